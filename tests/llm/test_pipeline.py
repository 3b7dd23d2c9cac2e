"""The pipeline on the smallest tables: every stage's decisions take effect, against plain versions of them."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from votelake.llm import packing, queries, quality, toxicity


def test_stages_and_their_effects(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[2].startswith("n-gram")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for _, f in corpus_pipeline.STAGES[:-1]:
        steps.append(f(spark, steps[-1], sf_dir).cache())
        assert steps[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1]

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels.select("doc_id", F.col("quality").alias("y")))
    assert ids[1] == {r["doc_id"] for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    known = toxicity.fit_toxicity(steps[1], labels.select("doc_id", F.col("toxic").alias("y")))
    assert ids[2] == {r["doc_id"] for r in toxicity.score_toxicity(steps[1], known).where("predicted = 0").collect()}

    texts = {r["doc_id"]: r["text"] for r in steps[2].collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert ids[3] == {i for i in texts if find(i) == i}

    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = set()
    for i in ids[3]:
        text = " " + " ".join(re.findall(r"[^\W_]+", texts[i].lower())) + " "
        if any(" " + " ".join(w) + " " in text for w in items):
            dirty.add(i)
    assert dirty and not dirty & ids[4]

    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(out.doc_id) == ids[4] and out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
