"""What the n-gram join keeps on disk: shuffle files go with their write, and sets that are not alike don't make blocks."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.llm import ngram_join, storage


def test_shuffle_files_go_with_the_write(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in dirs for p in Path(d.getPath()).glob("*/shuffle_*")}

    before = files()
    out = storage.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition("count"), "grouped")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 7
    assert spark.conf.get(storage._CLEAN_CONF) == "false"


@pytest.mark.parametrize("num, den", [(85, 100), (4, 5), (1, 2), (1, 1)])
@pytest.mark.parametrize("n", [1, 6, 40, 300, 900, 5000])
def test_sketches_of_similar_sets_differ_in_few_bits(n, num, den):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 1 << 64, k, dtype=np.uint64)
    differ = lambda x, y: int(np.bitwise_count((ngram_join._sketch(np.unique(x)) ^ ngram_join._sketch(np.unique(y))).view(np.uint64)).sum())
    need = ngram_join._need(n, n, num, den)
    for _ in range(50):
        x = draw(n)
        y = np.concatenate((x[:need], draw(n - need)))
        part = x[: -(-num * n // den)]  # the smallest similar subset
        assert differ(x, y) <= min(ngram_join._most_differing(num, den), 2 * (n - need))
        assert differ(x, part) <= min(ngram_join._most_differing(num, den), n + len(part) - 2 * ngram_join._need(n, len(part), num, den))
        if n >= 40 and num / den >= 0.8:
            assert differ(x, draw(n)) > min(ngram_join._most_differing(num, den), 2 * (n - need))


def test_long_texts_that_share_sentences_make_no_cluster(spark, monkeypatch):
    rng, seen = random.Random(5), []
    sentence = lambda k: " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(12))
    texts = [[] for _ in range(40)]
    for k in range(10_000):  # each sentence is in two texts: most first shingles of a text are in some other one
        s = sentence(k)
        for i in rng.sample(range(40), 2):
            texts[i].append(s)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows.append((99, " ".join(texts[7][:-20])))  # and one is a near copy
    blocks = ngram_join._cluster_blocks
    monkeypatch.setattr(ngram_join, "_cluster_blocks", lambda clusters, sizes: seen.append(clusters.count()) or blocks(clusters, sizes))
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {**{i: i for i in range(40)}, 99: 7}
    assert seen[0] <= 2
