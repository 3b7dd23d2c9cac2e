"""Empty tables, ties, several groups, nulls and clashing columns, for single operators and the whole pipeline."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from votelake.llm import decontamination, licences, packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, size int, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", len(t or ""), "t", 2, 0.5) for i, t in rows], SCHEMA)


def test_decontamination_of_no_documents(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "")], "item_id long, text string")
    none = docs(spark, [])
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.keep_uncontaminated(none, bench).columns == none.columns


def test_packing_in_several_groups_with_ties(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    rows = [(i, " ".join(["word"] * (1500 if i % 2 else 700))) for i in range(80)]  # two lengths only
    out = packing.pack(docs(spark, rows).repartition(5), queries.tokenizer_path()).toPandas()
    assert sorted(out.doc_id) == list(range(80)) and out.piece.max() == 0 and out.length.nunique() == 2
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], np.cumsum(g.length)[:-1]))).all() and g.length.sum() <= packing.CAPACITY
    assert out.sequence_id.nunique() < 60  # groups don't share numbers, and are packed


def test_a_very_long_text_with_many_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=400))
    text = "\n".join(filler() + "\n" + mit for _ in range(40))
    found = licences.scan(docs(spark, [(1, text), (1, text), (2, filler())])).collect()
    assert {r["doc_id"] for r in found} == {1} and len(found) == 40  # repeated rows of a document give each notice once


def tables(spark, at, rows, labels, items):
    docs(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_pipeline_of_no_documents(spark, tmp_path):
    tables(spark, tmp_path, [], [], [(1, "alpha beta gamma delta epsilon")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)


def test_pipeline_with_nulls_repeats_and_other_columns(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("token", F.lit("t")).withColumn("score", F.lit(0.5))
    clean = given.where("doc_id is not null and text is not null").orderBy("doc_id").first()
    odd = spark.createDataFrame([(900_001, None), (900_002, ""), (None, clean["text"] + " of no id"), (900_003, clean["text"])], "doc_id long, text string")
    given.unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    for n in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{n}.parquet").write.parquet(f"{tmp_path}/{n}.parquet")
    base = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 900_003 not in out or clean["doc_id"] not in base  # the copy goes, if the document itself stays
    assert {i for i in out if i is not None and i < 900_000} == base
