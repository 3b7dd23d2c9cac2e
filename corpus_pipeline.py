"""The corpus pipeline: quality, toxicity, near duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all the documents that
the stages before it kept; all but the last return the columns they were given.
``sf_dir`` has the labels that classifiers learn from and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.llm import decontamination, ngram_join, packing, quality, toxicity
from votelake.llm.queries import tokenizer_path
from votelake.llm.storage import discard, materialize


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("y"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking of labelled documents accepts."""
    return quality.keep_good(docs, quality.fit_quality(docs, _labels(spark, sf_dir, "quality")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of the nearest labelled documents don't flag."""
    return toxicity.keep_civil(docs, toxicity.fit_toxicity(docs, _labels(spark, sf_dir, "toxic")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep_representatives(docs, n=5, num=80, den=100)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the trained and iterative stages; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and read again; a stage's table goes once the next one's is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, before = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")), old
        if before is not None:
            discard(before)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
