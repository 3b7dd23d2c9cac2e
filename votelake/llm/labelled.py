"""Labelled documents to fit a classifier on: all, or bounded, reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import BROADCAST_IDS, bound_batches, materialize

#: Classes whose counts are broadcast; more are joined by a shuffle.
BROADCAST_CLASSES = 1 << 12


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id written as text leaves ``remainder``."""
    return F.crc32(id_col.cast("string")) % modulus == remainder


def classes_of(classes: DataFrame) -> DataFrame:
    """``(doc_id, y)``, one row per labelled id: rows with nulls are left out, and an id with several labels keeps the largest."""
    return classes.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, classes: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, y, weight)`` of at most ``per_class`` documents of each class.

    ``classes`` has ``(doc_id, y)``, one row per labelled id that may be learned
    from; rows with nulls are left out, and an id with several labels keeps the
    largest.  The documents taken are those whose hashed ids are smallest, so
    the sample does not depend on order or partitions.  Its ids, at most
    ``per_class`` times the number of classes, are broadcast if they are few
    enough.  ``weight`` is
    the number of labelled ids of the class that each taken one stands for.
    """
    labelled = classes_of(classes)
    # hashes are uniform, so this share of them has per_class rows of a class and few more; the rest is cut exactly
    counts = labelled.groupBy("y").agg(F.count("*").alias("n"))
    if counts.count() <= BROADCAST_CLASSES:
        counts = F.broadcast(counts)
    ample = per_class + 8 * per_class**0.5 + 64
    order = Window.partitionBy("y").orderBy("h", "doc_id")
    hashed = labelled.join(counts, "y").withColumn("h", F.xxhash64("doc_id")).where(F.col("h") / F.lit(2.0**64) + 0.5 <= ample / F.col("n"))
    cut = hashed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_class)
    some = cut.select("doc_id", "y", (F.col("n") / F.count("*").over(Window.partitionBy("y"))).alias("weight"))
    texts = bound_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = materialize(some, "labelled-sample")
    return texts.join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, "doc_id")
