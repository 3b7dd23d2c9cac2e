"""Where the operators of this subpackage keep intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast to a join, at most.
BROADCAST_IDS = 1 << 20
#: Bytes of a batch of rows that Spark sends to a Python worker, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's batches to Python workers bounded by BATCH_BYTES.

    Texts differ in length, so Spark's bound on rows does not bound memory.  A
    smaller bound that the session has already stays.
    """
    conf = df.sparkSession.conf
    size = re.fullmatch(r"\s*(-?\d+)\s*([bkmgt]?)b?\s*", conf.get(_BATCH_CONF).lower())
    now = int(size[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[size[2]] if size and int(size[1]) > 0 else None
    if now is None or now > BATCH_BYTES:
        conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")
    return df


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of all rows, a number and a string, in bounded batches."""
    return bound_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and
    the driver is the one executor, as in tests, a new temporary folder takes
    its place; on a cluster an unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="votelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends here.

    A lost executor costs nothing that was written, unlike with a local
    checkpoint, whose blocks have one copy.  The shuffle files of the write go
    with its end; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(_CLEAN_CONF, None)
    spark.conf.set(_CLEAN_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_CONF, before) if before is not None else spark.conf.unset(_CLEAN_CONF)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them is written itself."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ids_to_join(ids: DataFrame, name: str) -> DataFrame:
    """A one-column table of distinct ids, written, counted, and marked for broadcast if it has at most BROADCAST_IDS rows.

    Then the other side of a semi- or anti-join, which may hold whole texts, is
    not shuffled; a larger table is joined by a shuffle.
    """
    ids = materialize(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
