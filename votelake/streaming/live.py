"""Live counts: projection, estimator against a forecast, replay of snapshots, and the streaming upsert."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from threading import Event
from time import monotonic
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.maths import normal_cdf, share

COUNT_SCHEMA = "code long, side1 long, side0 long, pct double, ts timestamp"
#: A trigger that takes what is there now.
ONCE: Mapping[str, Any] = {"availableNow": True}


def scaled_count(counts: DataFrame, unit: str, option: str, votes: str, pct: str, by: Sequence[str] = ()) -> DataFrame:
    """Each unit's votes scaled by 100 / percent counted (nothing where that is 0), summed per option, with shares."""
    grown = F.coalesce(F.try_divide(F.col(votes) * 100.0, F.col(pct)), F.lit(0.0))
    s = counts.groupBy(*by, option).agg(F.sum(grown).alias("projected"))
    total = s.groupBy(*by).agg(F.sum("projected").alias("_t"))
    j = s.join(F.broadcast(total), list(by)) if by else s.crossJoin(F.broadcast(total))
    return j.withColumn("share", share("projected", "_t")).drop("_t")


def _joined(forecast: DataFrame, counts: DataFrame, key: Sequence[str]) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    snapshots = counts.select(*key).distinct() if key else None
    grid = forecast.crossJoin(F.broadcast(snapshots)) if key else forecast
    j = grid.join(counts.select(*key, "code", "side1", "side0", "pct"), [*key, "code"], "left")
    j = j.select(*key, "code", "unit", "region", F.col("valid").cast("double").alias("valid"), "p", zero("side1"), zero("side0"), zero("pct"))
    j = j.withColumn("c", F.col("side1") + F.col("side0"))
    return j.withColumn("r", share("side1", F.when(F.col("c") > 0, F.col("c"))) - F.col("p"))


def projected_units(forecast: DataFrame, counts: DataFrame, k: float, key: Sequence[str] = ()) -> DataFrame:
    """Per counted unit: its deviation, swing, final size and projected votes of the first side.

    ``forecast`` has (code, unit, region, valid, p); ``counts`` (key, code,
    side1, side0, pct) with pct from 0 to 1.  A unit's swing is its counted
    votes' deviation from the forecast, shrunk with ``k`` votes toward its
    region's, which is shrunk toward the nation's.  What isn't counted follows
    the place's own deviation as far as it is counted, and the swing beyond.
    """
    m, keys = _joined(forecast, counts, key), list(key)
    dev = F.sum(F.coalesce(F.col("r"), F.lit(0.0)) * F.col("c"))
    unit = m.groupBy(*keys, "unit", "region").agg(dev.alias("s"), F.sum("c").alias("w"))
    region = unit.groupBy(*keys, "region").agg(F.sum("s").alias("rs"), F.sum("w").alias("rw"))
    nation = region.groupBy(*keys).agg(F.coalesce(share(F.sum("rs"), F.sum("rw")), F.lit(0.0)).alias("nation"))
    link = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    region = link(region, nation).withColumn("region_dev", (F.col("rs") + k * F.col("nation")) / (F.col("rw") + k))
    swing = unit.join(region, [*keys, "region"]).select(*keys, "unit", ((F.col("s") + k * F.col("region_dev")) / (F.col("w") + k)).alias("swing"), "region_dev", "nation")
    j = m.join(F.broadcast(swing), [*keys, "unit"])
    size = F.greatest(F.when(F.col("pct") > 0.02, F.col("c") / F.greatest("pct", F.lit(0.02))).otherwise(F.col("valid")), F.col("c"))
    own = F.coalesce("r", F.lit(0.0)) * F.col("pct") + F.col("swing") * (1 - F.col("pct"))
    rest = F.least(F.greatest(F.col("p") + own, F.lit(0.0)), F.lit(1.0))
    return j.withColumn("total", size).withColumn("projected", F.col("side1") + (F.col("total") - F.col("c")) * rest)


def estimate(units: DataFrame, sd: float, key: Sequence[str] = (), by: Sequence[str] = (), overseas: tuple[float, float, float, float] | None = None) -> DataFrame:
    """National (or per ``by``) state of the count: counted and projected share, deviation, spread, probability of the first side.

    ``overseas`` is (side1, side0, forecast valid, forecast share), projected
    with the nation's deviation.  The spread shrinks with the part counted, to
    0.15 points at least.
    """
    g = [*key, *by]
    s = units.groupBy(*g).agg(F.sum("side1").alias("n1"), F.sum("c").alias("nc"), F.sum("projected").alias("np"), F.sum("total").alias("nt"), F.sum(F.col("p") * F.col("c")).alias("ne"), F.sum(F.col("p") * F.col("valid")).alias("nf"), F.sum("valid").alias("nv"), F.max("nation").alias("nation"))
    if overseas is not None:
        a, b, valid, p = overseas
        size = max(valid, a + b)
        s = s.withColumns({"n1": F.col("n1") + a, "nc": F.col("nc") + a + b, "np": F.col("np") + a + (size - a - b) * (F.lit(p) + F.col("nation")), "nt": F.col("nt") + size, "ne": F.col("ne") + p * (a + b)})
    pct = lambda a, b: share(F.col(a), F.when(F.col(b) > 0, F.col(b))) * 100
    s = s.select(*g, pct("nc", "nt").alias("counted_pct"), pct("n1", "nc").alias("share_counted"), pct("ne", "nc").alias("share_expected"), pct("np", "nt").alias("share_projected"), pct("nf", "nv").alias("share_forecast"), (F.col("nation") * 100).alias("deviation_pp"))
    s = s.withColumn("sd_pp", F.greatest(F.lit(sd) * (1 - F.coalesce(F.col("counted_pct"), F.lit(0.0)) / 100), F.lit(0.15)))
    return s.withColumn("win", normal_cdf((F.col("share_projected") - 50) / F.col("sd_pp")))


def snapshots_until(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The latest row of each unit at every cutoff: all replayed snapshots as one keyed table.

    A row holds from its time until its unit's next one, so it meets only the
    cutoffs of that span; these come as one sorted list in one row.  Of rows of
    a unit at the same time the largest counts.
    """
    rest = [c for c in counts.columns if c not in ("code", "ts")]
    once = counts.groupBy("code", "ts").agg(F.max(F.struct(*rest)).alias("x")).select("code", "ts", "x.*")
    span = once.withColumn("_next", F.lead("ts").over(Window.partitionBy("code").orderBy("ts")))
    list_ = cutoffs.agg(F.array_sort(F.collect_set("cutoff")).alias("_cutoffs"))
    own = F.filter("_cutoffs", lambda c: (c >= F.col("ts")) & (F.col("_next").isNull() | (c < F.col("_next"))))
    return span.crossJoin(F.broadcast(list_)).select(F.explode(own).alias("cutoff"), "code", "ts", *rest)


def replay(forecast: DataFrame, counts: DataFrame, cutoffs: DataFrame, k: float, sd: float) -> DataFrame:
    """``estimate`` at every cutoff, in one job."""
    return estimate(projected_units(forecast, snapshots_until(counts, cutoffs), k, ["cutoff"]), sd, ["cutoff"])


class LatestCount(StatefulProcessor):
    """Keeps the newest row of a unit: an older snapshot changes nothing, and a unit counted wholly is frozen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "side1 long, side0 long, pct double, ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        new = pd.concat(list(rows)).sort_values(["ts", "pct", "side1", "side0"])
        changed = False
        for r in new.itertuples(index=False):
            if old is not None and (old[2] >= 1 or r.ts <= old[3]):
                continue
            old, changed = (int(r.side1), int(r.side0), float(r.pct), r.ts), True
        if changed:
            self.state.update(old)
            yield pd.DataFrame([(key[0], *old)], columns=["code", "side1", "side0", "pct", "ts"])

    def close(self) -> None:
        pass


def read_counts(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of count snapshots from JSON files."""
    return spark.readStream.schema(COUNT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest_counts(counts: DataFrame) -> DataFrame:
    """Stream of the units that changed, by keyed state in the state store, which must be RocksDB's: the session is set so."""
    counts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return counts.groupBy("code").transformWithStateInPandas(LatestCount(), COUNT_SCHEMA, "Update", "None")


def newest(counts: DataFrame, until: Column | None = None) -> DataFrame:
    """Batch form of the state: rows up to a unit's first complete one, the newest of them; a tie takes the larger values."""
    own = counts if until is None else counts.where(until)
    done = own.where("pct >= 1").groupBy("code").agg(F.min("ts").alias("_done"))
    j = own.join(done, "code", "left").where("_done is null or ts <= _done")
    return j.groupBy("code").agg(F.max(F.struct("ts", "pct", "side1", "side0")).alias("x")).select("code", "x.side1", "x.side0", "x.pct", "x.ts")


def stored_counts(spark: SparkSession, checkpoint: str, batch: int) -> DataFrame:
    """The newest row of every unit after a batch, read from the state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").option("batchId", batch).load()
    return state.select("key.code", "value.*").select("code", "side1", "side0", "pct", "ts")


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of history there are, None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def finished(rows: DataFrame | None, stop_at: float = 99.99) -> bool:
    """Whether the last row of history says that the count is complete."""
    row = rows.orderBy(F.desc("batch")).select("counted_pct").first() if rows is not None else None
    return row is not None and row[0] is not None and row[0] >= stop_at


def track(counts: DataFrame, forecast: DataFrame, history_path: str, checkpoint: str, k: float, sd: float, stop_at: float = 99.99, trigger: Mapping[str, Any] = ONCE) -> StreamingQuery:
    """Re-estimate after every micro-batch and append one row of history, until ``stop_at`` percent are counted.

    A batch brings the units that it changed; the others are read from the
    state store as the batch before it left them, so counts are stored once.
    History is written under the batch's number: a repeated batch starts from
    the same state and replaces its own row by an equal one.  Once the count is
    complete, further batches change nothing.  ``trigger`` is that of a
    ``DataStreamWriter``; by default, what is there now.
    """

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        before = history(s, history_path)
        if before is not None and finished(before.where(F.col("batch") < number), stop_at):
            batch.write.format("noop").mode("overwrite").save()  # state moves on with every batch
            return
        rows = new = batch.persist()
        if number > 0:
            rows = stored_counts(s, checkpoint, number - 1).join(new.select("code"), "code", "left_anti").unionByName(new)
        row = estimate(projected_units(forecast, rows, k), sd).crossJoin(rows.agg(F.count("*").alias("n_units")))
        row.write.mode("overwrite").parquet(f"{history_path}/batch={number}")
        new.unpersist()

    return latest_counts(counts).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class CountListener(StreamingQueryListener):
    """Says when the history of a count is complete; looked at after every batch."""

    def __init__(self, spark: SparkSession, history_path: str, stop_at: float) -> None:
        self.spark, self.path, self.stop_at, self.complete = spark, history_path, stop_at, Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if finished(history(self.spark, self.path), self.stop_at):
            self.complete.set()

    def onQueryTerminated(self, event) -> None:
        pass


def track_to_end(spark: SparkSession, counts: DataFrame, forecast: DataFrame, history_path: str, checkpoint: str, k: float, sd: float, stop_at: float = 99.99, every: str = "30 seconds", wait: float | None = None) -> StreamingQuery:
    """``track`` every so often until the count is complete, or for ``wait`` seconds; the query that is returned is stopped.

    A query that failed raises its error.
    """
    listener = CountListener(spark, history_path, stop_at)
    spark.streams.addListener(listener)
    until = None if wait is None else monotonic() + wait
    try:
        q = track(counts, forecast, history_path, checkpoint, k, sd, stop_at, {"processingTime": every})
        while q.isActive and not listener.complete.wait(0.2) and (until is None or monotonic() < until):
            pass
        if q.exception() is not None:
            raise q.exception()
        q.stop()
        return q
    finally:
        spark.streams.removeListener(listener)
