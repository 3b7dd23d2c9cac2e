import datetime as dt

from pyspark.sql import functions as F

from votelake.streaming import live

P = [0.45, 0.5, 0.55, 0.7]


def forecast(spark):
    return spark.createDataFrame([(i, "A" if i < 2 else "B", "R", 1000.0, p) for i, p in enumerate(P)], "code long, unit string, region string, valid double, p double")


def counted(spark, rows):
    return spark.createDataFrame(rows, "code long, side1 long, side0 long, pct double")


def test_empty_count_is_the_forecast(spark):
    r = live.estimate(live.projected_units(forecast(spark), counted(spark, []), 5000), 1.5).first()
    assert abs(r["share_projected"] - 55) < 1e-9 and r["sd_pp"] == 1.5 and r["counted_pct"] == 0 and r["share_counted"] is None


def test_uniform_deviation_is_projected(spark):
    rows = [(i, round((p + 0.05) * 500), 500 - round((p + 0.05) * 500), 0.5) for i, p in enumerate(P)]
    r = live.estimate(live.projected_units(forecast(spark), counted(spark, rows), 1), 1.5).first()
    assert abs(r["deviation_pp"] - 5) < 1e-6 and abs(r["share_projected"] - 60) < 0.1


def test_all_counted(spark):
    rows = [(i, round(p * 1000), 1000 - round(p * 1000), 1.0) for i, p in enumerate(P)]
    r = live.estimate(live.projected_units(forecast(spark), counted(spark, rows), 5000), 1.5).first()
    assert abs(r["share_projected"] - 55) < 1e-9 and r["counted_pct"] == 100 and r["sd_pp"] == 0.15 and r["win"] > 0.999
    abroad = live.estimate(live.projected_units(forecast(spark), counted(spark, rows), 5000), 1.5, overseas=(0.0, 0.0, 4000.0, 0.35)).first()
    assert abs(abroad["share_projected"] - 45) < 1e-9


def snapshots(spark):
    t = lambda h: dt.datetime(2022, 10, 30, h)
    return [[(0, 10, 10, 0.1, t(1)), (1, 50, 50, 1.0, t(1))], [(0, 30, 20, 0.5, t(3)), (1, 99, 0, 1.0, t(3))], [(0, 20, 20, 0.3, t(2)), (2, 5, 5, 0.01, t(4))]]


def test_stream_equals_replay(spark, tmp_path):
    parts = snapshots(spark)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, live.COUNT_SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"s{i}"))
    stream = spark.readStream.schema(live.COUNT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    live.track(stream, forecast(spark), str(tmp_path / "history"), str(tmp_path / "cp"), 5000, 1.5).awaitTermination()
    h = spark.read.parquet(str(tmp_path / "history")).orderBy("batch").collect()
    assert len(h) == 3
    all_rows = spark.createDataFrame([r for p in parts for r in p], live.COUNT_SCHEMA)
    batch = live.newest(all_rows)
    assert {r["code"]: (r["side1"], r["side0"]) for r in batch.collect()} == {0: (30, 20), 1: (50, 50), 2: (5, 5)}
    want = live.estimate(live.projected_units(forecast(spark), batch, 5000), 1.5).first()
    assert abs(h[-1]["share_projected"] - want["share_projected"]) < 1e-9
    assert not live.finished(spark.read.parquet(str(tmp_path / "history")))


def test_keyed_state_ignores_old_and_freezes_complete(spark, tmp_path):
    for i, rows in enumerate(snapshots(spark)):
        spark.createDataFrame(rows, live.COUNT_SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"s{i}"))
    stream = spark.readStream.schema(live.COUNT_SCHEMA).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    live.latest_counts(stream).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["code"]: (r["side1"], r["side0"]) for r in spark.table("latest").groupBy("code").agg(F.max_by("side1", "ts").alias("side1"), F.max_by("side0", "ts").alias("side0")).collect()}
    assert got == {0: (30, 20), 1: (50, 50), 2: (5, 5)}


def test_snapshots_until(spark):
    rows = spark.createDataFrame([r for p in snapshots(spark) for r in p], live.COUNT_SCHEMA)
    cut = spark.createDataFrame([(dt.datetime(2022, 10, 30, 2),), (dt.datetime(2022, 10, 30, 9),)], "cutoff timestamp")
    got = {(r["cutoff"].hour, r["code"]): r["side1"] for r in live.snapshots_until(rows, cut).collect()}
    assert got[(2, 0)] == 20 and got[(9, 0)] == 30 and (2, 2) not in got


def test_scaled_count(spark):
    df = spark.createDataFrame([("x", "a", 50, 50.0), ("x", "b", 50, 50.0), ("y", "a", 30, 100.0), ("z", "b", 9, 0.0)], "unit string, option string, votes long, pct double")
    assert {r["option"]: r["projected"] for r in live.scaled_count(df, "unit", "option", "votes", "pct").collect()} == {"a": 130.0, "b": 100.0}


def test_stream_stops_when_all_is_counted(spark, tmp_path):
    t = lambda h: dt.datetime(2022, 10, 30, h)
    parts = [[(0, 10, 10, 0.1, t(1)), (1, 50, 50, 1.0, t(1))], [(i, 50 + i, 50, 1.0, t(2)) for i in range(4)], [(0, 1, 9, 1.0, t(3)), (2, 1, 9, 1.0, t(3))]]
    put = lambda i: spark.createDataFrame(parts[i], live.COUNT_SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"s{i}"))
    put(0), put(1)
    stream = lambda: spark.readStream.schema(live.COUNT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    cp, h = str(tmp_path / "cp"), str(tmp_path / "history")
    q = live.track_to_end(spark, stream(), forecast(spark), h, cp, 5000, 1.5, every="0 seconds", wait=120)
    assert not q.isActive and not spark.streams.active
    rows = spark.read.parquet(h).orderBy("batch").collect()
    assert [r["batch"] for r in rows] == [0, 1] and rows[0]["counted_pct"] < 99 and rows[1]["counted_pct"] == 100 and rows[1]["n_units"] == 4
    state = {r["code"]: r["side1"] for r in live.stored_counts(spark, cp, 1).collect()}
    assert state == {0: 50, 1: 50, 2: 52, 3: 53}
    put(2)  # later files move the stream on and change nothing
    live.track(stream(), forecast(spark), h, cp, 5000, 1.5).awaitTermination()
    assert spark.read.parquet(h).orderBy("batch").collect() == rows
    assert {r["code"]: r["side1"] for r in live.stored_counts(spark, cp, 2).collect()} == state


def test_repeated_batch_writes_the_same_row(spark, tmp_path):
    for i, rows in enumerate(snapshots(spark)):
        spark.createDataFrame(rows, live.COUNT_SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"s{i}"))
    stream = spark.readStream.schema(live.COUNT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    cp, h = tmp_path / "cp", str(tmp_path / "history")
    live.track(stream, forecast(spark), h, str(cp), 5000, 1.5).awaitTermination()
    before = spark.read.parquet(h).orderBy("batch").collect()
    for f in (cp / "commits").glob("*2*"):
        f.unlink()  # as if the driver had died before the last batch was committed
    live.track(stream, forecast(spark), h, str(cp), 5000, 1.5).awaitTermination()
    assert spark.read.parquet(h).orderBy("batch").collect() == before and len(before) == 3
