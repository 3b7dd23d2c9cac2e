import datetime as dt

from pyspark.sql import functions as F

from votelake.operators import polls, territory

COLUMNS = "unit string, place int, side1 long, side0 long, third long, reserve1 long, reserve0 long, electors long, p double"


def places(spark):
    return territory.stakes(spark.createDataFrame([("A", 1, 60, 40, 10, None, 5, 200, 0.6), ("A", 2, 10, 30, 0, 2, None, 100, None), ("B", 3, 0, 0, 7, 0, 0, 50, None)], COLUMNS))


def test_stakes(spark):
    got = {r["place"]: r for r in places(spark).collect()}
    assert got[1]["at_stake"] == 15 and got[1]["gap"] == 20 and abs(got[1]["elasticity"] - 0.4) < 1e-12
    assert got[2]["p"] == 0.25 and got[2]["at_stake"] == 2 and got[3]["p"] == 0.5 and got[3]["elasticity"] == 0
    t = {r["unit"]: r for r in territory.stake_table(places(spark), ["unit"]).collect()}
    assert t["A"]["n"] == 2 and t["A"]["share"] == 0.5 and t["B"]["share"] is None and abs(t["A"]["part_at_stake"] - 17 / 24) < 1e-12
    assert t["A"]["gap"] == 0 and t["A"]["part_gap"] is None
    assert territory.stake_table(places(spark).limit(0), ["unit"]).count() == 0


def test_gathered(spark):
    t = spark.createDataFrame([(i, 10 if i < 4 else 1) for i in range(24)], "place int, at_stake long")
    assert {r["part"]: r["n"] for r in territory.gathered(t, "at_stake", "place", [0.5, 0.8]).collect()} == {0.5: 3, 0.8: 12}


def test_turnout_cases(spark):
    got = {r["scenario"]: r for r in territory.turnout_cases(places(spark), {"a": (F.col("unit") == "A", 10.0), "none": (F.lit(False), 5.0)}).collect()}
    assert got["a"]["added"] == 30 and abs(got["a"]["share"] - (70 + 12 + 2.5) / 170) < 1e-12 and got["none"]["change"] == 0


def test_cluster_profile(spark):
    labels = spark.createDataFrame([(1, "high-high"), (2, "none"), (3, "none")], "place int, cluster string")
    got = {(r["unit"], r["cluster"]): r for r in territory.cluster_profile(labels, places(spark), "unit", "place").collect()}
    assert got[("A", "none")]["share"] == 0.25 and abs(got[("A", "high-high")]["part"] - 2 / 3) < 1e-12 and got[("B", "none")]["share"] is None


def test_before_votes(spark):
    day = lambda n: dt.date(2022, 10, n)
    p = spark.createDataFrame([("a", day(2)), ("b", day(9)), ("c", day(28)), ("d", day(30)), ("e", None)], "poll string, end_date date")
    v = spark.createDataFrame([(1, day(2), day(30))], "contest int, since date, vote_date date")
    got = {}
    for r in polls.before_votes(p, v, 20, 14).collect():
        assert r["age"] == (30 - r["end_date"].day) - r["days"]
        got.setdefault(r["poll"], set()).add(r["days"])
    assert got == {"b": set(range(7, 21)), "c": {1, 2}}
