"""Running sums over ranges against plain windows' definition, with one group that holds most rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.operators import rollup
from votelake.operators.ranges import exact_quantiles, quantiles_of, running


def test_running_values_cross_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, *range(-5, 9)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kinds = {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "x": ("bit_xor", F.col("v")), "low": ("min", F.col("v")), "top": ("max", F.col("v"))}
        got = {(r["g"], r["o"]): r for r in running(df, ["g"], ["o"], kinds).collect()}
        every = {r["o"]: r["n"] for r in running(df, [], ["o"], {"n": ("count", F.lit(1))}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert every == {o: o + 1 for _, o, _ in rows}
    now = defaultdict(list)
    for g, o, v in rows:
        now[g].append(v)
        have = [x for x in now[g] if x is not None]
        xor = 0
        for x in have:
            xor ^= x
        r = got[g, o]
        assert (r["s"], r["n"], r["low"], r["top"]) == (sum(have) if have else None, len(now[g]), min(have, default=None), max(have, default=None))
        assert r["x"] == (xor if have else None)


def test_running_values_of_nothing(spark):
    none = spark.createDataFrame([], "g string, o int, v int")
    assert running(none, ["g"], ["o"], {"s": ("sum", F.col("v"))}).count() == 0


def test_exact_quantiles_equal_the_interpolated_ones(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b"]), rng.choice([None, 1.5, 1.5, rng.gauss(0, 1), rng.randrange(4)])) for _ in range(2500)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, x in rows], "g string, x double").repartition(6)
    ps = [0.0, 0.002, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, "x", ps, ["g"]).collect()}
    for g in {g for g, _ in rows}:
        own = [float(x) for h, x in rows if h == g and x is not None]
        if own:
            assert got[g]["n"] == len(own)
            assert got[g]["quantiles"] == pytest.approx(np.quantile(own, ps).tolist(), abs=1e-12)
        else:
            assert g not in got
    whole = exact_quantiles(df, "x", [0.5]).collect()
    assert whole[0]["quantiles"] == pytest.approx([np.median([x for _, x in rows if x is not None])])
    assert exact_quantiles(df.limit(0), "x", [0.5]).collect()[0]["n"] == 0


def test_quantiles_of_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 4.0, 5.0), (2, None, None)], "g int, a double, b double")
    got = {r["g"]: (r["a"], r["b"]) for r in quantiles_of(df, {"a": F.col("a"), "b": F.col("b") * 2}, [0.5], ["g"]).collect()}
    assert got == {1: ([3.0], [10.0])}


def test_concentration_of_one_large_group(spark):
    rng = random.Random(6)
    rows = [("g", i, rng.randrange(1, 50)) for i in range(900)] + [("h", 1, 3)]
    got = {r["by"]: (r["reach_50"], r["reach_80"]) for r in rollup.concentration(spark.createDataFrame(rows, "by string, key int, v long").repartition(8), ["by"], "v", "key").collect()}
    own = sorted((v for g, _, v in rows if g == "g"), reverse=True)
    run = np.cumsum(own) / sum(own)
    assert got == {"g": (int((run < 0.5).sum()) + 1, int((run < 0.8).sum()) + 1), "h": (1, 1)}
