"""Neighbour searches, positions, stored results and small operators against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.operators import rollup, scenario, spatial, transfer
from votelake.sources import scan


def cloud(seed, n):
    """Points in clumps of very different density, some at the same place."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        wide = rng.choice([0.01, 0.3, 5.0, 40.0])
        rows.append((i, rng.gauss(0, wide), max(-80.0, min(80.0, rng.gauss(10, wide)))))
    return rows + [(n + i, 1.0, 1.0) for i in range(5)] + [(n + 5, 170.0, -79.0)]


@pytest.mark.parametrize("cell", [0.05, 3.0])
def test_nearest_place_is_exact(spark, cell):
    s, p = cloud(1, 150), cloud(2, 60)
    sectors = spark.createDataFrame([(i % 3, i, lon, lat) for i, lon, lat in s] + [(0, 999, None, None), (7, 1000, 1.0, 1.0)], "unit int, sector int, lon double, lat double")
    places = spark.createDataFrame([(i % 3, i, lon, lat) for i, lon, lat in p], "unit int, place int, lon double, lat double")
    got = {r["sector"]: (r["place"], r["km"]) for r in spatial.nearest_place(sectors, places, "unit", cell=cell).collect()}
    for i, lon, lat in s:
        km = lambda q: math.hypot((lat - q[2]) * 111.32, (lon - q[1]) * 111.32 * math.cos(math.radians(lat)))  # noqa: B023, E731
        best = min((q for q in p if q[0] % 3 == i % 3), key=lambda q: (km(q), q[0]))  # noqa: B023
        assert abs(got[i][1] - km(best)) < 1e-6
    assert 999 not in got and 1000 not in got and len(got) == len(s)


@pytest.mark.parametrize("k, cell", [(1, 0.1), (12, 0.1), (12, 100.0), (500, 1.0)])
def test_local_regression_takes_the_k_nearest(spark, k, cell):
    rows = cloud(3, 120)
    df = spark.createDataFrame([(i, x, y, math.sin(i), math.cos(i) + i % 3) for i, x, y in rows], "node int, px double, py double, v double, w double")
    got = {(r["node"], r["term"]): r for r in spatial.local_regression(df, ["v"], "w", k, cell).collect()}
    pos = np.array([(x, y) for _, x, y in rows])
    for i in range(0, len(rows), 17):
        d = np.hypot(*(pos - pos[i]).T)
        near = sorted(range(len(rows)), key=lambda j: (d[j], j))[:k]  # noqa: B023
        assert got[i, "v"]["n"] == len(near)
        b = max(d[near])
        weight = (1 - (d[near] / b) ** 2) ** 2 if b else np.ones(len(near))
        x = np.column_stack((np.ones(len(near)), [math.sin(j) for j in near]))
        y = np.array([math.cos(j) + j % 3 for j in near])
        beta = np.linalg.pinv((x * weight[:, None]).T @ x) @ ((x * weight[:, None]).T @ y)
        if k > 5:
            assert abs(got[i, "v"]["coef"] - beta[1]) < 1e-6 and abs(got[i, "intercept"]["coef"] - beta[0]) < 1e-6


def test_positions_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")).repartition(5)
    want = {k: i for i, k in enumerate(sorted(r["k"] for r in df.collect()))}
    for size in (10, 300, 50_000):
        assert {r["k"]: r["pos"] for r in rollup.numbered(df, "k", per_task=size).collect()} == want
    assert rollup.numbered(df.limit(0), "k").count() == 0


def test_stored_results_are_computed_once(spark, tmp_path):
    inputs = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "sha256 string, x int")
    asked = []

    def compute(df):
        asked.append(sorted(r["sha256"] for r in df.select("sha256").distinct().collect()))
        return df.groupBy("sha256").agg(F.sum("x").alias("x"))

    for keys in (["a"], ["a", "b"], ["b"]):
        out = scan.stored_results(spark, str(tmp_path / "r"), inputs.where(F.col("sha256").isin(keys)), compute)
        assert {r["sha256"]: r["x"] for r in out.collect()} == {k: {"a": 1, "b": 5}[k] for k in keys}
    assert asked == [["a"], ["b"], []]


def test_mixed_lists_are_an_error(spark):
    v = spark.createDataFrame([("u", "l", "f1", 3), ("u", "l", "f2", 1)], "unit string, list string, family string, votes long")
    with pytest.raises(ValueError, match="l"):
        scenario.list_base(v, ["unit"])
    assert scenario.list_base(v.where("family = 'f1'"), ["unit"]).first()["pct"] == 1


def test_bootstrap_interval(spark):
    p = spark.createDataFrame([(r, "u", o, d, x) for r in range(20) for o, d, x in (("a", "s", 0.5 + r / 100), ("a", "t", 0.5 - r / 100))], "replicate int, unit string, origin string, dest string, p double")
    mass = spark.createDataFrame([("u", "a", 10.0)], "unit string, origin string, votes double")
    r = transfer.bootstrap_interval(p, mass, ["unit"], ("s", "t")).first()
    shares = 0.5 + np.arange(20) / 100
    assert r["replicates"] == 20 and abs(r["mean"] - shares.mean()) < 1e-9 and abs(r["sd"] - shares.std(ddof=1)) < 1e-9
    assert abs(r["low"] - np.quantile(shares, 0.05)) < 1e-9 and abs(r["high"] - np.quantile(shares, 0.95)) < 1e-9


def test_bandwidths_equal_fits_for_each_k(spark):
    rng = random.Random(12)
    rows = [(i, rng.random() * 9, rng.random() * 9, rng.random(), rng.random()) for i in range(70)] + [(70, 1.0, 1.0, 0.5, 0.5), (71, 1.0, 1.0, 0.2, 0.9), (72, None, 1.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "node int, px double, py double, v double, w double").repartition(3)
    got = {r["k"]: (r["aicc"], r["chosen"]) for r in spatial.bandwidths(df, ["v"], "w", [40, 12, 25, 25, 500], 2.0).collect()}
    want = {k: spatial.aicc(spatial.local_regression(df, ["v"], "w", k, 2.0)).first()[0] for k in (12, 25, 40, 500)}
    assert {k: a for k, (a, _) in got.items()} == pytest.approx(want, rel=1e-9)
    assert [k for k, (_, c) in got.items() if c] == [min(want, key=want.get)]
