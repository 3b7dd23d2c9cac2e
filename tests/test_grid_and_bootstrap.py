"""Draws, the likelihood of whole grids and bootstrap sums in tasks against the same work by rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.functions import draws, maths
from votelake.operators import scenario, transfer


def test_draws_are_those_of_the_columns(spark):
    rows = spark.range(200).select("id", maths.uniform(5, "id", F.lit("x")).alias("u"), maths.normal(5, "id", F.lit("x")).alias("z"), maths.poisson_one(5, "id", F.lit("x")).alias("k")).orderBy("id").collect()
    keys = [f"5|{i}|x" for i in range(200)]
    assert draws.uniforms(keys).tolist() == [r["u"] for r in rows]
    assert draws.normals(keys).tolist() == pytest.approx([r["z"] for r in rows], abs=1e-12)
    assert draws.poissons(keys).tolist() == [r["k"] for r in rows]
    assert draws.uniforms([]).tolist() == []


RACES = "race string, candidate string, family string, strength double, first boolean, incumbent boolean, real_family string, real_incumbent boolean, real_runoff boolean"


def some_races():
    rng = random.Random(9)
    rows = []
    for r in range(6):
        n = rng.randrange(1, 5)
        own = [(f"r{r}", f"c{i}", f"f{i % 3}", rng.random(), i < 2, i == 1) for i in range(n)]
        real = rng.choice(own)
        rows += [(*c, real[2], real[5], rng.random() < 2 if n > 1 else False) for c in own]
    return rows + [("flat", "a", "f0", 0.5, True, False, "f0", False, False), ("flat", "b", "f1", 0.5, True, False, "f0", False, False), ("none", "a", "f0", 0.0, True, False, "f0", False, True)]


def by_rows(races, grid, n_sim, seed):
    """Every race, draw and point as a row of the two-round rule."""
    out = []
    for beta, sigma, delta, sigma_runoff in grid:
        cells = races.crossJoin(scenario.sims(races.sparkSession, n_sim))
        lits = [F.lit(float(x)) for x in (beta, sigma, delta, sigma_runoff)]
        won = scenario.two_round_rule(cells, ["race", "sim"], *lits, maths.normal(seed, "race", "sim", "candidate"), maths.normal(seed, "race", "sim", "place", F.lit("runoff")))
        facts = races.select("race", F.col("candidate").alias("winner"), "family", "incumbent", "real_family", "real_incumbent", "real_runoff")
        ok = (F.col("family") == F.col("real_family")) & (F.col("incumbent") == F.col("real_incumbent")) & (F.col("runoff") == F.col("real_runoff"))
        per = won.join(facts, ["race", "winner"]).groupBy("race").agg(F.avg(ok.cast("double")).alias("p")).collect()
        out.append((beta, sigma, delta, sigma_runoff, sum(math.log(r["p"] + 1 / (2 * n_sim)) for r in per)))
    return out


def test_grid_likelihood_equals_the_rule_by_rows(spark, monkeypatch):
    races = spark.createDataFrame(some_races(), RACES)
    points = [(0.5, 0.0, 0.0, 0.0), (0.5, 0.8, 0.4, 0.0), (1.0, 0.8, 0.4, 0.7), (0.5, 0.8, 0.0, 0.7)]
    grid = spark.createDataFrame([*points, points[0]], "beta double, sigma double, delta double, sigma_runoff double")
    monkeypatch.setattr(scenario, "HELD_SIMS", 17)
    got = sorted(map(tuple, scenario.grid_likelihood(races, grid, 50, 3).collect()))
    want = sorted(by_rows(races, points, 50, 3))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-9)


def test_best_points_name_the_edges(spark):
    rows = [(0.5, 0.1, 0.0, 0.0, -3.0), (0.5, 0.2, 0.0, 0.0, -2.0), (0.5, 0.1, 0.4, 0.0, -2.5), (0.7, 0.2, 0.0, 0.0, -2.0)]
    best = scenario.best_points(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*scenario.GRID, "log_likelihood"]))).collect()
    assert [tuple(r) for r in best] == [(0.5, 0.2, 0.0, 0.0, -2.0, "sigma")]


def test_bootstrap_sums_equal_those_of_repeated_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"u{i % 3}", i, rng.random(), rng.random(), None if i == 5 else rng.random(), rng.random()) for i in range(90)] + [(None, 500, 0.1, 0.2, 0.3, 1.0)]
    df = spark.createDataFrame(rows, "unit string, place int, a double, b double, y double, w double").repartition(3)
    reps = spark.range(12).select(F.col("id").cast("int").alias("replicate"))
    fan = df.crossJoin(reps).withColumn("_times", maths.poisson_one(17, "replicate", "place")).where("_times > 0")
    want = {(r["replicate"], r["unit"]): r for r in transfer.gram(fan, ["replicate", "unit"], ["a", "b"], ["y"], F.col("w") * F.col("_times")).collect()}
    for held, batch in ((256, 1 << 20), (1, 100)):
        monkeypatch.setattr(transfer, "HELD_GROUPS", held)
        monkeypatch.setattr(transfer, "BATCH_DRAWS", batch)
        got = {(r["replicate"], r["unit"]): r for r in transfer.bootstrap_gram(df, ["unit"], ["place"], ["a", "b"], ["y"], "w", 12, 17).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k]["n"] == r["n"]
            for c in ("xx", "xy", "yy"):
                assert np.allclose(got[k][c], r[c])
