"""Neighbour searches where points lie far closer than the cells that a search begins with, and where many are at one place."""

import math
import random

import numpy as np

from votelake.operators import spatial


def test_candidates_follow_density(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random()) for i in range(2000)] + [(2000, 5000.0, 0.0)]
    p = spark.createDataFrame(rows, "focus int, fx double, fy double")
    t = p.selectExpr("focus as node", "fx as px", "fy as py")
    pairs = spatial.near_candidates(p, t, ["focus"], "fx", "fy", "px", "py", 5, 100.0)
    assert pairs.where("focus < 2000").count() < 400 * 2000
    assert pairs.where("focus = node").count() == 2001


def test_copies_at_one_place_are_fitted_each(spark):
    rng = random.Random(6)
    rows = [(i, 0.5, 0.5, rng.random(), rng.random()) for i in range(300)] + [(300 + i, rng.random(), rng.random(), rng.random(), rng.random()) for i in range(100)]
    df = spark.createDataFrame(rows, "node int, px double, py double, v double, w double").repartition(3)
    got = {(r["node"], r["term"]): r for r in spatial.local_regression(df, ["v"], "w", 20, 50.0).collect()}
    assert len(got) == 800
    for i in (0, 19, 299, 350):
        d = [math.hypot(r[1] - rows[i][1], r[2] - rows[i][2]) for r in rows]
        near = sorted(range(400), key=lambda j: (d[j], j))[:20]  # noqa: B023
        top = d[near[-1]]
        weight = np.array([(1 - (d[j] / top) ** 2) ** 2 if top else 1.0 for j in near])
        x, y = np.array([(1.0, rows[j][3]) for j in near]), np.array([rows[j][4] for j in near])
        inverse = np.linalg.pinv((x * weight[:, None]).T @ x)
        beta, own = inverse @ ((x * weight[:, None]).T @ y), np.array([1.0, rows[i][3]])
        r = got[i, "v"]
        assert abs(r["coef"] - beta[1]) < 1e-9 and abs(r["hat"] - own @ inverse @ own) < 1e-9 and abs(r["residual"] - (rows[i][4] - own @ beta)) < 1e-9
