import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.operators import dims, polls, rollup, spatial, transfer, units


def test_families_and_lineage(spark):
    lineage = spark.createDataFrame([("PRP", "PATRIOTA", 2019), ("PATRIOTA", "PRD", 2023), ("A", "B", 2020), ("B", "A", 2021)], "party string, successor string, year int")
    parties = spark.createDataFrame([("PRP",), ("X",)], "party string")
    got = lambda y: {r["party"]: r["successor"] for r in dims.successors(parties, lineage, 2018, y).collect()}
    assert got(2026) == {"PRP": "PRD", "X": "X"} and got(2022)["PRP"] == "PATRIOTA"
    looped = spark.createDataFrame([("A", "B", 2020), ("B", "A", 2020)], "party string, successor string, year int")
    with pytest.raises(ValueError):
        dims.successors(spark.createDataFrame([("A",)], "party string"), looped, 2018, 2026).count()
    assigned = spark.createDataFrame([("P", 2018, "left"), ("Q", 2018, "right")], "party string, year int, family string")
    df = spark.createDataFrame([("P", 2018), ("Z", 2018), ("Y", 2018)], "party string, year int")
    with pytest.raises(dims.Unmatched) as e:
        dims.families(df, assigned)
    assert "Z" in str(e.value) and "Y" in str(e.value)
    with pytest.raises(ValueError):
        dims.families(df, assigned.unionByName(spark.createDataFrame([("P", 2018, "right")], assigned.schema)))


def test_crosswalk(spark):
    left = spark.createDataFrame([("SP", "1", "São Paulo", None), ("SP", "2", "Mogi-Mirim", None), ("SP", "3", "Old Name", "Other|New Town"), ("SP", "4", "Nowhere", None)], "uf string, code string, name string, alt string")
    right = spark.createDataFrame([("SP", "35001", "SAO PAULO"), ("SP", "35002", "Moji Mirim"), ("SP", "35003", "New Town"), ("SP", "35004", "Zzz")], "uf string, ibge string, label string")
    manual = spark.createDataFrame([("SP", "4", "35004", "renamed")], "uf string, code string, ibge string, reason string")
    m = dims.match_names(left, right, "uf", "code", "ibge", "name", "label", "alt", manual=manual)
    assert {r["code"]: (r["ibge"], r["method"]) for r in m.collect()} == {"1": ("35001", "exact"), "2": ("35002", "similar"), "3": ("35003", "alternative"), "4": ("35004", "manual")}
    ref = right.select("ibge")
    assert dims.violations(m.withColumn("pre", F.lit("35")), "code", "ibge", ref, "ibge", "pre").count() == 0
    with pytest.raises(dims.Unmatched):
        dims.must_match(spark.createDataFrame([("9",)], "code string"), m, ["code"])


def test_completed_coordinates(spark):
    p = spark.createDataFrame([("m", 1, "Escola A", "c", 1.0, 1.0), ("m", 2, "Escola Bela", "c", None, None), ("m", 3, "Gremio", "c", None, None), ("m", 4, "Nova", "d", None, None)], "unit string, place int, name string, district string, lat double, lon double")
    o = spark.createDataFrame([("m", 2, "ESCOLA BELA X", 2018, 5.0, 5.0), ("m", 9, "Grêmio", 2018, 6.0, 6.0)], "unit string, place int, name string, year int, lat double, lon double")
    got = {r["place"]: (r["lat"], r["coord_origin"]) for r in dims.completed_coordinates(p, o, ["unit"]).collect()}
    assert got[1] == (1.0, "own") and got[3] == (6.0, "same name") and got[4][1] == "none"


def test_grouped_options(spark):
    v = spark.createDataFrame([(1, k, n) for k, n in (("13", 100), ("22", 80), ("12", 10), ("30", 5), ("95", 3), ("96", 2))], "section int, option string, votes long")
    g = spark.createDataFrame([("13", "ab"), ("22", "xy"), ("12", "third"), ("95", "blank"), ("96", "blank")], "option string, grp string")
    got = {r["grp"]: r["votes"] for r in dims.grouped_options(v, g, ["section"]).collect()}
    assert got == {"ab": 100, "xy": 80, "third": 10, "otros": 5, "blank": 5}


def test_variance_parts_and_means(spark):
    rows = [("A", m, float(y), float(w)) for m, y, w in ((1, 0.2, 10), (1, 0.3, 5), (2, 0.6, 8), (2, 0.5, 4))] + [("B", m, float(y), float(w)) for m, y, w in ((3, 0.8, 10), (3, 0.7, 5), (4, 0.4, 8), (4, 0.9, 4))]
    r = rollup.variance_parts(spark.createDataFrame(rows, "uf string, m int, y double, w double"), "uf", "m", "y", "w").first()
    assert abs(sum(r) - 1) < 1e-12
    d = spark.createDataFrame([(0.4, 900.0), (0.9, 100.0), (None, 50.0)], "x double, w double")
    assert abs(d.agg(rollup.weighted_mean("x", "w")).first()[0] - 0.45) < 1e-12


def test_quantile_bins(spark):
    d = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert [r["bin"] for r in rollup.quantile_bin(d, "x", 5).orderBy("x").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert {r["bin"] for r in rollup.quantile_bin(flat, "x", 5).collect()} == {None}


def test_rank_top_and_grid(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 5.0)], "k string, x double")
    assert {r["k"]: r["r"] for r in rollup.average_rank(d, "x", "r").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}
    assert [r["k"] for r in rollup.top_per_group(d.withColumn("g", F.lit(1)), ["g"], [F.desc("x"), F.asc("k")], 2).orderBy("rank").collect()] == ["d", "b"]
    v = spark.createDataFrame([("a", 1, 5), ("b", 2, 7)], "u string, y int, v long")
    assert rollup.complete_grid(v, [["u"], ["y"]], "v").agg(F.count("*"), F.sum("v")).first()[:] == (4, 12)
    n = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert rollup.total(n, ["k"], "v").count() == 1  # a null key is no group


def test_transfer_matrix_recovers_and_sums(spark):
    rng = np.random.default_rng(1)
    b = np.array([[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.3, 0.3, 0.4]])
    x = rng.dirichlet([3, 3, 1], 800)
    y = x @ b + rng.normal(0, 0.005, (800, 3))
    w = rng.integers(200, 2000, 800)
    df = spark.createDataFrame([("g", *map(float, x[i]), *map(float, y[i]), float(w[i])) for i in range(800)], "g string, x0 double, x1 double, x2 double, y0 double, y1 double, y2 double, w double")
    m = transfer.transfer_matrix(transfer.gram(df, ["g"], ["x0", "x1", "x2"], ["y0", "y1", "y2"], "w"), ["g"], ["x0", "x1", "x2"], ["y0", "y1", "y2"]).toPandas()
    got = m.pivot(index="origin", columns="dest", values="p").to_numpy()
    assert np.abs(got - b).max() < 0.03 and np.allclose(got.sum(1), 1) and (got >= 0).all()
    free = np.random.default_rng(0).dirichlet([1, 1, 1], 3)
    xx, xy = (x * w[:, None]).T @ x, (x * w[:, None]).T @ y
    cost = lambda p: np.vdot(p, xx @ p) - 2 * np.vdot(p, xy)
    assert cost(got) <= cost(free) and cost(got) <= cost(np.full((3, 3), 1 / 3))


def matrix(spark, rows):
    return spark.createDataFrame([("X", o, d, float(p)) for o, r in rows.items() for d, p in r.items()], "unit string, origin string, dest string, p double")


BASE = {"ab": dict(ab=0.9, xy=0.05, blank=0.05, gone=0.0), "xy": dict(ab=0.05, xy=0.9, blank=0.05, gone=0.0), "otros": dict(ab=0.4, xy=0.4, blank=0.2, gone=0.0)}


def test_second_round(spark):
    v = spark.createDataFrame([("X", "ab", 60), ("X", "xy", 60), ("X", "third", 80)], "unit string, grp string, votes long")
    like = spark.createDataFrame([("third", "otros")], "grp string, like string")
    args = (v, matrix(spark, BASE), like)
    by = lambda df: {r["dest"]: round(r["votes"], 6) for r in df.collect()}
    plain = by(transfer.second_round(*args, None, ("ab", "xy"), ("blank", "gone"), "unit"))
    assert plain["ab"] == plain["xy"] == 89.0 and plain["blank"] == 22.0
    cells = spark.createDataFrame([("X", "third", "ab", 80.0)], "unit string, third string, origin string, votes double")
    moved = by(transfer.second_round(*args, cells, ("ab", "xy"), ("blank", "gone"), "unit"))
    assert moved["ab"] == 121.0 and moved["xy"] == 57.0
    forced = by(transfer.second_round(*args, None, ("ab", "xy"), ("blank", "gone"), "unit", override=spark.createDataFrame([("third", 1.0)], "grp string, share double")))
    assert forced == moved
    assert abs(sum(plain.values()) - 200) < 1e-9


def test_origin_cells_scale_to_the_observed(spark):
    now = spark.createDataFrame([("X", 1, "t", 20.0), ("X", 2, "t", 20.0), ("X", 3, "t", 10.0)], "unit string, place int, third string, votes double")
    before = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 1.0)], "place int, origin string, share double")
    m = spark.createDataFrame([("X", "a", "t", 0.2), ("X", "b", "t", 0.2)], "unit string, origin string, dest string, p double")
    got = {(r["place"], r["origin"]): r["votes"] for r in transfer.origin_cells(now, before, m, "unit", "place").collect()}
    assert got[(1, "a")] == 20 and got[(2, "b")] == 20 and got[(3, "a")] == got[(3, "b")] == 5


def test_blocks_recombine(spark):
    v = spark.createDataFrame([("X", g, 10.0) for g in ("ab", "xy", "otros")], "unit string, grp string, votes double")
    parts = transfer.blocks(v, matrix(spark, BASE), "unit")
    s = {r["scenario"]: r["share"] for r in transfer.recombine(parts, spark.createDataFrame([("same", "ab", 1.0), ("more", "ab", 2.0)], "scenario string, grp string, factor double"), "ab", "xy").collect()}
    assert abs(s["same"] - 0.5) < 1e-12 and s["more"] > 0.6


def test_least_squares_with_effects(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x), float(2 * x + 5 * g + e), 1.0) for g in range(4) for x, e in zip(rng.normal(size=50), rng.normal(0, 0.01, 50))]
    df = spark.createDataFrame(rows, "g int, x double, y double, w double")
    r = transfer.least_squares(df, [], ["x"], "y", "w", effects="g").first()
    assert abs(r["coef"] - 2) < 0.01 and r["r2"] > 0.99 and 0 < r["se"] < 0.01
    p = {x["term"]: x["coef"] for x in transfer.least_squares(df.where("g = 1"), [], ["x"], "y", "w", robust=False).collect()}
    assert abs(p["intercept"] - 5) < 0.01


def test_trend(spark):
    df = spark.createDataFrame([(float(d), 0.4 + 0.002 * d, 1000.0) for d in range(10)], "x double, y double, w double")
    assert abs(polls.trend(df, [], "x", "y", "w").first()["slope"] - 0.002) < 1e-12


def poll_rows(spark, rows):
    df = spark.createDataFrame([(dt.date(2022, 10, 1), f"p{i}", h, a, 1000, c, s) for i, (h, a, x) in enumerate(rows) for c, s in (("a", x), ("b", 1 - x))], "cutoff date, poll string, house string, age int, sample int, candidate string, share double")
    return df, spark.createDataFrame([], "house string, quality double")


def test_house_effects_are_taken_out(spark):
    df, q = poll_rows(spark, [("n1", 0, 0.5)] * 3 + [("n2", 0, 0.5)] * 3 + [("off", 0, 0.54)] * 6)
    r = {x["candidate"]: x for x in polls.aggregate(df, q, polls.PollSettings()).collect()}["a"]
    # effects cancel over the polls of a house, so they change nothing where all polls weigh the same
    assert abs(r["uncorrected"] - 0.52) < 1e-9 and abs(r["estimate"] - 0.52) < 1e-9
    df, q = poll_rows(spark, [("n1", 3, 0.5)] * 3 + [("n2", 3, 0.5)] * 3 + [("off", 0, 0.54)] * 6)
    r = {x["candidate"]: x for x in polls.aggregate(df, q, polls.PollSettings()).collect()}["a"]
    assert abs(r["uncorrected"] - 4.74 / 9) < 1e-9 and r["estimate"] < r["uncorrected"] - 0.003


def test_recent_polls_weigh_more(spark):
    df, q = poll_rows(spark, [("h", 29, 0.40), ("h", 0, 0.50)])
    assert {x["candidate"]: x["estimate"] for x in polls.aggregate(df, q, polls.PollSettings()).collect()}["a"] > 0.49


def test_track_record_orders_houses(spark):
    e = spark.createDataFrame([(y, h, "a", v) for y in (2018, 2022) for h, v in (("good", 0.005), ("mid", 0.03), ("bad", 0.06))], "year int, house string, candidate string, error double")
    t = {r["house"]: r["quality"] for r in polls.track_record(e, 1, ["year"]).collect()}
    assert t["good"] > 1 > t["bad"] and t["good"] > t["mid"] > t["bad"]


def test_runoff_rule_at_half(spark):
    v = spark.createDataFrame([("x", "a", 50), ("x", "b", 50), ("y", "a", 40), ("y", "b", 35), ("y", "c", 25)], "unit string, option string, votes long")
    got = units.runoff_pending(units.consolidate(v, ["unit"]), ["unit"]).collect()
    assert [(r["unit"], r["leader"]) for r in got] == [("y", "a")] and abs(got[0]["missing_pp"] - 10) < 1e-9


def test_party_votes_and_seats(spark):
    v = spark.createDataFrame([("U", 1, "P", 5, 2), ("U", 2, "Q", 3, None)], "unit string, place int, party string, nominal int, list int")
    e = spark.createDataFrame([("U", "P", "Eleito por QP"), ("U", "R", "NÃO ELEITO")], "unit string, party string, status string")
    f = spark.createDataFrame([("P", "left"), ("Q", "right")], "party string, family string")
    out = units.party_votes_and_seats(v, e, f, "unit", "place", 1)
    assert {r["party"]: (r["votes"], r["seats"]) for r in out["party_unit"].collect()} == {"P": (7, 1), "Q": (3, 0)}
    with pytest.raises(ValueError):
        units.party_votes_and_seats(v, e, f, "unit", "place", 2)


def test_merged_sections(spark):
    r = spark.createDataFrame([("U", 1, None, 10, 5, "A", 1.0, 1.0), ("U", 2, 1, 20, 5, "B", -1.0, -1.0), ("U", 3, -1, 30, 6, "C", 0.0, 0.0)], "unit string, section int, principal int, electors int, place int, name string, lat double, lon double")
    got = {x["section"]: x for x in units.merged_sections(r, ["unit"], "section", F.col("principal").isNotNull(), "principal").collect()}
    assert set(got) == {1, 3} and got[1]["electors"] == 30 and got[1]["name"] == "A" and got[3]["lat"] is None


def test_point_in_polygon(spark):
    e = spark.createDataFrame([("sq", 0.0, 0.0, 4.0, 0.0), ("sq", 4.0, 0.0, 4.0, 4.0), ("sq", 4.0, 4.0, 0.0, 4.0), ("sq", 0.0, 4.0, 0.0, 0.0)], "polygon string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0), (3, -1.0, 1.0), (4, 3.9, 3.9)], "point int, x double, y double")
    assert {r["point"] for r in spatial.point_in_polygon(p, e).collect()} == {1, 4}


def test_polygon_cells_equal_all_edges(spark):
    rng = random.Random(3)
    rings = [[(x, y) for x, y in ((rng.randint(-6, 6), rng.randint(-6, 6)) for _ in range(rng.randint(3, 9)))] for _ in range(40)]
    rings += [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(12)] for _ in range(10)] + [[(0, 0), (8, 0), (8, 8), (0, 8)]]
    edges = [(i, *map(float, a), *map(float, b)) for i, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1])]
    edges += [(len(rings) - 1, *map(float, a), *map(float, b)) for r in [[(2, 2), (6, 2), (6, 6), (2, 6)]] for a, b in zip(r, r[1:] + r[:1])]  # a hole
    pts = [(float(x) / 2, float(y) / 2) for x in range(-14, 15) for y in range(-14, 15)] + [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(200)]
    want = set()
    for k, (x, y) in enumerate(pts):
        n = {}
        for g, x1, y1, x2, y2 in edges:
            if y1 != y2 and min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                n[g] = n.get(g, 0) + 1
        want |= {(k, g) for g, c in n.items() if c % 2}
    e = spark.createDataFrame([*edges, (99, None, 0.0, 1.0, 1.0)], "polygon int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([*[(k, *xy) for k, xy in enumerate(pts)], (-1, None, 0.0)], "point int, x double, y double")
    for cell in (0.3, 1.0, 4.0):
        got = spatial.point_in_polygon(p, e, cell).collect()
        assert len(got) == len(want) and {(r["point"], r["polygon"]) for r in got} == want
    inside, cut = spatial.polygon_cells(e.where("polygon = 50"), 0.5)
    assert inside.count() > 100 and cut.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] <= 5


def test_clusters_and_outliers(spark):
    n = spark.createDataFrame([(i, 10.0 if i < 10 else (i * 37 % 11) / 10) for i in range(100)], "node int, x double")
    edges = n.select(F.col("node").alias("src"), F.explode(F.array((F.col("node") + 1) % 100, (F.col("node") + 99) % 100)).alias("dst"))
    assert spatial.moran(n, edges).first()["moran_i"] > 0.5
    hot = {r["node"] for r in spatial.local_clusters(n, edges, 199, 1, 0.05).where("cluster = 'high-high'").collect()}
    assert hot and hot <= set(range(-1, 11)) and {4, 5} <= hot
    assert spatial.local_clusters(n, edges, 199, 1, 0.05, star=True).where("cluster = 'high' and node = 5").count() == 1
    s = spark.createDataFrame([(p, i, 50 if (p, i) != (3, 0) else 95, 100) for p in range(20) for i in range(4)], "place int, section int, v long, n long")
    assert [(r["place"], r["section"]) for r in spatial.outliers(s, ["place"], "v", "n", 5.0).collect()] == [(3, 0)]


def test_local_regression(spark):
    rows = [(i, float(i % 10), float(i // 10), float(i % 7), float((1 if i % 10 < 5 else -1) * (i % 7))) for i in range(100)]
    fit = spatial.local_regression(spark.createDataFrame(rows, "node int, px double, py double, x double, y double"), ["x"], "y", 12, 4.0)
    c = {r["node"]: r["coef"] for r in fit.where("term = 'x'").collect()}
    assert c[0] > 0.9 and c[9] < -0.9 and spatial.aicc(fit).first()[0] is not None
