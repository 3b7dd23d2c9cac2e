"""Voter transfer: grouped sufficient statistics in one aggregate, a small solve per group, predictions as joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import poissons
from ..functions.maths import share

#: Draws that a bootstrap task makes at a time, and groups whose sums of all replicates it holds.
BATCH_DRAWS, HELD_GROUPS = 1 << 20, 256


def gram(df: DataFrame, by: Sequence[str], xs: Sequence[str], ys: Sequence[str], weight: Column | str) -> DataFrame:
    """``(by, xx, xy, yy, n)``: weighted sums of products of the columns, as arrays in row-major order.

    Rows with a null among them are left out.  One aggregate serves all groups;
    what follows never sees the rows again.
    """
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    own = df.dropna(subset=[*by, *xs, *ys]).withColumn("_w", w)
    d = lambda c: F.col(c).cast("double")
    xx = [F.sum(F.col("_w") * d(a) * d(b)) for a in xs for b in xs]
    xy = [F.sum(F.col("_w") * d(a) * d(b)) for a in xs for b in ys]
    yy = [F.sum(F.col("_w") * d(b) * d(b)) for b in ys]
    return own.groupBy(*by).agg(F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.array(*yy).alias("yy"), F.count("*").alias("n"))


def _onto_simplex(rows: np.ndarray) -> np.ndarray:
    """Each row moved to the nearest point with no negative entry and sum 1."""
    top = -np.sort(-rows, axis=1)
    over = np.cumsum(top, axis=1) - 1
    count = (top - over / np.arange(1, rows.shape[1] + 1) > 0).sum(axis=1)
    return np.maximum(rows - (over[np.arange(len(rows)), count - 1] / count)[:, None], 0)


def solve_rows(xx: np.ndarray, xy: np.ndarray, steps: int = 5000, tolerance: float = 1e-10) -> np.ndarray:
    """The matrix with rows on the simplex that minimises the weighted squared error, by accelerated projected gradient."""
    scale = float(np.linalg.eigvalsh(xx)[-1]) or 1.0
    b = np.full(xy.shape, 1 / xy.shape[1])
    ahead, t = b, 1.0
    for _ in range(steps):
        new = _onto_simplex(ahead - (xx @ ahead - xy) / scale)
        if np.vdot(ahead - new, new - b) > 0:
            t = 1.0  # the momentum points uphill: restart
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - b)
        moved, b, t = np.abs(new - b).max(), new, t_new
        if moved < tolerance:
            break
    return b


def transfer_matrix(sums: DataFrame, by: Sequence[str], xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """``(by, origin, dest, p, n)`` from ``gram``: shares of each origin that go to each destination; every row sums to 1."""
    keys, k, j = list(by), len(xs), len(ys)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                b = solve_rows(np.asarray(row.xx, float).reshape(k, k), np.asarray(row.xy, float).reshape(k, j))
                out += [(*[getattr(row, c) for c in keys], xs[a], ys[c], float(b[a, c]), row.n) for a in range(k) for c in range(j)]
            yield pd.DataFrame(out, columns=[*keys, "origin", "dest", "p", "n"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "origin string", "dest string", "p double", "n long"])
    tasks = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a group is a small row that costs a solve
    return sums.select(*keys, "xx", "xy", "n").repartition(tasks, *keys).mapInPandas(run, schema)


def with_fallback(own: DataFrame, parent: DataFrame, members: DataFrame, unit: str, region: str, least: int) -> DataFrame:
    """A unit's matrix if it rests on ``least`` rows, else its region's."""
    grid = members.select(unit, region).distinct().join(parent.select(region, "origin", "dest", F.col("p").alias("_rp")), region)
    j = grid.join(own.select(unit, "origin", "dest", F.col("p").alias("_p"), "n"), [unit, "origin", "dest"], "left")
    mine = F.coalesce(F.col("n") >= least, F.lit(False))
    return j.select(unit, "origin", "dest", F.when(mine, F.col("_p")).otherwise(F.col("_rp")).alias("p"), mine.alias("own"))


def national_matrix(matrix: DataFrame, mass: DataFrame, unit: str) -> DataFrame:
    """Mean of the units' matrices weighted by each origin's votes there (``mass``: unit, origin, votes)."""
    return matrix.join(mass, [unit, "origin"]).groupBy("origin", "dest").agg(share(F.sum(F.col("p") * F.col("votes")), F.sum("votes")).alias("p"))


def least_squares(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, weight: str, effects: str | None = None, robust: bool = True) -> DataFrame:
    """``(by, term, coef, se, r2, n)`` of weighted least squares with intercept, or with fixed effects by demeaning inside ``effects``.

    Two aggregates: the normal equations, then the sums for the errors; HC1
    errors if ``robust``, else classical.
    """
    own = df.dropna(subset=[*by, *xs, y, weight]).where(F.col(weight) > 0)
    terms = list(xs)
    if effects:
        mean = lambda c: share(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(f"_{c}")
        m = own.groupBy(*by, effects).agg(*[mean(c) for c in [*xs, y]])
        own = own.join(m, [*by, effects]).withColumns({c: F.col(c) - F.col(f"_{c}") for c in [*xs, y]})
    else:
        own, terms = own.withColumn("intercept", F.lit(1.0)), ["intercept", *xs]
    k, keys = len(terms), list(by)
    absorbed = own.groupBy(*by).agg(F.countDistinct(effects).alias("lost"), F.sum(weight).alias("wsum"), F.sum(F.col(weight) * F.col(y)).alias("ysum")) if effects else own.groupBy(*by).agg(F.lit(0).cast("long").alias("lost"), F.sum(weight).alias("wsum"), F.sum(F.col(weight) * F.col(y)).alias("ysum"))
    link = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    sums = link(gram(own, by, terms, [y], weight), absorbed)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "beta array<double>", "inv array<double>", "n long", "lost long", "tss double", "rss double"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                xx, xy = np.asarray(r.xx, float).reshape(k, k), np.asarray(r.xy, float)
                inv = np.linalg.pinv(xx)
                beta = inv @ xy
                out.append((*[getattr(r, c) for c in keys], beta.tolist(), inv.ravel().tolist(), r.n, r.lost, float(r.yy[0] - r.ysum**2 / r.wsum), float(r.yy[0] - beta @ xy)))
            yield pd.DataFrame(out, columns=[*keys, "beta", "inv", "n", "lost", "tss", "rss"])

    fit = sums.mapInPandas(solve, schema)
    e = F.col(y) - sum((F.col("beta")[i] * F.col(t) for i, t in enumerate(terms)), F.lit(0.0))
    resid = link(own, fit.select(*keys, "beta")).withColumn("_we", F.pow(F.col(weight) * e, 2))
    meat = resid.groupBy(*by).agg(F.array(*[F.sum(F.col("_we") * F.col(a) * F.col(b)) for a in terms for b in terms]).alias("meat"))

    def finish(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                inv, free = np.asarray(r.inv).reshape(k, k), max(r.n - k - r.lost, 1)
                cov = inv @ np.asarray(r.meat).reshape(k, k) @ inv * (r.n / free) if robust else inv * r.rss / free
                r2 = 1 - r.rss / r.tss if r.tss > 0 else None
                out += [(*[getattr(r, c) for c in keys], t, float(r.beta[i]), float(np.sqrt(max(cov[i, i], 0))), r2, r.n) for i, t in enumerate(terms)]
            yield pd.DataFrame(out, columns=[*keys, "term", "coef", "se", "r2", "n"])

    out = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "term string", "coef double", "se double", "r2 double", "n long"])
    return link(fit, meat).mapInPandas(finish, out)


def bootstrap_gram(df: DataFrame, by: Sequence[str], unit: Sequence[str], xs: Sequence[str], ys: Sequence[str], weight: str, replicates: int, seed: int) -> DataFrame:
    """``(replicate, by, xx, xy, yy, n)``: ``gram`` of every bootstrap replicate and group; a unit's weight in a replicate is a Poisson draw of its key.

    A task holds the sums of all replicates for the groups it meets and adds
    each row to them with its draws, a product of two matrices a batch; what it
    emits are these partial sums, so rows are never repeated per replicate.
    """
    own = df.dropna(subset=[*by, *xs, *ys])
    number = lambda c: F.col(c).cast("double")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in unit])
    columns = list(dict.fromkeys([*xs, *ys]))
    light = own.select(*by, key.alias("_key"), number(weight).alias("_w"), *[number(c).alias(f"_v_{c}") for c in columns])
    products = [(a, b) for a in xs for b in xs] + [(a, b) for a in xs for b in ys] + [(b, b) for b in ys]

    def partial(held: dict) -> pd.DataFrame:
        rows = [(*g, r, sums[r, :-1].tolist(), int(sums[r, -1])) for g, sums in held.items() for r in np.flatnonzero(sums[:, -1])]
        return pd.DataFrame(rows, columns=[*by, "replicate", "sums", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for low in range(0, len(batch), BATCH_DRAWS // replicates + 1):
                rows = batch.iloc[low : low + BATCH_DRAWS // replicates + 1]
                times = poissons(f"{seed}|{r}|{k}" for k in rows["_key"] for r in range(replicates)).reshape(len(rows), replicates)
                value = {c: rows[f"_v_{c}"].to_numpy(float) for c in columns}
                made = np.stack([rows["_w"].to_numpy(float) * value[a] * value[b] for a, b in products], 1)
                for g, at in rows.groupby(list(by), sort=False).indices.items():
                    g = g if isinstance(g, tuple) else (g,)
                    sums = held.setdefault(g, np.zeros((replicates, len(products) + 1)))
                    sums[:, :-1] += times[at].T @ made[at]
                    sums[:, -1] += (times[at] > 0).sum(0)
                if len(held) > HELD_GROUPS:
                    yield partial(held)
                    held = {}
        yield partial(held)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # a row is small but costs a digest per replicate, so its bytes must not decide how many share a task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = light.repartition(tasks, "_key").mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "replicate int, sums array<double>, n long"]))
    whole = parts.groupBy("replicate", *by).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(len(products))]).alias("s"), F.sum("n").alias("n"))
    k, j = len(xs), len(ys)
    return whole.select("replicate", *by, F.slice("s", 1, k * k).alias("xx"), F.slice("s", k * k + 1, k * j).alias("xy"), F.slice("s", k * (k + j) + 1, j).alias("yy"), "n")


def bootstrap_interval(replicated: DataFrame, mass: DataFrame, by: Sequence[str], sides: tuple[str, str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean, deviation and percentiles of side 1's share over bootstrap replicates of a transfer matrix.

    ``replicated`` has (replicate, by, origin, dest, p), re-estimated in each
    replicate; ``mass`` (by, origin, votes).  One row per replicate is summed
    over all groups.
    """
    votes = F.col("p") * F.col("votes")
    at = lambda d: F.coalesce(F.sum(F.when(F.col("dest") == d, votes)), F.lit(0.0))
    per = replicated.join(mass, [*by, "origin"]).groupBy("replicate").agg(at(sides[0]).alias("a"), at(sides[1]).alias("b"))
    shares = per.select(share("a", F.col("a") + F.col("b")).alias("share"))
    q = F.percentile("share", F.array(F.lit(low), F.lit(high)))
    s = shares.agg(F.count("*").alias("replicates"), F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"), q.alias("_q"))
    return s.select("replicates", "mean", "sd", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def origin_cells(now: DataFrame, before: DataFrame, matrix: DataFrame, unit: str, place: str) -> DataFrame:
    """``(unit, place, third, origin, votes)``: a third candidate's votes by what their voters chose before, scaled to what was observed.

    ``now`` has (unit, place, third, votes), ``before`` (place, origin, share),
    ``matrix`` (unit, origin, dest, p) from origins to first-round options.  A
    place without history takes its unit's vote-weighted composition.
    """
    j = now.join(matrix.withColumnRenamed("dest", "third"), [unit, "third"]).join(before.select(place, "origin", "share"), [place, "origin"], "left")
    w = F.col("share") * F.col("p")
    mean = j.groupBy(unit, "third", "origin").agg(F.coalesce(F.sum(w * F.col("votes")), F.lit(0.0)).alias("_mean"))
    known = before.select(place).distinct().withColumn("_known", F.lit(True))
    k = j.join(mean, [unit, "third", "origin"]).join(known, place, "left").withColumn("_w", F.when(F.col("_known"), F.coalesce(w, F.lit(0.0))).otherwise(F.col("_mean")))
    total = k.groupBy(unit, place, "third").agg(F.sum("_w").alias("_t"))
    return k.join(total, [unit, place, "third"]).select(unit, place, "third", "origin", (F.col("votes") * F.coalesce(share("_w", "_t"), F.lit(0.0))).alias("votes"))


def second_round(votes: DataFrame, matrix: DataFrame, analogy: DataFrame, cells: DataFrame | None, sides: tuple[str, str], lost: tuple[str, str], unit: str, place: str | None = None, override: DataFrame | None = None) -> DataFrame:
    """Second-round votes per unit (or place) and destination.

    ``votes`` has (unit, [place], grp, votes); ``matrix`` (unit, origin, dest,
    p); ``analogy`` (grp, like) names the matrix row of a third group, a group
    that isn't there uses its own row.  Of a third group's valid votes the share
    of the first side is that of its row; or, with ``cells`` (unit, [place],
    third, origin, votes), that of its voters' origins, the undecided ones split
    as the row; or what ``override`` (grp, share) says.
    """
    a, b = sides
    here = [unit, place] if place else [unit]
    m = matrix.groupBy(unit, F.col("origin").alias("like")).agg(*[F.sum(F.when(F.col("dest") == d, F.col("p"))).alias(f"_{i}") for i, d in enumerate([a, b, *lost])])
    v = votes.groupBy(*here, "grp").agg(F.sum("votes").alias("votes")).join(F.broadcast(analogy), "grp", "left").withColumn("_third", F.col("like").isNotNull())
    j = v.withColumn("like", F.coalesce("like", "grp")).join(m, [unit, "like"])
    valid = F.col("_0") + F.col("_1")
    row_share = F.coalesce(share(F.col("_0"), valid), F.lit(0.5))
    part = row_share
    if cells is not None:
        c = cells.groupBy(*here, F.col("third").alias("grp")).agg(F.sum(F.when(F.col("origin") == a, F.col("votes"))).alias("_ca"), F.sum(F.when(F.col("origin").isin(*lost), F.col("votes"))).alias("_cu"), F.sum("votes").alias("_ct"))
        j = j.join(c, [*here, "grp"], "left")
        part = F.coalesce(share(F.coalesce("_ca", F.lit(0.0)) + F.coalesce("_cu", F.lit(0.0)) * row_share, F.when(F.col("_ct") > 0, F.col("_ct"))), row_share)
    if override is not None:
        j = j.join(F.broadcast(override.select("grp", F.col("share").alias("_fixed"))), "grp", "left")
        part = F.coalesce("_fixed", part)
    part = F.when(F.col("_third"), part).otherwise(row_share)
    n = F.col("votes").cast("double")
    parts = F.array(*[F.struct(F.lit(d).alias("dest"), (n * x).alias("votes")) for d, x in ((a, valid * part), (b, valid * (1 - part)), (lost[0], F.col("_2")), (lost[1], F.col("_3")))])
    return j.select(*here, F.explode(parts).alias("x")).select(*here, "x.*").groupBy(*here, "dest").agg(F.sum("votes").alias("votes"))


def two_sided_share(predicted: DataFrame, sides: tuple[str, str], by: Sequence[str] = (), extra: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Share of the first side, with votes counted elsewhere added to both."""
    s = [F.coalesce(F.sum(F.when(F.col("dest") == d, F.col("votes"))), F.lit(0.0)) + e for d, e in zip(sides, extra)]
    return predicted.groupBy(*by).agg(s[0].alias("side1"), s[1].alias("side0")).withColumn("share", share("side1", F.col("side1") + F.col("side0")))


def blocks(votes: DataFrame, matrix: DataFrame, unit: str) -> DataFrame:
    """``(grp, dest, votes)``: what each group sends where, summed over units; any scenario is a recombination of these."""
    return votes.join(matrix.withColumnRenamed("origin", "grp"), [unit, "grp"]).groupBy("grp", "dest").agg(F.sum(F.col("votes") * F.col("p")).alias("votes"))


def recombine(parts: DataFrame, factors: DataFrame, side: str, other: str) -> DataFrame:
    """Share of ``side`` per scenario from block votes and factors ``(scenario, grp, factor)`` of a group's turnout; without one it is 1."""
    scenarios = factors.select("scenario").distinct()
    j = parts.crossJoin(F.broadcast(scenarios)).join(F.broadcast(factors), ["scenario", "grp"], "left").withColumn("x", F.col("votes") * F.coalesce("factor", F.lit(1.0)))
    s = j.groupBy("scenario").agg(F.sum(F.when(F.col("dest") == side, F.col("x"))).alias("s1"), F.sum(F.when(F.col("dest") == other, F.col("x"))).alias("s0"))
    return s.select("scenario", share("s1", F.col("s1") + F.col("s0")).alias("share"))


def predicted_units(shares: DataFrame, matrix: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Predicted destination shares of units ``(by, unit, origin, share)`` under their group's matrix."""
    return shares.join(matrix, [*by, "origin"]).groupBy(*by, unit, "dest").agg(F.sum(F.col("share") * F.col("p")).alias("predicted"))


def needed_swing(units: DataFrame) -> DataFrame:
    """Reserve and need: votes not cast by each side's past voters, and the part of them that would reach half.

    ``units`` has (unit, side1, side0, reserve1, reserve0).
    """
    s = units.agg(*[F.sum(c).cast("double").alias(c) for c in ("side1", "side0", "reserve1", "reserve0")])
    gap = F.col("side0") - F.col("side1")
    return s.select("*", gap.alias("gap"), share(gap, F.col("reserve1")).alias("needed_of_reserve1"), share(-gap, F.col("reserve0")).alias("needed_of_reserve0"))


def coefficient_change(fit: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``(by, term, before, after, change)``: each coefficient of ``least_squares`` in the first and the last election."""
    s = fit.groupBy(*by, "term").agg(F.min_by("coef", order).alias("before"), F.max_by("coef", order).alias("after"))
    return s.withColumn("change", F.col("after") - F.col("before"))


def endorsement(gap: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Share of side 1 per scenario ``(scenario, follow, turnout)``: of a third group ``turnout`` comes, ``follow`` of these choose side 1.  ``gap`` is one row (side1, side0, third)."""
    j = scenarios.crossJoin(F.broadcast(gap)).withColumn("_t", F.col("third") * F.col("turnout"))
    return j.select("scenario", share(F.col("side1") + F.col("_t") * F.col("follow"), F.col("side1") + F.col("side0") + F.col("_t")).alias("share"))


def path_grid(gap: DataFrame, shares: Sequence[float], extra: Sequence[float]) -> DataFrame:
    """Sensitivity table: every share of a third group against every number of extra votes, with the resulting side share.

    ``gap`` is one row (side1, side0, third).
    """
    spark = gap.sparkSession
    grid = spark.createDataFrame([(float(s), float(e)) for s in shares for e in extra], "third_share double, extra double")
    one = F.col("side1") + F.col("third") * F.col("third_share") + F.col("extra")
    all_ = F.col("side1") + F.col("side0") + F.col("third") + F.col("extra")
    return grid.crossJoin(F.broadcast(gap)).select("third_share", "extra", share(one, all_).alias("share"))
