"""Scenario tables: reproducible draws, seat allocation and round rules as window operators over long rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import normals
from ..functions.maths import normal, share, student_t
from ..sources.shared import written
from . import rollup


def sims(spark: SparkSession, n: int) -> DataFrame:
    """``sim`` from 0 to n - 1."""
    return spark.range(n).select(F.col("id").cast("int").alias("sim"))


def allocate(votes: DataFrame, contest: Sequence[str], option: str, amount: str, seats: Column | str, threshold: float = 0.8) -> DataFrame:
    """Seats by highest averages: the ``seats`` largest of ``votes / 1, votes / 2, ...``, ties to the smaller option, then divisor.

    Only options with at least ``threshold`` times a quota (votes / seats) take
    part; if none has, all with votes do.  Only eligible options are fanned
    out, into one row per divisor.
    """
    s = F.col(seats) if isinstance(seats, str) else seats
    w = Window.partitionBy(*contest)
    base = votes.withColumn("_s", s).withColumn("_ok", F.col(amount) >= threshold * F.sum(amount).over(w) / F.greatest("_s", F.lit(1)))
    base = base.withColumn("_any", F.max("_ok").over(w)).withColumn("_in", (F.col("_s") > 0) & F.when(F.col("_any"), F.col("_ok")).otherwise(F.col(amount) > 0))
    fan = base.withColumn("_d", F.explode_outer(F.when(F.col("_in"), F.sequence(F.lit(1), F.col("_s").cast("int")))))
    rank = F.row_number().over(Window.partitionBy(*contest).orderBy(F.desc_nulls_last("_q"), option, "_d"))
    placed = fan.withColumn("_q", F.col(amount).cast("double") / F.col("_d")).withColumn("_r", rank)
    won = (F.col("_q").isNotNull() & (F.col("_r") <= F.col("_s"))).cast("int")
    return placed.groupBy(*contest, option).agg(F.max(amount).alias(amount), F.sum(won).cast("long").alias("seats"))


def list_scenarios(base: DataFrame, seats: DataFrame, noise: DataFrame, n_sim: int, seed: int, threshold: float = 0.8, unit: str = "unit", option: str = "list", family: str = "family") -> DataFrame:
    """``(sim, unit, family, seats)``: a family's share gets a national and a unit shock, lists follow it pro rata, seats are allocated.

    ``base`` has (unit, list, family, pct), ``seats`` (unit, seats), ``noise``
    (family, sigma_unit, sigma_national) in points.  A share stays at 0 or
    above, and one of 0 stays 0.  The draws depend on seed, simulation, unit and
    family only, so the same seed gives the same rows on any partitioning.
    """
    fam = base.groupBy(unit, family).agg(F.sum("pct").alias("_base"))
    shock = normal(seed, "sim", family, F.lit("national")) * F.col("sigma_national") / 100 + normal(seed, "sim", unit, family, F.lit("unit")) * F.col("sigma_unit") / 100
    moved = fam.join(F.broadcast(noise), family).crossJoin(F.broadcast(sims(base.sparkSession, n_sim))).withColumn("_new", F.when(F.col("_base") > 0, F.greatest(F.col("_base") + shock, F.lit(0.0))).otherwise(0.0))
    lists = moved.join(base, [unit, family]).withColumn("_p", F.coalesce(share(F.col("pct") * F.col("_new"), F.col("_base")), F.lit(0.0)))
    lists = lists.withColumn("_p", share(F.col("_p"), F.sum("_p").over(Window.partitionBy("sim", unit))))
    sized = lists.join(F.broadcast(seats.select(unit, F.col("seats").alias("_seats"))), unit)
    won = allocate(sized.select("sim", unit, option, family, "_p", "_seats"), ["sim", unit], option, "_p", "_seats", threshold)
    return won.join(base.select(unit, option, family), [unit, option]).groupBy("sim", unit, family).agg(F.sum("seats").alias("seats"))


def seat_summary(won: DataFrame, family: str = "family") -> DataFrame:
    """Mean, 10, 50 and 90 % points of a family's seats over the simulations."""
    per = won.groupBy("sim", family).agg(F.sum("seats").alias("seats"))
    q = F.percentile("seats", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return per.groupBy(family).agg(F.avg("seats").alias("mean"), q.alias("_q")).select(family, "mean", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p90"))


def two_winner_rule(strength: DataFrame, contest: Sequence[str], beta: float, family: str = "family", winners: int = 2, effect: Column | None = None) -> DataFrame:
    """Seats per family where a family's first entry has its strength and its second ``beta`` times that; the top entries win.

    ``strength`` has (contest, family, strength, n_cand).  ``effect`` is a
    logarithmic effect per entry and may use the column ``entry`` (1, 2).  Ties:
    all first entries by family before the second ones.
    """
    entries = strength.withColumn("entry", F.explode(F.array(F.lit(1), F.lit(2)))).where(F.col("entry") <= F.col("n_cand"))
    score = F.col("strength") * F.when(F.col("entry") == 2, F.lit(beta)).otherwise(1.0)
    if effect is not None:
        score = score * F.exp(effect)
    rank = F.row_number().over(Window.partitionBy(*contest).orderBy(F.desc("_score"), "entry", family))
    won = entries.withColumn("_score", score).withColumn("_w", (rank <= winners).cast("int")).groupBy(*contest, family).agg(F.sum("_w").cast("long").alias("seats"))
    return strength.select(*contest, family).distinct().join(won, [*contest, family], "left").withColumn("seats", F.coalesce("seats", F.lit(0).cast("long")))


def two_round_rule(candidates: DataFrame, contest: Sequence[str], beta: Column, sigma: Column, delta: Column, sigma_runoff: Column, z: Column, z_runoff: Column, candidate: str = "candidate") -> DataFrame:
    """``(contest, winner, runoff)``: above half of the score wins at once, else the first two meet with noise of their own.

    ``candidates`` has (contest, candidate, strength, first, incumbent).  The
    runoff's noise ``z_runoff`` may use ``place`` (1, 2).  Ties go to the smaller candidate.
    """
    score = F.col("strength") * F.when(F.col("first"), F.lit(1.0)).otherwise(beta) * F.exp(sigma * z + delta * F.col("incumbent").cast("int"))
    w = Window.partitionBy(*contest)
    scored = candidates.withColumn("_score", score).withColumn("_v", F.coalesce(share(F.col("_score"), F.sum("_score").over(w)), F.lit(0.0)))
    scored = scored.withColumn("place", F.row_number().over(w.orderBy(F.desc("_v"), candidate))).where("place <= 2").withColumn("_s2", F.col("_v") * F.exp(sigma_runoff * z_runoff))
    top = scored.groupBy(*contest).agg(F.max("_v").alias("_top"), F.min_by(candidate, "place").alias("_one"), F.max_by(candidate, F.struct("_s2", -F.col("place"))).alias("_two"))
    runoff = F.col("_top") <= 0.5
    return top.select(*contest, F.when(runoff, F.col("_two")).otherwise(F.col("_one")).alias("winner"), runoff.alias("runoff"))


GRID = ["beta", "sigma", "delta", "sigma_runoff"]
#: Simulations whose draws a task holds at a time, and outcomes that it evaluates, about.
HELD_SIMS, TASK_OUTCOMES = 4096, 1 << 21


def _outcomes(race: pd.DataFrame, points: np.ndarray, n_sim: int, seed: int) -> np.ndarray:
    """In how many simulations each grid point gives what happened in one race.

    The draws are one array per candidate, used by all points.  Points that
    share the candidates' noise, the list factor and the incumbent's bonus share
    the first round too.
    """
    race = race.sort_values("candidate")
    strength, first, incumbent = (race[c].to_numpy(float) for c in ("strength", "first", "incumbent"))
    good = ((race["family"] == race["real_family"]) & (race["incumbent"] == race["real_incumbent"])).to_numpy()
    real_runoff = bool(race["real_runoff"].iloc[0])
    rounds, which = np.unique(points[:, :3], axis=0, return_inverse=True)
    hits = np.zeros(len(points), np.int64)
    key = race["_race"].iloc[0]
    for low in range(0, n_sim, HELD_SIMS):
        sims_ = range(low, min(low + HELD_SIMS, n_sim))
        z = np.stack([normals([f"{seed}|{key}|{s}|{c}" for s in sims_]) for c in race["_candidate"]])
        z_runoff = np.stack([normals([f"{seed}|{key}|{s}|{place}|runoff" for s in sims_]) for place in (1, 2)])
        at = np.arange(len(sims_))
        noise = {sigma: np.exp(sigma * z) for sigma in np.unique(rounds[:, 1])}
        noise_runoff = {sigma: np.exp(sigma * z_runoff) for sigma in np.unique(points[:, 3])}
        for r, (beta, sigma, delta) in enumerate(rounds):
            score = (strength * np.where(first > 0, 1.0, beta) * np.exp(delta * incumbent))[:, None] * noise[sigma]
            total = score.sum(0)
            part = np.divide(score, total, out=np.zeros_like(score), where=total != 0)
            one = part.argmax(0)
            top = part[one, at].copy()
            part[one, at] = -1.0
            two = part.argmax(0)
            second = np.maximum(part[two, at], 0.0)
            runoff = top <= 0.5
            right = runoff == real_runoff
            for p in np.flatnonzero(which.ravel() == r):
                pair = noise_runoff[points[p, 3]]
                turned = runoff & (second * pair[1] > top * pair[0])
                hits[p] += int((good[np.where(turned, two, one)] & right).sum())
    return hits


def grid_likelihood(races: DataFrame, grid: DataFrame, n_sim: int, seed: int) -> DataFrame:
    """``(beta, sigma, delta, sigma_runoff, log_likelihood)`` of observed outcomes over a parameter grid with common random numbers.

    ``races`` has (race, candidate, family, strength, first, incumbent,
    real_family, real_incumbent, real_runoff).  A task takes a race, makes its
    draws once as arrays and evaluates every point over them; what leaves it is
    one share per point, summed up to the likelihood.  The grid is a table of
    parameters, and sent to the tasks.
    """
    spark = races.sparkSession
    table = grid.select(*GRID).distinct().toPandas().sort_values(GRID).astype(float).reset_index(drop=True)
    points = table.to_numpy()
    texts = [F.col(c).cast("string").alias(f"_{c}") for c in ("race", "candidate")]
    facts = races.select("race", "candidate", *texts, "family", F.col("strength").cast("double").alias("strength"), F.col("first").cast("int").alias("first"), F.col("incumbent").cast("int").alias("incumbent"), "real_family", F.col("real_incumbent").cast("int").alias("real_incumbent"), "real_runoff")
    facts = written(facts, "races")  # counted, then evaluated

    def run(race: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"point": np.arange(len(points)), "p": _outcomes(race, points, n_sim, seed) / n_sim})

    # a race is a few rows but much work, so their bytes must not decide how many share a task
    tasks = max(1, min(10_000, facts.select("race").distinct().count() * len(points) * n_sim // TASK_OUTCOMES))
    per = facts.repartition(tasks, "race").groupBy("race").applyInPandas(run, "point long, p double")
    scored = per.groupBy("point").agg(F.sum(F.log(F.col("p") + 1.0 / (2 * n_sim))).alias("log_likelihood"))
    named = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point long, " + ", ".join(f"{c} double" for c in GRID))
    return scored.join(named, "point").select(*GRID, "log_likelihood")


def best_points(likelihood: DataFrame, parameters: Sequence[str] = ("sigma", "delta", "sigma_runoff")) -> DataFrame:
    """The grid point of the highest likelihood (ties: the smallest parameters), and which parameters are at the upper edge of their grid."""
    order = [F.desc("log_likelihood"), *GRID]
    tops = likelihood.agg(*[F.max(p).alias(f"_max_{p}") for p in parameters])
    best = likelihood.orderBy(*order).limit(1).crossJoin(F.broadcast(tops))  # one row and one row
    edges = [F.when((F.col(f"_max_{p}") > 0) & (F.col(p) == F.col(f"_max_{p}")), F.lit(p)) for p in parameters]
    return best.select(*GRID, "log_likelihood", F.array_join(F.array_compact(F.array(*edges)), ",").alias("at_edge"))


def best_point(likelihood: DataFrame, parameters: Sequence[str] = ("sigma", "delta", "sigma_runoff")) -> dict[str, float]:
    """The grid point of the highest likelihood; one at the upper edge of its grid is an error."""
    edge = [F.max(p).alias(f"max_{p}") for p in parameters]
    best = F.max_by(F.struct(*[c for c in likelihood.columns if c != "log_likelihood"]), "log_likelihood").alias("best")
    row = likelihood.agg(best, *edge).first()
    at = row["best"].asDict()
    wide = [p for p in parameters if row[f"max_{p}"] > 0 and at[p] == row[f"max_{p}"]]
    if wide:
        raise ValueError(f"optimum at the upper edge of {wide}")
    return at


def swing_scenarios(units: DataFrame, n_sim: int, seed: int, sigma_unit: float, sigma_national: float) -> DataFrame:
    """National share per simulation: ``units`` (unit, share, weight) with unit and national shocks, kept in 0..1."""
    drawn = units.crossJoin(F.broadcast(sims(units.sparkSession, n_sim)))
    p = F.least(F.greatest(F.col("share") + normal(seed, "sim", F.lit("national")) * sigma_national + normal(seed, "sim", "unit") * sigma_unit, F.lit(0.0)), F.lit(1.0))
    return drawn.groupBy("sim").agg(share(F.sum(p * F.col("weight")), F.sum("weight")).alias("share"))


def student_scenarios(units: DataFrame, n_sim: int, seed: int, nu: int, sigma_unit: float, sigma_national: float) -> DataFrame:
    """``(sim, unit, share)`` with a common and an own Student-t shock, kept in 0..1; a row per unit serves single contests too."""
    drawn = units.crossJoin(F.broadcast(sims(units.sparkSession, n_sim)))
    p = F.col("share") + student_t(seed, nu, "sim", F.lit("national")) * sigma_national + student_t(seed, nu, "sim", "unit") * sigma_unit
    return drawn.select("sim", "unit", "weight", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("share"))


def win_probability(drawn: DataFrame, by: Sequence[str], value: str = "share", line: float = 0.5) -> DataFrame:
    """Probability above the line, mean and 5/25/50/75/95 % points."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    made = drawn.groupBy(*by).agg(F.avg((F.col(value) > line).cast("double")).alias("win"), F.avg(value).alias("mean"), q.alias("_q"))
    return made.select(*by, "win", "mean", *[F.col("_q")[i].alias(f"p{p:02d}") for i, p in enumerate((5, 25, 50, 75, 95))])


def pairing_scenarios(first: DataFrame, pairings: DataFrame, n_sim: int, seed: int, sigma: Column, sigma_runoff: float) -> DataFrame:
    """Two rounds with shared shocks: the two leaders of a simulated first round meet by their pairing's poll.

    ``first`` has (candidate, share), ``pairings`` (a, b, share_a) with a < b.
    Returns (sim, first, second, winner): a pairing without poll is decided by
    the first round's shares.
    """
    drawn = first.crossJoin(F.broadcast(sims(first.sparkSession, n_sim))).withColumn("_z", normal(seed, "sim", "candidate"))
    drawn = drawn.withColumn("_x", F.greatest(F.col("share") + sigma * F.col("_z"), F.lit(0.0)))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("sim").orderBy(F.desc("_x"), "candidate"))).where("_r <= 2")
    two = ranked.groupBy("sim").agg(F.min_by("candidate", "_r").alias("one"), F.max_by("candidate", "_r").alias("two"), F.min_by("_z", "_r").alias("z1"), F.max_by("_z", "_r").alias("z2"), F.max("_x").alias("x1"), F.min("_x").alias("x2"))
    met = two.withColumn("a", F.least("one", "two")).withColumn("b", F.greatest("one", "two")).join(F.broadcast(pairings), ["a", "b"], "left")
    base = F.when(F.col("share_a").isNull(), share(F.col("x1"), F.col("x1") + F.col("x2"))).otherwise(F.when(F.col("one") == F.col("a"), F.col("share_a")).otherwise(1 - F.col("share_a")))
    swing = base + (F.col("z1") - F.col("z2")) * sigma_runoff / 2 + normal(seed, "sim", F.lit("runoff")) * sigma_runoff
    return met.select("sim", F.col("one").alias("first"), F.col("two").alias("second"), F.when(swing >= 0.5, F.col("one")).otherwise(F.col("two")).alias("winner"))


def chamber(in_play: DataFrame, continuing: DataFrame, seats: int, family: str = "family") -> DataFrame:
    """Seats per simulation and family with those that continue; a simulation whose sum isn't ``seats`` is an error."""
    per = in_play.groupBy("sim", family).agg(F.sum("seats").alias("won"))
    grid = per.select("sim").distinct().crossJoin(F.broadcast(continuing.select(family, F.col("seats").alias("kept"))))
    all_ = per.join(grid, ["sim", family], "full_outer").select("sim", family, (F.coalesce("won", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("seats"))
    wrong = all_.groupBy("sim").agg(F.sum("seats").alias("n")).where(F.col("n") != seats).limit(1).collect()
    if wrong:
        raise ValueError(f"simulation {wrong[0][0]} has {wrong[0][1]} of {seats} seats")
    return all_


def list_base(votes: DataFrame, contest: Sequence[str], option: str = "list", family: str = "family", amount: str = "votes") -> DataFrame:
    """``(contest, list, family, pct)``: lists with their part of the contest; a list of more than one family is an error."""
    mixed = [r[0] for r in rollup.consistent(votes, option, family).limit(10).collect()]
    if mixed:
        raise ValueError(f"lists of several families: {mixed}")
    return rollup.share_of_group(rollup.total(votes, [*contest, option, family], amount), amount, contest, "pct")


def seat_differences(allocated: DataFrame, actual: DataFrame, contest: Sequence[str], option: str) -> DataFrame:
    """Per contest: seats allocated, seats on another option than the actual ones, and options with a difference."""
    k = [*contest, option]
    j = allocated.select(*k, F.col("seats").alias("_a")).join(actual.select(*k, F.col("seats").alias("_b")), k, "full_outer")
    gap = F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))
    return j.groupBy(*contest).agg(F.sum(F.coalesce("_a", F.lit(0))).alias("seats"), (F.sum(gap) / 2).alias("misplaced"), F.sum((gap > 0).cast("long")).alias("options"))


def race_probabilities(outcomes: DataFrame, candidates: DataFrame, race: Sequence[str], candidate: str = "candidate") -> DataFrame:
    """``(race, candidate, win, runoff)``: how often each candidate wins and the race has a second round, over the simulations of ``two_round_rule``."""
    n = outcomes.groupBy(*race).agg(F.count("*").alias("_n"), F.avg(F.col("runoff").cast("double")).alias("runoff"))
    won = outcomes.groupBy(*race, F.col("winner").alias(candidate)).agg(F.count("*").alias("_w"))
    j = candidates.select(*race, candidate).distinct().join(n, list(race)).join(won, [*race, candidate], "left")
    return j.select(*race, candidate, share(F.coalesce("_w", F.lit(0)), F.col("_n")).alias("win"), "runoff")


def coalition_thresholds(seats: DataFrame, coalitions: DataFrame, thresholds: DataFrame, party: str = "party") -> DataFrame:
    """Seats of each coalition against each named threshold, with what lacks."""
    sums = seats.join(F.broadcast(coalitions), party).groupBy("coalition").agg(F.sum("seats").cast("long").alias("seats"))
    j = sums.crossJoin(F.broadcast(thresholds))
    return j.select("coalition", "threshold", "seats", (F.col("seats") >= F.col("needed")).alias("reached"), F.greatest(F.col("needed") - F.col("seats"), F.lit(0)).cast("long").alias("lacking"))


def beta_update(groups: DataFrame, n_effective: float, prior_n: float = 20.0) -> DataFrame:
    """Posterior of a share per row (prior, side1, side0): a beta prior of ``prior_n`` and the data scaled to an effective number."""
    data = F.col("side1") + F.col("side0")
    n = F.least(data.cast("double"), F.lit(float(n_effective)))
    a = F.col("prior") * prior_n + F.coalesce(share(F.col("side1"), data), F.lit(0.0)) * n
    b = (1 - F.col("prior")) * prior_n + F.coalesce(share(F.col("side0"), data), F.lit(0.0)) * n
    return groups.withColumn("alpha", a).withColumn("beta", b).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))).withColumn("sd", F.sqrt(F.col("alpha") * F.col("beta") / (F.pow(F.col("alpha") + F.col("beta"), 2) * (F.col("alpha") + F.col("beta") + 1))))


def noise_parameters(volatility: DataFrame, national: bool = True, family: str = "family") -> DataFrame:
    """Unit noise is a family's volatility, national noise its mean change or 0."""
    return volatility.select(family, F.col("sd").alias("sigma_unit"), (F.abs(F.col("mean")) if national else F.lit(0.0)).alias("sigma_national"))
