"""Polls: valid shares, track records, house effects, aggregates at many dates in one job, backtests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.maths import half_life, share


@dataclass(frozen=True)
class PollSettings:
    """Window in days, half-life of a poll's weight in days, largest sample that counts, shrinkage in polls, iterations."""

    window: int = 45
    half: float = 3.0
    sample_cap: float = 2000.0
    shrink: float = 2.0
    iterations: int = 5


def long_polls(wide: DataFrame, ids: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """One row per poll and candidate from a wide table of numbers; empty cells are left out."""
    return wide.unpivot(list(ids), list(candidates), "candidate", "pct").where("pct is not null")


def rejected(rows: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds the first reason that applies as ``reject_reason`` (null: the row is kept)."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(list(reasons)):
        out = F.when(cond, name).otherwise(out)
    return rows.withColumn("reject_reason", out)


def valid_share(polls: DataFrame, poll: Sequence[str] = ("poll",), value: str = "pct") -> DataFrame:
    """Shares of each poll's sum; a missing value is 0."""
    return polls.withColumn("share", share(F.coalesce(F.col(value), F.lit(0.0)), F.sum(value).over(Window.partitionBy(*poll))))


def main_scenario(polls: DataFrame, by: Sequence[str], scenario: str = "scenario", poll: str = "poll") -> DataFrame:
    """The rows of the scenario that most polls have; ties to the smaller name."""
    n = polls.groupBy(*by, scenario).agg(F.countDistinct(poll).alias("_n"))
    best = n.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), scenario))).where("_r = 1").select(*by, scenario)
    return polls.join(F.broadcast(best), [*by, scenario], "left_semi")


def house_errors(polls: DataFrame, results: DataFrame, contest: Sequence[str], days: int, top: int = 2) -> DataFrame:
    """Mean error per contest, house and candidate of the polls that ended from ``days`` days before the vote on, for the leading candidates.

    ``polls`` has (contest, poll, house, end_date, candidate, share); ``results``
    (contest, candidate, result, vote_date).
    """
    lead = results.withColumn("_r", F.row_number().over(Window.partitionBy(*contest).orderBy(F.desc("result"), "candidate"))).where(F.col("_r") <= top).drop("_r")
    j = polls.join(F.broadcast(lead), [*contest, "candidate"]).where(F.col("end_date") >= F.date_sub("vote_date", days))
    return j.groupBy(*contest, "house", "candidate").agg(F.avg(F.col("share") - F.col("result")).alias("error"), F.count("*").alias("n_polls"))


def track_record(errors: DataFrame, k: float, contest: Sequence[str], exclude: DataFrame | None = None) -> DataFrame:
    """``(house, contests, rmse, rmse_shrunk, quality)``: mean squared error per house and contest, shrunk to the industry's with ``k`` contests."""
    own = errors if exclude is None else errors.join(F.broadcast(exclude), "house", "left_anti")
    obs = own.groupBy("house", *contest).agg(F.avg(F.col("error") * F.col("error")).alias("sq"))
    industry = obs.agg(F.avg("sq").alias("industry"))
    t = obs.groupBy("house").agg(F.sum("sq").alias("s"), F.count("*").alias("contests")).crossJoin(F.broadcast(industry))
    s2 = (F.lit(k) * F.col("industry") + F.col("s")) / (F.lit(k) + F.col("contests"))
    return t.select("house", "contests", F.sqrt(F.col("s") / F.col("contests")).alias("rmse"), F.sqrt(s2).alias("rmse_shrunk"), share(F.col("industry"), s2).alias("quality"))


def rolling_quality(errors: DataFrame, k: float, contest: str, last: int) -> DataFrame:
    """``(contest, house, quality)`` for contests 2 to ``last``: the track record from the contests before each, numbered from 1.

    Each contest's errors count for all later ones, an equi-join by exploding;
    a house without record has no row.
    """
    obs = errors.groupBy("house", contest).agg(F.avg(F.col("error") * F.col("error")).alias("sq")).where(F.col(contest) < last)
    later = obs.withColumn("_for", F.explode(F.sequence(F.col(contest) + 1, F.lit(last).cast(errors.schema[contest].dataType))))
    industry = later.groupBy("_for").agg(F.avg("sq").alias("_all"))
    own = later.groupBy("_for", "house").agg(F.sum("sq").alias("_s"), F.count("*").alias("_n")).join(F.broadcast(industry), "_for")
    s2 = (F.lit(k) * F.col("_all") + F.col("_s")) / (F.lit(k) + F.col("_n"))
    return own.select(F.col("_for").alias(contest), "house", share(F.col("_all"), s2).alias("quality"))


def at_cutoffs(polls: DataFrame, cutoffs: DataFrame, window: int) -> DataFrame:
    """Each poll row with every cutoff from its end to ``window`` days later: an equi-join on the days of that span, not a range join."""
    days = polls.withColumn("cutoff", F.explode(F.sequence(F.col("end_date"), F.date_add("end_date", window))))
    return days.join(F.broadcast(cutoffs), "cutoff").withColumn("age", F.datediff("cutoff", "end_date"))


def before_votes(polls: DataFrame, votes: DataFrame, last: int, age: int) -> DataFrame:
    """Each poll row with every contest and horizon, 1 to ``last`` days before its vote, at which it is known.

    ``votes`` has (contest, since, vote_date), a row per contest; polls count
    that ended after ``since`` (the round before), by the horizon's day, and at
    most ``age`` days before it.  Contests are met by an equality on the days
    between, which a contest has one row each for.
    """
    open_ = votes.withColumn("end_date", F.explode(F.sequence(F.date_add("since", 1), F.date_sub("vote_date", 1)))).drop("since")
    j = polls.join(F.broadcast(open_), "end_date").withColumn("ahead", F.datediff("vote_date", "end_date"))
    j = j.withColumn("days", F.explode(F.filter(F.sequence(F.greatest(F.col("ahead") - age, F.lit(1)), F.greatest(F.col("ahead"), F.lit(1))), lambda x: x <= last)))
    return j.withColumn("age", F.col("ahead") - F.col("days")).drop("ahead", "vote_date")


def house_effects(base: DataFrame, settings: PollSettings, key: Sequence[str]) -> DataFrame:
    """``(key, candidate, house, effect)``: each house's shrunk, centred mean distance from the trend of the others.

    ``base`` has (key, candidate, house, age, share, base, quality).  Polls are
    first summed up per house and age, at most houses x (window + 1) cells for a
    key and candidate however many polls there are.  The trend at an age is a
    kernel over these cells, so an iteration is a product of small matrices, and
    it changes house effects only.
    """
    by = [*key, "candidate"]
    cells = base.where("house is not null").groupBy(*by, "house", "age").agg(
        F.sum("base").alias("b"), F.sum(F.col("base") * F.col("share")).alias("bx"), F.count("share").alias("valued"), F.count("*").alias("n"), F.sum("share").alias("s"), F.max("quality").alias("quality")
    )
    fields = base.select(*by, "house").schema
    out = StructType([*fields.fields, StructField("effect", DoubleType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        houses, h = np.unique(group["house"].to_numpy(), return_inverse=True)
        ages, a = np.unique(group["age"].to_numpy(float), return_inverse=True)
        grid = lambda c: np.bincount(h * len(ages) + a, group[c].fillna(0).to_numpy(float), len(houses) * len(ages)).reshape(len(houses), len(ages))
        b, bx, valued, n, s = (grid(c) for c in ("b", "bx", "valued", "n", "s"))
        quality = np.zeros(len(houses))
        np.maximum.at(quality, h, group["quality"].to_numpy(float))
        kernel = 0.5 ** (np.abs(ages[:, None] - ages[None, :]) / settings.half)
        others = 1.0 - np.eye(len(houses))
        kb, kbx = b @ kernel, bx @ kernel
        weight = others @ kb  # of the other houses' polls, seen from each house and age
        met = weight > 0
        polls, anchor = n.sum(1), quality * n.sum(1)
        effect = np.zeros(len(houses))
        for _ in range(settings.iterations):
            trend = np.divide(others @ (kbx - effect[:, None] * kb), weight, out=np.zeros_like(weight), where=met)
            mean = np.where(met, s - valued * trend, 0.0).sum(1) / (polls + settings.shrink)
            centre = (mean * anchor).sum() / anchor.sum() if anchor.sum() else np.nan
            effect = mean - centre
        found = pd.DataFrame({c: [group[c].iloc[0]] * len(houses) for c in by})
        return found.assign(house=houses, effect=effect)

    return cells.groupBy(*by).applyInPandas(run, out)


def aggregate(polls: DataFrame, quality: DataFrame, settings: PollSettings, key: Sequence[str] = ("cutoff",)) -> DataFrame:
    """House-effect corrected, time-weighted share per key and candidate.

    ``polls`` has (key, poll, house, age, sample, candidate, share), all polls of
    a key with the same candidates; ``quality`` ([columns of the key], house,
    quality), 1 for a house that it hasn't.  A poll's trend
    is the mean of other houses' corrected polls, weighted by closeness in time;
    a house's effect is its mean residual, shrunk and centred so that weighted
    effects cancel; both are repeated.  Everything is keyed, so any number of
    dates is one job.  A trend depends on polls by their sums per house and age
    only, so these are what is iterated over, never pairs of polls.  Returns
    (key, candidate, estimate, uncorrected, simple, n_polls, n_effective).
    """
    k = list(key)
    on = [c for c in quality.columns if c != "quality"]
    base = polls.join(F.broadcast(quality), on, "left").withColumn("quality", F.coalesce("quality", F.lit(1.0)))
    base = base.withColumn("base", F.col("quality") * F.least(F.coalesce(F.col("sample").cast("double"), F.lit(settings.sample_cap)), F.lit(settings.sample_cap)) / settings.sample_cap)
    effects = house_effects(base, settings, k)
    j = base.join(effects, [*k, "house", "candidate"]).withColumn("w", F.col("base") * half_life("age", settings.half))
    est = j.groupBy(*k, "candidate").agg(
        F.greatest(share(F.sum(F.col("w") * (F.col("share") - F.col("effect"))), F.sum("w")), F.lit(0.0)).alias("e"),
        share(F.sum(F.col("w") * F.col("share")), F.sum("w")).alias("u"),
        F.avg("share").alias("s"),
        F.count("*").alias("n_polls"),
        share(F.pow(F.sum("w"), 2), F.sum(F.col("w") * F.col("w"))).alias("n_effective"),
    )
    part = lambda c: share(F.col(c), F.sum(c).over(Window.partitionBy(*k)))
    return est.select(*k, "candidate", part("e").alias("estimate"), part("u").alias("uncorrected"), part("s").alias("simple"), "n_polls", "n_effective")


def backtest(estimates: DataFrame, results: DataFrame, contest: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean absolute errors of the estimate and of the simple mean, by the given keys."""
    j = estimates.join(F.broadcast(results), [*contest, "candidate"])
    return j.groupBy(*by).agg(F.avg(F.abs(F.col("estimate") - F.col("result"))).alias("mae"), F.avg(F.abs(F.col("simple") - F.col("result"))).alias("mae_simple"), F.count("*").alias("n"))


def error_calibration(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Root mean square, bias, and error relative to the root of share times rest."""
    rel = F.col("error") / F.sqrt(F.col("result") * (1 - F.col("result")))
    return errors.groupBy(*by).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"), F.avg("error").alias("bias"), F.sqrt(F.avg(rel * rel)).alias("relative"), F.count("*").alias("n"))


def bias_rule(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """The mean error as a correction, only where every past error has the same sign; else 0 and a flag."""
    s = errors.groupBy(*by).agg(F.min(F.signum("error")).alias("lo"), F.max(F.signum("error")).alias("hi"), F.avg("error").alias("mean"))
    one = F.col("lo") == F.col("hi")
    return s.select(*by, one.alias("same_sign"), F.when(one, F.col("mean")).otherwise(0.0).alias("correction"))


def trend(points: DataFrame, by: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted straight line per group with heteroscedasticity-robust (HC1) standard error of the slope."""
    f = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0))
    m = f.groupBy(*by).agg(F.sum(w).alias("sw"), share(F.sum(F.col(x) * F.col(w)), F.sum(w)).alias("mx"), share(F.sum(F.col(y) * F.col(w)), F.sum(w)).alias("my"), F.count("*").alias("n"))
    c = f.join(m, list(by)) if by else f.crossJoin(F.broadcast(m))
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    s = c.groupBy(*by).agg(F.sum(F.col(w) * dx * dx).alias("sxx"), F.sum(F.col(w) * dx * dy).alias("sxy"), F.max("mx").alias("mx"), F.max("my").alias("my"), F.max("n").alias("n"))
    s = s.withColumn("slope", share(F.col("sxy"), F.col("sxx")))
    d = c.drop("n").join(s.select(*by, "slope", "sxx", "n"), list(by)) if by else c.drop("n").crossJoin(F.broadcast(s.select("slope", "sxx", "n")))
    e = dy - F.col("slope") * dx
    meat = d.groupBy(*by).agg(F.sum(F.pow(F.col(w) * dx * e, 2)).alias("meat"))
    out = s.join(meat, list(by)) if by else s.crossJoin(F.broadcast(meat))
    se = F.sqrt(F.col("meat") * share(F.col("n"), F.col("n") - 2)) / F.col("sxx")
    return out.select(*by, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), se.alias("se"), "n")
