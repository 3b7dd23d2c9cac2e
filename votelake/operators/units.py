"""Unit bases: consolidated votes, rolls, bases of places, series by family, municipality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import share
from ..sources.shared import written
from . import rollup


def consolidate(votes: DataFrame, contest: Sequence[str], option: str = "option", amount: str = "votes") -> DataFrame:
    """Votes per contest and option with their share of the contest."""
    return rollup.share_of_group(rollup.total(votes, [*contest, option], amount), amount, contest)


def runoff_pending(consolidated: DataFrame, contest: Sequence[str], option: str = "option", amount: str = "votes") -> DataFrame:
    """Contests whose leader is below half of the votes, with the points that lack; exactly half is decided.  Ties go to the smaller option."""
    lead = rollup.top_per_group(consolidated, contest, [F.desc(amount), F.asc(option)])
    return lead.where("share < 0.5").select(*contest, F.col(option).alias("leader"), F.col(amount).alias("votes"), "share", ((0.5 - F.col("share")) * 100).alias("missing_pp"))


def party_votes_and_seats(votes: DataFrame, elected: DataFrame, family: DataFrame, unit: str, place: str, total_seats: int | None = None) -> dict[str, DataFrame]:
    """Family by place, family by unit and party by unit: votes (nominal + list), seats, share; the seats must sum to ``total_seats``.

    ``votes`` has (unit, place, party, nominal, list), ``elected`` (unit, party,
    status), ``family`` (party, family).
    """
    own = votes.withColumn("votes", F.coalesce("nominal", F.lit(0)) + F.coalesce("list", F.lit(0))).join(F.broadcast(family), "party", "left")
    seats = elected.where(F.upper("status").startswith("ELEITO")).groupBy(unit, "party").agg(F.count("*").alias("seats"))
    party = rollup.total(own, [unit, "party"], "votes").join(seats, [unit, "party"], "full_outer").fillna(0, ["votes", "seats"])
    if total_seats is not None:
        got = party.agg(F.sum("seats")).first()[0] or 0
        if got != total_seats:
            raise ValueError(f"{got} of {total_seats} seats")
    by_unit = party.join(F.broadcast(family), "party", "left").groupBy(unit, "family").agg(F.sum("votes").alias("votes"), F.sum("seats").alias("seats"))
    by_place = rollup.total(own, [unit, place, "family"], "votes")
    return {"family_place": rollup.share_of_group(by_place, "votes", [unit, place]), "family_unit": rollup.share_of_group(by_unit, "votes", [unit]), "party_unit": rollup.share_of_group(party, "votes", [unit])}


def merged_sections(roll: DataFrame, by: Sequence[str], section: str, merged: Column, principal: str) -> DataFrame:
    """Sections that were merged take the number of their principal, if it is a number from 0 on; electors are summed per section.

    Name and coordinates are those of the smallest original number; (-1, -1)
    and points near (0, 0) are no coordinates.
    """
    key = F.when(merged & (F.col(principal) >= 0), F.col(principal)).otherwise(F.col(section))
    bad = (F.abs("lat") < 1e-6) & (F.abs("lon") < 1e-6) | (F.col("lat") == -1) & (F.col("lon") == -1)
    own = roll.withColumn("_key", key).withColumns({c: F.when(~bad, F.col(c)) for c in ("lat", "lon")})
    made = own.groupBy(*by, "_key").agg(F.coalesce(F.sum("electors"), F.lit(0)).alias("electors"), F.count("*").alias("n_merged"), F.min_by("place", section).alias("place"), F.min_by("name", section).alias("name"), F.min_by(F.struct("lat", "lon"), section).alias("_c"))
    return made.select(*by, F.col("_key").alias(section), "place", "name", "electors", "n_merged", F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"))


def unit_base(votes: DataFrame, roll: DataFrame, section: Sequence[str], place: Sequence[str], groups: Sequence[str], rounds: Sequence[int] = (1, 2)) -> DataFrame:
    """One row per place: electors, sections, and per round the votes of each group and the abstention, never below 0.

    ``votes`` has (section, round, grp, votes), ``roll`` (section, place,
    electors).  A section without votes in a round has none, and abstains
    wholly only if it voted in some round.
    """
    cells = [F.coalesce(F.sum(F.when((F.col("round") == r) & (F.col("grp") == g), F.col("votes"))), F.lit(0)).alias(f"{g}_{r}") for r in rounds for g in groups]
    turn = [F.coalesce(F.sum(F.when(F.col("round") == r, F.col("votes"))), F.lit(0)).alias(f"_t{r}") for r in rounds]
    wide = votes.dropna(subset=list(section)).groupBy(*section).agg(*cells, *turn)
    j = wide.join(roll, list(section), "left")
    j = j.withColumns({f"abstained_{r}": F.greatest(F.coalesce("electors", F.lit(0)) - F.col(f"_t{r}"), F.lit(0)) for r in rounds})
    names = [f"{g}_{r}" for r in rounds for g in [*groups, "abstained"]]
    return j.groupBy(*place).agg(F.coalesce(F.sum("electors"), F.lit(0)).alias("electors"), F.count("*").alias("sections"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def family_series(votes: DataFrame, keys: Sequence[str], years: Sequence[int] | None = None) -> DataFrame:
    """Share per (keys, unit, family, year) on the full grid, with the change to the election before; at least two years must exist.

    ``votes`` has (keys, unit, family, year, votes); all its years are taken,
    or only ``years``.
    """
    own = votes if years is None else votes.where(F.col("year").isin(list(years)))
    k = list(keys)
    sums = rollup.total(own, [*k, "unit", "family", "year"], "votes")
    have = sums.select("year").distinct().count()
    if have < 2:
        raise ValueError(f"{have} years, two are needed")
    axes = [[c] for c in k] + [["unit"], ["family"], ["year"]]
    full = rollup.complete_grid(sums, axes, "votes")
    shared = full.withColumn("share", F.coalesce(share("votes", F.sum("votes").over(Window.partitionBy(*k, "unit", "year"))), F.lit(0.0)))
    return rollup.change(shared, [*k, "unit", "family"], "year", "share")


def volatility(series: DataFrame, by: Sequence[str], value: str = "change") -> DataFrame:
    """Sample deviation, mean and number of changes."""
    return series.where(F.col(value).isNotNull()).groupBy(*by).agg(F.stddev_samp(value).alias("sd"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def change_by_bin(now: DataFrame, before: DataFrame, keys: Sequence[str], value: str, weight: str, bins: int = 5) -> DataFrame:
    """Units in both years, binned by the earlier value: units, weight, weighted means before and now, and their difference."""
    k = list(keys)
    j = before.select(*k, F.col(value).alias("before"), F.col(weight).alias("w")).join(now.select(*k, F.col(value).alias("now")), k)
    b = rollup.quantile_bin(written(j, "changes"), "before", bins)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), rollup.weighted_mean("before", "w").alias("before"), rollup.weighted_mean("now", "w").alias("now")).withColumn("difference", F.col("now") - F.col("before"))


def winners(votes: DataFrame, unit: Sequence[str], option: str = "option", amount: str = "votes") -> DataFrame:
    """First and second option of each unit and the margin between them as a share of the unit's votes."""
    u = list(unit)
    s = rollup.share_of_group(rollup.total(votes, [*u, option], amount), amount, u)
    top = rollup.top_per_group(s, u, [F.desc(amount), F.asc(option)], 2)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return top.groupBy(*u).agg(at(1, option).alias("winner"), at(2, option).alias("second"), (at(1, "share") - F.coalesce(at(2, "share"), F.lit(0.0))).alias("margin"))


def unit_annex(now: DataFrame, before: DataFrame, unit: Sequence[str], names: DataFrame | None = None) -> DataFrame:
    """Winner, margin, previous winner and whether it changed, from two ``winners`` tables."""
    u = list(unit)
    j = now.join(before.select(*u, F.col("winner").alias("previous")), u, "left").withColumn("flipped", F.coalesce(F.col("winner") != F.col("previous"), F.lit(False)))
    return j if names is None else j.join(F.broadcast(names), u[-1], "left")


def annex_summary(annex: DataFrame, weight: str, by: Sequence[str] = ("winner",)) -> DataFrame:
    """Units and weight by winner, with how many changed."""
    return annex.groupBy(*by).agg(F.count("*").alias("n"), F.sum(weight).alias(weight), F.sum(F.col("flipped").cast("long")).alias("flips"))


def final_results(votes: DataFrame, roll: DataFrame, unit: str, blank: Sequence[str] = (), null: Sequence[str] = ()) -> DataFrame:
    """Per unit: electors, attendance, turnout, valid, blank and null votes, and the winner; ``votes`` has (unit, option, votes), ``roll`` (unit, electors)."""
    at = lambda options: F.coalesce(F.sum(F.when(F.col("option").isin(list(options)), F.col("votes"))), F.lit(0))
    other = F.col("option").isin([*blank, *null])
    sums = rollup.total(votes, [unit, "option"], "votes")
    s = sums.groupBy(unit).agg(
        F.sum("votes").alias("attended"), at(blank).alias("blank"), at(null).alias("null"), F.coalesce(F.sum(F.when(~other, F.col("votes"))), F.lit(0)).alias("valid"))
    best = rollup.top_per_group(sums.where(~other), [unit], [F.desc("votes"), F.asc("option")]).select(unit, F.col("option").alias("winner"))
    j = s.join(best, unit, "left").join(roll, unit, "left")
    return j.withColumn("turnout", share("attended", "electors"))


def shares_by_year(votes: DataFrame, unit: str, side: str, years: Sequence[int]) -> DataFrame:
    """One row per unit with the share of a side in each year."""
    s = votes.groupBy(unit).agg(*[share(F.sum(F.when((F.col("year") == y) & (F.col("option") == side), F.col("votes"))), F.sum(F.when(F.col("year") == y, F.col("votes")))).alias(f"share_{y}") for y in years])
    return s


def party_evidence(votes: DataFrame, seats: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per party: votes, share, seats, family, and whether it is covered by the family table."""
    v = votes.groupBy("party").agg(F.sum("votes").alias("votes"))
    s = seats.groupBy("party").agg(F.sum("seats").cast("long").alias("seats"))
    j = v.join(s, "party", "full_outer").fillna(0, ["votes", "seats"]).join(F.broadcast(assigned.select("party", "family").distinct()), "party", "left")
    return j.withColumn("share", share("votes", F.sum("votes").over(Window.partitionBy()))).withColumn("covered", F.col("family").isNotNull())


def poll_files(polls: DataFrame, houses: DataFrame) -> DataFrame:
    """Registered polls with their house by registry number and year; ids that occur more than once are marked."""
    flat = houses.select("registry", F.explode("years").alias("year"), "house")
    distinct = polls.dropDuplicates()
    return rollup.duplicates(distinct.join(F.broadcast(flat), ["registry", "year"], "left"), ["poll_id"], "id_collision")


def candidate_base(candidates: DataFrame, elected_before: DataFrame, strength: str = "votes") -> DataFrame:
    """Candidates with their order inside the family of a race and whether they hold the office.

    ``candidates`` has (unit, candidate, person, family, votes), one row each
    (repeated registrations count once, the largest); ``elected_before`` (unit,
    person).
    """
    once = rollup.top_per_group(candidates, ["unit", "candidate"], [F.desc(strength), F.asc("person")]).drop("rank")
    held = elected_before.select("unit", "person").distinct().withColumn("incumbent", F.lit(True))
    j = once.join(held, ["unit", "person"], "left").withColumn("incumbent", F.coalesce("incumbent", F.lit(False)))
    order = F.row_number().over(Window.partitionBy("unit", "family").orderBy(F.desc("incumbent"), F.desc(strength), "candidate"))
    return j.withColumn("order_in_family", order).withColumn("first", F.col("order_in_family") == 1)
