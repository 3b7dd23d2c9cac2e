"""Territorial summaries: distributions, boxes, composition and participation, office splits, territory tables, variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import band, col, share
from . import rollup, transfer
from .ranges import exact_quantiles, running


def age_band(code: Column | str) -> Column:
    """Band of a coded age range whose hundreds are its lower end (``2529``: 25 to 29)."""
    return band(F.floor(col(code).try_cast("int") / 100), [0, 25, 35, 45, 60, 1000], ["16-24", "25-34", "35-44", "45-59", "60+"])


def size_band(electors: Column | str) -> Column:
    return band(electors, [0, 20_000, 100_000, 500_000, 1e18], ["under 20k", "20k-100k", "100k-500k", "over 500k"])


def sex_and_degree(df: DataFrame, sex: str, degree: str) -> DataFrame:
    """Recoded sex (``f``, ``m``, null) and degree (``higher`` for any that begins so, else ``other``)."""
    s, d = F.upper(F.trim(F.col(sex))), F.upper(F.trim(F.col(degree)))
    return df.withColumn("sex", F.when(s == "FEMININO", "f").when(s == "MASCULINO", "m")).withColumn("degree", F.when(d.startswith("SUPERIOR"), "higher").otherwise("other"))


def composition(df: DataFrame, dimensions: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """``(dimension, value, <counts>, <count>_share)``: every dimension's distribution, from one pass."""
    long = df.unpivot([*counts], list(dimensions), "dimension", "value")
    s = long.where("value is not null").groupBy("dimension", "value").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    w = Window.partitionBy("dimension")
    return s.select("*", *[share(F.col(c), F.sum(c).over(w)).alias(f"{c}_share") for c in counts])


def participation(df: DataFrame, by: Sequence[str], electors: str, attended: str) -> DataFrame:
    """Attendance as a share of electors per group."""
    return df.groupBy(*by).agg(F.sum(electors).alias("electors"), F.sum(attended).alias("attended")).withColumn("rate", share("attended", "electors"))


def abandonment(df: DataFrame, by: Sequence[str], before: str, after: str) -> DataFrame:
    """Per group: what was cast before and after, and the part of it that did not come back, 0 at least."""
    s = df.groupBy(*by).agg(F.sum(before).alias("before"), F.sum(after).alias("after"))
    return s.withColumn("rate", F.greatest(share(F.col("before") - F.col("after"), F.col("before")), F.lit(0.0)))


def distribution(df: DataFrame, by: Sequence[str], x: str, weight: str, lines: Sequence[float]) -> DataFrame:
    """Number, minimum, 10 and 90 % points, maximum, weighted mean, and how many lie above each line."""
    points = exact_quantiles(df, x, [0.1, 0.9], by, "_q").drop("n")
    above = [F.sum((F.col(x) > line).cast("long")).alias(f"above_{round(line * 100)}") for line in lines]
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), rollup.weighted_mean(x, weight).alias("mean"), *above)
    s = s.join(points, list(by), "left") if by else s.crossJoin(F.broadcast(points))  # one row
    return s.select(*by, "n", "low", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p90"), "high", "mean", *[f"above_{round(line * 100)}" for line in lines])


def box_totals(points: DataFrame, boxes: DataFrame, side: str, valid: str) -> DataFrame:
    """Totals and share inside named boxes ``(box, lat0, lat1, lon0, lon1)``, ends included; boxes are few and broadcast."""
    j = points.join(F.broadcast(boxes), F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1")))
    return j.groupBy("box").agg(F.count("*").alias("n"), F.sum(valid).alias(valid), rollup.ratio(side, valid).alias("share"))


def spellings(df: DataFrame, by: Sequence[str], name: str, version: str) -> DataFrame:
    """The latest name of a key and the others that it had, sorted and joined by bars."""
    s = df.groupBy(*by).agg(F.max_by(name, F.struct(version, name)).alias("latest"), F.collect_set(name).alias("_all"))
    return s.select(*by, "latest", F.array_join(F.array_sort(F.array_except("_all", F.array("latest"))), "|").alias("alternates"))


def office_split(votes: DataFrame, unit: str, place: str, office_a: str, office_b: str) -> DataFrame:
    """Per unit, for the leaders of two offices: correlation of their shares over places, its sign, and the share of places where the sides differ.

    ``votes`` has (unit, place, office, option, votes).  Each office's side is
    its first two options in the unit; places where both lead by as much count
    as equal.
    """
    own = votes.where(F.col("office").isin(office_a, office_b))
    sums = own.groupBy(unit, "office", "option").agg(F.sum("votes").alias("v"))
    top = rollup.top_per_group(sums, [unit, "office"], [F.desc("v"), F.asc("option")], 2).select(unit, "office", "option", "rank")
    j = own.join(F.broadcast(top), [unit, "office", "option"])
    wide = j.groupBy(unit, place, "office").agg(share(F.sum(F.when(F.col("rank") == 1, F.col("votes")).otherwise(0)), F.sum("votes")).alias("s"))
    at = lambda o: F.max(F.when(F.col("office") == o, F.col("s")))
    p = wide.groupBy(unit, place).agg(at(office_a).alias("a"), at(office_b).alias("b")).where("a is not null and b is not null")
    c = p.groupBy(unit).agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))
    k = p.join(F.broadcast(c), unit).withColumn("b2", F.when(F.col("r") < 0, 1 - F.col("b")).otherwise(F.col("b")))
    d = k.groupBy(unit).agg(F.avg(((F.col("a") > 0.5) != (F.col("b2") > 0.5)).cast("double")).alias("differ"))
    return c.join(d, unit).select(unit, "r", (F.col("r") >= 0).alias("aligned"), "n", "differ")


def territory(units: DataFrame, history: DataFrame) -> DataFrame:
    """Margin, votes at stake, swing and bellwether deviation of each unit.

    ``units`` has (unit, side1, side0, abstained, electors), ``history`` (unit,
    year, share, nation) with the unit's and the nation's share of side 1.
    """
    h = history.withColumn("dev", F.col("share") - F.col("nation"))
    w = Window.partitionBy("unit").orderBy("year")
    s = h.withColumn("swing", F.col("share") - F.lag("share").over(w)).groupBy("unit").agg(F.max_by("swing", "year").alias("swing"), F.avg(F.abs("dev")).alias("bellwether"), F.stddev_samp("share").alias("spread"))
    u = units.withColumn("valid", F.col("side1") + F.col("side0"))
    total = Window.partitionBy()
    u = u.select("*", share(F.col("side1") - F.col("side0"), "valid").alias("margin"), share("valid", F.sum("valid").over(total)).alias("weight"), share("abstained", "electors").alias("abstention"))
    u = u.withColumn("at_stake", F.col("valid") * (1 - F.abs("margin")))
    return u.join(s, "unit", "left")


def stakes(places: DataFrame) -> DataFrame:
    """What a runoff can still win in each place: ``gap``, ``at_stake`` and ``elasticity`` are added.

    ``places`` has (side1, side0, third, reserve1, reserve0, electors, p):
    votes of both sides, of those who are out, of those who voted for a side in
    another office only, and side 1's share in the contest before.  The
    elasticity is side 1's net gain if a hundredth more of the electors came and
    voted as then.  A missing reserve is 0; a missing ``p`` is the place's own
    share, and a half where that is missing too.
    """
    kept = places.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("reserve1", "reserve0")})
    own = F.coalesce("p", share("side1", F.col("side1") + F.col("side0")), F.lit(0.5))
    kept = kept.withColumn("p", own).withColumn("gap", F.col("side1") - F.col("side0")).withColumn("at_stake", F.col("third") + F.col("reserve1") + F.col("reserve0"))
    return kept.withColumn("elasticity", F.col("electors") * 0.01 * (2 * F.col("p") - 1))


def stake_table(places: DataFrame, by: Sequence[str]) -> DataFrame:
    """``stakes`` summed up by unit, region, size or any other column: places, sums, side 1's share, parts of all that is at stake and of the gap."""
    amounts = ["electors", "side1", "side0", "third", "reserve1", "reserve0", "gap", "at_stake", "elasticity"]
    t = places.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in amounts])
    whole = places.agg(F.sum("at_stake").alias("_stake"), F.sum("gap").alias("_gap"))  # one row
    j = t.crossJoin(F.broadcast(whole)).withColumn("share", share("side1", F.col("side1") + F.col("side0")))
    return j.withColumn("part_at_stake", share("at_stake", "_stake")).withColumn("part_gap", share("gap", "_gap")).drop("_stake", "_gap")


def gathered(table: DataFrame, amount: str, key: str, parts: Sequence[float]) -> DataFrame:
    """``(part, n)``: how many rows, the largest first, gather each part of the whole amount; running sums by ranges."""
    sums = running(table.select(key, amount), [], [F.desc(amount), key], {"upto": ("sum", F.col(amount))})
    whole = table.agg(F.sum(amount).alias("_all"))  # one row
    counts = [F.count_if(F.col("upto") < p * F.col("_all")).alias(f"_{i}") for i, p in enumerate(parts)]
    found = sums.crossJoin(F.broadcast(whole)).agg(*counts)
    cells = F.array(*[F.struct(F.lit(float(p)).alias("part"), (F.col(f"_{i}") + 1).alias("n")) for i, p in enumerate(parts)])
    return found.select(F.explode(cells).alias("c")).select("c.*")


def turnout_cases(places: DataFrame, cases: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """``(scenario, share, change, added)`` if more electors come in some places and vote as in the contest before.

    ``cases`` gives each scenario its places and the points of turnout added
    there; all are sums of one pass over ``stakes``.
    """
    new = {k: F.when(mask, F.col("electors") * points / 100).otherwise(0.0) for k, (mask, points) in cases.items()}
    sums = [x for i, v in enumerate(new.values()) for x in (F.sum(v).alias(f"_n{i}"), F.sum(v * F.col("p")).alias(f"_p{i}"))]
    base = places.agg(F.sum("side1").alias("_a"), F.sum("side0").alias("_b"), *sums)
    before = share("_a", F.col("_a") + F.col("_b"))
    rows = []
    for i, k in enumerate(new):
        after = share(F.col("_a") + F.col(f"_p{i}"), F.col("_a") + F.col("_b") + F.col(f"_n{i}"))
        rows.append(F.struct(F.lit(k).alias("scenario"), after.alias("share"), (after - before).alias("change"), F.col(f"_n{i}").alias("added")))
    return base.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def cluster_profile(labels: DataFrame, places: DataFrame, unit: str, node: str) -> DataFrame:
    """Per unit and type of cluster: places, their part of the unit's electors, and side 1's share; ``places`` has (unit, node, electors, side1, side0)."""
    t = labels.select(node, "cluster").join(places, node).groupBy(unit, "cluster").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("electors", "side1", "side0")])
    whole = t.groupBy(unit).agg(F.sum("electors").alias("_all"))
    return t.join(whole, unit).select(unit, "cluster", "n", share("electors", "_all").alias("part"), share("side1", F.col("side1") + F.col("side0")).alias("share"))


def turnout_scenarios(units: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Share of side 1 if each unit's abstention moves by a factor and those who come vote as the unit does; ``scenarios`` has (scenario, factor)."""
    j = units.crossJoin(F.broadcast(scenarios))
    more = F.col("abstained") * (1 - F.col("factor"))
    p = share("side1", F.col("side1") + F.col("side0"))
    return j.groupBy("scenario").agg(share(F.sum(F.col("side1") + more * p), F.sum(F.col("side1") + F.col("side0") + more)).alias("share"))


def finalists(now: DataFrame, other: DataFrame, unit: str, place: str, options: Sequence[str], weight: str, drop: Sequence[str] = ()) -> DataFrame:
    """Projection of two finalists' shares in a unit from how the groups of another office vote there.

    ``now`` has (unit, place, option, votes) of the contest, ``other`` (unit,
    place, <options as shares>, weight).  The finalists are the two largest
    options that are not in ``drop``; a transfer matrix from the other office's
    groups to finalist 1, finalist 2 and the rest is fitted per unit and applied
    to the unit's totals.
    """
    sums = now.where(~F.col("option").isin(*drop) if drop else F.lit(True)).groupBy(unit, "option").agg(F.sum("votes").alias("v"))
    top = rollup.top_per_group(sums, [unit], [F.desc("v"), F.asc("option")], 2).select(unit, "option", "rank")
    j = now.join(F.broadcast(top), [unit, "option"], "left")
    at = lambda r: F.coalesce(F.sum(F.when(F.col("rank") == r, F.col("votes"))), F.lit(0))
    y = j.groupBy(unit, place).agg(share(at(1), F.sum("votes")).alias("first"), share(at(2), F.sum("votes")).alias("second")).withColumn("rest", 1 - F.col("first") - F.col("second"))
    fit = transfer.transfer_matrix(transfer.gram(y.join(other, [unit, place]), [unit], list(options), ["first", "second", "rest"], weight), [unit], list(options), ["first", "second", "rest"])
    mass = other.groupBy(unit).agg(*[F.sum(F.col(o) * F.col(weight)).alias(o) for o in options]).unpivot([unit], list(options), "origin", "mass")
    p = fit.join(mass, [unit, "origin"]).groupBy(unit, "dest").agg(F.sum(F.col("p") * F.col("mass")).alias("v"))
    s = p.groupBy(unit).agg(F.sum(F.when(F.col("dest") == "first", F.col("v"))).alias("a"), F.sum(F.when(F.col("dest") == "second", F.col("v"))).alias("b"))
    names = top.groupBy(unit).agg(F.min_by("option", "rank").alias("first"), F.max_by("option", "rank").alias("second"))
    return s.join(names, unit).select(unit, "first", "second", share("a", F.col("a") + F.col("b")).alias("share_first"))


def variants(predictions: Mapping[str, DataFrame], sides: tuple[str, str]) -> DataFrame:
    """Share of the first side under each named variant of a prediction, as one table keyed by variant."""
    out: DataFrame | None = None
    for name, df in predictions.items():
        own = df.withColumn("variant", F.lit(name))
        out = own if out is None else out.unionByName(own)
    assert out is not None
    return transfer.two_sided_share(out, sides, ["variant"])


def continuing(members: DataFrame, legislature: str, expected: int | None = None) -> DataFrame:
    """Members of the last legislature of a list; their number is checked."""
    last = members.agg(F.max(legislature).alias(legislature))  # one row
    own = members.join(F.broadcast(last), legislature, "left_semi")
    if expected is not None and (n := own.count()) != expected:
        raise ValueError(f"{n} members, not {expected}")
    return own
