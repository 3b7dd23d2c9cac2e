"""Versioned dimensions, joins that must match, party families by year, and name crosswalks."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likeness import block_ratio, grams
from ..functions.text import name_key
from ..sources.shared import written

#: Steps that a chain of successors may have.
MAX_HOPS = 10


class Unmatched(ValueError):
    """Keys that have no partner in a lookup that must match."""


def unmatched(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` without a partner."""
    return df.select(*on).distinct().join(lookup.select(*on).distinct(), list(on), "left_anti")


def must_match(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which every key must have a partner; the error names the first ten that don't."""
    missing = unmatched(df, lookup, on).orderBy(*on).limit(10).collect()
    if missing:
        raise Unmatched(f"without partner: {[tuple(r) for r in missing]}")
    return df.join(lookup, list(on), "left")


def violations(crosswalk: DataFrame, source: str, target: str, reference: DataFrame, reference_key: str, prefix: str | None = None, declared: DataFrame | None = None) -> DataFrame:
    """``(rule, key)`` of a crosswalk's faults: source or target twice, no target, target unknown, wrong prefix, reference never used and not declared."""
    one = lambda rule, df, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("key"))
    out = one("unmatched", crosswalk.where(F.col(target).isNull()), source)
    out = out.unionByName(one("duplicate source", crosswalk.groupBy(source).count().where("count > 1"), source))
    out = out.unionByName(one("duplicate target", crosswalk.where(F.col(target).isNotNull()).groupBy(target).count().where("count > 1"), target))
    keys = reference.select(F.col(reference_key).alias(target)).distinct()
    out = out.unionByName(one("unknown target", crosswalk.where(F.col(target).isNotNull()).join(keys, target, "left_anti"), target))
    if prefix is not None:
        out = out.unionByName(one("wrong prefix", crosswalk.where(~F.col(target).cast("string").startswith(F.col(prefix).cast("string"))), source))
    orphans = keys.join(crosswalk.select(target).distinct(), target, "left_anti")
    if declared is not None:
        orphans = orphans.join(declared.select(F.col(declared.columns[0]).alias(target)), target, "left_anti")
    return out.unionByName(one("orphan reference", orphans, target))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Add ``value`` of a small table by ``key``; a key that isn't there gets the default."""
    own = df.join(F.broadcast(table.select(key, value)), key, "left")
    return own if default is None else own.withColumn(value, F.coalesce(value, F.lit(default)))


def valid_in(df: DataFrame, periods: DataFrame, key: str, year: str, years: str, value: str) -> DataFrame:
    """Lookup whose rows hold for listed years only."""
    flat = periods.select(key, F.explode(years).alias(year), value)
    return df.join(F.broadcast(flat), [key, year], "left")


def successors(parties: DataFrame, lineage: DataFrame, since: int, until: int, party: str = "party") -> DataFrame:
    """``(party, successor)`` after the chain of lineage rows ``(party, successor, year)`` with ``since < year <= until``.

    Of several successors the earliest counts, and a chain's years don't fall.
    A chain of more than MAX_HOPS steps, as a cycle makes, is an error.
    """
    steps = lineage.where((F.col("year") > since) & (F.col("year") <= until)).select(F.col("party").alias("_from"), F.col("successor").alias("_to"), F.col("year").alias("_year"))
    now = parties.select(F.col(party), F.col(party).alias("successor"), F.lit(since).alias("_at")).distinct()
    for hop in range(MAX_HOPS + 1):
        met = now.join(F.broadcast(steps), (F.col("successor") == F.col("_from")) & (F.col("_year") >= F.col("_at")), "left")
        first = F.row_number().over(Window.partitionBy(party).orderBy(F.asc_nulls_last("_year"), "_to"))
        met = met.withColumn("_r", first).where("_r = 1")
        if hop == MAX_HOPS:
            loops = [r[0] for r in met.where("_to is not null").select(party).limit(5).collect()]
            if loops:
                raise ValueError(f"lineage of {loops} does not end")
        now = met.select(party, F.coalesce("_to", "successor").alias("successor"), F.coalesce("_year", "_at").alias("_at"))
    return now.select(party, "successor")


def families(df: DataFrame, assigned: DataFrame, party: str = "party", year: str = "year") -> DataFrame:
    """``df`` with the family of (party, year); a party assigned twice in a year or not at all is an error that lists all."""
    twice = assigned.groupBy(party, year).agg(F.countDistinct("family").alias("n")).where("n > 1").limit(20).collect()
    if twice:
        raise ValueError(f"assigned twice: {[(r[0], r[1]) for r in twice]}")
    return must_match(df, assigned.select(party, year, "family").distinct(), [party, year])


def fixed_composition(df: DataFrame, lineage: DataFrame, assigned: DataFrame, reference_year: int, since: int, party: str = "party") -> DataFrame:
    """The family that a party's successor has in a reference year."""
    chain = successors(df.select(party).distinct(), lineage, since, reference_year, party)
    then = assigned.where(F.col("year") == reference_year).select(F.col("party").alias("successor"), "family").distinct()
    return df.join(F.broadcast(must_match(chain, then, ["successor"]).select(party, "family")), party, "left")


def grouped_options(votes: DataFrame, groups: DataFrame, by: Sequence[str], option: str = "option", amount: str = "votes", rest: str = "otros") -> DataFrame:
    """Votes per unit and named group of options; what is in no group is ``rest``."""
    named = lookup(votes, groups, option, "grp", rest)
    return named.dropna(subset=list(by)).groupBy(*by, "grp").agg(F.coalesce(F.sum(amount), F.lit(0)).alias(amount))


def similar_pairs(left: DataFrame, right: DataFrame, within: str, left_key: str, right_key: str, left_name: str, right_name: str, least: float) -> DataFrame:
    """``(within, left_key, right_key, similarity)``: all pairs of one unit whose names have a block ratio of ``least`` or more.

    No pair is missed.  Of two names with T characters such a ratio takes
    M = least T / 2 matching ones, so as many common characters, counted with
    repeats.  They lie in at most 1 + T - 2M blocks, since blocks that don't
    touch leave a character out; so the names share 3M - T - 1 pairs of
    neighbouring characters.  Each name is therefore listed under its rarest
    pairs only, as many as it can't do without (a prefix filter), names too
    short for that under their rarest characters.  Names that meet there are
    held against the bounds on length, characters and pairs, and only then scored.
    Null and empty names are like nothing.
    """
    ratio = least / (2 - least)  # of the lengths of two names that can be alike
    must = lambda t: F.ceil(t * (1.5 * least) - t - 1 - 1e-9)
    each = []
    for side, (df, key, name) in enumerate(((left, left_key, left_name), (right, right_key, right_name))):
        own = df.select(F.col(within).alias("unit"), F.col(key).alias("key"), F.col(name).alias("name"))
        own = written(own.where("length(name) > 0"), "names")  # read several times below
        own = own.withColumns({"len": F.length("name"), "one": grams("name", 1), "two": grams("name", 2)})
        pairs = must(F.col("len") + F.ceil(F.col("len") * ratio - 1e-9)) if least > 2 / 3 else F.lit(0)
        own = own.withColumn("pairs", pairs).withColumn("side", F.lit(side))
        each.append(own)

    def listed(own: DataFrame, kind: str, needed: Column) -> DataFrame:
        return own.select("side", "unit", "key", F.lit(kind).alias("kind"), F.col(kind).alias("grams"), (F.size(kind) - needed + 1).cast("int").alias("keep"))

    # the longest name that can be like one without a needed pair
    reach = F.floor(F.lit(_longest_without(least)) / ratio + 1e-9)
    lists = []
    for own in each:
        lists.append(listed(own.where("pairs >= 1"), "two", F.col("pairs")))
        lists.append(listed(own.where((F.col("pairs") < 1) | (F.col("len") <= reach)), "one", F.ceil(F.col("len") * ratio - 1e-9)))
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    long = every.select("side", "unit", "key", "kind", "keep", F.explode("grams").alias("gram"))
    known = long.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    rare = long.join(known, ["kind", "gram"]).groupBy("side", "unit", "key", "kind", "keep").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
    at = rare.select("side", "unit", "key", "kind", F.explode(F.slice("g", 1, F.col("keep"))).alias("x")).select("side", "unit", "key", "kind", F.col("x.gram").alias("gram"))
    mine = at.where("side = 0").select("unit", F.col("key").alias("k0"), "kind", "gram")
    theirs = at.where("side = 1").select("unit", F.col("key").alias("k1"), "kind", "gram")
    met = mine.join(theirs, ["unit", "kind", "gram"]).select("unit", "k0", "k1").distinct()
    of = lambda own, n: own.select("unit", *[F.col(c).alias(f"{c[0]}{n}") for c in ("key", "name", "len", "one", "two")])
    both = met.join(of(each[0], 0), ["unit", "k0"]).join(of(each[1], 1), ["unit", "k1"])
    total = F.col("l0") + F.col("l1")
    enough = F.ceil(total * (least / 2) - 1e-9)
    fits = (F.least("l0", "l1") >= enough) & (F.size(F.array_intersect("o0", "o1")) >= enough) & (F.size(F.array_intersect("t0", "t1")) >= 3 * enough - total - 1)
    scored = both.where(fits).withColumn("similarity", block_ratio("n0", "n1")).where(F.col("similarity") >= least)
    return scored.select(F.col("unit").alias(within), F.col("k0").alias(left_key), F.col("k1").alias(right_key), "similarity")


def _longest_without(least: float) -> int:
    """The longest name that may share no pair of neighbouring characters with one like it; a bound on all names where ``least`` is too low for pairs."""
    if least <= 2 / 3:
        return 1 << 30
    n = 1
    while ceil((n + ceil(n * least / (2 - least) - 1e-9)) * (1.5 * least - 1) - 1 - 1e-9) < 1:
        n += 1
    return n - 1


def match_names(left: DataFrame, right: DataFrame, within: str, left_key: str, right_key: str, left_name: str, right_name: str, alternatives: str | None = None, least: float = 0.75, manual: DataFrame | None = None) -> DataFrame:
    """``(within, left_key, right_key, method, reason)``: exact names first, then listed alternatives, then similar names, then manual rows.

    Names are compared as ``name_key`` inside the same ``within`` unit.  Only
    pairs that can be alike are scored (``similar_pairs``).  A similar name must be at least ``least`` alike and is
    taken once, best first.  Manual rows serve only what is still open.
    """
    a = left.select(within, left_key, name_key(left_name).alias("_n"), *([F.col(alternatives).alias("_alt")] if alternatives else []))
    b = right.select(within, right_key, name_key(right_name).alias("_m"))
    names = a.select(within, left_key, F.col("_n").alias("_m"), F.lit(0).alias("_o"))
    if alternatives:
        names = names.unionByName(a.select(within, left_key, F.explode(F.split("_alt", r"\|")).alias("_x")).select(within, left_key, name_key("_x").alias("_m"), F.lit(1).alias("_o")))
    hit = names.join(b, [within, "_m"]).groupBy(within, left_key).agg(F.min_by(right_key, F.struct("_o", right_key)).alias(right_key), F.min("_o").alias("_o"))
    hit = written(hit.select(within, left_key, right_key, F.when(F.col("_o") == 0, "exact").otherwise("alternative").alias("method")), "matches")
    open_a, open_b = a.join(hit, [within, left_key], "left_anti"), b.join(hit, [within, right_key], "left_anti")
    scored = similar_pairs(open_a, open_b, within, left_key, right_key, "_n", "_m", least).withColumnRenamed("similarity", "_s")
    best_a = F.row_number().over(Window.partitionBy(within, left_key).orderBy(F.desc("_s"), right_key))
    best_b = F.row_number().over(Window.partitionBy(within, right_key).orderBy(F.desc("_s"), left_key))
    near = scored.withColumn("_ra", best_a).withColumn("_rb", best_b).where("_ra = 1 and _rb = 1").select(within, left_key, right_key, F.lit("similar").alias("method"))
    near = written(near, "similar-matches")
    done = hit.unionByName(near).withColumn("reason", F.lit(None).cast("string"))
    rest = a.select(within, left_key).join(done, [within, left_key], "left_anti")
    if manual is not None:
        hand = rest.join(F.broadcast(manual.select(within, left_key, right_key, "reason")), [within, left_key]).select(within, left_key, right_key, F.lit("manual").alias("method"), "reason")
        done = done.unionByName(hand)
        rest = rest.join(hand, [within, left_key], "left_anti")
    return done.unionByName(rest.select(within, left_key, F.lit(None).cast(right.schema[right_key].dataType).alias(right_key), F.lit("none").alias("method"), F.lit(None).cast("string").alias("reason")))


def completed_coordinates(places: DataFrame, other_years: DataFrame, by: Sequence[str], place: str = "place", name: str = "name", district: str = "district") -> DataFrame:
    """Coordinates by a chain of fallbacks, with their origin.

    Own ones; else those of the same place number in another year if the names
    agree in their first 12 characters; else of the same name in the same unit;
    else the mean of its district.  Ties are taken in order of year.
    """
    b = list(by)
    k = lambda c: F.substring(name_key(c), 1, 12)
    known = other_years.where(F.col("lat").isNotNull())
    same_no = known.groupBy(*b, place, k(name).alias("_k")).agg(F.min_by(F.struct("lat", "lon"), "year").alias("c1"))
    same_name = known.groupBy(*b, name_key(name).alias("_n")).agg(F.min_by(F.struct("lat", "lon"), F.struct("year", place)).alias("c2"))
    centre = places.where(F.col("lat").isNotNull()).groupBy(*b, district).agg(F.struct(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).alias("c3"))
    j = places.withColumn("_k", k(name)).withColumn("_n", name_key(name)).join(same_no, [*b, place, "_k"], "left").join(same_name, [*b, "_n"], "left").join(centre, [*b, district], "left")
    own = F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))
    origin = F.when(own.isNotNull(), "own").when(F.col("c1").isNotNull(), "same place").when(F.col("c2").isNotNull(), "same name").when(F.col("c3").isNotNull(), "district").otherwise("none")
    best = F.coalesce(own, "c1", "c2", "c3")
    return j.select(*[c for c in places.columns if c not in ("lat", "lon")], best["lat"].alias("lat"), best["lon"].alias("lon"), origin.alias("coord_origin"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], frozen: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; an old row that is ``frozen`` stays."""
    if frozen:
        new = new.join(old.where(frozen).select(*key), list(key), "left_anti")
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)
