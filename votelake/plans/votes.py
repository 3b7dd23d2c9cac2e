"""Queries over votes: roll-ups, shares, series, bins, ranks, outliers and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.maths import band, share
from ..operators import dims, rollup, spatial, units
from ..operators.ranges import exact_quantiles
from ..sources import scan
from .bindings import VOTES, query, r6, table, votes

OPTIONS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("unit_votes_long", f"WITH {VOTES} SELECT unit, year, round, option, CAST(sum(votes) AS BIGINT) AS votes FROM votes GROUP BY ALL")
def unit_votes_long(spark: SparkSession, d: str) -> DataFrame:
    return rollup.total(votes(spark, d), ["unit", "year", "round", "option"], "votes")


@query("unit_votes_wide", f"WITH {VOTES} SELECT unit, year, " + ", ".join(f"CAST(coalesce(sum(votes) FILTER (WHERE option = '{o}'), 0) AS BIGINT) AS v_{o}" for o in OPTIONS) + ", CAST(sum(votes) AS BIGINT) AS total FROM votes GROUP BY unit, year")
def unit_votes_wide(spark: SparkSession, d: str) -> DataFrame:
    return rollup.pivot_sum(votes(spark, d), ["unit", "year"], "option", OPTIONS, "votes", with_total="total")


@query("runoff_pending", f"""WITH {VOTES}, s AS (SELECT unit, option, CAST(sum(votes) AS BIGINT) AS votes FROM votes WHERE round = 1 GROUP BY ALL),
t AS (SELECT *, votes / sum(votes) OVER (PARTITION BY unit) AS share, row_number() OVER (PARTITION BY unit ORDER BY votes DESC, option) AS r FROM s)
SELECT unit, option AS leader, votes, round(share, 6) AS share, round((0.5 - share) * 100, 6) AS missing_pp FROM t WHERE r = 1 AND share < 0.5""")
def runoff_pending(spark: SparkSession, d: str) -> DataFrame:
    own = units.consolidate(votes(spark, d).where("round = 1"), ["unit"])
    return units.runoff_pending(own, ["unit"]).select("unit", "leader", "votes", r6("share"), r6("missing_pp"))


@query("conform_and_clean", r"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS code, upper(s_name) AS name, round(s_acctbal, 2) AS balance, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE round(s_acctbal, 2) END AS clipped,
  CASE WHEN s_nationkey NOT IN (1, 3) THEN CAST(s_nationkey AS BIGINT) ELSE -1 END AS nation, CASE WHEN s_acctbal < 0 THEN 'under' WHEN s_acctbal < 5000 THEN 'low' WHEN s_acctbal < 20000 THEN 'high' END AS band FROM supplier""")
def conform_and_clean(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    raw = s.select(F.col("s_suppkey").cast("string").alias("CODE"), F.col("s_name").alias("NM"), F.replace(F.format_string("%.2f", "s_acctbal"), F.lit("."), F.lit(",")).alias("VR"), F.when(F.col("s_nationkey") == 1, "#NULO#").when(F.col("s_nationkey") == 3, "-1").otherwise(F.col("s_nationkey").cast("string")).alias("SG"))
    c = scan.conform(raw, {"code": ["CODE", "CD_OLD"], "name": ["NM_NEW", "NM"], "value": ["VR"], "nation": ["SG"]})
    balance = text.decimal_comma("value")
    return c.select(text.zero_padded("code", 7).alias("code"), F.upper("name").alias("name"), balance.alias("balance"), F.greatest(balance, F.lit(0.0)).alias("clipped"), F.coalesce(text.lenient(text.clean_nulls("nation"), "long"), F.lit(-1).cast("long")).alias("nation"), band(balance, [-1e18, 0, 5000, 20000], ["under", "low", "high"]).alias("band"))


@query("name_keys", r"""SELECT doc_id, trim(regexp_replace(upper(translate(replace(text, 'ß', 'ss'), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy')), '[^A-Z0-9]+', ' ', 'g')) AS key,
  'd_' || regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.name_key("text").alias("key"), text.slug("text", "d_").alias("slug"))


@query("must_match_violations", """WITH x AS (SELECT s_name AS source, s_nationkey AS target FROM supplier)
SELECT 'duplicate source' AS rule, source AS key FROM x GROUP BY source HAVING count(*) > 1
UNION ALL SELECT 'duplicate target', CAST(target AS VARCHAR) FROM x WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 1
UNION ALL SELECT 'unmatched', source FROM x WHERE target IS NULL
UNION ALL SELECT 'unknown target', CAST(target AS VARCHAR) FROM x WHERE target NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT DISTINCT 'orphan reference', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey NOT IN (SELECT target FROM x) AND n_regionkey <> 4""")
def must_match_violations(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select(F.col("s_name").alias("source"), F.col("s_nationkey").alias("target"))
    nation = table(spark, d, "nation")
    return dims.violations(x, "source", "target", nation, "n_nationkey", declared=nation.where("n_regionkey = 4").select("n_nationkey"))


FAMILY = "'f' || (CAST(substr(party, 7) AS INTEGER) + year) % 6"


def assigned_families(spark: SparkSession, d: str) -> DataFrame:
    """(party, year, family): the family changes with brand number and year."""
    years = spark.range(1994, 2003).select(F.col("id").cast("int").alias("year"))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("party")).distinct()
    number = F.substring("party", 7, 9).cast("int")
    return brands.crossJoin(F.broadcast(years)).select("party", "year", F.concat(F.lit("f"), (number + F.col("year")) % 6).alias("family"))


@query("party_family_by_year", f"WITH {VOTES} SELECT year, {FAMILY} AS family, CAST(sum(votes) AS BIGINT) AS votes, count(DISTINCT party) AS parties FROM votes GROUP BY ALL")
def party_family_by_year(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).groupBy("party", "year").agg(F.sum("votes").alias("votes"))
    return dims.families(v, assigned_families(spark, d)).groupBy("year", "family").agg(F.sum("votes").alias("votes"), F.countDistinct("party").alias("parties"))


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """A brand with an odd last digit passes to the next one, in a year that its number gives."""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("party")).distinct()
    n = F.substring("party", 7, 9).cast("int")
    return brands.where(n % 2 == 1).select("party", F.concat(F.lit("Brand#"), n + 1).alias("successor"), (F.lit(1995) + F.floor(n / 10).cast("int")).alias("year")).unionByName(
        brands.where(n % 10 == 2).select("party", F.concat(F.lit("Brand#"), n + 2).alias("successor"), (F.lit(1996) + F.floor(n / 10).cast("int")).alias("year"))
    )


@query("lineage_closure", """WITH RECURSIVE b AS (SELECT DISTINCT p_brand AS party, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part),
steps AS (SELECT party, 'Brand#' || (n + 1) AS successor, 1995 + n // 10 AS year FROM b WHERE n % 2 = 1 UNION ALL SELECT party, 'Brand#' || (n + 2), 1996 + n // 10 FROM b WHERE n % 10 = 2),
walk AS (SELECT party, party AS successor, 1994 AS at, 0 AS hop FROM b
  UNION ALL SELECT w.party, s.successor, s.year, w.hop + 1 FROM walk w JOIN steps s ON s.party = w.successor AND s.year > 1994 AND s.year <= 2002 AND s.year >= w.at)
SELECT party, arg_max(successor, hop) AS successor FROM walk GROUP BY party""")
def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    parties = table(spark, d, "part").select(F.col("p_brand").alias("party")).distinct()
    return dims.successors(parties, lineage(spark, d), 1994, 2002)


GROUPS = {"ECONOMY": "a", "LARGE": "a", "PROMO": "b", "SMALL": "blank"}
GROUP_SQL = "CASE option WHEN 'ECONOMY' THEN 'a' WHEN 'LARGE' THEN 'a' WHEN 'PROMO' THEN 'b' WHEN 'SMALL' THEN 'blank' ELSE 'otros' END"


def group_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes per section, round and named group of options."""
    groups = scan.dimension(spark, GROUPS, "option", "grp")
    return dims.grouped_options(votes(spark, d), groups, ["unit", "segment", "place", "section", "round"])


ROLL = "roll AS (SELECT section, any_value(unit) AS unit, any_value(place) AS place, CAST(60 * count(*) AS BIGINT) AS electors FROM votes GROUP BY section)"


@query("unit_base", f"""WITH {VOTES}, {ROLL}, g AS (SELECT section, round, {GROUP_SQL} AS grp, sum(votes) AS votes FROM votes GROUP BY ALL),
s AS (SELECT g.section, any_value(roll.unit) AS unit, any_value(roll.place) AS place, any_value(electors) AS electors, """
+ ", ".join(f"coalesce(sum(votes) FILTER (WHERE round = {r} AND grp = '{x}'), 0) AS {x}_{r}" for r in (1, 2) for x in ("a", "b", "blank", "otros"))
+ ", " + ", ".join(f"greatest(any_value(electors) - coalesce(sum(votes) FILTER (WHERE round = {r}), 0), 0) AS abstained_{r}" for r in (1, 2))
+ " FROM g JOIN roll ON roll.section = g.section GROUP BY g.section) SELECT unit, place, CAST(sum(electors) AS BIGINT) AS electors, count(*) AS sections, "
+ ", ".join(f"CAST(sum({x}_{r}) AS BIGINT) AS {x}_{r}" for r in (1, 2) for x in ("a", "b", "blank", "otros", "abstained")) + " FROM s GROUP BY unit, place")
def unit_base(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    roll = v.groupBy("section").agg(F.first("unit").alias("unit"), F.first("place").alias("place"), (F.count("*") * 60).alias("electors"))
    return units.unit_base(group_votes(spark, d), roll, ["section"], ["unit", "place"], ["a", "b", "blank", "otros"])


SERIES = f"""s0 AS (SELECT unit, {FAMILY} AS family, year, sum(votes) AS votes FROM votes GROUP BY ALL),
s1 AS (SELECT u.unit, f.family, y.year, coalesce(s0.votes, 0) AS votes FROM (SELECT DISTINCT unit FROM s0) u CROSS JOIN (SELECT DISTINCT family FROM s0) f CROSS JOIN (SELECT DISTINCT year FROM s0) y LEFT JOIN s0 USING (unit, family, year)),
s2 AS (SELECT *, votes / sum(votes) OVER (PARTITION BY unit, year) AS share FROM s1),
series AS (SELECT *, share - lag(share) OVER (PARTITION BY unit, family ORDER BY year) AS change FROM s2)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    v = dims.families(votes(spark, d).groupBy("unit", "party", "year").agg(F.sum("votes").alias("votes")), assigned_families(spark, d))
    return units.family_series(v, [])


@query("series_change", f"WITH {VOTES}, {SERIES} SELECT unit, family, year, CAST(votes AS BIGINT) AS votes, round(share, 6) AS share, round(change, 6) AS change FROM series")
def series_change(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select("unit", "family", "year", "votes", r6("share"), r6("change"))


@query("volatility", f"WITH {VOTES}, {SERIES} SELECT family, round(stddev_samp(change), 6) AS sd, round(avg(change), 6) AS mean, count(change) AS n FROM series WHERE change IS NOT NULL GROUP BY family")
def volatility(spark: SparkSession, d: str) -> DataFrame:
    return units.volatility(series(spark, d), ["family"]).select("family", r6("sd"), r6("mean"), "n")


SHARES = """sh AS (SELECT place, year, sum(votes) FILTER (WHERE option = 'PROMO') * 1.0::DOUBLE / sum(votes) AS x, CAST(sum(votes) AS DOUBLE) AS w FROM votes GROUP BY place, year),
nn AS (SELECT place, year, coalesce(x, 0.0) AS x, w FROM sh)"""


def place_shares(spark: SparkSession, d: str, keys: tuple[str, ...] = ("place",)) -> DataFrame:
    v = votes(spark, d)
    return v.groupBy(*keys, "year").agg((F.coalesce(F.sum(F.when(F.col("option") == "PROMO", F.col("votes"))), F.lit(0)) / F.sum("votes")).alias("x"), F.sum("votes").cast("double").alias("w"))


@query("quintile_change", f"""WITH {VOTES}, sh AS (SELECT unit, segment, year, coalesce(sum(votes) FILTER (WHERE option = 'PROMO'), 0) * 1.0::DOUBLE / sum(votes) AS x, CAST(sum(votes) AS DOUBLE) AS w FROM votes GROUP BY unit, segment, year),
j AS (SELECT b.x AS before, b.w, n.x AS now FROM sh b JOIN sh n ON b.unit = n.unit AND b.segment = n.segment AND b.year = 1997 AND n.year = 1998),
e AS (SELECT quantile_cont(before, 0.25) AS e1, quantile_cont(before, 0.5) AS e2, quantile_cont(before, 0.75) AS e3, min(before) AS lo, max(before) AS hi FROM j),
q AS (SELECT j.*, CASE WHEN e1 > lo AND e2 > e1 AND e3 > e2 AND hi > e3 THEN 1 + CAST(before > e1 AS INTEGER) + CAST(before > e2 AS INTEGER) + CAST(before > e3 AS INTEGER) END AS bin FROM j, e)
SELECT bin, count(*) AS n, round(sum(w), 6) AS weight, round(sum(before * w) / sum(w), 6) AS before, round(sum(now * w) / sum(w), 6) AS now, round(sum(now * w) / sum(w) - sum(before * w) / sum(w), 6) AS difference FROM q GROUP BY bin""")
def quintile_change(spark: SparkSession, d: str) -> DataFrame:
    s = place_shares(spark, d, ("unit", "segment"))
    out = units.change_by_bin(s.where("year = 1998"), s.where("year = 1997"), ["unit", "segment"], "x", "w", bins=4)
    return out.select("bin", "n", r6("weight"), r6("before"), r6("now"), r6("difference"))


@query("variance_parts", f"""WITH {VOTES}, p AS (SELECT unit, segment, place, coalesce(sum(votes) FILTER (WHERE option = 'PROMO'), 0) * 1.0::DOUBLE / sum(votes) AS x, CAST(sum(votes) AS DOUBLE) AS w FROM votes GROUP BY ALL),
lo AS (SELECT unit, segment, sum(w) AS w, sum(w * x) / sum(w) AS ml, sum(w * x * x) AS xx FROM p GROUP BY ALL), up AS (SELECT unit, sum(w * ml) / sum(w) AS mu FROM lo GROUP BY unit), al AS (SELECT sum(w * ml) / sum(w) AS m FROM lo),
s AS (SELECT sum(w * (mu - m) ** 2) AS a, sum(w * (ml - mu) ** 2) AS b, sum(xx - w * ml ** 2) AS c FROM lo JOIN up USING (unit), al)
SELECT round(a / (a + b + c), 6) AS between_upper, round(b / (a + b + c), 6) AS between_lower, round(c / (a + b + c), 6) AS within FROM s""")
def variance_parts(spark: SparkSession, d: str) -> DataFrame:
    p = votes(spark, d).groupBy("unit", "segment", "place").agg((F.coalesce(F.sum(F.when(F.col("option") == "PROMO", F.col("votes"))), F.lit(0)) / F.sum("votes")).alias("x"), F.sum("votes").cast("double").alias("w"))
    return rollup.variance_parts(p, "unit", "segment", "x", "w").select(r6("between_upper"), r6("between_lower"), r6("within"))


@query("outlier_sections", f"""WITH {VOTES}, s AS (SELECT place, section, coalesce(sum(votes) FILTER (WHERE option IN ('PROMO', 'LARGE')), 0) AS v, sum(votes) AS n FROM votes GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY place) AS nn, sum(v) OVER (PARTITION BY place) AS vv, count(*) OVER (PARTITION BY place) AS k FROM s WHERE n > 0),
z AS (SELECT place, section, v, n, v / n AS p, (vv - v) / (nn - n) AS pr FROM w WHERE k >= 3), zz AS (SELECT *, pr * (1 - pr) / n AS var FROM z),
t AS (SELECT greatest(median((p - pr) ** 2) / 0.455 - median(var), 0) AS tau2 FROM zz), o AS (SELECT *, CASE WHEN var + tau2 > 0 THEN (p - pr) / sqrt(var + tau2) END AS z FROM zz, t)
SELECT place, section, CAST(v AS BIGINT) AS v, CAST(n AS BIGINT) AS n, round(p, 6) AS p, round(pr, 6) AS p_rest, round(z, 6) AS z FROM o WHERE abs(z) > 1.5""")
def outlier_sections(spark: SparkSession, d: str) -> DataFrame:
    s = votes(spark, d).groupBy("place", "section").agg(F.coalesce(F.sum(F.when(F.col("option").isin("PROMO", "LARGE"), F.col("votes"))), F.lit(0)).alias("v"), F.sum("votes").alias("n"))
    return spatial.outliers(s, ["place"], "v", "n", limit=1.5).select("place", "section", "v", "n", r6("p"), r6("p_rest"), r6("z"))


@query("unit_annex", f"""WITH {VOTES}, s AS (SELECT unit, segment, year, option, sum(votes) AS votes FROM votes WHERE year IN (1996, 1999) GROUP BY ALL),
r AS (SELECT *, votes / sum(votes) OVER w0 AS share, row_number() OVER (PARTITION BY unit, segment, year ORDER BY votes DESC, option) AS k FROM s WINDOW w0 AS (PARTITION BY unit, segment, year)),
t AS (SELECT unit, segment, year, max(CASE WHEN k = 1 THEN option END) AS winner, max(CASE WHEN k = 2 THEN option END) AS second, max(CASE WHEN k = 1 THEN share END) - coalesce(max(CASE WHEN k = 2 THEN share END), 0) AS margin FROM r WHERE k <= 2 GROUP BY ALL)
SELECT n.unit, n.segment, n.winner, n.second, round(n.margin, 6) AS margin, b.winner AS previous, coalesce(n.winner <> b.winner, false) AS flipped FROM t n LEFT JOIN t b ON n.unit = b.unit AND n.segment = b.segment AND b.year = 1996 WHERE n.year = 1999""")
def unit_annex(spark: SparkSession, d: str) -> DataFrame:
    v, u = votes(spark, d), ["unit", "segment"]
    return units.unit_annex(units.winners(v.where("year = 1999"), u), units.winners(v.where("year = 1996"), u), u).withColumn("margin", r6("margin"))


@query("level_metrics", f"""WITH {VOTES} SELECT region, unit, segment, CAST(sum(votes) AS BIGINT) AS votes, count(DISTINCT section) AS sections, round(sum(votes) FILTER (WHERE option = 'PROMO') / sum(votes), 6) AS promo_share,
CAST(3 - (CASE WHEN grouping(region) = 1 THEN 1 ELSE 0 END + grouping(unit) + grouping(segment)) AS INTEGER) AS level FROM votes GROUP BY ROLLUP (region, unit, segment)""")
def level_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    out = rollup.levels(v, ["region", "unit", "segment"], [F.sum("votes").alias("votes"), r6(share(F.sum(F.when(F.col("option") == "PROMO", F.col("votes"))), F.sum("votes")), "promo_share")], {"sections": "section"})
    return out.select("region", "unit", "segment", "votes", "sections", "promo_share", F.col("level").cast("int").alias("level"))


@query("concentration", f"""WITH {VOTES}, s AS (SELECT unit, party, sum(votes) AS v FROM votes GROUP BY ALL), r AS (SELECT unit, sum(v) OVER (PARTITION BY unit ORDER BY v DESC, party ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY unit) AS c FROM s)
SELECT unit, CAST(sum(CAST(c < 0.5 AS INTEGER)) + 1 AS BIGINT) AS reach_50, CAST(sum(CAST(c < 0.8 AS INTEGER)) + 1 AS BIGINT) AS reach_80 FROM r GROUP BY unit""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return rollup.concentration(rollup.total(votes(spark, d), ["unit", "party"], "votes"), ["unit"], "votes", "party")


@query("vote_histogram", f"WITH {VOTES}, {SHARES} SELECT CASE WHEN x >= 0.75 THEN 3 WHEN x >= 0.5 THEN 2 WHEN x >= 0.25 THEN 1 ELSE 0 END AS bin, round(sum(w), 6) AS weight FROM nn GROUP BY 1")
def vote_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rollup.histogram(place_shares(spark, d), "x", [0, 0.25, 0.5, 0.75, 1], "w").select("bin", r6("weight"))


@query("rank_correlation", f"""WITH {VOTES}, {SHARES}, j AS (SELECT p.place, p.year, p.x, p.w FROM nn p), r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY x) + (count(*) OVER (PARTITION BY year, x) - 1) / 2.0::DOUBLE AS rx,
rank() OVER (PARTITION BY year ORDER BY w) + (count(*) OVER (PARTITION BY year, w) - 1) / 2.0::DOUBLE AS rw FROM j) SELECT year, round(corr(rx, rw), 6) AS spearman FROM r GROUP BY year""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rollup.spearman(place_shares(spark, d), "x", "w", ["year"]).select("year", r6("spearman"))


@query("weighted_profile", f"""WITH {VOTES}, {SHARES}, l AS (SELECT 'w' AS weighting, 'x' AS measure, x AS v, w AS q FROM nn UNION ALL SELECT 'w', 'place', place, w FROM nn UNION ALL SELECT 'one', 'x', x, 1 FROM nn UNION ALL SELECT 'one', 'place', place, 1 FROM nn)
SELECT weighting, measure, round(sum(v * q) / sum(q), 6) AS mean FROM l GROUP BY ALL""")
def weighted_profile(spark: SparkSession, d: str) -> DataFrame:
    return rollup.profile(place_shares(spark, d).withColumn("one", F.lit(1.0)), ["x", "place"], ["w", "one"]).select("weighting", "measure", r6("mean"))


@query("share_quantiles", f"""WITH {VOTES}, {SHARES} SELECT year, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(sum(x * w) / sum(w), 6) AS mean,
round(sum(w) ** 2 / sum(w * w), 6) AS n_effective, CAST(sum(CAST(x > 0.25 AS INTEGER)) AS BIGINT) AS above, round(regr_slope(x, w), 9) AS slope FROM nn GROUP BY year""")
def share_quantiles(spark: SparkSession, d: str) -> DataFrame:
    own = place_shares(spark, d)
    points = exact_quantiles(own, "x", [0.1, 0.5, 0.9], ["year"], "q").drop("n")
    above = F.sum((F.col("x") > 0.25).cast("long")).alias("above")
    sums = own.groupBy("year").agg(rollup.weighted_mean("x", "w").alias("mean"), rollup.effective_size("w").alias("n_effective"), above, F.regr_slope("x", "w").alias("slope"))
    out = sums.join(points, "year", "left")
    return out.select("year", *[r6(F.col("q")[i], n) for i, n in enumerate(("p10", "p50", "p90"))], r6("mean"), r6("n_effective"), "above", F.round("slope", 9).alias("slope"))


@query("box_trim", f"WITH {VOTES}, {SHARES}, b AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM nn) SELECT place, year, round(x, 6) AS x FROM nn, b WHERE x BETWEEN lo AND hi")
def box_trim(spark: SparkSession, d: str) -> DataFrame:
    return rollup.trim_box(place_shares(spark, d), ["x"], 0.05, 0.95).select("place", "year", r6("x"))


@query("option_frequency", f"WITH {VOTES}, g AS (SELECT unit, segment, option, sum(votes) AS v FROM votes GROUP BY ALL), w AS (SELECT unit, segment, option FROM g QUALIFY row_number() OVER (PARTITION BY unit, segment ORDER BY v DESC, option) = 1), c AS (SELECT unit, option, count(*) AS n FROM w GROUP BY ALL) SELECT unit, option, n, round(n / sum(n) OVER (PARTITION BY unit), 6) AS frequency FROM c")
def option_frequency(spark: SparkSession, d: str) -> DataFrame:
    w = units.winners(votes(spark, d), ["unit", "segment"]).withColumnRenamed("winner", "option")
    return rollup.frequency(w, ["unit", "option"], ["unit"]).withColumn("frequency", r6("frequency"))


@query("interpolated_curve", f"""WITH {VOTES}, c AS (SELECT unit, year, CAST(sum(votes) AS DOUBLE) AS y FROM votes GROUP BY ALL), s AS (SELECT unit, year AS x0, y AS y0, lead(year) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY unit ORDER BY year))
SELECT unit, round(y0 + (y1 - y0) * (1997.25 - x0) / (x1 - x0), 6) AS value FROM s WHERE x0 <= 1997.25 AND x1 > 1997.25""")
def interpolated_curve(spark: SparkSession, d: str) -> DataFrame:
    c = votes(spark, d).groupBy("unit", "year").agg(F.sum("votes").cast("double").alias("y"))
    return rollup.bracket_value(c, "year", "y", 1997.25, ["unit"]).select("unit", r6("value"))


@query("crosswalk", """SELECT n.n_regionkey AS within, n.n_nationkey AS code, n.n_nationkey AS target, 'exact' AS method FROM nation n""")
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    left = n.select(F.col("n_regionkey").alias("within"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    right = n.select(F.col("n_regionkey").alias("within"), F.col("n_nationkey").alias("target"), F.lower("n_name").alias("other"))
    return dims.match_names(left, right, "within", "code", "target", "name", "other").select("within", "code", "target", "method")


@query("expectations", "SELECT 'required_columns' AS rule, true AS passed, 0::BIGINT AS found UNION ALL SELECT 'min_rows', count(*) >= 10, count(*) FROM supplier UNION ALL SELECT 'positive', sum(CAST(NOT s_acctbal > 0 AS INTEGER)) = 0, CAST(sum(CAST(NOT s_acctbal > 0 AS INTEGER)) AS BIGINT) FROM supplier UNION ALL SELECT 'named', sum(CAST(s_name IS NULL AS INTEGER)) = 0, CAST(sum(CAST(s_name IS NULL AS INTEGER)) AS BIGINT) FROM supplier")
def expectations(spark: SparkSession, d: str) -> DataFrame:
    return scan.expect(table(spark, d, "supplier"), ["s_suppkey", "s_name"], 10, checks={"positive": F.col("s_acctbal") > 0, "named": F.col("s_name").isNotNull()})


@query("changed_snapshots", """WITH s AS (SELECT event_type AS dataset, CAST(ts AS DATE) AS version, count(*) % 3 AS digest FROM events GROUP BY ALL), l AS (SELECT *, lag(digest) OVER (PARTITION BY dataset ORDER BY version) AS b FROM s)
SELECT dataset, CAST(version AS VARCHAR) AS version, CAST(digest AS BIGINT) AS digest FROM l WHERE b IS NULL OR b <> digest""")
def changed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset"), F.to_date("ts").cast("string").alias("version")).agg((F.count("*") % 3).alias("digest"))
    return scan.changed_snapshots(s, ["dataset"], "version", "digest")


@query("latest_versions", "WITH s AS (SELECT event_type AS dataset, CAST(ts AS DATE) AS version, count(*) AS n FROM events GROUP BY ALL) SELECT dataset, CAST(version AS VARCHAR) AS version, n FROM s QUALIFY version = max(version) OVER (PARTITION BY dataset)")
def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset"), F.to_date("ts").cast("string").alias("version")).agg(F.count("*").alias("n"))
    return scan.latest_version(s, ["dataset"])


@query("nested_values", """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def nested_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("j"))
    return e.groupBy("event_type", F.col("j.k").alias("k")).agg(F.count("*").alias("n"))


@query("candidate_base", f"""WITH {VOTES}, c AS (SELECT unit, party AS candidate, {FAMILY.replace('year', '1999')} AS family, CAST(sum(votes) AS BIGINT) AS votes FROM votes WHERE year = 1999 GROUP BY ALL),
g AS (SELECT unit, party, sum(votes) AS v FROM votes WHERE year = 1995 GROUP BY ALL), e AS (SELECT unit, party FROM g QUALIFY row_number() OVER (PARTITION BY unit ORDER BY v DESC, party) <= 3),
j AS (SELECT c.*, e.party IS NOT NULL AS incumbent FROM c LEFT JOIN e ON c.unit = e.unit AND c.candidate = e.party), o AS (SELECT *, row_number() OVER (PARTITION BY unit, family ORDER BY incumbent DESC, votes DESC, candidate) AS order_in_family FROM j)
SELECT unit, candidate, candidate AS person, family, votes, incumbent, CAST(order_in_family AS INTEGER) AS order_in_family, order_in_family = 1 AS "first" FROM o""")
def candidate_base(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    number = F.substring("party", 7, 9).cast("int")
    c = v.where("year = 1999").groupBy("unit", "party").agg(F.sum("votes").alias("votes")).select("unit", F.col("party").alias("candidate"), F.col("party").alias("person"), F.concat(F.lit("f"), (number + 1999) % 6).alias("family"), "votes")
    before = rollup.top_per_group(rollup.total(v.where("year = 1995"), ["unit", "party"], "votes"), ["unit"], [F.desc("votes"), F.asc("party")], 3).select("unit", F.col("party").alias("person"))
    return units.candidate_base(c, before)


@query("shares_by_year", f"WITH {VOTES} SELECT unit, " + ", ".join(f"round(coalesce(sum(votes) FILTER (WHERE year = {y} AND option = 'PROMO'), 0) / sum(votes) FILTER (WHERE year = {y}), 6) AS share_{y}" for y in (1996, 1999)) + " FROM votes GROUP BY unit")
def shares_by_year(spark: SparkSession, d: str) -> DataFrame:
    out = units.shares_by_year(votes(spark, d), "unit", "PROMO", [1996, 1999])
    return out.select("unit", *[r6(F.coalesce(f"share_{y}", F.lit(0.0)), f"share_{y}") for y in (1996, 1999)])


@query("party_evidence", f"""WITH {VOTES}, v AS (SELECT party, CAST(sum(votes) AS BIGINT) AS votes FROM votes GROUP BY party), g AS (SELECT unit, party, sum(votes) AS v FROM votes GROUP BY ALL), e AS (SELECT unit, party FROM g QUALIFY row_number() OVER (PARTITION BY unit ORDER BY v DESC, party) <= 3), s AS (SELECT party, count(*) AS seats FROM e GROUP BY party)
SELECT v.party, votes, coalesce(seats, 0) AS seats, CASE WHEN CAST(substr(v.party, 7) AS INTEGER) % 2 = 0 THEN 'even' END AS family, round(votes / sum(votes) OVER (), 6) AS share, CAST(substr(v.party, 7) AS INTEGER) % 2 = 0 AS covered FROM v LEFT JOIN s USING (party)""")
def party_evidence(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    seats = rollup.top_per_group(rollup.total(v, ["unit", "party"], "votes"), ["unit"], [F.desc("votes"), F.asc("party")], 3).select("party", F.lit(1).alias("seats"))
    even = table(spark, d, "part").select(F.col("p_brand").alias("party")).distinct().where(F.substring("party", 7, 9).cast("int") % 2 == 0).withColumn("family", F.lit("even"))
    return units.party_evidence(v, seats, even).withColumn("share", r6("share"))
