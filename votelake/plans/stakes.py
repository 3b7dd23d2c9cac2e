"""Queries over what a runoff can still win, by place, unit, size and cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import band, share
from ..operators import ranges, spatial, territory
from ..sources.shared import written
from .bindings import VOTES, query, r6, votes
from .models import MORAN, MORAN_CLUSTER, NODES, PERMUTATIONS, SIGNIFICANCE, Z, nodes

ONE, OTHER = ("PROMO", "LARGE"), ("SMALL", "MEDIUM")

STAKES = f"""sp AS (SELECT region, unit, place, sum(votes) FILTER (WHERE option IN {ONE}) AS a, sum(votes) FILTER (WHERE option IN {OTHER}) AS b, sum(votes) FILTER (WHERE option IN {ONE} AND round = 1) AS a1, sum(votes) FILTER (WHERE option IN {OTHER} AND round = 1) AS b1,
  sum(votes) AS total, sum(votes) FILTER (WHERE option IN {ONE} AND year < 1996) AS ha, sum(votes) FILTER (WHERE option IN {OTHER} AND year < 1996) AS hb, 60 * count(*) AS electors FROM votes GROUP BY ALL),
sq AS (SELECT region, unit, place, CAST(electors AS BIGINT) AS electors, CAST(coalesce(a, 0) AS BIGINT) AS side1, CAST(coalesce(b, 0) AS BIGINT) AS side0, CAST(total - coalesce(a, 0) - coalesce(b, 0) AS BIGINT) AS third, CAST(coalesce(a1, 0) // 4 AS BIGINT) AS reserve1, CAST(coalesce(b1, 0) // 5 AS BIGINT) AS reserve0,
  coalesce(coalesce(ha, 0) / nullif(coalesce(ha, 0) + coalesce(hb, 0), 0), coalesce(a, 0) / nullif(coalesce(a, 0) + coalesce(b, 0), 0), 0.5::DOUBLE) AS p FROM sp),
st AS (SELECT *, side1 - side0 AS gap, third + reserve1 + reserve0 AS at_stake, electors * 0.01::DOUBLE * (2 * p - 1) AS elasticity FROM sq)"""
TABLE = """count(*) AS n, CAST(sum(electors) AS BIGINT) AS electors, CAST(sum(side1) AS BIGINT) AS side1, CAST(sum(side0) AS BIGINT) AS side0, CAST(sum(third) AS BIGINT) AS third, CAST(sum(reserve1) AS BIGINT) AS reserve1, CAST(sum(reserve0) AS BIGINT) AS reserve0, CAST(sum(gap) AS BIGINT) AS gap, CAST(sum(at_stake) AS BIGINT) AS at_stake,
round(sum(elasticity), 4) AS elasticity, round(sum(side1) / nullif(sum(side1 + side0), 0), 6) AS share, round(sum(at_stake) / (SELECT sum(at_stake) FROM st), 6) AS part_at_stake, round(sum(gap) / (SELECT sum(gap) FROM st), 6) AS part_gap"""
SIZES = [0, 600, 1200, 2400, 10**9]
LABELS = ["under 600", "600 to 1200", "1200 to 2400", "over 2400"]


def stakes(spark: SparkSession, d: str) -> DataFrame:
    """Places with votes of two sides, of third options, reserves (a part of the first round's votes), electors (60 a ballot line) and the share of earlier years."""
    at = lambda options, cond=F.lit(True): F.sum(F.when(F.col("option").isin(*options) & cond, F.col("votes")).otherwise(0))
    early, first = F.col("year") < 1996, F.col("round") == 1
    s = votes(spark, d).groupBy("region", "unit", "place").agg(
        (F.count("*") * 60).alias("electors"), at(ONE).alias("side1"), at(OTHER).alias("side0"), F.sum("votes").alias("total"),
        F.floor(at(ONE, first) / 4).alias("reserve1"), F.floor(at(OTHER, first) / 5).alias("reserve0"), share(at(ONE, early), at((*ONE, *OTHER), early)).alias("p"))
    return territory.stakes(s.withColumn("third", F.col("total") - F.col("side1") - F.col("side0")).drop("total"))


def _rounded(t: DataFrame) -> DataFrame:
    return t.withColumn("elasticity", F.round("elasticity", 4)).withColumns({c: F.round(c, 6) for c in ("share", "part_at_stake", "part_gap")})


@query("stakes_by_unit", f"WITH {VOTES}, {STAKES} SELECT region, unit, {TABLE} FROM st GROUP BY region, unit")
def stakes_by_unit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(territory.stake_table(written(stakes(spark, d), "stakes"), ["region", "unit"]))


@query("stakes_by_size", f"WITH {VOTES}, {STAKES} SELECT CASE WHEN electors < 600 THEN 'under 600' WHEN electors < 1200 THEN '600 to 1200' WHEN electors < 2400 THEN '1200 to 2400' ELSE 'over 2400' END AS size, {TABLE} FROM st GROUP BY 1")
def stakes_by_size(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(territory.stake_table(written(stakes(spark, d).withColumn("size", band("electors", SIZES, LABELS)), "stakes"), ["size"]))


@query("stakes_gathered", f"""WITH {VOTES}, {STAKES}, r AS (SELECT sum(at_stake) OVER (ORDER BY at_stake DESC, place) AS upto, sum(at_stake) OVER () AS whole FROM st)
SELECT part, CAST(count(*) FILTER (WHERE upto < part * whole) + 1 AS BIGINT) AS n FROM r, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) p(part) GROUP BY part""")
def stakes_gathered(spark: SparkSession, d: str) -> DataFrame:
    return territory.gathered(written(stakes(spark, d), "stakes"), "at_stake", "place", [0.5, 0.8])


@query("turnout_cases", f"""WITH {VOTES}, {STAKES}, c AS (SELECT 'one region +5' AS scenario, CASE WHEN region = 'ASIA' THEN electors * 5 / 100.0::DOUBLE ELSE 0 END AS added, p FROM st UNION ALL SELECT 'won before +2', CASE WHEN p > 0.5 THEN electors * 2 / 100.0::DOUBLE ELSE 0 END, p FROM st UNION ALL SELECT 'everywhere +3', electors * 3 / 100.0::DOUBLE, p FROM st),
b AS (SELECT sum(side1) AS a, sum(side0) AS b FROM st), s AS (SELECT scenario, sum(added) AS n, sum(added * p) AS g FROM c GROUP BY scenario)
SELECT scenario, round((a + g) / (a + b + n), 6) AS share, round((a + g) / (a + b + n) - a / (a + b), 6) AS change, round(n, 4) AS added FROM s, b""")
def turnout_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = {"one region +5": (F.col("region") == "ASIA", 5.0), "won before +2": (F.col("p") > 0.5, 2.0), "everywhere +3": (F.lit(True), 3.0)}
    return territory.turnout_cases(stakes(spark, d), cases).select("scenario", r6("share"), r6("change"), F.round("added", 4).alias("added"))


@query("cluster_profile", f"""WITH {VOTES}, {STAKES}, {NODES}, {Z}, {MORAN}, l AS (SELECT node, {MORAN_CLUSTER} AS cluster FROM pp), j AS (SELECT unit, cluster, count(*) AS n, sum(electors) AS e, sum(side1) AS a, sum(side0) AS b FROM l JOIN st ON place = node GROUP BY ALL)
SELECT unit, cluster, n, round(e / sum(e) OVER (PARTITION BY unit), 6) AS part, round(a / nullif(a + b, 0), 6) AS share FROM j""")
def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    """Types of local clusters inside each unit: part of its electors and share of the first side."""
    labels = spatial.local_clusters(*nodes(spark, d), PERMUTATIONS, 1, SIGNIFICANCE)
    out = territory.cluster_profile(labels.withColumnRenamed("node", "place"), stakes(spark, d).select("unit", "place", "electors", "side1", "side0"), "unit", "place")
    return out.select("unit", "cluster", "n", r6("part"), r6("share"))


@query("median_changes", f"""WITH {VOTES}, {STAKES}, c AS (SELECT region, side1 / nullif(side1 + side0, 0) - p AS change FROM st)
SELECT region, count(change) AS n, round(quantile_cont(change, 0.5), 6) AS median, CAST(sum(CAST(change > 0 AS INTEGER)) AS BIGINT) AS up FROM c GROUP BY region""")
def median_changes(spark: SparkSession, d: str) -> DataFrame:
    """Median change of the places of a region since earlier years, by exact selection, and how many rose."""
    c = written(stakes(spark, d).select("region", (share("side1", F.col("side1") + F.col("side0")) - F.col("p")).alias("change")), "changes")
    middle = ranges.exact_quantiles(c, "change", [0.5], ["region"])
    return middle.join(c.groupBy("region").agg(F.count_if(F.col("change") > 0).alias("up")), "region").select("region", "n", r6(F.col("quantiles")[0], "median"), "up")
