"""How the library's notions are read from the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

#: Ballot lines that one task sorts, joins and sums.
TASK_LINES = 500_000

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its DuckDB SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, since sums of doubles depend on their order."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and region."""
    t = lambda n: table(spark, sf_dir, n)
    units = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # nations and regions are fixed, small dimensions
    return t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(units), F.col("c_nationkey") == F.col("n_nationkey"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ballot line: region, unit (nation), place (customer), section (order), option (part type), party (brand), year, round, votes."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_quantity")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(people(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("unit"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("place"), F.col("o_orderkey").alias("section"),
        F.col("p_type").alias("option"), F.col("p_brand").alias("party"), F.year("o_orderdate").alias("year"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("round"), F.col("l_quantity").cast("long").alias("votes"),
    )


def place_sums(spark: SparkSession, sf_dir: str, sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over the ballot lines of each place (and of ``by``: option, round), with its region, unit and segment.

    Lines are summed by the place's number before its names are joined, so that
    a task's groups are few and narrow; what ``sums`` read are option, round and votes.
    The number of tasks follows that of the lines where this is more than the
    session's, so that what one holds doesn't grow with the table.
    """
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_quantity")
    tasks = -(-line.count() // TASK_LINES)
    dealt = lambda df, key: df.repartition(tasks, key) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    j = line.join(dealt(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))  # lines follow the side that is dealt
    j = j.join(dealt(t("part").select("p_partkey", "p_type"), "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    own = j.select(F.col("o_custkey").alias("place"), F.col("p_type").alias("option"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("round"), F.col("l_quantity").cast("long").alias("votes"))
    narrow = (dealt(own, "place") if by else own).groupBy("place", *by).agg(*[c.alias(n) for n, c in sums.items()])  # sums by ``by`` are hardly fewer than lines
    named = narrow.join(people(spark, sf_dir), F.col("place") == F.col("c_custkey"))
    keys = [F.col("r_name").alias("region"), F.col("n_name").alias("unit"), F.col("c_mktsegment").alias("segment"), F.col("place"), *[F.col(c) for c in by]]
    return named.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


VOTES = """votes AS (
  SELECT r_name AS region, n_name AS unit, c_mktsegment AS segment, c_custkey AS place, o_orderkey AS section, p_type AS option, p_brand AS party,
    CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS round, CAST(l_quantity AS BIGINT) AS votes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls from events: a poll is a house (user mod 12) on a day, its candidates the event types, its percentages their values."""
    e = table(spark, sf_dir, "events")
    own = e.select((F.col("user_id") % 12).alias("h"), F.to_date("ts").alias("end_date"), F.col("event_type").alias("candidate"), F.col("value").cast("double").alias("pct"), "event_id")
    g = own.groupBy("h", "end_date", "candidate").agg(F.avg("pct").alias("pct"), F.count("*").alias("m"), F.min("event_id").alias("e"))
    return g.select(F.concat(F.lit("h"), F.col("h")).alias("house"), F.concat_ws("-", F.col("h"), F.col("end_date")).alias("poll"), "end_date", "candidate", "pct", (500 + F.col("h") * 150).alias("sample"))


POLLS = """polls AS (
  SELECT 'h' || h AS house, h || '-' || end_date AS poll, end_date, candidate, pct, 500 + h * 150 AS sample
  FROM (SELECT user_id % 12 AS h, CAST(ts AS DATE) AS end_date, event_type AS candidate, avg(CAST(value AS DOUBLE)) AS pct FROM events GROUP BY ALL))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from embeddings: two coordinates scaled to degrees, three covariates, a unit (label), electors."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    return e.select(F.col("vec_id").alias("point"), F.col("label").alias("unit"), (at(0) * 10).alias("lat"), (at(1) * 10).alias("lon"), at(2).alias("v1"), at(3).alias("v2"), at(4).alias("v3"), (F.col("vec_id") % 97 + 3).alias("electors"))


POINTS = """points AS (
  SELECT vec_id AS point, label AS unit, CAST(embedding[1] AS DOUBLE) * 10 AS lat, CAST(embedding[2] AS DOUBLE) * 10 AS lon, CAST(embedding[3] AS DOUBLE) AS v1,
    CAST(embedding[4] AS DOUBLE) AS v2, CAST(embedding[5] AS DOUBLE) AS v3, vec_id % 97 + 3 AS electors FROM embeddings)"""
