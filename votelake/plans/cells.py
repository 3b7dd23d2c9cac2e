"""Queries over cells written as text: poll tables as people type them, and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..streaming import live
from .bindings import query, r6, table
from .models import COUNTS, LIVE, counts, forecast

HOUSES = {"norte pesquisa": "norte", "merito": "merito"}
MARKS = f"'{text.MARKED}', '{text.PLAIN}'"


@query("poll_cells", """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS last, CAST(ts AS DATE) - CAST(user_id % 4 AS INTEGER) AS first, event_type, value, user_id, event_id % 6 AS f FROM events)
SELECT event_id, CASE WHEN f <> 5 AND (f = 2 OR year(first) = year(last)) THEN CAST(CASE WHEN f = 2 THEN last ELSE first END AS VARCHAR) END AS first_day, CASE WHEN f <> 5 AND (f = 2 OR year(first) = year(last)) THEN CAST(last AS VARCHAR) END AS last_day,
CASE WHEN f <> 3 THEN CAST(value AS DOUBLE) END AS pct, CASE WHEN f = 4 AND event_type = 'click' THEN CAST(value AS DOUBLE) END AS click_pct,
CASE WHEN f <> 1 THEN user_id % 90 * 1000 + 1000 END AS sample, CASE WHEN f < 4 THEN CAST(last AS VARCHAR) END AS day, CASE WHEN f = 0 THEN '?' ELSE event_type END AS label,
CASE user_id % 4 WHEN 0 THEN 'norte' WHEN 1 THEN 'merito' WHEN 2 THEN 'merito' ELSE 'wiki_house_' || user_id END AS house FROM e""")
def poll_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a row of a poll table, typed in one of six manners, and what is read from it."""
    f, u = F.col("event_id") % 6, F.col("user_id")
    e = table(spark, d, "events").withColumn("last", F.to_date("ts")).withColumn("first", F.date_sub(F.to_date("ts"), (u % 4).cast("int")))
    day = lambda c, form: F.date_format(c, form)
    dates = F.when(f == 0, F.concat(day("first", "d MMM"), F.lit(" – "), day("last", "d MMM yyyy"), F.lit("[a]")))
    dates = dates.when(f == 1, F.concat(day("first", "d MMMM"), F.lit("−"), day("last", "d MMMM"))).when(f == 2, day("last", "d MMMM yyyy"))
    dates = dates.when(f == 3, F.concat(day("first", "d MMM yyyy"), F.lit("-"), day("last", "d MMM yyyy"))).when(f == 4, F.concat(day("first", "dd MMM"), F.lit(" -- "), day("last", "dd MMM"))).otherwise("no dates")
    v = F.col("value").cast("string")
    cell = F.when(f == 0, F.concat(F.replace(v, F.lit("."), F.lit(",")), F.lit("%"))).when(f == 1, F.concat(v, F.lit("[x]"))).when(f == 3, "—")
    cell = cell.when(f == 4, F.concat(v, F.lit("% ("), F.initcap("event_type"), F.lit("[b])"))).otherwise(v)
    size = (u % 90 + 1).cast("string")
    sample = F.when(f == 1, "n/a").when(f % 2 == 0, F.concat(size, F.lit(".000[c]"))).otherwise(F.concat(size, F.lit(",000 ")))
    filed = F.when(f < 2, day("last", "yyyy-MM-dd")).when(f < 4, day("last", "dd/MM/yyyy")).otherwise(day("last", "MMM yyyy"))
    top = F.when(f == 0, "Unnamed: 3").when(f == 1, F.concat(F.col("event_type"), F.lit(" [note]")))
    below = F.when(f == 0, "Unnamed: 3_level_1").otherwise(F.col("event_type"))
    house = F.when(u % 4 == 0, "Norte Pesquisa[2]").when(u % 4 == 1, "Sul / Mérito").when(u % 4 == 2, "MÉRITO Archived 9 June").otherwise(F.concat(F.lit("House  "), u))
    raw = e.select("event_id", F.year("last").alias("year"), dates.alias("dates"), cell.alias("cell"), sample.alias("sample"), filed.alias("filed"), top.alias("top"), below.alias("below"), house.alias("house"))
    span = text.date_range("dates", "year")
    return raw.select("event_id", span["start"].cast("string").alias("first_day"), span["end"].cast("string").alias("last_day"),
        text.number_cell("cell").alias("pct"), text.number_cell("cell", "click").alias("click_pct"), text.sample_size("sample").alias("sample"),
        text.date_of("filed", "yyyy-MM-dd", "dd/MM/yyyy").cast("string").alias("day"), text.header_label("top", "below").alias("label"), text.canonical("house", HOUSES).alias("house"))


@query("plain_texts", rf"""SELECT doc_id, trim(regexp_replace(split_part(regexp_replace(lower(translate(regexp_replace(text, '\[[^\]]*\]', '', 'g'), {MARKS})), '[^ -~\t\r\n]', '', 'g') || 'archived ', 'archived ', 1), '\s+', ' ', 'g')) AS words FROM documents""")
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.plain("text").alias("words"))


@query("proper_names", """WITH x AS (SELECT c_custkey AS place, lower(c_mktsegment || ' DE ' || n_name || ' E ' || r_name) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
y AS (SELECT place, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS s FROM x) SELECT place, replace(replace(s, ' De ', ' de '), ' E ', ' e ') AS name FROM y""")
def proper_names(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(units), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("place"), text.proper_name(F.concat_ws(" DE ", "c_mktsegment", F.concat_ws(" E ", "n_name", "r_name"))).alias("name"))


@query("live_win", f"""WITH {COUNTS}, {LIVE}, ws AS (SELECT unit, sum(proj) / sum(total) * 100 AS sh, greatest(1.5::DOUBLE * (1 - sum(c) / sum(total)), 0.15::DOUBLE) AS sd FROM pj GROUP BY unit),
wz AS (SELECT unit, sh, (sh - 50) / sd AS z, abs((sh - 50) / sd) / sqrt(2::DOUBLE) AS x FROM ws), wt AS (SELECT *, 1 / (1 + 0.5::DOUBLE * x) AS t FROM wz),
we AS (SELECT *, 0.5::DOUBLE * t * exp(-x * x - 1.26551223::DOUBLE + t * (1.00002368::DOUBLE + t * (0.37409196::DOUBLE + t * (0.09678418::DOUBLE + t * (-0.18628806::DOUBLE + t * (0.27886807::DOUBLE + t * (-1.13520398::DOUBLE + t * (1.48851587::DOUBLE + t * (-0.82215223::DOUBLE + t * 0.17087277::DOUBLE))))))))) AS tail FROM wt)
SELECT unit, round(sh, 6) AS share_projected, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 6) AS win FROM we""")
def live_win(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's projected share and the chance that it is above a half."""
    out = live.estimate(live.projected_units(forecast(spark, d), counts(spark, d), 5000), 1.5, by=["unit"])
    return out.select("unit", r6("share_projected"), r6("win"))
