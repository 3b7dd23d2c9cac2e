"""Queries over the electorate: categories, layers, party seats, polls' registers, races, gaps and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import normal, normal_sql, share
from ..operators import dims, polls as poll_ops, rollup, scenario, spatial, territory, transfer, units
from ..sources import scan
from .bindings import POINTS, POLLS, VOTES, points, polls, query, r6, table, votes
from .models import DESTS, DHONDT, ORIGINS, PLACE, ROUND, STRENGTH, matrices, place_rounds, strength
from .votes import FAMILY, GROUP_SQL, SERIES, SHARES, assigned_families, group_votes, place_shares, series

LEFT = ("PROMO", "LARGE", "SMALL")

# --- categories and filters --------------------------------------------------


@query("elector_profile", """WITH e AS (SELECT CASE WHEN a < 25 THEN '16-24' WHEN a < 35 THEN '25-34' WHEN a < 45 THEN '35-44' WHEN a < 60 THEN '45-59' ELSE '60+' END AS age,
CASE WHEN s < 20000 THEN 'under 20k' WHEN s < 100000 THEN '20k-100k' WHEN s < 500000 THEN '100k-500k' ELSE 'over 500k' END AS size, CASE k % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' ELSE '-' END AS sex, CASE WHEN k % 4 < 2 THEN 'higher' ELSE 'other' END AS degree
FROM (SELECT c_custkey AS k, 16 + c_custkey % 60 AS a, abs(c_acctbal) * 60 AS s FROM customer)) SELECT age, size, sex, degree, count(*) AS n FROM e GROUP BY ALL""")
def elector_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        territory.age_band(((16 + k % 60) * 100 + 16 + k % 60 + 4).cast("string")).alias("age"), territory.size_band(F.abs("c_acctbal") * 60).alias("size"),
        F.when(k % 3 == 0, " Feminino").when(k % 3 == 1, "MASCULINO").otherwise("?").alias("s"), F.when(k % 4 == 0, "superior completo").when(k % 4 == 1, "SUPERIOR INCOMPLETO").otherwise("Médio").alias("g"))
    own = territory.sex_and_degree(c, "s", "g").fillna("-", ["sex"])
    return own.groupBy("age", "size", "sex", "degree").agg(F.count("*").alias("n"))


@query("unit_filters", f"""WITH {VOTES}, u AS (SELECT region, unit, segment, coalesce(sum(votes) FILTER (WHERE option IN {LEFT}), 0) / sum(votes) AS share, count(DISTINCT section) AS electors FROM votes GROUP BY ALL)
SELECT unit, segment, CASE region WHEN 'AFRICA' THEN 'south' WHEN 'ASIA' THEN 'east' ELSE 'rest' END AS side, round(share, 6) AS share, electors, electors < 20 AS small, share BETWEEN 0.45 AND 0.55 AND electors > 10 AS swing FROM u WHERE lower(segment) LIKE '%build%' AND unit <> 'NATION_7'""")
def unit_filters(spark: SparkSession, d: str) -> DataFrame:
    """Units of one kind of place, without the overseas one: their part of the country, small ones, and those in the balance."""
    v = votes(spark, d).where(F.lower("segment").contains("build") & (F.col("unit") != "NATION_7"))
    u = v.groupBy("region", "unit", "segment").agg(share(F.coalesce(F.sum(F.when(F.col("option").isin(*LEFT), F.col("votes"))), F.lit(0)), F.sum("votes")).alias("share"), F.countDistinct("section").alias("electors"))
    sides = scan.dimension(spark, {"AFRICA": "south", "ASIA": "east"}, "region", "side")
    u = dims.lookup(u, sides, "region", "side", "rest")
    return u.select("unit", "segment", "side", r6("share"), "electors", (F.col("electors") < 20).alias("small"), (F.col("share").between(0.45, 0.55) & (F.col("electors") > 10)).alias("swing"))


@query("mixed_types", "SELECT p_brand AS party, count(DISTINCT p_type) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def mixed_types(spark: SparkSession, d: str) -> DataFrame:
    return rollup.consistent(table(spark, d, "part").select(F.col("p_brand").alias("party"), F.col("p_type").alias("type")), "party", "type")


@query("first_last", f"WITH {VOTES}, {SHARES} SELECT place, round(arg_min(x, year), 6) AS first, round(arg_max(x, year), 6) AS last, round(arg_max(x, year) - arg_min(x, year), 6) AS change FROM nn GROUP BY place")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    return rollup.first_last(place_shares(spark, d), ["place"], "year", "x").select("place", r6("first"), r6("last"), r6("change"))


@query("filled_constant", "SELECT o_orderkey AS section, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END) OVER (PARTITION BY o_custkey)) AS label FROM orders")
def filled_constant(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("section"), "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("label"))
    return rollup.fill_constant(o, ["o_custkey"], "label").select("section", "label")


@query("observed_percentile", f"WITH {VOTES}, {SHARES} SELECT year, round(avg(CAST(x < 0.2 AS INTEGER)) + 0.5 * avg(CAST(x = 0.2 AS INTEGER)), 6) AS percentile FROM nn GROUP BY year")
def observed_percentile(spark: SparkSession, d: str) -> DataFrame:
    return place_shares(spark, d).groupBy("year").agg(r6(rollup.mid_rank("x", F.lit(0.2)), "percentile"))


@query("needed_input", f"WITH {POLLS}, f AS (SELECT candidate, CAST(day(end_date) AS DOUBLE) AS x, pct AS y FROM polls) SELECT candidate, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round((50 - regr_intercept(y, x)) / regr_slope(y, x), 4) AS needed FROM f GROUP BY candidate")
def needed_input(spark: SparkSession, d: str) -> DataFrame:
    f = polls(spark, d).select("candidate", F.dayofmonth("end_date").cast("double").alias("x"), F.col("pct").alias("y"))
    return rollup.line_input(f, ["candidate"], "x", "y", 50.0).select("candidate", r6("slope"), r6("intercept"), F.round("needed", 4).alias("needed"))


@query("bin_medians", f"""WITH {VOTES}, {SHARES}, p AS (SELECT x, w FROM nn), e AS (SELECT quantile_cont(w, 0.25) AS e1, quantile_cont(w, 0.5) AS e2, quantile_cont(w, 0.75) AS e3 FROM p),
b AS (SELECT x, w, 1 + CAST(w > e1 AS INTEGER) + CAST(w > e2 AS INTEGER) + CAST(w > e3 AS INTEGER) AS bin FROM p, e) SELECT bin, count(*) AS n, round(sum(x * w) / sum(w), 6) AS x_mean, round(median(x), 6) AS x_median FROM b GROUP BY bin""")
def bin_medians(spark: SparkSession, d: str) -> DataFrame:
    b = rollup.quantile_bin(place_shares(spark, d).select("x", "w"), "w", 4)
    return rollup.bin_summary(b, ["x"], "w").select("bin", "n", r6("x_mean"), r6("x_median"))


LAYERS = {"nation": [], "region": ["region"], "unit": ["region", "unit"], "segment": ["region", "unit", "segment"], "year": ["year"], "region year": ["region", "year"], "unit year": ["region", "unit", "year"], "segment year": ["region", "unit", "segment", "year"]}
_MEASURES = {"votes": "sum(votes)", "sections": "count(DISTINCT section)", "places": "count(DISTINCT place)", "first_round": "sum(CASE WHEN round = 1 THEN votes ELSE 0 END)", "second_round": "sum(CASE WHEN round = 2 THEN votes ELSE 0 END)", "largest": "max(votes)"}
_PARTS = {"promo": "PROMO", "large": "LARGE", "small": "SMALL", "medium": "MEDIUM", "economy": "ECONOMY", "standard": "STANDARD"}


@query("layer_metrics", f"WITH {VOTES} SELECT CASE WHEN grouping(region) = 1 THEN CASE WHEN grouping(year) = 1 THEN 'nation' ELSE 'year' END ELSE CASE WHEN grouping(unit) = 1 THEN 'region' WHEN grouping(segment) = 1 THEN 'unit' ELSE 'segment' END || CASE WHEN grouping(year) = 1 THEN '' ELSE ' year' END END AS layer, region, unit, segment, CAST(coalesce(year, 0) AS INTEGER) AS year, "
+ ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _MEASURES.items()) + ", " + ", ".join(f"round(sum(CASE WHEN option = '{o}' THEN votes ELSE 0 END) / sum(votes), 6) AS {k}" for k, o in _PARTS.items())
+ " FROM votes GROUP BY GROUPING SETS (" + ", ".join("(" + ", ".join(s) + ")" for s in LAYERS.values()) + ")")
def layer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Twelve measures of eight layers of territory; distinct sections and places by value."""
    parts = [r6(share(F.sum(F.when(F.col("option") == o, F.col("votes")).otherwise(0)), F.sum("votes")), k) for k, o in _PARTS.items()]
    distinct = {"sections": "section", "places": "place"}
    out = rollup.layers(votes(spark, d), LAYERS, [*[F.expr(v).cast("long").alias(k) for k, v in _MEASURES.items() if k not in distinct], *parts], distinct)
    return out.fillna(0, ["year"]).select("region", "segment", "unit", "year", *_MEASURES, *_PARTS, "layer")


# --- parties, rolls and results ----------------------------------------------


@query("party_votes_seats", f"""WITH {VOTES}, p AS (SELECT unit, party, CAST(sum(votes) AS BIGINT) AS votes FROM votes WHERE year = 1999 GROUP BY ALL), e AS (SELECT unit, party, row_number() OVER (PARTITION BY unit ORDER BY votes DESC, party) <= 3 AS won FROM p),
f AS (SELECT p.unit, 'f' || (CAST(substr(p.party, 7) AS INTEGER) + 1999) % 6 AS family, CAST(sum(votes) AS BIGINT) AS votes, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS seats FROM p JOIN e ON p.unit = e.unit AND p.party = e.party GROUP BY ALL)
SELECT unit, family, votes, seats, round(votes / sum(votes) OVER (PARTITION BY unit), 6) AS share FROM f""")
def party_votes_seats(spark: SparkSession, d: str) -> DataFrame:
    """Votes for persons and lists, and seats by status, per family and unit."""
    v = votes(spark, d).where("year = 1999")
    at = lambda r: F.sum(F.when(F.col("round") == r, F.col("votes")))
    own = v.groupBy("unit", "place", "party").agg(at(1).alias("nominal"), at(2).alias("list"))
    top = rollup.top_per_group(rollup.total(v, ["unit", "party"], "votes"), ["unit"], [F.desc("votes"), F.asc("party")], 9)
    elected = top.select("unit", "party", F.when(F.col("rank") <= 3, F.when(F.col("rank") == 1, "Eleito por QP").otherwise("ELEITO POR MÉDIA")).otherwise("SUPLENTE").alias("status"))
    family = assigned_families(spark, d).where("year = 1999").select("party", "family")
    return units.party_votes_and_seats(own, elected, family, "unit", "place")["family_unit"].withColumn("share", r6("share"))


@query("merged_roll", """WITH r AS (SELECT o_custkey AS customer, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey - 5 >= 0 THEN o_orderkey - 5 ELSE o_orderkey END AS section, o_orderkey, 60 + o_orderkey % 7 AS electors, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.5 END AS lat FROM orders)
SELECT section, CAST(sum(electors) AS BIGINT) AS electors, count(*) AS n_merged, arg_min(customer, o_orderkey) AS place, coalesce(arg_min(coalesce(lat, -99), o_orderkey), -99) AS lat FROM r GROUP BY section""")
def merged_roll(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    bad = F.when(key % 3 != 0, F.lit(1.5)).when(key % 2 == 0, F.lit(-1.0)).otherwise(F.lit(0.0))
    o = table(spark, d, "orders").select(F.lit(1).alias("unit"), key.alias("section"), (key - 5).alias("principal"), F.col("o_custkey").alias("place"), F.lit("x").alias("name"), (60 + key % 7).alias("electors"), bad.alias("lat"), bad.alias("lon"))
    out = units.merged_sections(o, ["unit"], "section", F.col("section") % 5 == 0, "principal")
    return out.select("section", "electors", "n_merged", "place", F.coalesce("lat", F.lit(-99.0)).alias("lat"))


@query("final_results", f"""WITH {VOTES}, o AS (SELECT unit, option, sum(votes) AS votes FROM votes WHERE round = 2 GROUP BY ALL), r AS (SELECT unit, CAST(60 * count(DISTINCT section) AS BIGINT) AS electors FROM votes GROUP BY unit),
s AS (SELECT unit, CAST(sum(votes) AS BIGINT) AS attended, CAST(coalesce(sum(votes) FILTER (WHERE option = 'SMALL'), 0) AS BIGINT) AS blank, CAST(coalesce(sum(votes) FILTER (WHERE option = 'MEDIUM'), 0) AS BIGINT) AS "null", CAST(coalesce(sum(votes) FILTER (WHERE option NOT IN ('SMALL', 'MEDIUM')), 0) AS BIGINT) AS valid FROM o GROUP BY unit),
w AS (SELECT unit, option AS winner FROM o WHERE option NOT IN ('SMALL', 'MEDIUM') QUALIFY row_number() OVER (PARTITION BY unit ORDER BY votes DESC, option) = 1)
SELECT unit, attended, blank, "null", valid, winner, electors, round(attended / electors, 6) AS turnout FROM s JOIN w USING (unit) JOIN r USING (unit)""")
def final_results(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    roll = v.groupBy("unit").agg((F.countDistinct("section") * 60).alias("electors"))
    return units.final_results(v.where("round = 2"), roll, "unit", ["SMALL"], ["MEDIUM"]).withColumn("turnout", r6("turnout"))


ANNEX = """a0 AS (SELECT unit, segment, year, option, sum(votes) AS votes FROM votes WHERE year IN (1996, 1999) GROUP BY ALL), a1 AS (SELECT unit, segment, year, option FROM a0 QUALIFY row_number() OVER (PARTITION BY unit, segment, year ORDER BY votes DESC, option) = 1),
an AS (SELECT n.unit, n.segment, n.option AS winner, coalesce(n.option <> b.option, false) AS flipped FROM a1 n LEFT JOIN a1 b ON n.unit = b.unit AND n.segment = b.segment AND b.year = 1996 WHERE n.year = 1999)"""


@query("winners_summary", f"""WITH {VOTES}, {ANNEX}, w AS (SELECT unit, segment, CAST(sum(votes) AS BIGINT) AS electors FROM votes GROUP BY ALL) SELECT winner, count(*) AS n, CAST(sum(electors) AS BIGINT) AS electors, CAST(sum(CAST(flipped AS INTEGER)) AS BIGINT) AS flips FROM an JOIN w USING (unit, segment) GROUP BY winner""")
def winners_summary(spark: SparkSession, d: str) -> DataFrame:
    v, u = votes(spark, d), ["unit", "segment"]
    annex = units.unit_annex(units.winners(v.where("year = 1999"), u), units.winners(v.where("year = 1996"), u), u)
    return units.annex_summary(annex.join(v.groupBy(*u).agg(F.sum("votes").alias("electors")), u), "electors")


@query("naive_rules", f"""WITH {VOTES}, a0 AS (SELECT unit, segment, year, option, sum(votes) AS votes FROM votes WHERE year IN (1998, 1999) GROUP BY ALL), a1 AS (SELECT unit, segment, year, option FROM a0 QUALIFY row_number() OVER (PARTITION BY unit, segment, year ORDER BY votes DESC, option) = 1),
top AS (SELECT option FROM a0 WHERE year = 1998 GROUP BY option ORDER BY sum(votes) DESC, option LIMIT 1), m AS (SELECT n.option AS won, b.option AS said, 'same as before' AS method FROM a1 n JOIN a1 b ON n.unit = b.unit AND n.segment = b.segment AND b.year = 1998 WHERE n.year = 1999
UNION ALL SELECT n.option, top.option, 'largest' FROM a1 n, top WHERE n.year = 1999) SELECT method, count(*) AS n, CAST(sum(CAST(won = said AS INTEGER)) AS BIGINT) AS hits, round(avg(CAST(won = said AS INTEGER)), 6) AS rate FROM m GROUP BY method""")
def naive_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often the winner before, and the nation's largest option, win a place's contest."""
    v, u = votes(spark, d).where("year in (1998, 1999)"), ["unit", "segment"]
    now, before = units.winners(v.where("year = 1999"), u), units.winners(v.where("year = 1998"), u)
    top = rollup.total(v.where("year = 1998"), ["option"], "votes").orderBy(F.desc("votes"), "option").limit(1).select(F.col("option").alias("largest"))
    j = now.select(*u, "winner").join(before.select(*u, F.col("winner").alias("previous")), u, "left").crossJoin(F.broadcast(top))
    return rollup.hit_rates(j, "winner", {"same as before": "previous", "largest": "largest"}).withColumn("rate", r6("rate"))


@query("abandonment", f"""WITH {VOTES}, s AS (SELECT region, segment, sum(CASE WHEN round = 1 THEN votes ELSE 0 END) AS a, sum(CASE WHEN round = 2 THEN votes ELSE 0 END) AS b FROM votes GROUP BY ALL) SELECT region, segment, CAST(a AS BIGINT) AS before, CAST(b AS BIGINT) AS after, round(greatest((a - b) / a, 0), 6) AS rate FROM s""")
def abandonment(spark: SparkSession, d: str) -> DataFrame:
    at = lambda r: F.when(F.col("round") == r, F.col("votes")).otherwise(0)
    v = votes(spark, d).withColumn("one", at(1)).withColumn("two", at(2))
    return territory.abandonment(v, ["region", "segment"], "one", "two").withColumn("rate", r6("rate"))


@query("gap_change", f"""WITH {VOTES}, {SHARES}, f AS (SELECT year, regr_slope(x, w) AS slope, regr_intercept(x, w) AS intercept FROM nn WHERE year IN (1996, 1999) GROUP BY year), l AS (SELECT year, 'w' AS term, slope AS coef FROM f UNION ALL SELECT year, 'intercept', intercept FROM f)
SELECT term, round(arg_min(coef, year), 6) AS before, round(arg_max(coef, year), 6) AS after, round(arg_max(coef, year) - arg_min(coef, year), 6) AS change FROM l GROUP BY term""")
def gap_change(spark: SparkSession, d: str) -> DataFrame:
    """Regression of a share on size in two elections, and how its coefficients moved."""
    s = place_shares(spark, d).where("year in (1996, 1999)").withColumn("one", F.lit(1.0))
    fit = transfer.least_squares(s, ["year"], ["w"], "x", "one")
    return transfer.coefficient_change(fit, [], "year").select("term", r6("before"), r6("after"), r6("change"))


@query("endorsements", f"""WITH {VOTES}, s AS (SELECT sum(votes) FILTER (WHERE option IN ('PROMO', 'LARGE')) AS a, sum(votes) FILTER (WHERE option IN ('SMALL', 'MEDIUM')) AS b, sum(votes) FILTER (WHERE option = 'ECONOMY') AS t FROM votes)
SELECT scenario, round((a + t * turnout * follow) / (a + b + t * turnout), 6) AS share FROM s, (VALUES ('neutral', 0.5::DOUBLE, 1.0::DOUBLE), ('endorsed', 0.8::DOUBLE, 1.0::DOUBLE), ('half stay at home', 0.5::DOUBLE, 0.5::DOUBLE)) x(scenario, follow, turnout)""")
def endorsements(spark: SparkSession, d: str) -> DataFrame:
    at = lambda *o: F.sum(F.when(F.col("option").isin(*o), F.col("votes")))
    gap = votes(spark, d).agg(at("PROMO", "LARGE").alias("side1"), at("SMALL", "MEDIUM").alias("side0"), at("ECONOMY").alias("third"))
    s = spark.createDataFrame([("neutral", 0.5, 1.0), ("endorsed", 0.8, 1.0), ("half stay at home", 0.5, 0.5)], "scenario string, follow double, turnout double")
    return transfer.endorsement(gap, s).withColumn("share", r6("share"))


@query("two_sided_share", f"""WITH {VOTES}, s AS (SELECT unit, CAST(coalesce(sum(votes) FILTER (WHERE option = 'PROMO'), 0) + 10 AS DOUBLE) AS side1, CAST(coalesce(sum(votes) FILTER (WHERE option = 'LARGE'), 0) + 5 AS DOUBLE) AS side0 FROM votes GROUP BY unit) SELECT unit, side1, side0, round(side1 / (side1 + side0), 6) AS share FROM s""")
def two_sided_share(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).select("unit", F.col("option").alias("dest"), "votes")
    return transfer.two_sided_share(v, ("PROMO", "LARGE"), ["unit"], (10.0, 5.0)).withColumn("share", r6("share"))


@query("place_zones", f"""WITH {POINTS}, p AS (SELECT unit, point % 5 AS zone, sum(electors) AS w FROM points GROUP BY ALL), m AS (SELECT unit, arg_max(zone, w) AS main FROM p GROUP BY unit) SELECT point, CAST(CASE WHEN point % 3 = 0 THEN point % 5 ELSE main END AS BIGINT) AS zone FROM points JOIN m USING (unit)""")
def place_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone of a point where it is known, else the zone with most electors in its unit; here no two zones have as many."""
    p = points(spark, d)
    assigned = p.select("point", "unit", F.when(F.col("point") % 3 == 0, F.col("point") % 5).alias("zone"))
    return spatial.unit_zones(p.select("unit", (F.col("point") % 5).alias("zone"), "electors"), assigned, "unit", "zone", "electors").select("point", "zone")


# --- polls -------------------------------------------------------------------


@query("rejected_rows", """SELECT CASE WHEN event_type = 'error' THEN 'event row' WHEN value > 90 THEN 'result row' WHEN user_id % 10 = 0 THEN 'no house' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1""")
def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    reasons = [("event row", F.col("event_type") == "error"), ("result row", F.col("value") > 90), ("no house", F.col("user_id") % 10 == 0)]
    return poll_ops.rejected(table(spark, d, "events"), reasons).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("long_polls", f"WITH {POLLS} SELECT poll, candidate, round(pct, 6) AS pct FROM polls WHERE candidate IN ('click', 'view', 'error')")
def long_polls(spark: SparkSession, d: str) -> DataFrame:
    """Polls as a wide table of candidates, and its rows again."""
    names = ["click", "view", "error"]
    wide = polls(spark, d).groupBy("poll").agg(*[F.max(F.when(F.col("candidate") == c, F.col("pct"))).alias(c) for c in names])
    return poll_ops.long_polls(wide, ["poll"], names).withColumn("pct", r6("pct"))


@query("poll_register", """WITH p AS (SELECT DISTINCT o_orderkey % 12000 AS poll_id, o_custkey % 40 AS registry, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
SELECT poll_id, registry, year, CASE WHEN year IN (1996, 1998 + registry % 2) AND registry < 25 THEN n_name END AS house, count(*) OVER (PARTITION BY poll_id) > 1 AS id_collision FROM p LEFT JOIN nation ON n_nationkey = registry""")
def poll_register(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select((F.col("o_orderkey") % 12000).alias("poll_id"), (F.col("o_custkey") % 40).alias("registry"), F.year("o_orderdate").alias("year"))
    h = table(spark, d, "nation").select(F.col("n_nationkey").alias("registry"), F.array(F.lit(1996), 1998 + F.col("n_nationkey") % 2).alias("years"), F.col("n_name").alias("house"))
    return units.poll_files(p, h).select("poll_id", "registry", "year", "house", "id_collision")


# --- seats, races and noise --------------------------------------------------


@query("noise_parameters", f"WITH {VOTES}, {SERIES} SELECT family, round(stddev_samp(change), 6) AS sigma_unit, round(abs(avg(change)), 6) AS sigma_national FROM series WHERE change IS NOT NULL GROUP BY family")
def noise_parameters(spark: SparkSession, d: str) -> DataFrame:
    return scenario.noise_parameters(units.volatility(series(spark, d), ["family"])).select("family", r6("sigma_unit"), r6("sigma_national"))


@query("list_base", f"""WITH {VOTES}, s AS (SELECT unit, party AS list, {FAMILY.replace('year', '1999')} AS family, CAST(sum(votes) AS BIGINT) AS votes FROM votes WHERE year = 1999 GROUP BY ALL) SELECT unit, list, family, votes, round(votes / sum(votes) OVER (PARTITION BY unit), 6) AS pct FROM s""")
def list_base(spark: SparkSession, d: str) -> DataFrame:
    v = dims.families(votes(spark, d).where("year = 1999"), assigned_families(spark, d)).withColumnRenamed("party", "list")
    return scenario.list_base(v, ["unit"]).withColumn("pct", r6("pct"))


@query("allocation_check", f"""WITH {VOTES}, base AS (SELECT unit, year, party AS list, CAST(sum(votes) AS DOUBLE) AS votes, 8 + year % 7 AS seats FROM votes GROUP BY ALL), {DHONDT.format(k='unit, year')},
al AS (SELECT base.unit, base.year, base.list, coalesce(won.seats, 0) AS s FROM base LEFT JOIN won USING (unit, year, list)), q2 AS (SELECT unit, year, list, row_number() OVER (PARTITION BY unit, year ORDER BY votes / d DESC, list, d) AS r, seats FROM (SELECT *, unnest(range(1, seats + 1)) AS d FROM base)),
ac AS (SELECT unit, year, list, count(*) AS s FROM q2 WHERE r <= seats GROUP BY ALL), j AS (SELECT unit, year, coalesce(al.s, 0) AS a, coalesce(ac.s, 0) AS b FROM al FULL JOIN ac USING (unit, year, list))
SELECT unit, year, CAST(sum(a) AS BIGINT) AS seats, sum(abs(a - b)) / 2.0::DOUBLE AS misplaced, CAST(sum(CAST(a <> b AS INTEGER)) AS BIGINT) AS options FROM j GROUP BY ALL""")
def allocation_check(spark: SparkSession, d: str) -> DataFrame:
    """Seats with and without the threshold of a quota: how many change hands."""
    v = rollup.total(votes(spark, d).withColumnRenamed("party", "list"), ["unit", "year", "list"], "votes")
    seats = 8 + F.col("year") % 7
    own = scenario.allocate(v, ["unit", "year"], "list", "votes", seats)
    return scenario.seat_differences(own, scenario.allocate(v, ["unit", "year"], "list", "votes", seats, 0.0), ["unit", "year"], "list")


RACES = 40


@query("race_probabilities", f"""WITH {VOTES}, {STRENGTH}, sims AS (SELECT unnest(range(0, {RACES})) AS sim), scored AS (SELECT unit, sim, family AS candidate, strength * CASE WHEN n_cand = 2 THEN 1 ELSE 0.7 END * exp(0.4 * {normal_sql(23, 'unit', 'sim', 'family')} + 0.5 * CAST(family = 'f2' AS INTEGER)) AS sc FROM strength, sims),
{ROUND.format(k='unit, sim', sb='0.2', zb=normal_sql(23, 'unit', 'sim', 'place', "'runoff'"))}, n AS (SELECT unit, count(*) AS n, avg(CAST(runoff AS INTEGER)) AS runoff FROM res GROUP BY unit), w AS (SELECT unit, winner, count(*) AS w FROM res GROUP BY ALL)
SELECT s.unit, s.family AS candidate, round(coalesce(w, 0) / n, 6) AS win, round(runoff, 6) AS runoff FROM strength s JOIN n ON s.unit = n.unit LEFT JOIN w ON w.unit = s.unit AND w.winner = s.family""")
def race_probabilities(spark: SparkSession, d: str) -> DataFrame:
    c = strength(spark, d).select("unit", F.col("family").alias("candidate"), "strength", (F.col("n_cand") == 2).alias("first"), (F.col("family") == "f2").alias("incumbent"))
    n = F.lit
    fan = c.crossJoin(F.broadcast(scenario.sims(spark, RACES)))
    out = scenario.two_round_rule(fan, ["unit", "sim"], n(0.7), n(0.4), n(0.5), n(0.2), normal(23, "unit", "sim", "candidate"), normal(23, "unit", "sim", "place", F.lit("runoff")))
    return scenario.race_probabilities(out, c, ["unit"]).select("unit", "candidate", r6("win"), r6("runoff"))


@query("chamber_seats", f"""WITH {VOTES}, {STRENGTH}, sims AS (SELECT unnest(range(0, 30)) AS sim), e AS (SELECT sim, unit, family, 1 AS entry, strength AS s FROM strength, sims UNION ALL SELECT sim, unit, family, 2, 0.6 * strength FROM strength, sims WHERE n_cand >= 2),
w AS (SELECT *, s * exp(0.3 * {normal_sql(29, 'sim', 'unit', 'family', 'entry')}) AS x FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY sim, unit ORDER BY x DESC, entry, family) AS r FROM w)
SELECT CAST(sim AS INTEGER) AS sim, family, CAST(sum(CAST(r <= 2 AS INTEGER)) + 5 AS BIGINT) AS seats FROM r GROUP BY ALL""")
def chamber_seats(spark: SparkSession, d: str) -> DataFrame:
    """Two seats in play in each unit, with the five that each family keeps; every simulation must fill the chamber."""
    s = strength(spark, d).crossJoin(F.broadcast(scenario.sims(spark, 30)))
    won = scenario.two_winner_rule(s, ["sim", "unit"], 0.6, effect=0.3 * normal(29, "sim", "unit", "family", "entry"))
    kept = spark.createDataFrame([(f"f{i}", 5) for i in range(6)], "family string, seats long")
    total = table(spark, d, "nation").count() * 2 + 30
    return scenario.chamber(won, kept, total)
