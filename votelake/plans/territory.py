"""Queries over territory: distributions, boxes, composition, office splits, finalists and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polls as poll_ops, rollup, territory, transfer
from ..sources.shared import written
from .bindings import POINTS, POLLS, VOTES, place_sums, points, query, r6, table, votes
from .models import DESTS, ORIGINS, VALID, WEEKS, aggregate_sql, first_round, matrices, place_rounds, valid, weekly
from .votes import SHARES, place_shares


@query("distribution_summary", f"""WITH {VOTES}, {SHARES} SELECT year, count(x) AS n, round(min(x), 6) AS low, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS high, round(sum(x * w) / sum(w), 6) AS mean,
CAST(sum(CAST(x > 0.25 AS INTEGER)) AS BIGINT) AS above_25, CAST(sum(CAST(x > 0.5 AS INTEGER)) AS BIGINT) AS above_50 FROM nn GROUP BY year""")
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    s = territory.distribution(place_shares(spark, d), ["year"], "x", "w", [0.25, 0.5])
    return s.select("year", "n", *[r6(c) for c in ("low", "p10", "p90", "high", "mean")], "above_25", "above_50")


@query("box_totals", f"""WITH {POINTS}, b(box, lat0, lat1, lon0, lon1) AS (VALUES ('all', -1000, 1000, -1000, 1000), ('south', -1000, 0, -1000, 1000), ('core', -1, 1, -1, 1))
SELECT box, count(*) AS n, CAST(sum(electors) AS BIGINT) AS electors, round(sum(electors % 7) / sum(electors), 6) AS share FROM points JOIN b ON lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1 GROUP BY box""")
def box_totals(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.createDataFrame([("all", -1000.0, 1000.0, -1000.0, 1000.0), ("south", -1000.0, 0.0, -1000.0, 1000.0), ("core", -1.0, 1.0, -1.0, 1.0)], "box string, lat0 double, lat1 double, lon0 double, lon1 double")
    return territory.box_totals(points(spark, d).withColumn("young", F.col("electors") % 7), boxes, "young", "electors").withColumn("share", r6("share"))


@query("composition", f"""WITH {VOTES}, l AS (SELECT 'segment' AS dimension, segment AS value, votes FROM votes UNION ALL SELECT 'region', region, votes FROM votes), s AS (SELECT dimension, value, CAST(sum(votes) AS BIGINT) AS votes FROM l GROUP BY ALL)
SELECT dimension, value, votes, round(votes / sum(votes) OVER (PARTITION BY dimension), 6) AS votes_share FROM s""")
def composition(spark: SparkSession, d: str) -> DataFrame:
    return territory.composition(votes(spark, d).select("segment", "region", "votes"), ["segment", "region"], ["votes"]).withColumn("votes_share", r6("votes_share"))


@query("participation", f"""WITH {VOTES}, s AS (SELECT segment, round, section, count(*) AS k, sum(votes) AS v FROM votes GROUP BY ALL), t AS (SELECT segment, round, CAST(sum(60 * k) AS BIGINT) AS electors, CAST(sum(v) AS BIGINT) AS attended FROM s GROUP BY ALL) SELECT segment, round, electors, attended, round(attended / electors, 6) AS rate FROM t""")
def participation(spark: SparkSession, d: str) -> DataFrame:
    s = votes(spark, d).groupBy("segment", "round", "section").agg((F.count("*") * 60).alias("electors"), F.sum("votes").alias("attended"))
    return territory.participation(s, ["segment", "round"], "electors", "attended").withColumn("rate", r6("rate"))


@query("spellings", """WITH n AS (SELECT p_brand AS code, p_type AS name, max(p_size) AS version FROM part GROUP BY ALL), l AS (SELECT code, arg_max(name, struct_pack(a := version, b := name)) AS latest, list(name) AS names FROM n GROUP BY code)
SELECT code, latest, array_to_string(list_sort(list_filter(names, lambda x: x <> latest)), '|') AS alternates FROM l""")
def spellings(spark: SparkSession, d: str) -> DataFrame:
    return territory.spellings(table(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("name"), F.col("p_size").alias("version")), ["code"], "name", "version")


@query("office_split", f"""WITH {VOTES}, o AS (SELECT unit, segment AS place, round AS office, option, sum(votes) AS votes FROM votes GROUP BY ALL), s AS (SELECT unit, office, option, sum(votes) AS v FROM o GROUP BY ALL),
t AS (SELECT unit, office, option, row_number() OVER (PARTITION BY unit, office ORDER BY v DESC, option) AS r FROM s QUALIFY r <= 2), w AS (SELECT unit, place, office, sum(CASE WHEN r = 1 THEN votes ELSE 0 END) / sum(votes) AS s FROM o JOIN t USING (unit, office, option) GROUP BY ALL),
p AS (SELECT unit, place, max(CASE WHEN office = 1 THEN s END) AS a, max(CASE WHEN office = 2 THEN s END) AS b FROM w GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL), c AS (SELECT unit, corr(a, b) AS r, count(*) AS n FROM p GROUP BY unit)
SELECT unit, round(r, 6) AS r, r >= 0 AS aligned, any_value(n) AS n, round(avg(CAST((a > 0.5) <> ((CASE WHEN r < 0 THEN 1 - b ELSE b END) > 0.5) AS INTEGER)), 6) AS differ FROM p JOIN c USING (unit) GROUP BY unit, r""")
def office_split(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).groupBy("unit", F.col("segment").alias("place"), F.col("round").cast("string").alias("office"), "option").agg(F.sum("votes").alias("votes"))
    return territory.office_split(v, "unit", "place", "1", "2").withColumn("r", r6("r")).withColumn("differ", r6("differ"))


@query("territory_table", f"""WITH {VOTES}, u AS (SELECT unit, CAST(coalesce(sum(votes) FILTER (WHERE option IN ('PROMO', 'LARGE', 'SMALL')), 0) AS BIGINT) AS side1, CAST(coalesce(sum(votes) FILTER (WHERE option NOT IN ('PROMO', 'LARGE', 'SMALL')), 0) AS BIGINT) AS side0 FROM votes GROUP BY unit),
h AS (SELECT unit, year, sum(CASE WHEN option IN ('PROMO', 'LARGE', 'SMALL') THEN votes ELSE 0 END) / sum(votes) AS share FROM votes GROUP BY ALL), n AS (SELECT year, sum(CASE WHEN option IN ('PROMO', 'LARGE', 'SMALL') THEN votes ELSE 0 END) / sum(votes) AS nation FROM votes GROUP BY year),
s AS (SELECT unit, year, share, nation, share - lag(share) OVER (PARTITION BY unit ORDER BY year) AS swing FROM h JOIN n USING (year)), g AS (SELECT unit, arg_max(swing, year) AS swing, avg(abs(share - nation)) AS bellwether, stddev_samp(share) AS spread FROM s GROUP BY unit)
SELECT unit, side1, side0, round((side1 - side0) / (side1 + side0), 6) AS margin, round((side1 + side0) / sum(side1 + side0) OVER (), 6) AS weight, round((side1 + side0) * (1 - abs((side1 - side0) / (side1 + side0))), 4) AS at_stake, round(swing, 6) AS swing, round(bellwether, 6) AS bellwether, round(spread, 6) AS spread FROM u JOIN g USING (unit)""")
def territory_table(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    one = F.sum(F.when(F.col("option").isin("PROMO", "LARGE", "SMALL"), F.col("votes")).otherwise(0))
    u = v.groupBy("unit").agg(one.alias("side1"), (F.sum("votes") - one).alias("side0"), F.lit(0).alias("abstained"), F.lit(1).alias("electors"))
    h = v.groupBy("unit", "year").agg((one / F.sum("votes")).alias("share")).join(F.broadcast(v.groupBy("year").agg((one / F.sum("votes")).alias("nation"))), "year")
    t = territory.territory(u, h)
    return t.select("unit", "side1", "side0", r6("margin"), r6("weight"), F.round("at_stake", 4).alias("at_stake"), r6("swing"), r6("bellwether"), r6("spread"))


@query("turnout_scenarios", f"""WITH {VOTES}, u AS (SELECT unit, sum(CASE WHEN option IN ('PROMO', 'LARGE') THEN votes ELSE 0 END) AS a, sum(CASE WHEN option IN ('PROMO', 'LARGE') THEN 0 ELSE votes END) AS b, 60 * count(*) - sum(votes) AS x FROM votes GROUP BY unit)
SELECT scenario, round(sum(a + x * (1 - factor) * a / (a + b)) / sum(a + b + x * (1 - factor)), 6) AS share FROM u, (VALUES ('same', 1.0::DOUBLE), ('half', 0.5::DOUBLE), ('all', 0.0::DOUBLE)) s(scenario, factor) GROUP BY scenario""")
def turnout_scenarios(spark: SparkSession, d: str) -> DataFrame:
    one = F.sum(F.when(F.col("option").isin("PROMO", "LARGE"), F.col("votes")).otherwise(0))
    u = votes(spark, d).groupBy("unit").agg(one.alias("side1"), (F.sum("votes") - one).alias("side0"), (F.count("*") * 60 - F.sum("votes")).alias("abstained"))
    s = spark.createDataFrame([("same", 1.0), ("half", 0.5), ("all", 0.0)], "scenario string, factor double")
    return territory.turnout_scenarios(u, s).withColumn("share", r6("share"))


@query("finalists")
def finalists(spark: SparkSession, d: str) -> DataFrame:
    v = place_sums(spark, d, {"votes": F.sum(F.when(F.col("round") == 2, F.col("votes"))), "n": F.count_if(F.col("round") == 2)}, ("option",)).where("n > 0").groupBy("unit", "place", "option").agg(F.sum("votes").alias("votes"))
    return territory.finalists(v, place_rounds(spark, d), "unit", "place", ORIGINS, "w", ["SMALL"]).withColumn("share_first", r6("share_first"))


@query("transfer_validation")
def transfer_validation(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute and median error of predicted shares per unit and destination."""
    p = place_rounds(spark, d)
    long = p.unpivot(["unit", "place"], ORIGINS, "origin", "share")
    pred = transfer.predicted_units(long, matrices(spark, d).drop("n"), ["unit"], "place")
    real = p.unpivot(["unit", "place"], DESTS, "dest", "real")
    e = pred.join(real, ["unit", "place", "dest"]).withColumn("error", F.col("predicted") - F.col("real"))
    return e.groupBy("unit", "dest").agg(r6(F.avg(F.abs("error")), "mae"), r6(F.median(F.abs("error")), "median_error"), F.count("*").alias("n"))


@query("blocks_and_reserve")
def blocks_and_reserve(spark: SparkSession, d: str) -> DataFrame:
    """Votes that each first-round group sends to each second-round one, nationally."""
    g = first_round(spark, d, "grp")
    return transfer.blocks(g, matrices(spark, d).select("unit", "origin", "dest", "p"), "unit").withColumn("votes", F.round("votes", 3))


@query("national_matrix")
def national_matrix(spark: SparkSession, d: str) -> DataFrame:
    mass = first_round(spark, d)
    return transfer.national_matrix(matrices(spark, d), mass, "unit").withColumn("p", r6("p"))


@query("robustness_variants")
def robustness_variants(spark: SparkSession, d: str) -> DataFrame:
    """The first side's share under unit matrices, the national matrix, and a return rate of 0.9."""
    g = first_round(spark, d, "grp")
    m = matrices(spark, d).select("unit", "origin", "dest", "p")
    mass = g.select("unit", F.col("grp").alias("origin"), "votes")
    flat = m.select("unit").distinct().crossJoin(F.broadcast(transfer.national_matrix(m, mass, "unit")))
    one = lambda mm, k: g.join(mm.withColumnRenamed("origin", "grp"), ["unit", "grp"]).groupBy("dest").agg(F.sum(F.col("votes") * F.col("p") * k).alias("votes"))
    back = F.when(F.col("grp") == "a_1", 0.9).otherwise(1.0)
    return territory.variants({"own": one(m, F.lit(1.0)), "nation": one(flat, F.lit(1.0)), "return 0.9": one(m, back)}, ("a_2", "b_2")).select("variant", r6("share"))


@query("needed_swing", f"""WITH {VOTES}, s AS (SELECT CAST(sum(votes) FILTER (WHERE option IN ('PROMO', 'LARGE')) AS DOUBLE) AS side1, CAST(sum(votes) FILTER (WHERE option IN ('SMALL', 'MEDIUM')) AS DOUBLE) AS side0, CAST(sum(votes) FILTER (WHERE option = 'ECONOMY') AS DOUBLE) AS reserve1, CAST(sum(votes) FILTER (WHERE option = 'STANDARD') AS DOUBLE) AS reserve0 FROM votes)
SELECT side1, side0, reserve1, reserve0, side0 - side1 AS gap, round((side0 - side1) / reserve1, 6) AS needed_of_reserve1, round((side1 - side0) / reserve0, 6) AS needed_of_reserve0 FROM s""")
def needed_swing(spark: SparkSession, d: str) -> DataFrame:
    at = lambda *o: F.sum(F.when(F.col("option").isin(*o), F.col("votes")))
    u = votes(spark, d).groupBy("unit").agg(at("PROMO", "LARGE").alias("side1"), at("SMALL", "MEDIUM").alias("side0"), at("ECONOMY").alias("reserve1"), at("STANDARD").alias("reserve0"))
    return transfer.needed_swing(u).withColumn("needed_of_reserve1", r6("needed_of_reserve1")).withColumn("needed_of_reserve0", r6("needed_of_reserve0"))


@query("path_grid", f"""WITH {VOTES}, s AS (SELECT sum(votes) FILTER (WHERE option IN ('PROMO', 'LARGE')) AS a, sum(votes) FILTER (WHERE option IN ('SMALL', 'MEDIUM')) AS b, sum(votes) FILTER (WHERE option = 'ECONOMY') AS t FROM votes)
SELECT th::DOUBLE AS third_share, ex::DOUBLE AS extra, round((a + t * th + ex) / (a + b + t + ex), 6) AS share FROM s, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) x(th), (VALUES (0.0::DOUBLE), (1000.0::DOUBLE)) y(ex)""")
def path_grid(spark: SparkSession, d: str) -> DataFrame:
    at = lambda *o: F.sum(F.when(F.col("option").isin(*o), F.col("votes")))
    gap = votes(spark, d).agg(at("PROMO", "LARGE").alias("side1"), at("SMALL", "MEDIUM").alias("side0"), at("ECONOMY").alias("third"))
    return transfer.path_grid(gap, [0.3, 0.5, 0.7], [0.0, 1000.0]).withColumn("share", r6("share"))


@query("error_by_method", f"""WITH {VOTES}, {SHARES}, j AS (SELECT p.year, p.x - q.x AS e FROM nn p JOIN nn q ON p.place = q.place AND q.year = 1995 WHERE p.year > 1995)
SELECT year, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, count(e) AS n, CAST(sum(CAST(abs(e) < 0.1 AS INTEGER)) AS BIGINT) AS hits FROM j GROUP BY year""")
def error_by_method(spark: SparkSession, d: str) -> DataFrame:
    s = place_shares(spark, d)
    j = s.where("year > 1995").join(s.where("year = 1995").select("place", F.col("x").alias("x0")), "place").withColumn("error", F.col("x") - F.col("x0")).withColumn("hit", F.abs("error") < 0.1)
    return rollup.error_summary(j, ["year"], "error", "hit").select("year", r6("rmse"), r6("mae"), r6("bias"), "n", "hits")


@query("duplicated_keys", "SELECT s_nationkey, s_suppkey, count(*) OVER (PARTITION BY s_nationkey) > 1 AS duplicated FROM supplier")
def duplicated_keys(spark: SparkSession, d: str) -> DataFrame:
    return rollup.duplicates(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"])


#: Days before a vote that are looked at, and days between the round before and the vote.
HORIZONS, BETWEEN = 20, 25


@query("horizon_errors", f"""WITH {POLLS}, {VALID}, {WEEKS}, vt AS (SELECT contest, vote_date - {BETWEEN} AS since, vote_date FROM vd WHERE contest > 1), k AS (SELECT contest, since, vote_date, CAST(unnest(range(1, {HORIZONS + 1})) AS INTEGER) AS days FROM vt),
m AS (SELECT va.*, k.contest * 100 + days AS run, datediff('day', end_date, k.vote_date) - days AS age, coalesce(quality, 1.0::DOUBLE) AS quality FROM va JOIN k ON end_date > since AND end_date BETWEEN k.vote_date - days - 14 AND k.vote_date - days LEFT JOIN qw ON qw.target = k.contest AND qw.house = va.house), {aggregate_sql('m', 'run', 5)}
SELECT CAST(run % 100 AS INTEGER) AS days, count(DISTINCT run) AS contests, round(avg(abs(estimate - result)), 6) AS mae, round(avg(abs(simple - result)), 6) AS mae_simple, count(*) AS n FROM ag JOIN rw ON rw.contest = run // 100 AND rw.candidate = ag.candidate GROUP BY run % 100""")
def horizon_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error of the aggregate by days before the vote: polls since the round before, weights from the contests that had ended; all contests and horizons are keys of one job."""
    _, res, quality = weekly(spark, d)
    res = written(res, "results")
    votes_ = res.where("contest > 1").select("contest", F.date_sub("vote_date", BETWEEN).alias("since"), "vote_date").distinct()
    known = poll_ops.before_votes(valid(spark, d), votes_, HORIZONS, 14)
    est = poll_ops.aggregate(known, quality, poll_ops.PollSettings(14, 3.0, 1500.0, 2.0, 5), ["contest", "days"])
    out = poll_ops.backtest(est, res, ["contest"], ["days", "contest"])
    total = lambda c: r6(F.sum(F.col(c) * F.col("n")) / F.sum("n"), c)
    return out.groupBy("days").agg(F.count("*").alias("contests"), total("mae"), total("mae_simple"), F.sum("n").alias("n"))
