"""Queries over scenarios, polls, transfer matrices, places and live counts."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maths import normal, normal_sql, share, student_t_sql, uniform, uniform_part_sql, uniform_sql
from ..operators import dims, polls as poll_ops, rollup, scenario, spatial, transfer, units
from ..streaming import live
from .bindings import POINTS, POLLS, VOTES, place_sums, points, polls, query, r6, scratch, table, votes
from .votes import FAMILY, GROUP_SQL, GROUPS, assigned_families

# --- seats and scenarios -----------------------------------------------------

DHONDT = """el AS (SELECT *, CASE WHEN bool_or(votes >= 0.8 * tot / seats) OVER (PARTITION BY {k}) THEN votes >= 0.8 * tot / seats ELSE votes > 0 END AS ok FROM (SELECT *, sum(votes) OVER (PARTITION BY {k}) AS tot FROM base)),
q AS (SELECT {k}, list, d, row_number() OVER (PARTITION BY {k} ORDER BY votes / d DESC, list, d) AS r, seats FROM (SELECT *, unnest(range(1, seats + 1)) AS d FROM el WHERE ok)),
won AS (SELECT {k}, list, count(*) AS seats FROM q WHERE r <= seats GROUP BY ALL)"""


@query("dhondt_seats", f"""WITH {VOTES}, base AS (SELECT unit, year, party AS list, CAST(sum(votes) AS DOUBLE) AS votes, 8 + year % 7 AS seats FROM votes GROUP BY ALL), {DHONDT.format(k='unit, year')}
SELECT base.unit, base.year, base.list, CAST(base.votes AS BIGINT) AS votes, coalesce(won.seats, 0) AS seats FROM base LEFT JOIN won USING (unit, year, list)""")
def dhondt_seats(spark: SparkSession, d: str) -> DataFrame:
    v = rollup.total(votes(spark, d).withColumnRenamed("party", "list"), ["unit", "year", "list"], "votes")
    return scenario.allocate(v, ["unit", "year"], "list", "votes", 8 + F.col("year") % 7)


#: Simulations of seats, of single contests, and of national shares; bootstrap replicates; degrees of freedom of heavy-tailed shocks.
N_SIM, DRAWS, SWINGS, REPLICATES, NU = 1000, 2000, 20_000, 200, 5
SCENARIO_BASE = f"""b0 AS (SELECT unit, party AS list, 'f' || (CAST(substr(party, 7) AS INTEGER) + 1999) % 6 AS family, CAST(sum(votes) AS DOUBLE) AS v FROM votes WHERE year = 1999 GROUP BY ALL),
b AS (SELECT unit, list, family, v / sum(v) OVER (PARTITION BY unit) AS pct FROM b0), fam AS (SELECT unit, family, sum(pct) AS fb FROM b GROUP BY ALL), sims AS (SELECT unnest(range(0, {N_SIM})) AS sim),
mv AS (SELECT sim, unit, family, fb, CASE WHEN fb > 0 THEN greatest(fb + {normal_sql(42, 'sim', 'family', "'national'")} * 2 / 100 + {normal_sql(42, 'sim', 'unit', 'family', "'unit'")} * 5 / 100, 0) ELSE 0 END AS fn FROM fam, sims),
li AS (SELECT sim, unit, family, list, CASE WHEN fb > 0 THEN pct * fn / fb ELSE 0 END AS p FROM mv JOIN b USING (unit, family)),
base AS (SELECT sim, unit, family, list, p / sum(p) OVER (PARTITION BY sim, unit) AS votes, 10 AS seats FROM li), {DHONDT.format(k='sim, unit')},
seated AS (SELECT base.sim, base.unit, base.family, CAST(sum(coalesce(won.seats, 0)) AS BIGINT) AS seats FROM base LEFT JOIN won ON won.sim = base.sim AND won.unit = base.unit AND won.list = base.list GROUP BY ALL)"""


def scenario_rows(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).where("year = 1999")
    family = F.concat(F.lit("f"), (F.substring("party", 7, 9).cast("int") + 1999) % 6)
    base = v.groupBy("unit", F.col("party").alias("list"), family.alias("family")).agg(F.sum("votes").cast("double").alias("v"))
    base = rollup.share_of_group(base, "v", ["unit"], "pct").drop("v")
    noise = spark.createDataFrame([(f"f{i}", 5.0, 2.0) for i in range(6)], "family string, sigma_unit double, sigma_national double")
    seats = table(spark, d, "nation").select(F.col("n_name").alias("unit"), F.lit(10).alias("seats"))
    return scenario.list_scenarios(base, seats, noise, N_SIM, 42)


@query("scenario_seats", f"WITH {VOTES}, {SCENARIO_BASE} SELECT CAST(sim AS INTEGER) AS sim, unit, family, seats FROM seated")
def scenario_seats(spark: SparkSession, d: str) -> DataFrame:
    return scenario_rows(spark, d)


@query("scenario_summary", f"WITH {VOTES}, {SCENARIO_BASE}, t AS (SELECT sim, family, sum(seats) AS seats FROM seated GROUP BY ALL) SELECT family, round(avg(seats), 6) AS mean, round(quantile_cont(seats, 0.1), 6) AS p10, round(quantile_cont(seats, 0.5), 6) AS p50, round(quantile_cont(seats, 0.9), 6) AS p90 FROM t GROUP BY family")
def scenario_summary(spark: SparkSession, d: str) -> DataFrame:
    return scenario.seat_summary(scenario_rows(spark, d)).select("family", *[r6(c) for c in ("mean", "p10", "p50", "p90")])


STRENGTH = f"""st AS (SELECT unit, 'f' || (CAST(substr(party, 7) AS INTEGER) + year) % 6 AS family, year, CAST(sum(votes) AS DOUBLE) AS v, count(DISTINCT party) AS parties FROM votes WHERE year = 1999 GROUP BY ALL),
strength AS (SELECT unit, family, v / sum(v) OVER (PARTITION BY unit) AS strength, 1 + parties % 2 AS n_cand FROM st)"""


def strength(spark: SparkSession, d: str) -> DataFrame:
    v = dims.families(votes(spark, d).where("year = 1999"), assigned_families(spark, d))
    s = v.groupBy("unit", "family").agg(F.sum("votes").cast("double").alias("v"), F.countDistinct("party").alias("parties"))
    return rollup.share_of_group(s, "v", ["unit"], "strength").select("unit", "family", "strength", (1 + F.col("parties") % 2).alias("n_cand"))


@query("two_winner_rule", f"""WITH {VOTES}, {STRENGTH}, e AS (SELECT unit, family, 1 AS entry, strength AS s FROM strength UNION ALL SELECT unit, family, 2, 0.6 * strength FROM strength WHERE n_cand >= 2),
w AS (SELECT *, s * exp(0.3 * {normal_sql(7, 'unit', 'family', 'entry')}) AS x FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, entry, family) AS r FROM w)
SELECT unit, family, CAST(sum(CAST(r <= 2 AS INTEGER)) AS BIGINT) AS seats FROM r GROUP BY ALL""")
def two_winner_rule(spark: SparkSession, d: str) -> DataFrame:
    return scenario.two_winner_rule(strength(spark, d), ["unit"], 0.6, effect=0.3 * normal(7, "unit", "family", "entry"))


ROUND = """v AS (SELECT *, sc / sum(sc) OVER (PARTITION BY {k}) AS v FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY v DESC, candidate) AS place FROM v),
t AS (SELECT *, v * exp({sb} * {zb}) AS s2 FROM r WHERE place <= 2),
res AS (SELECT {k}, max(v) <= 0.5 AS runoff, CASE WHEN max(v) <= 0.5 THEN arg_max(candidate, s2) ELSE arg_max(candidate, v) END AS winner FROM t GROUP BY {k})"""


@query("two_round_rule", f"""WITH {VOTES}, {STRENGTH}, sims AS (SELECT unnest(range(0, {DRAWS})) AS sim), scored AS (SELECT unit, sim, family AS candidate, strength * CASE WHEN n_cand = 2 THEN 1 ELSE 0.7 END * exp(0.4 * {normal_sql(11, 'unit', 'sim', 'family')} + 0.5 * CAST(family = 'f2' AS INTEGER)) AS sc FROM strength, sims),
{ROUND.format(k='unit, sim', sb='0.2', zb=normal_sql(11, 'unit', 'sim', 'place', "'runoff'"))} SELECT unit, CAST(sim AS INTEGER) AS sim, winner, runoff FROM res""")
def two_round_rule(spark: SparkSession, d: str) -> DataFrame:
    c = strength(spark, d).select("unit", F.col("family").alias("candidate"), "strength", (F.col("n_cand") == 2).alias("first"), (F.col("family") == "f2").alias("incumbent")).crossJoin(F.broadcast(scenario.sims(spark, DRAWS)))
    n = F.lit
    return scenario.two_round_rule(c, ["unit", "sim"], n(0.7), n(0.4), n(0.5), n(0.2), normal(11, "unit", "sim", "candidate"), normal(11, "unit", "sim", "place", F.lit("runoff")))


@query("grid_likelihood", f"""WITH {VOTES}, {STRENGTH}, grid AS (SELECT * FROM (VALUES (0.5), (0.8)) a(beta), (VALUES (0.2), (0.6)) b(sigma), (VALUES (0.0), (0.4)) c(delta), (VALUES (0.1)) e(sigma_runoff)), sims AS (SELECT unnest(range(0, {DRAWS})) AS sim),
ra AS (SELECT unit AS race, family AS candidate, family, strength, n_cand = 2 AS fst, family = 'f2' AS inc, first_value(family) OVER (PARTITION BY unit ORDER BY strength DESC, family) AS rf FROM strength),
scored AS (SELECT beta, sigma, delta, sigma_runoff, race, sim, candidate, strength * CASE WHEN fst THEN 1 ELSE beta END * exp(sigma * {normal_sql(5, 'race', 'sim', 'candidate')} + delta * CAST(inc AS INTEGER)) AS sc FROM ra, grid, sims),
{ROUND.format(k='beta, sigma, delta, sigma_runoff, race, sim', sb='sigma_runoff', zb=normal_sql(5, 'race', 'sim', 'place', "'runoff'"))},
p AS (SELECT beta, sigma, delta, sigma_runoff, res.race, avg(CAST(ra.family = ra.rf AND ra.inc = (ra.rf = 'f2') AND res.runoff = true AS INTEGER)) AS p FROM res JOIN ra ON ra.race = res.race AND ra.candidate = res.winner GROUP BY ALL)
SELECT CAST(beta AS DOUBLE) AS beta, CAST(sigma AS DOUBLE) AS sigma, CAST(delta AS DOUBLE) AS delta, CAST(sigma_runoff AS DOUBLE) AS sigma_runoff, round(sum(ln(p + 1.0::DOUBLE / {2 * DRAWS})), 6) AS log_likelihood FROM p GROUP BY ALL""")
def grid_likelihood(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([(b, s, e, 0.1) for b in (0.5, 0.8) for s in (0.2, 0.6) for e in (0.0, 0.4)], "beta double, sigma double, delta double, sigma_runoff double")
    return scenario.grid_likelihood(calibration_races(spark, d), grid, DRAWS, 5).withColumn("log_likelihood", r6("log_likelihood"))


def calibration_races(spark: SparkSession, d: str) -> DataFrame:
    """Every unit as a race with what happened in it."""
    top = F.first("family").over(Window.partitionBy("unit").orderBy(F.desc("strength"), "family"))
    races = strength(spark, d).select(F.col("unit").alias("race"), F.col("family").alias("candidate"), "family", "strength", (F.col("n_cand") == 2).alias("first"), (F.col("family") == "f2").alias("incumbent"), top.alias("real_family"))
    return races.withColumn("real_incumbent", F.col("real_family") == "f2").withColumn("real_runoff", F.lit(True))


#: The calibration grid, 3240 points.
BETAS = [0.1, 0.25, 0.5, 0.75, 1.0]
SIGMAS = [0.1, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5]
DELTAS = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5]
RUNOFF_SIGMAS = [0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5]


@query("grid_best_point")
def grid_best_point(spark: SparkSession, d: str) -> DataFrame:
    """The best point of the whole calibration grid over all races, and the parameters it has at the upper edge."""
    grid = spark.createDataFrame(list(product(BETAS, SIGMAS, DELTAS, RUNOFF_SIGMAS)), ", ".join(f"{c} double" for c in scenario.GRID))
    found = scenario.grid_likelihood(calibration_races(spark, d), grid, DRAWS, 5)
    return scenario.best_points(found).withColumn("log_likelihood", r6("log_likelihood"))


UNIT_SHARE = "us AS (SELECT unit, CAST(coalesce(sum(votes) FILTER (WHERE option IN ('PROMO', 'LARGE', 'SMALL')), 0) AS DOUBLE) / sum(votes) AS share, CAST(sum(votes) AS DOUBLE) AS weight FROM votes GROUP BY unit)"


def unit_share(spark: SparkSession, d: str) -> DataFrame:
    side = F.coalesce(F.sum(F.when(F.col("option").isin("PROMO", "LARGE", "SMALL"), F.col("votes"))), F.lit(0))
    return votes(spark, d).groupBy("unit").agg((side / F.sum("votes")).alias("share"), F.sum("votes").cast("double").alias("weight"))


@query("swing_scenarios", f"""WITH {VOTES}, {UNIT_SHARE}, sims AS (SELECT unnest(range(0, {SWINGS})) AS sim), p AS (SELECT sim, weight, least(greatest(share + {normal_sql(3, 'sim', "'national'")} * 0.02 + {normal_sql(3, 'sim', 'unit')} * 0.03, 0), 1) AS p FROM us, sims)
SELECT CAST(sim AS INTEGER) AS sim, round(sum(p * weight) / sum(weight), 6) AS share FROM p GROUP BY sim""")
def swing_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return scenario.swing_scenarios(unit_share(spark, d), SWINGS, 3, 0.03, 0.02).select("sim", r6("share"))


@query("win_probability", f"""WITH {VOTES}, {UNIT_SHARE}, sims AS (SELECT unnest(range(0, {SWINGS})) AS sim), nt AS (SELECT sim, {student_t_sql(9, NU, 'sim', "'national'")} AS shock FROM sims),
dr AS (SELECT unit, least(greatest(share + shock * 0.02 + {student_t_sql(9, NU, 'sim', 'unit')} * 0.03, 0), 1) AS p FROM us, nt)
SELECT unit, round(avg(CAST(p > 0.5 AS INTEGER)), 6) AS win, round(avg(p), 6) AS mean, """ + ", ".join(f"round(quantile_cont(p, {q}), 6) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM dr GROUP BY unit")
def win_probability(spark: SparkSession, d: str) -> DataFrame:
    return scenario.win_probability(scenario.student_scenarios(unit_share(spark, d), SWINGS, 9, NU, 0.03, 0.02), ["unit"]).select("unit", *[r6(c) for c in ("win", "mean", "p05", "p25", "p50", "p75", "p95")])


@query("pairing_scenarios", f"""WITH {POLLS}, f0 AS (SELECT candidate, avg(pct) AS x FROM polls GROUP BY 1), f AS (SELECT candidate, x / sum(x) OVER () AS share FROM f0), pr AS (SELECT a.candidate AS a, b.candidate AS b, 0.4 + 0.2 * {uniform_sql(1, 'a.candidate', 'b.candidate')} AS share_a FROM f a JOIN f b ON a.candidate < b.candidate),
dr AS (SELECT sim, candidate, share, {normal_sql(4, 'sim', 'candidate')} AS z FROM f, (SELECT unnest(range(0, {SWINGS})) AS sim)), rk AS (SELECT sim, candidate, z, greatest(share + 0.02 * z, 0) AS x, row_number() OVER (PARTITION BY sim ORDER BY greatest(share + 0.02 * z, 0) DESC, candidate) AS r FROM dr),
tw AS (SELECT o.sim, o.candidate AS one, t.candidate AS two, o.z AS z1, t.z AS z2 FROM rk o JOIN rk t ON o.sim = t.sim AND o.r = 1 AND t.r = 2),
ou AS (SELECT one, two, CASE WHEN one = a THEN share_a ELSE 1 - share_a END + (z1 - z2) * 0.03 / 2 + {normal_sql(4, 'sim', "'runoff'")} * 0.03 AS swing FROM tw JOIN pr ON a = least(one, two) AND b = greatest(one, two)), wn AS (SELECT CASE WHEN swing >= 0.5 THEN one ELSE two END AS winner FROM ou), c AS (SELECT winner, count(*) AS n FROM wn GROUP BY 1)
SELECT winner, n, round(n / sum(n) OVER (), 6) AS frequency FROM c""")
def pairing_scenarios(spark: SparkSession, d: str) -> DataFrame:
    first = polls(spark, d).groupBy("candidate").agg(F.avg("pct").alias("x"))
    first = rollup.share_of_group(first, "x", [], "share").select("candidate", "share")
    pairs = first.select(F.col("candidate").alias("a")).crossJoin(first.select(F.col("candidate").alias("b"))).where("a < b").withColumn("share_a", 0.4 + 0.2 * uniform(1, "a", "b"))
    out = scenario.pairing_scenarios(first, pairs, SWINGS, 4, F.lit(0.02), 0.03)
    return rollup.frequency(out, ["winner"]).withColumn("frequency", r6("frequency"))


@query("coalitions", """WITH s AS (SELECT p_type AS party, count(*) AS seats FROM part GROUP BY 1), c AS (SELECT party, CASE WHEN party < 'M' THEN 'left' ELSE 'right' END AS coalition, seats FROM s), k AS (SELECT coalition, CAST(sum(seats) AS BIGINT) AS seats FROM c GROUP BY 1), n AS (SELECT sum(seats) AS n FROM s)
SELECT coalition, threshold, seats, seats >= needed AS reached, CAST(greatest(needed - seats, 0) AS BIGINT) AS lacking FROM k, (SELECT 'half' AS threshold, n // 2 + 1 AS needed FROM n UNION ALL SELECT 'three fifths', CAST(ceil(n * 0.6) AS BIGINT) FROM n)""")
def coalitions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").groupBy(F.col("p_type").alias("party")).agg(F.count("*").alias("seats"))
    c = s.select("party", F.when(F.col("party") < "M", "left").otherwise("right").alias("coalition"))
    n = s.agg(F.sum("seats").alias("n"))
    t = n.select(F.explode(F.array(F.struct(F.lit("half").alias("threshold"), (F.floor(F.col("n") / 2) + 1).alias("needed")), F.struct(F.lit("three fifths").alias("threshold"), F.ceil(F.col("n") * F.lit(0.6)).alias("needed")))).alias("t")).select("t.*")
    return scenario.coalition_thresholds(s, c, t)


@query("beta_update", f"""WITH {VOTES}, g AS (SELECT unit, CAST(sum(votes) FILTER (WHERE option IN ('PROMO', 'LARGE')) AS DOUBLE) AS a, CAST(sum(votes) FILTER (WHERE option NOT IN ('PROMO', 'LARGE')) AS DOUBLE) AS b FROM votes GROUP BY unit),
p AS (SELECT unit, 0.3 * 20 + a / (a + b) * least(a + b, 500) AS alpha, 0.7 * 20 + b / (a + b) * least(a + b, 500) AS beta FROM g)
SELECT unit, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS mean, round(sqrt(alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1))), 6) AS sd FROM p""")
def beta_update(spark: SparkSession, d: str) -> DataFrame:
    side = F.col("option").isin("PROMO", "LARGE")
    g = votes(spark, d).groupBy("unit").agg(F.lit(0.3).alias("prior"), F.sum(F.when(side, F.col("votes"))).alias("side1"), F.sum(F.when(~side, F.col("votes"))).alias("side0"))
    return scenario.beta_update(g, 500).select("unit", r6("alpha"), r6("beta"), r6("mean"), r6("sd"))


# --- polls -------------------------------------------------------------------

VALID = "va AS (SELECT *, pct / sum(pct) OVER (PARTITION BY poll) AS share FROM polls)"
RESULTS = "re AS (SELECT candidate, avg(share) + CASE candidate WHEN 'click' THEN 0.01 ELSE -0.0025 END AS result FROM va GROUP BY candidate)"


def valid(spark: SparkSession, d: str) -> DataFrame:
    return poll_ops.valid_share(polls(spark, d))


def results(v: DataFrame) -> DataFrame:
    """A stand-in for the vote: mean shares moved by fixed amounts, on the last day."""
    return v.groupBy("candidate").agg((F.avg("share") + F.when(F.col("candidate") == "click", 0.01).otherwise(-0.0025)).alias("result")).withColumn("vote_date", F.lit("2024-01-31").cast("date")).withColumn("contest", F.lit(1))


@query("poll_valid_share", f"WITH {POLLS}, {VALID} SELECT poll, candidate, round(share, 6) AS share FROM va")
def poll_valid_share(spark: SparkSession, d: str) -> DataFrame:
    return valid(spark, d).select("poll", "candidate", r6("share"))


ERRORS = f"""le AS (SELECT * FROM re ORDER BY result DESC, candidate LIMIT 2), er AS (SELECT house, va.candidate, avg(share - result) AS error, count(*) AS n_polls FROM va JOIN le USING (candidate) WHERE end_date >= DATE '2024-01-31' - 10 GROUP BY ALL)"""


@query("house_error", f"WITH {POLLS}, {VALID}, {RESULTS}, {ERRORS} SELECT 1 AS contest, house, candidate, round(error, 6) AS error, n_polls FROM er")
def house_error(spark: SparkSession, d: str) -> DataFrame:
    v = valid(spark, d)
    return poll_ops.house_errors(v.withColumn("contest", F.lit(1)), results(v), ["contest"], 10).withColumn("error", r6("error"))


@query("track_record", f"""WITH {POLLS}, {VALID}, {RESULTS}, {ERRORS}, ob AS (SELECT house, avg(error * error) AS sq FROM er GROUP BY house), ind AS (SELECT avg(sq) AS i FROM ob)
SELECT house, CAST(1 AS BIGINT) AS contests, round(sqrt(sq), 6) AS rmse, round(sqrt((2 * i + sq) / 3), 6) AS rmse_shrunk, round(i / ((2 * i + sq) / 3), 6) AS quality FROM ob, ind""")
def track_record(spark: SparkSession, d: str) -> DataFrame:
    v = valid(spark, d)
    e = poll_ops.house_errors(v.withColumn("contest", F.lit(1)), results(v), ["contest"], 10)
    return poll_ops.track_record(e, 2, ["contest"]).select("house", "contests", r6("rmse"), r6("rmse_shrunk"), r6("quality"))


def aggregate(spark: SparkSession, d: str, days: list[str], settings: poll_ops.PollSettings) -> DataFrame:
    cut = spark.createDataFrame([(x,) for x in days], "cutoff string").select(F.col("cutoff").cast("date"))
    quality = spark.createDataFrame([(f"h{i}", 0.7 + 0.05 * i) for i in range(12)], "house string, quality double")
    return poll_ops.aggregate(poll_ops.at_cutoffs(valid(spark, d), cut, settings.window), quality, settings)


def aggregate_sql(polls_: str, key: str, iterations: int, half: float = 3.0, cap: int = 1500, shrink: float = 2.0) -> str:
    """Common tables of the aggregate over ``polls_`` (key, poll, house, age, sample, candidate, share, quality); the last, ``es``, has its sums."""
    tables = [
        f"b AS MATERIALIZED (SELECT *, quality * least(sample, {cap}) / {cap} AS base FROM {polls_})",
        f"u AS MATERIALIZED (SELECT DISTINCT {key}, poll, house, age, base FROM b)",
        f"nr AS MATERIALIZED (SELECT a.{key}, a.poll, o.poll AS other, 0.5 ** (abs(a.age - o.age) / {half}::DOUBLE) * o.base AS w FROM u a JOIN u o ON a.{key} = o.{key} AND a.house <> o.house)",
        f"ef0 AS (SELECT DISTINCT {key}, house, candidate, 0.0::DOUBLE AS effect FROM b)",
    ]
    for i in range(1, iterations + 1):
        tables += [
            f"fx{i} AS MATERIALIZED (SELECT b.{key}, b.poll AS other, b.candidate, share - effect AS x FROM b JOIN ef{i - 1} f ON f.{key} = b.{key} AND f.house = b.house AND f.candidate = b.candidate)",
            f"tr{i} AS MATERIALIZED (SELECT nr.{key}, nr.poll, f.candidate, sum(w * x) / sum(w) AS trend FROM nr JOIN fx{i} f ON f.{key} = nr.{key} AND f.other = nr.other GROUP BY ALL)",
            f"rs{i} AS (SELECT b.{key}, b.house, b.candidate, b.quality, b.share - coalesce(trend, b.share) AS r FROM b LEFT JOIN tr{i} t ON t.{key} = b.{key} AND t.poll = b.poll AND t.candidate = b.candidate)",
            f"en{i} AS (SELECT {key}, house, candidate, sum(r) / (count(*) + {shrink}::DOUBLE) AS e, max(quality) * count(*) AS anchor FROM rs{i} GROUP BY ALL)",
            f"ef{i} AS MATERIALIZED (SELECT {key}, house, candidate, e - sum(e * anchor) OVER (PARTITION BY {key}, candidate) / sum(anchor) OVER (PARTITION BY {key}, candidate) AS effect FROM en{i})",
        ]
    tables += [
        f"wt AS (SELECT b.*, effect, base * 0.5 ** (age / {half}::DOUBLE) AS w FROM b JOIN ef{iterations} f ON f.{key} = b.{key} AND f.house = b.house AND f.candidate = b.candidate)",
        f"es AS (SELECT {key}, candidate, greatest(sum(w * (share - effect)) / sum(w), 0) AS e, sum(w * share) / sum(w) AS u, avg(share) AS s, count(*) AS n_polls, sum(w) ** 2 / sum(w * w) AS n_effective FROM wt GROUP BY ALL)",
        f"ag AS (SELECT {key}, candidate, e / sum(e) OVER (PARTITION BY {key}) AS estimate, u / sum(u) OVER (PARTITION BY {key}) AS uncorrected, s / sum(s) OVER (PARTITION BY {key}) AS simple, n_polls, n_effective FROM es)",
    ]
    return ", ".join(tables)


def _daily(days: list[str]) -> str:
    rows = ", ".join(f"(DATE '{x}')" for x in days)
    return f"""k(cutoff) AS (VALUES {rows}), m AS (SELECT va.*, cutoff, datediff('day', end_date, cutoff) AS age, 0.7 + 0.05 * CAST(substr(house, 2) AS INTEGER) AS quality FROM va JOIN k ON end_date BETWEEN cutoff - 14 AND cutoff)"""


ROUNDED = "round(estimate, 6) AS estimate, round(uncorrected, 6) AS uncorrected, round(simple, 6) AS simple, n_polls, round(n_effective, 6) AS n_effective"
TREND_DAYS = [f"2024-01-{x:02d}" for x in range(16, 31)]


def aggregated(out: DataFrame, *keys: str) -> DataFrame:
    return out.select(*keys, "candidate", r6("estimate"), r6("uncorrected"), r6("simple"), "n_polls", r6("n_effective"))


@query("poll_aggregate", f"WITH {POLLS}, {VALID}, {_daily(['2024-01-20'])}, {aggregate_sql('m', 'cutoff', 1)} SELECT candidate, {ROUNDED} FROM ag")
def poll_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return aggregated(aggregate(spark, d, ["2024-01-20"], poll_ops.PollSettings(14, 3.0, 1500.0, 2.0, 1)))


@query("poll_daily_trend", f"WITH {POLLS}, {VALID}, {_daily(TREND_DAYS)}, {aggregate_sql('m', 'cutoff', 5)} SELECT cutoff, candidate, {ROUNDED} FROM ag")
def poll_daily_trend(spark: SparkSession, d: str) -> DataFrame:
    return aggregated(aggregate(spark, d, TREND_DAYS, poll_ops.PollSettings(14, 3.0, 1500.0, 2.0, 5)), "cutoff")


#: Four contests, a week each but for the last: their polls, results that differ from the mean of these by fixed amounts, and errors of the two leaders.
WEEKS = """wk AS (SELECT *, CAST(least((day(end_date) + 6) // 7, 4) AS INTEGER) AS contest FROM va), vd AS (SELECT contest, max(end_date) AS vote_date FROM wk GROUP BY contest),
rw AS (SELECT contest, candidate, m + CASE WHEN candidate = 'click' THEN 0.01 ELSE -0.0025 END * contest AS result FROM (SELECT contest, candidate, avg(share) AS m FROM wk GROUP BY ALL)),
lw AS (SELECT contest, candidate, result FROM rw QUALIFY row_number() OVER (PARTITION BY contest ORDER BY result DESC, candidate) <= 2),
ew AS (SELECT contest, house, candidate, avg(share - result) AS error FROM wk JOIN lw USING (contest, candidate) GROUP BY ALL), ow AS (SELECT contest, house, avg(error * error) AS sq FROM ew GROUP BY ALL),
ta(target) AS (VALUES (2), (3), (4)), iw AS (SELECT target, avg(sq) AS i FROM ow JOIN ta ON contest < target GROUP BY target), qs AS (SELECT target, house, sum(sq) AS s, count(*) AS n FROM ow JOIN ta ON contest < target GROUP BY ALL),
qw AS (SELECT qs.target, house, i / ((2 * i + s) / (2 + n)) AS quality FROM qs JOIN iw USING (target))"""


def weekly(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Polls by contest, results, and the quality of houses from the contests before each."""
    v = valid(spark, d).withColumn("contest", F.least(F.floor((F.dayofmonth("end_date") + 6) / 7), F.lit(4)).cast("int"))
    days = v.groupBy("contest").agg(F.max("end_date").alias("vote_date"))
    moved = F.when(F.col("candidate") == "click", 0.01).otherwise(-0.0025) * F.col("contest")
    res = v.groupBy("contest", "candidate").agg(F.avg("share").alias("m")).select("contest", "candidate", (F.col("m") + moved).alias("result")).join(F.broadcast(days), "contest")
    errors = poll_ops.house_errors(v, res, ["contest"], 60)
    return v, res, poll_ops.rolling_quality(errors, 2, "contest", 4)


@query("rolling_record", f"WITH {POLLS}, {VALID}, {WEEKS} SELECT target AS contest, house, round(quality, 6) AS quality FROM qw")
def rolling_record(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d)[2].withColumn("quality", r6("quality"))


@query("poll_backtest", f"""WITH {POLLS}, {VALID}, {WEEKS}, m AS (SELECT wk.*, datediff('day', end_date, vote_date) AS age, coalesce(quality, 1.0::DOUBLE) AS quality FROM wk JOIN vd USING (contest) LEFT JOIN qw ON qw.target = wk.contest AND qw.house = wk.house), {aggregate_sql('m', 'contest', 5)},
sg AS (SELECT contest, avg(abs(share - result)) AS mae_single FROM wk JOIN rw USING (contest, candidate) GROUP BY contest)
SELECT contest, round(avg(abs(estimate - result)), 6) AS mae, round(avg(abs(simple - result)), 6) AS mae_simple, round(any_value(mae_single), 6) AS mae_single, count(*) AS n FROM ag JOIN rw USING (contest, candidate) JOIN sg USING (contest) GROUP BY contest""")
def poll_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Every contest by the aggregate with weights from the earlier ones' record, against the simple mean and single polls."""
    v, res, quality = weekly(spark, d)
    aged = v.join(F.broadcast(res.select("contest", "vote_date").distinct()), "contest").withColumn("age", F.datediff("vote_date", "end_date"))
    est = poll_ops.aggregate(aged, quality, poll_ops.PollSettings(60, 3.0, 1500.0, 2.0, 5), ["contest"])
    single = v.join(F.broadcast(res), ["contest", "candidate"]).groupBy("contest").agg(r6(F.avg(F.abs(F.col("share") - F.col("result"))), "mae_single"))
    out = poll_ops.backtest(est, res, ["contest"], ["contest"])
    return out.select("contest", r6("mae"), r6("mae_simple"), "n").join(single, "contest")


@query("main_scenario", f"""WITH {POLLS}, sc AS (SELECT *, CASE WHEN CAST(substr(house, 2) AS INTEGER) % 3 = 0 THEN 's1' ELSE 's2' END AS scenario FROM polls), n AS (SELECT candidate, scenario, count(DISTINCT poll) AS n FROM sc GROUP BY ALL), b AS (SELECT candidate, scenario FROM n QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY n DESC, scenario) = 1)
SELECT sc.candidate, sc.scenario, count(*) AS n FROM sc JOIN b ON b.candidate = sc.candidate AND b.scenario = sc.scenario GROUP BY ALL""")
def main_scenario(spark: SparkSession, d: str) -> DataFrame:
    p = polls(spark, d).withColumn("scenario", F.when(F.substring("house", 2, 9).cast("int") % 3 == 0, "s1").otherwise("s2"))
    return poll_ops.main_scenario(p, ["candidate"]).groupBy("candidate", "scenario").agg(F.count("*").alias("n"))


@query("error_calibration", f"WITH {POLLS}, {VALID}, {RESULTS}, e AS (SELECT house, share - result AS e, result FROM va JOIN re USING (candidate)) SELECT house, round(sqrt(avg(e * e)), 6) AS rms, round(avg(e), 6) AS bias, round(sqrt(avg(e * e / (result * (1 - result)))), 6) AS relative, count(*) AS n, min(sign(e)) = max(sign(e)) AS same_sign FROM e GROUP BY house")
def error_calibration(spark: SparkSession, d: str) -> DataFrame:
    v = valid(spark, d)
    e = v.join(F.broadcast(results(v)), "candidate").withColumn("error", F.col("share") - F.col("result"))
    rule = poll_ops.bias_rule(e, ["house"]).select("house", "same_sign")
    return poll_ops.error_calibration(e, ["house"]).join(rule, "house").select("house", r6("rms"), r6("bias"), r6("relative"), "n", "same_sign")


@query("share_trend", f"""WITH {POLLS}, {VALID}, f AS (SELECT candidate, CAST(day(end_date) AS DOUBLE) AS x, share AS y, CAST(sample AS DOUBLE) AS w FROM va), m AS (SELECT candidate, sum(x * w) / sum(w) AS mx, sum(y * w) / sum(w) AS my, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT candidate, sum(w * (x - mx) ** 2) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM f JOIN m USING (candidate) GROUP BY 1), k AS (SELECT candidate, sum((w * (x - mx) * (y - my - sxy / sxx * (x - mx))) ** 2) AS meat FROM f JOIN m USING (candidate) JOIN s USING (candidate) GROUP BY 1)
SELECT candidate, round(sxy / sxx, 6) AS slope, round(my - sxy / sxx * mx, 6) AS intercept, round(sqrt(meat * n / (n - 2)) / sxx, 6) AS se, n FROM m JOIN s USING (candidate) JOIN k USING (candidate)""")
def share_trend(spark: SparkSession, d: str) -> DataFrame:
    f = valid(spark, d).select("candidate", F.dayofmonth("end_date").cast("double").alias("x"), F.col("share").alias("y"), F.col("sample").cast("double").alias("w"))
    return poll_ops.trend(f, ["candidate"], "x", "y", "w").select("candidate", r6("slope"), r6("intercept"), r6("se"), "n")


# --- transfer ----------------------------------------------------------------

ORIGINS, DESTS = ["a_1", "b_1", "blank_1", "otros_1"], ["a_2", "b_2", "blank_2", "otros_2"]
PLACE = f"""gv AS (SELECT unit, segment, place, round, {GROUP_SQL} AS grp, sum(votes) AS v FROM votes GROUP BY ALL),
wd AS (SELECT unit, segment, place, """ + ", ".join(f"coalesce(sum(v) FILTER (WHERE round = {r} AND grp = '{g}'), 0) AS {g}_{r}" for r in (1, 2) for g in ("a", "b", "blank", "otros")) + """ FROM gv GROUP BY ALL),
pl AS (SELECT unit, place, """ + ", ".join(f"CAST({c} AS DOUBLE) / (a_{c[-1]} + b_{c[-1]} + blank_{c[-1]} + otros_{c[-1]}) AS {c}" for c in ORIGINS + DESTS) + """, CAST(a_1 + b_1 + blank_1 + otros_1 AS DOUBLE) AS w FROM wd WHERE a_1 + b_1 + blank_1 + otros_1 > 0 AND a_2 + b_2 + blank_2 + otros_2 > 0)"""


def place_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per place: votes of each group in both rounds, null where it has no line."""
    grp = F.coalesce(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[F.col("option")], F.lit("otros"))
    sums = {c: F.sum(F.when((F.col("round") == int(c[-1])) & (grp == c[:-2]), F.coalesce("votes", F.lit(0)))) for c in ORIGINS + DESTS}
    return place_sums(spark, d, sums).dropna(subset=["unit", "segment", "place"])


def first_round(spark: SparkSession, d: str, name: str = "origin") -> DataFrame:
    """Votes of each unit's groups in the first round: (unit, ``name``, votes)."""
    sums = place_groups(spark, d).groupBy("unit").agg(*[F.sum(c).alias(c) for c in ORIGINS])
    return sums.unpivot(["unit"], ORIGINS, name, "votes").where("votes is not null")


def place_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Per place: shares of each group in both rounds, and the first round's votes as weight."""
    w = place_groups(spark, d).select("region", "unit", "place", *[F.coalesce(c, F.lit(0)).alias(c) for c in ORIGINS + DESTS])
    t1, t2 = sum((F.col(c) for c in ORIGINS), F.lit(0)), sum((F.col(c) for c in DESTS), F.lit(0))
    return w.withColumn("t1", t1).withColumn("t2", t2).where("t1 > 0 and t2 > 0").select("unit", "place", *[(F.col(c) / F.col(f"t{c[-1]}")).alias(c) for c in ORIGINS + DESTS], F.col("t1").cast("double").alias("w"))


@query("transfer_gram", f"WITH {VOTES}, {PLACE} SELECT unit, round(sum(w * a_1 * a_1), 4) AS x00, round(sum(w * a_1 * b_1), 4) AS x01, round(sum(w * otros_1 * otros_1), 4) AS x33, round(sum(w * a_1 * a_2), 4) AS y00, round(sum(w * otros_1 * blank_2), 4) AS y32, count(*) AS n FROM pl GROUP BY unit")
def transfer_gram(spark: SparkSession, d: str) -> DataFrame:
    g = transfer.gram(place_rounds(spark, d), ["unit"], ORIGINS, DESTS, "w")
    at = lambda c, i, n: F.round(F.col(c)[i], 4).alias(n)
    return g.select("unit", at("xx", 0, "x00"), at("xx", 1, "x01"), at("xx", 15, "x33"), at("xy", 0, "y00"), at("xy", 14, "y32"), "n")


def matrices(spark: SparkSession, d: str) -> DataFrame:
    return transfer.transfer_matrix(transfer.gram(place_rounds(spark, d), ["unit"], ORIGINS, DESTS, "w"), ["unit"], ORIGINS, DESTS)


@query("transfer_matrix")
def transfer_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrices(spark, d).withColumn("p", r6("p"))


@query("origin_matrix")
def origin_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = place_rounds(spark, d)
    regions = place_groups(spark, d).select("unit", "region").distinct()
    parent = transfer.transfer_matrix(transfer.gram(p.join(F.broadcast(regions), "unit"), ["region"], ORIGINS, DESTS, "w"), ["region"], ORIGINS, DESTS)
    return transfer.with_fallback(matrices(spark, d), parent, regions, "unit", "region", 40).withColumn("p", r6("p"))


PAIRS = ", ".join(f"('{o}', '{t}', {p})" for o, row in {"a": (0.9, 0.05, 0.03, 0.02), "b": (0.1, 0.8, 0.05, 0.05), "blank": (0.2, 0.2, 0.5, 0.1), "otros": (0.4, 0.35, 0.15, 0.1)}.items() for t, p in zip(("a", "b", "blank", "gone"), row))


@query("second_round_prediction", f"""WITH {VOTES}, m(o, dst, p) AS (VALUES {PAIRS}), g AS (SELECT unit, {GROUP_SQL} AS grp, CAST(sum(votes) AS DOUBLE) AS v FROM votes WHERE round = 1 GROUP BY ALL),
p AS (SELECT unit, dst, sum(v * p) AS votes FROM g JOIN m ON m.o = g.grp GROUP BY ALL) SELECT unit, dst AS dest, round(votes, 6) AS votes FROM p""")
def second_round_prediction(spark: SparkSession, d: str) -> DataFrame:
    g = first_round(spark, d, "grp").withColumn("grp", F.regexp_replace("grp", "_1$", ""))
    rows = {"a": (0.9, 0.05, 0.03, 0.02), "b": (0.1, 0.8, 0.05, 0.05), "blank": (0.2, 0.2, 0.5, 0.1), "otros": (0.4, 0.35, 0.15, 0.1)}
    flat = spark.createDataFrame([(o, t, p) for o, r in rows.items() for t, p in zip(("a", "b", "blank", "gone"), r)], "origin string, dest string, p double")
    m = table(spark, d, "nation").select(F.col("n_name").alias("unit")).crossJoin(F.broadcast(flat))
    like = spark.createDataFrame([("otros", "otros")], "grp string, like string")
    return transfer.second_round(g, m, like, None, ("a", "b"), ("blank", "gone"), "unit").withColumn("votes", r6("votes"))


@query("origin_cells")
def origin_cells(spark: SparkSession, d: str) -> DataFrame:
    now = place_groups(spark, d).where("otros_2 is not null").groupBy("unit", "place").agg(F.sum("otros_2").cast("double").alias("votes")).withColumn("third", F.lit("otros_2"))
    before = place_rounds(spark, d).unpivot(["place"], ORIGINS, "origin", "share")
    return transfer.origin_cells(now, before, matrices(spark, d).select("unit", "origin", "dest", "p"), "unit", "place").withColumn("votes", r6("votes"))


@query("bootstrap_gram", f"""WITH {VOTES}, {PLACE}, reps AS (SELECT unnest(range(0, {REPLICATES})) AS replicate), dr AS (SELECT *, {uniform_sql(17, 'replicate', 'place')} AS u FROM pl, reps),
tm AS (SELECT *, CAST(u > 0.36787944117144233 AS INTEGER) + CAST(u > 0.7357588823428847 AS INTEGER) + CAST(u > 0.9196986029286058 AS INTEGER) + CAST(u > 0.9810118431238462 AS INTEGER) + CAST(u > 0.9963401531726563 AS INTEGER) + CAST(u > 0.9994058151824183 AS INTEGER) + CAST(u > 0.999916758850712 AS INTEGER) + CAST(u > 0.9999897508033253 AS INTEGER) AS t FROM dr)
SELECT CAST(replicate AS INTEGER) AS replicate, unit, round(sum(t * w * a_1 * a_1), 4) AS x00, round(sum(t * w * b_1 * a_2), 4) AS y10, count(*) AS n FROM tm WHERE t > 0 GROUP BY ALL""")
def bootstrap_gram(spark: SparkSession, d: str) -> DataFrame:
    g = transfer.bootstrap_gram(place_rounds(spark, d), ["unit"], ["place"], ORIGINS, DESTS, "w", REPLICATES, 17)
    return g.select("replicate", "unit", F.round(F.col("xx")[0], 4).alias("x00"), F.round(F.col("xy")[4], 4).alias("y10"), "n")


@query("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """The first side's share, with matrices estimated again in every replicate: mean, deviation and the middle 90 %."""
    g = transfer.bootstrap_gram(place_rounds(spark, d), ["unit"], ["place"], ORIGINS, DESTS, "w", REPLICATES, 17)
    own = transfer.transfer_matrix(g, ["replicate", "unit"], ORIGINS, DESTS)
    mass = first_round(spark, d)
    out = transfer.bootstrap_interval(own, mass, ["unit"], ("a_2", "b_2"))
    return out.select("replicates", *[r6(c) for c in ("mean", "sd", "low", "high")])


@query("wls_slope", f"WITH {VOTES}, {PLACE} SELECT unit, round(regr_slope(a_2, a_1), 5) AS coef, round(regr_r2(a_2, a_1), 5) AS r2, count(*) AS n FROM pl GROUP BY unit")
def wls_slope(spark: SparkSession, d: str) -> DataFrame:
    f = transfer.least_squares(place_rounds(spark, d).withColumn("one", F.lit(1.0)), ["unit"], ["a_1"], "a_2", "one")
    return f.where("term = 'a_1'").select("unit", F.round("coef", 5).alias("coef"), F.round("r2", 5).alias("r2"), "n")


_FE = "{c} - sum(w * {c}) OVER (PARTITION BY unit) / sum(w) OVER (PARTITION BY unit)"


@query("wls_fixed_effects", f"""WITH {VOTES}, {PLACE}, fe AS (SELECT unit, w, {_FE.format(c='a_1')} AS x1, {_FE.format(c='b_1')} AS x2, {_FE.format(c='a_2')} AS y FROM pl),
g AS (SELECT sum(w * x1 * x1) AS s11, sum(w * x1 * x2) AS s12, sum(w * x2 * x2) AS s22, sum(w * x1 * y) AS t1, sum(w * x2 * y) AS t2, sum(w * y * y) AS yy, count(*) AS n, count(DISTINCT unit) AS lost FROM fe),
c AS (SELECT *, s22 / (s11 * s22 - s12 ** 2) AS i11, -s12 / (s11 * s22 - s12 ** 2) AS i12, s11 / (s11 * s22 - s12 ** 2) AS i22 FROM g), f AS (SELECT *, i11 * t1 + i12 * t2 AS b1, i12 * t1 + i22 * t2 AS b2 FROM c),
m AS (SELECT sum((w * (y - b1 * x1 - b2 * x2)) ** 2 * x1 * x1) AS m11, sum((w * (y - b1 * x1 - b2 * x2)) ** 2 * x1 * x2) AS m12, sum((w * (y - b1 * x1 - b2 * x2)) ** 2 * x2 * x2) AS m22 FROM fe, f),
o AS (SELECT *, n / (n - 2.0::DOUBLE - lost) AS free, 1 - (yy - b1 * t1 - b2 * t2) / yy AS r2 FROM f, m)
SELECT 'a_1' AS term, round(b1, 5) AS coef, round(sqrt((i11 ** 2 * m11 + 2 * i11 * i12 * m12 + i12 ** 2 * m22) * free), 5) AS se, round(r2, 5) AS r2, n FROM o
UNION ALL SELECT 'b_1', round(b2, 5), round(sqrt((i12 ** 2 * m11 + 2 * i12 * i22 * m12 + i22 ** 2 * m22) * free), 5), round(r2, 5), n FROM o""")
def wls_fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    f = transfer.least_squares(place_rounds(spark, d), [], ["a_1", "b_1"], "a_2", "w", effects="unit")
    return f.select("term", *[F.round(c, 5).alias(c) for c in ("coef", "se", "r2")], "n")


# --- places ------------------------------------------------------------------

SECTORS = "se AS (SELECT * FROM points WHERE point % 4 <> 0), ps AS (SELECT * FROM points WHERE point % 4 = 0)"
NEAR = """nr AS (SELECT se.unit, se.point AS sector, arg_min(ps.point, struct_pack(a := sqrt(((se.lat - ps.lat) * 111.32) ** 2 + ((se.lon - ps.lon) * 111.32 * cos(radians(se.lat))) ** 2), b := ps.point)) AS place,
min(sqrt(((se.lat - ps.lat) * 111.32) ** 2 + ((se.lon - ps.lon) * 111.32 * cos(radians(se.lat))) ** 2)) AS km FROM se JOIN ps ON se.unit = ps.unit GROUP BY ALL)"""


def nearest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    sectors = p.where("point % 4 <> 0").withColumnRenamed("point", "sector")
    return sectors, spatial.nearest_place(sectors, p.where("point % 4 = 0").withColumnRenamed("point", "place"), "unit")


@query("nearest_place", f"WITH {POINTS}, {SECTORS}, {NEAR} SELECT unit, sector, place, round(km, 6) AS km FROM nr")
def nearest_place(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d)[1].withColumn("km", r6("km"))


@query("place_covariates", f"WITH {POINTS}, {SECTORS}, {NEAR} SELECT nr.place, CAST(sum(electors) AS BIGINT) AS electors, CAST(sum(electors % 7) AS BIGINT) AS young, round(sum(electors % 7) / sum(electors), 6) AS young_share FROM se JOIN nr ON se.unit = nr.unit AND se.point = nr.sector GROUP BY nr.place")
def place_covariates(spark: SparkSession, d: str) -> DataFrame:
    s, near = nearest(spark, d)
    return spatial.place_covariates(s.withColumn("young", F.col("electors") % 7), near, ["unit", "sector"], ["young"], "electors").withColumn("young_share", r6("young_share"))


@query("mean_distance", f"""WITH {POINTS}, {SECTORS}, {NEAR}, j AS (SELECT nr.place, se.electors, 2 * 6371.0::DOUBLE * asin(sqrt(least(sin((radians(ps.lat) - radians(se.lat)) / 2) ** 2 + cos(radians(se.lat)) * cos(radians(ps.lat)) * sin((radians(ps.lon) - radians(se.lon)) / 2) ** 2, 1))) AS km
FROM se JOIN nr ON se.unit = nr.unit AND se.point = nr.sector JOIN ps ON ps.point = nr.place) SELECT place, round(sum(km * electors) / sum(electors), 6) AS mean_km FROM j GROUP BY place""")
def mean_distance(spark: SparkSession, d: str) -> DataFrame:
    s, near = nearest(spark, d)
    at = points(spark, d).select(F.col("point").alias("place"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"))
    return spatial.mean_distance(s.join(near, ["unit", "sector"]).join(at, "place"), ["place"], "electors").withColumn("mean_km", r6("mean_km"))


@query("point_in_polygon", f"""WITH {POINTS}, tri AS (SELECT unit AS polygon, min(lon) - 0.1 AS x0, max(lon) + 0.1 AS x1, min(lat) - 0.1 AS y0, max(lat) + 0.1 AS y1 FROM points GROUP BY unit),
ed AS (SELECT polygon, x0 AS x1, y0 AS y1, x1 AS x2, y0 + 0.01 AS y2 FROM tri UNION ALL SELECT polygon, x1, y0 + 0.01, x0, y1 FROM tri UNION ALL SELECT polygon, x0, y1, x0, y0 FROM tri),
h AS (SELECT p.point, e.polygon FROM points p JOIN ed e ON e.y1 <> e.y2 AND p.lat >= least(e.y1, e.y2) AND p.lat < greatest(e.y1, e.y2) AND p.lon < e.x1 + (p.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1))
SELECT point, polygon FROM h GROUP BY ALL HAVING count(*) % 2 = 1""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    t = p.groupBy(F.col("unit").alias("polygon")).agg((F.min("lon") - 0.1).alias("a"), (F.max("lon") + 0.1).alias("b"), (F.min("lat") - 0.1).alias("c"), (F.max("lat") + 0.1).alias("e"))
    edge = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    a, b, c, e = (F.col(x) for x in "abce")
    edges = t.select("polygon", F.explode(F.array(edge(a, c, b, c + 0.01), edge(b, c + 0.01, a, e), edge(a, e, a, c))).alias("s")).select("polygon", "s.*")
    return spatial.point_in_polygon(p.select("point", F.col("lon").alias("x"), F.col("lat").alias("y")), edges, cell=2.0)


NODES = f"""nd AS (SELECT o_custkey AS node, avg(o_totalprice) AS x FROM orders GROUP BY 1), sz AS (SELECT count(*) AS size FROM customer), eg AS (SELECT node AS src, (node + k + size) % size AS dst FROM nd, sz, (VALUES (1), (3), (-3), (-1)) t(k)), ee AS (SELECT DISTINCT src, dst FROM eg WHERE dst IN (SELECT node FROM nd)), mm AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM nd)"""


def nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A ring of all customers, each next to four others."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.avg("o_totalprice").alias("x"))
    size = table(spark, d, "customer").count()
    e = n.select(F.col("node").alias("src"), F.explode(F.array(*[(F.col("node") + k + size) % size for k in (1, 3, -3, -1)])).alias("dst"))
    return n, e.join(n.select(F.col("node").alias("dst")), "dst", "left_semi").distinct()


@query("moran", f"WITH {NODES}, lg AS (SELECT src, avg(x - m) AS lag FROM ee JOIN nd ON nd.node = ee.dst, mm GROUP BY src) SELECT round(sum((x - m) * lag) * count(*) / (sum((x - m) ** 2) * count(lag)), 6) AS moran_i, count(*) AS n FROM nd LEFT JOIN lg ON lg.src = nd.node, mm")
def moran(spark: SparkSession, d: str) -> DataFrame:
    return spatial.moran(*nodes(spark, d)).select(r6("moran_i"), "n")


PERMUTATIONS, SIGNIFICANCE = 999, 0.01
Z = "zz AS (SELECT node, (x - m) / s AS z FROM nd, mm), n AS (SELECT count(*) AS n FROM nd), ps AS (SELECT row_number() OVER (ORDER BY node) - 1 AS pos, z AS zp FROM zz)"


def _permuted(seed: int, edges: str, own: str, statistic: str, draw: str) -> str:
    """Common tables ``pp`` (node, z, lag, statistic, p) of a conditional permutation test."""
    return f"""lg AS (SELECT src, avg(z) AS lag, count(*) AS deg FROM {edges} JOIN zz ON zz.node = dst GROUP BY src), ba AS (SELECT zz.node AS src, z, lag, deg, {own} AS statistic FROM zz JOIN lg ON lg.src = zz.node),
fa AS (SELECT src, z, statistic, perm, unnest(range(1, deg + 1)) AS slot FROM ba, (SELECT unnest(range(0, {PERMUTATIONS})) AS perm)), dw AS (SELECT src, perm, avg({draw}) AS plag, any_value(z) AS z, any_value(statistic) AS statistic
FROM (SELECT *, CAST(floor({uniform_part_sql(seed, "(slot - 1) % 4", "perm", "src", "(slot - 1) // 4")} * n) AS BIGINT) AS pos FROM fa, n) JOIN ps USING (pos) GROUP BY src, perm),
ct AS (SELECT src, sum(CAST({statistic} >= statistic AS INTEGER)) AS above, sum(CAST({statistic} <= statistic AS INTEGER)) AS below FROM dw GROUP BY src),
pp AS (SELECT ba.src AS node, z, lag, statistic, (least(above, below) + 1) / {PERMUTATIONS + 1}.0::DOUBLE AS p FROM ba JOIN ct ON ct.src = ba.src)"""


MORAN = _permuted(1, "(SELECT * FROM ee WHERE src <> dst)", "z * lag", "z * plag", "zp")
MORAN_CLUSTER = f"CASE WHEN p > {SIGNIFICANCE} THEN 'none' WHEN z > 0 AND lag > 0 THEN 'high-high' WHEN z <= 0 AND lag <= 0 THEN 'low-low' WHEN z > 0 THEN 'high-low' ELSE 'low-high' END"
STAR = _permuted(2, "(SELECT * FROM ee WHERE src <> dst UNION ALL SELECT node, node FROM nd)", "lag", "plag", "CASE WHEN slot = 1 THEN z ELSE zp END")


@query("local_moran", f"WITH {NODES}, {Z}, {MORAN} SELECT node, round(z, 6) AS z, round(lag, 6) AS lag, round(statistic, 6) AS statistic, round(p, 6) AS p, {MORAN_CLUSTER} AS cluster FROM pp")
def local_moran(spark: SparkSession, d: str) -> DataFrame:
    return spatial.local_clusters(*nodes(spark, d), PERMUTATIONS, 1, SIGNIFICANCE).select("node", r6("z"), r6("lag"), r6("statistic"), r6("p"), "cluster")


@query("gi_star", f"WITH {NODES}, {Z}, {STAR} SELECT node, round(z, 6) AS z, round(lag, 6) AS lag, round(statistic, 6) AS statistic, round(p, 6) AS p, CASE WHEN p > {SIGNIFICANCE} THEN 'none' WHEN lag > 0 THEN 'high' ELSE 'low' END AS cluster FROM pp")
def gi_star(spark: SparkSession, d: str) -> DataFrame:
    return spatial.local_clusters(*nodes(spark, d), PERMUTATIONS, 2, SIGNIFICANCE, star=True).select("node", r6("z"), r6("lag"), r6("statistic"), r6("p"), "cluster")


@query("cluster_labels", f"WITH {NODES}, {Z}, {MORAN}, l AS (SELECT {MORAN_CLUSTER} AS cluster, count(*) AS n FROM pp GROUP BY 1) SELECT cluster, n, round(n / sum(n) OVER (), 6) AS part FROM l")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.local_clusters(*nodes(spark, d), PERMUTATIONS, 1, SIGNIFICANCE)
    return rollup.frequency(found, ["cluster"]).select("cluster", "n", r6("frequency", "part"))


@query("local_regression")
def local_regression(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(F.col("point").alias("node"), F.col("lon").alias("px"), F.col("lat").alias("py"), "v1", "v2", "v3")
    out = spatial.local_regression(p, ["v1", "v2"], "v3", 30, 2.0)
    return out.select("node", "term", *[F.round(c, 4).alias(c) for c in ("coef", "local_r2")], "n")


@query("local_regression_k")
def local_regression_k(spark: SparkSession, d: str) -> DataFrame:
    """The information criterion of every number of neighbours of a grid, and which one is chosen."""
    p = points(spark, d).select(F.col("point").alias("node"), F.col("lon").alias("px"), F.col("lat").alias("py"), "v1", "v2", "v3")
    return spatial.bandwidths(p, ["v1", "v2"], "v3", range(15, 91, 5), 2.0).withColumn("aicc", r6("aicc"))


@query("kmeans_profile")
def kmeans_profile(spark: SparkSession, d: str) -> DataFrame:
    """Four types of points by their standardised covariates, sorted by mean of the first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    p = points(spark, d)
    x = VectorAssembler(inputCols=["v1", "v2", "v3"], outputCol="raw").transform(p)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    k = KMeans(k=4, seed=7, initSteps=5).fit(x).transform(x)
    means = k.groupBy("prediction").agg(F.count("*").alias("n"), *[r6(F.avg(c), c) for c in ("v1", "v2", "v3")])
    return means.withColumn("type", F.row_number().over(Window.orderBy("v1"))).drop("prediction")


# --- live counts -------------------------------------------------------------

COUNTS = """ct AS (SELECT user_id % 200 AS code, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 100 ELSE 40 END) AS BIGINT) AS side1, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 40 ELSE 90 END) AS BIGINT) AS side0, count(*) AS m FROM events GROUP BY 1),
cn AS (SELECT code, side1, side0, CASE WHEN code % 5 = 0 THEN 0.0::DOUBLE ELSE least(m / 60.0::DOUBLE, 1) END AS pct FROM ct),
fc AS (SELECT c_custkey % 200 AS code, min(c_nationkey) AS unit, min(c_nationkey) % 5 AS region, CAST(9000 + (c_custkey % 200) * 10 AS DOUBLE) AS valid, 0.4::DOUBLE + (c_custkey % 200) % 20 / 100.0::DOUBLE AS p FROM customer GROUP BY c_custkey % 200)"""


def forecast(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("code"), "c_nationkey")
    g = c.groupBy("code").agg(F.min("c_nationkey").alias("unit"))
    return g.select("code", "unit", (F.col("unit") % 5).alias("region"), (9000 + F.col("code") * 10).cast("double").alias("valid"), (F.lit(0.4) + (F.col("code") % 20) / F.lit(100.0)).alias("p"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    one = F.col("event_type").isin("click", "view")
    e = table(spark, d, "events").groupBy((F.col("user_id") % 200).alias("code")).agg(F.sum(F.when(one, 100).otherwise(40)).alias("side1"), F.sum(F.when(one, 40).otherwise(90)).alias("side0"), F.count("*").alias("m"))
    return e.select("code", "side1", "side0", F.when(F.col("code") % 5 == 0, F.lit(0.0)).otherwise(F.least(F.col("m") / F.lit(60.0), F.lit(1.0))).alias("pct"))


@query("count_projection", f"WITH {COUNTS}, u AS (SELECT 'side1' AS option, side1 AS v, pct FROM cn UNION ALL SELECT 'side0', side0, pct FROM cn), s AS (SELECT option, sum(CASE WHEN pct > 0 THEN v * 100.0::DOUBLE / (pct * 100) ELSE 0 END) AS projected FROM u GROUP BY option) SELECT option, round(projected, 4) AS projected, round(projected / sum(projected) OVER (), 6) AS share FROM s")
def count_projection(spark: SparkSession, d: str) -> DataFrame:
    long = counts(spark, d).withColumn("pct", F.col("pct") * 100).unpivot(["code", "pct"], ["side1", "side0"], "option", "v")
    return live.scaled_count(long, "code", "option", "v", "pct").select("option", F.round("projected", 4).alias("projected"), r6("share"))


LIVE = """m AS (SELECT fc.*, coalesce(side1, 0) AS s1, coalesce(side1 + side0, 0) AS c, coalesce(pct, 0) AS pct FROM fc LEFT JOIN cn USING (code)), r AS (SELECT *, CASE WHEN c > 0 THEN s1 / c - p END AS r FROM m),
un AS (SELECT unit, region, sum(coalesce(r, 0) * c) AS s, sum(c) AS w FROM r GROUP BY ALL), rg AS (SELECT region, sum(s) AS s, sum(w) AS w FROM un GROUP BY 1), na AS (SELECT coalesce(sum(s) / nullif(sum(w), 0), 0) AS n FROM rg),
rd AS (SELECT region, (s + 5000 * n) / (w + 5000) AS d FROM rg, na), sw AS (SELECT unit, (s + 5000 * d) / (w + 5000) AS swing FROM un JOIN rd USING (region)),
t AS (SELECT r.*, swing, n, greatest(CASE WHEN pct > 0.02 THEN c / greatest(pct, 0.02) ELSE valid END, c) AS total FROM r JOIN sw USING (unit), na), pj AS (SELECT *, s1 + (total - c) * least(greatest(p + coalesce(r, 0) * pct + swing * (1 - pct), 0), 1) AS proj FROM t)"""


@query("live_estimate", f"""WITH {COUNTS}, {LIVE} SELECT unit, round(sum(c) / sum(total) * 100, 6) AS counted_pct, round(sum(s1) / nullif(sum(c), 0) * 100, 6) AS share_counted, round(sum(p * c) / nullif(sum(c), 0) * 100, 6) AS share_expected, round(sum(proj) / sum(total) * 100, 6) AS share_projected,
round(sum(p * valid) / sum(valid) * 100, 6) AS share_forecast, round(max(n) * 100, 6) AS deviation_pp, round(greatest(1.5 * (1 - sum(c) / sum(total)), 0.15), 6) AS sd_pp FROM pj GROUP BY unit""")
def live_estimate(spark: SparkSession, d: str) -> DataFrame:
    out = live.estimate(live.projected_units(forecast(spark, d), counts(spark, d), 5000), 1.5, by=["unit"])
    return out.select("unit", *[r6(c) for c in out.columns if c not in ("unit", "win")])


SNAPSHOTS = """sn AS (SELECT user_id % 200 AS code, CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 100 ELSE 40 END) AS BIGINT) AS side1, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 40 ELSE 90 END) AS BIGINT) AS side0 FROM events GROUP BY ALL),
cu AS (SELECT code, day, CAST(sum(side1) OVER w AS BIGINT) AS side1, CAST(sum(side0) OVER w AS BIGINT) AS side0, least(day(day) / 30.0::DOUBLE, 1) AS pct FROM sn WINDOW w AS (PARTITION BY code ORDER BY day))"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Count snapshots: what each unit has counted by the end of every day on which it reported."""
    one = F.col("event_type").isin("click", "view")
    day = table(spark, d, "events").groupBy((F.col("user_id") % 200).alias("code"), F.to_date("ts").alias("day")).agg(F.sum(F.when(one, 100).otherwise(40)).alias("a"), F.sum(F.when(one, 40).otherwise(90)).alias("b"))
    w = Window.partitionBy("code").orderBy("day")
    return day.select("code", F.sum("a").over(w).alias("side1"), F.sum("b").over(w).alias("side0"), F.least(F.dayofmonth("day") / F.lit(30.0), F.lit(1.0)).alias("pct"), F.col("day").cast("timestamp").alias("ts"))


@query("snapshot_replay", f"""WITH {SNAPSHOTS}, {COUNTS.split('fc AS')[0].rstrip().rstrip(',').replace('ct AS', 'c0 AS').replace('cn AS', 'c1 AS').replace('FROM ct', 'FROM c0')}, fc AS {COUNTS.split('fc AS ')[1]},
k AS (SELECT DISTINCT day AS cutoff FROM cu WHERE day(day) % 10 = 0), la AS (SELECT cutoff, code, side1, side0, pct FROM cu JOIN k ON day <= cutoff QUALIFY row_number() OVER (PARTITION BY cutoff, code ORDER BY day DESC) = 1),
m AS (SELECT k.cutoff, fc.*, coalesce(side1, 0) AS s1, coalesce(side1 + side0, 0) AS c, coalesce(pct, 0) AS pct FROM fc CROSS JOIN k LEFT JOIN la ON la.code = fc.code AND la.cutoff = k.cutoff), r AS (SELECT *, CASE WHEN c > 0 THEN s1 / c - p END AS r FROM m),
un AS (SELECT cutoff, unit, region, sum(coalesce(r, 0) * c) AS s, sum(c) AS w FROM r GROUP BY ALL), rg AS (SELECT cutoff, region, sum(s) AS s, sum(w) AS w FROM un GROUP BY ALL), na AS (SELECT cutoff, coalesce(sum(s) / nullif(sum(w), 0), 0) AS n FROM rg GROUP BY 1),
rd AS (SELECT cutoff, region, (s + 5000 * n) / (w + 5000) AS d FROM rg JOIN na USING (cutoff)), sw AS (SELECT cutoff, unit, (s + 5000 * d) / (w + 5000) AS swing FROM un JOIN rd USING (cutoff, region)),
t AS (SELECT r.*, swing, n, greatest(CASE WHEN pct > 0.02 THEN c / greatest(pct, 0.02) ELSE valid END, c) AS total FROM r JOIN sw USING (cutoff, unit) JOIN na USING (cutoff)), pj AS (SELECT *, s1 + (total - c) * least(greatest(p + coalesce(r, 0) * pct + swing * (1 - pct), 0), 1) AS proj FROM t)
SELECT CAST(cutoff AS VARCHAR) AS cutoff, round(sum(c) / sum(total) * 100, 6) AS counted_pct, round(sum(proj) / sum(total) * 100, 6) AS share_projected, round(max(n) * 100, 6) AS deviation_pp FROM pj GROUP BY cutoff""")
def snapshot_replay(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    cut = s.where(F.dayofmonth("ts") % 10 == 0).select(F.col("ts").alias("cutoff")).distinct()
    out = live.replay(forecast(spark, d), s, cut, 5000, 1.5)
    return out.select(F.to_date("cutoff").cast("string").alias("cutoff"), r6("counted_pct"), r6("share_projected"), r6("deviation_pp"))


@query("live_stream")
def live_stream(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots as JSON files through the stream: history of estimates after every micro-batch."""
    run = scratch(spark, "live")
    s = snapshots(spark, d).withColumn("slice", F.ceil(F.dayofmonth("ts") / 10).cast("int"))
    s.repartition("slice").write.partitionBy("slice").json(f"{run}/in")
    stream = spark.readStream.schema(live.COUNT_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{run}/in/*")
    live.track(stream, forecast(spark, d), f"{run}/history", f"{run}/checkpoint", 5000, 1.5).awaitTermination()
    h = spark.read.parquet(f"{run}/history")
    return h.select("batch", r6("counted_pct"), r6("share_projected"), "n_units")


ARRIVALS = """sn AS (SELECT user_id % 200 AS code, CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 100 ELSE 40 END) AS BIGINT) AS side1, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 40 ELSE 90 END) AS BIGINT) AS side0 FROM events GROUP BY ALL),
sp AS (SELECT min(day) AS d0, max(day) AS d1 FROM sn),
cu AS (SELECT code, day, CAST(sum(side1) OVER w AS BIGINT) AS side1, CAST(sum(side0) OVER w AS BIGINT) AS side0, CAST(row_number() OVER w AS DOUBLE) / count(*) OVER (PARTITION BY code) AS pct,
  date_diff('day', d0, day) * 4 // (date_diff('day', d0, d1) + 1) AS batch FROM sn, sp WINDOW w AS (PARTITION BY code ORDER BY day))"""


@query("live_to_end", f"""WITH {ARRIVALS}, fa AS ({COUNTS.split("fc AS (")[1]}, fc AS (SELECT * FROM fa WHERE code IN (SELECT code FROM sn)),
k AS (SELECT DISTINCT batch FROM cu), la AS (SELECT k.batch, code, side1, side0, pct FROM cu JOIN k ON cu.batch <= k.batch QUALIFY row_number() OVER (PARTITION BY k.batch, code ORDER BY day DESC) = 1),
m AS (SELECT k.batch, fc.*, coalesce(side1, 0) AS s1, coalesce(side1 + side0, 0) AS c, coalesce(pct, 0) AS pct FROM fc CROSS JOIN k LEFT JOIN la ON la.code = fc.code AND la.batch = k.batch), r AS (SELECT *, CASE WHEN c > 0 THEN s1 / c - p END AS r FROM m),
un AS (SELECT batch, unit, region, sum(coalesce(r, 0) * c) AS s, sum(c) AS w FROM r GROUP BY ALL), rg AS (SELECT batch, region, sum(s) AS s, sum(w) AS w FROM un GROUP BY ALL), na AS (SELECT batch, coalesce(sum(s) / nullif(sum(w), 0), 0) AS n FROM rg GROUP BY 1),
rd AS (SELECT batch, region, (s + 5000 * n) / (w + 5000) AS d FROM rg JOIN na USING (batch)), sw AS (SELECT batch, unit, (s + 5000 * d) / (w + 5000) AS swing FROM un JOIN rd USING (batch, region)),
t AS (SELECT r.*, swing, n, greatest(CASE WHEN pct > 0.02 THEN c / greatest(pct, 0.02) ELSE valid END, c) AS total FROM r JOIN sw USING (batch, unit) JOIN na USING (batch)), pj AS (SELECT *, s1 + (total - c) * least(greatest(p + coalesce(r, 0) * pct + swing * (1 - pct), 0), 1) AS proj FROM t),
h AS (SELECT batch, sum(c) / sum(total) * 100 AS counted, sum(proj) / sum(total) * 100 AS projected FROM pj GROUP BY batch), u AS (SELECT batch, count(*) AS n_units FROM la GROUP BY batch)
SELECT CAST(batch AS INTEGER) AS batch, round(counted, 6) AS counted_pct, round(projected, 6) AS share_projected, n_units FROM h JOIN u USING (batch) WHERE batch <= (SELECT min(batch) FROM h WHERE counted >= 99.99)""")
def live_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Four snapshots of a count, one file each, streamed until all is counted: the history, one row per batch."""
    run = scratch(spark, "live")
    one = F.col("event_type").isin("click", "view")
    day = table(spark, d, "events").groupBy((F.col("user_id") % 200).alias("code"), F.to_date("ts").alias("day")).agg(F.sum(F.when(one, 100).otherwise(40)).alias("a"), F.sum(F.when(one, 40).otherwise(90)).alias("b"))
    unit, w = Window.partitionBy("code"), Window.partitionBy("code").orderBy("day")
    span = day.agg(F.min("day").alias("d0"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"))
    s = day.crossJoin(F.broadcast(span)).withColumn("slice", F.floor(F.datediff("day", "d0") * 4 / F.col("days")))
    s = s.select("code", F.sum("a").over(w).alias("side1"), F.sum("b").over(w).alias("side0"), (F.row_number().over(w) / F.count("*").over(unit)).alias("pct"), F.col("day").cast("timestamp").alias("ts"), "slice")
    s.write.parquet(f"{run}/all")  # 200 units a day: each snapshot is one small file, as a live feed gives it
    s = spark.read.parquet(f"{run}/all")
    for i in range(4):
        s.where(F.col("slice") == i).drop("slice").coalesce(1).write.json(f"{run}/in/{i}")
    stream = live.read_counts(spark, f"{run}/in/*")
    f = forecast(spark, d).join(s.select("code").distinct(), "code", "left_semi")
    live.track_to_end(spark, stream, f, f"{run}/history", f"{run}/checkpoint", 5000, 1.5, every="0 seconds", wait=600)
    return spark.read.parquet(f"{run}/history").select("batch", r6("counted_pct"), r6("share_projected"), "n_units")
