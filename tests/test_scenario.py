import pytest
from pyspark.sql import functions as F

from votelake.functions.maths import normal, poisson_one, student_t
from votelake.operators import scenario


def lists(spark, values, sim=0):
    return spark.createDataFrame([(sim, i, float(v)) for i, v in enumerate(values)], "sim int, list int, votes double")


def seats(df, n, threshold=0.8):
    return [r["seats"] for r in scenario.allocate(df, ["sim"], "list", "votes", F.lit(n), threshold).orderBy("list").collect()]


@pytest.mark.parametrize("votes, n, expected", [([100, 50, 30], 5, [3, 1, 1]), ([100, 45, 20], 5, [4, 1, 0])])
def test_highest_averages(spark, votes, n, expected):
    assert seats(lists(spark, votes), n) == expected


def test_nobody_reaches_the_quota(spark):
    got = seats(lists(spark, [10] * 10), 2)
    assert sum(got) == 2 and max(got) == 1
    assert got[:2] == [1, 1]  # ties go to the smaller list


def test_every_simulation_allocates_all_seats(spark):
    df = spark.range(500).select(F.col("id").cast("int").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("list"))
    df = df.withColumn("votes", F.abs(normal(1, "sim", "list")) * 1000)
    sums = scenario.allocate(df, ["sim"], "list", "votes", F.lit(70)).groupBy("sim").agg(F.sum("seats").alias("n"))
    assert sums.where("n <> 70").count() == 0 and sums.count() == 500


def test_no_seats_and_no_votes(spark):
    assert seats(lists(spark, [5, 3]), 0) == [0, 0]
    assert seats(lists(spark, [0, 0]), 3) == [3, 0]  # nothing but ties: all to the first


def test_scenarios_repeat_and_do_not_depend_on_partitions(spark):
    base = spark.createDataFrame([("X", "a", "f1", 0.5), ("X", "b", "f1", 0.2), ("X", "c", "f2", 0.3)], "unit string, list string, family string, pct double")
    noise = spark.createDataFrame([("f1", 5.0, 2.0), ("f2", 5.0, 2.0)], "family string, sigma_unit double, sigma_national double")
    n = spark.createDataFrame([("X", 10)], "unit string, seats int")
    a = scenario.list_scenarios(base, n, noise, 200, 42).orderBy("sim", "family").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    b = scenario.list_scenarios(base.repartition(3), n, noise, 200, 42).orderBy("sim", "family").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b
    assert len({sum(r["seats"] for r in a if r["sim"] == s) for s in range(200)}) == 1
    summary = {r["family"]: r for r in scenario.seat_summary(scenario.list_scenarios(base, n, noise, 200, 42)).collect()}
    assert abs(sum(r["mean"] for r in summary.values()) - 10) < 1e-9 and summary["f1"]["p10"] <= summary["f1"]["p90"]


def families(spark, strength, n_cand):
    return spark.createDataFrame([("X", i, float(s), n) for i, (s, n) in enumerate(zip(strength, n_cand))], "unit string, family int, strength double, n_cand int")


@pytest.mark.parametrize("strength, n_cand, beta, expected", [([0.5, 0.3, 0.2], [2, 1, 1], 0.5, [1, 1, 0]), ([0.5, 0.3, 0.2], [2, 1, 1], 0.7, [2, 0, 0]), ([0.5, 0.3, 0.2], [0, 1, 1], 0.5, [0, 1, 1]), ([0.5, 0.3], [1, 0], 0.5, [1, 0])])
def test_two_winners(spark, strength, n_cand, beta, expected):
    got = scenario.two_winner_rule(families(spark, strength, n_cand), ["unit"], beta).orderBy("family").collect()
    assert [r["seats"] for r in got] == expected


def test_two_winners_effect_is_multiplicative(spark):
    effect = F.when(F.col("family") == 2, 2.0).otherwise(0.0)
    got = scenario.two_winner_rule(families(spark, [0.4, 0.3, 0.005], [1, 1, 1]), ["unit"], 0.5, effect=effect).orderBy("family").collect()
    assert [r["seats"] for r in got] == [1, 1, 0]


def two_round(spark, strengths, first=None, incumbent=None, delta=0.0, sigma_runoff=0.0, z_runoff=None, beta=1.0):
    n = len(strengths)
    rows = [(0, i, float(s), (first or [True] * n)[i], (incumbent or [False] * n)[i]) for i, s in enumerate(strengths)]
    df = spark.createDataFrame(rows, "race int, candidate int, strength double, first boolean, incumbent boolean")
    z = F.lit(0.0) if z_runoff is None else F.when(F.col("place") == 1, z_runoff[0]).otherwise(z_runoff[1])
    r = scenario.two_round_rule(df, ["race"], F.lit(beta), F.lit(0.0), F.lit(delta), F.lit(sigma_runoff), F.lit(0.0), z).first()
    return r["winner"], r["runoff"]


def test_two_rounds(spark):
    assert two_round(spark, [0.6, 0.3, 0.1]) == (0, False)
    assert two_round(spark, [0.45, 0.35, 0.2]) == (0, True)
    assert two_round(spark, [0.45, 0.35, 0.2], sigma_runoff=1.0, z_runoff=(-1.0, 1.0)) == (1, True)
    assert two_round(spark, [0.45, 0.35, 0.2], incumbent=[False, True, False], delta=1.5)[0] == 1
    assert two_round(spark, [0.5, 0.5]) == (0, True)  # exactly half goes on


def test_grid_prefers_the_parameters_that_made_the_outcomes(spark):
    rows = [(r, c, f"f{c}", [0.5, 0.3, 0.2][c], True, c == 1, "f1", True, True) for r in range(6) for c in range(3)]
    races = spark.createDataFrame(rows, "race int, candidate int, family string, strength double, first boolean, incumbent boolean, real_family string, real_incumbent boolean, real_runoff boolean")
    grid = spark.createDataFrame([(0.5, 0.2, d, 0.1) for d in (0.0, 0.4, 0.9)] + [(0.5, 5.0, 0.0, 9.0), (0.5, 0.2, 9.0, 0.1)], "beta double, sigma double, delta double, sigma_runoff double")
    table = scenario.grid_likelihood(races, grid, 40, 3)
    assert scenario.best_point(table)["delta"] == 0.4
    with pytest.raises(ValueError):
        scenario.best_point(table.where("delta <= 0.4"))


def test_no_noise_makes_the_runoff_certain(spark):
    first = spark.createDataFrame([("f", 0.45), ("l", 0.40), ("o", 0.15)], "candidate string, share double")
    pairs = spark.createDataFrame([("f", "l", 0.52)], "a string, b string, share_a double")
    out = scenario.pairing_scenarios(first, pairs, 100, 1, F.lit(0.0), 0.0)
    assert out.where("first = 'f' and second = 'l' and winner = 'f'").count() == 100


@pytest.mark.parametrize("n, low, high", [(5, 0.30, 0.45), (5000, 0.59, 0.61)])
def test_posterior_moves_with_the_effective_number(spark, n, low, high):
    df = spark.createDataFrame([(0.3, 6000.0, 4000.0)], "prior double, side1 double, side0 double")
    assert low < scenario.beta_update(df, n).first()["mean"] < high


def test_draws_have_their_moments(spark):
    d = spark.range(4000).select(normal(1, "id").alias("z"), student_t(1, 5, "id").alias("t"), poisson_one(1, "id").alias("p"))
    r = d.agg(F.avg("z"), F.stddev("z"), F.avg("t"), F.avg("p"), F.var_samp("p")).first()
    assert abs(r[0]) < 0.06 and abs(r[1] - 1) < 0.05 and abs(r[2]) < 0.08 and abs(r[3] - 1) < 0.06 and abs(r[4] - 1) < 0.1


def test_chamber_must_be_full(spark):
    won = spark.createDataFrame([(0, "a", 2), (0, "b", 1)], "sim int, family string, seats long")
    kept = spark.createDataFrame([("a", 1), ("c", 1)], "family string, seats long")
    assert {r["family"]: r["seats"] for r in scenario.chamber(won, kept, 5).collect()} == {"a": 3, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        scenario.chamber(won, kept, 6)
