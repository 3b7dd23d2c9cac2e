"""Lines are summed by place before names are joined; what several aggregates shared is not grouped by section."""

import re

from pyspark.sql import functions as F

from votelake.plans import bindings, models
from votelake.plans.bindings import place_sums, votes
from votelake.plans.votes import group_votes


def test_place_rounds_group_lines_by_place_only(spark, sf_dir):
    plan = models.place_rounds(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    groups = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert not any("o_orderkey" in g or "section" in g for g in groups)
    assert any(re.fullmatch(r"(place|o_custkey)#\d+L?", g) for g in groups)


def test_first_round_equals_sums_over_sections(spark, sf_dir):
    want = group_votes(spark, sf_dir).where("round = 1").groupBy("unit", "grp").agg(F.sum("votes").alias("votes"))
    got = models.first_round(spark, sf_dir, "grp")
    assert {(r["unit"], r["grp"][:-2], r["votes"]) for r in got.collect()} == {(r["unit"], r["grp"], r["votes"]) for r in want.collect()}


def test_place_sums_by_option(spark, sf_dir):
    got = place_sums(spark, sf_dir, {"votes": F.sum("votes"), "n": F.count("*")}, ("option", "round"))
    want = votes(spark, sf_dir).groupBy("region", "unit", "segment", "place", "option", "round").agg(F.sum("votes").alias("votes"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tasks_follow_the_lines(spark, sf_dir, monkeypatch):
    by, sums = ("option", "round"), {"votes": F.sum("votes"), "n": F.count("*")}
    want = sorted(map(tuple, place_sums(spark, sf_dir, sums, by).collect()))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) + 7
    monkeypatch.setattr(bindings, "TASK_LINES", -(-lines // tasks))
    tasks = -(-lines // bindings.TASK_LINES)
    monkeypatch.setattr(bindings, "table", lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet").hint("merge"))  # as when no side fits a broadcast
    got = place_sums(spark, sf_dir, sums, by)
    plan = got._jdf.queryExecution().executedPlan().toString()
    for key in ("l_orderkey", "l_partkey", "place"):
        assert re.search(rf"hashpartitioning\({key}#\d+L?, {tasks}\)", plan), key
    assert sorted(map(tuple, got.collect())) == want
