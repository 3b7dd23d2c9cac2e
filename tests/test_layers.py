"""Distinct counts of layers, of values that lie in several groups, and nulls."""

from pyspark.sql import functions as F

from votelake.operators import rollup

ROWS = [("r1", "u1", 1, "s1", 3), ("r1", "u1", 2, "s1", 4), ("r1", "u2", 1, "s1", 5), ("r2", "u3", 1, "s2", 6), ("r2", None, 1, "s3", 7), ("r2", None, 2, None, 8), (None, "u4", 2, "s2", 9)]
SETS = {"all": [], "region": ["region"], "unit": ["region", "unit"], "year": ["year"], "unit year": ["region", "unit", "year"]}


def test_layers_count_distinct_values(spark):
    df = spark.createDataFrame(ROWS, "region string, unit string, year int, section string, votes int").repartition(3)
    out = rollup.layers(df, SETS, [F.sum("votes").alias("votes")], {"sections": "section"})
    got = {(r["layer"], r["region"], r["unit"], r["year"]): (r["votes"], r["sections"]) for r in out.collect()}
    want = {}
    for name, own in SETS.items():
        for row in ROWS:
            at = dict(zip(("region", "unit", "year"), row))
            key = (name, *(at[c] if c in own else None for c in ("region", "unit", "year")))
            want.setdefault(key, []).append(row)
    assert got == {k: (sum(r[4] for r in v), len({r[3] for r in v} - {None})) for k, v in want.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower().replace("array_distinct", "")
