"""Components of edges: contracted in tasks first, so that the driver plans few rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.llm import components


def plain(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


def test_stars_of_long_chains_and_random_graphs():
    rng = np.random.default_rng(1)
    chain = rng.permutation(3000) - 1500
    for u, v in ((chain[:-1], chain[1:]), rng.integers(0, 900, (2, 500)), rng.integers(0, 40, (2, 60)), (np.array([4]), np.array([4])), (np.array([], int), np.array([], int))):
        got = dict(zip(*(x.tolist() for x in components._stars(u, v))))
        assert {x: got.get(x, x) for x in {*u.tolist(), *v.tolist()}} == plain(list(zip(u.tolist(), v.tolist())))


@pytest.mark.parametrize("held", [1, 7, 1 << 18])
def test_components_whatever_a_task_holds(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD_EDGES", held)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (205, 201), (201, 205)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5, F.col("v")))
    rows = [(r["node"], r["component"]) for r in got.collect()]
    want = plain([e for e in edges if e[0] != e[1]])
    assert len(rows) == len(want) and dict(rows) == want


def test_few_edges_take_one_round(spark, monkeypatch):
    made = []
    write = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: made.append(name) or write(df, name))
    components.connected_components(spark.range(200).selectExpr("id as u", "id + 1 as v"))
    assert made == ["edges", "edges", "components"]
