"""Block ratios against the standard library's matcher, and the similarity join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from votelake.functions import likeness
from votelake.operators import dims


def brute(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratios_equal_the_matcher():
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcé ", k=rng.randrange(0, 30))) for _ in range(300)] + ["", "a", "aaaa", "abab" * 60, "😀é漢"]
    left, right = [rng.choice(texts) for _ in range(600)], [rng.choice(texts) for _ in range(600)]
    got = likeness.block_ratios(left, right)
    assert got.tolist() == pytest.approx([brute(a, b) for a, b in zip(left, right)], abs=1e-12)
    assert likeness.block_ratios([], []).tolist() == []


def test_ratio_of_columns_with_nulls_and_long_texts(spark, monkeypatch):
    long = "abcdefgh" * 300
    rows = [(1, "abc", "abd"), (2, None, "a"), (3, "a", None), (4, "", ""), (5, long, long[7:]), (6, "x", "y")]
    df = spark.createDataFrame(rows, "k int, a string, b string").coalesce(1)
    got = {r["k"]: r["r"] for r in df.select("k", likeness.block_ratio("a", "b").alias("r")).collect()}
    assert got == {k: None if a is None or b is None else pytest.approx(brute(a, b)) for k, a, b in rows}


def test_grams_number_equal_runs(spark):
    df = spark.createDataFrame([("abab",), ("a",), ("",), (None,)], "t string")
    got = {r["t"]: (r["one"], r["two"]) for r in df.select("t", likeness.grams("t", 1).alias("one"), likeness.grams("t", 2).alias("two")).collect()}
    assert got["abab"] == (["a#0", "b#0", "a#1", "b#1"], ["ab#0", "ba#0", "ab#1"])
    assert got["a"] == (["a#0"], []) and got[""] == ([], [])


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_no_pair_is_missed(spark, least):
    rng = random.Random(int(least * 100))
    made = ["".join(rng.choices("abcdef ", k=rng.randrange(1, 20))) for _ in range(40)]
    names = [n for m in made for n in (m, "".join(c for c in m if rng.random() > 0.1), m[::-1], m.replace("a", "ab", 1))] + ["", None]
    left = [(rng.randrange(2), i, n) for i, n in enumerate(names)]
    right = [(rng.randrange(2), 1000 + i, n) for i, n in enumerate(rng.sample(names, 100))]
    l = spark.createDataFrame(left, "unit int, code int, a string").repartition(3)
    r = spark.createDataFrame(right, "unit int, target int, b string").repartition(3)
    got = {(x["code"], x["target"]): x["similarity"] for x in dims.similar_pairs(l, r, "unit", "code", "target", "a", "b", least).collect()}
    want = {(i, j): brute(a, b) for u, i, a in left for v, j, b in right if u == v and a and b and brute(a, b) >= least}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_few_pairs_are_scored(spark):
    """Of many unlike names only those that can be alike meet."""
    rng = random.Random(3)
    words = [("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=14))) for _ in range(400)]
    l = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "unit int, code int, a string")
    r = spark.createDataFrame([(1, i, w[:-1] + "z") for i, w in enumerate(words)], "unit int, target int, b string")
    out = dims.similar_pairs(l, r, "unit", "code", "target", "a", "b", 0.75)
    assert {(x["code"], x["target"]) for x in out.collect()} >= {(i, i) for i in range(400)}
    assert out.where(F.col("code") != F.col("target")).count() < 20
