"""The quality model is fitted on all labelled documents and all their pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from votelake.llm import quality


def all_pairs(good, bad):
    """Newton steps over every pair, one by one."""
    both = np.concatenate((good, bad))
    mean, spread = both.mean(0), both.std(0) + 0.05
    g, b = (good - mean) / spread, (bad - mean) / spread
    diff = (g[:, None] - b[None]).reshape(-1, good.shape[1])
    w = np.zeros(good.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-diff @ w))
        gradient = diff.T @ (p - 1) / len(diff) + 1e-3 * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(curve, gradient)
    return mean, spread, w


def test_weights_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    good, bad = rng.random((90, 5)), rng.random((70, 5)) * [1, 0.8, 1, 1.2, 0.6]
    m = quality.fit_pairs(good, bad)
    mean, spread, w = all_pairs(good, bad)
    assert np.allclose(m.mean, mean, atol=1e-10) and np.allclose(m.spread, spread, atol=1e-10)
    assert np.allclose(m.weights, w, atol=2e-5)
    rank = lambda x: ((x - m.mean) / m.spread) @ m.weights
    right = lambda c: (rank(good) >= c).mean() + (rank(bad) < c).mean()
    assert right(m.threshold) >= max(right(c) for c in np.concatenate((rank(good), rank(bad)))) - 0.02


@pytest.mark.parametrize("few", [True, False])
def test_every_labelled_document_is_learned_from(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["plain", "words", "here", "THERE", "!!", "and", "so", "on"], 12)) for _ in range(5200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))  # 2600 a class
    seen = []
    fit = quality._fit

    def spy(total, size):
        seen.append(total(lambda x, y: np.array([(y == 1).sum(), (y == 0).sum()])).tolist())
        return fit(total, size)

    monkeypatch.setattr(quality, "_fit", spy)
    model = quality.fit_quality(docs.repartition(3), y)
    assert seen == [[2600.0, 2600.0]]
    x = quality.features(pa.array(texts)).astype(np.float32).astype(float)
    want = quality.fit_pairs(x[1::2], x[::2])
    assert np.allclose(model.weights, want.weights, atol=2e-6) and abs(model.threshold - want.threshold) < 1e-4 and model.scale == want.scale


def test_features_do_not_depend_on_the_text_before():
    alone = quality.features(pa.array(["AB c"]))
    assert (quality.features(pa.array(["x Y", "", "AB c"]))[2] == alone[0]).all()
