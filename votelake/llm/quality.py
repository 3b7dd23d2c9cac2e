"""Document quality by Bradley-Terry ranking of preference pairs.

A document is described by shares of its kinds of characters, by how its words
repeat, and by the shares of its words in hashed buckets.  The model is a
weight per feature: the probability that one document is preferred to another
is the logistic function of the difference of their scores.  It is fitted on all
pairs of a good and a bad labelled document, and documents are accepted above
the cut that separates the labelled ones best.  All sums run over the whole
table of labelled documents, in tasks; only sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .labelled import classes_of
from .storage import BROADCAST_IDS, bound_batches, discard, materialize, texts_of

#: Feature rows that are summed at a time.
ROWS = 2048
#: Nodes per unit of score at which documents meet, and nodes at most (then they are wider apart).
NODES, MOST_NODES = 8, 1024
#: Cuts of the range of scores that are tried as threshold.
CUTS = 1 << 14
#: The score at which a document counts as good.
ACCEPT = 0.3

_CLASSES = np.zeros((256, 8), np.float32)
_CLASSES[65:91, 0] = 1  # capitals; only those after another one are counted
_CLASSES[48:58, 1] = 1  # digits
_CLASSES[[33, 63], 2] = 1  # ! ?
_CLASSES[[124], 3] = 1  # |
_CLASSES[[*b"#$%&*@^~=+<>{}[]\\_`/"], 4] = 1
_CLASSES[[*b".,;:'\"()-"], 5] = 1
_CLASSES[[10], 6] = 1
_CLASSES[[*range(97, 123), *range(128, 256)], 7] = 1
#: Buckets of hashed words.
LEXICAL = 128
WIDTH = _CLASSES.shape[1] + 5 + LEXICAL


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: shares of character classes and of capitals after capitals, repetition of words, length, and shares of words by hash."""
    rows = []
    for a, b, words in vectext.blocks(texts):
        data, begin = vectext.utf8(texts.slice(a, b - a))
        size = np.maximum(np.diff(begin), 1)[:, None]
        loud = (_CLASSES[:, 0][data] > 0).astype(np.float32)
        loud[1:] *= loud[:-1].copy()
        loud[begin[:-1][begin[:-1] < len(loud)]] = 0  # a text's first character follows none
        shares = np.column_stack([vectext.per_doc(_CLASSES[:, k][data] if k else loud, begin) for k in range(_CLASSES.shape[1])]) / size
        n = np.diff(words.first)
        same = np.zeros(len(words.hashes))
        same[1:] = words.hashes[1:] == words.hashes[:-1]
        same[words.first[:-1][n > 0]] = 0
        repeats = vectext.per_doc(same, words.first) / np.maximum(n, 1)
        length = vectext.per_doc((words.ends - words.starts).astype(float), words.first) / np.maximum(n, 1)
        bucket = np.repeat(np.arange(b - a), n) * LEXICAL + (words.hashes % np.uint64(LEXICAL)).astype(np.int64)
        lexical = np.bincount(bucket, minlength=(b - a) * LEXICAL).reshape(-1, LEXICAL) / np.maximum(n, 1)[:, None]
        pairs, first = words.shingles(2)
        kinds = np.array([len(np.unique(pairs[first[i] : first[i + 1]])) for i in range(b - a)]) / np.maximum(np.diff(first), 1)
        rows.append(np.column_stack((shares, repeats, np.where(n > 0, 1 - kinds, 0), np.minimum(length, 40) / 40, np.minimum(np.log1p(n), 12) / 12, n == 0, lexical)))
    return np.concatenate(rows) if rows else np.zeros((0, WIDTH))


@dataclass(frozen=True)
class QualityModel:
    """``weights`` rank; a rank of ``threshold`` has the score ``ACCEPT``, ``scale`` says how fast it rises."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        rank = ((features(texts) - self.mean) / self.spread) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.scale * (rank - self.threshold) + np.log(ACCEPT / (1 - ACCEPT)), -40, 40)))


def _at_nodes(scores: np.ndarray, low: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The four nodes around each score and their weights in cubic interpolation; node k is at ``low + (k - 1) * step``."""
    at = (scores - low) / step
    first = np.floor(at).astype(np.int64)
    u = at - first
    weights = np.stack((-u * (u - 1) * (u - 2) / 6, (u + 1) * (u - 1) * (u - 2) / 2, -(u + 1) * u * (u - 2) / 2, (u + 1) * u * (u - 1) / 6), 1)
    return first[:, None] + np.arange(4), weights


def _fit(total: Callable, size: int) -> QualityModel:
    """Newton steps on the mean logistic loss over all pairs of a good and a bad row.

    ``total(f, merge)`` merges ``f(x, y)`` over blocks of all rows, by default
    as a sum.  A pair's loss depends on its difference of scores only, so each
    class is summed at nodes of the score, and nodes instead of rows are paired:
    every pair counts, by cubic interpolation between nodes.
    """
    moments = total(lambda x, y: np.concatenate(([(y == 1).sum(), (y == 0).sum()], x.sum(0), (x * x).sum(0))))
    if moments is None or not moments[0] or not moments[1]:
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(size), -1.0, 40.0)
    n = moments[:2]
    # rounded, since sums of doubles depend on their order
    mean = np.round(moments[2 : 2 + size] / n.sum(), 12)
    spread = np.round(np.sqrt(np.maximum(moments[2 + size :] / n.sum() - mean**2, 0)) + 0.05, 12)

    def span(w: np.ndarray) -> tuple[float, float]:
        high, low = total(lambda x, y: (lambda s: np.array([s.max(), -s.min()]))(((x - mean) / spread) @ w), np.maximum) * [1, -1]
        return float(low), float(high)

    w = np.zeros(size)
    for _ in range(30):
        low, high = span(w)
        step = max(1 / NODES, (high - low) / MOST_NODES)
        count = int((high - low) / step) + 4

        def meet(x, y, w=w, low=low, step=step, count=count):
            z = (x - mean) / spread
            nodes, weights = _at_nodes(z @ w, low, step)
            spreading = np.zeros((len(z), count))
            np.put_along_axis(spreading, nodes, weights, 1)
            z = np.column_stack((np.ones(len(z)), z))
            return np.concatenate([spreading[y == c].T @ z[y == c] for c in (1, 0)]).ravel()

        good, bad = total(meet).reshape(2, count, 1 + size)
        place = step * np.arange(count)
        p = 1 / (1 + np.exp(-np.clip(place[:, None] - place, -40, 40)))
        q = p * (1 - p)
        pull = np.stack((q @ bad[:, 0], good[:, 0] @ q))

        def bend(x, y, w=w, low=low, step=step, pull=pull):
            z = (x - mean) / spread
            nodes, weights = _at_nodes(z @ w, low, step)
            own = (np.where((y == 1)[:, None], pull[0][nodes], pull[1][nodes]) * weights).sum(1)
            return (z.T * own @ z).ravel()

        gradient = ((p - 1) @ bad[:, 0] @ good[:, 1:] - good[:, 0] @ (p - 1) @ bad[:, 1:]) / n.prod() + 1e-3 * w
        cross = good[:, 1:].T @ q @ bad[:, 1:]
        curve = (total(bend).reshape(size, size) - cross - cross.T) / n.prod() + 1e-3 * np.eye(size)
        move = np.linalg.solve(curve, gradient)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    w = np.round(w, 6)

    low, high = span(w)
    width = (high - low) / CUTS or 1.0

    def count_bins(x, y):
        own = np.clip((((x - mean) / spread) @ w - low) / width, 0, CUTS - 1).astype(np.int64)
        return np.concatenate([np.bincount(own[y == c], minlength=CUTS) for c in (1, 0)])

    below = total(count_bins).reshape(2, CUTS).cumsum(1)[:, :-1]
    right = 1 - below[0] / n[0] + below[1] / n[1]
    best = np.flatnonzero(right >= right.max() - 1e-9)
    threshold = low + width * float(best[len(best) // 2] + 1) if high > low else low

    scales, shift = np.geomspace(0.2, 20, 40), np.log(ACCEPT / (1 - ACCEPT))

    def losses(x, y):
        z = ((x - mean) / spread) @ w - threshold
        loss = np.log1p(np.exp(-np.clip((2 * y - 1)[:, None] * (z[:, None] * scales + shift), -40, 40)))
        return np.concatenate([loss[y == c].sum(0) for c in (1, 0)])

    loss = total(losses).reshape(2, -1) / n[:, None]
    return QualityModel(mean, spread, w, threshold, float(scales[int(np.argmin(loss.sum(0)))]))


def fit_pairs(good: np.ndarray, bad: np.ndarray) -> QualityModel:
    """The model of the rows of ``good``, each preferred to each of ``bad``.  With no pair, every document has the score 1."""
    x, y = np.concatenate((good, bad)), np.repeat([1, 0], [len(good), len(bad)])
    return _fit(lambda f, merge=None: f(x, y), (good if len(good) else bad).shape[1])


def fit_quality(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on all documents of ``classes(doc_id, y)``, y 1 for good and 0 for bad.

    Their feature rows are written once; each pass over them brings one row of
    sums per task to the driver.  Null texts count as empty.  With more labelled
    ids than can be broadcast, features instead of texts are shuffled.
    """

    def describe(batches):
        for batch in batches:
            x = features(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    known = materialize(classes_of(classes).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")), "labelled")
    texts, few = texts_of(docs, id_col, text_col), known.count() <= BROADCAST_IDS
    told = texts.join(F.broadcast(known), "doc_id", "left_semi") if few else texts
    rows = told.mapInArrow(describe, "doc_id long, x binary").join(F.broadcast(known) if few else known, "doc_id").select("y", "x")
    rows = bound_batches(materialize(rows, "quality-features"))

    def total(f, merge=np.add):
        def run(batches):
            held = None
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)
                    own = np.asarray(f(x, part.column(0).to_numpy()), float)
                    held = own if held is None else merge(held, own)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["sums"])

        parts = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()]
        return reduce(merge, parts) if parts else None

    model = _fit(total, WIDTH)
    discard(known, rows)
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row; predicted is 1 from the score ``ACCEPT`` on.

    Null and empty texts are scored as texts without characters; repeated rows
    are scored each; other columns are not read; an empty table gives an empty
    result, and rows with equal features equal scores.
    """

    def run(batches):
        for batch in batches:
            s = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows that the model accepts, with all columns as given."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) >= ACCEPT))

    return bound_batches(docs).mapInArrow(run, docs.schema)
