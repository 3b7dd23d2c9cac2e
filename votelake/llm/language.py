"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of the hashed 2- to 4-byte pieces of its
words; a softmax over the languages follows.  Both are trained by stochastic
gradient descent in numpy on a bounded sample.  The confidence is calibrated by
a temperature on examples that were set aside, which also give the confidence
below which a prediction is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .labelled import sample
from .storage import texts_of

#: Labelled documents of each language that the model is fitted on, at most.
PER_CLASS = 400
#: Hash buckets of the pieces, size of an embedding, passes over the examples.
BUCKETS, DIM, EPOCHS = 1 << 15, 16, 12
#: Lengths of the pieces in bytes.
PIECES = (2, 3, 4)
#: Share of accepted examples that may be wrong.
ERROR = 0.01


def _blocks(texts: pa.Array):
    return vectext.blocks(pc.utf8_lower(pc.fill_null(texts, "")), vectext.NON_ALNUM)


def _buckets(words: vectext.Words):
    """(buckets, where each document's begin) of each length of piece and of the words themselves."""
    for k in PIECES:
        h, first = words.grams(k)
        yield (h >> np.uint64(49)).astype(np.int64), first
    yield (words.hashes >> np.uint64(49)).astype(np.int64), words.first


def bags(texts: pa.Array):
    """(distinct buckets, counts) of each whole text."""
    for a, b, words in _blocks(texts):
        parts = list(_buckets(words))
        for i in range(b - a):
            yield np.unique(np.concatenate([h[f[i] : f[i + 1]] for h, f in parts]), return_counts=True)


@dataclass(frozen=True)
class LanguageModel:
    """``table`` has the logits of a bucket: embeddings times softmax weights, which averaging lets one multiply out."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for a, b, words in _blocks(texts):
            total, n = np.zeros((b - a, len(self.languages))), np.zeros(b - a)
            for h, first in _buckets(words):
                n += np.diff(first)
                for k in range(len(self.languages)):
                    total[:, k] += vectext.per_doc(self.table[k][h], first)
            z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str]) -> LanguageModel:
    """SGD over the (buckets, counts) of the examples, in a fixed pseudo-random order; every fifth is set aside for calibration."""
    rng = np.random.Generator(np.random.PCG64(11))
    n_lang = len(languages)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = np.zeros((DIM, n_lang))
    bias = np.zeros(n_lang)
    aside = np.arange(len(labels)) % 5 == 4
    own = np.flatnonzero(~aside)
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS) + 0.05
        for i in rng.permutation(own):
            at, count = examples[i]
            if not len(at):
                continue
            share = count / count.sum()
            h = share @ emb[at]
            p = _softmax(h @ out + bias)
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            emb[at] -= rate * 10 * share[:, None] * back
    def logits(i):
        at, count = examples[i]
        return (count / count.sum()) @ (emb[at] @ out) + bias if len(at) else bias
    z = np.array([logits(i) for i in np.flatnonzero(aside)]).reshape(-1, n_lang)
    y = labels[aside]
    temperature, reject = 1.0, 0.0
    if len(z):
        heats = np.geomspace(0.2, 5, 60)
        loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in heats]
        temperature = float(heats[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        top, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-top, kind="stable")
        wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(wrong <= ERROR)
        reject = float(top[order[good[-1]]]) if len(good) else 1.0
    return LanguageModel(languages, (emb @ out).T.copy(), bias, temperature, reject)


def fit_language(docs: DataFrame, classes: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Fit on at most ``per_class`` documents of each language of ``classes(doc_id, y)``, y a string; rows with nulls are not used.

    All languages are learned; the model has BUCKETS numbers for each.
    """
    languages = sorted(r["y"] for r in classes.where("y is not null").select("y").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros(0), 1.0, 0.0)

    def describe(batches):
        for batch in batches:
            got = list(bags(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], names=["doc_id", "y", "a", "c"])

    rows = sample(docs, classes, per_class, id_col, text_col).select("doc_id", "y", "text").mapInArrow(describe, "doc_id long, y string, a binary, c binary").toPandas().sort_values(["doc_id", "y"])
    examples = [(np.frombuffer(a, np.int32), np.frombuffer(c, np.int32)) for a, c in zip(rows["a"], rows["c"])]
    place = {y: k for k, y in enumerate(languages)}
    return train(examples, np.array([place[y] for y in rows["y"]], np.int64), languages)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every row, from the whole text.

    A null text, a text without any letter, and every text where no language
    was learned get ``und`` with score 0.  ``rejected`` marks predictions whose
    calibrated confidence is below the learned bound.  Of languages with the
    same score the first by name is predicted.  Repeated rows are predicted
    each; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            rows, letters = batch.num_rows, np.array(batch.column(2).fill_null(False).to_pylist(), bool)
            if model.languages:
                p = model.probabilities(batch.column(1))
                best, top = p.argmax(1), p.max(1)
            else:
                best, top, letters = np.zeros(rows, int), np.zeros(rows), np.zeros(rows, bool)
            names = [model.languages[k] if ok else "und" for k, ok in zip(best, letters)]
            top = np.where(letters, top, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top), pa.array(top < model.reject_below)], names=["doc_id", "lang_pred", "score", "rejected"])

    return texts_of(docs, id_col, text_col).withColumn("letters", F.col("text").rlike(r"\p{L}")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
