"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine.

A document is a vector over all words that the examples have, and over those
word beginnings that lean to the toxic class.  A term weighs its inverse
document frequency times LEAST and how clearly it leans, so every document has
a vector and the words that tell decide.  The examples are kept in inverted
lists whose ids are cut into blocks; every term knows its largest weight in
each block.  A query adds these maxima up, looks at the blocks of the highest
bounds first, then at all those whose bound reaches its k-th best cosine: the
neighbours are exact.  Their votes, weighted by cosine, are calibrated on the
examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .labelled import sample
from .storage import bound_batches, texts_of

#: Labelled documents of each class that serve as examples, at most.
PER_CLASS = 1500
#: The weight of a term that does not lean, the chi-square at which a leaning term has half its weight, and the one from which a beginning is a term.
LEAST, HALF_CHI2, BEGINNING_CHI2 = 0.02, 40.0, 10.0
#: Neighbours that vote, examples of one block, and blocks that a query looks at first.
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 15, 64, 3
#: The score from which a document counts as toxic.
FLAG = 0.3
#: Lengths in bytes of the word beginnings.
PREFIXES = (4, 5, 6)


def _blocks(texts: pa.Array):
    return vectext.blocks(pc.utf8_lower(pc.fill_null(texts, "")), vectext.NON_ALNUM)


def lean(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """0 to 1: how clearly terms that so many examples of each class have lean to the toxic class, by the chi-square of the 2 x 2 table."""
    both, n = toxic + clean, n_toxic + n_clean
    chi2 = n * (toxic * (n_clean - clean) - clean * (n_toxic - toxic)) ** 2 / np.maximum(max(n_toxic * n_clean, 1.0) * both * np.maximum(n - both, 1.0), 1.0)
    return np.where(toxic * n_clean > clean * n_toxic, (chi2 / (chi2 + HALF_CHI2)) ** 2, 0.0)


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``n`` numbers from ``begin``, one range after the other."""
    where = np.cumsum(n)
    return np.arange(where[-1] if len(where) else 0) + np.repeat(begin - where + n, n)


class Neighbours:
    """Examples in block-max inverted lists.

    ``terms`` are sorted hashes and ``boost`` what each weighs besides its
    inverse document frequency; ``vectors`` one (positions, counts) per
    example, ``weights`` how many labelled documents each stands for.
    """

    def __init__(self, terms: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None, boost: np.ndarray | None = None):
        self.terms, self.labels = terms, labels
        self.stands_for = np.ones(len(vectors)) if weights is None else weights
        sizes = np.array([len(at) for at, _ in vectors], np.int64)
        at = np.concatenate([x for x, _ in vectors] or [np.zeros(0)]).astype(np.int64)
        df = np.bincount(at, minlength=len(terms))
        self.idf = (np.log((len(vectors) + 1) / (df + 1)) + 1) * (1.0 if boost is None else boost)
        ids = np.repeat(np.arange(len(vectors)), sizes)
        unit = np.concatenate([self.unit(x, c) for x, c in vectors] or [np.zeros(0)])
        order = np.lexsort((ids, at))  # by term, then example
        at, self.ids, self.weights = at[order], ids[order].astype(np.int32), unit[order]
        block = self.ids // BLOCK
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (block[1:] != block[:-1])
        # one entry per term and block that has it: the block, where its examples begin in the list, and the largest weight there
        self.begin = np.append(np.flatnonzero(new), len(at))
        self.block = block[self.begin[:-1]]
        self.maxima = np.maximum.reduceat(self.weights, self.begin[:-1]) if len(at) else np.zeros(0)
        self.first = np.searchsorted(at[self.begin[:-1]], np.arange(len(terms) + 1))
        self.n_blocks = -(-len(vectors) // BLOCK)
        self.calibration = np.zeros(3)

    def unit(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[at]
        return w / max(np.sqrt((w * w).sum()), 1e-300)

    def nearest(self, at: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the NEIGHBOURS nearest examples with a positive cosine: by cosine, then id."""
        q = self.unit(at, counts)
        n = self.first[at + 1] - self.first[at]
        entries = _ranges(self.first[at], n)
        q, block = np.repeat(q, n), self.block[entries]
        bound = np.bincount(block, q * self.maxima[entries], self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        ids, cosines, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        done = 0
        while done < len(order) and bound[order[done]] > 0 and (len(ids) < NEIGHBOURS or bound[order[done]] >= kth - 1e-12):
            some = order[done : done + FIRST_BLOCKS] if not done else order[done:]
            if len(ids) >= NEIGHBOURS:
                some = some[bound[some] >= kth - 1e-12]
            done += len(some)
            looked = np.zeros(self.n_blocks, bool)
            looked[some] = True
            own = np.flatnonzero(looked[block])
            begin = self.begin[entries[own]]
            m = self.begin[entries[own] + 1] - begin
            at_ = _ranges(begin, m)
            found = np.bincount(self.ids[at_], np.repeat(q[own], m) * self.weights[at_], len(self.labels))
            if without >= 0:
                found[without] = 0
            hit = np.flatnonzero(found > 0)
            if len(hit) > 4 * NEIGHBOURS:  # all that can be among the nearest, ties included
                hit = hit[found[hit] >= -np.partition(-found[hit], NEIGHBOURS - 1)[NEIGHBOURS - 1] - 1e-11]
            ids, cosines = np.concatenate((ids, hit)), np.concatenate((cosines, found[hit]))
            best = np.lexsort((ids, -np.round(cosines, 12)))[:NEIGHBOURS]
            ids, cosines = ids[best], cosines[best]
            kth = cosines[-1] if len(ids) else 0.0
        return ids, cosines

    def vote(self, at: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[float, float, list[int]]:
        """(share of toxic neighbours, weighted by cosine and by what they stand for, best cosine, neighbours); all 0 for a text without any term."""
        ids, cosines = self.nearest(at, counts, without) if len(at) else (np.zeros(0, np.int64), np.zeros(0))
        say = cosines * self.stands_for[ids]
        return (float((say * self.labels[ids]).sum() / say.sum()), float(cosines[0]), ids.tolist()) if len(ids) else (0.0, 0.0, [])

    def vectors(self, texts: pa.Array):
        """(positions of terms, counts) of each whole text."""
        for a, b, words in _blocks(texts):
            docs, hits = [], []
            for hashes, at in [(words.hashes, np.arange(len(words.hashes))), *(words.prefixes(k) for k in PREFIXES)]:
                distinct, which = np.unique(hashes, return_inverse=True)
                pos = np.searchsorted(self.terms, distinct)
                pos[pos == len(self.terms)] = 0
                pos = np.where(self.terms[pos] == distinct, pos, -1)[which] if len(self.terms) else np.full(len(hashes), -1)
                ok = np.flatnonzero(pos >= 0)
                hits.append(pos[ok])
                docs.append(np.searchsorted(words.first, at[ok], "right") - 1)
            hit, doc = np.concatenate(hits), np.concatenate(docs)
            key, counts = np.unique(doc * max(len(self.terms), 1) + hit, return_counts=True)
            doc, hit = np.divmod(key, max(len(self.terms), 1))
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            for i in range(b - a):
                yield hit[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]]

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit the probability of label 1 to each example's vote without itself; what the examples stand for undoes the sampling."""
        x = np.array([(v, c, 1.0) for v, c, _ in (self.vote(*vec, without=i) for i, vec in enumerate(vectors))]).reshape(-1, 3)
        w, y, weights = np.zeros(3), self.labels.astype(float), self.stands_for
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            r = weights * (p - y)
            h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            step = np.linalg.solve(h, x.T @ r + 1e-2 * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.calibration = w

    def score(self, vote: float, cosine: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.calibration, (vote, cosine, 1.0)), -40, 40))))


def fit_toxicity(docs: DataFrame, classes: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Neighbours:
    """Examples from at most ``per_class`` documents of each class of ``classes(doc_id, y)``, y 1 for toxic.

    The examples' terms are counted in one grouped aggregate; the driver
    receives them and the examples' vectors, which ``per_class`` bounds.
    """
    taken = sample(docs, classes, per_class, id_col, text_col).select("doc_id", F.col("y").cast("int").alias("y"), "text", "weight")

    def distinct_terms(batches):
        for batch in batches:
            for a, b, words in _blocks(batch.column(2)):
                for beginning, (hashes, at) in enumerate([(words.hashes, np.arange(len(words.hashes))), *(words.prefixes(k) for k in PREFIXES)]):
                    doc = np.searchsorted(words.first, at, "right") - 1
                    order = np.lexsort((hashes, doc))
                    h, d = hashes[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    y = batch.column(1).take(pa.array(a + d[new]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(np.full(new.sum(), beginning > 0)), y], names=["term", "beginning", "y"])

    totals = {r["y"]: r["n"] for r in taken.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, fine = float(totals.get(1, 0)), float(sum(totals.values()) - totals.get(1, 0))
    counted = taken.mapInArrow(distinct_terms, "term long, beginning boolean, y int").groupBy("term", "beginning").agg(F.sum(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(1.0)).alias("b"))
    # a beginning needs the chi-square BEGINNING_CHI2, which takes at least as many toxic examples less what all examples are fewer than that
    rows = counted.where(f"not beginning or a >= 2 and a * {fine} > b * {bad}").toArrow()
    column = lambda name: rows.column(name).to_numpy()
    leans = lean(column("a"), column("b"), bad, fine)
    keep = ~column("beginning").astype(bool) | (leans >= (BEGINNING_CHI2 / (BEGINNING_CHI2 + HALF_CHI2)) ** 2)
    terms, own = np.unique(column("term").astype(np.int64).view(np.uint64)[keep], return_index=True)
    boost = LEAST + leans[keep][own]
    del rows, leans, keep, own
    finder = Neighbours(terms, [], np.zeros(0))

    def vectors(batches):
        for batch in batches:
            found = list(finder.vectors(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], names=["doc_id", "y", "weight", "at", "n"])

    rows = taken.mapInArrow(vectors, "doc_id long, y int, weight double, at binary, n binary").toPandas().sort_values(["doc_id", "y"])
    examples = [(np.frombuffer(x, np.int32).astype(np.int64), np.frombuffer(c, np.int32).astype(np.int64)) for x, c in zip(rows["at"], rows["n"])]
    # examples with the same telling terms, and then those that share their most common word, lie together: the blocks' bounds are tight
    df = np.bincount(np.concatenate([x for x, _ in examples] or [np.zeros(0, np.int64)]), minlength=len(terms))

    def key(i: int) -> tuple:
        x = examples[i][0]
        telling = x[boost[x] > 2 * LEAST]
        return tuple(telling[np.argsort(-boost[telling], kind="stable")].tolist()), int(x[np.argmax(df[x])]) if len(x) else -1, i

    order = sorted(range(len(examples)), key=key)
    examples = [examples[i] for i in order]
    model = Neighbours(terms, examples, rows["y"].to_numpy(np.int64)[order], rows["weight"].to_numpy(float)[order], boost)
    if examples:
        model.calibrate(examples)
    model.examples = rows["doc_id"].to_numpy(np.int64)[order]
    pa.default_memory_pool().release_unused()
    return model


def _scores(model: Neighbours, texts: pa.Array):
    return [(model.score(v, c), v, c, ids) for v, c, ids in (model.vote(at, n) for at, n in model.vectors(texts))]


def score_toxicity(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, evidence)`` of every row; evidence lists ids of the nearest examples.

    Null and empty texts, and texts without any term, have no neighbours and
    the calibrated score of such; repeated rows are scored each; other columns
    are not read; an empty table gives an empty result.  Of examples with the same
    cosine the first in the index votes.  With no labelled example every score
    is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            got = _scores(model, batch.column(1))
            s = np.array([x[0] for x in got], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= FLAG).astype(np.int32)), pa.array([model.examples[x[3]].tolist() for x in got], pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>")


def keep_civil(docs: DataFrame, model: Neighbours, text_col: str = "text") -> DataFrame:
    """The rows that are not flagged, with all columns as given.  With no labelled example all stay."""
    if not len(model.labels):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([x[0] < FLAG for x in _scores(shared.value, batch.column(at))], pa.bool_()))

    return bound_batches(docs).mapInArrow(run, docs.schema)
