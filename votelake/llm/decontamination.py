"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

A benchmark item of ``m`` word shingles is looked for in windows of ``m``
shingles of every document.  A window's SimHash of BITS bits is looked up in one
table per block of its bits; with the keys near each item's own in every block,
all items within ``RADIUS`` bits are found (pigeonhole), and about a quarter of
all others, which the whole fingerprint rules out.  Candidates are decided by the
exact weighted Jaccard similarity of the shingle sets.  A window without any
shingle of the benchmark has similarity 0 with every item, so fingerprints are
taken only where a shingle of the benchmark lies in the window.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .storage import ids_to_join, texts_of

#: Words of a shingle, and the similarity from which a window matches an item.
WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, bits in which two may differ, and blocks they are cut into. At similarity 0.8 about 19 of 128 bits differ, with a deviation of 4.
BITS, RADIUS, PARTS = 128, 32, 11
#: Items that one pass over the documents looks for; more items are looked for in further passes.
ITEMS = 5000

_WORD = np.arange(64, dtype=np.uint64)


def _cuts() -> list[tuple[int, int]]:
    edges = [round(i * BITS / PARTS) for i in range(PARTS + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits ``a`` to ``b`` of fingerprints, rows of 64-bit words."""
    word, at = divmod(a, 64)
    own = prints[:, word] >> np.uint64(at)
    if b > (word + 1) * 64:
        own = own | prints[:, word + 1] << np.uint64(64 - at)
    return own & np.uint64((1 << (b - a)) - 1)


def simhash(hashes: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all runs of ``length`` entries, rows of BITS / 64 words."""
    out = []
    for k in range(BITS // 64):
        own = vectext.mix(hashes + np.uint64(k)) if k else hashes
        sign = ((own[:, None] >> _WORD) & np.uint64(1)).astype(np.float64) * 2 - 1
        total = np.concatenate((np.zeros((1, 64)), np.cumsum(sign * weights[:, None], axis=0)))
        out.append(((total[length:] - total[:-length] > 0).astype(np.uint64) << _WORD).sum(axis=1, dtype=np.uint64))
    return np.column_stack(out)


@dataclass
class Counts:
    """Items of one shingle size in the whole benchmark, their shingles that several have (sorted), and how many have each."""

    items: int
    shared: np.ndarray
    df: np.ndarray


class Index:
    """The items of a block that have ``words`` words to a shingle; ``counts`` are those of the whole benchmark, which ``items`` are if not given."""

    def __init__(self, words: int, items: list[tuple[int | None, np.ndarray]], counts: Counts | None = None):
        self.words, self.ids = words, [i for i, _ in items]
        self.keys, df = np.unique(np.concatenate([np.unique(h) for _, h in items]), return_counts=True)
        counts = counts or Counts(len(items), self.keys, df)
        self.default = float(np.log(1 + counts.items))  # of a shingle that no item has; as of one that one item has
        self.shared, self.shared_weights = counts.shared, np.log(1 + counts.items / counts.df)
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.sets = [np.unique(h) for _, h in items]
        self.set_weights = [float(self.weigh(s).sum()) for s in self.sets]
        self.lengths = [len(h) for _, h in items]
        self.prints = np.array([simhash(h, self.weigh(h), len(h))[0] for _, h in items], np.uint64).reshape(-1, BITS // 64)
        self.owners: dict[int, list[int]] = defaultdict(list)
        for k, s in enumerate(self.sets):
            for h in s.tolist():
                self.owners[h].append(k)
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # per block: sorted keys near an item's own, and the items
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, length in enumerate(self.lengths):
            by_length[length].append(k)
        for length, own in by_length.items():
            tables = self.tables[length] = []
            for a, b in _cuts():
                flips = np.array([sum(1 << f for f in some) for r in range(RADIUS // PARTS + 1) for some in combinations(range(b - a), r)], np.uint64)
                keys = (_block(self.prints[own], a, b)[:, None] ^ flips).ravel().astype(np.uint16 if b - a <= 16 else np.uint64)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], np.repeat(np.array(own, np.int32), len(flips))[order]))

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.shared, hashes)
        at[at == len(self.shared)] = 0
        return np.where(self.shared[at] == hashes, self.shared_weights[at], self.default) if len(self.shared) else np.full(len(hashes), self.default)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the benchmark's shingles."""
        near = np.flatnonzero(self.hint[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[near])
        at[at == len(self.keys)] = 0
        return near[self.keys[at] == hashes[near]]

    def candidates(self, length: int, prints: np.ndarray) -> dict[int, np.ndarray]:
        """Items of ``length`` shingles within RADIUS bits, and the windows that are."""
        found = {}
        for k in self.retrieved(length, prints).tolist():
            ok = np.flatnonzero(np.bitwise_count(prints ^ self.prints[k]).sum(axis=1) <= RADIUS)
            if len(ok):
                found[k] = ok
        return found

    def retrieved(self, length: int, prints: np.ndarray) -> np.ndarray:
        """Items of ``length`` shingles that share a near key of some block with one of the windows: all within RADIUS bits, and a part of the others."""
        near = np.zeros(len(self.ids), bool)
        for (a, b), (keys, items) in zip(_cuts(), self.tables[length]):
            own = np.unique(_block(prints, a, b)).astype(keys.dtype)
            for lo, hi in zip(np.searchsorted(keys, own, "left").tolist(), np.searchsorted(keys, own, "right").tolist()):
                near[items[lo:hi]] = True
        return np.flatnonzero(near)

    def best(self, k: int, hashes: np.ndarray, starts: np.ndarray, length: int) -> tuple[float, int]:
        """The highest similarity of item ``k`` to a window at ``starts`` and the first window that has it."""
        own = self.sets[k]
        at = np.searchsorted(own, hashes)
        at[at == len(own)] = 0
        shared = np.concatenate(([0.0], np.cumsum(np.where(own[at] == hashes, self.weigh(hashes), 0.0))))
        bound = np.minimum(shared[starts + length] - shared[starts], self.set_weights[k]) / self.set_weights[k]
        top, where = 0.0, -1
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] + 1e-12 < max(top, SIMILARITY):
                break
            window = np.unique(hashes[starts[i] : starts[i] + length])
            both = float(self.weigh(np.intersect1d(window, own, assume_unique=True)).sum())
            s = both / (self.set_weights[k] + float(self.weigh(window).sum()) - both)
            if s > top + 1e-12:
                top, where = s, int(starts[i])
        return top, where

    def search(self, hashes: np.ndarray, hits: np.ndarray):
        """(item position, similarity, first shingle of the window) of one document's matches."""
        wanted: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for length in {self.lengths[k] for k in self.owners[int(hashes[p])]}:
                wanted[length].append(p)
        for length, at in wanted.items():
            if len(hashes) <= length:
                starts, size = np.zeros(1, np.int64), len(hashes)
            else:
                p, size = np.array(at), length
                lo, hi = np.maximum(p - length + 1, 0), np.minimum(p, len(hashes) - length)
                mark = np.zeros(len(hashes) - length + 2, np.int64)
                np.add.at(mark, lo, 1)
                np.add.at(mark, hi + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            found: dict[int, list[np.ndarray]] = defaultdict(list)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > length) + 1):
                for some in np.array_split(part, -(-len(part) // 4096)):
                    a, b = int(some[0]), int(some[-1]) + size
                    prints = simhash(hashes[a:b], self.weigh(hashes[a:b]), size)[some - a]
                    for k, ok in self.candidates(length, prints).items():
                        found[k].append(some[ok])
            for k, some in found.items():
                s, where = self.best(k, hashes, np.concatenate(some), size)
                if s >= SIMILARITY - 1e-12:
                    yield k, s, where


def _shingled(items: pa.Array):
    """(shingle size, position, shingles) of every item with words: one of fewer than WORDS words is one shingle of all its words."""
    for a, b, words in vectext.blocks(pc.utf8_lower(items), vectext.NON_ALNUM):
        counts = np.diff(words.first)
        for k in range(1, WORDS + 1):
            some = [i for i in range(b - a) if min(counts[i], WORDS) == k]
            if some:
                h, first = words.shingles(k)
                for i in some:
                    yield k, a + i, h[first[i] : first[i + 1]]


def _counts(items: DataFrame) -> dict[int, Counts]:
    """Per shingle size, over all rows of ``items(i, t)`` in one grouped count; the driver receives shingles that several items have."""

    def emit(batches):  # one row per item and distinct shingle, and one without a shingle per item
        for batch in batches:
            sizes, own = [], []
            for k, _, h in _shingled(batch.column(0)):
                own.append(np.unique(h))
                sizes.append((k, len(own[-1])))
            k = np.repeat([x for x, _ in sizes], [n for _, n in sizes]).astype(np.int32)
            hashes = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(hashes)], names=["k", "shingle"])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sizes], pa.int32()), pa.nulls(len(sizes), pa.int64())], names=["k", "shingle"])

    counted = items.select("t").mapInArrow(emit, "k int, shingle long").groupBy("k", "shingle").agg(F.count("*").alias("df"))
    got = counted.where("shingle is null or df > 1").toArrow()
    sizes, hashes, df = (got.column(c) for c in ("k", "shingle", "df"))
    none = pc.is_null(hashes)
    totals = dict(zip(sizes.filter(none).to_pylist(), df.filter(none).to_pylist()))
    out = {}
    for k, n in totals.items():
        own = pc.and_(pc.equal(sizes, k), pc.invert(none))
        h, d = hashes.filter(own).to_numpy().astype(np.int64).view(np.uint64), df.filter(own).to_numpy().astype(float)
        order = np.argsort(h)
        out[k] = Counts(n, h[order], d[order])
    return out


def _index(items: list[tuple[int | None, str]], counts: dict[int, Counts]) -> list[Index]:
    """One index per shingle size."""
    by_size: dict[int, list[tuple[int | None, np.ndarray]]] = defaultdict(list)
    for k, at, h in _shingled(pa.array([t for _, t in items], pa.string())):
        by_size[k].append((items[at][0], h))
    return [Index(k, own, counts[k]) for k, own in sorted(by_size.items())]


def _scan(shared):
    def run(batches):
        for batch in batches:
            out = []
            texts = pc.utf8_lower(pc.fill_null(batch.column(1), ""))
            for a, _, words in vectext.blocks(texts, vectext.NON_ALNUM):
                for index in shared.value:
                    hashes, first = words.shingles(index.words)
                    hits = index.hits(hashes)
                    docs = np.searchsorted(first, hits, "right") - 1
                    for d in np.unique(docs):
                        if words.first[d + 1] - words.first[d] < index.words:
                            continue  # fewer words than the shingle
                        own = hits[docs == d] - first[d]
                        for k, s, where in index.search(hashes[first[d] : first[d + 1]], own):
                            out.append((batch.column(0)[int(a + d)].as_py(), index.ids[k], s, where))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], names=["doc_id", "item_id", "similarity", "first_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, first_word)``: every document and benchmark item with a window of similarity SIMILARITY or more.

    The best window is given, by its similarity and first word (from 0).
    Shingles have WORDS words in lower case, and weigh less the more items
    of the whole benchmark have them.  Null texts are empty; empty texts and
    items match nothing; of repeated rows each gives its matches; rows with a
    null document or item id are searched like any other.  The benchmark is
    read in blocks of ITEMS items in order of their ids, each broadcast for one
    pass over the documents with the counts of shingles that several items have.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    schema = "doc_id long, item_id long, similarity double, first_word long"
    found, block = None, []
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null").distinct()
    counts = _counts(rows)

    def search(items):
        return texts.mapInArrow(_scan(spark.sparkContext.broadcast(_index(items, counts))), schema)

    for r in rows.orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        if len(block) == ITEMS:
            found, block = search(block) if found is None else found.unionByName(search(block)), []
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The documents without a match, with all columns as given; rows with a null id stay."""
    bad = contaminated(docs, benchmark, id_col, **columns).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(ids_to_join(bad, "contaminated"), id_col, "left_anti").select(*docs.columns)
