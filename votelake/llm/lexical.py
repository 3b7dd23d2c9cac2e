"""Ranked lexical search: the best documents for every item, by integer BM25 scores.

Documents are restricted to the words of the items.  What is left of a text is
a bag: the numbers of its terms with their frequencies.  Documents with the
same bag and the same length factor have the same score for every item, so
they form a class.  Each class is scored once, and only the best classes are
expanded to their members, smallest ids first.

Terms are the maximal runs of letters, digits and characters beyond ASCII;
only A-Z are lower-cased.  Null and empty texts have no term and no rank, nor
has a document without a word of the item.  A row that repeats another is a
document of its own; of equal scores the smaller id comes first, a null id
last.  An item's rows with the same id and text count once, and rows with one
id and different texts are ranked each.  Whole texts are read; a very long one
costs a task a few copies of its bytes.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize, texts_of
from .vectext import NON_ALNUM, blocks, utf8

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pairs of item and term whose index is sent to the tasks at a time; more items are further passes.
BLOCK_PAIRS = 1 << 18
#: Scores, and products summed into them, that a task holds at a time.
SCORES, PRODUCTS = 1 << 21, 1 << 21
#: Stands for a null id in the order of ids.
NO_ID = (1 << 63) - 1

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, of, term, times)``: how often each item has each of its terms; ``of`` tells texts of one id apart."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    listed = rows.select("item_id", F.md5("text").alias("of"), found.alias("found"))  # one digest an item, not one a term
    return listed.select("item_id", "of", F.explode("found").alias("term")).groupBy("item_id", "of", "term").agg(F.count("*").alias("times"))


def _in_blocks(terms: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """``terms`` with a block number so that no block has more than ``bound`` rows, unless one item alone does."""
    n, most = 1, terms.count()
    while most > bound:
        n *= 2
        block = F.pmod(F.xxhash64("item_id", "of"), F.lit(n))
        sizes = terms.groupBy("item_id", "of").agg(F.count("*").alias("n")).groupBy(block.alias("b")).agg(F.sum("n").alias("n"), F.max("n").alias("one"))
        most = sizes.where("n > one").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return terms.withColumn("block", F.pmod(F.xxhash64("item_id", "of"), F.lit(n))), n


class Vocabulary:
    """Finds terms by a 64-bit hash and verifies every hit by its bytes."""

    def __init__(self, terms: list[str]):
        texts = pa.array(terms, pa.string())
        hashes = np.concatenate([w.hashes for _, _, w in blocks(texts, NON_ALNUM)] or [np.zeros(0, np.uint64)])
        if len(hashes) != len(terms) or len(np.unique(hashes)) != len(terms):
            raise ValueError("terms must be single distinct words with distinct hashes")
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        self.data, self.offsets = utf8(texts)

    def find(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and of these the terms' numbers."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[near] == hashes)
        term = self.order[near[at]]
        begin, size = starts[at], ends[at] - starts[at]
        good = size == self.offsets[term + 1] - self.offsets[term]
        at, term, begin, size = at[good], term[good], begin[good], size[good]
        first = np.concatenate(([0], np.cumsum(size)))
        step = np.arange(first[-1]) - np.repeat(first[:-1], size)
        same = _LOWERED[data[step + np.repeat(begin, size)]] == self.data[step + np.repeat(self.offsets[term], size)]
        wrong = np.concatenate(([0], np.cumsum(~same)))
        true = wrong[first[1:]] == wrong[first[:-1]]
        return at[true], term[true]


def _bags(vocabulary) -> object:
    """A task that turns ``(doc_id, text)`` into ``(doc_id, n, bag)``, documents with a term only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        size = max(len(known.order), 1)
        for batch in batches:
            texts = batch.column("text")
            data, offsets = utf8(texts)
            for row, end, words in blocks(texts, NON_ALNUM):
                n = np.diff(words.first)
                at, term = known.find(words.hashes, words.starts, words.ends, data[offsets[row] : offsets[end]])
                doc = np.searchsorted(words.first, at, "right") - 1
                keys, times = np.unique(doc * size + term, return_counts=True)
                pairs = np.stack((keys % size, times), 1).astype("<i4")
                begin = (8 * np.searchsorted(keys, np.arange(len(n) + 1) * size)).astype(np.int32)
                bag = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(begin.tobytes()), pa.py_buffer(pairs.tobytes())])
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([x.filter(some) for x in (batch.column("doc_id").slice(row, end - row), pa.array(n, pa.int64()), bag)], names=["doc_id", "n", "bag"])

    return run


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and frequencies of a column of bags, and where each bag begins (one closing entry)."""
    offsets = np.frombuffer(bags.buffers()[1], np.int32)[bags.offset : bags.offset + len(bags) + 1]
    flat = np.frombuffer(bags.buffers()[2] or b"", "<i4", count=offsets[-1] // 4)[offsets[0] // 4 :].reshape(-1, 2)
    return flat[:, 0], flat[:, 1].astype(np.int64), (offsets - offsets[0]) // 8


def _frequencies(n_terms: int) -> object:
    """A task that counts in how many bags each term is, in one row per term it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            term, _, _ = _pairs(batch.column("bag"))
            total += np.bincount(term, minlength=n_terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["term", "df"])

    return run


class Scorer:
    """Scores bags for all items of a block by the items' inverted lists, and keeps the best classes of each."""

    def __init__(self, n_items: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.n_items, self.item, self.weight = n_items, item[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        #: sums of doubles are exact below 2^53
        self.exact = float(np.bincount(item, weight, n_items).max(initial=0)) * 1e6 < 2.0**53

    def scores(self, bags: pa.Array, m: np.ndarray) -> np.ndarray:
        """Scores of every item (rows) for every bag (columns)."""
        term, tf, begin = _pairs(bags)
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(begin)))
        lists = self.first[term + 1] - self.first[term]
        column = np.repeat(np.arange(len(m)), np.diff(begin))
        out = np.zeros(self.n_items * len(m), np.int64)
        ends = np.cumsum(lists)
        low = 0
        while low < len(term):
            high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PRODUCTS, "right")), low + 1)
            n = lists[low:high]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[term[low:high]], n)
            key = self.item[at] * len(m) + np.repeat(column[low:high], n)
            value = self.weight[at] * np.repeat(part[low:high], n)
            if self.exact:
                out += np.bincount(key, value, len(out)).astype(np.int64)
            else:
                np.add.at(out, key, value)
            low = high
        return out.reshape(self.n_items, len(m))


def _best(scorer, ids: list, keys: list, k: int) -> object:
    """A task that yields for each item the ``k`` best classes it met: score, then smallest member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = scorer.value
        score = np.zeros((s.n_items, k), np.int64)
        first = np.full((s.n_items, k), NO_ID)
        number = np.full((s.n_items, k), -1)
        members: dict[int, list] = {}
        seen = 0
        for batch in batches:
            step = max(SCORES // max(s.n_items, 1), 1)
            for a in range(0, batch.num_rows, step):
                own = batch.slice(a, step)
                lists = own.column("members")
                low = np.array([x[0].as_py() for x in lists], np.int64)
                new = s.scores(own.column("bag"), own.column("m").to_numpy())
                rank = np.empty(len(low), np.int64)
                rank[np.argsort(low, kind="stable")] = np.arange(len(low))
                top = min(k, len(low))
                key = new * len(low) + (len(low) - 1 - rank)  # one number: score, then the smaller id
                take = np.argpartition(key, len(low) - top, axis=1)[:, len(low) - top :]
                score = np.hstack((score, np.take_along_axis(new, take, 1)))
                first = np.hstack((first, low[take]))
                number = np.hstack((number, take + seen))
                order = np.lexsort((first, -score), axis=1)[:, :k]
                score, first, number = (np.take_along_axis(x, order, 1) for x in (score, first, number))
                number[score <= 0] = -1
                used = set(number.ravel().tolist()) - {-1}
                members = {i: members[i] if i < seen else lists[i - seen].as_py() for i in used}
                seen += len(low)
        item, place = np.nonzero(number >= 0)
        columns = [
            pa.array([ids[i] for i in item], pa.int64()),
            pa.array([keys[i] for i in item], pa.string()),
            pa.array(score[item, place]),
            pa.array([members[i] for i in number[item, place]], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "of", "score", "members"])

    return run


def classes_of(bags: DataFrame, k: int) -> DataFrame:
    """``(m, bag, members)``: one row per distinct bag with its length factor, and its ``k`` smallest ids in order.

    Rows meet by a hash and are verified by the bag itself.  Spark keeps the
    ``k`` smallest ids of a class in each task before the shuffle, so a class
    that very many documents share is never gathered.
    """
    keys = ["h", "m", "bag"]
    own = bags.where("length(bag) > 0").select(F.xxhash64("m", "bag").alias("h"), "m", "bag", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    near = own.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))).where(F.col("r") <= k)
    return near.groupBy(*keys).agg(F.sort_array(F.collect_list("doc_id")).alias("members")).drop("h")


def _search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The best ``k`` documents of the items of one block, written; ``terms`` has at most BLOCK_PAIRS rows or one item."""
    spark = docs.sparkSession
    table = terms.select("item_id", "of", "term", "times").toPandas()
    words, term = np.unique(table["term"].to_numpy(str), return_inverse=True) if len(table) else (np.zeros(0, str), np.zeros(0, int))
    named = table[["item_id", "of"]].astype(object)
    which = {who: i for i, who in enumerate(dict.fromkeys((None if i != i else int(i), of) for i, of in named.itertuples(index=False)))}
    item = np.array([which[None if i != i else int(i), of] for i, of in named.itertuples(index=False)], np.int64)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(list(words)))
    bags = materialize(docs.mapInArrow(_bags(vocabulary), "doc_id long, n long, bag binary"), "bags")
    n_docs, length = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for t, n in bags.select("bag").mapInArrow(_frequencies(len(words)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    scorer = spark.sparkContext.broadcast(Scorer(len(which), item, term, weight[term] * table["times"].to_numpy(np.int64), len(words)))
    factor = F.expr(f"25 + (CAST(n AS DECIMAL(19,0)) * CAST({75 * n_docs} AS DECIMAL(19,0))) div {max(length, 1)}")
    scored = classes_of(bags.withColumn("m", factor), k).mapInArrow(_best(scorer, [i for i, _ in which], [o for _, o in which], k), "item_id long, of string, score long, members array<long>")
    one = Window.partitionBy("item_id", "of").orderBy(F.desc("score"), "doc_id")
    ranked = scored.select("item_id", "of", "score", F.explode("members").alias("doc_id")).withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k)
    out = materialize(ranked.select("item_id", F.col("rank").cast("int"), F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "score"), "ranked")
    discard(bags)
    vocabulary.unpersist()
    scorer.unpersist()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0.

    With N documents that have a term, L terms in all of them, n in one, df
    documents with a term and tf of it in one, a term's weight w is
    floor(1000 ln((2N+2)/(2df+1))) and a document's m is 25 + 75nN div L; the
    score sums w times (10^9 tf) div (1000 tf + 8m) over the item's terms,
    repeats included.

    The items' index is sent to the tasks, in blocks of BLOCK_PAIRS pairs of
    item and term; each block reads the documents once.
    """
    terms = materialize(item_terms(items), "item-terms")
    parted, n = _in_blocks(terms, BLOCK_PAIRS)
    texts = texts_of(docs)
    out: DataFrame | None = None
    for b in range(n):
        found = _search_block(texts, parted.where(F.col("block") == b), k)
        out = found if out is None else out.unionByName(found)
    discard(terms)
    assert out is not None
    return out
