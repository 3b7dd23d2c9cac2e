"""Best-fit packing of tokenised documents, improved by swap-based local search."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, texts_of

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Pieces that one task packs. Each such group wastes less than a sequence more than packing all at once could.
GROUP = 20_000
#: Emptiest sequences in a row that the search may fail to empty before it ends.
PATIENCE = 24
#: Distinct words whose ids a task remembers, in two halves: when one is full, the other is forgotten.
MEMORY = 150_000

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?%$#&*|:;()+=@/-"
#: A run of western letters or of marks: one word of the tokenizer, stable under its normalisation but for case.
_PLAIN = re.compile(f"(?:[{_LETTERS}]+|[{_MARKS}]+)\\Z")
#: A mark after a western letter: the tokenizer begins a new word there, so a space before it changes no id.
_EDGE = re.compile(f"[{_MARKS}](?<=[{_LETTERS}].)")
_state: dict = {}


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts by a tokenizer whose tokens never cross a space or line feed.

    The ids of a text are those of its space-separated words in turn, so each
    distinct word is encoded once and remembered, in small letters and apart
    from the marks that follow it.  Plain words go straight to the tokenizer's
    merges; all others take its whole way.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_str(definition)
        self.model = self.inner.model
        self.symbols = _byte_symbols()
        self.added = [t.content.lower() for t in self.inner.get_added_tokens_decoder().values()]
        self.codes = [i.to_bytes(4, "little") for i in range(max(self.inner.get_vocab().values()) + 1)]
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if not _PLAIN.match(word):
            return np.array(self.inner.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        low = word.lower()
        if not low.isascii():
            low = low.encode("utf-8").decode("latin-1").translate(self.symbols)
        codes = self.codes
        return b"".join([codes[t.id] for t in self.model.tokenize(low)])

    def _words(self, text: str) -> list[str]:
        small = text.lower()
        if not any(t in small for t in self.added):  # those are found in the text as it is written
            try:
                text.encode("latin-1")
                text = small  # letter by letter there, as the tokenizer does; elsewhere a letter's place may matter
            except UnicodeEncodeError:
                pass
            text = _EDGE.sub(r" \g<0>", text)
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if 2 * len(self.known) > MEMORY:
            self.known, self.before = {"": b""}, self.known
        known, before = self.known, self.before
        words = [self._words(t) for t in texts]
        for w in set().union(*words).difference(known):
            got = before.get(w)
            known[w] = self._word(w) if got is None else got
        return [b"".join(map(known.__getitem__, ws)) for ws in words]


def _pieces(shared, capacity: int):
    def run(batches):
        if _state.get("definition") != shared.value:
            _state.update(definition=shared.value, tokenizer=WordTokenizer(shared.value))
        tokenizer, end = _state["tokenizer"], np.array([END], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for p in range(0, len(ids), 4 * capacity):
                        piece = ids[p : p + 4 * capacity]
                        rows.append((doc, p // (4 * capacity), p // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin per piece: longest first, each into the fullest bin with room."""
    bins = np.empty(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (room, bin) in order
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, n = capacity, n, n + 1
        bins[i] = b
        if left > size:
            insort(room, (left - size, b))
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, patience: int = PATIENCE) -> np.ndarray:
    """Empty bins by exchanges that increase the sum of squared fills.

    The emptiest bin gives: a piece moves to another bin with room, is swapped
    for a shorter piece of another bin, or two of its pieces are swapped for
    one.  Each exchange moves tokens into a bin at least as full, so the sum
    grows and the search ends.  It stops when the bins reach the lower bound
    or ``patience`` bins in a row can't be emptied.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    used, failed, stuck = int((fill > 0).sum()), 0, np.zeros(len(fill), bool)
    open_pieces = np.flatnonzero(fill[bins] < capacity)
    while used > least and failed < patience:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if len(open_bins) < 2:
            break
        giver = open_bins[np.argmin(fill[open_bins])]
        moved = True
        while moved and fill[giver]:
            moved = False
            own = open_pieces[bins[open_pieces] == giver]
            own = own[np.argsort(-lengths[own], kind="stable")]
            others = open_pieces[bins[open_pieces] != giver]
            room = capacity - fill[bins[others]]
            gives = [((int(i),), int(lengths[i])) for i in own] + [((int(i), int(j)), int(lengths[i] + lengths[j])) for x, i in enumerate(own[:12]) for j in own[x + 1 : 12]]
            free = np.flatnonzero((fill > 0) & (fill < capacity))
            free = free[free != giver]
            for pieces, size in gives:
                if len(pieces) == 1:
                    fits = free[capacity - fill[free] >= size]
                    if len(fits):  # a move, to the fullest bin with room
                        to = fits[np.argmax(fill[fits])]
                        bins[pieces[0]] = to
                        fill[giver] -= size
                        fill[to] += size
                        moved = True
                        break
                gain = size - lengths[others]
                ok = np.flatnonzero((gain > 0) & (gain <= room) & (fill[bins[others]] + gain > fill[giver]))
                if len(ok):  # a swap, that fills the most
                    best = others[ok[np.argmax(gain[ok])]]
                    to, more = bins[best], size - lengths[best]
                    bins[list(pieces)] = to
                    bins[best] = giver
                    fill[giver] -= more
                    fill[to] += more
                    moved = True
                    break
        if fill[giver]:
            stuck[giver] = True
            failed += 1
        else:
            used, failed = used - 1, 0
    return np.unique(bins, return_inverse=True)[1]


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32", "row"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(bins[order], bins[order])
        offset = np.empty(len(rows), np.int64)
        offset[order] = before - before[first]
        rows["sequence_id"] = rows["grp"].to_numpy() * np.int64(1 << 32) + bins
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of all pieces of all rows.

    A text's ids end with END; only those of more than ``capacity`` are cut.
    Null texts are empty and have the one id END; repeated rows, and rows with
    a null id, are packed each; other columns are not read; an empty table
    gives no sequence.  Groups of about GROUP pieces, dealt by a hash of the
    row, are packed side by side.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    json.loads(definition)
    shared = spark.sparkContext.broadcast(definition)
    texts = texts_of(docs, id_col, text_col)
    pieces = materialize(texts.mapInArrow(_pieces(shared, capacity), "doc_id long, piece long, start long, length long, ids_crc32 long"), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(_pack(capacity), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
