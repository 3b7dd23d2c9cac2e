"""Vectorised word and shingle hashing over Arrow string buffers.

The functions here run inside Arrow tasks.  They never build a Python string
per word: an Arrow batch is cut into blocks of whole documents, and one pass
of numpy over the UTF-8 bytes of a block yields a 64-bit hash per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; a longer document is one block of its own.
BLOCK_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = int(_RNG.integers(2**61, 2**62)) * 8 + 5
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M64 = (1 << 64) - 1

#: Bytes that end a word: the space and \\x09-\\x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: Every ASCII byte that is neither letter nor digit ends a word.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES), base & _M64, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a block of documents.

    ``hashes`` has one 64-bit value per word in reading order, ``first`` the
    index of each document's first word (with one closing entry), ``starts``
    and ``ends`` the byte span of each word from the block's beginning, and
    ``begin`` the byte at which each document begins.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, separators: np.ndarray):
        word = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[begin] = True  # documents touch in the buffer: no word crosses
        before = np.concatenate(([False], word[:-1])) if len(word) else word
        self.begin = begin[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate((word[1:], [False])) if len(word) else word
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        if len(data):
            np.cumsum(_BYTE[data] * _power(_BASE, len(data), "up"), out=total[1:])
        self._total = total
        self._down = _power(pow(_BASE, -1, 1 << 64), len(data) + 1, "down")
        self.hashes = self._span(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, begin)
        self.n_docs = len(begin) - 1

    def _span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._total[b] - self._total[a]) * self._down[a])

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``k`` bytes of the words longer than that, and these words' indices."""
        at = np.flatnonzero(self.ends - self.starts > k)
        a = self.starts[at]
        return self._span(a, a + k) ^ _LANES[k], at

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` bytes inside words, and where each document's begin."""
        n = np.maximum(self.ends - self.starts - k + 1, 0)
        where = np.concatenate(([0], np.cumsum(n)))
        a = np.arange(where[-1]) + np.repeat(self.starts - where[:-1], n)
        return self._span(a, a + k) ^ _LANES[20 + k], where[self.first]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words that lie in one document, and where each document's begin.

        A document of one to ``k - 1`` words has one shingle, its whole sequence.
        """
        counts = np.diff(self.first)
        n = len(self.hashes)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(self.n_docs + 1, np.int64)
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc[: n - j] += self.hashes[j:] * _LANES[j]
        long = counts >= k
        keep = np.zeros(n, bool)
        sizes = np.where(long, counts - k + 1, (counts > 0).astype(np.int64))
        doc = np.repeat(np.arange(self.n_docs), counts)
        at = np.arange(n) - self.first[:-1][doc]
        keep[:] = at < sizes[doc]
        for d in np.flatnonzero(~long & (counts > 0)):
            a, b = self.first[d], self.first[d + 1]
            acc[a] = np.append(self.hashes[a:b] * _LANES[: b - a], _LANES[40 + b - a]).sum(dtype=np.uint64)
        return mix(acc[keep]), np.concatenate(([0], np.cumsum(sizes)))


def blocks(texts: pa.Array, separators: np.ndarray = BLANKS) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of blocks of whole documents; a null text is empty."""
    data, offsets = utf8(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], separators)
        row = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one closing entry); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_doc(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring entries of ``begin``; 0 where they are equal."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[begin[1:]] - total[begin[:-1]]
