"""How alike two texts are by the blocks they share (Ratcliff-Obershelp), for whole columns at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import col

#: Cells of the tables of runs that are held at a time, about.
CELLS = 1 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in a padded table, and the lengths."""
    size = np.array([len(t) for t in texts])
    wide = max(1, int(size.max(initial=0)))
    return np.array(texts, f"U{wide}").view(np.uint32).reshape(len(texts), wide), size


def _longest(a: np.ndarray, b: np.ndarray, a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, and start in both texts, of the longest block in each row's two spans; of equal ones the first in ``a``, then in ``b``."""
    across = np.arange(int((b_high - b_low).max()))
    inside = across < (b_high - b_low)[:, None]
    part = np.take_along_axis(b, np.minimum(b_low[:, None] + across, b.shape[1] - 1), 1)
    rows = np.arange(len(a))
    run = np.zeros((len(a), len(across) + 1), np.int32)
    size, at_a, at_b = np.zeros(len(a), np.int64), a_low.copy(), b_low.copy()
    for i in range(int((a_high - a_low).max())):
        here = a[rows, np.minimum(a_low + i, a.shape[1] - 1)]
        same = (part == here[:, None]) & inside & (a_low + i < a_high)[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        end = run.argmax(1)
        top = run[rows, end]
        longer = top > size
        size = np.where(longer, top, size)
        at_a = np.where(longer, a_low + i + 1 - top, at_a)
        at_b = np.where(longer, b_low + end - top, at_b)
    return size, at_a, at_b


def block_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the characters in shared blocks over those of both texts: the longest block first, then those left and right of it; 1 for two empty texts.

    All pairs go on together: each round finds the longest block of every span
    that is still open.
    """
    (a, la), (b, lb) = _codes(left), _codes(right)
    matched = np.zeros(len(left), np.int64)
    pair, spans = np.arange(len(left)), np.stack((np.zeros_like(la), la, np.zeros_like(lb), lb))
    while True:
        live = (spans[1] > spans[0]) & (spans[3] > spans[2])
        pair, spans = pair[live], spans[:, live]
        if not len(pair):
            break
        size, at_a, at_b = _longest(a[pair], b[pair], *spans)
        np.add.at(matched, pair, size)
        found = size > 0
        pair, size, at_a, at_b, spans = pair[found], size[found], at_a[found], at_b[found], spans[:, found]
        before = np.stack((spans[0], at_a, spans[2], at_b))
        after = np.stack((at_a + size, spans[1], at_b + size, spans[3]))
        pair, spans = np.concatenate((pair, pair)), np.concatenate((before, after), axis=1)
    total = la + lb
    return np.divide(2.0 * matched, total, out=np.ones(len(left)), where=total > 0)


def block_ratio(a: Column | str, b: Column | str) -> Column:
    """``block_ratios`` of two columns; null where one is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        both = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        sizes = np.array([max(len(x.iloc[i]), len(y.iloc[i])) for i in both], np.int64)
        both = both[np.argsort(sizes, kind="stable")]  # texts of one length share a table
        sizes = np.sort(sizes)
        low = 0
        while low < len(both):
            high = low + 1
            while high < len(both) and (high - low + 1) * (sizes[high] + 1) <= CELLS:
                high += 1
            own = both[low:high]
            out.iloc[own] = block_ratios([x.iloc[i] for i in own], [y.iloc[i] for i in own])
            low = high
        return out.astype(object).where(out.notna(), None).astype("float64")

    return F.pandas_udf(run, "double")(col(a), col(b))


def grams(text: Column | str, size: int) -> Column:
    """All runs of ``size`` characters of a text, each with the number of equal ones before it, so that a multiset is a set."""
    whole = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(col(text), i, F.lit(size)))
    runs = F.when(F.length(text) >= size, whole).otherwise(F.expr("cast(array() as array<string>)"))
    return F.transform(runs, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(runs, 1, i), lambda y: y == x)).cast("string")))
