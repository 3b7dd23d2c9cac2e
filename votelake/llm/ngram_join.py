"""N-gram Jaccard join by a prefix tree over globally ordered shingle sets.

A document's set holds its distinct 4-word shingles.  All sets are sorted by
one global order (rare shingles first), so two sets that are similar enough
share one of their first few shingles, at a position that leaves room for the
overlap they need.  Those shared shingles name the candidates.  The candidates
of a block are stored in one prefix tree that all its queries walk: shingles
that several candidates begin with are matched once, and a subtree is left as
soon as no size below it fits, or what remains below it cannot supply the
missing overlap.

Before a set is sent to a block, the 512-bit sketches of two whole sets decide
whether these can be similar, so that sets that only share some shingles don't
come into one block.

Equal sets collapse to one representative before anything is paired, and pairs
whose ends are already connected are not compared again: the result is the
partition into components, which needs no more than that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .components import connected_components
from .storage import discard, ids_to_join, materialize, texts_of

#: A shingle is ordered by its frequency if one in so many documents of a block holds it.
SUPPORT = 2000
#: Frequent shingles that are sent to the tasks; the most frequent are kept. Which of them are sent changes speed, never the result.
MAX_FREQUENT = 1 << 20
#: Rows of one shingle that a task looks at together; a larger group passes on unexamined.
GROUP_ROWS = 4096
#: Shingles of a block of documents whose frequent shingles are counted together.
BLOCK_SHINGLES = 1 << 20
#: Shingles of one prefix tree of a query's candidates; more are split over several trees.
TREE_SHINGLES = 1 << 21
#: Rows of a shingle that one task compares with each other; the rows of a larger group meet in blocks.
PAIRED = 400
#: Pairs that are looked at together.
PAIRS = 1 << 18
#: 64-bit words of a set's sketch, by which pairs are ruled out before their sets are sent anywhere.
SKETCH = 8
#: A similar pair is ruled out by chance with a probability below e to the minus this, about 10^-20.
CERTAIN = 46
#: Members and queries of a block, about.
MEMBERS, QUERIES = 256, 1024


SKETCHED = [f"m{w}" for w in range(SKETCH)]


def _need(n1, n2, num: int, den: int):
    """The least overlap that makes intersection / union >= num / den."""
    return -(-num * (n1 + n2) // (num + den))


def _ranked(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, by frequency (unlisted ones count as 0), then by hash; and the frequencies."""
    keys, counts = frequent
    if not len(keys):
        return shingles, np.zeros(len(shingles), np.int64)
    at = np.searchsorted(keys, shingles)
    at[at == len(keys)] = 0
    rank = np.where(keys[at] == shingles, counts[at], 0)
    order = np.argsort(rank, kind="stable")
    return shingles[order], rank[order]


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: of its smallest shingle in each of 64 * SKETCH bins by hash one bit, 0 in an empty bin."""
    bits = np.zeros(64 * SKETCH, np.uint8)
    back = shingles[::-1]  # of what is assigned to a bin the last stays
    bits[(back % np.uint64(64 * SKETCH)).astype(np.int64)] = (back >> np.uint64(20)).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _most_differing(num: int, den: int) -> int:
    """Bits in which the sketches of two similar sets differ, at most.

    A bin can differ only if its smallest shingle in the union is not common,
    and then does so by half of all hashes: that is 64 * SKETCH draws of
    probability (1 - num / den) / 2 at most, and Chernoff's bound on their sum.
    """
    bins, q = 64 * SKETCH, (1 - num / den) / 2
    for h in range(math.ceil(bins * q), bins):
        x = h / bins
        if x > q and bins * (x * math.log(x / q) + (1 - x) * math.log((1 - x) / (1 - q))) >= CERTAIN if q else True:
            return h
    return bins


def _place(shingle: int, rank: int) -> int:
    """A number that grows with the global order; places that it can't tell apart are equal."""
    return min(rank, 0xFFFF) << 47 | (shingle >> 17 if rank < 0xFFFF else 0)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(row, sorted distinct shingle hashes, two 64-bit halves of the set's key)."""
    for row, end, words in vectext.blocks(batch.column(1)):
        hashes, first = words.shingles(n)
        for i in range(end - row):
            s = np.unique(hashes[first[i] : first[i + 1]])
            yield row + i, s, int(s.sum(dtype=np.uint64).view(np.int64)), int(vectext.mix(s).sum(dtype=np.uint64).view(np.int64))


def _keys(n: int):
    """Rows ``(doc_id, n, k1, k2, seen, m0, ...)``: one per document with its set's sketch, and one per shingle frequent in a block (``doc_id`` null)."""
    names = ["doc_id", "n", "k1", "k2", "seen"]

    def run(batches):
        for batch in batches:
            ids, out, sketches, many, block, known, held = batch.column(0).to_pylist(), [], [], [], [], set(), 0
            for i, s, k1, k2 in _sets(batch, n):
                out.append((ids[i], len(s), k1, k2, None))
                sketches.append(_sketch(s))
                if len(s) and (k1, k2) not in known:
                    known.add((k1, k2))
                    block.append(s)
                    held += len(s)
                if held >= BLOCK_SHINGLES:
                    many += often(block)
                    block, known, held = [], set(), 0
            many += often(block)
            words = [pa.array([*w, *[None] * len(many)], pa.int64()) for w in (np.stack(sketches).T.tolist() if sketches else [[]] * SKETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, *many) if out else [[]] * 5)] + words, names=[*names, *SKETCHED])

    def often(block):
        if not block:
            return []
        shingles, seen = np.unique(np.concatenate(block), return_counts=True)
        many = seen >= max(3, len(block) // SUPPORT)
        return [(None, None, k, None, c) for k, c in zip(shingles[many].view(np.int64).tolist(), seen[many].tolist())]

    return run


def _prefixes(n: int, num: int, den: int, frequent):
    """Rows ``(token, k1, np, e)`` for the first shingles of a set, by which it meets any similar one; equal sets of a batch give one.

    Among the sets that have a token, the first half of the key tells them
    apart.  ``np`` is the set's size and, in the lower half, the shingle's position; ``e`` is the place in the global order where the first shingles end.
    """

    def run(batches):
        keys, counts = frequent.value
        for batch in batches:
            known, parts = set(), []
            for _, s, k1, k2 in _sets(batch, n):
                if len(s) and (k1, k2) not in known:
                    known.add((k1, k2))
                    size = len(s)
                    length = size - (-(-num * size // den)) + 1
                    own, rank = _ranked(s, (keys, counts))
                    parts.append((own[:length], k1, size, _place(int(own[length - 1]), int(rank[length - 1]))))
            lengths = [len(x[0]) for x in parts]
            column = lambda k: np.repeat(np.array([x[k] for x in parts], np.int64), lengths)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in parts]).view(np.int64)), pa.array(column(1)), pa.array(column(2) << 32 | np.concatenate([np.arange(k) for k in lengths])), pa.array(column(3))], names=["token", "k1", "np", "e"])

    return run


def _meetings(num: int, den: int):
    """Of rows sorted by ``token, np, k1``: those whose token another set has too, with the smallest possible partner as pivot.

    A partner is possible if both sizes and both positions leave room for the
    overlap that the pair needs.
    """

    def group(t, k1, both, e):
        new = np.ones(len(t), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (both[1:] != both[:-1])
        t, k1, both, e = t[new], k1[new], both[new], e[new]
        n, p = both >> 32, both & 0xFFFFFFFF
        if len(t) < 2:
            return None
        pivot = np.full(len(t), -1)
        left = n - p
        for i in np.flatnonzero(left >= _need(n, n, num, den)):
            j = np.arange(i + 1, np.searchsorted(n, n[i] * den // num, "right"))
            j = j[(pivot[j] < 0) & (np.minimum(left[i], left[j]) >= _need(n[i], n[j], num, den))]
            pivot[j] = i
        q = np.maximum(pivot, 0)
        return [t, k1, both, e, k1[q], n[q], pivot >= 0]

    def emit(groups):
        if groups:
            cols = [np.concatenate(x) for x in zip(*groups)]
            none = ~cols[6]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols[:4]] + [pa.array(cols[4], mask=none), pa.array(cols[5], mask=none)], names=["token", "k1", "np", "e", "q1", "qn"])

    def run(batches):
        held: list[np.ndarray] = []  # the rows of the token that is still open, or its first row once it is too large to hold
        wide = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            out = []
            if held and held[0][0] == cols[0][0]:
                a = int(np.searchsorted(cols[0], cols[0][0], "right"))
            else:
                a = 0
            if a and wide:
                new = [c[:a] for c in cols]
                m = len(new[0])
                out.append([*new, np.full(m, held[1][0]), np.full(m, held[2][0] >> 32), (new[2] >> 32) * num <= (held[2][0] >> 32) * den])
            elif a:
                held = [np.concatenate((h, c[:a])) for h, c in zip(held, cols)]
                if len(held[0]) > GROUP_ROWS:
                    m, wide = len(held[0]), True
                    out.append([*held, np.full(m, held[1][0]), np.full(m, held[2][0] >> 32), (held[2] >> 32) * num <= (held[2][0] >> 32) * den])
                    held = [h[:1] for h in held]
            if a < batch.num_rows:  # the open token ends here
                if held and not wide:
                    out.append(group(*held))
                t = cols[0]
                cuts = np.concatenate(([a], a + 1 + np.flatnonzero(t[a + 1 :] != t[a:-1]), [len(t)]))
                for g in np.flatnonzero(np.diff(cuts[:-1]) > 1):
                    out.append(group(*(c[cuts[g] : cuts[g + 1]] for c in cols)))
                held, wide = [c[cuts[-2] :].copy() for c in cols], False
            yield from emit([x for x in out if x])
        if held and not wide:
            last = group(*held)
            yield from emit([last] if last else [])

    return run


class PrefixTree:
    """Sets in the global order, stored as a trie: sets with a common beginning share its nodes.

    A node holds the entries from ``begin`` to ``end`` of the sequences below
    it, the smallest and largest size among them, and the sets that end there.
    """

    def __init__(self, members: list[np.ndarray]):
        self.members = members
        order = sorted((i for i in range(len(members)) if len(members[i])), key=lambda i: members[i].byteswap().tobytes())
        own = [members[i] for i in order]
        same = [0] * len(order)  # entries that a sequence shares with the one before it
        for k in range(1, len(order)):
            m = min(len(own[k - 1]), len(own[k]))
            differ = np.flatnonzero(own[k - 1][:m] != own[k][:m])
            same[k] = int(differ[0]) if len(differ) else m
        same = np.array(same, np.int64)
        sizes = np.array([len(x) for x in own], np.int64)
        # begin, end, a set that runs through, smallest, largest, sets that end here, children, first and last place in the order
        self.nodes: list[tuple[int, int, int, int, int, list[int], list[int], int, int]] = []
        self.roots: list[int] = []
        self.place = np.full(len(members), -1)
        self.place[order] = np.arange(len(order))
        open_ = [(a, b, 0, self.roots) for a, b in self._runs(same, 0, len(order), 0)]
        while open_:
            a, b, begin, parent = open_.pop()
            end = int(same[a + 1 : b].min()) if b - a > 1 else int(sizes[a])
            here = a
            while here < b and sizes[here] == end:
                here += 1
            children: list[int] = []
            parent.append(len(self.nodes))
            self.nodes.append((begin, end, order[a], int(sizes[a:b].min()), int(sizes[a:b].max()), order[a:here], children, a, b))
            open_ += [(x, y, end, children) for x, y in self._runs(same, here, b, end)]
        self.roots.sort(key=lambda k: self.nodes[k][7])
        self.root_begins = np.array([self.nodes[k][7] for k in self.roots], np.int64)

    @staticmethod
    def _runs(same: np.ndarray, a: int, b: int, depth: int) -> list[tuple[int, int]]:
        """The parts of a..b whose sequences share more than ``depth`` entries."""
        if a >= b:
            return []
        edges = [a, *(a + 1 + np.flatnonzero(same[a + 1 : b] <= depth)).tolist(), b]
        return list(zip(edges[:-1], edges[1:]))

    def similar(self, query: np.ndarray, num: int, den: int, among: np.ndarray | None = None) -> list[int]:
        """The members with ``den * intersection >= num * union``, of all or ``among`` some; ``visited`` counts the nodes that were entered.

        The overlap with a node's entries is counted once for all sets below.
        A subtree is left where it has none of those asked for, where none of
        its sizes fits the query's, or where what remains of the query behind
        the last common entry, or of the longest set below, cannot supply the
        overlap that the shortest one that fits needs.
        """
        found, n = [], len(query)
        self.visited = 0
        asked = np.sort(self.place if among is None else self.place[among])
        asked = asked[asked >= 0]
        if not n or not len(asked):
            return found
        by_value = np.argsort(query, kind="stable")
        in_query = query[by_value]
        least, most = -(-num * n // den), n * den // num
        first = np.unique(np.searchsorted(self.root_begins, asked, "right") - 1)
        open_ = [(self.roots[k], 0, 0) for k in first.tolist()]  # node, overlap before it, entries of the query up to the last common one
        while open_:
            k, have, behind = open_.pop()
            begin, end, through, small, large, ending, children, a, b = self.nodes[k]
            if large < least or small > most or np.searchsorted(asked, a) == np.searchsorted(asked, b):
                continue
            need = int(_need(n, max(small, least), num, den))
            large = min(large, most)
            self.visited += 1
            depth, step, path = begin, 64, self.members[through]
            while depth < end and have + min(n - behind, large - depth) >= need:
                part = path[depth : min(end, depth + step)]
                at = np.searchsorted(in_query, part)
                at[at == n] = 0
                hit = by_value[at[in_query[at] == part]]
                if len(hit):
                    have, behind = have + len(hit), int(hit.max()) + 1
                depth, step = depth + len(part), step * 2
            if depth < end or have + min(n - behind, large - depth) < need:
                continue
            if ending and have >= _need(n, end, num, den):
                found += ending
            open_ += [(c, have, behind) for c in children]
        if among is None:
            return found
        wanted = set(among.tolist())
        return [i for i in found if i in wanted]


def _tree_join(num: int, den: int):
    """Links of a block: its queries (``q`` 1, or 2 for both) walk the tree of its members (``q`` 0 or 2).

    Of the members only those are asked for whose first shingles agree with the
    query's often enough.  Rows that are connected already, before or by links
    found here, are not linked again.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        ids, comp, q = rows["id"].to_numpy(), rows["c"].to_numpy().copy(), rows["q"].to_numpy()
        queries, members = np.flatnonzero(q > 0), np.flatnonzero(q != 1)
        tree = PrefixTree([sets[i] for i in members])
        sizes = np.array([len(x) for x in sets], np.int64)
        firsts = sizes - -(-num * sizes // den) + 1
        owner = np.repeat(np.arange(len(members)), firsts[members])
        token = np.concatenate([sets[i][: firsts[i]] for i in members] or [np.zeros(0, np.uint64)])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        u, v = [], []
        for i in queries:
            if (comp[members] == comp[i]).all():
                continue
            own = sets[i][: firsts[i]]
            lo, hi = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
            n = hi - lo
            where = np.cumsum(n)
            met = owner[np.arange(where[-1] if len(where) else 0) + np.repeat(lo - where + n, n)]
            common = np.bincount(met, minlength=len(members))
            size = sizes[members]
            need = _need(size, sizes[i], num, den)
            least = np.maximum(need + 1 - np.maximum(-(-num * size // den), -(-num * sizes[i] // den)), 1)
            some = np.flatnonzero((common >= least) & (comp[members] != comp[i]) & (size * num <= sizes[i] * den) & (sizes[i] * num <= size * den))
            for k in tree.similar(sets[i], num, den, some) if len(some) else ():
                j = members[k]
                if comp[j] != comp[i]:
                    u.append(ids[i])
                    v.append(ids[j])
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"u": np.array(u, "int64"), "v": np.array(v, "int64")})

    return run


def _possible(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sketches differ in no more bits than those of similar sets can.

    Each bin that differs holds at least one shingle that is not common, so
    these can't be more than a similar pair has.
    """
    x, y = (heads.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), *(F.col(m).alias(f"{k}{m}") for m in SKETCHED)).hint("merge") for k in "ab")
    both = pairs.join(x, "a").join(y, "b")
    need = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))
    differ = sum((F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in SKETCHED), F.lit(0))
    return both.where(differ <= F.least(F.lit(_most_differing(num, den)), F.col("na") + F.col("nb") - 2 * need)).select("a", "b")


def _verified(blocks: DataFrame, docs: DataFrame, classes: DataFrame | None, build_sets, num: int, den: int) -> DataFrame:
    """Links ``(u, v)`` in blocks of rows ``(block, part, id, q)``; ``classes`` tells which ids are connected already."""
    blocks = materialize(blocks, "shingle-blocks")
    wanted = ids_to_join(blocks.select("id").distinct(), "candidates")
    own = docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi").select("doc_id", "text")
    written = materialize(own.mapInArrow(build_sets, "id long, size long, tokens binary"), "shingle-sets")
    sets = written.dropDuplicates(["id"])
    rows = blocks.join(sets.select("id", "tokens").hint("merge"), "id")
    if classes is not None:
        rows = rows.join(classes.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    rows = rows.select("block", "part", "id", "q", "tokens", F.coalesce("component", "id").alias("c") if classes is not None else F.col("id").alias("c"))
    links = materialize(rows.groupBy("block", "part").applyInPandas(_tree_join(num, den), "u long, v long"), "links")
    discard(blocks, written)
    return links


def _star_blocks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of pairs ``(a, b)``: a query with its candidates, in several parts if these have more than TREE_SHINGLES shingles."""
    sized = pairs.join(sizes.select(F.col("id").alias("b"), "n").hint("merge"), "b")
    parts = sized.groupBy("a").agg(F.ceil(F.sum("n") / F.lit(TREE_SHINGLES)).cast("int").alias("parts"))
    members = sized.join(parts, "a").select("a", F.xxhash64("a", F.lit(7)).alias("block"), F.pmod(F.xxhash64("b"), F.greatest("parts", F.lit(1))).cast("int").alias("part"), F.col("b").alias("id"), F.lit(0).alias("q"))
    queries = members.select("block", "part", F.col("a").alias("id"), F.lit(1).alias("q")).distinct()
    return members.drop("a").unionByName(queries)


def _near_pairs(num: int, den: int):
    """Of rows ``(token, id, n, p, c, m0, ...)`` sorted by token: edges ``(u, v)`` that connect what pairs of one token connect that may be similar and aren't connected yet.

    The sketches ``m`` are of whole sets, so two long sets that are not alike
    stay apart however many of their first shingles are in some other set.  All
    is decided here, and a token gives fewer edges than it has rows, however
    many pairs there are.
    """
    most = _most_differing(num, den)

    def possible(cols, marks, a, b):
        n, c = cols["n"], cols["c"]
        for test in (lambda: (c[a] != c[b]) & (cols["id"][a] != cols["id"][b]), lambda: np.maximum(n[a], n[b]) * num <= np.minimum(n[a], n[b]) * den, lambda: np.minimum(n[a] - cols["p"][a], n[b] - cols["p"][b]) >= _need(n[a], n[b], num, den)):
            ok = test()
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(marks[a] ^ marks[b]).sum(1) <= np.minimum(most, n[a] + n[b] - 2 * _need(n[a], n[b], num, den))
        return a[ok], b[ok]

    def connected(cols, marks, begin, end):
        """Edges inside the row ranges ``begin`` to ``end``, which follow each other."""
        rows = np.arange(begin[0], end[-1])
        n = np.repeat(end, end - begin) - rows - 1  # pairs of a row with those after it
        where = np.cumsum(n)
        b = np.arange(where[-1]) + np.repeat(rows + 1 - where + n, n)
        a, b = possible(cols, marks, np.repeat(rows, n), b)
        a, b, root = a - begin[0], b - begin[0], np.arange(len(rows))
        while len(a):  # the smallest row that a row is connected with, by as many rounds as the longest chain takes
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(rows)))
        return cols["id"][begin[0] + far], cols["id"][begin[0] + root[far]]

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks() if held is not None or batch is not None else None
            if table is None or not table.num_rows:
                continue
            token = table.column("token").to_numpy()
            edges = np.concatenate(([0], 1 + np.flatnonzero(token[1:] != token[:-1]), [len(token)]))
            done = len(edges) - 1 if batch is None else len(edges) - 2  # the last token may go on
            held = None if batch is None else table.slice(int(edges[-2])).to_batches()[0]
            cols = {x: table.column(x).to_numpy() for x in ("id", "n", "p", "c")}
            marks = np.column_stack([table.column(m).to_numpy() for m in SKETCHED]).astype(np.int64).view(np.uint64)
            begin, end = edges[:done], edges[1 : done + 1]
            total = np.concatenate(([0], np.cumsum((end - begin) * (end - begin - 1) // 2)))
            us, vs, g = [], [], 0
            while g < done:  # tokens of about PAIRS pairs at a time
                h = max(g + 1, int(np.searchsorted(total, total[g] + PAIRS, "right")) - 1)
                if total[h] > total[g]:
                    u, v = connected(cols, marks, begin[g:h], end[g:h])
                    us.append(u)
                    vs.append(v)
                g = h
            if us:
                pairs = np.unique(np.column_stack((np.concatenate(us), np.concatenate(vs))), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def _cluster_blocks(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of clusters ``(node, component)`` in which all rows meet all: in one part, each row once, if that has at most TREE_SHINGLES shingles; else members are dealt over parts, and every part has all as queries."""
    sized = clusters.select(F.col("component").alias("_c"), F.col("node").alias("id")).join(sizes.select("id", "n").hint("merge"), "id")
    parts = sized.groupBy("_c").agg(F.ceil(F.sum("n") / F.lit(TREE_SHINGLES)).cast("int").alias("parts"))
    own = sized.join(parts, "_c").select(F.xxhash64("_c", F.lit(11)).alias("block"), "id", "parts")
    whole = own.where("parts = 1").select("block", F.lit(0).alias("part"), "id", F.lit(2).alias("q"))
    wide = own.where("parts > 1")
    members = wide.select("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("part"), "id", F.lit(0).alias("q"))
    queries = wide.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", F.lit(1).alias("q"))
    return whole.unionByName(members).unionByName(queries)


def _cross_blocks(row: DataFrame, num: int, den: int) -> DataFrame:
    """Blocks in which all rows ``(token, id, n, p, e, room, c)`` meet that may be similar and are not connected.

    A member's home is the token of its own that most rows have, and a part of
    that token's members by hash; its queries are all rows with which it shares
    any token.  So a large group of copies is some parts of MEMBERS rows, each
    met by every row of the group once, and not a row for each pair.
    """
    counts = row.groupBy("token").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / F.lit(MEMBERS), F.sum("n") / F.lit(TREE_SHINGLES))).alias("parts"))
    sized = row.join(counts, "token")
    home = sized.groupBy("id").agg(F.max(F.struct("m", "token", "parts")).alias("h")).select("id", F.xxhash64("h.token", F.pmod(F.xxhash64("id"), F.col("h.parts"))).alias("block"))
    wide = materialize(row.join(home.hint("merge"), "id"), "shingle-homes")
    need = lambda x, y: F.ceil(F.lit(num) * (x + y) / F.lit(num + den))
    # a query meets a block under a token: the block's bounds there, over its rows, decide whether any row could be similar
    at = wide.groupBy("token", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("p")).alias("left"), F.max("room").alias("room1"), F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    q = wide.select("token", "id", "n", "p", "e", "room", "c")
    least = need(F.col("n"), F.greatest(F.col("n0"), F.ceil(F.lit(num) * F.col("n") / F.lit(den))))
    room = F.when(F.col("e") < F.col("e0"), F.col("room")).when(F.col("e1") < F.col("e"), F.col("room1")).otherwise(F.greatest("room", "room1"))
    met = q.join(at, "token").where(((F.col("c0") != F.col("c")) | (F.col("c1") != F.col("c"))) & (F.col("n0") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("n1") * den) & (F.least(F.col("n") - F.col("p"), "left") >= least) & (room >= least))
    met = materialize(met.select("block", "id", "n").distinct(), "shingle-met")
    parts = met.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / F.lit(QUERIES), F.sum("n") / F.lit(TREE_SHINGLES))).cast("int").alias("parts"))
    queries = met.join(parts, "block").select("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"), "id", F.lit(1).alias("q"))
    members = wide.select("block", "id").distinct().join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", F.lit(0).alias("q"))
    return queries.unionByName(members)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Components of the graph that links documents whose shingle sets have ``den * intersection >= num * union``.

    Returns ``(doc_id, n_shingles, component_id)``, one row per input row; the
    component is the smallest id reachable.  A null text counts as empty, and
    an empty set is linked with nothing.  Rows with equal sets (repeated rows
    too) are one component.  A row with a null id is its own component, null.
    An empty table gives an empty result; other columns are not read.  Joins by
    id, of which a set has few rows, are merged at any size, so that the driver
    holds no broadcast tables of them.
    """
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col)
    found = materialize(docs.mapInArrow(_keys(n), "doc_id long, n long, k1 long, k2 long, seen long" + "".join(f", {m} long" for m in SKETCHED)), "shingle-keys")
    keys = found.where("seen is null")
    often = found.where("seen is not null").groupBy("k1").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "k1").limit(MAX_FREQUENT).toPandas()
    order = np.argsort(often["k1"].to_numpy(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast((often["k1"].to_numpy(np.int64).view(np.uint64)[order], often["seen"].to_numpy(np.int64)[order]))

    same = materialize(keys.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), *(F.first(m).alias(m) for m in SKETCHED)), "shingle-classes")
    prefixes = docs.where("doc_id is not null").mapInArrow(_prefixes(n, num, den, frequent), "token long, k1 long, np long, e long")
    meetings = prefixes.repartition("token").sortWithinPartitions("token", "np", "k1").mapInArrow(_meetings(num, den), "token long, k1 long, np long, e long, q1 long, qn long")
    meetings = materialize(meetings, "shingle-meetings")
    met = meetings.select("token", "k1", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(0xFFFFFFFF).alias("p"), "e", "q1", "qn")
    met = met.join(same.select("k1", "n", "id").hint("merge"), ["k1", "n"]).join(same.select(F.col("k1").alias("q1"), F.col("n").alias("qn"), F.col("id").alias("pivot")), ["q1", "qn"], "left")
    met = materialize(met.select("token", "id", "n", "p", "e", "pivot"), "shingle-rows")
    discard(meetings)
    heads = met.groupBy("id").agg(F.first("n").alias("n"), F.first("e").alias("e"), F.size(F.collect_set("token")).alias("k"))
    # of the first shingles, those that no other set has among its own are missing in any set whose first ones end later
    unshared = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1 - F.col("k")
    heads = materialize(heads.select("id", "n", (F.col("n") - unshared).alias("room")).join(same.select("id", *SKETCHED).hint("merge"), "id"), "shingle-heads")

    def build_sets(batches):
        for batch in batches:
            rows = [(i, s) for i, s, _, _ in _sets(batch, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([_ranked(s, frequent.value)[0].tobytes() for _, s in rows], pa.binary())], names=["id", "size", "tokens"])

    stars = met.where("pivot is not null and pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(_star_blocks(_possible(stars, heads, num, den), heads), docs, None, build_sets, num, den)
    first = connected_components(links)
    row = met.join(heads.select("id", "room").hint("merge"), "id").join(first.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("token", "id", "n", "p", "e", "room", F.coalesce("component", "id").alias("c")).distinct()
    split = row.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("token")
    row = materialize(row.join(split, "token", "left_semi"), "shingle-open")
    discard(met)
    counts = row.groupBy("token").agg(F.count("*").alias("m"))
    few, many = row.join(counts.where(F.col("m") <= PAIRED), "token", "left_semi"), row.join(counts.where(F.col("m") > PAIRED), "token", "left_semi")
    marked = few.select("token", "id", "n", "p", "c").join(heads.select("id", *SKETCHED).hint("merge"), "id").select("token", "id", "n", "p", "c", *SKETCHED)
    near = materialize(marked.repartition("token").sortWithinPartitions("token").mapInArrow(_near_pairs(num, den), "u long, v long").distinct(), "shingle-pairs")
    clusters = connected_components(near)
    pairs = _cluster_blocks(clusters, heads)
    more = _verified(pairs.unionByName(_cross_blocks(many, num, den)), docs, first, build_sets, num, den)
    frequent.unpersist()
    merged = connected_components(links.unionByName(more))
    discard(row, near, clusters, heads, first, links, more)
    classes = same.join(merged.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id"))
    out = keys.join(classes, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without those that have a component of smaller id; columns as given.

    One document of each group stays, the one with the smallest id; repeated
    rows of that id stay as one.  Rows with a null id or an empty text stay.
    """
    found = materialize(jaccard_components(docs, id_col, text_col, **settings).where("doc_id is not null"), "shingle-components")
    gone = ids_to_join(found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-duplicates")
    kept = docs.join(gone, id_col, "left_anti")
    again = found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(id_col))
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = ids_to_join(again, "repeated-ids")
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").unionByName(once).select(*docs.columns)
