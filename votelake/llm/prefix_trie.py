"""The prefix trie of conversations, by digests of blocks of turns.

A conversation's turns are cut into blocks of BLOCK turns.  A block's key
holds all blocks before it, so conversations that begin alike meet at the
start of a block, however long they are.  Only where conversations that start
a block together go on differently are the turns inside the block looked at
one by one; elsewhere one of them stands for all.

What a node sums over its subtree comes from its members alone, so no walk up
the tree is needed.  A node saves the words of its last turn for each member
but the smallest.  Going down, a conversation stays the smallest once it is
it; so the words it saves in the subtree are those between the node and the
last node at which it is not the smallest.

Nulls: a null role or text is empty, a null turn comes first, rows without a
conv_id are left out.  Equal turn numbers are ordered by a digest of role and
text; a repeated row is a turn of its own.  An empty table has no nodes.  Very
long texts are only hashed and counted.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from .storage import BROADCAST_IDS, bound_batches, discard, materialize

#: Turns of a block.
BLOCK = 4
#: Ids that one piece of a list of ends spans.
SPAN = 1 << 13
NO_WORDS = r"[\x20\x09-\x0D]+"


class _Kept:
    """Tables written on the way to another one."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def replaced_by(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written; the tables it was made of are deleted."""
        out = materialize(df, name)
        discard(*self.tables)
        return out


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _hash(*parts: Column) -> list[Column]:
    """128 bits as two numbers."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return [F.conv(F.substring(h, a, 16), 16, -10).cast("long") for a in (1, 17)]


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, pos, digest, words)``: every turn's place in its conversation, from 0, and what the trie needs of it.

    Places come from ranges of all turns that are numbered side by side, so a
    conversation with very many turns is never in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.size(F.array_remove(F.split(text, NO_WORDS), "")).cast("long").alias("words"),
    )
    kept = _Kept()
    placed = running(rows, ["conv_id"], ["turn", "digest"], {"after": ("count", F.lit(1))}, kept.write)
    return kept.replaced_by(placed.select("conv_id", (F.col("after") - 1).cast("int").alias("pos"), "digest", "words"), "turns")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt: the first ``h`` turns of the conversation ``c - c % every``, then the own turns after the first ``h``; ``h`` is crc32(c) % ``most``.

    ``(conv_id, pos, digest, words)`` of all turns, and a row with a null
    ``pos`` for a conversation that is left without turns.
    """
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"))
    first = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    led = ids.join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("head", F.expr("array()")), 1, F.col("h")).alias("head"))
    kept_tables = _Kept()
    led = kept_tables.write(led.withColumn("j", F.size("head")), "heads")
    taken = led.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    own = turns.join(_small(led.select("conv_id", "h", "j")), "conv_id").where("pos >= h")
    kept = taken.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("j")).alias("pos"), "digest", "words"))
    lengths = kept.groupBy("conv_id").agg(F.count("*").alias("n"))
    bare = led.join(lengths, "conv_id", "left_anti").select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    return kept_tables.replaced_by(kept.unionByName(bare), "rebuilt-turns")


def blocks_of(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation and block of ``size`` turns: its turns in order, keys of its start and its end, words before it.

    A conversation ends with a block of fewer turns, an empty one if need be.
    """
    real = turns.where("pos is not null")
    whole = real.groupBy("conv_id", F.floor(F.col("pos") / size).cast("int").alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("t"))
    whole = whole.select("conv_id", "k", F.transform("t", lambda x: x["digest"]).alias("digests"), F.transform("t", lambda x: x["words"]).alias("words"))
    none = [F.expr("cast(array() as array<string>)").alias("digests"), F.expr("cast(array() as array<bigint>)").alias("words")]
    last = turns.groupBy("conv_id").agg(F.count("pos").alias("n")).where(F.col("n") % size == 0)
    closed = whole.unionByName(last.select("conv_id", (F.col("n") / size).cast("int").alias("k"), *none))
    a, b = _hash(F.col("k"), F.array_join("digests", ","))
    closed = closed.select("*", F.size("digests").alias("len"), F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum"), a.alias("a"), b.alias("b"))
    sums = {"z1": ("bit_xor", F.col("a")), "z2": ("bit_xor", F.col("b")), "upto": ("sum", F.col("sum"))}
    tables = _Kept()
    run = running(closed, ["conv_id"], ["k"], sums, tables.write)
    keys = [F.col(z).bitwiseXOR(F.col(x)).alias(s) for z, x, s in (("z1", "a", "s1"), ("z2", "b", "s2"))]
    return tables.replaced_by(run.select("conv_id", "k", "len", "digests", "words", *keys, "z1", "z2", (F.col("upto") - F.col("sum")).alias("before")), "turn-blocks")


START = ["k", "s1", "s2"]
NODE = ["depth", "x1", "x2"]


def _starts(blocks: DataFrame) -> DataFrame:
    """Per start of a block: members, the smallest, and whether they all go on alike."""
    out = blocks.groupBy(*START).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.max("len").alias("longest"), *[f(z).alias(f"{z}_{f.__name__}") for z in ("z1", "z2") for f in (F.min, F.max)])
    alike = (F.col("z1_min") == F.col("z1_max")) & (F.col("z2_min") == F.col("z2_max"))
    return out.select(*START, "n", "low", "longest", (~alike).alias("split"))


def _node(size: int, i: Column, digests: Column) -> list[Column]:
    """Depth and key of the node after the first ``i`` turns of a block: the key of the block's end if that is all of a whole one."""
    inner = _hash(F.col("k"), F.col("s1"), F.col("s2"), i, F.array_join(F.slice(digests, 1, i), ","))
    ends = [F.when(i == 0, F.col(s)).when(i == size, F.col(z)).otherwise(x) for s, z, x in zip(("s1", "s2"), ("z1", "z2"), inner)]
    return [(F.col("k") * size + i).cast("long").alias("depth"), ends[0].alias("x1"), ends[1].alias("x2")]


def _turn_rows(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """One row per turn of a block: its node, its parent's key, its words and those before it."""
    each = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("i"))
    parent = [c.alias(n) for c, n in zip(_node(size, F.col("i") - 1, F.col("digests"))[1:], ("p1", "p2"))]
    ahead = F.aggregate(F.slice("words", 1, F.col("i") - 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return each.select(*keep, *START, "i", *_node(size, F.col("i"), F.col("digests")), *parent, F.element_at("words", F.col("i")).alias("w"), (F.col("before") + ahead).alias("pw"))


def _ends(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's list of ends from its pieces in order; a list is never held whole."""
    now, digest, done = None, None, []
    for batch in pieces:
        for depth, x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if now != (depth, x1, x2):
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (depth, x1, x2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends"])
        done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, digest.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends"])


def _end_digests(blocks: DataFrame, size: int) -> DataFrame:
    """Per node at which conversations end: the SHA-256 of their ids, ascending, with commas between."""
    last = blocks.where(F.col("len") < size)
    ends = last.select(*_node(size, F.col("len"), F.col("digests")), "conv_id", F.expr(f"conv_id div {SPAN}").alias("span"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy(*NODE, "span").agg(ids.alias("ids"))
    return bound_batches(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "span")).mapInArrow(_ends, "depth long, x1 long, x2 long, ends string")


def trie(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``turns``: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``(conv_id, pos, digest, words)``; a null ``pos`` stands for
    a conversation without turns.
    """
    blocks = blocks_of(turns, size)
    starts = materialize(_starts(blocks), "block-starts")
    # the start of all conversations is one row: it needs no join; of the others those with one member need none
    shared = _small(materialize(starts.where("n > 1 and k > 0"), "shared-starts"))
    top = starts.where("k = 0").select("n", "low", "split").first()
    if top is None:
        return _empty(blocks)
    head = blocks.where("k = 0").select("*", F.lit(top["n"]).alias("n"), F.lit(top["low"]).alias("low"), F.lit(top["split"]).alias("split"))
    rest = blocks.where("k > 0").join(shared.select(*START, "n", "low", "split"), START, "left")
    alone = [F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("low", "conv_id").alias("low"), F.coalesce("split", F.lit(False)).alias("split")]
    marked = materialize(head.unionByName(rest).select(*blocks.columns, *alone), "marked-blocks")
    alike, apart = marked.where("not split"), marked.where("split")

    turned = materialize(_turn_rows(apart.where("len > 0"), size, "conv_id", "len", "low").withColumnRenamed("low", "low_start"), "split-turns")
    last = (F.col("i") == F.col("len")) & (F.col("len") < size)
    nodes = turned.groupBy(*NODE, "p1", "p2", "i", "low_start", *START, "w", "pw").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.sum(last.cast("long")).alias("n_ends"))
    nodes = materialize(nodes, "split-nodes")

    # words that a conversation saves down to where it is not the smallest any more, and whether it owns a leaf
    near = _small(materialize(nodes.where("n > 1").select(*NODE, "n", "low", "n_ends"), "shared-nodes"))
    met = turned.join(near, NODE, "left").select(*turned.columns, F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("low", "conv_id").alias("low"), "n_ends")
    met = materialize(met, "split-members")
    whole_end = last & ((F.col("n") == 1) | (F.col("n") == F.col("n_ends")))
    own = alike.select("conv_id", F.when(F.col("conv_id") != F.col("low"), F.col("before") + F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x)).alias("save"), ((F.col("len") < size) & (F.col("conv_id") == F.col("low"))).alias("leaf"))
    own = own.unionByName(met.select("conv_id", F.when(F.col("conv_id") != F.col("low"), F.col("pw") + F.col("w")).alias("save"), (whole_end & (F.col("conv_id") == F.col("low"))).alias("leaf")))
    per = own.groupBy("conv_id").agg(F.coalesce(F.max("save"), F.lit(0)).alias("save"), F.max("leaf").cast("long").alias("leaf"))
    per = materialize(per, "savings")
    few = _small(per)

    # sums over the members of shared starts and shared inner nodes; with one member a node saves nothing and has one leaf
    def summed(rows: DataFrame, by: list[str]) -> DataFrame:
        s = rows.select("conv_id", *by, "low").join(few, "conv_id")
        return s.groupBy(*by).agg((F.sum("save") - F.coalesce(F.max(F.when(F.col("conv_id") == F.col("low"), F.col("save"))), F.lit(0))).alias("saves"), F.sum("leaf").alias("leaves"))

    at_start = summed(alike.where("n > 1"), START)
    at_node = summed(met.where("n > 1"), NODE)

    # nodes of blocks whose members go on alike, from their smallest member
    one = _turn_rows(alike.where("conv_id = low and len > 0").join(at_start, START, "left"), size, "len", "n", "low", "saves", "leaves")
    calm = one.select(*NODE, "n", "low", "low", "pw", "saves", "leaves", F.when(F.col("i") < F.col("len"), 1).when(F.col("len") < size, 0).cast("long").alias("children")).toDF(*NODE, "n", "low", "parent", "pw", "saves", "leaves", "children")
    inner = nodes.select("depth", F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("low").alias("parent_low"))
    up = nodes.withColumn("up", F.col("depth") - 1).join(inner.withColumnRenamed("depth", "up"), ["up", "p1", "p2"], "left")
    under = nodes.where("i > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("below"))
    split = up.join(at_node, NODE, "left").join(under, NODE, "left")
    below = F.when(F.col("i") < size, F.coalesce("below", F.lit(0)))
    split = split.select(*NODE, "n", "low", F.when(F.col("i") == 1, F.col("low_start")).otherwise(F.col("parent_low")).alias("parent"), "pw", "saves", "leaves", below.cast("long").alias("children"))

    # at the end of a whole block the next block's start knows the children
    firsts = nodes.where("i = 1").groupBy(*START).agg(F.count("*").alias("first"))
    following = starts.join(firsts, START, "left").select((F.col("k") * size).cast("long").alias("depth"), F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.when(F.col("split"), F.coalesce("first", F.lit(0))).otherwise((F.col("longest") > 0).cast("long")).alias("next"))
    saves = F.sum("save") - F.coalesce(F.max(F.when(F.col("conv_id") == top["low"], F.col("save"))), F.lit(0))
    over_all = per.agg(saves.alias("saves"), F.sum("leaf").alias("leaves")).first()
    literals = {"n": top["n"], "low": top["low"], "parent": None, "pw": 0, "saves": over_all["saves"], "leaves": over_all["leaves"], "children": None}
    root = following.where("depth = 0").select(*NODE, *[F.lit(v).cast("long").alias(c) for c, v in literals.items()])
    every = calm.unionByName(split).unionByName(root).join(following, NODE, "left").join(_end_digests(blocks, size), NODE, "left")
    saved = F.when(F.col("n") > 1, F.col("saves") - (F.col("n") - 1) * F.col("pw")).otherwise(0)
    out = every.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("children", "next", F.lit(0)).alias("n_children"),
        F.when(F.col("n") > 1, F.col("leaves")).otherwise(1).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = materialize(out, "trie")
    discard(blocks, starts, marked, turned, nodes, met, per)
    return out


def _empty(blocks: DataFrame) -> DataFrame:
    kinds = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return blocks.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in kinds) + ", ends_sha256 string")
