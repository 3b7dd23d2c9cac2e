"""Chat formatting: layouts are recognised by a fingerprint of their field paths and mapped to canonical turns.

Only DataFrame functions are used.  The template of a turn is ``### role``, a
line feed, the text, a line feed, ``</turn>`` and a line feed.  In texts and
roles a backslash goes before every backslash, ``###`` and ``</turn>``, so no
control string of a text can be taken for one of the template.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, TAIL = "### ", "\n</turn>\n"
_CONTROL, _ESCAPED = r"\\|###|</turn>", r"\\(\\|###|</turn>)"


def field_paths(schema: T.StructType) -> list[str]:
    """All nested field names, dotted, in order of name; an array adds ``[]``.  Types of leaves don't matter."""
    found: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]")
        else:
            found.append(path)

    walk(schema, "")
    return sorted(found)


def schema_fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layouts: the field paths that name each, and how its rows give turns. ``rows`` layouts have one row per turn;
#: ``pairs`` list (role, path) in order of turns; ``list`` layouts have an array of structs with these role and text fields.
MAPPINGS: list[dict] = [
    {"name": "turn rows", "paths": ["conv_id", "role", "text", "turn"], "rows": ("turn", "role", "text")},
    {"name": "message rows", "paths": ["content", "conv_id", "role", "turn"], "rows": ("turn", "role", "content")},
    {"name": "prompt and response", "paths": ["conv_id", "prompt", "response"], "pairs": [("user", "prompt"), ("assistant", "response")]},
    {"name": "prompt and completion", "paths": ["completion", "conv_id", "prompt"], "pairs": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "question and answer", "paths": ["answer", "conv_id", "question"], "pairs": [("user", "question"), ("assistant", "answer")]},
    {"name": "system, prompt and response", "paths": ["conv_id", "prompt", "response", "system"], "pairs": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "instruction", "paths": ["conv_id", "input", "instruction", "output"], "pairs": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"name": "instruction without input", "paths": ["conv_id", "instruction", "output"], "pairs": [("user", "instruction"), ("assistant", "output")]},
    {"name": "messages", "paths": ["conv_id", "messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    {"name": "share", "paths": ["conv_id", "conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
]
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

_BY_FINGERPRINT = {schema_fingerprint(m["paths"]): m for m in MAPPINGS}


def choose_mapping(schema: T.StructType) -> dict:
    """The mapping whose fingerprint the schema has; with extra columns, the one with most paths that the schema covers.

    Raises ``ValueError`` if no layout is covered.
    """
    paths = field_paths(schema)
    exact = _BY_FINGERPRINT.get(schema_fingerprint(paths))
    if exact:
        return exact
    covered = [m for m in MAPPINGS if set(m["paths"]) <= set(paths)]
    if not covered:
        raise ValueError(f"no layout has the fields {paths}")
    return max(covered, key=lambda m: (len(m["paths"]), m["name"]))


def _role(c: Column) -> Column:
    """Role names on one line, in the names used here; null is ``unknown``."""
    flat = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("unknown")), r"[\r\n]+", " ")
    out = flat
    for other, name in ROLES.items():
        out = F.when(flat == other, name).otherwise(out)
    return out


def canonical_turns(df: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` from any known layout; null texts are empty.

    In ``pairs`` layouts a turn whose field is null is left out, except the
    assistant's.  Null elements of lists are left out.  Extra columns are not read.
    """
    m = choose_mapping(df.schema)
    conv = F.col("conv_id").cast("long").alias("conv_id")
    if "rows" in m:
        turn, role, text = m["rows"]
        return df.select(conv, F.col(turn).cast("long").alias("turn"), _role(F.col(role)).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if "pairs" in m:
        parts = F.array(*[F.struct(F.lit(r).alias("role"), F.col(p).cast("string").alias("text"), F.lit(r == "assistant").alias("keep")) for r, p in m["pairs"]])
        parts = F.filter(parts, lambda x: x["text"].isNotNull() | x["keep"])
    else:
        field, role, text = m["list"]
        parts = F.transform(F.filter(F.col(field), lambda x: x.isNotNull()), lambda x: F.struct(x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))
    return df.select(conv, F.posexplode(parts).alias("turn", "part")).select("conv_id", F.col("turn").cast("long"), _role(F.col("part.role")).alias("role"), F.coalesce("part.text", F.lit("")).alias("text"))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"\\$0")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)``: the text of each conversation and the spans (start, length) of assistant texts in it, in code points.

    Turns are in order of turn (nulls first), then role, then text; repeated
    rows are turns each.  Rows with a null conversation id form one
    conversation; an empty table gives none.
    """
    own = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(HEAD), escape(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    piece = F.concat("head", "body", F.lit(TAIL))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = own.select("conv_id", F.row_number().over(order).alias("at"), piece.alias("piece"), F.length("head").alias("h"), F.length("body").alias("b"), (F.col("role") == "assistant").alias("learn"),
                        (F.sum(F.length(piece).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length(piece)).alias("start"))
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "start", "h", "b", "learn"))).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["learn"]), lambda r: F.struct((r["start"] + r["h"]).alias("start"), r["b"].alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"\n</turn>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p))
    head = lambda p: F.substring(p, F.lit(len(HEAD) + 1), F.instr(p, "\n") - 1 - len(HEAD))
    return F.transform(parts, lambda p: F.struct(unescape(head(p)).alias("role"), unescape(body(p)).alias("text")))


def chat_digest(chats: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: number and digest of turns, and the text under the loss mask."""
    turns = read_turns(F.col("formatted"))
    learned = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    back = chats.select("conv_id", turns.alias("turns"), learned.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
