"""Merkle-tree fingerprints of documents.

A text is cut into paragraphs (lines) and these into leaves of a clause or at
most 64 characters; nothing is lost between them.  A paragraph's hash is that
of its leaves' hashes, a section is a run of paragraphs that ends where the
content says so, and the root hashes the sections.  The fingerprint is the root
and the leaves in their tree, from which every inner hash follows: equal texts
have equal roots, and unequal branches lead to the edits.  Inner hashes have 64
bits, the root 128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paragraphs with their line feeds; leaves: up to 64 characters and the marks after them.
PARAGRAPH, LEAF = r"[^\n]*\n|[^\n]+", r"[^.!?,;:|\n]{1,64}[.!?,;:|\n]*|[.!?,;:|\n]+"
#: Hex digits of the hash of a leaf, paragraph or section.
DIGITS = 16
_PLACES = "array<struct<section:int,paragraph:int,leaf:int>>"
#: Rows of one slice of the order by id, and slices at most.
SLICE_ROWS, MAX_SLICES = 4096, 1 << 16


def _hash(c: Column, digits: int = DIGITS) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, digits)


def fingerprint(text: Column) -> Column:
    """``root:tree`` of a text (null: empty).  In the tree a leaf is DIGITS hex digits, ``.`` ends a paragraph and ``/`` one that ends its section."""
    paragraphs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    leaves = F.transform(paragraphs, lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: _hash(x)), ""))
    tree = F.array_join(F.transform(leaves, lambda x: F.concat(x, F.when(_hash(x, 1) < "4", "/").otherwise("."))), "")
    return F.concat(root(tree), F.lit(":"), tree)


def _branches(tree: Column) -> Column:
    """The parts of a tree that are its sections, in order."""
    return F.regexp_extract_all(tree, F.lit("[0-9a-f.]*/|[0-9a-f.]+$"), F.lit(0))


def _paragraphs(section: Column) -> Column:
    return F.regexp_extract_all(section, F.lit("[0-9a-f]+"), F.lit(0))


def _section_hash(section: Column) -> Column:
    return _hash(F.array_join(F.transform(_paragraphs(section), lambda p: _hash(p)), ""))


def sections(tree: Column) -> Column:
    """The hashes of a tree's sections, in order."""
    return F.transform(_branches(tree), _section_hash)


def root(tree: Column) -> Column:
    return F.md5(F.array_join(sections(tree), "").cast("binary"))


def _leaves(part: Column) -> Column:
    return F.regexp_extract_all(part, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def leaves(print_: Column) -> Column:
    return _leaves(F.substring_index(print_, ":", -1))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the two sets of leaves, from 0 to 1."""
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    both = F.size(F.array_intersect(x, y))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * both, F.size(x) + F.size(y)), F.lit(0.0)))


def edits(a: Column, b: Column) -> Column:
    """The edited places of ``a`` against ``b``: structs of section, paragraph in it and leaf in that (all from 0), in order.

    The trees are descended from their roots: only sections of ``a`` that
    ``b`` has not are opened, in these only paragraphs that no such section of
    ``b`` holds, and in these the leaves that ``b`` has nowhere are edits.
    """
    mine, other = (_branches(F.substring_index(x, ":", -1)) for x in (a, b))
    known = F.transform(other, _section_hash)
    own = F.transform(mine, _section_hash)
    opened = F.filter(F.zip_with(other, known, lambda s, h: F.when(~F.array_contains(own, h), s)), lambda s: s.isNotNull())
    paragraphs = F.array_distinct(F.flatten(F.transform(opened, _paragraphs)))
    theirs = leaves(b)

    def places(part: Column, section: Column) -> Column:
        def in_paragraph(p: Column, k: Column) -> Column:
            found = F.transform(_leaves(p), lambda x, i: F.when(~F.array_contains(theirs, x), F.struct(section.alias("section"), k.alias("paragraph"), i.alias("leaf"))))
            return F.when(F.array_contains(paragraphs, p), F.array().cast(_PLACES)).otherwise(F.filter(found, lambda x: x.isNotNull()))

        return F.flatten(F.transform(_paragraphs(part), in_paragraph))

    return F.flatten(F.transform(mine, lambda s, i: F.when(F.array_contains(known, _section_hash(s)), F.array().cast(_PLACES)).otherwise(places(s, i))))


def _slice(bounds: list[int], c: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``c``, in two short searches."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(x) for x in bounds[::step]]).cast("array<bigint>")
    rough = F.size(F.filter(coarse, lambda x: x <= c))
    all_ = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    fine = F.size(F.filter(F.slice(all_, F.greatest((rough - 1) * step, F.lit(0)) + 1, F.lit(step)), lambda x: x <= c))
    return F.when(rough == 0, 0).otherwise((rough - 1) * step + fine)


def with_next(docs: DataFrame, column: str, derived: dict[str, Column]) -> DataFrame:
    """``docs(doc_id, column)`` with ``derived`` columns, and ``next_<name>`` of all of them from the row that follows by id; the first follows the last.

    The order is cut into slices of ids.  Each slice also gets a copy of the
    first row of the one after it, so no task sees more than a slice.  Equal ids
    follow each other by ``column``.  A row with a null id is not in the order
    and has nulls there.  The derived columns are made after the rows have
    moved: only ``column`` is shuffled.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null")
    n = known.count()
    cuts = min(MAX_SLICES, n // SLICE_ROWS)
    bounds = sorted({int(x) for x in known.approxQuantile("doc_id", [(i + 1) / (cuts + 1) for i in range(cuts)], 0.2 / (cuts + 1))}) if cuts else []
    sliced = known.withColumn("_slice", _slice(bounds, F.col("doc_id")) if bounds else F.lit(0)).withColumn("_copy", F.lit(0))
    firsts = sliced.groupBy("_slice").agg(F.min("doc_id").alias("doc_id")).orderBy("_slice").collect()  # one row a slice
    before = {r["doc_id"]: firsts[i - 1]["_slice"] for i, r in enumerate(firsts)}
    target = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "doc_id long, _slice int")
    copies = known.where(F.col("doc_id").isin(list(before))).groupBy("doc_id").agg(F.min(column).alias(column))
    copies = copies.join(F.broadcast(target), "doc_id").withColumn("_copy", F.lit(1))
    order = Window.partitionBy("_slice").orderBy("_copy", "doc_id", column)
    names = ["doc_id", column, "_slice", "_copy"]
    placed = sliced.select(*names).unionByName(copies.select(*names)).withColumn(f"next_{column}", F.lead(column).over(order))
    made = placed.withColumns(derived).withColumns({f"next_{c}": F.lead(c).over(order) for c in derived})
    out = made.where("_copy = 0").drop("_slice", "_copy")
    rest = docs.where("doc_id is null").select("doc_id", column, F.lit(None).cast("string").alias(f"next_{column}")).withColumns(derived)
    return out.unionByName(rest.withColumns({f"next_{c}": F.lit(None).cast("string") for c in derived}))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, n_sections, n_leaves)`` of every row; a null text is empty, other columns are not read."""
    made = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fingerprint"))
    return made.select("*", F.size(sections(F.substring_index("fingerprint", ":", -1))).alias("n_sections"), F.size(leaves(F.col("fingerprint"))).alias("n_leaves"))


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against an edited version and against the next document.

    The edit replaces the last quarter (floor of the code points) by as many
    first code points of the next document, or all it has.  Returns ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``, one row per input row.  A null text is empty; the next
    document of a row with a null id is empty; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chain = with_next(base, "text", {"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    made = chain.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.coalesce("next_fingerprint", fingerprint(F.lit(""))).alias("next_fingerprint"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
