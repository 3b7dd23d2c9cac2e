"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, labelled, language, lexical, licences, merkle, packing, prefix_trie, quality, site_tree, toxicity, warc
from .ngram_join import jaccard_components
from .storage import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def _with_fold(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.withColumn("held_out", labelled.held_out(F.col("doc_id"), modulus, remainder))


def _labels(table: DataFrame, column: str, modulus: int, remainder: int) -> DataFrame:
    return table.where(~labelled.held_out(F.col("doc_id"), modulus, remainder)).select("doc_id", F.col(column).alias("y"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit_language(docs, _labels(docs, "lang", 4, 2))
    return _with_fold(language.identify_language(docs, model), 4, 2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _labels(_table(spark, sf_dir, "labels"), "toxic", 4, 2))
    return _with_fold(toxicity.score_toxicity(docs, model), 4, 2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _labels(_table(spark, sf_dir, "labels"), "quality", 5, 0))
    return _with_fold(quality.score_quality(docs, model), 5, 0)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(_table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    return chat.chat_digest(chat.format_chats(turns))


def op7_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(_table(spark, sf_dir, "pages"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_trial(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "archives")
    warc.write_archives(warc.captured(_table(spark, sf_dir, "pages")), at)
    found = warc.resolved(warc.read_archives(spark, at))
    return found.select(F.col("source_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("to_id").alias("refers_to"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_join": op2_ngram_join,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_chat_format": op6_chat_format,
    "op7_site_tree": op7_site_tree,
    "op8_merkle": op8_merkle,
    "op9_packing": op9_packing,
    "op10_licences": op10_licences,
    "op11_warc": op11_warc,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words),
sized AS MATERIALIZED (SELECT doc_id, s, len(s)::BIGINT AS n FROM sets),
items AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS MATERIALIZED (SELECT g FROM items GROUP BY g HAVING count(*) > 1),
few AS MATERIALIZED (SELECT items.* FROM items JOIN shared USING (g)),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM few a JOIN few b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT links.v, reach.r FROM reach JOIN links ON links.u = reach.doc_id WHERE reach.r < links.v)
SELECT sized.doc_id, n AS n_shingles, CAST(min(r) AS BIGINT) AS component_id FROM sized JOIN reach USING (doc_id) GROUP BY sized.doc_id, n
"""

_OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[\r\n]+', ' ', 'g') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '\\|###|</turn>', '\\\0', 'g')) + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_OP8_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
chain AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next FROM base),
texts AS (SELECT doc_id, text, next, left(text, length(text) - length(text) // 4) || left(next, length(text) // 4) AS edited FROM chain),
prints AS (
  SELECT t, md5(array_to_string(list_transform(regexp_extract_all(tree, '[0-9a-f.]*/|[0-9a-f.]+$'), lambda s: left(md5(array_to_string(list_transform(regexp_extract_all(s, '[0-9a-f]+'), lambda p: left(md5(p), 16)), '')), 16)), '')) || ':' || tree AS fp,
    list_distinct(regexp_extract_all(tree, '[0-9a-f]{16}')) AS leaves
  FROM (
    SELECT t, array_to_string(list_transform(list_transform(regexp_extract_all(t, '[^\n]*\n|[^\n]+'),
        lambda p: array_to_string(list_transform(regexp_extract_all(p, '[^.!?,;:|\n]{1,64}[.!?,;:|\n]*|[.!?,;:|\n]+'), lambda x: left(md5(x), 16)), '')),
        lambda h: h || CASE WHEN left(md5(h), 1) < '4' THEN '/' ELSE '.' END), '') AS tree
    FROM (SELECT text AS t FROM base UNION SELECT edited FROM texts)))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, e.fp AS edited_fingerprint,
  CASE WHEN split_part(a.fp, ':', 1) = split_part(e.fp, ':', 1) THEN 1.0::DOUBLE WHEN len(a.leaves) + len(e.leaves) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, e.leaves)) / (len(a.leaves) + len(e.leaves)) END AS near_edited,
  CASE WHEN split_part(a.fp, ':', 1) = split_part(n.fp, ':', 1) THEN 1.0::DOUBLE WHEN len(a.leaves) + len(n.leaves) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, n.leaves)) / (len(a.leaves) + len(n.leaves)) END AS near_next
FROM texts JOIN prints a ON a.t = text JOIN prints e ON e.t = edited JOIN prints n ON n.t = next
"""

_OP11_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p),
five AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(x, 5 * k + 1, 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[j // 4 + 1] >> (15 - 5 * (j % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM five
"""

_OP12_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
item_terms AS MATERIALIZED (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
tf AS MATERIALIZED (
  SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM item_terms) GROUP BY r, doc_id, n, t),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
scores AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l))))::BIGINT AS score
  FROM item_terms JOIN tf USING (t) JOIN weights USING (t), total GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
lists AS (
  SELECT conv_id, list(struct_pack(d := sha256(strlen(role) || ':' || role || text), w := len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')))
    ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS t FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, t, conv_id - conv_id % 20 AS base,
    (xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
        lambda i: list_concat([ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT], list_transform(range(8), lambda z: -1::BIGINT))))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4)::BIGINT AS h
  FROM lists),
rebuilt AS MATERIALIZED (
  SELECT a.conv_id AS c, list_concat(CASE WHEN a.h = 0 OR b.t IS NULL THEN [] ELSE b.t[1:a.h] END, a.t[a.h + 1:]) AS t FROM heads a LEFT JOIN lists b ON b.conv_id = a.base),
paths AS MATERIALIZED (
  SELECT c, d, array_to_string(list_transform(t[1:d], lambda x: x.d), ',') AS p, CASE WHEN d > 0 THEN array_to_string(list_transform(t[1:d - 1], lambda x: x.d), ',') END AS up,
    CASE WHEN d > 0 THEN t[d].w ELSE 0 END AS w, d = len(t) AS ends
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT d, p, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, p)),
below AS (
  SELECT a.d, a.p, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.w) AS saved
  FROM full_nodes a JOIN full_nodes b ON b.d >= a.d AND (a.d = 0 OR b.p = a.p OR starts_with(b.p, a.p || ',')) GROUP BY a.d, a.p)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM full_nodes x JOIN below USING (d, p) LEFT JOIN full_nodes y ON y.d = x.d - 1 AND y.p = x.up
"""

SQL: dict[str, str] = {
    "op13_prefix_trie": _OP13_SQL,
    "op11_warc": _OP11_SQL,
    "op12_lexical_search": _OP12_SQL,
    "op6_chat_format": _OP6_SQL,
    "op8_merkle": _OP8_SQL,
    "op2_ngram_join": _OP2_SQL,
}
