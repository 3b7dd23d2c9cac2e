"""WARC archives: writing, reading, and revisit records for repeated payloads.

A capture is a row ``(source_id, target_uri, payload)``.  ``write_archives``
lets Spark's own text writer lay records end to end, with the blank lines that
close a record as its separator, so commits, lost tasks and any file system
are Spark's matter.  ``read_archives`` splits archives of any size at the
version line, side by side, and puts together again what a payload that
contains such a line has cut.

Nulls: a null payload is an empty one, a null id or address has no header and
comes back null.  A repeated capture is a revisit of its first copy.  An empty
table writes archives without records.  Very long payloads cost a task's
memory a few copies of the longest one, never of an archive.  Other columns
are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, ids_to_join, materialize

#: Fixed values of the format.
VERSION, SPLIT, END = "WARC/1.1", "WARC/1.", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: What makes two captures copies: a SHA-1 alone can be forged.
SAME = ["digest", "strong", "payload_bytes"]
WHO = ["source_id", "target_uri"]

HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "source_id": "WARC-Source-Id",
    "declared_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_length": "Content-Length",
}


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits give four characters."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def captured(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(source_id, target_uri, payload)`` with size and digests of the whole payload."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("source_id"), F.col(uri_col).cast("string").alias("target_uri"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    return rows.select("*", size.alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"), F.sha2("payload", 256).alias("strong"))


def record_id(*parts: Column) -> Column:
    """A URN for what the parts name; nulls count as a value of their own."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def revisits_of(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Which captures repeat another one's payload: ``WHO``, ``SAME``, ``copy`` and ``to_id``, ``to_uri`` of the response.

    ``headers`` has ``WHO`` and ``SAME``, no payloads.  They are counted per
    capture and shuffled by digest; of those with equal payloads of at least
    ``min_bytes`` bytes the largest source id (ties: the larger address, then
    the first copy) is the response.  A digest that very many captures share is
    summed up before the shuffle, and joined back by a join that Spark can split.
    """
    named = materialize(headers.groupBy(*WHO, *SAME).agg(F.count("*").alias("n")), "capture-headers")
    wide = named.where(F.col("payload_bytes") >= min_bytes)
    chosen = wide.groupBy(*SAME).agg(F.max(F.struct(*WHO)).alias("to"), F.sum("n").alias("all")).where(F.col("all") > 1)
    met = wide.join(chosen.select(*SAME, F.col("to.source_id").alias("to_id"), F.col("to.target_uri").alias("to_uri")), SAME)
    own = F.col("source_id").eqNullSafe(F.col("to_id")) & F.col("target_uri").eqNullSafe(F.col("to_uri"))
    first = F.when(own, 1).otherwise(0)
    copies = met.where(F.col("n") > first).withColumn("copy", F.explode(F.sequence(first.cast("long"), F.col("n") - 1)))
    out = materialize(copies.drop("n"), "revisits")
    discard(named)
    return out


def responses_of(captures: DataFrame, revisits: DataFrame) -> DataFrame:
    """The captures that are archived whole: all but the revisits.  Payloads are only shuffled where captures are repeated row by row."""
    key = record_id(F.col("source_id"), F.col("target_uri"), F.col("strong"))
    named = captures.withColumn("who", key)
    gone = ids_to_join(revisits.where("copy = 0").select(key.alias("who")).distinct(), "revisit-ids")
    twice = ids_to_join(revisits.where("copy > 0").select(key.alias("who")).distinct(), "repeated-ids")
    left = named.join(gone, "who", "left_anti")
    once = left.join(twice, "who", "left_anti")
    return once.unionByName(left.join(twice, "who", "left_semi").dropDuplicates(["who"])).drop("who")


def _line(name: str, value: Column) -> Column:
    """A header line; none for null.  Control characters of a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record(kind: str, own: Column, block: Column, date: str, refers: list[Column]) -> Column:
    lines = [
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.lit(kind)), _line("WARC-Record-ID", own), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("target_uri")), _line("WARC-Source-Id", F.col("source_id")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *refers, _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"),
    ]
    return F.concat(*[x.cast("binary") for x in lines], block).cast("string").alias("value")


def write_archives(captures: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Write captures as WARC archives under ``path``, each payload once and revisit records with fresh headers for its copies.

    ``captures`` is as from ``captured``.  It is read twice: once without the
    payloads, to find the copies, once to write.
    """
    revisits = revisits_of(captures.select(*WHO, *SAME), min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    own = record_id(F.col("source_id"), F.col("target_uri"), F.col("strong"))
    small = F.col("payload_bytes") < min_bytes
    alone = responses_of(captures.where(~small), revisits).select(_record("response", own, F.concat(http, F.col("payload")), date, []))
    # captures too small for a revisit stay responses, copies among them too: a repeated one gets an id of its own
    numbered = record_id(F.col("source_id"), F.col("target_uri"), F.col("strong"), F.expr("uuid()"))
    tiny = captures.where(small).select(_record("response", numbered, F.concat(http, F.col("payload")), date, []))
    to = record_id(F.col("to_id"), F.col("to_uri"), F.col("strong"))
    refers = [_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", to), _line("WARC-Refers-To-Target-URI", F.col("to_uri")), _line("WARC-Refers-To-Date", F.lit(date))]
    copy = record_id(F.col("source_id"), F.col("target_uri"), F.col("strong"), F.col("copy"))
    again = revisits.select(_record("revisit", copy, http, date, refers))
    written = alone.unionByName(again)
    written = written.unionByName(tiny) if min_bytes > 0 else written
    written.write.option("lineSep", END).text(path)
    discard(revisits)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between version lines, with where it lies and how many bytes its record says it has."""
    text = spark.read.option("lineSep", SPLIT).text(path)
    head = F.substring_index("value", END, 1)
    length = F.regexp_extract(head, r"(?im)^content-length:[ \t]*(\d+)", 1).try_cast("long")
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")]
    return text.select(*at, "value", F.octet_length("value").cast("long").alias("octets"), (F.octet_length(head) + 2 * len(END) + length).alias("need"))


_RECORDS = T.StructType([T.StructField(c, T.LongType()) for c in ("seq", "record", "size")])


def _assign(rows: pd.DataFrame) -> pd.DataFrame:
    """The record of every piece of one archive: a record takes pieces until it has the bytes it says."""
    rows = rows.sort_values(["block", "seq"])
    record, size, have, out = -1, 0, 0, []
    for seq, octets, need in zip(rows["seq"], rows["octets"], rows["need"]):
        if record < 0 or have >= size:
            record, size, have = int(seq), int(octets if need is None or pd.isna(need) else need), int(octets)
        else:
            have += len(SPLIT) + int(octets)
        out.append((int(seq), record, size))
    return pd.DataFrame(out, columns=["seq", "record", "size"])


def _whole_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)`` of every record, from behind its version number.

    Archives all of whose pieces have the bytes they say are taken as they are.
    In the others, sizes of the pieces decide which of them make up a record.
    """
    pieces = _pieces(spark, path).where("octets > 0")
    fits = F.col("need").isNotNull() & (F.col("need") == F.col("octets"))
    broken = ids_to_join(pieces.where(~fits).select("file").distinct(), "broken-archives")
    clean = pieces.join(broken, "file", "left_anti").select("file", "value")
    cut = materialize(pieces.join(broken, "file", "left_semi"), "archive-pieces")
    records = cut.select("file", "block", "seq", "octets", "need").groupBy("file").applyInPandas(_assign, _RECORDS)
    parts = cut.join(records, "seq").groupBy("file", "record", "size").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["value"]), SPLIT).cast("binary")
    return clean.unionByName(parts.select("file", F.substring(whole, F.lit(1), F.col("size").cast("int")).cast("string").alias("value")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: its headers, ``payload``, ``payload_bytes`` and the payload's ``digest``.

    Payload and digest are of what the record holds: a revisit holds none.
    A record that ends before the bytes it says comes with what there is.
    """
    head = F.substring_index("value", END, 1)
    fields = [F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit("")).alias(alias) for alias, name in HEADERS.items()]
    start = F.octet_length(head) + len(END) + 1
    length = F.regexp_extract(head, r"(?im)^content-length:[ \t]*(\d+)", 1).try_cast("int")
    rows = _whole_records(spark, path).select("file", *fields, F.substring(F.col("value").cast("binary"), start, length).alias("block"))
    inner = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END) + 1
    rows = rows.withColumn("payload", F.substring("block", inner, F.octet_length("block"))).drop("block", "content_length")
    rows = rows.withColumn("source_id", F.col("source_id").try_cast("long")).withColumn("declared_digest", F.regexp_replace("declared_digest", "^sha1:", ""))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))


def resolved(records: DataFrame) -> DataFrame:
    """Every record with size and digest of its full payload; a revisit's come from the response that it refers to.

    A join on record ids, without payloads; Spark splits a response that very
    many revisits name.  A revisit whose response is not there has the digest
    it declares and no size.
    """
    light = records.select("record_id", "source_id", "target_uri", "record_type", "refers_to", "declared_digest", "payload_bytes", "digest")
    is_revisit = F.col("record_type") == "revisit"
    whole = light.where(~is_revisit)
    named = whole.select(F.col("record_id").alias("refers_to"), F.col("source_id").alias("to_id"), F.col("payload_bytes").alias("to_bytes"), F.col("digest").alias("to_digest"))
    met = light.where(is_revisit).join(named, "refers_to", "left")
    met = met.withColumn("payload_bytes", F.col("to_bytes")).withColumn("digest", F.coalesce("to_digest", "declared_digest"))
    out = whole.withColumn("to_id", F.lit(None).cast("long")).unionByName(met.drop("to_bytes", "to_digest"))
    return out.select("record_id", "source_id", "target_uri", "record_type", "payload_bytes", "digest", "to_id")


def with_payloads(records: DataFrame) -> DataFrame:
    """Records whose revisits carry the payload of the response that they refer to."""
    is_revisit = F.col("record_type") == "revisit"
    whole = records.where(~is_revisit)
    named = whole.select(F.col("record_id").alias("refers_to"), F.col("payload").alias("p"), F.col("payload_bytes").alias("b"), F.col("digest").alias("d"))
    met = records.where(is_revisit).join(named, "refers_to", "left")
    met = met.withColumns({"payload": F.col("p"), "payload_bytes": F.col("b"), "digest": F.coalesce("d", "declared_digest")}).drop("p", "b", "d")
    return whole.unionByName(met.select(*whole.columns))
