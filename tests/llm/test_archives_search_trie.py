"""WARC archives, ranked search and the prefix trie against brute force, and on nulls, empties, repeats, ties and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.llm import lexical, prefix_trie, warc
from votelake.llm.storage import new_path

PAGES = "page_id long, url string, html string, digest int, value string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", "f") for r in rows], PAGES)


def archived(spark, rows, **options):
    at = new_path(spark, "archives")
    warc.write_archives(warc.captured(pages(spark, rows)), at, **options)
    return at, warc.read_archives(spark, at)


TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ntail WARC/1."


def brute_revisits(rows, min_bytes=0):
    groups = defaultdict(list)
    for i, u, h in rows:
        groups[h or ""].append((i, u))
    out = Counter()
    for h, who in groups.items():
        raw = h.encode()
        what = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        best = max(who, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        for j, (i, _u) in enumerate(sorted(who, key=lambda x: x != best)):
            small = len(raw) < min_bytes
            out[(i, *what, "response" if small or j == 0 else "revisit", None if small or j == 0 else best[0])] += 1
    return out


def seen(records):
    rows = warc.resolved(records).select("source_id", "payload_bytes", "digest", "record_type", "to_id").collect()
    return Counter(tuple(r) for r in rows)


ODD = [
    (1, "http://a/1", "<p>x</p>"), (2, "u", None), (3, "u\r\nX: 1", ""), (4, "v", TRICKY), (5, "v2", "<p>x</p>"), (5, "v2", "<p>x</p>"), (5, "v2", "<p>x</p>"), (5, "v1", "<p>x</p>"),
    (None, None, "<p>x</p>"), (None, None, "<p>x</p>"), (7, "w", "é漢😀" * 3), (8, "w", "é漢😀" * 3 + "\r\n"), (9, "q", "WARC/1.1\r\n"), (10, "q", "WARC/1.1\r\n"), (11, "q", "x" * 3_000_000),
]


@pytest.mark.parametrize("min_bytes", [0, 9])
def test_revisits_of_odd_pages(spark, min_bytes):
    _, records = archived(spark, ODD, min_bytes=min_bytes)
    assert seen(records) == brute_revisits(ODD, min_bytes)
    whole = Counter((r[0], bytes(r[1])) for r in warc.with_payloads(records).select("source_id", "payload").collect())
    assert whole == Counter((i, (h or "").encode()) for i, _, h in ODD)
    ids = [r[0] for r in records.select("record_id").collect()]
    assert len(set(ids)) == len(ODD) and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)


def test_archives_are_read_in_any_cuts(spark):
    rng = random.Random(5)
    rows = [(i, f"u{i}", rng.choice(["", TRICKY, "WARC/1.0\r\n\r\n", "z\r\n"]) * rng.randrange(4) + "y" * rng.randrange(300)) for i in range(300)]
    at, records = archived(spark, rows)
    want = seen(records)
    assert want == brute_revisits(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for cut in ("1500b", "9k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            assert seen(warc.read_archives(spark, at)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_records_follow_the_format(spark):
    at, _ = archived(spark, [(1, "http://a", "same"), (2, "http://b", "same")])
    raw = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(at + "/*.txt").collect())
    n = 0
    while raw:
        head, rest = raw.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        assert (b"WARC-Refers-To: " in head) == (b"WARC-Type: revisit" in head)
        raw, n = rest[size + 4 :], n + 1
    assert n == 2


def test_archives_of_no_pages_and_foreign_ones(spark):
    _, records = archived(spark, [])
    assert warc.resolved(records).count() == 0
    at = new_path(spark, "foreign")
    one = "WARC/1.0\r\nwarc-type: revisit\r\nWARC-Record-ID: <a>\r\nWARC-Refers-To: <gone>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n"
    cut = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort"
    spark.createDataFrame([(one + "\r\n\r\n" + cut,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(at)
    rows = {r["record_id"]: r for r in warc.resolved(warc.read_archives(spark, at)).collect()}
    assert (rows["<a>"]["digest"], rows["<a>"]["payload_bytes"], rows["<a>"]["to_id"]) == ("ABC", None, None)
    assert rows["<b>"]["payload_bytes"] == len("short\r\n\r\n")  # what there is of a cut record


TERM = re.compile(lexical.PATTERN)


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    bags = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        own = Counter(terms_of(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scored = []
        for i, b, n in bags:
            m = 25 + 75 * n * n_docs // max(length, 1)
            s = sum(c * w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in own.items() if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def searched(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 2, 3, "b") for i, t in docs], "doc_id long, text string, n long, score int, rank int, bag string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")
    return Counter(tuple(r) for r in lexical.search(d.repartition(5), q, **options).select("item_id", "rank", "doc_id", "score").collect())


def some_docs(rng, n=120):
    words = ["Alpha", "beta", "GAMMA", "délta", "Éps", "x1", "42", "漢字", "the", "of", "zeta_eta"]
    made = [(i, rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(n)]
    made += [(1000 + i, made[3][1]) for i in range(40)] + [(1000 - i, made[3][1].upper()) for i in range(1, 5)]
    return made + [(5, None), (6, ""), (7, " ... "), (None, made[3][1]), (3, made[3][1]), (3, made[3][1]), (8, "alpha " * 50_000 + "beta")]


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    docs = some_docs(rng)
    items = [(i, " ".join(rng.choices(["alpha", "BETA", "délta", "éps", "the", "42", "nowhere", "漢字"], k=rng.randrange(1, 7)))) for i in range(25)]
    items += [(1, "gamma gamma"), (1, "gamma gamma"), (None, "the of"), (77, None), (78, "?!"), (79, "nowhere")]
    want = brute_search(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, k=3) == brute_search(docs, items, 3)
    assert searched(spark, [], items) == Counter() and searched(spark, docs, []) == Counter()


def test_search_in_small_blocks_and_wide_sums(spark, monkeypatch):
    rng = random.Random(4)
    docs = some_docs(rng, 40)
    items = [(i, " ".join(rng.choices(["alpha", "beta", "the", "x1"], k=3))) for i in range(12)]
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 20)
    assert searched(spark, docs, items) == brute_search(docs, items)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 1 << 18)
    heavy = [(1, "alpha " * 3_000_000 + "beta")]
    assert searched(spark, docs, heavy) == brute_search(docs, heavy)


def test_words_with_one_hash_are_told_apart_by_their_bytes():
    known = lexical.Vocabulary(["alpha", "beta"])
    data = np.frombuffer(b"ALPHA bets", np.uint8)
    hashes = np.array([known.hashes[np.flatnonzero(known.order == 0)[0]], known.hashes[np.flatnonzero(known.order == 1)[0]]])
    at, term = known.find(hashes, np.array([0, 6]), np.array([5, 10]), data)
    assert at.tolist() == [0] and term.tolist() == [0]


def words_in(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_trie(rows):
    lists = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            lists[c].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in lists.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, who in members.items():
        leaves = saved = 0
        todo = [p]
        while todo:
            q = todo.pop()
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * (words_in(q[-1][1]) if q else 0)
            todo += kids[q]
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, size=prefix_trie.BLOCK, parts=4):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, k int, digest string, depth int").repartition(parts)
    out = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(df)), size)
    return Counter(tuple(r) for r in out.select(*COLUMNS).collect())


def test_trie_of_odd_conversations(spark):
    rows = [
        (0, 0, "user", "a b"), (0, 1, "bot", "c"), (1, None, None, None), (1, 3, "user", "x"), (2, 5, "user", "a b"), (2, 5, "user", "a b"), (2, 5, "bot", ""), (None, 0, "user", "lost"),
        (-7, 0, "user", "a b"), (-7, 1, "bot", "c"), (-45, 0, "u", "q"), (40, 0, "user", "a b"), (41, 0, "user", "a b"), (43, 0, "user", "a b"), (44, 0, "user", "word " * 60_000), (44, 1, None, "\x0b \t"),
    ]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == Counter()
    assert trie_of(spark, [(6, 0, "user", "one")]) == brute_trie([(6, 0, "user", "one")])


@pytest.mark.parametrize("size", [1, 4])
def test_trie_equals_brute_force(spark, size):
    rng = random.Random(size)
    rows = []
    for c in range(150):
        same = rng.random() < 0.4
        length = rng.choice([1, 2, 3, 4, 5, 8, 9])
        for d in range(length):
            text = f"turn {d} " * d if same or rng.random() < 0.6 else f"own {rng.randrange(3)}"
            rows.append((c, d, ["user", "bot"][d % 2], text))
    rows += [(200, d, "user", f"t{d % 3}") for d in range(700)]  # one conversation with most of the turns
    rows += [(201, d, "user", f"t{d % 3}") for d in range(699)]
    assert trie_of(spark, rows, size) == brute_trie(rows)


def test_lists_of_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 7)
    rows = [(c, 0, "user", "same") for c in range(-60, 90)]
    assert trie_of(spark, rows) == brute_trie(rows)
