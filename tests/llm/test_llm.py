"""Each operator against a brute-force version on small tables, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from votelake.llm import chat, components, decontamination, labelled, language, licences, merkle, ngram_join, packing, quality, queries, site_tree, toxicity, vectext

SCHEMA = "doc_id long, text string, n long, token string, size int, y int, score double, host string"
LONG = "word" * 5 + " " + " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def docs(spark, rows):
    """Documents with extra columns named as the operators' own ones."""
    return spark.createDataFrame([(i, t, 1, "t", 2, 3, 0.5, "h") for i, t in rows], SCHEMA)


def odd_docs(spark):
    return docs(spark, [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "same text here now twice"), (5, "same text here now twice"), (6, LONG), (None, "no id"), (7, "!!! ... ???"), (8, "Ünïcode 漢字 😀 text")])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, n=4):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, num=85, den=100, n=4):
    sets = {i: shingle_set(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_word_hashes_follow_the_definition():
    texts = pa.array(["The THE the", "a\tb  c\x0bd", None, "", "éa Éa", "x" * 3_000_000 + " y"])
    n = []
    for a, b, w in vectext.blocks(texts):
        n += np.diff(w.first).tolist()
        if a == 0:
            assert len(set(w.hashes[:3].tolist())) == 1
    assert n == [3, 4, 0, 0, 2, 2]


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    rows, i = [], 0
    common = [f"c{k}" for k in range(60)]
    for _ in range(groups):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 9, 40, 120]))]
        if rng.random() < 0.5:
            base = common + base
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10_000)}"
            rows.append((i, " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_every_component(spark, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_join_with_groups_too_large_to_hold(spark, monkeypatch):
    rows = near_copies(3)
    run = ngram_join._meetings(85, 100)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 3)
    n, m = 50, 9
    cols = [np.zeros(m, np.int64), np.arange(m), np.full(m, n) << 32, np.zeros(m, np.int64)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 2]) for c in cols], names=list("tkne")) for a in range(0, m, 2)]
    out = pa.Table.from_batches(list(run(iter(batches))))
    assert sorted(out["k1"].to_pylist()) == list(range(m)) and set(out["q1"].drop_null().to_pylist()) == {0}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, rows)).collect()} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_join_in_small_blocks(spark, monkeypatch):
    for name in ("MEMBERS", "QUERIES", "PAIRED"):
        monkeypatch.setattr(ngram_join, name, 2)
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", 100)
    rows = near_copies(4)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, rows)).collect()} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_tree_prunes_but_never_loses():
    rng = np.random.default_rng(5)
    for _ in range(30):
        q = np.unique(rng.integers(0, 300, 80).astype(np.uint64))
        members = []
        for _ in range(20):
            keep = q[rng.random(len(q)) < rng.choice([0.3, 0.9, 0.97])]
            members.append(np.unique(np.concatenate((keep, rng.integers(300, 900, rng.integers(0, 12)).astype(np.uint64)))))
        want = [100 * len(np.intersect1d(q, m)) >= 85 * len(np.union1d(q, m)) for m in members]
        found = ngram_join.PrefixTree(members).similar(q, 85, 100)
        assert sorted(found) == np.flatnonzero(want).tolist()


def test_tree_shares_beginnings_and_prunes_subtrees():
    rng = np.random.default_rng(6)
    base = np.sort(rng.choice(10_000, 200, replace=False)).astype(np.uint64)
    near = [np.concatenate((base[:190], np.array([20_000 + i], np.uint64))) for i in range(50)]
    far = [np.concatenate((np.array([50_000], np.uint64), np.sort(rng.choice(10_000, 150, replace=False)).astype(np.uint64))) for _ in range(50)]
    short = [base[: 20 + i] for i in range(50)]
    tree = ngram_join.PrefixTree(near + far + short)
    assert sorted(tree.similar(base, 85, 100)) == list(range(50))
    assert tree.visited < 50 + 50 + 10  # of the far ones only the common beginning, of the short ones the path to the near ones
    assert tree.similar(np.zeros(0, np.uint64), 85, 100) == [] and ngram_join.PrefixTree([]).similar(base, 85, 100) == []
    assert sorted(ngram_join.PrefixTree([base, base[:199], base]).similar(base, 85, 100)) == [0, 1, 2]
    assert tree.similar(base, 85, 100, np.array([3, 70, 120])) == [3] and tree.visited < 60  # the path to the near ones goes through the short ones


def test_join_of_a_chain_of_edits(spark):
    """Each text is near the next one only: no pivot is near all, and all are one group."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        at = (i * 2) % 118
        words[at] = f"new{i}"
    rows += [(100 + i, " ".join(rng.sample([f"w{k}" for k in range(120)], 30) + [f"own{i}x{j}" for j in range(60)])) for i in range(20)]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, rows)).collect()} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_join_edge_cases(spark):
    got = collections.defaultdict(list)
    for r in ngram_join.jaccard_components(odd_docs(spark)).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert got[1] == [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(0, 3)] and got[4] == [(1, 4)] and got[5] == [(2, 5)] * 2 and got[None] == [(1, None)]
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    kept = ngram_join.keep_representatives(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.where("doc_id = 5").count() == 1 and kept.count() == 9


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components.connected_components(edges).select("component").distinct().collect() == [(0,)]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 12, 40, 90])))) for k in range(25)]
    rows = []
    for i in range(120):
        own = rng.choices(vocab, k=rng.randrange(0, 150))
        if i % 2:
            passage = items[rng.randrange(25)][1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        rows.append((i, ", ".join(own)))
    bench = spark.createDataFrame(items + [(77, None), (78, "")], "item_id long, text string")

    def brute():
        tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
        by_k = collections.defaultdict(dict)
        for k, t in items:
            w = tokens(t)
            n = min(5, len(w))
            by_k[n][k] = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
        out = {}
        for n, own in by_k.items():
            df = collections.Counter(g for grams in own.values() for g in set(grams))
            weight = lambda g: np.log(1 + len(own) / df[g]) if g in df else np.log(1 + len(own))  # noqa: B023, E731
            for i, t in rows:
                w = tokens(t)
                grams = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
                for k, item in own.items():
                    a = set(item)
                    for s in range(max(1, len(grams) - len(item) + 1)):
                        b = set(grams[s : s + len(item)])
                        if a & b:
                            sim = sum(map(weight, a & b)) / sum(map(weight, a | b))
                            if sim >= 0.8 - 1e-12 and sim > out.get((i, k), 0):
                                out[i, k] = sim
        return out

    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    want = brute()
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_decontamination_edges(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "same text here now twice")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd_docs(spark), bench).collect()} == {(5, 2)}
    tie = "alpha beta gamma delta epsilon zeta and alpha beta gamma delta epsilon zeta"
    same = bench.unionByName(spark.createDataFrame([(3, "alpha beta gamma delta epsilon zeta")], "item_id long, text string"))
    found = decontamination.contaminated(docs(spark, [(1, tie)]), same).collect()
    assert {(r["item_id"], r["similarity"], r["first_word"]) for r in found} == {(1, 1.0, 0), (3, 1.0, 0)}  # the first of equal windows, all equal items
    monkeypatch.setattr(decontamination, "ITEMS", 1)
    assert decontamination.contaminated(odd_docs(spark), bench).count() == 2  # both rows of document 5
    assert decontamination.contaminated(odd_docs(spark), bench.limit(0)).count() == 0
    kept = decontamination.keep_uncontaminated(odd_docs(spark), bench)
    assert kept.columns == odd_docs(spark).columns and kept.count() == 8


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    common = rng.choices(vocab, k=20)
    items = [(k, " ".join(common + rng.choices(vocab, k=14))) for k in range(12)] + [(None, "a passage of an item that has no id at all")]
    rows = [(k, " ".join(t.split()[:-3] + ["cut", "off", "here"])) for k, t in items[:12]] + [(k + 20, t.replace(common[2], "edited")) for k, t in items[:12]] + [(50, "see a passage of an item that has no id at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found(parts):
        got = decontamination.contaminated(docs(spark, rows), bench.repartition(parts)).collect()
        return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got}

    whole = found(1)
    assert whole[50, None] == 1 and 0.8 < whole.get((20, 0), 0) < 1
    for size, parts in ((1, 3), (4, 7)):
        monkeypatch.setattr(decontamination, "ITEMS", size)
        assert found(parts) == whole


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(k, rng.integers(0, 2**63, 30, dtype=np.uint64)) for k in range(400)]
    index = decontamination.Index(5, items)
    base = index.prints[7]
    for r in range(decontamination.RADIUS + 1):
        for _ in range(5):
            flips = rng.choice(decontamination.BITS, r, replace=False)
            probe = base.copy()
            for f in flips.tolist():
                probe[f // 64] ^= np.uint64(1 << f % 64)
            assert 7 in index.candidates(30, probe[None])
    probes = rng.integers(0, 2**64, (100, decontamination.BITS // 64), dtype=np.uint64)
    shares = [len(index.retrieved(30, p[None])) / len(items) for p in probes]
    assert 0.05 < np.mean(shares) < 0.35  # the blocks select
    assert not any(index.candidates(30, p[None]) for p in probes[:20])  # and no random fingerprint is that near


def labelled_rows(n=400):
    rng = random.Random(9)
    vocab = ["the", "of", "and", "stone", "river", "light", "green", "walk", "slow", "bright"]
    rows = []
    for i in range(n):
        own = [rng.choice(vocab) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(15, 120))]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["vilewort", "gruntsnipe", "vilest"]))
        text = "!! ".join(w.upper() for w in own) + "!!" if bad else " ".join(own).capitalize() + "."
        rows.append((i, text, 0 if bad else 1, 1 if toxic else 0))
    return rows


def test_quality_ranks_held_out_documents(spark):
    rows = labelled_rows()
    d = docs(spark, [(i, t) for i, t, _, _ in rows])
    y = spark.createDataFrame([(i, q) for i, _, q, _ in rows], "doc_id long, y int").where(~labelled.held_out(F.col("doc_id"), 5, 0))
    model = quality.fit_quality(d, y)
    got = {r["doc_id"]: r["predicted"] for r in quality.score_quality(d, model).collect()}
    assert all(got[i] == q for i, _, q, _ in rows)
    out = quality.score_quality(odd_docs(spark), model).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out)
    twice = quality.score_quality(docs(spark, [(1, rows[5][1]), (2, rows[5][1])]), model).collect()
    assert twice[0]["score"] == twice[1]["score"]
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, p in got.items() if p}
    assert quality.keep_good(odd_docs(spark), quality.fit_quality(d, y.limit(0))).count() == 10  # nothing learned: all stay
    assert quality.score_quality(docs(spark, []), model).count() == 0


def test_pairs_order_scores():
    good, bad = np.array([[1.0, 0.0], [0.9, 0.1]]), np.array([[0.1, 0.0], [0.2, 0.1]])
    m = quality.fit_pairs(good, bad)
    rank = lambda x: ((x - m.mean) / m.spread) @ m.weights
    assert rank(good).min() > m.threshold > rank(bad).max()


def test_toxicity_held_out_and_edges(spark):
    rows = labelled_rows()
    d = docs(spark, [(i, t) for i, t, _, _ in rows])
    y = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, y int").where(~labelled.held_out(F.col("doc_id"), 4, 2))
    model = toxicity.fit_toxicity(d, y)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    assert all(got[i]["predicted"] == t for i, _, _, t in rows)
    assert got[1]["evidence"] and all(e % 4 == 1 for e in got[1]["evidence"])
    assert len(toxicity.score_toxicity(odd_docs(spark), model).collect()) == 10
    assert toxicity.keep_civil(odd_docs(spark), model).count() == 10
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0
    # every document with a word that some example has is a vector, and a repeated row scores the same
    assert all(got[i]["evidence"] for i, _, _, _ in rows)
    twice = toxicity.score_toxicity(docs(spark, [(1, rows[5][1]), (1, rows[5][1])]), model).collect()
    assert twice[0] == twice[1]
    empty = toxicity.fit_toxicity(d, y.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs(spark), empty).collect()} == {0.5} and toxicity.keep_civil(d, empty).count() == len(rows)


def test_toxicity_prior_is_that_of_all_labels(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["stone", "river", "light", "walk"], k=12)) + (" vilewort" if i % 10 == 1 and i % 3 or i % 30 == 4 else ""), int(i % 10 == 1)) for i in range(1200)]
    d = docs(spark, [(i, t) for i, t, _ in rows])
    y = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, y int")
    assert {(r["y"], round(r["weight"], 6)) for r in labelled.sample(d, y, 60).select("y", "weight").distinct().collect()} == {(0, 18.0), (1, 2.0)}
    for per_class in (4000, 60):
        scored = toxicity.score_toxicity(d, toxicity.fit_toxicity(d, y, per_class))
        assert abs(scored.agg(F.avg("score")).first()[0] - 0.1) < 0.03  # a tenth of all labels is toxic, however many are taken


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        at = np.unique(rng.integers(0, 40, rng.integers(0, 6)))
        vectors.append((at, rng.integers(1, 4, len(at))))
    index = toxicity.Neighbours(np.arange(40, dtype=np.uint64), vectors, rng.integers(0, 2, 500))
    dense = np.zeros((500, 40))
    for i, (at, c) in enumerate(vectors):
        if len(at):
            dense[i, at] = index.unit(at, c)
    for at, c in vectors[:60]:
        if not len(at):
            continue
        q = np.zeros(40)
        q[at] = index.unit(at, c)
        cos = dense @ q
        want = np.lexsort((np.arange(500), -np.round(cos, 12)))[: toxicity.NEIGHBOURS]
        want = want[cos[want] > 1e-12]
        ids, found = index.nearest(at, c)
        assert ids.tolist() == want.tolist() and np.allclose(found, cos[want])


def test_language_accuracy_and_rejection(spark):
    rng = random.Random(2)
    parts = {"aa": ["tha", "ing", "wor", "sto"], "bb": ["éau", "queu", "oiè", "lem"], "cc": ["sch", "ung", "eit", "ver"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(3, 60))), lang) for i in range(300) for lang in [list(parts)[i % 3]]]
    d = docs(spark, [(i, t) for i, t, _ in rows])
    y = spark.createDataFrame([(i, lang) for i, _, lang in rows] + [(9999, None)], "doc_id long, y string").where(~labelled.held_out(F.col("doc_id"), 4, 2))
    model = language.fit_language(d, y)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(d, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.98
    odd = {r["doc_id"]: r for r in language.identify_language(odd_docs(spark), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 3, 7)) and odd[4]["lang_pred"] != "und"
    assert language.identify_language(docs(spark, []), model).count() == 0
    twice = language.identify_language(docs(spark, [(1, rows[0][1]), (1, rows[0][1])]), model).collect()
    assert twice[0] == twice[1]
    tie = language.LanguageModel(["aa", "bb"], np.zeros((2, language.BUCKETS)), np.zeros(2), 1.0, 0.0)
    assert {r["lang_pred"] for r in language.identify_language(docs(spark, [(1, "any words")]), tie).collect()} == {"aa"}
    many = spark.createDataFrame([(i, f"l{i:03d}") for i in range(300)], "doc_id long, y string")
    assert len(language.fit_language(d, many, per_class=1).languages) == 300  # no cap
    none = language.fit_language(d, y.limit(0))
    assert {r["lang_pred"] for r in language.identify_language(odd_docs(spark), none).collect()} == {"und"}


def test_sample_is_bounded_and_repeats(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    y = d.select("doc_id", (F.col("doc_id") % 2).alias("y"))
    a = {r["doc_id"] for r in labelled.sample(d, y, 100).collect()}
    assert len(a) == 200 and a == {r["doc_id"] for r in labelled.sample(d.repartition(7), y.repartition(3), 100).collect()}


def test_chat_layouts_give_the_same_turns(spark):
    said, answer = r"\### Assistant: </turn> ok" + "\n</turn>\n\\", "plain\n### user\nx"
    layouts = [
        spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", answer)], "conv_id long, turn long, role string, text string"),
        spark.createDataFrame([(1, said, answer)], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, None, said, answer)], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, [("user", said), ("assistant", answer), None])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", said), ("gpt", answer)], 5)], "conv_id long, conversations array<struct<from:string,value:string>>, extra int"),
    ]
    for df in layouts:
        c = chat.format_chats(chat.canonical_turns(df))
        r = c.select("formatted", chat.read_turns(F.col("formatted")).alias("t"), "loss_mask").first()
        assert [(t["role"], t["text"]) for t in r["t"]] == [("user", said), ("assistant", answer)]
        m = r["loss_mask"]
        assert len(m) == 1 and r["formatted"][m[0]["start"] : m[0]["start"] + m[0]["length"]].replace("\\###", "###") == answer
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "x int"))


def test_chat_digest_and_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "é😀"), (1, 1, "assistant", "é😀"), (None, None, None, "x"), (2, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(chat.canonical_turns(df))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 4 and got[1]["loss_sha256"] == hashlib.sha256("é😀é😀".encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\né😀\nassistant\né😀\n".encode()).hexdigest()
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0 and got[2]["loss_chars"] == 250_000
    assert chat.format_chats(chat.canonical_turns(df.limit(0))).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class="banner-x ad">buy</div>
<div class="tagline">All pages say this</div><article><h1>Title %d &amp; more</h1><p>First %d  para<br>line<p>Second &lt;b&gt; <b>bold</b> %d</p><div class="comments"><p>reader</p></div></article><aside>side</aside><form><p>mail</p></form><footer>&copy;</footer>"""


def test_site_tree(spark):
    rows = [(i, "http://A.example.com:80/p?x", PAGE % (i, i, i)) for i in range(12)] + [(12, None, "<p>alone &#233;"), (13, "http://b.example.com", None), (14, "http://b.example.com", "no markup\n at all"), (12, None, "<p>alone &#233;"), (None, "http://c", "<script>x<p>y</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in site_tree.extract(df).collect()]
    text = dict((i, t) for i, t, _ in got)
    assert text[3] == "Title 3 & more\n\nFirst 3 para line\n\nSecond <b> bold 3" and len(got) == len(rows)
    assert text[12] == "alone é" and text[13] == "" and text[14] == "no markup at all" and text[None] == ""
    assert all(n == len(t) for _, t, n in got)
    assert site_tree.extract(df.limit(0)).count() == 0


def test_words_of_attributes_do_not_drop_the_article():
    for page in (
        "<body class='no-sidebar'><p>kept</p>", "<body class='has-comments search'><p>kept</p>", "<article class='post with-share'>kept</article>", "<article class='related'>kept</article>", "<div id='main-widget'>kept</div>",
        "<main aria-label='Search results'>kept</main>", "<div aria-label='Search results'>kept</div>", "<section class='related-work'>kept</section>", "<div class='sidebar'><main>kept</main></div>", "<div id='widget'><p class='ad'>x</p><article>kept</article></div>",
        "<article>kept</article><div class='comments'><article>x</article></div>", "<p>kept</p><div class='cookie-banner'>x</div><div class='Share'>x</div><div role='search'>x</div><p aria-label='social share'>x</p>", "<main>kept</main><aside><article>x</article></aside>",
        "<p>kept</p><div hidden='' class='no-ad'>x</div><div class='social'><nav><p>x</p></nav></div>",
    ):
        assert site_tree.blocks(page) == ["kept"], page


def test_markup_that_is_odd():
    for page, want in (
        ("<p data-x=it's>Keep this text</p><p>they don't know</p><p>end</p>", ["Keep this text", "they don't know", "end"]),
        ('<p data-a = "x > y" data-b=\'>\'>a</p>b', ["a", "b"]),
        ("<p hidden>x</p><p title=hidden>kept</p>", ["kept"]),
        ("a<b>c</i></b> < d <br/>e</p>", ["ac < d e"]),
        ("<p>one<p>two<ul><li>a<li>b</ul>", ["one", "two", "a", "b"]),
        ("<![CDATA[1 < 2]]><!-- no --><p title=\"open", ["1 < 2"]),
        ("", []),
    ):
        assert site_tree.blocks(page) == want, page


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    began = time.time()
    assert site_tree.blocks("<div>" * 20_000 + "deep" + "</span></i>" * 20_000 + "</div>" * 20_000) == ["deep"]
    assert site_tree.blocks("<div class=ad>" * 20_000 + "<main>kept</main>") == ["kept"]
    assert len(site_tree.Page("<div><p>x</p>" * 20_000).nodes()) == 40_000
    assert len("".join(site_tree.blocks("<p>" + "long " * 400_000 + "=" * 100_000 + "<a " + "b=" * 50_000))) > 2_000_000
    assert time.time() - began < 20


def test_style_tree_takes_boilerplate_without_a_telling_name(spark):
    page = """<html><body><div class=x1><div><span>Our site</span> welcomes you</div><div>Call <a>us</a></div></div>
    <div class=x2><h2>Story %d</h2><div>Words of story %d only</div><div class=x3>Always the same end</div></div><div class=x4><div>Legal</div><div>Terms</div></div></body></html>"""
    rows = [(i, "https://plain.example.org/p", page % (i, i)) for i in range(20)] + [(50, "https://other.example.org/p", page % (1, 1))]
    out = site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in out}
    assert all(text[i] == f"Story {i}\n\nWords of story {i} only" for i in range(20))
    assert text[50].startswith("Our site welcomes you")  # one page of a host says nothing about the others
    # a list of links that changes on some pages is still noise, a text that changes on all of them is not
    trees = spark.createDataFrame([("h", i, [(1, 7, 5 if i % 20 else i), (2, 7, i), (3, i, 9)]) for i in range(60)], "host string, digest long, nodes array<struct<path:long,shape:long,content:long>>")
    found = {r["path"]: r for r in site_tree.importance(trees).collect()}
    assert found[1]["importance"] < site_tree.IMPORTANCE < 0.8 < found[2]["importance"]
    assert found[3]["content_entropy"] < 0.1 and found[3]["importance"] > 0.8  # the same words under another layout each time


def test_style_tree_without_a_broadcast(spark, monkeypatch):
    rows = [(i, "http://a.example.com/", PAGE % (i, i, i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    monkeypatch.setattr(site_tree, "BROADCAST_NODES", 0)
    assert whole == {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()} and "All pages" not in whole[3]


def test_site_tree_keeps_copied_articles(spark):
    df = spark.createDataFrame([(i, "http://x.org/", "<article><p>the one article</p></article>") for i in range(50)], "page_id long, url string, html string")
    assert {r["text"] for r in site_tree.extract(df).collect()} == {"the one article"}


def test_merkle_finds_edits(spark):
    base = "\n".join(f"Paragraph {i}, with a clause; and another one. It ends." for i in range(40))
    other = base.replace("Paragraph 7,", "Paragraph seven,")
    r = spark.createDataFrame([(base, other)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    r = r.select("a", "b", merkle.likeness(F.col("a"), F.col("b")).alias("l"), merkle.edits(F.col("a"), F.col("b")).alias("e"), merkle.edits(F.col("a"), F.col("a")).alias("none")).first()
    assert r["a"].split(":")[0] != r["b"].split(":")[0] and 0.95 < r["l"] < 1 and r["none"] == []
    assert [(x["paragraph"] >= 0, x["leaf"]) for x in r["e"]] == [(True, 0)]  # one leaf of one paragraph
    fp = merkle.fingerprint(F.col("t"))
    paths = [(s, p, k) for s, part in enumerate(re.findall("[0-9a-f.]*/|[0-9a-f.]+$", r["a"].split(":")[1])) for p, own in enumerate(re.findall("[0-9a-f]+", part)) for k in range(len(own) // merkle.DIGITS)]
    assert paths[7 * 4] == tuple(r["e"][0]) and len(paths) == 40 * 4
    texts = ["", "a", "a\nb\n", "b\na\n", "a.b.c\n" * 5, "a.b.c\n" * 4 + "a.x.c\n"]
    pairs = spark.createDataFrame([(i, j, texts[i], texts[j]) for i in range(6) for j in range(6)], "i int, j int, t string, u string")
    for x in pairs.select("i", "j", merkle.edits(fp, merkle.fingerprint(F.col("u"))).alias("e")).collect():
        mine, other = ([s for line in re.findall(merkle.PARAGRAPH, texts[k]) for s in re.findall(merkle.LEAF, line)] for k in (x["i"], x["j"]))
        assert len(x["e"]) == sum(s not in other for s in mine), (x, mine, other)


def test_merkle_trial(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SLICE_ROWS", 3)
    rows = [(i, f"Text {i}. " * (i % 5) + "tail😀") for i in range(40)] + [(100, None), (101, ""), (102, LONG), (103, "a"), (104, "b"), (104, "b")]
    got = collections.defaultdict(list)
    for r in merkle.edit_trial(docs(spark, rows + [(None, "nobody")])).collect():
        got[r["doc_id"]].append(r)
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        nxt, q = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        want = hashlib.sha256(edited.encode()).hexdigest()
        assert want in {r["edited_sha256"] for r in got[i]} and got[i][0]["n_chars"] == len(t)
        if edited == t:
            assert all(r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"] for r in got[i])
    assert sum(map(len, got.values())) == len(rows) + 1 and got[None][0]["near_next"] == 0
    assert merkle.edit_trial(docs(spark, [])).count() == 0


def test_packing_is_lossless(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["Hello,", "WORLD!!", "it's", "naïve", "é", "3.14", "<|endoftext|>", "x_y", " ", "ＡＢ", "漢字", "\x01", "co-op", "a\tb", "İx", "ﬁ"], k=rng.randrange(0, 400)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, LONG), (103, "same"), (103, "same"), (None, "no id")]
    out = packing.pack(docs(spark, rows), path).toPandas()
    tok = Tokenizer.from_file(path)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = out[out.doc_id.isna()] if i is None else out[out.doc_id == i]
        want = [(p, 4096 * p, len(ids[4096 * p : 4096 * (p + 1)]), zlib.crc32(np.array(ids[4096 * p : 4096 * (p + 1)], "<u4").tobytes())) for p in range(-(-len(ids) // 4096))]
        assert {tuple(map(int, x)) for x in own[["piece", "start", "length", "ids_crc32"]].to_numpy()} == set(want), t
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], np.cumsum(g.length)[:-1]))).all() and g.length.sum() <= 4096
    assert out.sequence_id.nunique() == -(-out.length.sum() // 4096) and len(out[out.doc_id == 103]) == 2
    assert packing.pack(docs(spark, []), path).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(8)
    for _ in range(10):
        lengths = rng.integers(900, 2100, 200)
        first = packing.best_fit(lengths, 4096)
        bins = packing.local_search(lengths, first, 4096)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 4096 and fill.sum() == lengths.sum() and bins.max() <= first.max()
    bins = packing.local_search(np.array([5, 5, 4, 4, 6, 6]), np.array([0, 0, 1, 1, 2, 3]), 10)  # 5+5, 4+4, 6, 6
    assert bins.max() + 1 == 3


def test_minhash_values_differ_and_ignore_order(spark):
    grams = [F.lit([5, 9, 13, 77, 2]), F.lit([13, 2, 5, 77, 9])]
    least = [[F.array_min(F.transform(g, licences._seeded(k))) for k in range(licences.BANDS * licences.ROWS)] for g in grams]
    a, b = (list(spark.range(1).select(*x).first()) for x in least)
    assert a == b and len(set(a)) == len(a)


def brute_licences(rows, templates):
    """(doc, template) with CONTAINED of the template's shingles in a run of twice its length, and those that hold it whole."""
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    near, whole = set(), set()
    for i, t in rows:
        w = tokens(t)
        for x, (_, template) in enumerate(templates):
            g = tokens(template)
            k = min(5, len(g))
            own = {tuple(g[j : j + k]) for j in range(len(g) - k + 1)}
            at = [j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in own]
            if k < 5:
                whole |= {(i, x)} if at else set()
                continue
            m = len(own)
            for j in at:  # in place: as long as the template
                share = len({tuple(w[p : p + 5]) for p in at if j <= p < j + m}) / m
                if share >= licences.CONTAINED:
                    near.add((i, x))
                if share == 1:
                    whole.add((i, x))
    return near | whole, whole


def test_licences_against_brute_force(spark):
    templates = licences.default_templates()
    rng = random.Random(3)
    filler = [f"w{i}" for i in range(200)]
    rows = []
    for x, (_, t) in enumerate(templates):
        for edit in (False, True):
            own = rng.choices(filler, k=rng.randrange(0, 90))
            passage = t.split()
            if edit and len(passage) > 12:  # a cut and a changed word
                del passage[: max(1, len(passage) // 20)]
                if len(passage) > 40:
                    passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
            rows.append((len(rows), " ".join(own)))
    near, whole = brute_licences(rows, templates)
    assert len(near) > len(templates)
    names = {x: n for x, (n, _) in enumerate(templates)}
    found = collections.defaultdict(set)
    for r in licences.scan(docs(spark, rows)).collect():
        found[r["doc_id"]].add(r["license"])
        assert r["containment"] >= licences.CONTAINED
    # of overlapping matches one stays: every document with a match has one, and the licence of a whole text or line is there
    have = {i for i, _ in near}
    assert set(found) <= have and len(have & set(found)) >= 0.99 * len(have)
    lost = [(i, names[i // 2]) for i in range(0, len(rows), 2) if names[i // 2] not in found[i]]
    assert len(lost) <= 0.01 * len(rows), lost


def test_licences_at_every_offset(spark):
    rows = []
    for _, t in [*licences.NOTICES.items(), *licences.TEXTS.items()]:
        rows += [(len(rows) + k, " ".join([f"f{j}" for j in range(k)] + t.split() + ["end"])) for k in range(0, 60, 7)]
    got = collections.Counter(r["doc_id"] for r in licences.scan(docs(spark, rows)).where("containment > 0.999").select("doc_id").distinct().collect())
    assert len(got) >= 0.99 * len(rows)


def test_licence_edges(spark):
    lines = [(20, "Text.\nReleased under the MIT License.\nMore"), (21, "RELEASED UNDER THE  MIT-LICENSE"), (22, "released under the mit"), (23, "This work is licensed under the GNU General Public License, version 3.")]
    df = odd_docs(spark).unionByName(docs(spark, lines))
    assert {(r["doc_id"], r["license"]) for r in licences.scan(df).collect()} == {(20, "MIT"), (21, "MIT"), (23, "GPL-3.0")}
    assert licences.scan(df, []).count() == 0 and licences.scan(docs(spark, [])).count() == 0
    # rows without an id, or with the same one, don't suppress each other; equal rows count once; SPDX lines and whole texts are found
    same = docs(spark, [(None, "Released under the MIT License."), (None, "x y z. Licensed under the ISC License and more"), (7, "# SPDX-License-Identifier: MIT"), (7, "// SPDX-License-Identifier: Apache-2.0"), (7, "# SPDX-License-Identifier: MIT"), (8, licences.TEXTS["BSD-3-Clause"]), (9, licences.TEXTS["BSD-2-Clause"]), (10, licences.TEXTS["GPL-3.0"])])
    got = sorted((r["doc_id"] or 0, r["license"]) for r in licences.scan(same).collect())
    assert got == [(0, "ISC"), (0, "MIT"), (7, "Apache-2.0"), (7, "MIT"), (8, "BSD-3-Clause"), (9, "BSD-2-Clause"), (10, "GPL-3.0")]


def test_edited_licences_keep_their_name(spark):
    """A holder's name, a year and a program's name in place of the template's leave the licence what it is."""
    whole = licences.TEXTS
    bsd = lambda t: t.replace("the copyright holder", "Acme Corporation").replace("COPYRIGHT HOLDERS", "AUTHORS").replace("COPYRIGHT HOLDER", "REGENTS")
    gnu = lambda t: t.replace("This program", "Frobnicator")
    edited = {
        1: ("BSD-3-Clause", bsd(whole["BSD-3-Clause"])), 2: ("BSD-2-Clause", bsd(whole["BSD-2-Clause"])), 3: ("GPL-3.0", gnu(whole["GPL-3.0"])), 4: ("GPL-2.0", gnu(whole["GPL-2.0"])),
        5: ("MIT", whole["MIT"].replace("AUTHORS OR COPYRIGHT HOLDERS", "ACME CORPORATION")), 6: ("ISC", whole["ISC"].replace("THE AUTHOR", "ACME CORPORATION")),
        7: ("LGPL-3.0", gnu(whole["LGPL-3.0"])), 8: ("AGPL-3.0", gnu(whole["AGPL-3.0"])), 9: ("GPL-2.0", "x " + licences.NOTICES["GPL-2.0"] + " y"), 10: ("BSD-3-Clause", licences.NOTICES["BSD-3-Clause"]),
    }
    rows = [(i, f"Copyright (c) {1990 + i} Acme Corporation. {t} The end.") for i, (_, t) in edited.items()]
    got = {(r["doc_id"], r["license"]) for r in licences.scan(docs(spark, rows)).collect()}
    assert got == {(i, k) for i, (k, _) in edited.items()}
    assert not {k for k, _ in licences.default_templates()} & {"BSD", "GPL"}


def test_licences_of_few_words(spark):
    lines = [(30, "Text. Licensed under MIT License."), (31, "released UNDER\nISC-License, and released under MIT license"), (32, "This work is licensed under MIT License"), (33, "licensed under MIT"), (34, "zlib")]
    df = odd_docs(spark).unionByName(docs(spark, lines))
    got = {(r["doc_id"], r["license"], r["first_word"], r["last_word"], r["containment"]) for r in licences.scan(df).collect()}
    assert got == {(30, "MIT", 1, 4, 1.0), (31, "ISC", 0, 3, 1.0), (31, "MIT", 5, 8, 1.0), (32, "MIT", 0, 6, 1.0)}
    assert {(r["doc_id"], r["license"]) for r in licences.scan(df, [("Zlib", "zlib"), ("none", "--")]).collect()} == {(34, "Zlib")}


def test_anchors_cover_every_template():
    anchors = licences._anchors(licences.default_templates())
    assert all(len(a) == 6 for a in anchors)
