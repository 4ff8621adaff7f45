"""Each operator against plain Python on small fixtures, with nulls, empty tables, ties, repeated rows and clashing names."""

import collections
import datetime as dt
import itertools
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engram.llm import entry, mapping, mixing, neardup, quality, runs, sequences, timeline, tokens

T = dt.datetime(2025, 3, 1)
LINES = "record_id string, scope string, pos int, t timestamp, event_kind string, ref string, summary string, ingested_at timestamp"


def minute(m):
    return None if m is None else T + dt.timedelta(minutes=m)


def small_batches(spark, n):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    return lambda: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


# --- runs


def brute_runs(rows, gap=10):
    out, by = set(), collections.defaultdict(list)
    for rid, pos, m, ev in rows:
        if rid is not None and m is not None:
            by[rid].append((m, pos, ev))
    for rid, evs in by.items():
        evs.sort(key=lambda x: x[:2])
        run = []
        for m, pos, ev in [*evs, (0, 0, None)]:
            if run and ev is not None and ev == run[-1][2] and m - run[-1][0] <= gap:
                run.append((m, pos, ev))
                continue
            if len(run) > 1:
                out.add((rid, run[0][1], run[-1][1], len(run)))
            run = [(m, pos, ev)] if ev is not None else []
    return out


@pytest.mark.parametrize("seed,batch,parts", [(1, 3, 1), (2, 2, 5), (3, 1000, 3)])
def test_runs_across_batches_and_partitions(spark, seed, batch, parts):
    rnd = random.Random(seed)
    rows = [("hot", i, rnd.randrange(60) if rnd.random() < 0.95 else None, rnd.choice(["a", "a", "a", "b", None])) for i in range(80)]
    rows += [("same", i, 5, "x") for i in range(25)]
    rows += [(f"r{rnd.randrange(6)}", 100 + i, rnd.randrange(40), rnd.choice("ab")) for i in range(60)] + [(None, 1, 1, "a"), (None, 2, 1, "a")]
    df = spark.createDataFrame([(r, r, p, minute(m), e, "clash") for r, p, m, e in rows], "rid string, record_id string, pos int, t timestamp, event string, part string")
    undo = small_batches(spark, batch)
    try:
        got = runs.collapse_runs(df, partitions=parts).collect()
    finally:
        undo()
    assert {(r["rid"], r["first_pos"], r["last_pos"], r["n"]) for r in got} == brute_runs(rows) and len(got) == len(brute_runs(rows))


def test_runs_empty(spark):
    df = spark.createDataFrame([], "rid string, record_id string, pos int, t timestamp, event string")
    assert runs.collapse_runs(df).collect() == []


def test_timeline_keys(spark):
    refs = ["build#12", "BUILD #12 ", "build_12 (retry 3)", "build-12/retry-2", "build 12 - Attempt 4", "build#12.attempt5", "Build#12 [retry 6]", "build 12 try 7"]
    rows = [("a", None, i, minute(i), " Tool-Call", r, None, minute(0)) for i, r in enumerate(refs)]
    rows += [("A ", None, 0, minute(9), "tool call", "x", None, minute(5)), ("a", None, 50, minute(1), " ", "", None, None), (None, None, 1, None, None, None, None, None), ("a", None, None, None, None, None, None, None)]
    got = {r["pos"]: r for r in timeline.events(spark.createDataFrame(rows, LINES)).collect()}
    assert set(got) == {*range(8), 50} and {got[i]["ref"] for i in range(1, 8)} == {"build12"}
    assert got[0]["ref"] == "x" and got[0]["t"] == minute(9) and {r["kind"] for p, r in got.items() if p != 50} == {"tool_call"}
    assert got[50]["kind"] is None and got[50]["ref"] is None


# --- sequences


def brute_patterns(seqs, support, lengths=(3, 4)):
    counts = collections.Counter()
    for s in seqs.values():
        for n in lengths:
            counts.update(set(itertools.combinations(s, n)))
    return {(">".join(p), n) for p, n in counts.items() if n >= max(1, support * len(seqs) - 1e-9)}


@pytest.mark.parametrize("long_", [4096, 12])
def test_sequence_patterns(spark, monkeypatch, long_):
    monkeypatch.setattr(sequences, "LONG", long_)
    rnd = random.Random(7)
    seqs = {f"e{i}": [rnd.choice("abcde") for _ in range(rnd.randrange(9))] for i in range(20)}
    seqs["hot"] = [rnd.choice("abc") for _ in range(30)]
    seqs["none"] = []
    rows = [(e, x, minute(i // 2), i) for e, s in seqs.items() for i, x in enumerate(s)]
    rows += [("none", None, minute(1), 0), ("none", "a", None, 1), (None, "a", minute(1), 1), ("e1", "", minute(1), 99)]
    df = spark.createDataFrame(rows, "rid string, name string, t timestamp, pos long")
    seqs = {e: s for e, s in seqs.items() if s or e == "none"}
    got = {(p, n) for _, p, _, n in sequences.sequence_patterns(df, 0.12)}
    assert got == brute_patterns(seqs, 0.12) and got


def test_useful_keeps_what_patterns_use():
    rnd = random.Random(3)
    for _ in range(60):
        s = [rnd.randrange(4) for _ in range(rnd.randrange(1, 40))]
        kept = [s[i] for i in sequences.useful(s, 3)]
        half = [*[s[i] for i in sequences.useful(s[:20], 3)], *s[20:]]
        for n in (1, 2, 3):
            assert set(itertools.combinations(s, n)) == set(itertools.combinations(kept, n))
        assert [half[i] for i in sequences.useful(half, 3)] == kept
    assert len(sequences.useful([0, 1] * 500, 4)) <= 8


def test_dependency_patterns(spark):
    graph = [("n1", "a", []), ("n2", None, ["n1", "n1", "zz"]), ("n3", "b", ["n2"]), ("n4", "c", ["n3"]), ("n5", "d", ["n4", "n1"])]
    rows = [(f"r{i}", n, x, d) for i in range(3) for n, x, d in graph] + [("r9", "m1", "a", ["m2"]), ("r9", "m2", "b", ["m1"]), (None, "n", "a", [])]
    df = spark.createDataFrame(rows, "rid string, node string, name string, deps array<string>")
    got = {(p, n) for _, p, _, n in sequences.dependency_patterns(df, 0.7)}
    assert got == {("a>b>c", 3), ("a>b>d", 3), ("a>c>d", 3), ("b>c>d", 3), ("a>b>c>d", 3)}
    loop = {p for _, p, _, n in sequences.dependency_patterns(df.where("rid = 'r9'"), 0.7)}
    assert {"a>b>a", "b>a>b>a", "a>a>a"} <= loop
    assert sequences.dependency_patterns(df.limit(0), 0.5) == [] and sequences.sequence_patterns(df.limit(0).selectExpr("rid", "name", "now() t", "1L pos"), 0.5) == []


# --- near-duplicates


def brute_pairs(rows, num, den, least):
    w = [(f, k, set(re.findall("[a-z0-9]+", (v or "").lower()))) for f, k, v in rows if k is not None]
    w = [x for x in w if len(x[2]) >= max(1, least)]
    return {(f, min(a, b), max(a, b)) for (f, a, x), (g, b, y) in itertools.combinations(w, 2) if f == g and len(x & y) * den >= num * len(x | y)}


@pytest.mark.parametrize("num,den,least,hot,split,block", [(3, 5, 6, None, None, None), (4, 5, 1, 9, 8, 2), (3, 5, 1, 1, 2, 3), (1, 2, 1, 1, 1, 1)])
def test_near_duplicates(spark, num, den, least, hot, split, block):
    rnd = random.Random(num)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "a"] * 4
    rows = []
    for i in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 16))]
        for _ in range(rnd.randrange(1, 5)):
            x = [rnd.choice(vocab) if rnd.random() < 0.12 else y for y in base]
            rnd.shuffle(x)
            rows.append((rnd.choice(["text", "object"]), f"k{len(rows)}", " ".join(x)))
    rows += [("text", f"copy{i}", "One two, THREE four five six seven") for i in range(6)] + [("text", "n", None), ("text", "e", ""), ("text", None, "one two three four five six"), ("text", "long", "one " * 5000 + "two three four five six seven")]
    df = spark.createDataFrame(rows, "field string, key string, value string").select("field", "key", neardup.words(F.col("value")).alias("words"), F.lit(1).alias("size"))
    members, pairs = neardup.similar_sets(df, num, den, least, hot, split, block)
    got = [tuple(r) for r in neardup.key_pairs(members, pairs).collect()]
    want = brute_pairs(rows, num, den, least)
    assert len(got) == len(set(got)) and set(got) == want and want
    links = collections.Counter(k for f, a, b in want for k in ((f, a), (f, b)))
    for r in neardup.classes(members, pairs).collect():
        assert r["links"] + r["copies"] - 1 == links[r["field"], r["key"]]


def test_near_duplicates_of_long_sets(spark):
    """Sets of 40 to 500 words with a word, and a whole template, in all of them; a prefix shared by many."""
    rnd = random.Random(9)
    rows = []
    for i in range(30):
        base = ["all", *[f"t{j}" for j in range(20)], *[f"v{rnd.randrange(3000)}" for _ in range(rnd.randrange(20, 480))]]
        for k in range(3):
            x = [w for w in base if rnd.random() > 0.1] + [f"e{rnd.randrange(9)}" for _ in range(k)]
            rows.append(("text", f"k{len(rows)}", " ".join(x)))
    rows += [("text", f"g{i}", " ".join([*[f"rare{j}" for j in range(8)], *[f"t{j}" for j in range(12) if j != i % 12], f"u{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "field string, key string, value string").select("field", "key", neardup.words(F.col("value")).alias("words"))
    members, pairs = neardup.similar_sets(df, 3, 5, 6, hot=50, split=200, block=7)
    got = [tuple(r) for r in neardup.key_pairs(members, pairs).collect()]
    want = brute_pairs(rows, 3, 5, 6)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 800


def test_near_duplicates_empty_and_shingles(spark):
    df = spark.createDataFrame([], "field string, key string, words array<string>")
    members, pairs = neardup.similar_sets(df)
    assert members.collect() == pairs.collect() == []
    row = spark.createDataFrame([("a b c d e f", "a b")], "x string, y string").select(neardup.shingles(F.col("x")).alias("x"), neardup.shingles(F.col("y")).alias("y")).first()
    assert row["x"] == ["a b c d e", "b c d e f"] and row["y"] == []


# --- tokens


@pytest.fixture(scope="module")
def enc():
    if not os.path.exists(tokens.VOCABULARIES):
        pytest.skip("no vocabularies here")
    return tokens.encoding(tokens.VOCABULARIES, "byte_bpe_50k")


def test_joined_halves_are_the_whole(enc):
    rnd = random.Random(5)
    parts = ["a", "b", "'", "'ll", "'re", "s", " ", "  ", "\n", "\t", "12", "é", "日本", "の", "!?", "==", " the", "Q", "​", "🙂", "\xa0", "<|endoftext|>"]
    for i in range(1500):
        s = "".join(rnd.choice(parts if i % 3 else parts[:3] + ["zq", "xk"]) for _ in range(rnd.randrange(1, 60)))
        c = rnd.randrange(1, 12)
        got = tokens.concat(enc, [tokens.encode(enc, s[j : j + c]) for j in range(0, len(s), c)])
        assert got.ids == enc.encode_ordinary(s) and got.text == s


def test_corpus_encoding(spark, enc):
    texts = ["", None, " ", "hello world", "x" * 700, "the cat. " * 90, "日本語" * 120, "=-" * 300 + " it's", "zq'll" * 99]
    rows = [(i, t, "s", 0) for i, t in enumerate(texts)] + [(3, "hello world", "s", 0), (None, "y", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, no int")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, "doc_id", "text", chunk=50, fan=3).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in tokens.encode_corpus(df, "doc_id", "text", chunk=50, counts_only=True, keep=("source",)).collect()}
    assert n == {i: ("s", len(x)) for i, x in got.items()}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").collect() == []


def test_p8_against_the_other_library(spark, sf, enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in zip(docs["doc_id"], docs["text"])}
    assert {r["doc_id"]: r["ids"] for r in entry.p8_ids(spark, sf).collect()} == want


# --- mixing


def test_pivotal_keeps_size_and_expectation():
    size, x = np.array([5.0, 1, 3, 7, 2, 9, 4]), np.array([0.5, 0.2, 0.9, 0.1, 0.4, 0.6, 0.3])
    mean = np.zeros(7)
    for seed in range(3000):
        y, left = mixing.pivotal(x, size, seed)
        assert abs((y * size).sum() - (x * size).sum()) < 1e-6
        assert all(v in (0, 1) for i, v in enumerate(y) if i != left)
        mean += y / 3000
    assert np.abs(mean - x).max() < 0.04


def test_mix_reaches_shares(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["A-b", " a b", "a_b ", "c", "c", "c", "other", None]), rnd.randrange(0, 40)) for i in range(3000)] + [(None, "c", 3), (5000, "c", None)]
    targets = [("a_b", 0.5, 3), ("C", 0.3, 1), ("gone", 0.2, 2), (None, 0.1, 1), ("c", 0.1, 9)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, t, bucket=100, fan=3)
    rows = mixed.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == sum(1 for i, s, n in docs if i is not None and n and s not in (None, "other"))
    out = {r["source"]: r for r in mixing.shares(mixed, t).collect()}
    assert set(out) == {"a_b", "c", "gone"} and out["gone"]["reached"] == 0
    assert out["a_b"]["most_copies"] <= 3 and out["c"]["most_copies"] == 1
    assert abs(out["a_b"]["reached_share"] - 0.625) < 0.002
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(d.repartition(7), t, bucket=100, fan=3).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    assert mixing.mix(d.limit(0), t).collect() == []
    assert all(r["reached_share"] == 0 for r in mixing.shares(mixing.mix(d.limit(0), t), t).collect())


# --- mapping


ENTRIES = [
    ("e1", "Person", "Zangormelpel Lorlumrhokra"), ("e1", "Person", "halcaltaol"), ("e2", "Project", "meadow-monitor"), ("e3", "Tool", "Meadow Monitor"),
    ("e4", "Service", "CobaltLedger"), ("e5", "API", "cobalt gateway"), ("e5", "API", None), ("e6", "Metric", "Ember Forecast"), ("e7", "Team", "Rosemary Ledger"),
    ("e8", "Place", "東京タワー"), ("e9", "Place", "Большая Садовая"), ("e10", "Place", "Große Straße"), ("e11", "Place", "Łódź"), ("e12", "Symbol", "🙂🙃"),
    ("e13", "Service", "lavender-gate"), ("e14", "Service", "oleander_gate"),
]
MENTIONS = [
    (1, "zangormelpel lorlumrhokra", "person", None, "e1"), (2, "Lorlumrhokra, Zangormelpel", None, [], "e1"), (3, "ZangormelpelLorlunrhokra", "person", [], "e1"),
    (4, "Halcaltoal", None, None, "e1"), (5, "meadow_monitor", "project", [], "e2"), (6, "the MEADOW monitr (prod)", "tool", [], "e3"), (7, "meadow-monitor", None, [], "e2"),
    (8, "cobalt ledg.", "other", [], "e4"), (9, "соbаlt-lеdgеr's", "other", [], "e4"), (10, "cöbált​gateway", None, [], "e5"), (11, "it", None, ["cobalt.gateway"], "e5"),
    (12, "it", None, [], ""), (13, None, None, None, ""), (14, " ", "tool", [None, ""], ""), (15, "cobalt", "other", [], ""), (16, "ember crawler", "other", [], ""), (17, "???", None, None, ""),
    (18, "x" * 3000, None, None, ""), (19, "東京タワー", None, None, "e8"), (20, " 東京タワ", None, None, "e8"), (21, "большая  садавая", None, None, "e9"), (22, "grosse strasse", None, None, "e10"),
    (23, "Lodz", None, None, "e11"), (24, "ŁÓDŹ", None, None, "e11"), (25, "🙂🙃", None, None, "e12"), (26, "大阪", None, None, ""), (27, "🙃", None, None, ""), (28, "Olaender Gate", None, None, "e14"),
]


def test_mentions_are_mapped(spark):
    e = spark.createDataFrame(ENTRIES, "entity_id string, primary_type string, name string")
    m = spark.createDataFrame([x[:4] for x in MENTIONS], "mention_id long, surface string, kind string, aliases array<string>")
    got = {r["mention_id"]: r["entity_id"] for r in mapping.map_mentions(m, e, entry.KINDS).collect()}
    assert got == {x[0]: x[4] for x in MENTIONS}
    assert mapping.map_mentions(m.limit(0), e, entry.KINDS).collect() == []
    assert {r["entity_id"] for r in mapping.map_mentions(m, e.limit(0), entry.KINDS).collect()} == {""}


def test_repair_finds_every_word_within_the_edits(spark):
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 16))) for _ in range(150)}
    toks = {"".join(c for c in w if rnd.random() > 0.1) + rnd.choice(["", "a"]) for w in words} | {w[:4] for w in words}

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {(t, w) for t in toks for w in words if t and (dist(t, w) <= mapping.allowed(len(w)) or (len(w) > len(t) >= 4 and w.startswith(t)))}
    t = spark.createDataFrame([(x,) for x in toks if x], "token string")
    w = spark.createDataFrame([(x, False) for x in words], "word string, solid boolean")
    assert {(r["token"], r["word"]) for r in mapping.repair(t, w).collect()} == want


def brute_mapping(mentions, entries, kinds):
    """Every token against every word of the reference, every spelling against every name."""

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    names = [(e, t, n, w) for e, t, n in entries if n is not None for w in mapping.token_sets(n)]
    cut = {n: mapping.token_sets(n) for _, _, n, _ in names}
    words = collections.defaultdict(set)
    for e, _, n, w in names:
        for x in w:
            words[x].add(e)
    solid = {x: all(len(w) == 1 and len(cut[n]) > 1 for _, _, n, w in names if x in w) for x in words}
    idf = {x: np.log(1 + len({e for e, *_ in names}) / len(es)) for x, es in words.items()}
    sims = {}

    def sim(t, w):
        if (t, w) not in sims:
            n, m = len(t), len(w)
            d = dist(t, w) if abs(n - m) <= 3 else 9
            near = 1 - 0.6 * (d - (0.5 if d == 2 and n == m and sorted(t) == sorted(w) else 0)) / max(n, m) if d <= mapping.allowed(m) else 0
            short = 0.8 + 0.15 * n / m if not solid[w] and mapping.PREFIX <= n < m and w.startswith(t) else 0
            sims[t, w] = max(near, short)
        return sims[t, w]

    def rank(spelling):
        best = {}
        for tokens_ in mapping.token_sets(spelling):
            for e, t, n, form in names:
                hits = collections.defaultdict(float)
                for w in form:
                    s, at = max((int(sim(x, w) * mapping.SCALE), -i) for i, x in enumerate(tokens_))
                    hits[at] = max(hits[at], s / mapping.SCALE * idf[w])
                hit, total = sum(hits.values()), sum(idf[w] for w in form)
                if hit >= mapping.COVERED * total:
                    best[t] = max(best.get(t, (-1,)), (round(hit * hit / total, 6), n == spelling, e))
        return best

    out = {}
    for i, surface, kind, aliases in mentions:
        choice = []
        for at, s in enumerate([surface, *(aliases or [])]):
            if s and s.strip():
                for t, (score, exact, e) in rank(s).items():
                    k = (kind or "").strip().lower()
                    fits = 0.5 if not k else float(kinds.get(k, "").lower() == t.lower() or (k not in kinds and t.lower() not in {x.lower() for x in kinds.values()}))
                    choice.append((-min(at, 1), score * (0.9 + 0.1 * fits), fits, exact, e))
        out[i] = max(choice)[-1] if choice else ""
    return out


def test_p1_against_brute_force(spark, sf):
    entries = [(r["entity_id"], r["primary_type"], r["name"]) for r in entry._entries(spark, sf).collect()]
    known = {e.strip().lower() for e, _, _ in entries}
    asked = [tuple(r[c] for c in ("mention_id", "surface", "entity_kind", "aliases")) for r in entry._mentions(spark, sf).collect() if (r["canonical_entity_id"] or "").strip().lower() not in known]
    want = brute_mapping(asked, entries, entry.KINDS)
    got = {r["mention_id"]: r["entity_id"] for r in entry.p1_found(spark, sf).collect()}
    assert {i: got[i] for i in want} == want and set(want.values()) != {""}


def test_known_mentions_agree(spark, sf):
    out = {r["state"]: r["mentions"] for r in entry.p1_agreement(spark, sf).collect()}
    assert out["right"] >= 0.97 * sum(out.values())


# --- quality


COMMON = {"en": {"the", "of", "to", "was", "and", "is", "it", "we", "that"}, "de": {"der", "die", "und", "war", "nicht"}, "ja": {"の", "は", "を", "に", "で", "ました"}}
PROSE = "The lock of the gateway was flushed, and we saw that it was stale. It is said that the plan was changed."
NOT_PROSE = [
    "- idle cursor\n- broken hook\n- the lease 7", "| a | b |\n|---|---|\n| the | 3 |\n| of | 4 |", "key: value\nother: the thing\nlast: 7", "Zm9vYmFyYmF6" * 40, ". . . . . . .",
    '{"op": "in", "of": ["the", 1]}', "idle cursor, broken hook, stale lease, quiet probe", "  at probe.a(b:1)\n  at cache.c(d:2)", "索引、記録、設定、通知、作業",
]


def test_prose_is_told_from_lists_tables_and_junk():
    p = quality.Prose(COMMON)
    share = lambda t: quality.read(t, p)[2]
    wrapped = "The lock of the gateway was flushed, and we\nsaw that it was stale. It is said that the\nplan was changed."
    for t in (PROSE, PROSE.upper(), wrapped, f"user: {PROSE}", f"- {PROSE}", PROSE.replace(" ", "​ "), "Der Lauf war nicht fertig, und die Planung war es nicht.", "記録は昨日の夜に確認されましたが、応答がありませんでした。"):
        assert share(t) > 0.9, t
    for t in NOT_PROSE:
        assert share(t) < 0.1, t
    symbols = "{&:~ +;] %$# ! [<_ ? *) @>| ~ &( " * 20
    blob = "Gecg5405O62aaX0clX8jAmnMjYh1AlG1db" * 9
    for t in (f"{symbols} {PROSE}", f"{blob} {PROSE}", f"{PROSE} {symbols}", f"{blob}/{blob}+{blob}==\n{PROSE}"):
        assert share(t) < 0.5 and quality.read(t, p)[6] == "junk", t
    assert quality.read("the of the was " * 20, p)[6] == "junk"
    assert share("De\u0301r Lauf war ni\u0301cht fertig, und die Planung war es nicht.") > 0.9
    assert share(f"{PROSE}\n" + "- idle cursor 5\n" * 40) < 0.5 < share(f"{PROSE * 9}\n- idle cursor\n")


def test_statistics_values(spark):
    rows = [(1, "ab cd!\nab cd!\n\nx1 _"), (2, None), (3, ""), (4, " ​\n"), (1, "ab cd!\nab cd!\n\nx1 _"), (None, "x"), (5, PROSE * 300)]
    df = spark.createDataFrame([(i, t, "prose") for i, t in rows], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in quality.text_statistics(df, "doc_id", "text", COMMON).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(got[i]["kind"] == "empty" and got[i]["n_visible"] == 0 for i in (2, 3, 4))
    r = got[1]
    assert (r["n_chars"], r["n_visible"], r["n_words"], r["n_lines"]) == (19, 13, 5, 3)
    assert r["end_punctuation_share"] == pytest.approx(2 / 3) and r["duplicate_line_share"] == pytest.approx(6 / 16) and r["symbol_ratio"] == pytest.approx(3 / 19)
    assert got[5]["n_words"] == len(quality.TOKEN.findall(PROSE * 300)) and got[5]["prose_share"] > 0.9 and got[5]["kind"] == "prose"
    assert quality.text_statistics(df.limit(0), "doc_id", "text", COMMON).collect() == []
