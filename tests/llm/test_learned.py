"""Prefix trie, n-gram scores and source divergence against brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spurline.llm import divergence, ngrams, prefixes, queries

TURNS = "conv_id long, turn long, role string, text string, seq string, slice long"  # the last two clash with names used inside


def turns(spark, convs):
    return spark.createDataFrame([(c, k, r, t, "x", 1) for c, rows in convs.items() for k, (r, t) in enumerate(rows)], TURNS)


def conversations():
    rng = np.random.default_rng(4)
    said = [("user", "a b c"), ("assistant", "d e"), ("user", ""), (None, None), ("user", "long " * 50)]
    convs = {c: [said[k] for k in rng.integers(0, 2, rng.integers(0, 6))] for c in range(1, 60)}
    convs |= {c: [said[0], said[1]] for c in range(200, 330)}  # copies
    convs |= {c: [said[0]] * 40 + [said[k] for k in rng.integers(0, 5, 3)] for c in range(400, 420)}  # a long path that many share
    convs |= {500 + c: [said[0]] * c for c in range(1, 30)}  # ends along one path
    return convs | {-7: [said[4]], 900: [said[3]] * 5}


def nodes(convs):
    """Members of every beginning, and what follows from them."""
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, rows in convs.items():
        path = tuple((r or "", t or "") for r, t in rows)
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("partitions", ["1", "5", "64"])
def test_trie_against_brute_force(spark, partitions):
    convs = {c: rows for c, rows in conversations().items() if rows}  # without turns there is no row to know a conversation by
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many slices as asked for
    try:
        got = prefixes.trie(prefixes.conversations(turns(spark, convs))).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert collections.Counter(map(tuple, got)) == nodes(convs)


def test_trie_of_rebuilt_conversations(spark):
    convs = {c: rows for c, rows in conversations().items() if rows}
    rebuilt = {}
    for c, rows in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + rows[h:]
    assert any(not r for r in rebuilt.values())
    got = prefixes.trie(prefixes.with_heads(turns(spark, convs))).select(*COLUMNS).collect()
    assert collections.Counter(map(tuple, got)) == nodes(rebuilt)


def test_trie_odd_rows(spark):
    """Null turns come first, equal turns by role, repeated rows are turns; rows without conv_id are in no conversation; no rows, no nodes."""
    rows = [(1, 2, "user", "b", "x", 1), (1, None, None, "a", "x", 1), (1, 2, "user", "b", "x", 1), (1, 2, "assistant", "z", "x", 1), (None, 1, "user", "q", "x", 1)]
    got = prefixes.trie(prefixes.conversations(spark.createDataFrame(rows, TURNS))).select(*COLUMNS).collect()
    assert collections.Counter(map(tuple, got)) == nodes({1: [("", "a"), ("assistant", "z"), ("user", "b"), ("user", "b")]})
    assert prefixes.trie(prefixes.with_heads(spark.createDataFrame([], TURNS))).count() == 0


def test_trie_slices_hold_few_points(spark):
    """A beginning that all share is summed up by slices: no more shared rows than slices times turns."""
    convs = {c: [("user", "same")] * 3 + [("user", str(c))] for c in range(500)}
    held = prefixes.conversations(turns(spark, convs))
    assert prefixes.trie(held).where("n_convs = 500").count() == 4


def base(c, n, v):
    return math.log10((c + 0.5) / (n + 0.5 * (v + 1)))


DOCS = "doc_id long, text string, lang string, source string, kind int, shard int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    chance = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, rng.integers(1, 200), p=chance / chance.sum())) for _ in range(400)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts[10:20] = [f"{t} {passage}" for t in texts[10:20]]
    texts += [None, "", " \t\n", "É\x0bé A a b", " ".join(words * 400), passage, texts[3], texts[3]]
    rows = [(i, t, "ab"[i % 2], f"s{i % 3}", 0, 0) for i, t in enumerate(texts)] + [(None, "w1 w2 unseen", None, None, 0, 0), (7, texts[7], "c", "only", 0, 0)]
    folder = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_ngram_scores_against_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngrams, "GRAMS", 20_000)  # several shards
    monkeypatch.setattr(ngrams, "WORDS", 500)
    s = ngrams.Settings(probes=30)  # no false positives, so counts as held can be told
    blocks = ngrams.pack(corpus, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    model = ngrams.train(blocks, s)
    assert min(model.shards) > 1
    by_broadcast, by_shards = ngrams.score(blocks, model), ngrams.score(blocks, model, most_bytes=0)
    got = sorted(map(tuple, by_broadcast.collect()), key=str)
    assert got == sorted(map(tuple, by_shards.collect()), key=str)
    assert got == sorted(map(tuple, ngrams.learnt_and_scored(blocks, s).collect()), key=str)

    rows = [(r["doc_id"], tokens(r["text"])) for r in corpus.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    grams = collections.Counter()
    for i, t in rows:
        if not held(i):
            path = [None, *t]
            for j in range(1, len(path)):
                grams[path[j],] += 1
                for n in (2, 3):
                    if j >= n - 1:
                        grams[tuple(path[j - n + 1 : j + 1])] += 1
    n_all, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def kept(g):
        c = grams[g]
        low = 2 ** int(math.log2(c)) if c else 0
        return (low + max(2 * low - 1, low)) / 2

    want = []
    for i, t in rows:
        path, score = [None, *t], 0.0
        for j in range(1, len(path)):
            p = (grams[path[j],] + 0.5) / (n_all + 0.5 * (v + 1))
            for n in (2, 3):
                if j >= n - 1:
                    g = tuple(path[j - n + 1 : j + 1])
                    context = grams[g[:1]] if n == 2 else kept(g[:-1])
                    p = (kept(g) + s.strength * p) / (max(context, kept(g)) + s.strength)
            score += math.log10(p)
        want.append((i, held(i), len(t), sum(grams[w,] > 0 for w in t), n_all, sum(base(grams[w,], n_all, v) for w in t), score))
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[6])), sorted(want, key=lambda r: (str(r[0]), r[2], r[6]))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_filter_reads_at_least_what_it_holds():
    rng = np.random.default_rng(1)
    keys = rng.choice(2**32, 50_000, replace=False).astype(np.uint32)
    counts = np.maximum(1, rng.zipf(1.5, 40_000).clip(1, 10**6)).astype(np.uint64)
    held = ngrams.LogFilter.read(ngrams.LogFilter.of(keys[:40_000], counts, ngrams.Settings()).body())
    levels = held.levels(keys)
    want = 1 + np.floor(np.log2(counts) + 1e-9)
    assert (levels[:40_000] >= want).all() and (levels[:40_000] == want).mean() > 0.98
    assert (levels[40_000:] > 0).mean() < 0.015


def test_ngrams_help_with_texts_not_learnt_from(spark, corpus):
    """Repeated passages are likelier than their words alone make them; and an empty corpus gives no rows, one without texts to learn from certain words."""
    blocks = ngrams.pack(corpus, F.col("doc_id") < 400)
    got = {r["doc_id"]: r for r in ngrams.score(blocks, ngrams.train(blocks)).where("doc_id >= 400").collect()}
    assert got[405]["score"] > 0.3 * got[405]["base_score"]  # the passage
    nothing = ngrams.pack(corpus, F.lit(False))
    assert all(r["base_score"] == r["score"] == 0 and r["train_tokens"] == 0 for r in ngrams.score(nothing, ngrams.train(nothing)).collect())
    none = ngrams.pack(corpus.limit(0), F.lit(True))
    assert ngrams.score(none, ngrams.train(none)).count() == 0
    assert ngrams.learnt_and_scored(none).count() == 0


def test_audit_against_brute_force(spark, corpus):
    # many tries, many chunks of terms, blocks of two sources
    got = {tuple(r) for r in divergence.audit(corpus, 5, 7, counters=200, chunk=16, block=2).select("lang", "source", "part", "item", "value", "rank").collect()}
    docs = collections.Counter()
    counts, groups = collections.defaultdict(collections.Counter), set()
    for r in corpus.collect():
        lang, source = r["lang"] or "", r["source"] or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r["text"] or "")]
        counts[lang, source].update(found)
        docs.update({(lang, t) for t in found})
    kept = collections.defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= 5:
            kept[lang].append(t)
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    total = {g: sum(counts[g][t] for t in kept[g[0]]) for g in groups}
    want = set()
    for lang, source in groups:
        terms, others = kept[lang], [s for k, s in groups if k == lang]
        p = lambda s, t: share(counts[lang, s][t], total[lang, s], len(terms))
        pairs = sorted(((-sum(abs(p(source, t) - p(s, t)) for t in terms), s.encode()) for s in others if s != source))
        want |= {(lang, source, "pair", s.decode(), -v, k + 1) for k, (v, s) in enumerate(pairs)}
        every = sum(total[lang, s] for s in others)
        q = lambda t: share(sum(counts[lang, s][t] for s in others), every, len(terms))
        top = sorted((q(t) - p(source, t), t.encode()) for t in terms if counts[lang, source][t] and p(source, t) > q(t))
        want |= {(lang, source, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(top[:7])}
    assert got == want
    assert divergence.audit(corpus.limit(0)).count() == 0


def test_shares_are_exact(spark):
    """Counts beyond what 64 bits can hold a billion times."""
    row = spark.createDataFrame([(3 * 10**12 + 1, 7 * 10**15 + 3, 10**6)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (3 * 10**12 + 6) // (7 * 10**15 + 3 + 5 * 10**6)


def test_radix_trie():
    texts = [b"to tea te t", "\u00c9t\u00e9 tea ten".encode(), b"x" * 300 + b" To", b"", b"te9tent"]
    counts = {"a": divergence.Counts(), "b": divergence.Counts()}
    want = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
    for k, text in enumerate(texts):
        source = "ab"[k % 2]
        new = counts[source].add(text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text.decode()))
        assert new == sum(not want[t.encode()][source][0] for t in set(found))
        for t in found:
            want[t.encode()][source][0] += 1
        for t in set(found):
            want[t.encode()][source][1] += 1
    trie = divergence.trie_of(counts)
    got = list(trie.ordered())
    assert got[0] == (b"", [("a", 0, 0), ("b", 0, 0)])
    assert [(t, sorted(c)) for t, c in got[1:]] == [(t, sorted((s, *n) for s, n in c.items() if n[0])) for t, c in sorted(want.items())]
    # an edge holds as many bytes as no other term leaves it, and children differ in their first
    nodes = [trie]
    while nodes:
        node = nodes.pop()
        assert node is trie or node.counts or len(node.children) > 1
        assert len({c.label[:1] for c in node.children}) == len(node.children)
        nodes += node.children


def test_crc32_in_sql():
    for c in (0, 7, 20, 123456789, -3):
        assert duckdb.sql(f"select {queries.crc32_sql(repr(str(c)))}").fetchall()[0][0] == zlib.crc32(str(c).encode())
