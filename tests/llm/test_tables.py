import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spurline.llm import language, mixing, neardup, pages, quality


def test_identical_blocks_in_a_marked_text_go(spark):
    """A notice in unnamed elements, or such with a plain name, on all pages of a host; texts of its own stay."""
    page = "<html><body><article><h1>Title {i}</h1><div><p>The same notice.</p></div><section class='content'><ul><li>Share it<li>Print it</ul></section><p>Own text {i} of this page.<p>More {j}</article></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i, j=i * 7)) for i in range(40)]
    rows += [(100 + i, "http://copies.example/", "<main><h1>One title</h1><p>One text</p></main>") for i in range(20)]
    rows += [(200, "http://alone.example/", page.format(i="x", j="y"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for sent in (32 << 20, 0):
        got = {r["page_id"]: r["text"] for r in pages.extract(df, sent_bytes=sent).collect()}
        assert all(got[i] == f"Title {i}\nOwn text {i} of this page.\nMore {i * 7}" for i in range(40))
        assert all(got[100 + i] == "One title\nOne text" for i in range(20))
        assert got[200] == "Title x\nOwn text x of this page.\nMore y"


def test_support_does_not_grow_with_the_table(spark, tmp_path):
    """A menu on six pages of a host of 8,000, and a branch that six small hosts share: gone as in small tables."""
    own = "<div class='col'><p>Own text {i} {j}</p></div>"
    rows = [(i, "http://big.example/", "<body>" + ("<div class='strip'><span>To all parts</span></div>" if i < 6 else "") + own.format(i=i, j=i * 3)) for i in range(8000)]
    rows += [(9000 + i, f"http://small{i}.example/", "<body><div class='lot'>Made with a kit</div>" + own.format(i=i, j="x")) for i in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    df = spark.read.parquet(str(tmp_path / "pages"))
    for sent, of_host in ((32 << 20, 64 << 10), (32 << 20, 0), (0, 64 << 10)):  # sent, hosts with many nodes, too many in all
        got = {r["page_id"]: r["text"] for r in pages.extract(df, sent_bytes=sent, host_bytes=of_host).collect()}
        assert len(got) == 8006 and all(got[i] == f"Own text {i} {i * 3}" for i in range(8000))
        assert all(got[9000 + i] == f"Own text {i} x" for i in range(6))


def test_rare_language_is_kept(spark):
    """Eight Korean documents of 12,008, under 0.1 percent, are fitted to and accepted; large languages are fitted to a part."""
    rng = random.Random(5)
    kinds = {"en": ["the", "and", "with", "thing", "over"], "de": ["und", "der", "schön", "nicht", "über"], "ko": ["나무", "사람", "하늘", "바다", "그리고"]}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(20)), lang, "s") for i, lang in enumerate([*["en", "de"] * 6000, *["ko"] * 8])]
    docs = spark.createDataFrame([*rows, (20000, "the and", "qq", "s")], "doc_id long, text string, lang string, source string")
    for s in (language.Settings(), language.Settings(rows=300)):
        model = language.fit(docs, s)
        assert model.names == ("de", "en", "ko", "und")
        got = language.identify(language.from_documents(docs.where("doc_id % 50 = 0 or lang = 'ko'")).withColumn("was", F.col("lang")), model, s, carry=("was",)).collect()
        assert len(got) > 200 and all(r["lang"] == r["was"] and r["accepted"] for r in got if r["was"] != "qq")


def test_importance_against_direct_entropies(spark):
    """Of every node of the merged pages, also of declared branches and of a marked text; and of a tree cut at its depth."""
    rng, s = random.Random(8), pages.Settings()
    li = lambda: "".join(f"<li>{rng.choice('abc')}</li>" for _ in range(rng.randint(1, 3)))
    rows = [
        (rng.choice(("x.org", "x.org", "y.org")), f"<body><nav><ul>{li()}</ul></nav><article><h1>T{i}</h1>" + "".join(rng.choice(("<p>One.</p>", f"<p>Two {i}.</p>", "<div class=q><p>Three</p></div>")) for _ in range(4)) + "</article>" + "<div>" * 70 + "deep</div></body>")
        for i in range(30)
    ]
    got = {(r["host"], r["node"]): r for r in pages.importance(pages.count_features(spark.createDataFrame(rows, "host string, html string")), s).collect()}
    parsed = [(h, pages.parse(p)) for h, p in rows]
    checked = 0
    for host in ("x.org", "y.org"):
        of = [p for h, p in parsed if h == host]
        under = [p.textual() for p in of]
        pages_of = Counter(n for u in under for n in u)
        for node, m in pages_of.items():
            if m < 2:
                assert got[host, node]["importance"] == 1.0
                continue
            shown = Counter(p.styles[node] for p, u in zip(of, under) if node in u and p.styles.get(node))
            e = -sum(k / m * math.log(k / m, m) for k in shown.values())
            texts = Counter(x for p, u in zip(of, under) for x in {(b.node, b.text) for b in p.blocks if b.node and node in u[b.node]})
            c = sum(1 - math.log(k) / math.log(max(pages_of[n], 2)) for (n, _), k in texts.items()) / len(texts)
            want = (1 - s.gamma ** len(shown)) * e + s.gamma ** len(shown) * c
            assert got[host, node]["pages"] == m and abs(got[host, node]["importance"] - want) < 1e-9
            checked += 1
    assert checked > 20


def test_the_tree_judges_declared_and_marked_branches(spark):
    """What the tree finds unimportant is counted in declared branches too; a lower least lets importance outweigh the prior."""
    page = "<body><nav><ul><li>Home<li>News</ul></nav><article><p>Own {i}.<p>Always this.</article><footer>Own foot {i}</footer></body>"
    df = spark.createDataFrame([(i, "http://h.example/", page.format(i=i)) for i in range(12)], "page_id long, url string, html string")
    for r in pages.extract(df).collect():
        assert r["text"] == f"Own {r['page_id']}.\nAlways this." and r["n_noisy"] == 2  # p's of one node: important together
    assert all("Own foot" in r["text"] and "Home" not in r["text"] for r in pages.extract(df, pages.Settings(least=0.35)).collect())


def test_deep_pages_are_linear(spark):
    html = ["<div>" * 50_000 + "end", "".join(f"<div>{i} " for i in range(20_000)), "<ul><li>" + "<div>" * 2000 + "<li>b" * 2000]
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got[0] == "end" and got[1].count("\n") == 19_999 and len(got[2]) == 3999
    assert all(len(pages.parse(h).above) <= pages.DEPTH for h in html)


def test_trigrams_of_long_texts():
    words = [random.Random(1).choice(("ab", "ß", "xyz")) for _ in range(2 * language._LONG + 7)]
    whole = f" {' '.join(words)} ".encode()
    parts = list(language.grams(" ".join(words), 16))
    assert len(parts) == 3 and sum(map(len, parts)) == len(whole) - 2
    b = np.frombuffer(whole, dtype=np.uint8).astype(np.uint32)
    assert np.array_equal(np.concatenate(parts), ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16))


def test_posterior_against_brute_force(spark):
    rng, s = random.Random(9), language.Settings()
    kinds = {"en": ["the", "and", "with", "thing"], "de": ["und", "der", "nicht", "über"], "fr": ["le", "est", "pas", "une"]}
    langs = [rng.choice(list(kinds)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(0, 4))), "xx" if i % 20 == 0 else rng.choice([k, k, None]), rng.choice(["a.x.de", "b.x.de", "y.org", "src", None])) for i, k in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(df)
    k, got = len(model.names), {r["doc_id"]: r for r in language.identify(language.from_documents(df), model, carry=("doc_id",)).collect()}
    assert k == 4

    # likelihoods from counts in plain loops
    counts = [Counter(c for _, t, l, _ in rows if l == n for part in language.grams(t, s.bits) for c in part.tolist()) for n in model.names[:-1]]

    def log_p(at, gram):
        if at == k - 1:
            return -s.bits * math.log(2)
        p = (counts[at][gram] + 1) / (sum(counts[at].values()) + 2**s.bits)
        return math.log(max(p, 2.0**-s.bits / (1 if counts[at][gram] else s.unseen)))

    likely = [[sum(log_p(a, c) for part in language.grams(t, s.bits) for c in part.tolist()) / s.temper for a in range(k)] for _, t, _, _ in rows]
    best = [max(range(k), key=lambda a: v[a]) if rows[i][1] else None for i, v in enumerate(likely)]
    said = [k if l is None else model.names.index(l) if l in model.names[:-1] else k - 1 for _, _, l, _ in rows]
    confusion = [[1 + sum(b == x and d == y for b, d in zip(best, said)) for y in range(k + 1)] for x in range(k)]
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None
    suffix = lambda h: h.split(".")[-1] if h and "." in h else None

    def shares(level, i):
        n = [sum(b == a and level(rows[r][3]) == level(rows[i][3]) for r, b in enumerate(best)) for a in range(k)]
        return n, sum(n)

    for i in range(len(rows)):
        everything = [x + 1 / k for x in shares(lambda h: 0, i)[0]]
        p = [x / sum(everything) for x in everything]
        for level, weight in ((suffix, s.suffix), (domain, s.domain)):
            n, total = shares(level, i)
            p = [(x + weight * q) / (total + weight) for x, q in zip(n, p)]
        n, total = shares(lambda h: h or "", i)
        own = best[i]
        prior = [(x - (own == a) + s.host * q) / (total - (own is not None) + s.host) for a, (x, q) in enumerate(zip(n, p))]
        fused = [likely[i][a] + math.log(prior[a]) + math.log(confusion[a][said[i]] / sum(confusion[a])) for a in range(k)]
        top = max(range(k), key=lambda a: fused[a])
        posterior = 1 / sum(math.exp(x - fused[top]) for x in fused)
        assert abs(got[i]["posterior"] - posterior) < 1e-4 and (got[i]["lang"] == model.names[top] or posterior < 0.51)
        assert got[i]["accepted"] == bool(rows[i][1] and top < k - 1 and posterior >= s.sure) or abs(posterior - s.sure) < 1e-3


def test_short_texts_of_a_known_language_are_kept(spark):
    rng = random.Random(3)
    words = ["water", "river", "stone", "under", "where", "there", "other", "rain"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(300)), "en", "s") for i in range(20)] + [(90, "river stone", "en", "s"), (91, "the stoned waters", "en", "s"), (92, "qzx jkq vvw xqj zzk " * 9, None, "t")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["accepted"] for r in language.identify(language.from_documents(docs), language.fit(docs), carry=("doc_id",)).collect()}
    assert got[90] and got[91] and not got[92]


def test_score_against_sparse_dots(spark):
    s, rng = quality.Settings(), np.random.default_rng(0)
    w = rng.normal(size=quality._width(s)).astype(np.float32)
    texts = ["One two, two three 44!", "", None, "a", "b a b a " * 500]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), w).collect()}
    for i, t in enumerate(texts):
        at, x = quality.features(t, s)
        z = sum(float(w[a]) * float(v) for a, v in zip(at, x))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6


def test_equal_rows_of_a_source_are_one_row_of_the_tree(spark):
    rows = [(1, "one two three", "s")] * 20_000 + [(i, "four five six seven", "t") for i in range(2, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).collect()
    assert sorted(r["n"] for r in got) == [4998, 20_000]
    assert all(abs(r["taken"] - r["target"]) <= 4 and r["most"] <= 3 for r in got)
    # with a column that tells equal rows apart they are dealt over the leaves
    carried = df.withColumn("row", F.monotonically_increasing_id())
    again = mixing.mix(carried, carry=("row",)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.countDistinct("row").alias("n")).collect()
    assert sorted(r["n"] for r in again) == [4998, 20_000] and all(abs(r["taken"] - r["target"]) <= 4 for r in again)


def test_targets_of_many_sources_need_no_single_task(spark):
    n = 30_000
    got = mixing.targets(spark.range(n).select(F.format_string("h%06d", "id").alias("source"), (F.col("id") % 97 + 1).alias("source_size")))
    r = got.agg(F.sum("target"), F.sum("source_size"), F.max("rank"), F.count_if(F.col("target") > 3 * F.col("source_size") + 1e-9)).first()
    assert abs(r[0] - r[1]) < 1e-3 and r[2] == n and r[3] == 0
    assert got.where("weight <> (rank - 1) % 3 + 1").isEmpty()


def test_overlaps_are_jaccard():
    rng, s = random.Random(7), neardup.Settings(words=1, weighted=True)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    sets = [neardup.shingles(t, s) for t in texts]
    counts = [Counter(t.split()) for t in texts]
    like = neardup.Overlaps(sets)
    for i, a in enumerate(counts):
        assert np.allclose(like.similarity(i), [sum((a & b).values()) / sum((a | b).values()) for b in counts])


def test_loose_family_across_blocks(spark, tmp_path, monkeypatch):
    """Many texts around the threshold in crowded buckets, compared in small blocks: the groups of brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, s = random.Random(16), neardup.Settings()
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for i in range(160):
        words = [*base]
        for k in rng.sample(range(120), rng.choice((1, 2, 3, 3, 4, 4))):
            words[k] = f"e{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(words)))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_copies(spark.read.parquet(str(tmp_path / "d"))).collect()}
    sets, parent = [set(neardup.shingles(t, s)[0].tolist()) for _, t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= s.similarity:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    want = [find(i) for i in range(len(texts))]
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 1
