import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spurline.llm import components, exact, language, lattice, licenses, mixing, neardup, pages, pieces, quality, queries, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string"  # row clashes with a name used inside


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s0"), len(t or ""), "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and blank texts, ties, repeated rows and ids, one long text: read from files, as operators want it."""
    random.seed(3)
    words = ["alpha", "beta", "gamma", "delta", "Große", "naïve", "x1", "\U0001d4b3"]
    long = " ".join(random.choice(words) for _ in range(60_000))
    base = [f"{random.choice(words)}{k}" for k in range(80)]
    near = [*base]
    near[40:41] = ["changed", "more"]
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (5, "abc"), (6, "a  b c"), (None, "abc"), (7, long), (8, long + " "), (9, " ".join(base)), (10, " ".join(near)), (11, "one two"), (12, "one two"), (13, "123 456 !!!"), (14, "one three")]
    folder = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    documents(spark, texts, {1: None, 5: None, 9: "s1", 10: "s2"}).coalesce(2).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    documents(spark, []).write.parquet(folder)
    return spark.read.parquet(folder)


def test_exact_against_brute_force(odd, none):
    for size in (exact.BLOCK_BYTES, 3):  # few blocks, and many levels of names
        rows = [r.asDict() for r in odd.where("length(text) < 1000 or text is null").collect()] if size == 3 else [r.asDict() for r in odd.collect()]
        got = exact.find_copies(odd.where("length(text) < 1000 or text is null") if size == 3 else odd, size).collect()
        bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups = collections.defaultdict(list)
        for r in rows:
            groups[bare(r["text"])].append(r)
        want = collections.Counter()
        for b, members in groups.items():
            best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
            for k, r in enumerate(sorted(members, key=lambda r: r is not best)):
                want[r["doc_id"], best["doc_id"], len(members), k == 0, hashlib.sha256(b.encode()).hexdigest()] += 1
        assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert exact.find_copies(none).count() == 0


def test_mix(odd, none):
    got = mixing.mix(odd, leaf_rows=2).collect()
    assert len(got) == odd.count() and mixing.mix(none).count() == 0
    sizes = collections.Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == sizes
    assert all(r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] for r in got)
    per = {}
    for r in got:
        t, n, big = per.get((r["source_size"], r["target"]), (0, 0, 0))
        per[r["source_size"], r["target"]] = (t + r["taken"], n + 1, max(big, r["size"]))
    for (size, target), (taken, _, big) in per.items():
        assert abs(taken - target) <= big + 1e-6 and target <= 3 * size + 1e-6
    key = lambda rs: sorted(str(r) for r in rs)
    assert key(got) == key(mixing.mix(odd, leaf_rows=2).collect())


def test_targets_against_a_loop(spark):
    sizes = [("a", 10), ("b", 0), ("c", 1000), ("d", 5), (None, 70), ("B", 300)]
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {n: k % 3 + 1 for k, (n, _) in enumerate(order)}
    size, total = dict(sizes), sum(s for _, s in sizes)
    want, left = {}, set(size)
    while True:
        rest = total - sum(want.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in left) for n in left}
        over = [n for n in left if share[n] > 3 * size[n]]
        if not over:
            want.update(share)
            break
        for n in over:
            want[n] = 3.0 * size[n]
            left.discard(n)
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert all(abs(got[n] - want[n]) < 1e-6 for n in want)


def test_pieces_are_the_librarys(spark, odd, none):
    import sentencepiece

    model = queries.tokenizer_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = pieces.decode(pieces.encode(odd, model), model).collect()
    want = sorted((str(r["doc_id"]), sp.encode(r["text"] or ""), sp.decode(sp.encode(r["text"] or ""))) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == want and pieces.encode(none, model).count() == 0
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in pieces.round_trip(odd, model).collect()) == want and pieces.round_trip(none, model).count() == 0
    table, random_ = pieces.Table(sp), random.Random(5)
    signs = [" ", "  ", "\n", "▁", "a", "the", "\t", "\r", "é", "\U0001d4b3", "漢", "\x00", "<s>", "</s>", "<0x0A>", " ", "e\u0301", "//"]
    for _ in range(1500):
        text = "".join(random_.choice(signs) for _ in range(random_.randint(0, 12)))
        assert list(pieces.encode_texts([text], table)[1]) == sp.encode(text)


def test_pieces_rejects_a_model_that_crosses(monkeypatch):
    class Fake:
        def get_piece_size(self): return 1
        def id_to_piece(self, i): return "a▁b"
        def encode(self, t): return [0, 1]
        def decode(self, i): return ""

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", lambda model_proto: Fake())
    with pytest.raises(ValueError):
        pieces.check_model(b"")


def test_quality_learns_and_holds_out(spark, odd, none):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "."
    texts = [(i, good() if i % 3 else " | ".join(good().upper().split())) for i in range(240)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(160)] + [(0, 7, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, w).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(160, 240))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, w).collect()) and quality.score(none, w).count() == 0
    assert not quality.train(none, labels.limit(0)).any()
    assert np.array_equal(w, quality.train(docs, labels))


def test_quality_update_is_the_published_one():
    s = quality.Settings(passes=1)
    w = quality.learn(["a b", "c d"], [1, 0], s)
    z, n = np.zeros_like(w, dtype=float), np.zeros_like(w, dtype=float)
    for text, y in (("a b", 1), ("c d", 0)):
        j, v = quality.features(text, s)
        ww = [0.0 if abs(z[a]) <= s.l1 else -(z[a] - math.copysign(s.l1, z[a])) / ((s.beta + math.sqrt(n[a])) / s.alpha + s.l2) for a in j]
        p = 1 / (1 + math.exp(-sum(q * b for q, b in zip(ww, v))))
        for a, b, q in zip(j, v, ww):
            g = (p - y) * b
            z[a] += g - (math.sqrt(n[a] + g * g) - math.sqrt(n[a])) / s.alpha * q
            n[a] += g * g
    want = np.array([0.0 if abs(a) <= s.l1 else -(a - math.copysign(s.l1, a)) / ((s.beta + math.sqrt(b)) / s.alpha + s.l2) for a, b in zip(z, n)])
    assert np.allclose(w, want) and w.any()


def test_language(spark, odd, none, tmp_path):
    rng = random.Random(2)
    kinds = {"en": ["the", "and", "with", "thing", "over"], "de": ["und", "der", "schön", "nicht", "über"]}
    texts = [(i, " ".join(rng.choice(kinds["en" if i % 2 else "de"]) for _ in range(30))) for i in range(200)]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    model = language.fit(docs)
    assert model.names == ("de", "en", "und")
    more = documents(spark, [(1000, "qzx jkq vvw xqj zzk qqx wvx " * 9), (1001, None), (1002, "12 34 !!"), (1003, "über und der nicht")]).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s9"))
    rows = language.from_documents(docs.unionByName(more))
    got = {r["doc_id"]: r for r in language.identify(rows, model, carry=("doc_id",)).collect()}
    assert all(got[i]["lang"] == ("en" if i % 2 else "de") and got[i]["accepted"] for i in range(200))
    assert not got[1000]["accepted"] and not got[1001]["accepted"] and not got[1002]["accepted"] and got[1001]["text_lang"] is None
    assert got[1003]["lang"] == "de"  # text outweighs a wrong declaration
    web = spark.createDataFrame([(1, "http://a.x.de/", "<html lang='de'><script>the and</script><p>und der</p>"), (2, None, None)], "page_id long, url string, html string")
    pages_ = {r["page_id"]: r for r in language.identify(language.from_pages(web), model, carry=("page_id",)).collect()}
    assert pages_[1]["lang"] == "de" and not pages_[2]["accepted"]
    assert language.identify(language.from_documents(none), model, carry=("doc_id",)).count() == 0 and language.fit(none).names == ("und",)
    assert language.identify(language.from_documents(odd), model, carry=("doc_id",)).count() == odd.count()


def test_host_prior_decides_short_texts(spark):
    model = language.Likelihoods(("aa", "bb", "und"), np.log(np.full((2**16, 3), 2.0**-16)).astype(np.float32))
    model.table[:, 2] -= 3
    one, two = (next(language.grams(t, 16)) for t in ("qqq", "zzz"))
    model.table[one, 0] += 2
    model.table[two, 1] += 2
    rows = [(i, "qqq", False, None, "h.x.org") for i in range(50)] + [(99, "mmm", False, None, "h.x.org"), (100, "zzz " * 8, False, None, "k.y.org")]
    df = spark.createDataFrame(rows, "id long, text string, is_page boolean, declared string, host string")
    got = {r["id"]: r["lang"] for r in language.identify(df, model, carry=("id",)).collect()}
    assert got[99] == "aa" and got[100] == "bb"


def test_licences(spark, odd, none):
    texts = {
        1: "Intro.\nLicensed under the Apache License, Version 2.0. More words here.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Released under the MIT License.", 4: "Licensed under CC BY-NC 4.0.",
        5: "A licence of my own.", 6: "nothing", 7: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        8: "The software is available under the terms of the MIT licence. It is distributed under the Apache 2.0 License.",
    }
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, list(texts.items()))).collect()}
    assert [got[i]["licenses"] for i in range(1, 9)] == [["Apache-2.0"], ["GPL-3.0-only"], ["MIT"], ["CC-BY-NC-4.0"], [], [], ["BSD-2-Clause"], ["Apache-2.0", "MIT"]]
    assert got[5]["unknown"] == 1 and got[6]["unknown"] == 0 and got[7]["sentences"] == ["bsd-grant", "bsd-source", "bsd-binary"]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
BSD_TEXT = """Copyright (c) 2019, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL_HEADER = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */"""


def test_licence_texts_and_rules(spark):
    """Wrapped canonical texts in comments and lists; sequences in order, broken by other sentences, overlapping, and with neighbours made by a cut."""
    grant, source, binary, names = (next(t for t, i in licenses.SENTENCES.items() if i == f"bsd-{k}") for k in ("grant", "source", "binary", "names"))
    mit, notice = (next(t for t, i in licenses.SENTENCES.items() if i == f"mit-{k}") for k in ("grant", "notice"))
    cases = [
        (MIT_TEXT, ["MIT"]), (APACHE_HEADER, ["Apache-2.0"]), (BSD_TEXT, ["BSD-3-Clause"]), (GPL_HEADER, ["GPL-2.0-or-later"]), ("// SPDX-License-Identifier: MPL-2.0\nint x;", ["MPL-2.0"]),
        (" ".join((grant, source, binary)), ["BSD-2-Clause"]), ("\n".join((grant, source, binary, names)), ["BSD-3-Clause"]), ("\n".join((source, grant, binary)), []),  # order
        ("\n".join((grant, source, "A sentence of another kind.", binary)), []), ("\n".join((grant, source, "No warranty at all.", binary)), []),  # broken
        ("\n".join((grant, grant, source, binary)), ["BSD-2-Clause"]), ("\n".join((grant, source, binary, grant, source, binary, names)), ["BSD-3-Clause", "BSD-2-Clause"]),  # overlapping
        ("\n".join((grant, source, mit, notice, binary)), ["MIT"]),  # what stood around a match is not made neighbours
        ("All rights reserved.", ["Proprietary"]), ("\n".join(("All rights reserved.", "Released under the MIT License.")), ["MIT"]),
        ("This line is as long as wrapped ones are and has no mark at all\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("x" * 60 + "***\nReleased under the MIT License.", ["MIT"]),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(spark, list(enumerate(t for t, _ in cases)))).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    keys = [(r["k"], r["id"]) for r in spark.createDataFrame(licenses._known(), "s string, id string").select(licenses.normalised(F.col("s")).alias("k"), "id").distinct().collect()]
    assert len({k for k, _ in keys}) == len(keys)


def test_urls_against_startswith(spark):
    hosts, paths = ["net", "example.net", "a.example.net", "badexample.net", "example.com", "x.org", "", "EXAMPLE.Net"], ["", "/", "/en", "/en/", "/en/x/y", "/english", "/de/", "/fr/1"]
    seen = [f"http://{h}{p}{t}" for h, p, t in itertools.product(hosts, paths, ["", "?a=/en/", "#/de/"])] + [None, "", "no host", "a://b://c/en/"]
    rules = [*queries.URL_RULES, ("allow", "net", "/en"), ("block", "com", "/d"), ("block", "a.example.net", "/en/x/"), ("block", "x.org", "/"), ("allow", "x.org", "/"), (None, "com", "/"), ("block", None, "/")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(seen)] + [(0, seen[0], "clash")], "page_id long, url string, host string")
    got = urls.filter_urls(df, urls.rules_frame(spark, rules)).collect()
    assert len(got) == len(seen) + 1
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if v and h and host and path and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[3] if best else None, best[4] if best else "allow")
    assert urls.filter_urls(df, urls.rules_frame(spark, [])).where("verdict <> 'allow'").isEmpty()
    assert urls.filter_urls(df.limit(0), urls.rules_frame(spark, rules)).count() == 0


def test_main_text(spark):
    noise = '<nav><ul><li>Home</ul></nav><div class="box7"><span>Great offers {k}</span></div>'
    html = ["<html><body>" + noise.format(k=i % 3) + f"<div class='col'><h2>Title {i}</h2><p>Own   text&nbsp;{i} &lt;b&gt;<br>goes <i>on</i><p>More {i * 7}</div><footer>f</footer>" for i in range(40)]
    marked = "<body><header>H</header><article><h1>T &amp; c</h1>a <span class='ad'>AD</span>b<br>c<p>x<div class=share>S</div><ul><li>1<li>2</ul><div id='comments'><p>no</div><form>f</form><script>if(a<b){'</p>'}</script>tail</article><p>out"
    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(html)] + [(100, "http://o.example/", marked), (101, None, None), (102, "", ""), (103, "http://p.example/", "plain < text <!-- c"), (103, "http://p.example/", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    for sent in (32 << 20, 0):  # all noisy nodes sent, and those of large hosts only
        got = [(r["page_id"], r["text"]) for r in pages.extract(df, sent_bytes=sent).collect()]
        assert len(got) == len(rows)
        found = dict(got)
        for i in range(40):
            assert found[i] == f"Title {i}\nOwn text {i} <b> goes on\nMore {i * 7}"
        assert found[100] == "T & c\na b c\nx\n1\n2\ntail" and found[101] == found[102] == ""
        assert sorted(t for p, t in got if p == 103) == ["deep", "plain < text"]
    assert pages.extract(df.limit(0)).count() == 0


def brute_groups(texts, s):
    sets = [set(neardup.shingles(t, s)[0].tolist()) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= s.similarity:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return [texts[find(i)][0] for i in range(len(texts))]


def test_near_copies_against_brute_force(spark, odd, none, tmp_path):
    rng, s = random.Random(6), neardup.Settings()
    texts, base = [], [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    for i in range(120):  # a chain of edits: many links, many just below
        words = [*base]
        for k in rng.sample(range(150), rng.choice((1, 2, 3, 5, 8))):
            words[k] = f"e{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(words)))
    texts += [(200 + i, " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(50))) for i in range(30)] + [(300, texts[0][1].upper()), (301, None), (302, ""), (303, "!!!"), (304, "one two"), (305, "One, two!")]
    documents(spark, texts).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in neardup.near_copies(spark.read.parquet(str(tmp_path / "d"))).collect()}
    want = brute_groups(texts, s)
    assert [got[i]["component_id"] for i, _ in texts] == want
    size = collections.Counter(want)
    assert all(got[i]["group_size"] == size[w] and got[i]["kept"] == (i == w) for (i, _), w in zip(texts, want))
    rest = neardup.near_copies(odd).collect()
    assert len(rest) == odd.count() and neardup.near_copies(none).count() == 0
    by = collections.defaultdict(set)
    for r in rest:
        by[r["component_id"]].add(r["doc_id"])
    assert {9, 10} <= by[9] and {11, 12} <= by[11] and {7, 8} <= by[7]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, size=300, dtype=np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    agree = [np.mean(np.equal(*neardup.signatures([(e, a), (e, b)], neardup.Settings(seed=q)))) for q in range(12)]
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    alone = neardup.signatures([(e, a)], neardup.Settings())
    assert np.array_equal(alone[0], neardup.signatures([(e[:5], a[:5]), (e, a)], neardup.Settings())[1])


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8)) * 3
    p = lattice.nearest(v)
    assert np.all((np.abs(p * 2 - np.rint(p * 2)) < 1e-9)) and np.all(np.abs(p.sum(axis=1) % 2) < 1e-9)
    d = ((v - p) ** 2).sum(axis=1)
    assert len(lattice.roots()) == 240 and all(np.all(((v - p - r) ** 2).sum(axis=1) >= d - 1e-9) for r in lattice.roots())


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, centre = [], rng.normal(size=64)
    for i in range(260):
        v = centre + rng.normal(size=64) * 0.12 * rng.random() if i < 120 else rng.normal(size=64)
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, None, 0), (404, [0.0] * 64, 0), (405, [1.0] * 63 + [None], 0), (406, [float("nan")] * 64, 0), (407, [1e300] * 64, 1), (408, [], 0), (409, [1.0, 2.0], 0), (410, [2.0, 4.0], 0), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    got = {r["vec_id"]: r for r in lattice.near_vectors(df, lattice.Settings(block_rows=16)).collect()}
    ok = [i for i, (_, v, l) in enumerate(rows) if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = (np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in (a, b))
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    assert sum(links.values()) > 1000
    for i, r in enumerate(rows):
        if r[0] is not None:
            least = min((rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None), default=r[0])
            assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (links[i], least, least == r[0]), r[0]
    assert got[None]["n_links"] == links[len(rows) - 1] and not got[None]["kept"]
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(0).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[1001] == 1000
    more = components.merged(components.components(spark.createDataFrame(links, "a long, b long")), spark.createDataFrame([(1001, 5), (7000, 7001)], "a long, b long"))
    got = {r["id"]: r["component"] for r in more.collect()}
    assert got[1000] == 0 and got[1001] == 0 and got[7001] == 7000


def test_pipeline_stages(spark, odd, none, tmp_path):
    docs, seen = odd.withColumns({"copies": F.lit("c"), "key": F.lit("k")}), []
    docs.write.parquet(str(tmp_path / "more"))
    docs = spark.read.parquet(str(tmp_path / "more"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "copies", "key"]
            assert docs.where("row <> 'x' or copies <> 'c' or key <> 'k'").isEmpty()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "sentencepiece"]
    assert seen[0] == 12 and seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[4]


def test_held_out_fold_is_crc32(spark):
    got = [r[0] for r in spark.range(50).select(F.crc32(F.col("id").cast("string")) % 3).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 for i in range(50)]
