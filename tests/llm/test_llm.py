"""Operators of the llm subpackage against brute force, their SQL twins, and edge rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkgrade.llm import html, licenses, mixing, ngram_join, packing, pii, quality, queries, sharding, topk, urls
from tools.compare import cell

DIR = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "mail a.b@c.example.com"
EDGES = [(1, None), (2, ""), (3, LONG), (4, LONG), (4, LONG), (5, "one two"), (None, "one two three four five six")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", s, 7, "x", "y") for (i, t), s in zip(EDGES, ["a", None, "a", "a", "a", "b", "b"])]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size string, hash string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = duck.execute(queries.ORACLES[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == want


def _base(text):
    found = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                 ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                 ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]:
                found.append(f"{k}:{m.start()}:{m.end()}")
    return found


def test_pii(spark, documents):
    odd = ["a@b.c@d.e x@y..z 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111-2", "+1 (555) 010-9999+1+49 30 12345678", "@.@",
           "4111111111111111 é 💳 4111-1111-1111-1111 . . 001.2.3.4"]
    docs = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(odd, -9)), "doc_id long, text string"))
    found = {(r["doc_id"], pii_text(r["base"])) for r in pii.find_pii(docs).collect()}
    assert found == {(r["doc_id"], ",".join(_base(r["text"]))) for r in docs.collect()}


def pii_text(spans):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def test_pii_digest_and_mask(edges):
    rows = pii.find_pii(edges.where("doc_id = 4"), accepted=frozenset()).select(F.sha2(pii.joined(F.col("base")), 256))
    start = LONG.index("a.b@")
    want = hashlib.sha256(f"email:{start}:{len(LONG)}".encode()).hexdigest()
    assert [r[0] for r in rows.collect()] == [want] * 2
    assert pii.masked("call +1 555 010 9999 or a@b.co", frozenset()) == "call [PHONE] or [EMAIL]"
    assert pii.masked(None, frozenset()) is None


def test_votes_separate_secrets_from_numbers():
    counts = {"4|yy-yy|4": 156, "10|---n-|2": 161, "10|--nn-|2": 20}
    assert pii.fit_classifier(counts, pii.fit_labelers(counts)) == {"4|yy-yy|4"}


def test_packing(spark, documents, edges):
    docs = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.tokenized(docs, tokenizer=path)
    rows = packing.pack(pieces, group=128).collect()
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(str(r["doc_id"]), p, 4096 * p, ids[4096 * p:4096 * p + 4096]) for p in range(-(-len(ids) // 4096))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for used in places.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1.03 * sum(r["length"] for r in rows) / 4096 + 2


def test_words_as_the_tokenizer_has_them():
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["It's ONE-two, don't 1234", "é e\u0301 ΑΣ ß İx <|endoftext|>", "a\x1cb \xa0c 日本語", "", "  "]:
        assert np.frombuffer(ids(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use</div>%s<aside>side</aside><footer>&copy; x</footer></body>"""


def test_html(spark):
    article = "<article><h1>A &amp; B</h1><p><b>One\n  two<br><p>Three<ul><li>x<li>y</ul><div class='comments'>no</div></article>"
    plain = "<div>Same text</div><div>Own {}</div><script>var a='</p>';</script><form>f</form>"
    rows = [(1, "http://a.b/1", PAGE % article), (2, "http://a.b/2", None), (3, None, "loose <!-- no --> text"), (4, "x", "")]
    rows += [(10 + i, "http://c.d/", PAGE % plain.format(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\n\nOne two\n\nThree\n\nx\n\ny"
    assert (got[2], got[3], got[4]) == ("", "loose text", "")
    assert [got[10 + i] for i in range(6)] == [f"Own {i}" for i in range(6)]


def test_html_repeats_and_options():
    a = html.folded(html.page_tree("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>")[0])
    assert a[1][0][1][0][0] == "(h2 p)" and a[1][0][1][0][2] == 1
    b = html.align(html.page_tree("<p>a</p><ul>b</ul>")[0][1], html.page_tree("<p>a</p>")[0][1])
    assert [(n[0], n[3]) for n in b] == [("p", 0), ("ul", 1)]


def test_html_template_inside_the_article(spark):
    page = "<article><h1>T{0}</h1><div>Join our club</div><p>Text {0}</p><p>More {0}</p><p>Read on below</p></article>"
    beside = "<aside><article>Other</article></aside><div>Prose {0}</div>"
    rows = [(i, "http://a.b/", page.format(i)) for i in range(6)] + [(10 + i, "http://c.d/", beside.format(i)) for i in range(6)]
    rows += [(20 + i, "http://e.f/", f"<div>{i}</div><main>Always so</main>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"T{i}\n\nText {i}\n\nMore {i}" for i in range(6)]
    assert [got[10 + i] for i in range(6)] == [f"Prose {i}" for i in range(6)]
    assert {got[20 + i] for i in range(6)} == {"Always so"}


def test_html_deep_and_wide(spark):
    deep = "<div>" * 60 + "<nav>menu</nav>" + "</div>" * 60
    page = f"<article><div>{deep}</div><p>First</p></article><article><p>After</p></article>"
    wide = "<body><div>Same</div>" + "".join(f"<h2>a{{0}}-{i}</h2><p>b{{0}}-{i}</p><ul>c{{0}}-{i}</ul><h3>d</h3><dl>e</dl>"[: 99] for i in range(3))
    odd = "".join(f"<div class={chr(97 + i // 26)}{chr(97 + i % 26)}x>v{i}-{{0}}</div>" for i in range(400))
    rows = [(1, "http://a.b/1", page)]
    rows += [(10 + i, "http://c.d/", (wide + odd).format(i)) for i in range(6)]
    rows += [(20 + i, "http://e.f/", f"<div>{'Same' if i else 'Other'}</div><div>Own {i}</div>") for i in range(7)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "First\n\nAfter"
    assert "Same" not in got[10] and got[10].split("\n\n")[-400:] == [f"v{i}-0" for i in range(400)]
    assert [got[20 + i] for i in range(7)] == ["Other\n\nOwn 0", *[f"Own {i}" for i in range(1, 7)]]
    x, y = [[n] for n in "abcab" * 30], [[n] for n in "bacba" * 30]
    pairs = html._long_matching([n for n, in x], [n for n, in y])
    assert len(pairs) == len(html._matching(x, y)) and all(x[i] == y[j] for i, j in pairs)


def test_licenses(spark, documents, edges):
    odd = ["MIT License mit license,MIT-LICENSE", "Licensed under CC BY-NC 4.0.", "the gnu general public license apache license", "mit licensee"]
    docs = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text")).unionByName(
        spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string"))
    rows = licenses.license_digest(licenses.scan_licenses(docs)).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def brute(i, text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        at = {p: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p in licenses.BASE_PHRASES}
        every = sorted(x for v in at.values() for x in v)
        labels = ",".join(sorted(licenses.BASE_PHRASES[p] for p, v in at.items() if v))
        return (str(i), len(w), len(every), str(every[0] if every else None), str(every[-1] if every else None), labels)

    got = sorted((str(r[0]), r[1], r[2], str(r[3]), str(r[4]), r[5]) for r in rows)
    assert got == sorted(brute(*r) for r in docs.collect())
    by = {r["doc_id"]: r for r in rows if r["doc_id"] and r["doc_id"] >= 10**6}
    assert by[10**6 + 1]["labels"] == "cc-by-nc"  # the shorter cc by lies within
    assert by[10**6 + 2]["labels"] == "apache,gpl" and by[10**6 + 3]["labels"] == ""


def test_licenses_without_the_word(spark):
    texts = {
        "(c) 2024 Someone. All Rights\nReserved.": "proprietary", "Released into the Public-Domain.": "public-domain",
        "Public domain": "public-domain", "released under CC BY-SA 4.0": "cc-by-sa",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "apache,mit", "distributed under the GPLv3": "gpl",
        "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided": "bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files": "mit",
        "see http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
        "rights reserved, domain, under mit": "", "Er ging mit der Apache": "",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = licenses.license_digest(licenses.scan_licenses(docs)).orderBy("doc_id").collect()
    assert {t: r["labels"] for t, r in zip(texts, got, strict=True)} == texts
    own = licenses.scan_licenses(docs, phrases={"rights reserved": "x"}, rules=[("y", " domain ", 2, " domain(?= )")])
    assert [x["label"] for r in own.orderBy("doc_id").collect() for x in r["detections"] or ()] == ["y"] * 3


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 9.0]), (2, [0.5, -9.0]), (3, None),
            (4, [float("nan"), 1.0]), (None, [0.5, 1.0]), (7, [1.0]), (8, [1e300, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query=F.col("vec_id") % 50 == 0, k=4)
    assert [tuple(r) for r in got.where("query_id = 0").orderBy("rank").collect()] == [
        (0, 1, 8, 2**63 - 1), (0, 2, 50, 65536), (0, 3, 1, 32768), (0, 4, 2, 32768)]


def test_ngram_join(spark, documents, edges):
    base = [f"w{i}" for i in range(120)]
    near = [(10**6 + i, " ".join(base[:i] + ["other"] + base[i + 1:])) for i in range(0, 120, 3)]
    docs = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text").where("doc_id is not null").distinct()).unionByName(
        spark.createDataFrame(near, "doc_id long, text string")).where("doc_id > 5 or text is null or length(text) < 60")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = t.lower().split() if t else []
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = len(sets[a]), len(sets[b])
            if x and y and 100 * min(x, y) >= 80 * max(x, y) and 100 * (s := len(sets[a] & sets[b])) >= 80 * (x + y - s):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    want = sorted((i, len(sets[i]), root(i)) for i in ids)
    crowd, ngram_join.CROWD = ngram_join.CROWD, 4  # also through the crowded path
    try:
        assert sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect()) == want
    finally:
        ngram_join.CROWD = crowd


def test_signatures_meet():
    random = np.random.default_rng(1)
    for _ in range(400):
        size = int(random.integers(1, 300))
        a = np.unique(random.integers(0, 2**63, size).astype(np.uint64))
        drop, add = random.integers(0, size // 8 + 1, 2)
        b = np.unique(np.concatenate([a[random.permutation(len(a))[drop:]], random.integers(0, 2**63, add).astype(np.uint64)]))
        if ngram_join.linked(a, b):
            (x, s), (y, t) = ngram_join.signatures(a), ngram_join.signatures(b)
            both = len(np.intersect1d(x, y))
            assert both >= 1 and both >= min(s, t, len(x))


def test_mixing_edges(edges):
    rows = mixing.mixed_copies(edges).collect()
    assert len(rows) == len(EDGES) and all(r["mix"]["copies"] <= 3 and r["size"] == "x" for r in rows)
    mixed = mixing.mix_documents(edges)
    assert mixed.columns == edges.columns and mixed.count() == sum(r["mix"]["copies"] for r in rows)


def test_mixing_meets_targets(documents):
    rows = mixing.mixed_copies(documents).groupBy("source").agg(
        F.sum(F.col("mix.copies") * F.col("mix.size")).alias("taken"), F.max("mix.target").alias("target"),
        F.max("mix.size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["most"] for r in rows)


def test_sharding(documents, edges):
    docs = documents.unionByName(edges.select(documents.columns))
    text = F.coalesce("text", F.lit(""))
    rows = sharding.shard_groups(docs, shards=4, size=F.octet_length(text) + 1, group=text, keep={"text": text, "crc": F.crc32(F.encode(text, "UTF-8"))}).collect()
    shard = {}
    for r in rows:
        assert r["crc"] == zlib.crc32(r["text"].encode()) and r["size"] == len(r["text"].encode()) + 1
        assert shard.setdefault(r["text"], r["shard"]) == r["shard"]
    for s in range(4):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    assert len(rows) == docs.count()


def test_sharding_within_a_small_capacity(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("size"))
    got = sharding.shard_groups(docs, capacity=6, size=F.col("size"), group=F.col("doc_id"))
    assert got.groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s"), F.count("*")).first()[0] <= 6
    docs = docs.withColumn("size", F.lit(10))
    got = sharding.shard_groups(docs, capacity=800, size=F.col("size"), group=F.col("doc_id"))
    most, shards, rows = got.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).agg(
        F.max("s"), F.count("*"), F.sum("n")).first()
    assert most <= 800 and shards <= 800 and rows == 60_000


def test_best_fit_decreasing():
    sizes = np.random.default_rng(2).integers(1, 60, 300).tolist()
    where = sharding.best_fit_decreasing([(s, i) for i, s in enumerate(sizes)], 100)
    room, want = [], {}
    for s, i in sorted(((s, i) for i, s in enumerate(sizes)), key=lambda x: (-x[0], str(x[1]))):
        fit = min(((r, b) for b, r in enumerate(room) if r >= s), default=None)
        b = fit[1] if fit else len(room)
        room += [] if fit else [100]
        room[b] -= s
        want[i] = b
    assert where == want
    shard = sharding.balanced([(s, i) for i, s in enumerate(sizes)], 8)
    fill = np.bincount([shard[i] for i in range(len(sizes))], sizes)
    assert fill.max() - fill.min() <= 0.02 * fill.max()


def test_quality_stats():
    text = "a b c a b c a b\nx#|\n\nx#|\né\xa0b  "
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    assert quality.text_stats(text)[0] == [len(words), sum(map(len, words)), 4, 1, len(hit)]
    assert quality.text_stats(None)[0] == [0, 0, 0, 0, 0]


def test_quality_verdicts(spark, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = quality.quality_verdicts(docs, train).join(held, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.95
    plain = quality.quality_verdicts(edges, None).collect()
    assert len(plain) == len(EDGES) and not any(r["kept"] for r in plain)


def test_quality_is_monotone():
    random = np.random.default_rng(3)
    x = random.normal(size=(500, 2))
    forest = quality.fit_forest(x, (x[:, 0] + random.normal(size=500) > 0).astype(float), [1, 0])
    line = np.stack([np.linspace(-3, 3, 200), np.zeros(200)], axis=1)
    assert (np.diff(forest.score(line)) >= -1e-12).all()


def test_url_edges(spark):
    rows = [(1, None), (2, "nothing"), (3, "http://example.com"), (4, "HTTP://WWW.Example.COM/en/x?y"), (5, "a://b.net/fr/"),
            (6, "a://notexample.com/en/"), (7, "x://m.example.com/en/#t"), (8, "x://net/es")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(
        spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("example.com", "", None, "allow"),
                   4: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 5: ("b.net", "/fr/", "net/fr/", "block"),
                   6: ("notexample.com", "/en/", "com/", "allow"), 7: ("m.example.com", "/en/", "example.com/en/", "block"),
                   8: ("net", "/es", None, "allow")}


def test_empty_tables(spark, edges):
    none = edges.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (pii.find_pii(none), packing.pack(packing.tokenized(none, tokenizer=path)), html.extract_text(pages),
               licenses.scan_licenses(none), topk.top_k(vectors, is_query=F.lit(True)), ngram_join.near_duplicates(none),
               mixing.mix_documents(none), sharding.shard_groups(none, shards=16, size=F.length("text"), group=F.col("text")),
               quality.quality_verdicts(none, labels), urls.filter_urls(pages)):
        assert df.count() == 0


def test_pipeline(spark, documents):
    import corpus_pipeline

    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == documents.columns
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == want


def test_new_words_need_the_model_only(monkeypatch):
    """Plain words never pass through the normalizer again, and a cache that overflows within a text loses nothing."""
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    plain, ids.tokenizer = ids.tokenizer, None
    text = " ".join([*packing._PLAIN_SIGNS, "Übergrößen,", "l'été", "(naïve)", "don't", "ÀÉ9x", "the", "THE", "the--The"])
    monkeypatch.setattr(packing, "_CACHE_BYTES", 400)
    for _ in range(2):
        assert np.frombuffer(ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(ids) < 10
