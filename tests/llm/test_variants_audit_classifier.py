"""Spelling variants, filter audit and quality classifier against brute force and on edge rows."""

import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkgrade.llm import audit, classifier, queries, spelling

DIR = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, word string, n long, bits int, score double, part string"


def _docs(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", s, "x", 1, 2, 0.5, "y") for i, t, s in rows], CLASHING)


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(counts):
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = {}
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), f, counts.get(f), root)
    return out


def _random_words(seed, size, letters="abé", lengths=(1, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(*lengths))): rng.choice([2, 3, 30, 400]) for _ in range(size)}


def _spelled(df):
    return {r["word"]: (r["n"], r["n_near"], r["best"], r["best_n"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_position_index_finds_one_edit(seed):
    words = sorted(_random_words(seed, 150)) + ["a" * 200, "a" * 201, "a" * 120 + "b" + "a" * 80]
    index = spelling.PositionIndex(words)
    for query, longest, shorter, half, half_longer in index.near(sorted(words)):
        pick = lambda bits: {w for j, w in enumerate(words) if bits >> j & 1}
        near = {w for w in words if _one_edit(query, w)}
        assert pick(longest | shorter) == near
        assert pick(half) >= {query} and all(w.startswith(query[: len(query) // 2]) for w in pick(half))
        assert pick(half_longer) == {w for w in words if w.startswith(query[: (len(query) - 1) // 2])}


@pytest.mark.parametrize("heavy", [None, 8])
def test_near_words_whole_and_sliced(spark, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(spelling, "BUCKET", heavy)
        monkeypatch.setattr(spelling, "HEAVY", 2 * heavy)
    counts = _random_words(7, 500) | {"q" * 300: 5, "q" * 301: 50, "abcdefg": 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {}
    for w in counts:
        near = [v for v in counts if _one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        want[w] = (counts[w], len(near), best, counts.get(best))
    assert _spelled(spelling.near_words(words)) == want


def test_spelling_edges(spark):
    long = "wonderful " * 5000 + "x" * 3000 + " " + "x" * 3000
    rows = [(1, "Wonderful wonderful WONDERFULL wonderfull", "a"), (2, None, "a"), (3, "", None), (4, long, "a"),
            (None, "wonderfull straße straßen straßen", "b"), (5, "ÀÉÎõü×÷ ÀÉÎõü×÷ àéîõü×÷", "b")]
    rows += [(6, "repeated sentence", "a")] * 2
    counts = Counter()
    for i, text, _ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run and i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if n >= 2}
    got = spelling.spelling_variants(_docs(spark, rows))
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()} == _variants(counts)
    assert spelling.spelling_variants(_docs(spark, rows).limit(0)).count() == 0


def test_chains_of_forms_end_at_the_root(spark):
    text = "abcdefgz " * 1 + "abcdefg " * 40 + "abcdeffg " * 2000
    rows = [(i, text, "a") for i in (100, 200)]
    got = {r["word"]: r["root"] for r in spelling.spelling_variants(_docs(spark, rows), slip=2**33).collect()}
    assert got == {"abcdefgz": "abcdeffg", "abcdefg": "abcdeffg", "abcdeffg": "abcdeffg"}


def _audit(rows, labels):
    bits = []
    for i, t, s in rows:
        t = t or ""
        words = t.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ")
        words = [w for w in words.split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        bits.append((s or "", {f for f, v in fails.items() if v}, any(k == i and q == 1 for k, q, _ in labels),
                     any(k == i and x == 1 for k, _, x in labels)))
    out = set()
    for part in {p for p, *_ in bits}:
        mine = [b for b in bits if b[0] == part]
        total = Counter()
        lines = []
        for order in permutations("ABCDE"):
            for at, f in enumerate(order):
                before = set(order[:at])
                gone = [b for b in mine if f in b[1] and not b[1] & before]
                total[f] += len(gone)
                lines.append((part, "".join(order), at + 1, sum(not b[1] & (before | {f}) for b in mine), len(gone),
                              sum(f in b[1] and bool(b[1] & before) for b in mine), sum(b[1] == {f} for b in mine),
                              sum(b[2] for b in gone), sum(b[3] for b in gone), f))
        out |= {line[:-1] + (total[line[-1]],) for line in lines}
    return out


def test_audit_against_brute_force(spark):
    fresh = " ".join(f"w{i}" for i in range(250))
    rows = [(1, fresh, "a"), (2, fresh, "a"), (2, fresh, "a"), (3, fresh, None), (None, fresh, "b"), (4, None, "b"),
            (5, "", "b"), (0, "SHORT TEXT", "b"), (6, "price $ 5", ""), (6, "price $ 5", "a"), (7, "same " * 30000, "a"),
            (8, "tab\tand\x0bother\x1cblank", "a"), (9, fresh + " ÄÖÜ", "clean")]
    rows += [(100 + i, "copied " * 220, "a") for i in range(70)]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (0, None, 1), (4, 1, 1), (120, 1, 0), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(_docs(spark, rows), marks)
    assert {tuple(r) for r in got.collect()} == _audit(rows, labels)
    assert audit.filter_audit(_docs(spark, rows).limit(0), marks).count() == 0
    assert got.count() == 4 * 600


def test_repeats_compare_whole_texts(spark):
    """Rows of one hash but different texts are no copies."""
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "a", 7), (3, "a", 7), (4, "c", 8)],
                                 "id long, text string, hash long")
    assert sorted(r.id for r in audit.repeated_rows(rows).collect()) == [3, 3]


def test_trees_walk_like_nested_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    trees = classifier.fit_trees(x, y, trees=30, depth=3)
    odds = []
    for row in x:
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        odds.append(total)
    assert np.allclose(trees.probability(x), 1 / (1 + np.exp(-np.array(odds))))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.95


def test_classifier_on_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    scored = queries.op13_classifier(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").toPandas()
    held = scored[scored["held_out"]]
    assert 50 < len(held) < len(scored)
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert set(held["held_out"].index) and all(
        h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(scored["doc_id"], scored["held_out"]))


def test_classifier_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 40000, None), (3, "word " * 40000, None), (None, "one two", "b")]
    docs = _docs(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classifier.score_quality(docs, none, keep=("n", "word")).toPandas()
    assert list(got.columns) == ["doc_id", "n", "word", "score"] and (got["score"] == 0.5).all() and len(got) == 5
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = classifier.score_quality(docs, labels).toPandas()
    assert len(got) == 5 and got["score"].between(0, 1).all()
    by_id = got.groupby("doc_id")["score"].nunique()
    assert by_id.max() == 1 and got["score"][got["doc_id"] == 1].iloc[0] == got["score"][got["doc_id"] == 2].iloc[0]
    assert classifier.score_quality(docs.limit(0), labels).count() == 0


def test_classifier_uses_text_alone(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    mixed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0)})
    a, b = (classifier.score_quality(d, labels).toPandas().sort_values("doc_id")["score"] for d in (docs, mixed))
    pd.testing.assert_series_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_other_tokenizers_encode_whole_texts():
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    from inkgrade.llm import packing

    texts = ["Don't STOP 12, it's\tnaïve... <b>", "a<|endoftext|>b", "İstanbul ß 5%", "", "x" * 5000 + " , " + "y " * 3000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        if not os.path.exists(path):
            continue
        ids, plain = packing.WordIds(path), Tokenizer.from_file(path)
        assert ids.by_chunks == (name == "word_bpe_49k.json")
        for text in texts:
            assert np.frombuffer(ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
