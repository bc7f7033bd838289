"""Pipeline stages on edge rows, columns named like results, and licence suppression against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkgrade.llm import licenses, ngram_join, packing, pii, quality

DIR = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]
TEXT = " ".join(WORDS)
NEAR = " ".join([*WORDS[:-1], "other"])


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(1, TEXT), (2, NEAR), (3, TEXT), (4, None), (5, ""), (5, ""), (6, "mail a.b@c.example.com now"), (None, TEXT),
             (7, "one text of its own"), (7, "quite another text under that id"), (7, "one text of its own"), (8, None)]
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), n, "x", "y", True) for n, (i, t) in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long, kept int, judged string, found string, "
        "base_failed boolean")


def test_one_of_each_group(spark, rows):
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["kept"])
                 for r in corpus_pipeline.one_of_each_group(spark, rows, DIR).collect())
    assert got == sorted([(1, TEXT, 0), (4, "", 3), (5, "", 4), (6, "mail a.b@c.example.com now", 6), (0, TEXT, 7),
                          (7, "one text of its own", 8), (7, "quite another text under that id", 9), (8, "", 11)])


def test_stages_keep_columns_named_like_results(spark, rows):
    judged = corpus_pipeline.quality_rules(spark, rows, DIR)
    assert judged.columns == rows.columns
    want = {r["kept"] for r in rows.collect() if r["text"] in (TEXT, NEAR)}
    verdicts = quality.quality_verdicts(
        rows.select("doc_id", "text", F.col("kept").alias("at")),
        spark.read.parquet(f"{DIR}/labels.parquet"), keep=("at",)).where("kept").collect()
    assert {r["kept"] for r in judged.collect()} == {r["at"] for r in verdicts} <= want
    clean = corpus_pipeline.personal_data(spark, rows, DIR)
    assert clean.columns == rows.columns
    texts = {r["kept"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[6] == ("mail [EMAIL] now", 16) and texts[3][0] is None and texts[5] == ("", 0) and len(texts) == 12
    assert corpus_pipeline.source_mix(spark, rows, DIR).columns == rows.columns


def test_results_win_over_columns_of_their_name(spark, rows):
    found = pii.find_pii(rows.withColumn("spans", F.lit(1)), keep=("found", "spans"), accepted=frozenset())
    assert found.columns == ["doc_id", "found", "base", "spans"]
    assert [len(r["spans"]) for r in found.where("doc_id = 6").collect()] == [1]
    pieces = spark.createDataFrame([(1, 0, 10, 5), (2, 0, 20, 5)], "doc_id long, piece int, length long, sequence_id long")
    packed = packing.pack(pieces.withColumn("bin", F.lit(1)), capacity=30)
    assert packed.columns == ["doc_id", "piece", "length", "bin", "sequence_id", "offset"]
    assert len({r["sequence_id"] for r in packed.collect()}) == 1


def test_suppression_against_brute_force(spark):
    rng = random.Random(5)
    rules = [("a", "w0", 2, " w0 w1 w2 w3(?= )"), ("b", "w1", 4, " w1 w2(?= )"), ("c", "w3", 3, " w3 w4(?= )"),
             ("d", "w2", 3, " w2 w3 w4(?= )"), ("e", "w4", 1, " w4(?= )"), ("f", "w0", 3, " w0 w1(?= )")]
    texts = ["w0 w1 w2 w3 w4 w5", "", *[
        " ".join(f"w{(start + k) % 6}" for start in rng.choices(range(6), k=6) for k in range(rng.randint(1, 6)))
        for _ in range(60)]]

    def brute(text):
        norm, kept = f" {text} ", []
        hits = [(-p, m.start() - m.end(), m.start(), label, m.end()) for label, _, p, rule in rules
                for m in re.finditer(rule, norm)]
        for p, _, start, label, stop in sorted(hits):
            if all(stop <= a or b <= start for a, b, _, _ in kept):
                kept.append((start, stop, -p, label))
        return sorted(kept)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(d) for d in r["detections"] or []] for r in licenses.scan_licenses(docs, rules=rules).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert {label for *_, label in got[0]} == {"b", "c", "e"} - {"e"}


def test_crowded_classes_join_by_whole_sets(spark):
    """Many copies, a chain of near copies and outsiders just below the limit, on signatures that all share."""
    base = [f"x{i}" for i in range(200)]
    texts = [" ".join(base[:i] + ["new"] + base[i + 1:]) for i in range(0, 200, 2)]
    texts += [" ".join(base)] * 30 + [" ".join(base[:120] + [f"far{i}-{k}" for k in range(40)]) for i in range(3)]
    texts += [" ".join([*base[: 200 - k], *[f"tail{j}" for j in range(k)]]) for k in range(2, 60, 3)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = ngram_join.CROWD, ngram_join.BLOCK, ngram_join.ROUNDS
    ngram_join.CROWD, ngram_join.BLOCK, ngram_join.ROUNDS = 4, 16, 0  # straight into several small blocks
    try:
        got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    finally:
        ngram_join.CROWD, ngram_join.BLOCK, ngram_join.ROUNDS = old
    assert got == [(i, root(i)) for i in range(len(texts))]
