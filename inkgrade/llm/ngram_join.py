"""N-gram Jaccard join by PartEnum signatures, and the classes of documents that its links connect."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from inkgrade.llm.common import LOWER_BYTES
from inkgrade.operators.lineage import cut_lineage

N, PERCENT = 5, 80
#: Hash seeds that a document may need until its strong parts suffice; the last one takes weak parts too.
SEEDS = 8
#: Signatures that more documents share are crowded: compared by leads first, then in blocks of so many.
CROWD, BLOCK = 64, 512
#: Shingles of a block's documents, on average, beyond which a signature gets more blocks.
BLOCK_SHINGLES = 1_000_000
#: Numbers (rows times columns) up to which a counted side is broadcast; beyond, it is joined by shuffling.
BROADCAST_NUMBERS = 2_000_000
#: Rounds in which documents on a crowded signature meet so many leads of its largest class.
ROUNDS, LEADS = 1, 4
#: Longs of a set's parity sketch.
SKETCH = 16
#: Documents for each partition of the small tables (labels, pairs, signatures left) that the rounds write.
DOCS_A_PART = 8192

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal numbers stay equal, others scatter."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_TIMES = np.array([pow(_BASE, 2 * i + 3, 2**64) for i in range(64)], dtype=_U)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_powers: list[np.ndarray] = [np.empty(0, dtype=_U)] * 2


def _powers_upto(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for at, factor in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _powers[at] = np.cumprod(np.full(2 * n, factor, dtype=_U))
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words in order: each word's bytes as a polynomial, taken from running sums."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
    if not raw:
        return np.empty(0, dtype=_U)
    data = np.frombuffer(raw, dtype=np.uint8)
    up, down = _powers_upto(len(data) + 1)
    word = np.concatenate(([False], ~_BLANK[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``n`` words; of shorter texts, of all words; empty without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(n, len(h))
    count = len(h) - width + 1
    total = np.full(count, width, dtype=_U)
    for i in range(width):
        total += h[i:count + i] * _TIMES[i]
    return np.unique(_mixed(total))


@cache
def _parts(band: int, percent: int) -> int:
    """Parts of the feature domain for sets of 2**band up to 2**(band + 1) - 1 features.

    A fifth more than the differences that a linked pair of the band can have, plus one.
    """
    top = 2 ** (band + 1) - 1
    differences = (100 - percent) * 2 * top // (100 + percent)
    return 1 if differences == 0 else -(-6 * (differences + 1) // 5)


def _differences(size: int, band: int, percent: int) -> int:
    """Features in which a linked partner within the band can differ at most."""
    top = 2 ** (band + 1) - 1
    return min((100 - percent) * size // percent, (100 - percent) * (size + top) // (100 + percent))


def signatures(features: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """PartEnum signatures, of which linked sets share at least one, and the set's slack.

    Sizes fall into bands that double; a set that a larger one may link to from the next band takes part there too.
    A band's domain is cut by hash into more parts than a linked pair can have differences, so some parts are equal
    in both. A signature is a part's whole content. Parts of fewer than two features are weak and give none: while a
    set has no fewer weak parts than equal parts guaranteed, it goes on to the next seed, where the same holds; with
    the last seed weak parts count. So of any linked pair, some strong part is equal under the first seed at which
    either set needs no further one, and both sets have signatures there. The slack is the least number of signatures
    that the set shares with any linked one: what the first seed guarantees, or one where that did not suffice.
    """
    size = len(features)
    if not size:
        return np.empty(0, dtype=np.int64), 0
    own = size.bit_length() - 1
    bands = [own] + [own + 1] * (100 * size >= percent * 2 ** (own + 1))
    out, slack = [], 2**31 - 1
    for band in bands:
        parts = _parts(band, percent)
        guaranteed = parts - _differences(size, band, percent)
        for seed in range(SEEDS):
            salt = _U(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
            place = _U(((band + 1) * 0xA0761D6478BD642F + int(salt)) & (2**64 - 1))
            scattered = _mixed(features ^ salt)
            part = ((scattered >> _U(33)) % _U(parts)).astype(np.uint16 if parts < 65536 else np.int64)
            every = np.bincount(part, minlength=parts)
            full = np.flatnonzero(every)
            counts = every[full]
            values = _mixed(scattered + salt)[np.argsort(part, kind="stable")]
            sums = np.add.reduceat(values, np.cumsum(counts) - counts)
            mark = full.astype(_U) * _U(0xD6E8FEB86659FD93) + place
            found = _mixed(sums ^ _mixed(mark + counts.astype(_U)))
            if parts == 1:
                out.append(found)
                break
            strong = counts >= 2
            weak = parts - int(strong.sum())
            last = seed == SEEDS - 1
            out.append(found if last else found[strong])
            if last and len(counts) < parts:  # parts without any feature are equal parts as well
                bare = np.flatnonzero(every == 0).astype(_U)
                out.append(_mixed(bare * _U(0xD6E8FEB86659FD93) + place))
            if weak < guaranteed or last:
                slack = min(slack, guaranteed - weak if seed == 0 else 1)
                break
    return np.unique(np.concatenate(out)).view(np.int64), slack


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union; empty sets link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def parities(features: np.ndarray) -> np.ndarray:
    """For 64 * SKETCH groups of features, whether a set has an odd number of them, as bits of longs.

    A feature that only one of two sets has flips one bit, so sets differ in no fewer features than bits.
    """
    bits = 64 * SKETCH
    odd = np.bincount((features % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """(doc_id, n_shingles, slack, digest, sketch, signatures) of every row; a null id has no signatures.

    Equal sets have equal digests.
    """
    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                features = shingles(text, n)
                found, slack = signatures(features, percent)
                digest = int(features.sum(dtype=_U).view(np.int64))
                out.append((i, len(features), slack, digest, parities(features), found[:0] if pd.isna(i) else found))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "slack", "digest", "sketch", "signatures"]).astype(
                {"doc_id": "Int64"})

    return docs.mapInPandas(
        sign, "doc_id long, n_shingles long, slack int, digest long, sketch array<long>, signatures array<long>")


def _kept(df: DataFrame, parts: int) -> DataFrame:
    """``df`` checkpointed in at most ``parts`` partitions, so that small tables neither fill folders nor task slots."""
    return cut_lineage(df.coalesce(parts))


def _premerged(signed: DataFrame, docs: DataFrame, percent: int, n: int, parts: int) -> DataFrame:
    """(doc_id, label) of documents that link to the first one of those sharing their least signature.

    A bucket's documents are compared with the first of their share of it, these with the first of the bucket, so no
    document meets more than about the root of the bucket's size.
    """
    least = signed.where(F.size("signatures") > 0).select(
        "doc_id", "n_shingles", F.element_at("signatures", 1).alias("bucket"))
    sizes = _kept(least.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), parts)
    shares = F.pmod(F.xxhash64("doc_id"), F.ceil(F.sqrt("n")).cast("long"))
    rows = least.join(_small(sizes, sizes.count()), "bucket").withColumn("share", shares)
    lead = F.min(F.struct("doc_id", "n_shingles")).alias("lead")
    first = _kept(rows.groupBy("bucket", "share").agg(lead), parts)
    firsts = first.count()
    top = first.groupBy("bucket").agg(F.min("lead").alias("lead"))
    near = rows.join(_small(first, firsts), ["bucket", "share"]).select("lead", "doc_id", "n_shingles")
    far = first.select("bucket", "lead.*").join(_small(top, firsts), "bucket").select("lead", "doc_id", "n_shingles")
    pairs = near.union(far).select(
        F.col("lead.doc_id").alias("a"), F.col("lead.n_shingles").alias("n_a"), F.col("doc_id").alias("b"),
        F.col("n_shingles").alias("n_b")).where("a <> b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    pairs = pairs.where(fits).select("a", "b").distinct()
    links = _kept(_verified(pairs, signed, docs, percent, n, parts).groupBy("b").agg(F.min("a").alias("a")), parts)
    up = links.select(F.col("b").alias("a"), F.col("a").alias("above"))
    return links.join(_small(up, links.count()), "a", "left").select(
        F.col("b").alias("doc_id"), F.coalesce("above", "a").alias("label"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side of at most ``rows`` counted rows, all of whose columns are numbers, up to BROADCAST_NUMBERS."""
    return F.broadcast(df) if rows * len(df.columns) <= BROADCAST_NUMBERS else df


def _alike(pairs: DataFrame, signed: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b, ...), ``rows`` in all, without those that differ in too many features by their sketches."""
    side = lambda s: signed.select(
        F.col("doc_id").alias(s), F.col("n_shingles").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    flips = sum(F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH))
    left = side("a").join(_small(pairs, rows), "a")
    right = side("b").join(_small(pairs.select("b"), rows), "b", "left_semi")
    return left.join(right, "b").where(
        flips * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)).select(*pairs.columns)


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, percent: int, n: int, parts: int) -> DataFrame:
    """The pairs (a, b, ...) that link, by their whole texts."""
    pairs = _kept(pairs, parts)
    pairs = _kept(_alike(pairs, signed, percent, pairs.count()), parts)
    rows = pairs.count()

    def check(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            last, features, found = None, None, []
            for a, b in zip(left, right, strict=True):
                if a == b:
                    found.append(True)
                    continue
                if a != last:
                    last, features = a, shingles(a, n)
                found.append(linked(features, shingles(b, n), percent))
            yield pd.Series(found, dtype=bool)

    texts = docs.select("doc_id", "text")
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(_small(pairs, rows), "a")
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(
        _small(pairs.select("b"), rows), "b", "left_semi")
    both = first.join(second, "b")
    return both.where(F.pandas_udf(check, "boolean")("text_a", "text_b")).select(*pairs.columns)


def components(edges: DataFrame, parts: int = DOCS_A_PART) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); the component is its least node.

    Least labels spread along edges and along labels, which halves the way each round. Labels are pre-aggregated
    before every shuffle, so a node with most of the edges does not gather them in one task. The labels are written in
    at most ``parts`` partitions.
    """
    both = _kept(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), parts)
    most = both.count()
    labels = _kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("component")), parts)
    while True:
        near = both.join(_small(labels, most), F.col("b") == F.col("node")).select(
            F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("before"))
        spread = labels.withColumn("before", F.col("component")).union(near).groupBy("node").agg(
            F.min("component").alias("component"), F.max("before").alias("before"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = _kept(spread.join(_small(up, most), "component", "left").select(
            "node", "before", F.least("component", "above").alias("component")), parts)
        labels = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            return labels


def _crowded(rows: DataFrame, parts: int) -> DataFrame:
    """(signature, crowd) of the signatures that more than CROWD documents share."""
    return _kept(rows.groupBy("signature").agg(F.count("*").alias("crowd")).where(F.col("crowd") > CROWD), parts)


def _uncrowded(rows: DataFrame, parts: int) -> DataFrame:
    """Without the most crowded signatures of each document, one fewer than its slack.

    Linked documents share as many signatures as either's slack, so one of the others is shared as well.
    """
    crowded = _crowded(rows, parts)
    n = crowded.count()
    if not n:
        return rows
    turn = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("crowd").desc(), "signature"))
    busy = rows.join(_small(crowded, n), "signature").withColumn("turn", turn).where("turn >= slack")
    calm = rows.join(_small(crowded, n), "signature", "left_anti")
    return _kept(calm.unionByName(busy.select(rows.columns)), 2 * parts)


def _meeting(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows, of two classes and of the group's two blocks, that sketches may link.

    A pair that shares several crowded signatures meets at the least of them only.
    """
    own, low, high = pdf["own"].to_numpy(), pdf["low"].iat[0], pdf["high"].iat[0]
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    if not len(left) or not len(right):
        return left[:0], right[:0]
    sketch, size = np.stack(pdf["sketch"].to_numpy()).view(_U), pdf["n_shingles"].to_numpy()
    label, ids = pdf["label"].to_numpy(), pdf["doc_id"].to_numpy()
    flips = np.zeros((len(left), len(right)), dtype=np.int32)
    for i in range(SKETCH):
        flips += np.bitwise_count(sketch[left, None, i] ^ sketch[None, right, i])
    n, m, p, q = size[left, None], size[None, right], label[left, None], label[None, right]
    fits = (p < q if low == high else p != q) & (ids[left, None] != ids[None, right])
    fits &= np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
    fits &= flips * (100 + percent) <= (n + m) * (100 - percent)
    i, j = np.nonzero(fits)
    i, j = left[i], right[j]
    signature, shared = pdf["signature"].iat[0], pdf["crowds"]
    before = {r: frozenset(shared.iat[r][shared.iat[r] < signature].tolist()) for r in {*i.tolist(), *j.tolist()}}
    first = [before[x].isdisjoint(before[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    first = np.array(first, dtype=bool)
    return i[first], j[first]


def _joined_classes(pdf: pd.DataFrame, percent: int, n: int) -> list[tuple[int, int]]:
    """Links between the classes of a group's rows, by whole texts: no more than join them, so fewer than rows."""
    text, distinct = pd.factorize(pdf["text"])
    label, features, above, apart, out = pdf["label"].tolist(), {}, {}, set(), []

    def root(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    def set_of(t: int) -> np.ndarray:
        if t not in features:
            features[t] = shingles(distinct[t], n)
        return features[t]

    for x, y in zip(*(side.tolist() for side in _meeting(pdf, percent)), strict=True):
        p, q = root(label[x]), root(label[y])
        texts = text[x], text[y]
        if p == q or texts in apart:
            continue
        if texts[0] == texts[1] or linked(set_of(texts[0]), set_of(texts[1]), percent):
            above[max(p, q)] = min(p, q)
            out.append((min(p, q), max(p, q)))
        else:
            apart.add(texts)
    return out


def _blocked(rows: DataFrame, crowded: DataFrame, n: int, signed: DataFrame, docs: DataFrame, percent: int, width: int,
             parts: int) -> DataFrame:
    """(label_a, label_b): linked classes of documents on one of ``n`` crowded signatures.

    Of a class's documents with equal sets one takes part. A signature's largest class and its other documents are
    dealt to blocks by id hash; every block of the others meets each block in a group of its own, blocks of the
    largest class do not meet. So a task holds two blocks however many documents share the signature. Rows with a
    partner within the differences by sketch go on, with their texts, to the same group for the check of whole sets.
    """
    count = lambda k, size: F.ceil(F.greatest(F.col(k) / BLOCK, F.col(size) / BLOCK_SHINGLES))
    held = rows.join(_small(crowded.select("signature"), n), "signature").select("signature", "label", "doc_id").join(
        signed.select("doc_id", "n_shingles", "sketch", "digest"), "doc_id")
    busy = _kept(held.groupBy("signature", "label", "n_shingles", "sketch", "digest").agg(
        F.min("doc_id").alias("doc_id")), 2 * parts)
    classes = busy.groupBy("signature", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    sizes = _kept(classes.groupBy("signature").agg(
        F.max_by(F.struct("label", "n", "size"), F.struct("n", "label")).alias("most"), F.sum("n").alias("n"),
        F.sum("size").alias("size")).select(
        "signature", F.col("most.label").alias("most"), F.col("most.n").alias("k"), F.col("most.size").alias("s"),
        (F.col("n") - F.col("most.n")).alias("k_rest"), (F.col("size") - F.col("most.size")).alias("s_rest")).where(
        "k_rest > 0").select("signature", "most", count("k", "s").alias("many"), count("k_rest", "s_rest").alias("rest")),
        parts)
    met = busy.join(_small(sizes, n), "signature")
    crowds = met.groupBy("doc_id", "digest").agg(F.collect_set("signature").alias("crowds"))
    top, place = F.col("label") == F.col("most"), F.xxhash64("doc_id")
    dealt = met.join(crowds, ["doc_id", "digest"]).withColumn(
        "own", F.when(top, F.col("rest") + F.pmod(place, "many")).otherwise(F.pmod(place, "rest"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1 + F.when(top, 0).otherwise(F.col("many"))))
    ).select("signature", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id",
             "n_shingles", "label", "sketch", "crowds")
    group = ["signature", "low", "high"]

    def partnered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[np.unique(np.concatenate(_meeting(pdf, percent)))]

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.array(_joined_classes(pdf, percent, width), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame(found, columns=["label_a", "label_b"])

    near = cut_lineage(dealt.groupBy(*group).applyInPandas(partnered, dealt.schema))
    texts = docs.select("doc_id", "text").join(near.select("doc_id").distinct(), "doc_id")
    return near.join(texts, "doc_id").groupBy(*group).applyInPandas(joined, "label_a long, label_b long")


def _starred(rows: DataFrame, crowded: DataFrame, n: int, turn: int, parts: int) -> DataFrame:
    """Candidates of one round: on ``n`` crowded signatures, documents of other classes with leads of the largest class.

    Leads are those of least id hash, which changes each round, so signatures with the same documents agree on them. A
    document meets the leads of a class on one signature, which changes each round too.
    """
    busy = rows.join(_small(crowded, n), "signature")
    top = _kept(busy.groupBy("signature", "label").agg(F.count("*").alias("n")).groupBy("signature").agg(
        F.max_by("label", F.struct("n", "label")).alias("top")), parts)
    busy = busy.join(_small(top, n), "signature")
    place = F.row_number().over(W.partitionBy("signature").orderBy(F.xxhash64(F.lit(turn), "doc_id"), "doc_id"))
    leads = busy.where("label = top").withColumn("place", place).where(F.col("place") <= LEADS)
    others = busy.where("label <> top").groupBy("doc_id", "n_shingles", "label", "top").agg(
        F.min_by("signature", F.xxhash64(F.lit(turn), "signature")).alias("signature"))
    return others.select(
        "signature", F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("label").alias("label_b")).join(
        _small(leads.select("signature", F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"),
                            F.col("label").alias("label_a")), LEADS * n), "signature")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = N,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: classes of documents connected by links.

    A document's set holds the distinct runs of ``n`` lower-cased words (all words, of a shorter text); two link when
    100 * intersection >= ``percent`` * union, for ``percent`` above 50. ``component_id`` is the least doc_id that
    links reach. Links are checked on whole texts; every linked pair shares a signature, and signatures are only
    left aside once all their documents are in one class or all pairs across classes are checked.

    Empty and null texts have no shingles and no links. ``doc_id`` identifies a document: rows that repeat an id are
    one document, linked if any of its texts is; a null id has no links and a null class. Very long texts are taken
    whole; an empty table gives no rows; other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_lineage(_signed(docs, percent, n))
    parts = -(-signed.count() // DOCS_A_PART) or 1
    labels = _kept(_premerged(signed, docs, percent, n, parts), parts)
    found = signed.join(_small(labels, labels.count()), "doc_id", "left").withColumn(
        "label", F.coalesce("label", "doc_id"))
    exploded = found.select("doc_id", "n_shingles", "slack", "label", F.explode("signatures").alias("signature"))
    spans = lambda rows: _kept(rows.groupBy("signature").agg(  # noqa: E731  signatures of more than one class
        F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("signature"), parts)
    met = spans(exploded)
    rows = _kept(exploded.join(_small(met, met.count()), "signature").distinct(), 2 * parts)

    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") != F.col("b"))
    edges, classes_n = None, 0
    side = lambda s: [F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"),
                      F.col("label").alias(f"label_{s}")]
    if not rows.isEmpty():
        rows = _uncrowded(rows, parts)
    every = False
    for turn in range(ROUNDS + 1):
        if every or rows.isEmpty():
            break
        crowded = _crowded(rows, parts)
        busy = crowded.count()
        every = turn == ROUNDS or not busy
        if every:
            calm = rows.join(_small(crowded, busy), "signature", "left_anti")
            left, right = calm.select("signature", *side("a")), calm.select("signature", *side("b"))
            candidates = left.join(right, "signature").where(fits & (F.col("label_a") < F.col("label_b"))).select(
                "a", "b", "label_a", "label_b")
        else:
            candidates = _starred(rows, crowded.select("signature"), busy, turn, parts).where(fits)
        pairs = candidates.select("a", "b", "label_a", "label_b").distinct()
        links = _verified(pairs, signed, docs, percent, n, parts).select("label_a", "label_b")
        if every and busy:
            links = links.unionByName(_blocked(rows, crowded, busy, signed, docs, percent, n, parts))
        new = _kept(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), parts)
        if new.isEmpty():
            continue
        classes = components(new if edges is None else edges.unionByName(new), parts)
        classes_n = classes.count()
        edges = classes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        if every:
            break
        rows = rows.join(_small(classes.withColumnRenamed("node", "label"), classes_n), "label", "left").withColumn(
            "label", F.coalesce("component", "label")).drop("component")
        still = spans(rows)
        rows = _kept(rows.join(_small(still, still.count()), "signature").select(
            "doc_id", "n_shingles", "slack", "label", "signature"), 2 * parts)
    out = found.select("doc_id", "n_shingles", "label")
    if edges is None:
        return out.withColumnRenamed("label", "component_id")
    return out.join(_small(edges.select(F.col("a").alias("label"), "b"), classes_n), "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("b", "label").alias("component_id"))
