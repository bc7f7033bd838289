"""Quality classifier: histogram gradient-boosted trees over document statistics, scored as flat arrays.

All trees are complete and of one depth, level by level in arrays, so a batch of documents walks each tree by
doubling positions without any branch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Labelled rows the trees are fitted on, at most: those of the smallest hashes.
SAMPLE_ROWS = 20_000
STATISTICS = [
    "words", "word_length", "distinct", "top_word", "same_as_last", "upper", "digits", "symbols", "bars", "shouts",
    "stops", "commas", "line_words", "repeated_lines", "long_words", "one_letter", "capitalised",
]
_UPPER = bytes(range(65, 91))


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` of a whole text; null is empty."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    count_of = lambda chars: len(raw) - len(raw.translate(None, chars))
    lengths = [len(w) for w in words]
    return [
        np.log1p(len(words)), sum(lengths) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, count_of(_UPPER) / size, count_of(b"0123456789") / size,
        count_of(b"#$%&*<>{}[]=~^") / n, raw.count(b"|") / n, raw.count(b"!") / n, raw.count(b".") / n,
        raw.count(b",") / n, len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(k > 20 for k in lengths) / n, sum(k == 1 for k in lengths) / n, sum(w[:1].isupper() for w in words) / n,
    ]


@dataclass
class Trees:
    """Complete trees of ``depth``: feature and threshold [tree, inner node], value [tree, leaf].

    The children of node i are 2i + 1 and 2i + 2; a row goes right where its feature is above the threshold.
    """

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        odds, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            odds += value[node - len(feature)]
        return 1 / (1 + np.exp(-odds))


def fit_trees(
    x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
    least: float = 3.0, ridge: float = 2.0,
) -> Trees:
    """Newton boosting of the logistic loss; every level of a tree is split from one histogram of all its nodes."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1)
    usable = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]  # feature, cut
    share = np.clip(y.mean(), 0.001, 0.999)
    inner = 2**depth - 1
    out = Trees(depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    odds, rows = np.full(n, out.base), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            nodes = 2**level
            cell = ((node[:, None] * width + np.arange(width)) * bins + binned).ravel()
            g, h, k = (
                np.bincount(cell, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2)
                for v in (slope, bend, np.ones(n)))
            gain = sum(a * a / (b + ridge) for a, b in ((g, h), (g[..., -1:] - g, h[..., -1:] - h)))
            gain -= g[..., -1:] ** 2 / (h[..., -1:] + ridge)
            allowed = usable & (k >= least) & (k[..., -1:] - k >= least)
            gain = np.where(allowed, gain, 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            feature, cut = np.divmod(best, bins)
            split = gain[np.arange(nodes), best] > 1e-9
            at = nodes - 1 + np.arange(nodes)
            out.feature[t, at] = np.where(split, feature, 0)
            out.threshold[t, at] = [cuts[f][c] if s else np.inf for f, c, s in zip(feature, cut, split)]
            right = binned[rows, feature[node]] > np.where(split, cut, bins)[node]
            node = 2 * node + right
        leaves = 2**depth
        step = -np.bincount(node, slope, leaves) / (np.bincount(node, bend, leaves) + ridge)
        out.value[t] = rate * step
        odds += out.value[t][node]
    return out


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(label, *statistics) of at most ``sample_rows`` labelled documents, those of the smallest id hashes.

    Labels of an id are averaged; of an id's rows the one of least statistics counts.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
        .groupBy("id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([np.array(statistics(t)) for t in texts], dtype=object)

    # Statistics are numbers only, so gathering the least row of an id moves no texts.
    measured = F.pandas_udf(measure, "array<double>")(F.col("text"))
    return rows.select("id", "label", measured.alias("x")).groupBy("id").agg(
        F.min(F.struct("x", "label")).alias("r")).select("id", "r.x", "r.label")


def fit_classifier(docs: DataFrame, labels: DataFrame | None, **sample) -> Trees | None:
    """Trees fitted on the labelled documents; None where fewer than two classes are labelled."""
    if labels is None:
        return None
    rows = sorted((r.id, r.label, r.x) for r in labelled_sample(docs, labels, **sample).collect())
    y = np.array([label >= 0.5 for _, label, _ in rows], float)
    if len(set(y)) < 2:
        return None
    return fit_trees(np.array([x for _, _, x in rows]), y)


def score_quality(
    docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), **sample,
) -> DataFrame:
    """(doc_id, *keep, score): the probability that a document's quality label is 1, from its whole text alone.

    Null texts are scored as empty ones, repeated rows one by one; an empty table gives no rows. Without labels of two
    classes every score is 0.5. Kept columns may have any name but ``doc_id`` and ``score``.
    """
    trees = fit_classifier(docs, labels, id_col=id_col, text_col=text_col, **sample)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))
            yield pd.Series(trees.probability(x) if trees else np.full(len(x), 0.5))

    scored = F.pandas_udf(score, "double")(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), *keep, scored.alias("score"))
