"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy node arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkgrade.llm.common import BLANKS

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees and the direction in which each may move the score (0: either).
FEATURES: dict[str, int] = {
    "words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines": -1, "repeats": -1, "distinct": 0,
    "bars_per_word": -1, "shouts_per_word": -1, "upper": -1, "digits": 0, "stops_per_word": 0, "line_words": 0,
    "top_word": -1,
}
_SYMBOLS = "#*$%&|<>"
#: Labelled rows that the trees are fitted on, at most: those of the smallest hashes.
FIT_ROWS = 20_000


def text_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of ``STATS`` and the values of ``FEATURES`` of a whole text; null is empty."""
    text = text or ""
    words = text.encode().split()  # splits at ASCII blanks alone, so these are the words
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen, upto = Counter(windows), 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeats += i + 3 - max(i, upto)
                upto = i + 3
    counts, per = Counter(words), max(n, 1)
    upper = sum(w.isupper() for w in words)
    return [n, chars, symbols, dup_lines, repeats], [
        min(n, 5000), chars / per, symbols / per, dup_lines / max(len(lines), 1), repeats / per, len(counts) / per,
        text.count("|") / per, text.count("!") / per, upper / per,
        sum(map(text.count, "0123456789")) / max(chars, 1), text.count(".") / per, n / max(len(lines), 1),
        max(counts.values(), default=0) / per,
    ]


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1: leaf), threshold, left and right child, value; roots by tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row, all rows of a tree level stepping down at once."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                down = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(inner, np.where(down, self.left[node], self.right[node]), node)
            total += self.value[node]
        return total


def fit_forest(
    x: np.ndarray, y: np.ndarray, monotone: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 64, least: float = 2.0, ridge: float = 1.0,
) -> Forest:
    """Boosted trees for the logistic loss with Newton steps on binned features.

    A split on a constrained feature must order its two values in the feature's direction, and all values below are
    held on their side of the middle, so the score is monotone in it.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
    nodes: list[list] = []  # feature, threshold, left, right, value
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score, roots = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        value = lambda gs, hs: np.clip(-gs / (hs + ridge), low, high)
        gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + ridge) * v * v)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, at, at, float(value(gs, hs)) * rate])
        best = (1e-6, None)
        for f, cut in enumerate(cuts) if level < depth else ():
            if not len(cut):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
            vl, vr = value(gl, hl), value(gs - gl, hs - hl)
            gain = gain_of(gl, hl, vl) + gain_of(gs - gl, hs - hl, vr) - gain_of(gs, hs, value(gs, hs))
            ok = (hl * 4 >= least) & ((hs - hl) * 4 >= least)
            if monotone[f]:
                ok &= (vr - vl) * monotone[f] >= 0
            gain = np.where(ok, gain, -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), (f, i, float(vl[i]), float(vr[i])))
        if best[1]:
            f, i, vl, vr = best[1]
            middle, down = (vl + vr) / 2, binned[rows, f] <= i
            lows, highs = (low, low), (high, high)
            if monotone[f] > 0:
                lows, highs = (low, middle), (middle, high)
            elif monotone[f] < 0:
                lows, highs = (middle, low), (high, middle)
            a = grow(rows[down], g, h, level + 1, lows[0], highs[0])
            b = grow(rows[~down], g, h, level + 1, lows[1], highs[1])
            nodes[at][:4] = [f, float(cuts[f][i]), a, b]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        score += _forest(nodes, roots[-1:], 0.0).score(x)
    return _forest(nodes, roots, base)


def _forest(nodes: list[list], roots: list[int], base: float) -> Forest:
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(f, t, left, right, v, np.array(roots), base)


def fit_quality(
    docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS,
) -> Forest | None:
    """Trees fitted on the labelled documents, or None where fewer than two classes are labelled.

    At most ``fit_rows`` labels are used, those of the smallest id hashes; conflicting labels of an id are averaged.
    Only these documents' feature values come to the driver.
    """
    if labels is None:
        return None
    sample = (
        labels.select(F.col(label_id_col).alias("label_id"), F.col(label_col).cast("double").alias("label"))
        .dropna().groupBy("label_id").agg(F.avg("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "label_id")  # at most fit_rows ids and numbers

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            values = [text_stats(t)[1] for t in pdf["text"]]
            out = pd.DataFrame(values, columns=list(FEATURES), dtype=float)
            out["label_id"], out["label"] = pdf["label_id"].to_numpy(), pdf["label"].to_numpy()
            yield out

    schema = ", ".join(f"{f} double" for f in FEATURES) + f", label_id {dict(rows.dtypes)['label_id']}, label double"
    fitted = rows.mapInPandas(features, schema).dropDuplicates(["label_id"]).toPandas()
    fitted = fitted.sort_values(["label_id", *FEATURES])
    y = (fitted["label"].to_numpy() >= 0.5).astype(float)
    if len(set(y)) < 2:
        return None
    return fit_forest(fitted[list(FEATURES)].to_numpy(float), y, list(FEATURES.values()))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.5, least_words: int = 50, repeat_percent: int = 50, keep: tuple[str, ...] = (), **fit,
) -> DataFrame:
    """(doc_id, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    ``score`` is the trees' probability of good quality, 1 where nothing could be fitted. A document is kept if the
    base rules pass and the score reaches ``threshold``. Null texts have no words and fail; repeated rows are judged
    one by one; very long texts are judged whole; an empty table gives no rows; columns not named in ``keep``, or named
    like a result, are left out.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", *STATS, "base_failed", "kept", "score"))
    forest = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **fit)

    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            both = [text_stats(t) for t in texts]
            out = pd.DataFrame([s for s, _ in both], columns=STATS, dtype="int64")
            out["base_failed"] = (out["n_words"] < least_words) | (
                100 * out["n_repeat_words"] > repeat_percent * out["n_words"])
            score = np.ones(len(both))
            if forest and both:
                score = 1 / (1 + np.exp(-forest.score(np.array([f for _, f in both]))))
            out["kept"], out["score"] = ~out["base_failed"] & (score >= threshold), score
            yield out

    schema = ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, kept boolean, score double"
    judged = F.pandas_udf(judge, schema)
    return docs.select(
        F.col(id_col).alias("doc_id"), *keep, judged(F.col(text_col)).alias("__judged")
    ).select("doc_id", *keep, "__judged.*")
