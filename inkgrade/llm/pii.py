"""Personal data by weak supervision: labelers vote, expectation maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Kinds in their order, and the wordings of the base kinds.
BASE_KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Further kinds that only the votes can establish, and what may be one.
OWN_KINDS: dict[str, re.Pattern] = {
    "secret": re.compile(
        r"(?<![0-9A-Za-z_])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})"
        r"(?![0-9A-Za-z_])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    "account": re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{8,19}(?![0-9A-Za-z.-]|,[0-9])"),
}
KINDS = [*BASE_KINDS, *OWN_KINDS]

#: Words that announce a kind, in the languages of the corpus.
CUES: dict[str, list[str]] = {
    "secret": ["token", "secret", "key", "apikey", "password", "passwd", "bearer", "auth", "credential"],
    "iban": ["iban", "konto", "account", "compte", "cuenta", "bank"],
    "ssn": ["ssn", "social", "security"],
    "mac": ["mac", "hardware", "ethernet"],
    "ipv6": ["ip", "ipv6", "host", "server", "address"],
    "local_phone": ["tel", "phone", "telefon", "téléphone", "teléfono", "mobile", "call", "fax", "cell"],
    "account": ["account", "konto", "compte", "cuenta", "passport", "pass", "customer", "kundennummer", "id"],
}
#: Words that announce something harmless.
HARMLESS = ["isbn", "issn", "doi", "version", "page", "seite", "order", "commit", "sha", "md5", "checksum", "hash",
            "invoice", "article", "item", "ticket", "vol"]
_WORDS = re.compile(r"\w+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, m.end() if m else 0))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _valid(kind: str, s: str) -> int:
    """What the form itself says: 1 for, -1 against, 0 nothing."""
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "iban":
        raw = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or "00" == digits[3:5] else 1
    if kind == "secret":
        counts = [s.count(c) / len(s) for c in set(s)]
        return 1 if -sum(p * math.log2(p) for p in counts) > 3.0 else -1
    if kind == "local_phone":
        return 1 if s[0] == "(" or digits[0] not in "01" else -1
    if kind == "account":
        return -1 if len(set(digits)) < 3 else 0
    return 1 if len(set(s.lower())) > 4 else -1


def _votes(kind: str, text: str, start: int, end: int) -> str:
    """One letter per labeler: y for, n against, - abstains."""
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 40):start])][-4:]
    near = text[max(0, start - 3):start].rstrip()
    cue = any(w in CUES[kind] for w in before)
    votes = [
        _valid(kind, text[start:end]),
        1 if cue else 0,
        -1 if any(w in HARMLESS for w in before) else 0,
        1 if near.endswith(("=", ":", '="', ":'", '"', "'")) else (0 if cue else -1),
        1 if text[end:end + 1] in ('"', "'", ";", ")", "\n") else 0,
    ]
    return "".join("n-y"[v + 1] for v in votes)


_LENGTHS = (10, 14, 18, 32, 48)


def own_candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, pattern) of what may be of a further kind, apart from base spans and each other."""
    found, busy = [], [(s, e) for _, s, e in taken]
    for at, (kind, wording) in enumerate(OWN_KINDS.items(), len(BASE_KINDS)):
        hits = []
        for m in wording.finditer(text):
            s, e = m.span()
            if all(e <= a or s >= b for a, b in busy):
                size = sum(e - s > x for x in _LENGTHS)
                hits.append((at, s, e, f"{at}|{_votes(kind, text, s, e)}|{size}"))
        found += hits
        busy += [(s, e) for _, s, e, _ in hits]
    return found


_DIGIT = re.compile("[0-9]")


def find_spans(text: str | None, accepted: frozenset[str] | None = None) -> tuple[list, list]:
    """Base spans and further candidates of a text (those of accepted patterns, if given)."""
    text = text or ""
    if "@" not in text and not _DIGIT.search(text):
        return [], []
    base = base_spans(text)
    own = own_candidates(text, base)
    return base, [c for c in own if accepted is None or c[3] in accepted]


def fit_labelers(patterns: dict[str, int], *, rounds: int = 50, smooth: float = 2.0) -> dict[str, float]:
    """Probability of each vote pattern, by expectation maximisation over labeler reliabilities.

    Each labeler has a chance of every vote given personal data and given none; each kind has its own share of
    personal data. Counts weigh the patterns, so all of the corpus takes part and the work does not grow with it.
    """
    names = sorted(patterns)
    if not names:
        return {}
    kinds = np.array([int(p.split("|")[0]) for p in names])
    votes = np.array([["n-y".index(v) for v in p.split("|")[1]] for p in names])
    weight = np.array([patterns[p] for p in names], dtype=float)
    lean = (votes - 1).sum(axis=1)
    p = 1 / (1 + np.exp(-1.5 * (lean - 0.5)))
    prior_votes = np.array([[0.5, 0.3, 0.2], [0.15, 0.35, 0.5]]) * smooth * 4  # a labeler is better than chance
    for _ in range(rounds):
        odds = np.zeros(len(names))
        for k in np.unique(kinds):
            rows = kinds == k
            share = (weight[rows] @ p[rows] + smooth) / (weight[rows].sum() + 2 * smooth)
            odds[rows] += np.log(share / (1 - share))
        for j in range(votes.shape[1]):
            chance = prior_votes.copy()
            for v in range(3):
                rows = votes[:, j] == v
                chance[0, v] += weight[rows] @ (1 - p[rows])
                chance[1, v] += weight[rows] @ p[rows]
            chance /= chance.sum(axis=1, keepdims=True)
            odds += np.log(chance[1] / chance[0])[votes[:, j]]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(names, p.tolist(), strict=True))


def fit_classifier(patterns: dict[str, int], posterior: dict[str, float], *, steps: int = 300) -> frozenset[str]:
    """Patterns that the span classifier takes for personal data: weighted logistic regression on kind, votes and
    length, fitted to the posteriors."""
    names = sorted(patterns)
    if not names:
        return frozenset()

    def features(p: str) -> list[float]:
        kind, votes, size = p.split("|")
        row = [1.0] + [float(int(kind) == k) for k in range(len(BASE_KINDS), len(KINDS))]
        row += [float(v == x) for v in votes for x in "ny"]
        return row + [float(int(size) == k) for k in range(len(_LENGTHS) + 1)]

    x = np.array([features(p) for p in names])
    y = np.array([posterior[p] for p in names])
    w = np.array([math.log1p(patterns[p]) for p in names])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) + 0.1 * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta)), grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-x @ beta))
    return frozenset(n for n, q in zip(names, p, strict=True) if q >= 0.5)


def learn_patterns(docs: DataFrame, *, text_col: str = "text") -> frozenset[str]:
    """Vote patterns that mean personal data in this corpus.

    A pattern is a kind, five three-valued votes and a length step: at most some thousands, whatever the input, and
    counted before they reach the driver.
    """
    def patterns(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for pdf in parts:
            for text in pdf["text"]:
                for c in find_spans(text)[1]:
                    counts[c[3]] = counts.get(c[3], 0) + 1
        if counts:
            yield pd.DataFrame(list(counts.items()), columns=["pattern", "n"]).astype({"pattern": object})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(patterns, "pattern string, n long")
    counts = {r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    return fit_classifier(counts, fit_labelers(counts))


SPANS = "array<struct<kind:string, start:int, end:int>>"


def find_pii(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    accepted: frozenset[str] | None = None,
) -> DataFrame:
    """(doc_id, *keep, base, spans): spans of personal data in every whole text, in code points, end exclusive.

    ``base`` has the base kinds; ``spans`` adds those that the classifier takes, learned from this corpus unless
    ``accepted`` gives its patterns. Both are ordered by kind, then start. Null texts are empty; repeated rows are
    searched one by one; very long texts are searched whole; an empty table gives no rows; columns not named in
    ``keep``, or named like a result, are left out.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "base", "spans"))
    accepted = learn_patterns(docs, text_col=text_col) if accepted is None else accepted

    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        named = lambda spans: [{"kind": KINDS[c[0]], "start": c[1], "end": c[2]} for c in spans]
        for texts in parts:
            both = [find_spans(t, accepted) for t in texts]
            yield pd.DataFrame({"base": [named(b) for b, _ in both], "spans": [named(b + o) for b, o in both]})

    found = F.pandas_udf(search, f"base {SPANS}, spans {SPANS}")
    return docs.select(F.col(id_col).alias("doc_id"), *keep, found(F.col(text_col)).alias("__found")).select(
        "doc_id", *keep, "__found.*")


def mask_pii(docs: DataFrame, *, text_col: str = "text", accepted: frozenset[str] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, of the first kind.

    Null texts stay null and empty ones empty; very long texts are masked whole, repeated rows one by one; an empty
    table gives no rows; other columns stay as they are.
    """
    accepted = learn_patterns(docs, text_col=text_col) if accepted is None else accepted

    def mask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([masked(t, accepted) for t in texts], dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(mask, "string")(F.col(text_col)))


def masked(text: str | None, accepted: frozenset[str]) -> str | None:
    if text is None:
        return None
    base, own = find_spans(text, accepted)
    out, upto = [], 0
    for kind, start, end in sorted([(c[0], c[1], c[2]) for c in base + own], key=lambda c: (c[1], -c[2], c[0])):
        if start >= upto:
            out += [text[upto:start], f"[{KINDS[kind].upper()}]"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
