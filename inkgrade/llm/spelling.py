"""Spelling variants: a bit-sliced position index finds the words one edit away from each word.

Bitsets per (position, letter) over the words of a bucket are combined letter by letter of a query. ``same`` holds the
words that agree so far; ``swap``, ``longer`` and ``shorter`` hold those that agree but for one replaced letter, one
letter more, or one letter less, the last two reading the index one position on or back. Two words one edit apart agree
in the first or in the last half of the shorter one, so only words that share a half need to meet in a bucket.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from inkgrade.llm.common import LOWER_BYTES
from inkgrade.operators.lineage import cut_lineage

LETTERS = r"A-Za-zÀ-ÿ"
#: Weight of the words of a bucket, about: a word weighs one for every 64 letters.
BUCKET = 2048
#: Buckets above this weight are sliced.
HEAVY = 2 * BUCKET
#: Words a counting task keeps before it hands them on.
FLUSH = 200_000
#: Letters up to which the states of a query are kept for the next one.
KEPT_STATES = 64

# What a word does in a bucket: the bucket belongs to its first or last half as the shorter or equally long word of a
# pair, or as the longer one.
FIRST, FIRST_LONGER, LAST, LAST_LONGER = 1, 2, 4, 8


def slipped_words(doc_id: str | None, text: str | None, least_length: int, slip: int) -> Counter:
    """Words of a text with their numbers; where ``slip`` divides the checksum of "id:run", a letter is left out."""
    lowered = (text or "").encode().translate(LOWER_BYTES).decode()
    runs = Counter(re.findall(f"[{LETTERS}]{{{least_length},}}", lowered))
    if doc_id is None:
        return runs
    words, start = Counter(), zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least_length:
                continue
        words[run] += n
    return words


def vocabulary(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
    slip: int = 31,
) -> DataFrame:
    """(word, n): all words of at least ``least_length`` code points that occur ``least_count`` times overall.

    Words are runs of letters, A-Z lower-cased. Null and empty texts have none; in documents without id no letter is
    left out; repeated rows count each. A task hands its counts on whenever it holds ``FLUSH`` words.
    """
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in parts:
            for doc_id, text in zip(pdf["id"], pdf["text"]):
                seen.update(slipped_words(doc_id, text, least_length, slip))
                if len(seen) >= FLUSH:
                    yield _table(list(seen.items()), "word", "n")
                    seen.clear()
        yield _table(list(seen.items()), "word", "n")

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets per (position, letter) and per length over words, bit j for the j-th word."""

    def __init__(self, words: list[str]):
        places: dict[tuple[int, str], list[int]] = defaultdict(list)
        lengths: dict[int, list[int]] = defaultdict(list)
        for j, word in enumerate(words):
            lengths[len(word)].append(j)
            for at in enumerate(word):
                places[at].append(j)
        self.letters = {at: _bits(js) for at, js in places.items()}
        self.lengths = {n: _bits(js) for n, js in lengths.items()}
        self.everything = (1 << len(words)) - 1

    def near(self, queries: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
        """Per query (query, words as long or longer one edit away, shorter ones, and the words that agree with its
        first half as the shorter or equal and as the longer of a pair). Sorted queries share the states of prefixes.
        """
        letter = self.letters.get
        states, before = [(self.everything, 0, 0, 0)], ""
        for query in queries:
            n = len(query)
            at = min(len(commonprefix((before, query))), len(states) - 1)
            del states[at + 1:]
            same, swap, longer, shorter = states[at]
            halves = {half: states[half][0] for half in (n // 2, (n - 1) // 2) if half <= at}
            for i in range(at, n):
                c = query[i]
                here = same & letter((i, c), 0)
                shorter = (shorter & letter((i - 1, c), 0)) | same
                longer = (longer | same) & letter((i + 1, c), 0)
                swap = (swap & letter((i, c), 0)) | (same ^ here)
                same = here
                if i < KEPT_STATES:
                    states.append((same, swap, longer, shorter))
                if i + 1 == n // 2 or i + 1 == (n - 1) // 2:
                    halves[i + 1] = same
            size = self.lengths.get
            longest = (swap & size(n, 0)) | ((longer | same) & size(n + 1, 0))
            yield query, longest, shorter & size(n - 1, 0), halves[n // 2], halves[(n - 1) // 2]
            before = query


def _bits(places: list[int]) -> int:
    if len(places) < 4:
        return sum(1 << j for j in places)
    out = bytearray((places[-1] >> 3) + 1)
    for j in places:
        out[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(out, "little")


def near_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's rows (word, n, roles, own): (word, n_near, best, best_n) for each word with near words in it.

    Rows of its own form the index, all rows are queries. A pair counts in the bucket of the shorter word's first
    half if both agree there, else in that of its last half, so it counts once for each of its words.
    """
    roles: dict[str, int] = defaultdict(int)
    for word, role in zip(rows["word"], rows["roles"]):
        roles[word] |= role
    own = dict(zip(rows["word"][rows["own"]], rows["n"][rows["own"]]))
    words = sorted(own, key=lambda w: (-own[w], w))  # the lowest bit is the best word
    out = []
    for query, equal_or_longer, shorter, half, half_longer in PositionIndex(words).near(sorted(roles)):
        role, found = roles[query], 0
        if role & FIRST:
            found |= equal_or_longer & half
        if role & LAST:
            found |= equal_or_longer & ~half
        if role & FIRST_LONGER:
            found |= shorter & half_longer
        if role & LAST_LONGER:
            found |= shorter & ~half_longer
        if found:
            best = words[(found & -found).bit_length() - 1]
            out.append((query, found.bit_count(), best, own[best]))
    return _table(out, "word", "n_near", "best", "best_n")


def _table(rows: list[tuple], *names: str) -> pd.DataFrame:
    """Rows as plain Python values, also where there are none or strings are long."""
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


def _entries(words: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, roles, word, n, weight): each word in the buckets of its halves, with equal halves once."""
    word, length = F.col("word"), F.length("word")

    def bucket(side: str, shorter: Column) -> Column:
        half = F.floor(shorter / 2).cast("int")
        part = F.substring(word, F.lit(1), half) if side == "first" else F.right(word, shorter - half)
        return F.pmod(F.xxhash64(F.lit(side), part), F.lit(buckets))

    even = length % 2 == 0
    entry = lambda at, roles: F.struct(at.alias("bucket"), roles.alias("roles"))
    entries = F.array(
        entry(bucket("first", length), F.when(even, FIRST).otherwise(FIRST | FIRST_LONGER)),
        entry(bucket("first", length - 1), F.when(even, FIRST_LONGER).otherwise(0)),
        entry(bucket("last", length), F.when(even, LAST | LAST_LONGER).otherwise(LAST)),
        entry(bucket("last", length - 1), F.when(even, 0).otherwise(LAST_LONGER)),
    )
    return (
        words.select("word", "n", _weight().alias("weight"), F.explode(entries).alias("e"))
        .select("e.bucket", "e.roles", "word", "n", "weight").where("roles > 0")
    )


def _weight() -> Column:
    return F.ceil(F.length("word") / 64)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for words (word, n): how many words are one edit away, and the one of them with
    the largest n (ties: smallest in code-point order), with its n; 0 and nulls if there is none.

    The words of a bucket above the weight ``HEAVY`` are dealt to slices; each slice is asked for all of its words.
    """
    total = words.agg(F.sum(_weight())).first()[0] or 0
    entries = _entries(words, 3 * total // BUCKET + 1)
    heavy = cut_lineage(
        entries.groupBy("bucket").agg(F.sum("weight").alias("weight")).where(F.col("weight") > HEAVY)
        .select("bucket", F.ceil(F.col("weight") / BUCKET).alias("slices")))
    if heavy.isEmpty():
        dealt = entries.withColumns({"slice": F.lit(0), "own": F.lit(True)})
    else:
        slices = F.coalesce("slices", F.lit(1))
        dealt = (
            entries.join(heavy, "bucket", "left")
            .withColumn("home", F.pmod(F.xxhash64("word"), slices))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
            .withColumn("own", F.col("slice") == F.col("home"))
        )
    found = dealt.select("bucket", "slice", "word", "n", "roles", "own").groupBy("bucket", "slice").applyInPandas(
        near_in_bucket, "word string, n_near long, best string, best_n long")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("down"), "best")))
    none = words.select("word", "n", F.lit(0).alias("n_near"), F.lit(None).alias("best"), F.lit(None).alias("best_n"))
    return (
        none.unionByName(found.withColumn("n", F.lit(None).cast("long")))
        .groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
        .select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.down")).alias("best_n"))
    )


def spelling_variants(docs: DataFrame, *, ratio: int = 10, **words) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the words of whole documents, each with its usual spelling.

    Two words are near if one inserted, deleted or replaced code point makes them equal. ``form`` is the near word of
    largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times the word's own, else null;
    ``root`` is the end of the chain of forms, the word itself if it has none. A chain has at most as many steps as
    n has factors of ``ratio``, so that many joins of ever fewer words find all roots.

    Null and empty texts have no words, an empty table gives no rows, very long words are words like others, repeated
    rows count each, and columns beyond id and text are not read. ``words`` goes to ``vocabulary``.
    """
    formed = F.col("best_n") >= ratio * F.col("n")
    found = cut_lineage(near_words(cut_lineage(vocabulary(docs, **words))).select(
        "word", "n", "n_near", F.when(formed, F.col("best")).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n")))
    steps = found.where("form IS NOT NULL").select(F.col("word").alias("root"), F.col("form").alias("next"))
    ends = at = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(1).alias("step"))
    step = 1
    while True:
        step += 1
        at = cut_lineage(at.join(steps, "root").select("word", F.col("next").alias("root"), F.lit(step).alias("step")))
        if at.isEmpty():
            break
        ends = ends.unionByName(at)
    roots = ends.groupBy("word").agg(F.max_by("root", "step").alias("root"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
