"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from inkgrade.operators.lineage import cut_lineage

#: Pieces that are packed together, islands that pack them, epochs (elites migrate in between), generations of an
#: epoch, and individuals of an island.
GROUP, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 3, 2, 4, 4
#: Islands that evolve in one task, about.
TOGETHER = 8

#: Chunks of Latin letters and ASCII, which lower-casing and composing treat letter by letter.
_PLAIN = re.compile(r"[\x21-\x3b\x3d-\x7eßà-öø-ÿÀ-ÖØ-Þ]+")
#: Texts of such chunks and ASCII white space, which may be lower-cased as a whole.
_PLAIN_TEXT = re.compile(r"[\t-\r\x20-\x3b\x3d-\x7eßà-öø-ÿÀ-ÖØ-Þ]*")
#: The vocabulary's parts of lower-cased plain chunks: letters, single digits, others.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ÿ]+|[0-9]|[^\sa-zßà-öø-ÿ0-9]+")
#: White space to Python's split, but not to the vocabulary.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Bytes of remembered chunks and parts, about, with what Python needs to hold one.
_CACHE_BYTES, _ENTRY_BYTES = 300_000_000, 150
#: The letters and signs of plain chunks, lower-cased.
_PLAIN_SIGNS = [chr(i) for i in range(0x21, 0x100) if _PLAIN.fullmatch(chr(i)) and chr(i) == chr(i).lower()]
#: A tokenizer splits and writes as ``WordIds`` does if it gives the ids of this text chunk by chunk.
_PROBE = "It's THE word's don't 12 3a4 we'll \"(Über)\" naïve... x--y ¡no! e-mail@a.b/c ÀÉ ß's 5%,6 a_b 'tis &c. " + " ".join(_PLAIN_SIGNS)


class WordIds(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes, remembered by chunk (white space parts chunks).

    The vocabulary drops white space and never merges across it, so the ids of a text are those of its chunks. A new
    chunk is split into the vocabulary's parts (letters, single digits, others), which the tokenizer's model encodes one
    by one, written as its pre-tokenizer writes them; normalizing and splitting again would take most of the time. A
    tokenizer that splits or writes otherwise, as a probe shows, encodes whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.held = 0
        self.by_chunks = True
        before = self.tokenizer.pre_tokenizer
        written = {} if before is None else {c: before.pre_tokenize_str(c) for c in _PLAIN_SIGNS}
        self.written = {ord(c): "".join(part for part, _ in parts) for c, parts in written.items()}
        self.tokens = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.by_chunks = self(_PROBE) == self._encode(_PROBE)
        self.clear()

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """The ids of a new chunk or part, which are remembered."""
        if self.held > _CACHE_BYTES:
            self.clear()
            self.held = 0
        letters, latin = chunk.isalpha(), chunk.isascii()
        if not (letters and latin or _PLAIN.fullmatch(chunk)):
            ids = self._encode(chunk)
        elif (lower := chunk.lower()) != chunk:
            ids = self[lower]
        elif letters or len(parts := _PARTS.findall(chunk)) == 1:
            id_bytes = self.id_bytes
            ids = b"".join([id_bytes[t.id] for t in self.tokens(chunk if latin else chunk.translate(self.written))])
        else:
            ids = b"".join([self[p] for p in parts])
        self.held += len(chunk) + len(ids) + _ENTRY_BYTES
        self[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.by_chunks:
            return self._encode(text)
        if _PLAIN_TEXT.fullmatch(text):
            text = text.lower()
        elif _SEPARATORS.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self._encode(text)
        return b"".join([self[c] for c in text.split()])


_LOADED: dict[str, WordIds] = {}


def tokenized(
    docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
    end_id: int = 1,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): a document's ids, then ``end_id``, cut only beyond ``limit``.

    ``ids`` is binary, unsigned 32-bit little-endian. Null texts are empty and give the one id ``end_id``; repeated
    rows give their pieces again; an empty table gives no rows; other columns are left out.
    """

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordIds(tokenizer))
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * limit
        for pdf in parts:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = ids_of(text or "") + end
                out += [
                    (doc_id, at // step, at // 4, min(step, len(raw) - at) // 4, raw[at:at + step])
                    for at in range(0, len(raw), step)
                ]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"]).astype(
                {"doc_id": pdf["doc_id"].dtype})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(pieces, f"doc_id {kind}, piece int, start long, length long, ids binary")


class Packer:
    """Packings of one group's lengths: a packing is an array with the bin of every length."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, np.random.default_rng(seed)

    def best_fit(self, items: np.ndarray, bins: list[list[int]], room: list[int]) -> None:
        """Each item, longest first, into the bin with the least room that holds it."""
        free = sorted((r, b) for b, r in enumerate(room))
        for i in items[np.argsort(-self.lengths[items], kind="stable")].tolist():
            size = int(self.lengths[i])
            at = bisect_left(free, (size, -1))
            if at < len(free):
                r, b = free.pop(at)
                bins[b].append(i)
            else:
                r, b = self.capacity, len(bins)
                bins.append([i])
            insort(free, (r - size, b))

    def from_bins(self, bins: list[list[int]]) -> np.ndarray:
        out = np.empty(len(self.lengths), dtype=np.int32)
        for b, items in enumerate(bins):
            out[items] = b
        return out

    def fresh(self, shuffled: float) -> np.ndarray:
        """Best fit of everything, a part of it put in first in random order."""
        n, bins = len(self.lengths), []
        order = self.random.permutation(n)
        early = order[: int(n * shuffled)]
        for chunk in np.array_split(early, max(1, len(early) // 8)):
            room = [self.capacity - int(self.lengths[b].sum()) for b in bins]
            self.best_fit(chunk, bins, room)
        room = [self.capacity - int(self.lengths[b].sum()) for b in bins]
        self.best_fit(order[len(early):], bins, room)
        return self.from_bins(bins)

    def fill(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, self.lengths, packing.max() + 1)

    def fitness(self, packing: np.ndarray) -> tuple[int, float]:
        """Fewer bins, then more uneven filling, which leaves room where documents still fit."""
        fill = self.fill(packing) / self.capacity
        return -len(fill), float((fill**2).sum())

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of the father enter; the mother's bins that share documents with them dissolve,
        and the documents displaced are best-fitted."""
        fill = self.fill(father)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.7))
        take = self.random.permutation(good)[: max(1, len(good) // 2)]
        injected = np.isin(father, take)
        broken = np.unique(mother[injected])
        kept = ~np.isin(mother, broken)
        bins: dict[tuple[int, int], list[int]] = {}
        for i in np.flatnonzero(injected).tolist():
            bins.setdefault((0, int(father[i])), []).append(i)
        for i in np.flatnonzero(kept).tolist():
            bins.setdefault((1, int(mother[i])), []).append(i)
        lists = list(bins.values())
        room = [self.capacity - int(self.lengths[b].sum()) for b in lists]
        self.best_fit(np.flatnonzero(~injected & ~kept), lists, room)
        return self.from_bins(lists)

    def shaken(self, packing: np.ndarray) -> np.ndarray:
        """Mutation: the emptiest bins and a few others dissolve and are best-fitted anew."""
        fill = self.fill(packing)
        loose = np.union1d(np.argsort(fill)[: max(2, len(fill) // 20)],
                           self.random.integers(0, len(fill), max(1, len(fill) // 20)))
        out = np.isin(packing, loose)
        bins: dict[int, list[int]] = {}
        for i in np.flatnonzero(~out).tolist():
            bins.setdefault(int(packing[i]), []).append(i)
        lists = list(bins.values())
        room = [self.capacity - int(self.lengths[b].sum()) for b in lists]
        self.best_fit(np.flatnonzero(out), lists, room)
        return self.from_bins(lists)

    def evolve(self, elites: list[np.ndarray], generations: int, population: int) -> np.ndarray:
        people = [np.asarray(e) for e in elites]
        if not people:
            people.append(self.fresh(0.0))
        least = -(-int(self.lengths.sum()) // self.capacity)
        while len(people) < population and -self.fitness(people[0])[0] > least:
            people.append(self.fresh(float(self.random.uniform(0.02, 0.2))))
        people.sort(key=self.fitness, reverse=True)
        for _ in range(generations):
            if -self.fitness(people[0])[0] <= least:
                break
            a, b = self.random.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
            child = self.shaken(self.cross(people[min(a, b)], people[max(a, b)]))
            people = sorted([*people, child], key=self.fitness, reverse=True)[:population]
        return people[0]


def pack(
    pieces: DataFrame, *, capacity: int = 4096, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS,
    generations: int = GENERATIONS, population: int = POPULATION,
) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with ``sequence_id`` and ``offset``.

    Sequences hold at most ``capacity`` tokens without gaps. Pieces are dealt by hash into groups of about ``group``
    rows; in each, ``islands`` populations of packings evolve apart, and between epochs every island's elite moves on
    to the next island. The best packing of any island is the result. Only lengths and bin numbers travel; a group is
    gathered into one row, bounded by the deal, which a hash of the row and its place in the input evens out for
    repeated rows. Rows with equal content are interchangeable; an empty table gives no rows; columns of ``pieces``
    named ``sequence_id`` or ``offset`` give way to the results.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fixed = cut_lineage(pieces.withColumn("__at", F.monotonically_increasing_id()))
    groups = max(1, -(-fixed.count() // group))
    rows = fixed.groupBy(F.pmod(F.xxhash64("__at"), F.lit(groups)).alias("group")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("length").alias("__size"), "__at", *[
            F.col(f"`{c}`") for c in columns])), asc=False).alias("rows"))
    rows = cut_lineage(rows)
    lengths = rows.select("group", F.transform("rows", lambda r: r["__size"].cast("int")).alias("lengths"))

    def epoch(number: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                found = []
                for g, i, sizes, elites in zip(pdf["group"], pdf["island"], pdf["lengths"], pdf["elites"]):
                    packer = Packer(np.asarray(sizes, dtype=np.int64), capacity, [int(g), int(i), number])
                    best = packer.evolve(list(elites), generations, population)
                    count, filled = packer.fitness(best)
                    found.append((g, i, best, count, filled))
                yield pd.DataFrame(found, columns=["group", "island", "elite", "count", "filled"])
        return run

    schema = "group long, island int, elite array<int>, count int, filled double"
    each = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    state = None
    for number in range(epochs):
        if state is None:
            start = lengths.select("group", each, "lengths", F.array().cast("array<array<int>>").alias("elites"))
        else:
            goes = F.explode(F.array_distinct(F.array(
                F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))))
            moved = state.select("group", goes.alias("to"), F.struct("count", "filled", "island", "elite").alias("e"))
            elites = moved.groupBy("group", F.col("to").alias("island")).agg(F.transform(
                F.sort_array(F.collect_list("e"), asc=False), lambda e: e["elite"]).alias("elites"))
            start = elites.join(lengths, "group").select("group", "island", "lengths", "elites")
        # a number of partitions of its own, so that the small rows are not put together in one task
        start = start.repartition(-(-groups * islands // TOGETHER), "group", "island")
        state = cut_lineage(start.mapInPandas(epoch(number), schema))
    best = state.groupBy("group").agg(
        F.max(F.struct("count", "filled", F.expr("-island").alias("island"), "elite")).alias("best"))
    placed = rows.join(best, "group").select(
        "group", F.explode(F.arrays_zip(F.col("rows").alias("r"), F.col("best.elite").alias("bin"))).alias("x"))
    flat = placed.select("x.r.*", (F.col("group") * 2**24 + F.col("x.bin")).alias("sequence_id"))
    before = F.sum("length").over(W.partitionBy("sequence_id").orderBy("__at")) - F.col("length")
    return flat.withColumn("offset", before).select(*[F.col(f"`{c}`") for c in columns], "sequence_id", "offset")
