"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkgrade.operators.lineage import cut_lineage

#: Groups of more than 1/HEAVY of all bytes are packed by themselves; there are fewer than HEAVY.
HEAVY = 4096
#: The other groups are gathered by hash into so many bundles, each packed as one item.
BUNDLES = 16_384
#: With a capacity, the average bundle takes at most 1/BUNDLE_SHARE of it, and a bundled group at most 1/64.
BUNDLE_SHARE, GROUP_SHARE = 8, 64
#: Rows of one item that are numbered together.
ROWS_PER_RUN = 100_000


class CapacityTree:
    """Bins by remaining capacity in a balanced search tree: the tightest bin that still fits, in log time.

    A treap: search order by (capacity, bin), heap order by random priorities, which keep it balanced.
    """

    def __init__(self) -> None:
        self._root, self._random = None, random.Random(0)

    def add(self, capacity: int, at: int) -> None:
        left, right = self._split(self._root, (capacity, at))
        node = [(capacity, at), self._random.random(), None, None]
        self._root = self._merge(self._merge(left, node), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin of least capacity >= size."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            self._root = left
            return None
        parent, node = None, right
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(left, right)
        return node[0]

    def _split(self, node, key):
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(items: Iterable[tuple[int, object]], capacity: int) -> dict[object, int]:
    """Bin of every (size, key): in falling order of size, each goes into the tightest bin it fits, else a new one."""
    tree, bins, where = CapacityTree(), 0, {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        room, at = tree.take_tightest(size) or (capacity, bins)
        bins += at == bins
        where[key] = at
        tree.add(room - size, at)
    return where


def balanced(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Best fit decreasing at the smallest capacity that needs no more than ``shards`` bins.

    An item above an equal share of what is left fills a shard of its own, and the rest is shared out anew.
    """
    rest, where, at = sorted(items, key=lambda x: (-x[0], str(x[1]))), {}, 0
    while rest and shards - at > 1 and rest[0][0] * (shards - at) > sum(s for s, _ in rest):
        where[rest.pop(0)[1]] = at
        at += 1
    if not rest:
        return where
    total = sum(s for s, _ in rest)
    low, high, best = math.ceil(total / (shards - at)), total, {k: 0 for _, k in rest}
    while low <= high:
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle)
        if max(found.values()) < shards - at:
            best, high = found, middle - 1
        else:
            low = middle + 1
    return where | {k: at + b for k, b in best.items()}


def shard_groups(
    docs: DataFrame, *, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id",
    size: Column, group: Column, keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(doc_id, size, *keep, shard, slot): groups stay whole, shards fill by best fit decreasing.

    With ``shards``, so many shards of nearly equal size; with ``capacity``, as few shards of that capacity as best
    fit decreasing needs (a larger item has a shard of its own). Slots count the rows of a shard from 0 without gaps.

    Group totals are pre-aggregated. Fewer than ``HEAVY`` groups can exceed 1/``HEAVY`` of all bytes; they and
    ``BUNDLES`` hash bundles of the others are the items that the driver packs, whatever the input's size. With a
    capacity, groups above 1/``GROUP_SHARE`` of it are packed by themselves too, and there are so many bundles that
    none exceeds it: the items grow with the number of shards, not with that of the groups. Rows of a
    heavy item are numbered in runs of about ``ROWS_PER_RUN`` rows. A null size counts as 0, null groups are one
    group, repeated rows count each; an empty table gives no rows; other columns are left out.
    """
    spark, keep = docs.sparkSession, keep or {}
    slim = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))).alias("group"),
        *[c.alias(n) for n, c in keep.items()],
    ))
    groups = cut_lineage(slim.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    is_heavy, bundles = F.col("size") * HEAVY > total, BUNDLES
    if not shards:
        is_heavy |= F.col("size") * GROUP_SHARE > capacity
        bundles = max(bundles, math.ceil(BUNDLE_SHARE * total / max(capacity, 1)))
    while True:
        bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string")
        items = groups.groupBy(F.when(is_heavy, F.col("group")).otherwise(bundle).alias("item")).agg(
            F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(is_heavy).alias("heavy")
        ).collect()  # with shards, at most HEAVY + BUNDLES rows
        if shards or all(r["heavy"] or r["size"] <= capacity for r in items):
            break
        bundles *= 2
    sized = [(r["size"], r["item"]) for r in items]
    where = balanced(sized, shards) if shards else best_fit_decreasing(sized, capacity)
    first, rows = {}, dict.fromkeys(where.values(), 0)
    for r in sorted(items, key=lambda r: r["item"]):
        first[r["item"]] = rows[where[r["item"]]]
        rows[where[r["item"]]] += r["n"]
    table = spark.createDataFrame(
        [(r["item"], where[r["item"]], first[r["item"]], max(1, r["n"] // ROWS_PER_RUN)) for r in items],
        "item string, shard int, first long, runs int",
    )
    heavy = spark.createDataFrame([(r["item"],) for r in items if r["heavy"]], "heavy string")
    placed = slim.join(F.broadcast(heavy), F.col("group") == F.col("heavy"), "left").withColumn(
        "item", F.coalesce("heavy", bundle)
    ).join(F.broadcast(table), "item").withColumn("run", F.pmod(F.xxhash64("doc_id"), F.col("runs")))
    runs = placed.groupBy("item", "run").agg(F.count("*").alias("n")).select(
        "item", "run", (F.sum("n").over(W.partitionBy("item").orderBy("run")) - F.col("n")).alias("before")
    )
    at = F.row_number().over(W.partitionBy("item", "run").orderBy("doc_id", "group"))
    return placed.withColumn("at", at).join(runs, ["item", "run"]).select(
        "doc_id", "size", *keep, "shard", (F.col("first") + F.col("before") + F.col("at") - 1).alias("slot")
    )
