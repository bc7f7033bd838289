"""Exact top-k inner-product search with a KD-tree per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkgrade.operators.lineage import cut_lineage

#: Vectors of a shard, vectors of a leaf, queries that a task takes at a time.
SHARD, LEAF, BLOCK = 8192, 128, 2048
_EXACT = 2.0**52


class KdTree:
    """Median splits along the widest axis; every node has the tight bounding box of its vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._grow(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray) -> int:
        at, box = len(self.rows), self.vectors[rows]
        low, high = box.min(axis=0), box.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.rows.append(rows)
        self.children.append(())
        wide = int(np.argmax(high - low))
        if len(rows) > LEAF and high[wide] > low[wide]:
            order = np.argsort(box[:, wide], kind="stable")
            half = len(rows) // 2
            self.children[at] = (self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that any point of a node's box has with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own, bounds: np.ndarray, k: int, kth: float) -> list[tuple]:
        """The k best (score, id) among those scoring at least ``kth``, best box first.

        A box is left out only if its bound is below the kth score, so ties are never lost.
        """
        best: list[tuple] = []
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= kth:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            good = np.flatnonzero(scores >= kth)
            if not len(good):
                continue
            found = [(-scores[i], _last(self.ids[rows[i]]), rows[i]) for i in good if self.ids[rows[i]] != own]
            best = heapq.nsmallest(k, best + found)
            if len(best) == k:
                kth = max(kth, -best[-1][0])
        return [(-s, self.ids[i]) for s, _, i in best]


def _last(value) -> tuple:
    """Nulls after all ids."""
    return (value is None, value if value is not None else 0)


def _search(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Queries of one block against the vectors of one shard; both are rows of ``pdf``."""
    rows = []
    for _, same in pdf.groupby(pdf["vector"].map(len), sort=True):
        data, asked = same[~same["asked"]], same[same["asked"]]
        if data.empty or asked.empty:
            continue
        vectors, queries = np.array(data["vector"].tolist()), np.array(asked["vector"].tolist())
        if np.abs(vectors).max() * np.abs(queries).sum(axis=1).max() >= _EXACT:
            vectors, queries = ([[int(x) for x in v] for v in m.tolist()] for m in (vectors, queries))
            vectors, queries = np.array(vectors, dtype=object), np.array(queries, dtype=object)
        ids = np.array([None if pd.isna(i) else int(i) for i in data["vec_id"]], dtype=object)
        tree = KdTree(ids, vectors)
        bounds = tree.bounds(queries)
        for at, (own, kth) in enumerate(zip(asked["vec_id"], asked["kth"], strict=True)):
            least = -np.inf if pd.isna(kth) else kth
            for score, vec_id in tree.search(queries[at], int(own), bounds[at], k, least):
                rows.append((int(own), vec_id, max(-(2**63), min(2**63 - 1, int(score)))))
    out = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])
    return out.astype({"query_id": "int64", "vec_id": "Int64", "score": "int64"})


def top_k(
    vectors: DataFrame, *, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products, ties to the smaller id.

    Components become floor(scale * x) in double; scores are whole numbers. Vectors that are null or hold null or
    non-finite components take no part; vectors of different lengths have no product. Rows with the query's id are
    its own; rows equal in id and vector count once; a score beyond a long stays at its limit; a row without id is a candidate, after all others at a tie, and
    no query. Empty tables give no rows; other columns are left out.

    Vectors are dealt into shards of about ``SHARD`` rows and each shard builds its tree. Queries, in blocks, first
    search one shard; their kth score then goes with them to all others, where most boxes fall below it.
    """
    valid = F.col("vector").isNotNull() & ~F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    floor = lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)
    whole = F.transform(F.col(vector_col), lambda x: floor(x.cast("double") * scale))
    finite = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                            is_query.alias("asked"), whole.alias("whole")).where(valid)
    rows = cut_lineage(finite.select("vec_id", F.col("whole").alias("vector"),
                                     F.coalesce("asked", F.lit(False)).alias("asked")).distinct())
    shards = max(1, -(-rows.count() // SHARD))
    queries = rows.where(F.col("asked") & F.col("vec_id").isNotNull()).select("vec_id", "vector")
    blocks = max(1, -(-queries.count() // BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select(
        deal(shards, 1).alias("shard"), every(blocks).alias("block"), "vec_id", "vector", F.lit(False).alias("asked"),
        F.lit(None).cast("double").alias("kth"),
    )
    asked = queries.select(deal(shards, 1).alias("home"), deal(blocks, 2).alias("block"), "vec_id", "vector",
                           F.lit(True).alias("asked"))

    def searched(batch: DataFrame) -> DataFrame:
        both = data.unionByName(batch)
        return both.groupBy("shard", "block").applyInPandas(
            lambda pdf: _search(pdf, k), "query_id long, vec_id long, score long")

    first = cut_lineage(searched(asked.withColumn("kth", F.lit(None).cast("double")).select(
        F.col("home").alias("shard"), "block", "vec_id", "vector", "asked", "kth")))
    bound = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).cast("double").alias("kth"))
    found = first
    if shards > 1:
        away = asked.join(bound, "vec_id", "left").withColumn("shard", every(shards)).where("shard <> home")
        found = first.unionByName(searched(away.select("shard", "block", "vec_id", "vector", "asked", "kth")))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
