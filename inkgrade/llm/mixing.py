"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkgrade.llm.common import word_count
from inkgrade.operators.lineage import cut_lineage

#: A run of equally hashed rows of one source and size class holds about this many rows at most.
ROWS_PER_RUN = 65_536


def source_targets(sizes: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) -> the same with ``weight``, ``target`` and ``rate``, the expected copies of a document.

    Sources in code-point order, null last, take the weights in turn. All sizes are shared out by weight; a target
    stops at ``cap`` times the source's size and the excess is shared anew until none is above. Sorted by
    size / weight, the sources that stop come first, so the sharing ends in one pass of running sums. One row per
    source enters, however many documents it has.
    """
    step = math.lcm(*weights)
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("long"))
    order = W.orderBy((F.col("source_size") * F.expr(f"{step}L div weight")).asc(), F.col("source").asc_nulls_last())
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    s = s.select(
        "*", (F.col("source_size") * cap).alias("top"), F.sum("source_size").over(W.partitionBy()).alias("all"),
        (F.sum(F.col("source_size") * cap).over(order) - F.col("source_size") * cap).alias("before"),
        (F.sum("weight").over(W.partitionBy()) - F.sum("weight").over(order) + F.col("weight")).alias("open"),
    ).withColumn("stops", (wide("all") - wide("before")) * wide("weight") >= wide("top") * wide("open"))
    every = W.partitionBy()
    s = s.select(
        "source", "source_size", "weight", "top", "stops",
        (F.col("all") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("top"))).over(every), F.lit(0))).alias("left"),
        F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every).alias("open"),
    )
    target = F.when(F.col("stops"), F.col("top").cast("double")).otherwise(
        (F.col("left") * F.col("weight")).cast("double") / F.col("open").cast("double")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    return s.withColumn("target", target).select("source", "source_size", "weight", "target", rate.alias("rate"))


def size_class(size: Column) -> Column:
    """Numbers with equal length and two leading digits share a class; the class grows with the number."""
    text = size.cast("string")
    return F.when(size < 100, size.cast("int")).otherwise(
        (F.length(text) - 2) * 100 + F.substring(text, 1, 2).cast("int")
    )


def mixed_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix", out_col: str = "mix",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (all, if not given) with ``out_col``, a struct (size,
    source_size, target, copies).

    Within a source, documents are ordered by size class, then by a hash of id and seed. The running sum of their
    expected copies starts at one random offset per source, and a document is taken once per whole number that the
    sum crosses: systematic sampling, never more than ``cap`` copies. Ordered by size, the words taken miss the
    target by little more than one document.

    The position of a document in its source adds up from three levels, so that no source, however large, meets in
    one task: totals of size classes (at most some hundreds per source), counts of hash prefixes within a class,
    and row numbers within a run of one prefix, of about ``ROWS_PER_RUN`` rows.

    Null texts count no words; a null source is a source; rows without words and repeated rows are rows like
    others; of rows equal in all of size, hash and id, either may get the extra copy. Empty tables give no rows.
    """
    digits = max(0, math.ceil(math.log(max(1.0, docs.count() / 3 / ROWS_PER_RUN), 16)))
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    size = word_count(F.col(text_col))
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    source = F.col(source_col).cast("string")
    rows = docs.select(
        kept, F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("part"), size.alias("size"),
        F.col(id_col).alias("id"), hashed.alias("hash"),
    ).withColumns({"class": size_class(F.col("size")), "run": F.substring("hash", 1, digits)})
    runs = cut_lineage(rows.groupBy("part", "class", "run").agg(
        F.count("*").alias("n"), F.sum("size").alias("words")))  # read four times below, so the texts are not
    named = F.when(F.col("part") != "-", F.substring(F.col("part"), 2, 2**30)).alias("source")
    targets = source_targets(
        runs.groupBy("part").agg(F.sum("words").alias("source_size")).select(named, "source_size"),
        weights=weights, cap=cap,
    ).withColumn("part", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    classes = runs.groupBy("part", "class").agg(F.sum("n").alias("n")).select(
        "part", "class", (F.sum("n").over(W.partitionBy("part").orderBy("class")) - F.col("n")).alias("before_class")
    )
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("part"))), 1, 5), 16, 10).cast("double") / 2**20
    starts = (
        runs.select("part", "class", "run", (
            F.sum("n").over(W.partitionBy("part", "class").orderBy("run")) - F.col("n")).alias("before_run"))
        .join(classes, ["part", "class"]).join(targets.withColumn("offset", offset), "part")
        .select("part", "class", "run", (F.col("before_class") + F.col("before_run")).alias("before"),
                "source_size", "target", "rate", "offset")
    )
    at = F.row_number().over(W.partitionBy("part", "class", "run").orderBy("hash", "size", "id"))
    numbered = rows.withColumn("at", at).join(starts, ["part", "class", "run"])
    place = F.col("before") + F.col("at")
    crossed = lambda p: F.floor(F.col("offset") + F.col("rate") * p.cast("double"))
    copies = F.least(crossed(place) - crossed(place - 1), F.ceil("rate")).cast("long")
    return numbered.select(
        "row.*", F.struct("size", "source_size", "target", copies.alias("copies")).alias(out_col)
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    plan = mixed_copies(docs, **options, out_col="__mix").where("__mix.copies > 0")
    return plan.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__mix.copies").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
