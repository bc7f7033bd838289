"""Filter interaction audit: what each filter removes, alone and after others, in every order.

Repeated texts are found by an existential self-join on hash, exact text and smaller id. The ids it marks and those of
the other failures are united and gathered into one set of failure bits per document; all orders are read from the
counts of these sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkgrade.llm.common import UPPER, stored

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
#: Rows of one text are spread over this many tasks.
SPREAD = 64


def text_failures(text: str | None) -> int:
    """Failure bits of the filters A to D, which look at one text alone; null is empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # splits at ASCII blanks alone
    upper = len(raw) - len(raw.translate(None, UPPER.encode()))
    return (
        BIT["A"] * (len(words) < 200) | BIT["B"] * (100 * len(set(words)) < 50 * len(words))
        | BIT["C"] * (100 * upper > 2 * len(text)) | BIT["D"] * (len(raw) > len(raw.translate(None, b"#$%&*|")))
    )


def repeated_rows(rows: DataFrame) -> DataFrame:
    """Those of the rows (id, text, hash, ...) whose text another row of smaller id has; a null id is never smaller.

    A count per hash, combined before the shuffle and spread by id, leaves only rows that repeat a hash; the join
    then compares their whole texts with the least id of each text, one row per text and slot of ids.
    """
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SPREAD)))
    slots = rows.where("id IS NOT NULL").groupBy("hash", "slot").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    shared = stored(slots.groupBy("hash").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set("slot").alias("slots"),  # at most SPREAD
    ).where("low < high").select("hash", F.explode("slots").alias("slot")))
    repeats = rows.join(shared, ["hash", "slot"], "left_semi")
    least = repeats.groupBy("hash", "text", "slot").agg(F.min("id").alias("low"))
    firsts = (
        least.groupBy("hash", "text").agg(F.min("low").alias("first_id"), F.collect_set("slot").alias("slots"))
        .select(F.col("hash").alias("first_hash"), F.col("text").alias("first_text"), "first_id",
                F.explode("slots").alias("first_slot"))
    )
    smaller = F.expr("hash = first_hash AND slot = first_slot AND text = first_text AND first_id < id")
    return repeats.join(firsts, smaller, "left_semi").drop("slot")


def filter_audit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per part, order of the five filters and step, zeros included. Null texts and parts are empty strings;
    every row counts as a document, repeated rows too; a row without id repeats nothing and has no label; of several
    labels of an id any 1 counts. An empty table has no parts and gives no rows. Columns beyond id, text and part are
    not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashes = [F.xxhash64("text").alias("hash"), F.xxhash64(F.lit("again"), "text").alias("check")]

    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(text_failures).astype("int32")

    # Not deterministic for the planner only, so that it does not judge again below the filter.
    bits = F.pandas_udf(judge, "int").asNondeterministic()(F.col("text"))
    alone = rows.select("id", "part", *hashes, bits.alias("bits")).where("bits > 0")
    again = repeated_rows(rows.select("*", *hashes)).select("id", "part", "hash", "check", F.lit(BIT["E"]).alias("bits"))
    # Rows equal in id, part and text fail the same filters: one set for all of them, and their number.
    failed = alone.unionByName(again).groupBy("id", "part", "hash", "check").agg(
        F.bit_or("bits").alias("bits"),
        F.greatest(F.count_if(F.col("bits") < BIT["E"]), F.count_if(F.col("bits") == BIT["E"])).alias("n"))
    marks = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    sets = failed.join(marks, "id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    everything = rows.groupBy("part").agg(F.count("*").alias("total")).select(
        "part", F.lit(0).alias("bits"), F.lit(0).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), "total")
    return in_every_order(sets.withColumn("total", F.lit(0)).unionByName(everything))


def in_every_order(sets: DataFrame) -> DataFrame:
    """The audit from (part, bits, n, good, toxic, total): documents by failure bits, and all of a part."""
    spark, names = sets.sparkSession, sorted(BIT)
    places = [
        (sum(BIT[f] for f in order[:at]), BIT[order[at]], "".join(order), at + 1)
        for order in permutations(names) for at in range(len(names))
    ]
    steps = spark.createDataFrame(places, "before int, own int, filter_order string, step int")
    cases = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own"))
                      for b, o in sorted({(b, o) for b, o, _, _ in places})])
    n, good, toxic = F.col("n"), F.col("good"), F.col("toxic")
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0
    number = lambda condition, what: F.sum(F.when(condition, what).otherwise(0)).cast("long")
    # A filter is the first of k failing ones in a k-th of all orders.
    turns = F.floor(F.lit(120) / F.bit_count("bits"))
    counted = sets.select("*", F.explode(cases).alias("c")).select("*", "c.*").groupBy("part", "before", "own").agg(
        (F.sum("total") - number(fails | gone, n)).alias("kept"), number(fails & ~gone, n).alias("removed"),
        number(fails & gone, n).alias("redundant"), number(F.col("bits") == F.col("own"), n).alias("unique_fails"),
        number(fails & ~gone, good).alias("good_lost"), number(fails & ~gone, toxic).alias("toxic_lost"),
        number(fails, n * turns).alias("shapley"))
    return counted.join(steps, ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley")
