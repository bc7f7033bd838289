"""Small column helpers used by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def clip(value: Column, low, high) -> Column:
    """Limit to [low, high]. Null is skipped by both functions and comes out as ``high``: callers guard
    nullable inputs themselves, which keeps ``value`` single in the plan."""
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def clip01(value: Column) -> Column:
    return clip(value, 0.0, 1.0)


def half_even(value: Column) -> Column:
    """Round to the nearest whole number, ties to even, as an int."""
    return F.rint(value).cast("int")


def points(value: Column, top: int) -> Column:
    """Whole points between 0 and ``top``."""
    return clip(half_even(value), 0, top)


def at_least_one(value: Column) -> Column:
    return F.greatest(value, F.lit(1))


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (null counts as 0)."""
    return F.when(condition, 1).otherwise(0)


def ladder(value: Column, steps, otherwise, descending: bool = True) -> Column:
    """First matching step: ``value >= bound`` (or ``<=`` when ascending)."""
    out = None
    for bound, result in steps:
        hit = value >= F.lit(bound) if descending else value <= F.lit(bound)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def messages(*pairs) -> Column:
    """Array with the text of each pair (condition, text) whose condition holds."""
    return F.array_compact(
        F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs])
    )


def for_all(drawings: DataFrame | None, df: DataFrame, keys: list[str], **empty: Column) -> DataFrame:
    """``df`` with a row for each of the drawings, those it lacks with the ``empty`` values; as it is without drawings."""
    if drawings is None:
        return df
    every = drawings.select(*keys).distinct().join(df.withColumn("_has", F.lit(True)), keys, "left")
    filled = every.withColumns({n: F.when(F.col("_has"), F.col(n)).otherwise(v) for n, v in empty.items()})
    return filled.select(*keys, *empty)


def top_rows(df: DataFrame, keys, order, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key.

    Spark plans ``row_number() <= k`` as a window group limit that runs before the shuffle too, so
    at most ``k`` rows per key and map task are exchanged, whatever the size of the largest key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
