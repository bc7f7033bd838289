"""One-dimensional profiles: rows (profile_id, pos, val) with every position from 0 to the last.

A profile is the row or column profile of one page, so it has at most 2200 positions, each once;
``occupancy_profile`` produces it by a count combined before the shuffle. Windows per profile are
therefore small however many cells a page had, and all steps share the partitioning by profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkgrade.functions.cols import flag, top_rows

c = F.col
ID = "profile_id"
GROUP = "profile_group"  # a profile may belong to one; rows partitioned by group then stay where they are


def _keys(profile: DataFrame) -> list[str]:
    return [GROUP, ID] if GROUP in profile.columns else [ID]


def _by_pos(profile: DataFrame):
    return Window.partitionBy(*_keys(profile)).orderBy("pos")


def odd(k: Column | int) -> Column | int:
    """Kernel size: at least 3 and odd."""
    if isinstance(k, Column):
        k = F.greatest(F.lit(3), k.cast("int"))
        return k + F.when(k % 2 == 0, 1).otherwise(0)
    k = max(3, int(k))
    return k if k % 2 else k + 1


def _col(value: Column | int | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fill_positions(sparse: DataFrame, lengths: DataFrame) -> DataFrame:
    """Zero-filled profiles from sparse (profile_id, pos, val) and lengths (profile_id, n)."""
    every = lengths.filter("n > 0").select(ID, F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("pos"))
    return every.join(sparse, [ID, "pos"], "left").select(ID, "pos", F.coalesce("val", F.lit(0.0)).alias("val"))


def occupancy_profile(cells: DataFrame, dims: DataFrame, axis: str = "y", how: str = "count") -> DataFrame:
    """On-cells per row or column of each mask, or their share of the row or column."""
    along, across = ("h", "w") if axis == "y" else ("w", "h")
    counts = cells.groupBy("mask_id", axis).agg(F.count("*").alias("n"))
    every = dims.filter(c(along) > 0).select("mask_id", across, F.explode(F.sequence(F.lit(0), c(along) - 1)).alias(axis))
    val = F.coalesce("n", F.lit(0)).cast("double")
    return every.join(counts, ["mask_id", axis], "left").select(
        c("mask_id").alias(ID), c(axis).alias("pos"), (val if how == "count" else val / c(across)).alias("val"))


def moving_average(profile: DataFrame, k: Column | int, out: str = "smooth") -> DataFrame:
    """Centred sum over ``k`` positions divided by ``k``; beyond the ends counts as zero.

    ``k`` may be a column that is constant within a profile. A frame cannot read a column, so such a window is the
    difference of two prefix sums of the profile.
    """
    k, keys, order = odd(k), _keys(profile), _by_pos(profile)
    if isinstance(k, int):
        return profile.withColumn(out, F.sum("val").over(order.rowsBetween(-(k // 2), k // 2)) / k)
    prefix = F.sum("val").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rest = [n for n in profile.columns if n not in (*keys, "pos")]
    rows = profile.withColumns({"_p": prefix, "_k": k}).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "_p", "_k", *rest))).alias("_rows"))  # the positions of one profile

    def average(row: Column, i: Column) -> Column:
        size, half = row.getField("_k"), F.floor(row.getField("_k") / 2).cast("int")
        upto = F.get("_rows", F.least(i + half, F.size("_rows") - 1)).getField("_p")
        before = F.coalesce(F.get("_rows", i - half - 1).getField("_p"), F.lit(0.0))
        return F.struct(row.getField("pos").alias("pos"), *[row.getField(n).alias(n) for n in rest],
                        ((upto - before) / size).alias(out))

    return rows.select(*keys, F.inline(F.transform("_rows", average)))


def _runs(profile: DataFrame, on: Column, *more: Column) -> DataFrame:
    """Maximal runs [s, e) of equal flag, with further aggregates."""
    keys = [*_keys(profile), "_on"]
    island = c("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return profile.withColumn("_on", on).withColumn("_i", island).groupBy(*keys, "_i").agg(
        F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"), *more).drop("_i")


def find_runs(profile: DataFrame, on: Column, min_len: Column | int = 1) -> DataFrame:
    """Maximal on-runs of at least ``min_len`` positions (a column must be constant within a profile)."""
    runs = _runs(profile.withColumn("_min", _col(min_len)), on, F.max("_min").alias("_min")).filter("_on")
    return runs.filter(c("e") - c("s") >= c("_min")).drop("_on", "_min")


def close_gaps(profile: DataFrame, on: Column, gap: Column | int, out: str = "closed") -> DataFrame:
    """Flags after closing: inner off-runs shorter than the kernel turn on, and off-runs at an end
    that fit in half of it. A profile that is off throughout stays off."""
    k = _col(odd(gap))
    half = F.floor(k / 2)
    order = _by_pos(profile)
    span = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.last(F.when(c("_on"), c("pos")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(c("_on"), c("pos")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = profile.withColumn("_on", on).select(
        "*", before.alias("_b"), after.alias("_a"), F.max("pos").over(span).alias("_last"))
    inner = c("_b").isNotNull() & c("_a").isNotNull() & (c("_a") - c("_b") - 1 < k)
    left = c("_b").isNull() & c("_a").isNotNull() & (c("_a") <= half)
    right = c("_a").isNull() & c("_b").isNotNull() & (c("_last") - c("_b") <= half)
    return marked.withColumn(out, c("_on") | inner | left | right).drop("_on", "_b", "_a", "_last")


def split_by_valleys(
    profile: DataFrame, min_len: Column | int, rel: Column | float, k: Column | int, occupancy: bool = False,
    floor: Column | float = 0.01,
) -> DataFrame:
    """Segments between the valleys of the smoothed profile. Parameters may be columns, constant within a profile.

    Valleys are runs at or below ``rel`` of the maximum (for occupancy, at least ``floor``) of a fortieth
    of the length, at least 4. Fewer than two segments of ``min_len`` leave the whole profile; an
    empty profile gives nothing, or the whole for occupancy.
    """
    keys = _keys(profile)
    whole_span = Window.partitionBy(*keys)
    s = moving_average(profile.withColumns({"_min": _col(min_len), "_rel": _col(rel), "_floor": _col(floor)}), k).select(
        "*", F.max("smooth").over(whole_span).alias("top"), (F.max("pos").over(whole_span) + 1).alias("len"))
    valley = c("_rel") * c("top")
    low = c("smooth") <= (F.greatest("_floor", valley) if occupancy else valley)
    min_len = c("_min")
    wide = c("e") - c("s") >= F.greatest(F.lit(4), (c("len") * 0.025).cast("int"))
    # the few valleys of a profile are gathered in order; the rest is arithmetic on one row
    rows = _runs(s, low, F.max("top").alias("top"), F.max("len").alias("len"), F.max("_min").alias("_min")).groupBy(*keys).agg(
        F.max("top").alias("top"), F.max("len").cast("int").alias("len"), F.max("_min").alias("_min"),
        F.sort_array(F.collect_list(F.when(c("_on") & wide, F.struct("s", "e")))).alias("cuts"))
    end = F.array(F.struct(c("len").alias("s"), c("len").alias("e")))
    between = F.transform(F.concat("cuts", end), lambda x, i: F.struct(
        F.when(i == 0, 0).otherwise(F.get("cuts", i - 1).getField("e")).cast("int").alias("a"), x.getField("s").cast("int").alias("b")))
    parts = F.filter(between, lambda x: x.getField("b") - x.getField("a") >= min_len)
    whole = F.array(F.struct(F.lit(0).alias("a"), c("len").alias("b")))
    short, empty = c("len") <= 2 * min_len, c("top") <= 0
    blank = whole if occupancy else F.slice(whole, 1, 0)
    return rows.withColumn("parts", parts).select(*keys, F.inline(
        F.when(short, whole).when(empty, blank).when(F.size("parts") >= 2, c("parts")).otherwise(whole)))


def valley_cut(profile: DataFrame, height: Column | int, ratios=(0.52, 0.58, 0.64, 0.70)) -> DataFrame:
    """Candidate cuts of pages of ``height`` rows (a column must be constant within a profile): fixed shares, and the
    emptiest smoothed row."""
    whole = lambda share, of: (c(of) * share).cast("int")
    page = profile.withColumn("_h", _col(height)).withColumn("_y0", whole(0.62, "_h"))
    top = page.filter(c("pos") < c("_y0"))
    kernel = F.greatest(F.lit(9), whole(0.02, "_h"))
    top = moving_average(top, kernel if isinstance(height, Column) else max(9, int(height * 0.02)))
    lo, hi = whole(0.35, "_y0"), whole(0.92, "_y0")
    best = top_rows(top.filter((c("pos") >= lo) & (c("pos") < hi) & (hi > lo + 5)), [ID], [F.asc("smooth"), F.asc("pos")])
    rows = page.groupBy(ID).agg(F.max("_h").alias("_h")).join(best.select(ID, "pos"), ID, "left")
    soft = F.when(c("pos").isNotNull(), F.greatest(whole(0.50, "_h"), c("pos").cast("int")))
    candidates = F.array_distinct(F.array_compact(F.array(*[whole(r, "_h") for r in ratios], soft)))
    kept = F.filter(candidates, lambda y: y.between(whole(0.45, "_h"), whole(0.78, "_h")))
    return rows.select(ID, F.explode(F.array_sort(kept)).alias("ycut"))


def extent_above(profile: DataFrame, threshold: float, relative: float | None = None, pad: int = 0, value: str = "val") -> DataFrame:
    """First and last position reaching the threshold (or ``relative`` of the maximum, at least the
    threshold), padded and clipped; the whole profile when none does."""
    whole = Window.partitionBy(ID)
    top = profile.withColumn("_top", F.max(value).over(whole))
    limit = F.lit(threshold) if relative is None else F.greatest(F.lit(threshold), c("_top") * relative)
    hit = F.when(c(value) >= limit, c("pos"))
    s = top.groupBy(ID).agg(F.min(hit).alias("first"), F.max(hit).alias("last"), (F.max("pos") + 1).alias("len"))
    return s.select(
        ID, F.coalesce(F.greatest(F.lit(0), c("first") - pad), F.lit(0)).alias("s"),
        F.when(c("last").isNull(), c("len")).otherwise(F.least("len", c("last") + 1 + pad)).alias("e"))


def band_spacing_cv(profile: DataFrame) -> DataFrame:
    """Variation of the gaps between bands of occupied rows; null with fewer than three bands."""
    top = profile.withColumn("_top", F.max("val").over(Window.partitionBy(ID)))
    bands = find_runs(top, c("val") >= F.greatest(F.lit(0.002), c("_top") * 0.25)).withColumn("center", (c("s") + c("e") - 1) / 2.0)
    gap = c("center") - F.lag("center").over(Window.partitionBy(ID).orderBy("center"))
    s = bands.withColumn("gap", gap).groupBy(ID).agg(
        F.count("*").alias("bands"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"))
    return profile.select(ID).distinct().join(s, ID, "left").select(
        ID, F.coalesce("bands", F.lit(0)).alias("bands"),
        F.when((c("bands") >= 3) & (c("mean") > 1e-6), c("sd") / c("mean")).alias("spacing_cv"))


def active_runs(
    profile: DataFrame, k: Column | int, gap: Column | int, min_len: Column | int, rel: float = 0.17, floor: float = 4.0,
) -> DataFrame:
    """Runs where the smoothed profile is active, after closing small gaps. Parameters may be columns, constant within
    a profile."""
    s = moving_average(profile.withColumns({"_gap": _col(gap), "_len": _col(min_len)}), k)
    s = s.withColumn("_thr", F.greatest(F.lit(floor), rel * F.max("smooth").over(Window.partitionBy(*_keys(s)))))
    closed = close_gaps(s, c("smooth") >= c("_thr"), c("_gap") if isinstance(gap, Column) else gap)
    return find_runs(closed, c("closed"), c("_len"))
