"""Segment tables (x1, y1, x2, y2): angles, lengths, hatch families and dashed lines.

Sums, counts and histograms are grouped aggregates, combined before the shuffle. Where an order
matters, values are first reduced to one row per distinct value, so repeated segments cost nothing;
the distinct half-pixel coordinates of a page of at most 2200 pixels are few thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkgrade.functions.angles import (
    acute, flat, mod180, nearest_angle, raw_angle, seg_length, skew_fold, slanted, steep,
)
from inkgrade.functions.boxes import clip_box
from inkgrade.functions.cols import all_of, flag, for_all, top_rows

c = F.col


def segment_features(segments: DataFrame) -> DataFrame:
    """Length, angle mod 180, acute angle, deviation from the axes, and midpoint."""
    a = raw_angle()
    return segments.select(
        "*", seg_length().alias("length"), mod180(a).alias("angle"), acute(a).alias("acute"), skew_fold(a).alias("skew"),
        ((c("x1") + c("x2")) / 2.0).alias("mid_x"), ((c("y1") + c("y2")) / 2.0).alias("mid_y"))


def angle_hist(segments: DataFrame, bins: int = 18, min_length: float = 40.0, keys: list[str] = ["drawing_id"],
               drawings: DataFrame | None = None) -> DataFrame:
    """Share of segments per direction as an array; uniform when none is long enough, also for drawings without any
    if ``drawings`` lists them."""
    rows = segments.select(*keys, F.when(seg_length() >= min_length, F.least(
        F.floor(mod180(raw_angle()) / (180.0 / bins)), F.lit(bins - 1))).alias("bin"))
    counted = rows.groupBy(*keys).agg(F.count("bin").alias("n"), *[F.count_if(c("bin") == i).alias(f"b{i}") for i in range(bins)])
    share = F.array(*[c(f"b{i}") / F.greatest(c("n"), F.lit(1)) for i in range(bins)])
    uniform = F.array_repeat(F.lit(1.0 / bins), bins)
    hist = counted.select(*keys, F.when(c("n") > 0, share).otherwise(uniform).alias("hist"))
    return for_all(drawings, hist, keys, hist=uniform)


def orientation_ratios(segments: DataFrame, preset: str = "region", keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Length shares of axis-aligned and diagonal segments, under one of three sets of thresholds."""
    length = seg_length()
    hv, diag = {
        "visible": (flat(12) | steep(78), slanted(18, 72)),
        "projection": (flat(12) | steep(78), slanted(18, 72)),
        "region": (flat(15) | steep(75), slanted(25, 65)),
    }[preset]
    rows = segments.select("*", length.alias("_l"), hv.alias("_hv"), diag.alias("_diag"))
    if preset != "projection":
        rows = rows.filter("_l >= 1")
    total = lambda cond: F.sum(F.when(cond, c("_l")).otherwise(0.0))
    long = c("_l") >= F.greatest(F.lit(18.0), 0.10 * F.least("w", "h"))
    s = rows.groupBy(*keys).agg(
        total(F.lit(True)).alias("total"), total(c("_hv")).alias("hv_len"), total(c("_diag")).alias("diag_len"),
        total(c("_diag") & long).alias("long_diag_len"), F.count("*").alias("line_count"))
    if preset == "projection":
        return s.select(*keys, "hv_len", "diag_len",
                        (c("hv_len") / F.greatest(F.lit(1e-6), c("hv_len") + c("diag_len"))).alias("hv_line_ratio"))
    base = F.greatest(c("total"), F.lit(1e-6)) if preset == "visible" else c("total") + 1e-6
    ratios = [(c(n) / base).alias(a) for n, a in (("hv_len", "hv_ratio"), ("diag_len", "diag_ratio"), ("long_diag_len", "long_diag_ratio"))]
    out = s.select(*keys, "line_count", *ratios)
    return out if preset == "visible" else out.withColumn(
        "view_type", F.when(c("diag_ratio") > c("hv_ratio") + 0.12, "diag_dominant").otherwise("hv_dominant"))


def long_line_ratio(segments: DataFrame, keys: list[str] = ["drawing_id"], drawings: DataFrame | None = None) -> DataFrame:
    """Share of segments that span a tenth of the page (w, h), at least 120 pixels; 0 for drawings without any."""
    length = seg_length()
    long = F.when(length >= 10, flag(length >= F.greatest(F.lit(120.0), 0.10 * F.greatest("w", "h"))))
    ratio = segments.groupBy(*keys).agg(F.coalesce(F.avg(long), F.lit(0.0)).alias("long_ratio"))
    return for_all(drawings, ratio, keys, long_ratio=F.lit(0.0))


def skew_angle(segments: DataFrame, keys: list[str] = ["drawing_id"], drawings: DataFrame | None = None) -> DataFrame:
    """Length-weighted mean deviation from the axes, over segments within 20 degrees; 0 for drawings without any."""
    a, length = skew_fold(raw_angle()), seg_length()
    near = (F.abs(a) <= 20) & (length > 0)
    skew = segments.groupBy(*keys).agg(F.coalesce(
        F.sum(F.when(near, a * length)) / (F.sum(F.when(near, length)) + 1e-6), F.lit(0.0)).alias("skew_angle"))
    return for_all(drawings, skew, keys, skew_angle=F.lit(0.0))


def weighted_mean_std(
    df: DataFrame, value: Column, weight: Column, keys: list[str] = ["drawing_id"], groups: DataFrame | None = None,
) -> DataFrame:
    """Weighted mean and deviation; (0, 999) without weight, also for those of ``groups`` that have no rows.

    The deviation is summed from the distances to the mean, not as a difference of squares, so large equal values have
    none. Both are grouped sums, combined before the shuffle; the means are one row per group.
    """
    rows = df.select(*keys, value.alias("_v"), weight.alias("_w"))
    means = rows.groupBy(*keys).agg(F.sum("_w").alias("_sum"), (F.sum(c("_v") * c("_w")) / (F.sum("_w") + 1e-6)).alias("_mean"))
    off = c("_v") - c("_mean")
    spread = rows.join(means, keys).groupBy(*keys).agg(
        F.first("_mean").alias("mean"), F.first("_sum").alias("_sum"), F.sum(off * off * c("_w")).alias("_off"))
    some = c("_sum") > 1e-6
    found = spread.select(*keys, F.when(some, c("mean")).otherwise(0.0).alias("mean"),
                          F.when(some, F.sqrt(c("_off") / (c("_sum") + 1e-6))).otherwise(999.0).alias("std"))
    return for_all(groups, found, keys, mean=F.lit(0.0), std=F.lit(999.0))


# ---- clusters of positions ----------------------------------------------------------------------
def cluster_1d(values: DataFrame, keys: list[str], value: str, tol: Column, members: bool = False) -> DataFrame:
    """Greedy clusters of sorted values against the running mean of the open cluster.

    Equal values always join the same cluster, so they are counted first. A step larger than the
    tolerance always opens a cluster, because the mean never exceeds the last value; chains between
    such steps are independent and each is folded on its own. Columns: lo, hi, mean, n; with
    ``members`` one row per distinct value ``v`` instead of one per cluster.
    """
    counted = values.select(*keys, c(value).cast("double").alias("v"), tol.cast("double").alias("tol")).groupBy(*keys, "v").agg(
        F.count("*").alias("n"), F.max("tol").alias("tol"))
    order = Window.partitionBy(*keys).orderBy("v")
    cut = flag(c("v") - F.lag("v").over(order) > c("tol"))
    chains = counted.withColumn("_cut", cut).withColumn("chain", F.sum("_cut").over(order)).groupBy(*keys, "chain").agg(
        F.sort_array(F.collect_list(F.struct("v", "n"))).alias("vs"), F.max("tol").alias("tol"))
    kind = "array<struct<total:double,n:bigint,lo:double,hi:double>>"

    def add(done, x):
        last = F.element_at(done, -1)
        v, n = x.getField("v"), x.getField("n")
        joins = F.abs(v - last.getField("total") / last.getField("n")) <= c("tol")
        fresh = F.struct((v * n).alias("total"), n.alias("n"), v.alias("lo"), v.alias("hi"))
        grown = F.struct((last.getField("total") + v * n).alias("total"), (last.getField("n") + n).alias("n"),
                         last.getField("lo").alias("lo"), v.alias("hi"))
        return F.when(F.size(done) == 0, F.array(fresh)).when(
            joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    folded = F.aggregate("vs", F.array().cast(kind), add)
    clusters = chains.select(*keys, "vs", F.explode(folded).alias("_k")).select(
        *keys, "_k.lo", "_k.hi", (c("_k.total") / c("_k.n")).alias("mean"), "_k.n", *(["vs"] if members else []))
    if not members:
        return clusters
    own = F.filter("vs", lambda x: x.getField("v").between(c("lo"), c("hi")))
    return clusters.select(*keys, "lo", "hi", "mean", "n", F.explode(F.transform(own, lambda x: x.getField("v"))).alias("v"))


# ---- hatch families -----------------------------------------------------------------------------
def hatch_candidates(segments: DataFrame) -> DataFrame:
    """Segments near 45 or 60 degrees in a region of size w × h, with their family."""
    base = F.least("w", "h")
    long = seg_length() >= F.greatest(F.lit(10), (base * 0.07).cast("int"))
    # nearest of 45 and 60, at most 11 degrees off: 34 to 71, split half-way
    rows = segments.filter(long & slanted(34, 71))
    return rows.withColumn("family", F.when(flat(52.5), 45.0).otherwise(60.0)).withColumn("length", seg_length()).withColumn(
        "acute", acute(raw_angle())).withColumn("mid_x", (c("x1") + c("x2")) / 2.0).withColumn("mid_y", (c("y1") + c("y2")) / 2.0)


def hatch_family(segments: DataFrame, keys: list[str] = ["drawing_id"], regions: DataFrame | None = None) -> DataFrame:
    """The dominant hatch direction of each region: by count, then length, then 45 before 60.

    With ``regions`` also those without candidates: no lines, deviation 999.
    """
    per = hatch_candidates(segments).groupBy(*keys, "family").agg(
        F.count("*").alias("dom_line_count"), F.sum("length").alias("length_sum"), F.median("acute").alias("dom_angle"),
        F.stddev_pop("acute").alias("angle_std"), F.avg(c("length") / F.greatest(F.hypot("w", "h"), F.lit(1.0))).alias("mean_len_ratio"),
        F.max(F.least("w", "h")).alias("base"))
    totals = per.groupBy(*keys).agg(F.sum("dom_line_count").alias("line_count"))
    best = top_rows(per, keys, [F.desc("dom_line_count"), F.desc("length_sum"), F.asc("family")])
    found = best.join(totals, keys).select(
        *keys, c("family").alias("target_angle"), "line_count", "dom_line_count",
        (c("dom_line_count") / c("line_count")).alias("dom_ratio"), "dom_angle", "angle_std", "mean_len_ratio", "base")
    zero = F.lit(0.0)
    return for_all(regions, found, keys, target_angle=zero, line_count=F.lit(0), dom_line_count=F.lit(0), dom_ratio=zero,
                   dom_angle=zero, angle_std=F.lit(999.0), mean_len_ratio=zero, base=F.lit(None))


def stripe_spacing(segments: DataFrame, families: DataFrame, keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Number and spacing of stripes across the dominant direction."""
    dominant = families.select(*keys, c("target_angle").alias("family"), "base")
    rad = F.radians("family")
    position = -F.sin(rad) * c("mid_x") + F.cos(rad) * c("mid_y")
    rows = hatch_candidates(segments).join(dominant, [*keys, "family"]).select(
        *keys, position.alias("position"), F.greatest(F.lit(3.0), c("base") * 0.020).alias("tol"))
    stripes = cluster_1d(rows, keys, "position", c("tol"))
    gap = c("mean") - F.lag("mean").over(Window.partitionBy(*keys).orderBy("mean"))
    spaced = stripes.withColumn("gap", gap).groupBy(*keys).agg(
        F.count("*").alias("stripe_count"), F.median("gap").alias("median_gap"), F.stddev_pop("gap").alias("gap_std"), F.avg("gap").alias("gap_mean"))
    n = c("stripe_count")
    return families.join(spaced, keys, "left").select(
        *keys, F.coalesce(n, F.lit(0)).alias("stripe_count"),
        F.when(n >= 2, c("median_gap") / F.greatest(c("base"), F.lit(1))).otherwise(0.0).alias("median_gap_norm"),
        F.when(n > 2, c("gap_std") / F.greatest(c("gap_mean"), F.lit(1e-6))).when(n == 2, 0.0).otherwise(999.0).alias("gap_cv"))


def parallel_segments(segments: DataFrame) -> DataFrame:
    """Short segments close to a hatch direction, with their offset bin, in a page of size w × h."""
    long, short = F.greatest("w", "h"), F.least("w", "h")
    rows = segment_features(segments).withColumn("near", nearest_angle(c("angle"))).filter(all_of(
        c("length") >= 6, c("near.diff") <= 8.5, c("length") <= F.greatest(F.lit(26), (0.33 * long).cast("int"))))
    normal = F.radians((c("near.target") + 90.0) % 180.0)
    rho = c("mid_x") * F.cos(normal) + c("mid_y") * F.sin(normal)
    return rows.select("*", c("near.target").alias("target"), F.rint(rho / F.greatest(F.lit(6.0), 0.018 * short)).cast("bigint").alias("bin")).drop("near")


def parallel_families(segments: DataFrame, keys: list[str] = ["drawing_id"], drawings: DataFrame | None = None) -> DataFrame:
    """Hatch families with enough short parallel lines, and how many segments and bins they hold.

    With ``drawings`` also those without candidates, all counts zero.
    """
    rows = parallel_segments(segments)
    bins = rows.groupBy(*keys, "target", "bin").agg(F.count("*").alias("n"), F.sum("length").alias("len")).filter("len >= 8")
    rich = bins.groupBy(*keys, "target").agg(F.count("*").alias("bins"), F.sum("n").alias("accepted"))
    lengths = rows.groupBy(*keys, "target").agg(
        F.count("*").alias("n"), F.percentile("length", [0.5, 0.85]).alias("q"), F.max(F.greatest("w", "h")).alias("side"))
    good = lengths.filter((c("n") >= 4) & (c("q")[0] <= 0.16 * c("side")) & (c("q")[1] <= 0.28 * c("side"))).join(
        rich.filter("bins >= 4"), [*keys, "target"])
    sums = good.groupBy(*keys).agg(F.count("*").alias("accepted_families"), F.sum("accepted").alias("accepted_segments"), F.sum("bins").alias("offset_bins"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    found = lengths.groupBy(*keys).agg(F.sum("n").alias("candidate_segments")).join(sums, keys, "left").select(
        *keys, "candidate_segments", zero("accepted_segments"), zero("accepted_families"), zero("offset_bins"))
    return for_all(drawings, found, keys, **{n: F.lit(0) for n in found.columns[len(keys):]})


def dominant_angle_hist(segments: DataFrame, keys: list[str] = ["drawing_id"], drawings: DataFrame | None = None) -> DataFrame:
    """Dominant diagonal direction by summed length per degree, and the lines within ten degrees of it.

    With ``drawings`` also those with fewer than three diagonal or kept lines: no direction, no lines, shares zero.
    """
    rows = segment_features(segments).filter((c("length") >= 3) & c("acute").between(18, 75)).withColumn(
        "bin", F.ceil(c("acute") - 0.5))
    hist = rows.groupBy(*keys, "bin").agg(F.sum("length").alias("len"), F.count("*").alias("n"))
    total = hist.groupBy(*keys).agg(F.sum("len").alias("total_len"), F.sum("n").alias("diag_count"))
    dominant = top_rows(hist, keys, [F.desc("len"), F.asc("bin")]).select(*keys, c("bin").alias("dominant_angle"))
    kept = rows.join(dominant, keys).filter(F.abs(c("acute") - c("dominant_angle")) <= 10.0).groupBy(*keys, "dominant_angle").agg(
        F.count("*").alias("line_count"), F.sum("length").alias("kept_len"), F.max(F.greatest(F.lit(1), F.least("w", "h"))).alias("side"))
    found = total.filter("diag_count >= 3").join(kept, keys).filter("line_count >= 3").select(
        *keys, "dominant_angle", "line_count", (c("kept_len") / (c("total_len") + 1e-6)).alias("parallel_ratio"),
        (c("kept_len") / c("side")).alias("length_ratio"))
    return for_all(drawings, found, keys, dominant_angle=F.lit(None), line_count=F.lit(0), parallel_ratio=F.lit(0.0),
                   length_ratio=F.lit(0.0))


# ---- dashed lines -------------------------------------------------------------------------------
def short_axis_segments(segments: DataFrame) -> DataFrame:
    """Short near-horizontal and near-vertical segments of a view of size w × h, along one axis."""
    side = F.greatest(F.lit(1), F.least("w", "h"))
    low = F.greatest(F.lit(5), (side * 0.04).cast("int"))
    high = F.greatest(low + 2, (side * 0.30).cast("int"))
    h = flat(14)
    rows = segments.filter(seg_length().between(low, high) & (h | steep(76)))
    return rows.select(
        *[n for n in segments.columns if n not in ("x1", "y1", "x2", "y2")], F.when(h, "h").otherwise("v").alias("axis"),
        F.when(h, c("y1") + c("y2")).otherwise(c("x1") + c("x2")).alias("coord2"),
        F.when(h, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("a1"),
        F.when(h, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("a2"),
        F.when(h, c("w")).otherwise(c("h")).alias("span_px"))


def dashed_sequences(segments: DataFrame, keys: list[str] = ["drawing_id", "role"]) -> DataFrame:
    """Dashed lines: aligned short segments with regular small gaps over a good part of the view.

    Segments of a line that start at the same pixel are reduced to the longest first, so the running
    maximum sees at most one row per pixel.
    """
    line = [*keys, "axis"]
    items = short_axis_segments(segments).withColumn("coord", c("coord2") / 2.0)
    coords = cluster_1d(items, line, "coord", F.lit(5.0), members=True).filter("n >= 3")
    marked = items.join(coords.select(*line, c("v").alias("coord"), c("mean").alias("coord_mean")), [*line, "coord"])
    line = [*line, "coord_mean"]
    starts = marked.groupBy(*line, "a1").agg(F.max("a2").alias("a2"), F.max("span_px").alias("span_px"))
    order = Window.partitionBy(*line).orderBy("a1")
    reach = F.max("a2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = starts.withColumn("_new", flag(c("a1") > reach + 2)).withColumn("island", F.sum("_new").over(order)).groupBy(
        *line, "island").agg(F.min("a1").alias("s"), F.max("a2").alias("e"), F.max("span_px").alias("span_px"))
    gap = c("s") - F.lag("e").over(Window.partitionBy(*line).orderBy("s"))
    found = islands.withColumn("gap", gap).groupBy(*line).agg(
        F.count("*").alias("segment_count"), F.count_if(c("gap") >= 0).alias("gaps"),
        F.avg(F.when(c("gap") >= 0, c("gap"))).alias("mean_gap"), (F.max("e") - F.min("s")).alias("span"), F.max("span_px").alias("span_px"))
    ratio = c("span") / F.greatest(F.lit(1.0), "span_px")
    return found.withColumn("span_ratio", ratio).filter(all_of(
        c("segment_count") >= 3, c("gaps") >= 2, c("mean_gap").between(2, 26), c("span_ratio") >= 0.16)).drop("gaps", "span_px")


def centerline_strength(sequences: DataFrame, views: DataFrame, keys: list[str] = ["drawing_id", "role"]) -> DataFrame:
    """How well dashed lines through the middle of a view mark its centre."""
    rows = sequences.join(views.select(*keys, "w", "h"), keys)
    along_h = c("axis") == "h"
    near = F.when(along_h, F.abs(c("coord_mean") - c("h") / 2.0) <= c("h") * 0.22).otherwise(
        F.abs(c("coord_mean") - c("w") / 2.0) <= c("w") * 0.22)
    s = rows.withColumn("near", near).groupBy(*keys).agg(
        F.count("*").alias("hidden_sequences"), F.count_if(c("near") & along_h).alias("hn"), F.count_if(c("near") & ~along_h).alias("vn"),
        F.count_if(c("near") & (c("span_ratio") >= 0.24)).alias("long"))
    center = F.when((c("hn") > 0) & (c("vn") > 0), "strong").when(c("long") > 0, "weak").otherwise("none")
    return views.select(*keys).join(s, keys, "left").select(
        *keys, F.coalesce("hidden_sequences", F.lit(0)).alias("hidden_sequences"), F.coalesce(center, F.lit("none")).alias("center"))


def visible_contours(segments: DataFrame, keys: list[str] = ["drawing_id", "role"], views: DataFrame | None = None) -> DataFrame:
    """Whether a view of size w × h has enough long axis-near lines to count as drawn.

    With ``views`` also those without segments, which are not drawn.
    """
    near = flat(18) | steep(72)
    s = segments.groupBy(*keys).agg(
        F.count_if(near).alias("count"), F.sum(F.when(near, seg_length()).otherwise(0.0)).alias("len"),
        F.max(F.greatest(F.lit(1), F.least("w", "h"))).alias("side"))
    ratio = c("len") / c("side")
    found = s.select(*keys, "count", ratio.alias("total_length_ratio"), ((c("count") >= 4) & (ratio >= 2.0)).alias("visible"))
    return for_all(views, found, keys, count=F.lit(0), total_length_ratio=F.lit(0.0), visible=F.lit(False))


def dimension_segments(segments: DataFrame, pad: int = 2) -> DataFrame:
    """Axis-near segments of at least ``base`` pixels as padded boxes inside the band (w, h)."""
    span = F.struct((F.least("x1", "x2") - pad).alias("x1"), (F.least("y1", "y2") - pad).alias("y1"),
                    (F.greatest("x1", "x2") + pad + 1).alias("x2"), (F.greatest("y1", "y2") + pad + 1).alias("y2"))
    fit = segments.filter((seg_length() >= c("base")) & (flat(12) | steep(78)))
    return fit.withColumn("b", clip_box(span, c("w"), c("h"))).filter("b IS NOT NULL").select(
        *[n for n in segments.columns if n not in ("x1", "y1", "x2", "y2", "w", "h", "base")], "b.*")
