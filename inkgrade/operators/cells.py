"""Masks as sets of on-cells, rows (mask_id, y, x), with page sizes (mask_id, h, w).

Mask algebra is set algebra. Morphology works on runs, rows (mask_id, y, s, e) with half-open spans:
there are far fewer of them than cells, and a page row of at most 2200 pixels holds at most 1100, so
a window over one row is small however many copies of a cell the input had (they collapse when runs
are built). Only connected components look at a whole mask at once, as runs: a page is bounded, and
so are they.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkgrade.functions.cols import all_of, flag
from inkgrade.operators.boxes import _cells as box_cells
from inkgrade.operators.lineage import cut_lineage

c = F.col
CELL = ["mask_id", "y", "x"]
ROW = ["mask_id", "y"]


# ---- sets ---------------------------------------------------------------------------------------
def ink_cells(pixels: DataFrame) -> DataFrame:
    """On-cells of gray pixels (mask_id, y, x, v): everything that is not white."""
    return pixels.filter("v < 255").select(*CELL)


def content_bbox(cells: DataFrame, dims: DataFrame, pad: int = 20) -> DataFrame:
    """Padded inclusive bounds of the on-cells; null for an empty mask."""
    b = cells.groupBy("mask_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    low = lambda n: F.when(c(n).isNotNull(), F.greatest(F.lit(0), c(n) - pad))
    high = lambda n, top: F.when(c(n).isNotNull(), F.least(c(top) - 1, c(n) + pad))
    return dims.join(b, "mask_id", "left").select(
        "mask_id", low("x1").alias("x1"), low("y1").alias("y1"), high("x2", "w").alias("x2"), high("y2", "h").alias("y2"))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*CELL), CELL, "left_semi")


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*CELL), CELL, "left_anti")


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).unionByName(b.select(*CELL)).distinct()


def mask_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells on in exactly one mask: one grouping instead of an outer join."""
    side = lambda df, v: df.select(*CELL, F.lit(v).alias("side"))
    both = side(a, 0).unionByName(side(b, 1)).groupBy(*CELL).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return both.filter("lo = hi").select(*CELL)


def strip_border(cells: DataFrame, dims: DataFrame, px: int = 60) -> DataFrame:
    return cells.join(dims, "mask_id").filter(all_of(
        c("y") >= px, c("x") >= px, c("y") < c("h") - px, c("x") < c("w") - px)).select(*CELL)


# ---- runs ---------------------------------------------------------------------------------------
def to_runs(cells: DataFrame, axis: str = "x") -> DataFrame:
    """Maximal horizontal runs (mask_id, y, s, e); with axis ``y`` vertical ones (mask_id, x, s, e)."""
    line = "y" if axis == "x" else "x"
    island = c(axis) - F.row_number().over(Window.partitionBy("mask_id", line).orderBy(axis))
    return cells.select(*CELL).distinct().withColumn("_i", island).groupBy("mask_id", line, "_i").agg(
        F.min(axis).alias("s"), (F.max(axis) + 1).alias("e")).drop("_i")


def to_cells(runs: DataFrame, axis: str = "x") -> DataFrame:
    line = "y" if axis == "x" else "x"
    return runs.select("mask_id", line, F.explode(F.sequence("s", c("e") - 1)).alias(axis)).select(*CELL)


def _coalesce(runs: DataFrame) -> DataFrame:
    """Join runs of a row that overlap or touch."""
    order = Window.partitionBy(*ROW).orderBy("s")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_new", flag(c("s") > reach)).withColumn("_i", F.sum("_new").over(order)).groupBy(*ROW, "_i").agg(
        F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def dilate_runs(runs: DataFrame, dims: DataFrame, k: int, kh: int | None = None) -> DataFrame:
    """Dilation by a rectangle ``k`` wide and ``kh`` (else ``k``) high, both odd, within the page."""
    rx, ry = k // 2, (kh or k) // 2
    spread = runs.select("mask_id", F.explode(F.sequence(c("y") - ry, c("y") + ry)).alias("y"), (c("s") - rx).alias("s"), (c("e") + rx).alias("e"))
    inside = spread.join(dims, "mask_id").filter("y >= 0 AND y < h").select(
        *ROW, F.greatest(F.lit(0), "s").alias("s"), F.least("e", "w").alias("e"))
    # equal starts collapse before the shuffle: only the longest run of each matters
    return _coalesce(inside.groupBy(*ROW, "s").agg(F.max("e").alias("e")))


def complement_runs(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Runs of the off-cells, rows without ink included."""
    order = Window.partitionBy(*ROW).orderBy("s")
    page = dims.select("mask_id", "h", "w")
    edges = page.select("mask_id", F.explode(F.sequence(F.lit(0), c("h") - 1)).alias("y"), c("w").alias("s"), c("w").alias("e"))
    # by mask, as the next step joins by it; the window of a row then needs no shuffle of its own
    both = runs.select(*ROW, "s", "e").unionByName(edges).repartition("mask_id")
    return both.withColumn("_p", F.coalesce(F.lag("e").over(order), F.lit(0))).filter(
        c("s") > c("_p")).select(*ROW, c("_p").alias("s"), c("s").alias("e"))


def erode_runs(runs: DataFrame, dims: DataFrame, k: int, kh: int | None = None) -> DataFrame:
    """Erosion; the outside of the page counts as on, so it is the dilation of the off-cells."""
    return complement_runs(dilate_runs(complement_runs(runs, dims), dims, k, kh), dims)


def open_runs(runs, dims, k, kh=None):
    return dilate_runs(erode_runs(runs, dims, k, kh), dims, k, kh)


def close_runs(runs, dims, k, kh=None):
    return erode_runs(dilate_runs(runs, dims, k, kh), dims, k, kh)


def morph(cells: DataFrame, dims: DataFrame, how: str, k: int, kh: int | None = None) -> DataFrame:
    """``dilate``, ``erode``, ``open`` or ``close`` of a cell table by a rectangle."""
    step = {"dilate": dilate_runs, "erode": erode_runs, "open": open_runs, "close": close_runs}[how]
    return to_cells(step(to_runs(cells), dims, k, kh))


def _spread(runs: DataFrame, name: str, r: int | None = None) -> DataFrame:
    """Runs tagged ``name``; with ``r``, an overlay also has them widened by ``r`` on all sides, tagged ``name_band``."""
    return runs.select(
        "mask_id", "y", c("s").cast("bigint").alias("s"), c("e").cast("bigint").alias("e"), F.lit(name).alias("tag"),
        F.lit(r).cast("int").alias("reach"))


def overlay_runs(dims: DataFrame, tagged: DataFrame, names: list[str], label: str | None = None) -> DataFrame:
    """Stretches (mask_id, y, s, e) of page rows with one flag per run table: does it cover the stretch?

    Every run adds +1 where it starts and -1 where it ends. Changes at the same place are summed; a running sum along each
    page row then tells which tables cover a stretch, so intersections, unions and differences of any number of run tables
    cost one window, and no run ever meets another one. With ``label``, a column of the tagged runs that is set on disjoint
    ones only, a stretch has the label of the last of these to start.

    Runs are shuffled once, by mask, before they are widened: a band of 2r + 1 rows a run never leaves its task.
    """
    extra = [label] if label else []
    runs = tagged.repartition("mask_id").join(dims.select("mask_id", "h", "w"), "mask_id")
    if "reach" in tagged.columns:
        own = F.array(F.struct("y", "s", "e", "tag"))
        band = F.transform(F.sequence(F.greatest(F.lit(0), c("y") - c("reach")), F.least(c("h") - 1, c("y") + c("reach"))), lambda y: F.struct(
            y.alias("y"), (c("s") - c("reach")).alias("s"), (c("e") + c("reach")).alias("e"), F.concat("tag", F.lit("_band")).alias("tag")))
        on_page = c("y") + c("reach") >= 0, c("y") - c("reach") < c("h"), c("h") > 0
        runs = runs.select("mask_id", "h", "w", F.inline(F.when(all_of(*on_page), F.concat(own, band)).otherwise(own)), *extra)
    inside = runs.filter("y >= 0 AND y < h").select(
        *ROW, "tag", F.greatest(F.lit(0), "s").alias("s"), F.least("e", "w").alias("e"), *extra).filter("s < e")
    start = F.struct(c("s").alias("at"), F.lit(1).alias("d"), *[c(n) for n in extra])
    end = F.struct(c("e").alias("at"), F.lit(-1).alias("d"), *[F.lit(None).cast(tagged.schema[n].dataType).alias(n) for n in extra])
    steps = inside.select(*ROW, "tag", F.inline(F.array(start, end)))
    rows = steps.groupBy(*ROW, "at").agg(
        *[F.sum(F.when(c("tag") == n, c("d")).otherwise(0)).alias(n) for n in names], *[F.max(n).alias(n) for n in extra])
    order = Window.partitionBy(*ROW).orderBy("at")
    return rows.select(
        *ROW, c("at").alias("s"), F.lead("at").over(order).alias("e"), *[(F.sum(n).over(order) > 0).alias(n) for n in names],
        *[F.last(n, ignorenulls=True).over(order).alias(n) for n in extra]).filter("e IS NOT NULL")


def overlay_counts(dims: DataFrame, tagged: DataFrame, names: list[str], counts: dict[str, Column]) -> DataFrame:
    """Cells per mask that satisfy conditions over several run tables at once."""
    covered = overlay_runs(dims, tagged, names)
    sums = covered.groupBy("mask_id").agg(*[F.sum(F.when(cond, c("e") - c("s"))).alias(k) for k, cond in counts.items()])
    return dims.select("mask_id").join(sums, "mask_id", "left").select("mask_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in counts])


def within_band(a: DataFrame, b: DataFrame, dims: DataFrame, r: int) -> DataFrame:
    """Cells of ``a`` with a cell of ``b`` at most ``r`` rows and columns away, each once."""
    tagged = _spread(to_runs(a), "a").unionByName(_spread(to_runs(b), "b", r))
    return to_cells(overlay_runs(dims, tagged, ["a", "b_band"]).filter(c("a") & c("b_band")))


def missing_extra_cells(ref: DataFrame, stu: DataFrame, dims: DataFrame, r: int) -> DataFrame:
    """Reference cells without a student cell nearby (``missing``) and the converse (``extra``), each once."""
    tagged = _spread(to_runs(ref), "ref", r).unionByName(_spread(to_runs(stu), "stu", r))
    stretches = overlay_runs(dims, tagged, ["ref", "stu", "ref_band", "stu_band"])
    kinds = F.array_compact(F.array(
        F.when(c("ref") & ~c("stu_band"), "missing"), F.when(c("stu") & ~c("ref_band"), "extra")))
    odd = stretches.select(*ROW, "s", "e", F.explode(kinds).alias("kind"))
    return odd.select("mask_id", "y", F.explode(F.sequence("s", c("e") - 1)).alias("x"), "kind").select(*CELL, "kind")


def match_metrics(ref: DataFrame, stu: DataFrame, diff: DataFrame, dims: DataFrame, r: int = 10) -> DataFrame:
    """Similarity, coverage, missing and extra shares of a student mask against its reference."""
    tagged = _spread(to_runs(ref), "ref", r).unionByName(_spread(to_runs(stu), "stu", r)).unionByName(_spread(to_runs(diff), "diff"))
    a, b = c("ref"), c("stu")
    n = overlay_counts(dims, tagged, ["ref", "stu", "diff", "ref_band", "stu_band"], {
        "union_px": a | b, "ref_px": a, "stu_px": b, "diff_px": c("diff"),
        "missing_px": a & ~c("stu_band"), "extra_px": b & ~c("ref_band")})
    one = lambda v: F.greatest(c(v), F.lit(1))
    return n.select(
        "mask_id", (1.0 - c("diff_px") / one("union_px")).alias("similarity"),
        ((c("stu_px") - c("extra_px")) / one("stu_px")).alias("coverage"),
        (c("missing_px") / one("ref_px")).alias("missing_ratio"), (c("extra_px") / one("stu_px")).alias("extra_ratio"))


def tolerance_metrics(ref: DataFrame, stu: DataFrame, dims: DataFrame, r: int = 6) -> DataFrame:
    """Completeness, correctness, band overlap and area balance of two masks within ``r`` cells."""
    tagged = _spread(to_runs(ref), "ref", r).unionByName(_spread(to_runs(stu), "stu", r))
    a, b, da, db = c("ref"), c("stu"), c("ref_band"), c("stu_band")
    n = overlay_counts(dims, tagged, ["ref", "stu", "ref_band", "stu_band"], {
        "ref_area": a, "stu_area": b, "found": a & db, "correct": b & da, "inter": da & db, "either": da | db})
    one = lambda v: F.greatest(c(v), F.lit(1))
    ratio = c("stu_area") / one("ref_area")
    return n.select(
        "mask_id", "ref_area", "stu_area", (c("found") / one("ref_area")).alias("completeness"),
        (c("correct") / one("stu_area")).alias("correctness"), (c("inter") / one("either")).alias("iou"), ratio.alias("area_ratio"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio, 1.0 / F.greatest(ratio, F.lit(1e-6)))).alias("area_balance"))


def long_runs(cells: DataFrame, k: Column | int, dims: DataFrame | None = None, kv: Column | int | None = None) -> DataFrame:
    """Cells in horizontal runs of at least ``k`` cells or vertical ones of at least ``kv`` (else ``k``). With ``dims``
    the lengths may be columns of it, one number per mask."""
    def long(axis, least):
        runs = to_runs(cells, axis)
        if dims is not None:
            least = least if isinstance(least, Column) else F.lit(least)
            runs = runs.join(dims.select("mask_id", least.alias("_k")), "mask_id")
            least = c("_k")
        return to_cells(runs.filter(c("e") - c("s") >= least), axis)

    return long("x", k).unionByName(long("y", k if kv is None else kv)).distinct()


def without_long_runs(cells: DataFrame, k: Column | int, dims: DataFrame | None = None) -> DataFrame:
    return mask_minus(cells, long_runs(cells, k, dims))


def hv_struct_ratio(cells: DataFrame, k: Column | int, dims: DataFrame | None = None, kv: Column | int | None = None) -> DataFrame:
    """Share of ink that lies in long axis-aligned runs."""
    total = cells.groupBy("mask_id").agg(F.count("*").alias("n"))
    hv = long_runs(cells, k, dims, kv).groupBy("mask_id").agg(F.count("*").alias("hv"))
    return total.join(hv, "mask_id", "left").select("mask_id", (F.coalesce("hv", F.lit(0)) / F.greatest("n", F.lit(1))).alias("hv_struct_ratio"))


# ---- measures -----------------------------------------------------------------------------------
def fill_metrics(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Ink share of the page, of its content box, and of its interior (a tenth off each side)."""
    page = cells.join(dims, "mask_id")
    mx, my = F.greatest(F.lit(4), (c("w") * 0.10).cast("int")), F.greatest(F.lit(4), (c("h") * 0.10).cast("int"))
    inner = all_of(c("x") >= mx, c("x") < c("w") - mx, c("y") >= my, c("y") < c("h") - my)
    s = page.groupBy("mask_id").agg(
        F.count("*").alias("px"), F.count_if(inner).alias("inner"),
        ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("box_area"))
    n = lambda v: F.coalesce(v, F.lit(0))
    area = F.greatest(c("w") * c("h"), F.lit(1))
    return dims.join(s, "mask_id", "left").select(
        "mask_id", (n("px") / area).alias("fill_ratio"), (n("px") / F.greatest(n("box_area"), F.lit(1))).alias("density"),
        (n("inner") / F.greatest(n("px"), F.lit(1))).alias("interior_share"))


def border_occupancy(cells: DataFrame, dims: DataFrame, band: int = 10) -> DataFrame:
    """Ink share of the four edge bands; a corner belongs to two of them and counts twice."""
    edges = [c("y") < band, c("y") >= c("h") - band, c("x") < band, c("x") >= c("w") - band]
    hits = sum((flag(e) for e in edges), F.lit(0))
    s = cells.join(dims, "mask_id").groupBy("mask_id").agg(F.sum(hits).alias("hits"))
    return dims.join(s, "mask_id", "left").select(
        "mask_id", (F.coalesce("hits", F.lit(0)) / (2 * band * (c("w") + c("h")))).alias("border_occ"))


def protect_cover(cells: DataFrame, boxes: DataFrame, dims: DataFrame, pad: int = 10, inside: bool = True) -> DataFrame:
    """Cells in any padded box of their mask (or in none), through the lookup cells both share."""
    zero = F.lit(0)
    padded = boxes.join(dims, "mask_id").select(
        "mask_id", F.greatest(zero, c("x1") - pad).alias("x1"), F.greatest(zero, c("y1") - pad).alias("y1"),
        F.least("w", c("x2") + pad).alias("x2"), F.least("h", c("y2") + pad).alias("y2"))
    near = box_cells(padded).select(c("mask_id").alias("_m"), "gx", "gy", "x1", "y1", "x2", "y2")
    held = all_of(c("mask_id") == c("_m"), F.floor(c("x") / 256) == c("gx"), F.floor(c("y") / 256) == c("gy"),
                  c("x") >= c("x1"), c("x") < c("x2"), c("y") >= c("y1"), c("y") < c("y2"))
    return cells.join(near, held, "left_semi" if inside else "left_anti")


def stray_ratio(cells: DataFrame, boxes: DataFrame, dims: DataFrame, pad: int = 10) -> DataFrame:
    """Ink share of the page outside every padded box."""
    s = protect_cover(cells, boxes, dims, pad, inside=False).groupBy("mask_id").agg(F.count("*").alias("n"))
    return dims.join(s, "mask_id", "left").select(
        "mask_id", (F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1), c("w") * c("h"))).alias("stray_ratio"))


def stroke_quantiles(values: DataFrame, least: int = 800) -> DataFrame:
    """Stroke-width quantiles and their ratios; null below ``least`` cells. Equal widths are counted
    before the shuffle, so the state of a mask is its distinct widths."""
    counted = values.groupBy("mask_id", "value").agg(F.count("*").alias("n"))
    q = counted.groupBy("mask_id").agg(
        F.sum("n").alias("cells"), F.percentile("value", [0.25, 0.50, 0.75, 0.90, 0.05, 0.95], c("n")).alias("q"))
    enough = c("cells") >= least
    at = lambda i: F.when(enough, c("q")[i])
    tiny = F.lit(1e-6)
    return q.select(
        "mask_id", at(0).alias("p25"), at(1).alias("p50"), at(2).alias("p75"), at(3).alias("p90"),
        (at(3) / F.greatest(at(1), tiny)).alias("r9050"), (at(2) / F.greatest(at(0), tiny)).alias("r7525"),
        (c("q")[5] - c("q")[4]).alias("contrast"))


def pick_binarization(df: DataFrame, target: float = 0.08) -> DataFrame:
    """Which of two candidate fills is closer to a plausible share of ink; the first wins ties."""
    def score(fill):
        off = F.abs(c(fill) - target)
        return F.when(c(fill).between(0.006, 0.30), 1.0 - off).otherwise(-off)
    return df.withColumn("choice", F.when(score("fill1") >= score("fill2"), 1).otherwise(2))


# ---- components ---------------------------------------------------------------------------------
def _label(runs: pd.DataFrame) -> pd.DataFrame:
    """Component of each run of some whole masks, sorted by mask, row and start: its label (where its
    first run starts, as y * 10000 + s), bounds and area."""
    y, s, e = (runs[k].to_numpy(np.int64) for k in ("y", "s", "e"))
    mask = runs["mask_id"].to_numpy()
    line = np.cumsum(np.r_[0, mask[1:] != mask[:-1]]) * (y.max() + 3) + y  # masks lie apart
    side = e.max() + 3
    # runs of the next row that touch [s - 1, e], found by position in the sorted order
    first = np.searchsorted(line * side + e, (line + 1) * side + s, side="left")
    last = np.searchsorted(line * side + s, (line + 1) * side + e, side="right")
    count = np.maximum(last - first, 0)
    n = len(runs)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    x1, x2, y2, area = np.full(n, side), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.minimum.at(x1, label, s)
    np.maximum.at(x2, label, e)
    np.maximum.at(y2, label, y)
    np.add.at(area, label, e - s)
    top = y[label]
    return runs.assign(label=top * 10000 + s[label], cx=x1[label], cy=top, w=(x2 - x1)[label],
                       h=y2[label] - top + 1, area=area[label])


def _label_masks(batches):
    """Label the masks of a sorted partition, many per batch; only an unfinished mask waits."""
    held = []
    for pdf in batches:
        if pdf.empty:
            continue
        done = (pdf["mask_id"] != pdf["mask_id"].iloc[-1]).to_numpy()
        if done.any() or (held and held[-1]["mask_id"].iloc[-1] != pdf["mask_id"].iloc[0]):
            yield _label(pd.concat([*held, pdf[done]], ignore_index=True))
            held = []
        held.append(pdf[~done])
    if held:
        yield _label(pd.concat(held, ignore_index=True))


def label_runs(runs: DataFrame) -> DataFrame:
    """Every run with its 8-connected component: label, bounds (cx, cy, w, h) and area.

    One shuffle by mask; filters on the component's shape then need no further join. A task holds
    one batch and one mask of at most 2.4 million runs (a page of 2200 × 2200 pixels).
    """
    whole = runs.select(c("mask_id").cast("bigint").alias("mask_id"), *[c(n).cast("int").alias(n) for n in ("y", "s", "e")])
    return whole.repartition("mask_id").sortWithinPartitions("mask_id", "y", "s").mapInPandas(
        _label_masks, "mask_id bigint, y int, s int, e int, label bigint, cx int, cy int, w int, h int, area bigint")


def component_stats(labelled: DataFrame) -> DataFrame:
    """One row per component: the run that starts it."""
    return labelled.filter(c("label") == c("y") * 10000 + c("s")).select(
        "mask_id", "label", c("cx").alias("x"), c("cy").alias("y"), "w", "h", "area")


def connected_components(cells: DataFrame, least: int = 1) -> DataFrame:
    return component_stats(label_runs(to_runs(cells))).filter(c("area") >= least)


def drop_small_runs(runs: DataFrame, least: Column | int, dims: DataFrame | None = None) -> DataFrame:
    """Runs of the components with at least ``least`` cells (may use page_h and page_w of ``dims``)."""
    labelled = label_runs(runs)
    if dims is not None:
        labelled = labelled.join(dims.select("mask_id", c("h").alias("page_h"), c("w").alias("page_w")), "mask_id")
    return labelled.filter(c("area") >= least).select(*ROW, "s", "e")


def remove_small_components(cells: DataFrame, least: int) -> DataFrame:
    return to_cells(drop_small_runs(to_runs(cells), least))


# ---- composites ---------------------------------------------------------------------------------
def support_region(ref: DataFrame, dims: DataFrame, sizes=(9, 31, 21), least: int = 400) -> DataFrame:
    """Where ink is expected, as runs: reference closed, widened, closed again, large parts only."""
    k1, k2, k3 = sizes
    grown = close_runs(dilate_runs(close_runs(to_runs(ref), dims, k1), dims, k2), dims, k3)
    size = F.greatest(F.lit(least), (c("page_h") * c("page_w") * 0.001).cast("int"))
    return drop_small_runs(grown, size, dims)


def noise_partition(ref: DataFrame, stu: DataFrame, dims: DataFrame, sizes=(9, 31, 21), band: int = 11, least: int = 400) -> DataFrame:
    """Unexpected student ink per mask: pixels and components of lines, speckles and blobs."""
    support = support_region(ref, dims, sizes, least)
    tagged = _spread(to_runs(stu), "stu").unionByName(_spread(to_runs(ref), "ref", band // 2)).unionByName(_spread(support, "support"))
    odd = overlay_runs(dims, tagged, ["stu", "ref_band", "support"]).filter(c("stu") & ~(c("support") & c("ref_band")))
    # both sorts of unexpected runs are labelled in one pass, as two masks
    sorts = odd.select((c("mask_id") * 2 + flag(c("support"))).alias("mask_id"), "y", "s", "e")
    parts = component_stats(label_runs(_coalesce(sorts))).filter(c("area") >= 3).withColumn(
        "inside", c("mask_id") % 2 == 1).withColumn("mask_id", F.floor(c("mask_id") / 2))
    fill = c("area") / F.greatest(c("w") * c("h"), F.lit(1))
    aspect = F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1))
    kind = (
        F.when(~c("inside"), F.when(c("area") < 4, None).when(c("area") <= 16, "out_speckle").otherwise("out_line"))
        .when(c("area") <= 18, "speckle").when(all_of(c("area") >= 20, fill >= 0.28, aspect <= 4.5), "blob")
        .when(all_of(c("area").between(12, 220), aspect <= 8.0, fill >= 0.10), "blob"))
    noise = parts.select("mask_id", "area", kind.alias("kind")).filter("kind IS NOT NULL")
    px = lambda k: F.coalesce(F.sum(F.when(c("kind") == k, c("area"))), F.lit(0)).alias(f"{k}_px")
    cnt = lambda k, n: F.count_if((c("kind") == k) & (c("area") >= n)).alias(f"{k}_cnt")
    s = noise.groupBy("mask_id").agg(
        px("out_line"), px("out_speckle"), px("blob"), px("speckle"), F.sum("area").alias("dirty_px"),
        cnt("out_line", 6), cnt("out_speckle", 1), cnt("blob", 10), cnt("speckle", 1))
    line_px = ref.groupBy("mask_id").agg(F.countDistinct("y", "x").alias("ref_line_px"))
    out = dims.select("mask_id").join(line_px, "mask_id", "left").join(s, "mask_id", "left")
    return out.select("mask_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in out.columns[1:]])


def structure_cells(ink: DataFrame, hatch: DataFrame, dims: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Ink without text-like, dashed-like and hatch cells, cleaned up; and pixel counts per class."""
    runs = to_runs(ink)
    fill = c("area") / F.greatest(c("w") * c("h"), F.lit(1))
    long, short = F.greatest("w", "h"), F.greatest(F.least("w", "h"), F.lit(1))
    text = label_runs(runs).filter(all_of(c("area").between(12, 260), c("w") <= 35, c("h") <= 35, fill.between(0.08, 0.75)))
    dashed = label_runs(erode_runs(runs, dims, 3)).filter(all_of(c("area").between(6, 160), long <= 30, long / short >= 1.9))
    classes = to_cells(text).withColumn("kind", F.lit("text")).unionByName(
        to_cells(dashed).withColumn("kind", F.lit("dashed"))).unionByName(hatch.select(*CELL, F.lit("hatch").alias("kind")))
    classes = cut_lineage(classes)  # read twice: removed here, counted below
    left = to_runs(mask_minus(ink, classes))
    structure = cut_lineage(to_cells(drop_small_runs(close_runs(open_runs(left, dims, 3), dims, 3), least)))
    tagged = classes.unionByName(structure.withColumn("kind", F.lit("structure")))
    px = tagged.groupBy("mask_id").agg(*[F.count_if(c("kind") == k).alias(f"{k}_px") for k in ("text", "dashed", "hatch", "structure")])
    counts = dims.select("mask_id").join(px, "mask_id", "left")
    return structure, counts.select("mask_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts.columns[1:]])


def hatch_region(lines: DataFrame, dims: DataFrame, sizes=(9, 13, 5, 9), least: int = 120, density: float = 0.018, final: int = 90) -> tuple[DataFrame, DataFrame]:
    """Region covered by hatch lines, and the number of dense clusters it grew from."""
    k1, k2, k3, k4 = sizes
    hatch = to_runs(lines)
    grown = label_runs(dilate_runs(close_runs(dilate_runs(hatch, dims, k1), dims, k2), dims, k3)).filter(c("area") >= least)
    grown = cut_lineage(grown.select(*ROW, "s", "e", "label", "area"))  # read twice: measured here, kept below
    none = F.lit(None).cast("bigint").alias("label")
    place = [c(n).cast("bigint").alias(n) for n in ("s", "e")]
    tagged = grown.select(*ROW, *place, F.lit("grown").alias("tag"), "label").unionByName(
        hatch.select(*ROW, *place, F.lit("ink").alias("tag"), none))
    ink = overlay_runs(dims, tagged, ["grown", "ink"], label="label").filter(c("grown") & c("ink")).groupBy("mask_id", "label").agg(
        F.sum(c("e") - c("s")).alias("px"))
    dense = cut_lineage(grown.join(ink, ["mask_id", "label"]).filter(c("px") / c("area") >= density))
    clusters = dims.select("mask_id").join(dense.groupBy("mask_id").agg(F.countDistinct("label").alias("n")), "mask_id", "left").select(
        "mask_id", F.coalesce("n", F.lit(0)).alias("cluster_count"))
    region = drop_small_runs(close_runs(dense.select(*ROW, "s", "e"), dims, k4), final)
    return to_cells(region), clusters
