"""The composite view finder: boxes of the views above each candidate cut of a page.

A mask is the part of a drawing above one cut, with pages (mask_id, drawing_id, ycut, w, h) where h is the cut. Runs are
found once per drawing, and the cuts take theirs from them; cells are shuffled once, before there are cuts. A cleaned
mask is one row with its packed runs, horizontal ones in one table and vertical ones in another, both stored in buckets
of mask_id. Every later step works on boxes, a few per mask, that are sent to the buckets: column and row counts,
extents, long runs are grouped where the runs lie. Splits and refinements then are prefix sums over such a profile of at
most 2200 positions.

A box is named by the struct (mask_id, x1, y1, x2, y2), so equal boxes are one and no numbers have to be dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkgrade.functions.boxes import SIDES, box, box_area
from inkgrade.functions.cols import all_of, top_rows
from inkgrade.operators import profiles as P
from inkgrade.operators.boxes import best_fallback, looks_like_projection, nms
from inkgrade.operators.cells import (
    close_runs, drop_small_runs, label_runs, long_runs, mask_minus, to_cells, to_runs,
)
from inkgrade.operators.components import group_by_xgap
from inkgrade.operators.lineage import cut_lineage, stored_by

c = F.col
ID = P.ID
CUTS = 4096  # cuts lie below this row; mask_id = drawing_id * CUTS + ycut
PARTS = 1024  # boxes of one mask that are split at once, at most
LINE = 121  # cells of a border line


def _part(share: float, of: str | Column, least: int = 0) -> Column:
    """Whole share of a length, at least ``least``."""
    of = c(of) if isinstance(of, str) else of
    return F.greatest(F.lit(least), (of * share).cast("int"))


def _named(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn(ID, F.struct("mask_id", *[c(s).cast("int").alias(s) for s in SIDES]))


def _distinct(boxes: DataFrame) -> DataFrame:
    """Equal boxes of a mask once, at the first of their places."""
    return boxes.groupBy("mask_id", *SIDES).agg(F.min(c("order").cast("array<bigint>")).alias("order"))


# ---- masks --------------------------------------------------------------------------------------
def mask_pages(cuts: DataFrame, dims: DataFrame) -> DataFrame:
    """One page per drawing and cut: (mask_id, drawing_id, ycut, w, h) and the least sizes of a view."""
    pages = cuts.select("drawing_id", "ycut").distinct().filter("ycut > 0").join(dims.select("drawing_id", "w").distinct(), "drawing_id")
    return pages.select(
        (c("drawing_id") * CUTS + c("ycut")).alias("mask_id"), "drawing_id", "ycut", "w", c("ycut").alias("h"),
        _part(0.05, "w", 16).alias("min_w"), _part(0.08, "ycut", 16).alias("min_h"),
        _part(0.0018, c("w") * c("ycut"), 120).alias("min_area"))


def drawing_runs(cells: DataFrame) -> DataFrame:
    """Packed horizontal runs (drawing_id, runs) of whole drawings; one shuffle of the cells."""
    top = 1 << PLACE  # beyond any page
    own = cells.filter(all_of(c("y").between(0, top - 1), c("x").between(0, top - 2))).select(
        c("drawing_id").alias("mask_id"), "y", "x").repartition("mask_id")
    return packed(to_runs(own)).withColumnRenamed("mask_id", "drawing_id")


def clean_runs(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Horizontal runs of each mask without border lines, margins and specks, small gaps closed, from ``drawing_runs``.

    Border lines are runs of ``LINE`` cells within the bands along the edges, first the horizontal bands, then the
    vertical ones. Only runs that reach into the vertical bands, or bands as high as a line, are taken apart into cells.
    """
    band = (F.least("w", "h") * 0.06).cast("int")
    size = pages.select("mask_id", "w", "h")

    def without(runs, among):
        """Runs without the cells of long runs among some of their cells."""
        cells = to_cells(runs)
        sized = cells.join(size, "mask_id").filter(among).select("mask_id", "y", "x")
        return to_runs(mask_minus(cells, long_runs(sized, LINE))).join(size, "mask_id").select("mask_id", "w", "h", "y", "s", "e")

    cut = drawings.join(pages.select("mask_id", "drawing_id", "w", "h"), "drawing_id")
    runs = cut.select("mask_id", "w", "h", F.explode("runs").alias("_v")).select("mask_id", "w", "h", *_unpacked("y")).filter(
        "y >= 0 AND y < h").withColumns({"s": F.greatest(F.lit(0), "s"), "e": F.least("e", "w")}).filter("s < e")
    edge = (c("y") < band) | (c("y") >= c("h") - band)
    high = edge & (band >= LINE)
    runs = runs.filter(~high & ~(edge & (c("e") - c("s") >= LINE))).unionByName(without(cut_lineage(runs.filter(high)), F.lit(True)))
    inside = (c("s") >= band) & (c("e") <= c("w") - band)
    runs = runs.filter(inside).unionByName(without(cut_lineage(runs.filter(~inside)), (c("x") < band) | (c("x") >= c("w") - band)))
    mx = (c("w") * 0.03).cast("int")
    inner = runs.filter(c("y") >= (c("h") * 0.02).cast("int")).select(
        "mask_id", "y", F.greatest("s", mx).cast("int").alias("s"), F.least("e", c("w") - mx).cast("int").alias("e")).filter("s < e")
    least = F.greatest(F.lit(18), (c("page_h") * c("page_w") * 0.00008).cast("int"))
    dims = pages.select("mask_id", "h", "w")
    # by mask once, so that neither closing nor packing shuffles again
    return close_runs(drop_small_runs(inner, least, dims).repartition("mask_id"), dims, 3)


# ---- packed runs --------------------------------------------------------------------------------
# one run of a mask as a number: line, start and end, each from 0 and below 2 ** PLACE
PLACE = 21


def packed(runs: DataFrame, line: str = "y") -> DataFrame:
    """One row (mask_id, runs) per mask: its runs in order, as numbers."""
    place = lambda n, by: F.shiftleft(c(n).cast("bigint"), by)
    return runs.groupBy("mask_id").agg(
        F.sort_array(F.collect_list(place(line, 2 * PLACE) + place("s", PLACE) + place("e", 0))).alias("runs"))


def _unpacked(line: str) -> list[Column]:
    """Line, start and end of the number ``_v``."""
    low = (1 << PLACE) - 1
    part = lambda by: F.shiftright("_v", by).bitwiseAND(F.lit(low).cast("bigint"))
    return [F.shiftright("_v", 2 * PLACE).cast("int").alias(line), part(PLACE).cast("int").alias("s"), part(0).cast("int").alias("e")]


def unpacked(ink: DataFrame, line: str = "y") -> DataFrame:
    return ink.select("mask_id", F.explode("runs").alias("_v")).select("mask_id", *_unpacked(line))


# ---- measures of boxes --------------------------------------------------------------------------
def _clipped(ink: DataFrame, boxes: DataFrame, axis: str, carry: tuple = (), whole: bool = False) -> DataFrame:
    """Per box the runs of its lines (columns with axis ``x``, else rows), cut at the box; with ``whole`` each line has a
    row of nulls too. Boxes keep their name, mask and the columns in ``carry``; ``pos`` counts lines from the first side.
    """
    low, high, near, far = ("x1", "x2", "y1", "y2") if axis == "x" else ("y1", "y2", "x1", "x2")
    keep = [ID, "mask_id", *carry]
    lines = boxes.filter(f"{high} > {low}").select(
        *keep, c(low).alias("_low"), c(high).alias("_high"), c(near).alias("_near"), c(far).alias("_far"))
    if whole:  # a run that ends where it starts, at 0, stands for its line
        blank = F.transform(F.sequence(c("_low"), c("_high") - 1), lambda at: F.shiftleft(at.cast("bigint"), 2 * PLACE))
        met = lines.join(ink, "mask_id", "left").withColumn("_v", F.explode(F.concat(blank, F.coalesce("runs", F.array().cast("array<bigint>")))))
    else:
        met = lines.join(ink, "mask_id").withColumn("_v", F.explode("runs"))
    met = met.select(*keep, "_low", "_high", "_near", "_far", *_unpacked(axis))
    s, e = F.greatest("s", "_near"), F.least("e", "_far")
    on = (c("e") > c("s")) & (e > s)
    there = (c(axis) >= c("_low")) & (c(axis) < c("_high")) & (on | (c("e") == 0) if whole else on)
    return met.filter(there).select(*keep, axis, (c(axis) - c("_low")).alias("pos"), F.when(on, s).alias("s"), F.when(on, e).alias("e"))


def box_profile(ink: DataFrame, boxes: DataFrame, axis: str, carry: tuple = ()) -> DataFrame:
    """Per box and line: cells (val), and where they begin and end across the line (lo, hi; null where there are none)."""
    return _clipped(ink, boxes, axis, carry, whole=True).groupBy(c("mask_id").alias(P.GROUP), ID, "pos", *carry).agg(
        F.coalesce(F.sum(c("e") - c("s")), F.lit(0)).cast("double").alias("val"), F.min("s").alias("lo"), F.max("e").alias("hi"))


def _crossed(rows: DataFrame, cols: DataFrame, boxes: DataFrame, carry: tuple) -> DataFrame:
    """Per box its horizontal runs and its vertical ones (``steep``), cut at the box, in one pass over the mask."""
    keep = [ID, "mask_id", *carry]
    sided = lambda ink, steep: F.transform(F.coalesce(ink, F.array().cast("array<bigint>")), lambda v: F.struct(
        v.alias("_v"), F.lit(steep).alias("steep")))
    met = boxes.select(*keep, *SIDES).join(rows.withColumnRenamed("runs", "_rows"), "mask_id", "left").join(
        cols.withColumnRenamed("runs", "_cols"), "mask_id", "left").select(
        *keep, *SIDES, F.inline(F.concat(sided(c("_rows"), False), sided(c("_cols"), True)))).select(*keep, *SIDES, "steep", *_unpacked("line"))
    way = lambda a, b: F.when(c("steep"), c(a)).otherwise(c(b))
    s, e = F.greatest(c("s"), way("y1", "x1")), F.least(c("e"), way("y2", "x2"))
    return met.filter((c("line") >= way("x1", "y1")) & (c("line") < way("x2", "y2")) & (e > s)).select(
        *keep, "steep", "line", s.alias("s"), e.alias("e"))


def _stroke_cells(strokes: DataFrame, *keep: str) -> DataFrame:
    """Cells (y, x) of runs that are horizontal or ``steep``."""
    cells = strokes.select(*keep, "steep", "line", F.explode(F.sequence(c("s"), c("e") - 1)).alias("_at"))
    return cells.select(*keep, F.when(c("steep"), c("_at")).otherwise(c("line")).alias("y"), F.when(c("steep"), c("line")).otherwise(c("_at")).alias("x"))


def with_features(boxes: DataFrame, rows: DataFrame, cols: DataFrame, segments: DataFrame) -> DataFrame:
    """Boxes with bw, bh, area, hvs (share of cells in long runs), and hv_len, diag_len, hvl of the segments inside."""
    b = _named(boxes).withColumns({"bw": c("x2") - c("x1"), "bh": c("y2") - c("y1")})
    kernel = lambda of: F.least(F.lit(31), _part(0.12, of, 9))
    area = _clipped(rows, b, "y").groupBy("mask_id", ID).agg(F.sum(c("e") - c("s")).alias("area")).drop("mask_id")
    strokes = _crossed(rows, cols, b.withColumns({"kx": kernel("bw"), "ky": kernel("bh")}), ("kx", "ky"))
    long = strokes.filter(c("e") - c("s") >= F.when(c("steep"), c("ky")).otherwise(c("kx")))
    hv = _stroke_cells(long, "mask_id", ID).distinct().groupBy("mask_id", ID).agg(F.count("*").alias("hv")).drop("mask_id")
    s = segments.select("drawing_id", *[c(n).alias("s_" + n) for n in SIDES])
    inside = all_of(
        F.least("s_x1", "s_x2") >= c("x1"), F.greatest("s_x1", "s_x2") < c("x2"),
        F.least("s_y1", "s_y2") >= c("y1"), F.greatest("s_y1", "s_y2") < c("y2"))
    dx, dy = c("s_x2") - c("s_x1"), c("s_y2") - c("s_y1")
    length, angle = F.hypot(dx, dy), F.degrees(F.atan2(F.abs(dy), F.abs(dx)))
    lines = b.join(s, "drawing_id").filter(inside).filter(length >= _part(0.18, F.least("bw", "bh"), 12)).groupBy(ID).agg(
        F.sum(F.when((angle <= 12) | (angle >= 78), length).otherwise(0.0)).alias("hv_len"),
        F.sum(F.when(angle.between(18, 72), length).otherwise(0.0)).alias("diag_len"))
    n = lambda v: F.coalesce(c(v), F.lit(0))
    known = b.join(area, ID, "left").join(hv, ID, "left").join(lines, ID, "left").withColumns(
        {"area": n("area"), "hv_len": n("hv_len").cast("double"), "diag_len": n("diag_len").cast("double")})
    return known.withColumns({
        "hvs": n("hv") / F.greatest(F.lit(1), "area"),
        "hvl": c("hv_len") / F.greatest(F.lit(1e-6), c("hv_len") + c("diag_len"))}).drop("hv", ID)


def tight_boxes(spans: DataFrame, cols: DataFrame) -> DataFrame:
    """Bounds of the cells in spans [a, b) of columns; spans without cells are left out."""
    keep = spans.columns
    met = spans.join(cols, "mask_id").select(*keep, F.explode("runs").alias("_v")).select(*keep, *_unpacked("x"))
    return met.filter("x >= a AND x < b").groupBy(*keep).agg(
        F.min("x").alias("x1"), F.min("s").alias("y1"), (F.max("x") + 1).alias("x2"), F.max("e").alias("y2"))


# ---- steps --------------------------------------------------------------------------------------
def first_boxes(cols: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes (mask_id, order, sides) of the active column runs of each mask, split at their valleys.

    A wide run that stays whole is split once more by a softer rule.
    """
    tall = lambda df, a, b: df.withColumns({
        "x1": a, "x2": b, "y1": F.lit(0), "y2": F.lit(1 << PLACE)})
    every = tall(pages.select("mask_id", "w").withColumn(ID, F.struct("mask_id")), F.lit(0), c("w"))
    profile = box_profile(cols, every, "x", ("w",)).drop("lo", "hi")
    runs = P.active_runs(profile, _part(0.02, "w", 9), _part(0.014, "w", 5), _part(0.040, "w", 12)).select(
        c(P.GROUP).alias("mask_id"), "s", "e")
    runs = cut_lineage(runs.join(pages.select("mask_id", "w"), "mask_id").withColumn(ID, F.struct("mask_id", "s", "e")))

    def split(runs, *rule):
        local = box_profile(cols, tall(runs, c("s"), c("e")), "x", ("w",)).drop("lo", "hi")
        return P.split_by_valleys(local, *rule)

    spans = cut_lineage(split(runs, _part(0.05, "w", 18), 0.45, _part(0.012, "w", 9)))
    single = spans.groupBy(ID).agg(F.count("*").alias("n"))
    again = cut_lineage(single.join(runs.select(ID, "w"), ID).filter(
        (c("n") == 1) & (c(f"{ID}.e") - c(f"{ID}.s") >= _part(0.22, "w"))).select(ID))
    softer = split(runs.join(again, ID, "left_semi"), _part(0.035, "w", 12), 0.68, _part(0.006, "w", 5))
    spans = spans.join(again, ID, "left_anti").unionByName(softer)
    shifted = spans.select(c(f"{ID}.mask_id").alias("mask_id"), (c(f"{ID}.s") + c("a")).alias("a"), (c(f"{ID}.s") + c("b")).alias("b"))
    return tight_boxes(shifted, cols).withColumn("order", F.array("a")).drop("a", "b")


def unlike_boxes(boxes: DataFrame, iou_thr: float) -> DataFrame:
    """Suppression within each mask, first in order on equal areas. The few boxes of a mask are numbered by order."""
    seq = F.row_number().over(Window.partitionBy("mask_id").orderBy("order", *SIDES))
    return nms(boxes.withColumn("seq", seq).select("mask_id", "seq", *SIDES), iou_thr, ["mask_id"])


def split_rows(boxes: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """High boxes split at their emptiest rows into parts with cells; a box without two such parts stays."""
    b = _named(boxes.join(pages.select("mask_id", "h"), "mask_id"))
    high = b.filter(c("y2") - c("y1") >= _part(0.22, "h"))
    profile = box_profile(rows, high, "y", ("h",))
    width = c(f"{ID}.x2") - c(f"{ID}.x1")
    spans = P.split_by_valleys(
        profile, _part(0.07, "h", 16), 0.20, _part(0.015, "h", 5), occupancy=True, floor=0.01 * width)
    spans = cut_lineage(spans.withColumnRenamed(P.GROUP, "mask_id"))
    y1, sides = c(f"{ID}.y1"), {n: c(f"{ID}.{n}") for n in ("x1", "x2")}
    bands = spans.withColumns({**sides, "y1": y1 + c("a"), "y2": y1 + c("b")})
    parts = _clipped(rows, bands, "y", ("a", "b")).withColumn("pos", c("pos") + c("a")).groupBy("mask_id", ID, "a", "b").agg(
        F.min("s").alias("n_x1"), F.max("e").alias("n_x2"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    many = parts.select(ID, c("a").alias("at"), c("n_x1").alias("x1"), (y1 + c("first")).alias("y1"), c("n_x2").alias("x2"),
                        (y1 + c("last") + 1).alias("y2"), F.count("*").over(Window.partitionBy(ID)).alias("n")).filter("n >= 2")
    return _replaced(b, many)


def _replaced(boxes: DataFrame, parts: DataFrame) -> DataFrame:
    """Boxes (named) with those that have ``parts`` (name, at, sides) replaced by them, in order."""
    kept = boxes.join(parts.select(ID).distinct(), ID, "left_anti").select("mask_id", F.concat("order", F.array(F.lit(0))).alias("order"), *SIDES)
    new = boxes.select(ID, "mask_id", "order").join(parts.select(ID, "at", *SIDES), ID).select(
        "mask_id", F.concat("order", F.array("at")).alias("order"), *SIDES)
    return kept.unionByName(new)


def anchor_groups(boxes: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Spans (name, a, b) of the groups of strong strokes in each box (name, part_no, sides), at least two per box.

    Strokes are long runs in the upper part of the box, without the longest horizontal ones; their components are
    grouped where the gap between neighbours is wide.
    """
    b = boxes.withColumns({"bw": c("x2") - c("x1"), "bh": c("y2") - c("y1")}).filter("bh >= 20")
    b = b.withColumn("scan", F.greatest(F.lit(20), (c("bh") * 0.92).cast("int")))
    scan = b.withColumn("y2", F.least("y2", c("y1") + c("scan")))
    facts = b.select(ID, "part_no", "bw", "bh", "scan", c("x1").alias("left"), c("y1").alias("top"))
    size = c("e") - c("s")
    placed = scan.withColumns({"left": c("x1"), "top": c("y1")})
    strokes = _crossed(rows, cols, placed, ("part_no", "bw", "scan", "left", "top"))
    strokes = strokes.filter(size >= F.when(c("steep"), _part(0.18, "scan", 9)).otherwise(_part(0.10, "bw", 9))).withColumn(
        "long", ~c("steep") & (size >= _part(0.24, "bw", 15)))
    anchors = _stroke_cells(strokes, "mask_id", "part_no", "left", "top", "long").groupBy("mask_id", "part_no", "left", "top", "y", "x").agg(
        F.max("long").alias("long")).filter("NOT long").select(
        c("part_no").alias("mask_id"), (c("y") - c("top")).cast("int").alias("y"), (c("x") - c("left")).cast("int").alias("x"))
    anchors = anchors.repartition("mask_id")
    dims = facts.select(c("part_no").alias("mask_id"), c("scan").alias("h"), c("bw").alias("w"))
    closed = label_runs(close_runs(to_runs(anchors), dims, 3))
    parts = closed.groupBy("mask_id", "label").agg(*[F.first(n).alias(n) for n in ("cx", "w", "h", "area")]).join(
        facts.select(c("part_no").alias("mask_id"), "bw", "bh"), "mask_id")
    pixels = c("bw") * c("bh")
    least = F.greatest(F.lit(10), (pixels * 0.0006).cast("int"))
    bar = (c("w") >= _part(0.45, "bw")) & (c("h") <= _part(0.16, "bh"))
    strong = parts.filter(all_of(
        c("area") >= F.greatest(F.lit(10), (pixels * 0.0005).cast("int")), ~bar, c("area") >= least,
        c("w") >= _part(0.015, "bw", 3), (c("h") >= _part(0.10, "bh", 8)) | (c("area") >= 2 * least)))
    groups = group_by_xgap(strong.select(
        c("mask_id").alias("drawing_id"), c("cx").alias("x"), "w", c("label").alias("seq"), _part(0.06, "bw", 8).alias("gap")))
    some = groups.withColumn("n", F.count("*").over(Window.partitionBy("drawing_id"))).filter("n >= 2")
    return some.join(facts.select(c("part_no").alias("drawing_id"), ID, "left"), "drawing_id").select(
        ID, (c("left") + c("x1")).cast("int").alias("a"), (c("left") + c("x2")).cast("int").alias("b"))


def split_columns(boxes: DataFrame, rows: DataFrame, cols: DataFrame, pages: DataFrame) -> DataFrame:
    """Wide boxes split between groups of strokes or, where there is one group, at their emptiest columns."""
    number = F.row_number().over(Window.partitionBy("mask_id").orderBy("order", *SIDES))
    b = cut_lineage(_named(boxes.join(pages.select("mask_id", "w"), "mask_id")).withColumn("part_no", c("mask_id") * PARTS + number))
    least = _part(0.040, "w", 14)
    wide = b.filter((c("x2") - c("x1") >= _part(0.16, "w")) & (c("x2") - c("x1") > 2 * least))
    named = wide.select(ID, "mask_id", "w")

    def parts(spans: DataFrame) -> DataFrame:
        return tight_boxes(spans.join(named, ID).select(ID, "mask_id", "w", "a", "b"), cols)

    counted = lambda df, n: df.withColumn("n", F.count("*").over(Window.partitionBy(ID))).filter(c("n") >= n).select(
        ID, c("a").alias("at"), *SIDES)
    groups = cut_lineage(counted(parts(anchor_groups(wide, rows, cols)).filter(c("x2") - c("x1") >= least), 2))
    left = wide.join(groups.select(ID).distinct(), ID, "left_anti")
    bh = c("y2") - c("y1")
    scan = F.greatest(F.lit(20), (bh * 0.88).cast("int"))
    profile = box_profile(cols, left.withColumns({"scan": F.least(bh, scan), "y2": F.least("y2", c("y1") + scan)}), "x", ("w", "scan"))
    spans = P.split_by_valleys(profile, least, 0.20, _part(0.008, "w", 5), occupancy=True, floor=0.01 * c("scan")).drop(P.GROUP)
    several = cut_lineage(spans).withColumn("n", F.count("*").over(Window.partitionBy(ID))).filter("n >= 2")
    x1 = c(f"{ID}.x1")
    hollow = counted(parts(several.select(ID, (x1 + c("a")).alias("a"), (x1 + c("b")).alias("b"))), 1)
    return _replaced(b, groups.unionByName(hollow))


def refine(boxes: DataFrame, rows: DataFrame, cols: DataFrame, pages: DataFrame, pad: float, occ: float) -> DataFrame:
    """Boxes grown or shrunk to where the smoothed occupancy around them reaches ``occ``, with a margin of 4.

    Where no row or no column does, the bounds of the cells; a box with nothing around it stays.
    """
    b = _named(boxes.join(pages.select("mask_id", "w", "h"), "mask_id"))
    xpad, ypad = _part(pad, "w", 10), _part(pad, "h", 10)
    around = b.select(
        ID, "mask_id", F.greatest(F.lit(0), c("x1") - xpad).alias("x1"), F.greatest(F.lit(0), c("y1") - ypad).alias("y1"),
        F.least("w", c("x2") + xpad).alias("x2"), F.least("h", c("y2") + ypad).alias("y2")).dropDuplicates([ID])

    def ends(runs, axis):
        low, high, near, far = ("x1", "x2", "y1", "y2") if axis == "x" else ("y1", "y2", "x1", "x2")
        size = around.withColumns({"low": c(low), "len": c(high) - c(low), "depth": c(far) - c(near)})
        smooth = P.moving_average(box_profile(runs, size, axis, ("low", "len", "depth")).drop("lo", "hi"), _part(0.05, "len", 5))
        at = c("low") + c("pos")
        full, some = F.when(c("smooth") / c("depth") >= occ, at), F.when(c("val") > 0, at)
        return smooth.groupBy(P.GROUP, ID).agg(*[f(v).alias(f"{axis}_{n}") for n, f, v in (
            ("first", F.min, full), ("last", F.max, full), ("low", F.min, some), ("high", F.max, some))]).drop(P.GROUP)

    m = b.join(ends(cols, "x"), ID, "left").join(ends(rows, "y"), ID, "left")
    hit, ink = c("x_first").isNotNull() & c("y_first").isNotNull(), c("x_low").isNotNull()

    def side(name, axis, grown, tight):
        return F.when(hit, grown).when(ink, tight).otherwise(c(name)).cast("int").alias(name)

    return m.select(
        "mask_id", "order",
        side("x1", "x", F.greatest(F.lit(0), c("x_first") - 4), c("x_low")), side("y1", "y", F.greatest(F.lit(0), c("y_first") - 4), c("y_low")),
        side("x2", "x", F.least("w", c("x_last") + 5), c("x_high") + 1), side("y2", "y", F.least("h", c("y_last") + 5), c("y_high") + 1))


def fallback_boxes(rows: DataFrame, segments: DataFrame, pages: DataFrame) -> DataFrame:
    """The best component of each of the masks under the soft test, measured by its own cells."""
    parts = label_runs(unpacked(rows))
    whole = parts.groupBy("mask_id", "label").agg(*[F.first(n).alias(n) for n in ("cx", "cy", "w", "h", "area")])
    seq = F.row_number().over(Window.partitionBy("mask_id").orderBy("label"))
    big = cut_lineage(whole.join(pages.select("mask_id", "min_w", "min_h", "min_area"), "mask_id").filter(all_of(
        c("area") >= _part(0.45, "min_area", 20), c("w") >= _part(0.70, "min_w", 10), c("h") >= _part(0.70, "min_h", 12)
    )).withColumn("seq", seq).select("mask_id", "label", (c("mask_id") * PARTS + c("seq")).alias("part_no"), c("cx").alias("x1"), c("cy").alias("y1"),
                                     (c("cx") + c("w")).alias("x2"), (c("cy") + c("h")).alias("y2")))
    own = parts.select("mask_id", "label", "y", "s", "e").join(big.select("mask_id", "label", "part_no"), ["mask_id", "label"]).select(
        c("part_no").alias("mask_id"), "y", "s", "e")
    boxes = big.select(c("part_no").alias("mask_id"), c("mask_id").alias("page"), *SIDES).join(
        pages.withColumnRenamed("mask_id", "page"), "page")
    own = stored_by(packed(own), "mask_id")
    known = with_features(boxes, own, packed(to_runs(to_cells(unpacked(own)), "y"), "x"), segments)
    best = best_fallback(known.withColumnRenamed("mask_id", "seq"), ["page"])
    return best.select(c("page").alias("mask_id"), F.array(F.lit(0)).alias("order"), *SIDES)


def detect_projections(cells: DataFrame, segments: DataFrame, cuts: DataFrame, dims: DataFrame) -> DataFrame:
    """Boxes (drawing_id, ycut, seq, x1, y1, x2, y2, fallback) of the views above each cut, at most three, by x.

    cells (drawing_id, y, x) are line cells, segments (drawing_id, x1, y1, x2, y2) detected lines, cuts (drawing_id, ycut)
    with ycut below ``CUTS``, dims (drawing_id, w, h). Column runs give first boxes, which must look like a projection; they are
    split by rows and by columns, refined, tested again, reduced to the three largest and refined once more. A cut
    left without boxes gets its best component, if one passes the soft test; else it has no row.
    """
    pages = cut_lineage(mask_pages(cuts, dims))
    drawings = stored_by(drawing_runs(cells), "drawing_id")
    rows = stored_by(packed(clean_runs(drawings, pages)), "mask_id")
    cols = stored_by(packed(to_runs(to_cells(unpacked(rows)), "y"), "x"), "mask_id")

    def projections(boxes: DataFrame) -> DataFrame:
        known = with_features(boxes.join(pages.drop("w", "h", "ycut"), "mask_id"), rows, cols, segments)
        return known.filter(looks_like_projection()).select("mask_id", "order", *SIDES)

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn("order", F.array(c("x1").cast("bigint"), c("seq").cast("bigint"))).drop("seq")

    first = cut_lineage(_distinct(first_boxes(cols, pages)))
    first = cut_lineage(ordered(unlike_boxes(projections(first), 0.45)))
    parts = cut_lineage(_distinct(split_rows(first, rows, pages)))
    parts = cut_lineage(_distinct(split_columns(parts, rows, cols, pages)))
    parts = cut_lineage(_distinct(refine(parts, rows, cols, pages, 0.05, 0.008)))
    best = ordered(unlike_boxes(projections(parts), 0.28))
    best = top_rows(best, ["mask_id"], [F.desc(box_area(box())), F.asc("order")], 3)
    final = _distinct(refine(cut_lineage(best), rows, cols, pages, 0.06, 0.006))
    final = cut_lineage(unlike_boxes(final, 0.28))
    bare = cut_lineage(pages.join(final.select("mask_id").distinct(), "mask_id", "left_anti"))
    spare = fallback_boxes(rows.join(bare.select("mask_id"), "mask_id", "left_semi"), segments, bare)
    spare = refine(cut_lineage(spare), rows, cols, pages, 0.04, 0.006)
    found = final.select("mask_id", "seq", *SIDES, F.lit(False).alias("fallback")).unionByName(
        spare.select("mask_id", F.lit(1).alias("seq"), *SIDES, F.lit(True).alias("fallback")))
    place = F.row_number().over(Window.partitionBy("mask_id").orderBy("x1", "seq"))
    return found.withColumn("seq", place).join(pages.select("mask_id", "drawing_id", "ycut"), "mask_id").select(
        "drawing_id", "ycut", "seq", *SIDES, "fallback")
