"""Box tables: pairs, merging, suppression, and the choice of views.

Boxes live in rows ``(drawing_id, seq, x1, y1, x2, y2)``; ``seq`` orders the boxes of a drawing and
breaks every tie. A drawing may hold any number of boxes. Nothing here gathers a drawing's boxes
without first collapsing them to a bounded number, and no operator but ``box_pairs`` (whose result
is pairs) emits pairs of boxes within a drawing.

Views are few: merged boxes of at least 0.4 % of the page that lie apart from each other, so at most
250 per drawing. Only the role functions, which take views, join a drawing's rows to each other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkgrade.functions.boxes import (
    SIDES, box, box_area, boxes_close, center_dist, center_x, center_y, clip_box, enclose, iou,
    overlap_ratio, x_overlap, y_overlap,
)
from inkgrade.functions.cols import all_of, clip, flag, top_rows
from inkgrade.operators.lineage import by_group_size, cut_lineage

c = F.col
CELL = 256  # side of a lookup cell in pixels
GRID = 64  # side of a cell in the grid of kept boxes
FOLD_LIMIT = 64  # most boxes of one drawing that are merged in a single row


def _cells(df: DataFrame, pad: int = 0, size: int = CELL) -> DataFrame:
    """One row per lookup cell (gx, gy) a box reaches, widened by ``pad`` to the right and below."""
    def span(low, high):
        return F.explode(F.sequence(F.floor(c(low) / size), F.floor((c(high) + pad) / size)))
    return df.withColumn("gx", span("x1", "x2")).withColumn("gy", span("y1", "y2"))


def _renamed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[c(n) if n in keep else c(n).alias(prefix + n) for n in df.columns])


def box_pairs(boxes: DataFrame, gap: int = 0, keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Pairs of boxes of a drawing at most ``gap`` apart (0: touching), each pair once.

    Boxes meet in the lookup cells they share, and a pair is reported only in the cell that holds
    the first corner of their common area.
    """
    on = [*keys, "gx", "gy"]
    cells = _cells(boxes.select(*keys, "seq", *SIDES), gap)
    a, b = _renamed(cells, "a_", on), _renamed(cells, "b_", on)
    home = (F.floor(F.greatest("a_x1", "b_x1") / CELL) == c("gx")) & (F.floor(F.greatest("a_y1", "b_y1") / CELL) == c("gy"))
    return a.join(b, on).filter((c("a_seq") < c("b_seq")) & home & boxes_close(box("a_"), box("b_"), gap)).drop("gx", "gy")


# ---- merging ------------------------------------------------------------------------------------
def _hull(prefix: str = ""):
    return [F.min(prefix + "x1").alias("x1"), F.min(prefix + "y1").alias("y1"),
            F.max(prefix + "x2").alias("x2"), F.max(prefix + "y2").alias("y2")]


def _collapse(boxes: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Merge boxes whose first corners share a tile of ``gap`` + 1 pixels: those are always close.

    This is a plain grouped minimum and maximum, combined before the shuffle, and leaves at most one
    box per tile of the page however many copies there were.
    """
    side = gap + 1
    return boxes.groupBy(*keys, F.floor(c("x1") / side).alias("_tx"), F.floor(c("y1") / side).alias("_ty")).agg(
        *_hull()).drop("_tx", "_ty")


def _merge_in_row(boxes: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Fold a small group: each box absorbs every merged box it is close to, growing as it does."""
    def add(merged: Column, new: Column) -> Column:
        grown = F.aggregate(
            F.array_repeat(F.lit(0), F.size(merged)), new,
            lambda cur, _: F.aggregate(F.filter(merged, lambda m: boxes_close(m, cur, gap)), cur, enclose))
        return F.transform(F.array(grown), lambda g: F.concat(
            F.filter(merged, lambda m: ~boxes_close(m, g, gap)), F.array(g)))[0]

    members = F.collect_list(box())
    kind = "array<struct<x1:int,y1:int,x2:int,y2:int>>"
    rows = boxes.select(*keys, *[c(s).cast("int").alias(s) for s in SIDES]).groupBy(*keys).agg(members.alias("m"))
    return rows.select(*keys, F.inline(F.aggregate("m", F.array().cast(kind), add)))


def _merge_on_lattice(boxes: DataFrame, keys: list[str], gap: int, step: int = 32) -> DataFrame:
    """Merge boxes that, widened by the gap, hold the same lattice point: those are always close.

    A grouped minimum and maximum per point, without forming pairs. Boxes between the points stay.
    """
    def points(low, high):
        first, last = F.ceil(c(low) / step), F.floor((c(high) + gap) / step)
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    rows = boxes.withColumn("_px", points("x1", "x2")).withColumn("_py", points("y1", "y2"))
    apart = (F.size("_px") == 0) | (F.size("_py") == 0)
    held = rows.filter(~apart).withColumn("_px", F.explode("_px")).withColumn("_py", F.explode("_py"))
    hulls = held.groupBy(*keys, "_px", "_py").agg(*_hull()).drop("_px", "_py")
    return hulls.unionByName(rows.filter(apart).drop("_px", "_py")).distinct()


def _merge_spread(boxes: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Merge crowded drawings without gathering them.

    First on lattice points while that thins the boxes out. What remains hardly overlaps; it is joined
    over lookup cells round by round, each box growing to the hull of all it is close to, until no box
    is close to another.
    """
    on = [*keys, "gx", "gy"]
    cur = cut_lineage(boxes.select(*keys, *[c(s).cast("int").alias(s) for s in SIDES]))
    before, now = None, cur.count()
    while before is None or now < 0.9 * before:
        cur = cut_lineage(_collapse(_merge_on_lattice(cur, keys, gap), keys, gap))
        before, now = now, cur.count()
    while True:
        cells = _cells(cur, gap, size=128)
        near = _renamed(cells, "b_", on)
        grown = cells.join(near, on).filter(boxes_close(box(), box("b_"), gap)).groupBy(*keys, *SIDES).agg(
            *[e.alias("n_" + s) for e, s in zip(
                [F.min("b_x1"), F.min("b_y1"), F.max("b_x2"), F.max("b_y2")], SIDES)])
        moved = F.max(~all_of(*[c(s) == c("n_" + s) for s in SIDES])).alias("moved")
        step = cut_lineage(grown.groupBy(*keys, *[c("n_" + s).alias(s) for s in SIDES]).agg(moved))
        cur = cut_lineage(_collapse(step.drop("moved"), keys, gap))
        if step.filter("moved").isEmpty():
            return cur


def merge_boxes(boxes: DataFrame, gap: int = 28, keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Merged boxes, pairwise more than ``gap`` apart. The result does not depend on the order."""
    return by_group_size(
        _collapse(boxes, keys, gap), keys, FOLD_LIMIT,
        lambda df: _merge_in_row(df, keys, gap), lambda df: _merge_spread(df, keys, gap))


def assign_to(merged: DataFrame, boxes: DataFrame, keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Each box with the merged box that holds it (columns ``m_x1`` …), found by lookup cell."""
    on = [*keys, "gx", "gy"]
    corner = boxes.withColumn("gx", F.floor(c("x1") / CELL)).withColumn("gy", F.floor(c("y1") / CELL))
    held = (c("x1") >= c("m_x1")) & (c("y1") >= c("m_y1")) & (c("x2") <= c("m_x2")) & (c("y2") <= c("m_y2"))
    return corner.join(_renamed(_cells(merged), "m_", on), on).filter(held).drop("gx", "gy")


def text_groups(atoms: DataFrame, gap: int = 8, keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Merged text atoms with their number and summed area."""
    own = ["m_" + s for s in SIDES]
    return assign_to(merge_boxes(atoms, gap, keys), atoms, keys).groupBy(*keys, *own).agg(
        F.count("*").alias("atom_count"), F.sum("area").alias("area_sum")).select(
        *keys, *[c("m_" + s).alias(s) for s in SIDES], "atom_count", "area_sum")


def band_clusters(boxes: DataFrame, gap: int = 14, keys: list[str] = ["drawing_id", "band"]) -> DataFrame:
    """Clusters of text and line boxes (column ``kind``) in each band, kept when strong enough."""
    own = ["m_" + s for s in SIDES]
    counts = assign_to(merge_boxes(boxes, gap, keys), boxes, keys).groupBy(*keys, *own).agg(
        F.count_if(c("kind") == "text").alias("text_count"), F.count_if(c("kind") == "line").alias("line_count"))
    t, n = c("text_count"), c("line_count")
    return counts.filter(((t >= 1) & (n >= 1)) | (t >= 2) | (n >= 2)).select(
        *keys, *[c("m_" + s).alias(s) for s in SIDES], "text_count", "line_count")


# ---- suppression --------------------------------------------------------------------------------
def nms(boxes: DataFrame, iou_thr: float = 0.45, keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Greedy suppression, largest first: keep a box when it overlaps no kept box by ``iou_thr``.

    Copies of a box collapse first (only the earliest can be kept). The rest streams through each task sorted by
    drawing and rank; a task holds the kept boxes of one drawing in a grid and compares a box with those in its grid
    cells alone, so a drawing costs time by its boxes, not by their pairs, and no drawing needs further rounds.
    """
    unique = boxes.groupBy(*keys, *SIDES).agg(F.min("seq").alias("seq")).select(*keys, "seq", *SIDES)
    ranked = unique.withColumn("_area", box_area(box())).repartition(*keys).sortWithinPartitions(
        *keys, F.desc("_area"), "seq")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawing, grid = None, _Kept(iou_thr)
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            sides = zip(*[batch.column(n).to_pylist() for n in SIDES])
            chosen = []
            for at, (name, b) in enumerate(zip(names, sides)):
                if name != drawing:
                    drawing, grid = name, _Kept(iou_thr)
                if grid.add(b):
                    chosen.append(at)
            yield batch.take(pa.array(chosen, pa.int64())).drop_columns(["_area"])

    return ranked.mapInArrow(keep, unique.schema)


class _Kept:
    """Kept boxes of one drawing, each listed in the grid cells it reaches."""

    def __init__(self, iou_thr: float):
        if iou_thr <= 0:
            raise ValueError("a threshold of zero would keep one box of each drawing")
        self.iou_thr, self.cells = iou_thr, defaultdict(list)

    def add(self, b: tuple[int, int, int, int]) -> bool:
        """Keep the box unless it overlaps a kept one by the threshold; whether it is kept."""
        x1, y1, x2, y2 = b
        area = max(0, x2 - x1) * max(0, y2 - y1)
        reach = [(gx, gy) for gx in range(x1 // GRID, x2 // GRID + 1) for gy in range(y1 // GRID, y2 // GRID + 1)]
        widest = area / self.iou_thr  # larger boxes share too little of their area
        for cell in reach:
            for k1, l1, k2, l2, kept in self.cells[cell]:
                if kept > widest or k1 >= x2 or x1 >= k2 or l1 >= y2 or y1 >= l2:
                    continue
                inter = (min(x2, k2) - max(x1, k1)) * (min(y2, l2) - max(y1, l1))
                if inter / (area + kept - inter) >= self.iou_thr:
                    return False
        for cell in reach:
            self.cells[cell].append((*b, area))
        return True


def nms_topk(boxes: DataFrame, dims: DataFrame, k: int = 3, iou_thr: float = 0.35) -> DataFrame:
    """The ``k`` best boxes by ink area plus a fifth of box area, none overlapping an earlier pick by
    ``iou_thr``; a drawing without candidates gets its whole page.

    One pass per pick: rank, keep one, drop what it overlaps.
    """
    page = dims.select("drawing_id", "w", "h")
    b = box()
    least = F.greatest(F.lit(350), (0.0007 * c("h") * c("w")).cast("int"))
    left = boxes.join(page, "drawing_id").filter(
        (c("area") >= least) & ((c("x2") - c("x1") >= 0.08 * c("w")) | (c("y2") - c("y1") >= 0.08 * c("h")))
    ).withColumn("score", c("area") + 0.20 * box_area(b)).select("drawing_id", "seq", *SIDES, "score")
    picks = None
    for n in range(1, k + 1):
        best = top_rows(left, ["drawing_id"], [F.desc("score"), F.asc("seq")])
        this = best.select("drawing_id", *SIDES, F.lit(n).alias("pick"))
        picks = this if picks is None else picks.unionByName(this)
        if n < k:
            left = left.join(_renamed(best.drop("score"), "k_", ["drawing_id"]), "drawing_id").filter(
                (c("seq") != c("k_seq")) & (iou(b, box("k_"), "floor") < iou_thr)
            ).select("drawing_id", "seq", *SIDES, "score")
    whole = page.join(picks.filter("pick = 1"), "drawing_id", "left_anti").select(
        "drawing_id", F.lit(0).alias("x1"), F.lit(0).alias("y1"), c("w").alias("x2"), c("h").alias("y2"), F.lit(1).alias("pick"))
    return picks.unionByName(whole)


def topk_boxes(boxes: DataFrame, k: int = 3, keys: list[str] = ["drawing_id"]) -> DataFrame:
    return top_rows(boxes, keys, [F.desc(box_area(box())), F.asc("seq")], k).orderBy(*keys, "x1", "seq")


def pick_visible_box(candidates: DataFrame) -> DataFrame:
    """Candidate of each drawing that looks most like the pictorial view."""
    score = 1.8 * c("long_diag_ratio") + 1.0 * c("diag_ratio") + 0.45 * F.sqrt("area_ratio") + 0.20 * c("density")
    return top_rows(candidates.withColumn("score", score), ["drawing_id"], [F.desc("score"), F.asc("seq")])


# ---- roles --------------------------------------------------------------------------------------
def _iso_score(v: Column, far: Column, zw: Column, zh: Column) -> Column:
    g = v.getField
    return (
        1.6 * (g("diag_ratio") - g("hv_ratio"))
        + 0.9 * (box_area(v) / F.greatest(F.lit(1), zw.cast("bigint") * zh))
        + 0.6 * (far / (F.greatest(zw, zh) + 1e-6))
        + F.when(g("view_type") == "diag_dominant", 0.35).otherwise(0.0)
    )


def _is_iso(v: Column) -> Column:
    return (v.getField("diag_ratio") >= 0.12) | (v.getField("view_type") == "diag_dominant")


def _support(a: Column, o: Column) -> Column:
    """Tenths of support a neighbour lends: 1.0 above, 0.8 below, 0.9 beside."""
    in_x, in_y = x_overlap(a, o) >= 0.18, y_overlap(a, o) >= 0.18
    return (
        F.when(in_x & (center_y(o) < center_y(a)), 10).when(in_x & (center_y(o) > center_y(a)), 8).otherwise(0)
        + F.when(in_y & (center_x(o) != center_x(a)), 9).otherwise(0)
    )


def _front_score(b: Column, support: Column) -> Column:
    return 1.2 * box_area(b) + support / 10.0 * 10000.0


def _fits_top(f: Column, b: Column) -> Column:
    return x_overlap(f, b) >= 0.18


def _top_score(f: Column, b: Column, system: str) -> Column:
    dy = center_y(b) - center_y(f)
    preferred = dy > 0 if system == "first_angle" else dy < 0
    return (2.5 * x_overlap(f, b) + 1.5 * F.when(preferred, 1.2).otherwise(0.15)
            - 0.0025 * F.abs(center_x(b) - center_x(f)) - 0.0015 * F.abs(dy))


def _fits_side(f: Column, b: Column) -> Column:
    return (y_overlap(f, b) >= 0.18) & (F.abs(center_x(b) - center_x(f)) >= 5)


def _side_score(f: Column, b: Column) -> Column:
    return (2.5 * y_overlap(f, b) + 0.8 - 0.0015 * F.abs(center_y(b) - center_y(f))
            - 0.0010 * F.abs(center_x(b) - center_x(f)))


def _view() -> Column:
    return F.struct("seq", *SIDES, "diag_ratio", "hv_ratio", "view_type")


def _pairs(views: DataFrame) -> DataFrame:
    """Views of a drawing joined to its other views: few per drawing, see the module text."""
    others = _renamed(views.select("drawing_id", "seq", *SIDES), "o_", ["drawing_id"])
    return views.join(others, "drawing_id").filter(c("seq") != c("o_seq"))


def _zone_sides(zones: DataFrame) -> DataFrame:
    return zones.select("drawing_id", (c("zx2") - c("zx1")).alias("zw"), (c("zy2") - c("zy1")).alias("zh"))


def _first(df: DataFrame) -> DataFrame:
    return top_rows(df, ["drawing_id"], [F.desc("score"), F.asc("seq")])


def pick_isometric(views: DataFrame, zones: DataFrame) -> DataFrame:
    """The pictorial view of each drawing, if one is diagonal enough."""
    far = _pairs(views).groupBy("drawing_id", "seq").agg(F.avg(center_dist(box(), box("o_"))).alias("far"))
    scored = views.join(far, ["drawing_id", "seq"], "left").join(_zone_sides(zones), "drawing_id").withColumn(
        "score", _iso_score(_view(), F.coalesce("far", F.lit(0.0)), c("zw"), c("zh")))
    return _first(scored).filter(_is_iso(_view())).select(*views.columns, "score")


def pick_front(views: DataFrame) -> DataFrame:
    """The view with the largest area and the most neighbours above, below and beside it."""
    support = _pairs(views).groupBy("drawing_id", "seq").agg(F.sum(_support(box(), box("o_"))).alias("support"))
    scored = views.join(support, ["drawing_id", "seq"], "left")
    return _first(scored.withColumn("score", _front_score(box(), F.coalesce("support", F.lit(0)))))


def _with_front(views: DataFrame, front: DataFrame) -> DataFrame:
    return views.join(_renamed(front.select("drawing_id", *SIDES), "f_", ["drawing_id"]), "drawing_id")


def assign_top(views: DataFrame, front: DataFrame, system: str = "first_angle") -> DataFrame:
    """Best view in line above or below the front view; the projection system prefers one side."""
    f, b = box("f_"), box()
    fit = _with_front(views, front).filter(_fits_top(f, b)).withColumn("score", _top_score(f, b, system))
    return _first(fit).select(*views.columns, "score")


def assign_side(views: DataFrame, front: DataFrame) -> DataFrame:
    """Best view in line to the left or right of the front view."""
    f, b = box("f_"), box()
    fit = _with_front(views, front).filter(_fits_side(f, b)).withColumn("score", _side_score(f, b))
    return _first(fit).select(*views.columns, "score")


def resolve_roles(views: DataFrame, zones: DataFrame, system: str = "first_angle", carry: list[str] = []) -> DataFrame:
    """Every view with its role: isometric, front, top, side, else extra_1, extra_2, … in order; null for a view whose box
    equals that of a named one.

    Views stream through each task sorted by drawing; a task holds the views of one drawing, and their distances and
    supports block by block, so crowded drawings need no more than a block of pairs at a time. Columns named in
    ``carry`` stay with their view. A drawing without zone is measured by the extent of its views; views of no drawing
    are left out.
    """
    fields = ["drawing_id", "seq", *SIDES, *carry]
    own = ["diag_ratio", "hv_ratio", "view_type"]
    rows = views.filter("drawing_id IS NOT NULL").select(*fields, *[c(n).alias("_" + n) for n in own]).join(
        _zone_sides(zones), "drawing_id", "left").repartition("drawing_id").sortWithinPartitions("drawing_id", "seq")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            ids = table.column("drawing_id").to_pylist()
            starts = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
            done = starts[-1] if starts else 0
            if done:
                yield from _with_roles(table.slice(0, done), [0, *starts], fields, system)
            held = table.slice(done)
        if held is not None and held.num_rows:
            yield from _with_roles(held, [0, held.num_rows], fields, system)

    schema = StructType([*[rows.schema[n] for n in fields], StructField("role", StringType())])
    return rows.mapInArrow(named, schema)


def _with_roles(table: pa.Table, bounds: list[int], fields: list[str], system: str) -> Iterator[pa.RecordBatch]:
    """The views of whole drawings, which begin and end at the bounds, with their roles."""
    number = lambda n: table.column(n).to_numpy().astype(float)  # noqa: E731  nulls become nan
    numbers = [number(n) for n in (*SIDES, "_diag_ratio", "_hv_ratio", "zw", "zh")]
    slanted = np.array([t == "diag_dominant" for t in table.column("_view_type").to_pylist()], bool)
    roles: list[str | None] = []
    for low, high in zip(bounds, bounds[1:]):
        roles += _roles(*[v[low:high] for v in numbers], slanted[low:high], system)
    yield from table.select(fields).append_column("role", pa.array(roles, pa.string())).to_batches()


def _pair_sums(n: int, score) -> np.ndarray:
    """Per view the sum of ``score(views, all)`` over all views, for a block of views at a time."""
    block = max(1, 4_000_000 // max(n, 1))
    return np.concatenate([score(np.arange(i, min(i + block, n))[:, None], np.arange(n)[None]).sum(1) for i in range(0, n, block)])


def _roles(x1, y1, x2, y2, diag, hv, zw, zh, slanted, system: str) -> list[str | None]:
    """Roles of the views of one drawing in order; ties go to the earlier view."""
    n, cx, cy = len(x1), (x1 + x2) / 2, (y1 + y2) / 2
    area = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    zone_w, zone_h = (x2.max(), y2.max()) if np.isnan(zw[0]) or np.isnan(zh[0]) else (zw[0], zh[0])

    def overlap(low, high, a, b):
        shared = np.maximum(np.minimum(high[a], high[b]) - np.maximum(low[a], low[b]), 0)
        return shared / np.maximum(1, np.minimum(high[a] - low[a], high[b] - low[b]))

    def best(fit, score):
        score = np.where(fit, np.nan_to_num(score, nan=-np.inf), -np.inf)
        return int(np.argmax(score)) if fit.any() else None

    far = _pair_sums(n, lambda a, b: np.hypot(cx[a] - cx[b], cy[a] - cy[b])) / max(n - 1, 1)
    iso = best(np.ones(n, bool), 1.6 * (diag - hv) + 0.9 * (area / max(1, zone_w * zone_h)) + 0.6 * (
        far / (max(zone_w, zone_h) + 1e-6)) + np.where(slanted, 0.35, 0.0))
    iso = iso if diag[iso] >= 0.12 or slanted[iso] else None
    orth = np.arange(n) != (-1 if iso is None else iso)

    def support(a, b):
        in_x, in_y = overlap(x1, x2, a, b) >= 0.18, overlap(y1, y2, a, b) >= 0.18
        tenths = np.where(in_x & (cy[b] < cy[a]), 10, np.where(in_x & (cy[b] > cy[a]), 8, 0)) + np.where(in_y & (cx[b] != cx[a]), 9, 0)
        return np.where(orth[b] & (a != b), tenths, 0)

    f = best(orth, 1.2 * area + _pair_sums(n, support) / 10.0 * 10000.0)
    roles: list[str | None] = [None] * n
    if iso is not None:
        roles[iso] = "isometric"
    if f is None:
        return roles
    every = np.arange(n)
    like_x, like_y = overlap(x1, x2, f, every), overlap(y1, y2, f, every)
    dx, dy = np.abs(cx - cx[f]), cy - cy[f]
    preferred = dy > 0 if system == "first_angle" else dy < 0
    top = best(orth & (every != f) & (like_x >= 0.18),
               2.5 * like_x + 1.5 * np.where(preferred, 1.2, 0.15) - 0.0025 * dx - 0.0015 * np.abs(dy))
    other = lambda i: np.ones(n, bool) if i is None else (x1 != x1[i]) | (y1 != y1[i]) | (x2 != x2[i]) | (y2 != y2[i])
    side = best(orth & other(f) & other(top) & (like_y >= 0.18) & (dx >= 5),
                2.5 * like_y + 0.8 - 0.0015 * np.abs(dy) - 0.0010 * dx)
    extras = np.flatnonzero(orth & other(f) & other(top) & other(side))
    for i, name in [(i, f"extra_{k}") for k, i in enumerate(extras, 1)] + [(side, "side"), (top, "top"), (f, "front")]:
        if i is not None:
            roles[i] = name
    return roles


# ---- dimensions around views --------------------------------------------------------------------
def dimension_bands(roles: DataFrame, dims: DataFrame) -> DataFrame:
    """Up to four bands outside each view, at least six pixels wide and high."""
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    size = lambda side, part: F.greatest(F.lit(12), F.rint(F.greatest(F.lit(1), side) * part).cast("int"))
    band_h, band_w, reach_x, reach_y = size(h, 0.18), size(w, 0.18), size(w, 0.30), size(h, 0.30)
    low = lambda v: F.greatest(F.lit(0), v)
    left, right = low(c("x1") - reach_x), F.least("w", c("x2") + reach_x)
    above, under = low(c("y1") - reach_y), F.least("h", c("y2") + reach_y)

    def band(name, x1, y1, x2, y2):
        return F.struct(F.lit(name).alias("band"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    bands = F.array(
        band("top", left, low(c("y1") - band_h), right, c("y1")), band("bottom", left, c("y2"), right, F.least("h", c("y2") + band_h)),
        band("left", low(c("x1") - band_w), above, c("x1"), under), band("right", c("x2"), above, F.least("w", c("x2") + band_w), under))
    return roles.join(dims.select("drawing_id", "w", "h"), "drawing_id").select(
        "drawing_id", "role", F.inline(bands)).filter("x2 - x1 >= 6 AND y2 - y1 >= 6")


def outer_boxes(roles: DataFrame, bands: DataFrame) -> DataFrame:
    """Box around all bands of a view; the view itself when it has none."""
    hull = bands.groupBy("drawing_id", "role").agg(*_hull())
    return roles.select("drawing_id", "role", *[c(s).alias("r_" + s) for s in SIDES]).join(
        hull, ["drawing_id", "role"], "left").select(
        "drawing_id", "role", *[F.coalesce(s, "r_" + s).alias(s) for s in SIDES])


def cluster_side(role: Column, cluster: Column) -> Column:
    """Side of the view a cluster lies on; null when it is central or too far away."""
    g = lambda s: role.getField(s)
    w, h = F.greatest(F.lit(1), g("x2") - g("x1")), F.greatest(F.lit(1), g("y2") - g("y1"))
    x, y = center_x(cluster), center_y(cluster)
    inner = x.between(g("x1") + w * 0.275, g("x2") - w * 0.275) & y.between(g("y1") + h * 0.275, g("y2") - h * 0.275)
    dist = [("left", g("x1") - x, w), ("right", x - g("x2"), w), ("top", g("y1") - y, h), ("bottom", y - g("y2"), h)]
    best = F.greatest(*[d for _, d, _ in dist])
    out = None
    for name, d, extent in dist:
        side = F.when(F.abs(d) <= extent * 1.42, name)
        out = F.when(d == best, side) if out is None else out.when(d == best, side)
    return F.when(~inner, out)


def reject_clusters(clusters: DataFrame, roles: DataFrame, titles: DataFrame) -> DataFrame:
    """Clusters (drawing, role, box, counts) that survive the title block, other views and position."""
    role = _renamed(roles.select("drawing_id", "role", *SIDES), "r_", ["drawing_id", "role"])
    title = _renamed(titles.select("drawing_id", *SIDES), "t_", ["drawing_id"])
    other = roles.select("drawing_id", *[c(s).alias("v_" + s) for s in SIDES])
    b = box()
    placed = clusters.join(role, ["drawing_id", "role"]).withColumn("side", cluster_side(box("r_"), b)).filter("side IS NOT NULL")
    clear = placed.join(title, "drawing_id", "left").filter(
        c("t_x1").isNull() | (overlap_ratio(b, box("t_")) <= 0.10)).drop(*["t_" + s for s in SIDES])
    same = all_of(*[c("v_" + s) == c("r_" + s) for s in SIDES])
    on_view = (clear["drawing_id"] == other["drawing_id"]) & ~same & (overlap_ratio(b, box("v_")) > 0.08)
    strength = 1.2 * F.least("text_count", F.lit(2)) + 1.0 * F.least("line_count", F.lit(2)) + 0.4
    return clear.join(other, on_view, "left_anti").withColumn("strength", strength).filter("strength >= 1.0").drop(
        *["r_" + s for s in SIDES])


# ---- projection search --------------------------------------------------------------------------
def choose_cut(cuts: DataFrame, boxes: DataFrame) -> DataFrame:
    """The horizontal cut of each drawing whose boxes score best; cuts without boxes take part."""
    facts = boxes.groupBy("drawing_id", "ycut").agg(
        F.count("*").alias("cnt"), F.stddev_pop(center_x(box())).alias("sx"), F.stddev_pop(center_y(box())).alias("sy"),
        F.max(c("x2") - c("x1")).alias("mw"), F.max(c("y2") - c("y1")).alias("mh"))
    rows = cuts.select("drawing_id", "ycut", "w").join(facts, ["drawing_id", "ycut"], "left")
    n = F.coalesce("cnt", F.lit(0))
    wide = F.coalesce(c("mw") / c("w"), F.lit(1.0))
    tall = F.coalesce(c("mh") / F.greatest(F.lit(1), "ycut"), F.lit(1.0))
    spread = lambda v, d: F.when(n >= 2, v / F.greatest(F.lit(1.0), d)).otherwise(0.0)
    score = (
        140.0 * n + 30.0 * spread(c("sx"), c("w")) + 40.0 * spread(c("sy"), c("ycut"))
        - 30.0 * F.greatest(F.lit(0.0), wide - 0.16)
        - F.when((n == 1) & (wide > 0.18), 60.0 + 120.0 * (wide - 0.18)).otherwise(0.0)
        - F.when((n == 1) & (tall > 0.30), 70.0 + 110.0 * (tall - 0.30)).otherwise(0.0)
    )
    return top_rows(rows.select("drawing_id", "ycut", n.alias("cnt"), score.alias("score")), ["drawing_id"],
                    [F.desc("score"), F.desc("cnt"), F.asc("ycut")])


def looks_like_projection() -> Column:
    """The strict test on bw, bh, area, hvs, hvl, hv_len, diag_len and the limits min_w, min_h, min_area."""
    big = all_of(c("bw") >= c("min_w"), c("bh") >= c("min_h"), c("area") >= c("min_area"))
    return big & (((c("hvs") >= 0.26) & (c("hvl") >= 0.50)) | ((c("hvs") >= 0.48) & (c("hv_len") >= c("diag_len") * 1.15)))


def best_fallback(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The best box of each key under the softer test; needs the page size w, h too."""
    share = lambda part, floor, of: F.greatest(F.lit(floor), (c(of) * part).cast("int"))
    soft_size = all_of(c("area") >= share(0.45, 20, "min_area"), c("bw") >= share(0.70, 10, "min_w"), c("bh") >= share(0.70, 12, "min_h"))
    flat = (c("bw") >= (c("w") * 0.55).cast("int")) & (c("bh") <= (c("h") * 0.12).cast("int"))
    soft = (
        ((c("hvs") >= 0.14) & (c("hvl") >= 0.34)) | ((c("hvs") >= 0.22) & (c("hv_len") >= c("diag_len") * 0.80))
        | ((c("hvl") >= 0.55) & (c("area") >= share(0.65, 40, "min_area")))
    )
    score = (
        3.5 * c("hvs") + 2.5 * c("hvl") + 0.35 * F.log1p("area")
        + 0.15 * F.least(c("bh") / F.greatest(F.lit(1.0), "bw"), F.lit(3.0))
        - 0.20 * (c("diag_len") / F.greatest(F.lit(1.0), c("hv_len") + c("diag_len")))
    )
    fit = boxes.filter(soft_size & ~flat & soft).withColumn("_score", score)
    return top_rows(fit, keys, [F.desc("_score"), F.asc("seq")]).drop("_score")


def projection_filter(boxes: DataFrame, keys: list[str] = ["drawing_id"]) -> DataFrame:
    """Boxes that look like projections; drawings with none keep their best one under a softer test.

    Needs bw, bh, area, hvs, hvl, hv_len, diag_len and the limits min_w, min_h, min_area, w, h.
    """
    kept = boxes.filter(looks_like_projection()).withColumn("fallback", F.lit(False))
    best = best_fallback(boxes.join(kept.select(*keys).distinct(), keys, "left_anti"), keys)
    return kept.unionByName(best.withColumn("fallback", F.lit(True)))


def projection_candidates(components: DataFrame, zones: DataFrame, gap: int = 28) -> DataFrame:
    """Grouped regions of plausible size and ink, merged when close, in reading order."""
    zone = zones.select("drawing_id", F.greatest(F.lit(1), (c("zx2") - c("zx1")).cast("bigint") * (c("zy2") - c("zy1"))).alias("zone_area"))
    share = box_area(box()) / c("zone_area")
    fit = components.join(zone, "drawing_id").filter(all_of(
        c("x2") - c("x1") >= 70, c("y2") - c("y1") >= 70, share.between(0.004, 0.55), c("fill_ratio") >= 0.01))
    return merge_boxes(fit, gap).join(zone, "drawing_id").select(
        "drawing_id", *SIDES, share.alias("area_ratio")).orderBy("drawing_id", "y1", "x1")


def title_block_rank(candidates: DataFrame) -> DataFrame:
    """The best title-block candidate of each drawing by grid fill, ink fill and corner position."""
    b = box()
    area_ratio = box_area(b) / (c("w").cast("bigint") * c("h") + 1e-6)
    tall = F.greatest(F.lit(0.0), (c("y2") - c("y1")) / F.greatest(F.lit(1.0), "h") - 0.26)
    score = 2.5 * c("hv_fill") + 0.8 * c("fill_ratio") + center_x(b) / c("w") + center_y(b) / c("h") - 2.0 * tall
    fit = candidates.filter(all_of(c("x2") - c("x1") >= 40, c("y2") - c("y1") >= 25,
                                   area_ratio.between(0.010, 0.30), c("fill_ratio") >= 0.03))
    return top_rows(fit.withColumn("score", score), ["drawing_id"], [F.desc("score"), F.asc("seq")])


def drawing_zone(pages: DataFrame, titles: DataFrame, pad: int = 12) -> DataFrame:
    """Page area left beside or above the title block, whichever is larger."""
    t = _renamed(titles.select("drawing_id", *SIDES), "t_", ["drawing_id"])
    zero = F.lit(0)
    top, beside = F.greatest(zero, c("t_y1") - pad), F.greatest(zero, c("t_x1") - pad)
    w, h = c("w"), c("h")
    use_top = w.cast("bigint") * top >= beside.cast("bigint") * h
    zx2 = F.when(use_top, w).otherwise(F.least(beside, w))
    zy2 = F.when(use_top, F.least(top, h)).otherwise(h)
    whole = c("t_x1").isNull() | (zx2.cast("bigint") * zy2 < 1000)
    return pages.join(t, "drawing_id", "left").select(
        "drawing_id", F.when(whole, pad).otherwise(0).alias("zx1"), F.when(whole, pad).otherwise(0).alias("zy1"),
        F.when(whole, w - pad).otherwise(zx2).alias("zx2"), F.when(whole, h - pad).otherwise(zy2).alias("zy2"))
