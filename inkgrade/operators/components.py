"""Connected-component tables (x, y, w, h, area): counting, classifying and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkgrade.functions.cols import all_of, flag, for_all, top_rows  # noqa: F401
from inkgrade.functions.angles import axial_diff

c = F.col


def _long():
    return F.greatest("w", "h")


def _short():
    return F.greatest(F.least("w", "h"), F.lit(1))


def _aspect():
    return _long() / _short()


def _fill():
    return c("area") / F.greatest(c("w") * c("h"), F.lit(1))


def is_dash() -> Column:
    return all_of(c("area").between(10, 220), c("w").between(2, 45), c("h").between(2, 45))


def dash_like_count(components: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """Dash-sized components per drawing; drawings without components count 0."""
    counts = components.groupBy("drawing_id").agg(F.sum(flag(is_dash())).alias("dashes"))
    if drawings is None:
        return counts
    return drawings.select("drawing_id").join(counts, "drawing_id", "left").select(
        "drawing_id", F.coalesce("dashes", F.lit(0)).alias("dashes"))


def small_component_stats(components: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    small = all_of(c("area").between(12, 450), c("w").between(3, 60), c("h").between(3, 60))
    stats = components.groupBy("drawing_id").agg(
        F.sum(flag(small)).alias("small_count"), F.sum(F.when(small, c("area")).otherwise(0)).alias("small_area"))
    return for_all(drawings, stats, ["drawing_id"], small_count=F.lit(0), small_area=F.lit(0))


def section_components(components: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """Components large and long enough for a section, per drawing of size w × h (page_w, page_h)."""
    area = c("page_w").cast("bigint") * c("page_h")
    base = F.least("page_w", "page_h")
    hit = (c("area") >= F.greatest(F.lit(6), (area * 0.00010).cast("int"))) & (_long() >= F.greatest(F.lit(5), (base * 0.04).cast("int")))
    found = components.groupBy("drawing_id").agg(F.sum(flag(hit)).alias("section_components"))
    return for_all(drawings, found, ["drawing_id"], section_components=F.lit(0))


def classes() -> dict[str, Column]:
    """Rule families over one component; each is a flag except ``noise`` and ``outside``."""
    w, h, area = c("w"), c("h"), c("area")
    fill, aspect = _fill(), _aspect()
    wide = w / F.greatest(F.lit(1.0), h)
    return {
        "text_like": all_of(area.between(12, 260), w <= 35, h <= 35, fill.between(0.08, 0.75)),
        "dashed_like": all_of(area.between(6, 160), _long() <= 30, aspect >= 1.9),
        "noise": F.when(area < 3, "none").when(area <= 18, "speckle")
        .when(all_of(area >= 20, fill >= 0.28, aspect <= 4.5), "blob")
        .when(all_of(area.between(12, 220), aspect <= 8.0, fill >= 0.10), "blob").otherwise("none"),
        "outside": F.when(area < 4, "none").when(area <= 16, "speckle").otherwise("line"),
        "text_atom": all_of(area.between(8, 2500), w.between(3, 140), h.between(4, 55),
                            ~((h > 3.8 * w) & (area < 60)), ~((wide > 12) & (area < 100))),
        "stray": area.between(20, 12000),
    }


def classify_components(components: DataFrame) -> DataFrame:
    return components.select("*", *[rule.alias(name) for name, rule in classes().items()])


def dim_lines(components: DataFrame, base: str = "base") -> DataFrame:
    """Thin long components near a view: candidates for dimension lines."""
    return components.filter(all_of(c("area") >= 10, F.least("w", "h") <= 5, _long() >= c(base)))


def frame_like(components: DataFrame) -> DataFrame:
    """Components near the page edge that span more than half of it."""
    mx, my = (c("page_w") * 0.08).cast("int"), (c("page_h") * 0.08).cast("int")
    near = ((c("x") <= mx) | (c("y") <= my) | (c("x") + c("w") >= c("page_w") - mx) | (c("y") + c("h") >= c("page_h") - my))
    long = (c("w") / F.greatest(F.lit(1), "page_w") >= 0.55) | (c("h") / F.greatest(F.lit(1), "page_h") >= 0.55)
    return components.filter(near & long)


def anchors(components: DataFrame) -> DataFrame:
    """Components of a region (region_w, region_h) that can anchor a view."""
    W, H = c("region_w"), c("region_h")
    scaled = lambda of, part, floor: F.greatest(F.lit(floor), (of * part).cast("int"))
    least = scaled(W.cast("bigint") * H, 0.0006, 10)
    bar = (c("w") >= (W * 0.45).cast("int")) & (c("h") <= (H * 0.16).cast("int"))
    low = (c("h") < scaled(H, 0.10, 8)) & (c("area") < (2.0 * least).cast("int"))
    return components.filter(all_of(~bar, c("area") >= least, c("w") >= scaled(W, 0.015, 3), ~low))


# Diagonal directions of hatching, in degrees.
HATCH_DIRECTIONS = [30, 45, 60, 120, 135, 150]


def short_diagonals(components: DataFrame, family: str = "range") -> DataFrame:
    """Short diagonal strokes by their angle and aspect: by angle range, or near a hatch direction."""
    long = _long()
    if family == "range":
        return components.filter(all_of(
            c("area").between(8, 150), c("angle").between(20, 70) | c("angle").between(110, 160),
            c("aspect") >= 2.0, long.between(6, 34)))
    near = F.least(*[axial_diff(c("angle"), F.lit(float(d))) for d in HATCH_DIRECTIONS])
    return components.filter(all_of(c("area").between(6, 260), near <= 12, c("aspect") >= 1.5, long.between(6, 90)))


def group_by_xgap(components: DataFrame, gap: str = "gap") -> DataFrame:
    """Runs of components along x, split where one starts at least ``gap`` after its predecessor ends.

    Components starting at the same x never split, so they are first reduced to one row per x: the
    window then holds at most one row per pixel column of the page.
    """
    columns = components.groupBy("drawing_id", "x").agg(
        F.max_by("w", "seq").alias("last_w"), F.max("w").alias("max_w"), F.count("*").alias("n"), F.max(gap).alias("gap"))
    order = Window.partitionBy("drawing_id").orderBy("x")
    starts = flag(c("x") - F.lag(c("x") + c("last_w")).over(order) >= c("gap"))
    return columns.withColumn("starts", starts).withColumn("group_id", F.sum("starts").over(order)).groupBy(
        "drawing_id", "group_id").agg(
        F.min("x").alias("x1"), F.max(c("x") + c("max_w")).alias("x2"), F.sum("n").alias("components"))


def region_density_filter(regions: DataFrame, ink: DataFrame, density: float = 0.08, least: int = 120) -> DataFrame:
    """Regions with enough area whose share of ink cells reaches ``density``.

    ``ink`` holds one row per (drawing_id, region_id) ink cell.
    """
    lines = ink.groupBy("drawing_id", "region_id").agg(F.count("*").alias("line_px"))
    return regions.join(lines, ["drawing_id", "region_id"], "left").withColumn(
        "line_px", F.coalesce("line_px", F.lit(0))).withColumn(
        "density", c("line_px") / F.greatest(c("area"), F.lit(1))).filter((c("area") >= least) & (c("density") >= density))
