"""Rubric without a reference drawing: six modules worth 75 points, rescaled to 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgrade.functions.boxes import center_x, center_y, x_overlap, y_overlap
from inkgrade.functions.cols import all_of, clip, flag, ladder, messages
from inkgrade.functions.text import task_requirements
from inkgrade.functions.texts import TEXTS as T

c = F.col

# The modules of the stand-alone rubric.
MODULES = [  # order, key, criterion text, points
    (1, "completeness_arrangement", "Proyeksiyalar to‘liqligi va joylashuvi", 15),
    (2, "section_hatching", "Qirqim va shtrixovka sifati", 10),
    (3, "dimensions", "O‘lchamlar mavjudligi va joylashuvi", 15),
    (4, "line_semantics", "Chiziq semantikasi va chizmachilik qoidalari", 15),
    (5, "cleanliness", "Chizma tozaligi va o‘qilishi", 10),
    (6, "task_compliance", "Topshiriq talabiga moslik", 10),
]


# ---- completeness and arrangement -------------------------------------------------------------
def view_count_points(count, required=3, top=6):
    return F.when(count >= required, top).when(count == 2, 4).when(count == 1, 2).otherwise(0)


def view_count_errors(count, required=3):
    short = count < required
    return messages(
        (short & (count == 2), T["one_view_missing"]),
        (short & (count == 1), T["two_views_missing"]),
        (short & ~count.isin(1, 2), T["no_views"]))


def score_view_count(df: DataFrame, required: int = 3, top: int = 6) -> DataFrame:
    return df.withColumn("view_count", view_count_points(c("orthographic_count"), required, top))


def score_isometric(df: DataFrame, required: bool = True, top: int = 2) -> DataFrame:
    return df.withColumn("isometric_presence", F.lit(top) if not required else F.when(c("has_isometric"), top).otherwise(0))


def _has(role):
    return c(f"{role}.x1").isNotNull()


def score_role_presence(df: DataFrame) -> DataFrame:
    """One point each for a front, top and side box (struct columns, null when absent)."""
    return df.withColumn("role_presence", flag(_has("front")) + flag(_has("top")) + flag(_has("side")))


def _arrangement(system: str):
    front, top, side = c("front"), c("top"), c("side")
    below = center_y(top) > center_y(front)
    above = center_y(top) < center_y(front)
    return {
        "top_direction_ok": F.coalesce(below if system == "first_angle" else above, F.lit(False)),
        "top_alignment_ok": _has("front") & _has("top") & (x_overlap(front, top) >= 0.18),
        "side_direction_ok": F.coalesce(F.abs(center_x(side) - center_x(front)) > 5, F.lit(False)),
        "side_alignment_ok": _has("front") & _has("side") & (y_overlap(front, side) >= 0.18),
    }


def score_arrangement(df: DataFrame, system: str = "first_angle") -> DataFrame:
    checks = _arrangement(system)
    return df.select("*", *[k.alias(n) for n, k in checks.items()]).withColumn(
        "arrangement", F.when(_has("front"), sum((flag(c(n)) for n in checks), F.lit(0))).otherwise(0))


def score_completeness(df: DataFrame, required: int = 3, system: str = "first_angle") -> DataFrame:
    """Sum of the four parts, with errors and the warning about views without a role.

    Input: front/top/side box structs, orthographic_count, has_isometric, extra_count.
    """
    out = score_arrangement(score_role_presence(score_isometric(score_view_count(df, required))), system)
    f, t, s = _has("front"), _has("top"), _has("side")
    errors = F.concat(
        view_count_errors(c("orthographic_count"), required),
        messages(
            (~c("has_isometric"), T["no_isometric"]),
            (~f, T["no_front"]), (~t, T["no_top"]), (~s, T["no_side"]),
            (~f, T["arrangement_needs_front"]),
            (f & t & ~c("top_direction_ok"), T["top_wrong_side"]),
            (f & t & ~c("top_alignment_ok"), T["top_not_aligned"]),
            (f & ~t, T["top_not_checked"]),
            (f & s & ~c("side_direction_ok"), T["side_wrong_side"]),
            (f & s & ~c("side_alignment_ok"), T["side_not_aligned"]),
            (f & ~s, T["side_not_checked"])))
    extra = F.concat(c("extra_count").cast("string"), F.lit(T["extra_views"]))
    return out.withColumn(
        "score", c("view_count") + c("isometric_presence") + c("role_presence") + c("arrangement")
    ).withColumn("errors", errors).withColumn("warnings", messages((c("extra_count") > 0, extra)))


# ---- hatching ---------------------------------------------------------------------------------
def hatch_quality(df: DataFrame) -> DataFrame:
    """Quality and presence of a hatch candidate from its kept lines."""
    par, length, cover = c("parallel_ratio"), c("length_ratio"), c("coverage")
    angle = F.greatest(F.lit(0.0), 1.0 - F.least("angle_std", F.lit(15.0)) / 15.0)
    spacing = F.when(c("spacing_cv").isNull(), 0.40).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.least("spacing_cv", F.lit(1.1)) / 1.1))
    covered = F.when(cover < 0.0012, 0.0).when(cover > 0.35, 0.35).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.abs(cover - 0.12) / 0.12))
    strength = F.least(F.lit(1.0), 0.5 * par + 0.5 * F.least(F.lit(1.0), length / 1.6))
    return df.withColumn("quality", 0.30 * strength + 0.30 * angle + 0.25 * spacing + 0.15 * covered).withColumn(
        "present", all_of(c("line_count") >= 3, par >= 0.34, length >= 0.45, cover >= 0.0012))


ROLE_ORDER = ["front", "top", "side", "isometric"]


def role_rank(role):
    """Sort key of a role: front, top, side, isometric, then extras by number."""
    known = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), role)
    return F.when(known > 0, known).otherwise(4 + F.regexp_extract(role, r"(\d+)$", 1).cast("int"))


def hatch_candidate_rows(roles: DataFrame, measures: DataFrame) -> DataFrame:
    """One row per role of a drawing, in role order, with nullable hatch measures."""
    return roles.join(measures, ["drawing_id", "role"], "left").select(
        "drawing_id", "role", role_rank(c("role")).alias("ord"),
        F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("quality", F.lit(0.0)).alias("quality"),
        "angle_std", "parallel_ratio", "coverage", "spacing_cv")


def hatching_facts() -> list:
    """Aggregates over the candidates of a drawing: how many are present, and the best of them."""
    best = F.when(c("present"), F.struct("quality", (-c("ord")).alias("first")))
    return [F.count_if(c("present")).alias("detected"),
            F.max_by(F.struct("role", "quality", "angle_std", "spacing_cv", "coverage", "parallel_ratio"), best).alias("best")]


def hatching_points(df: DataFrame) -> DataFrame:
    """Score and messages from the best candidate; without one the module does not apply."""
    found = c("detected") > 0
    cover, par = F.coalesce("best.coverage", F.lit(0.0)), F.coalesce("best.parallel_ratio", F.lit(0.0))
    cv = c("best.spacing_cv")
    angle = ladder(F.coalesce("best.angle_std", F.lit(99.0)), [(3.5, 3), (6.5, 2), (10.0, 1)], 0, descending=False)
    spacing = F.when(cv.isNull(), 1).otherwise(ladder(cv, [(0.35, 2), (0.70, 1)], 0, descending=False))
    presence = ladder(c("best.quality"), [(0.55, 3), (0.35, 2)], 1)
    in_range = cover.between(0.004, 0.24)
    total = F.least(F.lit(10), presence + angle + spacing + flag(in_range) + flag(par >= 0.70))
    none = T["no_hatch"]
    return df.select(
        "*", found.alias("applicable"), c("best.role").alias("best_role"), F.when(found, total).otherwise(0).alias("score"),
        messages((found & (angle == 0), T["hatch_angle"]),
                 (found & (spacing == 0), T["hatch_spacing"]),
                 (found & (par < 0.34), T["hatch_parallel"])).alias("errors"),
        messages((~found, none), (found & cv.isNull(), T["hatch_spacing_unknown"]),
                 (found & ~in_range, T["hatch_coverage"])).alias("warnings"))


def score_hatching(candidates: DataFrame) -> DataFrame:
    """The best present candidate of each drawing decides. One grouping, combined before the shuffle."""
    return hatching_points(candidates.groupBy("drawing_id").agg(*hatching_facts()))


# ---- dimensions -------------------------------------------------------------------------------
def dimension_quality(df: DataFrame, stage: str = "final") -> DataFrame:
    """Evidence of dimensions around a view; the discovery stage needs one line, the final one two."""
    t, n, k = c("text_count"), c("line_count"), c("cluster_count")
    present = _dim_present(stage)
    share = lambda v, full: F.least(F.lit(1.0), v / float(full))
    quality = 0.35 * share(t, 8) + 0.35 * share(n, 8) + 0.30 * share(k, 4)
    return df.withColumn("dim_present", present).withColumn("quality", F.when(present, quality).otherwise(0.0))


def _dim_present(stage: str):
    lines = 1 if stage == "discover" else 2
    return (c("cluster_count") > 0) | ((c("text_count") >= 2) & (c("line_count") >= lines))


def dimension_facts(counts=None) -> list:
    """Aggregates over the views of a drawing for which ``counts`` holds (all without it)."""
    counts = F.lit(True) if counts is None else counts
    total = lambda n: F.coalesce(F.sum(F.when(counts, c(n))), F.lit(0))
    return [F.count_if(counts & _dim_present("final")).alias("roles"), total("text_count").alias("texts"),
            total("line_count").alias("lines"), total("cluster_count").alias("clusters")]


def score_dimensions(per_role: DataFrame) -> DataFrame:
    """From one row per (drawing, role) with text_count, line_count and kept cluster_count."""
    return dimension_points(per_role.groupBy("drawing_id").agg(*dimension_facts()))


def dimension_points(sums: DataFrame) -> DataFrame:
    roles, texts, lines, clusters = c("roles"), c("texts"), c("lines"), c("clusters")
    covered = ladder(roles, [(3, 6), (2, 4), (1, 2)], 0)
    text = ladder(texts, [(8, 4), (5, 3), (3, 2), (1, 1)], 0)
    line = ladder(lines + 2 * clusters, [(12, 3), (7, 2), (3, 1)], 0)
    outside = F.when(clusters > 0, 1.0).otherwise(0.0)  # a kept cluster always lies outside its view
    place = ladder(outside, [(0.82, 2), (0.62, 1)], 0)
    return sums.withColumn("score", F.least(F.lit(15), covered + text + line + place)).withColumn(
        "errors", messages((roles == 0, T["no_dimensions"]))
    ).withColumn("warnings", messages(
        (roles == 1, T["dimensions_one_view"]),
        (texts == 0, T["dimension_text_low"]),
        (lines == 0, T["dimension_lines_low"])))


# ---- line semantics ---------------------------------------------------------------------------
def line_facts(counts=None) -> list:
    """Aggregates over the views of a drawing for which ``counts`` holds (all without it)."""
    counts = F.lit(True) if counts is None else counts
    n = lambda cond: F.count_if(counts & cond)
    return [n(c("visible")).alias("visible_roles"), n(c("hidden_sequences") >= 1).alias("hidden_roles"),
            F.coalesce(F.sum(F.when(counts, c("hidden_sequences"))), F.lit(0)).alias("sequences"),
            n(c("center") != "none").alias("center_roles"), n(c("center") == "strong").alias("strong_roles")]


def score_line_semantics(per_role: DataFrame) -> DataFrame:
    """From one row per (drawing, role): visible, hidden_sequences, center ('strong', 'weak', 'none')."""
    return line_points(per_role.groupBy("drawing_id").agg(*line_facts()))


def line_points(sums: DataFrame) -> DataFrame:
    v, h, q, m, s = (c(n) for n in ("visible_roles", "hidden_roles", "sequences", "center_roles", "strong_roles"))
    visible = ladder(v, [(3, 5), (2, 3), (1, 1)], 0)
    hidden = F.when((h >= 2) | (q >= 3), 4).when((h == 1) & (q >= 1), 2).otherwise(0)
    center = F.when(s >= 1, 3).when(m >= 1, 2).otherwise(0)
    mixed = (F.when(all_of(v >= 3, h >= 1, m >= 1), 3).when((v >= 2) & ((h >= 1) | (m >= 1)), 2)
             .when(v >= 1, 1).otherwise(0))
    return sums.withColumn("score", F.least(F.lit(15), visible + hidden + center + mixed)).withColumn(
        "errors", messages((v == 0, T["no_contours"]))
    ).withColumn("warnings", messages(
        (v == 1, T["contours_one_view"]),
        (h == 0, T["hidden_low"]),
        (m == 0, T["center_low"]),
        ((s == 0) & (m >= 1), T["center_weak"])))


# ---- cleanliness ------------------------------------------------------------------------------
def score_cleanliness_free(df: DataFrame) -> DataFrame:
    sharp = ladder(c("sharpness"), [(180.0, 3), (80.0, 2), (35.0, 1)], 0)
    contrast = ladder(c("contrast"), [(110.0, 2), (70.0, 1)], 0)
    ratio, count = c("stray_ratio"), c("stray_count")
    ground = (F.when((ratio <= 0.0025) & (count <= 1), 3).when((ratio <= 0.0075) & (count <= 4), 2)
              .when(ratio <= 0.0180, 1).otherwise(0))
    edge = ladder(c("border_occ"), [(0.010, 2), (0.030, 1)], 0, descending=False)
    return df.withColumn("score", F.least(F.lit(10), sharp + contrast + ground + edge)).withColumn(
        "errors", F.array().cast("array<string>")
    ).withColumn("warnings", messages(
        (sharp <= 1, T["blurred"]),
        (contrast == 0, T["contrast_low"]),
        ((ground <= 1) & (count > 0), T["stray_marks"]),
        (edge == 0, T["tight_edge"])))


# ---- task compliance --------------------------------------------------------------------------
def with_requirements(df: DataFrame, text: str = "description") -> DataFrame:
    return df.select("*", *[v.alias(k) for k, v in task_requirements(c(text)).items()])


def score_task_compliance(df: DataFrame) -> DataFrame:
    """Requirements against evidence: orthographic_count, has_isometric, detected, dim_roles."""
    need, have, roles = c("required_views"), c("orthographic_count"), c("dim_roles")
    views = F.when(have >= need, 4).when(have == need - 1, 2).otherwise(0)
    iso_missing = c("requires_isometric") & ~c("has_isometric")
    section_missing = c("requires_section") & (c("detected") <= 0)
    dims = F.when(~c("requires_dimensions"), 2).otherwise(clip(roles, 0, 2))
    total = views + F.when(iso_missing, 0).otherwise(2) + F.when(section_missing, 0).otherwise(2) + dims
    short = F.concat(F.lit(T["views_short"]), need.cast("string"),
                     F.lit(T["views_found"]), have.cast("string"))
    return df.withColumn("score", F.least(F.lit(10), total)).withColumn("errors", messages(
        (have < need, short),
        (iso_missing, T["isometric_required"]),
        (section_missing, T["section_required"]),
        (c("requires_dimensions") & (roles < 1), T["dimensions_required"]),
    )).withColumn("warnings", messages(
        (c("requires_dimensions") & (roles == 1), T["dimensions_once"])))
