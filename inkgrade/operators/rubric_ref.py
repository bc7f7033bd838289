"""Rubric against a reference drawing: nine criteria worth 100 points.

Each scorer is a set of column expressions over one metrics row per submission; nothing here
shuffles except the sum over a submission's projections. A null measure without a stated default earns no points:
where the criterion has a reason column, it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgrade.functions.cols import all_of, any_of, at_least_one, clip, clip01, flag, ladder, points
from inkgrade.functions.texts import TEXTS as T

c = F.col

# The criteria of the comparison rubric.
CRITERIA = [  # order, key, criterion text, points
    (1, "frame", "Ramka + burchak shtampi", 3),
    (2, "placement", "Chizmani to'g'ri joylashtirish", 6),
    (3, "line_types", "Chiziq turlari", 8),
    (4, "dimension_marks", "O'lcham qo'yish", 12),
    (5, "projections", "Proyeksiyalar soni", 18),
    (6, "projection_sections", "Proyeksiyalarda qirqim bajarilganligi", 10),
    (7, "visible_view", "Yaqqol tasvir to'g'riligi", 24),
    (8, "visible_section", "Yaqqol tasvirda qirqim bajarilganligi", 15),
    (9, "cleanliness", "Chizma tozaligi", 4),
]


#: Reason for no points where a measure that a criterion needs is null.
MISSING = "not measured"


def _missing(*names):
    return any_of(*[c(n).isNull() for n in names])


def _gate(gate, score):
    return F.when(gate, 0).otherwise(score)


def score_frame(df: DataFrame) -> DataFrame:
    sim, cov = F.coalesce("similarity", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    miss, extra = F.coalesce("missing_ratio", F.lit(1.0)), F.coalesce("extra_ratio", F.lit(1.0))
    quality = 0.45 * sim + 0.25 * cov + 0.20 * (1.0 - miss) + 0.10 * (1.0 - F.least(extra, F.lit(1.0)))
    return df.withColumn("frame", _gate((sim < 0.12) | (cov < 0.12), points(quality * 3, 3)))


def score_placement(df: DataFrame) -> DataFrame:
    shift = F.hypot(c("stu_cx") - c("ref_cx"), c("stu_cy") - c("ref_cy"))
    near = clip01(1.0 - shift / F.greatest("width", "height") / 0.12)
    quality = 0.50 * c("coverage") + 0.35 * near + 0.15 * c("angle_sim")
    return df.withColumn("shift_q", near).withColumn(
        "placement", F.when(quality.isNull() | shift.isNull() | F.greatest("width", "height").isNull(), 0).otherwise(points(quality * 6, 6)))


def dash_ratio(st="st_dash", et="et_dash"):
    return (c(st) + 1) / (c(et) + 1)


def score_line_types(df: DataFrame) -> DataFrame:
    def diversity(side):
        return 0.6 * c(f"{side}_r9050") + 0.4 * c(f"{side}_r7525")

    ratio = c("stu_p50") / F.greatest("ref_p50", F.lit(1e-6))
    thick = clip01(1.0 - (F.greatest(ratio, 1.0 / ratio) - 1.0) / 0.80)
    st_q, et_q = (clip01((diversity(s) - 1.05) / (1.35 - 1.05)) for s in ("stu", "ref"))
    variety = clip01((1.0 - et_q) + et_q * st_q)
    dash = (
        F.when(c("et_dash") < 20, 1.0).when(c("st_dash") < 8, 0.0)
        .otherwise(clip01(c("st_dash") / at_least_one(c("et_dash"))))
    )
    quality = 0.45 * thick + 0.35 * variety + 0.20 * dash
    noisy = (c("st_dash") >= 70) & (dash_ratio() >= 2.2)
    unknown = _missing("stu_p50", "ref_p50")
    missing = _missing("stu_r9050", "stu_r7525", "ref_r9050", "ref_r7525", "st_dash", "et_dash")
    return df.withColumn(
        "line_types", F.when(unknown | missing, 0).otherwise(_gate(noisy, points(quality * 8, 8)))
    ).withColumn("line_types_reason", F.when(unknown, "too few strokes").when(missing, MISSING).when(noisy, "noisy dashes"))


def _known_similarity():
    return clip01(F.coalesce("similarity", F.lit(0.0)))


def score_dimension_marks(df: DataFrame) -> DataFrame:
    sim, cov = _known_similarity(), F.coalesce("coverage", F.lit(0.0))
    miss, extra = F.coalesce("missing_ratio", F.lit(1.0)), F.coalesce("extra_ratio", F.lit(0.0))
    few_long = c("st_long") < 0.12
    gates = [
        ((cov < 0.18) & (sim < 0.28), "hard_bad"),
        (all_of(c("st_dash") >= 90, dash_ratio() >= 2.6, few_long | (sim < 0.15)), "noise_bad"),
        (all_of(extra > 0.55, miss > 0.40, few_long), "extra_bad"),
        (all_of(sim <= 0.01, c("st_dash") >= 70, dash_ratio() >= 2.2), "noise_override"),
        (_missing("st_dim_area", "et_dim_area", "st_small_cnt", "et_small_cnt", "st_dash", "et_dash", "st_long"), MISSING),
    ]
    why = F.concat_ws(" + ", *[F.when(g, n) for g, n in gates])
    sparse = (c("et_dim_area") < 2000) & (c("et_small_cnt") < 12)
    part = lambda st, et: F.least(clip(c(st) / at_least_one(c(et)), 0.0, 1.2), F.lit(1.0))
    quality = 0.40 * part("st_dim_area", "et_dim_area") + 0.60 * part("st_small_cnt", "et_small_cnt")
    soft = F.when((c("st_dim_area") > 1500) | (c("st_small_cnt") >= 10), 12).otherwise(8)
    return df.withColumn("dimension_why", F.nullif(why, F.lit(""))).withColumn(
        "dimension_mode", F.when(c("dimension_why").isNotNull(), "GATED_TO_ZERO").when(sparse, "soft").otherwise("ratio")
    ).withColumn("dimension_marks", _gate(c("dimension_why").isNotNull(), F.when(sparse, soft).otherwise(points(quality * 12, 12))))


def score_projections(df: DataFrame) -> DataFrame:
    sim, cov = _known_similarity(), F.coalesce("coverage", F.lit(0.0))
    gate = ((cov < 0.18) & (sim < 0.28)) | ((sim <= 0.02) & (c("st_dash") >= 70))
    gate = gate | _missing("projection_count", "st_dash")
    return df.withColumn("projections", _gate(gate, 6 * clip(c("projection_count"), 0, 3)))


def section_votes(df: DataFrame) -> DataFrame:
    """Per projection: hybrid score, which rule found a section, and its share of the ten points."""
    stripes, lines, dom = c("stripe_count"), c("dom_line_count"), c("dom_ratio")
    std, cv, length, inside, gap = (c(n) for n in ("angle_std", "gap_cv", "mean_len_ratio", "interior_share", "median_gap_norm"))
    hybrid = (
        2.0 * flag(stripes >= 3) + 1.5 * flag(stripes >= 4) + 0.8 * flag(stripes >= 5)
        + 2.2 * clip01((dom - 0.55) / 0.30) + 1.6 * clip01((12.0 - std) / 12.0)
        + 1.2 * clip01((lines - 4) / 5.0) + 0.8 * clip01((inside - 0.02) / 0.08)
        + 0.8 * flag(gap.between(0.008, 0.22)) + 0.7 * flag(cv <= 1.25) - 4.0 * flag(stripes < 3)
        - 2.0 * flag(lines < 4) - 1.6 * flag(dom < 0.60) - 1.2 * flag(length > 0.80)
    )

    def vote(s, n, d, deviation, spread, low, high, interior):
        return all_of(stripes >= s, lines >= n, dom >= d, std <= deviation, cv <= spread,
                      length.between(low, high), inside >= interior)

    hint = (
        F.when(vote(4, 5, 0.72, 8.5, 1.25, 0.06, 0.75, 0.02), "cad")
        .when(vote(3, 4, 0.62, 12.0, 1.60, 0.05, 0.78, 0.015), "sketch")
        .when((hybrid >= 5.2) & (stripes >= 3), "hybrid").otherwise("weak")
    )
    return df.withColumn("hybrid_score", hybrid).withColumn("mode_hint", hint).withColumn(
        "is_section", c("mode_hint") != "weak")


def score_projection_sections(features: DataFrame) -> DataFrame:
    """Ten points over three projections; rounded to two decimals before it joins the total."""
    return section_votes(features).groupBy("submission_id").agg(
        F.bround(F.sum(flag(c("is_section"))) * (10.0 / 3.0), 2).alias("projection_sections"),
        F.sum(flag(c("is_section"))).alias("sections_found"))


def _balance(student, reference):
    ratio = c(student) / at_least_one(c(reference))
    return ratio, clip01(F.least(ratio, 1.0 / F.greatest(ratio, F.lit(1e-6))))


def _f1(a, b):
    return (2.0 * a * b) / F.greatest(a + b, F.lit(1e-9))


def _lift(cap, rows, *values):
    """Raise ``cap`` to each row's level when all values reach that row's bounds."""
    for level, *bounds in rows:
        cap = F.when(all_of(*[v >= b for v, b in zip(values, bounds)]), F.greatest(cap, F.lit(level))).otherwise(cap)
    return cap


def score_visible_view(df: DataFrame) -> DataFrame:
    ref, stu = c("view_ref_area"), c("view_stu_area")
    comp = c("view_found")
    corr = F.when(stu > 0, c("view_right")).otherwise(0.0)
    iou = c("view_iou")
    ratio, balance = _balance("view_stu_area", "view_ref_area")
    reason = (
        F.when(stu < F.greatest(F.lit(80), (0.15 * ref).cast("int")), T["view_area_small"])
        .when(comp < 0.18, T["view_not_drawn"])
        .when(ratio < 0.20, T["view_area_ratio"])
        .when((c("ref_diag") >= 0.16) & (c("stu_diag") < 0.05), T["view_no_diagonals"])
        .when(_missing("view_ref_area", "view_stu_area", "view_found", "view_iou", "ref_diag", "stu_diag"), MISSING)
        .when((stu > 0) & _missing("view_right"), MISSING)
    )
    quality = clip01(0.50 * _f1(comp, corr) + 0.22 * comp + 0.18 * corr + 0.10 * F.sqrt(F.greatest(iou, F.lit(0.0))))
    worst = F.least(comp, corr)
    cap = F.when(worst < 0.40, 6).when(worst < 0.58, 12).when(worst < 0.72, 18).when(worst < 0.84, 21).otherwise(24)
    cap = _lift(cap, [(20, 0.90, 0.58, 0.46, 0.50), (22, 0.92, 0.60, 0.50, 0.55), (24, 0.95, 0.68, 0.58, 0.62)],
                comp, corr, iou, balance)
    raw = 24.0 * F.pow(quality, F.lit(0.82))
    return df.withColumn("visible_view_reason", reason).withColumn(
        "visible_view", _gate(reason.isNotNull(), points(F.least(raw, cap), 24)))


def score_visible_section(df: DataFrame) -> DataFrame:
    ref, stu = c("sect_ref_area"), c("sect_stu_area")
    recall, iou = c("sect_found"), c("sect_iou")
    right = F.when(stu > 0, c("sect_right")).otherwise(0.0)
    _, balance = _balance("sect_stu_area", "sect_ref_area")
    reason = (
        F.when(ref < 120, T["section_no_reference"])
        .when(stu < F.greatest(F.lit(100), (0.12 * ref).cast("int")), T["section_missing"])
        .when(recall < 0.20, T["section_misplaced"])
        .when(_missing("sect_ref_area", "sect_stu_area", "sect_found", "sect_iou"), MISSING)
        .when((stu > 0) & _missing("sect_right"), MISSING)
    )
    quality = clip01(0.46 * _f1(recall, right) + 0.26 * recall + 0.16 * right + 0.12 * F.sqrt(F.greatest(iou, F.lit(0.0))))
    below = lambda a, b: (recall < a) | (right < b)
    cap = (F.when(below(0.40, 0.35), 5).when(below(0.60, 0.45), 9).when(below(0.78, 0.55), 12)
           .when(below(0.88, 0.65), 14).otherwise(15))
    cap = _lift(cap, [(13, 0.90, 0.58, 0.48, 0.45), (15, 0.93, 0.64, 0.54, 0.50)], recall, right, iou, balance)
    raw = 15.0 * F.pow(quality, F.lit(0.82))
    return df.withColumn("visible_section_reason", reason).withColumn(
        "visible_section", _gate(reason.isNotNull(), points(F.least(raw, cap), 15)))


def score_cleanliness_ref(df: DataFrame) -> DataFrame:
    """Points and the severity behind them; a null measure leaves the severity null and earns nothing."""
    missing = _missing(
        "ref_line_px", "out_line_px", "blob_px", "out_speck_cnt", "speck_cnt", "dirty_px", "blob_cnt")
    ref = at_least_one(c("ref_line_px"))
    share = lambda px, part: F.least(c(px) / (part * ref), F.lit(1.0))
    severity = clip01(
        0.38 * share("out_line_px", 0.12) + 0.30 * share("blob_px", 0.10)
        + 0.14 * F.least((c("out_speck_cnt") + c("speck_cnt")) / 45.0, F.lit(1.0)) + 0.18 * share("dirty_px", 0.18))
    cap = (
        F.when((c("out_line_px") > 0.22 * ref) | (c("blob_px") > 0.18 * ref), 1)
        .when(c("dirty_px") > 0.16 * ref, 2)
        .when((c("dirty_px") > 0.09 * ref) | (c("blob_cnt") >= 6), 3).otherwise(4)
    )
    raw = 4.0 * F.pow(1.0 - severity, F.lit(0.85))
    return df.withColumn("severity", F.when(~missing, severity)).withColumn(
        "cleanliness", _gate(missing, points(F.least(raw, cap), 4)))


ROW_SCORERS = [
    score_frame, score_placement, score_line_types, score_dimension_marks, score_projections,
    score_visible_view, score_visible_section, score_cleanliness_ref,
]
