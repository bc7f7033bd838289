"""Queries that score metrics tables with both rubrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrade.functions.boxes import SIDES
from inkgrade.operators import rubric_free as free, rubric_ref as ref
from inkgrade.plans.catalog import query

c = F.col


def _pts(expr: str, top: int) -> str:
    return f"CAST(least(greatest(round_even({expr}, 0), 0), {top}) AS INT)"


def _clip01(expr: str) -> str:
    return f"least(greatest({expr}, 0.0), 1.0)"


def _text(col):
    return F.array_join(col, "; ")


@query("score_frame", f"""SELECT submission_id, CASE WHEN similarity < 0.12 OR coverage < 0.12 THEN 0
  ELSE {_pts('3 * (0.45 * similarity + 0.25 * coverage + 0.20 * (1.0 - missing_ratio) + 0.10 * (1.0 - least(extra_ratio, 1.0)))', 3)} END AS frame
FROM {{ref_features}}""")
def _(t):
    return ref.score_frame(t.ref_features).select("submission_id", "frame")


@query("score_placement", f"""WITH q AS (SELECT *, {_clip01('1.0 - sqrt((stu_cx - ref_cx) * (stu_cx - ref_cx) + (stu_cy - ref_cy) * (stu_cy - ref_cy)) / greatest(width, height) / 0.12')} AS near,
  stu_cx IS NULL OR ref_cx IS NULL AS gone FROM {{ref_features}})
SELECT submission_id, CASE WHEN gone THEN 0 ELSE {_pts('6 * (0.50 * coverage + 0.35 * near + 0.15 * angle_sim)', 6)} END AS placement FROM q""")
def _(t):
    return ref.score_placement(t.ref_features).select("submission_id", "placement")


@query("score_line_types", f"""WITH a AS (SELECT *, stu_p50 / ref_p50 AS tr, 0.6 * ref_r9050 + 0.4 * ref_r7525 AS de, 0.6 * stu_r9050 + 0.4 * stu_r7525 AS ds,
  (st_dash + 1) / (et_dash + 1) AS dr FROM {{ref_features}}),
b AS (SELECT *, {_clip01('1.0 - (greatest(tr, 1.0 / tr) - 1.0) / 0.80')} AS thick, {_clip01('(de - 1.05) / (1.35 - 1.05)')} AS eq, {_clip01('(ds - 1.05) / (1.35 - 1.05)')} AS sq,
  CASE WHEN et_dash < 20 THEN 1.0 WHEN st_dash < 8 THEN 0.0 ELSE {_clip01('st_dash / greatest(et_dash, 1)')} END AS dq FROM a)
SELECT submission_id, CASE WHEN stu_p50 IS NULL OR ref_p50 IS NULL THEN 0 WHEN st_dash >= 70 AND dr >= 2.2 THEN 0
  ELSE {_pts('8 * (0.45 * thick + 0.35 * ' + _clip01('(1.0 - eq) + eq * sq') + ' + 0.20 * dq)', 8)} END AS line_types,
  CASE WHEN stu_p50 IS NULL OR ref_p50 IS NULL THEN 'too few strokes' WHEN st_dash >= 70 AND dr >= 2.2 THEN 'noisy dashes' END AS line_types_reason FROM b""")
def _(t):
    return ref.score_line_types(t.ref_features).select("submission_id", "line_types", "line_types_reason")


@query("score_dimension_marks", f"""WITH a AS (SELECT *, {_clip01('similarity')} AS sim, (st_dash + 1) / (et_dash + 1) AS dr FROM {{ref_features}}),
g AS (SELECT *, coverage < 0.18 AND sim < 0.28 AS g1, st_dash >= 90 AND dr >= 2.6 AND (st_long < 0.12 OR sim < 0.15) AS g2,
  extra_ratio > 0.55 AND missing_ratio > 0.40 AND st_long < 0.12 AS g3, sim <= 0.01 AND st_dash >= 70 AND dr >= 2.2 AS g4,
  least(greatest(st_dim_area / greatest(et_dim_area, 1), 0.0), 1.2) AS ar, least(greatest(st_small_cnt / greatest(et_small_cnt, 1), 0.0), 1.2) AS cr FROM a)
SELECT submission_id,
  CASE WHEN g1 OR g2 OR g3 OR g4 THEN 0 WHEN et_dim_area < 2000 AND et_small_cnt < 12 THEN CASE WHEN st_dim_area > 1500 OR st_small_cnt >= 10 THEN 12 ELSE 8 END
       ELSE {_pts('12 * (0.40 * least(ar, 1.0) + 0.60 * least(cr, 1.0))', 12)} END AS dimension_marks,
  CASE WHEN g1 OR g2 OR g3 OR g4 THEN 'GATED_TO_ZERO' WHEN et_dim_area < 2000 AND et_small_cnt < 12 THEN 'soft' ELSE 'ratio' END AS dimension_mode,
  nullif(concat_ws(' + ', CASE WHEN g1 THEN 'hard_bad' END, CASE WHEN g2 THEN 'noise_bad' END, CASE WHEN g3 THEN 'extra_bad' END, CASE WHEN g4 THEN 'noise_override' END), '') AS dimension_why
FROM g""")
def _(t):
    return ref.score_dimension_marks(t.ref_features).select("submission_id", "dimension_marks", "dimension_mode", "dimension_why")


@query("score_projections", f"""SELECT submission_id, CASE WHEN (coverage < 0.18 AND {_clip01('similarity')} < 0.28) OR ({_clip01('similarity')} <= 0.02 AND st_dash >= 70) THEN 0
  ELSE 6 * least(greatest(projection_count, 0), 3) END AS projections FROM {{ref_features}}""")
def _(t):
    return ref.score_projections(t.ref_features).select("submission_id", "projections")


@query("section_votes", f"""WITH h AS (SELECT *, 2.0 * (stripe_count >= 3)::INT + 1.5 * (stripe_count >= 4)::INT + 0.8 * (stripe_count >= 5)::INT
  + 2.2 * {_clip01('(dom_ratio - 0.55) / 0.30')} + 1.6 * {_clip01('(12.0 - angle_std) / 12.0')} + 1.2 * {_clip01('(dom_line_count - 4) / 5.0')}
  + 0.8 * {_clip01('(interior_share - 0.02) / 0.08')} + 0.8 * (median_gap_norm BETWEEN 0.008 AND 0.22)::INT + 0.7 * (gap_cv <= 1.25)::INT
  - 4.0 * (stripe_count < 3)::INT - 2.0 * (dom_line_count < 4)::INT - 1.6 * (dom_ratio < 0.60)::INT - 1.2 * (mean_len_ratio > 0.80)::INT AS hs FROM {{hatch_features}})
SELECT submission_id, projection, round(hs, 6) AS hybrid_score, CASE
  WHEN stripe_count >= 4 AND dom_line_count >= 5 AND dom_ratio >= 0.72 AND angle_std <= 8.5 AND gap_cv <= 1.25 AND mean_len_ratio BETWEEN 0.06 AND 0.75 AND interior_share >= 0.02 THEN 'cad'
  WHEN stripe_count >= 3 AND dom_line_count >= 4 AND dom_ratio >= 0.62 AND angle_std <= 12.0 AND gap_cv <= 1.60 AND mean_len_ratio BETWEEN 0.05 AND 0.78 AND interior_share >= 0.015 THEN 'sketch'
  WHEN hs >= 5.2 AND stripe_count >= 3 THEN 'hybrid' ELSE 'weak' END AS mode_hint FROM h""")
def _(t):
    return ref.section_votes(t.hatch_features).select(
        "submission_id", "projection", F.round("hybrid_score", 6).alias("hybrid_score"), "mode_hint")


@query("score_projection_sections", """SELECT submission_id, round_even(count(*) FILTER (mode_hint <> 'weak') * (10.0::DOUBLE / 3.0), 2) AS projection_sections,
  count(*) FILTER (mode_hint <> 'weak') AS sections_found FROM {section_votes} GROUP BY submission_id""")
def _(t):
    return ref.score_projection_sections(t.hatch_features)


@query("score_visible_view", f"""WITH a AS (SELECT *, view_found AS comp, CASE WHEN view_stu_area > 0 THEN view_right ELSE 0.0 END AS corr, view_iou AS iou,
  view_stu_area / greatest(view_ref_area, 1) AS ar FROM {{ref_features}}),
b AS (SELECT *, {_clip01('least(ar, 1.0 / greatest(ar, 1e-6))')} AS bal, least(comp, corr) AS worst,
  {_clip01('0.50 * (2.0 * comp * corr / greatest(comp + corr, 1e-9)) + 0.22 * comp + 0.18 * corr + 0.10 * sqrt(greatest(iou, 0.0))')} AS qual,
  CASE WHEN view_stu_area < greatest(80, trunc(0.15 * view_ref_area)) THEN 'student_visible_area_too_small' WHEN comp < 0.18 THEN 'student_did_not_draw_visible_view'
       WHEN ar < 0.20 THEN 'visible_view_area_ratio_too_small' WHEN ref_diag >= 0.16 AND stu_diag < 0.05 THEN 'student_has_no_visible_view_diagonal_structure' END AS why FROM a),
k AS (SELECT *, CASE WHEN worst < 0.40 THEN 6 WHEN worst < 0.58 THEN 12 WHEN worst < 0.72 THEN 18 WHEN worst < 0.84 THEN 21 ELSE 24 END AS cap0 FROM b),
m AS (SELECT *, greatest(cap0, CASE WHEN comp >= 0.95 AND corr >= 0.68 AND iou >= 0.58 AND bal >= 0.62 THEN 24 WHEN comp >= 0.92 AND corr >= 0.60 AND iou >= 0.50 AND bal >= 0.55 THEN 22
  WHEN comp >= 0.90 AND corr >= 0.58 AND iou >= 0.46 AND bal >= 0.50 THEN 20 ELSE 0 END) AS cap FROM k)
SELECT submission_id, why AS visible_view_reason, CASE WHEN why IS NOT NULL THEN 0 ELSE {_pts('least(24.0 * pow(qual, 0.82), cap)', 24)} END AS visible_view FROM m""")
def _(t):
    return ref.score_visible_view(t.ref_features).select("submission_id", "visible_view", "visible_view_reason")


@query("score_visible_section", f"""WITH a AS (SELECT *, sect_found AS r, CASE WHEN sect_stu_area > 0 THEN sect_right ELSE 0.0 END AS p, sect_iou AS iou,
  sect_stu_area / greatest(sect_ref_area, 1) AS ar FROM {{ref_features}}),
b AS (SELECT *, {_clip01('least(ar, 1.0 / greatest(ar, 1e-6))')} AS bal,
  {_clip01('0.46 * (2.0 * r * p / greatest(r + p, 1e-9)) + 0.26 * r + 0.16 * p + 0.12 * sqrt(greatest(iou, 0.0))')} AS qual,
  CASE WHEN sect_ref_area < 120 THEN 'reference_section_region_not_found_or_invalid_roi' WHEN sect_stu_area < greatest(100, trunc(0.12 * sect_ref_area)) THEN 'student_has_no_section_region'
       WHEN r < 0.20 THEN 'student_section_not_in_correct_place' END AS why FROM a),
k AS (SELECT *, greatest(CASE WHEN r < 0.40 OR p < 0.35 THEN 5 WHEN r < 0.60 OR p < 0.45 THEN 9 WHEN r < 0.78 OR p < 0.55 THEN 12 WHEN r < 0.88 OR p < 0.65 THEN 14 ELSE 15 END,
  CASE WHEN r >= 0.93 AND p >= 0.64 AND iou >= 0.54 AND bal >= 0.50 THEN 15 WHEN r >= 0.90 AND p >= 0.58 AND iou >= 0.48 AND bal >= 0.45 THEN 13 ELSE 0 END) AS cap FROM b)
SELECT submission_id, why AS visible_section_reason, CASE WHEN why IS NOT NULL THEN 0 ELSE {_pts('least(15.0 * pow(qual, 0.82), cap)', 15)} END AS visible_section FROM k""")
def _(t):
    return ref.score_visible_section(t.ref_features).select("submission_id", "visible_section", "visible_section_reason")


@query("score_cleanliness_ref", f"""WITH a AS (SELECT *, greatest(ref_line_px, 1) AS r FROM {{ref_features}}),
b AS (SELECT *, {_clip01('0.38 * least(out_line_px / (0.12 * r), 1.0) + 0.30 * least(blob_px / (0.10 * r), 1.0) + 0.14 * least((out_speck_cnt + speck_cnt) / 45.0, 1.0) + 0.18 * least(dirty_px / (0.18 * r), 1.0)')} AS sev,
  CASE WHEN out_line_px > 0.22 * r OR blob_px > 0.18 * r THEN 1 WHEN dirty_px > 0.16 * r THEN 2 WHEN dirty_px > 0.09 * r OR blob_cnt >= 6 THEN 3 ELSE 4 END AS cap FROM a)
SELECT submission_id, round(sev, 6) AS severity, {_pts('least(4.0 * pow(1.0 - sev, 0.85), cap)', 4)} AS cleanliness FROM b""")
def _(t):
    return ref.score_cleanliness_ref(t.ref_features).select("submission_id", F.round("severity", 6).alias("severity"), "cleanliness")


# ---- stand-alone rubric -------------------------------------------------------------------------
def _wide(t):
    """role_wide with its columns gathered into one struct per role."""
    def role(name, p):
        return F.struct(*[c(p + s).alias(s) for s in SIDES]).alias(name)
    return t.role_wide.select("drawing_id", "orthographic_count", "has_isometric", "extra_count",
                              role("front", "f"), role("top", "t"), role("side", "s"))


@query("score_view_count", """SELECT drawing_id, CASE WHEN orthographic_count >= 3 THEN 6 WHEN orthographic_count = 2 THEN 4 WHEN orthographic_count = 1 THEN 2 ELSE 0 END AS view_count FROM {role_wide}""")
def _(t):
    return free.score_view_count(_wide(t)).select("drawing_id", "view_count")


@query("score_isometric", "SELECT drawing_id, CASE WHEN has_isometric THEN 2 ELSE 0 END AS isometric_presence FROM {role_wide}")
def _(t):
    return free.score_isometric(_wide(t)).select("drawing_id", "isometric_presence")


@query("score_role_presence", "SELECT drawing_id, (fx1 IS NOT NULL)::INT + (tx1 IS NOT NULL)::INT + (sx1 IS NOT NULL)::INT AS role_presence FROM {role_wide}")
def _(t):
    return free.score_role_presence(_wide(t)).select("drawing_id", "role_presence")


@query("score_arrangement", """SELECT drawing_id, coalesce(ty1 + ty2 > fy1 + fy2, false) AS top_direction_ok,
  coalesce(greatest(least(fx2, tx2) - greatest(fx1, tx1), 0) / greatest(1, least(fx2 - fx1, tx2 - tx1)) >= 0.18, false) AND fx1 IS NOT NULL AND tx1 IS NOT NULL AS top_alignment_ok,
  coalesce(abs(sx1 + sx2 - fx1 - fx2) > 10, false) AS side_direction_ok,
  coalesce(greatest(least(fy2, sy2) - greatest(fy1, sy1), 0) / greatest(1, least(fy2 - fy1, sy2 - sy1)) >= 0.18, false) AND fx1 IS NOT NULL AND sx1 IS NOT NULL AS side_alignment_ok,
  CASE WHEN fx1 IS NULL THEN 0 ELSE top_direction_ok::INT + top_alignment_ok::INT + side_direction_ok::INT + side_alignment_ok::INT END AS arrangement FROM {role_wide}""")
def _(t):
    return free.score_arrangement(_wide(t)).select(
        "drawing_id", "top_direction_ok", "top_alignment_ok", "side_direction_ok", "side_alignment_ok", "arrangement")


@query("score_completeness", """SELECT w.drawing_id, v.view_count + i.isometric_presence + r.role_presence + a.arrangement AS score,
  concat_ws('; ', CASE WHEN orthographic_count >= 3 THEN NULL WHEN orthographic_count = 2 THEN 'Bitta asosiy proyeksiya yetishmaydi' WHEN orthographic_count = 1 THEN 'Kamida ikkita asosiy proyeksiya yetishmaydi' ELSE 'Asosiy proyeksiyalar topilmadi' END,
    CASE WHEN NOT has_isometric THEN 'Yaqqol tasvir topilmadi' END, CASE WHEN fx1 IS NULL THEN 'FRONT view aniqlanmadi' END, CASE WHEN tx1 IS NULL THEN 'TOP view aniqlanmadi' END,
    CASE WHEN sx1 IS NULL THEN 'SIDE view aniqlanmadi' END, CASE WHEN fx1 IS NULL THEN 'Arrangement tekshirish uchun FRONT yo‘q' ELSE
    nullif(concat_ws('; ', CASE WHEN tx1 IS NULL THEN 'TOP view yo‘qligi sabab arrangement tekshirilmadi' END,
      CASE WHEN tx1 IS NOT NULL AND NOT top_direction_ok THEN 'TOP view FRONT''ga nisbatan noto‘g‘ri tomonda' END,
      CASE WHEN tx1 IS NOT NULL AND NOT top_alignment_ok THEN 'TOP view FRONT bilan vertikal o‘qda yetarli mos emas' END,
      CASE WHEN sx1 IS NULL THEN 'SIDE view yo‘qligi sabab arrangement tekshirilmadi' END,
      CASE WHEN sx1 IS NOT NULL AND NOT side_direction_ok THEN 'SIDE view FRONT''ga nisbatan chap/o‘ngda joylashmagan' END,
      CASE WHEN sx1 IS NOT NULL AND NOT side_alignment_ok THEN 'SIDE view FRONT bilan gorizontal o‘qda yetarli mos emas' END), '') END) AS errors,
  CASE WHEN extra_count > 0 THEN extra_count || ' ta ortiqcha orthographic region mavjud yoki roli aniqlanmagan' ELSE '' END AS warnings
FROM {role_wide} w JOIN {score_view_count} v USING (drawing_id) JOIN {score_isometric} i USING (drawing_id) JOIN {score_role_presence} r USING (drawing_id) JOIN {score_arrangement} a USING (drawing_id)""")
def _(t):
    return free.score_completeness(_wide(t)).select("drawing_id", "score", _text("errors").alias("errors"), _text("warnings").alias("warnings"))


@query("hatch_quality", """SELECT drawing_id, role, round(0.30 * least(1.0, 0.5 * parallel_ratio + 0.5 * least(1.0, length_ratio / 1.6))
  + 0.30 * greatest(0.0, 1.0 - least(angle_std, 15.0) / 15.0)
  + 0.25 * CASE WHEN spacing_cv IS NULL THEN 0.40 ELSE greatest(0.0, 1.0 - least(spacing_cv, 1.1) / 1.1) END
  + 0.15 * CASE WHEN coverage < 0.0012 THEN 0.0 WHEN coverage > 0.35 THEN 0.35 ELSE greatest(0.0, 1.0 - abs(coverage - 0.12) / 0.12) END, 9) AS quality,
  line_count >= 3 AND parallel_ratio >= 0.34 AND length_ratio >= 0.45 AND coverage >= 0.0012 AS present FROM {hatch_measures}""")
def _(t):
    return free.hatch_quality(t.hatch_measures).select("drawing_id", "role", F.round("quality", 9).alias("quality"), "present")


@query("hatch_candidate_rows", """SELECT b.drawing_id, b.role, CASE WHEN b.seq <= 4 THEN b.seq ELSE b.seq END AS ord, coalesce(q.present, false) AS present,
  coalesce(q.quality, 0.0) AS quality, m.angle_std, m.parallel_ratio, m.coverage, m.spacing_cv
FROM {role_boxes} b LEFT JOIN {hatch_quality} q USING (drawing_id, role) LEFT JOIN {hatch_measures} m USING (drawing_id, role)""")
def _(t):
    return free.hatch_candidate_rows(t.role_boxes.select("drawing_id", "role"), free.hatch_quality(t.hatch_measures)).withColumn(
        "quality", F.round("quality", 9))


@query("score_hatching", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY quality DESC, ord) AS k FROM {hatch_candidate_rows} WHERE present),
s AS (SELECT *, CASE WHEN quality >= 0.55 THEN 3 WHEN quality >= 0.35 THEN 2 ELSE 1 END AS s1, CASE WHEN angle_std <= 3.5 THEN 3 WHEN angle_std <= 6.5 THEN 2 WHEN angle_std <= 10 THEN 1 ELSE 0 END AS s2,
  CASE WHEN spacing_cv IS NULL THEN 1 WHEN spacing_cv <= 0.35 THEN 2 WHEN spacing_cv <= 0.70 THEN 1 ELSE 0 END AS s3, coverage BETWEEN 0.004 AND 0.24 AS ok FROM p WHERE k = 1)
SELECT d.drawing_id, d.detected, s.role IS NOT NULL AS applicable, s.role AS best_role, CASE WHEN s.role IS NULL THEN 0 ELSE least(10, s1 + s2 + s3 + ok::INT + (parallel_ratio >= 0.70)::INT) END AS score,
  CASE WHEN s.role IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN s2 = 0 THEN 'Hatch chiziqlari burchagi yetarli darajada bir xil emas' END, CASE WHEN s3 = 0 THEN 'Hatch chiziqlari oralig‘i notekis' END) END AS errors,
  CASE WHEN s.role IS NULL THEN 'Hatch/qirqim topilmadi. Keyin task compliance moduli qirqim talab qilingan-qilinmaganini tekshiradi.' ELSE
    concat_ws('; ', CASE WHEN spacing_cv IS NULL THEN 'Hatch spacing regularity to‘liq baholanmadi' END, CASE WHEN NOT ok THEN 'Hatch coverage juda kichik yoki juda katta ko‘rinadi' END) END AS warnings
FROM (SELECT drawing_id, count(*) FILTER (present) AS detected FROM {hatch_candidate_rows} GROUP BY drawing_id) d LEFT JOIN s USING (drawing_id)""")
def _(t):
    rows = free.hatch_candidate_rows(t.role_boxes.select("drawing_id", "role"), free.hatch_quality(t.hatch_measures))
    return free.score_hatching(rows.withColumn("quality", F.round("quality", 9))).select(
        "drawing_id", "detected", "applicable", "best_role", "score", _text("errors").alias("errors"), _text("warnings").alias("warnings"))


@query("dimension_quality", """SELECT drawing_id, role, cluster_count > 0 OR (text_count >= 2 AND line_count >= 1) AS dim_present,
  CASE WHEN cluster_count > 0 OR (text_count >= 2 AND line_count >= 1) THEN round(0.35 * least(1.0, text_count / 8) + 0.35 * least(1.0, line_count / 8) + 0.30 * least(1.0, cluster_count / 4), 9) ELSE 0.0 END AS quality
FROM {role_evidence}""")
def _(t):
    return free.dimension_quality(t.role_evidence, "discover").select("drawing_id", "role", "dim_present", F.round("quality", 9).alias("quality"))


@query("score_dimensions", """WITH a AS (SELECT drawing_id, count(*) FILTER (cluster_count > 0 OR (text_count >= 2 AND line_count >= 2)) AS roles, sum(text_count)::BIGINT AS texts,
  sum(line_count)::BIGINT AS lines, sum(cluster_count)::BIGINT AS clusters FROM {role_evidence} GROUP BY drawing_id)
SELECT *, least(15, CASE WHEN roles >= 3 THEN 6 WHEN roles = 2 THEN 4 WHEN roles = 1 THEN 2 ELSE 0 END + CASE WHEN texts >= 8 THEN 4 WHEN texts >= 5 THEN 3 WHEN texts >= 3 THEN 2 WHEN texts >= 1 THEN 1 ELSE 0 END
  + CASE WHEN lines + 2 * clusters >= 12 THEN 3 WHEN lines + 2 * clusters >= 7 THEN 2 WHEN lines + 2 * clusters >= 3 THEN 1 ELSE 0 END + CASE WHEN clusters > 0 THEN 2 ELSE 0 END) AS score,
  CASE WHEN roles = 0 THEN 'Asosiy ko‘rinishlar atrofida o‘lcham evidence topilmadi' ELSE '' END AS errors,
  concat_ws('; ', CASE WHEN roles = 1 THEN 'O‘lchamlar faqat bitta ko‘rinishda aniq ko‘rindi' END, CASE WHEN texts = 0 THEN 'O‘lcham matni/raqamlariga oid evidence juda kam' END,
    CASE WHEN lines = 0 THEN 'Dimension line evidence juda kam' END) AS warnings FROM a""")
def _(t):
    return free.score_dimensions(t.role_evidence).withColumn("errors", _text("errors")).withColumn("warnings", _text("warnings"))


@query("score_line_semantics", """WITH a AS (SELECT drawing_id, count(*) FILTER (visible) AS v, count(*) FILTER (hidden_sequences >= 1) AS h, sum(hidden_sequences)::BIGINT AS q,
  count(*) FILTER (center <> 'none') AS m, count(*) FILTER (center = 'strong') AS s FROM {role_evidence} GROUP BY drawing_id)
SELECT drawing_id, v AS visible_roles, h AS hidden_roles, q AS sequences, m AS center_roles, s AS strong_roles,
  least(15, CASE WHEN v >= 3 THEN 5 WHEN v = 2 THEN 3 WHEN v = 1 THEN 1 ELSE 0 END + CASE WHEN h >= 2 OR q >= 3 THEN 4 WHEN h = 1 AND q >= 1 THEN 2 ELSE 0 END
  + CASE WHEN s >= 1 THEN 3 WHEN m >= 1 THEN 2 ELSE 0 END + CASE WHEN v >= 3 AND h >= 1 AND m >= 1 THEN 3 WHEN v >= 2 AND (h >= 1 OR m >= 1) THEN 2 WHEN v >= 1 THEN 1 ELSE 0 END) AS score,
  CASE WHEN v = 0 THEN 'Asosiy kontur chiziqlari evidence topilmadi' ELSE '' END AS errors,
  concat_ws('; ', CASE WHEN v = 1 THEN 'Kontur chiziqlari faqat bitta ko‘rinishda aniq ko‘rindi' END, CASE WHEN h = 0 THEN 'Shtrix/yashirin chiziqlar evidence juda kam' END,
    CASE WHEN m = 0 THEN 'Markaz chiziqlari evidence topilmadi yoki juda sust' END, CASE WHEN s = 0 AND m >= 1 THEN 'Markaz chiziqlari kuchsiz evidence bilan topildi' END) AS warnings FROM a""")
def _(t):
    return free.score_line_semantics(t.role_evidence).withColumn("errors", _text("errors")).withColumn("warnings", _text("warnings"))


@query("score_cleanliness_free", """WITH a AS (SELECT *, CASE WHEN sharpness >= 180 THEN 3 WHEN sharpness >= 80 THEN 2 WHEN sharpness >= 35 THEN 1 ELSE 0 END AS s1,
  CASE WHEN contrast >= 110 THEN 2 WHEN contrast >= 70 THEN 1 ELSE 0 END AS s2,
  CASE WHEN stray_ratio <= 0.0025 AND stray_count <= 1 THEN 3 WHEN stray_ratio <= 0.0075 AND stray_count <= 4 THEN 2 WHEN stray_ratio <= 0.018 THEN 1 ELSE 0 END AS s3,
  CASE WHEN border_occ <= 0.010 THEN 2 WHEN border_occ <= 0.030 THEN 1 ELSE 0 END AS s4 FROM {clean_facts})
SELECT drawing_id, least(10, s1 + s2 + s3 + s4) AS score, concat_ws('; ', CASE WHEN s1 <= 1 THEN 'Rasmning aniqligi past yoki biroz xira ko‘rinadi' END,
  CASE WHEN s2 = 0 THEN 'Kontrast past, chiziqlar ajralishi sust bo‘lishi mumkin' END, CASE WHEN s3 <= 1 AND stray_count > 0 THEN 'Asosiy zonalardan tashqarida ortiqcha shovqin/kir belgilari mavjud' END,
  CASE WHEN s4 = 0 THEN 'Chizma chetga juda yaqin yoki crop juda tig‘iz' END) AS warnings FROM a""")
def _(t):
    return free.score_cleanliness_free(t.clean_facts).select("drawing_id", "score", _text("warnings").alias("warnings"))


REQ_SQL = r"""coalesce(try_cast(nullif(regexp_extract(lower(trim(description)), '(\d+)\s*(?:ta\s*)?(?:proyeksiya|proeksiya|ko[''‘’`]?rinish|korinish|вид|вида|views?)', 1), '') AS INT),
  try_cast(nullif(regexp_extract(lower(trim(description)), '(?:proyeksiya|proeksiya|ko[''‘’`]?rinish|korinish|вид|views?)\s*(\d+)', 1), '') AS INT), 3) AS required_views,
  regexp_matches(lower(description), 'yaqqol|aksonometriya|axonometry|isometric|izometrik|аксонометр|изометр') AS requires_isometric,
  regexp_matches(lower(description), 'qirqim|kesim|section|razrez|разрез|сечение') AS requires_section, true AS requires_dimensions"""


@query("task_requirements", f"SELECT task_id, {REQ_SQL} FROM {{task_text}}")
def _(t):
    return free.with_requirements(t.task_text).drop("description")


@query("score_task_compliance", f"""WITH a AS (SELECT *, {REQ_SQL} FROM {{compliance_facts}})
SELECT drawing_id, least(10, CASE WHEN orthographic_count >= required_views THEN 4 WHEN orthographic_count = required_views - 1 THEN 2 ELSE 0 END
  + CASE WHEN requires_isometric AND NOT has_isometric THEN 0 ELSE 2 END + CASE WHEN requires_section AND detected = 0 THEN 0 ELSE 2 END + least(dim_roles, 2)) AS score,
  concat_ws('; ', CASE WHEN orthographic_count < required_views THEN 'Talab qilingan proyeksiyalar soni yetarli emas: kerak=' || required_views || ', topildi=' || orthographic_count END,
    CASE WHEN requires_isometric AND NOT has_isometric THEN 'Topshiriqda yaqqol tasvir talab qilingan, lekin topilmadi' END,
    CASE WHEN requires_section AND detected = 0 THEN 'Topshiriqda qirqim/kesim talab qilingan, lekin evidence topilmadi' END,
    CASE WHEN dim_roles = 0 THEN 'Topshiriqda o‘lcham qo‘yish talab qilingan, lekin dimension evidence topilmadi' END) AS errors,
  CASE WHEN dim_roles = 1 THEN 'O‘lcham evidence bor, lekin faqat bitta ko‘rinishda aniq topildi' ELSE '' END AS warnings FROM a""")
def _(t):
    return free.score_task_compliance(free.with_requirements(t.compliance_facts)).select(
        "drawing_id", "score", _text("errors").alias("errors"), _text("warnings").alias("warnings"))
