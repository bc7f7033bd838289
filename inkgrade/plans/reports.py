"""Queries that normalise scorer output and assemble reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrade.functions import text
from inkgrade.operators import report
from inkgrade.plans.catalog import query

c = F.col


def _join(col):
    return F.array_join(col, "; ")


def _words(col):
    """Message column of a fixture: '|'-separated text to an array, empty text to an empty array."""
    return F.filter(F.split(col, r"\|"), lambda w: w != "")


def _modules(df):
    return df.withColumn("errors", _words("error_text")).withColumn("warnings", _words("warning_text"))


_TRUE = "(json_type(json, '$.{k}') IS NOT NULL AND json_type(json, '$.{k}') <> 'NULL' AND CAST(json_extract(json, '$.{k}') AS VARCHAR) NOT IN ('{{}}', '[]', '\"\"', '0', '0.0', 'false'))"


def _pick(keys, how="CAST(json_extract(json, '$.{k}') AS VARCHAR)"):
    return "CASE " + " ".join(f"WHEN {_TRUE.replace('{k}', k)} THEN {how.replace('{k}', k)}" for k in keys) + " END"


def _kind(keys):
    return _pick(keys, "json_type(json, '$.{k}')")


_SCORE = "coalesce(" + ", ".join(f"json_extract_string(json, '$.{k}')" for k in report.SCORE_KEYS) + ")"


@query("normalize_results", f"""SELECT submission_id, try_cast({_SCORE} AS DOUBLE) AS total_score,
  coalesce({_pick(report.DETAIL_KEYS)}, '{{{{}}}}') AS ai_json_result,
  {_pick(report.OVERLAY_KEYS, "json_extract_string(json, '$.{k}')")} AS overlay_path,
  CASE {_kind(report.TABLE_KEYS)} WHEN 'OBJECT' THEN '[' || {_pick(report.TABLE_KEYS)} || ']' WHEN 'ARRAY' THEN {_pick(report.TABLE_KEYS)} ELSE '[]' END AS table_json,
  CASE WHEN {_SCORE} IS NULL THEN 'total_score not found' WHEN try_cast({_SCORE} AS DOUBLE) IS NULL THEN 'total_score is not a number' END AS error
FROM {{raw_results}}""")
def _(t):
    return report.normalize_results(t.raw_results).drop("json")


@query("flatten_report", """WITH RECURSIVE f AS (SELECT submission_id, k AS key, json_extract(json, '$."' || k || '"') AS v
  FROM (SELECT submission_id, json, unnest(json_keys(json)) AS k FROM {raw_results})
  UNION ALL SELECT submission_id, key || '.' || k, json_extract(v, '$."' || k || '"') FROM (SELECT submission_id, key, v, unnest(json_keys(v)) AS k FROM f WHERE json_type(v) = 'OBJECT'))
SELECT submission_id, key, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') WHEN json_type(v) = 'NULL' THEN NULL ELSE CAST(v AS VARCHAR) END AS value
FROM f WHERE json_type(v) IS NULL OR json_type(v) <> 'OBJECT'""")
def _(t):
    return report.flatten_report(t.raw_results, levels=4)


@query("safe_cell", """SELECT submission_id, round_even(similarity / 3, 4) AS number, CASE WHEN length(json) > 90 THEN json[:87] || '...' ELSE json END AS text
FROM {ref_features} JOIN {raw_results} USING (submission_id)""")
def _(t):
    return t.ref_features.join(t.raw_results, "submission_id").select(
        "submission_id", text.safe_number(c("similarity") / 3).alias("number"), text.safe_text(c("json"), 90).alias("text"))


@query("score_table", "SELECT submission_id, ord, criterion, score, max_score, round_even(score / max_score * 100, 2) AS percent FROM {module_scores}")
def _(t):
    return report.score_table(t.module_scores.drop("error_text", "warning_text"))


@query("total_scores", """SELECT submission_id, total_score, CASE WHEN total_score >= 86 THEN 'A''lo' WHEN total_score >= 71 THEN 'Yaxshi' WHEN total_score >= 56 THEN 'Qoniqarli' ELSE 'Qoniqarsiz' END AS grade_label
FROM (SELECT submission_id, round_even(sum(score), 2) AS total_score FROM {module_scores} GROUP BY submission_id)""")
def _(t):
    return report.total_scores(t.module_scores)


@query("grade_label", """SELECT id, CASE WHEN total_score IS NULL THEN NULL WHEN total_score >= 86 THEN 'A''lo' WHEN total_score >= 71 THEN 'Yaxshi' WHEN total_score >= 56 THEN 'Qoniqarli' ELSE 'Qoniqarsiz' END AS grade FROM {submissions}""")
def _(t):
    return t.submissions.select("id", text.grade_label(c("total_score")).alias("grade"))


@query("band_label", """SELECT id, CASE WHEN total_score IS NULL THEN NULL WHEN total_score >= 90 THEN 'A''lo' WHEN total_score >= 80 THEN 'Yaxshi' WHEN total_score >= 70 THEN 'Qoniqarli+' WHEN total_score >= 60 THEN 'Qoniqarli' ELSE 'Qoniqarsiz' END AS grade FROM {submissions}""")
def _(t):
    return t.submissions.select("id", text.band_label(c("total_score")).alias("grade"))


@query("layout_reliability", """WITH p AS (SELECT *, [projection_count <= 1, projection_count >= 6, orthographic_count = 0, orthographic_count > 3, NOT has_isometric, NOT title_found, largest_share >= 0.72] AS hit FROM {layout_facts}),
s AS (SELECT *, round_even(greatest(0.0, 1.0::DOUBLE - (hit[1])::INT * 0.35 - (hit[2])::INT * 0.20 - (hit[3])::INT * 0.35 - (hit[4])::INT * 0.15 - (hit[5])::INT * 0.10 - (hit[6])::INT * 0.05 - (hit[7])::INT * 0.20), 4) AS score FROM p)
SELECT submission_id, score AS confidence_score, CASE WHEN score >= 0.80 THEN 'high' WHEN score >= 0.60 THEN 'medium' ELSE 'low' END AS confidence_label,
  concat_ws('; ', CASE WHEN hit[1] THEN 'Projection count juda kam topildi; layout ishonchliligi past bo‘lishi mumkin.' END,
    CASE WHEN hit[2] THEN 'Projection count juda ko‘p topildi; ortiqcha box yoki merge xatosi bo‘lishi mumkin.' END, CASE WHEN hit[3] THEN 'Orthographic role ajratilmadi.' END,
    CASE WHEN hit[4] THEN 'Orthographic role soni odatdagidan ko‘p.' END, CASE WHEN hit[5] THEN 'Yaqqol tasvir aniqlanmadi.' END, CASE WHEN hit[6] THEN 'Title block topilmadi.' END,
    CASE WHEN hit[7] THEN 'Bitta projection box juda katta; bir nechta ko‘rinish merge bo‘lgan bo‘lishi mumkin.' END) AS warnings FROM s""")
def _(t):
    return report.layout_reliability(t.layout_facts).select(
        "submission_id", "confidence_score", "confidence_label", _join("warnings").alias("warnings"))


@query("final_report", """WITH s AS (SELECT submission_id, sum(score)::BIGINT AS raw_total, sum(max_score)::BIGINT AS raw_max FROM {free_scores} GROUP BY submission_id),
f AS (SELECT *, round_even(raw_total / greatest(raw_max, 1) * 100, 0)::INT AS final_score_100 FROM s)
SELECT f.*, CASE WHEN final_score_100 >= 90 THEN 'A''lo' WHEN final_score_100 >= 80 THEN 'Yaxshi' WHEN final_score_100 >= 70 THEN 'Qoniqarli+' WHEN final_score_100 >= 60 THEN 'Qoniqarli' ELSE 'Qoniqarsiz' END AS grade_label,
  r.confidence_score, r.confidence_label FROM f JOIN {layout_reliability} r USING (submission_id)""")
def _(t):
    return report.final_report(t.free_scores, report.layout_reliability(t.layout_facts))


@query("collect_messages", """WITH m AS (SELECT submission_id, ord, unnest(string_split(error_text, '|')) AS w, 'e' AS kind, generate_subscripts(string_split(error_text, '|'), 1) AS i FROM {free_scores} WHERE error_text <> ''
  UNION ALL SELECT submission_id, ord, unnest(string_split(warning_text, '|')), 'w', generate_subscripts(string_split(warning_text, '|'), 1) FROM {free_scores} WHERE warning_text <> ''
  UNION ALL SELECT submission_id, 99, warnings, 'w', 1 FROM {layout_reliability} WHERE warnings <> ''),
d AS (SELECT submission_id, kind, w, min(ord * 1000 + i) AS p FROM m GROUP BY ALL)
SELECT f.submission_id, coalesce(string_agg(w, '; ' ORDER BY p) FILTER (kind = 'e'), '') AS errors, coalesce(string_agg(w, '; ' ORDER BY p) FILTER (kind = 'w'), '') AS warnings
FROM (SELECT DISTINCT submission_id FROM {free_scores}) f LEFT JOIN d USING (submission_id) GROUP BY f.submission_id""")
def _(t):
    rows = report.collect_messages(_modules(t.free_scores), last=report.layout_reliability(t.layout_facts))
    return rows.select("submission_id", _join("errors").alias("errors"), _join("warnings").alias("warnings"))


@query("feedback", "WITH r AS (SELECT submission_id, " + ", ".join(
    f"max(CASE WHEN module = '{m}' AND score / greatest(max_score, 1) < {b} THEN '{msg}' END) AS m{i}"
    for i, (m, b, msg) in enumerate(report.FEEDBACK)) + f""" FROM {{free_scores}} GROUP BY submission_id)
SELECT submission_id, coalesce(nullif(concat_ws('; ', m0, m1, m2, m3, m4, m5), ''), '{report.ALL_GOOD}') AS feedback FROM r""")
def _(t):
    return report.feedback(t.free_scores).select("submission_id", _join("feedback").alias("feedback"))


@query("module_rows", """SELECT submission_id, criterion, CAST(score AS DOUBLE) AS score, CAST(max_score AS DOUBLE) AS max_score,
  CASE WHEN error_text <> '' THEN array_to_string(string_split(error_text, '|')[1:2], '; ') WHEN warning_text <> '' THEN array_to_string(string_split(warning_text, '|')[1:2], '; ') ELSE '' END AS comment
FROM {free_scores}""")
def _(t):
    return report.module_rows(_modules(t.free_scores)).select(
        "submission_id", "criterion", c("score").cast("double").alias("score"), c("max_score").cast("double").alias("max_score"), "comment")


@query("etalon_table", "SELECT submission_id, ord AS pos, criterion, score, CAST(max_score AS DOUBLE) AS max_score, percent FROM {score_table}")
def _(t):
    return report.etalon_table(t.module_scores).select("submission_id", F.posexplode("table_json").alias("pos", "r")).select(
        "submission_id", (c("pos") + 1).alias("pos"), "r.*")


@query("round_metrics", "SELECT submission_id, round_even(similarity / 3, 4) AS similarity, round_even(coverage / 7, 4) AS coverage FROM {ref_features}")
def _(t):
    m = F.create_map(F.lit("similarity"), c("similarity") / 3, F.lit("coverage"), c("coverage") / 7)
    return t.ref_features.select("submission_id", report.round_metrics(m).alias("m")).select(
        "submission_id", c("m")["similarity"].alias("similarity"), c("m")["coverage"].alias("coverage"))


@query("evaluate_etalon_batch", """WITH a AS (SELECT f.submission_id, frame, placement, line_types, dimension_marks, p.projections,
  CASE WHEN p.projections > 0 THEN coalesce(s.projection_sections, 0.0) ELSE 0.0 END AS projection_sections, visible_view, visible_section, cleanliness
FROM {score_frame} f JOIN {score_placement} USING (submission_id) JOIN {score_line_types} USING (submission_id) JOIN {score_dimension_marks} USING (submission_id) JOIN {score_projections} p USING (submission_id)
  JOIN {score_visible_view} USING (submission_id) JOIN {score_visible_section} USING (submission_id) JOIN {score_cleanliness_ref} USING (submission_id) LEFT JOIN {score_projection_sections} s USING (submission_id)),
b AS (SELECT *, round_even(frame + placement + line_types + dimension_marks + projections + projection_sections + visible_view + visible_section + cleanliness, 2) AS total_score FROM a)
SELECT *, CASE WHEN total_score >= 86 THEN 'A''lo' WHEN total_score >= 71 THEN 'Yaxshi' WHEN total_score >= 56 THEN 'Qoniqarli' ELSE 'Qoniqarsiz' END AS grade_label FROM b""")
def _(t):
    return report.evaluate_etalon_batch(t.ref_features, t.hatch_features).drop("table_json")


_X = "greatest(least(f.{b}, o.{b}) - greatest(f.{a}, o.{a}), 0) / greatest(1, least(f.{b} - f.{a}, o.{b} - o.{a})) >= 0.18"


@query("evaluate_optional_batch", """WITH r AS (SELECT v.*, r.role FROM {views} v JOIN {resolve_roles} r USING (drawing_id, seq)),
n AS (SELECT drawing_id, count(*) AS views, count(*) FILTER (role IS DISTINCT FROM 'isometric') AS orth, coalesce(bool_or(role = 'isometric'), false) AS iso, count(*) FILTER (role IN ('front', 'top', 'side')) AS named FROM r GROUP BY drawing_id),
a AS (SELECT f.drawing_id, sum(CASE WHEN o.role = 'top' THEN (o.y1 + o.y2 > f.y1 + f.y2)::INT + (""" + _X.format(a="x1", b="x2") + """)::INT ELSE (abs(o.x1 + o.x2 - f.x1 - f.x2) > 10)::INT + (""" + _X.format(a="y1", b="y2") + """)::INT END) AS arr
  FROM r f JOIN r o ON o.drawing_id = f.drawing_id AND o.role IN ('top', 'side') WHERE f.role = 'front' GROUP BY f.drawing_id),
h AS (SELECT r.drawing_id, r.role, q.quality, q.present, m.angle_std, m.spacing_cv, m.coverage, m.parallel_ratio, CASE r.role WHEN 'front' THEN 1 WHEN 'top' THEN 2 WHEN 'side' THEN 3 WHEN 'isometric' THEN 4 ELSE 4 + CAST(r.role[7:] AS INT) END AS ord
  FROM r JOIN {hatch_measures} m USING (drawing_id, seq) JOIN {hatch_quality} q ON q.drawing_id = m.drawing_id AND q.role = m.role),
hb AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY quality DESC, ord) AS k FROM h WHERE present),
hs AS (SELECT drawing_id, least(10, CASE WHEN quality >= 0.55 THEN 3 WHEN quality >= 0.35 THEN 2 ELSE 1 END + CASE WHEN angle_std <= 3.5 THEN 3 WHEN angle_std <= 6.5 THEN 2 WHEN angle_std <= 10 THEN 1 ELSE 0 END
  + CASE WHEN spacing_cv IS NULL THEN 1 WHEN spacing_cv <= 0.35 THEN 2 WHEN spacing_cv <= 0.70 THEN 1 ELSE 0 END + (coverage BETWEEN 0.004 AND 0.24)::INT + (parallel_ratio >= 0.70)::INT) AS s FROM hb WHERE k = 1),
hd AS (SELECT drawing_id, count(*) FILTER (present) AS detected FROM h GROUP BY drawing_id),
d AS (SELECT r.drawing_id, count(*) FILTER (role <> 'isometric' AND (cluster_count > 0 OR (text_count >= 2 AND line_count >= 2))) AS roles, coalesce(sum(text_count) FILTER (role <> 'isometric'), 0) AS t,
  coalesce(sum(line_count) FILTER (role <> 'isometric'), 0) AS l, coalesce(sum(cluster_count) FILTER (role <> 'isometric'), 0) AS k,
  count(*) FILTER (role IN ('front', 'top', 'side') AND visible) AS v, count(*) FILTER (role IN ('front', 'top', 'side') AND hidden_sequences >= 1) AS h, coalesce(sum(hidden_sequences) FILTER (role IN ('front', 'top', 'side')), 0) AS q,
  count(*) FILTER (role IN ('front', 'top', 'side') AND center <> 'none') AS m, count(*) FILTER (role IN ('front', 'top', 'side') AND center = 'strong') AS s
  FROM r JOIN (SELECT drawing_id, seq, text_count, line_count, cluster_count, visible, hidden_sequences, center FROM {role_evidence}) e USING (drawing_id, seq) GROUP BY r.drawing_id),
x AS (SELECT drawing_id, max((x2 - x1) * (y2 - y1)) / sum((x2 - x1) * (y2 - y1)) AS share FROM {views} GROUP BY drawing_id),
z AS (SELECT n.drawing_id, CASE WHEN orth >= 3 THEN 6 WHEN orth = 2 THEN 4 WHEN orth = 1 THEN 2 ELSE 0 END + CASE WHEN iso THEN 2 ELSE 0 END + named + coalesce(a.arr, 0) AS s1, coalesce(hs.s, 0) AS s2,
  least(15, CASE WHEN roles >= 3 THEN 6 WHEN roles = 2 THEN 4 WHEN roles = 1 THEN 2 ELSE 0 END + CASE WHEN t >= 8 THEN 4 WHEN t >= 5 THEN 3 WHEN t >= 3 THEN 2 WHEN t >= 1 THEN 1 ELSE 0 END
    + CASE WHEN l + 2 * k >= 12 THEN 3 WHEN l + 2 * k >= 7 THEN 2 WHEN l + 2 * k >= 3 THEN 1 ELSE 0 END + CASE WHEN k > 0 THEN 2 ELSE 0 END) AS s3,
  least(15, CASE WHEN v >= 3 THEN 5 WHEN v = 2 THEN 3 WHEN v = 1 THEN 1 ELSE 0 END + CASE WHEN h >= 2 OR q >= 3 THEN 4 WHEN h = 1 AND q >= 1 THEN 2 ELSE 0 END + CASE WHEN d.s >= 1 THEN 3 WHEN m >= 1 THEN 2 ELSE 0 END
    + CASE WHEN v >= 3 AND h >= 1 AND m >= 1 THEN 3 WHEN v >= 2 AND (h >= 1 OR m >= 1) THEN 2 WHEN v >= 1 THEN 1 ELSE 0 END) AS s4, cf.score AS s5,
  least(10, CASE WHEN orth >= required_views THEN 4 WHEN orth = required_views - 1 THEN 2 ELSE 0 END + CASE WHEN requires_isometric AND NOT iso THEN 0 ELSE 2 END + CASE WHEN requires_section AND hd.detected = 0 THEN 0 ELSE 2 END + least(roles, 2)) AS s6,
  round_even(greatest(0, 1.0::DOUBLE - (views <= 1)::INT * 0.35 - (views >= 6)::INT * 0.20 - (orth = 0)::INT * 0.35 - (orth > 3)::INT * 0.15 - (NOT iso)::INT * 0.10 - (tt.drawing_id IS NULL)::INT * 0.05 - (share >= 0.72)::INT * 0.20), 4) AS confidence_score
  FROM n LEFT JOIN a USING (drawing_id) LEFT JOIN hs USING (drawing_id) JOIN hd USING (drawing_id) JOIN d USING (drawing_id) JOIN x USING (drawing_id) JOIN {score_cleanliness_free} cf USING (drawing_id)
  JOIN {compliance_facts} p USING (drawing_id) JOIN {task_requirements} q2 ON q2.task_id = p.part LEFT JOIN {titles} tt ON tt.drawing_id = n.drawing_id)
SELECT drawing_id, s1::INT AS completeness_arrangement, s2::INT AS section_hatching, s3::INT AS dimensions, s4::INT AS line_semantics, s5::INT AS cleanliness, s6::INT AS task_compliance, (s1 + s2 + s3 + s4 + s5 + s6)::INT AS raw_total,
  round_even((s1 + s2 + s3 + s4 + s5 + s6) / 75 * 100, 0)::INT AS final_score_100, confidence_score FROM z""", flat=True)
def _(t):
    out = report.evaluate_optional_batch(t.views, t.zones, t.titles, t.hatch_measures.drop("role"), t.role_evidence.drop("role"), t.clean_facts, t.compliance_facts)
    return out.drop("errors", "warnings", "feedback", "confidence_label", "grade_label")
