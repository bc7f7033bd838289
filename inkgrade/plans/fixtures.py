"""Tables of the assessment model, derived from the given tables.

Each is one SQL text that both Spark and DuckDB run; ``<<spark|duckdb>>`` marks the few spots where
the dialects differ. All are scans, equi-joins and pre-aggregated groupings over whole tables. No
window is used to number rows: orders and counters are taken from columns or computed from them, so
a single hot key never has to pass through one task.
"""

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {}

# ---------------------------------------------------------------- relational
FIXTURES["teachers"] = """
SELECT n_nationkey AS id, n_name AS first_name, r_name AS university,
       lower(n_name) || '@example.org' AS email
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""
FIXTURES["students"] = """
SELECT c_custkey AS id, c_nationkey AS teacher_id, c_name AS full_name,
       c_mktsegment AS direction, 'student_' || c_custkey AS login, c_acctbal > 0 AS is_active
FROM {customer}
"""
FIXTURES["tasks"] = """
SELECT s_suppkey AS id, s_nationkey AS teacher_id, s_name AS title,
       CASE WHEN s_suppkey % 2 = 0 THEN 'etalon' ELSE 'optional' END AS mode,
       CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0
            THEN 'app/uploads/tasks/ref_' || s_suppkey || '.png' END AS reference_file_path,
       CASE WHEN s_suppkey % 4 <> 0
            THEN CAST(DATE '1998-01-01' + CAST(7 * (s_suppkey % 500) AS INT)
                      AS <<TIMESTAMP_NTZ|TIMESTAMP>>) END AS deadline,
       s_acctbal > 0 AS is_active
FROM {supplier}
"""
FIXTURES["task_assignments"] = """
SELECT DISTINCT l_suppkey AS task_id, o_custkey AS student_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
WHERE (l_suppkey + o_custkey) % 5 <> 0
"""
FIXTURES["submissions"] = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS id,
       l_suppkey AS task_id, o_custkey AS student_id,
       CAST(l_linenumber AS BIGINT) AS attempt_number,
       CASE WHEN l_suppkey % 2 = 0 THEN 'etalon' ELSE 'optional' END AS mode,
       CASE l_suppkey % 6 WHEN 0 THEN replace('app/uploads/submissions/', '/', chr(92))
            WHEN 1 THEN 'app/uploads/submissions/' WHEN 2 THEN '/srv/app/uploads/submissions/'
            WHEN 3 THEN 'uploads/submissions/' WHEN 4 THEN '/uploads/submissions/'
            ELSE 'other/' END
         || l_orderkey || '_' || l_partkey
         || CASE l_partkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg'
            WHEN 3 THEN '.jpeg' ELSE '.bmp' END AS uploaded_file_path,
       CASE WHEN l_returnflag = 'A' THEN l_quantity * 2 END AS total_score,
       CASE WHEN l_returnflag = 'A' THEN 'app/uploads/results/' || l_orderkey || '_diff.png'
            WHEN l_returnflag = 'R' THEN '' END AS overlay_path,
       CASE l_returnflag WHEN 'A' THEN 'evaluated' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status,
       l_shipdate AS created_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
FIXTURES["requests"] = """
SELECT id, task_id, student_id, uploaded_file_path, created_at FROM {submissions}
"""
# the same, with the earlier half already stored
FIXTURES["stored_submissions"] = """
SELECT * FROM {submissions} WHERE created_at < CAST(DATE '1996-01-01' AS <<TIMESTAMP_NTZ|TIMESTAMP>>)
"""
FIXTURES["new_requests"] = """
SELECT * FROM {requests} WHERE created_at >= CAST(DATE '1996-01-01' AS <<TIMESTAMP_NTZ|TIMESTAMP>>)
"""
FIXTURES["evaluations"] = """
SELECT id, CASE WHEN created_at < CAST(DATE '2000-01-01' AS <<TIMESTAMP_NTZ|TIMESTAMP>>) THEN attempt_number * 12.5 END AS total_score,
       CASE WHEN created_at < CAST(DATE '2000-01-01' AS <<TIMESTAMP_NTZ|TIMESTAMP>>) THEN 'done' END AS ai_json_result,
       'app/uploads/results/' || id || '.png' AS overlay_path, '[]' AS table_json,
       CASE WHEN created_at >= CAST(DATE '2000-01-01' AS <<TIMESTAMP_NTZ|TIMESTAMP>>) THEN 'no drawing found' END AS error
FROM {submissions} WHERE status = 'pending'
"""
# lookups: every submission is asked for once by some teacher and by some student
FIXTURES["teacher_asks"] = """
SELECT id AS submission_id, CAST((task_id + attempt_number) % 25 AS INT) AS teacher_id FROM {submissions}
"""
FIXTURES["student_asks"] = """
SELECT id AS submission_id,
       CASE WHEN attempt_number % 3 = 0 THEN student_id + 1 ELSE student_id END AS student_id
FROM {submissions}
"""
FIXTURES["owner_asks"] = """
SELECT o_orderkey AS request_id, o_custkey AS student_id, CAST(o_orderkey % 25 AS INT) AS teacher_id
FROM {orders}
"""
FIXTURES["id_lists"] = """
SELECT o_orderkey AS request_id,
       CASE o_orderkey % 5 WHEN 0 THEN o_custkey || ', ' || (o_custkey + 1) || ',' || o_custkey
            WHEN 1 THEN ' ' || o_custkey || ' ,, ' || (o_orderkey % 7)
            WHEN 2 THEN o_custkey || ',x' || o_orderkey WHEN 3 THEN '' END AS raw
FROM {orders}
"""
FIXTURES["registrations"] = """
SELECT o_orderkey AS seq, 'student_' || (o_custkey * 2) AS login FROM {orders}
"""
FIXTURES["student_patches"] = """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'full_name' WHEN 1 THEN 'direction,is_active'
            WHEN 2 THEN 'full_name,direction' ELSE '' END AS set_keys,
       'New ' || c_name AS full_name,
       CASE WHEN c_acctbal > 4000 THEN lower(c_mktsegment) END AS direction, c_acctbal > 1000 AS is_active
FROM {customer} WHERE c_mktsegment <> 'HOUSEHOLD'
"""
FIXTURES["nation_tasks"] = """
SELECT s_nationkey, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM {supplier} GROUP BY s_nationkey
"""
FIXTURES["new_assignments"] = """
SELECT lo AS task_id, c_custkey AS student_id FROM {customer} JOIN {nation_tasks} ON c_nationkey = s_nationkey
UNION ALL
SELECT hi, c_custkey FROM {customer} JOIN {nation_tasks} ON c_nationkey = (s_nationkey + 1) % 25
WHERE s_nationkey < 10
"""
FIXTURES["task_text"] = """
SELECT p_partkey AS task_id,
       CASE WHEN p_size % 7 = 0 THEN 'Views ' || (p_size % 5) || '; ' WHEN p_size % 7 = 1 THEN ''
            ELSE (p_size % 5) || ' ta proyeksiya; ' END
       || CASE WHEN p_type LIKE '%ECONOMY%' THEN 'Qirqim bilan; ' WHEN p_type LIKE '%PROMO%' THEN 'yaqqol tasvir; '
               WHEN p_type LIKE '%LARGE%' THEN 'размер; ' ELSE '' END || p_name AS description
FROM {part}
"""

# ---------------------------------------------------------------- one row of sums per drawing
# Sums of whole numbers only, so that every engine reaches the same value in any order.
FIXTURES["order_sums"] = """
SELECT l_orderkey AS submission_id, count(*) AS n,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(l_partkey) AS BIGINT) AS p,
       CAST(sum(l_suppkey) AS BIGINT) AS s,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t,
       CAST(sum(l_linenumber) AS BIGINT) AS l, min(l_partkey) AS part
FROM {lineitem} GROUP BY l_orderkey
"""
FIXTURES["ref_features"] = """
SELECT submission_id,
       CAST((p + 3 * s) % 131 AS DOUBLE) / 100 - 0.25 AS similarity,
       CAST((q * 3 + p) % 101 AS DOUBLE) / 100 AS coverage,
       CAST((q + s) % 101 AS DOUBLE) / 100 AS missing_ratio,
       CAST((p + q) % 131 AS DOUBLE) / 100 AS extra_ratio,
       CAST(p % 150 AS INT) AS st_dash, CAST(s % 60 AS INT) AS et_dash,
       CAST((p * 7 + d) % 61 AS DOUBLE) / 100 AS st_long,
       CASE WHEN n > 1 THEN CAST(p % 900 AS DOUBLE) / 2 END AS ref_cx,
       CASE WHEN n > 1 THEN CAST(s % 700 AS DOUBLE) / 2 END AS ref_cy,
       CASE WHEN q > 10 THEN CAST((p + d * 7) % 900 AS DOUBLE) / 2 END AS stu_cx,
       CASE WHEN q > 10 THEN CAST((s + t * 5) % 700 AS DOUBLE) / 2 END AS stu_cy,
       CAST(1000 + p % 200 AS INT) AS width, CAST(800 + s % 200 AS INT) AS height,
       CAST((q * 7 + d) % 101 AS DOUBLE) / 100 AS angle_sim,
       CASE WHEN q % 11 <> 0 THEN 1.0 + CAST(p % 40 AS DOUBLE) / 20 END AS ref_p50,
       CASE WHEN q % 11 <> 0 THEN 1.0 + CAST(p % 31 AS DOUBLE) / 60 END AS ref_r9050,
       CASE WHEN q % 11 <> 0 THEN 1.0 + CAST(s % 31 AS DOUBLE) / 60 END AS ref_r7525,
       CASE WHEN q % 13 <> 0 THEN 1.0 + CAST((p + q) % 40 AS DOUBLE) / 20 END AS stu_p50,
       CASE WHEN q % 13 <> 0 THEN 1.0 + CAST(q % 31 AS DOUBLE) / 60 END AS stu_r9050,
       CASE WHEN q % 13 <> 0 THEN 1.0 + CAST((s + q) % 31 AS DOUBLE) / 60 END AS stu_r7525,
       CAST((p * 3) % 6000 AS INT) AS et_dim_area, CAST((p * 5 + s) % 6000 AS INT) AS st_dim_area,
       CAST(s % 40 AS INT) AS et_small_cnt, CAST((s + q) % 40 AS INT) AS st_small_cnt,
       CAST((p + s + q) % 6 AS INT) AS projection_count,
       CAST(p % 4000 AS INT) AS view_ref_area, CAST((p * 3 + q) % 4000 AS INT) AS view_stu_area,
       CAST((s * 3 + q) % 101 AS DOUBLE) / 100 AS view_found,
       CAST((s + q * 5) % 101 AS DOUBLE) / 100 AS view_right,
       CAST((p + q * 3) % 101 AS DOUBLE) / 100 AS view_iou,
       CAST(s % 41 AS DOUBLE) / 100 AS ref_diag, CAST(q % 41 AS DOUBLE) / 100 AS stu_diag,
       CAST((p * 11) % 2000 AS INT) AS sect_ref_area, CAST((p * 13 + s) % 2000 AS INT) AS sect_stu_area,
       CAST((q * 9 + s) % 101 AS DOUBLE) / 100 AS sect_found,
       CAST((q * 4 + p) % 101 AS DOUBLE) / 100 AS sect_right,
       CAST((s * 7 + p) % 101 AS DOUBLE) / 100 AS sect_iou,
       CAST(2000 + p % 3000 AS INT) AS ref_line_px, CAST((p + s) % 800 AS INT) AS out_line_px,
       CAST((s * 3) % 600 AS INT) AS blob_px, CAST(q % 30 AS INT) AS out_speck_cnt,
       CAST(s % 25 AS INT) AS speck_cnt, CAST((p + s) % 800 + (s * 3) % 600 + q % 40 AS INT) AS dirty_px,
       CAST(s % 9 AS INT) AS blob_cnt
FROM {order_sums}
"""
FIXTURES["hatch_features"] = """
SELECT l_orderkey AS submission_id, CAST(l_linenumber % 3 + 1 AS INT) AS projection,
       CAST(sum(l_partkey) % 8 AS INT) AS stripe_count,
       CAST(sum(l_suppkey) % 12 AS INT) AS dom_line_count,
       CAST((sum(l_partkey) + sum(l_suppkey)) % 51 AS DOUBLE) / 100 + 0.5 AS dom_ratio,
       CAST(sum(l_suppkey) % 40 AS DOUBLE) / 2 AS angle_std,
       CAST(sum(CAST(l_quantity AS BIGINT)) % 41 AS DOUBLE) / 20 AS gap_cv,
       CAST((sum(l_partkey) * 3) % 101 AS DOUBLE) / 100 AS mean_len_ratio,
       CAST((sum(l_suppkey) * 3) % 101 AS DOUBLE) / 1000 AS interior_share,
       CAST((sum(l_suppkey) * 7) % 301 AS DOUBLE) / 1000 AS median_gap_norm
FROM {lineitem} GROUP BY l_orderkey, CAST(l_linenumber % 3 + 1 AS INT)
"""
FIXTURES["module_scores"] = """
SELECT submission_id, ord, criterion, max_score, CAST((submission_id * 7 + ord * 5) % (max_score + 1) AS DOUBLE) AS score,
       CASE WHEN (submission_id + ord) % 3 = 0 THEN 'click|error' ELSE '' END AS error_text,
       CASE WHEN (submission_id + ord) % 4 = 0 THEN 'view|click' ELSE '' END AS warning_text
FROM {order_sums} <<LATERAL VIEW inline(array(|CROSS JOIN (VALUES >>(1, 'Ramka + burchak shtampi', 3), (2, 'Chizmani to''g''ri joylashtirish', 6),
  (3, 'Chiziq turlari', 8), (4, 'O''lcham qo''yish', 12), (5, 'Proyeksiyalar soni', 18),
  (6, 'Proyeksiyalarda qirqim bajarilganligi', 10), (7, 'Yaqqol tasvir to''g''riligi', 24),
  (8, 'Yaqqol tasvirda qirqim bajarilganligi', 15), (9, 'Chizma tozaligi', 4)<<)) c AS ord, criterion, max_score|) AS c(ord, criterion, max_score)>>
"""
FIXTURES["free_scores"] = """
SELECT submission_id, ord, module, criterion, max_score, CAST((submission_id * 3 + ord * 7) % (max_score + 1) AS INT) AS score,
       CASE WHEN (submission_id + ord) % 3 = 0 THEN module || ' missing|weak' ELSE '' END AS error_text,
       CASE WHEN (submission_id + ord) % 4 = 0 THEN 'check|weak|' || module ELSE '' END AS warning_text
FROM {order_sums} <<LATERAL VIEW inline(array(|CROSS JOIN (VALUES >>(1, 'completeness_arrangement', 'Proyeksiyalar to‘liqligi va joylashuvi', 15),
  (2, 'section_hatching', 'Qirqim va shtrixovka sifati', 10), (3, 'dimensions', 'O‘lchamlar mavjudligi va joylashuvi', 15),
  (4, 'line_semantics', 'Chiziq semantikasi va chizmachilik qoidalari', 15),
  (5, 'cleanliness', 'Chizma tozaligi va o‘qilishi', 10), (6, 'task_compliance', 'Topshiriq talabiga moslik', 10)<<)) c AS ord, module, criterion, max_score|) AS c(ord, module, criterion, max_score)>>
"""
FIXTURES["layout_facts"] = """
SELECT submission_id, CAST(n % 8 AS INT) AS projection_count, CAST((n + q) % 6 AS INT) AS orthographic_count,
       q % 2 = 0 AS has_isometric, p % 3 <> 0 AS title_found, CAST((p * 3) % 100 AS DOUBLE) / 100 AS largest_share
FROM {order_sums}
"""
FIXTURES["raw_results"] = """
SELECT submission_id,
  '{{' || '"details":' || CASE submission_id % 3 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"a":{{"b":' || n || ',"c":[1,2]}},"m":"x' || q || '"}}' ELSE 'null' END
  || CASE submission_id % 2 WHEN 0 THEN ',"json_result":{{"j":' || s || '}}' ELSE '' END
  || ',"overlay":' || CASE submission_id % 4 WHEN 0 THEN '""' ELSE '"o/' || submission_id || '.png"' END
  || CASE submission_id % 8 WHEN 0 THEN ',"overlay_file":"f/' || submission_id || '.png"' ELSE '' END
  || CASE WHEN submission_id % 7 = 0 THEN ',"total_score":null'
     ELSE ',"' || CASE submission_id % 6 WHEN 0 THEN 'total_score' WHEN 1 THEN 'score' WHEN 2 THEN 'final_score'
          WHEN 3 THEN 'overall_score' WHEN 4 THEN 'total_ball' ELSE 'ball' END || '":' ||
          CASE submission_id % 9 WHEN 0 THEN '"abc"' WHEN 1 THEN '"' || (q % 100) || '"' WHEN 2 THEN '0' ELSE CAST(q % 100 AS <<STRING|VARCHAR>>) END END
  || ',"table":' || CASE submission_id % 5 WHEN 0 THEN '{{"k":' || n || '}}' WHEN 1 THEN '[]' WHEN 2 THEN '"text"' ELSE '[{{"k":' || l || '}}]' END
  || CASE submission_id % 10 WHEN 1 THEN ',"rows":[1,2,' || n || ']' ELSE '' END || '}}' AS json
FROM {order_sums}
"""

# ---------------------------------------------------------------- views of a drawing, one per line number (at most 7)
FIXTURES["views"] = """
SELECT l_orderkey AS drawing_id, l_linenumber AS seq, CAST(min(l_partkey % 900) AS INT) AS x1,
       CAST(min((l_suppkey * 37) % 700) AS INT) AS y1,
       CAST(max(l_partkey % 900 + 20 + l_quantity * 4) AS INT) AS x2,
       CAST(max((l_suppkey * 37) % 700 + 20 + l_linenumber * 17 + l_partkey % 90) AS INT) AS y2,
       CAST(sum(l_partkey) % 101 AS DOUBLE) / 100 AS diag_ratio,
       CAST(sum(l_suppkey * 3) % 101 AS DOUBLE) / 100 AS hv_ratio,
       CASE WHEN sum(l_partkey) % 101 > sum(l_suppkey * 3) % 101 + 12 THEN 'diag_dominant' ELSE 'hv_dominant' END AS view_type
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
FIXTURES["role_boxes"] = """
SELECT drawing_id, seq, CASE seq WHEN 1 THEN 'front' WHEN 2 THEN 'top' WHEN 3 THEN 'side' WHEN 4 THEN 'isometric'
       ELSE 'extra_' || (seq - 4) END AS role, x1, y1, x2, y2
FROM {views}
"""
FIXTURES["role_wide"] = """
SELECT drawing_id,
  max(CASE WHEN seq = 1 THEN x1 END) AS fx1, max(CASE WHEN seq = 1 THEN y1 END) AS fy1, max(CASE WHEN seq = 1 THEN x2 END) AS fx2, max(CASE WHEN seq = 1 THEN y2 END) AS fy2,
  max(CASE WHEN seq = 2 THEN x1 END) AS tx1, max(CASE WHEN seq = 2 THEN y1 END) AS ty1, max(CASE WHEN seq = 2 THEN x2 END) AS tx2, max(CASE WHEN seq = 2 THEN y2 END) AS ty2,
  max(CASE WHEN seq = 3 THEN x1 END) AS sx1, max(CASE WHEN seq = 3 THEN y1 END) AS sy1, max(CASE WHEN seq = 3 THEN x2 END) AS sx2, max(CASE WHEN seq = 3 THEN y2 END) AS sy2,
  CAST(sum(CASE WHEN seq <> 4 THEN 1 ELSE 0 END) AS INT) AS orthographic_count,
  max(CASE WHEN seq = 4 THEN 1 ELSE 0 END) = 1 AS has_isometric,
  CAST(sum(CASE WHEN seq > 4 THEN 1 ELSE 0 END) AS INT) AS extra_count
FROM {views} GROUP BY drawing_id
"""
FIXTURES["hatch_measures"] = """
SELECT l_orderkey AS drawing_id, l_linenumber AS seq, CASE l_linenumber WHEN 1 THEN 'front' WHEN 2 THEN 'top' WHEN 3 THEN 'side' WHEN 4 THEN 'isometric'
       ELSE 'extra_' || (l_linenumber - 4) END AS role,
  CAST(sum(l_partkey) % 9 AS INT) AS line_count, CAST(sum(l_suppkey) % 101 AS DOUBLE) / 100 AS parallel_ratio,
  CAST(sum(l_partkey) % 250 AS DOUBLE) / 100 AS length_ratio, CAST(sum(l_partkey * 3) % 450 AS DOUBLE) / 1000 AS coverage,
  CAST(sum(l_suppkey) % 35 AS DOUBLE) / 2 AS angle_std,
  CASE WHEN l_linenumber <> 3 THEN CAST(sum(l_suppkey) % 131 AS DOUBLE) / 100 END AS spacing_cv
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
FIXTURES["role_evidence"] = """
SELECT l_orderkey AS drawing_id, l_linenumber AS seq, CASE l_linenumber WHEN 1 THEN 'front' WHEN 2 THEN 'top' WHEN 3 THEN 'side' WHEN 4 THEN 'isometric'
       ELSE 'extra_' || (l_linenumber - 4) END AS role,
  CAST(sum(l_partkey) % 5 AS INT) AS text_count, CAST(sum(l_suppkey) % 4 AS INT) AS line_count,
  CAST(sum(l_partkey + l_suppkey) % 3 AS INT) AS cluster_count, sum(l_partkey) % 3 > 0 AS visible,
  CAST(sum(l_suppkey) % 3 AS INT) AS hidden_sequences,
  CASE sum(l_partkey + l_suppkey) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'weak' ELSE 'strong' END AS center
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
FIXTURES["clean_facts"] = """
SELECT submission_id AS drawing_id, CAST(p % 240 AS DOUBLE) AS sharpness, CAST(s % 150 AS DOUBLE) AS contrast,
  CAST(q % 41 AS DOUBLE) / 1000 AS border_occ, CAST((p + q) % 241 AS DOUBLE) / 10000 AS stray_ratio, CAST(s % 7 AS INT) AS stray_count
FROM {order_sums}
"""
FIXTURES["compliance_facts"] = """
SELECT o.submission_id AS drawing_id, t.description, o.part, CAST(o.n % 5 AS INT) AS orthographic_count, o.q % 2 = 0 AS has_isometric,
  CAST(o.p % 3 AS INT) AS detected, CAST(o.s % 4 AS INT) AS dim_roles
FROM {order_sums} o JOIN {task_text} t ON t.task_id = o.part
"""

# ---------------------------------------------------------------- boxes, components and pages
FIXTURES["boxes"] = """
SELECT l_orderkey AS drawing_id, (l_partkey * 8 + l_linenumber) * 1048576 + l_suppkey AS seq,
       CAST(l_partkey % 900 AS INT) AS x1, CAST((l_suppkey * 37) % 700 AS INT) AS y1,
       CAST(l_partkey % 900 + 20 + l_quantity * 4 AS INT) AS x2,
       CAST((l_suppkey * 37) % 700 + 20 + l_linenumber * 17 + l_partkey % 90 AS INT) AS y2
FROM {lineitem}
"""
FIXTURES["band_boxes"] = """
SELECT l_orderkey AS drawing_id, CAST(l_linenumber % 2 AS INT) AS band, (l_partkey * 8 + l_linenumber) * 1048576 + l_suppkey AS seq,
       CASE WHEN l_partkey % 2 = 0 THEN 'text' ELSE 'line' END AS kind, CAST(l_quantity AS INT) AS area,
       CAST(l_partkey % 300 AS INT) AS x1, CAST((l_suppkey * 37) % 120 AS INT) AS y1,
       CAST(l_partkey % 300 + 10 + l_quantity AS INT) AS x2, CAST((l_suppkey * 37) % 120 + 6 + l_linenumber * 3 AS INT) AS y2
FROM {lineitem}
"""
FIXTURES["components"] = """
SELECT l_orderkey AS drawing_id, (l_partkey * 8 + l_linenumber) * 1048576 + l_suppkey AS seq,
       CAST(l_partkey % 900 AS INT) AS x, CAST((l_suppkey * 37) % 700 AS INT) AS y,
       CAST(1 + CAST(l_quantity AS INT) % 60 AS INT) AS w, CAST(1 + l_partkey % 60 AS INT) AS h,
       CAST(1 + floor((1 + CAST(l_quantity AS INT) % 60) * (1 + l_partkey % 60) * (l_suppkey % 10 + 1) / 12) AS INT) AS area,
       CAST((l_suppkey * 7 + l_partkey) % 180 AS DOUBLE) AS angle, 1.0 + CAST(l_partkey % 30 AS DOUBLE) / 10 AS aspect,
       CAST(8 + l_orderkey % 40 AS INT) AS gap
FROM {lineitem}
"""
FIXTURES["page_components"] = """
SELECT k.drawing_id, k.seq, k.x, k.y, k.w * 12 AS w, k.h * 10 AS h, k.area * 3 AS area, d.w AS page_w, d.h AS page_h,
       CAST(200 + k.gap * 4 AS INT) AS region_w, CAST(150 + k.gap * 3 AS INT) AS region_h, CAST(10 + k.gap AS INT) AS base
FROM {components} k JOIN {drawing_dims} d ON d.drawing_id = k.drawing_id
"""
FIXTURES["drawing_dims"] = """
SELECT o_orderkey AS drawing_id, CAST(1100 + o_custkey % 300 AS INT) AS w, CAST(900 + o_custkey % 200 AS INT) AS h FROM {orders}
"""
FIXTURES["zones"] = """
SELECT drawing_id, 12 AS zx1, 12 AS zy1, w - 12 AS zx2, h - 12 AS zy2 FROM {drawing_dims}
"""
FIXTURES["titles"] = """
SELECT drawing_id, w - 100 - w % 7 * 60 AS x1, h - 60 - h % 5 * 50 AS y1, w - 10 AS x2, h - 10 AS y2 FROM {drawing_dims} WHERE w % 3 <> 0
"""
FIXTURES["title_candidates"] = """
SELECT v.drawing_id, v.seq, v.x1 + 200 AS x1, v.y1 + 150 AS y1, v.x2 + 250 AS x2, v.y2 + 150 AS y2, d.w, d.h,
       v.diag_ratio AS hv_fill, v.hv_ratio / 5 AS fill_ratio
FROM {views} v JOIN {drawing_dims} d ON d.drawing_id = v.drawing_id
"""
FIXTURES["ink_boxes"] = """
SELECT b.drawing_id, b.seq, b.x1, b.y1, b.x2, b.y2, CAST((b.x2 - b.x1) * (b.y2 - b.y1) * (b.seq % 7 + 1) / 16 AS INT) AS area,
       CAST(b.seq % 11 AS DOUBLE) / 200 AS fill_ratio
FROM {boxes} b
"""
FIXTURES["visible_candidates"] = """
SELECT v.drawing_id, v.seq, v.diag_ratio * 0.5 AS long_diag_ratio, v.diag_ratio, CAST((v.x2 - v.x1) * (v.y2 - v.y1) AS DOUBLE) / (d.w * d.h) AS area_ratio, v.hv_ratio AS density
FROM {views} v JOIN {drawing_dims} d ON d.drawing_id = v.drawing_id
"""
FIXTURES["cuts"] = """
SELECT drawing_id, w, CAST(floor(h * 52 / 100) AS INT) AS ycut, 0 AS k FROM {drawing_dims} UNION ALL
SELECT drawing_id, w, CAST(floor(h * 58 / 100) AS INT), 1 FROM {drawing_dims} UNION ALL
SELECT drawing_id, w, CAST(floor(h * 64 / 100) AS INT), 2 FROM {drawing_dims} UNION ALL
SELECT drawing_id, w, CAST(floor(h * 70 / 100) AS INT), 3 FROM {drawing_dims}
"""
FIXTURES["cut_boxes"] = """
SELECT v.drawing_id, c.ycut, v.x1, v.y1, v.x2, v.y2 FROM {views} v JOIN {cuts} c ON c.drawing_id = v.drawing_id AND c.k = v.seq % 4
"""
FIXTURES["projection_features"] = """
SELECT v.drawing_id, v.seq, v.x2 - v.x1 AS bw, v.y2 - v.y1 AS bh, CAST((v.x2 - v.x1) * (v.y2 - v.y1) / 4 AS INT) AS area,
       v.diag_ratio * 0.6 AS hvs, v.hv_ratio AS hvl, CAST(v.x1 AS DOUBLE) AS hv_len, CAST(v.y1 AS DOUBLE) AS diag_len,
       120 AS min_w, 110 AS min_h, 2500 AS min_area, d.w, d.h
FROM {views} v JOIN {drawing_dims} d ON d.drawing_id = v.drawing_id
"""
FIXTURES["role_clusters"] = """
SELECT r.drawing_id, r.role, r.x1 - 60 + CAST(k.x % 300 AS INT) AS x1, r.y1 - 50 + CAST(k.y % 250 AS INT) AS y1,
       r.x1 - 60 + CAST(k.x % 300 AS INT) + k.w AS x2, r.y1 - 50 + CAST(k.y % 250 AS INT) + k.h AS y2,
       k.area % 3 AS text_count, k.h % 3 AS line_count
FROM {role_boxes} r JOIN {components} k ON k.drawing_id = r.drawing_id AND k.seq % 7 + 1 = r.seq
"""
FIXTURES["regions"] = """
SELECT drawing_id, CAST(seq % 4 AS INT) AS region_id, CAST(sum(area) AS INT) AS area FROM {components} GROUP BY drawing_id, CAST(seq % 4 AS INT)
"""
FIXTURES["region_ink"] = """
SELECT l_orderkey AS drawing_id, CAST(((l_partkey * 8 + l_linenumber) * 1048576 + l_suppkey) % 4 AS INT) AS region_id, x
FROM {lineitem} <<LATERAL VIEW explode(sequence(1, CAST(l_quantity AS INT))) e AS x|, unnest(range(1, CAST(l_quantity AS INT) + 1)) AS e(x)>>
"""

# ---------------------------------------------------------------- segments and profiles
FIXTURES["segments"] = """
SELECT b.drawing_id, CASE b.seq % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'top' ELSE 'side' END AS role, b.seq, b.x1, b.y1,
       b.x1 + CAST(b.seq % 201 AS INT) - 100 AS x2, b.y1 + CAST(b.seq % 197 AS INT) - 98 AS y2, d.w, d.h
FROM {boxes} b JOIN {drawing_dims} d ON d.drawing_id = b.drawing_id
"""
FIXTURES["hatch_segments"] = """
SELECT l_suppkey AS drawing_id, CAST(l_partkey % 500 AS INT) AS x1, CAST((l_orderkey * 7) % 400 AS INT) AS y1,
       CAST(l_partkey % 500 + 8 + l_quantity AS INT) AS x2,
       CAST((l_orderkey * 7) % 400 + CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END * (8 + floor(l_quantity * (1 + l_suppkey % 3) / 2)) AS INT) AS y2, 600 AS w, 500 AS h
FROM {lineitem}
"""
FIXTURES["dash_segments"] = """
SELECT drawing_id, role, CASE WHEN across THEN a ELSE k END AS x1, CASE WHEN across THEN k ELSE a END AS y1,
       CASE WHEN across THEN a + len ELSE k + 1 END AS x2, CASE WHEN across THEN k ELSE a + len END AS y2, 600 AS w, 600 AS h, 26 AS base
FROM (SELECT l_suppkey AS drawing_id, CASE l_linenumber % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'top' ELSE 'side' END AS role,
        l_partkey % 2 = 0 AS across, CAST((l_partkey % 6) * 70 + 60 + l_linenumber AS INT) AS k, CAST((l_orderkey * 13) % 560 AS INT) AS a,
        CAST(20 + l_quantity AS INT) AS len FROM {lineitem}) s
"""
FIXTURES["dash_views"] = """
SELECT drawing_id, role, 600 AS w, 600 AS h FROM {dash_segments} GROUP BY drawing_id, role
"""
FIXTURES["profile_counts"] = """
SELECT user_id AS profile_id, CAST(event_id % 64 AS INT) AS pos, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS val
FROM {events} GROUP BY user_id, CAST(event_id % 64 AS INT)
"""
FIXTURES["profiles"] = """
SELECT p.profile_id, CAST(p.pos AS INT) AS pos, coalesce(c.val, CAST(0 AS DOUBLE)) AS val
FROM (SELECT profile_id, <<explode(sequence(0, 63))|unnest(range(64))>> AS pos FROM {profile_counts} GROUP BY profile_id) p
LEFT JOIN {profile_counts} c ON c.profile_id = p.profile_id AND c.pos = p.pos
"""
# the same profiles cut to pages of different length, each with a kernel of its own
FIXTURES["sized_profiles"] = """
SELECT profile_id, pos, val, n, k FROM (
  SELECT profile_id, pos, val, CAST(40 + 12 * (profile_id % 3) AS INT) AS n, CAST(3 + 2 * (profile_id % 4) AS INT) AS k FROM {profiles}) p
WHERE pos < n
"""

# ---------------------------------------------------------------- masks
FIXTURES["pixels8"] = """
SELECT vec_id AS mask_id, CAST(floor(p / 8) AS INT) AS y, CAST(p % 8 AS INT) AS x,
       CASE WHEN v > 0 THEN CAST(254 - floor(v * 100) AS INT) ELSE 255 END AS v
FROM <<{embeddings} LATERAL VIEW posexplode(embedding) e AS p, v|(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM {embeddings}) e>>
"""
FIXTURES["cells8"] = "SELECT mask_id, y, x FROM {pixels8} WHERE v < 255"
FIXTURES["dark8"] = "SELECT mask_id, y, x FROM {pixels8} WHERE v < 244"
FIXTURES["core8"] = "SELECT CAST(floor(mask_id / 2) AS BIGINT) AS mask_id, y, x FROM {pixels8} WHERE v < 233 AND mask_id % 2 = 0"
FIXTURES["dims8"] = "SELECT vec_id AS mask_id, 8 AS h, 8 AS w FROM {embeddings}"
FIXTURES["ref8"] = "SELECT CAST(floor(mask_id / 2) AS BIGINT) AS mask_id, y, x FROM {cells8} WHERE mask_id % 2 = 0"
FIXTURES["stu8"] = "SELECT CAST(floor(mask_id / 2) AS BIGINT) AS mask_id, y, x FROM {cells8} WHERE mask_id % 2 = 1"
FIXTURES["pair_dims8"] = "SELECT CAST(floor(vec_id / 2) AS BIGINT) AS mask_id, max(8) AS h, max(8) AS w FROM {embeddings} GROUP BY CAST(floor(vec_id / 2) AS BIGINT)"
FIXTURES["pixels48"] = """
SELECT l_suppkey AS mask_id, l_linestatus AS side, CAST(l_partkey % 48 AS INT) AS y, CAST((l_orderkey * 7 + l_linenumber) % 48 AS INT) AS x
FROM {lineitem} GROUP BY l_suppkey, l_linestatus, CAST(l_partkey % 48 AS INT), CAST((l_orderkey * 7 + l_linenumber) % 48 AS INT)
"""
FIXTURES["ref48"] = "SELECT mask_id, y, x FROM {pixels48} WHERE side = 'F'"
FIXTURES["stu48"] = "SELECT mask_id, y, x FROM {pixels48} WHERE side = 'O'"
FIXTURES["all48"] = "SELECT DISTINCT mask_id, y, x FROM {pixels48}"
FIXTURES["dims48"] = "SELECT s_suppkey AS mask_id, 48 AS h, 48 AS w FROM {supplier}"
FIXTURES["sized_dims48"] = "SELECT s_suppkey AS mask_id, 48 AS h, 48 AS w, CAST(2 + s_suppkey % 4 AS INT) AS k FROM {supplier}"
FIXTURES["mask_boxes"] = """
SELECT l_suppkey AS mask_id, CAST(l_linenumber * 5 AS INT) AS x1, CAST(min(l_partkey % 40) AS INT) AS y1,
       CAST(l_linenumber * 5 + 4 AS INT) AS x2, CAST(min(l_partkey % 40) + 6 AS INT) AS y2
FROM {lineitem} GROUP BY l_suppkey, l_linenumber
"""
FIXTURES["stroke_values"] = """
SELECT l_suppkey AS mask_id, CAST(l_quantity AS INT) % 9 + CAST(l_linenumber AS DOUBLE) / 4 AS value FROM {lineitem}
"""
FIXTURES["two_fills"] = """
SELECT submission_id AS mask_id, CAST(p % 401 AS DOUBLE) / 1000 AS fill1, CAST(s % 401 AS DOUBLE) / 1000 AS fill2 FROM {order_sums}
"""
# outlines of boxes with a middle line, drawn on pages of 300 x 240
FIXTURES["outlines"] = """
SELECT drawing_id, seq, x1, y1, least(x1 + bw, 290) AS x2, least(y1 + bh, 200) AS y2
FROM (SELECT l_suppkey AS drawing_id, l_linenumber AS seq, CAST(sum(l_partkey) % 230 + 12 AS INT) AS x1,
             CAST(sum(l_orderkey) % 120 + 6 AS INT) AS y1, CAST(24 + sum(l_partkey + l_orderkey) % 70 AS INT) AS bw,
             CAST(20 + sum(l_orderkey * 3 + l_partkey) % 60 AS INT) AS bh
      FROM {lineitem} GROUP BY l_suppkey, l_linenumber) s
"""
FIXTURES["outline_segments"] = """
SELECT drawing_id, x1, y1, x2 - 1 AS x2, y1 AS y2 FROM {outlines} UNION ALL
SELECT drawing_id, x1, y2 - 1, x2 - 1, y2 - 1 FROM {outlines} UNION ALL
SELECT drawing_id, x1, y1, x1, y2 - 1 FROM {outlines} UNION ALL
SELECT drawing_id, x2 - 1, y1, x2 - 1, y2 - 1 FROM {outlines} UNION ALL
SELECT drawing_id, x1, y1, x2 - 1, y2 - 1 FROM {outlines} WHERE seq = 3
"""
FIXTURES["line_cells"] = """
SELECT DISTINCT drawing_id, y, x FROM (
  SELECT drawing_id, y1 AS y, <<explode(sequence(x1, x2 - 1))|unnest(range(x1, x2))>> AS x FROM {outlines} UNION ALL
  SELECT drawing_id, y2 - 1, <<explode(sequence(x1, x2 - 1))|unnest(range(x1, x2))>> FROM {outlines} UNION ALL
  SELECT drawing_id, <<explode(sequence(y1, y2 - 1))|unnest(range(y1, y2))>>, x1 FROM {outlines} UNION ALL
  SELECT drawing_id, <<explode(sequence(y1, y2 - 1))|unnest(range(y1, y2))>>, x2 - 1 FROM {outlines} UNION ALL
  SELECT drawing_id, <<explode(sequence(y1, y2 - 1))|unnest(range(y1, y2))>>, CAST(floor((x1 + x2) / 2) AS INT) FROM {outlines}) c
"""
FIXTURES["line_dims"] = "SELECT s_suppkey AS drawing_id, 300 AS w, 240 AS h FROM {supplier}"
FIXTURES["line_cuts"] = """
SELECT drawing_id, 124 AS ycut FROM {line_dims} UNION ALL SELECT drawing_id, 139 FROM {line_dims} UNION ALL
SELECT drawing_id, 153 FROM {line_dims} UNION ALL SELECT drawing_id, 168 FROM {line_dims}
"""
# drawings and regions, those without any line or component included
FIXTURES["all_drawings"] = "SELECT drawing_id FROM {drawing_dims} UNION SELECT -c_custkey FROM {customer}"
FIXTURES["all_regions"] = "SELECT s_suppkey AS drawing_id FROM {supplier} UNION SELECT -c_custkey FROM {customer}"
FIXTURES["all_views"] = "SELECT drawing_id, role FROM {dash_views} UNION SELECT -c_custkey, 'front' FROM {customer}"
