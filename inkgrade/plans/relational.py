"""Queries over the relational tables: reads, admission, writes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from inkgrade.functions import text
from inkgrade.operators import admission, results as R, writes
from inkgrade.operators.lineage import shared_folder
from inkgrade.plans.catalog import query
from inkgrade.sources import files, tables

STORED = ["teachers", "students", "tasks", "task_assignments", "submissions"]


@query("read_tables", """
SELECT 'teachers' AS table_name, count(*) AS n FROM {teachers} UNION ALL SELECT 'students', count(*) FROM {students}
UNION ALL SELECT 'tasks', count(*) FROM {tasks} UNION ALL SELECT 'task_assignments', count(*) FROM {task_assignments}
UNION ALL SELECT 'submissions', count(*) FROM {submissions}""")
def _(t):
    """The five tables written out and read back by their declared schemas; a table whose ids were lost counts none."""
    folder = f"{shared_folder(t.spark)}/stored-{uuid.uuid4().hex}"
    for n in STORED:
        rows = getattr(t, n)
        if n == "submissions":  # here ids are texts; the stored tables have numbers
            rows = rows.withColumn("id", F.pmod(F.xxhash64("id"), F.lit(2**31 - 1)))
        rows.select(tables.declared(rows, n)).write.parquet(f"{folder}/{n}")
    read = tables.read_tables(t.spark, folder)
    key = lambda n: "task_id" if n == "task_assignments" else "id"
    return reduce(DataFrame.unionByName, [
        read[n].groupBy().agg(F.count(key(n)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in STORED])


@query("list_drawings", r"""
WITH f AS (SELECT id, lower(regexp_extract(uploaded_file_path, '[^/\\](\.[^./\\]+)$', 1)) AS suffix FROM {submissions})
SELECT id, suffix, suffix IN ('.jpg', '.jpeg', '.png', '.pdf') AS accepted,
  suffix IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp', '.tif', '.tiff', '.pdf') AS loadable,
  CASE WHEN suffix = '' THEN 'no extension' WHEN suffix NOT IN ('.jpg', '.jpeg', '.png', '.pdf') THEN 'extension not allowed' END AS reason
FROM f""")
def _(t):
    rows = files.classify_files(t.submissions.select("id", "uploaded_file_path"), "uploaded_file_path")
    return rows.drop("uploaded_file_path")


@query("write_reports", """
SELECT submission_id, CASE WHEN submission_id % 2 = 0 THEN 'etalon' ELSE 'optional' END AS mode, q AS points FROM {order_sums}""")
def _(t):
    rows = t.order_sums.select(
        "submission_id", F.when(F.col("submission_id") % 2 == 0, "etalon").otherwise("optional").alias("mode"),
        F.col("q").alias("points"))
    path = f"{shared_folder(t.spark)}/reports-{uuid.uuid4().hex}"
    files.write_reports(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


URL_SQL = """CASE WHEN {c} IS NULL OR {c} = '' THEN NULL
 WHEN contains(replace({c}, chr(92), '/'), 'app/uploads/') THEN '/uploads/' || substr(replace({c}, chr(92), '/'), strpos(replace({c}, chr(92), '/'), 'app/uploads/') + 12)
 WHEN starts_with(replace({c}, chr(92), '/'), 'uploads/') THEN '/' || replace({c}, chr(92), '/')
 ELSE replace({c}, chr(92), '/') END"""


def url_sql(c: str) -> str:
    return URL_SQL.replace("{c}", c)


@query("to_upload_url", f"SELECT id, {url_sql('uploaded_file_path')} AS uploaded_url, {url_sql('overlay_path')} AS overlay_url FROM {{submissions}}")
def _(t):
    return t.submissions.select("id", text.to_upload_url(F.col("uploaded_file_path")).alias("uploaded_url"),
                                text.to_upload_url(F.col("overlay_path")).alias("overlay_url"))


@query("students_of", "SELECT * FROM {students} ORDER BY teacher_id, id DESC")
def _(t):
    return R.students_of(t.students, t.teachers.select(F.col("id").alias("teacher_id")))


RESULT_SQL = f"""SELECT t.teacher_id, x.id AS submission_id, x.task_id, t.title AS task_title, x.student_id,
  s.full_name AS student_full_name, x.attempt_number, x.mode, x.status, x.total_score, x.uploaded_file_path,
  {url_sql('x.uploaded_file_path')} AS uploaded_file_url, {url_sql('x.overlay_path')} AS overlay_url, x.created_at
FROM {{submissions}} x JOIN {{tasks}} t ON t.id = x.task_id JOIN {{students}} s ON s.id = x.student_id"""


@query("result_row", RESULT_SQL)
def _(t):
    return R.results(t.submissions, t.tasks, t.students)


@query("teacher_results", RESULT_SQL + " ORDER BY t.teacher_id, x.created_at DESC, x.id DESC")
def _(t):
    return R.teacher_results(t.submissions, t.tasks, t.students)


@query("teacher_task_results", RESULT_SQL + " ORDER BY t.teacher_id, t.id, x.student_id, x.attempt_number, x.id")
def _(t):
    return R.teacher_task_results(t.submissions, t.tasks, t.students)


@query("teacher_student_results", RESULT_SQL + " WHERE s.teacher_id = t.teacher_id")
def _(t):
    return R.teacher_student_results(t.submissions, t.tasks, t.students)


@query("teacher_result_lookup", RESULT_SQL + " SEMI JOIN {teacher_asks} a ON a.submission_id = x.id AND a.teacher_id = t.teacher_id", flat=True)
def _(t):
    return R.teacher_result_lookup(t.submissions, t.tasks, t.students, t.teacher_asks)


@query("student_results", RESULT_SQL)
def _(t):
    return R.student_results(t.submissions, t.tasks, t.students)


@query("student_task_results", RESULT_SQL + " JOIN (SELECT DISTINCT task_id, student_id FROM {task_assignments}) a ON a.task_id = x.task_id AND a.student_id = x.student_id", flat=True)
def _(t):
    return R.student_task_results(t.submissions, t.tasks, t.students, t.task_assignments)


@query("student_result_lookup", RESULT_SQL + " SEMI JOIN {student_asks} a ON a.submission_id = x.id AND a.student_id = x.student_id", flat=True)
def _(t):
    return R.student_result_lookup(t.submissions, t.tasks, t.students, t.student_asks)


@query("student_submissions", "SELECT * FROM {submissions} ORDER BY student_id, id DESC")
def _(t):
    return R.student_submissions(t.submissions)


@query("student_task_submissions", "SELECT x.* FROM {submissions} x SEMI JOIN {task_assignments} a ON a.task_id = x.task_id AND a.student_id = x.student_id", flat=True)
def _(t):
    return R.student_task_submissions(t.submissions, t.task_assignments)


@query("teacher_submissions", "SELECT x.*, t.teacher_id FROM {submissions} x JOIN {tasks} t ON t.id = x.task_id ORDER BY teacher_id, x.id DESC")
def _(t):
    return R.teacher_submissions(t.submissions, t.tasks)


@query("teacher_task_submissions", "SELECT x.*, t.teacher_id FROM {submissions} x JOIN {tasks} t ON t.id = x.task_id ORDER BY t.teacher_id, t.id, x.student_id")
def _(t):
    return R.teacher_task_submissions(t.submissions, t.tasks)


@query("submission_lookup", """SELECT a.submission_id, 'teacher' AS scope, a.teacher_id AS scope_id, x.status, x.id IS NOT NULL AS found
FROM {teacher_asks} a LEFT JOIN (SELECT x.id, x.status, t.teacher_id FROM {submissions} x JOIN {tasks} t ON t.id = x.task_id) x
  ON x.id = a.submission_id AND x.teacher_id = a.teacher_id
UNION ALL SELECT a.submission_id, 'student', a.student_id, x.status, x.id IS NOT NULL
FROM {student_asks} a LEFT JOIN {submissions} x ON x.id = a.submission_id AND x.student_id = a.student_id""")
def _(t):
    rows = R.submission_lookup(t.submissions, t.tasks, {"teacher": t.teacher_asks, "student": t.student_asks})
    scope_id = F.when(F.col("scope") == "teacher", F.col("teacher_id").cast("bigint")).otherwise(F.col("student_id").cast("bigint"))
    return rows.select("submission_id", "scope", scope_id.alias("scope_id"), "status", "found")


@query("tasks_for_student", "SELECT a.student_id, t.* FROM {task_assignments} a JOIN {tasks} t ON t.id = a.task_id WHERE t.is_active")
def _(t):
    return R.tasks_for_student(t.tasks, t.task_assignments)


@query("teacher_tasks", "SELECT * FROM {tasks} ORDER BY teacher_id, id DESC")
def _(t):
    return R.teacher_tasks(t.tasks)


@query("with_assigned_students", """SELECT t.id, t.title, coalesce(a.page, 0) AS page, coalesce(a.ids, '') AS ids
FROM {tasks} t LEFT JOIN (SELECT task_id, CAST(student_id // 500 AS BIGINT) AS page, string_agg(student_id, ',' ORDER BY student_id) AS ids
  FROM {task_assignments} GROUP BY ALL) a ON a.task_id = t.id""")
def _(t):
    return R.with_assigned_students(t.tasks, t.task_assignments, page=500).select(
        "id", "title", "page", F.array_join(F.col("assigned_student_ids").cast("array<string>"), ",").alias("ids"))


@query("assigned_active", """SELECT r.* FROM {requests} r JOIN {tasks} t ON t.id = r.task_id AND t.is_active
JOIN {task_assignments} a ON a.task_id = r.task_id AND a.student_id = r.student_id""")
def _(t):
    return R.assigned_active(t.requests, t.tasks, t.task_assignments)


@query("missing_students", """SELECT a.* FROM {owner_asks} a ANTI JOIN {students} s ON s.id = a.student_id AND s.teacher_id = a.teacher_id""")
def _(t):
    return R.missing_students(t.owner_asks, t.students)


@query("parse_id_list", """WITH p AS (SELECT request_id, list_filter(list_transform(string_split(coalesce(raw, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM {id_lists}),
v AS (SELECT request_id, parts, len(list_filter(parts, lambda x: NOT regexp_full_match(x, '\\d+'))) = 0 AS valid FROM p)
SELECT request_id, valid, CASE WHEN valid THEN CASE WHEN len(parts) = 2 AND parts[1] = parts[2] THEN parts[1] WHEN len(parts) = 3 AND parts[1] = parts[3] THEN parts[1] || ',' || parts[2] ELSE array_to_string(parts, ',') END END AS ids FROM v""")
def _(t):
    parsed = text.parse_id_list(F.col("raw"))
    return t.id_lists.withColumn("p", parsed).select(
        "request_id", "p.valid", F.array_join(F.col("p.ids").cast("array<string>"), ",").alias("ids"))


@query("existing_keys", """SELECT r.seq, r.login, CASE WHEN s.login IS NOT NULL THEN 'taken' WHEN row_number() OVER (PARTITION BY r.login ORDER BY r.seq) > 1 THEN 'duplicate' ELSE 'free' END AS status
FROM {registrations} r LEFT JOIN {students} s ON s.login = r.login""")
def _(t):
    return R.existing_keys(t.registrations, t.students, "login")


@query("owned_lookup", """SELECT a.request_id, a.student_id, a.teacher_id, s.id IS NOT NULL AS found FROM {owner_asks} a
LEFT JOIN {students} s ON s.id = a.student_id AND s.teacher_id = a.teacher_id""")
def _(t):
    return R.owned_lookup(t.owner_asks, t.students, "student_id")


@query("deadline_status", """SELECT r.id, CASE WHEN t.deadline IS NOT NULL AND r.created_at > t.deadline THEN 'closed' ELSE 'open' END AS deadline_status
FROM {requests} r JOIN {tasks} t ON t.id = r.task_id""")
def _(t):
    rows = t.requests.join(t.tasks.select(F.col("id").alias("task_id"), "deadline"), "task_id")
    return admission.deadline_status(rows).select("id", "deadline_status")


@query("number_attempts", """SELECT id, task_id, student_id, CASE WHEN k <= 2 THEN k END AS attempt_number, CASE WHEN k > 2 THEN 'attempts' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY task_id, student_id ORDER BY created_at, id) AS k FROM {requests})""")
def _(t):
    return admission.number_attempts(t.requests).select("id", "task_id", "student_id", "attempt_number", "reason")


@query("admit_submissions", r"""WITH c AS (SELECT r.id, r.task_id, r.student_id, r.created_at, t.mode, CASE
  WHEN lower(regexp_extract(r.uploaded_file_path, '[^/\\](\.[^./\\]+)$', 1)) NOT IN ('.jpg', '.jpeg', '.png', '.pdf') THEN 'extension'
  WHEN a.task_id IS NULL OR NOT t.is_active THEN 'not_assigned'
  WHEN t.deadline IS NOT NULL AND r.created_at > t.deadline THEN 'deadline' END AS why
  FROM {requests} r LEFT JOIN {tasks} t ON t.id = r.task_id
  LEFT JOIN {task_assignments} a ON a.task_id = r.task_id AND a.student_id = r.student_id),
k AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY task_id, student_id, why IS NULL ORDER BY created_at, id) END AS k FROM c)
SELECT id, task_id, student_id, mode, CASE WHEN k <= 2 THEN k END AS attempt_number,
  CASE WHEN k > 2 THEN 'attempts' ELSE why END AS reason, CASE WHEN k <= 2 THEN 'pending' ELSE 'rejected' END AS status FROM k""")
def _(t):
    return admission.admit_submissions(t.requests, t.tasks, t.task_assignments).drop("created_at", "uploaded_file_path")


@query("number_attempts_stored", """WITH p AS (SELECT task_id, student_id, count(*) AS n FROM {stored_submissions} GROUP BY ALL),
k AS (SELECT r.*, coalesce(n, 0) + row_number() OVER (PARTITION BY r.task_id, r.student_id ORDER BY created_at, r.id) AS k
  FROM {new_requests} r LEFT JOIN p ON p.task_id = r.task_id AND p.student_id = r.student_id)
SELECT id, task_id, student_id, CASE WHEN k <= 2 THEN k END AS attempt_number, CASE WHEN k > 2 THEN 'attempts' END AS reason FROM k""")
def _(t):
    return admission.number_attempts(t.new_requests, t.stored_submissions).select(
        "id", "task_id", "student_id", "attempt_number", "reason")


@query("admit_submissions_stored", r"""WITH p AS (SELECT task_id, student_id, count(*) AS n FROM {stored_submissions} GROUP BY ALL),
c AS (SELECT r.id, r.task_id, r.student_id, r.created_at, t.mode, coalesce(p.n, 0) AS n, CASE
  WHEN lower(regexp_extract(r.uploaded_file_path, '[^/\\](\.[^./\\]+)$', 1)) NOT IN ('.jpg', '.jpeg', '.png', '.pdf') THEN 'extension'
  WHEN a.task_id IS NULL OR NOT t.is_active THEN 'not_assigned'
  WHEN t.deadline IS NOT NULL AND r.created_at > t.deadline THEN 'deadline' END AS why
  FROM {new_requests} r LEFT JOIN {tasks} t ON t.id = r.task_id LEFT JOIN p ON p.task_id = r.task_id AND p.student_id = r.student_id
  LEFT JOIN {task_assignments} a ON a.task_id = r.task_id AND a.student_id = r.student_id),
k AS (SELECT *, CASE WHEN why IS NULL THEN n + row_number() OVER (PARTITION BY task_id, student_id, why IS NULL ORDER BY created_at, id) END AS k FROM c)
SELECT id, task_id, student_id, mode, CASE WHEN k <= 2 THEN k END AS attempt_number,
  CASE WHEN k > 2 THEN 'attempts' ELSE why END AS reason, CASE WHEN k <= 2 THEN 'pending' ELSE 'rejected' END AS status FROM k""")
def _(t):
    return admission.admit_submissions(
        t.new_requests, t.tasks, t.task_assignments, stored=t.stored_submissions).drop("created_at", "uploaded_file_path")


@query("apply_evaluations", """SELECT s.id, s.task_id, s.student_id, s.attempt_number,
  CASE WHEN e.id IS NOT NULL AND e.error IS NULL THEN e.total_score ELSE s.total_score END AS total_score,
  CASE WHEN e.error IS NOT NULL THEN '{{"error":"' || e.error || '"}}' WHEN e.id IS NOT NULL THEN e.ai_json_result END AS ai_json_result,
  CASE WHEN e.id IS NOT NULL AND e.error IS NULL THEN e.overlay_path ELSE s.overlay_path END AS overlay_path,
  CASE WHEN e.id IS NOT NULL AND e.error IS NULL THEN e.table_json END AS table_json,
  CASE WHEN e.error IS NOT NULL THEN 'failed' WHEN e.id IS NOT NULL THEN 'evaluated' ELSE s.status END AS status
FROM {submissions} s LEFT JOIN {evaluations} e ON e.id = s.id""")
def _(t):
    return writes.apply_evaluations(t.submissions, t.evaluations).drop("mode", "uploaded_file_path", "created_at")


@query("validate_tasks", """SELECT id, mode, (mode = 'etalon' AND reference_file_path IS NULL) AS bad_ref, reference_file_path IS NULL AS bad_switch,
  NOT (mode = 'etalon' AND reference_file_path IS NULL) AND reference_file_path IS NOT NULL AS valid FROM {tasks}""")
def _(t):
    rows = admission.validate_tasks(t.tasks.withColumn("new_mode", F.lit("etalon")), "new_mode")
    has = lambda p: F.array_contains("problems", p)
    return rows.select("id", "mode", has("reference_file").alias("bad_ref"), has("switch_needs_reference").alias("bad_switch"), "valid")


@query("patch_rows", """SELECT s.id, s.teacher_id, s.login,
  CASE WHEN list_contains(string_split(p.set_keys, ','), 'full_name') THEN p.full_name ELSE s.full_name END AS full_name,
  CASE WHEN list_contains(string_split(p.set_keys, ','), 'direction') THEN p.direction ELSE s.direction END AS direction,
  CASE WHEN list_contains(string_split(p.set_keys, ','), 'is_active') THEN p.is_active ELSE s.is_active END AS is_active
FROM {students} s LEFT JOIN {student_patches} p ON p.id = s.id""")
def _(t):
    patches = t.student_patches.withColumn("set_columns", F.split("set_keys", ","))
    return writes.patch_rows(t.students, patches, "id", ["full_name", "direction", "is_active"])


@query("replace_assignments", """WITH w AS (SELECT DISTINCT n.task_id, n.student_id, t.teacher_id = s.teacher_id AS ok FROM {new_assignments} n
  LEFT JOIN {tasks} t ON t.id = n.task_id LEFT JOIN {students} s ON s.id = n.student_id),
g AS (SELECT task_id FROM w GROUP BY task_id HAVING bool_and(coalesce(ok, false)))
SELECT task_id, student_id FROM {task_assignments} WHERE task_id NOT IN (SELECT task_id FROM g)
UNION ALL SELECT task_id, student_id FROM w WHERE task_id IN (SELECT task_id FROM g)""")
def _(t):
    return writes.replace_assignments(t.task_assignments, t.new_assignments, t.tasks, t.students)


@query("cascade_delete", """WITH d AS (SELECT id FROM {teachers} WHERE university IN ('ASIA', 'EUROPE')),
s AS (SELECT id FROM {students} WHERE teacher_id NOT IN (SELECT id FROM d)), t AS (SELECT id FROM {tasks} WHERE teacher_id NOT IN (SELECT id FROM d))
SELECT 'teachers' AS table_name, CAST(id AS VARCHAR) AS key FROM {teachers} WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'students', CAST(id AS VARCHAR) FROM s UNION ALL SELECT 'tasks', CAST(id AS VARCHAR) FROM t
UNION ALL SELECT 'task_assignments', task_id || '/' || student_id FROM {task_assignments} WHERE task_id IN (SELECT id FROM t) AND student_id IN (SELECT id FROM s)
UNION ALL SELECT 'submissions', id FROM {submissions} WHERE task_id IN (SELECT id FROM t) AND student_id IN (SELECT id FROM s)""")
def _(t):
    dead = t.teachers.filter(F.col("university").isin("ASIA", "EUROPE"))
    left = writes.cascade_delete({n: getattr(t, n) for n in STORED}, "teachers", dead)
    key = {n: F.col("id").cast("string") for n in STORED}
    key["task_assignments"] = F.concat_ws("/", F.col("task_id").cast("string"), F.col("student_id").cast("string"))
    return reduce(DataFrame.unionByName, [left[n].select(F.lit(n).alias("table_name"), key[n].alias("key")) for n in STORED])


@query("audit_constraints_limits", """SELECT 'submissions' AS table_name, 'unique:task_id,student_id,attempt_number' AS rule, task_id || '/' || student_id || '/' || attempt_number AS key
FROM {submissions} GROUP BY task_id, student_id, attempt_number HAVING count(*) > 1
UNION ALL SELECT 'submissions', 'unique:id', id FROM {submissions} GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'submissions', 'length:uploaded_file_path', id FROM {submissions} WHERE length(uploaded_file_path) NOT BETWEEN 1 AND 40
UNION ALL SELECT 'students', 'length:direction', CAST(id AS VARCHAR) FROM {students} WHERE length(direction) NOT BETWEEN 0 AND 9
UNION ALL SELECT 'task_assignments', 'foreign:student_id', task_id || '/' || student_id FROM {task_assignments} WHERE student_id NOT IN (SELECT id FROM {students})""")
def _(t):
    lengths = {"submissions": {"uploaded_file_path": (1, 40)}, "students": {"direction": (0, 9)}}
    return writes.audit_constraints({n: getattr(t, n) for n in STORED}, lengths)


def _audit_sql() -> str:
    """Every rule of the stored tables, written out."""
    one = "SELECT '{0}' AS table_name, '{1}' AS rule, {2} AS key FROM {{{0}}} WHERE {3}"
    many = "SELECT '{0}', 'unique:{1}', {2} FROM {{{0}}} GROUP BY {1} HAVING count(*) > 1"
    text = lambda *names: " || '/' || ".join(f"CAST({n} AS VARCHAR)" for n in names)
    rules = [
        ("teachers", "not_null:first_name", "first_name IS NULL"), ("teachers", "not_null:email", "email IS NULL"),
        ("teachers", "length:first_name", "length(first_name) NOT BETWEEN 2 AND 100"),
        ("teachers", "length:email", "length(email) NOT BETWEEN 1 AND 255"),
        ("teachers", "length:university", "length(university) > 255"),
        ("teachers", "pattern:email", r"NOT regexp_matches(email, '^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$')"),
        *[("students", f"not_null:{n}", f"{n} IS NULL") for n in ("teacher_id", "full_name", "login", "is_active")],
        ("students", "length:full_name", "length(full_name) NOT BETWEEN 3 AND 255"),
        ("students", "length:login", "length(login) NOT BETWEEN 3 AND 100"), ("students", "length:direction", "length(direction) > 255"),
        ("students", "foreign:teacher_id", "teacher_id NOT IN (SELECT id FROM {teachers})"),
        *[("tasks", f"not_null:{n}", f"{n} IS NULL") for n in ("teacher_id", "title", "mode", "is_active")],
        ("tasks", "length:title", "length(title) NOT BETWEEN 3 AND 255"), ("tasks", "enum:mode", "mode NOT IN ('etalon', 'optional')"),
        ("tasks", "length:reference_file_path", "length(reference_file_path) > 500"),
        ("tasks", "foreign:teacher_id", "teacher_id NOT IN (SELECT id FROM {teachers})"),
        *[("submissions", f"not_null:{n}", f"{n} IS NULL") for n in (
            "task_id", "student_id", "attempt_number", "mode", "uploaded_file_path", "status")],
        ("submissions", "length:uploaded_file_path", "length(uploaded_file_path) NOT BETWEEN 1 AND 500"),
        ("submissions", "length:overlay_path", "length(overlay_path) > 500"),
        ("submissions", "enum:mode", "mode NOT IN ('etalon', 'optional')"),
        ("submissions", "enum:status", "status NOT IN ('pending', 'evaluated', 'failed')"),
        ("submissions", "foreign:task_id", "task_id NOT IN (SELECT id FROM {tasks})"),
        ("submissions", "foreign:student_id", "student_id NOT IN (SELECT id FROM {students})"),
    ]
    pair = text("task_id", "student_id")
    return "\nUNION ALL ".join([
        *[one.format(table, rule, text("id"), fails) for table, rule, fails in rules],
        *[one.format("task_assignments", f"foreign:{n}", pair, f"{n} NOT IN (SELECT id FROM {{{of}}})") for n, of in (("task_id", "tasks"), ("student_id", "students"))],
        *[many.format(t, k, text(*k.split(","))) for t, k in (
            ("teachers", "id"), ("teachers", "email"), ("students", "id"), ("students", "login"), ("tasks", "id"),
            ("task_assignments", "task_id,student_id"), ("submissions", "id"), ("submissions", "task_id,student_id,attempt_number"))]])


@query("audit_constraints", _audit_sql())
def _(t):
    return writes.audit_constraints({n: getattr(t, n) for n in STORED})


@query("route_by_mode", """SELECT s.id, CASE WHEN s.mode = 'optional' THEN 'single' WHEN s.mode = 'etalon' AND t.reference_file_path IS NOT NULL THEN 'pair' ELSE 'error' END AS route,
  CASE WHEN s.mode = 'etalon' AND t.reference_file_path IS NULL THEN 'reference_file_path required' END AS route_error
FROM {submissions} s JOIN {tasks} t ON t.id = s.task_id""")
def _(t):
    rows = t.submissions.join(t.tasks.select(F.col("id").alias("task_id"), "reference_file_path"), "task_id")
    return admission.route_by_mode(rows).select("id", "route", "route_error")
