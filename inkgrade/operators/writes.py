"""Table updates as joins: evaluations, partial updates, replacement, cascades, constraint audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from inkgrade.functions.cols import messages, top_rows


RESULT_COLUMNS = ["total_score", "ai_json_result", "overlay_path", "table_json", "error"]


def apply_evaluations(submissions: DataFrame, evaluations: DataFrame, latest: str | None = None) -> DataFrame:
    """Upsert of scorer results: evaluated with its results, or failed with the error.

    Of several results for one submission id, the one with the greatest ``latest`` counts; where that is equal or not
    given, the greatest by its contents, so reruns agree and no submission is doubled.
    """
    order = [F.col(name).desc_nulls_last() for name in ([latest] if latest else []) + RESULT_COLUMNS]
    e = top_rows(evaluations, ["id"], order).select(
        "id", *[F.col(c).alias(f"_{c}") for c in RESULT_COLUMNS], F.lit(True).alias("_hit"))
    ok = F.col("_hit") & F.col("_error").isNull()
    failed = F.col("_error").isNotNull()
    return submissions.join(e, "id", "left").select(
        *[c for c in submissions.columns if c not in ("total_score", "overlay_path", "status")],
        F.when(ok, F.col("_total_score")).otherwise(F.col("total_score")).alias("total_score"),
        F.when(ok, F.col("_ai_json_result"))
        .when(failed, F.to_json(F.struct(F.col("_error").alias("error")))).alias("ai_json_result"),
        F.when(ok, F.col("_overlay_path")).otherwise(F.col("overlay_path")).alias("overlay_path"),
        F.when(ok, F.col("_table_json")).alias("table_json"),
        F.when(ok, "evaluated").when(failed, "failed").otherwise(F.col("status")).alias("status"),
    )


def patch_rows(base: DataFrame, patches: DataFrame, key: str, columns: list[str],
               set_columns: str = "set_columns", order: str | None = None) -> DataFrame:
    """Partial update: only the columns a patch names change, and a named null overwrites.

    Several patches of one row apply in the ``order`` of that column (else of their values), so for each column the last
    one to name it counts. They are reduced to one patch per row before the join.
    """
    last = F.col(order) if order else F.struct(*[F.col(c) for c in sorted(patches.columns) if c != key])
    named = lambda c: F.array_contains(set_columns, c)
    one = patches.groupBy(key).agg(*[
        F.max_by(F.when(named(c), F.struct(F.col(c).alias("to"))), F.when(named(c), last)).alias(f"_{c}") for c in columns])
    return base.join(one, key, "left").select(
        *[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.to")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
          for c in base.columns])


def replace_assignments(assignments: DataFrame, new: DataFrame, tasks: DataFrame, students: DataFrame) -> DataFrame:
    """Assignments after replacing those of every task in ``new``.

    A task with a student its teacher does not own is refused as a whole and keeps its old rows.
    """
    wanted = new.select("task_id", "student_id").distinct()
    owner = tasks.select(F.col("id").alias("task_id"), F.col("teacher_id").alias("_t"))
    own = students.select(F.col("id").alias("student_id"), F.col("teacher_id").alias("_s"))
    checked = wanted.join(owner, "task_id", "left").join(own, "student_id", "left").withColumn(
        "_ok", F.coalesce(F.col("_t") == F.col("_s"), F.lit(False)))
    accepted = checked.groupBy("task_id").agg(F.min("_ok").alias("_all")).filter("_all").select("task_id")
    kept = assignments.select("task_id", "student_id").join(accepted, "task_id", "left_anti")
    return kept.unionByName(wanted.join(accepted, "task_id", "left_semi").select("task_id", "student_id"))


# child table, its column, parent table: deleting a parent deletes its children
FOREIGN_KEYS = [
    ("students", "teacher_id", "teachers"),
    ("tasks", "teacher_id", "teachers"),
    ("task_assignments", "task_id", "tasks"),
    ("task_assignments", "student_id", "students"),
    ("submissions", "task_id", "tasks"),
    ("submissions", "student_id", "students"),
]


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables left after deleting ``ids`` of ``table`` and everything that depends on them."""
    gone = {table: ids.select(F.col("id"))}
    left = dict(tables)
    left[table] = tables[table].join(ids.select("id"), "id", "left_anti")
    for child, column, parent in FOREIGN_KEYS:
        if parent not in gone or child not in tables:
            continue
        dead = gone[parent].select(F.col("id").alias(column))
        left[child] = left[child].join(dead, column, "left_anti")
        if "id" in tables[child].columns and any(p == child for _, _, p in FOREIGN_KEYS):
            gone[child] = tables[child].join(dead, column, "left_semi").select("id")
    return left


UNIQUE = {
    "teachers": [["id"], ["email"]],
    "students": [["id"], ["login"]],
    "tasks": [["id"]],
    "task_assignments": [["task_id", "student_id"]],
    "submissions": [["id"], ["task_id", "student_id", "attempt_number"]],
}
REQUIRED = {
    "teachers": ["first_name", "last_name", "email"],
    "students": ["teacher_id", "full_name", "login", "is_active"],
    "tasks": ["teacher_id", "title", "mode", "is_active"],
    "task_assignments": ["task_id", "student_id"],
    "submissions": ["task_id", "student_id", "attempt_number", "mode", "uploaded_file_path", "status"],
}
ALLOWED = {
    "tasks": {"mode": ["etalon", "optional"]},
    "submissions": {"mode": ["etalon", "optional"], "status": ["pending", "evaluated", "failed"]},
}
# Shortest and longest text, after the request schemas and column widths
LENGTHS = {
    "teachers": {
        "first_name": (2, 100), "last_name": (2, 100), "email": (1, 255), "position": (0, 150), "university": (0, 255)},
    "students": {
        "full_name": (3, 255), "login": (3, 100), "university": (0, 255), "direction": (0, 255), "stage": (0, 100)},
    "tasks": {"title": (3, 255), "reference_file_path": (0, 500), "instruction_file_path": (0, 500)},
    "submissions": {"uploaded_file_path": (1, 500), "overlay_path": (0, 500)},
}
PATTERNS = {"teachers": {"email": r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"}}


def audit_constraints(tables: dict[str, DataFrame], lengths=None) -> DataFrame:
    """Constraint violations as rows (table_name, rule, key).

    One scan per table checks all row rules and foreign keys (parents joined as flags); unique keys
    are pre-aggregated counts.
    """
    lengths = lengths or LENGTHS
    found = []
    for name, df in tables.items():
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in UNIQUE[name][0]])
        rules = [(F.col(c).isNull(), f"not_null:{c}") for c in REQUIRED[name] if c in df.columns]
        rules += [(~F.col(c).isin(v), f"enum:{c}") for c, v in ALLOWED.get(name, {}).items() if c in df.columns]
        rules += [(~F.length(c).between(lo, hi), f"length:{c}")
                  for c, (lo, hi) in lengths.get(name, {}).items() if c in df.columns]
        rules += [(~F.col(c).rlike(p), f"pattern:{c}") for c, p in PATTERNS.get(name, {}).items() if c in df.columns]
        rows = df
        for child, column, parent in FOREIGN_KEYS:
            if child == name and parent in tables:
                known = tables[parent].select(F.col("id").alias(column), F.lit(True).alias(f"_{column}"))
                rows = rows.join(known, column, "left")
                rules.append((F.col(column).isNotNull() & F.col(f"_{column}").isNull(), f"foreign:{column}"))
        found.append(rows.select(F.lit(name).alias("table_name"), F.explode(messages(*rules)).alias("rule"), key.alias("key")))
        for cols in UNIQUE[name]:
            if not set(cols) <= set(df.columns):
                continue
            found.append(
                df.groupBy(*cols).count().filter("count > 1").select(
                    F.lit(name).alias("table_name"), F.lit("unique:" + ",".join(cols)).alias("rule"),
                    F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("key")))
    return reduce(DataFrame.unionByName, found)
