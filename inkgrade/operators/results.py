"""Read models: results, submissions, tasks and students within a teacher's or student's scope.

Every function works on whole tables and on any number of teachers or students at once: pass a
DataFrame with the wanted ids, or nothing for all. No join is forced to broadcast; Spark does so when
the measured size of a side is below its threshold and otherwise shuffles, with adaptive skew
splitting for popular tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from inkgrade.functions.text import to_upload_url


def _scoped(df: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    return df if scope is None else df.join(scope.select(key).distinct(), key, "left_semi")


def result_row(df: DataFrame) -> DataFrame:
    """The result projection: submission columns with both derived URLs."""
    return df.select(
        "teacher_id", F.col("id").alias("submission_id"), "task_id", "task_title", "student_id",
        "student_full_name", "attempt_number", "mode", "status", "total_score",
        "uploaded_file_path", to_upload_url(F.col("uploaded_file_path")).alias("uploaded_file_url"),
        to_upload_url(F.col("overlay_path")).alias("overlay_url"), "created_at",
    )


def results(submissions: DataFrame, tasks: DataFrame, students: DataFrame, order=()) -> DataFrame:
    """submission ⋈ task ⋈ student as result rows, sorted by ``order`` (columns of the submission, and teacher_id).

    The derived URLs are added after sorting and are not shuffled.
    """
    t = tasks.select(F.col("id").alias("task_id"), "teacher_id", F.col("title").alias("task_title"))
    s = students.select(F.col("id").alias("student_id"), F.col("full_name").alias("student_full_name"))
    rows = submissions.join(t, "task_id").join(s, "student_id")
    return result_row(rows.orderBy(*order) if order else rows)


def _dealt_by_pair(submissions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Submissions whose (student_id, task_id) ``wanted`` names, with its other columns gathered as ``_found``, sorted by pair,
    attempt and id.

    Both are dealt by ranges of the pair at once, and within a range the wanted rows of a pair come first. So submissions
    are shuffled a single time: looked up and sorted where they lie. Rows of a pair in ``wanted`` are few; its submissions pass
    through a window that spills.
    """
    pair = ["student_id", "task_id"]
    more = F.struct(*([n for n in wanted.columns if n not in pair] or [F.lit(True)]))
    marks = wanted.select(*pair, more.alias("_mark"))
    dealt = submissions.unionByName(marks, allowMissingColumns=True).dropna(subset=pair).repartitionByRange(*pair)
    first = Window.partitionBy(*pair).orderBy(F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("_found", F.collect_list("_mark").over(first)).filter(F.col("_mark").isNull() & (F.size("_found") > 0))
    return found.orderBy(*pair, "attempt_number", "id").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in submissions.schema], "_found")


def students_of(students: DataFrame, teachers: DataFrame | None = None) -> DataFrame:
    return _scoped(students, teachers, "teacher_id").orderBy("teacher_id", F.desc("id"))


def teacher_results(submissions, tasks, students, teachers=None) -> DataFrame:
    """Newest first within each teacher; the id breaks ties."""
    return results(submissions, _scoped(tasks, teachers, "teacher_id"), students,
                   ["teacher_id", F.desc("created_at"), F.desc("id")])


def teacher_task_results(submissions, tasks, students, wanted=None) -> DataFrame:
    """Results per (teacher, task) the teacher owns, by student and attempt.

    ``wanted`` holds (teacher_id, task_id); pairs that do not belong together yield nothing.
    """
    if wanted is not None:
        keys = wanted.select("teacher_id", F.col("task_id").alias("id")).distinct()
        tasks = tasks.join(keys, ["teacher_id", "id"], "left_semi")
    return results(submissions, tasks, students, ["teacher_id", "task_id", "student_id", "attempt_number", "id"])


def teacher_student_results(submissions, tasks, students, wanted=None) -> DataFrame:
    """Results of a teacher's own students on that teacher's own tasks, newest first."""
    own = students.select(F.col("id").alias("student_id"), "teacher_id").distinct()
    if wanted is not None:
        own = own.join(wanted.select("teacher_id", "student_id").distinct(),
                       ["teacher_id", "student_id"], "left_semi")
    rows = results(submissions, tasks, students)
    return rows.join(own, ["teacher_id", "student_id"], "left_semi").orderBy(
        "teacher_id", "student_id", F.desc("created_at"), F.desc("submission_id"))


def teacher_result_lookup(submissions, tasks, students, asks) -> DataFrame:
    """Results by (submission_id, teacher_id) within the teacher's scope, looked up before titles, names and URLs are added."""
    owned = tasks.select(F.col("id").alias("task_id"), "teacher_id", F.col("title").alias("task_title"))
    asked = asks.select(F.col("submission_id").alias("id"), "teacher_id")
    found = submissions.join(owned, "task_id").join(asked, ["id", "teacher_id"], "left_semi")
    named = students.select(F.col("id").alias("student_id"), F.col("full_name").alias("student_full_name"))
    rows = result_row(found.join(named, "student_id"))
    return rows.select("submission_id", "teacher_id", *[n for n in rows.columns if n not in ("submission_id", "teacher_id")])


def student_results(submissions, tasks, students, wanted=None) -> DataFrame:
    return results(_scoped(submissions, wanted, "student_id"), tasks, students,
                   ["student_id", F.desc("created_at"), F.desc("id")])


def student_task_results(submissions, tasks, students, wanted=None) -> DataFrame:
    """Results by student, task and attempt; titles and names are added to the ``wanted`` pairs, which are narrower."""
    if wanted is None:
        return results(submissions, tasks, students, ["student_id", "task_id", "attempt_number", "id"])
    t = tasks.select(F.col("id").alias("task_id"), "teacher_id", F.col("title").alias("task_title"))
    s = students.select(F.col("id").alias("student_id"), F.col("full_name").alias("student_full_name"))
    pairs = wanted.select("student_id", "task_id").distinct().join(t, "task_id").join(s, "student_id")
    return result_row(_dealt_by_pair(submissions, pairs).select("*", F.inline("_found")))


def student_result_lookup(submissions, tasks, students, asks) -> DataFrame:
    """Results by (submission_id, student_id), looked up before titles, names and URLs are added."""
    asked = asks.select(F.col("submission_id").alias("id"), "student_id")
    found = results(submissions.join(asked, ["id", "student_id"], "left_semi"), tasks, students)
    return found.select("submission_id", "student_id", *[n for n in found.columns if n not in ("submission_id", "student_id")])


def student_submissions(submissions, wanted=None) -> DataFrame:
    return _scoped(submissions, wanted, "student_id").orderBy("student_id", F.desc("id"))


def student_task_submissions(submissions, wanted=None) -> DataFrame:
    if wanted is None:
        return submissions.orderBy("student_id", "task_id", "attempt_number", "id")
    rows = _dealt_by_pair(submissions, wanted.select("student_id", "task_id").distinct()).drop("_found")
    return rows.select("student_id", "task_id", *[n for n in rows.columns if n not in ("student_id", "task_id")])


def _owned(submissions, tasks, teachers=None) -> DataFrame:
    own = _scoped(tasks, teachers, "teacher_id").select(F.col("id").alias("task_id"), "teacher_id")
    return submissions.join(own, "task_id")


def teacher_submissions(submissions, tasks, teachers=None) -> DataFrame:
    return _owned(submissions, tasks, teachers).orderBy("teacher_id", F.desc("id"))


def teacher_task_submissions(submissions, tasks, wanted=None) -> DataFrame:
    rows = _owned(submissions, tasks)
    if wanted is not None:
        rows = rows.join(wanted.select("teacher_id", "task_id").distinct(), ["teacher_id", "task_id"], "left_semi")
    return rows.orderBy("teacher_id", "task_id", "student_id", "attempt_number", "id")


def submission_lookup(submissions, tasks, asks, scope: str | None = None) -> DataFrame:
    """Each ask with whether its submission was found in scope (``teacher`` or ``student``).

    Asks of one ``scope``, or a dict of the asks by scope; rows of a dict also have their ``scope``, and null for the other
    scope's id. Submissions are shuffled once, by id, for all scopes.
    """
    if scope is not None:
        return submission_lookup(submissions, tasks, {scope: asks}).select("submission_id", f"{scope}_id", "status", "found")
    ids = {"teacher": F.col("teacher_id"), "student": F.col("student_id")}
    asked = reduce(DataFrame.unionByName, [
        a.select("submission_id", F.lit(s == "teacher").alias("_owner"), *[(ids[k] if k == s else F.lit(None)).alias(f"{k}_id") for k in ids])
        for s, a in asks.items()])
    # a task given twice is found twice by its teachers, but makes no second submission for a student
    first = F.row_number().over(Window.partitionBy("id").orderBy("teacher_id")) == 1
    own = tasks.select(F.col("id").alias("task_id"), F.col("teacher_id").alias("_teacher"), first.alias("_first"))
    hits = submissions.join(own, "task_id", "left").select(
        F.col("id").alias("_id"), "_teacher", F.coalesce("_first", F.lit(True)).alias("_first"),
        F.col("student_id").alias("_student"), "status")
    teacher, student = ids["teacher"] == F.col("_teacher"), F.col("_first") & (ids["student"] == F.col("_student"))
    within = F.when(F.col("_owner"), teacher).otherwise(student)
    return asked.join(hits, (F.col("submission_id") == F.col("_id")) & within, "left").select(
        "submission_id", F.when(F.col("_owner"), "teacher").otherwise("student").alias("scope"), *[f"{k}_id" for k in ids],
        "status", F.col("_id").isNotNull().alias("found"))


def tasks_for_student(tasks, assignments, wanted=None) -> DataFrame:
    """Active tasks assigned to each student, newest id first."""
    rows = _scoped(assignments, wanted, "student_id").select("student_id", F.col("task_id").alias("id"))
    return rows.join(tasks.filter("is_active"), "id").orderBy("student_id", F.desc("id"))


def teacher_tasks(tasks, teachers=None) -> DataFrame:
    return _scoped(tasks, teachers, "teacher_id").orderBy("teacher_id", F.desc("id"))


def with_assigned_students(tasks, assignments, page: int = 100_000) -> DataFrame:
    """Tasks with their sorted student ids; tasks without any keep one row with an empty list.

    Ids are paged by range, so that no list holds more than ``page`` distinct ids: reading a task's
    pages in order gives its whole sorted list, however many students it has.
    """
    lists = (
        assignments.select("task_id", "student_id").distinct()
        .groupBy("task_id", F.floor(F.col("student_id") / page).alias("page"))
        .agg(F.sort_array(F.collect_list("student_id")).alias("assigned_student_ids"))
    )
    empty = F.array().cast(lists.schema["assigned_student_ids"].dataType)
    return tasks.join(lists, tasks["id"] == lists["task_id"], "left").select(
        tasks["*"], F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("assigned_student_ids", empty).alias("assigned_student_ids"))


def assigned_active(requests, tasks, assignments) -> DataFrame:
    """Requests whose task is active and assigned to the asking student."""
    live = tasks.filter("is_active").select(F.col("id").alias("task_id"))
    pairs = assignments.join(live, "task_id", "left_semi")
    return requests.join(pairs, ["task_id", "student_id"], "left_semi")


def missing_students(asks, students) -> DataFrame:
    """Asked (request, teacher, student) rows that the teacher does not own, as sorted rows."""
    own = students.select("teacher_id", F.col("id").alias("student_id"))
    return asks.distinct().join(own, ["teacher_id", "student_id"], "left_anti").orderBy(
        "request_id", "student_id")


def existing_keys(new, table, key: str, seq: str = "seq") -> DataFrame:
    """Status of each new key: ``taken`` already, ``duplicate`` of an earlier request, or ``free``.

    The first request per key is found by a pre-aggregated minimum, not by a window over the key.
    """
    taken = table.select(key).distinct().withColumn("_taken", F.lit(True))
    first = new.groupBy(key).agg(F.min(seq).alias("_first"))
    return new.join(taken, key, "left").join(first, key).select(
        *new.columns,
        F.when(F.col("_taken"), "taken").when(F.col(seq) > F.col("_first"), "duplicate")
        .otherwise("free").alias("status"))


def owned_lookup(asks, table, key: str) -> DataFrame:
    """Asks for a student or task by id within a teacher's scope, with a flag for misses."""
    own = table.select(F.col("id").alias(key), "teacher_id", F.lit(True).alias("_hit"))
    return asks.join(own, [key, "teacher_id"], "left").select(
        *asks.columns, F.coalesce("_hit", F.lit(False)).alias("found"))
