"""Results are looked up and sorted before titles, names or URLs widen their rows."""

import re

import pytest

from inkgrade.operators import results as R


@pytest.fixture(scope="module")
def world(spark):
    subs = spark.createDataFrame([("a", 100, 10), ("b", 100, 20), ("c", 200, 10), ("c", 200, 10), (None, 100, 10), ("d", 100, None)],
                                 "key string, task_id int, student_id int").selectExpr(
        "concat(key, '-', key) AS id", "task_id", "student_id", "1 AS attempt_number", "'etalon' AS mode", "'pending' AS status", "0D AS total_score",
        "'app/uploads/submissions/x.png' AS uploaded_file_path", "'' AS overlay_path", "timestamp_ntz'2024-01-01' AS created_at")
    tasks = spark.createDataFrame([(100, 1, "A"), (200, 2, "B")], "id int, teacher_id int, title string")
    students = spark.createDataFrame([(10, 1, "s"), (20, 2, "t")], "id int, teacher_id int, full_name string")
    return subs, tasks, students


def _plan(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):]  # before it ran, so there is one


def test_lookup_joins_before_it_widens(spark, world):
    asks = spark.createDataFrame([("a-a", 10), ("a-a", 10), ("b-b", 10), ("c-c", 10), (None, 10), ("d-d", None)], "submission_id string, student_id int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.student_result_lookup(*world, asks)
        text = _plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = text[text.index("LeftSemi"):]
    # the semi join stands below the joins with tasks and students
    assert len(re.findall(r"Join.*Inner", text[:text.index("LeftSemi")])) == 2 and not re.findall(r"Join.*Inner", semi)
    assert sorted(r.submission_id for r in out.collect()) == ["a-a", "c-c", "c-c"]
    assert out.columns[:3] == ["submission_id", "student_id", "teacher_id"]


def test_urls_are_derived_after_sorting(world):
    out = R.student_task_results(*world)
    text = _plan(out)
    assert "uploaded_file_url" in text and "uploaded_file_url" not in text[text.index("Sort ["):]
    rows = [(r.student_id, r.task_id, r.submission_id, r.uploaded_file_url is None) for r in out.collect()]
    assert rows == [(10, 100, None, False), (10, 100, "a-a", False), (10, 200, "c-c", False), (10, 200, "c-c", False), (20, 100, "b-b", False)]


def test_both_scopes_share_one_shuffle_of_submissions(spark, world):
    subs, tasks, _ = world
    twice = tasks.unionByName(tasks.limit(1)).unionByName(spark.createDataFrame([(200, None, "B")], tasks.schema))  # task 100 stands twice
    asks = {"teacher": [("a-a", 1), ("b-b", 2), ("c-c", 2), ("x", 1), (None, 1), ("d-d", None)],
            "student": [("a-a", 10), ("b-b", 10), ("c-c", 10), ("x", 10), (None, 10), ("d-d", None)]}
    frames = {s: spark.createDataFrame(rows, f"submission_id string, {s}_id int") for s, rows in asks.items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.submission_lookup(subs, twice, frames)
        assert len(re.findall(r"Join.*LeftOuter", _plan(out))) == 2  # tasks to submissions, then one for both scopes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = sorted(((r.scope, r.submission_id or "", r.teacher_id or r.student_id or 0, r.status, r.found) for r in out.collect()), key=str)
    no = lambda s: [(s, "", 1 if s == "teacher" else 10, None, False), (s, "d-d", 0, None, False)]
    hit = lambda s, i, k, n: [(s, i, k, "pending", True)] * n
    assert got == sorted([
        *no("teacher"), *hit("teacher", "a-a", 1, 2), ("teacher", "b-b", 2, None, False), *hit("teacher", "c-c", 2, 2), ("teacher", "x", 1, None, False),
        *no("student"), *hit("student", "a-a", 10, 1), ("student", "b-b", 10, None, False), *hit("student", "c-c", 10, 2), ("student", "x", 10, None, False),
    ], key=str)
    for s, frame in frames.items():  # one scope alone gives its part
        alone = sorted(((s, r.submission_id or "", r[1] or 0, r.status, r.found) for r in R.submission_lookup(subs, twice, frame, s).collect()), key=str)
        assert alone == [r for r in got if r[0] == s]
