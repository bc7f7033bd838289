"""Submissions are looked up by pair and sorted with one shuffle; a teacher's results are looked up before they are widened."""

import datetime as dt
import re

import pytest

import inkgrade.plans.all  # noqa: F401  registers every query
from inkgrade.operators import results as R
from inkgrade.plans import catalog

COLUMNS = ("id string, task_id bigint, student_id bigint, attempt_number int, mode string, status string, total_score double, "
           "uploaded_file_path string, overlay_path string, created_at timestamp_ntz")


@pytest.fixture
def world(spark):
    """Tables with repeated and null keys, read without broadcasts."""
    row = lambda i, t, s, n: (i, t, s, n, "etalon", "pending", 1.0, f"app/uploads/{i}.png", "", dt.datetime(2024, 1, 1))
    subs = spark.createDataFrame([
        row("a", 100, 10, 2), row("b", 100, 10, 1), row("b", 100, 10, 1), row(None, 100, 10, None), row("c", 200, 20, 1),
        row("d", 300, 10, 1), row("e", None, 10, 1), row("f", 100, None, 1), row("g", 100, 30, 1), row("h", 200, 10, 1)], COLUMNS)
    tasks = spark.createDataFrame([(100, 1, "A"), (200, 2, "B"), (200, 3, "B2"), (None, 1, "N")], "id int, teacher_id int, title string")
    students = spark.createDataFrame([(10, 1, "s"), (10, 1, "s2"), (20, 2, "t"), (None, 1, "n")], "id int, teacher_id int, full_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield subs, tasks, students
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def wanted(spark):
    return spark.createDataFrame([(10, 100), (10, 100), (20, 200), (10, 300), (30, 100), (10, 999), (None, 100), (10, None)],
                                 "student_id int, task_id int")


def _plan(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):].split("== Initial Plan ==")[0]


def _wide_shuffles(df):
    """Exchanges whose rows carry the submission's path."""
    lines = _plan(df).splitlines()
    return sum("Exchange" in a and "uploaded_file_path" in "".join(lines[i + 1:i + 3]) for i, a in enumerate(lines))


def test_submissions_of_pairs(world, wanted):
    subs, *_ = world
    out = R.student_task_submissions(subs, wanted)
    want = subs.join(wanted.distinct(), ["student_id", "task_id"], "left_semi").orderBy("student_id", "task_id", "attempt_number", "id")
    assert out.dtypes == want.dtypes and out.collect() == want.collect() and want.count() == 7
    plan = _plan(out)
    assert len(re.findall("Exchange rangepartitioning", plan)) == 1 and "LeftSemi" not in plan


def test_results_of_pairs(world, wanted):
    subs, tasks, students = world
    out = R.student_task_results(subs, tasks, students, wanted)
    few = subs.join(wanted.distinct(), ["student_id", "task_id"], "left_semi")
    want = R.student_task_results(few, tasks, students)
    key = lambda r: str(tuple(r))
    assert out.dtypes == want.dtypes and sorted(out.collect(), key=key) == sorted(want.collect(), key=key)
    place = lambda df: [(r.student_id, r.task_id, r.attempt_number, r.submission_id) for r in df.collect()]
    assert place(out) == place(want) and len(place(out)) == 10  # students and tasks given twice are found twice
    assert len(re.findall("Exchange rangepartitioning", _plan(out))) == 1 and _wide_shuffles(out) == 1


def test_teacher_lookup_precedes_names(spark, world):
    asks = spark.createDataFrame([("a", 1), ("a", 1), ("c", 2), ("c", 3), ("c", 1), ("h", 2), ("g", 1), (None, 1)], "submission_id string, teacher_id int")
    out = R.teacher_result_lookup(*world, asks)
    text = _plan(out)
    assert len(re.findall("Join.*Inner", text[:text.index("LeftSemi")])) == 1  # names are joined to what was found
    want = R.results(*world).join(asks.distinct(), ["submission_id", "teacher_id"], "left_semi")
    assert out.dtypes == want.dtypes
    key = lambda r: str(tuple(r))
    assert sorted(out.collect(), key=key) == sorted(want.collect(), key=key) and len(want.collect()) == 6


@pytest.mark.parametrize("name", [
    "student_task_results", "student_task_submissions", "student_result_lookup", "teacher_result_lookup", "evaluate_optional_batch"])
def test_they_take_larger_partitions(spark, name, monkeypatch):
    seen = []

    def stop(self, table):
        seen.append(self._flat)
        raise KeyError(table)

    monkeypatch.setattr(catalog.Tables, "__getattr__", stop)
    with pytest.raises(KeyError):
        catalog.QUERIES[name](spark, "/nowhere")
    assert seen == [True]
