"""Null, empty and malformed rows neither get marks nor end a job."""

from pyspark.sql import functions as F

from inkgrade.functions import text
from inkgrade.operators import report, writes


def test_id_lists(spark):
    rows = [("1,\t2\n, 1",), ("99999999999999999999",), ("x",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(text.parse_id_list(F.col("t")).alias("r")).select("r.*").collect()
    assert [(r["ids"], r["valid"]) for r in got] == [([1, 2], True), (None, False), (None, False), ([], True)]


def test_no_total_no_grade(spark):
    row = spark.sql("select cast(null as double) t").select(text.grade_label(F.col("t")), text.band_label(F.col("t"))).first()
    assert tuple(row) == (None, None)


def test_empty_boxes(spark):
    boxes = spark.createDataFrame([(1, 5, 5, 5, 9), (2, 0, 0, 2, 2)], "drawing_id long, x1 int, y1 int, x2 int, y2 int")
    got = {r[0]: r[1] for r in report.largest_shares(boxes).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_two_results_for_one_submission(spark):
    submissions = spark.createDataFrame([(1, None, None, "pending"), (2, None, None, "pending")],
                                        "id int, total_score double, overlay_path string, status string")
    results = spark.createDataFrame([(1, 50.0, "a", "p", "[]", None, 2), (1, 90.0, "b", "q", "[]", None, 1)],
                                    "id int, total_score double, ai_json_result string, overlay_path string, table_json string, error string, seen int")
    late = {r.id: (r.total_score, r.status) for r in writes.apply_evaluations(submissions, results, latest="seen").collect()}
    assert late == {1: (50.0, "evaluated"), 2: (None, "pending")}
    assert [r.total_score for r in writes.apply_evaluations(submissions, results).orderBy("id").collect()] == [90.0, None]
