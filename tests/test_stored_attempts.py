"""Attempts continue from stored submissions, in batch and as a stream."""

import datetime as dt

import pytest

from inkgrade.operators import admission
from inkgrade.streaming import uploads

REQUEST = "id string, task_id long, student_id long, uploaded_file_path string, created_at timestamp_ntz"


def _at(minute):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)


@pytest.fixture(scope="module")
def world(spark):
    tasks = spark.createDataFrame(
        [(1, True, _at(500), "etalon"), (2, True, None, "optional"), (3, False, None, "optional")],
        "id long, is_active boolean, deadline timestamp_ntz, mode string")
    given = spark.createDataFrame([(t, s) for t in (1, 2, 3) for s in (7, 8, 9)] + [(1, 7)], "task_id long, student_id long")
    stored = spark.createDataFrame(
        [("a", 1, 7, "failed"), ("b", 1, 7, "evaluated"), ("c", 1, 8, "pending"), ("d", 2, 99, "failed"), ("e", None, 7, "failed")],
        "id string, task_id long, student_id long, status string")
    requests = [
        ("full", 1, 7, "x.png", _at(1)), ("second", 1, 8, "x.png", _at(2)), ("third", 1, 8, "x.png", _at(3)),
        ("bmp", 1, 9, "x.bmp", _at(0)), ("late", 1, 9, "x.pdf", _at(501)), ("on time", 1, 9, "x.pdf", _at(500)),
        ("first", 2, 7, "x.png", _at(9)), ("tie b", 2, 8, "x.png", _at(5)), ("tie a", 2, 8, "x.png", _at(5)),
        ("tie c", 2, 8, "x.png", _at(5)), ("closed", 3, 7, "x.png", _at(1)), ("stranger", 2, 99, "x.png", _at(1)),
        ("no task", 5, 7, "x.png", _at(1)), ("null", None, 7, "x.png", _at(1)), ("no file", 2, 9, None, _at(1)),
    ]
    return tasks, given, stored, spark.createDataFrame(requests, REQUEST)


WANT = {
    "full": (None, "attempts"), "second": (2, None), "third": (None, "attempts"), "bmp": (None, "extension"),
    "late": (None, "deadline"), "on time": (1, None), "first": (1, None), "tie a": (1, None), "tie b": (2, None),
    "tie c": (None, "attempts"), "closed": (None, "not_assigned"), "stranger": (None, "not_assigned"),
    "no task": (None, "not_assigned"), "null": (None, "not_assigned"),
}


def test_batch(spark, world):
    tasks, given, stored, requests = world
    got = admission.admit_submissions(requests, tasks, given, stored=stored).collect()
    assert {r.id: (r.attempt_number, r.reason) for r in got if r.id != "no file"} == WANT
    assert len(got) == requests.count() and all((r.status == "pending") == (r.reason is None) for r in got)


def test_without_stored_rows_numbers_start_at_one(spark, world):
    tasks, given, stored, requests = world
    plain = {r.id: r.attempt_number for r in admission.admit_submissions(requests, tasks, given).collect()}
    empty = {r.id: r.attempt_number for r in admission.admit_submissions(requests, tasks, given, stored=stored.limit(0)).collect()}
    assert plain == empty and plain["full"] == 1 and plain["third"] == 2


def test_hot_pair_is_numbered_without_gathering_it(spark):
    requests = spark.range(20_000).selectExpr(
        "cast(id as string) AS id", "1L AS task_id", "1L AS student_id", "timestamp_ntz '2024-05-01' + make_interval(0,0,0,0,0,0,20000 - id) AS created_at")
    stored = spark.createDataFrame([("s", 1, 1)], "id string, task_id long, student_id long")
    states = admission.pair_states(requests, stored, cap=3).collect()
    assert len(states) == 1 and len(states[0].first) == 3 and states[0].prior == 1
    numbered = admission.number_attempts(requests, stored, cap=3)
    assert {r.id: r.attempt_number for r in numbered.where("attempt_number IS NOT NULL").collect()} == {"19999": 2, "19998": 3}
    assert numbered.where("reason = 'attempts'").count() == 19_998


def test_stream_starts_from_stored_rows_and_goes_on_from_its_state(spark, world, tmp_path):
    tasks, given, stored, requests = world
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", uploads.ROCKSDB)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def drain():
        stream = uploads.stream_admission(
            spark.readStream.schema(requests.schema).parquet(source), tasks, given, stored=stored)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()
        return {r.id: (r.attempt_number, r.reason) for r in spark.read.parquet(out).collect()}

    early = requests.filter("id IN ('second', 'tie a', 'full')")
    early.coalesce(1).write.parquet(source)
    assert drain() == {"second": (2, None), "tie a": (1, None), "full": (None, "attempts")}
    requests.filter("id NOT IN ('second', 'tie a', 'full', 'no file')").coalesce(1).write.mode("append").parquet(source)
    assert drain() == WANT
