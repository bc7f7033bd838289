"""Stored tables, file listing, report sink, and streams fed in several micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from inkgrade.operators import admission, results, writes
from inkgrade.sources import files, tables
from inkgrade.streaming import uploads as U


def test_tables_round_trip(spark, tmp_path):
    now = dt.datetime(2024, 1, 2)
    rows = {
        "teachers": [(1, "Ann", "B", "a@x.org", None, None, now)],
        "students": [(5, 1, "Stu", None, None, None, "stu", True, now)],
        "tasks": [(7, 1, "T", None, "etalon", "r.png", None, now, True, now)],
        "task_assignments": [(1, 7, 5, now)],
        "submissions": [(9, 7, 5, 1, "etalon", "a.png", 50.0, "{}", None, [("c", 1.0, 2.0, 50.0, "")], "evaluated", now)],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, tables.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}")
    got = tables.read_tables(spark, str(tmp_path))
    assert {n: df.count() for n, df in got.items()} == {n: 1 for n in rows}
    assert got["submissions"].first().table_json[0].criterion == "c"
    raw = spark.createDataFrame([("7", '[{"criterion": "a", "score": 1.5}]', "2024-01-02 03:04:05")], "id string, table_json string, created_at string")
    row = raw.select(tables.declared(raw, "submissions")).first()
    assert (row.id, row.table_json[0].criterion, row.table_json[0].score, row.created_at.day, row.status) == (7, "a", 1.5, 2, None)


def test_listing_and_reports(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    for name in ("a.PNG", "b.tiff", "c"):
        (folder / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.suffix, r.accepted, r.loadable, r.reason) for r in files.list_drawings(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.PNG": (".png", True, True, None), "b.tiff": (".tiff", False, True, "extension not allowed"), "c": ("", False, False, "no extension")}
    df = spark.createDataFrame([(1, "etalon", 5), (2, "optional", 6)], "id int, mode string, total int")
    files.write_reports(df, str(tmp_path / "out"))
    assert sorted((r.id, r.mode, r.total) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(1, "etalon", 5), (2, "optional", 6)]


def _requests(spark):
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(300):  # one pair holds a third of all requests
        student = 1 if i % 3 == 0 else i % 17
        path = "x.bmp" if i % 11 == 0 else f"d{i}.png"
        rows.append((f"r{i:04d}", i % 2 if student != 1 else 0, student, path, start + dt.timedelta(hours=i)))
    return spark.createDataFrame(rows, "id string, task_id long, student_id long, uploaded_file_path string, created_at timestamp_ntz")


def test_streamed_admission_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", U.ROCKSDB)
    reqs = _requests(spark)
    tasks = spark.sql("SELECT * FROM VALUES (0L, true, timestamp_ntz'2024-01-12', 'etalon'), (1L, true, NULL, 'optional') AS t(id, is_active, deadline, mode)")
    pairs = reqs.select("task_id", "student_id").distinct().filter("student_id <> 4")
    days = [r[0] for r in reqs.select(F.to_date("created_at")).distinct().orderBy(F.to_date("created_at")).collect()]
    half = len(days) // 2
    for n, part in enumerate((days[:half], days[half:])):  # two files, in time order
        reqs.filter(F.to_date("created_at").isin(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = U.stream_admission(stream, tasks, pairs)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(
        availableNow=True).start().awaitTermination()
    cols = ["id", "attempt_number", "reason", "status"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()), key=str)
    want = sorted(map(tuple, admission.admit_submissions(reqs, tasks, pairs).select(*cols).collect()), key=str)
    assert got == want
    assert sum(r[3] == "pending" for r in got) > 20


def test_results_log_keeps_the_latest(spark, tmp_path):
    subs = spark.createDataFrame([("a", None, None, "pending"), ("b", None, None, "pending"), ("c", 1.0, "o", "evaluated")],
                                 "id string, total_score double, overlay_path string, status string")
    schema = "id string, total_score double, ai_json_result string, overlay_path string, table_json string, error string"
    for rows in ([("a", 10.0, "{}", "x", "[]", None)], [("a", None, None, None, None, "boom"), ("b", 7.0, "{}", "y", "[]", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        U.stream_apply_results(stream, f"{tmp_path}/log", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: (r.total_score, r.status, r.ai_json_result) for r in U.current_submissions(subs, f"{tmp_path}/log").collect()}
    assert got == {"a": (None, "failed", '{"error":"boom"}'), "b": (7.0, "evaluated", "{}"), "c": (1.0, "evaluated", None)}


def test_hot_pair_gets_its_first_two(spark):
    reqs = _requests(spark)
    out = admission.number_attempts(reqs).filter("task_id = 0 AND student_id = 1").orderBy("created_at").collect()
    assert [r.attempt_number for r in out[:3]] == [1, 2, None] and len(out) > 90


def test_cascade_and_replacement(spark):
    t = {
        "teachers": spark.createDataFrame([(1,), (2,)], "id int"),
        "students": spark.createDataFrame([(10, 1), (20, 2)], "id int, teacher_id int"),
        "tasks": spark.createDataFrame([(100, 1), (200, 2)], "id int, teacher_id int"),
        "task_assignments": spark.createDataFrame([(100, 10), (200, 20), (200, 10)], "task_id int, student_id int"),
        "submissions": spark.createDataFrame([(1, 100, 10), (2, 200, 20), (3, 200, 10)], "id int, task_id int, student_id int"),
    }
    left = writes.cascade_delete(t, "students", spark.createDataFrame([(10,)], "id int"))
    assert {n: df.count() for n, df in left.items()} == {"teachers": 2, "students": 1, "tasks": 2, "task_assignments": 1, "submissions": 1}
    new = spark.createDataFrame([(100, 20), (200, 20), (200, 20)], "task_id int, student_id int")
    out = writes.replace_assignments(t["task_assignments"], new, t["tasks"], t["students"])
    # task 100 asks for a student of another teacher and stays; task 200 is replaced, repeats dropped
    assert sorted(map(tuple, out.collect())) == [(100, 10), (200, 20)]


def test_scopes(spark):
    tasks = spark.createDataFrame([(100, 1, "A"), (200, 2, "B")], "id int, teacher_id int, title string")
    students = spark.createDataFrame([(10, 1, "s"), (20, 2, "t")], "id int, teacher_id int, full_name string")
    subs = spark.createDataFrame([("a", 100, 10), ("b", 100, 20), ("c", 200, 10)], "id string, task_id int, student_id int").selectExpr(
        "*", "1 AS attempt_number", "'etalon' AS mode", "'pending' AS status", "0D AS total_score", "'x.png' AS uploaded_file_path",
        "'' AS overlay_path", "timestamp_ntz'2024-01-01' AS created_at")
    ids = lambda df: [r.submission_id for r in df.collect()]
    ask = lambda cols, *rows: spark.createDataFrame(list(rows), cols)
    assert ids(results.teacher_results(subs, tasks, students, ask("teacher_id int", (1,)))) == ["b", "a"]
    # a task of another teacher is not shown, whoever asks
    wanted = ask("teacher_id int, task_id int", (1, 100), (1, 200))
    assert ids(results.teacher_task_results(subs, tasks, students, wanted)) == ["a", "b"]
    # own students on own tasks only
    assert ids(results.teacher_student_results(subs, tasks, students)) == ["a"]
    assert ids(results.student_results(subs, tasks, students, ask("student_id int", (10,)))) == ["c", "a"]
    asks = ask("submission_id string, teacher_id int", ("a", 1), ("c", 1))
    found = {r.submission_id: r.found for r in results.submission_lookup(subs, tasks, asks, "teacher").collect()}
    assert found == {"a": True, "c": False}
