"""Streaming queries over the given tables, run until the available input is consumed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from inkgrade.operators.lineage import shared_folder
from inkgrade.plans.catalog import ORACLES_RAW, Tables, query
from inkgrade.plans.fixtures import FIXTURES
from inkgrade.streaming import uploads as U

c = F.col


def _stream(t: Tables, table: str) -> DataFrame:
    """A given table as a file stream."""
    return t.spark.readStream.schema(getattr(t, table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.base)


def _submissions(t: Tables) -> DataFrame:
    """The submissions table with its line items arriving as a stream."""
    return t.spark.sql(FIXTURES["submissions"], lineitem=_stream(t, "lineitem"), orders=t.orders)


def _drain(t: Tables, df: DataFrame) -> DataFrame:
    """Run a stream over all available input into the shared folder and read the result."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option(
        "path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("stream_admission", ORACLES_RAW["admit_submissions"], flat=True)
def _(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", U.ROCKSDB)
    requests = _submissions(t).select("id", "task_id", "student_id", "uploaded_file_path", "created_at")
    return _drain(t, U.stream_admission(requests, t.tasks, t.task_assignments))


@query("stream_admission_stored", ORACLES_RAW["admit_submissions_stored"], flat=True)
def _(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", U.ROCKSDB)
    arriving = c("created_at") >= F.lit("1996-01-01").cast("timestamp_ntz")
    requests = _submissions(t).filter(arriving).select("id", "task_id", "student_id", "uploaded_file_path", "created_at")
    return _drain(t, U.stream_admission(requests, t.tasks, t.task_assignments, stored=t.stored_submissions))


@query("stream_apply_results", ORACLES_RAW["apply_evaluations"])
def _(t):
    folder = f"{shared_folder(t.spark)}/results-{uuid.uuid4().hex}"
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    pending = _submissions(t).filter("status = 'pending'")
    done = c("created_at") < cut
    evaluations = pending.select(
        "id", F.when(done, c("attempt_number") * 12.5).alias("total_score"), F.when(done, "done").alias("ai_json_result"),
        F.concat(F.lit("app/uploads/results/"), "id", F.lit(".png")).alias("overlay_path"), F.lit("[]").alias("table_json"),
        F.when(~done, "no drawing found").alias("error"))
    U.stream_apply_results(evaluations, f"{folder}/log", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return U.current_submissions(t.submissions, f"{folder}/log").drop("mode", "uploaded_file_path", "created_at")


@query("stream_drawing_intake", r"""SELECT DISTINCT uploaded_file_path AS path, lower(regexp_extract(uploaded_file_path, '[^/\\](\.[^./\\]+)$', 1)) AS suffix
FROM {submissions} WHERE lower(regexp_extract(uploaded_file_path, '[^/\\](\.[^./\\]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.pdf')""", flat=True)
def _(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", U.ROCKSDB)  # paths are kept on disk, not in memory
    files = _submissions(t).select(c("uploaded_file_path").alias("path"), "created_at")
    return _drain(t, U.stream_drawing_intake(files, "path", "created_at", "3650 days")).select("path", "suffix")
