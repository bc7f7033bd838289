"""The upload flow as streams: admission, results and file intake."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkgrade.functions.text import UPLOAD_SUFFIXES, file_suffix, has_suffix
from inkgrade.operators.admission import MAX_ATTEMPTS, PAIR, is_late, stored_counts
from inkgrade.operators.writes import apply_evaluations

c = F.col

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096  # groups of (task, student) pairs; a checkpoint holds the counters by bucket, so it stays as it is
ADMITTED = ("id string, task_id bigint, student_id bigint, mode string, attempt_number bigint, "
            "reason string, status string")


class AttemptCounter(StatefulProcessor):
    """Per (task, student): how many attempts are used up, by stored submissions and by requests accepted since.

    A group of the stream is a bucket of pairs, so that a call and its state serve many pairs at once; the state of a
    bucket is one table of its pairs. Within a micro-batch the earliest requests of a pair win. Only the few that may
    still be accepted are held between Arrow batches; all others are passed on as they arrive, so a busy pair needs no
    more memory than a quiet one.
    """

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "pairs binary")

    def _read(self) -> pd.DataFrame:
        """Columns task_id, student_id and n, one row per pair."""
        flat = np.frombuffer(self.used.get()[0], np.int64) if self.used.exists() else np.empty(0, np.int64)
        return pd.DataFrame(flat.reshape(-1, 3), columns=[*PAIR, "n"])

    def _add(self, used: pd.DataFrame, more: pd.DataFrame) -> None:
        total = pd.concat([used, more[[*PAIR, "n"]]]).groupby(PAIR, sort=False, as_index=False)["n"].sum()
        self.used.update((total.to_numpy(np.int64).tobytes(),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Called with all pairs of a bucket, at once or in parts, in the first micro-batch of a new checkpoint."""
        self._add(self._read(), initialState.rename(columns={"prior": "n"}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self._read()
        held = None
        for pdf in rows:
            pdf = pdf[[*PAIR, "id", "mode", "at"]].merge(used, on=PAIR, how="left")
            pdf["n"] = pdf["n"].fillna(0).astype(np.int64)
            ranked = (pdf if held is None else pd.concat([held, pdf])).sort_values([*PAIR, "at", "id"], kind="stable")
            ranked["number"] = ranked["n"] + ranked.groupby(PAIR).cumcount() + 1
            fit = ranked["number"] <= self.cap
            held, late = ranked[fit], ranked[~fit]
            if len(late):
                yield self._rows(late.assign(number=None), "attempts", "rejected")
        if held is not None and len(held):
            self._add(used, held.assign(n=1))
            yield self._rows(held, None, "pending")

    def _rows(self, requests: pd.DataFrame, reason, status) -> pd.DataFrame:
        return pd.DataFrame({
            "id": requests["id"].array, "task_id": requests["task_id"].array, "student_id": requests["student_id"].array,
            "mode": requests["mode"].array, "attempt_number": pd.array(requests["number"], dtype="Int64"),
            "reason": pd.Series([reason] * len(requests), dtype="object"), "status": status})

    def close(self) -> None:
        pass


def stream_admission(
    requests: DataFrame, tasks: DataFrame, assignments: DataFrame, cap: int = MAX_ATTEMPTS, stored: DataFrame | None = None,
) -> DataFrame:
    """Admission of a stream of requests against static tasks and assignments.

    The counters of a new checkpoint start from the submissions already ``stored``; a restarted stream goes on from
    its own state.

    The rules on extension, assignment and deadline need no state, and requests that fail one never
    reach the counter. Needs the RocksDB state store (``ROCKSDB``).
    """
    t = tasks.select(c("id").alias("task_id"), "is_active", "deadline", "mode")
    a = assignments.select("task_id", "student_id").distinct().withColumn("assigned", F.lit(True))
    checked = requests.join(t, "task_id", "left").join(a, ["task_id", "student_id"], "left").select(
        "id", "task_id", "student_id", "mode", c("created_at").cast("timestamp").alias("at"),
        F.when(~has_suffix(c("uploaded_file_path")), "extension")
        .when(~F.coalesce(c("assigned") & c("is_active"), F.lit(False)), "not_assigned")
        .when(is_late(c("created_at"), c("deadline")), "deadline").alias("reason"))
    bucket = F.pmod(F.hash(*[c(n).cast("bigint") for n in PAIR]), F.lit(BUCKETS)).alias("bucket")
    fit = checked.filter("reason IS NULL").select(bucket, *[c(n).cast("bigint") for n in PAIR], "id", "mode", "at")
    counted = fit.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=AttemptCounter(cap), outputStructType=ADMITTED, outputMode="Append", timeMode="None",
        initialState=None if stored is None else stored_counts(stored.dropna(subset=PAIR)).select(
            bucket, *[c(n).cast("bigint") for n in PAIR], "prior").groupBy("bucket"))
    refused = checked.filter("reason IS NOT NULL").select(
        "id", "task_id", "student_id", "mode", F.lit(None).cast("bigint").alias("attempt_number"), "reason", F.lit("rejected").alias("status"))
    return counted.unionByName(refused)


def stream_apply_results(evaluations: DataFrame, path: str, checkpoint: str):
    """Sink for scorer results: each micro-batch overwrites its own partition of a log.

    A batch that is retried replaces itself, so every result is stored once, and a batch costs no more
    than its own rows. ``current_submissions`` merges the log into the table when it is read.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("position", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return evaluations.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def current_submissions(submissions: DataFrame, path: str) -> DataFrame:
    """The submissions with the latest stored result of each applied."""
    log = submissions.sparkSession.read.parquet(path)
    values = [n for n in log.columns if n not in ("id", "batch_id", "position")]
    latest = log.groupBy("id").agg(F.max_by(F.struct(*values), F.struct("batch_id", "position")).alias("r")).select("id", "r.*")
    return apply_evaluations(submissions, latest)


def stream_drawing_intake(files: DataFrame, path: str = "path", at: str = "modificationTime", delay: str = "1 day") -> DataFrame:
    """Accepted files of a stream, each path once; repeats later than ``delay`` behind are dropped."""
    suffix = file_suffix(c(path))
    return (
        files.select(c(path).alias("path"), c(at).cast("timestamp").alias("at"), suffix.alias("suffix"))
        .filter(c("suffix").isin(UPLOAD_SUFFIXES)).withWatermark("at", delay).dropDuplicatesWithinWatermark(["path"]))
