"""Rules a submission passes before it is accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inkgrade.functions.cols import messages, top_rows
from inkgrade.functions.text import has_suffix

MAX_ATTEMPTS = 2


def is_late(at, deadline):
    """Strictly after the deadline; without a deadline never late."""
    return F.coalesce(at > deadline, F.lit(False))


def deadline_status(df: DataFrame, at: str = "created_at") -> DataFrame:
    return df.withColumn("deadline_status", F.when(is_late(F.col(at), F.col("deadline")), "closed").otherwise("open"))


PAIR = ["task_id", "student_id"]


def number_attempts(requests: DataFrame, stored: DataFrame | None = None, cap: int = MAX_ATTEMPTS) -> DataFrame:
    """Adds the attempt number of accepted requests; those beyond ``cap`` get null and a reason.

    Numbers go on from the submissions already ``stored`` for the pair, whatever became of them. Requests of one time
    and id are one request.
    """
    return _numbered(requests, pair_states(requests, stored, cap=cap), cap)


def stored_counts(stored: DataFrame) -> DataFrame:
    """How many submissions each (task, student) has: a count combined before the shuffle."""
    return stored.groupBy(*PAIR).agg(F.count("*").alias("prior"))


def pair_states(
    requests: DataFrame, stored: DataFrame | None = None, assignments: DataFrame | None = None, cap: int = MAX_ATTEMPTS,
) -> DataFrame:
    """One row per (task, student): ``prior`` stored submissions, its ``first`` requests (at most ``cap``) and whether it
    is ``assigned``.

    Only the first rows of a pair leave each map task (``top_rows``), so a pair that holds a third of all requests is as
    small here as any other.
    """
    order = [F.col("created_at"), F.col("id")]
    earliest = top_rows(requests.select(*PAIR, "created_at", "id").distinct(), PAIR, order, cap)
    none = F.lit(None)
    parts = [earliest.select(*PAIR, F.struct("created_at", "id").alias("one"), F.lit(0).alias("prior"), F.lit(False).alias("assigned"))]
    if stored is not None:
        parts.append(stored_counts(stored).select(*PAIR, none.alias("one"), "prior", F.lit(False).alias("assigned")))
    if assignments is not None:
        parts.append(assignments.select(*PAIR, none.alias("one"), F.lit(0).alias("prior"), F.lit(True).alias("assigned")))
    return reduce(DataFrame.unionByName, parts).groupBy(*PAIR).agg(
        F.sort_array(F.collect_list("one")).alias("first"),  # at most ``cap``
        F.sum("prior").alias("prior"), F.max("assigned").alias("assigned"))


def _numbered(requests: DataFrame, states: DataFrame, cap: int, reason: Column | None = None) -> DataFrame:
    """Requests joined to the one row of their pair, which a skewed join may split on the side of the requests."""
    at = F.array_position("first", F.struct("created_at", "id"))
    known = requests.join(states, PAIR, "left")
    if reason is None:
        reason = F.col("reason") if "reason" in requests.columns else F.lit(None).cast("string")
    number = F.when(reason.isNull() & (at > 0) & (F.col("prior") + at <= cap), F.col("prior") + at)
    return known.withColumns({
        "attempt_number": number.cast("bigint"), "reason": F.coalesce(reason, F.when(number.isNull(), "attempts")),
    }).drop("first", "prior", "assigned")


def admit_submissions(
    requests: DataFrame, tasks: DataFrame, assignments: DataFrame, cap: int = MAX_ATTEMPTS, stored: DataFrame | None = None,
) -> DataFrame:
    """Every request with its attempt number, or the first rule it fails.

    Order: extension, assigned and active, deadline, attempts. Only requests that pass the first
    three use up attempts, and the submissions already ``stored`` have used up theirs.
    """
    t = tasks.select(F.col("id").alias("task_id"), "is_active", "deadline", "mode")
    known = requests.join(t, "task_id", "left").select(
        "id", *PAIR, "created_at", "uploaded_file_path", "mode",
        F.coalesce(~has_suffix(F.col("uploaded_file_path")), F.lit(False)).alias("wrong_suffix"),
        F.coalesce("is_active", F.lit(False)).alias("active"), is_late(F.col("created_at"), F.col("deadline")).alias("late"))
    fit = known.filter(~F.col("wrong_suffix") & F.col("active") & ~F.col("late"))
    reason = (
        F.when(F.col("wrong_suffix"), "extension")
        .when(~F.col("active") | ~F.coalesce("assigned", F.lit(False)), "not_assigned").when(F.col("late"), "deadline"))
    numbered = _numbered(known, pair_states(fit, stored, assignments, cap), cap, reason)
    return numbered.drop("wrong_suffix", "active", "late").withColumn(
        "status", F.when(F.col("reason").isNull(), "pending").otherwise("rejected"))


def validate_tasks(tasks: DataFrame, new_mode: str | None = None) -> DataFrame:
    """Tasks with the list of rules they break; ``new_mode`` names a column with a requested mode."""
    checks = [
        (~F.coalesce(F.col("mode").isin("etalon", "optional"), F.lit(False)), "mode"),
        ((F.col("mode") == "etalon") & (F.coalesce("reference_file_path", F.lit("")) == ""), "reference_file"),
    ]
    if new_mode:
        checks.append(((F.col(new_mode) == "etalon")
                       & (F.coalesce("reference_file_path", F.lit("")) == ""), "switch_needs_reference"))
    problems = messages(*checks)
    return tasks.withColumn("problems", problems).withColumn("valid", F.size(problems) == 0)


def route_by_mode(submissions: DataFrame) -> DataFrame:
    """The scorer each submission goes to, or the error it gets. One scan, no union."""
    no_ref = F.coalesce("reference_file_path", F.lit("")) == ""
    mode = F.col("mode")
    return submissions.withColumn(
        "route",
        F.when((mode == "etalon") & no_ref, "error").when(mode == "etalon", "pair")
        .when(mode == "optional", "single").otherwise("error"),
    ).withColumn(
        "route_error",
        F.when((mode == "etalon") & no_ref, "reference_file_path required")
        .when(F.coalesce(~mode.isin("etalon", "optional"), F.lit(True)), "unknown mode"),
    )
