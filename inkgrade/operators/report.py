"""Normalising scorer output and assembling reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inkgrade.functions.cols import ladder, messages
from inkgrade.functions.text import band_label, grade_label, safe_number, safe_text
from inkgrade.functions.texts import TEXTS as T
from inkgrade.operators import rubric_free as free, rubric_ref as ref
from inkgrade.operators.boxes import resolve_roles
from inkgrade.operators.lineage import cut_lineage

c = F.col

# Keys under which the scorers report.
SCORE_KEYS = ["total_score", "score", "final_score", "overall_score", "total_ball", "ball"]
DETAIL_KEYS = ["details", "ai_json_result", "json_result"]
OVERLAY_KEYS = ["overlay_path", "overlay", "overlay_file"]
TABLE_KEYS = ["table_json", "table", "rows"]


def _part(fields: Column, key: str) -> Column:
    return F.try_element_at(fields, F.lit(key))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _truthy(v: Column) -> Column:
    """Whether a JSON value is present and not null, empty, zero or false."""
    text = F.try_variant_get(v, "$", "string")
    kind = _kind(v)
    return (
        F.when(text.isNull(), False).when(kind == "STRING", text != "")
        .when(kind.startswith("OBJECT"), text != "{}").when(kind.startswith("ARRAY"), text != "[]")
        .when(kind == "BOOLEAN", text == "true").otherwise(text.try_cast("double") != 0)
    )


def _first_truthy(doc: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.when(_truthy(_part(doc, k)), _part(doc, k)) for k in keys])


def normalize_results(df: DataFrame, json: str = "json") -> DataFrame:
    """Score, details, overlay and table from either scorer's JSON.

    The score is the first key that is not null (0 counts); the others are the first key that is
    truthy, so empty objects, lists and texts fall through. A single table object becomes a list.
    """
    text = lambda v: F.try_variant_get(v, "$", "string")
    # each stage names what the next one reads several times, so that nothing is parsed twice
    # a map of its top-level values needs one pass over the text, however many keys are looked up
    parsed = df.withColumn("_doc", F.from_json(c(json), "map<string,variant>"))
    parts = parsed.select(
        *df.columns, c("_doc").isNull().alias("_bad"),
        F.coalesce(*[text(_part(c("_doc"), k)) for k in SCORE_KEYS]).alias("_raw"),
        _first_truthy(c("_doc"), DETAIL_KEYS).alias("_details"), _first_truthy(c("_doc"), OVERLAY_KEYS).alias("_overlay"),
        _first_truthy(c("_doc"), TABLE_KEYS).alias("_table"))
    raw = c("_raw")
    number = F.when(raw.isin("true", "false"), (raw == "true").cast("double")).otherwise(raw.try_cast("double"))
    kind = _kind(c("_table"))
    return parts.select(
        *df.columns, number.alias("total_score"), F.coalesce(text(c("_details")), F.lit("{}")).alias("ai_json_result"),
        text(c("_overlay")).alias("overlay_path"),
        F.when(kind.startswith("OBJECT"), F.concat(F.lit("["), text(c("_table")), F.lit("]")))
        .when(kind.startswith("ARRAY"), text(c("_table"))).otherwise("[]").alias("table_json"),
        F.when(c("_bad"), "result is not an object").when(raw.isNull(), "total_score not found")
        .when(number.isNull(), "total_score is not a number").alias("error"))


#: Fixed value: key of a document that is no object.
VALUE_KEY = "qiymat"


def flatten_report(df: DataFrame, json: str = "json", levels: int = 8) -> DataFrame:
    """(dotted key, value) rows of nested objects, however deep.

    Texts stay whole, fractions are rounded to four decimals, lists stay one value and are cut with an ellipsis beyond
    180 characters. A document that is no object is one row under a fixed key. Each level explodes the objects that are
    left and carries finished values along; after every ``levels`` levels the rows are checkpointed, until no object is
    left.
    """
    spark = df.sparkSession
    keep = [n for n in df.columns if n != json]
    is_object = F.coalesce(_kind(c("v")).startswith("OBJECT"), F.lit(False))
    rows = df.select(*keep, F.lit(None).cast("string").alias("path"), F.try_parse_json(c(json)).alias("v"))
    while True:
        for _ in range(levels):
            rows = rows.withColumn("_o", F.when(is_object, c("v")))
            parts = spark.tvf.variant_explode_outer(c("_o").outer())
            rows = rows.lateralJoin(parts).filter("_o IS NULL OR key IS NOT NULL").select(
                *keep, F.when(c("key").isNull(), c("path")).otherwise(F.concat_ws(".", "path", "key")).alias("path"),
                F.when(c("key").isNull(), c("v")).otherwise(c("value")).alias("v"))
        rows = cut_lineage(rows)
        if rows.where(is_object).isEmpty():
            break
    plain, kind = F.try_variant_get(c("v"), "$", "string"), _kind(c("v"))
    fraction = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & plain.rlike(r"[.][0-9]{5}|E-")
    value = F.when(kind.startswith("ARRAY"), safe_text(plain)).when(
        fraction, safe_number(plain.try_cast("double")).cast("string")).otherwise(plain)
    return rows.select(*keep, F.coalesce("path", F.lit(VALUE_KEY)).alias("key"), value.alias("value"))


def score_table(scores: DataFrame) -> DataFrame:
    return scores.withColumn("percent", F.bround(c("score") / c("max_score") * 100, 2))


def total_scores(scores: DataFrame, key: str = "submission_id") -> DataFrame:
    return scores.groupBy(key).agg(F.bround(F.sum("score"), 2).alias("total_score")).withColumn(
        "grade_label", grade_label(c("total_score")))


def etalon_table(scores: DataFrame, key: str = "submission_id") -> DataFrame:
    """The nine criteria rows of each submission as one ordered list."""
    row = F.struct("ord", "criterion", c("score").cast("double").alias("score"),
                   c("max_score").cast("double").alias("max_score"), "percent")
    ordered = F.sort_array(F.collect_list(row))
    return score_table(scores).groupBy(key).agg(
        F.transform(ordered, lambda r: r.dropFields("ord")).alias("table_json"))


def round_metrics(metrics: Column) -> Column:
    """A map of metrics at four decimals."""
    return F.transform_values(metrics, lambda _, v: F.bround(v, 4))


# ---- stand-alone report -------------------------------------------------------------------------
def final_report(modules: DataFrame, reliability: DataFrame, key: str = "submission_id") -> DataFrame:
    """Raw and rescaled totals, grade and layout confidence per drawing."""
    sums = modules.groupBy(key).agg(F.sum("score").alias("raw_total"), F.sum("max_score").alias("raw_max"))
    total = F.rint(c("raw_total") / F.greatest(c("raw_max"), F.lit(1)) * 100).cast("int")
    return sums.withColumn("final_score_100", total).withColumn("grade_label", band_label(c("final_score_100"))).join(
        reliability.select(key, "confidence_score", "confidence_label"), key)


def collect_messages(modules: DataFrame, key: str = "submission_id", last: DataFrame | None = None) -> DataFrame:
    """Errors and warnings over a drawing's six modules, in module order, repeats dropped.

    ``last`` adds further warnings per drawing after those of the modules.
    """
    def merged(column):
        lists = F.sort_array(F.collect_list(F.struct("ord", c(column).alias("m"))))
        return F.flatten(F.transform(lists, lambda r: r.getField("m")))

    out = modules.groupBy(key).agg(merged("errors").alias("errors"), merged("warnings").alias("warnings"))
    if last is not None:
        out = out.join(last.select(key, c("warnings").alias("_last")), key, "left").withColumn(
            "warnings", F.concat("warnings", F.coalesce("_last", F.array().cast("array<string>")))).drop("_last")
    return out.withColumn("errors", F.array_distinct("errors")).withColumn("warnings", F.array_distinct("warnings"))


FEEDBACK = [  # module, lowest share of its points, message
    ("completeness_arrangement", 0.75, T["fb_completeness"]),
    ("section_hatching", 0.65, T["fb_hatching"]),
    ("dimensions", 0.70, T["fb_dimensions"]),
    ("line_semantics", 0.70, T["fb_lines"]),
    ("cleanliness", 0.70, T["fb_cleanliness"]),
    ("task_compliance", 0.80, T["fb_compliance"]),
]
ALL_GOOD = T["fb_all_good"]


def feedback(modules: DataFrame, key: str = "submission_id") -> DataFrame:
    share = c("score") / F.greatest(c("max_score"), F.lit(1))
    low = [F.max((c("module") == m) & (share < bound)).alias(m) for m, bound, _ in FEEDBACK]
    notes = messages(*[(c(m), text) for m, _, text in FEEDBACK])
    return modules.groupBy(key).agg(*low).select(
        key, F.when(F.size(notes) == 0, F.array(F.lit(ALL_GOOD))).otherwise(notes).alias("feedback"))


def largest_shares(boxes: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Share of the largest box in the summed box area of each drawing; 0 where all boxes are empty."""
    area = F.greatest(c("x2") - c("x1"), F.lit(0)).cast("bigint") * F.greatest(c("y2") - c("y1"), F.lit(0))
    return boxes.groupBy(key).agg(
        F.when(F.sum(area) > 0, F.max(area) / F.sum(area)).otherwise(0.0).alias("largest_share"))


def layout_reliability(df: DataFrame) -> DataFrame:
    """Confidence in the detected layout, with a warning for each penalty."""
    n, orth, share = c("projection_count"), c("orthographic_count"), F.coalesce("largest_share", F.lit(0.0))
    rules = [
        (n <= 1, 0.35, T["few_projections"]),
        (n >= 6, 0.20, T["many_projections"]),
        (orth == 0, 0.35, T["no_orthographic"]),
        (orth > 3, 0.15, T["many_orthographic"]),
        (~c("has_isometric"), 0.10, T["isometric_unseen"]),
        (~c("title_found"), 0.05, T["no_title_block"]),
        (share >= 0.72, 0.20, T["one_large_box"]),
    ]
    score = reduce(lambda s, r: s - F.when(r[0], r[1]).otherwise(0.0), rules, F.lit(1.0))
    score = F.bround(F.greatest(F.lit(0.0), score), 4)
    return df.withColumn("confidence_score", score).withColumn(
        "confidence_label", ladder(c("confidence_score"), [(0.80, "high"), (0.60, "medium")], "low")
    ).withColumn("warnings", messages(*[(cond, text) for cond, _, text in rules]))


def module_rows(modules: DataFrame) -> DataFrame:
    """One row per module; the comment is its first two errors, or warnings when it has no errors."""
    pick = F.when(F.size("errors") > 0, c("errors")).otherwise(c("warnings"))
    return modules.withColumn("comment", F.array_join(F.slice(pick, 1, 2), "; "))


# ---- whole comparison rubric --------------------------------------------------------------------
def evaluate_etalon_batch(features: DataFrame, hatch_features: DataFrame) -> DataFrame:
    """All nine criteria, total, grade and table for every submission.

    Eight criteria are columns of the same row; only the projection sections need a grouped sum and
    one join. The table is built from the row itself, so nothing is shuffled back together.
    """
    rows = reduce(lambda df, scorer: scorer(df), ref.ROW_SCORERS, features)
    sections = ref.score_projection_sections(hatch_features)
    rows = rows.join(sections, "submission_id", "left").withColumn(
        "projection_sections", F.when(c("projections") > 0, F.coalesce("projection_sections", F.lit(0.0))).otherwise(0.0))
    table = F.array(*[
        F.struct(F.lit(text).alias("criterion"), c(key).cast("double").alias("score"),
                 F.lit(float(top)).alias("max_score"), F.bround(c(key) / float(top) * 100, 2).alias("percent"))
        for _, key, text, top in ref.CRITERIA])
    total = F.bround(reduce(Column.__add__, [c(key) for _, key, _, _ in ref.CRITERIA]), 2)
    return rows.select(
        "submission_id", *[key for _, key, _, _ in ref.CRITERIA], total.alias("total_score"),
        grade_label(total).alias("grade_label"), table.alias("table_json"))


# ---- whole stand-alone rubric -------------------------------------------------------------------
def evaluate_optional_batch(views, zones, titles, measures, evidence, clean, text) -> DataFrame:
    """All six modules, totals, grade, confidence and messages for every drawing.

    ``measures`` and ``evidence`` hold one row per (drawing_id, seq) view, ``clean`` one row per
    drawing and ``text`` its task description. What is known about a view travels with it while roles
    are resolved; one grouping per drawing then yields every number the modules need. A drawing that any of views,
    ``clean`` and ``text`` names is reported: without views it has none of anything, an unmeasured cleanliness earns
    nothing and warns of nothing, and no description requires what an empty one does.
    """
    seen = free.hatch_quality(views.join(measures, ["drawing_id", "seq"], "left")).drop(
        "line_count", "length_ratio").join(evidence, ["drawing_id", "seq"], "left")
    carry = [n for n in seen.columns if n not in ("drawing_id", "seq", "x1", "y1", "x2", "y2", "diag_ratio", "hv_ratio", "view_type")]
    roles = resolve_roles(seen, zones, carry=carry)
    at = lambda r: F.max(F.when(c("role") == r, F.struct("x1", "y1", "x2", "y2"))).alias(r)
    area = F.greatest(c("x2") - c("x1"), F.lit(0)).cast("bigint") * F.greatest(c("y2") - c("y1"), F.lit(0))
    facts = roles.withColumn("ord", free.role_rank(c("role"))).withColumn("area", area).groupBy("drawing_id").agg(
        at("front"), at("top"), at("side"), F.count("*").alias("projection_count"),
        F.count_if(F.coalesce(c("role") != "isometric", F.lit(True))).alias("orthographic_count"),  # also without a role
        F.coalesce(F.max(c("role") == "isometric"), F.lit(False)).alias("has_isometric"),
        F.count_if(c("role").startswith("extra_")).alias("extra_count"),
        (F.max("area") / F.sum("area")).alias("largest_share"),
        *free.hatching_facts(), *free.dimension_facts(c("role") != "isometric"),
        *free.line_facts(c("role").isin("front", "top", "side")))
    parts = [df.select("drawing_id") for df in (views, clean, text)]
    drawings = reduce(DataFrame.union, parts).distinct()
    none = ["projection_count", "orthographic_count", "extra_count", "detected", "roles", "texts", "lines", "clusters",
            "visible_roles", "hidden_roles", "sequences", "center_roles", "strong_roles"]
    facts = drawings.join(facts, "drawing_id", "left").fillna(0, none).fillna(False, ["has_isometric"])
    no_notes = F.array().cast("array<string>")
    rows = (
        facts.join(titles.select("drawing_id", F.lit(True).alias("title_found")), "drawing_id", "left")
        .withColumn("title_found", F.coalesce("title_found", F.lit(False)))
        .join(free.score_cleanliness_free(clean).select("drawing_id", c("score").alias("s5"), c("errors").alias("e5"), c("warnings").alias("w5")), "drawing_id", "left")
        .withColumns({"s5": F.coalesce("s5", F.lit(0)), "e5": F.coalesce("e5", no_notes), "w5": F.coalesce("w5", no_notes)})
        .join(text.select("drawing_id", "description"), "drawing_id", "left")
        .withColumn("description", F.coalesce("description", F.lit(""))))
    rows = free.with_requirements(rows)

    def step(df, scorer, i):
        return scorer(df).withColumnsRenamed({"score": f"s{i}", "errors": f"e{i}", "warnings": f"w{i}"})

    for i, scorer in ((1, free.score_completeness), (2, free.hatching_points), (3, free.dimension_points), (4, free.line_points)):
        rows = step(rows, scorer, i)
    rows = step(rows.withColumn("dim_roles", c("roles")), free.score_task_compliance, 6)
    rows = layout_reliability(rows).withColumnRenamed("warnings", "w7")
    tops = [top for *_, top in free.MODULES]
    raw = reduce(Column.__add__, [c(f"s{i}") for i in range(1, 7)])
    merged = lambda kind, last: F.array_distinct(F.concat(*[c(f"{kind}{i}") for i in range(1, last + 1)]))
    notes = messages(*[(c(f"s{i}") / float(top) < bound, text) for i, (top, (_, bound, text)) in enumerate(zip(tops, FEEDBACK), 1)])
    out = rows.select(
        "drawing_id", *[c(f"s{i}").cast("int").alias(key) for i, key, *_ in free.MODULES], raw.cast("int").alias("raw_total"),
        F.rint(raw / float(sum(tops)) * 100).cast("int").alias("final_score_100"), "confidence_score", "confidence_label",
        merged("e", 6).alias("errors"), merged("w", 7).alias("warnings"),
        F.when(F.size(notes) == 0, F.array(F.lit(ALL_GOOD))).otherwise(notes).alias("feedback"))
    return out.withColumn("grade_label", band_label(c("final_score_100")))
