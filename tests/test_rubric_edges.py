"""Rubric thresholds on both sides of equality, by hand."""

import pytest
from pyspark.sql import Row, functions as F

from inkgrade.functions.text import band_label, grade_label, parse_id_list, safe_text, to_upload_url, has_suffix
from inkgrade.operators import admission, rubric_free as free, rubric_ref as ref, report, writes


def one(df, col):
    return [r[col] for r in df.collect()]


def test_frame_gate_and_negative_similarity(spark):
    rows = [Row(similarity=s, coverage=c, missing_ratio=m, extra_ratio=e) for s, c, m, e in [
        (0.12, 0.12, 0.0, 0.0), (0.1199, 1.0, 0.0, 0.0), (1.0, 0.1199, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0),
        (-0.4, 1.0, 0.0, 0.0), (None, 1.0, 0.0, 0.0), (0.5, 0.5, None, None)]]
    df = spark.createDataFrame(rows, "similarity double, coverage double, missing_ratio double, extra_ratio double")
    assert one(ref.score_frame(df), "frame") == [1, 0, 0, 3, 0, 0, 1]


def test_placement_without_box_scores_zero(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 10.0, 10.0, 10.0, 10.0), (1.0, 1.0, None, None, 10.0, 10.0)],
        "coverage double, angle_sim double, stu_cx double, stu_cy double, ref_cx double, ref_cy double").withColumn(
        "width", F.lit(100)).withColumn("height", F.lit(50))
    assert one(ref.score_placement(df), "placement") == [6, 0]


@pytest.mark.parametrize("st,et,expected", [(70, 31, 0), (70, 32, 8), (69, 0, 8)])
def test_line_types_noise_gate(spark, st, et, expected):
    # 71 / 32 = 2.21875 is gated, 71 / 33 = 2.15 is not
    df = spark.createDataFrame([(st, et)], "st_dash int, et_dash int").select(
        "*", *[F.lit(1.4).alias(f"{s}_{q}") for s in ("ref", "stu") for q in ("p50", "r9050", "r7525")])
    assert one(ref.score_line_types(df), "line_types") == [expected]


def test_dimension_marks_reasons_joined(spark):
    df = spark.createDataFrame(
        [(0.0, 0.1, 0.5, 0.6, 100, 0, 0.0, 0, 0, 0, 0), (0.9, 0.9, 0.0, 0.0, 0, 0, 0.5, 1999, 1501, 11, 0),
         (0.9, 0.9, 0.0, 0.0, 0, 0, 0.5, 1999, 1500, 11, 9), (0.9, 0.9, 0.0, 0.0, 0, 0, 0.5, 2000, 1000, 12, 6)],
        "similarity double, coverage double, missing_ratio double, extra_ratio double, st_dash int, et_dash int, "
        "st_long double, et_dim_area int, st_dim_area int, et_small_cnt int, st_small_cnt int")
    out = ref.score_dimension_marks(df).collect()
    assert [r.dimension_marks for r in out] == [0, 12, 8, 6]
    assert out[0].dimension_why == "hard_bad + noise_bad + extra_bad + noise_override"


def test_projection_gate(spark):
    df = spark.createDataFrame([(0.02, 0.9, 70, 5), (0.0201, 0.9, 70, 5), (0.27, 0.17, 0, 2), (0.28, 0.17, 0, 2)],
                               "similarity double, coverage double, st_dash int, projection_count int")
    assert one(ref.score_projections(df), "projections") == [0, 18, 0, 12]


def test_view_count_ladder(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "orthographic_count int")
    assert one(free.score_view_count(df), "view_count") == [0, 2, 4, 6, 6]
    assert one(free.score_view_count(df, required=2, top=5), "view_count") == [0, 2, 5, 5, 5]


def test_cleanliness_free_edges(spark):
    df = spark.createDataFrame(
        [(180.0, 110.0, 0.0025, 1, 0.010), (179.9, 109.9, 0.0026, 1, 0.0101), (80.0, 70.0, 0.0075, 4, 0.030),
         (34.9, 69.9, 0.0181, 0, 0.0301), (35.0, 0.0, 0.0180, 9, 1.0)],
        "sharpness double, contrast double, stray_ratio double, stray_count int, border_occ double")
    assert one(free.score_cleanliness_free(df), "score") == [10, 6, 6, 0, 2]


def test_dimension_rules_differ_by_stage(spark):
    df = spark.createDataFrame([(2, 1, 0), (2, 2, 0), (0, 0, 1)], "text_count int, line_count int, cluster_count int")
    assert one(free.dimension_quality(df, "discover"), "dim_present") == [True, True, True]
    assert one(free.dimension_quality(df, "final"), "dim_present") == [False, True, True]


def test_requirements_first_pattern_and_defaults(spark):
    df = spark.createDataFrame([("Kamida 2 ta proyeksiya",), ("views 4",), (None,), ("Разрез и 3 вида, РАЗМЕР, yaqqol",)], "description string")
    out = [tuple(r)[1:] for r in free.with_requirements(df).collect()]
    assert out == [(2, False, False, True), (4, False, False, True), (3, False, False, True), (3, True, True, True)]


def test_grades(spark):
    df = spark.createDataFrame([(86.0,), (85.99,), (71.0,), (56.0,), (55.9,), (90.0,), (0.0,)], "t double")
    assert one(df.select(grade_label(F.col("t")).alias("g")), "g") == ["A'lo", "Yaxshi", "Yaxshi", "Qoniqarli", "Qoniqarsiz", "A'lo", "Qoniqarsiz"]
    assert one(df.select(band_label(F.col("t")).alias("g")), "g") == ["Yaxshi", "Yaxshi", "Qoniqarli+", "Qoniqarsiz", "Qoniqarsiz", "A'lo", "Qoniqarsiz"]


def test_upload_urls(spark):
    paths = [None, "", "app\\uploads\\a.png", "/x/app/uploads/b/app/uploads/c.png", "uploads/a", "/uploads/a", "C:\\x\\y"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert one(df.select(to_upload_url(F.col("p")).alias("u")), "u") == [
        None, None, "/uploads/a.png", "/uploads/b/app/uploads/c.png", "/uploads/a", "/uploads/a", "C:/x/y"]


def test_suffixes(spark):
    df = spark.createDataFrame([(p,) for p in ["a.PDF", ".pdf", "x/.png", "a.b.jpeg", "a.bmp", "jpg"]], "p string")
    assert one(df.select(has_suffix(F.col("p")).alias("s")), "s") == [True, False, False, True, False, False]


def test_id_lists(spark):
    df = spark.createDataFrame([(p,) for p in [" 3, 1,,3 ", "1,x", "", None]], "p string")
    out = one(df.select(parse_id_list(F.col("p")).alias("v")), "v")
    assert [(v.ids, v.valid) for v in out] == [([3, 1], True), (None, False), ([], True), ([], True)]


def test_cells_are_cut(spark):
    df = spark.createDataFrame([("a" * 180,), ("b" * 181,)], "t string")
    assert one(df.select(safe_text(F.col("t")).alias("t")), "t") == ["a" * 180, "b" * 177 + "..."]


def test_deadline_is_strict(spark):
    df = spark.sql("""SELECT * FROM VALUES (timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-01'),
      (timestamp_ntz'2024-01-01 00:00:01', timestamp_ntz'2024-01-01'), (timestamp_ntz'2024-01-01', NULL) AS t(created_at, deadline)""")
    assert one(admission.deadline_status(df), "deadline_status") == ["open", "closed", "open"]


def test_patch_set_null_overwrites_and_unset_keeps(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "id int, x string, y string")
    patches = spark.createDataFrame([(1, ["x"], None, "zz"), (2, [], "q", "q")], "id int, set_columns array<string>, x string, y string")
    out = writes.patch_rows(base, patches, "id", ["x", "y"]).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, None, "b"), (2, "c", "d"), (3, "e", "f")]


def test_normalize_truthiness(spark):
    docs = ['{"total_score":0,"score":50,"details":{},"json_result":{"a":1}}', '{"total_score":null,"ball":"7.5","table":{"k":1}}',
            '{"score":"x"}', '{"details":{"a":1}}', '{"score":true,"rows":[1],"table":0,"overlay":""}']
    out = report.normalize_results(spark.createDataFrame([(d,) for d in docs], "json string")).collect()
    assert [r.total_score for r in out] == [0.0, 7.5, None, None, 1.0]
    assert [r.error for r in out] == [None, None, "total_score is not a number", "total_score not found", None]
    assert out[0].ai_json_result == '{"a":1}' and out[1].table_json == '[{"k":1}]' and out[4].table_json == "[1]"
    assert out[4].overlay_path is None


@pytest.mark.parametrize("levels", [1, 2, 3, 8])
def test_flatten_any_depth_and_whole_texts(spark, levels):
    long = "x" * 200
    docs = ['{"a":{"b":{"c":1}},"l":[{"x":1}],"e":{}}', '{"t":"%s","l":["%s"]}' % (long, long), '{"f":0.123456789,"g":0.25,"n":12}',
            "7", None, "{"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, json string")
    rows = {(r.id, r.key): r.value for r in report.flatten_report(df, levels=levels).collect()}
    assert rows == {
        (0, "a.b.c"): "1", (0, "l"): '[{"x":1}]', (1, "t"): long, (1, "l"): '["' + "x" * 175 + "...", (2, "f"): "0.1235",
        (2, "g"): "0.25", (2, "n"): "12", (3, "qiymat"): "7", (4, "qiymat"): None, (5, "qiymat"): None}


def test_drawings_without_parts_are_reported(spark):
    from inkgrade.operators import components, segments

    ids = spark.createDataFrame([(1,), (2,)], "drawing_id long")
    lines = spark.createDataFrame([(1, 0, 0, 200, 0, 500, 500)], "drawing_id long, x1 int, y1 int, x2 int, y2 int, w int, h int")
    hist = {r[0]: r[1] for r in segments.angle_hist(lines, drawings=ids).collect()}
    assert hist[1][0] == 1.0 and hist[2] == [1.0 / 18] * 18
    assert {r[0]: r[1] for r in segments.long_line_ratio(lines, drawings=ids).collect()} == {1: 1.0, 2: 0.0}
    assert {r[0]: r[1] for r in segments.skew_angle(lines, drawings=ids).collect()} == {1: 0.0, 2: 0.0}
    blobs = spark.createDataFrame([(1, 50, 10, 10, 100, 100)], "drawing_id long, area int, w int, h int, page_w int, page_h int")
    assert {tuple(r) for r in components.small_component_stats(blobs, drawings=ids).collect()} == {(1, 1, 50), (2, 0, 0)}
    assert {tuple(r) for r in components.section_components(blobs, drawings=ids).collect()} == {(1, 1), (2, 0)}


def test_report_of_a_drawing_without_views_or_cleanliness(spark):
    from inkgrade.plans.catalog import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    first = t.views.agg(F.min("drawing_id")).first()[0]
    views, clean = t.views.where(F.col("drawing_id") != first), t.clean_facts.where(F.col("drawing_id") != first + 1)
    out = report.evaluate_optional_batch(
        views, t.zones, t.titles, t.hatch_measures.drop("role"), t.role_evidence.drop("role"), clean, t.compliance_facts)
    got = {r["drawing_id"]: r for r in out.where(F.col("drawing_id") <= first + 1).collect()}
    assert got[first]["completeness_arrangement"] == 0 and got[first]["raw_total"] is not None
    assert got[first + 1]["cleanliness"] == 0 and got[first + 1]["raw_total"] is not None
