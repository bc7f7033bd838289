"""Null measures of the comparison rubric: each input of each scorer alone, and all of them at once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkgrade.operators import rubric_ref as R

GOOD = {
    "score_placement": ("placement", None, dict(
        coverage=1.0, angle_sim=1.0, stu_cx=5.0, stu_cy=5.0, ref_cx=5.0, ref_cy=5.0)),
    "score_line_types": ("line_types", "line_types_reason", dict(
        stu_p50=2.0, ref_p50=2.0, stu_r9050=1.4, stu_r7525=1.4, ref_r9050=1.4, ref_r7525=1.4, st_dash=30.0, et_dash=30.0)),
    "score_dimension_marks": ("dimension_marks", "dimension_why", dict(
        st_dim_area=5000.0, et_dim_area=5000.0, st_small_cnt=30.0, et_small_cnt=30.0, st_dash=10.0, et_dash=10.0, st_long=0.5)),
    "score_projections": ("projections", None, dict(projection_count=3.0, st_dash=10.0)),
    "score_visible_view": ("visible_view", "visible_view_reason", dict(
        view_ref_area=4000.0, view_stu_area=4000.0, view_found=1.0, view_right=1.0, view_iou=1.0, ref_diag=0.2, stu_diag=0.2)),
    "score_visible_section": ("visible_section", "visible_section_reason", dict(
        sect_ref_area=4000.0, sect_stu_area=4000.0, sect_found=1.0, sect_right=1.0, sect_iou=1.0)),
    "score_cleanliness_ref": ("cleanliness", "severity", dict(
        ref_line_px=1000.0, out_line_px=0.0, blob_px=0.0, out_speck_cnt=0.0, speck_cnt=0.0, dirty_px=0.0, blob_cnt=0.0)),
}
ALWAYS = dict(similarity=1.0, coverage=1.0, missing_ratio=0.0, extra_ratio=0.0, width=100.0, height=100.0)


@pytest.mark.parametrize("name", GOOD)
def test_null_measures_earn_nothing(spark, name):
    score, why, measures = GOOD[name]
    full = ALWAYS | measures
    cases = {"none": full, "all": full | dict.fromkeys(measures)} | {m: full | {m: None} for m in measures}
    if name == "score_placement":
        cases["size"] = full | dict(width=None, height=None)
    rows = [(case, *values.values()) for case, values in cases.items()]
    df = spark.createDataFrame(rows, "case string, " + ", ".join(f"{m} double" for m in full))
    out = {r["case"]: r for r in getattr(R, name)(df).withColumn("score", F.col(score)).collect()}
    assert out.pop("none")["score"] == dict((k, p) for _, k, _, p in R.CRITERIA)[score]
    assert {case: r["score"] for case, r in out.items()} == dict.fromkeys(out, 0)
    if why == "severity":
        assert all(r[why] is None for r in out.values())
    elif why:
        assert all(r[why] for r in out.values())
