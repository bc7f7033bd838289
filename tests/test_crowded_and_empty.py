"""Crowded drawings finish without pairs or driver rounds; drawings and regions without rows keep their defaults."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkgrade.operators import boxes as B, segments as S

BOX = "drawing_id long, seq long, x1 int, y1 int, x2 int, y2 int"
VIEW = BOX + ", diag_ratio double, hv_ratio double, view_type string"


def _random_boxes(rng, n, drawing, side=2200):
    for i in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        yield drawing, i, x, y, x + rng.randrange(1, 120), y + rng.randrange(1, 120)


def _greedy(rows, limit):
    area = lambda b: max(0, b[4] - b[2]) * max(0, b[5] - b[3])
    kept = []
    for b in sorted(rows, key=lambda b: (-area(b), b[1])):
        for k in kept:
            inter = max(0, min(b[4], k[4]) - max(b[2], k[2])) * max(0, min(b[5], k[5]) - max(b[3], k[3]))
            union = area(b) + area(k) - inter
            if union > 0 and inter / union >= limit:
                break
        else:
            kept.append(b)
    return {b[:2] for b in kept}


def test_nms_of_many_drawings(spark):
    rng = random.Random(1)
    rows = {d: list(_random_boxes(rng, 300, d, 400)) for d in range(12)}
    rows[99] = [(99, 1, -20, -10, 30, 40), (99, 2, -20, -10, 30, 40), (99, 3, 5, 5, 5, 9), (99, 4, 5, 5, 5, 9), (99, 5, 7, 7, 3, 3)]
    df = spark.createDataFrame([r for v in rows.values() for r in v], BOX)
    got = {(r.drawing_id, r.seq) for r in B.nms(df, 0.3).collect()}
    assert got == {k for d, v in rows.items() if d != 99 for k in _greedy(v, 0.3)} | {(99, 1), (99, 3), (99, 5)}


def test_nms_of_a_crowded_drawing(spark):
    df = spark.range(100_000).select(
        F.lit(1).cast("long").alias("drawing_id"), F.col("id").alias("seq"), (F.xxhash64("id") % 1000 + 1000).cast("int").alias("x1"),
        (F.xxhash64("id", F.lit(1)) % 1000 + 1000).cast("int").alias("y1")).withColumns({
            "x2": F.col("x1") + 1 + F.pmod("seq", F.lit(60)).cast("int"), "y2": F.col("y1") + 1 + F.pmod("seq", F.lit(47)).cast("int")})
    start = time.time()
    kept = B.nms(df, 0.45)
    assert 1000 < kept.count() < 100_000 and time.time() - start < 120
    sample = kept.filter("x1 < 400 AND y1 < 400")
    assert B.nms(sample, 0.45).count() == sample.count()


def test_nms_of_an_empty_table(spark):
    assert B.nms(spark.createDataFrame([], BOX)).count() == 0


def _views(drawing, boxes, slant=0.0):
    return [(drawing, i, *b, slant, 0.5, "hv_dominant") for i, b in enumerate(boxes)]


def test_roles_without_zone(spark):
    four = [(100, 100, 300, 300), (100, 400, 300, 500), (400, 100, 500, 300), (600, 600, 700, 700)]
    views = spark.createDataFrame(_views(1, four) + _views(2, four) + [(2, 9, 800, 800, 900, 900, 0.9, 0.1, "diag_dominant")], VIEW)
    zones = spark.createDataFrame([(1, 0, 0, 1000, 1000)], "drawing_id long, zx1 int, zy1 int, zx2 int, zy2 int")
    roles = {(r.drawing_id, r.seq): r.role for r in B.resolve_roles(views, zones).collect()}
    assert [roles[1, i] for i in range(4)] == ["front", "top", "side", "extra_1"] == [roles[2, i] for i in range(4)]
    assert roles[2, 9] == "isometric"


def test_roles_null_measures_and_equal_boxes(spark):
    same = (10, 10, 60, 60)
    rows = [(1, i, *same, None, None, None) for i in range(3)] + [(2, 0, *same, 0.5, 0.1, None)]
    zones = spark.createDataFrame([], "drawing_id long, zx1 int, zy1 int, zx2 int, zy2 int")
    roles = {(r.drawing_id, r.seq): r.role for r in B.resolve_roles(spark.createDataFrame(rows, VIEW), zones).collect()}
    assert roles == {(1, 0): "front", (1, 1): "top", (1, 2): None, (2, 0): "isometric"}
    assert B.resolve_roles(spark.createDataFrame([], VIEW), zones).count() == 0


def test_roles_of_a_crowded_drawing_and_carried_columns(spark):
    rng = random.Random(4)
    many = [b[2:] for b in _random_boxes(rng, 10_000, 1)]
    rows = spark.createDataFrame(_views(1, many) + _views(2, many[:3]), VIEW).withColumns(
        {"notes": F.array(F.col("seq").cast("string")), "count": F.when(F.col("seq") % 2 == 0, F.col("seq"))})
    zones = spark.createDataFrame([(1, 0, 0, 2320, 2320)], "drawing_id long, zx1 int, zy1 int, zx2 int, zy2 int")
    got = B.resolve_roles(rows, zones, carry=["notes", "count"]).collect()
    assert len(got) == 10_003 and all(r.notes == [str(r.seq)] and r["count"] == (None if r.seq % 2 else r.seq) for r in got)
    named = {r.role for r in got if r.drawing_id == 1}
    assert {"front", "top", "side", "extra_1"} <= named and sum(r.role == "front" for r in got) == 2


@pytest.fixture(scope="module")
def one_flat_line(spark):
    lines = spark.createDataFrame([(1, "front", 0, 0, 50, 0, 600, 500)], "drawing_id long, role string, x1 int, y1 int, x2 int, y2 int, w int, h int")
    return lines, spark.createDataFrame([(1, "front"), (2, "top")], "drawing_id long, role string")


def test_defaults_of_regions_without_candidates(one_flat_line):
    lines, views = one_flat_line
    rows = {r.drawing_id: r for r in S.hatch_family(lines, regions=views).collect()}
    assert {i: (r.target_angle, r.line_count, r.dom_ratio, r.angle_std) for i, r in rows.items()} == {i: (0.0, 0, 0.0, 999.0) for i in (1, 2)}
    spacing = S.stripe_spacing(lines, S.hatch_family(lines, regions=views)).collect()
    assert [(r.stripe_count, r.median_gap_norm, r.gap_cv) for r in spacing] == [(0, 0.0, 999.0)] * 2
    assert [tuple(r)[1:] for r in S.parallel_families(lines, drawings=views).collect()] == [(0, 0, 0, 0)] * 2
    assert [tuple(r)[1:] for r in S.dominant_angle_hist(lines, drawings=views).collect()] == [(None, 0, 0.0, 0.0)] * 2
    seen = {r.drawing_id: (r["count"], r.visible) for r in S.visible_contours(lines, views=views).collect()}
    assert seen == {1: (1, False), 2: (0, False)}


def test_weighted_deviation_of_large_equal_values(spark):
    rows = spark.createDataFrame([(1, 1e9, 3.0), (1, 1e9, 5.0), (2, 1.0, 0.0)], "drawing_id long, v double, w double")
    groups = spark.createDataFrame([(1,), (2,), (3,)], "drawing_id long")
    got = {r.drawing_id: (r.mean, r.std) for r in S.weighted_mean_std(rows, F.col("v"), F.col("w"), groups=groups).collect()}
    assert got[1][0] == pytest.approx(1e9) and got[1][1] < 500 and got[2] == got[3] == (0.0, 999.0)
