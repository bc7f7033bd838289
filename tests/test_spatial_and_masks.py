"""Boxes, clusters and masks against brute force, with crowded groups that take the spread-out path."""

import random

import pytest
from pyspark.sql import functions as F

from inkgrade.operators import boxes as B, cells as M, components as K, profiles as P, segments as S


def _crowd(n, drawings=(1, 2, 3), seed=5, copies=40, side=900):
    """Boxes of which one drawing holds most, with many exact copies."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        d = drawings[0] if i % 3 else rnd.choice(drawings)
        x, y = rnd.randrange(side), rnd.randrange(side)
        rows.append((d, i, x, y, x + rnd.randrange(5, 60), y + rnd.randrange(5, 60)))
    rows += [(drawings[0], n + i, 50, 50, 90, 80) for i in range(copies)]
    return rows


SCHEMA = "drawing_id long, seq long, x1 int, y1 int, x2 int, y2 int"


def _close(a, b, gap):
    return a[2] + gap >= b[0] and b[2] + gap >= a[0] and a[3] + gap >= b[1] and b[3] + gap >= a[1]


def _merged(boxes, gap):
    boxes = set(boxes)
    while True:
        grown = set()
        for a in boxes:
            near = [b for b in boxes if _close(a, b, gap)]
            grown.add((min(b[0] for b in near), min(b[1] for b in near), max(b[2] for b in near), max(b[3] for b in near)))
        if grown == boxes:
            return boxes
        boxes = grown


def _by_drawing(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], set()).add(tuple(r)[-4:])
    return out


@pytest.mark.parametrize("n,gap,side", [(40, 6, 900), (400, 6, 1500)])
def test_merge_boxes(spark, n, gap, side):
    rows = _crowd(n, side=side)
    got = _by_drawing(B.merge_boxes(spark.createDataFrame(rows, SCHEMA), gap).collect())
    for d, boxes in _by_drawing(rows).items():
        assert got[d] == _merged(boxes, gap)


def test_merge_needs_a_second_pass_and_touches_at_the_gap(spark):
    # the first two merge into a box that reaches the third, which neither reached alone
    rows = [(1, 0, 0, 0, 10, 10), (1, 1, 12, 90, 20, 100), (1, 2, 0, 8, 4, 92), (2, 0, 0, 0, 10, 10), (2, 1, 38, 0, 50, 10),
            (3, 0, 0, 0, 10, 10), (3, 1, 39, 0, 50, 10), (4, 0, 5, 5, 9, 9)]
    got = _by_drawing(B.merge_boxes(spark.createDataFrame(rows, SCHEMA), 28).collect())
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 2, 4: 1}


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return i / (area(a) + area(b) - i)


@pytest.mark.parametrize("n,side", [(40, 300), (300, 300)])
def test_nms(spark, n, side):
    rows = _crowd(n, side=side)
    got = {}
    for r in B.nms(spark.createDataFrame(rows, SCHEMA), 0.45).collect():
        got.setdefault(r.drawing_id, set()).add(r.seq)
    for d in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-(r[4] - r[2]) * (r[5] - r[3]), r[1])):
            if all(_iou(r[2:], k[2:]) < 0.45 for k in kept):
                kept.append(r)
        assert got[d] == {k[1] for k in kept}


def test_box_pairs_once_each(spark):
    rows = _crowd(200, side=400, copies=5)
    got = sorted((r.drawing_id, r.a_seq, r.b_seq) for r in B.box_pairs(spark.createDataFrame(rows, SCHEMA), 10).collect())
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and _close(a[2:], b[2:], 10))
    assert got == want


def test_topk_suppression_falls_back_to_the_page(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 300, 300, 5000), (1, 1, 5, 5, 300, 300, 4000), (1, 2, 400, 400, 600, 600, 3000)], SCHEMA + ", area int")
    dims = spark.createDataFrame([(1, 1000, 800), (2, 1000, 800)], "drawing_id long, w int, h int")
    got = sorted((r.drawing_id, r.pick, r.x1, r.x2) for r in B.nms_topk(boxes, dims).collect())
    assert got == [(1, 1, 0, 300), (1, 2, 400, 600), (2, 1, 0, 1000)]


def test_cluster_uses_the_running_mean(spark):
    # 0, 4, 8: 8 is within 5 of 4 but not of the mean 2
    df = spark.createDataFrame([(1, float(v)) for v in (8, 0, 4, 4, 4, 20)] + [(2, 1.0)], "k int, v double")
    got = sorted((r.k, r.lo, r.hi, r.n) for r in S.cluster_1d(df, ["k"], "v", F.lit(5.0)).collect())
    assert got == [(1, 0.0, 8.0, 5), (1, 20.0, 20.0, 1), (2, 1.0, 1.0, 1)]


def test_xgap_compares_with_the_previous_row(spark):
    rows = [(1, 0, 0, 50), (1, 1, 5, 2), (1, 2, 20, 5)]  # 20 - 7 >= 10 although the first still reaches 50
    df = spark.createDataFrame([(d, s, x, w, 10) for d, s, x, w in rows], "drawing_id long, seq long, x int, w int, gap int")
    got = sorted((r.x1, r.x2, r.components) for r in K.group_by_xgap(df).collect())
    assert got == [(0, 50, 2), (20, 25, 1)]


# ---- masks --------------------------------------------------------------------------------------
def _mask(rnd, h, w, p):
    return {(y, x) for y in range(h) for x in range(w) if rnd.random() < p}


def _components(cells):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(part)
    return out


@pytest.fixture(scope="module")
def masks():
    rnd = random.Random(3)
    return {i: _mask(rnd, 30, 23, p) for i, p in enumerate((0.05, 0.3, 0.45, 0.6, 0.95, 0.5))}


def _cells(spark, masks):
    rows = [(m, y, x) for m, cells in masks.items() for y, x in cells]
    return spark.createDataFrame(rows + rows[:50], "mask_id long, y int, x int")  # some cells twice


def test_connected_components(spark, masks):
    got = {}
    for r in M.connected_components(_cells(spark, masks)).collect():
        got.setdefault(r.mask_id, []).append((r.x, r.y, r.w, r.h, r.area))
    for m, cells in masks.items():
        want = []
        for part in _components(cells):
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
        assert sorted(got[m]) == sorted(want)


@pytest.mark.parametrize("how,k", [("dilate", 5), ("erode", 3), ("close", 5), ("open", 3)])
def test_morphology(spark, masks, how, k):
    h, w, r = 30, 23, k // 2
    page = {(y, x) for y in range(h) for x in range(w)}

    def dilate(s):
        return {(y, x) for y, x in page if any((y + i, x + j) in s for i in range(-r, r + 1) for j in range(-r, r + 1))}

    def erode(s):
        return page - dilate(page - s)

    step = {"dilate": dilate, "erode": erode, "close": lambda s: erode(dilate(s)), "open": lambda s: dilate(erode(s))}[how]
    dims = spark.createDataFrame([(m, h, w) for m in masks], "mask_id long, h int, w int")
    got = {}
    for row in M.morph(_cells(spark, masks), dims, how, k).collect():
        got.setdefault(row.mask_id, []).append((row.y, row.x))
    for m, cells in masks.items():
        assert sorted(got.get(m, [])) == sorted(step(cells))


def test_xor_is_both_differences(spark, masks):
    a, b = _cells(spark, {1: masks[1]}), _cells(spark, {1: masks[2]})
    xor = {tuple(r) for r in M.mask_xor(a, b).collect()}
    assert xor == {tuple(r) for r in M.mask_minus(a, b).collect()} | {tuple(r) for r in M.mask_minus(b, a).collect()}
    assert xor == {(1, y, x) for y, x in masks[1] ^ masks[2]}


def test_empty_student_mask(spark, masks):
    dims = spark.createDataFrame([(1, 30, 23)], "mask_id long, h int, w int")
    a = _cells(spark, {1: masks[1]})
    row = M.tolerance_metrics(a, a.filter("false"), dims, 2).collect()[0]
    assert (row.completeness, row.correctness, row.stu_area) == (0.0, 0.0, 0)
    row = M.match_metrics(a, a, a.filter("false"), dims, 2).collect()[0]
    assert (row.similarity, row.coverage, row.missing_ratio) == (1.0, 1.0, 0.0)


# ---- profiles -----------------------------------------------------------------------------------
def _profile(spark, rows):
    return spark.createDataFrame([(i, p, float(v)) for i, vals in rows.items() for p, v in enumerate(vals)], "profile_id long, pos int, val double")


def test_closing_at_the_ends(spark):
    df = _profile(spark, {1: [0, 0, 1, 0, 0, 1, 0, 0, 0], 2: [0, 0, 0], 3: [0, 1, 1, 0]})
    out = {}
    for r in P.close_gaps(df, F.col("val") > 0, 3).orderBy("profile_id", "pos").collect():
        out.setdefault(r.profile_id, []).append(int(r.closed))
    # an inner gap of 2 closes under 3, an end gap only when it fits in 1
    assert out == {1: [0, 0, 1, 1, 1, 1, 0, 0, 0], 2: [0, 0, 0], 3: [1, 1, 1, 1]}


def test_average_shrinks_at_the_ends(spark):
    out = P.moving_average(_profile(spark, {1: [3, 3, 3], 2: [5, 5, 5, 5, 5]}), 4).orderBy("profile_id", "pos").collect()
    assert [round(r.smooth, 6) for r in out] == [1.8, 1.8, 1.8, 3.0, 4.0, 5.0, 4.0, 3.0]


def test_runs_cover_the_profile(spark):
    df = _profile(spark, {1: [1, 1, 0, 1, 0, 0, 1], 2: [1] * 4, 3: [0] * 4})
    runs = sorted((r.profile_id, r.s, r.e) for r in P.find_runs(df, F.col("val") > 0).collect())
    assert runs == [(1, 0, 2), (1, 3, 4), (1, 6, 7), (2, 0, 4)]
