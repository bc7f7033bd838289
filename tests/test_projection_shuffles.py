"""The view finder's runs stay in their buckets; masks are cleaned from the runs of whole drawings."""

import re

import pytest
from pyspark.sql import functions as F

from inkgrade.operators import cells as M, profiles as P, projections as V
from inkgrade.operators.lineage import stored_by

c = F.col


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_measures_send_boxes_to_the_runs(spark, no_broadcast):
    runs = spark.createDataFrame([(m, y, 3, 5 + y) for m in range(20) for y in range(0, 12, 2)], "mask_id long, y int, s int, e int")
    ink = stored_by(V.packed(runs), "mask_id")
    back = sorted(tuple(r) for r in V.unpacked(ink).collect())
    assert back == sorted(tuple(r) for r in runs.collect())
    boxes = spark.createDataFrame([(m, 4, 1, 9, 8) for m in range(21)], "mask_id long, x1 int, y1 int, x2 int, y2 int")
    profile = V.box_profile(ink, V._named(boxes), "y")
    smooth = P.split_by_valleys(profile.withColumn("k", F.lit(3)), 2, 0.3, c("k"), occupancy=True)
    plan = smooth._jdf.queryExecution().executedPlan().toString()
    # one exchange, of the boxes; neither the runs nor their profiles and windows are shuffled
    assert len(re.findall(r"\bExchange\b", plan)) == 1, plan
    got = {(r.profile_id.mask_id, r.pos): (r.val, r.lo, r.hi) for r in profile.collect()}
    want = {(m, y - 1): (float(min(9, 5 + y) - 4), 4, min(9, 5 + y)) if m < 20 and y % 2 == 0 else (0.0, None, None)
            for m in range(21) for y in range(1, 8)}
    assert got == want
    plain = P.split_by_valleys(profile.drop(P.GROUP).withColumn("k", F.lit(3)), 2, 0.3, c("k"), occupancy=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, smooth.drop(P.GROUP).collect()))


def test_masks_cleaned_from_runs_equal_those_from_cells(spark):
    w, h = 2300, 2200
    ink = set()
    for x in (300, 301, 302, 900):  # strokes as high as the band, and higher
        ink |= {(y, x) for y in range(0, 125 if x != 900 else 400)}
    for x1, x2, y in ((200, 330, 5), (200, 330, 60), (600, 715, 7), (1000, 1900, 700), (-9, 140, 900), (2100, 2310, 905), (60, 260, 903)):
        ink |= {(y, x) for x in range(x1, x2)}
    for x, y1, y2 in ((20, 600, 900), (100, 650, 760), (2290, 300, 800), (130, 890, 910), (136, 600, 902)):
        ink |= {(y, x) for y in range(y1, y2)}
    ink |= {(y, x) for y in range(1000, 1040) for x in range(100, 200)} | {(-1, 5), (2250, 9)}
    cells = spark.createDataFrame([(7, y, x) for y, x in sorted(ink)] + [(7, 700, 1000)], "drawing_id long, y int, x int")
    dims = spark.createDataFrame([(7, w, h)], "drawing_id long, w int, h int")
    pages = V.mask_pages(spark.createDataFrame([(7, 2150), (7, 950)], "drawing_id long, ycut int"), dims).cache()
    got = V.clean_runs(V.drawing_runs(cells), pages)

    band = (F.least("w", "h") * 0.06).cast("int")
    all_ink = cells.join(pages.select("mask_id", "drawing_id", "w", "h"), "drawing_id").filter(
        "y >= 0 AND y < h AND x >= 0 AND x < w").select("mask_id", "y", "x", "w", "h")
    left = M.mask_minus(all_ink, M.long_runs(all_ink.filter((c("y") < band) | (c("y") >= c("h") - band)), V.LINE))
    left = M.mask_minus(left, M.long_runs(left.filter((c("x") < band) | (c("x") >= c("w") - band)), V.LINE))
    mx = (c("w") * 0.03).cast("int")
    inner = left.filter((c("y") >= (c("h") * 0.02).cast("int")) & (c("x") >= mx) & (c("x") < c("w") - mx))
    size = pages.select("mask_id", "h", "w")
    least = F.greatest(F.lit(18), (c("page_h") * c("page_w") * 0.00008).cast("int"))
    want = M.close_runs(M.drop_small_runs(M.to_runs(inner), least, size), size, 3)
    rows = lambda df: sorted(tuple(r) for r in df.select("mask_id", "y", "s", "e").collect())
    assert rows(got) == rows(want) and len({r[0] for r in rows(got)}) == 2


def test_a_page_given_twice_is_one(spark):
    dims = spark.createDataFrame([(7, 300, 240)] * 2 + [(8, 300, 240)], "drawing_id long, w int, h int")
    cuts = spark.createDataFrame([(7, 124), (7, 124), (7, 139), (8, 124), (None, 124)], "drawing_id long, ycut int")
    assert sorted((r.drawing_id, r.ycut) for r in V.mask_pages(cuts, dims).collect()) == [(7, 124), (7, 139), (8, 124)]
