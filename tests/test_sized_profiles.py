"""Kernels, gaps, lengths and heights of their own for every profile equal one call per profile with numbers."""

import random

import pytest
from pyspark.sql import functions as F

from inkgrade.operators import cells as M, profiles as P

c = F.col
#: profile: length, kernel, gap, least length
PAGES = {1: (40, 3, 5, 3), 2: (97, 8, 4, 6), 3: (12, 5, 3, 2), 4: (60, 11, 9, 4)}


@pytest.fixture(scope="module")
def profiles(spark):
    rng = random.Random(5)
    rows = [(i, p, float(rng.choice([0, 0, 3, 9, 40])), *PAGES[i]) for i in PAGES for p in range(PAGES[i][0])]
    return spark.createDataFrame(rows, "profile_id int, pos int, val double, n int, k int, gap int, least int").cache()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("step", [
    lambda p, n, k, gap, least: P.moving_average(p, k).select("profile_id", "pos", F.round("smooth", 9)),
    lambda p, n, k, gap, least: P.split_by_valleys(p, least, 0.5, k),
    lambda p, n, k, gap, least: P.split_by_valleys(p, least, 0.3, k, occupancy=True, floor=2.0),
    lambda p, n, k, gap, least: P.active_runs(p, k, gap, least),
    lambda p, n, k, gap, least: P.valley_cut(p, n),
    lambda p, n, k, gap, least: P.find_runs(P.close_gaps(p, c("val") > 5, gap), c("closed"), least),
])
def test_columns_equal_numbers(profiles, step):
    own = _rows(step(profiles, c("n"), c("k"), c("gap"), c("least")))
    each = sorted(r for i, q in PAGES.items() for r in _rows(step(profiles.filter(c("profile_id") == i), *q)))
    assert own == each and own


def test_run_lengths_of_each_mask(spark):
    rng = random.Random(6)
    ks = {1: (2, 3), 2: (4, 2), 3: (50, 1)}
    cells = spark.createDataFrame(
        list({(i, rng.randrange(20), rng.randrange(20)) for i in ks for _ in range(220)}), "mask_id int, y int, x int")
    dims = spark.createDataFrame([(i, 20, 20, a, b) for i, (a, b) in ks.items()], "mask_id int, h int, w int, kx int, ky int")
    each = sorted(r for i, (a, b) in ks.items() for r in _rows(M.long_runs(cells.filter(c("mask_id") == i), a, kv=b)))
    assert _rows(M.long_runs(cells, c("kx"), dims, c("ky"))) == each
    share = {r.mask_id: r.hv_struct_ratio for r in M.hv_struct_ratio(cells, c("kx"), dims, c("ky")).collect()}
    assert share[3] == 1.0 and 0 < share[1] < 1
