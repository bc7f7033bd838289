"""Overlays of run tables against pixel arrays: cells, not only counts."""

import numpy as np
import pytest

from inkgrade.operators import cells as M
from tests import pixelwise

H, W = 40, 56


def _masks(seed, share, n=4):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        img = rng.random((H, W)) < share * (i + 1) / n
        for _ in range(i * 2):
            y, x = rng.integers(0, H - 8), rng.integers(0, W - 16)
            for k in range(8):
                img[y + k, x + k:x + k + 2] = True
        out[i] = img
    return out


def _table(spark, masks):
    rows = [(i, int(y), int(x)) for i, img in masks.items() for y, x in np.argwhere(img)]
    return spark.createDataFrame(rows + rows[:20], "mask_id long, y int, x int")


def _cells(df, *more):
    return sorted((r.mask_id, r.y, r.x, *[r[m] for m in more]) for r in df.collect())


def _want(masks, *more):
    return sorted((i, int(y), int(x), *more) for i, img in masks.items() for y, x in np.argwhere(img))


def grow(img, k):
    p = np.pad(img, k // 2)
    return np.any([p[a:a + H, b:b + W] for a in range(k) for b in range(k)], axis=0)


def close(img, k):
    return ~grow(~grow(img, k), k)


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame([(i, H, W) for i in range(5)], "mask_id long, h int, w int")


def test_near_missing_and_extra_cells(spark, dims):
    ref, stu = _masks(1, 0.04), _masks(2, 0.04)
    a, b = _table(spark, ref), _table(spark, stu)
    assert _cells(M.within_band(a, b, dims, 2)) == _want({i: ref[i] & grow(stu[i], 5) for i in ref})
    lost = _want({i: ref[i] & ~grow(stu[i], 5) for i in ref}, "missing")
    more = _want({i: stu[i] & ~grow(ref[i], 5) for i in ref}, "extra")
    assert _cells(M.missing_extra_cells(a, b, dims, 2), "kind") == sorted(lost + more)
    assert M.within_band(a, b.limit(0), dims, 2).count() == 0
    assert M.missing_extra_cells(a.limit(0), b, dims, 2).where("kind = 'missing'").count() == 0


def test_hatch_region_cells(spark, dims):
    lines = _masks(3, 0.03)
    want, clusters = {}, {}
    for i, img in lines.items():
        grown = grow(close(grow(img, 3), 3), 3)
        parts = [p for p in pixelwise.components(grown) if p.sum() >= 30 and (p & img).sum() / p.sum() >= 0.11]
        dense = np.any(parts, axis=0) if parts else np.zeros((H, W), bool)
        region = np.zeros((H, W), bool)
        for p in pixelwise.components(close(dense, 5)):
            if p.sum() >= 40:
                region |= p
        want[i], clusters[i] = region, len(parts)
    cells, counts = M.hatch_region(_table(spark, lines), dims, (3, 3, 3, 5), least=30, density=0.11, final=40)
    assert _cells(cells) == _want(want) and any(v.any() for v in want.values())
    assert {r.mask_id: r.cluster_count for r in counts.collect()} == clusters | {4: 0}
    assert len(set(clusters.values())) > 1


def test_noise_counts(spark, dims):
    ref, stu = _masks(5, 0.03), _masks(6, 0.08)
    got = {r.mask_id: r.asDict() for r in M.noise_partition(
        _table(spark, ref), _table(spark, stu), dims, (3, 5, 3), band=3, least=60).collect()}
    for i in ref:
        grown = close(grow(close(ref[i], 3), 5), 3)
        support = np.zeros((H, W), bool)
        for p in pixelwise.components(grown):
            if p.sum() >= max(60, int(H * W * 0.001)):
                support |= p
        outside, inside = stu[i] & ~support, stu[i] & support & ~grow(ref[i], 3)
        line = [int(p.sum()) for p in pixelwise.components(outside) if p.sum() > 16]
        speck = [int(p.sum()) for p in pixelwise.components(outside) if 4 <= p.sum() <= 16]
        small = [int(p.sum()) for p in pixelwise.components(inside) if 3 <= p.sum() <= 18]
        assert (got[i]["out_line_px"], got[i]["out_speckle_px"], got[i]["out_speckle_cnt"]) == (sum(line), sum(speck), len(speck))
        assert (got[i]["speckle_px"] + got[i]["blob_px"], got[i]["ref_line_px"]) >= (sum(small), int(ref[i].sum()))
        assert got[i]["speckle_px"] <= sum(small) and got[i]["ref_line_px"] == ref[i].sum()
    assert got[4]["dirty_px"] == 0


def test_runs_meet_page_sizes_only(spark, dims):
    """The plan joins runs to the page sizes (to bound rows and columns), never to other runs."""
    a = _table(spark, _masks(1, 0.04))
    plan = M.within_band(a, a, dims, 2)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 1 and "(mask_id#" in joins[0]
