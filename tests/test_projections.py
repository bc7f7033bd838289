"""The view finder against its pixel-wise version, on drawn pages that reach every branch and on the registered query."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkgrade.operators import projections
from inkgrade.plans.catalog import Tables
from tests import pixelwise

W, H = 320, 260
CUTS = (150, 182)


class Page:
    def __init__(self):
        self.ink, self.lines = np.zeros((H, W), bool), []

    def line(self, x1, y1, x2, y2):
        n = max(abs(x2 - x1), abs(y2 - y1), 1)
        for i in range(n + 1):
            self.ink[round(y1 + (y2 - y1) * i / n), round(x1 + (x2 - x1) * i / n)] = True
        self.lines.append((x1, y1, x2, y2))

    def view(self, x1, y1, x2, y2, diagonal=False):
        for a, b, c, d in (x1, y1, x2, y1), (x1, y2, x2, y2), (x1, y1, x1, y2), (x2, y1, x2, y2):
            self.line(a, b, c, d)
        if diagonal:
            self.line(x1, y1, x2, y2)

    def block(self, x1, y1, x2, y2, step):
        for y in range(y1, y2, step):
            self.line(x1, y, x2, y)

    def bricks(self, x1, y1, x2, y2):
        for y in range(y1, y2, 6):
            for x in range(x1, x2 - 6, 10):
                self.ink[y:y + 3, x:x + 7] = True


def _pages():
    pages = {}

    def page(name):
        pages[name] = Page()
        return pages[name]

    page("empty")
    page("two").view(30, 20, 90, 80)
    pages["two"].view(180, 30, 260, 100)
    p = page("four")
    for x in (15, 90, 165, 240):
        p.block(x, 20, x + 50, 60 + x // 4, 4)
    p = page("stacked")  # split by rows
    p.view(40, 10, 110, 55)
    p.view(42, 100, 108, 140)
    p = page("two blocks below a wide one")  # split by rows, then by groups of strokes
    p.block(30, 8, 230, 80, 4)
    p.block(30, 104, 70, 132, 4)
    p.block(190, 104, 230, 132, 4)
    p = page("a block and bricks below a wide one")  # split by rows, then by empty columns
    p.block(30, 8, 230, 80, 4)
    p.block(30, 104, 70, 132, 4)
    p.bricks(180, 104, 230, 116)
    p = page("shallow valley")  # the softer second split
    p.block(30, 20, 100, 120, 4)
    p.block(140, 20, 210, 120, 4)
    p.block(100, 20, 140, 120, 7)
    p = page("slanted")  # only the fallback takes it
    p.line(60, 20, 130, 90)
    p.line(130, 90, 60, 91)
    p.line(60, 91, 60, 20)
    p.line(60, 40, 110, 90)
    p.line(60, 60, 90, 90)
    p = page("framed")  # border lines go
    p.line(3, 2, 316, 2)
    p.line(3, 2, 3, 250)
    p.view(60, 30, 140, 110)
    p = page("specks")
    for x in range(20, 300, 9):
        p.ink[30, x] = True
    for seed in range(8):
        rng, p = random.Random(seed), page(f"random {seed}")
        for _ in range(rng.randint(2, 7)):
            x, y = rng.randint(5, 260), rng.randint(5, 130)
            p.view(x, y, min(W - 2, x + rng.randint(15, 90)), min(H - 2, y + rng.randint(15, 90)), rng.random() < 0.4)
        for _ in range(60):
            p.ink[rng.randrange(H), rng.randrange(W)] = True
    return pages


@pytest.fixture(scope="module")
def drawn(spark):
    pages = _pages()
    cells, lines = [], []
    for i, p in enumerate(pages.values()):
        cells += [(i, int(y), int(x)) for y, x in np.argwhere(p.ink)]
        lines += [(i, *line) for line in p.lines]
    schema = "drawing_id long, x1 int, y1 int, x2 int, y2 int"
    return pages, (
        spark.createDataFrame(cells, "drawing_id long, y int, x int"), spark.createDataFrame(lines, schema),
        spark.createDataFrame([(i, y) for i in range(len(pages)) for y in CUTS], "drawing_id long, ycut int"),
        spark.createDataFrame([(i, W, H) for i in range(len(pages))], "drawing_id long, w int, h int"))


def _found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.drawing_id, r.ycut, r.seq)):
        out[r.drawing_id, r.ycut].append((r.x1, r.y1, r.x2, r.y2, r.fallback))
    return dict(out)


def test_drawn_pages(spark, drawn):
    pages, tables = drawn
    hits, want = set(), {}
    for i, p in enumerate(pages.values()):
        for y in CUTS:
            views = pixelwise.find_views(p.ink, p.lines, y, hits)
            if views:
                want[i, y] = views
    assert hits == {"second split", "rows", "groups", "hollow", "more than three", "fallback"}
    assert _found(projections.detect_projections(*tables)) == want


def test_empty_tables(spark, drawn):
    cells, lines, cuts, dims = drawn[1]
    assert projections.detect_projections(cells.limit(0), lines, cuts, dims).count() == 0
    assert projections.detect_projections(cells, lines, cuts.limit(0), dims).count() == 0


def test_registered_query(spark):
    base = "/root/testdata/sf0.001"
    got = _found(entry.queries()["detect_projections"](spark, base))
    t = Tables(spark, base)
    ink, lines, hits, want = defaultdict(lambda: np.zeros((240, 300), bool)), defaultdict(list), set(), {}
    for r in t.line_cells.collect():
        ink[r.drawing_id][r.y, r.x] = True
    for r in t.outline_segments.collect():
        lines[r.drawing_id].append((r.x1, r.y1, r.x2, r.y2))
    for r in t.line_cuts.collect():
        views = pixelwise.find_views(ink[r.drawing_id], lines[r.drawing_id], r.ycut, hits)
        if views:
            want[r.drawing_id, r.ycut] = views
    assert got == want and len(got) > 10
