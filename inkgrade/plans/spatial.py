"""Queries over boxes and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrade.functions import boxes as g
from inkgrade.functions.boxes import SIDES, box
from inkgrade.operators import boxes as B, components as K, projections
from inkgrade.plans.catalog import query

c = F.col


def inter(a, b):
    return (f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)::BIGINT * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))")


def area(a):
    return f"(greatest({a}.x2 - {a}.x1, 0)::BIGINT * greatest({a}.y2 - {a}.y1, 0))"


def iou(a, b, extra=""):
    return f"({inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)}{extra}))"


def close(a, b, gap):
    return f"({a}.x2 + {gap} >= {b}.x1 AND {b}.x2 + {gap} >= {a}.x1 AND {a}.y2 + {gap} >= {b}.y1 AND {b}.y2 + {gap} >= {a}.y1)"


def xov(a, b):
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) / greatest(1, least({a}.x2 - {a}.x1, {b}.x2 - {b}.x1)))"


def yov(a, b):
    return f"(greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0) / greatest(1, least({a}.y2 - {a}.y1, {b}.y2 - {b}.y1)))"


def merged(table, gap, keys=("drawing_id",), rounds=16):
    """Boxes grown round by round to the hull of everything close, in plain recursion."""
    k, ak = ", ".join(keys), ", ".join(f"a.{x}" for x in keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    return f"""WITH RECURSIVE g AS (SELECT DISTINCT {k}, x1, y1, x2, y2, 0 AS it FROM {{{table}}}
  UNION ALL SELECT DISTINCT {k}, nx1, ny1, nx2, ny2, it FROM (SELECT {ak}, min(b.x1) AS nx1, min(b.y1) AS ny1, max(b.x2) AS nx2, max(b.y2) AS ny2, a.it + 1 AS it
    FROM g a JOIN g b ON {on} AND {close('a', 'b', gap)} WHERE a.it < {rounds} GROUP BY {ak}, a.x1, a.y1, a.x2, a.y2, a.it))
SELECT {k}, x1, y1, x2, y2 FROM g WHERE it = {rounds}"""


@query("box_helpers", f"""SELECT a.drawing_id, a.seq, {area('a')} AS area, (a.x1 + a.x2) / 2.0 AS cx, (a.y1 + a.y2) / 2.0 AS cy,
  CASE WHEN least(a.x2, d.w - 500) > least(a.x1, d.w - 500) AND least(a.y2, d.h - 300) > least(a.y1, d.h - 300) THEN least(a.x2, d.w - 500) END AS clip_x2,
  greatest(a.x1 - 10, 0) AS pad_x1, least(a.y2 + 10, d.h) AS pad_y2, greatest(a.x2, d.w - 50) AS hull_x2
FROM {{boxes}} a JOIN {{drawing_dims}} d ON d.drawing_id = a.drawing_id""")
def _(t):
    rows = t.boxes.join(t.drawing_dims, "drawing_id")
    b = box()
    clipped, padded = g.clip_box(b, c("w") - 500, c("h") - 300), g.pad_box(b, 10, c("w"), c("h"))
    hull = g.enclose(b, F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), (c("w") - 50).alias("x2"), c("h").alias("y2")))
    return rows.select("drawing_id", "seq", g.box_area(b).alias("area"), g.center_x(b).alias("cx"), g.center_y(b).alias("cy"),
                       clipped.getField("x2").alias("clip_x2"), padded.getField("x1").alias("pad_x1"),
                       padded.getField("y2").alias("pad_y2"), hull.getField("x2").alias("hull_x2"))


@query("box_pairs", f"""SELECT a.drawing_id, a.seq AS a_seq, b.seq AS b_seq FROM {{boxes}} a JOIN {{boxes}} b
  ON a.drawing_id = b.drawing_id AND a.seq < b.seq AND {close('a', 'b', 28)}""")
def _(t):
    return B.box_pairs(t.boxes, 28).select("drawing_id", "a_seq", "b_seq")


@query("iou", f"""SELECT a.drawing_id, a.seq AS a_seq, b.seq AS b_seq, round({iou('a', 'b')}, 9) AS plain, CASE WHEN {inter('a', 'b')} = 0 THEN 0.0 ELSE round({iou('a', 'b', ' + 1e-6')}, 9) END AS eps,
  round({inter('a', 'b')} / greatest({area('a')} + {area('b')} - {inter('a', 'b')}, 1), 9) AS floored
FROM {{boxes}} a JOIN {{boxes}} b ON a.drawing_id = b.drawing_id AND a.seq < b.seq AND {close('a', 'b', 0)}""")
def _(t):
    a, b = box("a_"), box("b_")
    return B.box_pairs(t.boxes, 0).select(
        "drawing_id", "a_seq", "b_seq", F.round(g.iou(a, b), 9).alias("plain"),
        F.round(g.iou(a, b, "eps"), 9).alias("eps"), F.round(g.iou(a, b, "floor"), 9).alias("floored"))


@query("overlaps", f"""SELECT a.drawing_id, a.seq AS a_seq, b.seq AS b_seq, round({inter('a', 'b')} / greatest(1, least({area('a')}, {area('b')})), 9) AS overlap,
  round({xov('a', 'b')}, 9) AS x_overlap, round({yov('a', 'b')}, 9) AS y_overlap,
  round(sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2.0) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2.0) ** 2), 6) AS center_dist
FROM {{boxes}} a JOIN {{boxes}} b ON a.drawing_id = b.drawing_id AND a.seq < b.seq AND {close('a', 'b', 0)}""")
def _(t):
    a, b = box("a_"), box("b_")
    return B.box_pairs(t.boxes, 0).select(
        "drawing_id", "a_seq", "b_seq", F.round(g.overlap_ratio(a, b), 9).alias("overlap"),
        F.round(g.x_overlap(a, b), 9).alias("x_overlap"), F.round(g.y_overlap(a, b), 9).alias("y_overlap"),
        F.round(g.center_dist(a, b), 6).alias("center_dist"))


@query("merge_boxes", merged("boxes", 28))
def _(t):
    return B.merge_boxes(t.boxes, 28)


def _nms_sql(ranked, thr, extra="", limit=None):
    stop = f"len(r.kept) < {limit} AND " if limit else ""
    return f"""WITH RECURSIVE ranked AS ({ranked}),
r AS (SELECT drawing_id, 1 AS i, [b] AS kept FROM ranked WHERE k = 1
  UNION ALL SELECT r.drawing_id, r.i + 1, CASE WHEN {stop}len(list_filter(r.kept, lambda q: {iou('q', 'n.b', extra)} >= {thr})) = 0 THEN list_append(r.kept, n.b) ELSE r.kept END
  FROM r JOIN ranked n ON n.drawing_id = r.drawing_id AND n.k = r.i + 1),
f AS (SELECT drawing_id, max_by(kept, i) AS kept FROM r GROUP BY drawing_id)"""


@query("nms", _nms_sql(f"SELECT a.drawing_id, {{{{'seq': a.seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}}} AS b, row_number() OVER (PARTITION BY a.drawing_id ORDER BY {area('a')} DESC, seq) AS k FROM {{boxes}} a", 0.45)
       + " SELECT drawing_id, u.b.seq AS seq, u.b.x1 AS x1, u.b.y1 AS y1, u.b.x2 AS x2, u.b.y2 AS y2 FROM (SELECT drawing_id, unnest(kept) AS b FROM f) u")
def _(t):
    return B.nms(t.boxes, 0.45)


@query("nms_topk", _nms_sql(f"""SELECT a.drawing_id, {{{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}}} AS b, row_number() OVER (PARTITION BY a.drawing_id ORDER BY a.area + 0.20 * {area('a')} DESC, seq) AS k
  FROM {{ink_boxes}} a JOIN {{drawing_dims}} d ON d.drawing_id = a.drawing_id WHERE a.area >= greatest(350, trunc(0.0007 * d.h * d.w)) AND (a.x2 - a.x1 >= 0.08 * d.w OR a.y2 - a.y1 >= 0.08 * d.h)""", 0.35, limit=3)
       + """ SELECT drawing_id, u.b.x1 AS x1, u.b.y1 AS y1, u.b.x2 AS x2, u.b.y2 AS y2, pick FROM (SELECT drawing_id, unnest(kept) AS b, generate_subscripts(kept, 1) AS pick FROM f) u
  UNION ALL SELECT drawing_id, 0, 0, w, h, 1 FROM {drawing_dims} WHERE drawing_id NOT IN (SELECT drawing_id FROM f)""")
def _(t):
    return B.nms_topk(t.ink_boxes, t.drawing_dims)


@query("topk_boxes", f"SELECT drawing_id, seq, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY {area('a')} DESC, seq) AS k FROM {{boxes}} a) WHERE k <= 3")
def _(t):
    return B.topk_boxes(t.boxes)


@query("pick_visible_box", """SELECT drawing_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY 1.8 * long_diag_ratio + 1.0 * diag_ratio + 0.45 * sqrt(area_ratio) + 0.20 * density DESC, seq) AS k FROM {visible_candidates}) WHERE k = 1""")
def _(t):
    return B.pick_visible_box(t.visible_candidates).select("drawing_id", "seq")


@query("pick_isometric", f"""WITH far AS (SELECT a.drawing_id, a.seq, avg(sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2.0) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2.0) ** 2)) AS far FROM {{views}} a JOIN {{views}} b ON a.drawing_id = b.drawing_id AND a.seq <> b.seq GROUP BY ALL),
s AS (SELECT a.drawing_id, a.seq, a.diag_ratio, a.view_type, 1.6 * (a.diag_ratio - a.hv_ratio) + 0.9 * ({area('a')} / ((z.zx2 - z.zx1) * (z.zy2 - z.zy1))) + 0.6 * (coalesce(f.far, 0) / (greatest(z.zx2 - z.zx1, z.zy2 - z.zy1) + 1e-6))
  + CASE WHEN a.view_type = 'diag_dominant' THEN 0.35 ELSE 0 END AS score FROM {{views}} a LEFT JOIN far f ON f.drawing_id = a.drawing_id AND f.seq = a.seq JOIN {{zones}} z ON z.drawing_id = a.drawing_id)
SELECT drawing_id, seq, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, seq) AS k FROM s) WHERE k = 1 AND (diag_ratio >= 0.12 OR view_type = 'diag_dominant')""")
def _(t):
    return B.pick_isometric(t.views, t.zones).select("drawing_id", "seq", F.round("score", 4).alias("score"))


def _front_sql(views):
    return f"""SELECT drawing_id, seq, score, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, seq) AS k FROM (
  SELECT a.drawing_id, a.seq, a.x1, a.y1, a.x2, a.y2, 1.2 * {area('a')} + coalesce(s.support, 0) / 10.0 * 10000.0 AS score FROM {views} a LEFT JOIN (
    SELECT a.drawing_id, a.seq, sum(CASE WHEN {xov('a', 'b')} >= 0.18 AND b.y1 + b.y2 < a.y1 + a.y2 THEN 10 WHEN {xov('a', 'b')} >= 0.18 AND b.y1 + b.y2 > a.y1 + a.y2 THEN 8 ELSE 0 END
      + CASE WHEN {yov('a', 'b')} >= 0.18 AND b.x1 + b.x2 <> a.x1 + a.x2 THEN 9 ELSE 0 END) AS support
    FROM {views} a JOIN {views} b ON a.drawing_id = b.drawing_id AND a.seq <> b.seq GROUP BY ALL) s ON s.drawing_id = a.drawing_id AND s.seq = a.seq)) WHERE k = 1"""


def _top_sql(views, front):
    return f"""SELECT drawing_id, seq, score, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, seq) AS k FROM (
  SELECT b.drawing_id, b.seq, b.x1, b.y1, b.x2, b.y2, 2.5 * {xov('f', 'b')} + 1.5 * CASE WHEN b.y1 + b.y2 > f.y1 + f.y2 THEN 1.2 ELSE 0.15 END - 0.0025 * abs((b.x1 + b.x2 - f.x1 - f.x2) / 2.0) - 0.0015 * abs((b.y1 + b.y2 - f.y1 - f.y2) / 2.0) AS score
  FROM {views} b JOIN {front} f ON f.drawing_id = b.drawing_id WHERE {xov('f', 'b')} >= 0.18)) WHERE k = 1"""


def _side_sql(views, front):
    return f"""SELECT drawing_id, seq, score, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, seq) AS k FROM (
  SELECT b.drawing_id, b.seq, b.x1, b.y1, b.x2, b.y2, 2.5 * {yov('f', 'b')} + 0.8 - 0.0015 * abs((b.y1 + b.y2 - f.y1 - f.y2) / 2.0) - 0.0010 * abs((b.x1 + b.x2 - f.x1 - f.x2) / 2.0) AS score
  FROM {views} b JOIN {front} f ON f.drawing_id = b.drawing_id WHERE {yov('f', 'b')} >= 0.18 AND abs(b.x1 + b.x2 - f.x1 - f.x2) >= 10)) WHERE k = 1"""


@query("pick_front", f"SELECT drawing_id, seq, score FROM ({_front_sql('{views}')})")
def _(t):
    return B.pick_front(t.views).select("drawing_id", "seq", "score")


def _rest(t):
    front = B.pick_front(t.views)
    return t.views.join(front.select("drawing_id", "seq"), ["drawing_id", "seq"], "left_anti"), front


_REST = f"WITH f AS ({_front_sql('{views}')}), rest AS (SELECT * FROM {{views}} v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.drawing_id = v.drawing_id AND f.seq = v.seq)) "


@query("assign_top", _REST + f"SELECT drawing_id, seq, round(score, 6) AS score FROM ({_top_sql('rest', 'f')})")
def _(t):
    return B.assign_top(*_rest(t)).select("drawing_id", "seq", F.round("score", 6).alias("score"))


@query("assign_side", _REST + f"SELECT drawing_id, seq, round(score, 6) AS score FROM ({_side_sql('rest', 'f')})")
def _(t):
    return B.assign_side(*_rest(t)).select("drawing_id", "seq", F.round("score", 6).alias("score"))


def _not_in(table, *others):
    return f"SELECT v.* FROM {table} v WHERE " + " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM {o} o WHERE o.drawing_id = v.drawing_id AND o.x1 = v.x1 AND o.y1 = v.y1 AND o.x2 = v.x2 AND o.y2 = v.y2)" for o in others)


@query("resolve_roles", f"""WITH orth AS (SELECT v.* FROM {{views}} v WHERE NOT EXISTS (SELECT 1 FROM {{pick_isometric}} i WHERE i.drawing_id = v.drawing_id AND i.seq = v.seq)),
f AS ({_front_sql('orth')}), r1 AS (SELECT * FROM orth v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.drawing_id = v.drawing_id AND f.seq = v.seq)),
tp AS ({_top_sql('r1', 'f')}), r2 AS ({_not_in('orth', 'f', 'tp')}), sd AS ({_side_sql('r2', 'f')}), ex AS ({_not_in('orth', 'f', 'tp', 'sd')}),
n AS (SELECT drawing_id, seq, 'isometric' AS role FROM {{pick_isometric}} UNION ALL SELECT drawing_id, seq, 'front' FROM f UNION ALL SELECT drawing_id, seq, 'top' FROM tp UNION ALL SELECT drawing_id, seq, 'side' FROM sd
  UNION ALL SELECT drawing_id, seq, 'extra_' || row_number() OVER (PARTITION BY drawing_id ORDER BY seq) FROM ex)
SELECT v.drawing_id, v.seq, n.role FROM {{views}} v LEFT JOIN n ON n.drawing_id = v.drawing_id AND n.seq = v.seq""")
def _(t):
    return B.resolve_roles(t.views, t.zones).select("drawing_id", "seq", "role")


_BANDS = """WITH s AS (SELECT r.*, d.w, d.h, greatest(12, round_even((x2 - x1) * 0.18, 0))::INT AS bw, greatest(12, round_even((y2 - y1) * 0.18, 0))::INT AS bh,
  greatest(12, round_even((x2 - x1) * 0.30, 0))::INT AS rx, greatest(12, round_even((y2 - y1) * 0.30, 0))::INT AS ry FROM {role_boxes} r JOIN {drawing_dims} d ON d.drawing_id = r.drawing_id),
b AS (SELECT drawing_id, role, 'top' AS band, greatest(0, x1 - rx) AS x1, greatest(0, y1 - bh) AS y1, least(w, x2 + rx) AS x2, y1 AS y2 FROM s
UNION ALL SELECT drawing_id, role, 'bottom', greatest(0, x1 - rx), y2, least(w, x2 + rx), least(h, y2 + bh) FROM s
UNION ALL SELECT drawing_id, role, 'left', greatest(0, x1 - bw), greatest(0, y1 - ry), x1, least(h, y2 + ry) FROM s
UNION ALL SELECT drawing_id, role, 'right', x2, greatest(0, y1 - ry), least(w, x2 + bw), least(h, y2 + ry) FROM s)
SELECT * FROM b WHERE x2 - x1 >= 6 AND y2 - y1 >= 6"""


@query("dimension_bands", _BANDS)
def _(t):
    return B.dimension_bands(t.role_boxes, t.drawing_dims)


@query("outer_boxes", """SELECT r.drawing_id, r.role, coalesce(b.x1, r.x1) AS x1, coalesce(b.y1, r.y1) AS y1, coalesce(b.x2, r.x2) AS x2, coalesce(b.y2, r.y2) AS y2 FROM {role_boxes} r
LEFT JOIN (SELECT drawing_id, role, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM {dimension_bands} GROUP BY ALL) b USING (drawing_id, role)""")
def _(t):
    return B.outer_boxes(t.role_boxes, B.dimension_bands(t.role_boxes, t.drawing_dims))


@query("text_groups", merged("band_boxes", 8, ("drawing_id", "band")).replace("WITH RECURSIVE g", "WITH RECURSIVE g").replace(
    "SELECT drawing_id, band, x1, y1, x2, y2 FROM g WHERE it = 16",
    "SELECT m.drawing_id, m.band, m.x1, m.y1, m.x2, m.y2, count(*) AS atom_count, sum(b.area)::BIGINT AS area_sum FROM g m JOIN {band_boxes} b ON b.drawing_id = m.drawing_id AND b.band = m.band AND "
    + close("m", "b", 0) + " WHERE m.it = 16 GROUP BY ALL"))
def _(t):
    return B.text_groups(t.band_boxes, 8, ["drawing_id", "band"])


@query("band_clusters", merged("band_boxes", 14, ("drawing_id", "band")).replace(
    "SELECT drawing_id, band, x1, y1, x2, y2 FROM g WHERE it = 16",
    "SELECT * FROM (SELECT m.drawing_id, m.band, m.x1, m.y1, m.x2, m.y2, count(*) FILTER (b.kind = 'text') AS text_count, count(*) FILTER (b.kind = 'line') AS line_count FROM g m JOIN {band_boxes} b ON b.drawing_id = m.drawing_id AND b.band = m.band AND "
    + close("m", "b", 0) + " WHERE m.it = 16 GROUP BY ALL) WHERE (text_count >= 1 AND line_count >= 1) OR text_count >= 2 OR line_count >= 2"))
def _(t):
    return B.band_clusters(t.band_boxes)


@query("reject_clusters", f"""WITH p AS (SELECT c.*, r.x1 AS rx1, r.y1 AS ry1, r.x2 AS rx2, r.y2 AS ry2, (c.x1 + c.x2) / 2.0 AS cx, (c.y1 + c.y2) / 2.0 AS cy, greatest(1, r.x2 - r.x1) AS rw, greatest(1, r.y2 - r.y1) AS rh
  FROM {{role_clusters}} c JOIN {{role_boxes}} r ON r.drawing_id = c.drawing_id AND r.role = c.role),
q AS (SELECT *, greatest(rx1 - cx, cx - rx2, ry1 - cy, cy - ry2) AS best FROM p WHERE NOT (cx BETWEEN rx1 + rw * 0.275 AND rx2 - rw * 0.275 AND cy BETWEEN ry1 + rh * 0.275 AND ry2 - rh * 0.275)),
s AS (SELECT *, CASE WHEN rx1 - cx = best THEN CASE WHEN abs(best) <= rw * 1.42 THEN 'left' END WHEN cx - rx2 = best THEN CASE WHEN abs(best) <= rw * 1.42 THEN 'right' END
  WHEN ry1 - cy = best THEN CASE WHEN abs(best) <= rh * 1.42 THEN 'top' END ELSE CASE WHEN abs(best) <= rh * 1.42 THEN 'bottom' END END AS side FROM q)
SELECT s.drawing_id, s.role, s.x1, s.y1, s.x2, s.y2, s.text_count, s.line_count, s.side, CAST(1.2 * least(2, text_count) + 1.0 * least(2, line_count) + 0.4 AS DOUBLE) AS strength FROM s
WHERE side IS NOT NULL AND 1.2 * least(2, text_count) + 1.0 * least(2, line_count) + 0.4 >= 1.0
  AND NOT EXISTS (SELECT 1 FROM {{titles}} t WHERE t.drawing_id = s.drawing_id AND {inter('s', 't')} / greatest(1, least({area('s')}, {area('t')})) > 0.10)
  AND NOT EXISTS (SELECT 1 FROM {{role_boxes}} v WHERE v.drawing_id = s.drawing_id AND NOT (v.x1 = rx1 AND v.y1 = ry1 AND v.x2 = rx2 AND v.y2 = ry2) AND {inter('s', 'v')} / greatest(1, least({area('s')}, {area('v')})) > 0.08)""")
def _(t):
    return B.reject_clusters(t.role_clusters, t.role_boxes, t.titles).withColumn("strength", F.round("strength", 6))


@query("choose_cut", """WITH f AS (SELECT drawing_id, ycut, count(*) AS cnt, stddev_pop((x1 + x2) / 2.0) AS sx, stddev_pop((y1 + y2) / 2.0) AS sy, max(x2 - x1) AS mw, max(y2 - y1) AS mh FROM {cut_boxes} GROUP BY ALL),
r AS (SELECT c.drawing_id, c.ycut, c.w, coalesce(cnt, 0) AS cnt, sx, sy, coalesce(mw / c.w, 1.0) AS wide, coalesce(mh / greatest(1, c.ycut), 1.0) AS tall FROM {cuts} c LEFT JOIN f ON f.drawing_id = c.drawing_id AND f.ycut = c.ycut),
s AS (SELECT *, 140.0 * cnt + CASE WHEN cnt >= 2 THEN 30.0 * sx / w + 40.0 * sy / ycut ELSE 0 END - 30.0 * greatest(0.0, wide - 0.16) - CASE WHEN cnt = 1 AND wide > 0.18 THEN 60.0 + 120.0 * (wide - 0.18) ELSE 0 END
  - CASE WHEN cnt = 1 AND tall > 0.30 THEN 70.0 + 110.0 * (tall - 0.30) ELSE 0 END AS score FROM r)
SELECT drawing_id, ycut, cnt, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, cnt DESC, ycut) AS k FROM s) WHERE k = 1""")
def _(t):
    return B.choose_cut(t.cuts, t.cut_boxes).withColumn("score", F.round("score", 6))


@query("projection_filter", """WITH kept AS (SELECT *, false AS fallback FROM {projection_features} WHERE bw >= min_w AND bh >= min_h AND area >= min_area AND ((hvs >= 0.26 AND hvl >= 0.50) OR (hvs >= 0.48 AND hv_len >= diag_len * 1.15))),
soft AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY 3.5 * hvs + 2.5 * hvl + 0.35 * ln(1 + area) + 0.15 * least(bh / greatest(1, bw), 3.0) - 0.20 * (diag_len / greatest(1.0, hv_len + diag_len)) DESC, seq) AS k
  FROM {projection_features} WHERE drawing_id NOT IN (SELECT drawing_id FROM kept) AND area >= greatest(20, trunc(min_area * 0.45)) AND bw >= greatest(10, trunc(min_w * 0.70)) AND bh >= greatest(12, trunc(min_h * 0.70))
  AND NOT (bw >= trunc(w * 0.55) AND bh <= trunc(h * 0.12)) AND ((hvs >= 0.14 AND hvl >= 0.34) OR (hvs >= 0.22 AND hv_len >= diag_len * 0.80) OR (hvl >= 0.55 AND area >= greatest(40, trunc(min_area * 0.65)))))
SELECT drawing_id, seq, fallback FROM kept UNION ALL SELECT drawing_id, seq, true FROM soft WHERE k = 1""")
def _(t):
    return B.projection_filter(t.projection_features).select("drawing_id", "seq", "fallback")


FIT_SQL = f"""SELECT a.drawing_id, a.x1, a.y1, a.x2, a.y2 FROM {{ink_boxes}} a JOIN {{zones}} z ON z.drawing_id = a.drawing_id
WHERE a.x2 - a.x1 >= 70 AND a.y2 - a.y1 >= 70 AND {area('a')} / ((zx2 - zx1) * (zy2 - zy1)) BETWEEN 0.004 AND 0.55 AND a.fill_ratio >= 0.01"""


@query("projection_candidates", "WITH RECURSIVE fit AS (" + FIT_SQL + "), " + merged("fit", 28).replace("WITH RECURSIVE ", "").replace("{fit}", "fit").replace(
    "SELECT drawing_id, x1, y1, x2, y2 FROM g WHERE it = 16",
    f"SELECT a.drawing_id, x1, y1, x2, y2, round({area('a')} / ((zx2 - zx1) * (zy2 - zy1)), 9) AS area_ratio FROM g a JOIN {{zones}} z ON z.drawing_id = a.drawing_id WHERE it = 16"))
def _(t):
    return B.projection_candidates(t.ink_boxes, t.zones).withColumn("area_ratio", F.round("area_ratio", 9))


@query("title_block_rank", f"""SELECT drawing_id, seq, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, seq) AS k FROM (
  SELECT a.*, 2.5 * hv_fill + 0.8 * fill_ratio + (x1 + x2) / 2.0 / w + (y1 + y2) / 2.0 / h - 2.0 * greatest(0.0, (y2 - y1) / h - 0.26) AS score FROM {{title_candidates}} a
  WHERE x2 - x1 >= 40 AND y2 - y1 >= 25 AND {area('a')} / (w * h + 1e-6) BETWEEN 0.010 AND 0.30 AND fill_ratio >= 0.03)) WHERE k = 1""")
def _(t):
    return B.title_block_rank(t.title_candidates).select("drawing_id", "seq", F.round("score", 6).alias("score"))


@query("drawing_zone", """WITH a AS (SELECT d.*, t.x1 IS NULL AS none, greatest(0, t.y1 - 12) AS top, greatest(0, t.x1 - 12) AS beside FROM {drawing_dims} d LEFT JOIN {titles} t ON t.drawing_id = d.drawing_id),
b AS (SELECT *, CASE WHEN w * top >= beside * h THEN w ELSE least(beside, w) END AS zx, CASE WHEN w * top >= beside * h THEN least(top, h) ELSE h END AS zy FROM a)
SELECT drawing_id, CASE WHEN none OR zx * zy < 1000 THEN 12 ELSE 0 END AS zx1, CASE WHEN none OR zx * zy < 1000 THEN 12 ELSE 0 END AS zy1,
  CASE WHEN none OR zx * zy < 1000 THEN w - 12 ELSE zx END AS zx2, CASE WHEN none OR zx * zy < 1000 THEN h - 12 ELSE zy END AS zy2 FROM b""")
def _(t):
    return B.drawing_zone(t.drawing_dims, t.titles)


# ---- components ---------------------------------------------------------------------------------
@query("dash_like_count", """SELECT d.drawing_id, count(k.seq) AS dashes FROM {drawing_dims} d LEFT JOIN {components} k ON k.drawing_id = d.drawing_id
AND k.area BETWEEN 10 AND 220 AND k.w BETWEEN 2 AND 45 AND k.h BETWEEN 2 AND 45 GROUP BY d.drawing_id""")
def _(t):
    return K.dash_like_count(t.components, t.drawing_dims)


@query("small_component_stats", """SELECT a.drawing_id, count(*) FILTER (ok) AS small_count, coalesce(sum(area) FILTER (ok), 0)::BIGINT AS small_area
FROM {all_drawings} a LEFT JOIN (SELECT *, area BETWEEN 12 AND 450 AND w BETWEEN 3 AND 60 AND h BETWEEN 3 AND 60 AS ok FROM {components}) k ON k.drawing_id = a.drawing_id GROUP BY a.drawing_id""")
def _(t):
    return K.small_component_stats(t.components, t.all_drawings)


@query("section_components", """SELECT a.drawing_id, count(*) FILTER (area >= greatest(6, trunc(page_w * page_h * 0.0001)) AND greatest(w, h) >= greatest(5, trunc(least(page_w, page_h) * 0.04))) AS section_components
FROM {all_drawings} a LEFT JOIN {page_components} k ON k.drawing_id = a.drawing_id GROUP BY a.drawing_id""")
def _(t):
    return K.section_components(t.page_components, t.all_drawings)


@query("classify_components", """SELECT drawing_id, seq, area BETWEEN 12 AND 260 AND w <= 35 AND h <= 35 AND area / (w * h) BETWEEN 0.08 AND 0.75 AS text_like,
  area BETWEEN 6 AND 160 AND greatest(w, h) <= 30 AND greatest(w, h) / least(w, h) >= 1.9 AS dashed_like,
  CASE WHEN area < 3 THEN 'none' WHEN area <= 18 THEN 'speckle' WHEN area >= 20 AND area / (w * h) >= 0.28 AND greatest(w, h) / least(w, h) <= 4.5 THEN 'blob'
    WHEN area BETWEEN 12 AND 220 AND greatest(w, h) / least(w, h) <= 8 AND area / (w * h) >= 0.10 THEN 'blob' ELSE 'none' END AS noise,
  CASE WHEN area < 4 THEN 'none' WHEN area <= 16 THEN 'speckle' ELSE 'line' END AS outside,
  area BETWEEN 8 AND 2500 AND w BETWEEN 3 AND 140 AND h BETWEEN 4 AND 55 AND NOT (h > 3.8 * w AND area < 60) AND NOT (w / h > 12 AND area < 100) AS text_atom,
  area BETWEEN 20 AND 12000 AS stray FROM {components}""")
def _(t):
    return K.classify_components(t.components.select("drawing_id", "seq", "w", "h", "area")).drop("w", "h", "area")


@query("component_roles", """SELECT 'dim_line' AS kind, drawing_id, seq FROM {page_components} WHERE area >= 10 AND least(w, h) <= 5 AND greatest(w, h) >= base
UNION ALL SELECT 'frame', drawing_id, seq FROM {page_components} WHERE (x <= trunc(page_w * 0.08) OR y <= trunc(page_h * 0.08) OR x + w >= page_w - trunc(page_w * 0.08) OR y + h >= page_h - trunc(page_h * 0.08)) AND (w / page_w >= 0.55 OR h / page_h >= 0.55)
UNION ALL SELECT 'anchor', drawing_id, seq FROM (SELECT *, greatest(10, trunc(region_w * region_h * 0.0006)) AS least_area FROM {page_components}) WHERE NOT (w >= trunc(region_w * 0.45) AND h <= trunc(region_h * 0.16)) AND area >= least_area
  AND w >= greatest(3, trunc(region_w * 0.015)) AND NOT (h < greatest(8, trunc(region_h * 0.10)) AND area < trunc(2.0 * least_area))""")
def _(t):
    def kind(df, name):
        return df.select(F.lit(name).alias("kind"), "drawing_id", "seq")
    return kind(K.dim_lines(t.page_components), "dim_line").unionByName(
        kind(K.frame_like(t.page_components), "frame")).unionByName(kind(K.anchors(t.page_components), "anchor"))


@query("dim_lines", "SELECT drawing_id, seq FROM (SELECT *, 10 + gap AS base FROM {components}) WHERE area >= 10 AND least(w, h) <= 5 AND greatest(w, h) >= base")
def _(t):
    return K.dim_lines(t.components.withColumn("base", c("gap") + 10)).select("drawing_id", "seq")


@query("short_diagonals", """SELECT 'range' AS family, drawing_id, seq FROM {components} WHERE area BETWEEN 8 AND 150 AND (angle BETWEEN 20 AND 70 OR angle BETWEEN 110 AND 160) AND aspect >= 2.0 AND greatest(w, h) BETWEEN 6 AND 34
UNION ALL SELECT 'direction', drawing_id, seq FROM {components} WHERE area BETWEEN 6 AND 260 AND aspect >= 1.5 AND greatest(w, h) BETWEEN 6 AND 90
  AND list_min(list_transform([30, 45, 60, 120, 135, 150], lambda d: least(abs(angle - d), 180 - abs(angle - d)))) <= 12""")
def _(t):
    return K.short_diagonals(t.components).select(F.lit("range").alias("family"), "drawing_id", "seq").unionByName(
        K.short_diagonals(t.components, "direction").select(F.lit("direction").alias("family"), "drawing_id", "seq"))


@query("group_by_xgap", """WITH a AS (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY drawing_id ORDER BY x, seq) >= gap THEN 1 ELSE 0 END AS st FROM {components}),
b AS (SELECT *, sum(st) OVER (PARTITION BY drawing_id ORDER BY x, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS group_id FROM a)
SELECT drawing_id, group_id, min(x) AS x1, max(x + w) AS x2, count(*) AS components FROM b GROUP BY drawing_id, group_id""")
def _(t):
    return K.group_by_xgap(t.components)


@query("region_density_filter", """SELECT r.drawing_id, r.region_id, r.area, coalesce(i.n, 0) AS line_px, round(coalesce(i.n, 0) / greatest(r.area, 1), 9) AS density FROM {regions} r
LEFT JOIN (SELECT drawing_id, region_id, count(*) AS n FROM {region_ink} GROUP BY ALL) i ON i.drawing_id = r.drawing_id AND i.region_id = r.region_id
WHERE r.area >= 120 AND coalesce(i.n, 0) / greatest(r.area, 1) >= 0.08""")
def _(t):
    return K.region_density_filter(t.regions, t.region_ink).withColumn("density", F.round("density", 9))


# The chain of splits and refinements has no SQL twin; tests hold it against a pixel-wise version.
@query("detect_projections")
def _(t):
    return projections.detect_projections(t.line_cells, t.outline_segments, t.line_cuts, t.line_dims)
