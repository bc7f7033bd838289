"""Queries over masks of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrade.operators import cells as M, profiles as P
from inkgrade.plans.catalog import query

c = F.col


def dil(src, k, size):
    """Dilation by definition: every cell spread over the kernel, within the page."""
    r = k // 2
    return (f"(SELECT DISTINCT mask_id, y + dy AS y, x + dx AS x FROM {src} CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dy) CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dx)"
            f" WHERE y + dy BETWEEN 0 AND {size - 1} AND x + dx BETWEEN 0 AND {size - 1})")


def ero(src, k, size):
    """Erosion by definition: cells whose kernel, within the page, is all on."""
    r = k // 2
    full = f"(least(y + {r}, {size - 1}) - greatest(y - {r}, 0) + 1) * (least(x + {r}, {size - 1}) - greatest(x - {r}, 0) + 1)"
    return (f"(SELECT mask_id, y, x FROM (SELECT a.mask_id, a.y, a.x, count(*) AS n FROM {src} a JOIN {src} b ON a.mask_id = b.mask_id AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r} GROUP BY ALL) q WHERE n = {full})")


def near(a, b, r, yes=True):
    return f"(SELECT a.* FROM {a} a WHERE {'' if yes else 'NOT '}EXISTS (SELECT 1 FROM {b} b WHERE b.mask_id = a.mask_id AND abs(b.y - a.y) <= {r} AND abs(b.x - a.x) <= {r}))"


def comps(name, src, rounds=24):
    """CTEs ``name`` (mask_id, y, x, label): smallest label spread to neighbours round by round."""
    return f"""{name}_g AS (SELECT mask_id, y, x, y * 10000 + x AS label, 0 AS it FROM {src}
  UNION ALL SELECT a.mask_id, a.y, a.x, min(b.label), a.it + 1 FROM {name}_g a JOIN {name}_g b ON a.mask_id = b.mask_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.it < {rounds} GROUP BY a.mask_id, a.y, a.x, a.it),
{name} AS (SELECT mask_id, y, x, label FROM {name}_g WHERE it = {rounds}),
{name}_s AS (SELECT mask_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM {name} GROUP BY mask_id, label)"""


def kept(name, cond):
    return f"(SELECT k.mask_id, k.y, k.x FROM {name} k JOIN {name}_s s ON s.mask_id = k.mask_id AND s.label = k.label WHERE {cond})"


def _r(df, *cols, n=9):
    for col in cols:
        df = df.withColumn(col, F.round(col, n))
    return df


@query("ink_cells", "SELECT mask_id, y, x FROM {pixels8} WHERE 255 - v > 0")
def _(t):
    return M.ink_cells(t.pixels8)


@query("content_bbox", """SELECT d.mask_id, greatest(0, min(x) - 2) AS x1, greatest(0, min(y) - 2) AS y1, least(47, max(x) + 2) AS x2, least(47, max(y) + 2) AS y2
FROM {all48} r JOIN {dims48} d ON d.mask_id = r.mask_id GROUP BY d.mask_id
UNION ALL SELECT mask_id, NULL, NULL, NULL, NULL FROM {dims48} WHERE mask_id NOT IN (SELECT mask_id FROM {all48})""")
def _(t):
    return M.content_bbox(t.all48, t.dims48, 2)


@query("mask_algebra", """SELECT 'and' AS op, r.* FROM {ref48} r SEMI JOIN {stu48} s USING (mask_id, y, x) UNION ALL SELECT 'minus', r.* FROM {ref48} r ANTI JOIN {stu48} s USING (mask_id, y, x)
UNION ALL SELECT 'or', * FROM {all48} UNION ALL SELECT 'xor', * FROM ((SELECT * FROM {ref48} EXCEPT SELECT * FROM {stu48}) UNION ALL (SELECT * FROM {stu48} EXCEPT SELECT * FROM {ref48}))""")
def _(t):
    ops = {"and": M.mask_and, "minus": M.mask_minus, "or": M.mask_or, "xor": M.mask_xor}
    out = None
    for name, fn in ops.items():
        one = fn(t.ref48, t.stu48).select(F.lit(name).alias("op"), *M.CELL)
        out = one if out is None else out.unionByName(one)
    return out


@query("strip_border", "SELECT * FROM {all48} WHERE y BETWEEN 5 AND 42 AND x BETWEEN 5 AND 42")
def _(t):
    return M.strip_border(t.all48, t.dims48, 5)


@query("connected_components", f"WITH RECURSIVE {comps('k', '{cells8}')} SELECT mask_id, label, x, y, w, h, area FROM k_s WHERE area >= 2")
def _(t):
    return M.connected_components(t.cells8, 2)


@query("connected_components_48", f"WITH RECURSIVE {comps('k', '{all48}', 40)} SELECT mask_id, label, x, y, w, h, area FROM k_s")
def _(t):
    return M.connected_components(t.all48)


@query("remove_small_components", f"WITH RECURSIVE {comps('k', '{cells8}')} SELECT * FROM {kept('k', 'area >= 6')}")
def _(t):
    return M.remove_small_components(t.cells8, 6)


@query("match_metrics", f"""WITH x AS ((SELECT * FROM {{ref48}} EXCEPT SELECT * FROM {{stu48}}) UNION ALL (SELECT * FROM {{stu48}} EXCEPT SELECT * FROM {{ref48}})),
n AS (SELECT mask_id, (SELECT count(*) FROM {{ref48}} r WHERE r.mask_id = d.mask_id) AS r, (SELECT count(*) FROM {{stu48}} r WHERE r.mask_id = d.mask_id) AS s, (SELECT count(*) FROM {{all48}} r WHERE r.mask_id = d.mask_id) AS u,
  (SELECT count(*) FROM x r WHERE r.mask_id = d.mask_id) AS df, (SELECT count(*) FROM {near('{stu48}', '{ref48}', 1)} r WHERE r.mask_id = d.mask_id) AS si, (SELECT count(*) FROM {near('{ref48}', '{stu48}', 1)} r WHERE r.mask_id = d.mask_id) AS ri FROM {{dims48}} d)
SELECT mask_id, round(1.0 - df / greatest(u, 1), 9) AS similarity, round(si / greatest(s, 1), 9) AS coverage, round((r - ri) / greatest(r, 1), 9) AS missing_ratio, round((s - si) / greatest(s, 1), 9) AS extra_ratio FROM n""")
def _(t):
    return _r(M.match_metrics(t.ref48, t.stu48, M.mask_xor(t.ref48, t.stu48), t.dims48, 1), "similarity", "coverage", "missing_ratio", "extra_ratio")


@query("tolerance_metrics", f"""WITH da AS {dil('{ref48}', 5, 48)}, db AS {dil('{stu48}', 5, 48)},
n AS (SELECT mask_id, (SELECT count(*) FROM {{ref48}} r WHERE r.mask_id = d.mask_id) AS r, (SELECT count(*) FROM {{stu48}} r WHERE r.mask_id = d.mask_id) AS s,
  (SELECT count(*) FROM {{ref48}} r SEMI JOIN db USING (mask_id, y, x) WHERE r.mask_id = d.mask_id) AS f, (SELECT count(*) FROM {{stu48}} r SEMI JOIN da USING (mask_id, y, x) WHERE r.mask_id = d.mask_id) AS k,
  (SELECT count(*) FROM da r SEMI JOIN db USING (mask_id, y, x) WHERE r.mask_id = d.mask_id) AS i, (SELECT count(*) FROM (SELECT * FROM da UNION SELECT * FROM db) r WHERE r.mask_id = d.mask_id) AS u FROM {{dims48}} d)
SELECT mask_id, r AS ref_area, s AS stu_area, round(f / greatest(r, 1), 9) AS completeness, round(k / greatest(s, 1), 9) AS correctness, round(i / greatest(u, 1), 9) AS iou, round(s / greatest(r, 1), 9) AS area_ratio,
  round(least(1.0, s / greatest(r, 1), 1.0 / greatest(s / greatest(r, 1), 1e-6)), 9) AS area_balance FROM n""")
def _(t):
    return _r(M.tolerance_metrics(t.ref48, t.stu48, t.dims48, 2), "completeness", "correctness", "iou", "area_ratio", "area_balance")


@query("within_band", f"SELECT mask_id, y, x FROM {near('{ref48}', '{stu48}', 1)}")
def _(t):
    return M.within_band(t.ref48, t.stu48, t.dims48, 1)


@query("missing_extra_cells", f"SELECT *, 'missing' AS kind FROM {near('{ref48}', '{stu48}', 2, False)} UNION ALL SELECT *, 'extra' FROM {near('{stu48}', '{ref48}', 2, False)}")
def _(t):
    return M.missing_extra_cells(t.ref48, t.stu48, t.dims48, 2)


@query("morphology", f"""WITH d AS {dil('{all48}', 3, 48)}, e AS {ero('{all48}', 3, 48)}, cl AS {ero('d', 3, 48)}, op AS {dil('e', 3, 48)}
SELECT 'dilate' AS how, * FROM d UNION ALL SELECT 'erode', * FROM e UNION ALL SELECT 'close', * FROM cl UNION ALL SELECT 'open', * FROM op""")
def _(t):
    out = None
    for how in ("dilate", "erode", "close", "open"):
        one = M.morph(t.all48, t.dims48, how, 3).select(F.lit(how).alias("how"), *M.CELL)
        out = one if out is None else out.unionByName(one)
    return out


def _runs(src, axis, k):
    line = "y" if axis == "x" else "x"
    return f"(SELECT mask_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY mask_id, {line}, isl) AS n FROM (SELECT *, {axis} - row_number() OVER (PARTITION BY mask_id, {line} ORDER BY {axis}) AS isl FROM {src})) WHERE n >= {k})"


@query("long_runs", f"""WITH g AS (SELECT * FROM {_runs('{all48}', 'x', 3)} UNION SELECT * FROM {_runs('{all48}', 'y', 3)})
SELECT 'long' AS kind, * FROM g UNION ALL SELECT 'rest', a.* FROM {{all48}} a ANTI JOIN g USING (mask_id, y, x)""")
def _(t):
    long = M.long_runs(t.all48, 3).select(F.lit("long").alias("kind"), *M.CELL)
    return long.unionByName(M.without_long_runs(t.all48, 3).select(F.lit("rest").alias("kind"), *M.CELL))


@query("hv_struct_ratio", """SELECT mask_id, round(count(*) FILTER (kind = 'long') / count(*), 9) AS hv_struct_ratio FROM {long_runs} GROUP BY mask_id""")
def _(t):
    return _r(M.hv_struct_ratio(t.all48, 3), "hv_struct_ratio")


@query("long_runs_sized", """WITH h AS (SELECT *, count(*) OVER (PARTITION BY mask_id, y, isl) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS isl FROM {all48})),
v AS (SELECT *, count(*) OVER (PARTITION BY mask_id, x, isl) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY mask_id, x ORDER BY y) AS isl FROM {all48}))
SELECT h.mask_id, h.y, h.x FROM h JOIN {sized_dims48} d ON d.mask_id = h.mask_id WHERE n >= d.k
UNION SELECT v.mask_id, v.y, v.x FROM v JOIN {sized_dims48} d ON d.mask_id = v.mask_id WHERE n >= d.k + 1""")
def _(t):
    return M.long_runs(t.all48, c("k"), t.sized_dims48, c("k") + 1).select(*M.CELL)


@query("fill_metrics", """SELECT mask_id, round(count(*) / 2304, 9) AS fill_ratio, round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 9) AS density,
  round(count(*) FILTER (x BETWEEN 4 AND 43 AND y BETWEEN 4 AND 43) / count(*), 9) AS interior_share FROM {all48} GROUP BY mask_id""")
def _(t):
    return _r(M.fill_metrics(t.all48, t.dims48), "fill_ratio", "density", "interior_share")


@query("border_occupancy", """SELECT mask_id, round(sum((y < 4)::INT + (y >= 44)::INT + (x < 4)::INT + (x >= 44)::INT) / (2 * 4 * 96), 9) AS border_occ FROM {all48} GROUP BY mask_id""")
def _(t):
    return _r(M.border_occupancy(t.all48, t.dims48, 4), "border_occ")


_COVER = "EXISTS (SELECT 1 FROM {mask_boxes} b WHERE b.mask_id = a.mask_id AND a.x >= greatest(0, b.x1 - 1) AND a.x < least(48, b.x2 + 1) AND a.y >= greatest(0, b.y1 - 1) AND a.y < least(48, b.y2 + 1))"


@query("protect_cover", f"SELECT a.* FROM {{all48}} a WHERE {_COVER}")
def _(t):
    return M.protect_cover(t.all48, t.mask_boxes, t.dims48, 1)


@query("stray_ratio", f"SELECT mask_id, round(count(*) FILTER (NOT {_COVER}) / 2304, 9) AS stray_ratio FROM {{all48}} a GROUP BY mask_id".replace("FILTER (NOT EXISTS", "FILTER (NOT EXISTS"))
def _(t):
    return _r(M.stray_ratio(t.all48, t.mask_boxes, t.dims48, 1), "stray_ratio")


@query("stroke_quantiles", """WITH q AS (SELECT mask_id, count(*) AS n, quantile_cont(value, [0.25, 0.50, 0.75, 0.90, 0.05, 0.95]) AS q FROM {stroke_values} GROUP BY mask_id)
SELECT mask_id, CASE WHEN n >= 600 THEN round(q[1], 9) END AS p25, CASE WHEN n >= 600 THEN round(q[2], 9) END AS p50, CASE WHEN n >= 600 THEN round(q[3], 9) END AS p75, CASE WHEN n >= 600 THEN round(q[4], 9) END AS p90,
  CASE WHEN n >= 600 THEN round(q[4] / q[2], 9) END AS r9050, CASE WHEN n >= 600 THEN round(q[3] / q[1], 9) END AS r7525, round(q[6] - q[5], 9) AS contrast FROM q""")
def _(t):
    return _r(M.stroke_quantiles(t.stroke_values, 600), "p25", "p50", "p75", "p90", "r9050", "r7525", "contrast")


@query("pick_binarization", """WITH s AS (SELECT *, CASE WHEN fill1 BETWEEN 0.006 AND 0.30 THEN 1.0 - abs(fill1 - 0.08) ELSE -abs(fill1 - 0.08) END AS a, CASE WHEN fill2 BETWEEN 0.006 AND 0.30 THEN 1.0 - abs(fill2 - 0.08) ELSE -abs(fill2 - 0.08) END AS b FROM {two_fills})
SELECT mask_id, fill1, fill2, CASE WHEN a >= b THEN 1 ELSE 2 END AS choice FROM s""")
def _(t):
    return M.pick_binarization(t.two_fills)


@query("occupancy_profile", """SELECT 'y' AS axis, d.mask_id AS profile_id, p.pos::INT AS pos, CAST(count(c.mask_id) AS DOUBLE) AS val FROM {dims48} d CROSS JOIN (SELECT unnest(range(48)) AS pos) p LEFT JOIN {all48} c ON c.mask_id = d.mask_id AND c.y = p.pos GROUP BY ALL
UNION ALL SELECT 'x', d.mask_id, p.pos::INT, round(count(c.mask_id) / 48, 9) FROM {dims48} d CROSS JOIN (SELECT unnest(range(48)) AS pos) p LEFT JOIN {all48} c ON c.mask_id = d.mask_id AND c.x = p.pos GROUP BY ALL""")
def _(t):
    rows = P.occupancy_profile(t.all48, t.dims48).select(F.lit("y").alias("axis"), "profile_id", "pos", "val")
    cols = P.occupancy_profile(t.all48, t.dims48, "x", "mean").select(F.lit("x").alias("axis"), "profile_id", "pos", F.round("val", 9).alias("val"))
    return rows.unionByName(cols)


def _support(src, name="sup", least=20):
    return f"""{name}1 AS {dil(src, 3, 8)}, {name}2 AS {ero(name + '1', 3, 8)}, {name}3 AS {dil(name + '2', 3, 8)}, {name}4 AS {dil(name + '3', 3, 8)}, {name}5 AS {ero(name + '4', 3, 8)},
{comps(name + 'k', name + '5', 12)}, {name} AS {kept(name + 'k', f'area >= {least}')}"""


@query("support_region", f"WITH RECURSIVE {_support('{ref8}')} SELECT mask_id, y, x FROM sup")
def _(t):
    return M.to_cells(M.support_region(t.ref8, t.pair_dims8, (3, 3, 3), 20))


@query("noise_partition", f"""WITH RECURSIVE src AS (SELECT * FROM {{core8}}), {_support('src', 'sup', 5)}, bandk AS {dil('src', 3, 8)},
o AS (SELECT * FROM {{stu8}} s ANTI JOIN sup USING (mask_id, y, x)), i AS (SELECT * FROM (SELECT * FROM {{stu8}} s SEMI JOIN sup USING (mask_id, y, x)) q ANTI JOIN bandk USING (mask_id, y, x)),
{comps('oc', 'o', 24)}, {comps('ic', 'i', 12)},
n AS (SELECT mask_id, area, CASE WHEN area <= 16 THEN 'os' ELSE 'ol' END AS kind FROM oc_s WHERE area >= 4 UNION ALL
  SELECT mask_id, area, CASE WHEN area <= 18 THEN 'sp' WHEN area >= 20 AND area / (w * h) >= 0.28 AND greatest(w, h) / least(w, h) <= 4.5 THEN 'bl' WHEN area BETWEEN 12 AND 220 AND greatest(w, h) / least(w, h) <= 8 AND area / (w * h) >= 0.10 THEN 'bl' END FROM ic_s WHERE area >= 3),
s AS (SELECT mask_id, sum(area) FILTER (kind = 'ol') AS a, sum(area) FILTER (kind = 'os') AS b, sum(area) FILTER (kind = 'bl') AS c, sum(area) FILTER (kind = 'sp') AS d, sum(area) FILTER (kind IS NOT NULL) AS e,
  count(*) FILTER (kind = 'ol') AS f, count(*) FILTER (kind = 'os') AS g, count(*) FILTER (kind = 'bl') AS bc, count(*) FILTER (kind = 'sp') AS sc FROM n GROUP BY mask_id)
SELECT p.mask_id, (SELECT count(*) FROM src WHERE src.mask_id = p.mask_id) AS ref_line_px, coalesce(a, 0)::BIGINT AS out_line_px, coalesce(b, 0)::BIGINT AS out_speckle_px, coalesce(c, 0)::BIGINT AS blob_px, coalesce(d, 0)::BIGINT AS speckle_px, coalesce(e, 0)::BIGINT AS dirty_px,
  coalesce(f, 0) AS out_line_cnt, coalesce(g, 0) AS out_speckle_cnt, coalesce(bc, 0) AS blob_cnt, coalesce(sc, 0) AS speckle_cnt FROM {{pair_dims8}} p LEFT JOIN s USING (mask_id)""")
def _(t):
    return M.noise_partition(t.core8, t.stu8, t.pair_dims8, (3, 3, 3), 3, 5)


@query("structure_cells", f"""WITH RECURSIVE ink AS (SELECT * FROM {{cells8}}), hatch AS (SELECT * FROM {{dark8}}), {comps('k', 'ink')}, txt AS {kept('k', 'area BETWEEN 12 AND 260 AND area / (w * h) BETWEEN 0.08 AND 0.45')},
thin AS {ero('ink', 3, 8)}, {comps('tk', 'thin', 12)}, dash AS {kept('tk', 'area BETWEEN 6 AND 160 AND greatest(w, h) / least(w, h) >= 1.9')},
lft AS (SELECT * FROM ink EXCEPT (SELECT * FROM txt UNION SELECT * FROM dash UNION SELECT * FROM hatch)),
o1 AS {ero('lft', 3, 8)}, o2 AS {dil('o1', 3, 8)}, c1 AS {dil('o2', 3, 8)}, c2 AS {ero('c1', 3, 8)}, {comps('fk', 'c2', 12)}, fin AS {kept('fk', 'area >= 4')}
SELECT d.mask_id, (SELECT count(*) FROM txt q WHERE q.mask_id = d.mask_id) AS text_px, (SELECT count(*) FROM dash q WHERE q.mask_id = d.mask_id) AS dashed_px, (SELECT count(*) FROM hatch q WHERE q.mask_id = d.mask_id) AS hatch_px,
  (SELECT count(*) FROM fin q WHERE q.mask_id = d.mask_id) AS structure_px FROM {{dims8}} d""".replace("BETWEEN 0.08 AND 0.45", "BETWEEN 0.08 AND 0.75"))
def _(t):
    return M.structure_cells(t.cells8, t.dark8, t.dims8, 4)[1]


@query("hatch_region", f"""WITH RECURSIVE ln AS (SELECT * FROM {{dark8}}), g1 AS {dil('ln', 3, 8)}, g2 AS {dil('g1', 3, 8)}, g3 AS {ero('g2', 3, 8)}, g4 AS {ero('{dims_none}', 3, 8)}, {comps('k', 'g3', 14)},
d AS (SELECT k.mask_id, k.label FROM k JOIN ln USING (mask_id, y, x) JOIN k_s s ON s.mask_id = k.mask_id AND s.label = k.label WHERE s.area >= 10 GROUP BY k.mask_id, k.label, s.area HAVING count(*) / s.area >= 0.20),
r AS (SELECT k.mask_id, k.y, k.x FROM k SEMI JOIN d ON d.mask_id = k.mask_id AND d.label = k.label), c1 AS {dil('r', 3, 8)}, c2 AS {ero('c1', 3, 8)}, {comps('f', 'c2', 14)}, fin AS {kept('f', 'area >= 12')}
SELECT p.mask_id, (SELECT count(*) FROM d WHERE d.mask_id = p.mask_id) AS cluster_count, (SELECT count(*) FROM fin q WHERE q.mask_id = p.mask_id) AS region_px FROM {{dims8}} p""".replace(f", g4 AS {ero('{dims_none}', 3, 8)}", ""))
def _(t):
    region, clusters = M.hatch_region(t.dark8, t.dims8, (3, 3, 1, 3), 10, 0.20, 12)
    px = region.groupBy("mask_id").agg(F.count("*").alias("n"))
    return clusters.join(px, "mask_id", "left").select("mask_id", "cluster_count", F.coalesce("n", F.lit(0)).alias("region_px"))
