"""Queries over segments and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrade.functions.angles import acute, cosine_sim, nearest_angle, raw_angle, seg_length
from inkgrade.operators import profiles as P, segments as S
from inkgrade.plans.catalog import query

c = F.col
LEN = "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
RAW = "degrees(atan2(y2 - y1, x2 - x1))"
ACUTE = f"CASE WHEN abs({RAW}) > 90 THEN 180.0 - abs({RAW}) ELSE abs({RAW}) END"
MOD = f"CASE WHEN {RAW} < 0 THEN CASE WHEN {RAW} <= -180 THEN 0.0 ELSE {RAW} + 180.0 END WHEN {RAW} >= 180 THEN 0.0 ELSE {RAW} END"


def feat(table):
    return f"(SELECT *, {LEN} AS len, {RAW} AS raw, {ACUTE} AS ac, {MOD} AS ang, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my FROM {{{table}}})"


def _r(df, n, *cols):
    for col in cols:
        df = df.withColumn(col, F.round(col, n))
    return df


_HALF = "CASE WHEN raw <= -90 THEN raw + 180.0 WHEN raw > 90 THEN raw - 180.0 ELSE raw END"
_SKEW = f"CASE WHEN {_HALF} > 45 THEN {_HALF} - 90.0 WHEN {_HALF} < -45 THEN {_HALF} + 90.0 ELSE {_HALF} END"


@query("segment_features", f"SELECT drawing_id, seq, round(len, 6) AS length, round(ang, 6) AS angle, round(ac, 6) AS acute, round({_SKEW}, 6) AS skew, mx AS mid_x, my AS mid_y FROM {feat('segments')}")
def _(t):
    return _r(S.segment_features(t.segments), 6, "length", "angle", "acute", "skew").select(
        "drawing_id", "seq", "length", "angle", "acute", "skew", "mid_x", "mid_y")


_HIST = f"""WITH b AS (SELECT drawing_id, CASE WHEN len >= 40 THEN least(floor(ang / 10), 17)::INT END AS bin FROM {feat('segments')}),
n AS (SELECT a.drawing_id, count(bin) AS n FROM {{all_drawings}} a LEFT JOIN b ON b.drawing_id = a.drawing_id GROUP BY a.drawing_id), k AS (SELECT drawing_id, bin, count(*) AS k FROM b WHERE bin IS NOT NULL GROUP BY ALL)
SELECT n.drawing_id, s.bin::INT AS bin, CASE WHEN n.n = 0 THEN round(1.0 / 18, 9) ELSE round(coalesce(k.k, 0) / n.n, 9) END AS share
FROM n CROSS JOIN (SELECT unnest(range(18)) AS bin) s LEFT JOIN k ON k.drawing_id = n.drawing_id AND k.bin = s.bin"""


@query("angle_hist", _HIST)
def _(t):
    return S.angle_hist(t.segments, drawings=t.all_drawings).select("drawing_id", F.posexplode("hist").alias("bin", "share")).withColumn("share", F.round("share", 9))


@query("cosine_sim", f"""WITH b AS (SELECT drawing_id, role, least(floor(ang / 10), 17)::INT AS bin, count(*) AS k FROM {feat('segments')} WHERE len >= 40 GROUP BY ALL),
a AS (SELECT drawing_id, role FROM {{segments}} GROUP BY ALL),
v AS (SELECT a.drawing_id, a.role, s.bin, CASE WHEN sum(coalesce(b.k, 0)) OVER (PARTITION BY a.drawing_id, a.role) = 0 THEN 1.0 / 18 ELSE coalesce(b.k, 0) / sum(coalesce(b.k, 0)) OVER (PARTITION BY a.drawing_id, a.role) END AS x
  FROM a CROSS JOIN (SELECT unnest(range(18)) AS bin) s LEFT JOIN b ON b.drawing_id = a.drawing_id AND b.role = a.role AND b.bin = s.bin)
SELECT p.drawing_id, round(sum(p.x * q.x) / (sqrt(sum(p.x * p.x)) * sqrt(sum(q.x * q.x)) + 1e-9), 6) AS similarity FROM v p JOIN v q ON p.drawing_id = q.drawing_id AND p.bin = q.bin AND p.role = 'front' AND q.role = 'top' GROUP BY p.drawing_id""")
def _(t):
    # one histogram per drawing and role, so both roles meet in a grouping instead of a join of two scans
    h = S.angle_hist(t.segments.filter("role IN ('front', 'top')"), keys=["drawing_id", "role"])
    of = lambda role: F.max(F.when(c("role") == role, c("hist")))
    both = h.groupBy("drawing_id").agg(of("front").alias("a"), of("top").alias("b")).filter("drawing_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    return both.select("drawing_id", F.round(cosine_sim(c("a"), c("b")), 6).alias("similarity"))


@query("orientation_ratios", f"""WITH f AS (SELECT *, ac <= 12 OR ac >= 78 AS p_hv, ac BETWEEN 18 AND 72 AS p_d, ang <= 12 OR ang >= 168 OR ang BETWEEN 78 AND 102 AS v_hv, ang BETWEEN 18 AND 72 OR ang BETWEEN 108 AND 162 AS v_d,
  ac <= 15 OR ac >= 75 AS r_hv, ac BETWEEN 25 AND 65 AS r_d FROM {feat('segments')}),
s AS (SELECT drawing_id, coalesce(sum(len) FILTER (p_hv), 0) AS ph, coalesce(sum(len) FILTER (p_d), 0) AS pd, coalesce(sum(len) FILTER (len >= 1), 0) AS tot, coalesce(sum(len) FILTER (v_hv AND len >= 1), 0) AS vh, coalesce(sum(len) FILTER (v_d AND len >= 1), 0) AS vd,
  coalesce(sum(len) FILTER (v_d AND len >= 1 AND len >= greatest(18, 0.10 * least(w, h))), 0) AS vl, coalesce(sum(len) FILTER (r_hv AND len >= 1), 0) AS rh, coalesce(sum(len) FILTER (r_d AND len >= 1), 0) AS rd FROM f GROUP BY drawing_id)
SELECT drawing_id, round(ph / greatest(1e-6, ph + pd), 6) AS hv_line_ratio, round(vh / greatest(tot, 1e-6), 6) AS v_hv, round(vd / greatest(tot, 1e-6), 6) AS v_diag, round(vl / greatest(tot, 1e-6), 6) AS v_long,
  round(rh / (tot + 1e-6), 6) AS r_hv, round(rd / (tot + 1e-6), 6) AS r_diag, CASE WHEN rd / (tot + 1e-6) > rh / (tot + 1e-6) + 0.12 THEN 'diag_dominant' ELSE 'hv_dominant' END AS view_type FROM s WHERE tot > 0""")
def _(t):
    p = S.orientation_ratios(t.segments, "projection").select("drawing_id", "hv_line_ratio")
    v = S.orientation_ratios(t.segments, "visible").select("drawing_id", c("hv_ratio").alias("v_hv"), c("diag_ratio").alias("v_diag"), c("long_diag_ratio").alias("v_long"))
    r = S.orientation_ratios(t.segments, "region").select("drawing_id", c("hv_ratio").alias("r_hv"), c("diag_ratio").alias("r_diag"), "view_type")
    return _r(p.join(v, "drawing_id").join(r, "drawing_id"), 6, "hv_line_ratio", "v_hv", "v_diag", "v_long", "r_hv", "r_diag")


@query("long_line_ratio", f"SELECT a.drawing_id, round(coalesce(avg((len >= greatest(120, 0.10 * greatest(w, h)))::INT) FILTER (len >= 10), 0), 9) AS long_ratio FROM {{all_drawings}} a LEFT JOIN {feat('segments')} f ON f.drawing_id = a.drawing_id GROUP BY a.drawing_id")
def _(t):
    return _r(S.long_line_ratio(t.segments, drawings=t.all_drawings), 9, "long_ratio")


@query("weighted_angle", f"""WITH s AS (SELECT *, {_SKEW} AS sk FROM {feat('segments')}),
m AS (SELECT a.drawing_id, coalesce(sum(sk * len) FILTER (abs(sk) <= 20 AND len > 0) / (sum(len) FILTER (abs(sk) <= 20 AND len > 0) + 1e-6), 0.0) AS skew_angle, coalesce(sum(len), 0) AS mw, sum(ac * len) / (sum(len) + 1e-6) AS mean FROM {{all_drawings}} a LEFT JOIN s ON s.drawing_id = a.drawing_id GROUP BY a.drawing_id)
SELECT m.drawing_id, round(any_value(skew_angle), 5) AS skew_angle, CASE WHEN any_value(mw) <= 1e-6 THEN 0.0 ELSE round(any_value(mean), 5) END AS mean,
  CASE WHEN any_value(mw) <= 1e-6 THEN 999.0 ELSE round(sqrt(sum(len * (ac - mean) ** 2) / (any_value(mw) + 1e-6)), 4) END AS std FROM m LEFT JOIN s USING (drawing_id) GROUP BY m.drawing_id""")
def _(t):
    ms = S.weighted_mean_std(t.segments, acute(raw_angle()), seg_length(), groups=t.all_drawings)
    return _r(_r(S.skew_angle(t.segments, drawings=t.all_drawings).join(ms, "drawing_id"), 5, "skew_angle", "mean"), 4, "std")


@query("nearest_angle", f"""SELECT drawing_id, seq, CAST(n.t AS DOUBLE) AS target, round(n.d, 6) AS diff FROM (SELECT drawing_id, seq, list_min([{{{{'d': least(abs(ang - 45) % 180, 180 - abs(ang - 45) % 180), 'i': 0, 't': 45.0}}}}, {{{{'d': least(abs(ang - 60) % 180, 180 - abs(ang - 60) % 180), 'i': 1, 't': 60.0}}}},
  {{{{'d': least(abs(ang - 120) % 180, 180 - abs(ang - 120) % 180), 'i': 2, 't': 120.0}}}}, {{{{'d': least(abs(ang - 135) % 180, 180 - abs(ang - 135) % 180), 'i': 3, 't': 135.0}}}}]) AS n FROM {feat('segments')})""")
def _(t):
    return S.segment_features(t.segments).withColumn("n", nearest_angle(c("angle"))).select(
        "drawing_id", "seq", "n.target", F.round("n.diff", 6).alias("diff"))


_CAND = f"(SELECT *, CASE WHEN abs(ac - 45) <= abs(ac - 60) THEN 45.0 ELSE 60.0 END AS fam FROM {feat('hatch_segments')} WHERE len >= greatest(10, trunc(least(w, h) * 0.07)))"
_FAM = f"""SELECT drawing_id, fam, n, total, dom_angle, angle_std, mean_len_ratio FROM (SELECT *, sum(n) OVER (PARTITION BY drawing_id) AS total, row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, len DESC, fam) AS k
  FROM (SELECT drawing_id, fam, count(*) AS n, sum(len) AS len, median(ac) AS dom_angle, stddev_pop(ac) AS angle_std, avg(len / sqrt(w * w + h * h)) AS mean_len_ratio FROM {_CAND} WHERE abs(ac - fam) <= 11 GROUP BY drawing_id, fam)) WHERE k = 1"""


@query("hatch_family", f"SELECT a.drawing_id, coalesce(CAST(fam AS DOUBLE), 0) AS target_angle, coalesce(total, 0)::BIGINT AS line_count, coalesce(n, 0) AS dom_line_count, round(coalesce(n / total, 0), 6) AS dom_ratio, round(coalesce(dom_angle, 0), 6) AS dom_angle, round(coalesce(angle_std, 999), 6) AS angle_std, round(coalesce(mean_len_ratio, 0), 6) AS mean_len_ratio FROM {{all_regions}} a LEFT JOIN ({_FAM}) f ON f.drawing_id = a.drawing_id")
def _(t):
    return _r(S.hatch_family(t.hatch_segments, regions=t.all_regions), 6, "dom_ratio", "dom_angle", "angle_std", "mean_len_ratio").drop("base")


def _clusters(rows, keys, tol):
    """Greedy running-mean clusters by recursion over the sorted rows of each key."""
    k = ", ".join(keys)
    on = " AND ".join(f"n.{x} = r.{x}" for x in keys)
    rk = ", ".join(f"r.{x}" for x in keys)
    joins = f"abs(n.v - r.total / r.n) <= {tol}"
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY v) AS i FROM ({rows})),
r AS (SELECT {k}, 1 AS i, 1 AS cl, v AS total, 1 AS n, v AS lo, v AS hi FROM ranked WHERE i = 1
  UNION ALL SELECT {rk}, r.i + 1, CASE WHEN {joins} THEN r.cl ELSE r.cl + 1 END, CASE WHEN {joins} THEN r.total + n.v ELSE n.v END, CASE WHEN {joins} THEN r.n + 1 ELSE 1 END,
    CASE WHEN {joins} THEN r.lo ELSE n.v END, n.v FROM r JOIN ranked n ON {on} AND n.i = r.i + 1),
cl AS (SELECT {k}, cl, max_by(total / n, i) AS mean, max(n)::BIGINT AS n, max_by(lo, i) AS lo, max(hi) AS hi FROM r GROUP BY {k}, cl)"""


@query("stripe_spacing", f"""WITH RECURSIVE fam AS ({_FAM}), {_clusters(f"SELECT c.drawing_id, -sin(radians(c.fam)) * mx + cos(radians(c.fam)) * my AS v FROM {_CAND} c JOIN fam ON fam.drawing_id = c.drawing_id AND fam.fam = c.fam WHERE abs(ac - c.fam) <= 11", ["drawing_id"], "greatest(3.0, 500 * 0.020)")},
g AS (SELECT drawing_id, mean - lag(mean) OVER (PARTITION BY drawing_id ORDER BY mean) AS gap FROM cl),
s AS (SELECT drawing_id, count(*) AS k, median(gap) AS med, stddev_pop(gap) AS sd, avg(gap) AS av FROM g GROUP BY drawing_id)
SELECT fam.drawing_id, coalesce(k, 0) AS stripe_count, CASE WHEN k >= 2 THEN round(med / 500, 6) ELSE 0.0 END AS median_gap_norm, CASE WHEN k > 2 THEN round(sd / greatest(av, 1e-6), 6) WHEN k = 2 THEN 0.0 ELSE 999.0 END AS gap_cv FROM {{all_regions}} fam LEFT JOIN s USING (drawing_id)""")
def _(t):
    return _r(S.stripe_spacing(t.hatch_segments, S.hatch_family(t.hatch_segments, regions=t.all_regions)), 6, "median_gap_norm", "gap_cv")


@query("cluster_1d", f"WITH RECURSIVE {_clusters('SELECT drawing_id, CAST(x AS DOUBLE) AS v FROM {components}', ['drawing_id'], '40.0')} SELECT drawing_id, lo, hi, round(mean, 6) AS mean, n FROM cl")
def _(t):
    return _r(S.cluster_1d(t.components, ["drawing_id"], "x", F.lit(40.0)), 6, "mean")


@query("parallel_families", f"""WITH a AS (SELECT *, list_min([{{{{'d': least(abs(ang - 45), 180 - abs(ang - 45)), 'i': 0, 't': 45.0}}}}, {{{{'d': least(abs(ang - 60), 180 - abs(ang - 60)), 'i': 1, 't': 60.0}}}},
  {{{{'d': least(abs(ang - 120), 180 - abs(ang - 120)), 'i': 2, 't': 120.0}}}}, {{{{'d': least(abs(ang - 135), 180 - abs(ang - 135)), 'i': 3, 't': 135.0}}}}]) AS near FROM {feat('hatch_segments')}),
b AS (SELECT *, near.t AS fam, round_even((mx * cos(radians((near.t + 90) % 180)) + my * sin(radians((near.t + 90) % 180))) / greatest(6.0, 0.018 * least(w, h)), 0) AS bin FROM a WHERE len >= 6 AND near.d <= 8.5 AND len <= greatest(26, trunc(0.33 * greatest(w, h)))),
k AS (SELECT drawing_id, fam, count(*) AS bins, sum(n) AS acc FROM (SELECT drawing_id, fam, bin, count(*) AS n, sum(len) AS len FROM b GROUP BY ALL HAVING sum(len) >= 8) GROUP BY ALL),
f AS (SELECT drawing_id, fam, count(*) AS n, median(len) AS med, quantile_cont(len, 0.85) AS p85, max(greatest(w, h)) AS side FROM b GROUP BY ALL),
g AS (SELECT f.drawing_id, count(*) AS fams, sum(acc) AS acc, sum(bins) AS bins FROM f JOIN k ON k.drawing_id = f.drawing_id AND k.fam = f.fam WHERE n >= 4 AND bins >= 4 AND med <= 0.16 * side AND p85 <= 0.28 * side GROUP BY f.drawing_id)
SELECT a.drawing_id, coalesce(t.n, 0)::BIGINT AS candidate_segments, coalesce(acc, 0)::BIGINT AS accepted_segments, coalesce(fams, 0) AS accepted_families, coalesce(bins, 0)::BIGINT AS offset_bins
FROM {{all_regions}} a LEFT JOIN (SELECT drawing_id, sum(n) AS n FROM f GROUP BY drawing_id) t USING (drawing_id) LEFT JOIN g USING (drawing_id)""")
def _(t):
    return S.parallel_families(t.hatch_segments, drawings=t.all_regions)


@query("dominant_angle_hist", f"""WITH d AS (SELECT *, ceil(ac - 0.5)::BIGINT AS bin FROM {feat('hatch_segments')} WHERE len >= 3 AND ac BETWEEN 18 AND 75),
t AS (SELECT drawing_id, sum(len) AS tot, count(*) AS n FROM d GROUP BY drawing_id), h AS (SELECT drawing_id, bin, row_number() OVER (PARTITION BY drawing_id ORDER BY sum(len) DESC, bin) AS k FROM d GROUP BY drawing_id, bin),
k AS (SELECT d.drawing_id, h.bin, count(*) AS n, sum(len) AS len, max(least(w, h)) AS side FROM d JOIN h ON h.drawing_id = d.drawing_id AND h.k = 1 WHERE abs(ac - h.bin) <= 10 GROUP BY ALL)
SELECT a.drawing_id, q.bin AS dominant_angle, coalesce(q.n, 0) AS line_count, coalesce(q.p, 0) AS parallel_ratio, coalesce(q.l, 0) AS length_ratio FROM {{all_regions}} a LEFT JOIN (
  SELECT t.drawing_id, k.bin, k.n, round(k.len / (tot + 1e-6), 6) AS p, round(k.len / side, 5) AS l FROM t JOIN k USING (drawing_id) WHERE t.n >= 3 AND k.n >= 3) q USING (drawing_id)""".replace("max(least(w, h))", "max(least(d.w, d.h))"))
def _(t):
    return _r(_r(S.dominant_angle_hist(t.hatch_segments, drawings=t.all_regions), 6, "parallel_ratio"), 5, "length_ratio")


_DASH = f"""items AS (SELECT *, CASE WHEN axis = 'h' THEN (y1 + y2) / 2.0 ELSE (x1 + x2) / 2.0 END AS v, CASE WHEN axis = 'h' THEN least(x1, x2) ELSE least(y1, y2) END AS a1, CASE WHEN axis = 'h' THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS a2
  FROM (SELECT *, CASE WHEN ac <= 14 THEN 'h' WHEN ac >= 76 THEN 'v' END AS axis FROM {feat('dash_segments')} WHERE len BETWEEN 24 AND 180) WHERE axis IS NOT NULL),
{_clusters("SELECT drawing_id, role, axis, v FROM items", ["drawing_id", "role", "axis"], "5")},
m AS (SELECT i.drawing_id, i.role, i.axis, cl.cl, cl.mean, i.a1, i.a2 FROM items i JOIN cl ON cl.drawing_id = i.drawing_id AND cl.role = i.role AND cl.axis = i.axis AND i.v BETWEEN cl.lo AND cl.hi WHERE cl.n >= 3),
w AS (SELECT *, CASE WHEN a1 > max(a2) OVER (PARTITION BY drawing_id, role, axis, cl ORDER BY a1, a2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS st FROM m),
u AS (SELECT *, sum(st) OVER (PARTITION BY drawing_id, role, axis, cl ORDER BY a1, a2 ROWS UNBOUNDED PRECEDING) AS isl FROM w),
iv AS (SELECT drawing_id, role, axis, cl, mean, isl, min(a1) AS s, max(a2) AS e FROM u GROUP BY ALL),
gp AS (SELECT *, s - lag(e) OVER (PARTITION BY drawing_id, role, axis, cl ORDER BY s) AS gap FROM iv),
sq AS (SELECT drawing_id, role, axis, mean AS coord_mean, count(*) AS segment_count, avg(gap) FILTER (gap >= 0) AS mean_gap, count(*) FILTER (gap >= 0) AS gaps, max(e) - min(s) AS span FROM gp GROUP BY drawing_id, role, axis, cl, mean),
seqs AS (SELECT *, span / 600 AS span_ratio FROM sq WHERE segment_count >= 3 AND gaps >= 2 AND mean_gap BETWEEN 2 AND 26 AND span / 600 >= 0.16)"""


@query("dashed_sequences", f"WITH RECURSIVE {_DASH} SELECT drawing_id, role, axis, round(coord_mean, 6) AS coord_mean, segment_count, round(mean_gap, 6) AS mean_gap, span, round(span_ratio, 6) AS span_ratio FROM seqs")
def _(t):
    return _r(S.dashed_sequences(t.dash_segments), 6, "coord_mean", "mean_gap", "span_ratio")


@query("centerline_strength", f"""WITH RECURSIVE {_DASH},
n AS (SELECT drawing_id, role, count(*) AS k, count(*) FILTER (axis = 'h' AND abs(coord_mean - 300) <= 132) AS hn, count(*) FILTER (axis = 'v' AND abs(coord_mean - 300) <= 132) AS vn,
  count(*) FILTER (abs(coord_mean - 300) <= 132 AND span_ratio >= 0.24) AS lg FROM seqs GROUP BY ALL)
SELECT v.drawing_id, v.role, coalesce(k, 0) AS hidden_sequences, CASE WHEN hn > 0 AND vn > 0 THEN 'strong' WHEN lg > 0 THEN 'weak' ELSE 'none' END AS center FROM {{dash_views}} v LEFT JOIN n USING (drawing_id, role)""")
def _(t):
    return S.centerline_strength(S.dashed_sequences(t.dash_segments), t.dash_views)


@query("visible_contours", f"""SELECT a.drawing_id, a.role, count(*) FILTER (ac <= 18 OR ac >= 72) AS count, round(coalesce(sum(len) FILTER (ac <= 18 OR ac >= 72), 0) / 600, 6) AS total_length_ratio,
  count(*) FILTER (ac <= 18 OR ac >= 72) >= 4 AND coalesce(sum(len) FILTER (ac <= 18 OR ac >= 72), 0) / 600 >= 2 AS visible FROM {{all_views}} a LEFT JOIN {feat('dash_segments')} f ON f.drawing_id = a.drawing_id AND f.role = a.role GROUP BY ALL""")
def _(t):
    return _r(S.visible_contours(t.dash_segments, views=t.all_views), 6, "total_length_ratio")


@query("dimension_segments", f"""SELECT drawing_id, role, greatest(0, least(x1, x2) - 2) AS x1, greatest(0, least(y1, y2) - 2) AS y1, least(w, greatest(x1, x2) + 3) AS x2, least(h, greatest(y1, y2) + 3) AS y2
FROM {feat('dash_segments')} WHERE len >= base AND (ac <= 12 OR ac >= 78)""")
def _(t):
    return S.dimension_segments(t.dash_segments)


# ---- profiles -----------------------------------------------------------------------------------
def smooth(k, src="{profiles}"):
    r = P.odd(k) // 2
    return f"(SELECT *, sum(val) OVER (PARTITION BY profile_id ORDER BY pos ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) / {2 * r + 1} AS sm FROM {src})"


def runs(src, on):
    return f"(SELECT profile_id, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT profile_id, pos, pos - row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS isl FROM {src} WHERE {on}) GROUP BY profile_id, isl)"


@query("fill_positions", "SELECT profile_id, pos, val FROM {profiles}")
def _(t):
    lengths = t.profile_counts.select("profile_id").distinct().withColumn("n", F.lit(64))
    return P.fill_positions(t.profile_counts, lengths)


@query("moving_average", f"SELECT profile_id, pos, round(sm, 6) AS smooth FROM {smooth(5)}")
def _(t):
    return _r(P.moving_average(t.profiles, 5), 6, "smooth").drop("val")


@query("find_runs", f"SELECT profile_id, s, e FROM {runs('{profiles}', 'val > 40')} WHERE e - s >= 2")
def _(t):
    return P.find_runs(t.profiles, c("val") > 40, 2)


def closing(src, on, k):
    """Closing as its definition: a position stays off iff some window of ``k`` that holds it is all off."""
    r = k // 2
    return f"""(SELECT p.profile_id, p.pos, NOT EXISTS (SELECT 1 FROM (SELECT d.profile_id, d.pos FROM {src} d WHERE NOT EXISTS (SELECT 1 FROM {src} o WHERE o.profile_id = d.profile_id AND abs(o.pos - d.pos) <= {r} AND o.{on})) q
   WHERE q.profile_id = p.profile_id AND abs(q.pos - p.pos) <= {r}) AS closed FROM {src} p)"""


@query("close_gaps", f"WITH f AS (SELECT *, val > 60 AS flag FROM {{profiles}}) SELECT profile_id, pos, closed FROM {closing('f', 'flag', 7)}")
def _(t):
    return P.close_gaps(t.profiles, c("val") > 60, 6).select("profile_id", "pos", "closed")


def _split(min_len, rel, k, occ):
    low = f"greatest(0.01, {rel} * top)" if occ else f"{rel} * top"
    blank = "true" if occ else f"(top > 0 OR 64 <= {2 * min_len})"
    return f"""WITH s AS (SELECT *, max(sm) OVER (PARTITION BY profile_id) AS top FROM {smooth(k)}),
cuts AS (SELECT * FROM {runs('s', f'top > 0 AND 64 > {2 * min_len} AND sm <= {low}')} WHERE e - s >= 4),
parts AS (SELECT profile_id, a, b, count(*) OVER (PARTITION BY profile_id) AS n FROM (SELECT profile_id, coalesce(lag(e) OVER (PARTITION BY profile_id ORDER BY s), 0) AS a, s AS b FROM cuts
  UNION ALL SELECT profile_id, max(e), 64 FROM cuts GROUP BY profile_id) WHERE b - a >= {min_len})
SELECT profile_id, a, b FROM parts WHERE n >= 2 UNION ALL SELECT DISTINCT profile_id, 0, 64 FROM s WHERE {blank} AND profile_id NOT IN (SELECT profile_id FROM parts WHERE n >= 2)"""


@query("split_by_valleys", _split(6, 0.45, 5, False))
def _(t):
    return P.split_by_valleys(t.profiles, 6, 0.45, 5)


@query("split_by_occupancy", _split(5, 0.30, 3, True))
def _(t):
    return P.split_by_valleys(t.profiles, 5, 0.30, 3, occupancy=True)


@query("valley_cut", f"""WITH s AS (SELECT profile_id, pos, row_number() OVER (PARTITION BY profile_id ORDER BY sm, pos) AS k FROM (SELECT *, sum(val) OVER (PARTITION BY profile_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9 AS sm FROM {{profiles}} WHERE pos < 39) WHERE pos >= 13 AND pos < 35)
SELECT DISTINCT profile_id, ycut FROM (SELECT profile_id, unnest([33, 37, 40, 44, greatest(32, pos)]) AS ycut FROM s WHERE k = 1) WHERE ycut BETWEEN 28 AND 49""")
def _(t):
    return P.valley_cut(t.profiles, 64)


@query("extent_above", """WITH m AS (SELECT *, max(val) OVER (PARTITION BY profile_id) AS top FROM {profiles})
SELECT profile_id, coalesce(greatest(0, min(pos) FILTER (val >= greatest(5, 0.6 * top)) - 2), 0) AS s, coalesce(least(64, max(pos) FILTER (val >= greatest(5, 0.6 * top)) + 3), 64) AS e FROM m GROUP BY profile_id""")
def _(t):
    return P.extent_above(t.profiles, 5.0, relative=0.6, pad=2)


@query("band_spacing_cv", f"""WITH m AS (SELECT *, max(val) OVER (PARTITION BY profile_id) AS top FROM {{profiles}}), b AS (SELECT profile_id, (s + e - 1) / 2.0 AS ctr FROM {runs('m', 'val >= greatest(0.002, top * 0.25)')}),
g AS (SELECT profile_id, ctr - lag(ctr) OVER (PARTITION BY profile_id ORDER BY ctr) AS gap FROM b), s AS (SELECT profile_id, count(*) AS bands, stddev_pop(gap) / avg(gap) AS cv FROM g GROUP BY profile_id)
SELECT p.profile_id, coalesce(bands, 0) AS bands, CASE WHEN bands >= 3 THEN round(cv, 6) END AS spacing_cv FROM (SELECT DISTINCT profile_id FROM {{profiles}}) p LEFT JOIN s USING (profile_id)""")
def _(t):
    return _r(P.band_spacing_cv(t.profiles), 6, "spacing_cv")


@query("active_runs", f"""WITH s AS (SELECT *, max(sm) OVER (PARTITION BY profile_id) AS top FROM {smooth(3)}), f AS (SELECT *, sm >= greatest(4.0, 0.5 * top) AS flag FROM s), k AS (SELECT * FROM {closing('f', 'flag', 5)})
SELECT profile_id, s, e FROM {runs('k', 'closed')} WHERE e - s >= 3""")
def _(t):
    return P.active_runs(t.profiles, 3, 5, 3, rel=0.5)


# ---- profiles of pages of different size --------------------------------------------------------
_SIZED = """(SELECT a.profile_id, a.pos, a.n, a.k, sum(b.val) / a.k AS sm FROM {sized_profiles} a JOIN {sized_profiles} b
  ON a.profile_id = b.profile_id AND abs(a.pos - b.pos) <= a.k // 2 GROUP BY a.profile_id, a.pos, a.n, a.k)"""


@query("moving_average_sized", f"SELECT profile_id, pos, round(sm, 6) AS smooth FROM {_SIZED}")
def _(t):
    return _r(P.moving_average(t.sized_profiles, c("k")), 6, "smooth").select("profile_id", "pos", "smooth")


@query("split_by_valleys_sized", f"""WITH s AS (SELECT *, max(sm) OVER (PARTITION BY profile_id) AS top FROM {_SIZED}),
cuts AS (SELECT profile_id, s, e, n, k FROM (SELECT profile_id, min(pos) AS s, max(pos) + 1 AS e, max(n) AS n, max(k) AS k FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS isl FROM s WHERE top > 0 AND n > 2 * (k + 2) AND sm <= 0.5 * top)
  GROUP BY profile_id, isl) WHERE e - s >= 4),
parts AS (SELECT profile_id, a, b, count(*) OVER (PARTITION BY profile_id) AS m FROM (
  SELECT profile_id, coalesce(lag(e) OVER (PARTITION BY profile_id ORDER BY s), 0) AS a, s AS b, k FROM cuts
  UNION ALL SELECT profile_id, max(e), max(n), max(k) FROM cuts GROUP BY profile_id) WHERE b - a >= k + 2)
SELECT profile_id, a, b FROM parts WHERE m >= 2
UNION ALL SELECT DISTINCT profile_id, 0, n FROM s WHERE (top > 0 OR n <= 2 * (k + 2)) AND profile_id NOT IN (SELECT profile_id FROM parts WHERE m >= 2)""")
def _(t):
    return P.split_by_valleys(t.sized_profiles, c("k") + 2, 0.5, c("k"))


@query("valley_cut_sized", """WITH s AS (SELECT a.profile_id, a.pos, a.n, sum(b.val) / 9 AS sm, floor(a.n * 0.62) AS y0 FROM {sized_profiles} a JOIN {sized_profiles} b
    ON a.profile_id = b.profile_id AND abs(a.pos - b.pos) <= 4 AND b.pos < floor(a.n * 0.62) WHERE a.pos < floor(a.n * 0.62) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY sm, pos) AS k FROM s WHERE pos >= floor(y0 * 0.35) AND pos < floor(y0 * 0.92))
SELECT DISTINCT profile_id, ycut FROM (SELECT profile_id, n, unnest([floor(n * 0.52), floor(n * 0.58), floor(n * 0.64), floor(n * 0.70), greatest(floor(n * 0.50), pos)])::INT AS ycut
  FROM k WHERE k = 1) WHERE ycut BETWEEN floor(n * 0.45) AND floor(n * 0.78)""")
def _(t):
    return P.valley_cut(t.sized_profiles, c("n"))


@query("active_runs_sized", f"""WITH s AS (SELECT *, max(sm) OVER (PARTITION BY profile_id) AS top FROM {_SIZED}),
f AS (SELECT *, sm >= greatest(4.0, 0.5 * top) AS flag FROM s),
k AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM (SELECT d.profile_id, d.pos FROM f d WHERE NOT EXISTS (
    SELECT 1 FROM f o WHERE o.profile_id = d.profile_id AND abs(o.pos - d.pos) <= d.k // 2 AND o.flag)) q
  WHERE q.profile_id = p.profile_id AND abs(q.pos - p.pos) <= p.k // 2) AS closed FROM f p)
SELECT profile_id, s, e FROM (SELECT profile_id, min(pos) AS s, max(pos) + 1 AS e, max(k) AS k FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS isl FROM k WHERE closed) GROUP BY profile_id, isl) WHERE e - s >= k""")
def _(t):
    return P.active_runs(t.sized_profiles, c("k"), c("k"), c("k"), rel=0.5)
