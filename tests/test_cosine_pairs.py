"""Both roles of a drawing are compared from one histogram, without scanning the segments twice."""

from pyspark.sql import functions as F

import inkgrade.plans.all  # noqa: F401
from inkgrade.functions.angles import cosine_sim
from inkgrade.operators import segments as S
from inkgrade.plans import catalog

c = F.col


def test_roles_meet_in_one_grouping(spark, tmp_path):
    lines = [(o, p, s, n, float(q)) for o in range(1, 40) for n, (p, s, q) in enumerate(
        [(o * 17 + k * 31, o * 7 + k, 1 + (o * k) % 50) for k in range(o % 8)], 1)]
    lines += lines[:20] + [(None, 5, 6, 1, 3.0), (7, None, 6, 2, 3.0), (99, 1, 2, 3, 4.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(o, o * 13) for o in range(1, 45)] + [(3, 8), (None, 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = catalog.QUERIES["cosine_sim"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and len([x for x in plan.splitlines() if "Relation" in x and "l_orderkey" in x]) == 1
    h = S.angle_hist(catalog.Tables(spark, str(tmp_path)).segments, keys=["drawing_id", "role"])
    side = lambda role, name: {r.drawing_id: r[name] for r in h.filter(c("role") == role).select("drawing_id", c("hist").alias(name)).collect()}
    a, b = side("front", "a"), side("top", "b")
    both = [(k, a[k], b[k]) for k in sorted(a.keys() & b.keys())]
    assert len(both) > 5 and len(both) < len(a.keys() | b.keys())
    want = spark.createDataFrame(both, "drawing_id long, a array<double>, b array<double>").select("drawing_id", F.round(cosine_sim(c("a"), c("b")), 6).alias("similarity"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
