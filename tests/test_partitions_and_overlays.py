"""Shuffle partitions follow the size of the tables; overlays shuffle runs once, before they are widened."""

import pytest
from pyspark.sql import functions as F

from inkgrade.operators import cells as M
from inkgrade.plans import catalog


@pytest.fixture
def settings(spark):
    names = [catalog.SHUFFLE_PARTITIONS, *catalog.PIECES]
    before = {n: spark.conf.get(n) for n in names}
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_partitions_grow_with_the_tables(spark, tmp_path, settings, monkeypatch):
    spark.conf.set(catalog.SHUFFLE_PARTITIONS, "4")
    spark.range(1000).selectExpr("id AS o_orderkey", "uuid() AS o_comment").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(catalog, "BYTES_PER_PARTITION", 1 << 20)
    assert catalog.Tables(spark, str(tmp_path)).orders.count() == 1000
    assert spark.conf.get(catalog.SHUFFLE_PARTITIONS) == "4"  # small tables leave it alone
    monkeypatch.setattr(catalog, "BYTES_PER_PARTITION", 1 << 10)
    t = catalog.Tables(spark, str(tmp_path))
    assert t.orders.count() == 1000 and t.orders.count() == 1000
    raised = int(spark.conf.get(catalog.SHUFFLE_PARTITIONS))
    assert raised > 30
    assert catalog.Tables(spark, str(tmp_path)).customer.count() == 10
    assert int(spark.conf.get(catalog.SHUFFLE_PARTITIONS)) == raised


def test_joined_partitions_stay_small(spark, tmp_path, settings):
    """About 6 MB of shuffled rows: at most 2 MB of them meet in a task, however few tasks would do."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    for name, (default, _) in catalog.PIECES.items():
        spark.conf.set(name, default)
    spark.conf.set(catalog.SHUFFLE_PARTITIONS, "40")
    try:
        spark.range(150000).selectExpr("id AS o_orderkey", "uuid() AS o_comment").write.parquet(f"{tmp_path}/orders.parquet")
        orders = catalog.Tables(spark, str(tmp_path)).orders
        parts = orders.groupBy("o_orderkey").agg(F.max("o_comment").alias("o_comment")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", before)
    assert 3 <= parts < 40


def test_partitions_suit_a_task(spark, tmp_path, settings):
    """A shuffle partition for every MB of the tables read."""
    spark.conf.set(catalog.SHUFFLE_PARTITIONS, "1")
    spark.range(150000).selectExpr("id AS o_orderkey", "uuid() AS o_comment").coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/orders.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "orders.parquet").glob("*.parquet"))
    assert catalog.Tables(spark, str(tmp_path)).orders.count() == 150000
    assert int(spark.conf.get(catalog.SHUFFLE_PARTITIONS)) == -(-size // (1 << 20)) > 4


def test_a_band_never_leaves_the_task_of_its_mask(spark):
    runs = spark.createDataFrame([(1, 0, 2, 4), (1, 5, 0, 9), (2, 3, 3, 4)], "mask_id long, y int, s int, e int")
    dims = spark.createDataFrame([(1, 6, 9), (2, 5, 5)], "mask_id long, h int, w int")
    tagged = M._spread(runs, "a", 2).unionByName(M._spread(runs, "b"))
    out = M.overlay_runs(dims, tagged, ["a", "b", "a_band"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(mask_id" in plan
    assert not any("hashpartitioning(mask_id" in x and ", y" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines())
    band = {(r.mask_id, r.y, x) for r in out.filter("a_band").collect() for x in range(r.s, r.e)}
    want = {(m, y, x) for m, h, w, r, s, e in ((1, 6, 9, 0, 2, 4), (1, 6, 9, 5, 0, 9), (2, 5, 5, 3, 3, 4))
            for y in range(max(0, r - 2), min(h, r + 3)) for x in range(max(0, s - 2), min(w, e + 2))}
    assert band == want


def test_runs_off_the_page_reach_onto_it(spark):
    runs = spark.createDataFrame([(1, -1, 0, 2), (1, -9, 0, 2), (1, 7, 1, 2)], "mask_id long, y int, s int, e int")
    dims = spark.createDataFrame([(1, 6, 4)], "mask_id long, h int, w int")
    out = M.overlay_runs(dims, M._spread(runs, "a", 2), ["a", "a_band"]).filter("a_band").collect()
    assert {(r.y, x) for r in out for x in range(r.s, r.e)} == {(0, x) for x in range(4)} | {(1, x) for x in range(4)} | {(5, x) for x in range(4)}
