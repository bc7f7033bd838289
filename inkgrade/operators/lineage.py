"""Safe points for iterative jobs, and the choice between a small-group and a spread-out path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster the setting is required,
    because a folder on one machine is lost with it.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="inkgrade-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably, so that iterations neither grow the plan nor depend on executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """``df``, which has been grouped by ``key``, written once to the shared folder in buckets of it.

    Columnar files are a fraction of a checkpoint's size, and joins and groupings by ``key`` read the buckets where they
    are: only their other side is shuffled.
    """
    spark, name = df.sparkSession, f"inkgrade_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def by_group_size(df: DataFrame, keys: list[str], limit: int, small, large) -> DataFrame:
    """Apply ``small`` to groups of at most ``limit`` rows and ``large`` to the others.

    ``small`` may gather a group into one row; ``large`` must keep it spread out. The counts are
    pre-aggregated before the shuffle and only the keys above the limit are kept. When none is,
    ``large`` is not planned at all.
    """
    big = cut_lineage(df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys))
    if big.isEmpty():
        return small(df)
    return small(df.join(big, keys, "left_anti")).unionByName(large(df.join(big, keys, "left_semi")))
