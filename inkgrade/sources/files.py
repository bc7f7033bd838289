"""Uploaded drawings as a file listing, and reports as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkgrade.functions.text import LOADER_SUFFIXES, UPLOAD_SUFFIXES, file_suffix


def classify_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds the lower-case suffix, whether an upload or the loader accepts it, and a reason if not."""
    suffix = file_suffix(F.col(path))
    return files.select(
        "*",
        suffix.alias("suffix"),
        suffix.isin(UPLOAD_SUFFIXES).alias("accepted"),
        suffix.isin(LOADER_SUFFIXES).alias("loadable"),
        F.when(suffix == "", "no extension")
        .when(~suffix.isin(UPLOAD_SUFFIXES), "extension not allowed").alias("reason"),
    )


def list_drawings(spark: SparkSession, directory: str) -> DataFrame:
    """Inventory of a directory tree. File contents are never read: the column is pruned."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
        .select("path", "modificationTime", "length")
    )
    return classify_files(files)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes one JSON line per report, in one directory per scoring mode."""
    reports.write.mode(mode).partitionBy("mode").json(path)
