"""Incremental index upkeep on plain tables, without a merge statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("project", "relpath")


def changes(index: DataFrame, scan: DataFrame) -> DataFrame:
    """project, relpath, change: 'insert', 'update' or 'keep' of every scanned file, by content digest."""
    old = index.select(*KEY, F.col("sha256").alias("old")).dropDuplicates([*KEY])
    joined = scan.select(*KEY, "sha256").join(old, [*KEY], "left")
    return joined.select(*KEY, F.when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("sha256"), "keep").otherwise("update").alias("change"))


def upserted(index: DataFrame, scan: DataFrame) -> DataFrame:
    """The index after the scan: scanned rows replace those of the same key, the others stay."""
    return index.join(scan.select(*KEY), [*KEY], "left_anti").unionByName(scan, allowMissingColumns=True)


def write_index(index: DataFrame, path: str, buckets: int = 0) -> None:
    """Rebuild the stored index at ``path``, clustered by project."""
    out = index.repartition(buckets, "project") if buckets else index.repartition("project")
    out.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)
