"""The file index kept up to date from a stream of scanned files. Beyond what a batch scan offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import KEY, upserted

SCAN = "project string, relpath string, bytes binary, size bigint"
INDEX = "project string, relpath string, size bigint, sha256 string"


def index_rows(scan: DataFrame) -> DataFrame:
    """Index rows of scanned files; of several versions of a file in one batch the greatest digest stays."""
    rows = scan.where("project is not null and relpath is not null and bytes is not null").select(*KEY, "size", F.sha2("bytes", 256).alias("sha256"))
    return rows.groupBy(*KEY).agg(F.max(F.struct("sha256", "size")).alias("r")).select(*KEY, "r.size", "r.sha256")


def follow(spark: SparkSession, folder: str, index: str, checkpoint: str) -> StreamingQuery:
    """Apply every new batch of scanned files in ``folder`` to the table at ``index``.

    Versions of the table are written to new folders, index/v=<batch>; a batch that is replayed after
    a failure writes the same folder again, so the result is exactly once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = session.createDataFrame([], INDEX) if number == 0 else session.read.schema(INDEX).parquet(f"{index}/v={number - 1}")
        upserted(old, index_rows(batch)).select("project", "relpath", "size", "sha256").write.mode("overwrite").parquet(f"{index}/v={number}")

    stream = spark.readStream.schema(SCAN).parquet(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_arrivals(stream: DataFrame, time: str, key: str, delay: str = "2 days") -> DataFrame:
    """Records by day and key of an unbounded stream; later ones than ``delay`` are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), key).agg(F.count(F.lit(1)).alias("records"))
