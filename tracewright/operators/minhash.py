"""MinHash signatures of k-gram hashes, and the band table that candidates are looked up in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .similarity import hex_values

PERMUTATIONS, ROWS = 128, 2
#: Permutation i of a 31-bit value x is (x * a + b) modulo the prime 2**31 - 1.
PRIME = (1 << 31) - 1
FACTORS = tuple((i * 1_103_515_245 + 12_345) % PRIME for i in range(1, PERMUTATIONS + 1))
OFFSETS = tuple((i * 69_069 + 1) % PRIME for i in range(1, PERMUTATIONS + 1))


def signatures(grams: DataFrame, key: str) -> DataFrame:
    """key, signature of ``kgrams``: the least value of all k-grams, not only the winnowed, under each permutation.

    The last 31 bits of a hash are permuted. A text is one row, so nothing is moved; one without k-grams has none.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.array(FACTORS, np.int64)[:, None], np.array(OFFSETS, np.int64)[:, None]
        for part in parts:
            column = part.column("hashes")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x = (hex_values(column.flatten()) & np.uint64(PRIME)).astype(np.int64)
            borders = np.concatenate([[0], np.cumsum(lengths)])
            least = [((np.unique(x[lo:hi])[None] * a + b) % PRIME).min(axis=1).tolist() for lo, hi in zip(borders[:-1], borders[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(least, pa.list_(pa.int64()))], [key, "signature"])

    some = grams.where(F.size("hashes") > 0).select(key, "hashes")
    return some.mapInArrow(run, f"{key} {dict(grams.dtypes)[key]}, signature array<bigint>")


def bands(signed: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """band, value, key: one row for each band of successive signature values."""
    count = PERMUTATIONS // rows
    value = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.array_join(F.slice("signature", b * rows + 1, rows), "-"))
    return signed.select(key, F.posexplode(value).alias("band", "value")).select("band", "value", key)


def write_bands(table: DataFrame, path: str, buckets: int = 0) -> None:
    """Store a band table, clustered by band value so that a lookup reads few files."""
    placed = table.repartition(buckets, "band", "value") if buckets else table.repartition("band", "value")
    placed.sortWithinPartitions("band", "value").write.mode("overwrite").parquet(path)


def read_bands(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A stored band table."""
    return spark.read.schema(f"band int, value string, {key} bigint").parquet(path)
