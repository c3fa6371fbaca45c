"""Winnowing, postings and pair metrics on fingerprints and texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import KGRAM, WINDOW, portable_hash, runs_of
from ..session import cut_lineage


def kgrams(tokenised: DataFrame, key: str, k: int = KGRAM) -> DataFrame:
    """key, hashes: the hashes of all k-grams of a column ``tokens``, in order; texts without tokens give none."""
    return tokenised.where(F.size("tokens") > 0).select(key, F.transform(runs_of(F.col("tokens"), k), portable_hash).alias("hashes"))


def hex_values(texts: pa.StringArray) -> np.ndarray:
    """The numbers that texts of 16 hexadecimal digits stand for; they order alike."""
    if not len(texts):
        return np.zeros(0, ">u8")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + 1]
    digits = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[0] + 16 * len(texts)].reshape(-1, 16)
    digits = digits - np.where(digits > 57, 87, 48).astype(np.uint8)
    return np.ascontiguousarray(digits[:, 0::2] << 4 | digits[:, 1::2]).view(">u8").ravel().astype(np.uint64)


def least_of_windows(ranks: np.ndarray, window: int) -> np.ndarray:
    """Places of the least value of each window, the rightmost of equals; of no more values than the window, the leftmost."""
    n = len(ranks)
    if n <= window:
        return np.array([int(np.argmin(ranks))] if n else [], np.int64)
    best = np.arange(n - window + 1)
    for j in range(1, window):
        at = np.arange(j, n - window + 1 + j)
        best = np.where(ranks[at] <= ranks[best], at, best)
    return np.unique(best)


def winnow(grams: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """key, pos, hash of the winnowed k-grams (``kgrams``): the least of each window, the rightmost of equals.

    A text of no more k-grams than the window has one, the leftmost of the least. A text is one row,
    so nothing is moved.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column("hashes")
            values, lengths = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            borders = np.concatenate([[0], np.cumsum(lengths)])
            ranks = hex_values(values)
            places = [least_of_windows(ranks[lo:hi], window) for lo, hi in zip(borders[:-1], borders[1:])]
            rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
            pos = np.concatenate([*places, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(pos, pa.int32()), values.take(pa.array(borders[rows] + pos))], [key, "pos", "hash"])

    return grams.select(key, "hashes").mapInArrow(run, f"{key} {dict(grams.dtypes)[key]}, pos int, hash string")


def one_row_a_file(files: DataFrame) -> DataFrame:
    """The latest indexing of each file; of equal ones the greatest digest."""
    order = Window.partitionBy("file_id").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("sha256").desc_nulls_last())
    return files.where("file_id is not null").withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key of a table whose rows of equal key are copies, moving only the copies.

    The keys are counted first, from their column alone; rows of other keys stay where they are.
    Rows without a key are left out.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select(key)
    repeated = cut_lineage(counted)
    copies = df.join(repeated, key, "left_semi").dropDuplicates([key])
    return df.where(F.col(key).isNotNull()).join(repeated, key, "left_anti").unionByName(copies)


def posting_matches(queries: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, file_id, matched, density: files that share winnow hashes with each query file.

    A posting join: the density is the matched share of the query's distinct hashes. A file doesn't
    match itself.
    """
    q = queries.select(F.col("file_id").alias("query_id"), F.explode(F.array_distinct("winnow_hashes")).alias("hash")).distinct()
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("hashes"))
    # Postings meet the queries' hashes as they are scanned; repeated rows fall out of the hits.
    p = files.select("file_id", F.explode(F.array_distinct("winnow_hashes")).alias("hash"))
    hits = p.join(q, "hash").where("query_id <> file_id").distinct().groupBy("query_id", "file_id").agg(F.count(F.lit(1)).alias("matched"))
    return hits.join(size, "query_id").select("query_id", "file_id", "matched", (F.col("matched") / F.col("hashes")).alias("density"))


def winnow_density(a: Column, b: Column) -> Column:
    """Share of a's distinct hashes that b has; 0 for an empty a."""
    own = F.array_distinct(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(F.lit(0.0))


def longest_run(pairs: DataFrame, key: str, reach: int = 3) -> DataFrame:
    """key, longest_run of pairs (key, hashes, positions, other; hashes are numbers): the most successive shared entries.

    An entry is a hit if the other file has its hash; a hit at most ``reach`` places behind the
    last one goes on with its run, a miss ends it.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, lengths = [], []
            for k, (h, p, o) in enumerate(zip(part.column("h"), part.column("p"), part.column("o"))):
                if h.values is None or p.values is None or o.values is None or not len(h.values) or not len(o.values):
                    continue
                hit = np.isin(h.values.to_numpy(zero_copy_only=False), o.values.to_numpy(zero_copy_only=False))
                pos = p.values.to_numpy(zero_copy_only=False)
                if hit.any():
                    new = ~hit
                    new[1:] |= ~hit[:-1] | (np.diff(pos) > reach)
                    rows.append(k)
                    lengths.append(int(np.bincount(np.cumsum(new)[hit]).max()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64())], [key, "longest_run"])

    schema = T.StructType([pairs.schema[key], T.StructField("longest_run", T.LongType())])
    return pairs.select(key, F.col("hashes").alias("h"), F.col("positions").alias("p"), F.col("other").alias("o")).mapInArrow(run, schema)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group, with their rank; the order must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in a total order."""
    return top_k(df, key, order, 1).drop("rank")
