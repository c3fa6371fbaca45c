"""Pairs and groups of files whose token-shingle similarity reaches a threshold (problem 6).

Every file gets an odd sketch: a bit vector in which each distinct shingle flips one bit. The
exclusive-or of two sketches is the sketch of the symmetric difference, so its bit count never
exceeds the size of that difference, and the bit counts of the two differ by no more than that.
A Jaccard of at least t bounds the difference by (1-t)/(1+t) of the two sizes together, and each
size by 1/t of the other. All sketches are put in order of size and bit count and cut into tiles;
tile pairs whose ranges lie further apart are skipped, the others compared with numpy: folded
to fewer words, which never adds to a distance, and in full where that leaves a pair. No pair is
lost, and what remains is verified exactly. The work is quadratic in the files of like
size; ``banded`` compares only files that share a MinHash band, which is linear but may lose pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .lexing import bands, distinct, minhash, mix, windows
from .shingles import WIDTH, token_lists, verified_pairs
from .source_text import binary_column

#: Least Jaccard of the distinct five-token shingles of whole texts.
SIMILARITY = 0.6
#: Rows of sketches that one task holds for each side of a tile pair (a power of two); rows of the small tiles in it.
BLOCK, TILE = 4096, 64
#: Tiles that are compared with one at once; bits, as a multiple of the largest distance that fits, to which
#: sketches are brought down first (unlike sets mostly differ in more then, and few pairs are left).
WIDE, FIRST = 8, 3.0
#: Words of the sketches of pairs that are counted in full at once.
PAIRS = 1 << 18
#: 42 bands of 3 MinHash values: a pair at 0.6 meets in one with probability 0.99996, at 0.8 with 1 - 3e-14.
ROWS, BANDS = 3, 42


def _radius(similarity: float, a, b):
    return (1 - similarity) / (1 + similarity) * (a + b)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits, as 64-bit words, flipped once by each shingle; at least two bits for each."""
    bits = max(256, 1 << int(max(1, 2 * len(shingles)) - 1).bit_length())
    flips = np.bincount((mix(shingles ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def odd_sketches(shingles: np.ndarray, borders: np.ndarray) -> list[bytes]:
    """The bytes of ``odd_sketch`` of each of the sets between the borders."""
    counts = np.diff(borders)
    bits = np.array([max(256, 1 << (max(1, 2 * n) - 1).bit_length()) for n in counts.tolist()], np.int64)
    to = np.concatenate([[0], np.cumsum(bits)])
    place = (mix(shingles ^ np.uint64(0x5BD1E995)) & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(to[:-1], counts)
    packed = np.packbits((np.bincount(place, minlength=to[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    at = (to // 8).tolist()
    return [packed[lo:hi] for lo, hi in zip(at[:-1], at[1:])]


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Odd sketches (one in a row) brought down to fewer words."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def sketches(files: DataFrame, banded: bool = False) -> DataFrame:
    """file_id, size (distinct shingles), ones (bits set), identity of the set, odd sketch, band keys if they are wanted."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size, ones, one, two, keys, bits = [], [], [], [], [], []
            for tokens in token_lists(binary_column(part, "bytes")):
                s = distinct(windows(tokens, WIDTH))
                with np.errstate(over="ignore"):
                    one.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(s + np.uint64(99)).sum(dtype=np.uint64).view(np.int64)))
                size.append(len(s))
                keys.append(bands(minhash(s, ROWS * BANDS), ROWS).tolist() if banded and len(s) else [])
                sketch = odd_sketch(s)
                ones.append(int(np.bitwise_count(sketch).sum()))
                bits.append(sketch.tobytes())
            arrays = [part.column("file_id"), pa.array(size, pa.int32()), pa.array(ones, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["file_id", "size", "ones", "one", "two", "keys", "sketch"])

    return files.select("file_id", "bytes").where("file_id is not null").mapInArrow(run, "file_id bigint, size int, ones int, one bigint, two bigint, keys array<bigint>, sketch binary")


class Sketches:
    """Sketches of one width, in order of bit count, and the ranges of their tiles."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, table: np.ndarray):
        ones = np.bitwise_count(table).sum(axis=1, dtype=np.int64)
        order = np.lexsort((sizes, ones))
        self.at, self.sizes, self.ones, self.table = at[order], sizes[order], ones[order], np.ascontiguousarray(table[order])
        self.starts = np.arange(0, len(order), TILE)
        self._words: dict[int, np.ndarray] = {}
        if len(order):
            self.least, self.most = (f.reduceat(self.ones, self.starts) for f in (np.minimum, np.maximum))
            self.small, self.large = (f.reduceat(self.sizes, self.starts) for f in (np.minimum, np.maximum))

    def words(self, width: int) -> np.ndarray:
        """The sketches brought down to ``width`` words, one word of all of them in a row."""
        if width not in self._words:
            self._words[width] = np.ascontiguousarray(fold(self.table, width).T)
        return self._words[width]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sketches (a column each) that differ in no more than ``radius`` bits."""
    shape = a.shape[1], b.shape[1]
    distance, few = np.zeros(shape, np.uint16 if 64 * len(a) < 1 << 16 else np.uint32), np.zeros(shape, np.uint8)
    differ, count = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    for k in range(len(a)):
        np.bitwise_xor(a[k][:, None], b[k][None], out=differ)
        np.bitwise_count(differ, out=few if k % 3 == 0 else count)
        if k % 3:
            few += count
        if k % 3 == 2 or k + 1 == len(a):
            distance += few
    return np.divmod(np.flatnonzero(distance <= min(radius, 64 * len(a))), shape[1])


def _by_width(sizes: np.ndarray, bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    words = np.fromiter((len(b) // 8 for b in bits), np.int64, len(bits))
    out = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        out[w] = at, sizes[at], np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), w)
    return out


def compare(sizes_a: np.ndarray, bits_a: list[bytes], sizes_b: np.ndarray, bits_b: list[bytes], similarity: float, own: bool = False) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Index pairs within the radius; then how many tile pairs there were and how many were skipped by their ranges.

    ``own``: both sides are the same rows, and each pair counts once.
    """
    left, right = _by_width(sizes_a, bits_a), _by_width(sizes_b, bits_b)
    found_i, found_j, tiles, skipped = [], [], 0, 0
    eps = 1e-9
    for wa, (at_a, size_a, table_a) in left.items():
        for wb, (at_b, size_b, table_b) in right.items():
            if own and wa > wb:
                continue
            w, same = min(wa, wb), own and wa == wb
            a = Sketches(at_a, size_a, fold(table_a, w))
            b = a if same else Sketches(at_b, size_b, fold(table_b, w))
            for x in range(len(a.starts)):
                apart = np.maximum(0, np.maximum(a.least[x] - b.most, b.least - a.most[x]))
                close = apart <= _radius(similarity, a.large[x], b.large) + eps
                close &= (a.large[x] >= similarity * b.small - eps) & (b.large >= similarity * a.small[x] - eps)
                if same:
                    close[:x] = False
                tiles += len(b.starts) - x * same
                skipped += int((~close).sum()) - x * same
                i = slice(a.starts[x], a.starts[x] + TILE)
                met = np.flatnonzero(close)
                for run in np.split(met, np.flatnonzero(np.diff(met) != 1) + 1):
                    for y in range(0, len(run), WIDE):
                        j = slice(b.starts[run[y]], b.starts[run[y : y + WIDE][-1]] + TILE)
                        radius = int(_radius(similarity, a.large[x], b.large[run[y : y + WIDE]].max()) + eps)
                        first = next((v for v in (w >> k for k in range(w.bit_length(), 0, -1)) if v >= 4 and 64 * v >= FIRST * radius), w)
                        p, q = _near(a.words(first)[:, i], b.words(first)[:, j], radius)
                        p, q = p + i.start, q + j.start
                        if same:
                            p, q = p[p < q], q[p < q]
                        step = max(1, PAIRS // w)
                        for lo in range(0, len(p), step):
                            r, s = p[lo : lo + step], q[lo : lo + step]
                            sp, sq = a.sizes[r], b.sizes[s]
                            fit = np.bitwise_count(a.table[r] ^ b.table[s]).sum(axis=1, dtype=np.int64) <= np.floor(_radius(similarity, sp, sq) + eps)
                            fit &= np.minimum(sp, sq) >= similarity * np.maximum(sp, sq) - eps
                            found_i.append(a.at[r[fit]])
                            found_j.append(b.at[s[fit]])
    none = np.zeros(0, np.int64)
    return np.concatenate([*found_i, none]), np.concatenate([*found_j, none]), tiles, skipped


def _compare_blocks(similarity: float):
    """Candidate pairs of each pair of blocks, whose rows are successive in a partition."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pair = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            side, ids, sizes, bits = t.column("side").to_numpy(), t.column("file_id").to_numpy(), t.column("size").to_numpy().astype(np.int64), t.column("sketch").to_pylist()
            left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
            i, j, _, _ = compare(sizes[left], [bits[k] for k in left], sizes[right], [bits[k] for k in right], similarity, own=bool((side == 0).any()))
            a, b = ids[left[i]], ids[right[j]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for part in parts:
            numbers = part.column("pair").to_numpy()
            borders = np.flatnonzero(np.concatenate([[True], np.diff(numbers) != 0, [True]])) if len(numbers) else []
            for lo, hi in zip(borders[:-1], borders[1:]):
                if held and pair != numbers[lo]:
                    yield flush()
                    held.clear()
                pair = numbers[lo]
                held.append(part.slice(lo, hi - lo))
        if held:
            yield flush()

    return run


def candidate_pairs(sk: DataFrame, similarity: float = SIMILARITY, banded: bool = False) -> DataFrame:
    """Pairs a < b of rows of ``sketches`` within the radius: all of them, or those that share a band.

    Rows in order of size and bit count are cut into blocks. Block pairs whose sizes lie further
    apart than the similarity allows are skipped; so are, in the others, the rows that fit no row
    of the other side, before anything moves.
    """
    group = F.explode("keys").alias("group") if banded else F.lit(0).cast("bigint").alias("group")
    rows = sk.where("size > 0").select(group, "size", "ones", "file_id", "sketch")
    count = rows.count() if not banded else sk.count() * BANDS
    order = ["group", "size", "ones", "file_id"]
    ranged = rows.repartitionByRange(-(-count // BLOCK) or 1, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)))
    heads = placed.groupBy("group", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count(F.lit(1)).alias("n"))
    level = lambda c: F.floor(F.log(c) / F.lit(-np.log(similarity)) + 1e-9).cast("int")
    a = heads.select("group", F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "n", F.explode(F.sequence(level(F.col("lo")), level(F.col("hi")))).alias("level"))
    b = heads.select("group", F.col("block").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.explode(F.sequence(level(F.col("lo")) - 2, level(F.col("hi")))).alias("level"))
    met = a.join(b, ["group", "level"]).where("a < b or a = b and n > 1").where(F.col("a_hi") >= F.lit(similarity) * F.col("b_lo") - 1e-9)
    pairs = cut_lineage(met.drop("level", "n").distinct().withColumn("pair", F.monotonically_increasing_id()))
    fits = (F.col("size") >= F.lit(similarity) * F.col("other_lo") - 1e-9) & (F.col("other_hi") >= F.lit(similarity) * F.col("size") - 1e-9)
    left = pairs.select("group", F.col("a").alias("block"), F.col("b_lo").alias("other_lo"), F.col("b_hi").alias("other_hi"), "pair", F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side"))
    right = pairs.where("a <> b").select("group", F.col("b").alias("block"), F.col("a_lo").alias("other_lo"), F.col("a_hi").alias("other_hi"), "pair", F.lit(2).alias("side"))
    moved = placed.join(left.unionByName(right), ["group", "block"]).where(fits).select("pair", "side", "file_id", "size", "sketch")
    ordered = moved.repartition(max(2 * sk.sparkSession.sparkContext.defaultParallelism, count // BLOCK), "pair").sortWithinPartitions("pair", "side")
    found = ordered.mapInArrow(_compare_blocks(similarity), "a bigint, b bigint")
    return found.distinct() if banded else found


def near_duplicates(index: DataFrame, files: DataFrame, similarity: float = SIMILARITY, banded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Class pairs (a, b, jaccard) between representatives, and membership (file_id, class).

    ``index`` tells by file_id which of ``files`` count. Files with the same shingle set are one
    class, named by its smallest file_id; files without tokens are in no class, as is a null id.
    Repeated rows count once and extra columns are ignored.
    """
    wanted = index.select("file_id").distinct()
    sk = cut_lineage(sketches(files, banded).dropDuplicates(["file_id"]).join(wanted, "file_id", "left_semi").where("size > 0"))
    classes = sk.groupBy("size", "one", "two").agg(F.min("file_id").alias("class"))
    membership = sk.join(classes, ["size", "one", "two"]).select("file_id", "class")
    heads = sk.join(classes.select(F.col("class").alias("file_id")), "file_id", "left_semi")
    pairs = cut_lineage(candidate_pairs(heads, similarity, banded))
    return verified_pairs(pairs, files, similarity), membership


def similar_files(index: DataFrame, files: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """file_id_a < file_id_b of all pairs of different files that reach the similarity.

    A file like itself only is in no pair, nor is one without tokens or with null content; of texts
    shorter than a shingle only equal ones are alike. Repeated rows give a pair once, empty tables none.
    """
    links, membership = near_duplicates(index, files, similarity)
    membership = cut_lineage(membership)
    crowded = membership.groupBy("class").count().where("count > 1").select("class")
    same = membership.join(crowded, "class", "left_semi").select(F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    a = membership.select(F.col("class").alias("a"), F.col("file_id").alias("x"))
    b = membership.select(F.col("class").alias("b"), F.col("file_id").alias("y"))
    met = links.select("a", "b").unionByName(same).join(a, "a").join(b, "b").where("a <> b or x < y")
    return met.select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b"))


def similar_groups(index: DataFrame, files: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """file_id, class, group_id: files linked directly or through others, one row for each file.

    ``class`` is the smallest file with the same shingles, ``group_id`` the smallest file of the group;
    a file like no other is its own group.
    """
    links, membership = near_duplicates(index, files, similarity)
    reached = components(links.select("a", "b")).select(F.col("node").alias("class"), F.col("component").alias("group_id"))
    return membership.join(reached, "class", "left").select("file_id", "class", F.coalesce("group_id", "class").alias("group_id"))
