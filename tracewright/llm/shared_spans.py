"""Stretches of fingerprints that stand unchanged in another file (problem 5).

Every stretch of ``length`` successive entries is a seed. Seeds that occur in more than one file
link the files that have them to one representative file each, never all to all. Per file the
linked seeds become unbroken runs, and the runs against one partner are chained in both files'
order with a gap cost, through a Fenwick tree. The spans that stand unchanged are what the runs of
all chains of a file cover. ``pair_passages`` chains every pair of different lists that share a
seed, and aligns what lies between the runs of a chain: the fuzzy passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_parts
from .lexing import windows

#: Entries of a seed.
LENGTH = 30
#: Cost of one skipped entry in either file when two runs are chained.
GAP = 0.1
#: A seed with more than this share of all places is dealt over so many tasks; no more than 1 / HOT seeds are.
HOT, SALTS = 1e-4, 64
#: Places of a seed that one task holds against all others; a seed with more is split over tasks.
TILE = 512


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, whether they are null, and offsets of a list column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _ends(seed: np.ndarray, file: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each distinct seed the smallest and the greatest (file, at), and how many there are."""
    order = np.lexsort((at, file, seed))
    seed, file, at = seed[order], file[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
    first = first[: len(seed)]
    last = np.append(first, len(seed))[1:] - 1
    return [seed[first], file[first], at[first], file[last], at[last], last - first + 1]


def seeds(files: DataFrame, length: int = LENGTH, combined: bool = False) -> DataFrame:
    """seed, file_id, at (index from 0) of every stretch of ``length`` entries; a null entry is like no other.

    ``combined``: seed, lo_file, lo_at, hi_file, hi_at, n of each distinct seed of some 100,000 stretches,
    so that what repeats is counted before it moves.
    """
    names = ["seed", "lo_file", "lo_at", "hi_file", "hi_at", "n"] if combined else ["seed", "file_id", "at"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes, null, borders = _lists(part.column("winnow_hashes"))
            hashes = hashes.astype(np.int64).view(np.uint64)
            nulls = np.concatenate([[0], np.cumsum(null)])
            ids = part.column("file_id").to_numpy(zero_copy_only=False)
            usable = part.column("usable").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            size = 0

            def batch() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in zip(*out)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in (_ends(*columns) if combined else columns)], names)

            for k, file in enumerate(ids):
                lo, hi = borders[k], borders[k + 1]
                n = hi - lo - length + 1
                if n < 1 or not usable[k]:
                    continue
                at = np.flatnonzero(nulls[lo + length : hi + 1] == nulls[lo : hi - length + 1]).astype(np.int32)
                out.append((windows(hashes[lo:hi], length).view(np.int64)[at], np.full(len(at), file), at))
                size += n
                if size > 100_000:
                    yield batch()
                    out, size = [], 0
            if out:
                yield batch()

    usable = F.coalesce(F.size("winnow_hashes") == F.size("winnow_positions"), F.lit(False)).alias("usable")
    return files.where("file_id is not null").select("file_id", "winnow_hashes", usable).mapInArrow(run, "seed bigint, lo_file bigint, lo_at int, hi_file bigint, hi_at int, n bigint" if combined else "seed bigint, file_id bigint, at int")


def links(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """file_id, at, partner, partner_at of every seed shared with another file.

    Of each seed the first place in the smallest file and the last in the greatest represent all:
    files other than the smallest are linked to the former, the smallest to the latter. Counting
    combines before the shuffle. A seed with more than ``HOT`` of all places is dealt over ``SALTS``
    tasks, to each of which its representatives go.
    """
    width = shuffle_parts(files, 3)
    placed = seeds(files, length)
    lo, hi = (F.struct(F.col(f"{x}_file").alias("file_id"), F.col(f"{x}_at").alias("at")) for x in ("lo", "hi"))
    counted = seeds(files, length, combined=True).repartition(width, "seed").groupBy("seed").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.sum("n").alias("n"))
    ends = cut_lineage(counted.where("lo.file_id < hi.file_id"))
    limit = max(1.0, HOT * (ends.agg(F.sum("n")).first()[0] or 0))
    hot = F.broadcast(ends.where(F.col("n") > limit).select("seed", F.lit(True).alias("hot")))  # fewer than 1 / HOT
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("file_id", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = placed.join(hot, "seed", "left").select("seed", salt.alias("salt"), "file_id", "at").repartition(width, "seed", "salt")
    salts = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    partner = F.when(F.col("file_id") == F.col("lo.file_id"), F.col("hi")).otherwise(F.col("lo"))
    found = dealt.join(ends.select("seed", F.explode(salts).alias("salt"), "lo", "hi").repartition(width, "seed", "salt"), ["seed", "salt"])
    return found.select("file_id", "at", partner.alias("p")).select("file_id", "at", F.col("p.file_id").alias("partner"), F.col("p.at").alias("partner_at"))


def _placed(found: DataFrame, files: DataFrame) -> DataFrame:
    """``first_at`` and ``last_at``, indexes from 0, looked up among the positions of their files."""
    positions = files.select("file_id", "winnow_positions").where("file_id is not null").dropDuplicates(["file_id"])
    place = lambda c: F.element_at("winnow_positions", F.col(c) + 1)
    joined = found.join(positions, "file_id").withColumns({"first_pos": place("first_at"), "last_pos": place("last_at")})
    return joined.drop("winnow_positions", "first_at", "last_at")


def runs(partner: np.ndarray, at: np.ndarray, partner_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the unbroken runs: successive in both files, against one partner."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(partner_at) != 1) | (partner[1:] != partner[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


def chain(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, weight: np.ndarray, gap: float) -> np.ndarray:
    """Chain number of each run: collinear, the best-scoring chain first, each run in one chain.

    ``x0..x1`` and ``y0..y1`` are the runs' places in the two files. A predecessor must end before
    the run begins in both; the cost of a link is ``gap`` for every place skipped in either.
    The Fenwick tree holds, by rank of y1, the best score of a run that has ended in x. One pass
    scores all runs; chains are then read back from the best end on, and one that meets a run of a
    better chain ends behind it.
    """
    n = len(x0)
    ranks = np.unique(y1)
    tree = [(-np.inf, -1)] * (len(ranks) + 1)
    score = np.zeros(n)
    before = np.full(n, -1)
    starts, ends = np.argsort(x0, kind="stable"), np.argsort(x1, kind="stable")
    reach, place = np.searchsorted(ranks, y0, side="left"), np.searchsorted(ranks, y1) + 1
    e = 0
    for k in starts:
        while e < n and x1[ends[e]] < x0[k]:
            p, item = place[ends[e]], (score[ends[e]] + gap * (x1[ends[e]] + y1[ends[e]]), int(ends[e]))
            while p <= len(ranks):
                tree[p] = max(tree[p], item)
                p += p & -p
            e += 1
        best, p = (-np.inf, -1), int(reach[k])
        while p:
            best = max(best, tree[p])
            p -= p & -p
        joined = best[0] - gap * (x0[k] + y0[k])
        score[k] = weight[k] + max(0.0, joined)
        before[k] = best[1] if joined > 0 else -1
    number = np.full(n, -1)
    chains = 0
    for k in np.argsort(-score, kind="stable").tolist():
        if number[k] >= 0:
            continue
        while k >= 0 and number[k] < 0:
            number[k] = chains
            k = int(before[k])
        chains += 1
    return number


def _by_file(make, names: list[str], kinds: list[pa.DataType]):
    """Run ``make`` on the rows of each file in partitions sorted by file; a file may span batches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            cols = {c: t.column(c).to_numpy() for c in t.column_names}
            borders = np.flatnonzero(np.concatenate([[True], np.diff(cols["file_id"]) != 0, [True]]))
            out: list[list] = [[] for _ in names]
            for lo, hi in zip(borders[:-1], borders[1:]):
                for row in make({c: v[lo:hi] for c, v in cols.items()}):
                    for column, value in zip(out, row):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        for part in parts:
            if not part.num_rows:
                continue
            held.append(part)
            ids = part.column("file_id").to_numpy()
            if ids[0] == ids[-1] and len(held) > 1 and held[-2].column("file_id")[-1].as_py() == ids[-1]:
                continue
            t = pa.Table.from_batches(held)
            whole = int(np.searchsorted(t.column("file_id").to_numpy(), ids[-1], side="left"))
            if whole:
                yield flush(t.slice(0, whole))
            held = t.slice(whole).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def chained_runs(files: DataFrame, length: int = LENGTH, gap: float = GAP) -> DataFrame:
    """file_id, partner, chain, at, last, partner_at: every run of shared seeds with the chain that it is in.

    Runs are unbroken in both files; ``at`` and ``last`` are the first and last entry. Chains are
    numbered within a file. Linear in the files, as each seed has one partner: see ``pair_passages``.
    """

    def make(c: dict[str, np.ndarray]):
        order = np.lexsort((c["at"], c["partner"]))
        c = {k: v[order] for k, v in c.items()}
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(c["at"]) != 0) | (np.diff(c["partner"]) != 0)
        c = {k: v[once] for k, v in c.items()}
        first, last = runs(c["partner"], c["at"], c["partner_at"])
        chains = 0
        borders = np.flatnonzero(np.concatenate([[True], np.diff(c["partner"][first]) != 0, [True]]))
        for lo, hi in zip(borders[:-1], borders[1:]):
            f, l = first[lo:hi], last[lo:hi]
            number = chain(c["at"][f], c["at"][l], c["partner_at"][f], c["partner_at"][l], (l - f + length).astype(float), gap) if hi - lo > 1 else np.zeros(1, int)
            for a, b, k in zip(f.tolist(), l.tolist(), number.tolist()):
                yield int(c["file_id"][0]), int(c["partner"][a]), chains + k, int(c["at"][a]), int(c["at"][b]) + length - 1, int(c["partner_at"][a])
            chains += int(number.max()) + 1

    names = ["file_id", "partner", "chain", "at", "last", "partner_at"]
    linked = links(files, length).repartition(shuffle_parts(files, 2), "file_id").sortWithinPartitions("file_id", "at").select("file_id", "at", "partner", "partner_at")
    return linked.mapInArrow(_by_file(make, names, [pa.int64(), pa.int64(), *[pa.int32()] * 4]), "file_id bigint, partner bigint, chain int, at int, last int, partner_at int")


def _matches(files: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """a, b, at, partner_at of every seed that two classes share, in all places; file_id, class, copies.

    Files of equal lists are one class, named by its smallest file; a class of several files also
    meets itself. Classes a < b meet once. The places of a hot seed are split into tiles, each of
    which meets all places of the seed.
    """
    usable = files.where("file_id is not null and size(winnow_hashes) = size(winnow_positions)").where(F.size("winnow_hashes") >= length)
    members = cut_lineage(list_classes(files, length))
    heads = members.where("file_id = class")
    same_seed = Window.partitionBy("seed")
    placed = seeds(usable.join(heads.select("file_id"), "file_id", "left_semi"), length)
    shared = placed.withColumns({"lo": F.min("file_id").over(same_seed), "hi": F.max("file_id").over(same_seed), "n": F.count(F.lit(1)).over(same_seed)})
    shared = cut_lineage(shared.where("lo < hi").select("seed", "file_id", "at", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")).distinct())
    left = shared.select("seed", F.pmod(F.xxhash64("file_id", "at"), "tiles").cast("int").alias("tile"), F.col("file_id").alias("a"), "at")
    right = shared.select("seed", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("file_id").alias("b"), F.col("at").alias("partner_at"))
    across = left.join(right, ["seed", "tile"]).where("a < b").select("a", "b", "at", "partner_at")
    own = seeds(usable.join(heads.where("copies > 1").select("file_id"), "file_id", "left_semi"), length).distinct()
    within = own.join(own.withColumnRenamed("at", "partner_at"), ["seed", "file_id"]).select(F.col("file_id").alias("a"), F.col("file_id").alias("b"), "at", "partner_at")
    return across.unionByName(within), members


def _covered(begins: np.ndarray, ends: np.ndarray) -> int:
    """Number of places that the stretches begins..ends (exclusive) cover together."""
    order = np.argsort(begins)
    begins, ends = begins[order], ends[order]
    reached = np.maximum.accumulate(np.concatenate([begins[:1], ends[:-1]]))
    return int(np.maximum(0, ends - np.maximum(begins, reached)).sum())


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Entries that an alignment of two stretches matches at most, in order: bits of one row stand for all of ``x``."""
    if not len(x) or not len(y):
        return 0
    where: dict[int, int] = {}
    for k, v in enumerate(x.tolist()):
        where[v] = where.get(v, 0) | 1 << k
    full = (1 << len(x)) - 1
    row = full
    for v in y.tolist():
        hit = where.get(v, 0) & row
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


def _chained_pairs(length: int, gap: float, names: list[str], kinds: list[pa.DataType]):
    """The chains of each pair with the places of their runs, in partitions sorted by a, b, diagonal, at."""

    def make(c: dict[str, np.ndarray]) -> Iterator[tuple]:
        first, last = runs(c["partner_at"].astype(np.int64) - c["at"], c["at"], c["partner_at"])
        x0, x1, y0, y1 = c["at"][first], c["at"][last], c["partner_at"][first], c["partner_at"][last]
        number = chain(x0, x1, y0, y1, (x1 - x0 + length).astype(float), gap) if len(first) > 1 else np.zeros(1, int)
        order = np.lexsort((x0, number))
        for mine in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            yield int(c["a"][0]), int(c["b"][0]), x0[mine].tolist(), (x1[mine] + length).tolist(), y0[mine].tolist(), (y1[mine] + length).tolist()

    def flush(t: pa.Table) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        borders = np.flatnonzero(np.concatenate([[True], (np.diff(cols["a"]) != 0) | (np.diff(cols["b"]) != 0), [True]]))
        rows = [row for lo, hi in zip(borders[:-1], borders[1:]) for row in make({c: v[lo:hi] for c, v in cols.items()})]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pair = None
        for part in parts:  # a pair is whole only where the next one has begun
            if not part.num_rows:
                continue
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            begun = int(np.argmax((a == a[-1]) & (b == b[-1])))
            if held and (begun or pair != (a[-1], b[-1])):
                yield flush(pa.Table.from_batches([*held, part.slice(0, begun)]))
                held = []
            elif begun:
                yield flush(pa.Table.from_batches([part.slice(0, begun)]))
            held.append(part.slice(begun))
            pair = a[-1], b[-1]
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _aligned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A passage for each side of a chain, with what an alignment between its runs matches besides."""
    names = ["file_id", "partner", "first_at", "last_at", "partner_first", "partner_last", "runs", "exact_entries", "matched_entries"]
    for part in parts:
        rows = []
        h, _, at = _lists(part.column("a_hashes"))
        g, _, bt = _lists(part.column("b_hashes"))
        for k, (a, b, *places) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "b", "x0", "x1", "y0", "y1")))):
            x0, x1, y0, y1 = (np.array(p) for p in places)
            x, y = h[at[k] : at[k + 1]], g[bt[k] : bt[k + 1]]
            between = sum(common(x[x1[i] : x0[i + 1]], y[y1[i] : y0[i + 1]]) for i in range(len(x0) - 1))
            one, two = _covered(x0, x1), _covered(y0, y1)
            rows.append((a, b, int(x0.min()), int(x1.max()) - 1, int(y0.min()), int(y1.max()) - 1, len(x0), one, one + between))
            if a != b:
                rows.append((b, a, int(y0.min()), int(y1.max()) - 1, int(x0.min()), int(x1.max()) - 1, len(x0), two, two + between))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, [pa.int64(), pa.int64(), *[pa.int32()] * 7])], names)


def pair_passages(files: DataFrame, length: int = LENGTH, gap: float = GAP) -> DataFrame:
    """file_id, partner, first_pos, last_pos, partner_first, partner_last, runs, exact_entries, matched_entries, similarity.

    Files of equal lists are one class, named by its smallest file (``list_classes``); file_id and
    partner are classes. One row for each fuzzy passage of a class that a chain shares with another
    one, whichever files share its seeds besides; a class of several files also has its repeats
    within itself, the whole list first. partner_first and partner_last are indexes of the partner's entries; similarity is
    the share of the passage's entries that the runs and the alignment between them match. Rows are
    as many as the pairs of different lists, quadratic in those that share a stretch. Null ids, null
    or short lists and lists of unequal length share nothing; repeated rows count once.
    """
    names = ["a", "b", "x0", "x1", "y0", "y1"]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4]
    matches, _ = _matches(files, length)
    ordered = matches.repartition(shuffle_parts(files, 2), "a", "b").sortWithinPartitions("a", "b", F.col("partner_at") - F.col("at"), "at")
    chained = cut_lineage(ordered.mapInArrow(_chained_pairs(length, gap, names, kinds), "a bigint, b bigint, x0 array<int>, x1 array<int>, y0 array<int>, y1 array<int>"))
    used = cut_lineage(chained.select(F.col("a").alias("file_id")).unionByName(chained.select(F.col("b").alias("file_id"))).distinct())
    lists = files.where("size(winnow_hashes) = size(winnow_positions)").join(used, "file_id", "left_semi").select("file_id", "winnow_hashes").dropDuplicates(["file_id"])
    both = chained.join(lists.select(F.col("file_id").alias("a"), F.col("winnow_hashes").alias("a_hashes")), "a").join(lists.select(F.col("file_id").alias("b"), F.col("winnow_hashes").alias("b_hashes")), "b")
    found = both.mapInArrow(_aligned, "file_id bigint, partner bigint, first_at int, last_at int, partner_first int, partner_last int, runs int, exact_entries int, matched_entries int")
    share = F.round(F.col("matched_entries") / (F.col("last_at") - F.col("first_at") + 1), 6).alias("similarity")
    return _placed(found.select("*", share), files).select("file_id", "partner", "first_pos", "last_pos", "partner_first", "partner_last", "runs", "exact_entries", "matched_entries", "similarity")


def list_classes(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """file_id, class, copies: the smallest file with the same list, and how many have it. Lists without a seed have no row."""
    usable = files.where("file_id is not null and size(winnow_hashes) = size(winnow_positions)").where(F.size("winnow_hashes") >= length)
    identity = usable.select("file_id", F.md5(F.col("winnow_hashes").cast("string")).alias("list")).distinct()
    classes = identity.groupBy("list").agg(F.min("file_id").alias("class"), F.count(F.lit(1)).alias("copies"))
    return identity.join(classes, "list").select("file_id", "class", "copies")


def spans(files: DataFrame, length: int = LENGTH, gap: float = GAP) -> DataFrame:
    """file_id, entries, first_pos, last_pos: the longest unbroken stretches of shared entries.

    They are what the runs of the chains of a file cover: every shared seed is in a run, and every
    run in a chain, so nothing is lost. Rows of one file_id are taken to hold the same content. Null
    lists, lists of unequal length and lists shorter than ``length`` share nothing, a null entry is
    like no other; repeated rows count once; a stretch repeated only within one file is not shared;
    extra columns are ignored.
    """

    def make(c: dict[str, np.ndarray]):
        order = np.argsort(c["at"], kind="stable")
        at, last = c["at"][order], np.maximum.accumulate(c["last"][order])
        begins = np.flatnonzero(np.concatenate([[True], at[1:] > last[:-1] + 1]))
        for first, end in zip(at[begins].tolist(), last[np.append(begins[1:], len(at)) - 1].tolist()):
            yield int(c["file_id"][0]), first, end, end - first + 1

    names, kinds = ["file_id", "first_at", "last_at", "entries"], [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    # The runs of a file follow each other in one partition, so nothing moves in between.
    return _placed(chained_runs(files, length, gap).mapInArrow(_by_file(make, names, kinds), "file_id bigint, first_at int, last_at int, entries int"), files)


def shared_shares(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """file_id, entries, shared_entries, shared_share, longest_run of every file."""
    size = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.coalesce(F.size("winnow_hashes"), F.lit(0))).alias("entries"))
    size = size.withColumn("entries", F.greatest("entries", F.lit(0)))
    own = spans(files, length).groupBy("file_id").agg(F.sum("entries").alias("shared_entries"), F.max("entries").alias("longest_run"))
    shared = F.coalesce("shared_entries", F.lit(0)).cast("bigint")
    return size.join(own, "file_id", "left").select("file_id", "entries", shared.alias("shared_entries"), F.when(F.col("entries") > 0, F.round(shared / F.col("entries"), 6)).otherwise(0.0).alias("shared_share"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))
