"""Shingle sets of source files and exact verification of candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lexing import distinct_each, tokenize, windows_each
from .source_text import batches, binary_column, opening_comment, suffix

WIDTH = 5
#: Files whose sets one task holds while it verifies pairs.
CELL = 256
#: Partners in a cell from which a file meets them all at once, through an index of the cell's shingles.
FEW = 6
#: Values (columns) of a 0/1 matrix, and how much cheaper a place in a matrix product is than a pair of postings.
PIECE, DENSE_GAIN = 1024, 200
#: Pairs of sets up to which each is intersected by itself; files and shingles that ask a cell at once.
PAIRS, ASKING, LOAD = 48, 1024, 1 << 20


def token_lists(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Token hashes of each text, in order."""
    for group in batches(texts):
        tokens, _, _ = tokenize(group)
        borders = tokens.split(len(group))
        for i in range(len(group)):
            yield tokens.hash[borders[i] : borders[i + 1]]


def set_lists(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct token shingles of each text, for some texts at a time one after the other, and their borders."""
    for group in batches(texts):
        tokens, _, _ = tokenize(group)
        yield distinct_each(*windows_each(tokens.hash, tokens.split(len(group)), width))


def body(data: bytes, relpath: str) -> bytes:
    """A source file without its opening comment."""
    return data[opening_comment(data, suffix(relpath or ""))[1] :]


def shingle_sets(files: DataFrame, width: int = WIDTH, bodies: bool = False) -> DataFrame:
    """file_id and the distinct token shingles of each file as an array of 64-bit hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = binary_column(part, "bytes")
            if bodies:
                texts = [body(t, p) for t, p in zip(texts, part.column("relpath").to_pylist())]
            sets = list(set_lists(texts, width))
            lengths = np.cumsum(np.concatenate([[0], *(np.diff(b) for _, b in sets)])).astype(np.int32)
            values = pa.array(np.concatenate([v for v, _ in sets]).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("file_id"), pa.ListArray.from_arrays(lengths, values)], ["file_id", "shingles"])

    return files.select("file_id", "relpath", "bytes").mapInArrow(run, "file_id bigint, shingles array<bigint>")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Number of values that two sorted arrays without repeats share."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return 0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _overlaps(own: np.ndarray, index: tuple[np.ndarray, np.ndarray], held: int) -> np.ndarray:
    """How many values of a set each of the ``held`` sets has, by their sorted values and whose these are."""
    values, owner = index
    first = np.searchsorted(values, own)
    count = np.searchsorted(values, own, side="right") - first
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.bincount(owner[at], minlength=held)


def common_counts(asked: list[np.ndarray], held: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets on one side (rows) shares with each on the other (columns).

    Values that many sets on both sides have are counted by products of 0/1 matrices, the others by
    postings; both in pieces, so that memory stays within a few times that of the sets.
    """
    m, n = len(asked), len(held)
    if m * n <= PAIRS:
        return np.array([[_shared(a, b) for b in held] for a in asked], np.int64).reshape(m, n)
    common = np.zeros((m, n), np.int64)
    sides = [(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets])) for sets in (asked, held)]
    values, code = np.unique(sides[1][0], return_inverse=True)
    if not len(values) or not len(sides[0][0]):
        return common
    # Sets that are held as well need no search.
    ends = np.cumsum([len(s) for s in held]).tolist()
    own = {id(s): code[end - len(s) : end] for s, end in zip(held, ends)}
    places = [own[id(s)] if id(s) in own else np.where(values[i := np.minimum(np.searchsorted(values, s), len(values) - 1)] == s, i, -1) for s in asked]
    at = np.concatenate(places)
    known = at >= 0
    at, asker, owner = at[known], sides[0][1][known], sides[1][1]
    here, there = np.bincount(at, minlength=len(values)), np.bincount(code, minlength=len(values))
    dense = here * there * DENSE_GAIN > m * n
    columns = np.where(dense, np.cumsum(dense) - 1, -1)
    x, y = columns[at], columns[code]
    width = int(dense.sum())
    for lo in range(0, width, PIECE):
        matrices = []
        for c, row, size in ((x, asker, m), (y, owner, n)):
            inside = (c >= lo) & (c < lo + PIECE)
            matrix = np.zeros((size, min(PIECE, width - lo)), np.float32)
            matrix[row[inside], c[inside] - lo] = 1
            matrices.append(matrix)
        common += (matrices[0] @ matrices[1].T).astype(np.int64)  # no sum exceeds PIECE, so none is rounded
    rare = y < 0
    owner, first = owner[rare][np.argsort(code[rare], kind="stable")], np.cumsum(there * ~dense) - there
    at, asker = at[x < 0], asker[x < 0]
    ends = np.cumsum(there[at])
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, LOAD))
    for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
        count = there[at[lo:hi]]
        place = np.repeat(first[at[lo:hi]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        common += np.bincount(np.repeat(asker[lo:hi], count) * n + owner[place], minlength=m * n).reshape(m, n)
    return common


def _verify(least: float, below: float):
    """Compare each row of kind 1 with the sets of kind 0 that its cell began with."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, index = None, {}, None
        for part in parts:
            values = part.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            borders = np.concatenate([[0], np.cumsum(part.column("shingles").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            rows = zip(part.column("cell").to_pylist(), part.column("kind").to_pylist(), part.column("file_id").to_pylist(), part.column("others"))
            for k, (where, kind, file, others) in enumerate(rows):
                own = values[borders[k] : borders[k + 1]]
                if where != cell:
                    cell, sets, index = where, {}, None
                if kind == 0:
                    sets[file] = own.copy()
                    continue
                asked = others.values.to_numpy(zero_copy_only=False)
                if len(asked) < FEW:
                    asked = np.array([x for x in asked.tolist() if x in sets], np.int64)
                    sizes = np.array([len(sets[x]) for x in asked.tolist()], np.int64)
                    common = np.array([_shared(own, sets[x]) for x in asked.tolist()], np.int64)
                elif sets:
                    if index is None:
                        ids = np.array(sorted(sets), np.int64)
                        held = np.array([len(sets[x]) for x in ids.tolist()], np.int64)
                        flat = np.concatenate([sets[x] for x in ids.tolist()])
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], np.repeat(np.arange(len(ids)), held)[order]
                    at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
                    known = ids[at] == asked
                    asked, at = asked[known], at[known]
                    sizes, common = held[at], _overlaps(own, index, len(ids))[at]
                else:
                    continue
                union = len(own) + sizes - common
                jaccard = common / np.maximum(union, 1)
                fits = (jaccard >= least) & (jaccard < below)
                out.append((np.full(int(fits.sum()), file, np.int64), asked[fits], jaccard[fits]))
            columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "jaccard"])

    return run


def _verify_dense(least: float, below: float):
    """What ``_verify`` does, for cells most of whose sets are asked for by many: all that ask are counted together."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asking, load = None, {}, [], 0

        def flush() -> pa.RecordBatch:
            ids = np.array(sorted(held), np.int64)
            sets = [held[x] for x in ids.tolist()]
            row, asked = np.repeat(np.arange(len(asking)), [len(o) for _, o, _ in asking]), np.concatenate([o for _, o, _ in asking])
            at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
            known = ids[at] == asked
            row, asked, at = row[known], asked[known], at[known]
            common = common_counts([s for _, _, s in asking], sets)[row, at]
            union = np.array([len(s) for _, _, s in asking], np.int64)[row] + np.array([len(s) for s in sets], np.int64)[at] - common
            jaccard = common / np.maximum(union, 1)
            fits = (jaccard >= least) & (jaccard < below)
            return pa.RecordBatch.from_arrays([pa.array(c[fits]) for c in (np.array([f for f, _, _ in asking], np.int64)[row], asked, jaccard)], ["a", "b", "jaccard"])

        for part in parts:
            lists = []
            for name in ("shingles", "others"):
                column = part.column(name)
                values = column.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                lists.append(np.split(values, ends[:-1]) if len(ends) else [])
            for where, kind, file, own, others in zip(part.column("cell").to_pylist(), part.column("kind").to_pylist(), part.column("file_id").to_pylist(), *lists):
                if asking and (where != cell or len(asking) >= ASKING or load >= LOAD):
                    if held:
                        yield flush()
                    asking, load = [], 0
                if where != cell:
                    cell, held = where, {}
                if kind == 0:
                    held[file] = own.view(np.uint64).copy()
                else:
                    asking.append((file, others.copy(), own.view(np.uint64).copy()))
                    load += len(own)
        if asking and held:
            yield flush()

    return run


def verified_pairs(pairs: DataFrame, files: DataFrame, least: float, bodies: bool = False) -> DataFrame:
    """Those of the distinct pairs (a, b) whose shingle Jaccard is at least ``least``, with the value.

    Only files that occur in a pair are tokenised. A file without shingles is like none.
    """
    members = cut_lineage(pairs.select(F.col("a").alias("file_id")).unionByName(pairs.select(F.col("b").alias("file_id"))).distinct())
    sets = shingle_sets(files.join(members, "file_id", "left_semi"), bodies=bodies).dropDuplicates(["file_id"])
    cells = cell_count(members.count())
    hold = sets.join(pairs.select(F.col("b").alias("file_id")).distinct(), "file_id", "left_semi").withColumn("cell", cell_of("file_id", cells))
    partners = pairs.select("a", "b", cell_of("b", cells)).groupBy("a", "cell").agg(F.collect_list("b").alias("others"))  # no more than a cell has
    return compared(hold, partners, sets, cells, least)


def cell_count(members: int) -> int:
    """Cells for so many files."""
    return max(1, -(-members // CELL))


def cell_of(file: str, cells: int) -> Column:
    """The cell of a file, if any will do."""
    return F.pmod(F.xxhash64(file), F.lit(cells)).alias("cell")


def compared(hold: DataFrame, partners: DataFrame, sets: DataFrame, cells: int, least: float, below: float = 2.0, dense: bool = False) -> DataFrame:
    """a, b, jaccard of the pairs of each a and its others that lies between ``least`` and ``below``.

    Every held file has a cell, one of about so many ``cells``, to which its set goes once; the set of
    an a goes once to each cell that it has partners in (a, cell, others), however many. So a dense
    group moves its sets a few times, not once for each pair, and no task holds more than one cell.
    ``dense``: most sets of a cell are asked for by many.
    """
    ask = partners.select(F.col("a").alias("file_id"), "cell", "others").join(sets, "file_id").select("cell", F.lit(1).alias("kind"), "file_id", "others", "shingles")
    held = hold.select("cell", F.lit(0).alias("kind"), "file_id", F.lit(None).cast("array<bigint>").alias("others"), "shingles")
    width = max(sets.sparkSession.sparkContext.defaultParallelism, min(4 * cells, 20_000))  # a task has a cell or two, however many there are
    placed = held.unionByName(ask).repartition(width, "cell").sortWithinPartitions("cell", "kind")
    return placed.mapInArrow((_verify_dense if dense else _verify)(least, below), "a bigint, b bigint, jaccard double")
