"""Source files that nobody of the project wrote by hand (problem 1).

Tokens are masked: identifiers, numbers and strings each become one symbol. Files whose masked
shingle sets agree while their unmasked ones don't (odd sketches of all, then exact verification)
form a family: one skeleton filled in with other names. Three of one repository make a family of
any measures generated; smaller families are generated, minified or, if they hold literals only,
blobs when their members on average look it, and a file that is alone only when its own records
are family enough. Variants of one text, alike with their names, form none.
Files of different projects that meet in a band of masked and unmasked MinHash values, and whose
unmasked shingles then agree, are a vendored copy and its home.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators.similarity import once
from ..session import cut_lineage
from .lexing import DIGIT, LETTER, bands, distinct_each, minhash_each, mix, sorted_each, sums_each, token_hash, tokenize, windows_each
from .near_duplicates import candidate_pairs, odd_sketches
from .shingles import WIDTH, body, cell_count, cell_of, common_counts, compared, set_lists, verified_pairs
from .source_text import LICENSE_FILE_NAMES, batches, binary_column, comment_text, opening_comment, suffix

# Words that masking leaves as they are.
KEYWORDS = (
    "if else elif for while do switch case break default return goto int long unsigned short char const static void "
    "struct class enum union def in with as import from not and or assert lambda pass raise try except let var function "
    "export throw new type real integer subroutine end call module use contains allocate where any select write then"
).split()
# Folders that hold other projects' files.
VENDOR_FOLDERS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "extern", "external", "externals", "deps")

#: Least masked similarity of a family's members with its head (five tokens, 0.8 by the rule for such stages).
FAMILY = 0.8
#: Least unmasked similarity, opening comments left out, of a copy and its home.
COPY = 0.65
#: Unmasked similarity from which files are variants of one text, not members of a family.
UNLIKE = 0.3
#: Members of a family in one repository that make it generated, whatever its measures are.
WITHIN = 3
#: Share of 24-token masked stretches that occur again in the file, and share of visible characters in
#: literals, from which a family on average is generated or a blob, and from which a file alone is.
FAMILY_REPEAT, REPEAT = 0.5, 0.6
FAMILY_LITERAL, LITERAL = 0.55, 0.6
#: Mean identifier length up to which, and share of white space below which, a file is minified.
SHORT_NAME, DENSE = 3.5, 0.08
STRETCH = 24
MEASURES = ("repeat", "literal", "name_length", "space")
COPY_BANDS = 24
#: Files of one family, or nearly so, and shingles of their texts, up to which they are one cell: a task
#: holds so many on each side of a comparison, however large the family is.
SHELF, LOAD = 1024, 1 << 20
#: Bytes of small cells that a task compares at once.
BUNCH = 1 << 20
#: Least shingles of a body that, equal in several projects none of which is named as its home, is a copy of the largest one's.
COMMON = 50
#: Bodies of a copy band that one task holds against all others; a band with more is split over tasks.
TILE = 512

_STRING = re.compile(rb'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_ORIGINS = re.compile(r"\bpart\s+of\s+([\w.+-]*\w)|\b(?:imported|vendored|taken|copied|synced)\s+from\s+([\w.+-]*\w)|\borigin:\s*([\w.+-]*\w)|\bthe\s+([\w.+-]*\w)\s+authors\b", re.I)
_CODES = mix(np.arange(1, 1024, dtype=np.uint64))
_NAME, _NUMBER, _TEXT, _KEYWORD = 256, 257, 258, 300
_keywords: tuple[np.ndarray, np.ndarray] | None = None


def _keyword_table() -> tuple[np.ndarray, np.ndarray]:
    global _keywords
    if _keywords is None:
        values = np.array([token_hash(w.encode()) for w in KEYWORDS], np.uint64)
        order = np.argsort(values)
        _keywords = values[order], order
    return _keywords


def origins(relpath: str, comment: str) -> list[str]:
    """Names of projects that a file's path or opening comment gives as its home."""
    parts = relpath.lower().split("/")[:-1]
    found = {parts[i + 1] for i, p in enumerate(parts[:-1]) if p in VENDOR_FOLDERS}
    for m in _ORIGINS.finditer(comment):
        found.add(next(x for x in m.groups() if x).lower())
    return sorted(found)


@dataclass
class Features:
    """Measures of some bodies, and their masked and unmasked shingle sets, one after the other, with borders."""

    repeat: np.ndarray
    literal: np.ndarray
    name_length: np.ndarray
    space: np.ndarray
    masked: tuple[np.ndarray, np.ndarray]
    plain: tuple[np.ndarray, np.ndarray]


def _features(texts: list[bytes]) -> Iterator[Features]:
    """Measures and shingle sets of the bodies, some bodies at a time."""
    for group in batches(texts):
        tokens, buf, offsets = tokenize(group)
        n = len(buf)
        opened, closed = [], []
        for text, at in zip(group, offsets.tolist()):
            for m in _STRING.finditer(text):
                opened.append(at + m.start())
                closed.append(at + m.end())
        quoted = np.zeros(n + 1, np.int8)
        quoted[opened] += 1  # no two strings begin or end in the same place
        quoted[closed] -= 1
        quoted = np.cumsum(quoted, dtype=np.int8)[:n] > 0
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        in_text = quoted[tokens.start]
        number = tokens.kind == DIGIT
        code = buf[tokens.start].astype(np.int64) + 600 * ((tokens.length == 2) & (tokens.kind == 3))
        name = (tokens.kind == LETTER) & ~tokens.glued
        code[name] = _NAME
        values, order = _keyword_table()
        named = np.flatnonzero(name)
        at = np.minimum(np.searchsorted(values, tokens.hash[named]), len(values) - 1)
        known = values[at] == tokens.hash[named]
        code[named[known]] = _KEYWORD + order[at[known]]
        plain_name = name & ~in_text
        plain_name[named[known]] = False
        code[number] = _NUMBER
        code[in_text] = _TEXT
        # A string counts once; what is glued to a number belongs to it.
        follows = np.zeros(len(code), bool)
        follows[1:] = in_text[1:] & in_text[:-1] & (np.diff(tokens.start) > 0)
        keep = ~follows & ~(tokens.glued & ~in_text)
        lone = (number | tokens.glued) & ~in_text
        figure = np.bincount(tokens.start[lone], minlength=n + 1) - np.bincount(tokens.start[lone] + tokens.length[lone], minlength=n + 1)
        literal = (np.cumsum(figure)[:n] > 0) | (quoted & ~space)
        borders = tokens.split(len(group))
        sizes = np.fromiter((len(t) for t in group), np.int64, len(group))
        ends = np.stack([offsets[:-1], offsets[:-1] + sizes])
        count = lambda flags, at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at], axis=0)
        blank, lit = count(space, ends)[0], count(literal, ends)[0]
        names, letters = count(plain_name, borders), sums_each(tokens.length * plain_name, borders)
        masked, of = _CODES[code[keep] % 1023], np.concatenate([[0], np.cumsum(keep)])[borders]
        # Stretches that occur again; a file of STRETCH tokens or less has none.
        stretch, to = windows_each(masked, of, STRETCH)
        _, again = sorted_each(stretch, to)
        again[:-1] |= again[1:]
        stretches, repeats = np.diff(to), count(again, to)
        yield Features(
            np.where(np.diff(of) > STRETCH, repeats / np.maximum(1, stretches), 0.0),
            lit / np.maximum(1, sizes - blank),
            np.where(names > 0, letters / np.maximum(1, names), 99.0),
            blank / np.maximum(1, sizes),
            distinct_each(*windows_each(masked, of, WIDTH)),
            distinct_each(*windows_each(tokens.hash, borders, WIDTH)),
        )


def identities(shingles: np.ndarray, borders: np.ndarray) -> list[str | None]:
    """Size and two sums of each of the sets between the borders, equal for equal sets; none for an empty one."""
    with np.errstate(over="ignore"):
        sums = sums_each(mix(shingles), borders).tolist(), sums_each(mix(shingles + np.uint64(99)), borders).tolist()
    return [f"{n} {one} {two}" if n else None for n, one, two in zip(np.diff(borders).tolist(), *sums)]


def packed(signature: np.ndarray) -> np.ndarray:
    """Four bits of each MinHash value, sixteen values in a number."""
    with np.errstate(over="ignore"):
        nibbles = (mix(signature) & np.uint64(15)).reshape(*signature.shape[:-1], -1, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(nibbles, axis=-1).view(np.int64)


def estimate(a: str, b: str, values: int) -> Column:
    """Similarity by the share of equal packed values, less what is equal by chance."""
    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    unequal = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda x, y: x + y)
    return F.lit(1.0) - unequal * 16 / 15 / values


def file_traits(files: DataFrame) -> DataFrame:
    """One row for each source file: measures of its body, sketches, band keys, names of possible homes, identity of its shingle set.

    Any file may belong to a family, whatever its own measures are: its masked set is kept if it has one.
    """
    schema = (
        "file_id bigint, project string, repeat double, literal double, name_length double, space double, "
        "masked array<bigint>, copy_keys array<bigint>, origins array<string>, set string, shingles int, skeleton string, ones int, sketch binary, plain_signature array<bigint>"
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            paths = [p or "" for p in part.column("relpath").to_pylist()]
            raw = binary_column(part, "bytes")
            heads = [opening_comment(t, suffix(p)) for t, p in zip(raw, paths)]
            homes = [origins(path, comment_text(head[0])) for path, head in zip(paths, heads)]
            groups: list[tuple] = []
            for g in _features([t[h[1] :] for t, h in zip(raw, heads)]):
                one, two = (minhash_each(*sets, 2 * COPY_BANDS).reshape(-1, COPY_BANDS, 2) for sets in (g.masked, g.plain))
                keys, signed = bands(np.stack([one, two], axis=2).reshape(len(one), -1), 4, salt=7), packed(two.reshape(len(two), -1))
                groups.append((*(getattr(g, c) for c in MEASURES), g.masked[0].view(np.int64), np.diff(g.masked[1]), np.diff(g.plain[1]), keys, signed, identities(*g.plain), identities(*g.masked), odd_sketches(*g.masked)))
            *measures, values, masked, plain, keys, signed = (np.concatenate(c) for c in list(zip(*groups))[:-3])
            sets, skeletons, bits = (list(chain.from_iterable(c)) for c in list(zip(*groups))[-3:])
            lists = lambda flat, counts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            # A file without tokens has no keys.
            keys, signed = (lists(c[plain > 0].ravel(), (plain > 0) * c.shape[1]) for c in (keys, signed))
            ones = [int.from_bytes(b, "little").bit_count() for b in bits]
            told = zip((homes, sets, plain, skeletons, ones, bits), (pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary()))
            columns = [part.column("file_id"), part.column("project"), *map(pa.array, measures), lists(values, masked), keys, *(pa.array(c, k) for c, k in told), signed]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    sources = files.select("file_id", "project", "relpath", "bytes").where("file_id is not null").where(~F.coalesce(file_name(F.col("relpath")), F.lit("")).isin(*LICENSE_FILE_NAMES))
    return once(sources, "file_id").mapInArrow(run, schema)


def alike_skeletons(traits: DataFrame) -> DataFrame:
    """a, b: all pairs of skeletons (each named by the smallest file that has it) whose masked sets are alike.

    Odd sketches of all skeletons are compared as in problem 6, which loses no pair; the sets then decide.
    """
    one = traits.where("skeleton is not null").groupBy("skeleton").agg(F.min("file_id").alias("file_id")).select("file_id")
    skeletons = cut_lineage(traits.select("file_id", F.size("masked").alias("size"), "ones", "sketch").join(one, "file_id", "left_semi"))
    near = cut_lineage(candidate_pairs(skeletons, FAMILY))
    members = cut_lineage(near.select(F.col("a").alias("file_id")).unionByName(near.select(F.col("b").alias("file_id"))).distinct())
    cells = cell_count(members.count())
    sets = traits.select("file_id", F.col("masked").alias("shingles")).join(members, "file_id", "left_semi")
    partners = near.select("a", "b", cell_of("b", cells)).groupBy("a", "cell").agg(F.collect_list("b").alias("others"))
    return compared(sets.withColumn("cell", cell_of("file_id", cells)), partners, sets, cells, FAMILY, dense=True).select("a", "b")


def estimated_pairs(traits: DataFrame) -> DataFrame:
    """a < b of the files whose skeletons are alike and whose texts, as MinHash values estimate them, are unlike."""
    near, member = kindred(traits)
    signed = member.join(traits.select("file_id", "plain_signature"), "file_id")
    one = signed.select(F.col("head").alias("a"), F.col("file_id").alias("x"), F.col("plain_signature").alias("p"))
    two = signed.select(F.col("head").alias("b"), F.col("file_id").alias("y"), F.col("plain_signature").alias("q"))
    return near.join(one, "a").join(two, "b").where("x < y").where(estimate("p", "q", 2 * COPY_BANDS) < UNLIKE).select(F.col("x").alias("a"), F.col("y").alias("b"))


def kindred(traits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): skeletons that are alike, in both orders, and those that several files have, with themselves; (file_id, head): the files of these skeletons."""
    alike = cut_lineage(alike_skeletons(traits))
    skeleton = traits.where("skeleton is not null").groupBy("skeleton").agg(F.min("file_id").alias("head"), F.count(F.lit(1)).alias("of"))
    several = skeleton.where("of > 1").select(F.col("head").alias("a"), F.col("head").alias("b"))
    near = cut_lineage(alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(several))
    member = cut_lineage(traits.select("file_id", "skeleton").join(skeleton, "skeleton").select("file_id", "head").join(near.select(F.col("a").alias("head")).distinct(), "head", "left_semi"))
    return near, member


def placed(traits: DataFrame) -> DataFrame:
    """file_id, head, cell, tile, held, wanted: where the files of alike skeletons are compared.

    Every file is held in one cell, in all tiles of it, and asks in one tile of each cell that holds
    a larger file of a skeleton which it wants. So every pair meets once, and no cell and no tile has
    many more files and shingles than ``SHELF`` and ``LOAD``.
    """
    near, member = kindred(traits)
    member = member.join(traits.select("file_id", "shingles"), "file_id")
    parts = lambda c: F.ceil(F.greatest(F.count(F.lit(1)) / SHELF, F.sum(c) / LOAD)).alias("parts")
    # Skeletons that are alike have mostly the same first partner, so their files lie in few cells.
    first = near.groupBy(F.col("a").alias("head")).agg(F.least("head", F.min("b")).alias("first"))
    member = member.join(first, "head")
    split = member.join(member.groupBy("first").agg(parts("shingles")), "first")
    member = cut_lineage(split.select("file_id", "head", "shingles", F.xxhash64("first", F.pmod(F.xxhash64("file_id"), "parts")).alias("own")))
    shelf = member.groupBy(F.col("head").alias("b"), F.col("own").alias("cell")).agg(F.max("file_id").alias("top"))
    # A skeleton of a single file has itself only to be placed.
    alone = near.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(None).cast("bigint").alias("want"))
    partners = near.withColumn("want", F.col("b")).unionByName(alone).join(shelf, "b").groupBy("a", "cell").agg(F.collect_list("want").alias("wanted"), F.max(F.when(F.col("want").isNotNull(), F.col("top"))).alias("top"))
    asked = member.join(partners.withColumnRenamed("a", "head"), "head")
    asks, held = F.coalesce(F.col("file_id") < F.col("top"), F.lit(False)), F.col("own") == F.col("cell")
    asked = cut_lineage(asked.select("file_id", "head", "shingles", "cell", held.alias("held"), F.when(asks, F.col("wanted")).otherwise(F.array().cast("array<bigint>")).alias("wanted")).where("held or size(wanted) > 0"))
    tiles = asked.where("size(wanted) > 0").groupBy("cell").agg(parts("shingles").cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64(F.lit(7), "file_id"), "tiles").cast("int")
    spread = asked.join(tiles, "cell").withColumn("mine", tile).withColumn("tile", F.explode(F.when(F.col("held"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("mine"))))
    return spread.select("file_id", "head", "shingles", "cell", "tile", "held", F.when(F.col("tile") == F.col("mine"), F.col("wanted")).otherwise(F.array().cast("array<bigint>")).alias("wanted"))


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of each cell and tile, whose rows are successive, with those that they are unlike; small cells in bunches."""
    held: list[pa.RecordBatch] = []
    where, size = None, 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: t.column(name).to_numpy()
        texts = [body(data or b"", path) for data, path in zip(t.column("bytes").to_pylist(), t.column("relpath").to_pylist())]
        sets = [own for values, borders in set_lists(texts) for own in np.split(values, borders[1:-1])]
        ids, heads, projects, sizes = column("file_id"), column("head"), column("home"), np.array([len(s) for s in sets], np.int64)
        measures = np.stack([column(c) for c in MEASURES], axis=1)
        wanted = t.column("wanted").to_pylist()
        where = np.stack([column("cell"), column("tile")])
        borders = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 0).any(axis=0), [True]]))
        is_held, out = column("held"), []
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
            x, y = np.array([k for k in range(lo, hi) if wanted[k]], np.int64), lo + np.flatnonzero(is_held[lo:hi])
            if not len(x):
                continue
            common = common_counts([sets[k] for k in x], [sets[k] for k in y])
            unlike = common < UNLIKE * (sizes[x][:, None] + sizes[y][None] - common)
            unlike &= ids[x][:, None] < ids[y][None]
            fitting = {k: np.isin(heads[y], np.array(wanted[at], np.int64)) for k, at in {int(heads[at]): at for at in x}.items()}
            unlike &= np.stack([fitting[int(h)] for h in heads[x]])
            for fits, one, other in ((unlike, x, y), (unlike.T, y, x)):
                some = fits.any(axis=1)
                fits, one = fits[some], one[some]
                of = other[np.nonzero(fits)[1]]
                out.append([ids[one], fits.sum(axis=1), ids[of], projects[of], fits @ measures[other]])
        out = out or [[np.zeros(0, np.int64)] * 4 + [np.zeros((0, len(MEASURES)))]]
        file, count, of, home, sums = (np.concatenate(c) for c in zip(*out))
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (of, home)]
        return pa.RecordBatch.from_arrays([pa.array(file), *lists, *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], ["file_id", "others", "homes", *MEASURES])

    for part in parts:
        keys = part.column("cell").to_numpy(), part.column("tile").to_numpy()
        borders = np.flatnonzero(np.concatenate([[True], (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0), [True]])) if part.num_rows else []
        for lo, hi in zip(borders[:-1], borders[1:]):
            if size >= BUNCH and where != (keys[0][lo], keys[1][lo]):
                yield flush()
                held.clear()
                size = 0
            where = keys[0][lo], keys[1][lo]
            held.append(part.slice(lo, hi - lo))
            size += held[-1].nbytes
    if held:
        yield flush()


def unlike_files(traits: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, others, homes (first files of the others' projects) and sums of the others' measures.

    The others of a file are all files of its skeleton, or of one that is alike, whose text is unlike
    by the exact shingle sets. A file has a row for each place that it meets some in. Texts move to the
    places and are tokenised there, since they are a fraction of their sets.
    """
    home = traits.groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.min("file_id").alias("home"))
    measures = traits.select("file_id", F.coalesce("project", F.lit("")).alias("project"), *MEASURES).join(home, "project").drop("project")
    rows = cut_lineage(placed(traits))
    load = rows.agg(F.sum("shingles")).first()[0] or 0
    texts = once(files.select("file_id", "relpath", "bytes").join(rows.select("file_id").distinct(), "file_id", "left_semi"), "file_id")
    width = max(files.sparkSession.sparkContext.defaultParallelism, min(-(-4 * load // LOAD), 20_000))
    met = rows.drop("shingles").join(measures, "file_id").join(texts, "file_id").repartition(width, "cell", "tile").sortWithinPartitions("cell", "tile")
    return met.mapInArrow(_compare, "file_id bigint, others array<bigint>, homes array<bigint>, " + ", ".join(f"{c} double" for c in MEASURES))


def families(traits: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file_id, family: the files (heads) whose skeleton a file shares and whose text it doesn't.

    Every file that has such partners is a head, with all of them and itself in its family. The
    texts' shingle sets decide; without ``files`` they are estimated from MinHash values.
    """
    if files is None:
        pairs = cut_lineage(estimated_pairs(traits))
        both = pairs.select(F.col("a").alias("file_id"), F.col("b").alias("family")).unionByName(pairs.select(F.col("b").alias("file_id"), F.col("a").alias("family")))
    else:
        both = cut_lineage(unlike_files(traits, files).select(F.explode("others").alias("file_id"), F.col("file_id").alias("family")))
    return both.unionByName(both.select("file_id", F.col("file_id").alias("family")).distinct())


def _most(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of the homes of each family's members, their number and the largest number with the same one."""
    for part in parts:
        homes, own = part.column("homes"), part.column("home").to_pylist()
        counts = [np.unique(np.append(h.values.to_numpy(), o), return_counts=True)[1] for h, o in zip(homes, own)]
        numbers = [pa.array([f(c) for c in counts], pa.int64()) for f in (lambda c: int(c.sum()), lambda c: int(c.max()))]
        yield pa.RecordBatch.from_arrays([part.column("file_id"), *(part.column(c) for c in MEASURES), *numbers], ["file_id", *MEASURES, "family_size", "within"])


def family_kinds(traits: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, kind (generated, minified or blob) by the spread and the measures of each family of a file that has one.

    A file in no family has itself as family, and its own measures and stricter limits decide.
    """
    home = traits.groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.min("file_id").alias("home"))
    own = traits.select("file_id", F.coalesce("project", F.lit("")).alias("project"), *(F.col(c).alias(f"own_{c}") for c in MEASURES)).join(home, "project").drop("project")
    rows = cut_lineage(unlike_files(traits, files))
    whole = rows.groupBy("file_id").agg(*(F.sum(c).alias(c) for c in MEASURES), F.flatten(F.collect_list("homes")).alias("homes")).join(own, "file_id")
    summed = whole.select("file_id", *((F.col(c) + F.col(f"own_{c}")).alias(c) for c in MEASURES), "homes", "home")
    counted = summed.mapInArrow(_most, "file_id bigint, " + ", ".join(f"{c} double" for c in MEASURES) + ", family_size bigint, within bigint")
    mean = counted.select("file_id", *((F.col(c) / F.col("family_size")).alias(c) for c in MEASURES), "within")

    def kind(repeat, literal):
        dense = (F.col("name_length") <= SHORT_NAME) & (F.col("space") <= DENSE)
        return F.when(F.col("literal") >= literal, "blob").when(dense, "minified").when(repeat, "generated").alias("kind")

    heads = cut_lineage(mean.select("file_id", kind((F.col("within") >= WITHIN) | (F.col("repeat") >= FAMILY_REPEAT), FAMILY_LITERAL)))
    told = heads.where("kind is not null")
    others = rows.select("file_id", "others").join(told, "file_id").select(F.explode("others").alias("file_id"), "kind")
    apart = traits.where("size(masked) > 0").join(heads, "file_id", "left_anti")
    alone = apart.select("file_id", kind(F.col("repeat") >= REPEAT, LITERAL)).where("kind is not null")
    return told.unionByName(others).unionByName(alone)


def copies(traits: DataFrame, sides: DataFrame, files: DataFrame) -> DataFrame:
    """file_id of the vendored copies among the files; ``sides`` tells project, foreign and self of each.

    Likeness depends on the bodies alone, so files of equal shingle sets are one body. Every body
    with a file that may be a copy is compared with every other body of its bands that has, in
    another project, a file which would make it one: any for a file that names a foreign home, a
    self-named home for one that names none. A hot band's bodies are split into tiles, each of
    which meets all of the band.
    """
    known = traits.where("size(copy_keys) > 0 and project is not null").select("file_id", "project", "set", "shingles", "copy_keys").join(sides, "file_id")
    bodies_ = known.groupBy("set").agg(F.min("file_id").alias("body"))
    role = F.when(F.col("foreign"), "foreign").when(F.col("self"), "home").otherwise("none").alias("role")
    placed = cut_lineage(known.join(bodies_, "set").select("file_id", "project", "body", role, "shingles", "copy_keys"))
    home = F.when(F.col("role") == "home", F.col("project"))
    answers = placed.groupBy("body").agg(F.min("project").alias("any_lo"), F.max("project").alias("any_hi"), F.min(home).alias("home_lo"), F.max(home).alias("home_hi"), F.min("role").alias("any_role"), F.max("role").alias("other_role"), F.max("shingles").alias("shingles"))
    # Equal bodies in several projects none of which is named as home: it is the largest, the first by name of equals.
    unnamed = answers.where("any_lo <> any_hi and any_role = 'none' and other_role = 'none'").where(F.col("shingles") >= COMMON).select("body")
    size = placed.groupBy("project").agg(F.count(F.lit(1)).alias("files"))
    apart_ = cut_lineage(placed.join(unnamed, "body").select("file_id", "project", "body").join(size, "project"))
    largest = apart_.groupBy("body").agg(F.min(F.struct((-F.col("files")).alias("files"), "project"))["project"].alias("home"))
    orphans = apart_.join(largest, "body").where("project <> home").select("file_id")
    differs = F.when(F.col("role") == "foreign", (F.col("any_lo") != F.col("project")) | (F.col("any_hi") != F.col("project")))
    differs = F.coalesce(differs.otherwise((F.col("home_lo") != F.col("project")) | (F.col("home_hi") != F.col("project"))), F.lit(False))
    asking = cut_lineage(placed.where("role <> 'home'").select("body", "project", "role").distinct().join(answers.drop("any_role", "other_role", "shingles"), "body").withColumn("settled", differs).select("body", "project", "role", "settled"))
    # Who still asks: the range of the projects of the files that name a foreign home, and of those that name none.
    by_role = lambda f, r: f(F.when(F.col("role") == r, F.col("project")))
    asks = asking.where("not settled").groupBy("body").agg(
        by_role(F.min, "foreign").alias("f_lo"), by_role(F.max, "foreign").alias("f_hi"), by_role(F.min, "none").alias("n_lo"), by_role(F.max, "none").alias("n_hi")
    )
    # Moved once, by key: both the distinct rows and the window are of one key.
    keyed = placed.select("body", F.explode("copy_keys").alias("key")).repartition("key").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    keyed = cut_lineage(keyed.where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).drop("n"))
    left = keyed.join(asks, "body").withColumn("tile", F.pmod(F.xxhash64("body"), "tiles").cast("int")).drop("tiles")
    right = keyed.join(answers, "body").select(F.col("body").alias("other"), "key", "any_lo", "any_hi", "home_lo", "home_hi", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    apart = "not (f_lo = f_hi and any_lo = any_hi and f_lo = any_lo)", "not (n_lo = n_hi and home_lo = home_hi and n_lo = home_lo)"
    met = left.join(right, ["key", "tile"]).where("body <> other").where(f"f_lo is not null and {apart[0]} or n_lo is not null and home_lo is not null and {apart[1]}")
    pairs = cut_lineage(met.select(F.least("body", "other").alias("a"), F.greatest("body", "other").alias("b")).distinct())
    alike = cut_lineage(verified_pairs(pairs, files, COPY, bodies=True).select("a", "b"))
    both = alike.select(F.col("a").alias("body"), F.col("b").alias("other")).unionByName(alike.select(F.col("b").alias("body"), F.col("a").alias("other")))
    reached = asking.where("not settled").join(both, "body").join(answers.withColumnRenamed("body", "other"), "other").where(differs)
    copied = asking.where("settled").select("body", "project", "role").unionByName(reached.select("body", "project", "role")).distinct()
    return placed.select("file_id", "body", "project", "role").join(copied, ["body", "project", "role"]).select("file_id").unionByName(orphans)


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_id, kind of every source file that is generated, minified, a blob or a vendored copy.

    A vendored copy is a file with a verified likeness in another project whose path or opening
    comment names a project other than its own as home; where neither of two such files does, the
    one that doesn't name its own project is the copy of one that does; equal bodies of which no
    project is named as home are copies of the largest project's. Null ids give no row, empty or very short files are no cases, repeated rows count once, extra columns are ignored.
    """
    traits = cut_lineage(file_traits(files))
    by_family = family_kinds(traits, files)
    named = traits.select("file_id", F.lower("project").alias("own"), "origins")
    homes = traits.select(F.lower("project").alias("home")).distinct()
    foreign = named.select("file_id", "own", F.explode("origins").alias("home")).where("home <> own").join(homes, "home", "left_semi").select("file_id").distinct().withColumn("foreign", F.lit(True))
    side = named.join(foreign, "file_id", "left").select("file_id", F.coalesce("foreign", F.lit(False)).alias("foreign"), F.array_contains("origins", F.col("own")).alias("self"))
    copied = copies(traits, side, files).select("file_id", F.lit("copy").alias("kind"))
    return by_family.unionByName(copied).groupBy("file_id").agg(F.min("kind").alias("kind"))
