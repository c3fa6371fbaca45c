"""Test items leaking into documents (problem 8).

Adjacent words are the features; pairs that few of all items have weigh more. An item that leaks in
part lies far from the whole item, so an item gets a weighted 256-bit SimHash of each of many short
pieces, and so do windows of the same size at all places of a document where a known pair begins. A
multi-index over blocks of the fingerprint finds all pieces within the Hamming radius of a window;
the exact weighted similarity of piece and window has to reach a floor, the document has to have as
many of the item's pairs as any alignment needs, and the words of both are aligned to see whether
enough of the item is there.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lexing import mix

BITS, BLOCKS = 256, 16
#: Hamming radius: each block of 16 bits is probed one bit around, which a random window meets with one piece in 250.
RADIUS = 31
#: Words of a piece: an eighth of the item within these limits; pieces begin at every second word of longer items.
PIECE_SHARE, PIECE_LEAST, PIECE_MOST = 8, 2, 8
#: Least weighted similarity of a piece and a window.
ALIKE = 0.5
#: Least share of the item's words that its one or two stretches in the document span.
PART = 0.5
#: Alignment: a changed, added or dropped word costs this many matching ones; longest gap of such words.
EDIT, REACH = 3.0, 4
#: Least alignment score of a stretch for each word it spans: about 15 words in 100 edited. Shortest stretch, for items of 16 words and more.
DENSITY, STRETCH = 0.4, 4
#: Pairs of words, for each word of its stretches, that an item keeps at least, but for one in each stretch: an edit
#: costs a match and ``EDIT`` more, so no more than this share of a stretch's words is edited, and breaks two pairs.
NEEDED = 1 - 2 * (1 - DENSITY) / (EDIT + 1)
#: Features of a text whose windows are worked out together.
STRIDE = 4096
#: Most characters of item text sent to every task at once; more items are taken in several blocks.
BLOCK_CHARS = 1 << 20

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t>*+#/!|-]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")


def words(text: str) -> list[str]:
    """Lower-case words without their typographic dress: wrapping, hyphens, accents, ligatures, widths."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    if "-\n" in text or "-\r" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text.lower())


class HammingIndex:
    """Finds all of a set of fingerprints within a radius, by the pigeonhole principle on blocks.

    Of ``BLOCKS`` blocks of 16 bits one must be within ``radius // BLOCKS`` bits if the whole is
    within ``radius``; for each block the stored fingerprints are listed under all values that near.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        flips = [0]
        for _ in range(radius // BLOCKS):
            flips = sorted({f ^ (1 << b) for f in flips for b in range(16)} | set(flips))
        block = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), BLOCKS)
        self.first, self.stored = [], []
        for b in range(BLOCKS):
            value = (block[:, b][:, None] ^ np.array(flips, np.uint16)[None]).ravel()
            order = np.argsort(value, kind="stable")
            self.first.append(np.searchsorted(value[order], np.arange(65537)))
            self.stored.append((order // len(flips)).astype(np.int32))

    def reached(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct index pairs (query, stored) that share a block within its bits."""
        block = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), BLOCKS)
        keys = []
        for b in range(BLOCKS):
            lo, hi = self.first[b][block[:, b]], self.first[b][block[:, b].astype(np.int64) + 1]
            n = hi - lo
            q = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            keys.append(q * len(self.prints) + self.stored[b][at])
        key = np.unique(np.concatenate(keys))
        return key // max(1, len(self.prints)), key % max(1, len(self.prints))

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, stored) within the radius."""
        q, s = self.reached(prints)
        near = np.bitwise_count(prints[q] ^ self.prints[s]).sum(axis=1) <= self.radius
        return q[near], s[near]


def word_hashes(texts: list[str]) -> np.ndarray:
    """64 bits of each word, the same everywhere."""
    return np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in texts), np.uint64, len(texts))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Feature of each two adjacent words, from their hashes."""
    with np.errstate(over="ignore"):
        return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


@dataclass
class Items:
    """The items of one block and what is needed to recognise them.

    ``counts`` tells for every adjacent pair of words of an item in how many of all ``total`` items
    it is, whichever block they are in, so that an item's fingerprints and weights don't depend on
    its block. Without it the items here are all.
    """

    ids: list[int]
    texts: list[list[str]]
    counts: list[np.ndarray] | None = None
    total: int = 0
    share: float = PART

    def __post_init__(self) -> None:
        vocabulary = sorted({w for t in self.texts for w in t})
        self.word_id = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.base = len(vocabulary) + 1
        self.coded = [np.array([self.word_id[w] for w in t], np.int64) for t in self.texts]
        pairs = [t[:-1] * self.base + t[1:] for t in self.coded]
        every = np.concatenate([*pairs, np.zeros(0, np.int64)])
        if self.counts is None:
            self.pairs, df = np.unique(np.concatenate([*map(np.unique, pairs), np.zeros(0, np.int64)]), return_counts=True)
        else:
            self.pairs, at = np.unique(every, return_index=True)
            df = np.concatenate([*self.counts, np.zeros(0, np.int64)])[at]
        self.weight = np.log(1 + max(self.total, len(self.texts)) / df)
        hashes = np.concatenate([np.zeros(1, np.uint64), word_hashes(vocabulary)])
        with np.errstate(over="ignore"):
            self.feature_hash = mix(hashes[self.pairs // self.base] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.pairs % self.base])
        self.lengths = np.array([len(t) for t in self.texts])
        self.features = [np.searchsorted(self.pairs, p) for p in pairs]
        self.held = np.zeros(len(self.pairs), bool)
        self.single = {int(t[0]): [] for t in self.coded if len(t) == 1}
        for i, t in enumerate(self.coded):
            if len(t) == 1:
                self.single[int(t[0])].append(i)
        # Pieces by size: their item, their distinct features and their fingerprint.
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, p in enumerate(pairs):
            n = len(p) + 1
            size = min(PIECE_MOST, max(PIECE_LEAST, n // PIECE_SHARE))
            at = self.features[i]
            last = n - size
            for start in sorted({*range(0, last + 1, 2 if size > 2 else 1), last}) if n > 1 else ():
                found.setdefault(size, []).append((i, np.unique(at[start : start + size - 1])))
        self.pieces = []
        for size, some in sorted(found.items()):
            lengths = np.array([len(f) for _, f in some])
            flat = np.concatenate([f for _, f in some])
            sums = np.concatenate([np.zeros((1, BITS), np.float32), np.cumsum(self.vectors(flat), axis=0, dtype=np.float64)])
            ends = np.cumsum(lengths)
            weights = np.array([self.weight[f].sum() for _, f in some])
            index = HammingIndex(self._bits(sums[ends] - sums[ends - lengths]), RADIUS)
            self.pieces.append((size, np.array([i for i, _ in some]), [f for _, f in some], weights, index))
        self.most = max((x[0] for x in self.pieces), default=0)
        self.of_word: list[dict[int, list[int]]] = []
        for t in self.coded:
            at: dict[int, list[int]] = {}
            for i, w in enumerate(t.tolist()):
                at.setdefault(w, []).append(i)
            self.of_word.append(at)

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "texts": self.texts, "counts": self.counts, "total": self.total, "share": self.share}  # the tables are built again where they are used

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def vectors(self, features: np.ndarray) -> np.ndarray:
        """Weighted directions of features, one in a row."""
        bits = mix(self.feature_hash[features][:, None] * np.uint64(4) + np.arange(BITS // 64, dtype=np.uint64)[None])
        signs = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
        return signs * self.weight[features][:, None].astype(np.float32)

    @staticmethod
    def _bits(sums: np.ndarray) -> np.ndarray:
        # Features weigh at least 0.01, so what rounding leaves of an even sum is none.
        return np.packbits(sums > 1e-4, axis=-1, bitorder="little").view(np.uint64)

    def candidates(self, coded: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Items of which a window of the text is like a piece and whose pairs are enough in it, with the
        places of the item's pairs in the text."""
        lone = [(i, np.flatnonzero(coded == w)) for w in set(coded.tolist()) & self.single.keys() for i in self.single[w]]
        if not len(self.pairs) or len(coded) < 2:
            return lone
        both = coded[:-1] * self.base + coded[1:]
        at = np.searchsorted(self.pairs, both)
        at[at == len(self.pairs)] = 0
        place = np.flatnonzero((self.pairs[at] == both) & (coded[:-1] > 0))
        feature = at[place]
        found: set[int] = set()
        for first in range(0, len(place), STRIDE):  # long texts in stretches that overlap by a window
            last = min(first + STRIDE, len(place))
            end = int(np.searchsorted(place, place[last - 1] + self.most))
            self._windows(place[first:end], feature[first:end], last - first, found)
        self.held[feature] = True
        near = [i for i in sorted(found) if self.held[self.features[i]].sum() >= NEEDED * self.share * self.lengths[i] - 2]
        self.held[feature] = False
        return lone + [(i, place[np.isin(feature, self.features[i])]) for i in near]

    def _windows(self, place: np.ndarray, feature: np.ndarray, anchors: int, found: set[int]) -> None:
        """Add the items of which a window that begins at one of the first places is like a piece."""
        kinds, where = np.unique(feature, return_inverse=True)
        weights = np.concatenate([[0.0], np.cumsum(self.weight[feature])])
        sums: np.ndarray | None = None
        for size, owner, features, weight, index in self.pieces:
            lo = np.arange(anchors)
            hi = np.searchsorted(place, place[:anchors] + size - 1)
            heavy = weights[hi] - weights[lo] >= ALIKE * weight.min() - 1e-6  # lighter ones are like no piece
            lo, hi = lo[heavy], hi[heavy]
            if not len(lo):
                continue
            if sums is None:
                sums = np.concatenate([np.zeros((1, BITS), np.float32), np.cumsum(self.vectors(kinds)[where], axis=0)])
            bits, first = np.unique(self._bits(sums[hi] - sums[lo]), axis=0, return_index=True)
            window, piece = index.query(bits)
            for w, k in zip(first[window].tolist(), piece.tolist()):
                if owner[k] not in found:
                    own = np.unique(feature[lo[w] : hi[w]])
                    shared = self.weight[np.intersect1d(own, features[k])].sum()
                    if shared >= ALIKE * (self.weight[own].sum() + weight[k] - shared) - 1e-9:
                        found.add(int(owner[k]))

    def part(self, item: int, coded: np.ndarray, places: np.ndarray) -> float:
        """Share of the item's words that at most two stretches of the text span, in order.

        Stretches are local alignments in which an edit costs ``EDIT`` matching words, so that about
        one changed word in ten is borne and frames with other contents fall apart.
        """
        near = np.unique((places[:, None] + np.arange(-3, 5)[None]).ravel())
        near = near[(near >= 0) & (near < len(coded))]
        cell: dict[tuple[int, int], tuple[float, tuple[int, int]]] = {}
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        at = self.of_word[item]
        for j, w in zip(near.tolist(), coded[near].tolist()):
            for i in at.get(w, ()):
                score, start = 1.0, (i, j)
                for di in range(1, REACH + 1):
                    for dj in range(1, REACH + 1):
                        if before := cell.get((i - di, j - dj)):
                            s = before[0] + 1 - EDIT * (max(di, dj) - 1)
                            if s > score:
                                score, start = s, before[1]
                cell[i, j] = score, start
                if start not in best or score > best[start][0]:
                    best[start] = score, i, j
        n = len(self.texts[item])
        least = min(n, max(2, min(STRETCH, n // 4)))
        stretches = [(i0, j0, i1, j1) for (i0, j0), (s, i1, j1) in best.items() if s >= max(least, DENSITY * (i1 - i0 + 1))]
        # The widest pair in order: by begin in the text, after the widest of those that have ended in it, by their end in the item.
        widest = [0] * (n + 1)  # Fenwick tree of prefix maxima
        ended = sorted(stretches, key=lambda x: x[3])
        most = e = 0
        for i0, j0, i1, _ in sorted(stretches, key=lambda x: x[1]):
            while ended[e][3] < j0:
                a0, _, a1, _ = ended[e]
                p = a1 + 1
                while p <= n:
                    widest[p] = max(widest[p], a1 - a0 + 1)
                    p += p & -p
                e += 1
            before, p = 0, i0
            while p:
                before = max(before, widest[p])
                p -= p & -p
            most = max(most, i1 - i0 + 1 + before)
        return most / max(1, len(self.texts[item]))


def _search(documents: DataFrame, items: Items) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.word_id
        for part in parts:
            docs, hits, share = [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                coded = np.array(list(map(known.get, words(text), repeat(0))), np.int64)
                for item, places in items.candidates(coded):
                    docs.append(doc)
                    hits.append(items.ids[item])
                    share.append(items.part(item, coded, places))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "part"])

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, part double")


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words, counts: the words of each item, and for each adjacent pair of them the number of items that have it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            split = [words(t) for t in part.column("text").to_pylist()]
            pairs = [pair_hashes(word_hashes(t)).view(np.int64).tolist() for t in split]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(split, pa.list_(pa.string())), pa.array(pairs, pa.list_(pa.int64()))], ["item_id", "words", "pairs"])

    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    read = cut_lineage(rows.mapInArrow(run, "item_id bigint, words array<string>, pairs array<bigint>").where("size(words) > 0"))
    count = read.select("item_id", "words", F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    placed = read.select("item_id", "words", F.posexplode_outer("pairs").alias("at", "pair")).join(count, "pair", "left")
    return placed.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))).alias("c")).select("item_id", "words", F.col("c.n").alias("counts"))


def leaks(documents: DataFrame, items: DataFrame, part: float = PART) -> DataFrame:
    """doc_id, item_id, part: documents that hold at least ``part`` of an item's words.

    Items are the query set: they are taken in blocks of bounded size, each sent to every task, and
    every block meets all documents; weights count over all items. A stretch has two words at least,
    four of longer items; an item of one word is held by a text with that word. Null ids, and texts
    that are null or without words, match nothing; repeated rows count once; extra columns are ignored.
    """
    rows = cut_lineage(item_words(items))
    total = rows.count()
    found: DataFrame | None = None
    block: list[tuple[int, list[str], np.ndarray]] = []
    size = 0

    def take() -> None:
        nonlocal found, block, size
        ids, texts, counts = (list(x) for x in zip(*block)) if block else ([], [], [])
        hits = _search(documents, Items(ids, texts, counts, total, part))
        found = hits if found is None else found.unionByName(hits)
        block, size = [], 0

    for item, text, counts in rows.orderBy("item_id").toLocalIterator():
        block.append((item, text, np.array(counts, np.int64)))
        size += sum(map(len, text))
        if size >= BLOCK_CHARS:
            take()
    if block or found is None:
        take()
    return found.where(F.col("part") >= part).groupBy("doc_id", "item_id").agg(F.max("part").alias("part"))
