"""Texts packed into containers of fixed token capacity (problem 7).

A grouping genetic algorithm: a solution is a set of bins; crossover injects whole well-filled bins
of one parent into the other, drops the bins that would hold an item twice, and best-fits what that
displaces. Items are dealt into shards of bounded size; each shard is evolved on several islands,
each a row of its own, and between epochs the elite of an island moves on to the next one. Bins
that end up short of full are opened again and their items packed anew, with those of other
shards, as long as that fills bins.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITY = 4096
#: Vocabulary file of a public tokenizer; a bare name is looked up in the installed collection.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Items of one shard, about the most that one task packs together.
SHARD = 600
#: Populations that evolve a shard apart from each other; epochs, between which their elites move on.
ISLANDS, EPOCHS = 2, 3
#: Solutions of a population; children of one epoch, and after how many without a gain it ends.
POPULATION, GENERATIONS, STALL = 6, 40, 14
#: Bins at least this full are final.
FULL = 0.9985
#: Packing anew goes on while at least this share of the items in open bins gets into full ones.
GAIN = 0.1

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-level tokenizer of a rank file, loaded once in each process."""
    if vocabulary not in _encoders:
        import tiktoken

        path = vocabulary
        import public_tokenizers

        if not os.path.isabs(path):
            path = public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _encoders[vocabulary] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of every text; null and empty texts have none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for part in parts:
            counts = [len(encode(t)) if t else 0 for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "tokens"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens bigint")


class Bins:
    """One solution: items by bin, with the open bins ordered by their room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        self.room: list[tuple[int, int]] = []
        self.next = 0

    def add_bin(self, items: list[int]) -> None:
        fill = sum(self.sizes[i] for i in items)
        self.items[self.next], self.fill[self.next] = list(items), fill
        if fill < self.capacity:
            insort(self.room, (self.capacity - fill, self.next))
        self.next += 1

    def drop_bin(self, b: int) -> list[int]:
        room = (self.capacity - self.fill.pop(b), b)
        at = bisect_left(self.room, room)
        if at < len(self.room) and self.room[at] == room:
            self.room.pop(at)
        return self.items.pop(b)

    def best_fit(self, items: list[int]) -> None:
        """Put the items, in order, each into the fullest bin that has room for it."""
        for i in items:
            size = self.sizes[i]
            at = bisect_left(self.room, (size, -1))
            if at == len(self.room):
                self.add_bin([i])
                continue
            room, b = self.room.pop(at)
            self.items[b].append(i)
            self.fill[b] += size
            if room > size:
                insort(self.room, (room - size, b))

    def fitness(self) -> float:
        """Mean squared fill; more for few full bins than for many equal ones."""
        return sum((f / self.capacity) ** 2 for f in self.fill.values()) / max(1, len(self.fill))

    def groups(self) -> list[list[int]]:
        return list(self.items.values())


def _from(groups: list[list[int]], sizes: list[int], capacity: int) -> Bins:
    bins = Bins(sizes, capacity)
    for g in groups:
        bins.add_bin(g)
    return bins


def crossover(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, random: Random) -> Bins:
    """``one`` with the best-filled part of ``other`` injected."""
    ranked = sorted(other, key=lambda g: -sum(sizes[i] for i in g))
    take = max(1, int(len(ranked) * random.uniform(0.2, 0.6)))
    injected = ranked[:take]
    held = {i for g in injected for i in g}
    child, loose = Bins(sizes, capacity), []
    for g in injected:
        child.add_bin(g)
    for g in one:
        if held.isdisjoint(g):
            child.add_bin(g)
        else:
            loose += [i for i in g if i not in held]
    loose.sort(key=lambda i: -sizes[i])
    child.best_fit(loose)
    return child


def mutate(bins: Bins, random: Random) -> None:
    """Open the emptiest bin and two others, and best-fit their items in another order."""
    order = sorted(bins.fill, key=lambda b: bins.fill[b])
    chosen = order[:1] + random.sample(order[1:], min(2, len(order) - 1))
    loose = [i for b in chosen for i in bins.drop_bin(b)]
    random.shuffle(loose)
    loose.sort(key=lambda i: -bins.sizes[i] * random.uniform(0.7, 1.3))
    bins.best_fit(loose)


def rank(bins: Bins) -> tuple[int, float]:
    """Smaller is better: fewer bins, then fuller ones."""
    return len(bins.fill), -bins.fitness()


def finished(bins: Bins) -> bool:
    """No grouping can be better: all bins but the last are full to the token."""
    return sum(f < bins.capacity for f in bins.fill.values()) <= 1


def seeds(sizes: list[int], capacity: int, random: Random, population: int = POPULATION) -> list[Bins]:
    """First solutions: best fit in decreasing, in disturbed decreasing and in random order."""
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    crowd = []
    for k in range(population):
        order = falling[:]
        if k >= population // 2:
            random.shuffle(order)
        elif k:
            order.sort(key=lambda i: -sizes[i] * random.uniform(0.8, 1.2))
        bins = Bins(sizes, capacity)
        bins.best_fit(order)
        crowd.append(bins)
    return crowd


def evolve(crowd: list[Bins], sizes: list[int], capacity: int, random: Random, generations: int = GENERATIONS, stall: int = STALL) -> list[Bins]:
    """The population after an epoch, best first. The worst makes room for each child that is better."""
    crowd = sorted(crowd, key=rank)
    idle = 0
    for _ in range(generations):
        if finished(crowd[0]) or idle >= stall or len(crowd) < 2:
            break
        one, two = random.sample(crowd[: max(2, len(crowd) * 2 // 3)], 2)
        child = crossover(one.groups(), two.groups(), sizes, capacity, random)
        mutate(child, random)
        mine = rank(child)
        idle = 0 if mine < rank(crowd[0]) else idle + 1
        if mine < rank(crowd[-1]) and all(mine != rank(b) for b in crowd):
            crowd[-1] = child
            crowd.sort(key=rank)
    return crowd


_ITEMS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64())]))
_STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("items", _ITEMS), ("crowd", pa.list_(pa.list_(pa.int32())))])
STATE = "shard bigint, island int, items array<struct<doc_id:bigint,piece:int,tokens:bigint>>, crowd array<array<int>>"


def _numbered(bins: Bins) -> list[int]:
    """The bin of each item."""
    out = [0] * len(bins.sizes)
    for b, group in enumerate(bins.items.values()):
        for i in group:
            out[i] = b
    return out


def _grouped(numbers: list[int], sizes: list[int], capacity: int) -> Bins:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        groups.setdefault(b, []).append(i)
    return _from(list(groups.values()), sizes, capacity)


def _islands(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.ListArray, list[list[int]]]]:
    """shard, island, items (a list array of one row) and solutions of each island of a sorted partition; what has moved in is among the solutions."""
    held: tuple | None = None
    for part in parts:
        items = part.column("items")
        for k, (shard, island, crowd) in enumerate(zip(*(part.column(c).to_pylist() for c in ("shard", "island", "crowd")))):
            if held and held[:2] == (shard, island):
                held = (*held[:3], held[3] + crowd)  # the island's own row comes first
            else:
                if held:
                    yield held
                held = shard, island, items.slice(k, 1), crowd
    if held:
        yield held


def _sizes(items: pa.ListArray) -> list[int]:
    return items.flatten().field("tokens").to_pylist()


def _epoch(capacity: int, level: int, epoch: int):
    """Evolve every island; its row stays, and a row with its elite goes to the next one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, island, items, crowd in _islands(parts):
            sizes = _sizes(items)
            random = Random(((shard * ISLANDS + island) * 64 + level) * EPOCHS + epoch)
            first = [_grouped(c, sizes, capacity) for c in crowd] if crowd else seeds(sizes, capacity, random)
            best = evolve(first, sizes, capacity, random)[:POPULATION]
            solved = [_numbered(b) for b in best]
            both = [pa.array([shard, shard]), pa.array([island, (island + 1) % ISLANDS], pa.int32()), pa.concat_arrays([items.cast(_ITEMS), pa.nulls(1, _ITEMS)]), pa.array([solved, solved[:1]], _STATE.field("crowd").type)]
            yield pa.RecordBatch.from_arrays(both, schema=_STATE)

    return run


def _pick(capacity: int):
    """The items of every shard with their bins in the best solution of all islands, and the bins' fill."""
    names = ["shard", "bin", "doc_id", "piece", "tokens", "fill"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple | None = None

        def rows() -> pa.RecordBatch:
            _, shard, items, bins = best
            fill = [sum(bins.sizes[k] for k in g) for g in bins.items.values()]
            mine = _numbered(bins)
            each = items.flatten()
            columns = [pa.array([shard] * len(mine)), pa.array(mine, pa.int32()), *(each.field(c) for c in names[2:5]), pa.array([fill[b] for b in mine], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for shard, _, items, crowd in _islands(parts):
            sizes = _sizes(items)
            mine = min((_grouped(c, sizes, capacity) for c in crowd), key=rank)
            if best and best[1] != shard:
                yield rows()
                best = None
            if not best or rank(mine) < best[0]:
                best = rank(mine), shard, items, mine
        if best:
            yield rows()

    return run


def pack(items: DataFrame, shards: int, capacity: int, level: int = 0) -> DataFrame:
    """shard, bin, doc_id, piece, tokens, fill: items (doc_id, piece, tokens) packed shard by shard.

    A shard is one row on each of its islands, so an epoch moves a row for each island and one for
    its elite; nothing is joined, and no row outgrows a shard.
    """
    width = min(shards * ISLANDS, max(items.sparkSession.sparkContext.defaultParallelism, shards * ISLANDS // 8))
    dealt = items.groupBy(F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(shards)).alias("shard"))
    rows = dealt.agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "tokens"))).alias("items"))  # about SHARD items
    state = rows.select("shard", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), "items", F.array().cast("array<array<int>>").alias("crowd"))
    for epoch in range(EPOCHS):
        state = state.repartition(width, "shard", "island").sortWithinPartitions("shard", "island", F.col("items").isNull()).mapInArrow(_epoch(capacity, level, epoch), STATE)
    last = state.repartition(width, "shard").sortWithinPartitions("shard", "island", F.col("items").isNull())
    return last.mapInArrow(_pick(capacity), "shard bigint, bin int, doc_id bigint, piece int, tokens bigint, fill bigint")


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """container, doc_id, piece, token_start, tokens, container_tokens, fill.

    A text of more than ``capacity`` tokens is cut into full pieces and a rest; no other text is
    cut. Texts without tokens, and null ids, need no room and are in no container; a repeated
    doc_id counts once (its longest text); extra columns are ignored.
    """
    sizes = cut_lineage(token_counts(documents, vocabulary).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0"))
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") - whole * capacity
    full = F.lit(capacity).cast("bigint")
    cut = sizes.where(whole > 0).select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    rows = cut.select(F.concat(F.lit("f-"), F.col("doc_id"), F.lit("-"), F.col("piece")).alias("container"), "doc_id", "piece", full.alias("tokens"), full.alias("container_tokens"))
    left, level = sizes.where(rest > 0).select("doc_id", whole.alias("piece"), rest.alias("tokens")), 0
    count = left.count()
    while count:
        shards = -(-count // SHARD)  # a shard never outgrows its bound, however many items stay in open bins
        packed = cut_lineage(pack(left, shards, capacity, level))
        named = packed.select(F.concat_ws("-", F.lit(f"l{level}"), "shard", "bin").alias("container"), "doc_id", "piece", "tokens", F.col("fill").alias("container_tokens"))
        is_open = F.col("container_tokens") < F.lit(FULL * capacity)
        still = named.where(is_open).count()
        if shards == 1 or still > (1 - GAIN) * count:
            rows = rows.unionByName(named)
            break
        rows = rows.unionByName(named.where(~is_open))
        left, level, count = named.where(is_open).select("doc_id", "piece", "tokens"), level + 1, still
    start = (F.col("piece") * capacity).cast("bigint").alias("token_start")
    return rows.select("container", "doc_id", "piece", start, "tokens", "container_tokens", F.round(F.col("container_tokens") / capacity, 6).alias("fill"))
