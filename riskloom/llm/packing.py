"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces (tokenized once, only their lengths are kept); pieces of full length are sequences of their
own. The others are dealt by hash to subproblems of about `ITEMS` pieces. For each one, several islands evolve
populations of packings: crossover injects whole well-filled bins of another parent and removes the bins that hold a piece
twice; mutation dissolves the worst bins. The displaced pieces first replace pieces of bins that get fuller so, and best fit
places the others. Between epochs each island's elite migrates to its neighbour. Full bins and the better-filled half of
each subproblem's bins are final; the pieces of the others go to the next level's fewer subproblems, until one is left.
So the loss doesn't grow with the number of subproblems.

Every group has a bounded size at any scale, and only lengths, ids and places are shuffled. All randomness is seeded by the
subproblem, so a lost task gives the same result again.

Defined results: null text counts as empty (one end token); rows that repeat an id are packed separately; an empty table gives
no sequences.
"""

from __future__ import annotations

import zlib
from bisect import insort_right
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .token_ids import default_path, encoder, text_parts

LENGTH = 1024
END_ID = 2
ITEMS = 3000
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 4


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut into pieces of `length`; the first may be shorter."""
    path = path or default_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_parts(whole)):
            ids, offsets = encoder(path).encode(batch.column(1))
            of, number, start, size, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                at, k, cut = 0, 0, len(own) % length or length
                while at < len(own):
                    of.append(i), number.append(k), start.append(at), size.append(cut - at)
                    crc.append(zlib.crc32(own[at:cut].tobytes()))
                    at, k, cut = cut, k + 1, cut + length
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space: a bit mask of the free spaces that occur finds the tightest fit in one step."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.by_free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, members: list[int], free: int) -> None:
        self.by_free[free].append(members)
        self.mask |= 1 << free

    def fit(self, item: int) -> None:
        size = self.sizes[item]
        above = self.mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            members = self.by_free[free].pop()
            if not self.by_free[free]:
                self.mask ^= 1 << free
        else:
            members, free = [], self.capacity
        members.append(item)
        self.add(members, free - size)

    def all(self) -> list[list[int]]:
        return [members for same in self.by_free for members in same]


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """`bins` with `items` added, the largest first, each to the fullest bin that takes it."""
    found = Bins(sizes, capacity)
    for members in bins:
        found.add(list(members), capacity - sum(map(sizes.__getitem__, members)))
    for item in sorted(items, key=sizes.__getitem__, reverse=True):
        found.fit(item)
    return found.all()


@lru_cache(maxsize=None)
def _choices(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """What may give way of a bin's `n` pieces: one, or two if they are few; and the places of both of these."""
    pairs = [(a, b) for b in range(n) for a in range(b)] if n < 12 else []
    return [(k,) for k in range(n)] + pairs, np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)


def replaced(sizes: list[int], loose: list[int], bins: list[list[int]], capacity: int) -> tuple[list[list[int]], list[int]]:
    """`bins` filled better by pieces of `loose`, and what is loose then.

    One piece of a bin that isn't full gives way to one or two loose ones, or two pieces to one, where the bin is
    fuller afterwards. What comes loose is smaller in sum than what went in.
    """
    size = sizes.__getitem__
    loose = sorted(loose, key=size)
    have = np.array([sizes[i] for i in loose], dtype=np.int64)
    out = []
    for members in bins:
        free = capacity - sum(map(size, members))
        for _ in range(len(members)):
            if not free or not len(have):
                break
            own = list(map(size, members))
            # the best loose piece for each of the bin's, and for each two of them
            gone, one, two = _choices(len(own))
            weight = np.array(own, dtype=np.int64)
            weight = np.concatenate([weight, weight[one] + weight[two]])
            at = have.searchsorted(weight + free, side="right") - 1
            gain = np.where(at >= 0, have[np.maximum(at, 0)] - weight, 0)
            best = int(gain.argmax())
            taken = [int(at[best])] if gain[best] > 0 else []
            most = int(gain[best])
            if most < free and len(have) > 1:
                before = np.arange(len(have)) - 1
                for k, w in enumerate(own):
                    if most == free:  # nothing is better than a full bin
                        break
                    # the larger one of two that are better, and all that a smaller one fits beside
                    low = max(1, int(have.searchsorted((w + most) // 2, side="right")))
                    high = int(have.searchsorted(w + free - have[0], side="right"))
                    if low >= high:
                        continue
                    second = np.minimum(have.searchsorted(w + free - have[low:high], side="right") - 1, before[low:high])
                    sums = have[low:high] + have[second]
                    one = int(sums.argmax())
                    if sums[one] - w > most:
                        most, best, taken = int(sums[one]) - w, k, [int(second[one]), one + low]
            if not taken:
                break
            out_of = [members[k] for k in gone[best]]
            members = [i for i in members if i not in out_of] + [loose[k] for k in taken]
            for k in sorted(taken, reverse=True):
                del loose[k]
            for i in out_of:
                insort_right(loose, i, key=size)
            have = np.fromiter(map(size, loose), np.int64, len(loose))
            free -= most
        out.append(members)
    return out, loose


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, int]:
    """Fewer bins are better; among equally many, the more uneven filling."""
    return -len(bins), sum(sum(map(sizes.__getitem__, b)) ** 2 for b in bins)


def crossover(sizes: list[int], into: list[list[int]], other: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """`into` with some well-filled bins of `other` injected; bins that share a piece with them dissolve, and best fit places the displaced pieces."""
    good = [b for b in other if sum(map(sizes.__getitem__, b)) >= capacity - 8]
    if not good:
        good = sorted(other, key=lambda b: -sum(map(sizes.__getitem__, b)))[: max(1, len(other) // 4)]
    chosen = [good[i] for i in rng.permutation(len(good))[: max(1, len(good) // 3)]]
    taken = {i for b in chosen for i in b}
    kept, loose = list(chosen), []
    for b in into:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            loose += [i for i in b if i not in taken]
    kept, loose = replaced(sizes, loose, kept, capacity)
    return best_fit(sizes, loose, kept, capacity)


def mutate(sizes: list[int], bins: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The worst-filled bins and a few others dissolve, and best fit places their pieces anew."""
    order = sorted(bins, key=lambda b: sum(map(sizes.__getitem__, b)))
    worst = max(1, len(order) // 20)
    more = set((worst + rng.permutation(max(len(order) - worst, 0))[: max(1, len(order) // 20)]).tolist())
    loose = [i for k, b in enumerate(order) if k < worst or k in more for i in b]
    kept, loose = replaced(sizes, loose, [b for k, b in enumerate(order) if k >= worst and k not in more], capacity)
    return best_fit(sizes, loose, kept, capacity)


def evolve(sizes: list[int], elites: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing after some generations from `elites` and random best-fit packings; stops at the lower bound."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    ranked = lambda bins: (fitness(sizes, bins, capacity), bins)
    people = list(elites) or [best_fit(sizes, list(range(len(sizes))), [], capacity)]
    while len(people) < population:
        people.append(mutate(sizes, people[0], capacity, rng))
    people = sorted(map(ranked, people), key=itemgetter(0), reverse=True)
    for _ in range(generations):
        if len(people[0][1]) <= least:
            break
        a, b = sorted(rng.permutation(len(people))[:2].tolist())
        children = [crossover(sizes, people[a][1], people[b][1], capacity, rng), mutate(sizes, people[0][1], capacity, rng)]
        people = sorted([*people, *map(ranked, children)], key=itemgetter(0), reverse=True)[:population]
    return people[0][1]


def _as_numbers(bins: list[list[int]], n: int) -> np.ndarray:
    number = np.zeros(n, dtype=np.int32)
    for k, members in enumerate(bins):
        number[members] = k
    return number


def _as_bins(number: np.ndarray) -> list[list[int]]:
    order = np.argsort(number, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(number[order])) + 1)]


def _level(items: DataFrame, subproblems: int, level: int, capacity: int) -> DataFrame:
    """pid, sequence_id (the smallest pid of its bin), offset, free, late (whether its bin is in the worse-filled half of the
    subproblem's), length: the best packing of each subproblem."""
    group = F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(subproblems))
    groups = items.groupBy(group.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pid", "length"))).alias("items"))
    state = groups.select("part", F.col("items.pid").alias("pids"), F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = state.withColumn("elites", F.lit(None).cast("array<array<int>>"))
    columns = "part long, pids array<long>, sizes array<long>, island int, elite array<int>"

    def epoch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = []
            for row in frame.itertuples():
                sizes = [int(x) for x in row.sizes]
                elites = [_as_bins(np.asarray(x)) for x in row.elites] if row.elites is not None else []
                best.append(_as_numbers(evolve(sizes, elites, capacity, int(row.part) * 1009 + int(row.island) * 31 + level + 7 * len(elites)), len(sizes)))
            yield pd.DataFrame({"part": frame["part"], "pids": frame["pids"], "sizes": frame["sizes"], "island": frame["island"], "elite": best})

    for _ in range(EPOCHS):
        # each row is seconds of work: spread them, whatever Spark thinks of their bytes
        spread = state.repartition(max(1, min(subproblems * ISLANDS, 2000)), "part", "island")
        evolved = durable(spread.mapInPandas(epoch, columns))
        own = evolved.select("part", "pids", "sizes", "island", F.col("elite").alias("mine"))
        guest = evolved.select("part", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("elite").alias("guest"))
        state = own.join(guest, ["part", "island"]).select("part", "pids", "sizes", "island", F.array("mine", "guest").alias("elites"))

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                sizes = [int(x) for x in row.sizes]
                best = max((_as_bins(np.asarray(e)) for e in row.all), key=lambda b: fitness(sizes, b, capacity))
                pid, of, place, free, late = [], [], [], [], []
                best.sort(key=lambda b: -sum(sizes[i] for i in b))
                for rank, members in enumerate(best):
                    at, name = 0, min(int(row.pids[i]) for i in members)
                    for i in members:
                        pid.append(int(row.pids[i])), of.append(name), place.append(at)
                        at += sizes[i]
                    free += [capacity - at] * len(members)
                    late += [2 * rank >= len(best) + 1] * len(members)
                yield pd.DataFrame({"pid": pid, "sequence_id": of, "offset": place, "free": free, "late": late, "length": [sizes[i] for members in best for i in members]})

    last = evolved.groupBy("part").agg(F.first("pids").alias("pids"), F.first("sizes").alias("sizes"), F.collect_list("elite").alias("all"))
    return durable(last.mapInPandas(bins, "pid long, sequence_id long, offset long, free long, late boolean, length long"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cut = durable(pieces(docs, path, length, end_id, id_col, text_col).withColumn("pid", F.monotonically_increasing_id()))
    items = cut.where(F.col("length") < length).select("pid", "length")
    whole = cut.where(F.col("length") == length).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed, level = [whole], 0
    while n := items.count():
        subproblems = -(-n // ITEMS)
        found = _level(items, subproblems, level, length)
        if subproblems == 1:
            placed.append(found.select("pid", "sequence_id", "offset"))
            break
        # bins with space in the worse-filled half go on: half of the pieces at most
        loose = (F.col("free") > 0) & F.col("late")
        placed.append(found.where(~loose).select("pid", "sequence_id", "offset"))
        items = found.where(loose).select("pid", "length")
        level += 1
    places = placed[0]
    for more in placed[1:]:
        places = places.unionByName(more)
    return cut.join(places, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
