"""Exact n-gram Jaccard join in metric space: pivots create regions, windows replicate boundary documents, regions join
recursively.

Jaccard distance is a metric on finite sets of word shingles; sets link within distance e = 1 - percent / 100.

1. Regions. Pivots are the sets of a single shingle. A set S has distance 1 - 1/|S| to {s} if it holds s, else 1, so its
   nearest pivots are its own shingles, and a total order on shingles (frequent ones last) breaks the ties. A set
   within distance e of S shares a shingle among the first |S| - ceil((1-e)|S|) + 1 of either one's order; these are the
   regions into whose windows a set is replicated. A pair must meet in the region of its first shared pivot, and what
   both sets have from there on bounds their intersection. Whole documents as pivots don't part a corpus: almost all
   pairs have a distance near 1, so every window would hold everything; inside a region they do.
2. Document pivots. The most central document of each region is its pivot. Each document is measured against the pivot
   it shares most regions with: exact distances within e are links, and most of a region is one component then.
3. Documents of one component need no comparison, nor do regions of one component. Small regions compare all pairs that
   may link. In a large region first the most central documents are pivots for those outside its largest component; then all documents outside its largest component become pivots, which meet the whole region, and
   the region is done; if there are too many of them, some are pivots of Voronoi cells: by exact Jaccard distances a document
   goes to the cell of its nearest pivot, and by the triangle inequality to every cell whose pivot is at most 2e further
   away. Cells are regions of the next round. A region that its pivots don't part stays whole, without the pivots that it has met,
   and takes more of them each round, so the recursion ends.

Sets that are equal are collapsed first. All counts cover all documents. No cap applies to regions or partners.
Shingles are 64-bit hashes. `HEAVY` bounds only how many frequent shingles get a place at the end of the order (any
order is exact).

Defined results: ids are numbers, a null id counts as -1; null text counts as empty; a text without words is linked with
nothing; a text of fewer words than a shingle is one shingle of all its words; rows that share an id are documents of their
own, each with its own set; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, forget_tables, gathered, lower_ascii, prefix_hash, sequence_hash, span_hash, text_chunks, word_spans
from .components import components

#: At most so many frequent shingles are moved to the end of the order.
HEAVY = 1 << 16
#: Shingles counted at a time; one in at least 8 and 0.1 % of the documents of such a block is a frequent one there.
BLOCK = 1 << 21
#: Regions of at most `ALL` documents join all pairs that may link, those of at most `SMALL` compare them in a block; larger
#: ones use at most `FIRST` documents as pivots at first, and `PIVOTS` of these as pivots of cells.
ALL = 32
SMALL = 256
FIRST = 512
PIVOTS = 16
#: Least number of classes of the shingle hash in a signature; a power of two.
CLASSES = 1024


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in text_chunks(column):
        data = lower_ascii(data)
        starts, ends, owner = word_spans(data, offsets)
        hashes = span_hash(prefix_hash(data), starts, ends)
        grams = sequence_hash(hashes, words)
        inside = owner[: len(grams)] == owner[words - 1 :] if len(grams) else np.zeros(0, bool)
        grams, gram_owner = grams[inside], owner[: len(grams)][inside]
        word_at = np.searchsorted(owner, np.arange(end - first + 1))
        gram_at = np.searchsorted(gram_owner, np.arange(end - first + 1))
        for i in range(end - first):
            n = word_at[i + 1] - word_at[i]
            if n >= words:
                yield np.unique(grams[gram_at[i] : gram_at[i + 1]])
            else:
                yield sequence_hash(hashes[word_at[i] : word_at[i + 1]], int(n)) if n else np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> bytes:
    """For each class of the shingle hash, one bit: whether the set has an odd number of shingles in it.

    A shingle that only one of two sets has changes one bit, so the bits that differ are a metric that never exceeds the
    symmetric difference. There are as many classes as shingles or more.
    """
    classes = max(CLASSES, 1 << len(s).bit_length())
    return np.packbits(np.bincount((s & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).tobytes()


def _folded(signature: bytes, size: int) -> bytes:
    """The signature over fewer classes, `size` bytes of them; numbers of classes are powers of two."""
    value = np.frombuffer(signature, np.uint8)
    return np.bitwise_xor.reduce(value.reshape(-1, size), axis=0).tobytes() if len(value) > size else signature


def _apart(x: bytes, y: bytes) -> int:
    """Lower bound of the symmetric difference of two sets: how many bits of their signatures differ."""
    size = min(len(x), len(y))
    return (int.from_bytes(_folded(x, size)) ^ int.from_bytes(_folded(y, size))).bit_count()


#: The signature over the fewest classes as columns of 64 bits each.
_BITS = [f"s{i}" for i in range(CLASSES // 64)]


def _described(source: DataFrame, words: int) -> DataFrame:
    """Per document its number of shingles, a key of its set, and its signature, whole and over the fewest classes; and
    rows (s, often) of frequent shingles.

    A shingle that is in 0.1 % of all documents is so in some block of documents, and is found there.
    """
    names = ["doc_id", "n", "key", "signature", "s", "often", *_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        held: list[np.ndarray] = []
        size = 0

        def found() -> pa.RecordBatch:
            values, count = np.unique(np.concatenate(held), return_counts=True)
            much = count >= max(8, len(held) // 1000)
            m = int(much.sum())
            nothing = [pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(values[much].view(np.int64)), pa.array(count[much].astype(np.int64)), *[pa.nulls(m, pa.int64())] * len(_BITS)], names=names)

        for batch in batches:
            n, keys, signatures = [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signatures.append(_signature(s))
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield found()
                    held, size = [], 0
            m = batch.num_rows
            bits = np.frombuffer(b"".join(_folded(x, CLASSES // 8) for x in signatures), np.int64).reshape(m, -1)
            columns = [batch.column(0), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if held:
            yield found()

    return source.mapInArrow(run, "doc_id long, n int, key binary, signature binary, s long, often long, " + ", ".join(f"{x} long" for x in _BITS))


def _windows(source: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(region, rep, n, rest, common): the shingle pivots into whose windows each document goes, in the order of pivots.

    n: size of the set; rest: how many of its shingles a set has from the pivot on; negative where the set isn't at home.
    common: the pivot is a frequent shingle.
    """
    # `frequent` has the rarest first; rank: the place there of each one in hash order
    by_hash, rank = np.sort(frequent), np.argsort(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            regions, rests, lights, lengths, sizes = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                m = len(s)
                window = m - (percent * m + 99) // 100 + 1 if m else 0
                if len(by_hash):
                    at = np.minimum(np.searchsorted(by_hash, s), len(by_hash) - 1)
                    often = by_hash[at] == s
                    first, last = s[~often], at[often]
                else:
                    first, last = s, None
                light = min(len(first), window)
                chosen = first[:light]
                if light < window:
                    chosen = np.concatenate([chosen, by_hash[last[np.argsort(rank[last])][: window - light]]])
                rest = m - np.arange(len(chosen))
                regions.append(chosen)
                rests.append(np.where((100 + percent) * rest >= 2 * percent * m, rest, -rest))
                lights.append(np.arange(len(chosen)) >= light)
                lengths.append(len(chosen))
                sizes.append(m)
            rep = batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(regions).view(np.int64)), rep, pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(np.concatenate(rests).astype(np.int32)), pa.array(np.concatenate(lights))],
                names=["region", "rep", "n", "rest", "common"],
            )

    return source.mapInArrow(run, "region long, rep long, n int, rest int, common boolean")


def _sets(source: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets)))], names=["rep", "items"])

    return source.mapInArrow(run, "rep long, items array<long>")


def _measured(pairs: DataFrame, n: int, source: DataFrame, words: int) -> DataFrame:
    """(a, b, shared, either) of each of the `n` pairs: sizes of the intersection and of the union.

    Sets are made again from the texts of the documents that are in pairs; all other texts stay where they are.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = durable(_sets(source.join(broadcast_if_small(ids, n, 32), F.col("doc_id") == F.col("rep"), "left_semi"), words))
    left, right = (sets.select(F.col("rep").alias(side), F.col("items").alias(items)) for side, items in (("a", "x"), ("b", "y")))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    measured = joined.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
    return measured.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("either"))


def _near_enough(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that may link by their signatures: of sets that link, the symmetric difference is at most
    (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    left = marks.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("signature").alias("sa"))
    right = marks.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("signature").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.array([_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * apart <= (100 - percent) * sizes))

    return both.select("a", "b", "an", "bn", "sa", "sb").mapInArrow(run, "a long, b long")


def _own_ids(source: DataFrame, known: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """`source` and `known` with ids of their own for rows that share an id; and the ids that these had (doc_id, was)."""
    odd = durable(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    n = odd.count()
    if not n:
        return source, known, None
    odd = broadcast_if_small(odd, n, 16)
    # written once: the ids must be the same in every pass
    own = F.lit(-(1 << 63)) + F.monotonically_increasing_id()
    apart = durable(source.join(odd, "doc_id", "left_semi").select(own.alias("own"), "doc_id", "text"))
    texts = apart.select(F.col("own").alias("doc_id"), "text")
    again = durable(_described(texts, words).where("s IS NULL").select(*known.columns))
    return source.join(odd, "doc_id", "left_anti").unionByName(texts), known.join(odd, "doc_id", "left_anti").unionByName(again), apart.select(F.col("own").alias("doc_id"), F.col("doc_id").alias("was"))


class _Links:
    """The components that the links found so far make."""

    def __init__(self, source: DataFrame, marks: DataFrame, words: int, percent: int) -> None:
        self.source, self.marks, self.words, self.percent = source, marks, words, percent
        self.comps: DataFrame | None = None
        self.nodes = 0

    def measure(self, pairs: DataFrame) -> None:
        """Measure pairs (a, b) and keep those that link."""
        close = durable(_near_enough(pairs, self.marks, self.percent))
        n = close.count()
        if not n:
            return
        self.link(_measured(close, n, self.source, self.words).where(f"100 * shared >= {self.percent} * either").select("a", "b"), n)

    def link(self, found: DataFrame, most: int | None = None) -> None:
        """Join the components that the new links (a, b) connect, of which there are `most` at most. Links inside a component change
        nothing, and those found before are in the components already, so each link is followed once only.
        """
        new = self.label(self.label(found, "a").withColumnRenamed("comp", "ca"), "b").where("ca <> comp").select(F.least("ca", "comp").alias("a"), F.greatest("ca", "comp").alias("b")).distinct()
        new = durable(new if most is None else gathered(new, most))
        n = new.count()
        if not n:
            return
        joined = components(new)
        if self.comps is None:
            self.comps = joined
        else:
            moved = broadcast_if_small(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), 2 * n, 16)
            known = self.comps.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            # a component is one of its own nodes, so what is no node yet was a document by itself
            before = broadcast_if_small(self.comps.select("node"), self.nodes, 16)
            self.comps = durable(gathered(known.unionByName(joined.join(before, "node", "left_anti").select("node", "comp")), self.nodes + 2 * n))
        self.nodes = self.comps.count()

    def settle(self, pairs: DataFrame) -> None:
        """Find the components that pairs (a, b, apart) make: each document's nearest one is measured first, as most others
        are inside one component then, and those that aren't afterwards.
        """
        left = durable(pairs.groupBy("a", "b").agg(F.min("apart").alias("apart")))
        if left.limit(1).count():
            near = left.select(F.explode(F.array("a", "b")).alias("one"), F.struct("apart", "a", "b").alias("pair")).groupBy("one").agg(F.min("pair").alias("pair"))
            near = durable(near.select("pair.a", "pair.b").distinct())
            self.measure(near)
            rest = left.join(broadcast_if_small(near, near.count(), 32), ["a", "b"], "left_anti")
            rest = self.label(self.label(rest, "a").withColumnRenamed("comp", "ca"), "b").where("ca <> comp")
            self.measure(rest.select("a", "b"))

    def label(self, df: DataFrame, column: str = "rep") -> DataFrame:
        """`df` with column comp: the component of `column`."""
        if self.comps is None:
            return df.withColumn("comp", F.col(column))
        names = broadcast_if_small(self.comps.withColumnRenamed("node", column).withColumnRenamed("comp", "found"), self.nodes, 32)
        return df.join(names, column, "left").withColumn("comp", F.coalesce("found", column)).drop("found")


def _met(live: DataFrame, others: DataFrame, percent: int, bits: list[str]) -> DataFrame:
    """(a, b, apart) of the pairs of a document and another one of its region that may link and are in different components.

    apart: how many of the signature's `bits` columns' bits differ, a lower bound of the symmetric difference.
    """
    other = others.select("region", *(F.col(x).alias(f"p_{x}") for x in ("rep", "n", "rest", "comp", "home", *bits)))
    met = live.select("region", "rep", "n", "rest", "comp", "home", *bits).join(other, "region")
    apart = F.expr(" + ".join(["0", *(f"bit_count({x} ^ p_{x})" for x in bits)]))
    may_link = F.expr(f"rep <> p_rep AND comp <> p_comp AND (home OR p_home) AND (100 + {percent}) * least(rest, p_rest) >= {percent} * (n + p_n)")
    met = met.where(may_link & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("p_n"))))
    return met.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b"), apart.alias("apart"))


def _block_pairs(heads: DataFrame, others: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b) of the pairs of a head and another document of its block that `_met` would give; with `forest` as many of them as
    join what all of them would join, the least apart first: fewer than the block has components.

    Both have region, block, rep, n, rest, comp, home and the bits. A block has some `SMALL` others, and heads come in lots.
    """
    columns = ["region", "block", "rep", "n", "rest", "comp", "home", *_BITS]
    both = heads.select(*columns, F.lit(True).alias("head")).unionByName(others.select(*columns, F.lit(False).alias("head")))

    def run(block: pa.Table) -> pa.Table:
        rep, n, rest, comp = (block[x].to_numpy().astype(np.int64) for x in ("rep", "n", "rest", "comp"))
        home, head = (block[x].to_numpy() for x in ("home", "head"))
        bits = np.stack([block[x].to_numpy() for x in _BITS]).view(np.uint64)  # of signed numbers the absolute value's bits are counted
        other, x, y, weight = np.flatnonzero(~head), [], [], []
        for lot in np.split(at := np.flatnonzero(head), range(SMALL, len(at), SMALL)):
            i, j = lot[:, None], other[None, :]
            sizes = n[i] + n[j]
            may = (comp[i] != comp[j]) & (home[i] | home[j]) & ((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * sizes)
            if not may.any():
                continue
            apart = np.zeros(may.shape, np.int64)
            for word in bits:
                apart += np.bitwise_count(word[i] ^ word[j])
            one, two = np.nonzero(may & ((100 + percent) * apart <= (100 - percent) * sizes))
            x.append(lot[one]), y.append(other[two]), weight.append(apart[one, two])
        if not x:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.argsort(np.concatenate(weight), kind="stable")
        x, y = np.concatenate(x)[order], np.concatenate(y)[order]
        if forest:
            chosen = _spanning(comp[x], comp[y])
            x, y = x[chosen], y[chosen]
        return pa.table({"a": np.minimum(rep[x], rep[y]), "b": np.maximum(rep[x], rep[y])})

    return both.groupBy("region", "block").applyInArrow(run, "a long, b long")


def _spanning(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the edges (x, y) that make a minimal spanning forest, where the edges rise by weight (Boruvka's method)."""
    names, ends = np.unique(np.stack([x, y]), return_inverse=True)
    (x, y), name = ends.reshape(2, -1), np.arange(len(names))
    at, out = np.arange(len(x)), []
    while True:
        apart = name[x[at]] != name[y[at]]
        at = at[apart]
        if not len(at):
            return np.sort(np.array(out, dtype=np.int64))
        # each component's least edge
        _, first = np.unique(np.stack([name[x[at]], name[y[at]]], axis=1).ravel(), return_index=True)
        for k in np.unique(first // 2):
            p, q = name[x[at[k]]], name[y[at[k]]]
            if p != q:
                out.append(int(at[k]))
                name[name == q] = p


def _live(regions: DataFrame, links: _Links, bits: DataFrame) -> DataFrame:
    """The documents of the regions that hold several components, with their component, signature and m, the region's size."""
    live = links.label(regions)
    state = live.groupBy("region").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("home").alias("any_home")).where("lo < hi AND any_home")
    return durable(live.join(state.select("region", "m"), "region").join(bits, "rep"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Documents link when 100 * shared >= percent * union of their shingle sets; component_id is the smallest id reachable.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text_col).alias("text"))
    described = durable(_described(source, words))
    counted = described.where("s IS NOT NULL").groupBy("s").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "s").limit(HEAVY).select("s").collect()
    frequent = np.array([r["s"] for r in reversed(counted)], dtype=np.int64).view(np.uint64)
    source, known, was = _own_ids(source, described.where("s IS NULL").select("doc_id", "n", "key", "signature", *_BITS), words)

    # equal sets are one class; its smallest id stands for it
    classes = known.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = durable(classes.select("key", "rep"))
    final = known.select("doc_id", "n", "key").join(broadcast_if_small(classes, classes.count(), 64), "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    copies = durable(final.where("doc_id <> rep").select("doc_id"))
    alone = source.join(broadcast_if_small(copies, copies.count(), 16), "doc_id", "left_anti")

    # regions of one document are dropped; those of frequent shingles are spread over tasks here and looked at below
    spread = F.when(F.col("common"), F.pmod(F.xxhash64("rep"), F.lit(256))).otherwise(F.lit(0))
    region = Window.partitionBy("region", "part")
    rows = _windows(alone, words, percent, frequent).withColumn("part", spread).withColumn("m", F.count("*").over(region)).withColumn("most", F.max("rest").over(region))
    rows = durable(rows.where("common OR (m > 1 AND most > 0)").select("region", "rep", "n", F.abs("rest").alias("rest"), (F.col("rest") > 0).alias("home"), "common"))
    if len(frequent):
        peopled = rows.where("common").groupBy("region").agg(F.count("*").alias("m"), F.max("home").alias("any_home")).where("m > 1 AND any_home").select("region")
        rows = rows.where("NOT common").unionByName(rows.where("common").join(F.broadcast(peopled), "region", "left_semi"))
    rows = rows.drop("common")
    # those that share most of their pivots are the most central ones of their neighbourhood
    met = durable(rows.groupBy("rep").agg(F.count("*").alias("met"), F.max("n").alias("n")).select("rep", (-F.col("met") / F.col("n")).alias("rare")))
    n_meet = met.count()
    if not n_meet:
        return _named(final.withColumn("comp", F.col("rep")), was)
    marks = durable(known.join(broadcast_if_small(met.select("rep"), n_meet, 16), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "n", "signature", *_BITS))
    size = marks.agg(F.sum(F.length("signature") + 48)).first()[0] or 0
    links = _Links(source, broadcast_if_small(marks.drop(*_BITS), size, 1), words, percent)
    bits = broadcast_if_small(marks.select("rep", *_BITS), n_meet, 96)
    regions = rows.join(broadcast_if_small(met, n_meet, 24), "rep")

    heads = regions.groupBy("region").agg(F.min(F.struct("rare", "rep", "n", "rest", "home")).alias("head")).select("region", "head.*").withColumn("comp", F.col("rep"))
    stars = durable(_met(rows.withColumn("comp", F.col("rep")), heads, percent, []).groupBy("a", "b").agg(F.count("*").alias("regions")))
    # each document's pivot is the one that it shares most regions with
    own = stars.select(F.explode(F.array("a", "b")).alias("one"), F.struct("regions", "a", "b").alias("pair")).groupBy("one").agg(F.max("pair").alias("pair"))
    links.measure(own.select("pair.a", "pair.b").distinct())

    live = _live(regions, links, bits)
    few = live.where(f"m <= {ALL}")
    links.settle(_met(few, few, percent, _BITS))
    regions, most, first = live.where(f"m > {ALL}").drop("comp", "m", *_BITS), FIRST, True
    while True:
        live = _live(regions, links, bits)
        if not live.limit(1).count():
            break
        few, large = live.where(f"m <= {SMALL}"), live.where(f"m > {SMALL}")
        # some central pivots first: what links at all mostly links to one of them
        central = large.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy("rare", "rep"))).where(f"k <= {PIVOTS}")
        links.measure(_met(large, central, percent, _BITS).select("a", "b").distinct())
        large = links.label(large.drop("comp"))
        sizes = large.groupBy("region", "comp").agg(F.count("*").alias("size")).groupBy("region").agg(F.max(F.struct("size", "comp")).alias("largest"), F.sum("size").alias("m"))
        sizes = durable(sizes.select("region", F.col("largest.comp").alias("main"), (F.col("m") - F.col("largest.size") > most).alias("deep"), F.ceil(F.col("m") / SMALL).alias("blocks")))
        sizes = broadcast_if_small(sizes, sizes.count(), 32)
        order = Window.partitionBy("region").orderBy("rare", "rep")
        heads = large.drop("m").join(sizes, "region").where("comp <> main").withColumn("k", F.row_number().over(order)).where(f"k <= {most}")
        heads = durable(heads)
        # every document outside the largest component meets the blocks of its region; those of a small one are a block
        few = few.withColumn("block", F.lit(0).cast("long"))
        others = large.join(sizes.select("region", "blocks"), "region").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
        meeting = heads.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        columns = ["region", "block", "rep", "n", "rest", "home", *_BITS]
        meeting, others = (x.select(*columns).unionByName(few.select(*columns)) for x in (meeting, others))
        for forest in (True, False):  # what a forest's edges don't link is compared whole
            links.measure(_block_pairs(links.label(meeting), links.label(others), percent, forest).distinct())
        left = large.drop("comp", "m", *_BITS).join(sizes.where("deep").select("region"), "region").join(heads.select("region", "rep"), ["region", "rep"], "left_anti")
        left = durable(left)
        if not left.limit(1).count():
            break
        # at first mostly few are outside the largest component now
        regions = left if first else _cells(left, heads.where(f"deep AND k <= {PIVOTS}"), source, words, percent)
        most, first = most * 8, False
    return _named(links.label(final), was)


def _named(final: DataFrame, was: DataFrame | None) -> DataFrame:
    """doc_id, n_shingles, component_id from rows with comp."""
    if was is None:
        return final.select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    final = final.join(was, "doc_id", "left").select(F.coalesce("was", "doc_id").alias("doc_id"), "n_shingles", "comp")
    least = final.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return final.join(least, "comp").select("doc_id", "n_shingles", "component_id")


def _cells(left: DataFrame, pivots: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """The documents of each region dealt to the cells of its pivots by exact distances; a region that its pivots don't part stays whole."""
    columns = ["rep", "n", "rest", "home", "rare"]
    dealt = left.join(pivots.select("region", F.col("rep").alias("p")), "region").withColumn("a", F.least("rep", "p")).withColumn("b", F.greatest("rep", "p"))
    pairs = durable(dealt.select("a", "b").distinct())
    distances = _measured(pairs, pairs.count(), source, words).select("a", "b", (1 - F.col("shared") / F.col("either")).alias("d"))
    dealt = durable(dealt.join(distances, ["a", "b"]).select("region", *columns, "p", "d"))
    nearest = dealt.groupBy("region", "rep").agg(F.min(F.struct("d", "p")).alias("near"))
    # 2e further away at most; the rest allows for rounding
    dealt = dealt.join(nearest, ["region", "rep"]).where(F.col("d") <= F.col("near.d") + 2 * (100 - percent) / 100 + 1e-9)
    dealt = durable(dealt.withColumn("home", F.col("home") & (F.col("p") == F.col("near.p"))).withColumn("nearest", F.col("p") == F.col("near.p")).select("region", *columns, "nearest", F.xxhash64("region", "p").alias("cell")))
    parted = dealt.groupBy("region").agg((F.count("*") <= 2 * F.sum(F.col("nearest").cast("int"))).alias("parted")).where("parted").select("region")
    cells = dealt.join(parted, "region").select(F.col("cell").alias("region"), *columns)
    return durable(cells.unionByName(left.join(parted, "region", "left_anti").select("region", *columns)))
