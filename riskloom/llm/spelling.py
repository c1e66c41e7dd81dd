"""Spelling variants: words within one edit of each other, found in broadcast shards of a compact trie.

1. Words. Runs of letters are counted in each chunk of texts by Arrow's hash tables and summed by Spark.
2. Shards. The vocabulary is range-partitioned; each range becomes tries of at most `SHARD` characters. A trie holds a word only
   as far as it differs from its neighbours; the rest of the word is its tail. Nodes are numbered breadth first in plain
   arrays: a node's children stand together, and an edge is found by binary search.
3. Intersection. Shards are broadcast, at most `WAVE` bytes at a time. For a block of words at once, the states of
   their distance-one Levenshtein automata (node, place in the word, whether the edit is spent) walk down the trie depth first: a stack of
   state blocks, the deepest one first, halved when they get large. Words at accepting nodes or in tails are compared exactly.
4. Forms. Each word's neighbours are counted, and its best one taken, shard by shard; Spark reduces these rows. A form
   has ten times its word's occurrences, so chains are as long as the counts have digits; they are followed by doubling.

Letters are Latin-1, so a word is one byte a character inside tasks.

Defined results: null text counts as empty, a null id as an empty text before the colon; repeated rows count as often as
they occur; a text without letters has no words; ties go to the smallest word; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, durable, lower_ascii, runs, text_chunks

#: Least length of a word in characters and least number of occurrences.
LETTERS, OCCURRENCES = 7, 2
#: A run of letters whose checksum this divides loses a character.
SLIP = 31
#: A form occurs so many times as often as its word.
RATIO = 10
#: Most characters of a trie, bytes of tries broadcast at a time, words of a task, and states of a block; all only bound memory.
SHARD = 4 << 20
WAVE = 32 << 20
TASK = 20_000
STATES = 1 << 18

_LETTER = byte_class(bytes([*range(65, 91), *range(97, 123)]))
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of the spans, each one carrying on from the checksum `before` it."""
    out = np.zeros(len(starts), np.uint32)
    size = ends - starts
    long = np.flatnonzero(size > 64)
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = np.argsort(-size, kind="stable")[len(long) :]
    live = np.searchsorted(-size[order], -np.arange(1, 66), side="right")  # spans that have a byte at each place
    c, s = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF), starts[order]
    for k in range(int(size[order[0]]) if len(order) else 0):
        n = live[k]
        c[:n] = _CRC[(c[:n] ^ data[s[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of every word of `LETTERS` characters and `OCCURRENCES` occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                lead = data == 0xC3  # of U+00C0 to U+00FF
                inside = _LETTER[data] | lead
                inside[1:] |= lead[:-1]
                starts, ends, owner = runs(inside, offsets)
                leads = np.concatenate([[0], np.cumsum(lead)])
                size = ends - starts - (leads[ends] - leads[starts])
                keep = size >= LETTERS
                starts, ends, owner, size = starts[keep], ends[keep], owner[keep], size[keep]
                data = lower_ascii(data)
                before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).slice(first, end - first).to_pylist()], np.uint32)
                h = _checksums(data, starts, ends, before[owner])
                slip = h % SLIP == 0
                changed = []
                for i in np.flatnonzero(slip & (size > LETTERS)).tolist():
                    word, k = data[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(size[i])
                    changed.append(word[:k] + word[k + 1 :])
                starts, ends = starts[~slip], ends[~slip]
                n = ends - starts
                upto = np.concatenate([[0], np.cumsum(n)])
                flat = data[np.repeat(starts - upto[:-1], n) + np.arange(upto[-1])]
                plain = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                counted = pa.concat_arrays([plain, pa.array(changed, pa.string())]).value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {OCCURRENCES}")


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as Latin-1 bytes with two zeros after each: bytes, offsets, lengths."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8), np.concatenate([[0], np.cumsum(size + 2)])[:-1], size


def _common(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many bytes agree from the places xs and ys on (backwards with step -1), at most `most`."""
    out = np.zeros(len(xs), np.int64)
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        if k >= 256:  # few words are that long; each is compared at once
            for i in live.tolist():
                n = int(most[i])
                a, b = (x[xs[i] : xs[i] + n], y[ys[i] : ys[i] + n]) if step > 0 else (x[xs[i] - n + 1 : xs[i] + 1][::-1], y[ys[i] - n + 1 : ys[i] + 1][::-1])
                differ = np.flatnonzero(a != b)
                out[i] = differ[0] if len(differ) else n
            return out
        live = live[x[xs[live] + step * k] == y[ys[live] + step * k]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


class Trie:
    """A compact trie of sorted words: label, depth, first child and word of each node; parents' edges as sorted keys."""

    def __init__(self, words: pa.Array, counts: np.ndarray) -> None:
        self.words, self.counts = words, counts
        self.text, self.offsets, self.size = _latin(words)
        n = len(self.size)
        shared = np.zeros(n + 1, np.int64)
        shared[1:n] = _common(self.text, self.offsets[:-1], self.text, self.offsets[1:], np.minimum(self.size[:-1], self.size[1:]))
        need = np.minimum(self.size, np.maximum(shared[:-1], shared[1:]) + 1)
        edges, depths, at = [np.zeros(0, np.int64)], [np.zeros(1, np.int32)], [np.full(1, -1, np.int32)]
        node, total, d, live = np.zeros(n, np.int64), 1, 1, np.arange(n)
        while len(live):
            new = shared[live] < d
            head = live[new]
            edges.append(node[head] << 8 | self.text[self.offsets[head] + d - 1])
            depths.append(np.full(len(head), d, np.int32))
            node[live] = total + np.cumsum(new) - 1
            word = np.full(len(head), -1, np.int32)
            done = need[live] == d
            word[node[live[done]] - total] = live[done]
            at.append(word)
            total, d = total + len(head), d + 1
            live = live[~done]
        self.edges, self.depth, self.word = np.concatenate(edges), np.concatenate(depths), np.concatenate(at)
        self.first = np.searchsorted(self.edges, np.arange(total + 1) << 8) + 1

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The children by label; 0 where there is none."""
        key = node << 8 | label
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, at + 1, 0)

    def near(self, text: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word of the block, word of the trie) at a distance of exactly one."""
        if not len(self.edges):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = []
        zero = np.zeros(len(size), np.int64)
        stack = [(np.arange(len(size)), zero, zero, np.zeros(len(size), bool))]
        while stack:
            w, node, i, spent = stack.pop()
            if len(w) > STATES:
                half = len(w) // 2
                stack += [tuple(x[:half] for x in (w, node, i, spent)), tuple(x[half:] for x in (w, node, i, spent))]
                continue
            word = self.word[node]
            rest = size[w] - i - (self.size[word] - self.depth[node])
            ends = (word >= 0) & np.where(spent, rest == 0, np.abs(rest) <= 1)
            pairs.append((w[ends], word[ends].astype(np.int64)))
            letter = text[offsets[w] + i].astype(np.int64)
            s = np.flatnonzero(spent)
            c = self.child(node[s], letter[s])
            s, c = s[c > 0], c[c > 0]
            states = [(w[s], c, i[s] + 1, np.ones(len(s), bool))]
            f = np.flatnonzero(~spent)
            n = self.first[node[f] + 1] - self.first[node[f]]
            of = np.repeat(f, n)
            c = np.repeat(self.first[node[f]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            match = self.edges[c - 1] & 255 == letter[of]
            m, o = of[match], of[~match]
            left = o[size[w[o]] > i[o]]
            states.append((w[m], c[match], i[m] + 1, np.zeros(len(m), bool)))
            states.append((w[left], c[~match][size[w[o]] > i[o]], i[left] + 1, np.ones(len(left), bool)))  # replaced
            states.append((w[o], c[~match], i[o], np.ones(len(o), bool)))  # inserted; before an equal letter it is as after it
            f = f[(size[w[f]] > i[f]) & (letter[f] != text[offsets[w[f]] + i[f] + 1])]
            states.append((w[f], node[f], i[f] + 1, np.ones(len(f), bool)))  # deleted
            if any(len(x[0]) for x in states):
                stack.append(tuple(np.concatenate(x) for x in zip(*states)))
        w, x = (np.concatenate(p) for p in zip(*pairs))
        key = np.unique(w * len(self.size) + x)
        w, x = key // len(self.size), key % len(self.size)
        short, long = np.minimum(size[w], self.size[x]), np.maximum(size[w], self.size[x])
        head = _common(text, offsets[w], self.text, self.offsets[x], short)
        tail = _common(text, offsets[w] + size[w] - 1, self.text, self.offsets[x] + self.size[x] - 1, short, -1)
        good = ~((head == short) & (short == long)) & (long - short <= 1) & (head + tail >= long - 1)
        return w[good], x[good]


def _tries(words: DataFrame, ranges: int) -> DataFrame:
    """Shards (bytes) of the vocabulary's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        table = table.take(pc.sort_indices(table, [("word", "ascending")])).combine_chunks()
        upto = np.cumsum(pc.utf8_length(table.column("word")).to_numpy().astype(np.int64))
        a = 0
        while a < len(upto):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SHARD, side="right")))
            part = table.slice(a, b - a).combine_chunks()
            shard = pickle.dumps(Trie(part.column("word").chunk(0), part.column("n").to_numpy()), 5)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.binary())], names=["shard"])
            a = b

    return words.repartitionByRange(ranges, "word").mapInArrow(run, "shard binary")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of the words that have a neighbour: how many, and the most frequent one with its count."""
    spark = words.sparkSession
    total = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("letters")).first()
    shards = durable(_tries(words, max(1, -(-total["letters"] // SHARD))))
    sizes = shards.select(F.input_file_name().alias("file"), F.octet_length("shard").alias("bytes")).groupBy("file").agg(F.sum("bytes").alias("bytes")).orderBy("file").collect()
    waves: list[tuple[int, list[str]]] = []
    for file, size in sizes:
        if waves and waves[-1][0] + size <= WAVE:
            waves[-1] = (waves[-1][0] + size, [*waves[-1][1], file])
        else:
            waves.append((size, [file]))
    asked = durable(words.select("word").repartition(max(1, -(-total["n"] // TASK)), "word"))
    found = None
    for _, files in waves:
        tries = spark.sparkContext.broadcast([bytes(r[0]) for r in shards.where(F.input_file_name().isin(files)).collect()])

        def run(batches: Iterator[pa.RecordBatch], tries=tries) -> Iterator[pa.RecordBatch]:
            loaded = None
            for batch in batches:
                if loaded is None:
                    loaded = [pickle.loads(t) for t in tries.value]
                words = batch.column(0)
                block = _latin(words)
                for trie in loaded:
                    w, x = trie.near(*block)
                    order = np.lexsort((x, -trie.counts[x], w))
                    w, x = w[order], x[order]
                    at = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else w
                    near = np.diff(np.append(at, len(w)))
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(w[at])), pa.array(near), trie.words.take(pa.array(x[at])), pa.array(trie.counts[x[at]])], names=["word", "near", "best", "best_n"])

        one = durable(asked.mapInArrow(run, "word string, near long, best string, best_n long"))
        tries.destroy()
        found = one if found is None else found.unionByName(one)
    if found is None:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit("").alias("form"), F.col("n").alias("form_n")).where("false")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("form"), (-F.col("b.m")).alias("form_n"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = durable(occurrences(docs))
    near = durable(neighbours(words))
    good = F.col("form_n") >= RATIO * F.col("n")
    whole = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    roots = durable(whole.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        roots = moved.select("word", "root")
        if not moved.where("on").limit(1).count():
            break
    return whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
