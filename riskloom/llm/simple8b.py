"""Token-id output in a word-aligned binary format: Simple-8b with escapes and block offsets.

A 64-bit word holds a 4-bit selector and 60 bits of payload. Selectors 2 to 15 pack 60 down to 1 values of equal width;
selectors 0 and 1 stand for 240 and 120 zeros. A value of 60 bits or more is an escape: its place holds 0, and a table of the
block has its position and value. Blocks of at most `BLOCK` values begin at known words, so that they decode
independently: all words of a block that share a selector unpack at once.

Shard file, little-endian: b"S8B1"; the words of all blocks; then the tables: per document int64 id and uint64 count of
values, per block uint64 first word, uint32 words and uint32 values, per escape uint64 position in the shard and uint64 value;
last uint32 counts of documents, blocks and escapes, and b"S8B1" again. So a shard is written and read as a stream of blocks;
only its tables and a few blocks are ever in memory.

`write` deals documents to shards of about `SHARD_BYTES` of text by ranges of the id, in ascending order, and each task
writes its shard under a name of its own attempt before it is renamed, so a repeated task replaces a whole file by an equal one.
Defined results: ids are numbers; null text counts as empty (the end id alone); rows that repeat an id follow each other, in
the order of a hash of the text, then the text, and may fill several shards; a null id comes first and reads back as -1;
further columns of the table don't matter; an empty table gives no shard.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, shared_dir
from .token_ids import default_path, encoder, text_parts

#: Values per word and bits per value of each selector (fixed by the published format).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1 << 14
MAGIC = b"S8B1"
SHARD_BYTES = 16 << 20
#: Values that are encoded, read or digested at a time, but for a longer document.
RUN = 1 << 19
_DOCUMENT = np.dtype([("id", "<i8"), ("count", "<u8")])
_TABLE = np.dtype([("first", "<u8"), ("words", "<u4"), ("values", "<u4")])
_ESCAPE = np.dtype([("at", "<u8"), ("value", "<u8")])


def _encode_block(values: np.ndarray) -> np.ndarray:
    """The words of one block; all values are below 2**60."""
    n = len(values)
    bits = np.zeros(n, dtype=np.int64)
    for w in WIDTHS[2:]:
        bits += values >= (np.uint64(1) << np.uint64(w))
    # bits: how many of the widths from 1 bit on are too narrow; 0 is for values 0 and 1
    need = np.where(values == 0, 0, 2 + bits)
    # selector of the widest word that could begin at each place: the first whose run of values all fit
    best = np.full(n, 15, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)
    running: dict[int, np.ndarray] = {1: need}

    def widest(count: int) -> np.ndarray:
        """Largest need in the next `count` values from each place, by doubling; the block's end counts as fitting nothing."""
        if count not in running:
            half = 1 << ((count - 1).bit_length() - 1)
            part = widest(half)
            shift = count - half
            out = np.full(n, 99, dtype=np.int64)
            if n > shift:
                out[: n - shift] = np.maximum(part[: n - shift], part[shift:])
            running[count] = out
        return running[count]

    for selector in range(16):
        count = int(COUNTS[selector])
        if count > n:
            continue
        largest = widest(count).copy()
        if count > 1:
            largest[n - count + 1 :] = 99
        fits = open_ & (largest <= (0 if selector < 2 else selector))
        best[fits] = selector
        open_ &= ~fits
    steps, at, places = COUNTS[best].tolist(), 0, []
    while at < n:
        places.append(at)
        at += steps[at]
    places = np.array(places)
    selectors = best[places]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        if selector < 2:
            continue
        rows = np.flatnonzero(selectors == selector)
        chunk = values[places[rows][:, None] + np.arange(COUNTS[selector])]
        shifts = (np.arange(COUNTS[selector]) * WIDTHS[selector]).astype(np.uint64)
        words[rows] |= np.bitwise_or.reduce(chunk << shifts, axis=1)
    return words


def _decode_words(words: np.ndarray, n: int) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(max(n, int(ends[-1]) if len(ends) else 0), dtype=np.uint64)
    starts = ends - COUNTS[selectors]
    for selector in np.unique(selectors):
        if selector < 2:
            continue
        rows = np.flatnonzero(selectors == selector)
        shifts = (np.arange(COUNTS[selector]) * WIDTHS[selector]).astype(np.uint64)
        mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
        out[starts[rows][:, None] + np.arange(COUNTS[selector])] = (words[rows][:, None] >> shifts) & mask
    return out[:n]


class ShardWriter:
    """Writes a shard to a binary stream, block by block."""

    def __init__(self, out, block: int = BLOCK) -> None:
        self.out, self.block = out, block
        self.documents, self.blocks, self.escapes = [], [], []
        self.open = np.zeros(0, np.uint64)
        self.values = self.words = 0
        out.write(MAGIC)

    def add(self, ids: np.ndarray, counts: np.ndarray, values: np.ndarray) -> None:
        """Documents `ids`, whose values, `counts` of each, follow one another in `values`."""
        table = np.empty(len(ids), _DOCUMENT)
        table["id"], table["count"] = ids, counts
        self.documents.append(table.tobytes())
        self.open = np.concatenate([self.open, values.astype(np.uint64)])
        whole = len(self.open) // self.block * self.block
        for i in range(0, whole, self.block):
            self._write(self.open[i : i + self.block])
        self.open = self.open[whole:].copy()

    def _write(self, values: np.ndarray) -> None:
        large = np.flatnonzero(values >= np.uint64(1) << np.uint64(60))
        if len(large):
            table = np.empty(len(large), _ESCAPE)
            table["at"], table["value"] = self.values + large, values[large]
            self.escapes.append(table.tobytes())
            values = values.copy()
            values[large] = 0
        words = _encode_block(values)
        self.out.write(words.astype("<u8").tobytes())
        self.blocks.append((self.words, len(words), len(values)))
        self.words += len(words)
        self.values += len(values)

    def close(self) -> None:
        """Writes the last block and the tables; the stream stays open."""
        if len(self.open):
            self._write(self.open)
        documents, escapes = b"".join(self.documents), b"".join(self.escapes)
        self.out.write(documents)
        self.out.write(np.array(self.blocks, _TABLE).tobytes())
        self.out.write(escapes)
        self.out.write(struct.pack("<III", len(documents) // 16, len(self.blocks), len(escapes) // 16) + MAGIC)


class ShardReader:
    """Reads the tables of a shard from a seekable stream, and then its blocks in order."""

    def __init__(self, data, size: int) -> None:
        self.data = data
        data.seek(size - 16)
        *counts, magic = struct.unpack("<III4s", data.read(16))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        n, blocks, escapes = counts
        data.seek(size - 16 - 16 * sum(counts))
        self.documents = np.frombuffer(data.read(16 * n), _DOCUMENT)
        self.blocks = np.frombuffer(data.read(16 * blocks), _TABLE)
        self.escapes = np.frombuffer(data.read(16 * escapes), _ESCAPE)

    def values(self, most: int = RUN) -> Iterator[np.ndarray]:
        """All values in order, about `most` at a time."""
        step, done = max(1, most // BLOCK), 0
        for k in range(0, len(self.blocks), step):
            part = self.blocks[k : k + step]
            first = int(part["first"][0])
            self.data.seek(4 + 8 * first)
            words = np.frombuffer(self.data.read(8 * int(part["words"].sum())), "<u8")
            out = np.concatenate([_decode_words(words[int(b["first"]) - first : int(b["first"]) - first + int(b["words"])], int(b["values"])) for b in part])
            a, b = np.searchsorted(self.escapes["at"], [done, done + len(out)])
            out[self.escapes["at"][a:b].astype(np.int64) - done] = self.escapes["value"][a:b]
            done += len(out)
            yield out

    def runs(self, most: int = RUN) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of whole documents as (first, end, their values), of about `most` values but for a longer document."""
        ends = np.cumsum(self.documents["count"]).astype(np.int64)
        first = done = 0
        held: list[np.ndarray] = []
        size = 0
        for part in self.values(most):
            held.append(part)
            size += len(part)
            end = int(np.searchsorted(ends, done + size, side="right"))
            if end > first:
                joined = np.concatenate(held)
                take = int(ends[end - 1]) - done
                yield first, end, joined[:take]
                held, size = [joined[take:]], len(joined) - take
                first, done = end, done + take
        if first < len(ends):  # documents without values at the end
            yield first, len(ends), np.zeros(0, np.uint64)


def encode_shard(ids: list[int], counts: list[int], values: np.ndarray, block: int = BLOCK) -> bytes:
    """The file of documents `ids` whose values, `counts` of each, follow one another in `values` (uint64)."""
    out = io.BytesIO()
    writer = ShardWriter(out, block)
    writer.add(np.array(ids, np.int64), np.array(counts, np.int64), values)
    writer.close()
    return out.getvalue()


def decode_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of the documents of a shard file, and all their values."""
    reader = ShardReader(io.BytesIO(data), len(data))
    return reader.documents["id"], reader.documents["count"].astype(np.int64), np.concatenate([np.zeros(0, np.uint64), *reader.values()])


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, uri: str, path: str | None = None, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode `docs` in ascending id order into shard files under `uri` (a folder that all executors reach).

    Returns the index, one row per shard: file, shard, documents, n_values, first (values of all shards before).
    """
    path = path or default_path()
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a number of shards that grows with the table, whatever the cluster
    n = shards or max(1, -(-(source.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0) // SHARD_BYTES))
    # the hash parts rows that share an id
    dealt = source.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        rows = (part for batch in batches for part in text_parts(batch))
        first = next(rows, None)
        if first is None:
            return
        store, folder = _store(uri)
        name = f"shard-{number:06d}.s8b"
        draft = f"{folder}/_draft-{number:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        documents = n_values = 0
        with store.open_output_stream(draft) as out:
            writer = ShardWriter(out)
            for part in chain([first], rows):
                tokens, offsets = encoder(path).encode(part.column(1))
                counts = np.diff(offsets) + 1
                writer.add(part.column(0).to_numpy(), counts, np.insert(tokens, offsets[1:], np.uint32(end_id)))
                documents += len(counts)
                n_values += int(counts.sum())
            writer.close()
        store.move(draft, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "shard": [number], "documents": [documents], "n_values": [n_values]})

    store, folder = _store(uri)
    store.create_dir(folder, recursive=True)
    files = durable(dealt.select("doc_id", "text").mapInArrow(run, "file string, shard long, documents long, n_values long"))
    # running sums inside runs of shards, and of the runs before
    files = files.withColumn("run", F.expr("shard div 4096"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = files.groupBy("run").agg(F.sum("n_values").alias("total")).select("run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n_values").over(inside), F.lit(0))
    return files.join(runs, "run").select("file", "shard", "documents", "n_values", first.alias("first"))


def _opened(index: DataFrame, uri: str, columns: str, rows: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """`rows` of (ids, starts, counts, values) for every run of documents in the shards of `index`, in parallel by shard."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(uri)
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{folder}/{file}") as data:
                    reader = ShardReader(data, data.size())
                    counts = reader.documents["count"].astype(np.int64)
                    starts = before + np.cumsum(counts) - counts
                    for a, b, values in reader.runs():
                        yield pa.RecordBatch.from_pydict(rows(reader.documents["id"][a:b], starts[a:b], counts[a:b], values)).select(names)

    spread = index.select("file", "first", "shard").repartition(max(1, min(index.count(), 100_000)), "shard")
    return spread.select("file", "first").mapInArrow(run, columns)


def read(index: DataFrame, uri: str) -> DataFrame:
    """doc_id, start (values of all documents before it), ids of every document in the shard files."""

    def rows(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> dict:
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return {"doc_id": ids, "start": starts, "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int64)))}

    return _opened(index, uri, "doc_id long, start long, ids array<long>", rows)


def digests(index: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""

    def rows(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> dict:
        small, ends = values.astype("<u4"), np.cumsum(counts)
        return {"doc_id": ids, "start": starts, "n_tokens": counts, "ids_crc32": [zlib.crc32(small[e - c : e]) for c, e in zip(counts, ends)]}

    return _opened(index, uri, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for shard files beside the session's written tables."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
