"""Helpers that the corpus operators share: durable intermediate tables, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: x20 and x09-x0D, as a Java character class.
JAVA_SPACE = r"[\x20\x09-\x0D]"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one on a local master only."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="riskloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared checkpoint folder and read back.

    It survives the loss of any executor and cuts the lineage. Against checkpoint() the table is columnar, compressed and
    has true sizes, and the reader's plan doesn't inherit the writer's constraints. Tables go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/riskloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table of `durable` that nothing reads any more before the driver ends."""
    files = table.inputFiles()
    if files:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


_written: list[tuple[SparkSession, str]] = []


def note_table(spark: SparkSession, path: str) -> None:
    """Remember a folder of the shared one, which goes when the driver ends."""
    _written.append((spark, path))


@atexit.register
def _drop_tables() -> None:
    for spark, path in _written:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended already
            return


_tables: list = []


def worker_table(build: Callable) -> Callable:
    """`build` called once per worker process and argument; `forget_tables` frees what it made."""
    cached = lru_cache(maxsize=1)(build)
    _tables.append(cached)
    return cached


def forget_tables() -> None:
    """Free the tables that operators before have left in this worker process; called where a task needs none of them."""
    for t in _tables:
        t.cache_clear()
    give_back()


def give_back() -> None:
    """Return memory that this process has freed to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        return


def new_name() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 8 << 20) -> DataFrame:
    """`df` with a broadcast hint if its checked size is within `limit_bytes`; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


def gathered(df: DataFrame, rows: int, each: int = 1 << 16) -> DataFrame:
    """`df` of at most `rows` rows, just grouped or made of small tables, in as many tasks as these rows need."""
    return df.coalesce(1 + rows // each)


def id_remainder(column: str, divisor: int):
    """crc32 of the id written as text, modulo `divisor`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def text_chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of a string column as (first row, end row, UTF-8 bytes, offsets); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _PRIME)]))
        _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, inverse)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of a byte string, modulo 2**64; see `span_hash`."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the bytes behind `prefix`; equal bytes give equal hashes everywhere."""
    h = (prefix[ends] - prefix[starts]) * _inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_class(characters: bytes) -> np.ndarray:
    """Lookup table of 256 truth values: the bytes in `characters`."""
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space, never across texts): starts, ends and the index of each one's text."""
    return runs(~_SPACE[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true values, never across texts: starts, ends and the index of each one's text."""
    if not len(inside):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, side="right") - 1


def sequence_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of `n` consecutive word hashes; element i covers words i to i+n-1."""
    size = max(len(words) - n + 1, 0)
    h = np.full(size, n * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB) + words[k : k + size]
    return mix(h)
