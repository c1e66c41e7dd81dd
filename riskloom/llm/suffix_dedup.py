"""Removal of passages that repeat across documents, by range-partitioned suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document of a smaller id. Sorting a suffix of every
byte would write the text fifty times over, so only suffixes at anchors are sorted:

1. Anchors. The anchor of a window of 50 bytes is its k-gram of the smallest hash. Equal windows have
   equal anchors, and consecutive windows mostly share one, so there is an anchor for every 16 bytes. The windows of one anchor
   are a run; its bytes are the run's content.
2. Who shares. Entries (anchor, content, document) go in packed blobs to buckets by the anchor's hash. Of runs with equal
   content all but the smallest document's go whole. A smallest one is asked about further if its anchor also has other contents.
   Equal entries of a chunk of documents are collapsed before the shuffle. Anchors in at least 0.1 % of a chunk's documents
   ("heavy"; their number is bounded by the reciprocal times the anchors of an average document) go to buckets by content,
   so no bucket holds all entries of a common passage.
3. Suffixes. The contents asked about, from their anchor on, are range-partitioned by their leading bytes with Spark's
   sampled splitters; document ids break ties, so equal suffixes may fill several buckets. A bucket sorts by multikey
   quicksort, eight bytes being one character, and compares all windows of suffixes that start with the same k-gram.
   The first and last of these groups in a bucket may go on in its neighbours: their windows that have found no smaller
   document are compared across the boundaries by one grouping on the window itself.
4. Removal. Documents and decisions meet by part, and every document drops what its runs' decisions cover.

Documents are written once, bucketed by part, so no later join shuffles texts.

Defined results: ids are integers; rows with a null id lose nothing and take nothing from others; rows that share an id don't
affect each other; null text counts as empty; a text under 50 bytes loses nothing; overlaps of a document with itself don't
count; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix, note_table, prefix_hash, shared_dir, span_hash, text_chunks

#: Bytes of a string that counts as repeated, and of the k-gram that anchors it.
LENGTH = 50
GRAM = 20
#: Text bytes of a part, anchors of a chunk, entries of a bucket, and suffixes of a range; all only bound memory.
PART = 16 << 20
CHUNK = 1 << 20
BUCKET = 1 << 19
RANGE = 150_000
#: An anchor is heavy in a chunk from this share and number of its documents on.
HEAVY_SHARE, HEAVY_LEAST = 0.001, 8

_G = (1 << 48) - 1
_ALL = (1 << (LENGTH - GRAM + 1)) - 1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the `GRAM` bytes from each place on, out of three overlapping 8-byte words."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += words[GRAM - 8 : GRAM - 8 + n]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts: the runs' first and last window, anchor, the anchor's hash, the content's 48-bit hash, and the text.

    A run has one anchor hash and at most as many windows as contain a k-gram. Where its k-gram repeats, its first place counts.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    prefix = prefix_hash(data)
    h = _gram_hashes(data)
    width, covered = LENGTH - GRAM + 1, 1
    least = h
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[step:], least[:-step])
        covered += step
    n = len(least)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.clip(offsets[1:] - LENGTH + 1, offsets[:-1], n), 1)
    np.add.at(change, np.minimum(offsets[1:], n), -1)
    valid = np.cumsum(change[:n]) == 0
    other = np.ones(n + 1, bool)
    other[1:-1] = (least[1:] != least[:-1]) | ~(valid[1:] & valid[:-1])
    s, e = np.flatnonzero(other[:-1] & valid), np.flatnonzero(other[1:] & valid)
    long = e - s >= width
    if long.any():
        pieces = (e - s) // width + 1
        of = np.repeat(np.arange(len(s)), pieces)
        s = s[of] + width * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        e = np.minimum(e[of], s + width - 1)
    value = least[s]
    a, open_ = s.copy(), np.flatnonzero(h[s] != value)
    while len(open_):
        a[open_] += 1
        open_ = open_[h[a[open_]] != value[open_]]
    return s, e, a, value, span_hash(prefix, s, e + LENGTH) & np.uint64(_G), np.searchsorted(offsets, s, side="right") - 1


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(blobs, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def _pack_ids(ids: np.ndarray) -> bytes:
    """Byte planes of the ids: planes of equal bytes compress to nothing."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack_ids(blobs) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8") for b in blobs] or [np.zeros(0, np.int64)])


def _slot(ids: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One key of a document's run: its id and content."""
    return mix(mix(ids.astype(np.int64).view(np.uint64)) ^ content)


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted list of rows changes in any of these columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _prime(least: int) -> int:
    n = max(2, least)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Runs of about `CHUNK` anchors of whole documents: anchors' hashes, contents, ids, and the number of documents. Rows without an id are left out."""
    held: list[tuple] = []
    size = docs = 0
    for batch in batches:
        for first, end, data, offsets in text_chunks(batch.column("text")):
            ids = batch.column("doc_id").slice(first, end - first)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            _, _, _, h, content, owner = anchors(data, offsets)
            keep = known[owner]
            held.append((h[keep], content[keep], ids[owner[keep]]))
            size, docs = size + len(h), docs + end - first
            if size >= CHUNK:
                yield (*(np.concatenate(x) for x in zip(*held)), docs)
                held, size, docs = [], 0, 0
    if held:
        yield (*(np.concatenate(x) for x in zip(*held)), docs)


def _heavy(parts: DataFrame, documents: int) -> np.ndarray:
    """Hashes of the anchors that are in 0.1 % of the documents: those that are so in some chunk, with their summed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, ids, docs in _chunks(batches):
            order = np.argsort(h, kind="stable")  # a document's anchors stand together
            h, ids = h[order], ids[order]
            h = h[_first(h, ids)]
            at = np.flatnonzero(_first(h))
            count = np.diff(np.concatenate([at, [len(h)]]))
            much = count >= max(HEAVY_LEAST, HEAVY_SHARE * docs)
            yield pa.RecordBatch.from_arrays([pa.array(h[at[much]].view(np.int64)), pa.array(count[much].astype(np.int64))], names=["h", "n"])

    counted = parts.select("doc_id", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(HEAVY_LEAST, HEAVY_SHARE / 2 * documents)).select("h").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


_ENTRIES = "bucket int, heavy boolean, h binary, g binary, d binary"
_DECIDED = "part int, kind int, g binary, d binary"


def _entries(parts: DataFrame, heavy: np.ndarray, buckets: int, n_parts: int) -> DataFrame:
    """Blobs of distinct (anchor, content) of each chunk with the smallest id; those of larger ids go straight to their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, g, ids, _ in _chunks(batches):
            order = np.argsort(g)
            h, g, ids = h[order], g[order], ids[order]
            at = np.flatnonzero(_first(h, g))
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(g))))
            best = np.minimum.reduceat(ids, at) if len(at) else ids
            rows = []
            gone = np.flatnonzero(ids != best[group])
            to = ids[gone] % n_parts
            gone = gone[np.argsort(to, kind="stable")]
            for x in np.split(gone, np.flatnonzero(np.diff(np.sort(to))) + 1) if len(gone) else []:
                rows.append((buckets + int(ids[x[0]] % n_parts), False, b"", _pack(g[x], 6), _pack_ids(ids[x])))
            h, g, ids = h[at], g[at], best
            common = _is_in(h, heavy)
            to = np.where(common, g % np.uint64(buckets), h % np.uint64(buckets)).astype(np.int64) * 2 + common
            order = np.argsort(to.astype(np.uint16) if buckets < 1 << 15 else to, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                rows.append((int(to[x[0]] >> 1), bool(to[x[0]] & 1), _pack(h[x] // np.uint64(buckets), 5), _pack(g[x], 6), _pack_ids(ids[x])))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "heavy", "h", "g", "d"])

    return parts.select("doc_id", "text").mapInArrow(run, _ENTRIES)


def _decisions(entries: DataFrame, buckets: int, n_parts: int) -> DataFrame:
    """Per part: runs that go whole (kind 0), and runs whose windows must be compared (kind 1)."""

    def decide(key, table):
        rows: list[tuple] = []

        def tell(kind: int, g: np.ndarray, ids: np.ndarray) -> None:
            to = ids % n_parts
            order = np.argsort(to, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                rows.append((int(to[x[0]]), kind, _pack(g[x], 6), _pack_ids(ids[x])))

        if key[0].as_py() >= buckets:
            tell(0, _unpack(table.column("g").to_pylist(), 6), _unpack_ids(table.column("d").to_pylist()))
        else:
            for heavy in (False, True):
                some = table.filter(pc.equal(table.column("heavy"), heavy))
                h, g, ids = _unpack(some.column("h").to_pylist(), 5), _unpack(some.column("g").to_pylist(), 6), _unpack_ids(some.column("d").to_pylist())
                order = np.lexsort((ids, g, h))
                h, g, ids = h[order], g[order], ids[order]
                new = _first(h, g)
                least = ids[np.flatnonzero(new)][np.cumsum(new) - 1] == ids if len(ids) else new
                tell(0, g[~least], ids[~least])
                h, g, ids, new = h[least], g[least], ids[least], new[least]
                if heavy:
                    ask = np.ones(len(h), bool)
                else:
                    at = np.flatnonzero(_first(h))
                    size = np.diff(np.concatenate([at, [len(h)]]))
                    many = (np.add.reduceat(new, at, dtype=np.int64) > 1) & (np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at)) if len(at) else np.zeros(0, bool)
                    ask = np.repeat(many, size)
                tell(1, g[ask], ids[ask])
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["part", "kind", "g", "d"])

    return entries.groupBy("bucket").applyInArrow(decide, _DECIDED)


def _ragged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings [start, end) of `data` as one Arrow array."""
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _suffixes(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """suffix (from the anchor on), before (the run's bytes before it) and doc_id of every run that was asked about."""

    def run(docs, asks):
        wanted = np.unique(_slot(_unpack_ids(asks.column("d").to_pylist()), _unpack(asks.column("g").to_pylist(), 6)))
        out = [pa.table([pa.array([], pa.binary()), pa.array([], pa.binary()), pa.array([], pa.int64())], names=["suffix", "before", "doc_id"])]
        docs = docs.combine_chunks()
        for batch in docs.to_batches():
            for first, end, data, offsets in text_chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(first, end - first)
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                s, e, a, _, g, owner = anchors(data, offsets)
                slot = _slot(ids[owner], g)
                hit = np.flatnonzero(_is_in(slot, wanted) & known[owner])
                hit = hit[np.sort(np.unique(slot[hit], return_index=True)[1])]
                s, e, a = s[hit], e[hit], a[hit]
                out.append(pa.table([_ragged(data, a, e + LENGTH), _ragged(data, s, a), pa.array(ids[owner[hit]])], names=["suffix", "before", "doc_id"]))
        return pa.concat_tables(out)

    return parts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run, "suffix binary, before binary, doc_id long")


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of 64-bit characters: sort by the first one, then only ties by the next."""
    order = np.argsort(keys[:, 0], kind="stable")
    tied = np.zeros(len(keys), np.int64)
    for c in range(1, keys.shape[1]):
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:], c - 1] != keys[order[:-1], c - 1]) | (tied[1:] != tied[:-1])
        tied = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        rest = np.flatnonzero(~alone)
        order[rest] = order[rest][np.lexsort((keys[order[rest], c], tied[rest]))]
    return order


def _compared(suffixes: DataFrame, n_parts: int) -> DataFrame:
    """doc_id, g, mask of the windows that a smaller document has; or, at a bucket's ends, window, doc_id, g and mask of those that none of the bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got).combine_chunks()
        suffix, before = table.column("suffix").cast(pa.large_binary()).combine_chunks(), table.column("before").cast(pa.large_binary()).combine_chunks()
        ids = table.column("doc_id").to_numpy()
        suffix, before = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (suffix, before))
        so, sd = (np.frombuffer(suffix.buffers()[1], np.int64)[: len(ids) + 1], np.frombuffer(suffix.buffers()[2], np.uint8))
        bo = np.frombuffer(before.buffers()[1], np.int64)[: len(ids) + 1]
        bd = np.frombuffer(before.buffers()[2], np.uint8) if before.buffers()[2] else np.zeros(0, np.uint8)
        lead = sd[so[:-1][:, None] + np.arange(GRAM)]
        keys = np.zeros((len(ids), -(-GRAM // 8) * 8), np.uint8)
        keys[:, :GRAM] = lead
        keys = keys.view(">u8").astype(np.uint64)
        order = multikey_order(keys)
        keys = keys[order]
        group = np.cumsum(_first(*keys.T)) - 1
        ends = np.flatnonzero(np.diff(np.append(group, group[-1] + 1))) + 1
        edge = (group == 0) | (group == group[-1])
        a = 0
        while a < len(order):
            # whole groups with about 20,000 suffixes
            b = int(ends[np.searchsorted(ends, min(a + 20_000, len(order)))])
            x = order[a:b]
            nb, ns = np.diff(bo)[x], np.diff(so)[x]
            size = nb + ns
            base = np.concatenate([[0], np.cumsum(size)])
            text = np.zeros(base[-1], np.uint8)
            for starts, n, source, shift in ((bo[:-1][x], nb, bd, np.zeros(len(x), np.int64)), (so[:-1][x], ns, sd, nb)):
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text[np.repeat(base[:-1] + shift, n) + k] = source[np.repeat(starts, n) + k]
            prefix = prefix_hash(text)
            g = span_hash(prefix, base[:-1], base[1:]) & np.uint64(_G)
            n = size - LENGTH + 1
            of = np.repeat(np.arange(len(x)), n)
            t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = base[:-1][of] + t
            w = span_hash(prefix, at, at + LENGTH)
            d = ids[x][of]
            by = np.lexsort((d, w))
            new = _first(w[by])
            least = d[by][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = np.zeros(len(w), bool)
            gone[by] = d[by] > least
            mask = np.bincount(of, weights=gone * np.exp2(t), minlength=len(x)).astype(np.int64)
            hit = np.flatnonzero(mask)
            m = np.flatnonzero(~gone & edge[a:b][of])
            windows = pa.concat_arrays([pa.nulls(len(hit), pa.binary()), _ragged(text, at[m], at[m] + LENGTH)])
            doc = np.concatenate([ids[x][hit], d[m]])
            content = np.concatenate([g[hit], g[of[m]]])
            yield pa.RecordBatch.from_arrays([windows, pa.array(doc), pa.array(content.view(np.int64)), pa.array(np.concatenate([mask[hit], np.int64(1) << t[m]]))], names=["window", "doc_id", "g", "mask"])
            a = b

    return suffixes.mapInArrow(run, "window binary, doc_id long, g long, mask long")


def _packed(masks: DataFrame, n_parts: int) -> DataFrame:
    """Rows (doc_id, g, mask) as blobs by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, g, m = (batch.column(c).to_numpy() for c in ("doc_id", "g", "mask"))
            to = ids % n_parts
            order = np.argsort(to, kind="stable")
            rows = [(int(to[x[0]]), _pack(g[x].view(np.uint64), 6), _pack_ids(ids[x]), _pack(m[x].view(np.uint64), 4)) for x in (np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else [])]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "g", "d", "m"])

    return masks.select("doc_id", "g", "mask").mapInArrow(run, "part int, g binary, d binary, m binary")


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _kept(parts: DataFrame, decided: DataFrame, digest: bool) -> DataFrame:
    """Per document its bytes, removed bytes and spans, and what is left of it (or that's SHA-256)."""

    def run(docs, found):
        g, d, m = [], [], []
        for gb, db, mb in zip(*(found.column(c).to_pylist() for c in ("g", "d", "m"))):
            g.append(_unpack([gb], 6))
            d.append(_unpack_ids([db]))
            m.append(np.full(len(g[-1]), _ALL, np.uint64) if mb is None else _unpack([mb], 4))
        slots, masks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if g:
            slots = _slot(np.concatenate(d), np.concatenate(g))
            order = np.argsort(slots, kind="stable")
            at = np.flatnonzero(_first(slots[order]))
            masks, slots = np.bitwise_or.reduceat(np.concatenate(m)[order], at), slots[order][at]
        ids_out, n_bytes, n_removed, n_spans, kept = [], [], [], [], []
        for batch in docs.combine_chunks().to_batches():
            for first, end, data, offsets in text_chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(first, end - first)
                known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                s, e, _, _, content, owner = anchors(data, offsets)
                slot = _slot(values[owner], content)
                hit = np.flatnonzero(_is_in(slot, slots) & known[owner])
                mask = masks[np.searchsorted(slots, slot[hit])]
                some = mask != np.uint64(_ALL)
                s, e, mask = s[hit], e[hit], mask
                n = (e - s + 1)[some]
                of = np.repeat(np.flatnonzero(some), n)
                t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = (s[of] + t)[(mask[of] >> t.astype(np.uint64)) & np.uint64(1) > 0]
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, np.concatenate([s[~some], p]), 1)
                np.add.at(cover, np.concatenate([e[~some], p]) + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
                removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
                left = data[~gone].tobytes()
                bounds = offsets - removed[offsets]
                for i in range(end - first):
                    rest = left[bounds[i] : bounds[i + 1]]
                    kept.append(hashlib.sha256(rest).digest() if digest else rest)
                ids_out.append(ids)
                n_bytes.append(np.diff(offsets))
                n_removed.append(np.diff(removed[offsets]))
                n_spans.append(np.diff(spans[offsets]))
        whole = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        ids_out = pa.concat_arrays([i.combine_chunks() if isinstance(i, pa.ChunkedArray) else i for i in ids_out]) if ids_out else pa.array([], pa.int64())
        return pa.table([ids_out, whole(n_bytes), whole(n_removed), whole(n_spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return parts.groupBy("part").cogroup(decided.groupBy("part")).applyInArrow(run, _KEPT)


def _bucketed(docs: DataFrame, n_parts: int) -> DataFrame:
    """part, doc_id, text written once, bucketed by part, in the shared folder."""
    spark = docs.sparkSession
    name = f"riskloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    part = F.coalesce(F.pmod("doc_id", F.lit(n_parts)), F.lit(0)).cast("int").alias("part")
    note_table(spark, path)
    docs.select(part, "doc_id", "text").write.option("compression", "zstd").option("path", path).bucketBy(n_parts, "part").saveAsTable(name)
    return spark.table(name)


def repeated(docs: DataFrame, digest: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_parts = _prime(-(-size["bytes"] // PART))
    buckets = max(1, -(-size["bytes"] // 16 // BUCKET))
    parts = _bucketed(docs, n_parts)
    heavy = _heavy(parts, size["n"])
    decided = durable(_decisions(_entries(parts, heavy, buckets, n_parts), buckets, n_parts))
    asked = decided.where("kind = 1")
    n_asked = asked.agg(F.coalesce(F.sum(F.expr("octet_length(g) div 6")), F.lit(0))).first()[0]
    whole = decided.where("kind = 0").select("part", "g", "d", F.lit(None).cast("binary").alias("m"))
    if n_asked:
        # written, so that drawing the splitters doesn't make them a second time
        suffixes = durable(_suffixes(parts, asked.select("part", "g", "d"))).repartitionByRange(max(1, -(-n_asked // RANGE)), "suffix", "before", "doc_id")
        compared = durable(_compared(suffixes, n_parts))
        edges = compared.where("window is not null")
        first = edges.groupBy("window").agg(F.min("doc_id").alias("first"))
        masks = edges.join(first, "window").where("doc_id > first").select("doc_id", "g", "mask").unionByName(compared.where("window is null").select("doc_id", "g", "mask"))
        whole = whole.unionByName(_packed(masks, n_parts))
    return _kept(parts, whole, digest)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    return repeated(docs, True).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document without its repeated passages. A cut inside a character leaves a replacement character."""
    return repeated(docs, False).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.decode("kept", "UTF-8").alias("text"))
