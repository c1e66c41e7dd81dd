"""Secret scan: three fixed patterns, and windows of high Shannon entropy inside candidate strings.

A candidate is a maximal run of at least `WINDOW` characters of base64, URL and hex alphabets, if it holds a digit and
letters of both cases, and each alphanumeric run of that length inside, if it holds a letter. Its class (the characters it
holds) sets the least entropy; no candidate is skipped. The entropy of each window follows from the one before by taking
one character out of the counts and one in. Overlapping windows of high entropy merge into a span. The allow list
(UUIDs, named digests, counting alphabets, placeholders) suppresses the windows that overlap what it names, and no others.

A random key of 20 characters reaches its class's least entropy in 99 of 100 cases or more; one of letters of a single
case, which is as varied as plain words are, only from about 40 characters on.

Defined results: null and empty texts have no spans; an entropy span leaves out what the fixed patterns' spans cover, and
what is left of it stays if it has at least `REST` characters; every text is scanned whole; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_class, forget_tables, runs, text_chunks

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

WINDOW = 20
#: Least entropy in bits of a window of 20 characters, by class.
LEAST = {"hex": 3.0, "base64": 3.6, "digit_upper": 3.3, "digit_lower": 3.4, "letters": 3.5, "letter": 3.6}
#: Characters that a part of an entropy span beside a fixed pattern's span has at least.
REST = 8
_HEX = byte_class(b"0123456789abcdef")
_CANDIDATE = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_ALNUM = re.compile(rb"[0-9A-Za-z]{%d,}" % WINDOW)
_ALL_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_DIGEST = re.compile(rb"(?:sha1|sha224|sha256|sha384|sha512|md5|blake2b)[-:=\x20]\x20*$", re.IGNORECASE)
_DIGEST_VALUE = re.compile(rb"[0-9a-fA-F]{20,}(?![A-Za-z0-9+/])|[A-Za-z0-9+/]+={0,2}")
_PLACEHOLDER = re.compile(rb"example|placeholder|changeme|dummy|sample|redacted|xxxx|0000000|0123456789abcdef|abcdefghij", re.IGNORECASE)

_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def entropy_windows(text: bytes, least: float, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows whose entropy is at least `least`."""
    counts, total = [0] * 256, 0.0
    start = end = -1
    for i, c in enumerate(text):
        total += _NLOGN[counts[c] + 1] - _NLOGN[counts[c]]
        counts[c] += 1
        if i >= window - 1:
            if math.log2(window) - total / window >= least - 1e-9:
                if end < i - window + 1:
                    if end >= 0:
                        yield start, end
                    start = i - window + 1
                end = i + 1
            old = text[i - window + 1]
            total += _NLOGN[counts[old] - 1] - _NLOGN[counts[old]]
            counts[old] -= 1
    if end >= 0:
        yield start, end


def _least(word: bytes) -> float | None:
    """The least entropy of a candidate's class; None for digits alone."""
    digit, lower, upper = (any(a <= c <= b for c in word) for a, b in ((48, 57), (97, 122), (65, 90)))
    if not (lower or upper):
        return None
    if digit and _ALL_HEX.fullmatch(word):
        return LEAST["hex"]
    if lower and upper:
        return LEAST["base64" if digit else "letters"]
    return LEAST[("digit_upper" if upper else "digit_lower") if digit else "letter"]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _without(start: int, end: int, holes: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the holes leave of [start, end)."""
    for a, b in _merged(holes):
        if start < min(a, end):
            yield start, min(a, end)
        start = max(start, b)
    if start < end:
        yield start, end


def _random_spans(text: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    word = text[start:end]
    allowed = [m.span() for pattern in (_UUID, _PLACEHOLDER) for m in pattern.finditer(word)]
    if _DIGEST.search(text[max(0, start - 12) : start]) and (value := _DIGEST_VALUE.match(word)):
        allowed.append(value.span())
    whole = _least(word) == LEAST["base64"]
    found: list[tuple[int, int]] = []
    for a, b in _without(0, len(word), allowed):
        part = word[a:b]
        if whole:
            found += [(a + x, a + y) for x, y in entropy_windows(part, LEAST["base64"])]
        for m in _ALNUM.finditer(part):
            least = _least(m[0])
            if least is not None:
                found += [(a + m.start() + x, a + m.start() + y) for x, y in entropy_windows(m[0], least)]
    for a, b in _merged(found):
        yield start + a, start + b


def _scan(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Of each text its bytes and its spans (start, kind, end) in bytes, in order; spans of the patterns first found."""
    long: dict[int, list[tuple[int, int]]] = {}
    hexes: dict[int, list[tuple[int, int]]] = {}
    for table, least, into in ((_CANDIDATE, WINDOW, long), (_HEX, 32, hexes)):
        starts, ends, owner = runs(table[data], offsets)
        for k in np.flatnonzero(ends - starts >= least):
            base = offsets[owner[k]]
            into.setdefault(int(owner[k]), []).append((int(starts[k] - base), int(ends[k] - base)))
    raw = data.tobytes()
    for i in range(len(offsets) - 1):
        text = raw[offsets[i] : offsets[i + 1]]
        spans: list[tuple[int, int, int]] = []
        if b"=" in text or b":" in text:
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if b"AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        spans += [(a, 2, b) for a, b in hexes.get(i, ())]
        base = _merged([(a, b) for a, _, b in spans])
        begins, ends = [a for a, _ in base], [b for _, b in base]
        for start, end in long.get(i, ()):
            for a, b in _random_spans(text, start, end):
                over = base[bisect_right(ends, a) : bisect_left(begins, b)]
                spans += [(x, 3, y) for x, y in _without(a, b, over) if not over or y - x >= REST]
        yield text, sorted(spans)


def _in_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The spans with places in code points; one pass over the text, whatever their number."""
    if not spans:
        return []
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"kind": KINDS[k], "start": int(upto[a]), "end": int(upto[b])} for a, k, b in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and spans, an array of (kind, start, end) in code points, by start, then kind."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                for text, spans in _scan(data, offsets):
                    found.append(_in_points(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span (overlapping ones merged) replaced by `mask`, and the length column, if there is one, set anew."""
    schema = docs.schema
    lengths = length_col in schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out: list[str | None] = []
            for _, _, data, offsets in text_chunks(batch.column(at)):
                for text, spans in _scan(data, offsets):
                    merged: list[list[int]] = []
                    for a, _, b in spans:
                        if merged and a < merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    parts, done = [], 0
                    for a, b in merged:
                        parts += [text[done:a], mask.encode()]
                        done = b
                    out.append(b"".join([*parts, text[done:]]).decode())
            valid = batch.column(at).is_valid().to_pylist()
            out = [x if ok else None for x, ok in zip(out, valid)]
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            columns[at] = pa.array(out, batch.schema.field(at).type)
            if lengths:
                k = batch.schema.get_field_index(length_col)
                before = columns[k].to_pylist()
                columns[k] = pa.array([n if x == y or y is None else len(y) for n, x, y in zip(before, old, out)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))


def joined(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, comma-joined in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from the rows of `scan`."""
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("spans"), KINDS[:3]).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
