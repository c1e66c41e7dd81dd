"""Token ids by the tokenizers library's byte-level BPE, fast on large corpora.

A byte-level BPE pre-tokenizer never joins a character that isn't white space to white space after it, nor letters,
digits and other characters to one another. So texts are cut at these places, units are hashed in numpy, and each
distinct unit of a worker is encoded once; its ids are then gathered for all its places. No cut is made beside an
apostrophe (contractions) or a character whose class isn't known here; such units go through the pre-tokenizer's
pattern. Texts with white space other than ASCII are encoded whole, as cutting them could change a run of white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import forget_tables, give_back, prefix_hash, span_hash, text_chunks, worker_table

#: Classes of bytes: white space 0, letters 1, digits 2, other ASCII 3; 9 is an apostrophe or unknown.
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[:128] = 3
_CLASS[39] = 9
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: The pre-tokenizer's published pattern (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes Arrow columns of text; keeps the ids of the units it has seen, up to `most` units (some 40 bytes each)."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(_PATTERN)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.sorted = np.zeros(0, dtype=np.uint64)  # keys of most units, and their places
        self.sorted_places = np.zeros(0, dtype=np.int32)
        self.recent: dict[int, int] = {}  # of the others
        self.units = 0
        self.starts = np.zeros(1 << 16, dtype=np.int32)
        self.lengths = np.zeros(1 << 16, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _learn(self, keys: list[int], units: list[list[int]]) -> None:
        """Add new units with their ids."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        known, total = self.units, int(lengths.sum())
        for name, need in (("flat", self.used + total), ("starts", known + len(units)), ("lengths", known + len(units))):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, 2 * len(old)), dtype=old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.flat[self.used : self.used + total] = np.fromiter((i for unit in units for i in unit), np.uint32, total)
        self.lengths[known : known + len(units)] = lengths
        self.starts[known : known + len(units)] = self.used + np.cumsum(lengths) - lengths
        self.recent.update(zip(keys, range(known, known + len(units))))
        self.units += len(units)
        self.used += total
        if len(self.recent) > 100_000:
            joined = np.concatenate([self.sorted, np.fromiter(self.recent, np.uint64, len(self.recent))])
            order = np.argsort(joined)
            self.sorted_places = np.concatenate([self.sorted_places, np.fromiter(self.recent.values(), np.int32, len(self.recent))])[order]
            self.sorted, self.recent = joined[order], {}

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the units with these keys; -1 for new ones."""
        places = np.full(len(keys), -1, dtype=np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            same = self.sorted[at] == keys
            places[same] = self.sorted_places[at[same]]
        missing = np.flatnonzero(places < 0)
        get = self.recent.get
        places[missing] = np.fromiter((get(k, -1) for k in keys[missing].tolist()), np.int64, len(missing))
        return places

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts in order, and the offsets of the texts among them; null counts as empty."""
        ids, counts = [], []
        for _, _, data, offsets in text_chunks(column):
            part, n = self._chunk(data, offsets)
            ids.append(part)
            counts.append(n)
        lengths = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        if self.units > self.most:
            self._forget()
        raw = data.tobytes()
        kind = _CLASS[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # all but two of these are letters
        kind[lead] = kind[lead + 1] = 1
        cut = np.zeros(len(data) + 1, dtype=bool)
        now, before = kind[1:], kind[:-1]
        cut[1:-1] = (now != before) & (before > 0) & (before < 9) & (now < 9) | (now == 0) & (before == 9)
        cut[offsets] = True
        cut[-1] = True
        edges = np.flatnonzero(cut)
        begin, end = edges[:-1], edges[1:]
        keys, first, back = np.unique(span_hash(prefix_hash(data), begin, end), return_index=True, return_inverse=True)
        places = self._find(keys)
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            unknown = np.concatenate([[0], np.cumsum(kind == 9)])
            b, e = begin[first[fresh]], end[first[fresh]]
            second = kind[np.minimum(b + 1, len(kind) - 1)]
            # one pre-token: letters, digits or others, with at most one space before
            simple = (unknown[e] == unknown[b]) & ((kind[b] > 0) | (data[b] == 32) & (e - b > 1) & (second > 0))
            mapped, tokenize, find = raw.decode("latin-1").translate(self.letters), self.tokenizer.model.tokenize, self.pattern.findall
            units = []
            for x, y, one in zip(b.tolist(), e.tolist(), simple.tolist()):
                if one:
                    units.append([t.id for t in tokenize(mapped[x:y])])
                else:
                    units.append([t.id for part in find(raw[x:y].decode()) for t in tokenize(part.encode().decode("latin-1").translate(self.letters))])
            known = self.units
            self._learn(keys[fresh].tolist(), units)
            places[fresh] = known + np.arange(len(fresh))
        lengths = self.lengths[places][back].astype(np.int64)
        starts = self.starts[places][back].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(begin, offsets)]
        odd = sorted({int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in _OTHER_SPACE.finditer(raw)})
        if not odd:
            return ids, np.diff(bounds)
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(n_texts)]
        for i in odd:
            parts[i] = np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


@worker_table
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file; what reading the file took is given back."""
    forget_tables()
    made = Encoder(path)
    give_back()
    return made


def text_parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (id, text) with about `most` bytes of text each, but for a longer text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b
