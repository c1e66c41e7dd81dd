"""Quality rules by repetition: rolling hashes of several n-gram lengths in numpy measure the characters inside
duplicated n-grams and duplicated lines of each whole text.

Texts are handled in runs of about a megabyte: words, lines and n-grams are hashed for the whole run at once, and the
text's number is mixed into each hash, so that only repeats inside a text count. Memory follows the longest text.

Defined results: null and empty texts, and texts without words, have all measures 0 and fail the base rule (too few
words); equal lines count as duplicates from the second on, lines without a word never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_class, mix, prefix_hash, sequence_hash, span_hash, text_chunks, word_spans

#: Largest allowed share of a text's word characters inside the most frequent n-gram.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest allowed share of a text's word characters inside n-grams that were in the text before.
REPEATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest allowed share of lines, and of word characters in lines, that were in the text before.
LINES, LINE_CHARACTERS = 0.30, 0.20

_SYMBOLS = byte_class(b"#*$%&|<>")
NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"top_{n}" for n in TOP), *(f"repeated_{n}" for n in REPEATED)]


def _sum_by(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of the keys, where a new key begins in it, and the number of each sorted element's group."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, new, np.cumsum(new) - 1


def _covered(begins: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of `words` words are inside runs of n words that begin where `begins` is true."""
    steps = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(begins)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of `NAMES` for each text."""
    texts = len(offsets) - 1
    out = np.zeros((texts, len(NAMES)), dtype=np.int64)
    if not len(data):
        return out
    column = {name: out[:, i] for i, name in enumerate(NAMES)}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    prefix = prefix_hash(data)
    column["n_symbols"][:] = _sum_by(_SYMBOLS[data], offsets)
    starts, ends, owner = word_spans(data, offsets)
    words, size = span_hash(prefix, starts, ends), points[ends] - points[starts]
    edges = np.searchsorted(owner, np.arange(texts + 1))
    column["n_words"][:] = np.diff(edges)
    column["word_chars"][:] = _sum_by(size, edges)

    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:] = data == 10
    cut[offsets[:-1]] = True
    begin = np.flatnonzero(cut[:-1])
    end = np.concatenate([begin[1:], [len(data)]])
    of = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(end - (data[end - 1] == 10), offsets[of + 1])
    has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, of = begin[has], end[has], of[has]
    if len(begin):
        order, new, _ = _groups(mix(span_hash(prefix, begin, end) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        again = np.zeros(len(begin), dtype=bool)
        again[order[~new]] = True
        by_line = np.searchsorted(of, np.arange(texts + 1))
        total = np.concatenate([[0], np.cumsum(size)])
        inside = total[np.searchsorted(starts, end)] - total[np.searchsorted(starts, begin)]
        column["n_lines"][:] = np.diff(by_line)
        column["n_dup_lines"][:] = _sum_by(again, by_line)
        column["dup_line_chars"][:] = _sum_by(np.where(again, inside, 0), by_line)

    salt = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    reach = np.concatenate([[0], np.cumsum(size)])
    for n in sorted({3, *TOP, *REPEATED}):
        grams = sequence_hash(words, n)
        if not len(grams):
            continue
        place = np.flatnonzero(owner[: len(grams)] == owner[n - 1 :])
        if not len(place):
            continue
        order, new, group = _groups(mix(grams[place] + salt[place]))
        counts = np.bincount(group)
        if n == 3:
            begins = np.zeros(len(words), dtype=bool)
            begins[place[order[counts[group] > 1]]] = True
            column["n_repeat_words"][:] = _sum_by(_covered(begins, n, len(words)), edges)
        if n in TOP:
            # of a repeated n-gram: its occurrences times its characters
            first = place[order[new]]
            found = np.where(counts > 1, counts * (reach[first + n] - reach[first]), 0)
            np.maximum.at(column[f"top_{n}"], owner[first], found)
        if n in REPEATED:
            begins = np.zeros(len(words), dtype=bool)
            begins[place[order[~new]]] = True
            column[f"repeated_{n}"][:] = _sum_by(np.where(_covered(begins, n, len(words)), size, 0), edges)
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and `NAMES`; top_n and repeated_n count characters."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(data, offsets) for _, _, data, offsets in text_chunks(batch.column(1))]
            table = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(len(NAMES)))], names=["doc_id", *NAMES])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def repetitive() -> Column:
    """The method's verdict against a text: any share of repetition above its limit."""
    found = (F.col("n_dup_lines") > LINES * F.col("n_lines")) | (F.col("dup_line_chars") > LINE_CHARACTERS * F.col("word_chars"))
    for prefix, limits in (("top", TOP), ("repeated", REPEATED)):
        for n, most in limits.items():
            found = found | (F.col(f"{prefix}_{n}") > most * F.col("word_chars"))
    return found
