"""Brown class-based bigram model: exchange clustering assigns words to classes; class transitions and word emissions
give smoothed probabilities of texts.

Texts are read once. Each task turns its texts into blocks of a few million tokens: a vocabulary of word hashes and
texts coded by places in it. A word's total count comes back to every block that has the word, by one shuffle of
(word, block, count) rows, so no task holds the vocabulary of the corpus and none is sent for each token.

The exchange has two parts. The `FREQUENT` most frequent words are single symbols, and counts of symbol pairs over all
training tokens feed rounds of exchange: in each Spark finds for every frequent word the class that raises the likelihood most,
for a half of the words at a time, until a round doesn't raise it. At first all other words are in bands by the power of
two of their count. Then every other word that occurs more than once is exchanged from its band to a class: its
neighbours' classes are counted in the blocks, summed by one shuffle on the word, and the class that raises the likelihood
most is chosen in the tasks and sent back to the word's places. So classes of all words are rows, never a table of
the driver. Words seen once have no statistics of their own and share a class with unseen ones.

A token after class a has probability (1 - u(a)) * P(class | a) * count / count of its class if it was seen, else u(a),
the smoothed share of words seen once after a. All unseen words count as one, so each context's probabilities add up to 1.

Defined results: null text counts as empty: one end token; rows that repeat an id are scored each, and count each; with no
training rows all counts are 0 and scores use u = 1/2 for every token; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, lower_ascii, prefix_hash, span_hash, text_chunks, word_spans

#: Tokens in a block at most (a longer text is a block of its own).
BLOCK = 4_000_000
FREQUENT, CLASSES, ROUNDS = 500, 80, 12
#: Symbol 0 is the end; frequent words follow; then one symbol per power of two of the count.
BANDS = 48
END = np.uint64(0x1D8AF5C6E3B70924)
_ENTRY = np.dtype([("slot", "<u2"), ("count", "<u4")])
#: Strength of the class frequencies in class transitions.
PRIOR = 20.0


def _packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Whole numbers as compressed byte planes; most are small, so the upper planes are almost empty."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(packed: bytes, kind: str = "<i4") -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _blocks(docs: DataFrame) -> DataFrame:
    """block, ids, held, lengths, codes, words, counts: texts coded by their block's words; counts are of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, lengths, hashes = [], [], [], []
        size = 0

        def block() -> pa.RecordBatch:
            tokens, n = np.concatenate(hashes), np.concatenate(lengths)
            words, back, total = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-total, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            places = place[back]
            trains = np.repeat(~np.array(held, dtype=bool), n)
            counts = np.bincount(places[trains], minlength=len(words))
            row = {"block": [number], "ids": [ids], "held": [held], "lengths": [n.tolist()], "codes": [_packed(places)], "words": [words[order].view(np.int64)], "counts": [counts]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema({"block": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "codes": pa.binary(), "words": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())})
        for batch in batches:
            keys, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, end, data, offsets in text_chunks(batch.column(2)):
                data = lower_ascii(data)
                starts, ends, owner = word_spans(data, offsets)
                at = np.searchsorted(owner, np.arange(1, end - first + 1))
                found = np.insert(span_hash(prefix_hash(data), starts, ends), at, END)
                if size and size + len(found) > BLOCK:
                    yield block()
                    number += 1
                    ids, held, lengths, hashes, size = [], [], [], [], 0
                ids += keys[first:end]
                held += flags[first:end]
                lengths.append(np.diff(np.concatenate([[0], at])) + 1)
                hashes.append(found)
                size += len(found)
        if ids:
            yield block()

    columns = "block long, ids array<long>, held array<boolean>, lengths array<int>, codes binary, words array<long>, counts array<long>"
    return docs.mapInArrow(run, columns)


def _totals(blocks: DataFrame, frequent: int) -> DataFrame:
    """block, totals (training count of each of its words), leads (-count, word): the `frequent` most frequent words that this block leads.

    Each word is led by one block, so sums over all leads count every word once.
    """
    one = blocks.select("block", F.arrays_zip("words", "counts").alias("z")).select("block", F.posexplode("z").alias("place", "z"))
    one = one.select(F.col("z.words").alias("word"), "block", "place", F.col("z.counts").alias("n"))
    word = Window.partitionBy("word")
    one = one.withColumn("total", F.sum("n").over(word)).withColumn("first", F.min("block").over(word))
    leads = F.when((F.col("first") == F.col("block")) & (F.col("total") > 0), F.col("total"))
    grouped = one.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", "total"))).alias("found"),
        F.count(leads).alias("n_words"), F.sum(F.coalesce(leads, F.lit(0))).alias("n_tokens"),
        F.slice(F.array_sort(F.collect_list(F.when(leads >= 2, F.struct((-F.col("total")).alias("order"), "word")))), 1, frequent).alias("leads"),
    )
    return grouped.select("block", F.col("found.total").alias("totals"), "n_words", "n_tokens", "leads")


def _symbols(words: np.ndarray, totals: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Symbol of each word; `frequent` has the hashes of the frequent words, sorted. Unseen words share the symbol of words seen once."""
    band = 1 + len(frequent) + np.floor(np.log2(np.maximum(totals, 1))).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        band = np.where(frequent[at] == words, 1 + at, band)
    return np.where(words == END, 0, band)


def _coded(blocks: DataFrame, totals: DataFrame, frequent: np.ndarray) -> DataFrame:
    """block, ids, held, lengths, codes, totals, words, symbols; codes, totals and symbols are packed."""
    names = ["block", "ids", "held", "lengths", "codes", "totals", "words"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for k in range(batch.num_rows):
                own, words = (np.asarray(batch.column(i)[k].values) for i in (5, 6))
                packed = [pa.array([_packed(own, "<i8")]), batch.column(6).slice(k, 1), pa.array([_packed(_symbols(words.view(np.uint64), own, frequent))])]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:5]), *packed], names=[*names, "symbols"])

    joined = blocks.drop("counts").join(totals.select("block", "totals"), "block").select(*names)
    return joined.mapInArrow(run, "block long, ids array<long>, held array<boolean>, lengths array<int>, codes binary, totals binary, words array<long>, symbols binary")


def _tokens(batch: pa.RecordBatch, k: int, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the block in row `k`: the place of each token, the value (by place) of the packed column `values`, and whether it trains."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[k]
    places = _unpacked(get("codes").as_py())
    held = get("held").values.to_numpy(zero_copy_only=False).astype(bool)
    return places, _unpacked(get(values).as_py())[places], np.repeat(~held, np.asarray(get("lengths").values))


def _pairs(coded: DataFrame, n: int, values: str) -> DataFrame:
    """(a, b, n): how often value b of the column `values` follows a in the training texts; each text follows an end (the value 0 of symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, of, trains = _tokens(batch, k, values)
                # a block ends with an end
                before = np.concatenate([of[-1:], of[:-1]])
                count = np.bincount(before[trains] * n + of[trains], minlength=n * n)
                there = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(there // n), pa.array(there % n), pa.array(count[there])], names=["a", "b", "n"])

    return coded.select("held", "lengths", "codes", values).mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _neighbours(coded: DataFrame, of: np.ndarray, frequent: int, n: int) -> DataFrame:
    """word, block, place, entries of every word that is to leave its band: packed (slot, count), how often which class stands
    before it (slots from 0) and after it (slots from `n`) in the training texts of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = np.asarray(batch.column(batch.schema.get_field_index("words"))[k].values)
                symbols = _unpacked(batch.column(batch.schema.get_field_index("symbols"))[k].as_py())
                leaving = np.flatnonzero(symbols > frequent + 1)
                row_of = np.full(len(symbols), -1, dtype=np.int32)
                row_of[leaving] = np.arange(len(leaving), dtype=np.int32) * (2 * n)
                places, own, trains = _tokens(batch, k, "symbols")
                at = np.flatnonzero(trains & (own > frequent + 1))
                cls, row = of[own].astype(np.int32), row_of[places[at]]
                keys = np.concatenate([row + cls[at - 1], row + n + cls[at + 1]])
                del places, own, trains, cls, at, row
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                count, keys = np.diff(np.append(first, len(keys))), keys[first]
                # entries (slot, count) of 16 and 32 bits as bytes
                entries = np.empty(len(keys), dtype=_ENTRY)
                entries["slot"], entries["count"] = keys % (2 * n), count
                offsets = (np.searchsorted(keys, np.arange(len(leaving) + 1) * (2 * n)) * _ENTRY.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(leaving), [None, pa.py_buffer(offsets), pa.py_buffer(entries)])
                columns = [pa.array(words[leaving]), pa.array(np.full(len(leaving), batch.column(0)[k].as_py(), np.int64)), pa.array(leaving.astype(np.int32)), packed]
                out = pa.RecordBatch.from_arrays(columns, names=["word", "block", "place", "entries"])
                for i in range(0, out.num_rows, 20_000):
                    yield out.slice(i, 20_000)

    columns = "word long, block long, place int, entries binary"
    return coded.select("block", "held", "lengths", "codes", "words", "symbols").mapInArrow(run, columns)


def class_of(matrix: np.ndarray, classes: int, word: np.ndarray, slot: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    """The class among the first `classes` whose likelihood gains most by each of `words` words that joins it.

    Entries (word, slot, count) are sorted by word: counts of the classes before it (slots from 0) and after it (from the matrix's size).
    """
    n, best = len(matrix), np.zeros(words, dtype=np.int16)
    rows, columns = matrix.sum(1)[:classes], matrix.sum(0)[:classes]
    before, after = matrix[:, :classes], np.ascontiguousarray(matrix[:classes].T)
    step = max(1, 1_000_000 // classes)
    start = 0
    while start < len(word):
        # whole words of about `step` entries
        end = len(word) if start + step >= len(word) else int(np.searchsorted(word, word[start + step]))
        if end <= start:
            end = int(np.searchsorted(word, word[start], side="right"))
        w, s, c = word[start:end], slot[start:end], count[start:end].astype(float)
        right = s >= n
        cells = np.where(right[:, None], after[s % n], before[s % n])
        gain = _xlogx(cells + c[:, None]) - _xlogx(cells)
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        total = np.add.reduceat(gain, first, axis=0)
        to_right, to_left = np.add.reduceat(np.where(right, c, 0), first)[:, None], np.add.reduceat(np.where(right, 0, c), first)[:, None]
        total -= _xlogx(rows + to_right) - _xlogx(rows) + _xlogx(columns + to_left) - _xlogx(columns)
        best[w[first]] = total.argmax(1)
        start = end
    return best


def _assigned(neighbours: DataFrame, matrix: np.ndarray, classes: int) -> DataFrame:
    """block, found (place, cls): the class of every word that leaves its band, at its places in the blocks."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column(0).to_numpy()
        number = np.concatenate([[0], np.cumsum(words[1:] != words[:-1])])
        sizes = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False) // _ENTRY.itemsize
        entries = np.frombuffer(b"".join(batch.column(3).to_pylist()), _ENTRY)
        keys, back = np.unique(np.repeat(number, sizes) * (2 * len(matrix)) + entries["slot"], return_inverse=True)
        count = np.bincount(back, entries["count"], len(keys))
        best = class_of(matrix, classes, keys // (2 * len(matrix)), keys % (2 * len(matrix)), count, int(number[-1]) + 1)
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(best[number])], names=["block", "place", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            joined = batch if rest is None else pa.concat_batches([rest, batch])
            words = joined.column(0).to_numpy()
            cut = int(np.searchsorted(words, words[-1])) if len(words) else 0
            if cut:
                yield whole(joined.slice(0, cut))
            rest = joined.slice(cut)
        if rest is not None and rest.num_rows:
            yield whole(rest)

    one = neighbours.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, place int, cls smallint")
    return one.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "cls"))).alias("found"))


def _classed(coded: DataFrame, assigned: DataFrame, of: np.ndarray) -> DataFrame:
    """ids, held, lengths, codes, totals, classes (by place) of each block; the last three are packed."""
    kept = ["ids", "held", "lengths", "codes", "totals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = of[_unpacked(batch.column(5)[k].as_py())]
                if batch.column(6)[k].is_valid:
                    own[np.asarray(batch.column(6)[k].values)] = np.asarray(batch.column(7)[k].values)
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:5]), pa.array([_packed(own)])], names=[*kept, "classes"])

    joined = coded.drop("words").join(assigned, "block", "left").select(*kept, "symbols", F.col("found.place").alias("places"), F.col("found.cls").alias("cls"))
    return joined.mapInArrow(run, "ids array<long>, held array<boolean>, lengths array<int>, codes binary, totals binary, classes binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(matrix: np.ndarray) -> float:
    """The part of the class bigram log likelihood that the classes decide."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, self_n: float, classes: int) -> tuple[int, float]:
    """The class among the first `classes` to which to move a word, and the gain.

    left, right: counts of the classes before and after the word; self_n: how often it follows itself.
    """
    base = matrix.copy()
    base[own, :] -= right
    base[:, own] -= left
    base[own, own] += self_n
    # without itself, the word's neighbours of its own class are the others
    l, r = left.copy(), right.copy()
    l[own] -= self_n
    r[own] -= self_n
    gains = np.empty(classes)
    for c in range(classes):
        row, column = base[c, :].copy(), base[:, c].copy()
        new_row, new_column = row + r, column + l
        corner = base[c, c] + r[c] + l[c] + self_n
        new_row[c] = new_column[c] = corner
        cells = _xlogx(new_row).sum() + _xlogx(new_column).sum() - _xlogx(np.array([corner]))[0] - (_xlogx(row).sum() + _xlogx(column).sum() - _xlogx(row[c : c + 1])[0])
        rows, columns = base.sum(1), base.sum(0)
        new_rows, new_columns = rows + l, columns + r
        new_rows[c] += r.sum() + self_n
        new_columns[c] += l.sum() + self_n
        gains[c] = cells - (_xlogx(new_rows).sum() - _xlogx(rows).sum()) - (_xlogx(new_columns).sum() - _xlogx(columns).sum())
    best = int(np.argmax(gains))
    return (best, float(gains[best] - gains[own])) if gains[best] > gains[own] + 1e-6 else (own, 0.0)


def _matrix(pairs: DataFrame, of: np.ndarray, n: int) -> np.ndarray:
    """Class transition counts; a table of the classes' size comes to the driver."""
    name = F.array(*[F.lit(int(c)) for c in of])
    rows = pairs.groupBy(F.get(name, F.col("a").cast("int")).alias("a"), F.get(name, F.col("b").cast("int")).alias("b")).agg(F.sum("n").alias("n")).collect()
    out = np.zeros((n, n))
    for r in rows:
        out[r["a"], r["b"]] = r["n"]
    return out


def _exchange(pairs: DataFrame, start: np.ndarray, frequent: int, classes: int, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol after the exchange of the frequent words (symbols 1 to `frequent`), and the transition counts."""
    of, matrix = start.copy(), _matrix(pairs, start, n)
    both = pairs.where(f"a between 1 and {frequent}").select(F.col("a").alias("w"), F.lit(0).alias("side"), F.col("b").alias("x"), "n")
    both = durable(both.unionByName(pairs.where(f"b between 1 and {frequent}").select(F.col("b").alias("w"), F.lit(1).alias("side"), F.col("a").alias("x"), "n")))
    idle, share = 0, 2
    for step in range(rounds):
        now, table = of.copy(), matrix.copy()

        def move(frame: pd.DataFrame) -> pd.DataFrame:
            w, x = int(frame["w"].iloc[0]), frame["x"].to_numpy()
            after = frame["side"].to_numpy() == 0
            count = frame["n"].to_numpy(dtype=float)
            right = np.bincount(now[x[after]], count[after], n)
            left = np.bincount(now[x[~after]], count[~after], n)
            best, gain = best_class(table, int(now[w]), left, right, float(count[after & (x == w)].sum()), classes)
            return pd.DataFrame({"w": [w], "best": [best], "gain": [gain]})

        turn = both.where(F.pmod(F.xxhash64("w", F.lit(step // share)), F.lit(share)) == step % share)
        moves = turn.groupBy("w").applyInPandas(move, "w long, best long, gain double").where("gain > 0").collect()
        for m in moves:
            now[m["w"]] = m["best"]
        changed = _matrix(pairs, now, n) if moves else matrix
        if likelihood(changed) > likelihood(matrix) + 1e-6:
            of, matrix, idle = now, changed, 0
        else:  # moves made together got in each other's way: fewer at a time
            idle += 1
            share = min(share * 2, 16)
            if idle > 3:
                break
    return of, matrix


@dataclass(frozen=True)
class BrownModel:
    """Word counts and classes live in the blocks; this is what else the scores need."""

    n_tokens: int
    n_words: int
    transitions: np.ndarray
    end: int
    once: int

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of P(class | class before), of the share of unseen words after a class, and the counts of classes."""
        follows = self.transitions.sum(0)
        total = max(follows.sum(), 1.0)
        given = self.transitions.sum(1)
        with np.errstate(divide="ignore"):
            moves = np.log10((self.transitions + PRIOR * follows[None, :] / total) / (given + PRIOR)[:, None])
        unseen = (self.transitions[:, self.once] + PRIOR * (follows[self.once] + 1) / (follows.sum() + 2)) / (given + PRIOR)
        return moves, np.clip(unseen, 1e-9, 0.5), follows


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where `held` (of doc_id) is false."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held.alias("held"), "text")
    blocks = durable(_blocks(source))
    totals = durable(_totals(blocks, frequent))
    sums = totals.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    n_words, n_tokens = int(sums[0] or 0), int(sums[1] or 0)
    end = int(np.array([END]).view(np.int64)[0])
    top = totals.select(F.explode("leads").alias("lead")).select("lead.*").where(F.col("word") != end).orderBy("order", "word").limit(frequent).collect()
    chosen = np.sort(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64))
    coded = durable(_coded(blocks, totals, chosen))
    pairs = durable(_pairs(coded, 1 + len(chosen) + BANDS, "symbols"))
    # classes: of frequent words, dealt by rank at first; then the end; then one of each band
    by_rank = {r["word"]: k for k, r in enumerate(top)}
    k = min(classes, max(len(chosen), 1))
    n = k + 1 + BANDS
    start = np.array([k, *(by_rank[int(w)] % k for w in chosen.view(np.int64)), *(k + 1 + np.arange(BANDS))])
    of, matrix = _exchange(pairs, start, len(chosen), k, n, rounds if len(chosen) else 0)
    classed = durable(_classed(coded, _assigned(_neighbours(coded, of, len(chosen), n), matrix, k), of))
    model = BrownModel(n_tokens, n_words, _matrix(_pairs(classed, n, "classes"), np.arange(n), n), k, k + 1)
    moves, unseen, follows = model.tables()
    log_unseen, log_seen = np.log10(unseen), np.log10(1 - unseen)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.asarray(batch.column(2)[row].values)
                places, classes_, _ = _tokens(batch, row, "classes")
                totals_ = _unpacked(batch.column(4)[row].as_py(), "<i8")
                ends = np.concatenate([[0], np.cumsum(lengths)])
                a = 0
                while a < len(lengths):  # texts of about half a million tokens at a time
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + 500_000, side="right")) - 1)
                    part = slice(ends[a], ends[b])
                    count, cls = totals_[places[part]], classes_[part]
                    before = np.concatenate([[model.end], cls[:-1]])  # the text before ends with an end
                    seen = count > 0
                    with np.errstate(divide="ignore"):
                        emit = np.log10(np.maximum(count, 1) / np.maximum(follows[cls], 1))
                        value = np.where(seen, log_seen[before] + moves[before, cls] + emit, log_unseen[before])
                    base = np.log10((count + 1.0) / (n_tokens + n_words + 1.0))
                    add = lambda x: np.add.reduceat(x, ends[a:b] - ends[a])  # noqa: E731, B023
                    own = [pa.array(lengths[a:b].astype(np.int64)), pa.array(add(seen.astype(np.int64))), pa.array(np.full(b - a, n_tokens)), pa.array(add(base)), pa.array(add(value))]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[row].values.slice(a, b - a), batch.column(1)[row].values.slice(a, b - a), *own], names=names)
                    a = b

    return classed.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
