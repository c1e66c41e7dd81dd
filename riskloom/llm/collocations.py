"""Phrase collocations: word sequences that are frequent in a language, scored against their parts.

1. Words. Texts are split once. Each run of texts keeps its distinct words and their places; Spark counts the words of a language, and
   frequent ones get numbers.
2. Levels. A phrase of n words is the pair of the numbers that its first and its last n - 1 words have, so its key is one integer, without
   collisions. A task forms keys only where both parts are frequent, as no phrase is more frequent than its parts, and counts
   them; counts go to parts by key, where they are summed, and keys that reach the threshold get the numbers of the next level.
   Each level is one pass over numbers and one shuffle, however many phrases are frequent: work grows with the text alone.
3. Scores are decimals of 38 digits. A phrase takes the counts of its beginnings from its first part and those of its ends from its last one,
   so each level joins the one before twice, on numbers. Words are put in only for phrases whose score can be among the best.

Tasks hold the frequent keys of one level, of which there is at most one in `LEAST` words of the text.

Defined results: null text counts as empty, a null language as `und`; repeated rows count as often as they occur; ids
and further columns don't matter; texts without words and empty tables give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, byte_class, drop, durable, give_back, lower_ascii, mix, prefix_hash, runs, span_hash, text_chunks

LONGEST = 5
LEAST = 100
BEST = 2000
#: Phrases, by occurrences, that a part's counts stand for; bounds what a task sums up at once.
SHARD = 4 << 20
#: Cells of the filter before the search for a key: a power of two from the first to the last of these, 16 for a frequent key.
CELLS = (1 << 16, 1 << 27)
#: Bytes of text of a run, and keys that a task counts together.
RUN, PENDING = 3 << 20, 1 << 20
#: Bytes of text of a task.
TASK = 128 << 20

_BREAK = byte_class(b".,;:!?\n\x0b\x0c\r")
_BLANK = byte_class(b" \t")
_STATE = "lang array<string>, words array<binary>, counts array<binary>, places binary, part int"
_SCHEMA = pa.schema([("lang", pa.list_(pa.string())), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())), ("places", pa.binary()), ("part", pa.int32())])


def _row(**values) -> pa.RecordBatch:
    """One row of `_STATE`: a run of texts (lang, words, places; later ones places alone), or counts of a part (words' with lang and words)."""
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _packed(a: np.ndarray) -> bytes:
    """Numbers of 32 bits, with the bytes of one place side by side."""
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<i4").ravel().astype(np.int64)


def _joined(words: pa.Array) -> bytes:
    """Words, which have no spaces, as one string."""
    one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
    return zstandard.ZstdCompressor(level=1).compress(one[0].as_buffer())


def _parted(blob: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([zstandard.ZstdDecompressor().decompress(blob)], pa.binary()).cast(pa.string()), " ")[0].values


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of a run of texts in lower case, the text of each one, and whether it begins a piece."""
    data = lower_ascii(data)
    breaks = _BREAK[data]
    starts, ends, owner = runs(~(breaks | _BLANK[data]), offsets)
    new = np.ones(len(starts), bool)
    if len(starts):
        upto = np.cumsum(breaks, dtype=np.int32)
        new[1:] = (owner[1:] != owner[:-1]) | (upto[starts[1:] - 1] != upto[ends[:-1] - 1])
    # a word with what follows it up to the next one, cut off by the offsets: words are every other string
    cuts = np.empty(2 * len(starts) + 1, np.int32)
    cuts[:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(data)
    both = pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    words = both.take(pa.array(np.arange(0, 2 * len(starts), 2))).view(pa.string()) if len(starts) else pa.array([], pa.string())
    return words, owner, new


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _words(docs: DataFrame, parts: int) -> DataFrame:
    """Each run of texts: its distinct words by language, and the place of each word among them, from 1, with a 0 before each piece; and words' counts by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), RUN):
                words, owner, new = _split(data, offsets)
                if not len(words):
                    continue
                coded, langs = words.dictionary_encode(), batch.column(0).slice(first, end - first).dictionary_encode()
                n = len(coded.dictionary)
                pairs, entry, count = np.unique(langs.indices.to_numpy()[owner].astype(np.int64) * n + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
                own, ends = np.unique(pairs // n, return_index=True)
                ends, names = np.append(ends, len(pairs)), langs.dictionary.take(pa.array(own)).to_pylist()
                places = np.insert(entry + 1, np.flatnonzero(new), 0)
                known = coded.dictionary.take(pa.array(pairs % n))
                yield _row(lang=names, words=[_joined(known.slice(a, b - a)) for a, b in zip(ends, ends[1:])], places=_packed(places))
                part = _part_of(known, parts)
                for p in range(parts):
                    hit = [a + np.flatnonzero(part[a:b] == p) for a, b in zip(ends, ends[1:])]
                    some = [(lang, h) for lang, h in zip(names, hit) if len(h)]
                    if some:
                        yield _row(part=p, lang=[lang for lang, _ in some], words=[_joined(known.take(pa.array(h))) for _, h in some], counts=[_packed(count[h]) for _, h in some])
        give_back()

    return durable(docs.mapInArrow(run, _STATE))


def _part_of(words: pa.Array, parts: int) -> np.ndarray:
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return (span_hash(prefix_hash(np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]]), at[:-1], at[1:]) >> np.uint64(20)) % np.uint64(parts)


def _by_part(state: DataFrame, parts: int, columns: list[str]) -> DataFrame:
    """The counts of each part one after the other, in one task."""
    return state.where("part is not null").select("part", *columns).repartition(parts, "part").sortWithinPartitions("part")


def _word_counts(state: DataFrame, parts: int) -> DataFrame:
    """lang, word, f of all words."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, size = None, [], 0

        def total() -> pa.Table:
            return pa.concat_tables(rows).group_by(["lang", "word"]).aggregate([("f", "sum")]).rename_columns(["lang", "word", "f"])

        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                if p != part and rows:
                    yield from total().to_batches()
                    rows, size = [], 0
                part = p
                for lang, words, n in zip(*(batch.column(c)[i].as_py() for c in (1, 2, 3))):
                    words = _parted(words)
                    rows.append(pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(words)), words, pa.array(_unpacked(n))], names=["lang", "word", "f"]))
                    size += len(words)
                if size >= PENDING:
                    rows, size = [total()], 0
        if rows:
            yield from total().to_batches()
        del rows
        give_back()

    return durable(_by_part(state, parts, ["lang", "words", "counts"]).mapInArrow(sums, "lang string, word string, f long"))


class _Counts:
    """Counts of a task's keys, given out by part: sorted keys as the steps of their upper and their lower halves, and how often each occurs."""

    def __init__(self, parts: int) -> None:
        self.parts, self.waiting, self.size = parts, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size >= PENDING:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.waiting, self.size = [], 0
            part = (mix(keys.astype(np.uint64)) >> np.uint64(20)) % np.uint64(self.parts)
            order = np.argsort(part, kind="stable")
            keys, n, ends = keys[order], n[order], np.searchsorted(part[order], np.arange(self.parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(ends[1:] > ends[:-1]):
                k = keys[ends[p] : ends[p + 1]]
                yield _row(part=int(p), counts=[_packed(np.concatenate([np.diff(k >> 32, prepend=0), k & 0xFFFFFFFF, n[ends[p] : ends[p + 1]]]))])


def _keys(places: np.ndarray) -> np.ndarray:
    """The key of each place and the next one, 0 where there is none."""
    return np.where((places[:-1] > 0) & (places[1:] > 0), places[:-1] << 32 | places[1:], 0)


def _filter(keys: np.ndarray) -> np.ndarray:
    """Bits of the cells that keys have."""
    cells = min(max(CELLS[0], 1 << (16 * len(keys)).bit_length()), CELLS[1])
    bits = np.zeros(cells, bool)
    bits[(mix(keys.astype(np.uint64)) & np.uint64(cells - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _numbers(asked: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted `keys`, from 1; 0 where it isn't there."""
    out = np.zeros(len(asked), np.int64)
    some = np.flatnonzero(asked)
    cell = (mix(asked[some].astype(np.uint64)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    some = some[bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 > 0]
    at = np.searchsorted(keys, asked[some])
    out[some] = np.where(keys[np.minimum(at, len(keys) - 1)] == asked[some], at + 1, 0)
    return out


def _closed(places: np.ndarray) -> np.ndarray:
    """Places without zeros that follow a zero, or nothing."""
    keep = places > 0
    keep[1:] |= places[:-1] > 0
    return places[keep]


def _word_numbers(lang: str, words: pa.Array, known: dict[str, tuple[int, pa.Array]]) -> np.ndarray:
    """The number of each word of a language, 0 for one that isn't frequent."""
    if lang not in known:
        return np.zeros(len(words), np.int64)
    first, own = known[lang]
    found = pc.index_in(words, value_set=own)
    return np.where(found.is_valid().to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy().astype(np.int64) + first + 1, 0)


def _vocabulary(frequent: pa.Table) -> dict[str, tuple[int, pa.Array]]:
    """For each language the number before its first word's, and its words."""
    frequent = frequent.select(["lang", "word"]).sort_by([("lang", "ascending"), ("word", "ascending")])
    out, first = {}, 0
    for lang, n in zip(*(c.to_pylist() for c in pc.value_counts(frequent["lang"].combine_chunks()).flatten())):
        out[lang] = (first, pa.concat_arrays(frequent["word"].slice(first, n).cast(pa.string()).chunks))
        first += n
    return out


def _level(state: DataFrame, parts: int, known: Broadcast) -> DataFrame:
    """Runs with the numbers of their frequent phrases of one length, and the counts of phrases that are a word longer, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(parts)
        for batch in batches:
            for i in range(batch.num_rows):
                places, langs = _unpacked(batch.column(2)[i].as_py()), batch.column(0)[i].as_py()
                if langs is None:
                    places = _numbers(_keys(places), *known.value)
                else:
                    numbers = [_word_numbers(lang, _parted(words), known.value) for lang, words in zip(langs, batch.column(1)[i].as_py())]
                    places = np.concatenate([[0], *numbers])[places]
                places = _closed(places)
                if len(places) > 1:
                    yield _row(places=_packed(places))
                    keys = _keys(places)
                    yield from counts.add(keys[keys > 0])
        yield from counts.rows()
        give_back()

    return durable(state.where("places is not null").select("lang", "words", "places").mapInArrow(run, _STATE))


def _frequent(level: DataFrame, parts: int) -> DataFrame:
    """key, f of the phrases that reach the threshold."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's counts come one after the other."""
        part, keys, n = None, [], []

        def total() -> pa.RecordBatch:
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")
            every, first = np.unique(every[order], return_index=True)
            f = np.add.reduceat(np.concatenate(n)[order], first)
            return pa.RecordBatch.from_arrays([pa.array(every[f >= LEAST]), pa.array(f[f >= LEAST])], names=["key", "f"])

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part and keys:
                    yield total()
                    keys, n = [], []
                part = p
                upper, lower, count = _unpacked(blob.as_py()[0]).reshape(3, -1)
                keys.append(np.cumsum(upper) << 32 | lower & 0xFFFFFFFF)
                n.append(count)
        if keys:
            yield total()
        give_back()

    return durable(_by_part(level, parts, ["counts"]).mapInArrow(sums, "key long, f long"))


def _counted(docs: DataFrame, size: int) -> tuple[list[DataFrame], list[int], DataFrame, Broadcast]:
    """Tables of frequent phrases by length: words (id, lang, f), then longer ones (id, p, s, f; p and s are the ids of their first
    and their last words); how many each has, the number of words of each language, and the vocabulary.
    """
    sc = docs.sparkSession.sparkContext
    # texts have a word for six bytes or more, but for odd ones
    parts = max(1, -(-size // (6 * SHARD)))
    few = -(-parts // 4)  # a run has its distinct words only
    state = _words(docs, few)
    words = _word_counts(state, few)
    n = durable(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = words.where(f"f >= {LEAST}")
    known = _vocabulary(frequent.select("lang", "word").toArrow())
    vocabulary = sc.broadcast(known)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = np.zeros(batch.num_rows, np.int64), batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(langs.indices.to_numpy() == i)
                ids[at] = _word_numbers(lang, batch.column(1).take(pa.array(at)), vocabulary.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0), batch.column(2)], names=["id", "lang", "f"])

    tables, sizes = [durable(frequent.select("lang", "word", "f").mapInArrow(numbered, "id long, lang string, f long"))], [sum(len(w) for _, w in known.values())]
    shared = vocabulary
    while len(tables) < LONGEST and sizes[-1]:
        older, state = state, _level(state, parts, shared)
        drop(older)
        found = _frequent(state, parts)
        keys = np.sort(found.select("key").toArrow()["key"].to_numpy())
        shared = sc.broadcast((keys, _filter(keys)))

        def numbered(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(key, *shared.value)), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), batch.column(1)], names=["id", "p", "s", "f"])

        tables.append(found.mapInArrow(numbered, "id long, p long, s long, f long"))
        sizes.append(len(keys))
    drop(state)
    return tables, sizes, broadcast_if_small(n, n.count(), 100), vocabulary


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    docs = _input(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a task counts what it has read before anything is shuffled, so there are no more tasks than keep the cores busy, or than 128 MB of text need
    docs = docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // TASK))
    tables, sizes, n, vocabulary = _counted(docs, size)
    none = F.array().cast("array<long>")
    # begins and ends: counts of the first 1, 2, ... and the last ..., 2, 1 words
    one, levels = tables[0].select("id", "lang", "f", F.array("id").alias("w"), none.alias("begins"), none.alias("ends")), []
    for table, before in zip(tables[1:], sizes):
        p, s = (broadcast_if_small(one.select(*(F.col(c).alias(f"{side}_{c}") for c in one.columns)), before, 200) for side in "ps")
        both = table.join(p, F.col("p") == F.col("p_id")).join(s, F.col("s") == F.col("s_id"))
        one = durable(both.select(
            "id", F.col("p_lang").alias("lang"), "f", F.concat("p_w", F.slice("s_w", -1, 1)).alias("w"), F.concat("p_begins", F.array("p_f")).alias("begins"), F.concat(F.array("s_f"), "s_ends").alias("ends"), "p", "s",
        ))
        levels.append(one)
        one = one.drop("p", "s")
    if not levels:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    kept = None
    for level, longer, most in zip(levels, [*levels[1:], None], [*sizes[2:], 0]):
        if longer is not None:
            # a phrase is as frequent as a longer one around it only if it is as frequent as one that is a word longer
            around = longer.select(F.explode(F.array("p", "s")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            level = level.join(broadcast_if_small(around, 2 * most, 16), "id", "left").where("longer is null or 100 * longer < 100 * f")
        level = level.select("lang", "w", "f", "begins", "ends")
        kept = level if kept is None else kept.unionByName(level)
    whole = lambda c: f"cast({c} as decimal(38,0))"
    score = f"cast((1000 * {whole('f')} * {whole('n')}) div (cast(begins[k - 1] as decimal(19,0)) * cast(ends[k - 1] as decimal(19,0))) as bigint)"
    cuts = f"transform(sequence(1, size(w) - 1), k -> struct({score} as score, k, begins[k - 1] as l, ends[k - 1] as r))"
    scored = kept.join(n, "lang").withColumn("cut", F.array_min(F.expr(cuts))).select("lang", "w", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    of = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored.withColumn("rank", F.rank().over(of)).where(F.col("rank") <= BEST).drop("rank")

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.concat_arrays([words for _, words in vocabulary.value.values()])
        for batch in batches:
            w = batch.column(1)
            words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(w).to_numpy())), pa.int32()), texts.take(pc.subtract(w.flatten(), 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join(words, " "), *batch.columns[2:]], names=["lang", "phrase", "a", "l", "r", "n", "score"])

    best = best.mapInArrow(spelt, "lang string, phrase string, a long, l long, r long, n long, score long")
    rank = F.row_number().over(of.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= BEST).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB's SQL.
ORACLE = """
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents),
ws as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from pieces),
n as (select lang, cast(sum(len(w)) as bigint) n from ws group by 1 having sum(len(w)) > 0),
g as (
  select lang, m, phrase, count(*) f from (
    select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase from ws, (select unnest(range(1, 6)) m) where len(w) >= m)
  group by all having count(*) >= 100),
c as (select lang, phrase, f, m, string_split(phrase, ' ') w from g where m > 1),
inner_ as (
  select lang, phrase, max(f) longer from (
    select distinct lang, f, whole, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) phrase
    from (select *, phrase whole from c where m > 2))
  group by 1, 2),
kept as (select c.* from c left join inner_ i using (lang, phrase) where i.longer is null or 100 * i.longer < 100 * c.f),
cuts as (select lang, phrase, f a, k, array_to_string(w[1:k], ' ') head, array_to_string(w[k + 1:], ' ') tail from (select *, unnest(range(1, m)) k from kept)),
scored as (
  select cuts.lang, cuts.phrase, a, k, h.f l, t.f r, n.n, cast(1000 * a::hugeint * n.n // (h.f::hugeint * t.f) as bigint) score
  from cuts join g h on h.lang = cuts.lang and h.phrase = head join g t on t.lang = cuts.lang and t.phrase = tail join n on n.lang = cuts.lang),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from least
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
