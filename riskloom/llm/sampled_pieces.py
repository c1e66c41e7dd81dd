"""Distinct sampled SentencePiece segmentations: Gumbel top-k without replacement, by perturbed A-star over the lattice.

The lattice of a text has all pieces of the vocabulary as arcs, with weights by rank (Zipf's law over the model's order
of merges), and bytes for characters that have no piece. A word begins with its run of spaces, and pieces don't cross word
starts, so the lattice is a chain of word lattices; each distinct word of a run of about `RUN` bytes of whole texts is built
once, with its backward sums. A worker keeps the words' lattices up to `NODES` characters, then forgets them all.

The search keeps, per text, a queue of sets of segmentations with their perturbed log probabilities. The root's is a
Gumbel draw. Expanding a set samples the path that attains its maximum, and splits the rest by the first word that
differs from the path: (same words before, another segmentation here, anything after). Each part's maximum is a Gumbel
at the part's exact log mass, truncated at the set's own. These are upper bounds that the best path of the part attains, so
taking sets in order of their bounds emits distinct segmentations in order: a sample of k without replacement. With
kappa the bound of the next one, a segmentation's inclusion score is 1 - exp(-exp(log p - kappa)).

All draws are hashes of (key of the row, number of the sample, word, step): the same row gives the same result in any
partitioning. `decoded` turns ids back into texts. Defined results: null and empty texts have one segmentation, without
pieces; a text with fewer than k segmentations gives all it has, with score 1; rows that repeat an id are sampled alike; further
columns of the table don't matter; a literal U+2581 is decoded as a space; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, prefix_hash, span_hash, text_chunks

START = 0x2581
LONGEST = 16
SAMPLES = 4
#: Bytes of text whose lattices are in memory at once, but for a longer text.
RUN = 1 << 20
#: Characters of distinct words whose lattices a worker keeps from run to run.
NODES = 700_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        weight = -np.log(np.arange(len(ids)) + 10.0)
        self.byte_weight = -np.log(len(ids) + 10.0)
        keys = np.array([span_hash(prefix_hash(p := np.array(list(map(ord, self.pieces[i])), dtype=np.uint32)), np.array([0]), np.array([len(p)]))[0] for i in ids])
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], np.array(ids)[order], weight[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.longest = min(LONGEST, max(len(self.pieces[i]) for i in ids))
        # beginnings of pieces: a place whose text isn't one of them has no longer piece
        self.begins = np.zeros(1 << 22, dtype=bool)
        codes = np.array(sorted({self.pieces[i][:n] for i in ids for n in range(1, len(self.pieces[i]) + 1)}))
        joined = np.array(list(map(ord, "".join(codes))), dtype=np.uint32)
        ends = np.cumsum([len(c) for c in codes])
        heads = span_hash(prefix_hash(joined), ends - [len(c) for c in codes], ends)
        self.begins[(heads & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        byte = {int(i): bytes([b]) for b, i in enumerate(self.bytes)}
        spelled = [byte.get(i, piece.replace(chr(START), " ").encode()) for i, piece in enumerate(self.pieces)]
        self.spelled_at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are pieces, and the places of these."""
        there = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[there]), len(self.keys) - 1)
        same = self.keys[at] == hashes[there]
        return there[same], at[same]

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the segmentations that follow one another in `ids`, and the offsets of their texts.

        The inverse of any segmentation but for a literal U+2581, which becomes a space. The start that was put before a text
        is taken off.
        """
        begin = self.spelled_at[ids]
        lengths = self.spelled_at[ids + 1] - begin
        first = offsets[:-1][np.diff(offsets) > 0]
        begin[first] += 1
        lengths[first] -= 1
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.spelled[np.repeat(begin - upto[:-1], lengths) + np.arange(upto[-1])], upto[offsets]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of distinct words, laid out one after the other: a node per character, arcs sorted by node."""

    def __init__(self, vocab: Vocabulary, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        sizes = end - begin
        self.first = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        here = np.repeat(begin - self.first, sizes) + np.arange(total)
        chars = points[here]
        self.left = np.repeat(end, sizes) - here  # characters from a node to its word's end
        prefix = prefix_hash(chars)
        nodes, lengths, ids, weights = [], [], [], []
        start = np.arange(total)
        for n in range(1, vocab.longest + 1):
            start = start[self.left[start] >= n]
            hashes = span_hash(prefix, start, start + n)
            found, at = vocab.find(hashes)
            nodes.append(start[found])
            lengths.append(np.full(len(found), n))
            ids.append(vocab.ids[at])
            weights.append(vocab.weights[at])
            if n == 1:
                alone = np.ones(total, dtype=bool)
                alone[nodes[0]] = False
                other = np.flatnonzero(alone)
                used = 1 + (chars[other] >= 0x80) + (chars[other] >= 0x800) + (chars[other] >= 0x10000)
                nodes.append(other)
                lengths.append(np.ones(len(other), dtype=np.int64))
                ids.append(-chars[other].astype(np.int64) - 1)
                weights.append(vocab.byte_weight * used)
            start = start[vocab.begins[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)]]
        # arcs by node, the shorter ones first: each length's nodes are distinct
        count = np.bincount(np.concatenate(nodes), minlength=total)
        self.arc_from = arc_from = np.concatenate([[0], np.cumsum(count)])
        size = int(arc_from[-1])
        node = np.repeat(np.arange(total), count)
        self.length, self.id, weight = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size)
        free = arc_from[:-1].copy()
        for at, n, piece, w in zip(nodes, lengths, ids, weights):
            place = free[at]
            self.length[place], self.id[place], weight[place] = n, piece, w
            free[at] += 1
        # backward sums, by the distance to the word's end
        beta = np.zeros(total)
        by_left = np.argsort(self.left, kind="stable")
        cuts = np.searchsorted(self.left[by_left], np.arange(1, (self.left.max() if total else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            group = by_left[a:b]
            count = arc_from[group + 1] - arc_from[group]
            edges = np.cumsum(count) - count
            arcs = np.repeat(arc_from[group] - edges, count) + np.arange(int(count.sum()))
            target = node[arcs] + self.length[arcs]
            value = weight[arcs] + np.where(self.length[arcs] == self.left[node[arcs]], 0.0, beta[np.minimum(target, total - 1)])
            beta[group] = np.logaddexp.reduceat(value, edges)
        target = node + self.length
        ends = self.length == self.left[node]
        self.log = weight + np.where(ends, 0.0, beta[np.minimum(target, total - 1)]) - beta[node]
        p = np.exp(self.log)
        upto = np.concatenate([[0.0], np.cumsum(p)])
        share = (upto[1:] - upto[arc_from[node]]) / (upto[arc_from[node + 1]] - upto[arc_from[node]])
        self.reach = node + np.minimum(share, 1.0)
        self.reach[arc_from[1:] - 1] = np.arange(total) + 1.0

    def join(self, other: Lattices) -> None:
        """Append the words of `other`."""
        nodes, arcs = len(self.left), len(self.length)
        self.first = np.concatenate([self.first, other.first + nodes])
        self.left = np.concatenate([self.left, other.left])
        self.arc_from = np.concatenate([self.arc_from[:-1], other.arc_from + arcs])
        self.reach = np.concatenate([self.reach, other.reach + nodes])
        for name in ("length", "id", "log"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each word, by its seed: log probabilities, the arcs word after word, and where each word's begin."""
        n = len(word)
        log = np.zeros(n)
        order = np.argsort(word, kind="stable")  # neighbours in memory are visited together
        node, live, steps, taken = self.first[word[order]], order, [], 0
        count = np.zeros(n, dtype=np.int64)
        while len(live):
            draw = _uniform(seed[live] + np.uint64(taken * int(_C) & 0xFFFFFFFFFFFFFFFF))
            # the first of the node's arcs that reaches the draw; few arcs, so it is found from the first on
            arc, target, behind = self.arc_from[node], node + draw, np.arange(len(node))
            while len(behind := behind[self.reach[arc[behind]] <= target[behind]]):
                arc[behind] += 1
            log[live] += self.log[arc]
            count[live] += 1
            steps.append((live, arc))
            go = self.length[arc] < self.left[node]
            node = (node + self.length[arc])[go]
            live, taken = live[go], taken + 1
        at = np.cumsum(count) - count
        arcs = np.empty(int(count.sum()), dtype=np.int64)
        for k, (who, arc) in enumerate(steps):
            arcs[at[who] + k] = arc
        return log, arcs, np.append(at, len(arcs))

    def other(self, word: int, excluded: list[np.ndarray], seed: np.uint64) -> np.ndarray:
        """The arcs of a segmentation of one word that isn't any of `excluded`, drawn by the probabilities among the others.

        At each node an arc weighs its probability less that of the excluded ones that go on through it.
        """
        node = int(self.first[word])
        draws = _uniform(seed + np.arange(int(self.left[node]), dtype=np.uint64) * _C)
        out, rest = [], [(e.tolist(), np.cumsum(self.log[e][::-1])[::-1].tolist()) for e in excluded]
        while True:
            arcs = np.arange(self.arc_from[node], self.arc_from[node + 1])
            weights = np.exp(self.log[arcs])
            step = len(out)
            for path, left in rest:
                weights[path[step] - arcs[0]] -= np.exp(left[step])
            upto = np.cumsum(np.maximum(weights, 0.0))
            arc = int(arcs[min(int(np.searchsorted(upto, draws[step] * upto[-1], side="right")), len(arcs) - 1)])
            out.append(arc)
            if self.length[arc] == self.left[node]:
                return np.array(out)
            rest = [x for x in rest if x[0][step] == arc]
            node += int(self.length[arc])


class Known:
    """The lattices of the words that a worker has met."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.keys, self.places, self.lattices = vocab, np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def find(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold the words [begin, end) of `points`, and each word's place in them."""
        if self.lattices is not None and len(self.lattices.left) > NODES:
            self.__init__(self.vocab)
        keys, first, back = np.unique(span_hash(prefix_hash(points), begin, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            built = Lattices(self.vocab, points, begin[first[new]], end[first[new]])
            known = len(self.keys)
            if self.lattices is None:
                self.lattices = built
            else:
                self.lattices.join(built)
            joined = np.concatenate([self.keys, keys[new]])
            order = np.argsort(joined)
            self.keys, self.places = joined[order], np.concatenate([self.places, known + np.arange(len(new))])[order]
        return self.lattices, self.places[np.searchsorted(self.keys, keys)][back]


@lru_cache(maxsize=2)
def known_words(path: str) -> Known:
    return Known(vocabulary(path))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), by hash."""
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _gumbel_below(mass: np.ndarray, bound: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Gumbel draws at log mass `mass`, conditioned to be below `bound`."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -np.logaddexp(-bound, np.log(-np.log(np.maximum(draw, 1e-300))) - mass)
    return np.where(np.isneginf(mass), -np.inf, out)


def _rest(log: np.ndarray) -> np.ndarray:
    """log(1 - exp(log)); a word whose only segmentation it is leaves nothing."""
    p = np.minimum(np.exp(log), 1.0)
    with np.errstate(divide="ignore"):
        return np.where(p > 1 - 1e-12, -np.inf, np.log1p(-np.minimum(p, 1 - 1e-16)))


def search(known: Known, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, sample, ids, log p, perturbed log p, kappa) of the sampled segmentations of a run of texts."""
    texts, vocab = len(offsets) - 1, known.vocab
    filled = np.flatnonzero(np.diff(offsets) > 0)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    counts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.insert(np.where(points == 32, START, points), counts[filled], START)
    # each filled text begins with an inserted start; a word begins with the first of a run of starts
    text_begin = counts[filled] + np.arange(len(filled))
    starts = points == START
    starts[1:] &= points[:-1] != START
    starts[text_begin] = True
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(points))
    owner = np.searchsorted(text_begin, begin, side="right") - 1
    edges = np.searchsorted(owner, np.arange(len(filled) + 1))
    if len(begin):
        lattices, back = known.find(points, begin, end)
    place = np.arange(len(begin)) - edges[owner]
    base = mix(keys[filled])[owner] + (place.astype(np.uint64) + np.uint64(1)) * _A if len(begin) else np.zeros(0, np.uint64)
    root = -np.log(-np.log(np.maximum(_uniform(mix(keys[filled]) ^ _B), 1e-300)))
    n_filled = len(filled)
    paths: list[dict] = []
    excluded: list[dict[tuple[int, int], list[np.ndarray]]] = [{} for _ in range(n_filled)]

    def seeds(sample: int, use: int) -> np.ndarray:
        return base + np.uint64((sample * 4 + use) * int(_B) & 0xFFFFFFFFFFFFFFFF)

    def queue(path: dict, bound: np.ndarray, sample: int, since: np.ndarray) -> None:
        """The sets beside a path: of each word from `since` on, other segmentations after the same words."""
        before = np.cumsum(path["log"]) - path["log"]
        before -= before[edges[:-1]][owner]
        mass = before + _rest(path["log"])
        for t, i in path["branch"].items():  # here the segmentations of earlier paths are out as well
            w = edges[t] + i
            out = sum(float(np.exp(lattices.log[x].sum())) for x in excluded[t][(sample, i)])
            mass[w] = before[w] + (np.log(1 - out) if out < 1 - 1e-12 else -np.inf)
        draw = _uniform(seeds(sample, 1))
        bounds = _gumbel_below(mass, bound[owner], draw)
        bounds[place < since[owner]] = -np.inf
        path["bounds"] = bounds

    emitted: list[list[tuple]] = [[] for _ in range(n_filled)]
    kappa = np.full(n_filled, -np.inf)
    if len(begin):
        log, arcs, at = lattices.sample(back, seeds(0, 0))
        path = {"log": log, "arcs": arcs, "at": at, "branch": {}, "live": np.ones(n_filled, dtype=bool)}
        queue(path, root, 0, np.zeros(n_filled, dtype=np.int64))
        paths.append(path)
        for t in range(n_filled):
            emitted[t].append((0, float(root[t])))
    for sample in range(1, k + 1):
        if not len(begin):
            break
        best = np.stack([np.where(p["live"], np.maximum.reduceat(p["bounds"], edges[:-1]), -np.inf) for p in paths])
        parent = best.argmax(0)
        bound = best.max(0)
        if sample == k:
            kappa = bound
            break
        go = np.isfinite(bound)
        if not go.any():
            break
        path = {"branch": {}, "live": go, "log": (log := np.zeros(len(begin)))}
        since = np.zeros(n_filled, dtype=np.int64)
        words: dict[int, int] = {}
        replaced: dict[int, np.ndarray] = {}
        apart = seeds(sample, 2)
        for t in np.flatnonzero(go).tolist():
            old = paths[parent[t]]
            i = int(np.argmax(old["bounds"][edges[t] : edges[t + 1]]))
            words[t] = w = int(edges[t]) + i
            old["bounds"][w] = -np.inf
            since[t] = i
            out = list(excluded[t].get((int(parent[t]), i), ())) or [old["arcs"][old["at"][w] : old["at"][w + 1]]]
            replaced[w] = lattices.other(int(back[w]), out, apart[w])
            excluded[t][(sample, i)] = [*out, replaced[w]]
            log[edges[t] : w], log[w] = old["log"][edges[t] : w], lattices.log[replaced[w]].sum()
        # only the words after the one that differs are drawn anew
        tail = np.flatnonzero(go[owner] & (place > since[owner]))
        log[tail], arcs, at = lattices.sample(back[tail], seeds(sample, 0)[tail])
        tail_at = np.searchsorted(tail, edges)
        parts, sizes = [], []
        for t in range(n_filled):
            if not go[t]:
                continue
            old, w = paths[parent[t]], words[t]
            mine = [old["arcs"][old["at"][edges[t]] : old["at"][w]], replaced[w], arcs[at[tail_at[t]] : at[tail_at[t + 1]]]]
            parts += mine
            head = np.diff(old["at"][edges[t] : w + 1])
            sizes += [head, [len(replaced[w])], np.diff(at[tail_at[t] : tail_at[t + 1] + 1])]
            path["branch"][t] = int(since[t])
            emitted[t].append((sample, float(bound[t])))
        # arcs of texts that don't go on are left out; their words have none
        lengths = np.zeros(len(begin), dtype=np.int64)
        lengths[go[owner]] = np.concatenate(sizes) if sizes else []
        path["arcs"] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        path["at"] = np.concatenate([[0], np.cumsum(lengths)])
        queue(path, bound, sample, since)
        paths.append(path)
    by_text = dict(zip(filled.tolist(), range(n_filled)))
    for path in paths:
        ids = lattices.id[path["arcs"]]
        single = (ids < 0) & (ids >= -128)
        ids[single] = vocab.bytes[-ids[single] - 1]
        path["ids"] = ids
        path["sums"] = np.add.reduceat(path["log"], edges[:-1])
    for text in range(texts):
        t = by_text.get(text)
        if t is None:
            yield text, 0, np.zeros(0, np.int64), 0.0, 0.0, -np.inf
            continue
        for sample, perturbed in emitted[t]:
            path = paths[sample]
            ids = path["ids"][path["at"][edges[t]] : path["at"][edges[t + 1]]]
            yield text, sample, _spelled(vocab, ids), float(path["sums"][t]), perturbed, float(kappa[t])


def _spelled(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The ids, with the bytes of characters that have no piece."""
    if ids.min() >= 0:
        return ids
    out: list[int] = []
    for i in ids.tolist():
        out += [i] if i >= 0 else vocab.bytes[list(chr(-i - 1).encode())].tolist()
    return np.array(out)


def segmentations(docs: DataFrame, k: int = SAMPLES, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample (from 0), n_tokens, log_prob, perturbed, inclusion, ids, text_crc32: `k` distinct segmentations of each text.

    text_crc32 is the checksum of the text that the ids decode to.
    """
    path = path or default_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("key"), F.col(text_col).alias("text"))
    names = ["doc_id", "sample", "n_tokens", "log_prob", "perturbed", "inclusion", "ids", "text_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(path)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(2), RUN):
                keys = batch.column(1).slice(first, end - first).to_numpy().view(np.uint64)
                rows, samples, ids, scores = [], [], [], []
                for text, sample, own, *score in search(known, data, offsets, keys, k):
                    rows.append(first + text), samples.append(sample), ids.append(own), scores.append(score)
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = np.concatenate(ids)
                decoded, ends = known.vocab.decode_many(flat.astype(np.int64), at)
                scores = np.array(scores)
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(samples, pa.int32()), pa.array(np.diff(at)), pa.array(scores[:, 0]), pa.array(scores[:, 1]),
                    pa.array(-np.expm1(-np.exp(np.minimum(scores[:, 0] - scores[:, 2], 700)))), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([zlib.crc32(decoded[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, sample int, n_tokens long, log_prob double, perturbed double, inclusion double, ids array<int>, text_crc32 long")


def decoded(segments: DataFrame, path: str | None = None, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """`segments` and the text of each row's ids as column `name`; null ids have a null text, and without ids it is empty."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(part.schema.get_field_index(ids_col))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                data, ends = vocab.decode_many(flat, at)
                raw = data.tobytes()
                out = [raw[x:y].decode() if ok else None for x, y, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, name])

    return segments.mapInArrow(run, T.StructType([*segments.schema.fields, T.StructField(name, T.StringType())]))
