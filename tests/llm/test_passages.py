"""Spelling variants, repeated passages and collocations against brute force."""

import random

import brute
import numpy as np
import pytest

from riskloom.llm import collocations, spelling, suffix_dedup

LONG = "".join(f"w{i} " for i in range(20000))


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def table(spark, rows, columns):
    """Rows with further columns whose names clash with the operators' own."""
    kinds = ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in columns)
    return spark.createDataFrame([(*r, 1, "x", b"g") for r in rows], f"{kinds}, n long, word string, part binary").repartition(3)


def same(got, expected):
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected, key=key)


def misspelt(seed, documents=150):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    rows = []
    for i in range(documents):
        words = []
        for _ in range(60):
            w = base[min(int(rng.paretovariate(0.7)) - 1, 59)]
            while rng.random() < 0.15:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abcé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abÉ") + w[k + 1 :]])
            words.append(w)
        rows.append((i, rng.choice([" ", "1", "\n", ". "]).join(words)))
    long = "ab" * 2000 + "c"
    rows += [(None, "Hellooo hellooo"), (7, None), (8, ""), (8, ""), (9, "×÷ letters×letters÷lettérs"), (10, "letters Lettérs lettérs"), (10, "letters Lettérs lettérs")]
    return rows + [(11, f"{long} {long[:-1]}"), (12, f"{long} {long[:-1]} {long[:1999]}x{long[1999:]}"), (13, f"{long[:1999]}x{long[1999:]}"), (14, "日本語 "), (15, LONG)]


def test_spelling_equals_brute_force(spark, monkeypatch):
    rows = misspelt(1)
    df = table(spark, rows, ["doc_id", "text"])
    expected = brute.spelling(rows)
    assert any(r[1] for r in expected) and any(r[1] and r[1] != r[2] for r in expected)
    same(spelling.variants(df), expected)
    for name, small in (("SHARD", 200), ("WAVE", 20_000), ("TASK", 100), ("STATES", 1000)):
        monkeypatch.setattr(spelling, name, small)
    same(spelling.variants(df), expected)
    same(spelling.variants(df.where("false")), [])
    same(spelling.variants(table(spark, [(1, None), (2, "short words only")], ["doc_id", "text"])), [])


def test_trie_finds_all_neighbours():
    import pyarrow as pa

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    trie = spelling.Trie(pa.array(words), np.ones(len(words), np.int64))
    asked = ["", *words[:100], "zzz"]
    w, x = trie.near(*spelling._latin(pa.array(asked)))
    cut = lambda s: {s[:k] + s[k + 1 :] for k in range(len(s))}
    near = lambda a, b: a != b and (sum(p != q for p, q in zip(a, b)) == 1 if len(a) == len(b) else b in cut(a) or a in cut(b))
    assert {(asked[i], words[j]) for i, j in zip(w, x)} == {(a, b) for a in asked for b in words if near(a, b)}


def passages(seed, documents=200):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdefghij klmnop éß\n") for _ in range(rng.randrange(40, 300))) for _ in range(12)]
    rows = []
    for i in range(documents):
        t = ""
        for _ in range(rng.randrange(0, 5)):
            t += "".join(rng.choice("abcde fghij") for _ in range(rng.randrange(0, 120)))
            if rng.random() < 0.6:
                p = rng.choice(shared)
                a = rng.randrange(len(p))
                t += p[:a] if rng.random() < 0.5 else p[a:]
        rows.append((i * 7, t))
    rows += [(None, shared[0]), (None, None), (3, shared[0] * 3), (3, shared[0]), (3, None), (5000, "x" * 3000), (5001, "x" * 60), (5002, "ab" * 500), (9, "x" * 49), (-4, shared[1])]
    hot = "a passage that very many documents of this table have in common, with one beginning and another end. "
    rows += [(6000 + i, f"{rng.random()} {hot * 2}{rng.random()}") for i in range(150)]
    return rows + [(7000, LONG), (7001, LONG[100:50_000]), (7002, LONG), (7002, LONG)]


def test_repeats_equal_brute_force(spark, monkeypatch):
    rows = passages(2)
    df = table(spark, rows, ["doc_id", "text"])
    expected = brute.repeated(rows)
    same(suffix_dedup.report(df), expected)
    for name, small in (("RANGE", 20), ("CHUNK", 500), ("PART", 20_000), ("BUCKET", 100), ("HEAVY_LEAST", 2)):
        monkeypatch.setattr(suffix_dedup, name, small)
    same(suffix_dedup.report(df), expected)
    same(suffix_dedup.report(df.where("false")), [])
    same(suffix_dedup.report(df.where("text is null")), [r for r in expected if r[1] == 0 and r[0] in (None, 3)])


def test_repeats_leave_the_rest_of_the_text(spark):
    common = "these are more than fifty bytes that both of the two documents have. "
    df = spark.createDataFrame([(2, "Before. " + common + "After."), (1, common), (3, None)], "doc_id int, text string")
    found = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert found == {1: common, 2: "Before. After.", 3: ""}


def test_multikey_order_sorts_rows():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (500, 3)).astype(np.uint64)
    assert (keys[suffix_dedup.multikey_order(keys)] == keys[np.lexsort(keys.T[::-1])]).all()


@pytest.mark.parametrize("shard", [None, 300])
def test_collocations_equal_brute_force(spark, monkeypatch, shard):
    rng = random.Random(2)
    pick = lambda: rng.choice(["a", "b", "É", "C", "d"]) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "])
    rows = [(rng.choice(["en", None, "de"]), "".join(pick() for _ in range(200)) if i % 9 else rng.choice([None, "", "  ", "."])) for i in range(120)]
    rows += [("en", LONG), ("en", LONG), ("xx", None)]
    if shard:
        monkeypatch.setattr(collocations, "SHARD", shard)
        monkeypatch.setattr(collocations, "CELLS", (1 << 16, 1 << 16))
    df = table(spark, rows, ["lang", "text"])
    same(collocations.collocations(df), brute.collocations(rows))
    same(collocations.collocations(df.where("false")), [])


def test_collocations_read_the_text_once(spark, monkeypatch):
    """However many phrases are frequent, there are as many passes: none for each lot of them."""
    monkeypatch.setattr(collocations, "SHARD", 2000)

    def jobs(phrases):
        line = " ".join(f"w{i}" for i in range(phrases))
        group = f"collocations-{phrases}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = collocations.collocations(table(spark, [("en", line)] * 100, ["lang", "text"])).collect()
            return len(rows), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (few, jobs_of_few), (many, jobs_of_many) = jobs(50), jobs(1500)
    assert few < many
    assert jobs_of_many <= jobs_of_few + 20
