"""Components of links that come in several lots."""

import random

import numpy as np

import brute
from riskloom.llm import near_join


def test_later_links_are_followed_once(spark, monkeypatch):
    rng = random.Random(5)
    lots = [[(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (12, 10, 0, 9, 30)] + [[(7, 8), (7, 8)]]
    sizes = []
    whole = near_join.components

    def counted(edges):
        sizes.append(edges.count())
        return whole(edges)

    monkeypatch.setattr(near_join, "components", counted)
    links, root = near_join._Links(None, None, 5, 80), list(range(60))
    names = spark.createDataFrame([(i,) for i in range(60)], "rep long")
    for lot in lots:
        links.link(spark.createDataFrame(lot, "a long, b long"))
        for a, b in lot:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
        got = {r["rep"]: r["comp"] for r in links.label(names).collect()}
        assert got == dict(enumerate(root))
    assert sum(sizes) < sum(len({*lot}) for lot in lots)  # once, and none inside a component


def test_large_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(150)], []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 8)):
            text[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    counts = []
    real = near_join.durable

    def counted(df):
        out = real(df)
        if set(out.columns) >= {"a", "b"}:
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_join, "durable", counted)
    monkeypatch.setattr(near_join, "SMALL", 64)
    monkeypatch.setattr(near_join, "PIVOTS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.near_components(rows)
    assert max(counts) < 4 * len(rows)


def test_spanning_forest_joins_what_all_edges_join():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 40, 90) * -7, rng.integers(0, 40, 90) * -7
    x, y = x[x != y], y[x != y]

    def joined(edges):
        root = {k: k for k in [*x.tolist(), *y.tolist()]}
        for k in edges:
            low, high = sorted((root[int(x[k])], root[int(y[k])]))
            root = {node: low if r == high else r for node, r in root.items()}
        return root

    chosen = near_join._spanning(x, y)
    assert joined(chosen) == joined(range(len(x)))
    assert len(chosen) == len(joined([])) - len(set(joined(chosen).values()))
    assert not len(near_join._spanning(x[:0], y[:0]))
