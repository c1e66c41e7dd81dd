"""Stages of the corpus pipeline on rows with null, repeated and negative ids, clashing columns and empty tables."""

import pytest

WORDS = [f"w{i}" for i in range(60)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, component_id long, word string"


@pytest.fixture(scope="module")
def rows(spark):
    def make(pairs):
        return spark.createDataFrame([(i, t, "en", None, 0, "clash", 7, "clash") for i, t in pairs], COLUMNS).repartition(3)

    return make


def texts(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))


def expected(pairs):
    return sorted((i is None, i or 0, t or "") for i, t in pairs)


def test_near_works_by_row(spark, small, rows):
    import corpus_pipeline

    base, cut, other = " ".join(WORDS), " ".join(WORDS[:58]), "other text entirely here"
    cases = [
        ([(-5, base), (None, cut), (-1, other)], [(-5, base), (-1, other)]),
        ([(-5, base), (None, cut)], [(-5, base)]),
        ([(None, base), (None, cut), (None, other), (None, None), (None, "")], None),
        ([(3, base), (3, cut), (3, other), (2, cut), (9, None), (9, None)], [(2, cut), (3, other), (9, None), (9, None)]),
        ([(4, base), (-7, base), (None, base), (-7, other)], [(-7, base), (-7, other)]),
        ([], []),
    ]
    for given, left in cases:
        df = rows(given) if given else rows([(1, "x")]).where("false")
        found = corpus_pipeline.near(spark, df, small)
        assert found.columns == df.columns
        if left is None:
            assert sorted(t for _, _, t in texts(found)) in (["", "", other, base], ["", "", other, cut])
        else:
            assert texts(found) == expected(left)


def test_other_stages_keep_rows_and_columns(spark, small, rows):
    import corpus_pipeline

    good = "This is a plain sentence that somebody wrote for other people to read. " * 5
    given = [(None, good), (None, None), (-2, good + "End."), (5, "password = \"abcdefgh1234\" " + good), (5, ""), (6, "a b  c"), (7, "a\tbc")]
    df = rows(given)
    exact = corpus_pipeline.exact(spark, df, small)
    assert exact.columns == df.columns
    assert texts(exact) == expected([(None, good), (-2, good + "End."), (5, "password = \"abcdefgh1234\" " + good), (5, ""), (6, "a b  c")])
    masked = corpus_pipeline.secrets(spark, df, small)
    assert masked.columns == df.columns and masked.count() == len(given)
    assert not any("abcdefgh1234" in (r["text"] or "") for r in masked.collect())
    packed = corpus_pipeline.pack(spark, df, small)
    assert packed.count() >= len(given)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, df.where("false"), small).count() == 0, name
