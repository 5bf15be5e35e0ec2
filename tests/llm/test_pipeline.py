"""The pipeline's stages one by one against plain versions of each."""

import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from test_training import brute_components, brute_language, brute_windows, corpus, words

from tidelog.llm import language_id

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus(9)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    before = {i: t for i, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            found = brute_language([(i, t, "en") for i, t in before.items()], lambda i: zlib.crc32(str(i).encode()) % 4 != 2)
            letters = {i: sum(c.isalpha() for c in t or "") for i, t in before.items()}
            assert set(kept) == {i for i, (x, score) in found.items() if x != "und" and (score >= language_id.MIN_SCORE or letters[i] < language_id.ENOUGH_LETTERS)}
        elif name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                k = "".join(c.lower() if c.isascii() else c for c in t or "")
                groups[k] = max(i, groups.get(k, -1))
            assert set(kept) == set(groups.values())
        elif name == "ngram_join":
            assert set(kept) == {c for _, c in brute_components(list(before.items())).values()}
        else:
            want = brute_windows(list(before.items()))
            assert set(kept) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
            assert all(len(words(t)) == want[i][0] - want[i][1] for i, t in kept.items())
        before, docs = kept, spark.createDataFrame(out.collect(), COLUMNS)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(before)


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS).repartition(3)


def test_repeated_ids_are_rows_of_their_own(spark):
    """Of a repeated row one stays; texts that share an id don't share marks or decisions."""
    stages = dict(corpus_pipeline.STAGES)
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(7, a, "x"), (7, a, "x"), (7, b, "y"), (9, a, "z"), (9, c, "z")]
    for name, want in (("exact_dedup", [(7, b), (9, a), (9, c)]), ("ngram_join", [(7, a), (7, b), (9, c)]), ("substring_dedup", [(7, a), (7, b), (9, c)])):
        assert sorted((r.doc_id, r.text) for r in stages[name](spark, odd(spark, rows), "").collect()) == want, name


def test_null_ids_stay_in_stages(spark):
    """Null ids alone, and in a component, whose clean documents don't go with them."""
    stages = dict(corpus_pipeline.STAGES)
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = a.replace("a59", "edit")
    rows = [(None, b, "x"), (None, c, "y"), (None, a, "x"), (3, near, "z"), (4, near, "z")]
    got = {n: [(r.doc_id, r.text) for r in stages[n](spark, odd(spark, rows), "").collect()] for n in ("exact_dedup", "ngram_join", "substring_dedup")}
    assert sorted(got["exact_dedup"], key=lambda r: r[1]) == [(None, a), (4, near), (None, b), (None, c)]
    assert sorted(got["ngram_join"], key=lambda r: r[1]) == [(None, a), (None, b), (None, c)]
    assert sorted(got["substring_dedup"], key=lambda r: r[1]) == [(None, a), (None, b), (None, c), (3, "edit")]


def test_empty_tables_and_clashing_columns(spark):
    """Extra columns of any name and type come through; empty tables stay empty."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a, "en", "s", 3), (2, a + " more", "en", "s", 3), (3, f"{b} {a}", "en", "s", 3)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({"key": F.lit("k"), "_keep": F.lit(7), "_starts": F.lit(None).cast("array<int>"), "_marks": F.lit(1.5), "_row": F.lit("r"), "h": F.lit(1), "words": F.lit("w")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all((r.key, r._keep, r._starts, r._marks, r._row, r.h, r.words) == ("k", 7, None, 1.5, "r", 1, "w") for r in got), name
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()) == 3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == [], name
