"""The suffix tree of operator 6 against a plain one that stores every sequence seen twice."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_training import corpus, words

from tidelog.llm import suffix_lm


def brute_scores(rows, depth):
    tokens = {i: [*words(t, True), None] for i, t in rows}
    train = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(tuple(w[k : k + d]) for w in train for d in range(1, depth + 2) for k in range(len(w) - d + 1))
    below = sum(map(len, train)) + 0.5 * (len([s for s in counts if len(s) == 1]) + 1)
    base = lambda x: (counts[(x,)] + 0.5) / below
    following = defaultdict(dict)
    for s, n in counts.items():
        if len(s) > 1 and n > 1:
            following[s[:-1]][s[-1]] = n
    kept = defaultdict(dict)

    def chance(context, x):
        if not context:
            return base(x)
        if context not in kept:
            return chance(context[1:], x)
        seen = kept[context]
        total = counts[context] + len(seen)
        return seen.get(x, 0) / total + (1 - sum(seen.values()) / total) * chance(context[1:], x)

    for context in sorted(following, key=len):
        diverge = {x: n for x, n in following[context].items() if n * math.log(n / (counts[context] + 1) / chance(context[1:], x)) >= suffix_lm.MIN_GAIN}
        if diverge:
            kept[context] = diverge
    return {i: sum(math.log10(chance(tuple(w[max(0, k - depth) : k]), x)) for k, x in enumerate(w)) for i, w in tokens.items()}


@pytest.mark.parametrize("spot", [suffix_lm.SPOT, 0.01])
def test_suffix_tree_has_every_repeated_sequence(spark, monkeypatch, spot):
    """A passage seen a few times among many other words is in the tree, scored on the spot or by the join."""
    monkeypatch.setattr(suffix_lm, "SPOT", spot)
    monkeypatch.setattr(suffix_lm, "FOLD", 500)
    r = random.Random(3)
    rows = corpus() + [(20_000 + i, " ".join(f"z{r.randrange(400)}" for _ in range(500)) + " rare words in a row") for i in range(9)]
    want = brute_scores(rows, suffix_lm.DEPTH)
    got = suffix_lm.suffix_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: x.score for x in got} == pytest.approx(want)


def test_lookups_cross_in_rounds(spark, monkeypatch):
    """A full filter sends every sequence of every token across; rounds of documents bound what does at a time, and no score changes."""
    tables, stored = [], suffix_lm.stored
    monkeypatch.setattr(suffix_lm, "stored", lambda df, name: tables.append(name) or stored(df, name))
    monkeypatch.setattr(suffix_lm, "ROUND_LOOKUPS", 1)
    monkeypatch.setattr(suffix_lm.KeyFilter, "wrong", lambda self: 1.0)
    monkeypatch.setattr(suffix_lm.KeyFilter, "may_have", lambda self, keys: np.ones(len(keys), bool))
    rows = corpus()
    got = suffix_lm.suffix_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: x.score for x in got} == pytest.approx(brute_scores(rows, suffix_lm.DEPTH), rel=1e-5)  # values are kept in single precision
    assert (tables.count("scores"), tables.count("sequences")) == (14, 4)


def test_pair_hash(spark):
    rows = [(0, 0), (1, -1), (2**62 + 5, -(2**63))]
    a, b = np.array(rows, np.int64).T
    want = [x[0] for x in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert suffix_lm.pair_hash(np.ascontiguousarray(a), np.ascontiguousarray(b)).tolist() == want
