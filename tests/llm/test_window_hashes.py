"""Windows whose hashes agree are compared word by word, and no repeat is lost."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_training import brute_windows

from tidelog.llm import common, substring_dedup


@pytest.mark.parametrize("bits", [0, 3])
def test_forged_collisions_keep_their_words(spark, monkeypatch, bits):
    """Own hashes that all agree (or have eight values): what goes is what is repeated, all of it."""
    r = random.Random(1)
    line = " ".join(f"line{k}" for k in range(12))
    rows = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(12)) + f" {line} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(12))) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(3)]
    real = substring_dedup.unpacked_windows
    keyed = spark.createDataFrame(rows, "key long, text string").coalesce(2)

    def forged(batch):
        anchor, own, key, start = real(batch)
        return anchor, own & np.uint64((1 << bits) - 1), key, start

    want = {i: n for i, (_, n, _) in brute_windows(rows).items()}
    monkeypatch.setattr(substring_dedup, "unpacked_windows", forged)
    levels = np.zeros(substring_dedup.COUNTERS, np.uint8)
    chunks = [b for part in (rows[:20], rows[20:]) for b in substring_dedup.entries_of(pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "text": [t for _, t in part]}), levels, 1)]
    order = [("anchor", "ascending"), ("key", "ascending"), ("start", "ascending")]
    folder = common.scratch(spark, "forged")
    monkeypatch.setattr(substring_dedup.TaskContext, "get", lambda: type("Task", (), {"taskAttemptId": lambda _: 0})())
    found = list(substring_dedup.merge(iter(pa.Table.from_batches(chunks).sort_by(order).combine_chunks().to_batches()), [], folder))
    spans = pa.Table.from_batches(found)
    marks = substring_dedup.verified(substring_dedup.with_earlier_words(spark.createDataFrame(spans.to_pylist(), substring_dedup.SPANS), keyed), keyed).collect()
    text, gone = dict(rows), dict.fromkeys(want, 0)
    for key in {m.key for m in marks}:
        gone[key] = int(substring_dedup.covered(text[key].encode().split(), [m.asDict() for m in marks if m.key == key]).sum())
    assert gone == want and sum(want.values()) == 3 * 36


def test_hot_anchors_are_split(spark, monkeypatch):
    """One line fills most documents: with every anchor split by bits of its windows, and with its windows in several batches, nothing changes."""
    r = random.Random(2)
    line = " ".join(f"line{k}" for k in range(8))
    rows = [(k, " ".join([f"w{r.randrange(10**6)}", *[line] * r.randrange(1, 6), f"w{r.randrange(50)}", *[line] * 3])) for k in range(60)]
    monkeypatch.setattr(substring_dedup, "SPLIT_LEVEL", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_dedup(docs).collect()} == brute_windows(rows)
