"""Document fingerprints by consistent weighted sampling (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, split_words, starts_of, text_chunks, with_unique_ids, word_hashes

#: Samples in a fingerprint; the likeness of two has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 64
#: Ranges of doc_id per shuffle partition; a few spread evenly over the tasks.
RANGES = 4
#: Distinct words whose draws are held at a time, in a chunk or of one text.
TERMS = 1 << 18
#: Text bytes fingerprinted at a time.
BYTES = 4 << 20


def uniforms(hashes: np.ndarray, samples: int, stream: int) -> np.ndarray:
    """Uniform numbers in (0, 1), one per term and sample, fixed by the term's hash."""
    salt = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream * 0x51ED27))
    return ((mix(hashes[:, None] ^ salt) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)


def term_draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, ...]:
    """Per term and sample: r ~ Gamma(2, 1) and 1 / r, ln c with c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    r = -np.log(uniforms(hashes, samples, 1) * uniforms(hashes, samples, 2))
    log_c = np.log(-np.log(uniforms(hashes, samples, 3) * uniforms(hashes, samples, 4)))
    return r, 1 / r, log_c, uniforms(hashes, samples, 5)


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) unsigned 16-bit hashes of the sampled (term, level) pairs.

    Terms are words with their counts as weights. For a term of weight w and sample k,
    t = floor(ln w / r + beta), y = exp(r (t - beta)), a = c / (y e^r); the sample is the
    term with the least a together with its t, so two texts agree on a sample with a
    probability of sum(min) / sum(max) of their weights. Texts without words give zeros.
    """
    codes, words, per = split_words(pa.array(texts, pa.large_string()))
    hashes = word_hashes(words)
    shared = term_draws(hashes, samples) if len(hashes) <= TERMS else None
    bounds = starts_of(per)
    out = np.zeros((len(texts), samples), np.uint16)
    every = np.arange(samples)
    for i in range(len(texts)):
        all_terms, all_counts = np.unique(codes[bounds[i] : bounds[i + 1]], return_counts=True)
        best = np.full(samples, np.inf, np.float32)
        for at in range(0, len(all_terms), TERMS):
            terms, counts = all_terms[at : at + TERMS], all_counts[at : at + TERMS]
            r, inverse, log_c, beta = (x[terms] for x in shared) if shared is not None else term_draws(hashes[terms], samples)
            level = np.floor(np.log(counts.astype(np.float32))[:, None] * inverse + beta)
            rate = log_c - r * (level - beta + 1)
            least = rate.argmin(axis=0)
            better = rate[least, every] < best
            chosen = mix(hashes[terms[least]] ^ mix(level[least, every].astype(np.int64).view(np.uint64)))
            out[i, better] = (chosen[better] >> np.uint64(48)).astype(np.uint16)
            best[better] = rate[least, every][better]
    return out


def likeness(a: np.ndarray, b: np.ndarray, some_a: bool, some_b: bool) -> float:
    """The share of equal samples; texts without words are alike only to each other."""
    return float(np.mean(a == b)) if some_a and some_b else float(some_a == some_b)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the next text's first ones."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Each document meets the next one in ascending doc_id order (the last meets the first).
    Documents are dealt by ranges of the key and sorted inside; of each range the first
    document also goes, as an extra row, to the end of the range before, so one shuffle
    brings neighbours together. Range bounds are one number per partition.

    A fingerprint is the hexadecimal text of 16 bits per sample, and is the empty string for
    a text without words. Null texts are empty; null and repeated doc_ids are documents of
    their own, ordered by text; a single document is its own next one; an empty table
    gives no rows. Of a long text the draws of TERMS words are held at a time.
    """
    spark = docs.sparkSession
    keyed = with_unique_ids(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES * parts
    found = keyed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"), F.min("key").alias("least")).first()
    if found.least is None:
        return spark.createDataFrame([], RESULT)
    cuts = np.array(sorted(set(found.cuts)))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy()).astype(np.int32))

    # The first key of each range: one row per range.
    borders = sorted((r["part"], r["key"]) for r in keyed.select("key", range_of("key").alias("part")).groupBy("part").agg(F.min("key").alias("key")).collect())
    first_keys, before = np.array([k for _, k in borders]), np.roll(np.array([p for p, _ in borders], np.int32), 1)

    @F.pandas_udf("int")
    def range_before(key: pd.Series) -> pd.Series:
        return pd.Series(before[np.searchsorted(first_keys, key.to_numpy())])

    own = keyed.withColumn("part", range_of("key")).withColumn("tail", F.lit(False))
    tails = keyed.filter(F.col("key").isin(first_keys.tolist())).withColumn("part", range_before("key")).withColumn("tail", F.lit(True))
    dealt = own.unionByName(tails).repartition(parts, "part").sortWithinPartitions("part", "tail", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for chunk in text_chunks(batches, limit=BYTES):
            rows = held + list(zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True))
            held = rows[-1:]
            if len(rows) > 1:
                yield neighbours(rows, samples)

    return dealt.select("doc_id", "text", "tail").mapInArrow(run, RESULT)


def neighbours(rows: list[tuple], samples: int) -> pa.RecordBatch:
    """Results for all but the last of (doc_id, text, tail) rows in order; each row's next document is the row after it."""
    at = [i for i in range(len(rows) - 1) if not rows[i][2]]
    own = [r[1] for r in rows]
    changed = [edited(own[i], own[i + 1]) for i in at]
    marks = signatures(own + changed, samples)
    has = [bool(t.strip(" \t\n\v\f\r")) for t in own + changed]
    shown = [m.astype(">u2").tobytes().hex() if h else "" for m, h in zip(marks, has, strict=True)]
    after = range(len(own), len(own) + len(at))
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([rows[i][0] for i in at], pa.int64()), "n_chars": pa.array([len(own[i]) for i in at], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
        "fingerprint": pa.array([shown[i] for i in at], pa.string()), "edited_fingerprint": pa.array([shown[j] for j in after], pa.string()),
        "near_edited": pa.array([likeness(marks[i], marks[j], has[i], has[j]) for i, j in zip(at, after, strict=True)], pa.float64()),
        "near_next": pa.array([likeness(marks[i], marks[i + 1], has[i], has[i + 1]) for i in at], pa.float64()),
    })


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
