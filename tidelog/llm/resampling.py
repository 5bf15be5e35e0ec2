"""Importance resampling towards a target corpus, over hashed word n-grams (operator 13).

The bucket of an n-gram is the crc32 of its text modulo a number of buckets. No such text is ever
made: the register of a crc32 is linear over GF(2), so the crc of two strings in a row is the first one's,
shifted by the second one's length, plus the second one's. Each distinct word's crc is computed once;
those of its n-grams follow from shift matrices, as vectors over a whole chunk of text.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from .common import LOWER, UPPER, id_text, small_batches, split_words, starts_of, text_chunks

#: Buckets, and the words of the longest n-gram.
BUCKETS, LONGEST = 10_000, 3
#: Documents with fewer words are not drawn; the share of the others that is, in percent.
LEAST_WORDS, PERCENT = 20, 5
#: What the documents' random numbers are drawn by.
SEED = 42
#: Polynomial of crc32, lowest power first.
POLYNOMIAL = 0xEDB88320
#: Lengths up to which shifts have tables of their own.
NEAR = 64
#: Words whose crc a worker remembers.
REMEMBERED = 400_000


def times(matrix: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns as numbers, times each of the vectors x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@functools.cache
def byte_shift(doublings: int) -> np.ndarray:
    """The matrix that carries a crc over 2 ** doublings zero bytes."""
    if doublings:
        half = byte_shift(doublings - 1)
        return times(half, half)
    one_bit = np.array([POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
    two = times(one_bit, one_bit)
    four = times(two, two)
    return times(four, four)


@functools.cache
def near_tables() -> np.ndarray:
    """[length, byte of the crc, its value]: what that byte adds to a crc carried over `length` zero bytes."""
    out = np.zeros((NEAR, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for k in range(4):
        out[0, k] = values << np.uint32(8 * k)
    for length in range(1, NEAR):
        out[length] = times(byte_shift(0), out[length - 1])
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each crc carried over so many zero bytes."""
    tables = near_tables()
    low, b = length & (NEAR - 1), crc
    out = tables[low, 0, b & 255] ^ tables[low, 1, b >> 8 & 255] ^ tables[low, 2, b >> 16 & 255] ^ tables[low, 3, b >> 24]
    high, doublings = length >> 6, 6
    while high.any():
        some = np.flatnonzero(high & 1)
        out[some] = times(byte_shift(doublings), out[some])
        high, doublings = high >> 1, doublings + 1
    return out


def gram_crcs(crc: np.ndarray, size: np.ndarray, codes: np.ndarray, longest: int = LONGEST) -> list[np.ndarray]:
    """crc32 of the texts of all runs of 1 to `longest` entries of `codes`, joined by a space: the n-th array has those of n words, by their
    last word from the n-th on. `crc` and `size` are those of the distinct words that `codes` names."""
    after_space = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc  # of " word"
    word, step, add = crc[codes], (size + 1)[codes], after_space[codes]
    grams = [word]
    for n in range(1, longest):
        grams.append(shifted(grams[-1][:-1], step[n:]) ^ add[n:])
    return grams


#: Bytes of words stay, A-Z become a-z, all others are blanks.
PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


class WordCrcs:
    """crc32 and byte length of distinct words, remembered within bounds."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in words:
            if w not in self.known:
                b = w.encode()
                self.known[w] = len(b) << 32 | zlib.crc32(b)
        both = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return (both & 0xFFFFFFFF).astype(np.uint32), both >> 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the texts with A-Z lower-cased, as (codes, distinct words, words per text)."""
    texts = texts.cast(pa.large_string())
    data = texts.buffers()[2]
    plain = pa.py_buffer(data.to_pybytes().translate(PLAIN)) if data is not None else data
    return split_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], plain], offset=texts.offset))


def text_buckets(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Chunks of rows with their words per text, and for each n the buckets of the n-grams and the row that each is of."""
    crcs = WordCrcs()
    for chunk in text_chunks(batches):
        codes, words, per = words_of(chunk.column("text"))
        owner = np.repeat(np.arange(len(per), dtype=np.int32), per)
        crc, size = crcs(words.to_pylist())
        found, rows = [], []
        for n, gram in enumerate(gram_crcs(crc, size, codes.astype(np.int64), longest)):
            whole = slice(None) if n == 0 else owner[n:] == owner[:-n]  # within one text
            found.append((gram[whole] % np.uint32(buckets)).astype(np.int32))
            rows.append(owner[n:][whole])
        yield chunk, per, found, rows


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts in each bucket: every task counts its own, Spark adds up at most `buckets` numbers of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, found, _ in text_buckets(batches, buckets, longest):
            for some in found:
                total += np.bincount(some, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some])})

    got = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of the target's share of each bucket to the corpus's."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1) * (s.sum() + k) / ((a + 1) * (t.sum() + k)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of gains over all features of a text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, per, found, rows in text_buckets(batches, len(gains), longest):
            features, weight = np.zeros(len(per), np.int64), np.zeros(len(per), np.int64)
            for some, owner in zip(found, rows, strict=True):
                here = np.bincount(owner, minlength=len(per))
                sums, ends = np.append(0, np.cumsum(gains[some])), starts_of(here)
                features += here
                weight += sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "n_words": pa.array(per), "n_features": pa.array(features), "weight": pa.array(weight)})

    return id_text(docs).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def importance_resampling(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, n_words.

    Drawn without replacement, by the highest of weight plus Gumbel noise that depends on seed and doc_id alone: `percent` of the
    documents with at least `least_words` words, ranked from 1; others have no rank. Ties go to the smaller doc_id.
    Rows are ranked by ranges of the order, so no task sorts them all.

    A null or empty text has no features and weight 0. A null doc_id is drawn by the text `<seed>:` and comes after others in ties.
    Rows that repeat a doc_id have the same noise and ranks of their own. Texts count whole, whatever their length. Without documents
    there are no rows; without target texts, every gain follows from its smoothing alone.
    """
    small_batches(docs.sparkSession)
    texts = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gains = bucket_gains(bucket_counts(id_text(docs), buckets, longest), bucket_counts(texts, buckets, longest))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighted(docs, gains, longest).withColumns({"score": (F.col("weight") + noise).cast("long"), "later": (F.col("n_words") < least_words).cast("int"), "last": F.col("doc_id").isNull().cast("int")})
    ordered = positions(scored.withColumn("down", -F.col("score")), ["later", "down", "last", "doc_id"], "place")
    drawn = percent * ordered.filter("later = 0").count() // 100
    return ordered.select("doc_id", "n_features", "weight", "score", F.when((F.col("later") == 0) & (F.col("place") <= drawn), F.col("place").cast("long")).alias("rank"), "n_words")


_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH
table256 AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) AS c FROM range(256) r(b))),
bytes256 AS (SELECT map_from_entries(list((printf('%02x', b), b))) AS m FROM range(256) r(b)),
words AS (SELECT true AS own, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT false, item_id, {_WORDS} FROM benchmark),
grams AS (
  SELECT own, id, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM words, range(1, {LONGEST + 1}) a(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
texts AS (SELECT g, lower(hex(encode(g))) AS x FROM (SELECT DISTINCT g FROM grams)),
crcs AS (
  SELECT g, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(x) // 2), lambda k: m[x[2 * k + 1 : 2 * k + 2]])),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket
  FROM texts, table256, bytes256),
found AS (SELECT own, id, bucket FROM grams JOIN crcs USING (g)),
per AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM found GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM per),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM per, sums),
weights AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE own GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights ON id = doc_id WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, {PERCENT} * count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= drawn THEN place END AS rank, n_words FROM ranked
"""
