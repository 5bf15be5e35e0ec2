"""Helpers that the training-data operators share: columns, scratch space, word arrays.

Text helpers work on Arrow chunks of bounded size inside a task; Spark partitions,
shuffles and stores everything else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch, stored  # noqa: F401

#: Text bytes that a task turns into arrays at a time.
CHUNK_BYTES = 4 << 20
#: Rows, and bytes, that Spark hands to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 50_000, 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Documents are long rows and numbers short ones: what bounds an Arrow batch is its bytes."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) != str(most):
            spark.conf.set(key, str(most))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns can neither clash nor be read; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take Spark's faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_bucket(modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo; a null doc_id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def with_unique_ids(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): key is a unique long in doc_id order.

    It is doc_id itself where ids are unique and not null (one aggregate over the id
    column tells). Otherwise rows are numbered by (doc_id, nulls first; text), so that
    repeated ids and null ids each remain documents of their own.
    """
    d = id_text(docs)
    if ids_are_keys(d):
        return d.withColumn("key", F.col("doc_id"))
    ordered = d.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("key", F.monotonically_increasing_id())
    return stored(ordered, "ids")


def ids_are_keys(docs: DataFrame) -> bool:
    n, known, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    return n == known == distinct


def with_row_keys(docs: DataFrame) -> DataFrame:
    """`docs` with all columns and `_tidelog_row`, a key as that of with_unique_ids, for stages that give back whole rows."""
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    if ids_are_keys(docs.select(doc_id.alias("doc_id"))):
        return docs.withColumn("_tidelog_row", doc_id)
    ordered = docs.orderBy(doc_id.asc_nulls_first(), F.coalesce("text", F.lit(""))).withColumn("_tidelog_row", F.monotonically_increasing_id())
    return stored(ordered, "rows")


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pa.default_memory_pool().release_unused()
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, until - at)
            at = until


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in order, as (codes, distinct words, words per text)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    keep = real.to_numpy(zero_copy_only=False)
    if not keep.all():
        flat = flat.filter(real)
        per = np.bincount(np.repeat(np.arange(len(per)), per)[keep], minlength=len(per)).astype(np.int64)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, per


#: Bytes up to which words are hashed all together, eight bytes of each at a time.
SHORT_WORD = 64


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words. Words of one length up to eight bytes never share one."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    padded = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(padded) > 8:
        padded[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    blocks = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at, size = offsets[:-1] - offsets[0], np.diff(offsets)
    h = mix(size.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    some, done = np.flatnonzero((size > 0) & (size <= SHORT_WORD)), 0
    while len(some):
        left = size[some] - done
        x = blocks[at[some] + done]
        part = left < 8
        x[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        h[some] = mix(h[some] ^ x)
        some, done = some[left > 8], done + 8
    for i in np.flatnonzero(size > SHORT_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(padded[at[i] : at[i] + size[i]], seed)
    return h


def starts_of(per: np.ndarray) -> np.ndarray:
    """Offsets, with the total at the end."""
    out = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=out[1:])
    return out


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenate the slices flat[starts[c] : starts[c] + lengths[c]] of all codes."""
    n = lengths[codes]
    begin = starts_of(n)
    return flat[np.arange(begin[-1]) + np.repeat(starts[codes] - begin[:-1], n)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all n consecutive entries, joined from spans of doubling length; shorter by n - 1."""
    def join(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * (width + seed) + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        return mix(a * odd + b)

    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, width, span, have = None, 1, h, 0
    while n:
        if n & 1:
            done, have = (span, width) if done is None else (join(done[: len(span) - have], span[have:], have), have + width) if len(span) > have else (span[:0], have + width)
        n >>= 1
        if n:
            span, width = join(span[: len(span) - width], span[width:], width), 2 * width
    return done[: len(h) - have + 1]


#: Numbers of a column in one packet.
PACKET = 2048


def packets(bucket: np.ndarray, columns: dict[str, np.ndarray], kind: int = 0) -> pa.RecordBatch:
    """Rows (bucket, kind, a binary for each column of numbers or of rows of numbers): the entries of each bucket, in order,
    in packets of a bounded size. They cross a shuffle at a few bytes an entry and without a row for each."""
    if (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
        bucket, columns = bucket[order], {n: x[order] for n, x in columns.items()}
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(bucket)))
    cuts = -(-sizes // PACKET)
    begin = np.repeat(begin, cuts) + (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PACKET
    ends = np.append(begin, len(bucket)).astype(np.int64)

    def binary(x: np.ndarray) -> pa.Array:
        x = np.ascontiguousarray(x)
        return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends * x.strides[0]), pa.py_buffer(x)]).cast(pa.binary())

    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[begin].astype(np.int32)), "kind": pa.array(np.full(len(begin), kind, np.int32)), **{n: binary(x) for n, x in columns.items()}})


def unpacked(column: pa.Array, dtype: type) -> np.ndarray:
    """The numbers of all packets of a column."""
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), b"")[0].as_py() if len(column) else b""
    return np.frombuffer(data or b"", dtype)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, by its upper half."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def buckets_for(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions: a task must hold the distinct keys of one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def publish(fs: pafs.FileSystem, attempt: str, name: str) -> None:
    """Give a finished file its name; an earlier attempt's equal file goes first, as not every store renames onto one."""
    if fs.get_file_info(name).is_file:
        fs.delete_file(name)
    fs.move(attempt, name)
