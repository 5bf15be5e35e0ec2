"""Language-model scores from a probabilistic suffix tree over words (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, buckets_for, discard, id_bucket, mix, packets, publish, scratch, split_words, store_of, stored, text_chunks, unpacked, with_unique_ids, word_hashes

#: Words of the longest context (the tree's memory), and the least count of a sequence that is stored.
DEPTH, MIN_COUNT = 3, 2
#: Nats that a next word must gain, over all its occurrences in a context, for the context to be kept for it.
MIN_GAIN = 3.0
#: Share of all training tokens from which a sequence is scored on the spot, without the join. It bounds
#: what is broadcast, (DEPTH + 1) / SPOT sequences of 20 bytes at most, and changes no score.
SPOT = 2.0**-22
#: Hash that stands for the end of a text.
END = 0
#: Entries that a task gathers before it folds equal ones, or sends them on.
FOLD = 1_500_000
#: Bits of a filter, and the slices in which tasks send it.
BITS, SLICES = 1 << 28, 64

#: Lookups for each token of all documents that cross the shuffle in one round, and lookups that do in any case; the share that values meet at least.
ROUND_SHARE, ROUND_LOOKUPS, MEET_SHARE = 0.3, 1 << 25, 0.2
#: Share of wrong answers of a filter from which sequences are counted in two halves, one after the other.
FULL = 0.25

#: Packets of the scoring join: values of words and of sequences, lookups of words and of sequences, documents, and parts of their sums.
WORD_VALUE, VALUE, WORD_LOOKUP, LOOKUP, DOCUMENT, PART = range(6)
PACKETS = "bucket int, kind int, keys binary, numbers binary"


class Tally:
    """Counts within a task of entries that are told apart by a 64-bit key."""

    def __init__(self, buckets: int, *names: str) -> None:
        self.buckets, self.names, self.parts, self.size = buckets, names, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts, *more))
        self.size += len(keys)
        if self.size > FOLD and len(self.parts) > 1:
            self.fold()
            if len(self.parts[0][0]) > 2 * FOLD:
                yield from self.rows()

    def fold(self) -> None:
        keys, counts, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, counts, first = summed(keys, counts)
        self.parts = [(keys, counts, *(x[first] for x in more))]
        self.size = len(keys) // 2  # only what comes on top counts in full

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.fold()
            keys, counts, *more = self.parts[0]
            yield packets(bucket_of(keys, self.buckets), dict(zip(self.names, (*(more or [keys]), counts), strict=True)))
        self.parts, self.size = [], 0


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in unsigned order, which is that of buckets too, the sum of each one's numbers, and where each stands."""
    order = np.argsort(keys.view(np.uint64))
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(numbers[order], begin) if len(begin) else numbers[:0], order[begin]


def hashed_words(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with an end after each text, hash of each code, tokens per text); words are lower-cased A-Z."""
    codes, words, per = split_words(pc.ascii_lower(chunk.column("text")))
    h = word_hashes(words).view(np.int64)
    h = np.append(np.where(h == END, 1, h), END)
    return np.insert(codes.astype(np.int64), np.cumsum(per), len(words)), h, per + 1


def of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packets of one bucket at a time, from batches that are sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and b > a and held[0].column("bucket")[0].as_py() != bucket[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def dealt(rows: DataFrame) -> DataFrame:
    """Packets of a bucket together, those of values first."""
    return rows.repartitionById(buckets_for(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "kind")


#: Numbers that are hashed at a time, so that they stay in a processor's cache.
HASHED = 1 << 14


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(a, b) of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    out, t = np.full(len(a), 42, np.uint64), np.empty(min(len(a), HASHED), np.uint64)

    def turn(x: np.ndarray, n: int, y: np.ndarray) -> None:
        np.right_shift(x, np.uint64(64 - n), out=y)
        np.left_shift(x, np.uint64(n), out=x)
        np.bitwise_or(x, y, out=x)

    def fold(x: np.ndarray, n: int, y: np.ndarray) -> None:
        np.right_shift(x, np.uint64(n), out=y)
        np.bitwise_xor(x, y, out=x)

    for at in range(0, len(a), HASHED):
        h = out[at : at + HASHED]
        y = t[: len(h)]
        for part in (a, b):
            x = part[at : at + HASHED].view(np.uint64) * p2
            turn(x, 31, y)
            x *= p1
            h += p5 + np.uint64(8)
            h ^= x
            turn(h, 27, y)
            h *= p1
            h += p4
            fold(h, 33, y)
            h *= p2
            fold(h, 29, y)
            h *= p3
            fold(h, 32, y)
    return out.view(np.int64)


def sequence_keys(codes: np.ndarray, h: np.ndarray, depth: int) -> list[np.ndarray]:
    """Keys of all runs of 1 to depth + 1 tokens. The run of d + 1 that starts at i has the pair hash of
    the keys of its context, which starts at i too, and of its suffix, at i + 1."""
    keys = [h[codes]]
    for _ in range(min(depth, len(codes) - 1)):
        keys.append(pair_hash(keys[-1][:-1], keys[-1][1:]))
    return keys


class KeyFilter:
    """A Bloom filter of fixed size: saves lookups that no value would meet, never one that it would."""

    def __init__(self, *tables: DataFrame):
        """Of the one column of each table."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, *places = KeyFilter.places(batch.column(0).to_numpy())
                yield packets(np.concatenate([which] * len(places)), {"places": np.concatenate(places).astype(np.uint32)})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, which = np.zeros(BITS // SLICES, bool), None
            for rows in batches:
                mine[unpacked(rows.column("places"), np.uint32)] = True
                which = rows.column("bucket")[:1] if rows.num_rows else which
            if which is not None:
                yield pa.RecordBatch.from_pydict({"slice": which, "bits": pa.array([np.packbits(mine, bitorder="little").tobytes()], pa.binary())})

        self.bits = np.zeros((SLICES, BITS // SLICES // 8), np.uint8)
        placed = [t.mapInArrow(place, "bucket int, kind int, places binary") for t in tables]
        rows = placed[0]
        for more in placed[1:]:
            rows = rows.union(more)
        slices = stored(rows.repartitionById(SLICES, "bucket").mapInArrow(add, "slice int, bits binary"), "filter")
        got = slices.toArrow()
        discard(slices)
        for i, x in zip(got["slice"].to_pylist(), got["bits"].to_pylist(), strict=True):
            self.bits[i] = np.frombuffer(x, np.uint8)

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slice of each key, and its two bits there, which lie in one word of 64 bits."""
        k = keys.view(np.uint64)
        word = (k >> np.uint64(42) & np.uint64(BITS // SLICES // 64 - 1)) << np.uint64(6)
        return (k >> np.uint64(58)).astype(np.int64), (word | k & np.uint64(63)).astype(np.int64), (word | k >> np.uint64(6) & np.uint64(63)).astype(np.int64)

    def wrong(self) -> float:
        """The share of other keys that it takes for its own."""
        return float(np.bitwise_count(self.bits.view("<u8")).sum() / BITS) ** 2

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        """One look into memory for a key: its slice and word are its upper bits."""
        words, one, low, out = self.bits.view("<u8").ravel(), np.uint64(1), np.uint64(63), np.empty(len(keys), bool)
        for at in range(0, len(keys), HASHED):
            k = keys[at : at + HASHED].view(np.uint64)
            mask = one << (k & low) | one << (k >> np.uint64(6) & low)
            out[at : at + HASHED] = words[k >> np.uint64(42)] & mask == mask
        return out


def count_words_and_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, n) of all words and the end, and (ctx, suf, n) of the pairs that occur MIN_COUNT times or more, from one pass."""
    buckets = buckets_for(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Tally(buckets, "ctx", "n"), Tally(buckets, "ctx", "suf", "n")
        as_words = lambda out: (b.append_column("suf", pa.nulls(b.num_rows, pa.binary())).select(["bucket", "kind", "ctx", "suf", "n"]) for b in out)
        as_pairs = lambda out: (b.set_column(1, "kind", pa.array(np.ones(b.num_rows, np.int32))) for b in out)
        for chunk in text_chunks(batches):
            codes, h, per = hashed_words(chunk)
            n = np.bincount(codes, minlength=len(h))
            yield from as_words(words.add(h[n > 0], n[n > 0]))
            keys, doc = sequence_keys(codes, h, 1), np.repeat(np.arange(len(per)), per)
            if len(keys) > 1:
                at = np.flatnonzero(doc[1:] == doc[:-1])
                yield from as_pairs(pairs.add(keys[1][at], np.ones(len(at), np.int64), keys[0][at], keys[0][at + 1]))
        yield from as_words(words.rows())
        yield from as_pairs(pairs.rows())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_buckets(batches):
            part = rows.filter(pc.equal(rows.column("kind"), 0))
            h, n, _ = summed(unpacked(part.column("ctx"), np.int64), unpacked(part.column("n"), np.int64))
            yield pa.RecordBatch.from_pydict({"ctx": h, "suf": pa.nulls(len(h), pa.int64()), "n": n})
            part = rows.filter(pc.equal(rows.column("kind"), 1))
            ctx, suf = (unpacked(part.column(c), np.int64) for c in ("ctx", "suf"))
            _, n, first = summed(pair_hash(ctx, suf), unpacked(part.column("n"), np.int64))
            first = first[n >= MIN_COUNT]
            yield pa.RecordBatch.from_pydict({"ctx": ctx[first], "suf": suf[first], "n": n[n >= MIN_COUNT]})

    packed = docs.select("text").mapInArrow(count, "bucket int, kind int, ctx binary, suf binary, n binary")
    counted = stored(dealt(packed).mapInArrow(merge, "ctx long, suf long, n long"), "counts")
    return counted.filter("suf is null").select(F.col("ctx").alias("h"), "n"), counted.filter("suf is not null")


def count_sequences(docs: DataFrame, depth: int, shorter: DataFrame) -> DataFrame:
    """(ctx, suf, n): all sequences of depth + 1 tokens that occur MIN_COUNT times or more.

    `shorter` has those of one token less, in which a sequence's context and suffix must be.
    """
    spark = docs.sparkSession
    held = KeyFilter(shorter.select("seq"))
    buckets, shared, halves = buckets_for(spark), spark.sparkContext.broadcast(held), 2 if held.wrong() > FULL else 1

    def count(batches: Iterator[pa.RecordBatch], half: int) -> Iterator[pa.RecordBatch]:
        known, tally = shared.value, Tally(buckets, "ctx", "suf", "n")
        for chunk in text_chunks(batches):
            codes, h, per = hashed_words(chunk)
            keys, doc = sequence_keys(codes, h, depth), np.repeat(np.arange(len(per)), per)
            if len(keys) <= depth:
                continue
            have = known.may_have(keys[depth - 1])
            at = np.flatnonzero((doc[depth:] == doc[:-depth]) & have[:-1] & have[1:])
            at = at[keys[depth][at] % halves == half] if halves > 1 else at
            yield from tally.add(keys[depth][at], np.ones(len(at), np.int64), keys[depth - 1][at], keys[depth - 1][at + 1])
        yield from tally.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_buckets(batches):
            ctx, suf = (unpacked(rows.column(c), np.int64) for c in ("ctx", "suf"))
            _, n, first = summed(pair_hash(ctx, suf), unpacked(rows.column("n"), np.int64))
            first = first[n >= MIN_COUNT]
            yield pa.RecordBatch.from_pydict({"ctx": ctx[first], "suf": suf[first], "n": n[n >= MIN_COUNT]})

    found = None
    for half in range(halves):
        counted = docs.select("text").mapInArrow(lambda batches, half=half: count(batches, half), "bucket int, kind int, ctx binary, suf binary, n binary")
        part = stored(dealt(counted).mapInArrow(merge, "ctx long, suf long, n long"), "sequences")
        found = found.union(part) if found is not None else part
    shared.destroy()  # its copies on the executors' disks go
    return found


def grow(counted: DataFrame, shorter: DataFrame, last: bool = False) -> DataFrame:
    """(seq, n, logp, value, ctx, total, rest) of the sequences of one depth.

    A context that occurs C times is kept for the next words that diverge in it: those whose n
    occurrences gain MIN_GAIN nats by n / (C + 1) over the probability in the longest kept suffix.
    With T such words, whose counts sum to K, it gives each n / (C + T), and all words what is left,
    1 - K / (C + T), of the suffix's distribution. `logp` is the log10 probability of the next word
    in the longest kept context; `shorter` has it for the suffix, for which it stays where the
    context isn't kept. Scores are sums of what contexts add: each token after a kept context gets
    its `rest`, and `value` on top if the sequence is kept. A kept context is named once, by `ctx`.

    Equal contexts meet in a window: as many rows as a context has distinct next words. Of the `last` depth,
    whose probabilities nothing asks for, kept sequences alone are stored.
    """
    suffix = shorter.select(F.col("seq").alias("suf"), F.col("logp").alias("parent"))
    context = shorter.select(F.col("seq").alias("ctx"), F.col("n").alias("total"))
    each = Window.partitionBy("ctx")
    rows = counted.join(suffix, "suf").join(context, "ctx")
    rows = rows.withColumn("passes", F.col("n") * (F.log(F.col("n") / (F.col("total") + 1)) - F.col("parent") * float(np.log(10))) >= MIN_GAIN)
    rows = rows.withColumns({"held": F.sum(F.when(F.col("passes"), F.col("n"))).over(each), "types": F.count_if("passes").over(each), "first": F.min(F.when(F.col("passes"), F.col("suf"))).over(each)})
    rows = rows.withColumn("all", F.col("total") + F.col("types")).withColumn("left", 1 - F.coalesce("held", F.lit(0)) / F.col("all"))
    rows = rows.withColumns({"rest": F.log10("left"), "own": F.log10(F.when(F.col("passes"), F.col("n") / F.col("all")).otherwise(0.0) + F.col("left") * F.pow(F.lit(10.0), "parent"))})
    head = F.col("passes") & (F.col("suf") == F.col("first"))
    return stored((rows.filter("passes") if last else rows).select(
        F.xxhash64("ctx", "suf").alias("seq"), "n", F.col("own").alias("logp"), F.when(F.col("passes"), F.col("own") - F.col("parent") - F.col("rest")).cast("float").alias("value"),
        *(F.when(head, c).alias(n) for n, c in (("ctx", F.col("ctx")), ("total", F.col("total")), ("rest", F.col("rest").cast("float")))),
    ), "tree")


def learn_values(docs: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, n, gain): what sequences, as such and as contexts, add to the scores of tokens they end at;
    contributions to one h come in several rows. `words` has h, n and logp of all words, `pairs` the counts of depth 1."""
    spark, level, values = docs.sparkSession, words.select(F.col("h").alias("seq"), "n", "logp"), []
    for depth in range(1, DEPTH + 1):
        counted = pairs if depth == 1 else count_sequences(docs, depth, level)
        longer = grow(counted, level, depth == DEPTH)
        values.append(stored(longer.filter("value is not null").select(F.col("seq").alias("h"), "n", F.col("value").alias("gain")).union(longer.filter("ctx is not null").select("ctx", "total", "rest")), "values"))
        if depth > 1:
            discard(level)
        discard(counted)
        level = longer
    discard(level)
    out = values[0]
    for more in values[1:]:
        out = out.union(more)
    return out if values else spark.createDataFrame([], "h long, n long, gain float")


SCORES = "doc_id long, n_tokens long, n_known long, base double, gain double"


def suffix_lm(docs: DataFrame, holdout: int = 5, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The tree learns from the documents that aren't held out: all sequences of up to DEPTH + 1 words
    that occur MIN_COUNT times, at any size of the corpus; each context is kept or not by its own
    divergence. Words are 64-bit hashes. Counts, tree and the values by which words and sequences
    add to scores stay in tables. The tokens of a document are scored on the spot where values of
    a share of SPOT or more have them, and else meet the tables in a shuffle by sequence, but for
    those that a filter of fixed size knows not to be in them (once that is full, all tokens
    cross, in rounds of documents). A task of that shuffle reads the values of one bucket from its file
    in the shared folder; there are as many as shuffle partitions. Each token is scored in its longest kept context of up to DEPTH words.

    Null texts are empty and consist of their end. Null and repeated doc_ids are documents of
    their own (a null id counts as 0 when rows are held out). A long text is one row of a chunk of
    its own. With nothing to learn from, all probabilities are those of the formulas with zero
    counts; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = with_unique_ids(docs)
    training = keyed.filter(id_bucket(holdout) != remainder)
    counted, pairs = count_words_and_pairs(training)
    counts = stored(counted, "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = total + 0.5 * (distinct + 1)
    unseen = float(np.log10(0.5 / below))
    words = counts.withColumn("logp", F.log10((F.col("n") + 0.5) / F.lit(below)))
    values = learn_values(training, words, pairs)
    spot = max(1.0, SPOT * total)
    often = words.select("h", "n", F.col("logp").alias("base"), F.lit(0.0).alias("gain")).union(values.select("h", "n", F.lit(0.0), F.col("gain").cast("double"))).filter(F.col("n") >= spot)
    often = stored(often.groupBy("h").agg(F.sum("base").alias("base"), F.sum("gain").alias("gain")), "often").toArrow().sort_by("h")
    often = [often[c].to_numpy() for c in ("h", "base", "gain")]
    known, buckets = KeyFilter(words.select("h"), values.select("h")), buckets_for(spark)
    shared = spark.sparkContext.broadcast((often, known))
    # Once the filter is full, every token crosses with each of its sequences; in rounds of documents it takes no more disk.
    tokens = total * holdout / max(holdout - 1, 1)
    asked = tokens * (DEPTH + 1) * max(MEET_SHARE, known.wrong())
    rounds = max(1, int(np.ceil(asked / max(ROUND_SHARE * tokens, ROUND_LOOKUPS))))

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (held, base_of, gain_of), known = shared.value
        waiting: dict[int, list] = {WORD_LOOKUP: [], LOOKUP: []}
        ids: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            for kind, parts in waiting.items():
                if parts:
                    keys, of = (np.concatenate(x) for x in zip(*parts, strict=True))
                    bucket, names = bucket_of(keys, buckets), np.concatenate(ids)
                    order = np.argsort(bucket.astype(np.int64) << 32 | of)  # lookups of a document side by side, its key is then small when compressed
                    yield packets(bucket[order], {"keys": keys[order], "numbers": names[of[order]]}, kind)
                    parts.clear()
            ids.clear()

        for chunk in text_chunks(batches):
            codes, h, per = hashed_words(chunk)
            doc, n = np.repeat(np.arange(len(per)), per), len(per)
            base, gain, n_known, key = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), chunk.column("key").to_numpy()
            place = sum(map(len, ids))
            ids.append(key)
            for depth, keys in enumerate(sequence_keys(codes, h, DEPTH)):
                of = doc[depth:]
                if depth:
                    may = np.flatnonzero((of == doc[: len(of)]) & known.may_have(keys))
                    at, hit = placed(held, keys[may])
                else:  # distinct words are few
                    may = np.flatnonzero(known.may_have(h)[codes])
                    base += unseen * (per - np.bincount(of[may], minlength=n))
                    at, hit = (x[codes[may]] for x in placed(held, h))
                    base += np.bincount(of[may[hit]], base_of[at[hit]], n)
                    n_known += np.bincount(of[may[hit]], minlength=n)
                gain += np.bincount(of[may[hit]], gain_of[at[hit]], n)
                may = may[~hit]
                waiting[LOOKUP if depth else WORD_LOOKUP].append((keys[may], place + of[may]))
            ids_of = chunk.column("doc_id")
            row = (per, n_known, base.view(np.int64), gain.view(np.int64), ids_of.fill_null(0).to_numpy(), ids_of.is_valid().cast(pa.int64()).to_numpy())
            yield packets((np.arange(n) * buckets // n).astype(np.int32), {"keys": key, "numbers": np.stack(row, axis=1)}, DOCUMENT)
            if sum(len(k) for parts in waiting.values() for k, _ in parts) > FOLD:
                yield from send()
        yield from send()

    def pack(kind: int) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy()
                yield packets(bucket_of(keys, buckets), {"keys": keys, "numbers": batch.column(1).to_numpy()}, kind)

        return run

    folder = scratch(spark, "held")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_buckets(batches):
            kind, bucket = rows.column("kind").to_numpy(), rows.column("bucket")[0].as_py()
            for k, name in ((WORD_VALUE, "words"), (VALUE, "values")):
                part = rows.filter(pa.array(kind == k))
                numbers = unpacked(part.column("numbers"), np.float64 if k == WORD_VALUE else np.float32).astype(np.float64)
                write_numbers(f"{folder}/{bucket}.{name}", *summed(unpacked(part.column("keys"), np.int64), numbers)[:2])
            yield pa.RecordBatch.from_pydict({"bucket": rows.column("bucket")[:1]})

    held_packets = words.select("h", "logp").mapInArrow(pack(WORD_VALUE), PACKETS).union(values.select("h", "gain").mapInArrow(pack(VALUE), PACKETS))
    full = {r.bucket for r in stored(dealt(held_packets).mapInArrow(hold, "bucket int"), "held").collect()}
    discard(values, counts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_buckets(batches):
            kind, bucket = rows.column("kind").to_numpy(), rows.column("bucket")[0].as_py()
            of_kind = lambda k, a="keys", b="numbers", t=np.float64: (unpacked((part := rows.filter(pa.array(kind == k))).column(a), np.int64), unpacked(part.column(b), t))  # noqa: B023, E731
            none = np.zeros(0, np.uint64), np.zeros(0)
            (held_words, base_of), (held, gain_of) = (read_numbers(f"{folder}/{bucket}.{x}") if bucket in full else none for x in ("words", "values"))
            parts = []
            for k in (WORD_LOOKUP, LOOKUP):
                keys, of = of_kind(k, t=np.int64)
                at, hit = placed(held, keys.view(np.uint64))
                gain, base = np.zeros(len(keys)), np.full(len(keys), unseen if k == WORD_LOOKUP else 0.0)
                gain[hit] = gain_of[at[hit]]
                n_known = np.zeros(len(keys), np.int64)
                if k == WORD_LOOKUP:
                    at, hit = placed(held_words, keys.view(np.uint64))
                    base[hit], n_known[hit] = base_of[at[hit]], 1
                parts.append((of, n_known, base, gain))
            of, n_known, base, gain = (np.concatenate(x) for x in zip(*parts, strict=True))
            key, base, _ = summed(of, base)
            row = (summed(of, n_known)[1], base.view(np.int64), summed(of, gain)[1].view(np.int64))
            yield packets(of_document(key), {"keys": key, "numbers": np.stack(row, axis=1)}, PART)
            key, numbers = of_kind(DOCUMENT, t=np.int64)
            yield packets(of_document(key), {"keys": key, "numbers": numbers.reshape(-1, 6)}, DOCUMENT)

    def of_document(key: np.ndarray) -> np.ndarray:
        return bucket_of(mix(key.view(np.uint64)), buckets)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_buckets(batches):
            kind = rows.column("kind").to_numpy()
            parts = []
            for k, width in ((DOCUMENT, 6), (PART, 3)):
                part = rows.filter(pa.array(kind == k))
                parts.append((unpacked(part.column("keys"), np.int64), unpacked(part.column("numbers"), np.int64).reshape(-1, width)))
            (docs, whole), (keys, more) = parts
            at = np.argsort(docs)
            docs, whole = docs[at], whole[at]
            place = np.searchsorted(docs, keys)
            add = lambda first, column: first + np.bincount(place, np.ascontiguousarray(more[:, column]).view(np.float64), len(docs))  # noqa: B023, E731
            real = lambda column: np.ascontiguousarray(whole[:, column]).view(np.float64)  # noqa: B023, E731
            n_known = whole[:, 1] + np.bincount(place, more[:, 0], len(docs)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(whole[:, 4], pa.int64(), mask=whole[:, 5] == 0), "n_tokens": pa.array(whole[:, 0]), "n_known": n_known, "base": add(real(2), 1), "gain": add(real(3), 2)})

    sums = None
    for i in range(rounds):
        some = keyed.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == i) if rounds > 1 else keyed
        got = stored(dealt(dealt(some.mapInArrow(lookups, PACKETS)).mapInArrow(meet, PACKETS)).mapInArrow(add_up, SCORES), "scores")
        sums = sums.union(got) if sums is not None else got
    shared.destroy()
    fs, name = store_of(folder)
    if full:
        fs.delete_dir(name)
    return sums.select("doc_id", (id_bucket(holdout) == remainder).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"))


def write_numbers(path: str, keys: np.ndarray, numbers: np.ndarray) -> None:
    """A file of sorted keys, at the bytes of their distances, with a number each; it appears by a rename."""
    fs, name = store_of(path)
    fs.create_dir(name.rpartition("/")[0])
    attempt = f"{name}.{TaskContext.get().taskAttemptId()}"
    table = pa.table({"key": keys.view(np.int64), "number": numbers})
    with fs.open_output_stream(attempt) as f:
        pq.write_table(table, f, use_dictionary=False, compression="zstd", column_encoding={"key": "DELTA_BINARY_PACKED", "number": "BYTE_STREAM_SPLIT"})
    publish(fs, attempt, name)


def read_numbers(path: str) -> tuple[np.ndarray, np.ndarray]:
    fs, name = store_of(path)
    with fs.open_input_file(name) as f:
        table = pq.ParquetFile(f).read(use_threads=False)
    return table["key"].to_numpy().view(np.uint64), table["number"].to_numpy()


def placed(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ones, and whether it does."""
    if not len(held):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return at, held[at] == keys
