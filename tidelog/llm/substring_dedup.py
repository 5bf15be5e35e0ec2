"""Substring deduplication against a log-structured fingerprint index (operator 3)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, buckets_for, gram_hashes, mix, publish, scratch, split_words, starts_of, store_of, stored, text_chunks, with_row_keys, with_unique_ids, word_hashes

#: Words of a window, and of the grams whose first in order places a window in the index.
WINDOW, ANCHOR = 20, 6
#: Counters of the frequency sketch, and the slices in which tasks send theirs.
COUNTERS, SLICES = 1 << 20, 64
#: Windows in one index entry at most, and bytes of a window's own hash: hits are verified.
ENTRY, HASH_BYTES = 64, 5
#: Levels from which on an anchor is split, and the bits of a window's own hash by which it is: one line in a third of all documents
#: is the only anchor of the windows that it fills, and these go to as many places of the index.
SPLIT_LEVEL, SPLIT_BITS = 3, 10
#: Runs of one level that are merged into one of the next.
FAN_IN = 2
#: Batches in which the query submits its table.
BATCHES = 3

#: An index entry: `n` consecutive windows of a document that share their anchor. `hashes` holds the
#: windows' own hashes; it is empty for windows that are known, and verified, to start earlier.
ENTRIES = "bucket int, anchor long, key long, start int, n int, hashes binary"
#: Windows start .. start + n - 1 of a document that start earlier: those of document `prev` from
#: `prev_start` on, if they hold the same words, or verified already where `prev` is null.
SPANS = "key long, start int, n int, prev long, prev_start int"
RUN = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary())])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width, span = 1, x
    while 2 * width <= n:
        span, width = np.minimum(span[: len(span) - width], span[width:]), 2 * width
    rest = n - width
    return np.minimum(span[: len(span) - rest], span[rest:]) if rest else span


def counter_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def frequency_sketch(counted: DataFrame) -> np.ndarray:
    """The sums of (slice, counts), each task's part of the sketch: COUNTERS numbers at any size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())})

    got = counted.select("slice", "counts").repartition(8, "slice").mapInArrow(add, "slice int, counts binary").toArrow()
    sketch = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for part, counts in zip(got["slice"].to_pylist(), got["counts"].to_pylist(), strict=True):
        sketch[part] = np.frombuffer(counts, "<i8")
    return np.minimum(sketch.ravel(), 2**31 - 1).astype(np.int32)


def gram_levels(docs: DataFrame) -> np.ndarray:
    """How much more frequent than most the grams of a counter are, in powers of two, by counters of
    their hash: COUNTERS numbers at any size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for chunk in text_chunks(batches):
            codes, words, _ = split_words(chunk.column("text"))
            grams = gram_hashes(word_hashes(words)[codes], ANCHOR) if len(codes) else np.zeros(0, np.uint64)
            counts += np.bincount(counter_of(grams), minlength=COUNTERS)
        parts = [x.astype("<u4").tobytes() for x in np.minimum(counts, 2**32 - 1).reshape(SLICES, -1)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(parts, pa.binary())})

    counts = frequency_sketch(docs.select("text").mapInArrow(count, "slice int, counts binary")).astype(np.float64)
    usual = 8 * (counts.mean() + 1)
    return np.clip(np.ceil(np.log2(np.maximum(counts / usual, 1))), 0, 31).astype(np.uint8)


def runs_of(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches in which all conditions hold from one element to the next."""
    n = len(same[0]) + 1
    new = np.ones(n, bool)
    new[1:] = ~np.logical_and.reduce(same)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def cut(first: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `most` elements at most."""
    cuts = -(-sizes // most)
    place = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * most
    return np.repeat(first, cuts) + place, np.minimum(most, np.repeat(sizes, cuts) - place)


def packed_hashes(own: np.ndarray, sizes: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((starts_of(sizes) * HASH_BYTES).astype(np.int32)), pa.py_buffer(data)])


def unpacked_windows(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, own hash, key and start of each window of index entries that hold hashes."""
    n = rows.column("n").to_numpy().astype(np.int64)
    column = rows.column("hashes")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(n) else np.zeros(0, np.uint8)
    own = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    own[:, :HASH_BYTES] = data.reshape(-1, HASH_BYTES)
    place = np.arange(n.sum()) - np.repeat(starts_of(n)[:-1], n)
    return np.repeat(rows.column("anchor").to_numpy(), n), own.view(np.uint64).ravel(), np.repeat(rows.column("key").to_numpy(), n), np.repeat(rows.column("start").to_numpy().astype(np.int64), n) + place


def entries_of(chunk: pa.RecordBatch, levels: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Index entries of a chunk of documents; windows whose words occur earlier in the chunk come without hashes."""
    chunk = chunk.take(pa.array(np.argsort(chunk.column("key").to_numpy(), kind="stable")))
    keys = chunk.column("key").to_numpy()
    codes, words, per = split_words(chunk.column("text"))
    if len(codes) < WINDOW:
        return
    h = word_hashes(words)[codes]
    grams = gram_hashes(h, ANCHOR)
    # Rare grams first: a line that many documents share is no anchor where another gram is there.
    ordered = levels[counter_of(grams)].astype(np.uint64) << np.uint64(58) | grams >> np.uint64(6)
    anchors, own = sliding_min(ordered, WINDOW - ANCHOR + 1), gram_hashes(h, WINDOW, 1)
    low = np.uint64((1 << SPLIT_BITS) - 1)
    anchors = np.where(anchors >> np.uint64(58) >= SPLIT_LEVEL, anchors & ~low | own & low, anchors)
    doc = np.repeat(np.arange(len(per)), per)
    at = np.flatnonzero(doc[: len(own)] == doc[WINDOW - 1 :])
    if not len(at):
        return
    anchors, own, doc = anchors[at].view(np.int64), own[at], doc[at]
    start = at - starts_of(per)[doc]
    order = np.argsort(own, kind="stable")
    first, sizes = runs_of(own[order][1:] == own[order][:-1])
    earlier = np.empty(len(at), np.int64)
    earlier[order] = np.repeat(order[first], sizes)
    known = earlier != np.arange(len(at))
    again = np.flatnonzero(known)
    same = np.ones(len(again), bool)
    for k in range(WINDOW):
        same &= codes[at[again] + k] == codes[at[earlier[again]] + k]
    known[again[~same]] = False

    def rows(some: np.ndarray, stretches: tuple[np.ndarray, np.ndarray], bucket: np.ndarray, hashes: pa.Array) -> pa.RecordBatch:
        i = some[stretches[0]]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket), "anchor": anchors[i], "key": keys[doc[i]], "start": pa.array(start[i].astype(np.int32)), "n": pa.array(stretches[1].astype(np.int32)), "hashes": hashes})

    for some, is_known in ((again[same], True), (np.flatnonzero(~known), False)):
        if len(some):
            follows = (some[1:] == some[:-1] + 1) & (at[some[1:]] == at[some[:-1]] + 1)
            if is_known:
                found = runs_of(follows)
                yield rows(some, found, bucket_of(mix(keys[doc[some[found[0]]]].view(np.uint64)), buckets), pa.array([b""] * len(found[0]), pa.binary()))
            else:
                found = cut(*runs_of(follows, anchors[some[1:]] == anchors[some[:-1]]), ENTRY)
                yield rows(some, found, bucket_of(mix(anchors[some[found[0]]].view(np.uint64)), buckets), packed_hashes(own[some], found[1]))


class RunReader:
    """The entries of one bucket of a run, in the order of their anchors."""

    def __init__(self, path: str):
        fs, name = store_of(path)
        self.stream, self.held = None, None
        if fs.get_file_info(name).is_file:
            self.stream = pa.ipc.open_stream(fs.open_input_stream(name))
            self.more()

    def more(self) -> None:
        rows = next(self.stream, None)
        if rows is None:
            self.stream = None
        else:
            self.held = pa.Table.from_batches([rows] if self.held is None else [*self.held.to_batches(), rows])

    def last(self) -> int | None:
        return self.held.column("anchor")[-1].as_py() if self.held is not None and self.held.num_rows else None

    def upto(self, anchor: int) -> pa.RecordBatch | None:
        """What is left with anchors up to this one."""
        while self.stream is not None and (self.last() is None or self.last() <= anchor):
            self.more()
        if self.held is None or not self.held.num_rows:
            return None
        whole = self.held.combine_chunks().to_batches()[0]
        n = int(np.searchsorted(whole.column("anchor").to_numpy(), anchor, "right"))
        self.held = pa.Table.from_batches([whole.slice(n)])
        return whole.slice(0, n)


class RunWriter:
    """One bucket's file of a new run; it appears by a rename, and nothing appears for no entries."""

    def __init__(self, path: str):
        self.fs, self.name = store_of(path)
        self.attempt = f"{self.name}.{TaskContext.get().taskAttemptId()}"
        self.stream = None

    def write(self, rows: pa.RecordBatch) -> None:
        if not rows.num_rows:
            return
        if self.stream is None:
            self.fs.create_dir(self.name.rpartition("/")[0])
            self.file = self.fs.open_output_stream(self.attempt)
            self.stream = pa.ipc.new_stream(self.file, RUN, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.stream.write_batch(rows)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.file.close()
            publish(self.fs, self.attempt, self.name)


def merge(batches: Iterator[pa.RecordBatch], runs: list[str], new_run: str) -> Iterator[pa.RecordBatch]:
    """Merge-join the entries of one bucket, sorted by (anchor, key, start), with that bucket of all runs.

    Windows that no run and no earlier entry has go into the new run; of the others, spans are returned.
    Of the anchor at hand only its distinct windows are held, never its entries.
    """
    readers, writer, carry, at = None, None, [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64)], None
    for batch in batches:
        size = batch.column("n").to_numpy()
        open_ = np.diff(np.frombuffer(batch.column("hashes").buffers()[1], np.int32)[batch.column("hashes").offset :][: batch.num_rows + 1]) > 0
        known = batch.filter(pa.array(~open_))
        none = pa.nulls(known.num_rows, pa.int64())
        yield pa.RecordBatch.from_pydict({"key": known.column("key"), "start": known.column("start"), "n": known.column("n"), "prev": none, "prev_start": none.cast(pa.int32())})
        if not open_.any():
            continue
        rows = batch.filter(pa.array(open_))
        if readers is None:
            bucket = rows.column("bucket")[0].as_py()
            readers, writer = [RunReader(f"{run}/{bucket}") for run in runs], RunWriter(f"{new_run}/{bucket}")
        new = unpacked_windows(rows)
        present, last = np.unique(new[0]), new[0][-1]
        parts = []
        for reader in readers:
            if (old := reader.upto(int(last))) is not None and old.num_rows:
                anchors = old.column("anchor").to_numpy()
                hit = present[np.minimum(np.searchsorted(present, anchors), len(present) - 1)] == anchors
                parts.append(unpacked_windows(old.filter(pa.array(hit))))
        if at is not None and at == present[0]:
            parts.append(carry)
        held = sum(len(p[0]) for p in parts)
        anchor, own, key, start = (np.concatenate(x) for x in zip(*parts, new, strict=True))
        both = mix(anchor.view(np.uint64) + mix(own))
        order = np.argsort(both, kind="stable")
        first, sizes = runs_of(both[order][1:] == both[order][:-1])
        earlier = np.empty(len(both), np.int64)
        earlier[order] = np.repeat(order[first], sizes)
        fresh = earlier == np.arange(len(both))
        keep = np.flatnonzero(fresh & (anchor == last))
        carry, at = [x[keep] for x in (anchor, own, key, start)], last
        hits = np.flatnonzero(~fresh[held:]) + held
        if len(hits):
            a, b = hits[1:], hits[:-1]
            i, n = runs_of(key[a] == key[b], start[a] == start[b] + 1, key[earlier[a]] == key[earlier[b]], start[earlier[a]] == start[earlier[b]] + 1)
            i = hits[i]
            yield pa.RecordBatch.from_pydict({"key": key[i], "start": pa.array(start[i].astype(np.int32)), "n": pa.array(n.astype(np.int32)), "prev": key[earlier[i]], "prev_start": pa.array(start[earlier[i]].astype(np.int32))})
        some = np.flatnonzero(fresh[held:]) + held
        if len(some):
            a, b = some[1:], some[:-1]
            i, n = cut(*runs_of(anchor[a] == anchor[b], key[a] == key[b], start[a] == start[b] + 1), ENTRY)
            hashes, i = packed_hashes(own[some], n), some[i]
            writer.write(pa.RecordBatch.from_arrays([pa.array(anchor[i]), pa.array(key[i]), pa.array(start[i].astype(np.int32)), pa.array(n.astype(np.int32)), hashes], schema=RUN))
    if writer is not None:
        writer.close()


class WindowIndex:
    """Sorted immutable runs of the window hashes of all documents so far, below a shared folder.

    Each batch is hashed and dealt out to the index's buckets; there it is merge-joined with that
    bucket's file of each run, and what is new becomes a run of its own. History is read in the order
    of its anchors and neither shuffled nor sorted again. FAN_IN runs of one level are compacted into
    one. A manifest names what is valid: a batch counts once its manifest is written, and another
    session can go on from there. Batches come in ascending key order, which is checked.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        """An index in a folder; without one, or with an empty one, it has no runs."""
        self.spark, self.folder = spark, folder or scratch(spark, "windows")
        if "://" not in self.folder:
            self.folder = self.folder.replace("file:", "file://", 1) if self.folder.startswith("file:") else f"file://{self.folder}"
        self.fs, self.root = store_of(self.folder)
        self.fs.create_dir(self.root)
        names = [f.base_name for f in self.fs.get_file_info(self._all()) if f.base_name.startswith("manifest-") and f.extension == "json"]
        self.state = {"batches": 0, "runs": [], "last": None, "buckets": buckets or buckets_for(spark), "levels": None}
        if names:
            with self.fs.open_input_stream(f"{self.root}/{max(names)}") as f:
                self.state = json.loads(f.read())

    def _all(self) -> object:
        from pyarrow.fs import FileSelector

        return FileSelector(self.root)

    def _write(self, name: str, data: bytes) -> None:
        with self.fs.open_output_stream(f"{self.root}/{name}.new") as f:
            f.write(data)
        publish(self.fs, f"{self.root}/{name}.new", f"{self.root}/{name}")

    def _levels(self, docs: DataFrame) -> np.ndarray:
        """The order of grams is fixed by the first batch, so that equal windows always have one anchor."""
        if self.state["levels"] is None:
            self.state["levels"] = f"levels-{uuid.uuid4().hex}"
            self._write(self.state["levels"], gram_levels(docs).tobytes())
        with self.fs.open_input_stream(f"{self.root}/{self.state['levels']}") as f:
            return np.frombuffer(f.read(), np.uint8)

    def add(self, docs: DataFrame) -> DataFrame:
        """Spans of windows of `docs` (key, text) that start earlier, in the index or in `docs`, by their hashes."""
        low, high = docs.agg(F.min("key"), F.max("key")).first()
        if low is None:
            return self.spark.createDataFrame([], SPANS)
        if self.state["last"] is not None and low <= self.state["last"]:
            raise ValueError(f"a batch must come after key {self.state['last']}; this one has {low}")
        levels, buckets = self.spark.sparkContext.broadcast(self._levels(docs)), self.state["buckets"]
        runs, new = [f"{self.folder}/{name}" for _, name in self.state["runs"]], f"run-{uuid.uuid4().hex}"
        path = f"{self.folder}/{new}"

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in text_chunks(batches):
                yield from entries_of(chunk, levels.value, buckets)

        found = docs.select("key", "text").mapInArrow(entries, ENTRIES).repartitionById(buckets, "bucket").sortWithinPartitions("anchor", "key", "start")
        spans = stored(found.mapInArrow(lambda batches: merge(batches, runs, path), SPANS), "spans")
        self.state |= {"batches": self.state["batches"] + 1, "runs": [*self.state["runs"], [0, new]], "last": high}
        gone = self.compact()
        self._write(f"manifest-{self.state['batches']:08d}.json", json.dumps(self.state).encode())
        for name in gone:
            self.fs.delete_dir(f"{self.root}/{name}")
        return spans

    def compact(self) -> list[str]:
        """Merge FAN_IN runs of one level into one of the next, bucket by bucket; the names of the runs it replaces."""
        level, gone = 0, []
        while len(same := [name for at, name in self.state["runs"] if at == level]) >= FAN_IN:
            new = f"run-{uuid.uuid4().hex}"
            old, path = [f"{self.folder}/{name}" for name in same], f"{self.folder}/{new}"

            def one(batches: Iterator[pa.RecordBatch], old: list[str] = old, path: str = path) -> Iterator[pa.RecordBatch]:
                for bucket in (b for batch in batches for b in batch.column("id").to_pylist()):
                    readers, writer = [RunReader(f"{run}/{bucket}") for run in old], RunWriter(f"{path}/{bucket}")
                    while ends := [x for r in readers if (x := r.last()) is not None]:
                        parts = [rows for r in readers if (rows := r.upto(min(ends))) is not None]
                        writer.write(pa.Table.from_batches(parts).sort_by([("anchor", "ascending"), ("key", "ascending"), ("start", "ascending")]).combine_chunks().to_batches()[0])
                    writer.close()
                    yield pa.RecordBatch.from_pydict({"id": pa.array([bucket], pa.int64())})

            stored(self.spark.range(0, self.state["buckets"], 1, self.state["buckets"]).mapInArrow(one, "id long"), "compacted")
            self.state["runs"] = [[level + 1, new], *(r for r in self.state["runs"] if r[1] not in same)]
            gone += same
            level += 1
        return [name for name in gone if self.fs.get_file_info(f"{self.root}/{name}").type.name == "Directory"]


def with_earlier_words(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, start, n, words): spans with the words of the earlier windows that are to be the same; null where they are known to be.

    Adjoining spans become one, cut where the earlier document's windows reach a multiple of ENTRY: so
    a passage that many documents share is asked for in few forms, and each is read once.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            per = np.diff(lists.offsets.to_numpy())
            start, n = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(len(per)), per)
            order = np.lexsort((start, row))
            start, n, row = start[order], n[order], row[order]
            i, _ = runs_of(row[1:] == row[:-1], start[1:] == start[:-1] + n[:-1])
            n, start, row = np.add.reduceat(n, i) if len(i) else n, start[i], row[i]
            before = start + batch.column("shift").to_numpy().astype(np.int64)[row]
            head = np.minimum(n, -before % ENTRY)
            whole, sizes = cut(start + head, n - head, ENTRY)
            of = np.concatenate([row[head > 0], np.repeat(row, -(-(n - head) // ENTRY))])
            start, n = np.concatenate([start[head > 0], whole]), np.concatenate([head[head > 0], sizes])
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key").take(pa.array(of)), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                "prev": batch.column("prev").take(pa.array(of)), "prev_start": pa.array((start + batch.column("shift").to_numpy().astype(np.int64)[of]).astype(np.int32)),
            })

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            out: list[tuple] = []
            for key, text, asked in zip(*(chunk.column(c).to_pylist() for c in ("key", "text", "asked")), strict=True):
                words = text.encode().split()
                out += [(key, a["prev_start"], a["n"], b" ".join(words[a["prev_start"] : a["prev_start"] + a["n"] + WINDOW - 1]).decode()) for a in asked]
            prev, start, n, found = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"prev": pa.array(prev, pa.int64()), "prev_start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()), "words": pa.array(found, pa.string())})

    hits = spans.filter("prev is not null").groupBy("key", "prev", (F.col("prev_start") - F.col("start")).alias("shift")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    hits = stored(hits.mapInArrow(joined, SPANS), "hits")
    asked = hits.select("prev", "prev_start", "n").distinct().groupBy(F.col("prev").alias("key")).agg(F.collect_list(F.struct("prev_start", "n")).alias("asked"))
    # One plan at every size: what is asked for grows with the corpus.
    words = stored(docs.select("key", "text").join(asked.hint("merge"), "key").mapInArrow(read, "prev long, prev_start int, n int, words string"), "words")
    return spans.filter("prev is null").select("key", "start", "n", F.lit(None).cast("string").alias("words")).union(hits.join(words, ["prev", "prev_start", "n"]).select("key", "start", "n", "words"))


def same_words(words: list[bytes], marks: list[dict]) -> Iterator[tuple[int, int, str | None]]:
    """(start, n, None) of the windows that hold the earlier document's words, and (start, 1, its words) of each that doesn't."""
    for m in marks:
        start, n, there = m["start"], m["n"], m["words"].encode()
        if b" ".join(words[start : start + n + WINDOW - 1]) == there:
            yield start, n, None
            continue
        there = there.split(b" ")
        for k in range(start, start + n):
            own = words[k : k + WINDOW]
            yield k, 1, None if own == there[k - start : k - start + WINDOW] else b" ".join(own).decode()


def verified(marks: DataFrame, keyed: DataFrame) -> DataFrame:
    """(key, start, n) of the windows of `marks` (key, start, n, words) that start earlier, word for word.

    A window whose hash an earlier, different one had first never entered the index. All windows with
    its words fail here in the same way, so they are compared among themselves, whole: of each
    word sequence all but the first are repeats. No repeat is lost to a collision.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=1 << 20):  # as Python strings, with the words of their marks
            out = [(key, *m) for key, text, of in zip(*(chunk.column(c).to_pylist() for c in ("key", "text", "_tidelog_marks")), strict=True) for m in same_words(text.encode().split(), of)]
            key, start, n, words = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()), "words": pa.array(words, pa.string())})

    lists = marks.filter("words is not null").groupBy("key").agg(F.collect_list(F.struct("start", "n", "words")).alias("_tidelog_marks"))
    rows = keyed.select("key", "text").join(lists.hint("merge"), "key")
    checked = stored(rows.select("key", "text", "_tidelog_marks").mapInArrow(compare, "key long, start int, n int, words string"), "verified")
    failed, place = checked.filter("words is not null"), F.struct("key", "start")
    first = failed.groupBy("words").agg(F.min(place).alias("first"))
    repeats = failed.join(first, "words").filter(place > F.col("first")).select("key", "start", "n")
    return marks.filter("words is null").select("key", "start", "n").union(checked.filter("words is null").select("key", "start", "n")).union(repeats)


def covered(words: list[bytes], marks: list[dict]) -> np.ndarray:
    """Which of a document's words lie in a marked window."""
    step = np.zeros(len(words) + WINDOW + 1, np.int64)
    for m in marks:
        step[m["start"]] += 1
        step[m["start"] + m["n"] + WINDOW - 1] -= 1
    return np.cumsum(step)[: len(words)] > 0


def with_marks(keyed: DataFrame, marks: DataFrame, key: str = "key") -> DataFrame:
    """Documents with the lists of their own marked windows (as many as they have words at most)."""
    lists = marks.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "n")).alias("_tidelog_marks"))
    return keyed.join(lists.hint("merge"), key, "left")  # one plan at every size


def kept_words(rows: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Words, words removed, and the kept words joined by one space, of each row."""
    for text, marks in zip(rows.column("text").to_pylist(), rows.column("_tidelog_marks").to_pylist(), strict=True):
        words = text.encode().split()
        if marks:
            drop = covered(words, marks)
            yield len(words), int(drop.sum()), b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d])
        else:
            yield len(words), 0, b" ".join(words)


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """(key, start, n) of the windows of `keyed` (key, text) that start earlier: the table goes in
    BATCHES ascending ranges of keys into an index that starts empty."""
    index = WindowIndex(keyed.sparkSession)
    cuts = sorted(set(keyed.approxQuantile("key", [k / BATCHES for k in range(1, BATCHES)], 0.01)))
    bounds = [None, *map(int, cuts), None]
    spans = None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        batch = keyed if low is None else keyed.filter(F.col("key") > low)
        found = index.add(batch if high is None else batch.filter(F.col("key") <= high))
        spans = found if spans is None else spans.union(found)
    return verified(with_earlier_words(spans, keyed), keyed)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A word goes if a window of WINDOW words that covers it also starts earlier: in a smaller
    doc_id, or before in its own document. Windows are judged on the input.

    A window is filed under the first of its ANCHOR-word grams, rare ones and then small hashes
    first, which neighbouring windows share: about one entry for eight words crosses the shuffle
    instead of one for each. Tasks mark repeats within their own chunks first, so that a passage
    which many documents share sends one entry per chunk. The table goes into the index in BATCHES;
    each is merged with the runs of those before. Windows that agree in their anchors (58 bits) and
    40 bits of their own are compared word by word with the earlier document's text before a word goes,
    and those that differ among themselves (verified()). An anchor that a common line gives is split by
    bits of the windows' own hashes; adaptive execution splits documents with very many marks no
    further, as a document's marks are at most its words.

    Null texts have no words. Null and repeated doc_ids are documents of their own, ordered
    by text. Documents under WINDOW words stay whole; a long text is a chunk of its own. An empty
    table gives no rows.
    """
    keyed = with_unique_ids(docs)
    marks = repeated_windows(keyed.select("key", "text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            n, gone, sha = zip(*((a, b, hashlib.sha256(c).hexdigest()) for a, b, c in kept_words(chunk)), strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": list(sha)})

    return with_marks(keyed, marks).select("doc_id", "text", "_tidelog_marks").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_filter(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut out of their texts: kept words joined by one space, n_chars
    recounted. Texts without a repeat stay as they are; documents of which nothing is left go.
    Rows with null and repeated doc_ids are documents of their own, in the order of with_unique_ids.
    """
    schema, names = docs.schema, docs.columns
    rows = with_row_keys(docs).withColumn("text", F.coalesce("text", F.lit("")))
    marks = repeated_windows(rows.select(F.col("_tidelog_row").alias("key"), "text"))
    types: Callable = lambda n, batch: batch.schema.field(n).type

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            texts, stays = [], []
            for old, (n, gone, new) in zip(chunk.column("text").to_pylist(), kept_words(chunk), strict=True):
                texts.append(new.decode() if gone else old)
                stays.append(not n or gone < n)
            out = {x: chunk.column(x) for x in names} | {"text": pa.array(texts, types("text", chunk))}
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) for t in texts], types("n_chars", chunk))
            yield pa.RecordBatch.from_pydict(out).filter(pa.array(stays, pa.bool_()))

    return with_marks(rows, marks, "_tidelog_row").mapInArrow(apply, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM again),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
