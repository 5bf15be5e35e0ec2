"""Token ids of whole texts, and their binary shards (operator 1)."""

from __future__ import annotations

import functools
import json
import mmap
import os
import zlib
from collections.abc import Iterator
from itertools import repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import publish, ragged_take, scratch, split_words, starts_of, store_of, stored, text_chunks, with_unique_ids

#: Words whose ids a worker remembers.
REMEMBERED = 400_000
#: Words that go to the library in one string.
JOINED = 256
#: Text bytes encoded at a time.
BYTES = 4 << 20
#: The id after each document.
END_ID = 1
#: What a null doc_id is written as.
NO_ID = -(2**63)
#: Texts on which encoding by words must give what encoding whole texts gives.
PROBES = ("two words", "  lead,  and\ttail \n", "don't 12ab x-y (z) a.b", "É ﬁ é́ İ ß", "日本 語😀 x", "a  b\r\n\x0bc", "")


class TextEncoder:
    """Ids of texts by the tokenizers library, which sees each distinct word of a chunk once.

    That holds for a tokenizer that drops white space and whose normaliser and splitting don't
    look across it: then the ids of a text are those of its words in a row. PROBES tell, and for
    other tokenizers whole texts are encoded. Words go to the library in strings, set apart by one
    of its special tokens. Each text is followed by the end id.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[0] if special else (-1, None)
        self.end_id = end_id
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.word_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        if suffix:
            self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.clear()
        self.by_words = True
        probes = pa.array(PROBES)
        self.by_words = all(np.array_equal(a, b) for a, b in zip(self.encode(probes), self.encode_whole(probes), strict=True))
        self.clear()

    def encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What encode() gives, text by text."""
        listed = pc.fill_null(texts, "").to_pylist()
        ids = [np.array([*e.ids, self.end_id], np.uint32) for e in self.tokenizer.encode_batch_fast(listed, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), starts_of(np.array([len(x) for x in ids], np.int64))

    def clear(self) -> None:
        """Place 0 of the tables is the end of a text."""
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.met = np.full(1, 2, np.int64)

    def forget_rare(self) -> None:
        """Keep the words that at least two chunks had."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > REMEMBERED // 2:
            return self.clear()
        moved = np.full(len(self.met), -1)
        moved[keep] = np.arange(len(keep))
        self.known = {w: int(moved[i]) for w, i in self.known.items() if moved[i] >= 0}
        ids, lengths = ragged_take(self.ids, self.starts, self.lengths, keep), self.lengths[keep]
        self.ids, self.starts, self.lengths, self.met = ids, starts_of(lengths)[:-1], lengths, self.met[keep]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has.

        Words of letters go in strings, set apart by spaces; each must give one unit, which
        the vocabulary's word-end tokens tell. Other words, and the words of a string whose
        units don't agree, are set apart by a special token instead, or go alone.
        """
        plain = [i for i, w in enumerate(words) if w.isalpha()] if self.word_end.any() else []
        ids, sizes, order = [], [], []
        left = [i for i, w in enumerate(words) if not w.isalpha()] if len(plain) else list(range(len(words)))
        for at, got in self.encode_joined([words[i] for i in plain], " "):
            some = plain[at : at + JOINED]
            ends = np.flatnonzero(self.word_end[got])
            if len(ends) == len(some) and ends[-1] == len(got) - 1:
                ids.append(got)
                sizes.append(np.diff(ends, prepend=-1))
                order += some
            else:
                left += some
        for at, got in self.encode_joined([words[i] for i in left], self.mark) if self.mark else ():
            some = left[at : at + JOINED]
            ends = np.append(np.flatnonzero(got == self.mark_id), len(got))
            if len(ends) == len(some):
                ids.append(got[got != self.mark_id])
                sizes.append(np.diff(ends, prepend=-1) - 1)
                order += some
        for i in sorted(set(left).difference(order)) if len(order) < len(words) else ():
            ids.append(np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32))
            sizes.append(np.array([len(ids[-1])]))
            order.append(i)
        lengths = np.concatenate(sizes)
        back = np.argsort(np.array(order))
        return ragged_take(np.concatenate(ids), starts_of(lengths)[:-1], lengths, back), lengths[back]

    def encode_joined(self, words: list[str], by: str) -> Iterator[tuple[int, np.ndarray]]:
        texts = [by.join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            yield k * JOINED, np.array(e.ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets at which each text's ids begin (the total last)."""
        if not self.by_words:
            return self.encode_whole(texts)
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        codes, words, per = split_words(texts)
        listed = words.to_pylist()
        place = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        if len(new := np.flatnonzero(place < 0)):
            unknown = [listed[i] for i in new.tolist()]
            ids, sizes = self.encode_words(unknown)
            place[new] = len(self.lengths) + np.arange(len(new))
            self.known.update(zip(unknown, place[new].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + starts_of(sizes)[:-1]])
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, sizes])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[place] += 1
        ends = np.cumsum(per)
        with_end = np.insert(place[codes], ends, 0) if len(codes) else np.zeros(len(per), np.int64)
        offsets = starts_of(self.lengths[with_end])
        return ragged_take(self.ids, self.starts, self.lengths, with_end), np.concatenate([[0], offsets[ends + np.arange(1, len(per) + 1)]]).astype(np.int64)


@functools.cache
def text_encoder(path: str, end_id: int = END_ID) -> TextEncoder:
    """One encoder, with the words it remembers, for all tasks of a worker."""
    return TextEncoder(path, end_id)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode all documents in ascending doc_id order into flat files below `folder`.

    Rows are dealt by ranges of doc_id, and each task writes one shard in order:
    `<n>.tokens` (flat little-endian unsigned integers, 2 bytes each if the vocabulary
    allows, else 4), `<n>.offsets` (unsigned 64-bit starts of the documents within the
    shard, the total last) and `<n>.ids` (signed 64-bit doc_ids). Files appear by an atomic
    rename, so a repeated task replaces its own shard by equal bytes.

    Returns the manifest, one row per shard: shard, n_docs, n_tokens, base (ids before the
    shard, a prefix sum over the shards' totals), width. Null texts are empty and give the
    end id alone. Null or repeated doc_ids are ordered by text among themselves, and a null
    one is written as NO_ID. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ordered = with_unique_ids(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(partitions, "key").sortWithinPartitions("key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = text_encoder(tokenizer_path, end_id)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        fs, root = store_of(folder)
        attempt = f".{shard}-{TaskContext.get().taskAttemptId()}"
        names = ("tokens", "offsets", "ids")
        out = {}
        n_docs, n_tokens = 0, 0
        for chunk in text_chunks(batches, limit=BYTES):
            if not out:
                fs.create_dir(root)
                out = {x: fs.open_output_stream(f"{root}/{attempt}.{x}") for x in names}
            ids, offsets = encoder.encode(chunk.column("text"))
            out["tokens"].write(ids.astype(f"<u{width}").tobytes())
            out["offsets"].write((offsets[:-1] + n_tokens).astype("<u8").tobytes())
            out["ids"].write(chunk.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
            n_docs, n_tokens = n_docs + chunk.num_rows, n_tokens + len(ids)
        if out:
            out["offsets"].write(np.array([n_tokens], "<u8").tobytes())
            for x in names:
                out[x].close()
                publish(fs, f"{root}/{attempt}.{x}", f"{root}/{shard}.{x}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": pa.array([width], pa.int32())})

    written = stored(ordered.select("doc_id", "text").mapInArrow(write, "shard long, n_docs long, n_tokens long, width int"), "manifest")
    # One row per shard: as many as the range exchange has partitions.
    shards = sorted(written.collect(), key=lambda r: r.shard)
    bases = starts_of(np.array([r.n_tokens for r in shards], np.int64))
    rows = [(r.shard, r.n_docs, r.n_tokens, int(b), r.width) for r, b in zip(shards, bases, strict=False)]
    return spark.createDataFrame(rows, "shard long, n_docs long, n_tokens long, base long, width int")


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Each task maps its shards' files into memory and walks the offsets; start adds the
    shard's base.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)

        def numbers(name: str, kind: str, first: int = 0, last: int | None = None) -> np.ndarray:
            """Numbers first .. last - 1 of a file: mapped where it is local, read as a range elsewhere."""
            size = np.dtype(kind).itemsize
            if isinstance(fs, pafs.LocalFileSystem):
                with open(name, "rb") as f:
                    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), kind)[first:last]
            with fs.open_input_file(name) as f:
                return np.frombuffer(f.read_at(((f.size() // size if last is None else last) - first) * size, first * size), kind)

        for batch in batches:
            for r in batch.to_pylist():
                offsets = numbers(f"{root}/{r['shard']}.offsets", "<u8").astype(np.int64)
                ids = numbers(f"{root}/{r['shard']}.ids", "<i8")
                for at in range(0, len(ids), 1000):
                    some = offsets[at : at + 1001]
                    tokens = numbers(f"{root}/{r['shard']}.tokens", f"<u{r['width']}", int(some[0]), int(some[-1]))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[at : at + 1000], pa.int64()),
                        "start": pa.array(r["base"] + some[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(some), pa.int64()),
                        "ids_crc32": pa.array([ids_crc32(tokens[a:b]) for a, b in zip(some[:-1] - some[0], some[1:] - some[0], strict=True)], pa.int64()),
                    })

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.select("shard", "base", "width").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the shards to the cluster's shared folder and read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    if urlparse(folder).scheme == "":
        folder = f"file://{folder}"
    return read_token_shards(write_token_shards(docs, folder, tokenizer_path), folder)
