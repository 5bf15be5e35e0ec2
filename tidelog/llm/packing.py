"""Packing token pieces into fixed-length sequences (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, with_unique_ids
from .token_output import BYTES, END_ID, ids_crc32, text_encoder

#: Documents that a group holds on average.
GROUP_DOCS = 4096
MAX_TOKENS = 2048

PIECES = "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """A tournament tree over the room left in each bin; its root is the roomiest."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for `size`, whose room shrinks; winners are replayed to the root."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        found, at = at - self.leaves, at // 2
        while at:
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
            at //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; ties go by position. Every size is at most `room`."""
    tree = CapacityTree(len(sizes), room)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        b = bins[i] = tree.place(int(sizes[i]))
        offsets[i] = filled[b]
        filled[b] += sizes[i]
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Encode every text and cut its ids after each `max_tokens`; one row per piece, without the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path, end_id)
        for chunk in text_chunks(batches, limit=BYTES):
            ids, offsets = encoder.encode(chunk.column("text"))
            totals = np.diff(offsets)
            pieces = -(-totals // max_tokens)
            doc = np.repeat(np.arange(len(totals)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * max_tokens
            length = np.minimum(max_tokens, totals[doc] - start)
            at = offsets[doc] + start
            yield pa.RecordBatch.from_pydict({
                "key": chunk.column("key").take(pa.array(doc)), "doc_id": chunk.column("doc_id").take(pa.array(doc)), "start": start, "length": length,
                "ids_crc32": pa.array([ids_crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()), "doc_tokens": totals[doc],
            })

    return docs.select("key", "doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, group_docs: int = GROUP_DOCS, seed: int = 0) -> DataFrame:
    """Pieces in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are dealt into randomised groups by a hash of their key; the number of groups
    follows the table, so a group has about `group_docs` documents at any size. A document
    is cut after each `max_tokens` ids, so whole pieces fill sequences of their own and only
    its last piece is packed with others: first-fit decreasing within the group, the first
    bin with room being found in a tournament tree. Only lengths and checksums travel to the
    groups. A sequence_id is its group's number times 2**32 plus the bin.

    Null texts are empty: the end id alone. Null and repeated doc_ids are documents of their
    own. An empty table gives no rows.
    """
    keyed = with_unique_ids(docs)
    groups = max(1, -(-keyed.count() // group_docs))
    pieces = cut_pieces(keyed, tokenizer_path, max_tokens).withColumn("grp", F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(groups)))

    def fit(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["key", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(items["length"].to_numpy(), max_tokens)
        items["sequence_id"], items["offset"] = (items["grp"].to_numpy() << 32) + bins, offsets
        return items[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pieces.groupBy("grp").applyInPandas(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
