"""SentencePiece encoding and decoding by an Aho-Corasick driven Viterbi (operator 8)."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_text, ragged_take, starts_of, text_chunks

SPACE = "▁"
#: Units whose pieces a worker remembers, and the bytes of the longest of them.
REMEMBERED, SHORT = 600_000, 64
#: What a byte costs beyond the rarest piece.
BYTE_COST = 10.0
#: A run of spaces with what follows it; no piece reaches across the start of such a unit.
UNIT = re.compile(" *[^ ]+| +")


class PieceCodec:
    """Pieces of a model file with a log-probability each, and the automaton over them.

    A unigram model brings its scores. A merge (BPE) model's scores are merge orders, not
    probabilities; its pieces get Zipf log-probabilities by that order, so that Viterbi
    prefers few and early pieces.
    """

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        if plain and all(s <= 0 and float(s).is_integer() for s in scores.values()):
            total = math.log(sum(1 / (2 - s) for s in scores.values()))
            scores = {i: -math.log(2 - s) - total for i, s in scores.items()}
        self.byte_score = min(scores.values(), default=0.0) - BYTE_COST
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece crosses the start of a word; this codec encodes word by word")
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), scores[i], i))
        self.automaton.make_automaton()
        self.single = {p for i in plain if len(p := self.pieces[i]) == 1} - {"\0"}
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.piece_lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.piece_starts = starts_of(self.piece_lengths)[:-1]
        self.forget()

    def forget(self) -> None:
        """The remembered units: place of each, and their ids and scores in a row."""
        self.known: dict[bytes, int] = {}
        self.ids, self.lengths, self.scores = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0)

    def best(self, unit: str) -> tuple[list[int], float]:
        """The best pieces of one unit: one pass over its characters; at each, every piece that
        ends there comes along the automaton's output links and relaxes that position's score."""
        literal = {i for i, c in enumerate(unit) if c == SPACE} if SPACE in unit else ()
        text = unit.replace(SPACE, "\0").replace(" ", SPACE)
        score, back = [0.0] + [-math.inf] * len(text), [(0, -1)] * (len(text) + 1)
        # Bytes cost more than any piece: only characters that are no piece need them.
        odd = [] if self.single.issuperset(text) else [(i, c) for i, c in enumerate(text) if c not in self.single]
        reached = 0

        def by_bytes(until: int) -> None:
            nonlocal reached
            while reached < len(odd) and odd[reached][0] < until:
                at, c = odd[reached]
                spare = score[at] + self.byte_score * (3 if at in literal else len(c.replace(SPACE, " ").encode()))
                if spare > score[at + 1]:
                    score[at + 1], back[at + 1] = spare, (at, -1)
                reached += 1

        for end, (length, s, piece) in self.automaton.iter(text):
            if odd:
                by_bytes(end)
            at = end + 1 - length
            total = score[at] + s
            if total > score[end + 1]:
                score[end + 1], back[end + 1] = total, (at, piece)
        if odd:
            by_bytes(len(text))
        out, at = [], len(text)
        while at:
            before, piece = back[at]
            raw = SPACE if before in literal else text[before].replace(SPACE, " ")
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(raw.encode())]
            at = before
        return out[::-1], score[-1]

    def encode(self, text: str) -> tuple[list[int], float]:
        """Ids of a whole text and their log-probability. The text gets one space in front unless empty."""
        parts = [self.best(unit) for unit in UNIT.findall(" " + text)] if text else []
        return [i for ids, _ in parts for i in ids], sum(score for _, score in parts)

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]

    def places(self, units: list[bytes]) -> np.ndarray:
        """Where the ids of distinct units stand; new ones are encoded, once."""
        place = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(place < 0)
        if len(new):
            found = [self.best(units[i].decode()) for i in new.tolist()]
            place[new] = len(self.lengths) + np.arange(len(new))
            self.known.update((units[i], p) for i, p in zip(new.tolist(), place[new].tolist(), strict=True) if len(units[i]) < SHORT)
            self.lengths = np.concatenate([self.lengths, np.array([len(ids) for ids, _ in found], np.int64)])
            self.ids = np.concatenate([self.ids, np.array([i for ids, _ in found for i in ids], np.uint32)])
            self.scores = np.concatenate([self.scores, np.array([score for _, score in found])])
        return place

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the offsets at which each text's ids begin (the total last), and each text's
        log-probability: what encode() gives for each, but a distinct unit is looked at once."""
        if len(self.lengths) > REMEMBERED:
            self.forget()
        data, begin = spaced(texts)
        blank = data == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[begin[:-1][begin[:-1] < begin[1:]]] = True
        units = np.flatnonzero(first)
        coded = pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(np.append(units, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        of = np.searchsorted(units, begin)  # a text's first unit
        offsets = starts_of(self.lengths[place])[of]
        ids = ragged_take(self.ids, starts_of(self.lengths)[:-1], self.lengths, place)
        return ids, offsets, np.bincount(np.repeat(np.arange(len(texts)), np.diff(of)), self.scores[place], len(texts)).astype(np.float64)

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, each with its space in front, and the offsets at which each begins."""
        return ragged_take(self.piece_bytes, self.piece_starts, self.piece_lengths, ids), starts_of(self.piece_lengths[ids])[offsets]


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, each but an empty one with one space in front, and the offsets at which each begins."""
    texts = texts.cast(pa.large_string())
    column = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    return data, begin - begin[0]


@functools.cache
def piece_codec_of(model_path: str) -> PieceCodec:
    """One codec, with the units it remembers, for all tasks of a worker."""
    return PieceCodec(model_path)


def piece_codec(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_pieces, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), score, decoded_sha256, round_trip.

    A purely local step: no shuffle, and nothing but a bounded memo of units in a worker, whatever
    the length of a text. Characters outside the vocabulary, and a literal piece-space, go by bytes,
    so that decoding gives every text back. Null texts are empty, with no pieces and score 0. Each
    row counts for itself, with a repeated or null doc_id too; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec_of(model_path)
        for chunk in text_chunks(batches):
            texts = chunk.column("text")
            ids, offsets, scores = codec.encode_all(texts)
            back, begin = codec.decode_all(ids, offsets)
            given, places = spaced(texts)
            same = np.array_equal(begin, places) and np.array_equal(back, given)
            ids, back = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), memoryview(back)
            each = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), begin[:-1].tolist(), begin[1:].tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "n_pieces": pa.array(np.diff(offsets)), "ids_crc32": pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b, *_ in each], pa.int64()),
                "score": pa.array(scores), "decoded_sha256": [hashlib.sha256(back[a + 1 : b] if b > a else b"").hexdigest() for _, _, a, b, _, _ in each],
                "round_trip": [same or np.array_equal(given[x:y], back[a:b]) for _, _, a, b, x, y in each],
            })

    return id_text(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean")
