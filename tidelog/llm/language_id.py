"""Language identification by hyperdimensional profiles (operator 10)."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, small_batches, text_chunks

#: Size of a hypervector, and of the letter alphabet (0 is anything but a letter).
DIMENSIONS, LETTERS = 1024, 128
#: Letters with a symbol of their own: a-z and the small letters of Western Europe; others share the rest by code point.
OWN = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
NO_LANGUAGE = "und"
#: Trigram vectors that a worker remembers.
REMEMBERED = 16_384
#: The filter's rule: a text of at least so many letters goes if its cosine is below this. Of held-out documents
#: none of that length is below 0.3; hexadecimal, base64, code, random words and an unknown script are below 0.2.
ENOUGH_LETTERS, MIN_SCORE = 60, 0.2


@functools.cache
def letter_table() -> np.ndarray:
    """Symbol of each code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            low = c.lower()[0]
            place = OWN.find(low)
            table[point] = 1 + (place if place >= 0 else len(OWN) + ord(low) % (LETTERS - 1 - len(OWN)))
    return table


class NgramVectors:
    """Vectors of letter trigrams: letters are random +-1 vectors, permuted by place and bound by product."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (LETTERS, dimensions))
        self.places = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.table = letter_table()
        self.forget()

    def forget(self) -> None:
        self.row_of = np.full(LETTERS**3, -1, np.int32)
        self.rows, self.used = np.zeros((REMEMBERED, self.places[0].shape[1]), np.float32), 0

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a whole text and their counts; runs of other characters count as one gap."""
        s = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate([[0], s, [0]]).astype(np.int32)
        keep = s != 0
        keep[1:] |= s[:-1] != 0
        s = s[keep]
        s = np.concatenate([[0], s]) if len(s) and s[0] else s
        if len(s) < 3:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        grams = (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]
        return np.unique(grams, return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of REMEMBERED distinct trigrams at most."""
        rows = self.row_of[grams]
        if (rows < 0).any():
            new = grams[rows < 0]
            if self.used + len(new) > REMEMBERED:
                self.forget()
                new = grams
            a, b, c = new // LETTERS**2, new // LETTERS % LETTERS, new % LETTERS
            self.rows[self.used : self.used + len(new)] = self.places[0][a] * self.places[1][b] * self.places[2][c]
            self.row_of[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            rows = self.row_of[grams]
        return self.rows[rows]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows.shape[1], np.float64)
        for at in range(0, len(grams), REMEMBERED):
            out += counts[at : at + REMEMBERED].astype(np.float32) @ self.vectors(grams[at : at + REMEMBERED])
        return out


@functools.cache
def ngram_vectors(dimensions: int) -> NgramVectors:
    """One set of letter vectors, with the trigrams it remembers, for all tasks of a worker."""
    return NgramVectors(dimensions)


def learn_languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language prototypes from all rows with a lang: names in order, and unit vectors.

    Bundling is a sum, so each language's vector is the sum over its documents. Tasks bundle what
    they read, and Spark adds up one vector of each task and language. A document counts its
    trigrams by square root, which keeps long documents from drowning the others.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = ngram_vectors(dimensions)
        sums: dict[str, np.ndarray] = {}
        for chunk in text_chunks(batches):
            found: dict[str, list] = {}
            for text, lang in zip(chunk.column("text").to_pylist(), chunk.column("lang").to_pylist(), strict=True):
                grams, counts = vectors.counts(text)
                if len(grams):
                    found.setdefault(lang, []).append((grams, np.sqrt(counts)))
            for lang, parts in found.items():
                grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                grams, place = np.unique(grams, return_inverse=True)
                sums[lang] = sums.get(lang, 0.0) + vectors.bundle(grams, np.bincount(place, counts))
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "place": pa.array(range(dimensions), pa.int32()), "x": total})

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    got = rows.mapInArrow(bundle, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x")).toArrow()
    names = sorted(pc.unique(got["lang"]).to_pylist())
    prototypes = np.zeros((len(names), dimensions))
    prototypes[pc.index_in(got["lang"], pa.array(names, pa.string())).to_numpy().astype(np.int64), got["place"].to_numpy()] = got["x"].to_numpy()
    return names, (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predictor(names: list[str], prototypes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """A task's function from batches to (chunk, languages, scores, letters).

    The language is the one whose prototype has the largest cosine with the document's
    bundle; the score is that cosine, 0 at least. A text that is null or has no letter is
    `und` with score 0, and so is every text where no language was learned. Ties go to the
    first name.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        vectors = ngram_vectors(prototypes.shape[1])
        for chunk in text_chunks(batches):
            langs, scores, letters = [], [], []
            for text in chunk.column("text").to_pylist():
                grams, counts = vectors.counts(text or "")
                # A trigram ends at each letter, and one more after each word.
                letters.append(int(counts[grams % LETTERS != 0].sum()) if len(grams) else 0)
                if not len(grams) or not names:
                    langs.append(NO_LANGUAGE)
                    scores.append(0.0)
                    continue
                v = vectors.bundle(grams, np.sqrt(counts))
                cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(np.clip(cosines[best], 0, 1)))
            yield chunk, langs, scores, letters

    return predict


def predict_languages(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    predict = predictor(names, prototypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, langs, scores, _ in predict(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, holdout: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the rows that aren't held out.

    Only text and lang are learned from. Repeated rows are predicted alike, and a null doc_id
    counts as 0 when rows are held out. A text of any length is counted whole; what is held of it
    are its distinct trigrams. An empty table gives no rows, and one without a lang `und` alone.
    """
    small_batches(docs.sparkSession)
    bucket = id_bucket(holdout)
    names, prototypes = learn_languages(docs.filter(bucket != remainder))
    return predict_languages(docs, names, prototypes).select("doc_id", (bucket == remainder).alias("held_out"), "lang_pred", "score")


def language_filter(docs: DataFrame, min_score: float = MIN_SCORE, enough: int = ENOUGH_LETTERS) -> DataFrame:
    """The documents in a language, with all columns: not `und`, and not `enough` letters with a cosine
    under `min_score`. Shorter texts, of which a cosine tells little, stay unless they are `und`.

    Decided where each row is, without a join or shuffle. Null and repeated doc_ids don't matter; an
    empty table stays empty. Where no language could be learned, no row is in one.
    """
    small_batches(docs.sparkSession)
    names, prototypes = learn_languages(docs.filter(id_bucket(4) != 2))
    predict = predictor(names, prototypes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, langs, scores, letters in predict(batches):
            yield chunk.filter(pa.array([x != NO_LANGUAGE and (s >= min_score or n < enough) for x, s, n in zip(langs, scores, letters, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
