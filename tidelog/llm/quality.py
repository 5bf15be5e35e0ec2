"""Quality classifier: random-indexing word vectors, pooled, into a calibrated two-layer network (operator 7)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, id_text, mix, split_words, starts_of, stored, text_chunks, word_hashes

#: Buckets for word cores and for word shapes, and the size of a vector.
CORES, SHAPES, DIMENSIONS = 1 << 13, 1 << 10, 32
#: Non-zero entries of an index vector, and the words on each side that make a context.
NONZERO, REACH = 4, 2
#: Labelled rows that the network is fitted on at most: those with the least hash of doc_id.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
#: Words whose buckets a task remembers.
REMEMBERED = 400_000
#: Words whose context is added up at a time.
BLOCK = 1 << 18

LETTER_RUNS = (re.compile("[^\\W\\d_]+"), re.compile("[A-Z]+"), re.compile("[a-z]+"), re.compile("\\d+"))


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary random vectors."""
    r = np.random.default_rng(seed)
    out = np.zeros((rows, DIMENSIONS), np.float32)
    for k in range(NONZERO):
        out[np.arange(rows), r.integers(0, DIMENSIONS, rows)] += 1 - 2 * (k % 2)
    return out


def shape_of(word: str) -> str:
    """Letters as X, x or o (beyond ASCII), digits as 9, runs shortened to one."""
    if word.isascii() and word.isalpha():  # most words, without expressions
        if word.islower():
            return "x"
        if word[0].isupper() and word[1:].islower():
            return "Xx"
    s = LETTER_RUNS[2].sub("x", LETTER_RUNS[1].sub("X", LETTER_RUNS[3].sub("9", word)))
    s = re.sub("[^\\W\\d_xX]+", "o", s)
    return re.sub(r"(.)\1+", r"\1", s)


def core_of(word: str) -> str:
    """A word's letters, lower-cased."""
    return word.lower() if word.isalpha() else "".join(LETTER_RUNS[0].findall(word)).lower()


class Buckets:
    """Bucket of a part of each distinct word, remembered within bounds."""

    def __init__(self, part: Callable[[str], str], size: int):
        self.part, self.size, self.known = part, size, {}

    def __call__(self, listed: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if missing := [w for w in listed if w not in self.known]:
            found = mix(word_hashes(pa.array([self.part(w) for w in missing], pa.string()))) % np.uint64(self.size)
            self.known.update(zip(missing, found.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))


def learn_word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all core buckets, from every text: each task adds up the index vectors of
    the neighbours of every word, and Spark adds up the tasks' sums (at most CORES rows each)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, core_bucket = index_vectors(CORES, 1), Buckets(core_of, CORES)
        total, seen = np.zeros((CORES, DIMENSIONS)), np.zeros(CORES, np.int64)
        for chunk in text_chunks(batches):
            codes, words, per = split_words(chunk.column("text"))
            cores = core_bucket(words.to_pylist())[codes] if len(words) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(per)), per)
            for at in range(0, len(cores), BLOCK):
                low, high = max(0, at - REACH), min(len(cores), at + BLOCK + REACH)
                part, owner = cores[low:high], doc[low:high]
                near = np.zeros((len(part), DIMENSIONS), np.float32)
                vectors = index[part]
                for step in range(1, REACH + 1):
                    same = (owner[step:] == owner[:-step])[:, None]
                    near[step:] += vectors[:-step] * same
                    near[:-step] += vectors[step:] * same
                mid = slice(at - low, at - low + min(BLOCK, len(cores) - at))
                order = np.argsort(part[mid], kind="stable")
                found, first = np.unique(part[mid][order], return_index=True)
                total[found] += np.add.reduceat(near[mid][order], first, axis=0)
                seen += np.bincount(part[mid], minlength=CORES)
        rows = np.flatnonzero(seen)
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            yield pa.RecordBatch.from_pydict({"core": pa.array(some, pa.int32()), "sums": pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))})

    sums = id_text(docs).select("text").mapInArrow(add_up, "core int, sums array<double>")
    added = sums.groupBy("core").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIMENSIONS)]).toArrow()
    out = np.zeros((CORES, DIMENSIONS))
    if added.num_rows:
        out[added["core"].to_numpy()] = np.stack([added[f"s{i}"].to_numpy() for i in range(DIMENSIONS)], axis=1)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pooled(docs: DataFrame, contexts: np.ndarray) -> DataFrame:
    """doc_id and features of every text: mean and spread of its word vectors, mean of its shape
    vectors, log of its number of words. All zeros without words."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core_bucket, shape_bucket = Buckets(core_of, CORES), Buckets(shape_of, SHAPES)
        words_by, shapes_by = index_vectors(CORES, 1) + contexts, index_vectors(SHAPES, 2)
        for chunk in text_chunks(batches):
            codes, words, per = split_words(chunk.column("text"))
            bounds, out = starts_of(per), np.zeros((chunk.num_rows, 3 * DIMENSIONS + 1), np.float32)
            listed = words.to_pylist()
            cores, shapes = core_bucket(listed), shape_bucket(listed)
            for i in range(chunk.num_rows):
                some, counts = np.unique(codes[bounds[i] : bounds[i + 1]], return_counts=True)
                if len(some):
                    share = (counts / per[i]).astype(np.float32)
                    vectors = words_by[cores[some]]
                    mean = share @ vectors
                    out[i, :DIMENSIONS], out[i, DIMENSIONS : 2 * DIMENSIONS] = mean, np.sqrt(np.maximum(share @ vectors**2 - mean**2, 0))
                    out[i, 2 * DIMENSIONS : -1], out[i, -1] = share @ shapes_by[shapes[some]], np.log1p(per[i])
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "features": pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float32()))})

    return id_text(docs).mapInArrow(pool, "doc_id long, features array<float>")


@dataclass
class Network:
    """Standardised features, a tanh layer, a logit divided by a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the rest choose the temperature.

    With one class or no rows the network always answers that class's smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    r = np.random.default_rng(seed)
    d = x.shape[1]
    centre, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
    net = Network(centre, scale, r.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return net
    net.w2 = r.normal(0, hidden**-0.5, hidden)
    order = r.permutation(len(x))
    train, check = order[len(x) // 5 :], order[: len(x) // 5]
    z = (x - centre) / scale
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    b2, step = np.array([net.b2]), 0
    for _ in range(epochs):
        for at in range(0, len(train), batch):
            rows = r.choice(train, batch) if len(train) >= batch else train
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + b2, -50, 50))) - y[rows]) / len(rows)
            back = np.outer(g, net.w2) * (1 - h**2)
            grads = (z[rows].T @ back + 1e-4 * net.w1, back.sum(0), h.T @ g + 1e-4 * net.w2, np.array([g.sum()]))
            step += 1
            for p, grad, (m, v) in zip((net.w1, net.b1, net.w2, b2), grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(b2[0])
    if len(check) and len(set(y[check].tolist())) == 2:
        logits = net.logits(x[check])
        loss = lambda t: np.mean(np.logaddexp(0, np.where(y[check] == 1, -logits, logits) / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS, holdout: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, empty and null texts too.

    Word vectors are learned from all texts, without labels. The network is fitted on at
    most `max_training_rows` labelled rows that aren't held out. Labels without a document,
    or null, are ignored; a document with several labels counts once for each. Repeated
    rows are scored alike; a null doc_id counts as 0 when rows are held out. A long text counts
    whole, by its distinct words. An empty table gives no rows; without labels all scores are 0.5.
    """
    features = stored(pooled(docs, learn_word_vectors(docs)), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    usable = marks.filter(id_bucket(holdout) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_training_rows)
    got = features.dropna(subset=["doc_id"]).join(usable, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_training_rows).select("features", "quality").toArrow()
    x = np.array(got["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(got.num_rows, 3 * DIMENSIONS + 1)
    net = fit_network(x, got["quality"].to_numpy().astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = net.scores(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())})

    scored = features.mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (id_bucket(holdout) == 0).alias("held_out"), "score", "predicted")
