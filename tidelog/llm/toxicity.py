"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, noisy-or is between (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, id_text, split_words, starts_of, stored, text_chunks, word_hashes

#: Labelled rows that the model is fitted on at most: those with the least hash of doc_id.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7
#: Sentences at which a document is said to offend.
SENTENCE_THRESHOLD = 0.5
#: Words after which a sentence without an end is cut.
LONGEST_SENTENCE = 64
#: Letters of a word's beginnings that are features beside the whole word.
STEMS = (3, 4, 5, 6, 7, 8)
#: Labelled documents that must have a feature, the least chi-square of its presence against the label, and the features kept at most.
LEAST_DOCUMENTS, LEAST_CHI2, MOST_FEATURES = 4, 20.0, 1024
#: What ends a sentence: a full stop and the like before a blank, an ideographic one, a line break.
SENTENCE_END = "[.!?…]+[\"'”’»)\\]]*\\s|[。！？]|[\\n\\r\\x0b\\x0c]"
#: Stands for such an end among the words.
END = "\x1e"


def features_of(words: pa.Array) -> list[np.ndarray]:
    """Hashes of each word's letters and digits, lower-cased, whole and by their beginnings; 0 where a word has none, or is no longer than that."""
    plain = pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), "[^\\p{L}\\p{N}]+", "")
    size = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
    found = [np.where(size > 0, word_hashes(plain, 1) | np.uint64(1), np.uint64(0))]
    for k in STEMS:
        found.append(np.where(size > k, word_hashes(pc.utf8_slice_codeunits(plain, 0, k), 1 + k) | np.uint64(1), np.uint64(0)))
    return found


@dataclass
class Sentences:
    """A chunk's words by sentence: the code of each word, the instance it is in, the row of each instance, its number in the text and first word there."""

    codes: np.ndarray
    words: pa.Array
    instance: np.ndarray
    row: np.ndarray
    number: np.ndarray
    word: np.ndarray


def sentences_of(texts: pa.Array) -> Sentences:
    """Every text has one instance at least, if it has a word. Sentences of more than LONGEST_SENTENCE words are cut at multiples of that."""
    marked = pc.replace_substring_regex(pc.replace_substring(texts.cast(pa.large_string()), END, " "), SENTENCE_END, f" {END} ")
    codes, words, per = split_words(marked)
    owner = np.repeat(np.arange(len(per)), per)
    is_end = pc.fill_null(pc.equal(words, END), False).to_numpy(zero_copy_only=False)[codes] if len(words) else np.zeros(0, bool)
    after = np.cumsum(is_end)  # ends up to here
    real = ~is_end
    codes, owner, after = codes[real], owner[real], after[real]
    n = len(codes)
    new = np.ones(n, bool)
    new[1:] = (after[1:] != after[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    new |= place % LONGEST_SENTENCE == 0
    begin = np.flatnonzero(new)
    row = owner[begin]
    first = np.searchsorted(row, row)  # of the same text
    text_start = np.searchsorted(owner, row)
    return Sentences(codes, words, np.cumsum(new) - 1, row, np.arange(len(row)) - first, begin - text_start)


@dataclass
class Model:
    """Sorted feature hashes with weights; a sentence's logit is the bias plus the weights of all features of its words."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def word_weights(self, words: pa.Array) -> np.ndarray:
        out = np.zeros(len(words))
        if len(self.keys) and len(words):
            for h in features_of(words):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                out += np.where(self.keys[at] == h, self.weights[at], 0)
        return out

    def instances(self, s: Sentences) -> np.ndarray:
        """Logit of each sentence."""
        return self.bias + np.bincount(s.instance, self.word_weights(s.words)[s.codes], minlength=len(s.row))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def noisy_or(logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """1 less the product of 1 less each sentence's probability, by row; 0 without sentences."""
    return -np.expm1(-np.bincount(row, softplus(logits), minlength=rows))


def telling_features(training: DataFrame, positives: int, negatives: int) -> np.ndarray:
    """Sorted hashes of the features whose presence goes with the label most, at most MOST_FEATURES: each task counts the documents of
    either label that have a feature, Spark adds the counts up and judges them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=1 << 20):  # seven features of every word are held
            toxic = chunk.column("toxic").to_numpy(zero_copy_only=False) > 0
            codes, words, per = split_words(chunk.column("text"))
            owner = np.repeat(np.arange(len(per)), per)
            pairs = np.unique(owner * len(words) + codes) if len(words) else np.zeros(0, np.int64)
            owner, codes = pairs // max(len(words), 1), pairs % max(len(words), 1)
            keys, docs = [], []
            for h in features_of(words) if len(words) else ():
                some = h[codes] != 0
                keys.append(h[codes][some])
                docs.append(owner[some])
            key, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, docs))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[once], doc[once]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            hit = toxic[doc].astype(np.int64)
            pos = np.add.reduceat(hit, begin) if len(begin) else hit
            all_ = np.diff(np.append(begin, len(key)))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[begin].view(np.int64) if len(key) else key, pa.int64()), "pos": pa.array(pos), "neg": pa.array(all_ - pos)})

    a, b = F.col("pos"), F.col("neg")
    n = float(positives + negatives)
    there = a + b
    chi2 = n * (a * (negatives - b) - b * (positives - a)) ** 2 / (there * (n - there) * float(max(positives, 1)) * float(max(negatives, 1)))
    counted = training.select("text", "toxic").mapInArrow(count, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg"))
    told = counted.filter((there >= LEAST_DOCUMENTS) & (there < n)).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
    got = told.orderBy(F.desc("chi2"), "key").limit(MOST_FEATURES).select("key").toArrow()
    return np.sort(got["key"].to_numpy().astype(np.int64).view(np.uint64))


def training_bags(training: DataFrame, keys: np.ndarray) -> pa.Table:
    """Per training document: its label, its number of sentences, and (sentence, feature, times) of the telling features in it."""
    kind = "toxic int, sentences long, instance array<int>, feature array<int>, times array<int>"

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            s = sentences_of(chunk.column("text"))
            inst, feat = [], []
            for h in features_of(s.words) if len(keys) and len(s.words) else ():
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = (keys[at] == h)[s.codes]
                inst.append(s.instance[hit])
                feat.append(at[s.codes][hit])
            i, f = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (inst, feat))
            both, times = np.unique(i * max(len(keys), 1) + f, return_counts=True)
            i, f = both // max(len(keys), 1), both % max(len(keys), 1)
            ends = starts_of(np.bincount(s.row[i], minlength=chunk.num_rows)).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"toxic": chunk.column("toxic"), "sentences": pa.array(np.bincount(s.row, minlength=chunk.num_rows)), "instance": lists(s.number[i]), "feature": lists(f), "times": lists(times)})

    return training.select("text", "toxic").mapInArrow(collect, kind).toArrow()


def fit(bags: pa.Table, keys: np.ndarray, steps: int = 600, rate: float = 0.05, ridge: float = 5e-4) -> Model:
    """Adam on the logistic loss of the noisy-or of all sentences. Sentences without a telling feature are alike and enter by their number.

    With one class, or no rows, every sentence gets the same smoothed probability.
    """
    y = bags["toxic"].to_numpy().astype(float)
    total = bags["sentences"].to_numpy().astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share))) - float(np.log(max(total.mean() if len(total) else 1, 1)))
    if len(set(y.tolist())) < 2 or not len(keys):
        return Model(keys[:0], np.zeros(0), bias)
    per = pc.list_value_length(bags["instance"]).to_numpy()
    doc = np.repeat(np.arange(len(y)), per)
    number, feature, times = (pc.list_flatten(bags[c].combine_chunks()).to_numpy() for c in ("instance", "feature", "times"))
    order = np.lexsort((number, doc))
    doc, number, feature, times = doc[order], number[order], feature[order], np.minimum(times[order], 3).astype(float)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    inst = np.cumsum(new) - 1
    inst_doc = doc[new]
    empty = total - np.bincount(inst_doc, minlength=len(y))
    p = np.append(np.zeros(len(keys)), bias)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        z = p[-1] + np.bincount(inst, p[feature] * times, minlength=len(inst_doc))
        odds = empty * softplus(p[-1]) + np.bincount(inst_doc, softplus(z), minlength=len(y))
        slope = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(odds, 500)), 1e-3), 1.0)
        back = slope[inst_doc] * sigmoid(z)
        grad = np.append(np.bincount(feature, back[inst] * times, minlength=len(keys)), back.sum() + (slope * empty).sum() * sigmoid(p[-1])) / len(y)
        grad[:-1] += ridge / len(keys) ** 0.5 * p[:-1]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad**2 - v)
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(keys, p[:-1], float(p[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_training_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from at most `max_training_rows` labels of documents for which `usable`, a condition on doc_id, holds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    some = marks.filter(usable).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_training_rows)
    # Ids are chosen before texts are read; the chosen texts, not all, are dealt out again.
    joined = id_text(docs).dropna(subset=["doc_id"]).join(F.broadcast(some), "doc_id")  # at most `max_training_rows` ids
    training = stored(joined.repartition("doc_id").select("text", "toxic"), "training")
    counts = {r["toxic"] > 0: r["n"] for r in training.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    keys = telling_features(training, counts.get(True, 0), counts.get(False, 0))
    return fit(training_bags(training, keys), keys)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences, worst_sentence (its number in the text, from 0; null without words), worst_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            s = sentences_of(chunk.column("text"))
            z, rows = model.instances(s), chunk.num_rows
            score = noisy_or(z, s.row, rows)
            order = np.lexsort((s.number, -z, s.row))
            first = order[np.flatnonzero(np.append(True, s.row[order][1:] != s.row[order][:-1]))] if len(order) else order
            worst, top, none = np.zeros(rows, np.int64), np.zeros(rows), np.ones(rows, bool)
            worst[s.row[first]], top[s.row[first]], none[s.row[first]] = s.number[first], sigmoid(z[first]), False
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32)), "n_sentences": pa.array(np.bincount(s.row, minlength=rows)),
                "worst_sentence": pa.array(worst, mask=none), "worst_score": pa.array(top, mask=none),
            })

    return id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int, n_sentences long, worst_sentence long, worst_score double")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = SENTENCE_THRESHOLD) -> DataFrame:
    """doc_id, sentence (its number), first_word (its place among the text's words, ends of sentences apart), n_words, text, score of every sentence from `threshold` on."""
    kind = "doc_id long, sentence long, first_word long, n_words long, text string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            s = sentences_of(chunk.column("text"))
            p = sigmoid(model.instances(s))
            bad = np.flatnonzero(p >= threshold)
            bounds = np.searchsorted(s.instance, np.arange(len(s.row) + 1))
            said = [" ".join(s.words.take(pa.array(s.codes[bounds[i] : bounds[i + 1]])).to_pylist()) for i in bad.tolist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id").take(pa.array(s.row[bad])), "sentence": pa.array(s.number[bad]), "first_word": pa.array(s.word[bad]),
                "n_words": pa.array(np.diff(bounds)[bad]), "text": pa.array(said, pa.string()), "score": pa.array(p[bad]),
            })

    return id_text(docs).mapInArrow(run, kind)


def toxicity(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS, holdout: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_sentences, worst_sentence, worst_score.

    Only labels of rows whose crc32 of doc_id modulo `holdout` isn't `held` are learned from. A sentence's logit sums the weights of its
    words and of their beginnings, of which those are kept that go with the labels; a document's score is the noisy-or
    of all its sentences. Empty and null texts, and texts without words, score 0. Labels without a document, or null, are
    ignored; a document with several labels counts once for each. A null doc_id counts as 0 when rows are held out. Repeated
    rows are scored alike. A long text counts whole. Without documents there are no rows; without labels every
    sentence has the same probability.
    """
    model = train(docs, labels, id_bucket(holdout) != held, max_training_rows)
    scored = scores(docs, model, threshold)
    return scored.select("doc_id", (id_bucket(holdout) == held).alias("held_out"), *scored.columns[1:])
