"""Toxicity, the Merkle manifest and importance resampling against brute force, SQL and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import difference
from pyspark.sql import functions as F

from tidelog.llm import merkle, quality, queries, resampling, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, digest string, place int, bucket int"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    """A hot source, a null one and one with an empty name, null and repeated ids, null texts, newlines, long texts."""
    r = random.Random(3)
    new = lambda k: " ".join(r.choices(["alpha", "Beta", "Été", "x1", "日本", "gamma-ray", "q" * 40, "\n", "don't"], k=k))
    out = [(i, new(r.randrange(0, 60)), r.choice(["en", None]), r.choice(["hot"] * 4 + ["", "é", "z"]), r.choice([1, None])) for i in r.sample(range(10_000), 130)]
    out += [(None, "no id", "en", None, 1), (None, None, None, None, None), (7, "one\ntwo", "en", None, 2), (7, "one\ntwo", "en", None, 2), (20_001, new(30_000), "en", "alone", 0), (20_002, "", "", "hot", 0), (20_003, None, "en", "hot", 0)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 5, "h", 1, 2) for r in rows], SCHEMA).repartition(3)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)))


def plain_paths(leaves):
    """The root over the leaves, and for each leaf its levels of (left, right) siblings."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            a = k - k % 3
            paths[i].append((nodes[a:k], nodes[k + 1 : a + 3]))
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], paths


def brute_merkle(rows):
    out, subroots, groups = [], [], {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        some = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        subroots.append(plain_paths([plain_leaf(r, r[1]) for r in some]))
        groups[s] = some
    root, tops = plain_paths([s for s, _ in subroots])
    for s, (subroot, paths), top in zip(order, subroots, tops, strict=True):
        for row, path in zip(groups[s], paths, strict=True):
            leaf, even = plain_leaf(row, row[1]), row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = plain_leaf(row, row[1].replace("\n", "") if even and row[1] is not None else row[1])
            for left, right in path + top:
                folded = h(*left, folded, *right)
            out.append((row[0], leaf, subroot, root, h(*(x for left, right in path + top for x in left + right)), folded, folded == root))
    return Counter(out)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("block", "fan"), [(4096, 16), (5, 2), (1, 2), (9, 3)])
def test_merkle_manifest(docs, rows, monkeypatch, block, fan):
    """Blocks and merges of any size give the same tree; ties, nulls and repeated rows are leaves of their own."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "FAN", fan)
    monkeypatch.setattr(merkle.all_nodes, "__defaults__", (block,))
    assert Counter(tuple(r[n] for n in NAMES) for r in merkle.merkle_manifest(docs).collect()) == brute_merkle(rows)


def test_merkle_sql(spark):
    assert difference(queries.queries()["op12_merkle_manifest"](spark, SF), merkle.ORACLE_SQL, SF) == ""


def test_merkle_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(empty).collect() == [] and merkle.manifest(empty).root() is None


def test_merkle_of_one_row(spark):
    row = (1, "a\nb", None, "s", 3)
    got = merkle.merkle_manifest(spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long")).first()
    assert got.leaf == got.subroot == got.root == plain_leaf(row, row[1]) and got.proof_sha256 == h()


def test_many_small_sources(spark):
    rows = [(i, f"t\n{i}", "en", f"host{i // 2}", i) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r[n] for n in NAMES) for r in merkle.merkle_manifest(frame).collect()) == brute_merkle(rows)


def test_forests_merge_in_any_grouping():
    r = random.Random(8)
    for n in (1, 2, 3, 4, 27, 100):
        leaves = [h(str(i)).encode() for i in range(n)]
        want = plain_paths([x.decode() for x in leaves])[0].encode()
        order = r.sample(range(n), n)
        whole, parts = merkle.Forest(), [merkle.Forest() for _ in range(4)]
        for k in order:
            parts[r.randrange(4)].add("g", n, 0, k, leaves[k])
        roots = [d for p in parts for _, d, is_root in p.made if is_root]
        for p in r.sample(parts, 4):
            for (_, _, level, idx), d in p.nodes.items():
                whole.add("g", n, level, idx, d)
        assert roots + [d for _, d, is_root in whole.made if is_root] == [want] and not whole.nodes


def test_climb_leaves_what_a_block_cannot_resolve():
    leaves = [h(str(i)).encode() for i in range(40)]
    for lo, hi in ((0, 40), (1, 40), (0, 39), (4, 5), (9, 27), (10, 35)):
        forest, plain = merkle.Forest(), merkle.Forest()
        for level, i, d in merkle.climb(lo, leaves[lo:hi], 40):
            forest.add("g", 40, level, i, d)
        for i in range(lo, hi):
            plain.add("g", 40, 0, i, leaves[i])
        assert forest.nodes == plain.nodes


def plain_words(t):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))]


def plain_features(t):
    w = plain_words(t)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_importance_resampling(spark, docs, rows):
    target = ["alpha beta", None, "", "Été x1 日本 alpha"]
    s, t = (Counter(b for text in texts for b in plain_features(text)) for texts in ([r[1] for r in rows], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    scored = []
    for i, text, *_ in rows:
        f = plain_features(text)
        u = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), len(plain_words(text)) >= 20))
    eligible = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    ranks = {id(x): k for k, x in enumerate(eligible[: 5 * len(eligible) // 100], 1)}
    got = resampling.importance_resampling(docs, spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")).collect()
    assert len(ranks) > 1
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == Counter((*x[:4], ranks.get(id(x))) for x in scored)


def test_importance_resampling_sql(spark):
    assert difference(queries.queries()["op13_importance_resampling"](spark, SF), resampling.ORACLE_SQL, SF) == ""


def test_importance_resampling_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resampling.importance_resampling(empty, empty.select("text")).collect() == []
    one = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(resampling.importance_resampling(one, empty.select("text"), percent=100, least_words=2).collect(), key=str)
    assert [(r.doc_id, r.n_features, r["rank"]) for r in got] == [(1, 3, 1), (1, 3, 2), (None, 0, None)]


def test_crc_algebra():
    """Joined strings are never made, words may be of any length."""
    words = [b"a", b"bc", b"x" * 63, b"y" * 64, b"z" * 70_000, "é".encode(), b"0"]
    crc, size = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    r = random.Random(4)
    codes = np.array([r.randrange(len(words)) for _ in range(60)])
    for n, got in enumerate(resampling.gram_crcs(crc, size, codes, 5), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(words[c] for c in codes[i : i + n])) for i in range(61 - n)]


def test_words_of_sliced_texts():
    texts = ["A-b\x00c", "Été 9Z x", "", " ", "k_l"]
    whole = pa.array(["skip", *texts, "skip"])
    codes, words, per = resampling.words_of(whole.slice(1, 5))
    listed = words.take(pa.array(codes)).to_pylist()
    assert listed == [w for t in texts for w in plain_words(t)] and per.tolist() == [len(plain_words(t)) for t in texts]


@pytest.fixture(scope="module")
def judged(spark):
    """Documents of four sentences in two languages; the label depends on stems in one of the sentences."""
    r = random.Random(6)
    good = [f"word{k}" for k in range(200)]
    bad = ["vileness", "vilest", "grotten", "grottig", "scumbag"]
    rows, labels = [], []
    for i in range(900):
        text = [" ".join(r.choices(good, k=r.randrange(3, 12))) for _ in range(4)]
        toxic = r.random() < 0.3
        if toxic:
            text[i % 4] += f" {r.choice(bad)} {r.choice(bad)}"
        rows.append((i, r.choice([". ", "\n", "! "]).join(text), i % 4 if toxic else None))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_documents_and_sentences(judged):
    rows, docs, labels = judged
    toxic = {i for i, _, where in rows if where is not None}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == (i in toxic) for i in held) >= 0.98 * len(held)
    model = toxicity.train(docs, labels, F.lit(True))
    found = toxicity.offending_sentences(docs, model).collect()
    hits = {(r.doc_id, r.sentence) for r in found}
    want = {(i, where) for i, _, where in rows if where is not None}
    assert len(hits & want) >= 0.97 * len(want) and len(hits - want) <= 0.02 * len(want)
    texts = {i: t for i, t, _ in rows}
    assert all(" ".join(texts[r.doc_id].split()).find(r.text) >= 0 and r.n_words == len(r.text.split()) and texts[r.doc_id].split()[r.first_word] == r.text.split()[0] for r in found)


def test_toxicity_learns_only_from_its_rows(judged):
    """Labels of held-out rows change nothing."""
    _, docs, labels = judged
    held = toxicity.id_bucket(3) == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda some: {r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs, some).collect()}
    assert scores(labels) == scores(other)


def test_noisy_or_is_that_of_plain_sentences(spark):
    """Scores equal those worked out sentence by sentence, in plain Python."""
    keys = [toxicity.features_of(pa.array(["vile"]))[0][0], toxicity.features_of(pa.array(["grotty"]))[1][0]]
    weight = dict(zip(keys, (3.0, 1.5), strict=True))
    model = toxicity.Model(np.sort(np.array(keys)), np.array([weight[k] for k in sorted(keys)]), -4.0)
    texts = ["Vile, vile! So so.", "a b\nGrotto vile. c", "", None, " . ", "fine", "one 2.5 two. three", "x " * 200 + "vile", "。vile。b"]
    plain = lambda s: -4.0 + sum(3.0 * (re.sub(r"[\W_]+", "", w) == "vile") + 1.5 * (len(re.sub(r"[\W_]+", "", w)) > 3 and re.sub(r"[\W_]+", "", w)[:3] == "gro") for w in s.lower().split())
    want = []
    for t in texts:
        parts = [p.split() for p in re.split("[.!?…]+[\"'”’»)\\]]*\\s|[。！？]|[\n\r]", t or "")]
        inst = [" ".join(p[k : k + 64]) for p in parts for k in range(0, len(p), 64)]
        clean = 1.0
        for s in inst:
            clean *= 1 - 1 / (1 + math.exp(-plain(s)))
        want.append((1 - clean, len(inst)))
    got = sorted(toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect(), key=lambda r: r.doc_id)
    assert [r.n_sentences for r in got] == [n for _, n in want]
    assert np.allclose([r.score for r in got], [s for s, _ in want], atol=1e-12)
    assert [r.worst_sentence for r in got][:5] == [0, 1, None, None, None if want[4][1] == 0 else 0]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, "a"), (None, "b. c"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs.withColumn("toxic", F.lit(9)).withColumn("score", F.lit("x")), none).collect()
    assert len(got) == 4 and {r.score for r in got if r.n_sentences == 0} == {0.0}
    assert toxicity.toxicity(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 1), (1, None), (99, 1), (None, 0), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs, one).collect()) == 4


def test_toxicity_of_the_given_labels(spark):
    """Held-out rows of sf0.1: ranked well, few clean documents flagged."""
    sf = "/root/testdata/sf0.1"
    got = queries.queries()["op11_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    rank, pos = got["score"].rank(), got["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.96 and (got["predicted"] == got["toxic"]).mean() > 0.97 and got[~pos]["predicted"].mean() < 0.01


def test_quality_vectors_pooling_and_network_against_brute_force(spark):
    """Context sums word by word, means and spreads document by document, and the network's score unit by unit."""
    r = random.Random(9)
    vocabulary = ["alpha", "Beta,", "42nd", "Été", "x-Ray!", "a1B2c3D4e5F6", "日本", "..."]
    texts = [" ".join(r.choices(vocabulary, k=k)) for k in (1, 2, 5, 40, 300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    index, shapes = quality.index_vectors(quality.CORES, 1), quality.index_vectors(quality.SHAPES, 2)
    bucket = lambda part, w, size: int(quality.mix(quality.word_hashes(pa.array([part(w)])))[0] % np.uint64(size))
    sums = np.zeros((quality.CORES, quality.DIMENSIONS))
    for t in texts:
        cores = [bucket(quality.core_of, w, quality.CORES) for w in (t or "").split()]
        for i, c in enumerate(cores):
            for j in range(max(0, i - quality.REACH), min(len(cores), i + quality.REACH + 1)):
                if i != j:
                    sums[c] += index[cores[j]]
    contexts = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    learned = quality.learn_word_vectors(docs)
    assert np.allclose(learned, contexts, atol=1e-5)
    got = {x.doc_id: np.array(x.features) for x in quality.pooled(docs, learned).collect()}
    for k, t in enumerate(texts):
        w = (t or "").split()
        want = np.zeros(3 * quality.DIMENSIONS + 1)
        if w:
            v = np.array([(index + contexts)[bucket(quality.core_of, x, quality.CORES)] for x in w])
            s = np.array([shapes[bucket(quality.shape_of, x, quality.SHAPES)] for x in w])
            want = np.concatenate([v.mean(0), v.std(0), s.mean(0), [math.log1p(len(w))]])
        assert np.allclose(got[k], want, atol=2e-3)
    net = quality.fit_network(np.array([got[k % 7] + k for k in range(60)]), np.array([k % 2 for k in range(60)], float), epochs=3)
    x = got[3]
    hidden = [math.tanh(sum((x[i] - net.centre[i]) / net.scale[i] * net.w1[i, j] for i in range(len(x))) + net.b1[j]) for j in range(len(net.b1))]
    logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
    assert math.isclose(net.scores(x[None])[0], 1 / (1 + math.exp(-logit)), rel_tol=1e-9)


def test_shapes_are_whole():
    """No word's shape is cut."""
    assert quality.shape_of("aB1" * 9) == "xX9" * 9 and quality.shape_of("Éa-1") != quality.shape_of("Éa-1-") and quality.shape_of("WORLD2000") == "X9"
