"""The ten operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import difference
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, fingerprints, language_id, ngram_join, packing, piece_codec, quality, queries, substring_dedup, suffix_lm, token_output

SF = "/root/testdata/sf0.001"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, h string, n long"


def words(t, lower=False):
    b = (t or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", b.translate(LOW) if lower else b)


def corpus(seed=5, n=60):
    """Small texts with copies, near copies, shared passages, nulls, blanks and long ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ä", "Été", "ß", "naïve", "X"]
    new = lambda k: " ".join(r.choices(vocabulary, k=k))
    passage = new(60)
    texts = [None, "", " \t\n ", "one", "One", "a b c", "x " * 70, new(3000)]
    for _ in range(n):
        kind = r.random()
        if kind < 0.25 and texts[-1]:
            texts.append(r.choice([t for t in texts if t]))
        elif kind < 0.5:
            t = (r.choice([t for t in texts if t])).split(" ")
            t[r.randrange(len(t))] = "edit"
            texts.append(" ".join(t))
        elif kind < 0.7:
            texts.append(f"{new(30)} {passage}\n{new(10)}")
        else:
            texts.append(new(r.randrange(1, 120)))
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, "h", 7) for i, t in rows], SCHEMA).repartition(3)


def test_exact_dedup_sql(spark):
    assert difference(queries.queries()["op2_exact_dedup"](spark, SF), exact_dedup.ORACLE_SQL, SF) == ""


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().translate(LOW)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()} == want


def brute_windows(rows, size=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring_dedup(docs, rows):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()} == brute_windows(rows)


def test_window_index_in_batches(spark, rows):
    """Six batches, with compactions and a new session's index in between, find what one batch finds."""
    ordered = [(i, t or "") for i, t in sorted(rows)]
    frame = lambda part: spark.createDataFrame(part, "key long, text string")
    windows = lambda df: {(r.key, r.start + k) for r in df.collect() for k in range(r.n)}
    index, found = substring_dedup.WindowIndex(spark), set()
    step = -(-len(ordered) // 6)
    for at in range(0, len(ordered), step):
        found |= windows(index.add(frame(ordered[at : at + step])))
        index = substring_dedup.WindowIndex(spark, index.folder)
    assert found == windows(substring_dedup.WindowIndex(spark).add(frame(ordered)))
    assert sorted(level for level, _ in index.state["runs"]) == [1, 2]
    with pytest.raises(ValueError, match="must come after"):
        index.add(frame(ordered[:3]))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("crowd", [24, 1])
def test_ngram_join(docs, rows, crowd, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()} == brute_components(rows)


def test_ngram_join_meets_in_rounds(docs, rows, monkeypatch):
    """What crosses a shuffle at a time is bounded by the members' texts, however many blocks a block meets."""
    tables, stored = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: tables.append(name) or stored(df, name))
    for name, value in (("ROUND_BYTES", 1), ("CROWD", 1), ("TRIE_SETS", 1), ("FOLD", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()} == brute_components(rows)
    assert tables.count("met") > 1


def test_sketch_tells_rare_shingles_from_frequent_ones(spark):
    """1.8 million rare shingles beside one of 30 texts; 2^20 counters can't tell most rare ones from those of two texts."""
    r = np.random.default_rng(3)
    texts = [" ".join(["often"] * 4 + [f"{x:x}" for x in r.integers(0, 2**40, 60_000)]) for _ in range(30)]
    sketch = ngram_join.frequency_sketch(ngram_join.describe_sets(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key long, doc_id long, text string")))
    _, found = ngram_join.shingle_sets(pa.RecordBatch.from_pydict({"text": pa.array(texts[:1])}))
    _, often = ngram_join.shingle_sets(pa.RecordBatch.from_pydict({"text": pa.array(["often often often often"])}))
    rare = sketch[ngram_join.counter_of(found[~np.isin(found, often)])]
    assert (rare < sketch[ngram_join.counter_of(often)][0]).all() and (rare == rare.min()).mean() > 0.9


@pytest.mark.parametrize("x", [[], [0], [254, 255, 256, 256, 900, 1_000_000]])
def test_gaps_come_back(x):
    assert ngram_join.from_gaps(ngram_join.as_gaps(np.array(x, np.int64))).tolist() == x


def test_trie_join_is_exact():
    r = np.random.default_rng(1)
    base = r.choice(2**60, 80, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(60, 80), replace=False), r.integers(0, 2**60, r.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
    got = sorted(ngram_join.Trie(sets, np.ones(ngram_join.COUNTERS, np.int32)).similar(sets))
    want = sorted((i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)))
    assert got == want


def test_tokens_and_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_BPE)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    at, want = 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.token_output(docs, queries.WORD_BPE).collect()} == want
    pieces, bins = defaultdict(int), defaultdict(list)
    for r in packing.pack(docs, queries.WORD_BPE, group_docs=20).collect():
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: len(x) for i, x in ids.items()}
    for b in bins.values():
        ends = 0
        for offset, length in sorted(b):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    texts = ["a <|startoftext|>b <|endoftext|>", "", "é́ ﬁ x　y", "İ ǅ ß don't İİ 12ab", "   lead", "日本 語😀 x"]
    ids, at = token_output.TextEncoder(queries.WORD_BPE).encode(pa.array(texts))
    t = Tokenizer.from_file(queries.WORD_BPE)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    assert token_output.TextEncoder(queries.WORD_BPE).by_words
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, t = token_output.TextEncoder(path), Tokenizer.from_file(path)
    ids, at = encoder.encode(pa.array(["two  words", None, "x\n"]))
    assert not encoder.by_words and [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in ("two  words", "", "x\n")]


def test_negative_ids_come_back(spark):
    rows = [(-7, "a"), (-1, "b c"), (None, "d"), (3, "e")]
    got = token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string"), queries.WORD_BPE).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, -7), (True, -1), (True, 3)]


def test_first_fit_decreasing():
    sizes = np.random.default_rng(2).integers(1, 100, 300)
    bins, _ = packing.first_fit_decreasing(sizes, 128)
    room, want = [], np.zeros(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, free in enumerate(room) if free >= sizes[i]), len(room))
        if k == len(room):
            room.append(128)
        room[k] -= sizes[i]
        want[i] = k
    assert bins.tolist() == want.tolist()


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows)]
    assert len(got) == len(ordered)
    by_text = {}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    a, b = ["x x x y z " * 3 + " ".join(f"a{i}" for i in range(40)), "x y z z " * 3 + " ".join(f"a{i}" for i in range(10, 50))]
    ca, cb = Counter(a.split()), Counter(b.split())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    s = fingerprints.signatures([a, b], 4096)
    assert abs(np.mean(s[0] == s[1]) - true) < 0.04


def test_suffix_lm(docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {i: [*words(t, True), None] for i, t in rows}
    c = Counter(x for i, w in tokens.items() if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    for r in suffix_lm.suffix_lm(docs).collect():
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))


def test_suffix_lm_predicts_better_than_words(spark):
    r = queries.queries()["op6_suffix_lm"](spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def brute_pieces(codec, t):
    """Best ids and score of a whole text, trying every piece at every place."""
    scores = {p: (s, i) for p, (_, s, i) in codec.automaton.items()}
    given = " " + t if t else ""
    text, longest = given.replace("▁", "\0").replace(" ", "▁"), max(map(len, scores))
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        raw = given[end - 1]
        options = [(best[end - 1][0] + codec.byte_score * len(raw.encode()), best[end - 1][1] + [codec.byte_ids[b] for b in raw.encode()])]
        for start in range(max(0, end - longest), end):
            if text[start:end] in scores:
                s, i = scores[text[start:end]]
                options.append((best[start][0] + s, [*best[start][1], i]))
        best.append(max(options, key=lambda x: x[0]))
    return best[-1][1], best[-1][0]


def test_piece_codec(spark, docs, rows):
    codec = piece_codec.PieceCodec(queries.PIECES)
    more = ["hello world", "  two  spaces ", "naïve ▁ x", "日本\n\t😀", " ", "▁", "a\0b", "a\0▁b", "Don't   stop ", "x" * 90 + " é" * 3]
    rows = rows + [(50_000 + i, t) for i, t in enumerate(more)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(rows[-len(more) :], "doc_id long, text string")).repartition(2)
    got = {r.doc_id: r for r in piece_codec.piece_codec(docs, queries.PIECES).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, t = got[i], t or ""
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        ids, score = brute_pieces(codec, t) if len(t) < 400 else codec.encode(t)
        assert (r.n_pieces, r.ids_crc32, r.score) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), pytest.approx(score))
        assert codec.decode(codec.encode(t)[0]) == t


def brute_language(rows, learn):
    """Language and cosine of each text, trigram by trigram; `learn` tells which rows are learned from."""
    letters = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (language_id.LETTERS, language_id.DIMENSIONS)).astype(np.float64)

    def symbol(c):
        low = c.lower()[0]
        at = language_id.OWN.find(low)
        return (1 + at if at >= 0 else 1 + len(language_id.OWN) + ord(low) % (language_id.LETTERS - 1 - len(language_id.OWN))) if c.isalpha() else 0

    def bundle(text):
        s = [0]
        for c in (text or "") + " ":
            if (x := symbol(c)) or s[-1]:
                s.append(x)
        grams = Counter(zip(s, s[1:], s[2:], strict=False))
        return sum((np.sqrt(n) * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for (a, b, c), n in grams.items()), np.zeros(letters.shape[1]))

    protos = defaultdict(lambda: np.zeros(letters.shape[1]))
    for i, t, lang in rows:
        if learn(i) and lang and t:
            protos[lang] += bundle(t)
    names = sorted(x for x in protos if np.abs(protos[x]).any())
    unit = {x: protos[x] / np.linalg.norm(protos[x]) for x in names}
    out = {}
    for i, t, _ in rows:
        v = bundle(t)
        scored = [(float(unit[x] @ v / np.linalg.norm(v)), x) for x in names] if np.abs(v).any() else []
        best = max(scored, key=lambda x: (x[0], [-ord(c) for c in x[1]])) if scored else (0.0, "und")
        out[i] = (best[1], max(best[0], 0.0))
    return out


def test_language_id(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(sf)
    r = language_id.language_id(docs).join(docs, "doc_id")
    assert r.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !?", None), (3, "the and of", "en")], "doc_id long, text string, lang string")
    assert {x.doc_id: x.lang_pred for x in language_id.language_id(odd).collect()} == {1: "und", 2: "und", 3: "en"}
    rows = [(x.doc_id, x.text, x.lang) for x in docs.filter("n_chars < 1500").limit(60).collect()] + [(90_001, "Ñandú été", "es"), (90_002, "слово и дело", None), (90_003, "é", "fr")]
    want = brute_language(rows, lambda i: zlib.crc32(str(i).encode()) % 4 != 2)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert {i: s for i, (_, s) in got.items()} == pytest.approx({i: s for i, (_, s) in want.items()}, abs=1e-4)


def test_language_filter_tells_junk_from_text(spark):
    """No document of the table goes; hexadecimal, base64, code and an unknown script go, if long enough to tell."""
    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = ["".join(r.choices("0123456789abcdef", k=900)), "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=900)), "for(int i=0;i<n;i++){x[i]=y[i];}\n" * 30, "привет мир это текст на русском языке " * 9, "12 34 !!", None, ""]
    short = ["ff", "x[i]"]
    rows = [(10**6 + k, t, None) for k, t in enumerate([*junk, *short])]
    kept = {x.doc_id for x in language_id.language_filter(docs.union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert kept == {x.doc_id for x in docs.collect()} | {10**6 + len(junk) + k for k in range(len(short))}


def brute_signature(text, samples):
    """Consistent weighted samples, term by term, as 16-bit hashes."""
    counts, out = Counter(words(text)), []
    if not counts:
        return None
    terms = list(counts)
    h = np.array([fingerprints.word_hashes(pa.array([t.decode()]))[0] for t in terms], np.uint64)
    r, inverse, log_c, beta = fingerprints.term_draws(h, samples)
    for k in range(samples):
        best = None
        for j, t in enumerate(terms):
            level = np.floor(np.log(np.float32(counts[t])) * inverse[j, k] + beta[j, k])
            rate = log_c[j, k] - r[j, k] * (level - beta[j, k] + 1)
            if best is None or rate < best[0]:
                best = (rate, h[j], level)
        out.append(int(fingerprints.mix(np.array([best[1]]) ^ fingerprints.mix(np.array([best[2]]).astype(np.int64).view(np.uint64)))[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("terms", [fingerprints.TERMS, 7])
def test_fingerprints_against_every_term(spark, rows, monkeypatch, terms):
    """The query's columns from plain samples of each text, its edit and the next one; blocks of terms change nothing."""
    monkeypatch.setattr(fingerprints, "TERMS", terms)
    some = [(i, t) for i, t in sorted(rows) if len(t or "") < 700]
    texts = [t or "" for _, t in some]
    changed = [t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4] for k, t in enumerate(texts)]
    marks, other = ([brute_signature(t, fingerprints.SAMPLES) for t in x] for x in (texts, changed))
    alike = lambda a, b: float(np.mean(np.array(a) == np.array(b))) if a and b else float(a is b is None)
    shown = lambda m: "".join(f"{x:04x}" for x in m) if m else ""
    if terms == 7:
        got = fingerprints.signatures(texts)
        assert [shown(x.tolist()) if m else "" for x, m in zip(got, marks, strict=True)] == [shown(m) for m in marks]
        return
    want = {i: (shown(m), shown(o), alike(m, o), alike(m, marks[(k + 1) % len(marks)])) for k, ((i, _), m, o) in enumerate(zip(some, marks, other, strict=True))}
    frame = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.fingerprint, x.edited_fingerprint, x.near_edited, x.near_next) for x in fingerprints.fingerprints(frame).collect()} == want


def test_quality(spark):
    """On held-out rows: ranked well, and better than always answering 1."""
    sf = "/root/testdata/sf0.01"
    rows = queries.queries()["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and quality is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert auc > 0.9 and right > len(good) / len(rows) + 0.05 and right > 0.9


ALL = {
    "op1": lambda d: token_output.token_output(d, queries.WORD_BPE), "op2": exact_dedup.exact_dedup, "op3": substring_dedup.substring_dedup, "op4": fingerprints.fingerprints,
    "op5": ngram_join.ngram_join, "op6": suffix_lm.suffix_lm, "op7": lambda d: quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "op8": lambda d: piece_codec.piece_codec(d, queries.PIECES), "op9": lambda d: packing.pack(d, queries.WORD_BPE), "op10": language_id.language_id,
}


def by_rank(values):
    """The op's rows of the odd table below: null and empty text, 'a b' without id, twice with id 7, and 'c'."""
    return sorted(values, key=repr)


ODD = {
    "op1": (lambda r: (r.doc_id, r.n_tokens), [(None, 1), (None, 3), (7, 3), (7, 3), (7, 2)]),
    "op2": (lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept), [(None, None, 1, True), (None, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True), (7, 7, 1, True)]),
    "op3": (lambda r: (r.doc_id, r.n_words, r.n_removed), [(None, 0, 0), (None, 2, 0), (7, 2, 0), (7, 2, 0), (7, 1, 0)]),
    "op4": (lambda r: (r.doc_id, r.n_chars, 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1), [(None, 0, True), (None, 3, True), (7, 3, True), (7, 3, True), (7, 1, True)]),
    "op5": (lambda r: (r.doc_id, r.n_shingles, r.component_id), [(None, 0, None), (None, 1, None), (7, 1, None), (7, 1, None), (7, 1, 7)]),
    "op6": (lambda r: (r.doc_id, r.n_tokens, r.score < 0), [(None, 1, True), (None, 3, True), (7, 3, True), (7, 3, True), (7, 2, True)]),
    "op7": (lambda r: (r.doc_id, 0 <= r.score <= 1, r.predicted == int(r.score >= 0.3)), [(None, True, True)] * 2 + [(7, True, True)] * 3),
    "op8": (lambda r: (r.doc_id, r.n_pieces, r.round_trip), [(None, 0, True), (None, 2, True), (7, 2, True), (7, 2, True), (7, 1, True)]),
    "op9": (lambda r: (r.doc_id, r.start, r.length, r.doc_tokens), [(None, 0, 1, 1), (None, 0, 3, 3), (7, 0, 3, 3), (7, 0, 3, 3), (7, 0, 2, 2)]),
    "op10": (lambda r: (r.doc_id, r.lang_pred), [(None, "und"), (None, "en"), (7, "en"), (7, "en"), (7, "en")]),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_null_and_repeated_rows(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert ALL[name](empty).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (None, "a b", "en", "", 1, 1, "", 1), (7, "a b", "en", "", 1, 1, "", 1), (7, "a b", "en", "", 1, 1, "", 1), (7, "c", None, "", 1, 1, "", 1)], SCHEMA)
    take, want = ODD[name]
    assert by_rank(take(r) for r in ALL[name](odd).collect()) == by_rank(want)


@pytest.mark.parametrize("name", ["op1", "op3", "op5", "op6", "op8", "op9", "op10"])
def test_chunk_borders_change_nothing(spark, name):
    """About 7 MB of texts, some of over 100,000 characters, as one task's chunks and as many tasks'."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 2500").select("doc_id", "text", "lang")
    long = docs.filter("doc_id < 60").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text")).select(F.lit(10**6).alias("doc_id"), "text", F.lit("en").alias("lang"))
    docs = docs.union(long)
    rows = lambda d: {(r.doc_id, r.asDict().get("start", 0)): {k: v for k, v in r.asDict().items() if k not in ("sequence_id", "offset")} for r in ALL[name](d).collect()}
    one, many = rows(docs.coalesce(1)), rows(docs.repartition(11))
    assert one.keys() == many.keys() and len(one) >= 2501
    for k, r in one.items():
        assert {x: pytest.approx(v, rel=1e-6, abs=1e-4) if isinstance(v, float) else v for x, v in r.items()} == many[k]
