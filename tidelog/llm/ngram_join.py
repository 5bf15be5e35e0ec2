"""N-gram Jaccard self-join by prefixes and tries (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, gram_hashes, id_text, mix, split_words, starts_of, stored, text_chunks, with_row_keys, with_unique_ids, word_hashes
from .components import components
from .suffix_lm import KeyFilter

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, SIMILARITY = 4, 85
#: Counters of the frequency sketch, the slices in which tasks send theirs, and shingles that a task gathers before it does.
COUNTERS, SLICES, FOLD = 1 << 25, 64, 1 << 22
#: Sets of a block; sets beyond which those of a token aren't paired; cells of a membership table.
TRIE_SETS, CROWD, CELLS = 256, 24, 1 << 25
#: Bytes of texts that cross a shuffle for meetings at a time, at least.
ROUND_BYTES = 1 << 30


def shingle_sets(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of the distinct shingles of each text, sorted by both; words are lower-cased A-Z."""
    codes, words, per = split_words(pc.ascii_lower(chunk.column("text")))
    h = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    bounds = starts_of(per)
    owner = np.repeat(np.arange(len(per)), per)
    grams = gram_hashes(h, SHINGLE)
    inside = owner[: len(grams)] == owner[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    whole = np.array([gram_hashes(h[bounds[i] : bounds[i + 1]], int(per[i]), 1)[0] for i in short], np.uint64)
    rows, found = np.concatenate([owner[: len(grams)][inside], short]), np.concatenate([grams[inside], mix(whole)])
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]


def digests(rows: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set, and two independent 64-bit digests of it."""
    sizes = np.bincount(rows, minlength=n)
    d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(rows):
        some, first = np.flatnonzero(sizes), np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        d1[some], d2[some] = np.add.reduceat(mix(found), first), np.add.reduceat(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    return sizes, d1.view(np.int64), d2.view(np.int64)


def counter_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def as_gaps(x: np.ndarray) -> bytes:
    """Sorted numbers at about a byte each: the distance from the one before, where 255 stands for that and a further byte."""
    step = np.diff(x, prepend=0)
    more = step // 255
    out = np.full(len(x) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = step % 255
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


SETS = "key long, doc_id long, n long, d1 long, d2 long, slice int, counters binary"


def describe_sets(keyed: DataFrame) -> DataFrame:
    """A row for each document with its set's size and digests, and the counters that its shingles raise, in slices."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def raised() -> pa.RecordBatch:
            x = np.sort(np.concatenate([np.zeros(0, np.uint32), *held])).astype(np.int64)
            cuts, width = np.searchsorted(x, np.arange(SLICES + 1) * (COUNTERS // SLICES)), COUNTERS // SLICES
            none = pa.nulls(SLICES, pa.int64())
            parts = [as_gaps(x[a:b] - i * width) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            return pa.RecordBatch.from_pydict({"key": none, "doc_id": none, "n": none, "d1": none, "d2": none, "slice": pa.array(range(SLICES), pa.int32()), "counters": pa.array(parts, pa.binary())})

        for chunk in text_chunks(batches):
            rows, found = shingle_sets(chunk)
            held.append(counter_of(found).astype(np.uint32))
            size += len(found)
            n, d1, d2 = digests(rows, found, chunk.num_rows)
            yield pa.RecordBatch.from_pydict({"key": chunk.column("key"), "doc_id": chunk.column("doc_id"), "n": n, "d1": d1, "d2": d2, "slice": pa.nulls(len(n), pa.int32()), "counters": pa.nulls(len(n), pa.binary())})
            if size > FOLD:
                yield raised()
                held, size = [], 0
        if size:
            yield raised()

    return stored(keyed.select("key", "doc_id", "text").mapInArrow(describe, SETS), "described")


def frequency_sketch(described: DataFrame) -> np.ndarray:
    """How many documents hold a shingle, by counters of its hash: COUNTERS bytes at any size of the corpus.

    A byte is eight times the logarithm to base 2 of its counter and one, so it tells counts apart that differ by a tenth."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("slice").to_pylist(), batch.column("counters"), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(COUNTERS // SLICES, np.int64)
                np.add.at(sums[part], from_gaps(data.as_py()), 1)
        levels = [np.minimum(8 * np.log2(1 + x), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "levels": pa.array(levels, pa.binary())})

    raised = described.filter("slice is not null").select("slice", "counters").repartitionById(SLICES, "slice")
    summed = stored(raised.mapInArrow(add, "slice int, levels binary"), "sketch")
    got = summed.toArrow()
    discard(summed)
    sketch = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for part, levels in zip(got["slice"].to_pylist(), got["levels"], strict=True):
        sketch[part] = np.frombuffer(levels.as_buffer(), np.uint8)
    return sketch.ravel()


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Two sets of enough similarity share one of this many first shingles of each, in any one order."""
    return n + (-n * SIMILARITY // 100) + 1


def prefixes(keyed: DataFrame, sketch: object) -> DataFrame:
    """(key, n, tokens): the first shingles of each document, rare ones first. Of equal sets in a chunk the least key goes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            rows, found = shingle_sets(chunk)
            n, d1, d2 = digests(rows, found, chunk.num_rows)
            keys = chunk.column("key").to_numpy()
            order = np.lexsort((keys, d2, d1, n))
            again = np.zeros(len(n), bool)
            again[order[1:]] = (n[order[1:]] == n[order[:-1]]) & (d1[order[1:]] == d1[order[:-1]]) & (d2[order[1:]] == d2[order[:-1]])
            use = ~again[rows]
            rows, found = rows[use], found[use]
            order = np.lexsort((found, sketch.value[counter_of(found)], rows))
            rows, found = rows[order], found[order]
            size = np.where(again, 0, n)
            first = np.arange(len(rows)) - starts_of(size)[rows] < prefix_size(n)[rows]
            some = np.flatnonzero(size)
            offsets = starts_of(np.bincount(rows[first], minlength=len(n))[some])
            yield pa.RecordBatch.from_pydict({"key": keys[some], "n": n[some], "tokens": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[first].view(np.int64)))})

    return keyed.select("key", "text").mapInArrow(emit, "key long, n long, tokens array<long>")


def least_overlap(n: np.ndarray, m: int) -> np.ndarray:
    return -(-SIMILARITY * (n + m) // (100 + SIMILARITY))


class Trie:
    """Sets in one global order of their shingles; a path that sets share is stored, and matched, once.

    The order is by falling document frequency, told by the sketch, so that like sets stay together long.
    """

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray):
        self.universe, place = np.unique(np.concatenate(sets), return_inverse=True)
        rank = np.empty(len(self.universe), np.int64)
        rank[np.lexsort((self.universe, -sketch[counter_of(self.universe)].astype(np.int64)))] = np.arange(len(self.universe))
        self.rank = rank
        bounds = starts_of(np.array([len(x) for x in sets]))
        self.sets = sorted(((np.sort(rank[place[bounds[i] : bounds[i + 1]]]), i) for i in range(len(sets))), key=lambda x: x[0].astype(">u4").tobytes())
        self.root = self.node(0, len(sets), 0)

    def node(self, low: int, high: int, depth: int) -> tuple:
        """(path, depth at its end, greatest set size below, sets that end here, children)."""
        a, b = self.sets[low][0], self.sets[high - 1][0]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:short] != b[depth:short])
        end = depth + int(differ[0]) if len(differ) else short
        at, ends, children = low, [], []
        while at < high and len(self.sets[at][0]) == end:
            ends.append(self.sets[at][1])
            at += 1
        while at < high:
            until = at + 1
            while until < high and self.sets[until][0][end] == self.sets[at][0][end]:
                until += 1
            children.append(self.node(at, until, end))
            at = until
        return a[depth:end], end, max(len(x[0]) for x in self.sets[low:high]), ends, children

    def similar(self, probes: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(probe, set) of all similar pairs. All probes go down the trie together; at a subtree those
        are left behind whose matches so far and what remains there can't make up the needed overlap."""
        sizes = np.array([len(p) for p in probes])
        has = np.zeros((len(probes), len(self.universe)), bool)
        for i, p in enumerate(probes):
            at = np.minimum(np.searchsorted(self.universe, p), len(self.universe) - 1)
            has[i, self.rank[at[self.universe[at] == p]]] = True
        stack = [(self.root, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            (path, depth, most, ends, children), live, both = stack.pop()
            both = both + has[live[:, None], path].sum(axis=1)
            stay = both + most - depth >= least_overlap(sizes[live], most)
            live, both = live[stay], both[stay]
            if not len(live):
                continue
            if ends:
                for i in live[100 * both >= SIMILARITY * (sizes[live] + depth - both)].tolist():
                    for j in ends:
                        yield i, j
            stack += [(child, live, both) for child in children]


def spanning_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], sketch: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever similar pairs of `left` with `right` (or within `left`, if none) connect."""
    other = right or left
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    trie = Trie([x for _, x in other], sketch)
    step = max(1, CELLS // len(trie.universe))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        for i, j in trie.similar([x for _, x in some]):
            a, b = some[i][0], other[j][0]
            if top(a) != top(b):
                parent[top(a)] = top(b)
                links.append((a, b))
    return links


def same_token_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of rows (token, key, n) of one token whose sizes allow similarity, once for
    each token they share."""
    one, two = rows.select("token", F.col("key").alias("a"), F.col("n").alias("na")), rows.select("token", F.col("key").alias("b"), F.col("n").alias("nb"))
    return one.join(two, "token").filter(f"a < b and 100 * least(na, nb) >= {SIMILARITY} * greatest(na, nb)").select("a", "b", "na", "nb")


def class_links(keyed: DataFrame, rows: DataFrame, sketch: object) -> DataFrame:
    """Links (a, b) that connect similar sets, from their shared prefix tokens `rows` (token, key, n).

    Of a token that few sets share, pairs are listed, and kept where the number of tokens that
    they share in all allows the similarity. Sets of a token that many share aren't paired.
    Each set that is left belongs to a block, of about TRIE_SETS sets that have their most
    shared token in common; two blocks meet once, in tries, if a kept pair or a crowded token
    lies across them. A meeting returns no more links than connect its sets. Meetings are held in
    rounds, each of which moves about as many bytes of texts as all members have, so that disk
    doesn't grow with the number of blocks that a block meets.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(rows.join(rows.groupBy("token").agg(F.count("*").alias("f")), "token"), "counted")
    # A set's first tokens hold all the tokens it shares with another but those past the end of one of the two.
    needed = f"ceil({SIMILARITY} * (na + nb) / {100 + SIMILARITY}) - greatest(ceil({SIMILARITY} * na / 100), ceil({SIMILARITY} * nb / 100)) + 1"
    pairs = stored(same_token_pairs(counted.filter(F.col("f") <= CROWD)).groupBy("a", "b", "na", "nb").count().filter(F.expr(f"count >= {needed}")).select("a", "b"), "pairs")
    crowded = counted.filter(F.col("f") > CROWD)
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(crowded.select("key")).distinct()
    anchors = counted.groupBy("key").agg(F.max(F.struct("f", "token")).alias("most"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("most.f") / TRIE_SETS))
    members = stored(keys.join(anchors, "key").select("key", F.xxhash64("most.token", part).alias("block")), "members")
    a, b = members.select(F.col("key").alias("a"), F.col("block").alias("x")), members.select(F.col("key").alias("b"), F.col("block").alias("y"))
    by_pair = pairs.join(a, "a").join(b, "b").select("x", "y")
    touched = crowded.join(members, "key").select("token", "block").distinct()
    by_token = touched.withColumnRenamed("block", "x").join(touched.withColumnRenamed("block", "y"), "token").filter("x <= y").select("x", "y")
    meetings = stored(by_pair.union(by_token).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "meetings")

    texts = texts_of(keyed, members)
    sizes = texts.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes"))
    guests = meetings.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("block")).groupBy("block").count()
    held, moved = sizes.join(guests, "block", "left").agg(F.sum("bytes"), F.sum(F.col("bytes") * F.col("count"))).first()
    rounds = -(-(moved or 0) // max(held or 0, ROUND_BYTES)) or 1

    def sets_of(side: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
        out, batch = [], pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in side], pa.int64()), "text": pa.array([t for _, t in side], pa.string())})
        for chunk in text_chunks([batch]):
            which, found = shingle_sets(chunk)
            out += zip(chunk.column("key").to_pylist(), np.split(found, np.cumsum(np.bincount(which, minlength=chunk.num_rows))[:-1]), strict=True)
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if sides[0] and (sides[1] or at[0] == at[1]):
                found = spanning_links(*map(sets_of, sides), sketch.value)
                yield pa.RecordBatch.from_pydict({"a": pa.array([i for i, _ in found], pa.int64()), "b": pa.array([j for _, j in found], pa.int64())})
            sides[0].clear()
            sides[1].clear()

        for batch in batches:
            for x, y, side, key, text in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "side", "key", "text")), strict=True):
                if (x, y) != at:
                    yield from flush()
                    at = (x, y)
                sides[side].append((key, text))
        yield from flush()

    links = None
    for i in range(rounds):
        now = meetings.filter(F.pmod(F.xxhash64("x", "y"), F.lit(rounds)) == i)
        left = now.join(texts.withColumnRenamed("block", "x"), "x").select("x", "y", F.lit(0).alias("side"), "key", "text")
        right = now.filter("x <> y").join(texts.withColumnRenamed("block", "y"), "y").select("x", "y", F.lit(1).alias("side"), "key", "text")
        found = stored(left.union(right).repartition(parts, "x", "y").sortWithinPartitions("x", "y", "side").mapInArrow(meet, "a long, b long"), "met")
        links = links.union(found) if links is not None else found
    discard(texts)
    return links


def texts_of(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """(key, block, text) of the members. They grow with the corpus and are never broadcast, but a filter of fixed size
    keeps most texts of others from the shuffle."""
    place = F.xxhash64("key")
    shared = keyed.sparkSession.sparkContext.broadcast(KeyFilter(members.select(place.alias("place"))))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.may_have(batch.column("place").to_numpy()))).select(["key", "text"])

    some = keyed.select("key", "text", place.alias("place")).mapInArrow(may, "key long, text string")
    texts = stored(some.join(members.hint("merge"), "key").select("key", "block", "text"), "texts")
    shared.destroy()  # its copies on the executors' disks go
    return texts


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Sets are distinct SHINGLE-word shingles, as 64-bit hashes; texts with fewer words have
    themselves as the one shingle, and texts without words have an empty set and no links.
    Documents link when SIMILARITY * union <= 100 * intersection. Equal sets are one class
    (size and 128 bits of digest), represented by its least key. Classes meet by their
    prefixes in an order of rising document frequency, told by a sketch of fixed size;
    candidate pairs are verified with whole sets, in tries.

    Null texts are empty, and a long text is a chunk of its own. Null and repeated doc_ids are
    documents of their own; component_id is null where the first reachable document has no id.
    An empty table gives no rows.
    """
    placed, sets = placed_sets(with_unique_ids(docs))
    firsts = sets.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    return placed.join(firsts, "component").select("doc_id", "n_shingles", "component_id")


def placed_sets(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, doc_id, n_shingles and component, its least key, of every document; and the sets."""
    described = describe_sets(keyed)
    sketch = keyed.sparkSession.sparkContext.broadcast(frequency_sketch(described))
    sets = stored(described.filter("slice is null").select("key", "doc_id", "n", "d1", "d2"), "sets")
    discard(described)
    classes = stored(sets.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("key").alias("class")), "classes")
    # One row a document decides which sets stand for others, before their tokens meet.
    first = prefixes(keyed, sketch).join(classes.select(F.col("class").alias("key")), "key", "left_semi")
    token = Window.partitionBy("token").orderBy("key")
    shared = first.select("key", "n", F.explode("tokens").alias("token")).withColumns({"before": F.lag("key").over(token), "after": F.lead("key").over(token)})
    rows = stored(shared.filter("before is not null or after is not null").select("token", "key", "n"), "shared")
    labels = components(class_links(keyed, rows, sketch)).withColumnRenamed("key", "class")
    placed = sets.join(classes, ["n", "d1", "d2"], "left").join(labels, "class", "left").select("key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class", "key").alias("component"))
    return placed, sets


def ngram_filter(docs: DataFrame) -> DataFrame:
    """The first document (least doc_id, nulls first) of each component, with all columns.

    Rows with null and repeated doc_ids are documents of their own, told apart by their keys.
    """
    rows = with_row_keys(docs)
    keyed = id_text(rows.withColumn("doc_id", F.col("_tidelog_row"))).withColumn("key", F.col("doc_id"))
    placed, _ = placed_sets(keyed)
    first = stored(placed.filter("key = component").select(F.col("key").alias("_tidelog_row")), "firsts")
    return rows.join(first, "_tidelog_row", "left_semi").select(docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
g AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * both_have >= 85 * (len(sa.g) + len(sb.g) - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(other) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY ALL
"""
