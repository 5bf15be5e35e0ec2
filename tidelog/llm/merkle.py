"""Merkle manifest of a corpus: a tree of hashes per source, a tree over the sources, and proofs of single rows (operator 12).

Forests of unresolved nodes are merged as an associative monoid. A forest maps (group, level,
index) to a digest; the number of a group's leaves is known, so the size of every sibling run
is too. Merging two forests joins their nodes and replaces each run that has become whole by
its parent, over and over. Any cut of the leaves into partitions, merged in any grouping, ends in
the same roots. What a merge gives up is kept in a table of nodes, from which proofs are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import positions
from .common import small_batches, stored

ARITY = 3
#: Leaves of a group that are proved together: the most rows that a task holds.
BLOCK = 4096
#: Fragments that a merge takes in, as a treeReduce of that fan-in.
FAN = 16

#: A node that some forest has held: the fragment, its group with its number of leaves, place and digest; open if the
#: fragment's forest still holds it, root if it is the group's last.
NODES = "frag long, grp string, n long, level int, idx long, digest binary, open boolean, root boolean"
Node = tuple[str, int, int, int]


def join_digests(members: Iterable[bytes]) -> bytes:
    """H of digests as hex text, as hex text."""
    return hashlib.sha256(b"".join(members)).hexdigest().encode()


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree over n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


class Forest:
    """Unresolved nodes of any number of groups; add() merges one more in."""

    def __init__(self) -> None:
        self.nodes: dict[Node, bytes] = {}
        self.made: list[tuple[Node, bytes, bool]] = []

    def add(self, grp: str, n: int, level: int, idx: int, digest: bytes) -> None:
        """`made` gets the node and every parent that it completes. A group's root does not stay in the forest."""
        while True:
            across = width(n, level)
            self.made.append(((grp, n, level, idx), digest, across == 1))
            if across == 1:
                return
            first = idx - idx % ARITY
            members = [(grp, n, level, i) for i in range(first, min(first + ARITY, across))]
            self.nodes[grp, n, level, idx] = digest
            if not all(m in self.nodes for m in members):
                return
            digest = join_digests([self.nodes.pop(m) for m in members])
            level, idx = level + 1, idx // ARITY


def climb(lo: int, digests: list[bytes], n: int) -> Iterator[tuple[int, int, bytes]]:
    """What stays unresolved of consecutive leaves from `lo`: (level, index, digest)."""
    level, across = 0, n
    while digests:
        hi = lo + len(digests)
        first, end = -(-lo // ARITY), -(-hi // ARITY) if hi == across else hi // ARITY
        if across == 1 or first >= end:
            yield from ((level, lo + i, d) for i, d in enumerate(digests))
            return
        yield from ((level, i, digests[i - lo]) for i in range(lo, ARITY * first))
        yield from ((level, i, digests[i - lo]) for i in range(ARITY * end, hi))
        digests = [join_digests(digests[ARITY * r - lo : ARITY * r + ARITY - lo]) for r in range(first, end)]
        lo, level, across = first, level + 1, -(-across // ARITY)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before in any of the columns, and the end."""
    n = len(columns[0])
    changed = np.zeros(n + 1, bool)
    changed[[0, n]] = True
    for c in columns:
        changed[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def node_batch(frag: list[int], nodes: list[tuple[Node, bytes, bool]], is_open: bool) -> pa.RecordBatch:
    keys = [k for k, _, _ in nodes]
    column = lambda i, kind: pa.array([k[i] for k in keys], kind)
    return pa.RecordBatch.from_pydict({
        "frag": pa.array(frag, pa.int64()), "grp": column(0, pa.string()), "n": column(1, pa.int64()), "level": column(2, pa.int32()), "idx": column(3, pa.int64()),
        "digest": pa.array([bytes.fromhex(d.decode()) for _, d, _ in nodes], pa.binary()), "open": pa.array([is_open] * len(nodes), pa.bool_()), "root": pa.array([r for _, _, r in nodes], pa.bool_()),
    })


def fragments(leaves: DataFrame, block: int) -> DataFrame:
    """NODES of the forests of each range of leaves (frag, grp, n, idx, digest); a block's own nodes are resolved at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: dict[int, Forest] = {}
        for batch in batches:
            grp = batch.column("grp").dictionary_encode()
            names, codes = grp.dictionary.to_pylist(), grp.indices.to_numpy()
            frag, n, idx = (batch.column(c).to_numpy() for c in ("frag", "n", "idx"))
            digests = [d.hex().encode() for d in batch.column("digest").to_pylist()]
            cuts = runs(frag, codes, idx // block, idx - np.arange(len(idx))).tolist()  # consecutive leaves of a block
            for a, b in zip(cuts, cuts[1:], strict=False):
                forest = forests.setdefault(int(frag[a]), Forest())
                for level, i, digest in climb(int(idx[a]), digests[a:b], int(n[a])):
                    forest.add(names[codes[a]], int(n[a]), level, i, digest)
            for f, forest in forests.items():
                if forest.made:
                    yield node_batch([f] * len(forest.made), forest.made, False)
                    forest.made = []
        for f, forest in forests.items():
            yield node_batch([f] * len(forest.nodes), [(k, d, False) for k, d in forest.nodes.items()], True)

    return leaves.select("frag", "grp", "n", "idx", "digest").mapInArrow(run, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """NODES after the open nodes of FAN neighbouring fragments have met, for each such set."""

    def meet(table: pa.Table) -> pa.Table:
        forest = Forest()
        for row in table.select(["grp", "n", "level", "idx", "digest"]).to_pylist():
            forest.add(row["grp"], row["n"], row["level"], row["idx"], row["digest"].hex().encode())
        frag = table.column("frag")[0].as_py() if table.num_rows else 0
        given = {(r["grp"], r["n"], r["level"], r["idx"]) for r in table.select(["grp", "n", "level", "idx"]).to_pylist()}
        new = [m for m in forest.made if m[0] not in given]
        left = [(k, d, False) for k, d in forest.nodes.items()]
        return pa.Table.from_batches([node_batch([frag] * len(new), new, False), node_batch([frag] * len(left), left, True)])

    return nodes.filter("open").withColumn("frag", F.floor(F.col("frag") / FAN).cast("long")).groupBy("frag").applyInArrow(meet, NODES)


def all_nodes(leaves: DataFrame, fragment_count: int, block: int = BLOCK) -> DataFrame:
    """Every node that some forest has held, roots included: a treeReduce over fragments, whose rounds are stored tables.

    A fragment of neighbouring leaves has at most two unresolved nodes a level for each end, so
    a merge holds a few thousand rows at any size of the corpus.
    """
    rounds = [stored(fragments(leaves, block), "forest")]
    while True:
        rounds.append(stored(merged(rounds[-1]), "forest"))
        fragment_count = -(-fragment_count // FAN)
        if fragment_count <= 1:
            break
    found = rounds[0]
    for r in rounds[1:]:
        found = found.union(r)
    return found.filter("NOT open").drop("frag", "open")


def value(c: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(text: Column) -> Column:
    """Digest of a row of documents with that text, as 32 bytes."""
    row = F.concat(value(F.col("doc_id").cast("long")), value(F.col("source")), value(F.col("lang")), value(F.col("n_chars").cast("long")), value(text))
    return F.unhex(F.sha2(row.cast("binary"), 256))


def placed(leaves: DataFrame) -> DataFrame:
    """`leaves` with frag, idx and n: the range of the order (grp, doc_id, digest) that holds the row, its place in its group from 0, and the
    group's number of leaves. What is broadcast has at most two rows for a range: for groups that reach beyond it."""
    order = ["grp", "doc_id", "digest", "tie"]
    ties = leaves.withColumn("tie", F.monotonically_increasing_id())
    dealt = ties.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("tie")
    ranges = stored(dealt, "leaves").withColumn("frag", F.floor(F.col("at") / (1 << 33)).cast("long"))
    per = ranges.groupBy("grp", "frag").agg(F.count("*").alias("here"))
    whole = Window.partitionBy("grp")
    spread = per.withColumns({"before": F.sum("here").over(whole.orderBy("frag")) - F.col("here"), "total": F.sum("here").over(whole)}).filter("total > here").select("grp", "frag", "before", "total")
    part = Window.partitionBy("frag", "grp")
    within = ranges.withColumns({"place": F.row_number().over(part.orderBy("at")) - 1, "here": F.count("*").over(part)})
    joined = within.join(F.broadcast(spread), ["grp", "frag"], "left")
    return joined.select("frag", "grp", "doc_id", "digest", "altered", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("idx"), F.coalesce("total", "here").cast("long").alias("n"))


@dataclass
class Manifest:
    """Leaves in order, the nodes met on the way, subroots with rank and number of sources (grp, rank, sources, subroot), and the nodes of the tree over them."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    upper: DataFrame

    def root(self) -> str | None:
        """The manifest's root; None over no rows."""
        row = self.upper.filter("root").first()
        return row["digest"].hex() if row else None


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The trees of `docs`. `tampered` is the text that a row has been changed to, where it is to be proved against the original."""
    small_batches(docs.sparkSession)
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # bytewise order, null first
    text = F.col("text").cast("string")
    changed = F.lit(None).cast("binary") if tampered is None else F.when(~tampered.eqNullSafe(text), leaf_digest(tampered))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), grp.alias("grp"), leaf_digest(text).alias("digest"), changed.alias("altered")), "rows")
    leaves = stored(placed(rows), "placed")
    last = leaves.agg(F.max("frag")).first()[0]
    nodes = all_nodes(leaves, (last or 0) + 1)
    roots = nodes.filter("root").select("grp", F.col("digest").alias("subroot"))
    sources = roots.count()
    ranked = positions(roots, ["grp"]).select("grp", (F.col("position") - 1).cast("long").alias("rank"), F.lit(sources).cast("long").alias("sources"), "subroot")
    subroots = stored(ranked, "subroots")
    over = subroots.select(F.floor(F.col("rank") / BLOCK).cast("long").alias("frag"), F.lit("").alias("grp"), F.col("sources").alias("n"), F.col("rank").alias("idx"), F.col("subroot").alias("digest"))
    return Manifest(leaves, nodes, subroots, all_nodes(over, -(-sources // BLOCK), 1))


def siblings(spans: DataFrame) -> DataFrame:
    """(grp, block, level, idx) of the nodes beyond leaves [lo, hi) of a tree over n that the proofs of these leaves need: at most four a level."""

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for r in batch.to_pylist():
                lo, hi, across, level = r["lo"], r["hi"], r["n"], 0
                while across > 1:
                    first, end = lo // ARITY, -(-hi // ARITY)
                    out += [(r["grp"], r["block"], level, i) for i in (*range(ARITY * first, lo), *range(hi, min(ARITY * end, across)))]
                    lo, hi, across, level = first, end, -(-across // ARITY), level + 1
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = {"grp": pa.string(), "block": pa.int64(), "level": pa.int32(), "idx": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns, strict=True)})

    return spans.select("grp", "block", "n", "lo", "hi").mapInArrow(needed, "grp string, block long, level int, idx long")


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source_rank long, position long"
#: Rows of a block, in the order in which a task needs them.
HEAD, BESIDE, ABOVE, LEAF = range(4)


def proofs(m: Manifest) -> DataFrame:
    """A row per leaf (PROOFS): the hash of its siblings from the leaf to the root, and the root that its altered (else original) digest
    and these siblings fold to. Blocks of leaves meet the few nodes beyond them that they need; nothing else of the tree is moved."""
    of_block = F.floor(F.col("idx") / BLOCK).cast("long").alias("block")
    spans = stored(m.leaves.groupBy("grp", of_block).agg(F.max("n").alias("n"), F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi")), "blocks")
    no_id, no_change = F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered")
    row = lambda df, kind, n: df.select("grp", "block", F.lit(kind).alias("kind"), "level", "idx", n.alias("n"), "digest", no_id, no_change)
    beside = siblings(spans).join(m.nodes.select("grp", "level", "idx", "digest"), ["grp", "level", "idx"])
    single = m.subroots.select("grp", F.lit(0).cast("long").alias("block"), F.col("sources").alias("n"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"))
    above = siblings(single).join(m.upper.select("level", "idx", "digest"), ["level", "idx"]).drop("block").join(spans.select("grp", "block"), "grp")
    heads = spans.select("grp", "block").join(m.subroots, "grp").select("grp", "block", F.lit(0).alias("level"), F.col("rank").alias("idx"), F.col("subroot").alias("digest"), "sources")
    leaves = m.leaves.select("grp", of_block, F.lit(LEAF).alias("kind"), F.lit(0).alias("level"), "idx", "n", "digest", "doc_id", "altered")
    rows = row(heads, HEAD, F.col("sources")).union(row(beside, BESIDE, F.lit(0).cast("long"))).union(row(above, ABOVE, F.lit(0).cast("long"))).union(leaves)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grp = batch.column("grp").dictionary_encode().indices.to_numpy()
            cuts = runs(grp, batch.column("block").to_numpy()).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0].as_py() != piece.column(c)[0].as_py() for c in ("grp", "block")):
                    yield from prove_block(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield from prove_block(pa.Table.from_batches(held))

    dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "level", "idx")
    return dealt.mapInArrow(prove, PROOFS)


def prove_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """PROOFS of the leaves of one block, from its head, the nodes beside it and above it, and its leaves."""
    kind = table.column("kind").to_numpy()
    level, idx = table.column("level").to_numpy(), table.column("idx").to_numpy()
    digests = [d.hex().encode() for d in table.column("digest").to_pylist()]
    rank, sources = int(idx[0]), table.column("n")[0].as_py()
    start = int(np.searchsorted(kind, LEAF))
    known = {(int(kind[i]), int(level[i]), int(idx[i])): digests[i] for i in range(1, start)}
    n = table.column("n")[start].as_py()
    lo, own = int(idx[start]), digests[start:]
    leaf_lo = lo
    around: list[tuple[int, list[tuple[bytes, bytes]]]] = []  # of each level: the first own node, and what is left and right of each in its run

    def level_up(which: int, lo: int, own: list[bytes], across: int, at: int) -> tuple[int, list[bytes]]:
        hi = lo + len(own)
        first, end = lo // ARITY, -(-hi // ARITY)
        before = [known[which, at, i] for i in range(ARITY * first, lo)]
        after = [known[which, at, i] for i in range(hi, min(ARITY * end, across))]
        whole, skip = before + own + after, len(before)
        sides = []
        for i in range(skip, skip + len(own)):
            a = i - i % ARITY
            sides.append((b"".join(whole[a:i]), b"".join(whole[i + 1 : a + ARITY])))
        around.append((lo, sides))
        return first, [join_digests(whole[i : i + ARITY]) for i in range(0, len(whole), ARITY)]

    at, across = 0, n
    while across > 1:
        lo, own = level_up(BESIDE, lo, own, across, at)
        at, across = at + 1, -(-across // ARITY)
    below, subroot = len(around), own[0]
    at, across, lo = 0, sources, rank
    while across > 1:
        lo, own = level_up(ABOVE, lo, own, across, at)
        at, across = at + 1, -(-across // ARITY)
    root = own[0]
    shared = [sides[0] for _, sides in around[below:]]
    altered = table.column("altered").to_pylist()
    proved, folded = [], []
    for i, digest in enumerate(digests[start:]):
        changed, proof, place = altered[start + i], hashlib.sha256(), leaf_lo + i
        now = digest if changed is None else changed.hex().encode()
        for first, sides in around[:below]:
            left, right = sides[place - first]
            proof.update(left + right)
            now = hashlib.sha256(left + now + right).hexdigest().encode()
            place //= ARITY
        for left, right in shared:
            proof.update(left + right)
            now = hashlib.sha256(left + now + right).hexdigest().encode()
        proved.append(proof.hexdigest())
        folded.append(now.decode())
    count = len(proved)
    yield pa.RecordBatch.from_pydict({
        "doc_id": table.column("doc_id").slice(start).combine_chunks(), "leaf": pa.array([d.decode() for d in digests[start:]]), "subroot": pa.array([subroot.decode()] * count),
        "root": pa.array([root.decode()] * count), "proof_sha256": pa.array(proved), "folded_root": pa.array(folded), "verified": pa.array([f == root.decode() for f in folded], pa.bool_()),
        "source_rank": pa.array([rank] * count, pa.int64()), "position": pa.array(idx[start:], pa.int64()),
    })


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per document (PROOFS): its leaf, its source's subroot, the root, the hash of its proof, and what its text without
    newlines (where 2 divides the crc32 of doc_id) folds to.

    A null in any column is hashed as `-`, apart from an empty value, `0:`. Null sources form a source of their own,
    before all others. A null doc_id comes first in its source and is never tampered with; rows that repeat a
    doc_id are ordered by digest, equal rows are leaves of their own. Texts are hashed whole. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.col("text").cast("string")
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return proofs(manifest(docs, F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)))


#: The bits of a byte through the register of a crc32, and the unsigned crc32 of a decimal number, in SQL.
_BYTE_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {_BYTE_STEP}))"
_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

ORACLE_SQL = f"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS altered
  FROM documents),
low(source, level, idx, across, h) AS (
  SELECT source, 0, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, count(*) OVER (PARTITION BY source), leaf FROM d
  UNION ALL
  SELECT source, any_value(level) + 1, idx // 3, any_value((across + 2) // 3), sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE across > 1 GROUP BY source, idx // 3),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS sources, level AS height FROM low WHERE across = 1),
high(level, idx, across, h) AS (
  SELECT 0, rank, sources, subroot FROM subs
  UNION ALL
  SELECT any_value(level) + 1, idx // 3, any_value((across + 2) // 3), sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE across > 1 GROUP BY idx // 3),
path(doc_id, source, leaf, level, idx, folded, proof) AS (
  SELECT doc_id, source, leaf, 0, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, altered, '' FROM d
  UNION ALL
  SELECT p.doc_id, any_value(p.source), any_value(p.leaf), any_value(p.level) + 1, any_value(p.idx) // 3,
         sha256(string_agg(CASE WHEN n.idx = p.idx THEN p.folded ELSE n.h END, '' ORDER BY n.idx)),
         any_value(p.proof) || coalesce(string_agg(CASE WHEN n.idx = p.idx THEN NULL ELSE n.h END, '' ORDER BY n.idx), '')
  FROM path p JOIN low n ON n.source IS NOT DISTINCT FROM p.source AND n.level = p.level AND n.idx // 3 = p.idx // 3 AND n.across > 1 GROUP BY p.doc_id),
top(doc_id, leaf, subroot, level, idx, folded, proof) AS (
  SELECT p.doc_id, p.leaf, s.subroot, 0, s.rank, p.folded, p.proof FROM path p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source AND s.height = p.level
  UNION ALL
  SELECT p.doc_id, any_value(p.leaf), any_value(p.subroot), any_value(p.level) + 1, any_value(p.idx) // 3,
         sha256(string_agg(CASE WHEN n.idx = p.idx THEN p.folded ELSE n.h END, '' ORDER BY n.idx)),
         any_value(p.proof) || coalesce(string_agg(CASE WHEN n.idx = p.idx THEN NULL ELSE n.h END, '' ORDER BY n.idx), '')
  FROM top p JOIN high n ON n.level = p.level AND n.idx // 3 = p.idx // 3 AND n.across > 1 GROUP BY p.doc_id),
place AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, source FROM d)
SELECT t.doc_id, t.leaf, t.subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root, t.folded = r.h AS verified, s.rank AS source_rank, l.position
FROM top t JOIN high r ON r.across = 1 AND t.level = r.level JOIN place l ON l.doc_id = t.doc_id JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
"""
