"""Merkle manifest of a dataset: a digest for each row, a tree for each source, a tree over sources, and proofs.

A leaf is the hash of a row's fields. A source's leaves stand in the order of doc_id; while several nodes remain, every ARITY
neighbours become their hash. What remains of the sources, in their order, is folded likewise to the root.

Rows of digests are dealt by ranges of (source, doc_id, leaf), so each partition is a run of the whole order, and checkpointed, so
that its rows stay what they are. From two counts a partition the driver knows where each run starts and how many leaves its
sources have, so every node's level, index and number of siblings are known wherever it is. A partition folds the sibling runs it holds
whole and leaves a sparse forest: the nodes at its two edges whose run isn't complete, keyed by tree, level and index.
Forests form a monoid (union, then folding of each run that has become complete), merged by treeReduce. A forest keeps what it has
folded, too: with that, each partition computes its rows' proofs by itself.

What reaches the driver and is broadcast grows with partitions, not rows: two nodes for each edge and level, 4 x 21 nodes of about 200
bytes for each of N / PART_ROWS partitions at 1e10 rows, some 100 MB where nearly all are present.

Defined cases: null fields are `-`; null sources and null doc_ids come first; equal doc_ids of one source stand in the order of
their leaves, so repeated rows have equal leaves and places of their own. A lone leaf is its source's subroot, a lone subroot the root. A
row without siblings has the hash of nothing as proof. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from weftgraph.llm.store import drop, durable, shared_dir

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one partition at most, before what the ranges' sampling adds.
PART_ROWS = 1_000_000
TOP = -1  # the tree over sources

Key = tuple[int, int, int]  # tree (a source's place, or TOP), level, index


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """H of the row's fields; columns: what stands for a field instead of itself."""
    parts = []
    for name in FIELDS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def H(nodes: list[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def width(n: int, level: int) -> int:
    """How many nodes a tree of n leaves has at a level."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


@dataclass
class Forest:
    """Nodes whose sibling run isn't complete, nodes that are folded, and how many leaves each tree has. merge() is associative."""

    sizes: dict[int, int]
    open: dict[Key, bytes] = field(default_factory=dict)
    folded: dict[Key, bytes] = field(default_factory=dict)

    def add(self, key: Key, digest: bytes) -> None:
        """Add a node, and fold as long as it completes a run."""
        while True:
            tree, level, index = key
            self.open[key] = digest
            n = width(self.sizes[tree], level)
            if n == 1:
                if tree == TOP:
                    return
                done, key = [key], (TOP, 0, tree)
            else:
                first = index - index % ARITY
                done = [(tree, level, k) for k in range(first, min(first + ARITY, n))]
                if not all(k in self.open for k in done):
                    return
                digest, key = H([self.open[k] for k in done]), (tree, level + 1, index // ARITY)
            for k in done:
                self.folded[k] = self.open.pop(k)

    def merge(self, other: Forest) -> Forest:
        """Both forests as one; folds each run that has become complete."""
        out = Forest(self.sizes | other.sizes, dict(self.open), self.folded | other.folded)
        for key, digest in other.open.items():
            out.add(key, digest)
        return out

    def nodes(self) -> dict[Key, bytes]:
        return self.folded | self.open


@dataclass(frozen=True)
class Run:
    """A partition's neighbouring leaves of one source: the source's place, the first leaf's index, and all the source's leaves."""

    tree: int
    start: int
    total: int


@dataclass(frozen=True)
class Part:
    """Where a partition stands: the run it begins with, the number of leaves its last source has (None: all are here), and sources in all."""

    first: Run
    last_total: int | None
    n_sources: int


def spans(rows: Iterator[tuple[object, bytes]], part: Part) -> Iterator[tuple[Run, list[bytes]]]:
    """The partition's runs, in order, with their leaves."""
    groups = [(source, [row[1] for row in group]) for source, group in groupby(rows, key=lambda row: row[0])]
    for k, (_, leaves) in enumerate(groups):
        if k == 0:
            yield part.first, leaves
        elif k == len(groups) - 1 and part.last_total is not None:
            yield Run(part.first.tree + k, 0, part.last_total), leaves
        else:
            yield Run(part.first.tree + k, 0, len(leaves)), leaves


def levels(run: Run, leaves: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """For each level, the index of the first node that the run's own leaves make, and these nodes."""
    out, n, start, nodes = [(run.start, leaves)], run.total, run.start, leaves
    while n > 1 and nodes:
        stop = start + len(nodes)
        low, high = -(-start // ARITY), -(-stop // ARITY) if stop == n else stop // ARITY
        nodes = [H(nodes[ARITY * k - start : min(ARITY * (k + 1), stop) - start]) for k in range(low, high)]
        start, n = low, -(-n // ARITY)
        out.append((start, nodes))
    return out


def fragment(runs: list[tuple[Run, list[bytes]]], n_sources: int) -> Forest:
    """What a partition can't fold by itself: of its trees, and of its stretch of the tree over sources."""
    forest, subroots = Forest({TOP: n_sources}), []

    def edges(run: Run, leaves: list[bytes]) -> bytes | None:
        found = levels(run, leaves)
        if len(found[-1][1]) == 1 and width(run.total, len(found) - 1) == 1:
            return found[-1][1][0]
        forest.sizes[run.tree] = run.total
        for level, (start, nodes) in enumerate(found):
            above, over = found[level + 1] if level + 1 < len(found) else (0, [])
            for k, digest in enumerate(nodes, start):
                if not above <= k // ARITY < above + len(over):
                    forest.open[run.tree, level, k] = digest
        return None

    for run, leaves in runs:
        root = edges(run, leaves)
        if root is not None:
            subroots.append((run.tree, root))
    if subroots:  # of neighbouring sources, as only the first and the last run of a partition can be cut
        root = edges(Run(TOP, subroots[0][0], n_sources), [digest for _, digest in subroots])
        if root is not None:
            forest.open[TOP, height(n_sources), 0] = root
    return forest


def height(n: int) -> int:
    """The level of a tree's root."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


class Proofs:
    """Siblings of nodes, from a partition's own nodes or the forest's."""

    def __init__(self, part: Part, known: dict[Key, bytes], runs: list[tuple[Run, list[bytes]]]):
        self.known, self.n_sources = known, part.n_sources
        self.own = {run.tree: levels(run, leaves) for run, leaves in runs}
        self.sizes = {run.tree: run.total for run, _ in runs} | {TOP: part.n_sources}
        whole = [(run.tree, self.own[run.tree][-1][1][0]) for run, _ in runs if self.complete(run.tree)]
        self.own[TOP] = levels(Run(TOP, whole[0][0], part.n_sources), [digest for _, digest in whole]) if whole else []
        self.memory: dict[tuple[int, int], tuple[int, list]] = {}

    def complete(self, tree: int) -> bool:
        """Whether the partition has all of a source."""
        return len(self.own[tree][0][1]) == self.sizes[tree]

    def node(self, tree: int, level: int, index: int) -> bytes:
        found = self.own[tree]
        if level < len(found):
            start, nodes = found[level]
            if start <= index < start + len(nodes):
                return nodes[index - start]
        return self.known[tree, level, index]

    def path(self, tree: int, level: int, index: int) -> list[tuple[bytes, bytes]]:
        """The siblings to the left and right of a node and of all above it, up to the root."""
        held = self.memory.get((tree, level))
        if held is not None and held[0] == index:
            return held[1]
        n = width(self.sizes[tree], level)
        if n == 1:
            out = [] if tree == TOP else self.path(TOP, 0, tree)
        else:
            first = index - index % ARITY
            around = [b"" if k == index else self.node(tree, level, k) for k in range(first, min(first + ARITY, n))]
            at = index - first
            out = [(b"".join(around[:at]), b"".join(around[at:])), *self.path(tree, level + 1, index // ARITY)]
        self.memory[tree, level] = index, out
        return out

    def subroot(self, tree: int) -> bytes:
        return self.node(tree, height(self.sizes[tree]), 0)


def folded_root(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


def digests(docs: DataFrame, received: Column) -> DataFrame:
    """doc_id, source, leaf and changed (the leaf of the received text; null where it is the same), in ranges of the whole order."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    changed = F.when(~received.eqNullSafe(text), leaf_digest({"text": received}))
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), leaf_digest().alias("leaf"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = durable(rows, "merkle-leaves")  # the ranges are sampled from this table, not from the texts
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    order = ("source", "doc_id", "leaf", "row")  # the last one spreads repeated rows; which of them stands first makes no difference
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row").checkpoint()
    drop(rows)
    return ranged


def _ends(index: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(partition, first source, its rows, last source, its rows, sources); nothing for a partition without rows."""
    runs, first, last = 0, (), ()
    for source, group in groupby(rows, key=lambda row: row[0]):
        last = source, sum(1 for _ in group)
        first, runs = first or last, runs + 1
    if runs:
        yield index, *first, *last, runs


def places(ends: list[tuple]) -> dict[int, Part]:
    """Where each partition stands, from what _ends() tells of all."""
    totals: dict[object, int] = {}
    for _, first, n_first, last, n_last, n in ends:
        totals[first] = totals.get(first, 0) + n_first
        if n > 1:
            totals[last] = totals.get(last, 0) + n_last
    found, before, tree, start = {}, None, -1, 0
    for k, (index, first, n_first, last, n_last, n) in enumerate(ends):
        if k == 0 or first != before:
            tree, start = tree + 1, 0
        found[index] = Run(tree, start, totals[first]), totals[last] if n > 1 else None
        start = start + n_first if n == 1 else n_last
        tree, before = tree + n - 1, last
    return {index: Part(run, total, tree + 1) for index, (run, total) in found.items()}


def manifest(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row.

    received: the text as it arrived, by default the text itself. folded_root is the root that its leaf and the row's original
    siblings lead to, and verified tells whether that is the root."""
    sc = docs.sparkSession.sparkContext
    rows = digests(docs, F.col("text").cast("string") if received is None else received)
    flat = rows.select("source", "leaf").rdd
    parts = places(sorted(flat.mapPartitionsWithIndex(_ends).collect(), key=lambda end: end[0]))
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(name, StringType()) for name in names), StructField("verified", BooleanType()),
    ])
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    where = sc.broadcast(parts)

    def forest_of(index: int, own: Iterator[tuple]) -> Iterator[Forest]:
        if (part := where.value.get(index)) is not None:
            yield fragment(list(spans(((source, leaf.encode()) for source, leaf in own), part)), part.n_sources)

    forest = flat.mapPartitionsWithIndex(forest_of).treeReduce(Forest.merge)
    known = sc.broadcast(forest.folded | forest.open)
    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(partial(_prove, where, known), schema)


def _prove(where: Broadcast, known: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    part = where.value[table.column("part")[0].as_py()]
    leaves = [x.encode() for x in table.column("leaf").to_pylist()]
    runs = list(spans(zip(table.column("source").to_pylist(), leaves, strict=True), part))
    proofs, at = Proofs(part, known.value, runs), 0
    root = proofs.node(TOP, height(part.n_sources), 0)
    for run, own in runs:
        subroot = proofs.subroot(run.tree)
        for begin in range(0, len(own), 2_000):
            some = own[begin : begin + 2_000]
            rows = table.slice(at, n := len(some))
            paths = [proofs.path(run.tree, 0, run.start + begin + k) for k in range(n)]
            proof = [sha256(b"".join(x for pair in path for x in pair)).hexdigest() for path in paths]
            given = [x.encode() if x else leaf for x, leaf in zip(rows.column("changed").to_pylist(), some, strict=True)]
            back = [folded_root(leaf, path) for leaf, path in zip(given, paths, strict=True)]
            same = [pa.array([x.decode()] * n) for x in (subroot, root)]
            columns = [*(rows.column(c).combine_chunks() for c in ("doc_id", "leaf")), *same, pa.array(proof), pa.array([x.decode() for x in back]), pa.array([x == root for x in back])]
            yield pa.record_batch(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
            at += n


#: Levels are folded one by one; steps tells each node's siblings and parent. crc32 is folded over the bytes of the decimal doc_id.
ORACLE = """
WITH RECURSIVE d AS (
    SELECT *, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                          lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
    FROM documents
), l AS (
    SELECT doc_id, source, list_transform([text, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END], lambda t:
        sha256(list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, t],
               lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), 'string_agg', ''))) AS h
    FROM d
), leaves AS (
    SELECT doc_id, h[1] AS leaf, h[2] AS given, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id, h[1]) - 1 AS idx FROM l
), own AS (
    SELECT tree, 0 AS level, idx, leaf AS h FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM own) WHERE w > 1 GROUP BY tree, level, idx // 3
), subroots AS (
    SELECT tree, max(level) AS level, arg_max(h, level) AS h FROM own GROUP BY tree
), top AS (
    SELECT 0 AS level, tree AS idx, h FROM subroots
    UNION ALL
    SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER () AS w FROM top) WHERE w > 1 GROUP BY level, idx // 3
), nodes AS (
    SELECT tree, level, idx, h FROM own UNION ALL SELECT -1, level, idx, h FROM top
), steps AS (
    SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
    GROUP BY a.tree, a.level, a.idx
), walk AS (
    SELECT doc_id, leaf, tree AS source_tree, tree, 0 AS level, idx, given AS h, '' AS proof FROM leaves
    UNION ALL
    SELECT doc_id, leaf, source_tree, CASE WHEN w.level = s.level THEN -1 ELSE w.tree END, CASE WHEN w.level = s.level THEN 0 ELSE w.level + 1 END,
           CASE WHEN w.level = s.level THEN w.tree ELSE w.idx // 3 END,
           CASE WHEN w.level = s.level THEN w.h ELSE sha256(l || w.h || r) END, CASE WHEN w.level = s.level THEN proof ELSE proof || l || r END
    FROM walk w JOIN steps USING (tree, level, idx)
    JOIN (SELECT tree, level FROM subroots UNION ALL SELECT -1, max(level) FROM top) s ON s.tree = w.tree
    WHERE NOT (w.tree = -1 AND w.level = s.level)
)
SELECT w.doc_id, w.leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM walk w JOIN subroots s ON s.tree = w.source_tree JOIN (SELECT max(level) AS level, arg_max(h, level) AS h FROM top) t ON w.level = t.level
WHERE w.tree = -1
"""
