"""Vector code compression: product quantisation whose codebooks are trained by dual-tree Lloyd rounds.

Components become integers, vectors are cut into equal parts, and each part's
position has a codebook of its own. The vectors are written once in blocks; for
each position a block holds a tree over its parts: nodes split at the median of
their widest component, each with its box (least and greatest of each
component) and the cached sum of its parts. A round builds a tree over each
codebook's entries and walks both trees level by level. A pair of nodes has a
least and a greatest squared distance between its boxes; a pair is pruned where
its least is above the smallest greatest of the same node of parts. A node of
parts with one entry left is assigned whole, by its cached sum and count. Parts
of a leaf with several entries left are compared with these one by one. All
distances are integers, so bounds are exact and equal distances stay to the end,
where the lower index wins.

A task adds up its blocks and emits one row for each entry it used; these are
summed by key. Only codebooks, whose size is given by the parameters, reach the
driver; they go out with the next round's tasks.

Defined results: a row goes if its vector is null, holds null, NaN or infinite
components, or a component so large that a squared distance would not fit in a
long; so does one whose length is not that of the first vector (least vec_id)
of a length that the parts divide. Null ids come last when the codebooks are
begun; rows of equal id are ordered by their components. Fewer rows than entries
give smaller codebooks; an entry without parts stays; an empty table gives an
empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph.llm import common as C
from supplygraph.session import Scratch

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Vectors of a block, and components of one at most.
BLOCK, BLOCK_VALUES = 4_096, 1 << 19
#: Parts of a leaf.
LEAF = 32
#: Components of a row of partial sums.
CHUNK = 16
#: Rows of sums by label up to which they are broadcast; more are joined by a salted shuffle.
BROADCAST_LABELS = 100_000
SALT = 16


def largest(dimension: int) -> int:
    """The greatest component whose vectors' squared distances fit in a long."""
    return int((2**61 / max(dimension, 1)) ** 0.5)


class Tree:
    """A balanced tree over integer points: ``order`` puts them so that every node is a stretch.

    Level ``l`` has ``2**l`` nodes, bounded by ``bounds[l]``; ``low``, ``high`` and ``sums`` are given by level.
    """

    def __init__(self, points: np.ndarray, leaf: int, levels: int | None = None):
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if levels is None else levels
        order, bounds = np.arange(n), [np.array([0, n])]
        for _ in range(depth):
            at = bounds[-1]
            middle = (at[:-1] + at[1:]) // 2
            for a, m, b in zip(at[:-1].tolist(), middle.tolist(), at[1:].tolist(), strict=True):
                own = points[order[a:b]]
                if b - a > 1:
                    widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                    order[a:b] = order[a:b][np.argpartition(own[:, widest], m - a)]
            bounds.append(np.sort(np.concatenate((at, middle))))
        self.order, self.bounds = order, bounds
        self.points = points[order]
        self.low, self.high, self.sums = [], [], []
        for at in bounds:
            self._level(at)

    def _level(self, at: np.ndarray) -> None:
        width = self.points.shape[1]
        low, high, sums = (np.zeros((len(at) - 1, width), np.int64) for _ in range(3))
        filled = np.flatnonzero(at[1:] > at[:-1])
        if len(filled):
            starts = at[filled]
            low[filled], high[filled] = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)
            sums[filled] = np.add.reduceat(self.points, starts)
        self.low.append(low)
        self.high.append(high)
        self.sums.append(sums)


def pack_tree(tree: Tree) -> bytes:
    """The tree as bytes: order, points, then low, high and sums of all levels."""
    parts = [tree.order.astype("<i4"), tree.points.astype("<i4")]
    for levels, kind in ((tree.low, "<i4"), (tree.high, "<i4"), (tree.sums, "<i8")):
        parts.append(np.concatenate(levels).astype(kind))
    return b"".join(p.tobytes() for p in parts)


def unpack_tree(raw: bytes, n: int, width: int, leaf: int) -> Tree:
    tree, at = Tree.__new__(Tree), 0
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    tree.bounds = [np.array([0, n])]
    for _ in range(depth):
        last = tree.bounds[-1]
        tree.bounds.append(np.sort(np.concatenate((last, (last[:-1] + last[1:]) // 2))))

    def take(rows: int, kind: str, columns: int = width) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, rows * columns, at)
        at += out.nbytes
        return out.reshape(rows, columns).astype(np.int64)

    tree.order, tree.points = take(n, "<i4", 1).reshape(-1), take(n, "<i4")
    nodes = [len(b) - 1 for b in tree.bounds]
    cut = np.cumsum(nodes)[:-1]
    tree.low, tree.high, tree.sums = (np.split(take(sum(nodes), kind), cut) for kind in ("<i4", "<i4", "<i8"))
    return tree


def box_distances(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between points of boxes."""
    apart = np.maximum(0, np.maximum(low2 - high, low - high2))
    reach = np.maximum(high2 - low, high - low2)
    return (apart * apart).sum(axis=1), (reach * reach).sum(axis=1)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances, as integers; by a product of floats where those are exact."""
    most = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most * most < 2**53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


class Codebook:
    """The entries of one position and a tree whose leaves are single entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        depth = int(np.ceil(np.log2(max(len(entries), 1))))
        self.tree = Tree(entries, 1, depth)


def walk(parts: Tree, book: Codebook) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``level, node, entry, candidates``: nodes assigned whole to ``entry``, or leaves with several ``candidates`` (entry -1)."""
    entries, last, deepest = book.tree, len(parts.bounds) - 1, len(book.tree.bounds) - 1
    node, other, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(node):
        low, high = parts.low[level][node], parts.high[level][node]
        least, most = box_distances(low, high, entries.low[depth][other], entries.high[depth][other])
        # pairs come in order of their node of parts
        first = np.flatnonzero(np.diff(node, prepend=-1))
        bound = np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(node))))
        keep = least <= bound
        node, other = node[keep], other[keep]
        if depth == deepest:
            first = np.flatnonzero(np.diff(node, prepend=-1))
            size = np.diff(np.append(first, len(node)))
            single = size == 1
            for n, e in zip(node[first[single]].tolist(), other[first[single]].tolist(), strict=True):
                yield level, n, int(entries.order[entries.bounds[-1][e]]), other[:0]
            open_ = np.repeat(~single, size)
            node, other = node[open_], other[open_]
            if level == last and len(node):
                first = np.flatnonzero(np.diff(node, prepend=-1))
                for n, own in zip(node[first].tolist(), np.split(other, first[1:]), strict=True):
                    yield level, n, -1, np.sort(entries.order[entries.bounds[-1][own]])
            if level == last:
                return
        # both trees go one level down, as far as they reach
        more = np.array([0, 1])
        if level < last and depth < deepest:
            node = np.repeat((2 * node[:, None] + more).reshape(-1), 2)
            other = np.tile(np.stack((2 * other, 2 * other + 1), axis=1), (1, 2)).reshape(-1)
        elif level < last:
            node, other = (2 * node[:, None] + more).reshape(-1), np.repeat(other, 2)
        else:
            node, other = np.repeat(node, 2), (2 * other[:, None] + more).reshape(-1)
        level, depth = min(level + 1, last), min(depth + 1, deepest)
        # nodes without points lie nowhere
        real = (parts.bounds[level][node + 1] > parts.bounds[level][node]) & (entries.bounds[depth][other + 1] > entries.bounds[depth][other])
        node, other = node[real], other[real]
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]


def add_up(parts: Tree, book: Codebook, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds each part to the sum of its entry, whole nodes by their cached sums."""
    for level, node, entry, candidates in walk(parts, book):
        a, b = int(parts.bounds[level][node]), int(parts.bounds[level][node + 1])
        if entry >= 0:
            sums[entry] += parts.sums[level][node]
            counts[entry] += b - a
        else:
            points = parts.points[a:b]
            chosen = candidates[np.argmin(squared(points, book.entries[candidates]), axis=1)]
            np.add.at(sums, chosen, points)
            np.add.at(counts, chosen, 1)


def assign(parts: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part and its squared distance, in the parts' first order."""
    entry, error = np.zeros(len(parts.points), np.int64), np.zeros(len(parts.points), np.int64)
    for level, node, whole, candidates in walk(parts, book):
        a, b = int(parts.bounds[level][node]), int(parts.bounds[level][node + 1])
        own = np.array([whole]) if whole >= 0 else candidates
        far = squared(parts.points[a:b], book.entries[own])
        nearest = np.argmin(far, axis=1)
        at = parts.order[a:b]
        entry[at], error[at] = own[nearest], far[np.arange(b - a), nearest]
    return entry, error


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    most = max(LEAF, min(BLOCK, BLOCK_VALUES // (width * parts)))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            own = batch.slice(at, min(most, batch.num_rows - at))
            lists = own.column("ints")
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, parts, width)
            trees = [pack_tree(Tree(np.ascontiguousarray(values[:, p]), LEAF)) for p in range(parts)]
            whole = pa.array([0, own.num_rows], pa.int32())
            as_list = lambda name: pa.ListArray.from_arrays(whole, own.column(name))  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({
                "vec_ids": as_list("vec_id"), "labels": as_list("label"), "n": pa.array([own.num_rows], pa.int32()), "trees": pa.array([trees], pa.list_(pa.binary())),
            })


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[Tree]]]:
    for k, n in enumerate(batch.column("n").to_pylist()):
        yield k, [unpack_tree(raw.as_py(), n, width, LEAF) for raw in batch.column("trees")[k].values]


def _round(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    width, own = books[0].shape[1], [Codebook(b) for b in books]
    sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        for _, trees in _trees(batch, width):
            for p, tree in enumerate(trees):
                add_up(tree, own[p], sums[p], counts[p])
    for p in range(len(books)):
        used = np.flatnonzero(counts[p])
        for chunk in range(0, width, CHUNK):
            columns = {f"s{k}": pa.array(sums[p][used, chunk + k] if chunk + k < width else np.zeros(len(used), np.int64), pa.int64()) for k in range(CHUNK)}
            yield pa.RecordBatch.from_pydict({
                "p": pa.array(np.full(len(used), p), pa.int32()), "entry": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), chunk), pa.int32()),
                "n": pa.array(counts[p][used], pa.int64()), **columns,
            })


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    width, own = books[0].shape[1], [Codebook(b) for b in books]
    for batch in batches:
        for k, trees in _trees(batch, width):
            found = [assign(tree, own[p]) for p, tree in enumerate(trees)]
            entries = np.stack([e for e, _ in found], axis=1)
            digits = max(2, len(f"{max(len(b) for b in books) - 1:x}"))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_ids")[k].values, "label": batch.column("labels")[k].values,
                "code": ["".join(f"{e:0{digits}x}" for e in row) for row in entries.tolist()], "error": pa.array(sum(e for _, e in found), pa.int64()),
            })


def kept(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """``vec_id, label, ints`` of the rows that take part, and their length (0: none does)."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = given.where("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    first = fine.where(f"size(v) % {parts} = 0").select("vec_id", F.size("v").alias("d")).orderBy(F.col("vec_id").asc_nulls_last(), "d").first()
    d = first.d if first else 0
    # compared as doubles: a float far beyond a long would be cut to the greatest long
    same = fine.where(f"size(v) = {d} and forall(v, x -> abs(x * {SCALE}D) <= {largest(d)}D)")
    return same.select("vec_id", "label", F.expr(f"transform(v, x -> cast(floor(x * {SCALE}D) as long)) AS ints")), d


def by_label(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of the label, null being one."""
    sums, n = scratch.save_counted(coded.groupBy("label").agg(F.sum("error").cast("long").alias("label_error")), "labels")
    sums = sums.withColumnRenamed("label", "of")
    if n <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)))
    spread = sums.withColumn("salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return dealt.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt2"))).drop("of", "salt", "salt2")


class Quantiser:
    """Codebooks trained on all vectors of a table, and their codes."""

    def __init__(self, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
        self.scratch = Scratch(vectors.sparkSession, "vectors")
        rows, d = kept(vectors, parts)
        self.width, self.books = d // parts, []
        if not d:
            self.blocks = None
            return
        begun = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
        if not begun:
            self.blocks = None
            return
        first = np.array([r.ints for r in begun], np.int64).reshape(-1, parts, self.width)
        self.books = [np.ascontiguousarray(first[:, p]) for p in range(parts)]
        width, label = self.width, rows.schema["label"].dataType.simpleString()
        self.label_type = label
        ddl = f"vec_ids array<long>, labels array<{label}>, n int, trees array<binary>"
        self.blocks = self.scratch.save(rows.mapInArrow(lambda batches: _blocks(batches, width, parts), ddl), "blocks")
        for _ in range(rounds):
            self.books = self._moved()

    def _moved(self) -> list[np.ndarray]:
        books = self.books
        ddl = "p int, entry int, chunk int, n long, " + ", ".join(f"s{k} long" for k in range(CHUNK))
        partial = self.blocks.mapInArrow(lambda batches: _round(batches, books), ddl)
        # exactly parts x entries x (components of a part / CHUNK) rows at most
        total = partial.groupBy("p", "entry", "chunk").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(CHUNK)]).collect()
        out = [b.copy() for b in books]
        for row in total:
            at = slice(row.chunk, min(row.chunk + CHUNK, self.width))
            out[row.p][row.entry, at] = np.array(row[4:], np.int64)[: at.stop - at.start] // row.n
        return out

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.reshape(-1).tolist()).encode()).hexdigest()

    def codebooks(self) -> DataFrame:
        """``part, entry, components``: the final entries."""
        rows = [(p, e, v.tolist()) for p, book in enumerate(self.books) for e, v in enumerate(book)]
        return self.scratch.spark.createDataFrame(rows, "part int, entry int, components array<long>")

    def codes(self) -> DataFrame:
        """``vec_id, label, code, error`` of every vector."""
        books = self.books
        if self.blocks is None:
            return self.scratch.spark.createDataFrame([], "vec_id long, label int, code string, error long")
        return self.blocks.mapInArrow(lambda batches: _codes(batches, books), f"vec_id long, label {self.label_type}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that takes part."""
    own = Quantiser(vectors, parts, entries, rounds)
    coded = own.scratch.save(own.codes(), "codes")
    return by_label(coded, own.scratch).select("vec_id", "code", "error", "label_error", F.lit(own.codebooks_sha256()).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(C.table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by plain comparison of every part with every entry; sums of integers stay below 2^53."""
    width = "any_value(len(ints)) OVER () // {parts}".format(parts=parts)
    steps = [f"""
kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
part AS (
  SELECT vec_id, label, p, list_slice(ints, p * w + 1, (p + 1) * w) AS v
  FROM (SELECT *, {width} AS w, row_number() OVER (ORDER BY vec_id) AS rn FROM kept), range({parts}) AS t(p)
),
book0 AS (
  SELECT p, rank - 1 AS entry, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rank FROM part) WHERE rank <= {entries}
)"""]
    distance = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT a.vec_id, a.p, any_value(a.label) AS label, any_value(a.v) AS v, min({{'d': {distance}, 'e': b.entry}}) AS best
  FROM part a JOIN book{r} b ON a.p = b.p GROUP BY a.vec_id, a.p
)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT p, entry, i, sum(x) AS s, count(*) AS n
  FROM (SELECT p, best.e AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r}) GROUP BY p, entry, i
),
moved{r} AS (SELECT p, entry, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM sums{r} GROUP BY p, entry),
book{r + 1} AS (SELECT b.p, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN moved{r} m ON b.p = m.p AND b.entry = m.entry)""")
    last = rounds
    return f"""WITH {','.join(steps)},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{last} GROUP BY vec_id
),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS h FROM book{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, digest"""


OP12_SQL = _sql()
