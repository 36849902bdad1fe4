"""Near-duplicate documents: BagMinHash signatures of shingle multisets, bands, exact overlap.

A document is the multiset of its runs of ``SHINGLE`` words. Each shingle has
one Poisson process for each dyadic interval of weights, [0, 1), [1, 2), [2, 4),
..., with the interval's length as its rate. A point has a time, a signature
component and a place in the interval; a document whose weight of the shingle
exceeds the place has the point, so one process serves all weights and the
points of a lighter document are among a heavier one's. A component holds the
least time of the document's points: two documents agree in it with the
probability of their weighted Jaccard similarity. Points are made in order of
time and only up to the time by which all components are full.

Documents of equal multisets are one node. ``BANDS`` bands of ``ROWS`` components
deal the nodes into buckets; at the threshold a pair misses all buckets with a
probability of 2e-4. Pairs of a bucket are never all listed: first each member
is verified against the bucket's least node, and the components of the verified
pairs are classes; a bucket of one class is done. In the others ``LEADERS`` more
leaders are drawn, and the members of other classes are verified against them,
which costs a pair a member and leader. What is left, members of one bucket in
different classes, is verified in full, which completes the classes: pairs are
listed in buckets of up to ``LISTED`` members only. The members of more crowded
ones are dealt into blocks of bounded size, and two blocks that share a bucket
meet in one task, where a matrix product gives the overlaps of all their texts;
what leaves it is at most one link a text. So a family of texts a little below
the threshold moves each text once for each block it meets, not for each pair.
Verified means that the exact overlap of the multisets, sum of least over sum of
greatest counts, is at least ``SIMILARITY``.

Defined results: a document of fewer words than a shingle, but not none, has one
shingle of all its words; a document without words, null texts too, is alone in
its class; equal rows are copies; the class id is the least document id of the
class, null if all are null; of equal candidates for the one that stays the
least id (null last) and then text hash decides; an empty table gives an empty
result; further columns play no part in the judgement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplygraph.llm import common as C
from supplygraph.operators.fixpoint import components
from supplygraph.session import Scratch

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 8
SIZE = BANDS * ROWS
#: Leaders drawn before the members of different classes are paired in full.
LEADERS = 4
#: Members of an unsettled bucket up to which its pairs are listed.
LISTED = 8
#: Texts and bytes of a block of a crowded bucket, on average.
BLOCK_TEXTS, BLOCK_BYTES = 256, 4_000_000
#: Shingles of a matrix product.
COLUMNS = 4096
#: Points of a process that are made at once.
BLOCK = 16
NODE = ["b1", "b2"]


class Bags:
    """The shingle multisets of a slice of rows: ``row``, ``shingle`` and ``count`` of each distinct shingle."""

    def __init__(self, column: pa.Array):
        words = C.Words(column)
        hashes, counts = words.hashes(), words.counts
        self.rows = len(counts)
        last = words.first[1:]
        grams = C.gram_hashes(hashes, SHINGLE)
        row_of = words.rows()
        at = np.flatnonzero(row_of[: len(grams)] == row_of[SHINGLE - 1:]) if len(grams) else np.empty(0, np.int64)
        rows, shingles = row_of[at], grams[at]
        # short texts: one shingle of all their words
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):
            whole = [int(C.gram_hashes(hashes[e - n: e], int(n))[0]) for e, n in zip(last[short].tolist(), counts[short].tolist(), strict=True)]
            rows, shingles = np.concatenate((rows, short)), np.concatenate((shingles, np.array(whole, np.uint64)))
        key = C.mixed(shingles + C.mixed(rows.astype(np.uint64)))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        self.row, self.shingle, self.count = rows[first], shingles[first], count
        self.weight = np.bincount(rows, minlength=self.rows)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each multiset, whatever the order."""
        out = []
        for salt in (1, 2):
            own = C.mixed(C.mixed(self.shingle + np.uint64(salt)) + self.count.astype(np.uint64))
            order = np.argsort(self.row, kind="stable")
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own[order], dtype=np.uint64)))
            bound = np.searchsorted(self.row[order], np.arange(self.rows + 1))
            out.append((total[bound[1:]] - total[bound[:-1]]).view(np.int64))
        return out[0], out[1]


def uniform(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1] of the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(bags: Bags) -> np.ndarray:
    """Rows x ``SIZE`` least times; infinite for rows without shingles."""
    best = np.full(bags.rows * SIZE, np.inf)
    todo = np.flatnonzero(bags.weight > 0)
    limit = np.zeros(bags.rows)
    limit[todo] = (np.log(SIZE) + 5) * SIZE / bags.weight[todo]
    while len(todo):
        wanted = np.zeros(bags.rows, bool)
        wanted[todo] = True
        chosen = np.flatnonzero(wanted[bags.row])
        low = 0
        while len(chosen):
            length = max(low, 1)
            _points(best, bags, chosen, low, length, limit)
            low += length
            chosen = chosen[bags.count[chosen] > low]
        full = np.isfinite(best.reshape(bags.rows, SIZE)[todo]).all(axis=1)
        todo = todo[~full]
        limit[todo] *= 2
    return best.reshape(bags.rows, SIZE)


def _points(best: np.ndarray, bags: Bags, chosen: np.ndarray, low: int, length: int, limit: np.ndarray) -> None:
    """Enters the points up to the rows' limits of the processes of weights ``low`` to ``low + length``."""
    for part in np.array_split(chosen, max(1, len(chosen) // 100_000)):
        row, weight = bags.row[part], bags.count[part]
        seed = C.mixed(bags.shingle[part] + C.mixed(np.full(len(part), low, np.uint64)))
        until, time, k = limit[row], np.zeros(len(part)), 0
        step = np.arange(BLOCK, dtype=np.uint64)
        while len(row):
            draw = C.mixed(seed[:, None] + (step + np.uint64(k))[None, :] * np.uint64(0xD6E8FEB86659FD93))
            times = time[:, None] + np.cumsum(-np.log(uniform(draw)) / length, axis=1)
            inside = times < until[:, None]
            i, j = np.nonzero(inside)
            second = C.mixed(draw[i, j] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            component = (second >> np.uint64(40)) % np.uint64(SIZE)
            if length > 1:
                place = low + (second & np.uint64(0xFFFFFF)).astype(np.float64) * (length / 2.0**24)
                has = np.floor(place) < weight[i]
                i, j, component = i[has], j[has], component[has]
            np.minimum.at(best, row[i] * SIZE + component.astype(np.int64), times[i, j])
            alive = inside[:, -1]
            row, weight, seed, until, time = row[alive], weight[alive], seed[alive], until[alive], times[alive, -1]
            k += BLOCK


def bands(signature: np.ndarray) -> np.ndarray:
    """Rows x ``BANDS`` bucket hashes."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.tile(C.mixed(np.arange(BANDS, dtype=np.uint64)), (len(signature), 1))
    for k in range(ROWS):
        out = C.mixed(out + C.mixed(bits[:, :, k]))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for whole in batches for s in C.slices([whole], limit=C.SLICE_BYTES // 2)):
        bags = Bags(batch.column("text"))
        one, two = bags.ids()
        filled = bags.weight > 0
        buckets = bands(signatures(bags))[filled].view(np.int64)
        offsets = np.concatenate(([0], np.cumsum(filled * BANDS)))
        yield pa.RecordBatch.from_pydict({
            **{c: batch.column(c) for c in C.KEY}, "b1": pa.array(one, mask=~filled), "b2": pa.array(two, mask=~filled),
            "buckets": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets.reshape(-1))),
        })


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts."""
    a, b = Bags(left), Bags(right)
    key = C.mixed(np.concatenate((a.shingle, b.shingle)) + C.mixed(np.concatenate((a.row, b.row)).astype(np.uint64)))
    row = np.concatenate((a.row, b.row))
    order = np.argsort(key, kind="stable")
    count = np.concatenate((a.count, b.count))[order]
    both = np.flatnonzero(key[order][1:] == key[order][:-1]) if len(order) > 1 else np.empty(0, np.int64)
    least = np.bincount(row[order][both], np.minimum(count[both], count[both + 1]), a.rows)
    return least / np.maximum(a.weight + b.weight - least, 1)


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in (s for whole in batches for s in C.slices([whole], "text_a", C.SLICE_BYTES // 4)):
        good = overlap(batch.column("text_a"), batch.column("text_b")) >= least - 1e-12
        yield batch.select(["a1", "a2", "c1", "c2"]).filter(pa.array(good))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a1, a2, c1, c2`` whose texts overlap enough."""
    one = texts.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("text").alias("text_a"))
    two = texts.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("text").alias("text_b"))
    full = pairs.join(one, ["a1", "a2"]).join(two, ["c1", "c2"])
    return full.mapInArrow(lambda batches: _verify(batches, least), "a1 long, a2 long, c1 long, c2 long")


def bridges(group: pa.Table, least: float) -> pa.Table:
    """Links between the classes ``root`` of texts of side 0 and side 1 (of side 0 alone if there is no other), one less than it joins at most."""
    side = group.column("side").to_numpy()
    bags = Bags(group.column("text").combine_chunks())
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if (side == 1).any() else one
    # the k-th copy of a shingle is a column of its own, so that common columns are the least counts
    row = np.repeat(bags.row, bags.count)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(bags.count) - bags.count, bags.count)
    _, column, held = np.unique(C.mixed(np.repeat(bags.shingle, bags.count) + C.mixed(copy.astype(np.uint64))), return_inverse=True, return_counts=True)
    row, column = row[held[column] > 1], column[held[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(one), len(two)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        holds = np.zeros((bags.rows, COLUMNS), np.float32)
        holds[row[at], column[at] - low] = 1
        common += holds[one] @ holds[two].T
    near = common / np.maximum(bags.weight[one][:, None] + bags.weight[two][None, :] - common, 1) >= least - 1e-12
    _, class_of = np.unique(np.stack((group.column("r1").to_numpy(), group.column("r2").to_numpy())), axis=1, return_inverse=True)
    parent = np.arange(class_of.max() + 1)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    i, j = np.nonzero(near & (class_of[one][:, None] != class_of[two][None, :]))
    for a, b in zip(one[i].tolist(), two[j].tolist(), strict=True):
        x, y = top(class_of[a]), top(class_of[b])
        if x != y:
            parent[x] = y
            found.append((a, b))
    a, b = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
    own, other = group.take(a), group.take(b)
    return pa.table({"a1": own.column("b1"), "a2": own.column("b2"), "c1": other.column("b1"), "c2": other.column("b2")})


def met_in_blocks(left: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``a1, a2, c1, c2``: links that join the classes of ``left`` (``bucket, b1, b2, root``) as its members' overlaps do."""
    sizes = left.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > LISTED)
    crowded = scratch.save(left.join(sizes, "bucket"), "crowded")
    # members of a family take the same bucket as their home: the most crowded one of any node that shares a bucket with them
    own = crowded.groupBy(*NODE).agg(F.max(F.struct("n", "bucket")).alias("home"))
    seen = crowded.select("bucket", *NODE).join(own, NODE).groupBy("bucket").agg(F.max("home").alias("home"))
    home = crowded.join(seen, "bucket").groupBy(*NODE).agg(F.max("home").alias("home"), F.min("root").alias("root")).select(*NODE, "root", F.col("home.bucket").alias("home"))
    home = scratch.save(home.join(texts.select(*NODE, F.octet_length("text").alias("bytes")), NODE), "homes")
    pieces = home.groupBy("home").agg(F.expr(f"ceil(greatest(count(*) / {BLOCK_TEXTS}, sum(bytes) / {BLOCK_BYTES}))").alias("pieces"))
    home = scratch.save(home.join(pieces, "home").select(*NODE, "root", F.expr("xxhash64(home, pmod(xxhash64(b1, b2), pieces))").alias("block")), "blocks")
    in_bucket = crowded.select("bucket", *NODE).join(home, NODE).select("bucket", "block").distinct()
    meet = in_bucket.withColumnRenamed("block", "x").join(in_bucket.withColumnRenamed("block", "y"), "bucket").where("x <= y").select("x", "y").distinct()
    meet = scratch.save(meet, "meetings")
    sides = [
        meet.where(where).join(home.withColumnRenamed("block", at), at).select("x", "y", *NODE, "root", F.lit(side).alias("side"))
        for side, at, where in ((0, "x", "true"), (1, "y", "x <> y"))
    ]
    full = sides[0].unionByName(sides[1]).join(texts, NODE).select("x", "y", *NODE, F.col("root.b1").alias("r1"), F.col("root.b2").alias("r2"), "side", "text")
    return full.groupBy("x", "y").applyInArrow(lambda group: bridges(group, least), "a1 long, a2 long, c1 long, c2 long")


def as_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.struct(F.col("a1").alias("b1"), F.col("a2").alias("b2")).alias("a"), F.struct(F.col("c1").alias("b1"), F.col("c2").alias("b2")).alias("b"))


def unsettled(member: DataFrame, links: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``bucket, b1, b2, root`` of the buckets that hold more than one class of the links, and their number."""
    node = F.struct(*NODE)
    rooted = components(as_links(links), scratch).select(F.col("node.b1").alias("b1"), F.col("node.b2").alias("b2"), "root")
    placed = scratch.save(member.select("bucket", *NODE).join(rooted, NODE, "left").select("bucket", *NODE, F.coalesce("root", node).alias("root")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return scratch.save_counted(placed.join(mixed, "bucket", "left_semi"), "unsettled")


def between(one: DataFrame, two: DataFrame) -> DataFrame:
    """``a1, a2, c1, c2``: pairs of one bucket and different classes, the lesser node first, each once."""
    left = one.select("bucket", F.struct(*NODE).alias("p"), F.col("root").alias("root_p"))
    right = two.select("bucket", F.struct(*NODE).alias("q"), F.col("root").alias("root_q"))
    pairs = left.join(right, "bucket").where("root_p <> root_q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("c"))
    return pairs.select(F.col("a.b1").alias("a1"), F.col("a.b2").alias("a2"), F.col("c.b1").alias("c1"), F.col("c.b2").alias("c2")).distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``KEY, root1, root2, b1, b2``: the class of every document, null for those without words."""
    scratch = Scratch(docs.sparkSession, "near")
    keyed = C.keyed(docs)
    signed = scratch.save(keyed.select(*C.KEY, "text").mapInArrow(_sign, f"{C.KEY_DDL}, b1 long, b2 long, buckets array<long>"), "signed")
    place = F.struct("key_null", "key_id", "key_text")
    nodes = signed.where("b1 is not null").groupBy(*NODE).agg(F.min(place).alias("place"), F.first("buckets").alias("buckets"))
    nodes = scratch.save(nodes, "nodes")
    dealt = nodes.select(*NODE, F.explode("buckets").alias("bucket"))
    node = F.struct(*NODE)
    crowded = dealt.groupBy("bucket").agg(F.min(node).alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
    member = scratch.save(dealt.join(crowded, "bucket"), "members")
    star = member.where(node != F.col("leader")).select(F.col("leader.b1").alias("a1"), F.col("leader.b2").alias("a2"), F.col("b1").alias("c1"), F.col("b2").alias("c2")).distinct()
    star = scratch.save(star, "star")
    # one text of each node that may be near another
    wanted = member.select(*NODE).distinct().join(nodes.select(*NODE, "place.*"), NODE)
    texts = scratch.save(keyed.join(wanted, C.KEY).groupBy(*NODE).agg(F.first("text").alias("text")), "texts")
    near = scratch.save(verified(star, texts, least), "near")
    links, tried = near, star
    left, n = unsettled(member, links, scratch)
    if n:
        drawn = [F.min_by(F.struct(*NODE, "root"), F.xxhash64(*NODE, F.lit(k))) for k in range(LEADERS)]
        leaders = left.groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("ls")).select("bucket", F.explode("ls").alias("l")).select("bucket", "l.*")
        pairs = scratch.save(between(leaders, left).join(tried, ["a1", "a2", "c1", "c2"], "left_anti"), "pairs")
        links, tried = links.unionByName(scratch.save(verified(pairs, texts, least), "more")), tried.unionByName(pairs)
        left, n = unsettled(member, links, scratch)
    if n:
        few = left.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") <= LISTED).select("bucket")
        few = left.join(few, "bucket", "left_semi")
        pairs = scratch.save(between(few, few).join(tried, ["a1", "a2", "c1", "c2"], "left_anti"), "pairs")
        links = links.unionByName(scratch.save(verified(pairs, texts, least), "more")).unionByName(scratch.save(met_in_blocks(left, texts, least, scratch), "bridges"))
    every = components(as_links(links), scratch).select(F.col("node.b1").alias("b1"), F.col("node.b2").alias("b2"), "root")
    # copies of a text share its node; a class is named by its least node
    rows = signed.select(*C.KEY, *NODE).join(every, NODE, "left")
    return rows.select(*C.KEY, *NODE, F.coalesce("root.b1", "b1").alias("root1"), F.coalesce("root.b2", "b2").alias("root2"))


def representatives(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``KEY, class_id, class_size, stays``, a row for every document."""
    scratch = Scratch(docs.sparkSession, "classes")
    found = scratch.save(classes(docs, least), "found")
    place = F.struct("key_null", "key_id", "key_text")
    alone = found.where("root1 is null").select(*C.KEY, F.when(~F.col("key_null"), F.col("key_id")).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    grouped = found.where("root1 is not null")
    head = grouped.groupBy("root1", "root2").agg(F.min(place).alias("first"), F.count("*").alias("class_size"))
    joined = grouped.join(head, ["root1", "root2"]).select(
        *C.KEY, F.when(~F.col("first.key_null"), F.col("first.key_id")).alias("class_id"), "class_size", (place == F.col("first")).alias("stays"),
    )
    return joined.unionByName(alone)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = representatives(C.table(spark, sf_dir, "documents"))
    return found.select(F.when(~F.col("key_null"), F.col("key_id")).alias("doc_id"), "class_id", "class_size", "stays")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, all columns; of rows equal in id and text one stays."""
    stays = representatives(docs).where("stays").select(*C.KEY).distinct()
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.xxhash64(F.col("text").cast("string")).alias("key_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    same = Window.partitionBy(*C.KEY).orderBy(F.xxhash64("row"))
    kept = keyed.join(stays, C.KEY).withColumn("n", F.row_number().over(same)).where("n = 1 or row.text is null or not row.text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.select("row.*")
