"""Substring dedup: words covered by a repeated window are removed, by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of a document; it is repeated if its
words also start anywhere else. Equal windows have the same least hash of a
``GRAM``-word gram, their anchor; windows that follow each other and share it
form one stretch, so that

1. every document gives its anchors, about one in fifteen words;
2. anchors of one window are dropped (a count with partial aggregation, a join);
3. the stretch of words of each remaining anchor goes to the group of its anchor:
   the prefix that partitions the suffixes;
4. a group builds its subtree top down, a few words of depth at a time, over the
   suffixes at all window starts of its stretches; leaves that branch off above
   the window's depth are done, and the deep internal nodes are the repeats.

Prefixes vary in length: a group of more than ``GROUP_MAX`` stretches is dealt
out by a salt, each part builds its own subtree and marks what repeats inside,
and one representative of each path goes on under the longest prefix, the whole
window, where a count over the parts finds the rest. No task holds more than a
part, however common a passage is. Words are compared by 64-bit fingerprints.

Consecutive repeated windows are one maximal repeat. Windows are judged on the
input, so all of them go, the first occurrence included.

Defined results: a null or empty text has no words, none removed and the hash of
the empty text; a text shorter than a window loses nothing; equal rows are each
other's repeats, each keeps its row; a null id is an id of its own; an empty
table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph.llm import common as C
from supplygraph.llm.pretoken import gather
from supplygraph.session import Scratch

WINDOW = 35
GRAM = 6
#: Words of depth that a level of a subtree adds; divides the window.
STEP = 7
#: Stretches that a subtree is built over at most, about.
GROUP_MAX = 2_000

PLACE = f"{C.KEY_DDL}, low int, high int"
FOUND_DDL = f"{PLACE}, path1 long, path2 long, marked boolean"
STRETCH_DDL = f"anchor long, salt int, parts int, {C.KEY_DDL}, low int, words binary"


def anchors(hashes: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch: its anchor, 2 if the anchor's gram stands in it twice or more and else 1, its first and last window start."""
    n = len(hashes) - WINDOW + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return np.empty(0, np.uint64), none, none, none
    grams = C.gram_hashes(hashes, GRAM)
    starts = np.flatnonzero(row_of[:n] == row_of[WINDOW - 1:])
    if not len(starts):
        return np.empty(0, np.uint64), none, none, none
    at = np.arange(n, dtype=np.int64)
    least, place = grams[:n].copy(), at.copy()
    for k in range(1, WINDOW - GRAM + 1):  # leftmost least gram of every window
        better = grams[k: k + n] < least
        least[better] = grams[k: k + n][better]
        place[better] = at[better] + k
    least, place = least[starts], place[starts]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    # windows of one stretch that are equal have their gram at different places
    return least[first], 1 + (place[first] != place[last]), starts[first], starts[last]


def _key_columns(batch: pa.RecordBatch, rows: np.ndarray) -> dict[str, pa.Array]:
    take = pa.array(rows)
    return {c: batch.column(c).take(take) for c in C.KEY}


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for whole in batches for s in C.slices([whole])):
        words = C.Words(batch.column("text"))
        row_of = words.rows()
        found, times, low, _ = anchors(words.hashes(), row_of)
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(found.view(np.int64)), "key_text": batch.column("key_text").take(pa.array(row_of[low])), "times": pa.array(times, pa.int64())})


def _stretches(batches: Iterator[pa.RecordBatch], group_max: int) -> Iterator[pa.RecordBatch]:
    """The stretches around those anchors of a document that other places share."""
    for batch in (s for whole in batches for s in C.slices([whole])):
        words = C.Words(batch.column("text"))
        row_of = words.rows()
        found, _, low, high = anchors(words.hashes(), row_of)
        shared = batch.column("shared")
        entries = shared.flatten()
        owner = np.repeat(np.arange(len(shared)), np.diff(shared.offsets.to_numpy()))
        known = C.mixed(entries.field("anchor").to_numpy().view(np.uint64) + C.mixed(owner.astype(np.uint64)))
        count = entries.field("n").to_numpy()
        order = np.argsort(known)
        known, count = known[order], count[order]
        rows = row_of[low]
        wanted = C.mixed(found + C.mixed(rows.astype(np.uint64)))
        at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        keep = known[at] == wanted if len(known) else np.zeros(len(wanted), bool)
        found, low, high, rows, n = found[keep], low[keep], high[keep], rows[keep], count[at[keep]] if len(known) else count[:0]
        parts = np.maximum(1, -(-n // group_max))
        texts = batch.column("key_text").to_numpy()[rows].view(np.uint64)
        salt = (C.mixed(texts + low.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
        data = words.data.tobytes()
        spans = zip(words.starts[low].tolist(), words.ends[high + WINDOW - 1].tolist(), strict=True)
        yield pa.RecordBatch.from_pydict({
            "anchor": pa.array(found.view(np.int64)), "salt": pa.array(salt), "parts": pa.array(parts.astype(np.int32)), **_key_columns(batch, rows),
            "low": pa.array((low - words.first[rows]).astype(np.int32)), "words": pa.array([data[a:b] for a, b in spans], pa.binary()),
        })


def subtrees(symbols: np.ndarray, starts: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Builds the subtrees of all roots at once down to the window's depth.

    Gives, for each suffix, whether it lies below an internal node of that
    depth, and that node (-1 for suffixes that branched off before).
    """
    steps = C.gram_hashes(symbols, STEP)
    alive, node = np.arange(len(starts)), root.astype(np.uint64)
    for depth in range(0, WINDOW, STEP):
        edge = steps[starts[alive] + depth]
        _, child, leaves = np.unique(C.mixed(edge + C.mixed(node)), return_inverse=True, return_counts=True)
        child = child.reshape(-1)
        stay = leaves[child] > 1
        alive, node = alive[stay], child[stay].astype(np.uint64)
    found, nodes = np.zeros(len(starts), bool), np.full(len(starts), -1, np.int64)
    found[alive] = True
    nodes[alive] = node.astype(np.int64)
    return found, nodes


def _forest(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Repeats within the groups of the rows, and the paths of the parts of dealt-out groups."""
    words = C.Words(rows.column("words"))
    hashes, row_of = words.hashes(), words.rows()
    n = len(hashes) - WINDOW + 1
    starts = np.flatnonzero(row_of[:n] == row_of[WINDOW - 1:]) if n > 0 else np.empty(0, np.int64)
    own = row_of[starts]
    anchor = rows.column("anchor").to_numpy().view(np.uint64)
    salt, parts = rows.column("salt").to_numpy(), rows.column("parts").to_numpy()
    root = C.mixed(anchor + C.mixed(salt.astype(np.uint64)))[own]
    found, node = subtrees(hashes, starts, root)
    low = rows.column("low").to_numpy()[own] + (starts - words.first[own])
    # runs of repeated windows of a stretch
    here = np.flatnonzero(found)
    edge = np.concatenate(([True], (np.diff(here) > 1) | (np.diff(own[here]) > 0))) if len(here) else np.empty(0, bool)
    begin = here[edge]
    end = here[np.append(np.flatnonzero(edge)[1:], len(here)) - 1] if len(here) else begin
    # one suffix of each path of a part: a node's first leaf, and every leaf above the depth
    dealt = parts[own] > 1
    single = np.flatnonzero(dealt & ~found)
    inner = np.flatnonzero(dealt & found)
    inner = inner[np.unique(node[inner], return_index=True)[1]]
    paths = np.concatenate((single, inner))
    path1 = C.gram_hashes(hashes, WINDOW)[starts[paths]] if len(paths) else np.empty(0, np.uint64)
    path2 = C.gram_hashes(C.mixed(hashes + np.uint64(1)), WINDOW)[starts[paths]] if len(paths) else np.empty(0, np.uint64)
    which = np.concatenate((begin, paths))
    nothing = np.concatenate((np.ones(len(begin), bool), np.zeros(len(paths), bool)))
    return pa.RecordBatch.from_pydict({
        **_key_columns(rows, own[which]), "low": pa.array(low[which].astype(np.int32)), "high": pa.array(np.concatenate((low[end], low[paths])).astype(np.int32)),
        "path1": pa.array(np.concatenate((np.zeros(len(begin), np.int64), path1.view(np.int64))), mask=nothing),
        "path2": pa.array(np.concatenate((np.zeros(len(begin), np.int64), path2.view(np.int64))), mask=nothing),
        "marked": pa.array(np.concatenate((np.ones(len(begin), bool), found[paths]))),
    })


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come one after the other; a slice ends where a group ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in C.slices([batch], "words"):
            if held and size >= C.SLICE_BYTES:
                group = [piece.column(c).to_numpy() for c in ("anchor", "salt")]
                tail = [held[-1].column(c)[-1].as_py() for c in ("anchor", "salt")]
                other = np.flatnonzero((group[0] != tail[0]) | (group[1] != tail[1]))
                cut = int(other[0]) if len(other) else piece.num_rows
                held.append(piece.slice(0, cut))
                if len(other):
                    yield _forest(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size, piece = [], 0, piece.slice(cut)
                else:
                    size += piece.nbytes
                    continue
            held.append(piece)
            size += piece.nbytes
    if sum(h.num_rows for h in held):
        yield _forest(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def repeats(docs: DataFrame, scratch: Scratch, group_max: int = GROUP_MAX) -> DataFrame:
    """``KEY, low, high``: runs of starts of repeated windows, by document."""
    keyed = C.keyed(docs)
    given = keyed.select("key_text", "text").mapInArrow(_anchors, "anchor long, key_text long, times long")
    shared = scratch.save(given.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1"), "shared")
    # by text, not by row: copies of a text have the same anchors
    by_text = given.select("anchor", "key_text").join(shared, "anchor").groupBy("key_text").agg(F.collect_set(F.struct("anchor", "n")).alias("shared"))
    stretches = keyed.select(*C.KEY, "text").join(by_text, "key_text").mapInArrow(lambda batches: _stretches(batches, group_max), STRETCH_DDL)
    grouped = stretches.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = scratch.save(grouped.mapInArrow(_forests, FOUND_DDL), "found")
    paths = found.where("path1 is not null")
    again = paths.groupBy("path1", "path2").agg(F.count("*").alias("n")).where("n > 1").select("path1", "path2")
    late = paths.where("not marked").join(again, ["path1", "path2"])
    return found.where("path1 is null").select(*C.KEY, "low", "high").unionByName(late.select(*C.KEY, "low", "high"))


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in (s for whole in batches for s in C.slices([whole])):
        words = C.Words(batch.column("text"))
        places = batch.column("places")
        entries = places.flatten()
        base = np.repeat(words.first[:-1], np.diff(places.offsets.to_numpy()))
        gone = C.covered(len(words.starts), base + entries.field("low").to_numpy(), base + entries.field("high").to_numpy() + WINDOW)
        row_of = words.rows()
        removed = np.bincount(row_of, gone, batch.num_rows).astype(np.int64)
        kept = np.flatnonzero(~gone)
        size = words.ends[kept] - words.starts[kept] + 1
        text = gather(np.append(words.data, np.uint8(32)), words.starts[kept], size)
        stop = np.cumsum(size)
        text[stop - 1] = 32  # one space for whatever followed a word
        bound = np.concatenate(([0], stop))[np.searchsorted(row_of[kept], np.arange(batch.num_rows + 1))]
        raw = text.tobytes()
        texts = [raw[a: max(a, b - 1)] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        columns = {
            "doc_id": batch.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        }
        if with_text:
            columns |= {"kept": pa.array(texts, pa.binary()).cast(pa.string()), "places": places}
        yield pa.RecordBatch.from_pydict(columns)


def remove_repeats(docs: DataFrame, with_text: bool = True, group_max: int = GROUP_MAX) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document; ``with_text`` adds the kept text and the runs of repeated windows."""
    scratch = Scratch(docs.sparkSession, "substrings")
    runs = repeats(docs, scratch, group_max).groupBy(*C.KEY).agg(F.collect_list(F.struct("low", "high")).alias("places"))
    joined = C.keyed(docs).join(runs, C.KEY, "left").select("doc_id", "text", F.expr("coalesce(places, cast(array() as array<struct<low:int,high:int>>))").alias("places"))
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, places array<struct<low:int,high:int>>" if with_text else "")
    return joined.mapInArrow(lambda batches: _kept(batches, with_text), ddl)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents"), with_text=False)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT r, list(DISTINCT k) AS ks FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM twice) GROUP BY r),
kept AS (SELECT w.r, string_agg(w.x, ' ' ORDER BY w.k) AS s, count(*) AS n
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) w
  LEFT JOIN (SELECT r, unnest(ks) AS k FROM gone) g ON g.r = w.r AND g.k = w.k WHERE g.k IS NULL GROUP BY w.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
