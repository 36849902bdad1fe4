"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a slice of documents held by one task. Its suffix array sorts the
word positions by the words that follow; a word that no test item has ends a
suffix, and suffixes that end before the shortest window cannot match and are
left out. Every suffix of every test item is then narrowed down in the array
by binary search, one word at a time, all test suffixes at once. This yields
its longest verbatim match and where that lies, and on the way the interval of
all places where its window occurs. Nothing is shuffled: a document's matches
are found where the document is.

The test items are read in blocks of at most ``block_bytes``; each block is one
broadcast of that bound and one narrow pass over the documents.

Defined results: null or empty texts have no words and no hits; an item without
words is ignored; an item of fewer words than the window is one window; equal
items are all reported; null item ids are hit but not listed; repeated documents
each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph.llm import common as C

WINDOW = 10
BLOCK_BYTES = 8_000_000
#: Words: runs of a-z (A-Z lowered), 0-9 and all non-ASCII characters.
WORD = C.byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))

FOUND = "struct<start:int,length:int>"
BEST = "struct<item_id:long,item_start:int,start:int,length:int>"


@dataclass
class TestSuffixes:
    """The words of a block of items as symbols 1..n; 0 is any other word."""

    vocabulary: np.ndarray  # sorted word hashes
    symbols: np.ndarray
    item: np.ndarray  # item number of each word
    place: np.ndarray  # place of each word in its item
    left: np.ndarray  # words of the item from here on
    ids: list[int | None]
    window: int

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], window: int) -> TestSuffixes:
        words = C.Words(pa.array([t for _, t in items], pa.string()), WORD, lower=True)
        vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
        counts = words.counts
        place = np.arange(len(symbols)) - np.repeat(words.first[:-1], counts)
        return cls(vocabulary, symbols.reshape(-1) + 1, words.rows(), place, np.repeat(counts, counts) - place, [i for i, _ in items], window)

    @property
    def depth(self) -> np.ndarray:
        """Length of the window that starts here, 0 if none does."""
        size = self.left + self.place
        return np.where(size < self.window, np.where(self.place == 0, size, 0), np.where(self.left >= self.window, self.window, 0))


def suffix_array(symbols: np.ndarray, reach: np.ndarray, least: int) -> np.ndarray:
    """Positions with ``reach`` of ``least`` words or more, sorted by the words up to their reach.

    Prefix doubling on ranks, where places past the reach rank lowest.
    """
    rank, k, longest = symbols.astype(np.int64), 1, int(reach.max(initial=0))
    while k < longest:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-k] = rank[k:]
        ahead[reach <= k] = 0
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].reshape(-1) + 1
        k *= 2
    places = np.flatnonzero(reach >= least)
    return places[np.argsort(rank[places], kind="stable")]


def narrow(array: np.ndarray, symbols: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each interval whose word at ``depth`` is the wanted one, by binary search."""

    def bound(upper: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            word = np.where(reach[at] > depth, symbols[np.minimum(at + depth, len(symbols) - 1)], 0)
            right = open_ & ((word <= wanted) if upper else (word < wanted))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        return a

    return bound(False), bound(True)


def search(words: C.Words, tests: TestSuffixes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Window hits ``(item, position, length)`` and longest matches ``(item, item place, position, length)`` of a shard."""
    depths = tests.depth
    query = np.flatnonzero(depths > 0)
    hashes = words.hashes()
    if not len(query) or not len(hashes):
        return [], []
    least = int(depths[query].min())
    at = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    known = tests.vocabulary[at] == hashes
    # words from here to the next unknown word or the end of the document
    place = np.arange(len(known))
    stop = np.where(known, len(known), place)
    ends = words.first[1:]
    ends = ends[ends > 0]
    stop[ends - 1] = np.minimum(stop[ends - 1], ends)
    reach = np.minimum.accumulate(stop[::-1])[::-1] - place
    # only stretches of known words that can hold a whole window
    begins = known & np.concatenate(([True], reach[:-1] <= 1))
    stretch = np.cumsum(begins) - 1
    long_ = np.flatnonzero(known & (reach[begins][np.maximum(stretch, 0)] >= least)) if begins.any() else np.empty(0, np.int64)
    if not len(long_):
        return [], []
    symbols, reach = at[long_] + 1, reach[long_]
    array = suffix_array(symbols, reach, least)
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(array), np.int64)
    hits, longest, depth = [], [], 0

    def note(which: np.ndarray) -> None:
        for q, a in zip(query[which].tolist(), low[which].tolist(), strict=True):
            if depth >= depths[q]:
                longest.append((int(tests.item[q]), int(tests.place[q]), int(long_[array[a]]), depth))

    while len(query):
        lower, upper = narrow(array, symbols, reach, low, high, depth, tests.symbols[query + depth])
        alive = lower < upper
        note(~alive)
        query, low, high = query[alive], lower[alive], upper[alive]
        depth += 1
        for j in np.flatnonzero(depths[query] == depth).tolist():
            hits += [(int(tests.item[query[j]]), int(p), depth) for p in long_[array[low[j]: high[j]]]]
        done = tests.left[query] == depth
        note(done)
        query, low, high = query[~done], low[~done], high[~done]
    return hits, longest


def _pass(batches: Iterator[pa.RecordBatch], tests: TestSuffixes) -> Iterator[pa.RecordBatch]:
    for batch in (s for whole in batches for s in C.slices([whole])):
        words = C.Words(batch.column("text"), WORD, lower=True)
        hits, longest = search(words, tests)
        state = {c: batch.column(c) for c in batch.schema.names} | {"n_words": pa.array(words.counts, pa.int64())}
        if hits:
            row_of = words.rows()
            spans, items, best = (batch.column(c).to_pylist() for c in ("spans", "items", "longest"))
            for item, p, size in hits:
                r = int(row_of[p])
                spans[r].append({"start": p - int(words.first[r]), "length": size})
                if tests.ids[item] is not None:
                    items[r].append(tests.ids[item])
            for item, start, p, size in longest:
                r = int(row_of[p])
                best[r].append({"item_id": tests.ids[item], "item_start": start, "start": p - int(words.first[r]), "length": size})
            for c, values in (("spans", spans), ("items", [sorted(set(x)) for x in items]), ("longest", best)):
                state[c] = pa.array(values, batch.schema.field(c).type)
        yield pa.RecordBatch.from_arrays([*state.values()], names=[*state])


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in id order, a bounded block at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    block, size = [], 0
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """``doc_id, text, n_words, spans, items, longest`` of every document, with ``carry`` also its whole row as ``row``.

    ``spans``: word spans of all window occurrences; ``items``: the items that
    they come from; ``longest``: each test suffix's longest match in a shard
    (a window at least), with one place of that shard that has it.
    """
    spark: SparkSession = docs.sparkSession
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.expr(f"cast(array() as array<{FOUND}>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("items"),
        F.expr(f"cast(array() as array<{BEST}>)").alias("longest"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    for block in [*blocks(benchmark, block_bytes)] or [[]]:
        held = spark.sparkContext.broadcast(TestSuffixes.of(block, window))
        state = state.mapInArrow(lambda batches, held=held: _pass(batches, held.value), state.schema)
    return state


def digest(found: DataFrame) -> DataFrame:
    """One row a document: words, hit words, items and their hash."""
    hit = F.expr("""aggregate(array_sort(spans), named_struct('n', 0L, 'done', 0),
        (a, s) -> named_struct('n', a.n + greatest(0, s.start + s.length - greatest(a.done, s.start)), 'done', greatest(a.done, s.start + s.length)), a -> a.n)""")
    return found.select(
        "doc_id", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window of an item; all their columns stay."""
    return matches(docs, benchmark, window, carry=True).where("size(spans) = 0").select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(matches(C.documents(C.table(spark, sf_dir, "documents")), C.table(spark, sf_dir, "benchmark")))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT p.r, p.i, p.n, item_id
  FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) p
  JOIN win ON win.n = p.n AND win.g = p.g),
places AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""
