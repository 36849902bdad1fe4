"""Cross-tokenizer alignment: byte ends of two tokenizations merged along equal pieces of the merge path.

A slice of documents is tokenized twice. Both give ascending byte ends, A's and
B's; merging them yields what is asked: each distinct end closes one pair of
overlapping tokens (a link), and an end of both closes a group. The merged
sequence is cut into pieces of ``PIECE`` ends, whatever the documents' lengths:
a binary search on each piece's diagonal finds how many ends of A and of B lie
before it (A first where both end), so pieces are independent and of equal work.
A piece emits its links and common ends by their global places; a group that
runs over pieces is stitched from the common ends before and after.

Corpus-wide counts. A slice becomes one row with its distinct id pairs, the
number of its documents that hold each, and for each document which of them it
holds how often (place in the slice's pairs, times), packed. Pairs are summed
over slices; each slice's pairs then get their counts by a join, once a slice
and not once a document, and go back to the slice's row, which gives the sums of
its documents. No list is longer than what a slice holds, whatever the corpus.

Defined results: a null or empty text, or one whose joined token bytes differ
from a blank and the text, has no tokens: zeros and the empty string; names of
special tokens inside a text are plain text; equal rows are documents of their
own, counted each; an empty table gives an empty result; further columns play
no part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph.llm import bpe
from supplygraph.llm import common as C
from supplygraph.llm import pretoken as P
from supplygraph.session import Scratch

#: Ends in a piece of the merge path.
PIECE = 65_536
#: Pieces of A whose ids a task keeps before it starts anew.
CACHED = 100_000
#: Bytes of text of a slice.
SLICE = 1_000_000


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library; special names are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte_of = {s: b for b, s in enumerate(bpe.byte_symbols())}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelling = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.spelling[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode("utf-8")
        self.cache = P.PieceIds(self._ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of null-free texts, and each row's number of them."""
        if len(self.cache.slot) > CACHED:
            self.cache = P.PieceIds(self._ids)
        simple = P.simple_rows(column)
        data, offsets = C.flat(column.filter(pa.array(simple)))
        starts, ends = P.pieces(data, offsets, spaced=True)
        ids, size = self.cache.ids(data, starts, ends) if len(starts) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        bound = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, offsets)]
        if simple.all():
            return ids, np.diff(bound)
        rows: list[np.ndarray] = [np.empty(0, np.uint32)] * len(column)
        for r, a, b in zip(np.flatnonzero(simple).tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            rows[r] = ids[a:b]
        others = np.flatnonzero(~simple)
        for r, own in zip(others.tolist(), self._ids(column.take(pa.array(others)).to_pylist()), strict=True):
            rows[r] = np.array(own, np.uint32)
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))


class PieceLevel:
    """A sentencepiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = own = SentencePieceProcessor(model_file=path)
        unseen = lambda i: own.is_control(i) or own.is_unknown(i)
        self.spelling = [
            bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else b"" if unseen(i) else own.id_to_piece(i).replace("▁", " ").encode("utf-8")
            for i in range(own.get_piece_size())
        ]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = self.model.encode(column.to_pylist(), num_threads=1)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes


class Strings:
    """Byte strings by number: their bytes one after the other, where each begins and how long it is."""

    def __init__(self, strings: list[bytes]):
        self.pool = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(self.size) - self.size

    def join(self, which: np.ndarray) -> np.ndarray:
        return P.gather(self.pool, self.begin[which], self.size[which])


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the ascending ``a`` are among the first ``d`` of both, for each ``d``; ``a`` goes first where they are equal."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # the a at the middle is among the first d unless d - middle of b are less
        taken = np.zeros(len(diagonals), bool)
        taken[open_] = a[middle[open_]] <= b[diagonals[open_] - middle[open_] - 1]
        low, high = np.where(open_ & taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low


def piece_links(a: np.ndarray, b: np.ndarray, at: tuple[int, int], to: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the ends of a piece close: links as places in ``a`` and ``b``, and common ends likewise."""
    (i, j), (i2, j2) = at, to
    own_a, own_b = a[i:i2], b[j:j2]
    b_before = j + np.searchsorted(own_b, own_a, "left")
    a_up_to = i + np.searchsorted(own_a, own_b, "right")
    common = np.zeros(len(own_b), bool)
    some = a_up_to > 0
    # the end of A may be the last of the piece before
    common[some] = a[a_up_to[some] - 1] == own_b[some]
    places = np.arange(j, j2)
    left, right = np.concatenate((np.arange(i, i2), a_up_to[~common])), np.concatenate((b_before, places[~common]))
    order = np.lexsort((right, left))
    return left[order], right[order], a_up_to[common] - 1, places[common]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links and common ends of two ascending sequences of ends, piece by piece."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    in_a = merge_path(a, b, diagonals)
    splits = list(zip(in_a.tolist(), (diagonals - in_a).tolist(), strict=True))
    parts = [piece_links(a, b, at, to) for at, to in zip(splits[:-1], splits[1:], strict=True)]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))


class Slice:
    """Both tokenizations of a slice of documents, and how they meet.

    Arrays over the tokens of all rows that have any: ids, global byte ends, the
    links (``link_a``, ``link_b``) and the last tokens of groups (``last_a``, ``last_b``).
    """

    def __init__(self, texts: pa.Array, one: Aligner):
        texts = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        (ids_a, size_a), (ids_b, size_b) = one.a.encode(spaced), one.b.encode(texts)
        data, offsets = C.flat(spaced)
        wanted = np.diff(offsets)
        same = wanted > 0
        for strings, ids, size in ((one.names_a, ids_a, size_a), (one.names_b, ids_b, size_b)):
            row = np.repeat(np.arange(len(wanted)), size)
            got = np.bincount(row, strings.size[ids], len(wanted)).astype(np.int64)
            same &= got == wanted
            checked = same.copy()
            joined = strings.join(ids[checked[row]])
            owner = np.repeat(np.arange(len(wanted)), np.where(checked, wanted, 0))
            same[owner[joined != data[np.repeat(checked, wanted)]]] = False
        self.n_a, self.n_b = np.where(same, size_a, 0), np.where(same, size_b, 0)
        self.a, self.b = ids_a[np.repeat(same, size_a)].astype(np.int64), ids_b[np.repeat(same, size_b)].astype(np.int64)
        self.ends_a, self.ends_b = np.cumsum(one.names_a.size[self.a]), np.cumsum(one.names_b.size[self.b])
        self.link_a, self.link_b, self.last_a, self.last_b = overlaps(self.ends_a, self.ends_b)
        self.row_a = np.repeat(np.arange(len(wanted)), self.n_a)
        self.group_row = self.row_a[self.last_a]
        self.n_groups = np.bincount(self.group_row, minlength=len(wanted))
        self.link_row = self.row_a[self.link_a]
        self.n_links = np.bincount(self.link_row, minlength=len(wanted))

    def group_hashes(self, decimals: tuple[Strings, Strings, Strings]) -> list[str]:
        """The hash of each row's groups written out; the empty string without tokens."""
        group_a = np.searchsorted(self.last_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.last_b, np.arange(len(self.b)))
        # B's tokens of the groups before an A token, A's tokens of the groups up to a B token's
        before_b, up_to_a = np.concatenate(([0], self.last_b + 1)), self.last_a + 1
        sizes, begins = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.int64)
        comma, bar, semicolon = decimals
        base = [0, len(comma.pool), len(comma.pool) + len(bar.pool)]
        for ids, place, last, end in (
            (self.a, np.arange(len(self.a)) + before_b[group_a], self.last_a, 1), (self.b, np.arange(len(self.b)) + up_to_a[group_b], self.last_b, 2),
        ):
            sizes[place], begins[place] = comma.size[ids], comma.begin[ids]
            closing = place[last]
            begins[closing] = decimals[end].begin[ids[last]] + base[end]
        written = memoryview(P.gather(np.concatenate([d.pool for d in decimals]), begins, sizes).tobytes())
        stop = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        return [hashlib.sha256(written[s: e - 1]).hexdigest() if e > s else "" for s, e in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs and the documents that hold each; then, by document: bounds, places in the pairs, times."""
        pair = (self.a[self.link_a] << 32) | self.b[self.link_b]
        distinct, which = np.unique(pair, return_inverse=True)
        # links come in order of their rows
        own, times = np.unique(self.link_row * max(len(distinct), 1) + which.reshape(-1), return_counts=True)
        row, place = np.divmod(own, max(len(distinct), 1))
        return distinct, np.bincount(place, minlength=len(distinct)), np.searchsorted(row, np.arange(len(self.n_a) + 1)), place, times


class Aligner:
    """Two vocabularies and their strings."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), PieceLevel(path_b)
        self.names_a, self.names_b = Strings(self.a.spelling), Strings(self.b.spelling)
        most = max(len(self.a.spelling), len(self.b.spelling))
        self.decimals = tuple(Strings([b"%d%s" % (i, mark) for i in range(most)]) for mark in (b",", b"|", b";"))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _packed(values: np.ndarray) -> bytes:
    """Differences of neighbours, modulo 2^32: small numbers that compress."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0)).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint32), dtype=np.uint32).astype(np.int64)


SLICE_DDL = """part int, seq int, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,
    hashes array<string>, pairs array<long>, held array<long>, bounds binary, places binary, times binary"""


def _slices(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    context, one, seq = TaskContext.get(), aligner(path_a, path_b), 0
    for batch in (s for whole in batches for s in C.slices([whole], limit=SLICE)):
        own = Slice(batch.column("text"), one)
        distinct, held, bounds, places, times = own.pairs()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([context.partitionId()], pa.int32()), "seq": pa.array([seq], pa.int32()),
            "doc_ids": pa.array([batch.column("doc_id")], pa.list_(pa.int64())),
            **{k: pa.array([getattr(own, k)], pa.list_(pa.int64())) for k in ("n_a", "n_b", "n_groups", "n_links")},
            "hashes": pa.array([own.group_hashes(one.decimals)], pa.list_(pa.string())),
            "pairs": pa.array([distinct], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.int64())),
            "bounds": [_packed(bounds)], "places": [_packed(places)], "times": [times.astype(np.uint32).tobytes()],
        })
        seq += 1


def slices_of(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch) -> DataFrame:
    """The written slices (``SLICE_DDL``) that everything corpus-wide is made from."""
    return scratch.save(C.documents(docs).mapInArrow(lambda batches: _slices(batches, path_a, path_b), SLICE_DDL), "slices")


def pair_counts(slices: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, n_docs, best``: documents that hold each linked id pair, and whether none of its A id has more."""
    counts = slices.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("n_docs"))
    counts = counts.selectExpr("pair", "shiftright(pair, 32) AS a_id", "pair & 4294967295 AS b_id", "n_docs")
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            bounds, places, times = _unpacked(row["bounds"].as_py()), _unpacked(row["places"].as_py()), np.frombuffer(row["times"].as_py(), np.uint32).astype(np.int64)
            count, best = np.zeros(int(places.max(initial=-1)) + 1, np.int64), np.zeros(int(places.max(initial=-1)) + 1, np.int64)
            if len(count):
                found = row["found"].values
                at = found.field("place").to_numpy()
                count[at], best[at] = found.field("n_docs").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
            sums = [np.concatenate(([0], np.cumsum(times * v[places]))) for v in (best, count)]
            n_best, count_sum = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            yield pa.RecordBatch.from_pydict({
                "doc_id": row["doc_ids"].values, **{c: row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")},
                "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": row["hashes"].values,
            })


def alignment_figures(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    scratch = Scratch(docs.sparkSession, "align")
    slices = slices_of(docs, path_a, path_b, scratch)
    counts = scratch.save(pair_counts(slices).select("pair", "n_docs", "best"), "counts")
    wanted = slices.select("part", "seq", F.posexplode("pairs").alias("place", "pair"))
    found = wanted.join(counts, "pair").groupBy("part", "seq").agg(F.collect_list(F.struct("place", "n_docs", "best")).alias("found"))
    full = slices.drop("pairs", "held").join(found, ["part", "seq"], "left")
    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return full.mapInArrow(_sums, ddl)


def _groups(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    one = aligner(path_a, path_b)
    for batch in (s for whole in batches for s in C.slices([whole], limit=SLICE)):
        own = Slice(batch.column("text"), one)
        ends = own.ends_a[own.last_a]
        first = np.concatenate(([0], np.cumsum(np.bincount(own.row_a, one.names_a.size[own.a], batch.num_rows).astype(np.int64))))[own.group_row]
        starts = np.concatenate(([0], ends[:-1])) - first if len(ends) else ends
        lists = lambda ids, last: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], last + 1)), pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(own.group_row)), "start": pa.array(starts, pa.int64()), "end": pa.array(ends - first, pa.int64()),
            "a_ids": lists(own.a, own.last_a), "b_ids": lists(own.b, own.last_b),
        })


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, start, end, a_ids, b_ids``: each group of every document, its byte range in the blank and the text, and its tokens."""
    return C.documents(docs).mapInArrow(lambda batches: _groups(batches, path_a, path_b), "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_figures(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
