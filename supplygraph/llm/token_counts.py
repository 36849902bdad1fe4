"""Token counts of a sentencepiece model by heap-and-linked-list byte-pair merging.

A text gets a blank in front (the model's dummy prefix); a blank is the model's
U+2581. Its symbols are its characters; one that is no piece of the vocabulary
stands for as many symbols as it has bytes. Adjacent pairs whose joined string
is a piece wait in a heap by rank (the piece's score, ties by place); the least
is popped, its right symbol leaves the linked list and the pairs with the new
neighbours enter the heap. The count is the number of symbols at first less
those that merges took away: no ids are looked up or emitted.

Merges never cross a place whose two bytes stand next to each other in no piece,
so a text is cut there first, all rows of a slice at once by numpy, and equal
segments are merged once and kept in a bounded cache by their 64-bit hash. A
text without such a place is one segment and costs n log n.

Defined results: null and empty texts have no bytes and no tokens; names of
control pieces inside a text are plain text; equal rows each get a row; an empty
table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from supplygraph.llm import common as C

#: Tokens that a document may have.
LIMIT = 4_096
#: Segments whose counts a task keeps before it starts anew.
CACHE = 500_000
BLANK = "▁"


class Pieces:
    """The vocabulary of a sentencepiece BPE model: ranks of its pieces and the places that no piece spans."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError(f"not a BPE model with texts as they are: {path}")
        if any(p.type == kind.USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"pieces of one's own and blanks at the end are not supported: {path}")
        self.prefix = spec.add_dummy_prefix
        self.ids = {p.piece.replace(BLANK, " "): i for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.UNUSED)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        #: Bytes that each id stands for; none for control pieces.
        self.spelling = [b""] * len(model.pieces)
        for text, i in self.ids.items():
            self.spelling[i] = text.encode("utf-8")
        for byte, i in self.byte_ids.items():
            self.spelling[i] = bytes([byte])
        places = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True))}
        self.ranks = {t: places[model.pieces[i].score] for t, i in self.ids.items()}
        #: Pairs of bytes that stand next to each other in a piece.
        self.beside = np.zeros((256, 256), bool)
        for text in self.ids:
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            self.beside[raw[:-1], raw[1:]] = True

    def weight(self, symbol: str) -> int:
        """Tokens that an unmerged character stands for."""
        return 1 if symbol in self.ids or not self.byte_ids else len(symbol.encode("utf-8"))

    def merge(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Each merge in order: places of the two symbols' first characters and what they become."""
        n, rank = len(text), self.ranks.get
        symbol, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, pair) for i in range(n - 1) if (r := rank(pair := text[i: i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, j, joined = heappop(heap)
            # a symbol that was merged since has another string, or none
            if symbol[i] is None or after[i] != j or len(symbol[i]) + len(symbol[j]) != len(joined):
                continue
            yield i, j, joined
            symbol[i], symbol[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair := joined + symbol[k])) is not None:
                    heappush(heap, (r, i, k, pair))
            if (h := before[i]) >= 0 and (r := rank(pair := symbol[h] + joined)) is not None:
                heappush(heap, (r, h, i, pair))

    def count(self, text: str) -> int:
        """Symbols at first less those that merges take away."""
        weights = [self.weight(c) for c in text]
        total = sum(weights)
        for i, j, _ in self.merge(text):
            total -= weights[i] + weights[j] - 1
            weights[i] = 1
        return total

    def tokens(self, text: str) -> list[int]:
        """The ids of a segment; bytes for characters that are no piece."""
        symbols: list[str | None] = list(text)
        for i, j, joined in self.merge(text):
            symbols[i], symbols[j] = joined, None
        out = []
        for s in symbols:
            if s is not None and (found := self.ids.get(s)) is not None:
                out.append(found)
            elif s is not None:
                out += [self.byte_ids[b] for b in s.encode("utf-8")] if self.byte_ids else [self.unknown]
        return out

    def spelled(self, column: pa.Array) -> pa.Array:
        """Null-free texts as the model reads them, U+2581 as a blank."""
        texts = pc.replace_substring(pc.fill_null(column, ""), BLANK, " ")
        return pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")) if self.prefix else texts

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans that can be merged on their own."""
        n = len(data)
        start = np.zeros(n + 1, bool)
        if n > 1:
            start[1:n] = ~self.beside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        start[offsets] = True
        bounds = np.flatnonzero(start[:n])
        return bounds, np.append(bounds[1:], n)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class Counter:
    """Counts of rows, with a bounded cache of segments."""

    def __init__(self, model: Pieces):
        self.model = model
        self.known, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def of_segments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes, first, which = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        counts = np.zeros(len(hashes), np.int64)
        counts[~new] = self.counts[at[~new]]
        if new.any():
            raw, spans = data.tobytes(), zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            counts[new] = [self.model.count(raw[a:b].decode("utf-8")) for a, b in spans]
            keep = slice(0) if len(self.known) + int(new.sum()) > CACHE else slice(None)
            known, own = np.concatenate((self.known[keep], hashes[new])), np.concatenate((self.counts[keep], counts[new]))
            order = np.argsort(known)
            self.known, self.counts = known[order], own[order]
        return counts[which.reshape(-1)]

    def rows(self, column: pa.Array) -> np.ndarray:
        data, offsets = C.flat(self.model.spelled(column))
        starts, ends = self.model.segments(data, offsets)
        if not len(starts):
            return np.zeros(len(column), np.int64)
        total = np.concatenate(([0], np.cumsum(self.of_segments(data, starts, ends))))
        return np.diff(total[np.searchsorted(starts, offsets)])


_COUNTERS: dict[str, Counter] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    # a worker keeps its cache from task to task
    counter = _COUNTERS.setdefault(path, Counter(pieces(path)))
    for batch in (s for whole in batches for s in C.slices([whole])):
        n = counter.rows(batch.column("text"))
        size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return C.documents(docs).mapInArrow(lambda batches: _count(batches, path, limit), ddl)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
