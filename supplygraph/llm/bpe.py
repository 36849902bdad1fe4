"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as a state machine.

Encoding. Pieces of a text are merged on their own. A piece is read symbol by
symbol; whenever the buffer is long enough, the merges are run over it and all
tokens that end at least ``lookahead`` symbols before its end are emitted, for
no text that follows can change them; the buffer then starts at the last
emitted end, which is a token boundary for good. Memory is a few times the
lookahead, whatever the piece's length.

The lookahead comes from the merge list. Let two texts agree up to the end of
the buffer. Merges are made by rank, so the point up to which both are split
alike can move left only when a merge (u, v) is made at it in one text alone; it
then moves by the length of u, and what begins there in either text begins with
u. The next merge (u', v') that can move it has a later rank and a v' that
begins with u. The lookahead is the longest sum of lengths of u over such
chains, found in one sweep over the list from its end.

Decoding. Token strings stand for bytes; a machine turns the bytes of one token
after the other into text and holds back the at most three bytes of a character
that is not complete. The tokenizers library, for a file without a decoder,
instead joins the token strings with blanks; both are offered.

Defined results: a null text is encoded like an empty one, to no ids and the
empty text; equal rows each get a row; an empty table gives an empty result;
further columns play no part; a special token's name in a text becomes its id.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from supplygraph.llm import common as C
from supplygraph.llm import pretoken as P


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], symbols_of: dict[str, int]) -> int:
    """Longest stretch at a buffer's end that later text can still change; see the module's text."""
    reach: dict[str, int] = {}  # beginning of a right part -> best sum over the merges seen, all later ones
    best = 0
    for left, right in reversed(merges):
        total = symbols_of[left] + reach.get(left, 0)
        best = max(best, total)
        for k in range(1, len(right) + 1):
            if reach.get(right[:k], 0) < total:
                reach[right[:k]] = total
    return best


class Merger:
    """Encoder and decoder of one vocabulary file with a merge list."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.symbols = byte_symbols()
        # a symbol is one character, or one with the word's end
        parts = {s for m in merges for s in m}
        self.lookahead = sufficient_lookahead(merges, {s: len(s.removesuffix(self.suffix)) if self.suffix else len(s) for s in parts})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.path = path
        self.cache = P.PieceIds(lambda texts: [list(self.encode_piece(t)) for t in texts])

    @cached_property
    def library(self):
        """For what it says of texts beyond the simple ones: their normal form and their pieces."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a buffer: the merge of least rank first, from the left."""
        rank, none = self.ranks.get, len(self.ranks)
        symbols = list(symbols)
        waiting = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while waiting and (least := min(waiting)) < none:
            i = waiting.index(least)
            joined = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], waiting[i]
            if i:
                waiting[i - 1] = rank((symbols[i - 1], joined), none)
            if i < len(waiting):
                waiting[i] = rank((joined, symbols[i + 1]), none)
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens as soon as they are stable."""
        most, buffer = 2 * self.lookahead + 1, []
        for symbol in symbols:
            if len(buffer) >= most:
                done, end = 0, len(buffer) - self.lookahead
                for token in self.merged(buffer):
                    if done + len(token) > end:
                        break
                    yield token
                    done += len(token)
                del buffer[:done]
            buffer.append(symbol)
        yield from self.merged(buffer)

    def encode_piece(self, text: str) -> Iterator[int]:
        raw = text.encode("utf-8")
        names, last = self.symbols, len(raw) - 1
        if self.suffix:
            symbols = (names[b] + self.suffix if i == last else names[b] for i, b in enumerate(raw))
        else:
            symbols = (names[b] for b in raw)
        tokens = self.merged(list(symbols)) if len(raw) <= 2 * self.lookahead + 1 else self.stream(symbols)
        for token in tokens:
            found = self.vocabulary.get(token)
            if found is not None:
                yield found

    def _general(self, text: str) -> list[int]:
        """Any text: special names first, then each part by its normal form and pieces."""
        out, at = [], 0
        for m in [*self._special.finditer(text), None]:
            part = text[at: m.start() if m else len(text)]
            if part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part):
                    out += self.encode_piece(part[a:b])
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and each row's number of ids."""
        column = column.fill_null("")
        simple = P.simple_rows(column)
        data, offsets = C.flat(column.filter(pa.array(simple)))
        words = bool(self.suffix)
        data = P.lowered(data) if words else data
        starts, ends = P.pieces(data, offsets, spaced=not words)
        ids, size = self.cache.ids(data, starts, ends) if len(starts) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        before = np.concatenate(([0], np.cumsum(size)))
        bound = before[np.searchsorted(starts, offsets)]
        if simple.all():
            return ids, np.diff(bound)
        rows: list[np.ndarray] = [np.empty(0, np.uint32)] * len(column)
        for r, a, b in zip(np.flatnonzero(simple).tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            rows[r] = ids[a:b]
        for r in np.flatnonzero(~simple).tolist():
            rows[r] = np.array(self._general(column[r].as_py()), np.uint32)
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    @cached_property
    def names(self) -> list[str]:
        out = [""] * (max([*self.vocabulary.values(), *self.special.values()]) + 1)
        for token, i in (*self.vocabulary.items(), *self.special.items()):
            out[i] = token
        return out

    @cached_property
    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token strings with a blank after each, as one pool of bytes."""
        raw = [n.encode("utf-8") + b" " for n in self.names]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all token strings, a blank after each, and where each id's end."""
        pool, begin, size = self._joined
        return P.gather(pool, begin[ids], size[ids]), np.cumsum(size[ids])

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, piece by piece, as soon as its characters are complete."""
        byte_of = {s: b for b, s in enumerate(self.symbols)}
        special = {i: t for t, i in self.special.items()}
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if i in special:
                yield machine.decode(b"", True) + special[i]
                machine.reset()
                continue
            token = self.names[i]
            ends = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(byte_of[c] for c in (token.removesuffix(self.suffix) if ends else token))
            yield machine.decode(raw + b" " if ends else raw)
        yield machine.decode(b"", True)


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def _digest(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = merger(path)
    for batch in (s for whole in batches for s in C.slices([whole])):
        ids, sizes = own.encode(batch.column("text"))
        text, ends = own.join(ids)
        raw, shown = memoryview(ids.astype("<u4").tobytes()), memoryview(text.tobytes())
        stops = np.cumsum(sizes)
        bytes_at = np.concatenate(([0], ends))[np.concatenate(([0], stops))]
        a = [hashlib.sha256(raw[4 * (e - n): 4 * e]).hexdigest() for e, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
        # the blank after the last token is not part of the text
        b = [hashlib.sha256(shown[f: max(f, t - 1)]).hexdigest() for f, t in zip(bytes_at[:-1].tolist(), bytes_at[1:].tolist(), strict=True)]
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(columns)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` of every document."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return C.documents(docs).mapInArrow(lambda batches: _digest(batches, path, with_ids), ddl)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
