"""Splitting texts into the pieces that byte-pair merges work on, a slice of rows at a time.

A text of ASCII and of the letters U+00C0 to U+00FF is split by numpy over its
bytes; equal pieces of a slice are encoded once and kept in a bounded cache.
Any other text, and one that holds a special token's name, is for the caller's
slower way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from supplygraph.llm import common as C

SPACE, LETTER, NUMBER, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[list(b"\t\n\x0b\x0c\r ")] = SPACE
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = NUMBER

#: Pieces that a task's cache holds before it starts anew.
CACHE = 500_000


def simple_rows(column: pa.Array) -> np.ndarray:
    """Rows whose bytes alone tell the pieces: ASCII and U+00C0..U+00FF without the signs U+00D7 and U+00F7."""
    data, offsets = C.flat(column)
    odd = (data >= 0xC0) & (data != 0xC3) | (data == 0x97) | (data == 0xB7)
    total = np.concatenate(([0], np.cumsum(odd, dtype=np.int64)))
    special = pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False)
    return (total[offsets[1:]] == total[offsets[:-1]]) & ~special


def pieces(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pieces of simple rows.

    ``spaced``: white space belongs to pieces (a blank goes with the run after
    it) and numbers stay whole; otherwise white space is dropped and every
    digit is a piece of its own. The short forms 's 't 're 've 'm 'll 'd are
    pieces where a lone apostrophe begins one.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = CLASS[data]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | row_start[1:n]
    change = start.copy()
    if spaced:
        # the last white space of a run stands alone, or with what follows if it is a blank
        last = np.flatnonzero((kind[:-1] == SPACE) & change[1:n] & ~row_start[1:n]) if n > 1 else np.empty(0, np.int64)
        start[last + 1] &= data[last] != 32
        start[last] = True
    else:
        start[:n] |= kind == NUMBER
    quote = np.flatnonzero((data == 39) & start[:n] & change[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[change[quote + 1] & ~row_start[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = data[quote + 1]
        two = data[np.minimum(quote + 2, n - 1)]
        inside = (quote + 2 < n) & ~row_start[np.minimum(quote + 2, n)]
        long_ = inside & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(long_, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + 1 + size] = True
    bounds = np.flatnonzero(start[:n])
    ends = np.append(bounds[1:], n)
    if not spaced:
        keep = kind[bounds] != SPACE
        return bounds[keep], ends[keep]
    return bounds, ends


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of simple rows: A-Z, and U+00C0..U+00DE, whose second byte moves by 32."""
    upper = (data >= 65) & (data <= 90)
    second = (data >= 0x80) & (data <= 0x9E)
    return np.where(upper | second, data + 32, data).astype(np.uint8)


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pool's stretches one after the other."""
    total = np.cumsum(size)
    if not len(total):
        return pool[:0]
    shift = begin - (total - size)
    return pool[np.repeat(shift, size) + np.arange(int(total[-1]))]


class PieceIds:
    """Ids of pieces by their hash, from a bounded cache."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[int, int] = {}
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, hashes: list[int], texts: list[str]) -> None:
        ids = self.encode(texts)
        n, at = len(self.slot), self.used
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        while n + len(ids) > len(self.begin):
            self.begin, self.size = np.concatenate((self.begin, np.zeros_like(self.begin))), np.concatenate((self.size, np.zeros_like(self.size)))
        while at + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[at: at + len(flat)] = flat
        self.begin[n: n + len(ids)] = at + np.cumsum(sizes) - sizes
        self.size[n: n + len(ids)] = sizes
        self.used = at + len(flat)
        self.slot.update(zip(hashes, range(n, n + len(ids)), strict=True))

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans in order, and how many each span has."""
        hashes, first, which = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.slot) + len(hashes) > CACHE:
            self._reset()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.slot]
        if new:
            whole = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._add([keys[i] for i in new], [whole[a:b].decode("utf-8") for a, b in spans])
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))[which.reshape(-1)]
        size = self.size[slots]
        return gather(self.pool, self.begin[slots], size), size
