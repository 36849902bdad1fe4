"""Helpers of the corpus operators: row keys, Arrow slices, word scanning and rolling hashes.

Word hashes are 64-bit fingerprints computed by numpy over the UTF-8 bytes of a
whole slice of rows, so no per-word Python runs. Functions that compare word
sequences compare these fingerprints symbol by symbol.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; one longer text is handled alone.
SLICE_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Key of a row: doc_id (0 for null), whether it is null, and a hash of the text.
KEY = ["key_id", "key_null", "key_text"]
KEY_DDL = "key_id long, key_null boolean, key_text long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone: further columns, whatever their names, play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """``documents`` with null-free key columns. Rows equal in id and text share a key."""
    return documents(docs).select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("key_id"), F.col("doc_id").isNull().alias("key_null"),
        F.xxhash64("text").alias("key_text"), "doc_id", "text",
    )


def sha256_utf8(text: str | Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size + 16)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words; bytes of non-ASCII characters always do."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Words of the form ``[^\\x20\\x09-\\x0D]+``.
SPACED = byte_table(b" \t\n\x0b\x0c\r")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _POWERS[i] = np.multiply.accumulate(grown)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever it stands."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` symbols; empty if there are fewer."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * power[: len(symbols)], out=total[1:])
    return mixed((total[k:] - total[:n]) * inverse[:n])


class Words:
    """Words of a slice of rows: byte spans and the first word of each row."""

    def __init__(self, column: pa.Array, member: np.ndarray = SPACED, lower: bool = False):
        data, offsets = flat(column)
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data + 32, data).astype(np.uint8)
        self.data, self.offsets = data, offsets
        inside = member[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.inside = inside

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the half-open spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans of the places that are set."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once per application.

    Nothing is done where the package's folder is the working folder or on
    PYTHONPATH, which Spark hands to its workers; elsewhere it is sent with the
    job, as ``spark-submit --py-files`` would.
    """
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root for p in known) or getattr(spark.sparkContext, "_corpus_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "supplygraph.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "supplygraph").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._corpus_shipped = True
