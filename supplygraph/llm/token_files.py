"""Token ids as files of fixed-width bit packing.

Documents are range-partitioned and sorted by id; every task encodes its
stretch of documents and writes one file:

    header   magic "IDPK", version, bits of an id, ids of a block (uint32 each)
    blocks   ids packed at ``bits`` each, most significant bit first; a block starts on a byte
    footer   uint64 byte offset of each block, int64 doc id and uint8 null flag of
             each document, uint64 first id of each document and their total
    trailer  numbers of blocks, documents and ids, offset of the footer (uint64 each), "IDPK"

``bits`` is the least number that holds every id of the vocabulary. Any range of
ids is read by its blocks' offsets and unpacked by numpy. A task names its file
by its attempt and reports it in its result row; these rows, written as a
table, are the manifest: files of lost or repeated attempts are not in it.

Defined results: a null text is encoded like an empty one (the end id alone);
documents of equal id are ordered by a hash of the text and the text, those of
null id come first; an empty table gives an empty result; further columns play
no part.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplygraph.llm import common as C
from supplygraph.llm import pretoken as P
from supplygraph.session import Scratch

MAGIC = b"IDPK"
BLOCK_IDS = 65_536
#: The id that ends each document of the registered query.
END_ID = 2
HEADER, TRAILER = struct.Struct("<4sIII"), struct.Struct("<QQQQ4s")
#: Documents of one output batch when files are read back.
READ_DOCS = 4_096


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits:].reshape(-1)).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits:] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class IdWriter:
    """Writes a file in one pass; holds one block and the document table."""

    def __init__(self, uri: str, bits: int):
        store, path = filesystem(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.bits = store.open_output_stream(path), bits
        self.out.write(HEADER.pack(MAGIC, 1, bits, BLOCK_IDS))
        self.blocks, self.at, self.rest = [], HEADER.size, np.empty(0, np.uint32)
        self.ids, self.nulls, self.starts, self.total = [], [], [], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.append(np.array([d or 0 for d in doc_ids], np.int64))
        self.nulls.append(np.array([d is None for d in doc_ids], np.uint8))
        self.starts.append((self.total + np.cumsum(sizes) - sizes).astype(np.uint64))
        self.total += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        for k in range(0, whole, BLOCK_IDS):
            self._block(ids[k: k + BLOCK_IDS])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        ids = join(self.ids, np.int64)
        self.out.write(np.array(self.blocks, np.uint64).tobytes() + ids.tobytes() + join(self.nulls, np.uint8).tobytes())
        self.out.write(join(self.starts, np.uint64).tobytes() + np.uint64(self.total).tobytes())
        self.out.write(TRAILER.pack(len(self.blocks), len(ids), self.total, self.at, MAGIC))
        self.out.close()
        return len(ids), self.total


class IdReader:
    """Random access to a file's ids."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n_blocks, n_docs, self.total, footer, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        head, version, self.bits, self.block = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if (magic, head, version) != (MAGIC, MAGIC, 1):
            raise ValueError(f"not a file of packed ids: {uri}")
        self.end = footer
        tables = self.file.read_at(size - TRAILER.size - footer, footer)
        cut = np.cumsum([8 * n_blocks, 8 * n_docs, n_docs])
        self.blocks = np.frombuffer(tables[: cut[0]], np.uint64)
        self.doc_ids = np.frombuffer(tables[cut[0]: cut[1]], np.int64)
        self.nulls = np.frombuffer(tables[cut[1]: cut[2]], np.uint8).astype(bool)
        self.starts = np.frombuffer(tables[cut[2]:], np.uint64).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``, by the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.blocks[first])
        end = int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else self.end
        data, parts = self.file.read_at(end - begin, begin), []
        for k in range(first, last + 1):
            n = min(self.block, self.total - k * self.block)
            at = int(self.blocks[k]) - begin
            parts.append(unpack(data[at: at + (n * self.bits + 7) // 8], self.bits, n))
        return np.concatenate(parts)[start - first * self.block: stop - first * self.block]


class Encoder:
    """The tokenizers library, asked once for each distinct piece; whole texts where pieces are not simple."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache = P.PieceIds(self._ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by ``end_id``, and the sizes of the rows."""
        column = column.fill_null("")
        simple = P.simple_rows(column)
        rows: list[np.ndarray | None] = [None] * len(column)
        data, offsets = C.flat(column.filter(pa.array(simple)))
        starts, ends = P.pieces(data, offsets, spaced=True)
        ids, size = self.cache.ids(data, starts, ends) if len(starts) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        per_piece = np.concatenate(([0], np.cumsum(size)))
        bound = per_piece[np.searchsorted(starts, offsets)]
        for r, a, b in zip(np.flatnonzero(simple).tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            rows[r] = ids[a:b]
        for r in np.flatnonzero(~simple).tolist():
            rows[r] = np.array(self._ids([column[r].as_py()])[0], np.uint32)
        end = np.array([end_id], np.uint32)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        return np.concatenate([x for row in rows for x in (row, end)]) if rows else np.empty(0, np.uint32), sizes


def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, end_id: int, bits: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    uri = f"{folder}/part-{part:06d}-{context.taskAttemptId() if context else 0}.ids"
    encoder, writer = Encoder(path), None
    for batch in (s for whole in batches for s in C.slices([whole])):
        writer = writer or IdWriter(uri, bits)
        ids, sizes = encoder.encode(batch.column("text"), end_id)
        writer.add(batch.column("doc_id").to_pylist(), ids, sizes)
    if writer:
        n_docs, n_ids = writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
            reader = IdReader(uri)
            for at in range(0, len(reader.doc_ids), READ_DOCS):
                to = min(at + READ_DOCS, len(reader.doc_ids))
                starts, crc = reader.starts[at: to + 1], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    crc.append(zlib.crc32(reader.read(a, b).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.doc_ids[at:to], pa.int64(), mask=reader.nulls[at:to]), "start": pa.array(starts[:-1] + base, pa.int64()),
                    "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, vocabulary: int | None = None) -> DataFrame:
    """Writes the documents' ids as files in the shared folder; gives their manifest.

    ``part, uri, n_docs, n_ids, base``: ``base`` is the number of ids in the files before.
    """
    spark = docs.sparkSession
    if vocabulary is None:
        vocabulary = max(Encoder(tokenizer_path).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    bits = bits_for(vocabulary)
    scratch = Scratch(spark, "ids")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    spread = C.documents(docs).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    folder = scratch.path("files")
    files = scratch.save(
        spread.mapInArrow(lambda batches: _write(batches, tokenizer_path, folder, end_id, bits), "part int, uri string, n_docs long, n_ids long"), "manifest",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    n = manifest.count()
    spread = manifest.select("uri", "base").repartition(max(1, min(n, 20_000)), "uri")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_ids(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(manifest)
