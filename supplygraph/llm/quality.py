"""Quality rules: a chain CRF labels the lines of a document as content or boilerplate.

Each line that has a word is one place of the chain and is described by binary
features of its characters, words and repeats. Viterbi decoding labels the
lines; the share of words in content lines decides whether the document stays.
The field is trained on lines of labelled documents (``labels.quality``: each
line takes its document's label), a bounded sample of at most ``TRAIN_DOCS``
documents and ``TRAIN_LINES`` lines each. Counts and decisions cover all rows
and whole texts, in one narrow pass.

Defined results: a null or empty text has no words and fails the base rule;
lines without a word take no part; equal rows each get a row; a document with
null id is judged like any other; without labels (or with labels of one kind
only) nothing is known about lines and only the base rule rejects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph.llm import common as C
from supplygraph.llm.crf import ChainCrf

#: Bounds of the training sample: labelled documents of each label, and lines of one document.
TRAIN_DOCS = 600
TRAIN_LINES = 50
#: Least share of words in content lines.
CONTENT_SHARE = 0.5
#: Bytes of text measured at once: a worker keeps some 60 times as much, also while later jobs run.
SLICE_BYTES = 250_000
#: Base rule.
LEAST_WORDS = 50
MOST_REPEATED = 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, LOWER, DIGIT, MARK = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
LOWER[97:123] = True
DIGIT[48:58] = True
MARK[list(b"!?=_/\\{}[]~^+@")] = True

#: Bounds of the bins of each measured share of a line.
BINS = {
    "symbols": (0.001, 0.03, 0.1, 0.3), "upper": (0.001, 0.1, 0.3, 0.6), "digits": (0.001, 0.1, 0.3),
    "marks": (0.001, 0.03, 0.1), "distinct": (0.1, 0.3, 0.5, 0.7, 0.999), "repeated": (0.001, 0.2, 0.5, 0.8),
    "words": (2, 4, 8, 20, 60), "dup": (0.5,), "word_length": (3.0, 4.0, 6.0, 9.0),
}
N_FEATURES = 1 + sum(len(v) + 1 for v in BINS.values())


class Measured:
    """Counts by document and features by line for a slice of texts."""

    def __init__(self, column: pa.Array):
        words = C.Words(column)
        data, offsets, n_rows = words.data, words.offsets, len(column)
        hashes, row_of = words.hashes(), words.rows()
        self.n_words = words.counts
        at = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        by_row = lambda total: total[offsets[1:]] - total[offsets[:-1]]
        points = at(words.inside & ((data & 0xC0) != 0x80))
        symbols = at(SYMBOLS[data])
        self.word_chars, self.n_symbols = by_row(points), by_row(symbols)

        # words in 3-word windows found twice or more in the same text
        grams = C.gram_hashes(hashes, 3)
        inner = np.flatnonzero(row_of[:-2] == row_of[2:]) if len(row_of) > 2 else np.empty(0, np.int64)
        key = C.mixed(grams[inner] + C.mixed(row_of[inner].astype(np.uint64)))
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        again = inner[size[group.reshape(-1)] > 1]
        repeated = C.covered(len(hashes), again, again + 3)
        self.n_repeat_words = np.bincount(row_of, repeated, n_rows).astype(np.int64)

        # lines: split at \n and at the ends of rows
        cut = np.flatnonzero(data == 10)
        begin = np.sort(np.concatenate((offsets[:-1], cut + 1)), kind="stable")
        end = np.sort(np.concatenate((cut, offsets[1:])), kind="stable")
        line_row = self._line_rows(cut, offsets, n_rows)
        first, last = np.searchsorted(words.starts, begin), np.searchsorted(words.starts, end)
        full = last > first
        begin, end, line_row, first, last = begin[full], end[full], line_row[full], first[full], last[full]
        content = C.span_hashes(data, begin, end)
        key = C.mixed(content + C.mixed(line_row.astype(np.uint64)))
        _, seen, group = np.unique(key, return_index=True, return_inverse=True)
        dup = np.arange(len(key)) != seen[group.reshape(-1)]
        self.n_dup_lines = np.bincount(line_row, dup, n_rows).astype(np.int64)
        self.lines = np.bincount(line_row, minlength=n_rows)
        self.line_words = last - first
        self.line_row = line_row

        size = np.maximum(end - begin, 1)
        share = lambda total: (total[end] - total[begin]) / size
        upper, letters = at(UPPER[data]), at(UPPER[data] | LOWER[data])
        line_of = np.repeat(np.arange(len(first)), self.line_words)
        key = C.mixed(hashes + C.mixed(line_of.astype(np.uint64))) if len(line_of) == len(hashes) else C.mixed(hashes)
        distinct = np.bincount(line_of[np.unique(key, return_index=True)[1]], minlength=len(first))
        measured = {
            "symbols": share(symbols), "upper": (upper[end] - upper[begin]) / np.maximum(letters[end] - letters[begin], 1),
            "digits": share(at(DIGIT[data])), "marks": share(at(MARK[data])), "distinct": distinct / np.maximum(self.line_words, 1),
            "repeated": (at(repeated)[last] - at(repeated)[first]) / np.maximum(self.line_words, 1), "words": self.line_words, "dup": dup,
            "word_length": (points[end] - points[begin]) / np.maximum(self.line_words, 1),
        }
        self.features = np.zeros((len(first), N_FEATURES), np.float32)
        self.features[:, 0] = 1
        base, every = 1, np.arange(len(first))
        for name, bounds in BINS.items():
            self.features[every, base + np.searchsorted(bounds, measured[name], "right")] = 1
            base += len(bounds) + 1

    @staticmethod
    def _line_rows(cut: np.ndarray, offsets: np.ndarray, n_rows: int) -> np.ndarray:
        """Row of each line in order: a row has one line more than it has line feeds."""
        feeds = np.searchsorted(cut, offsets)
        return np.repeat(np.arange(n_rows), np.diff(feeds) + 1)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(batches: Iterator[pa.RecordBatch], field: ChainCrf | None) -> Iterator[pa.RecordBatch]:
    for batch in (s for whole in batches for s in C.slices([whole], limit=SLICE_BYTES)):
        m = Measured(batch.column("text"))
        share = np.ones(batch.num_rows)
        if field is not None:
            content = field.viterbi(m.features, m.lines)
            good = np.bincount(m.line_row, m.line_words * content, batch.num_rows)
            share = np.divide(good, m.n_words, out=share, where=m.n_words > 0)
        added = {c: pa.array(getattr(m, c), pa.int64()) for c in COUNTS} | {"content_share": pa.array(share, pa.float64())}
        yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a document's first ``TRAIN_LINES`` lines, for training only."""
    for batch in (s for whole in batches for s in C.slices([whole], limit=SLICE_BYTES)):
        m = Measured(batch.column("text"))
        ends = np.cumsum(m.lines)
        rows = [m.features[e - n: e][:TRAIN_LINES].astype(np.int8).tobytes() for e, n in zip(ends, m.lines, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.binary())], names=["quality", "lines"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> ChainCrf | None:
    """The field learnt from at most ``most`` documents of either quality, chosen by a hash of their id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    sample = C.documents(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("quality", "text")
    rows = sample.mapInArrow(_lines, "quality int, lines binary").limit(4 * most).collect()
    rows = sorted((r.quality, bytes(r.lines)) for r in rows if r.lines)
    if len({q for q, _ in rows}) < 2:
        return None
    parts = [np.frombuffer(b, np.int8).reshape(-1, N_FEATURES) for _, b in rows]
    lengths = np.array([len(p) for p in parts])
    truth = np.repeat([q for q, _ in rows], lengths)
    return ChainCrf(N_FEATURES).fit(np.concatenate(parts).astype(float), truth, lengths)


def judge(docs: DataFrame, field: ChainCrf | None) -> DataFrame:
    """All rows and columns of ``docs`` (as ``row``) with the counts and ``kept``."""
    state = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    kind = f"{state._jdf.schema().toDDL()}, {', '.join(f'{c} long' for c in COUNTS)}, content_share double"
    failed = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"
    judged = state.mapInArrow(lambda batches: _judge(batches, field), kind)
    return judged.withColumn("base_failed", F.expr(failed)).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= CONTENT_SHARE))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = judge(docs, train(docs, labels)).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(C.table(spark, sf_dir, "documents"))
    judged = judge(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", *COUNTS, "base_failed", "kept", "content_share")
