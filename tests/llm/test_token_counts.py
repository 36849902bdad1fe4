"""Counts beside the sentencepiece library."""

import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from supplygraph.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", None, " ", "   ", "▁", "▁▁ ▁", "\n", "\x00", "<s></s><unk><0x0A>", " lead", "trail  ", "a" * 5000, " " * 3000, "日" * 2000, "tab\tand\r\nlines\n\n\nof   blanks",
    "naïve façade", "кириллица العربية ᚠᛇᚻ 😀👍🏽 é", "x" * 20_000 + " " + "ab" * 20_000,
]


def test_equal_to_the_library(spark, documents):
    draw = random.Random(7)
    letters = "abcde  \n\t▁éßñ日本<0xA>/s😀‍\x00ـкл12.,;'\"-_=+"
    texts = HARD + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 200))) for _ in range(400)]
    texts += ["".join(chr(draw.choice([draw.randint(32, 0x2FFF), draw.randint(0x3000, 0xD7FF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(60)) for _ in range(100)]
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)] + [(4, "   ")]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows)
    got = token_counts.count_tokens(documents(rows), MODEL).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == want


def test_ids_of_segments_equal_the_library():
    model, library = token_counts.pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in HARD:
        if text:
            assert model.tokens(" " + text.replace("▁", " ")) == library.encode(text)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 20)
    counter, library = token_counts.Counter(token_counts.pieces(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(6):
        texts = [f"some words {k} {j} and more" for j in range(30)]
        assert counter.rows(pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts]


def test_limit_and_empty_table(spark, documents):
    got = token_counts.count_tokens(documents([(1, "a b c"), (2, "")]), MODEL, limit=2).collect()
    assert {r.doc_id: r.over_limit for r in got} == {1: True, 2: False}
    assert token_counts.count_tokens(documents([]), MODEL).collect() == []
