"""Alignment beside a walk over both tokenizations by the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from supplygraph.llm import align
from supplygraph.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "▁", "a ▁ b", "word", "The quick brown fox's 12 jumps\n\n  over <|endoftext|> and </s> <0x0A>.", "naïve façade 日本語テキスト 😀👍🏽 \x00 x",
    "same text", "same text", "z" * 3000, "    indented\n\tcode = {}\r\n", "ᚠᛇᚻ᛫ " * 40,
]


def texts(n=60):
    draw = random.Random(3)
    return TEXTS + ["".join(draw.choice("abc  \n▁é日😀<|>s0'.,") for _ in range(draw.randint(1, 120))) for _ in range(n)]


def brute(all_texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {s: k for k, s in enumerate(byte_symbols())}
    out, links_of = [], []
    for text in all_texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append([0, 0, 0, 0, ""])
            links_of.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        begins_a, begins_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        links = [(x, y) for i, x in enumerate(ids_a) for j, y in enumerate(ids_b) if begins_a[i] < ends_b[j] and begins_b[j] < ends_a[i]]
        written, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            written.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            i, j = i2, j2
        out.append([len(ids_a), len(ids_b), len(written), len(links), hashlib.sha256(";".join(written).encode()).hexdigest()])
        links_of.append(links)
    counts = Counter(p for links in links_of for p in set(links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (*r[:4], sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), r[4]) for r, links in zip(out, links_of, strict=True)
    ]


def test_figures_equal_brute_force(spark, documents):
    given = texts()
    rows = [(k if k != 4 else None, t) for k, t in enumerate(given)]
    got = {r.doc_id: tuple(r)[1:] for r in align.alignment_figures(documents(rows).repartition(3), A, B).collect()}
    want = {k: w for (k, _), w in zip(rows, brute(given), strict=True)}
    assert got == want


def test_small_slices_and_pieces_change_nothing(spark, documents, monkeypatch):
    given = texts(20)
    one = align.Aligner(A, B)
    whole = align.Slice(pa.array(given, pa.string()), one)
    for piece in (1, 2, 7, 64):
        cut = align.overlaps(whole.ends_a, whole.ends_b, piece)
        assert [c.tolist() for c in cut] == [c.tolist() for c in (whole.link_a, whole.link_b, whole.last_a, whole.last_b)]


@pytest.mark.parametrize("seed", range(20))
def test_merge_path_splits_like_a_sorted_merge(seed):
    draw = np.random.default_rng(seed)
    a, b = (np.unique(draw.integers(0, 60, draw.integers(0, 40))) for _ in range(2))
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    diagonals = np.arange(len(merged) + 1)
    assert align.merge_path(a, b, diagonals).tolist() == [sum(kind == 0 for _, kind in merged[:d]) for d in diagonals.tolist()]


def test_groups_hold_all_tokens_and_bytes(spark, documents):
    given = [t for t in texts(10)]
    rows = align.groups(documents(list(enumerate(given))), A, B).collect()
    one = align.Aligner(A, B)
    for k, text in enumerate(given):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        if text and "▁" not in text:
            raw = (" " + text).encode()
            assert [r.start for r in own] == [0, *[r.end for r in own[:-1]]] and own[-1].end == len(raw)
            for r in own:
                assert b"".join(one.a.spelling[i] for i in r.a_ids) == raw[r.start: r.end] == b"".join(one.b.spelling[i] for i in r.b_ids)
        else:
            assert not own


def test_empty_table(spark, documents):
    assert align.alignment_figures(documents([]), A, B).collect() == []
    assert align.alignment_figures(documents([(1, None), (None, "")]), A, B).count() == 2
