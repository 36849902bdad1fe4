"""Encoders beside the tokenizers library; files of ids by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from supplygraph.llm import bpe, pretoken, token_files

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def texts():
    rnd = random.Random(3)
    alphabet = "ab's tré'lld ve\n\t  12!'X éß÷ÜÀ. m"
    out = [None, "", " ", "\n", " \n", "a \n b", "it's 'll", "'s", "x 's a'", "''s", "don't!'re 've", "<|endoftext|> aA", "日本 語 a İΣ", "\x1c a\x85b", "a\xa0b"]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 40))) for _ in range(3000)]
    out += ["".join(rnd.choice("inthaeréso") for _ in range(rnd.randrange(900, 4000))) for _ in range(20)]
    return out + ["a" * 5000, "ab" * 3000, "é" * 2000, "!" * 999]


@pytest.mark.parametrize("name", FILES)
def test_own_merges_match_the_library(name):
    own, library = bpe.Merger(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    ids, sizes = own.encode(pa.array(texts()))
    at = 0
    for text, n in zip(texts(), sizes.tolist(), strict=True):
        assert ids[at: at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
        at += n


def test_tokens_are_emitted_before_the_end_and_are_right():
    own = bpe.Merger(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(8)
    parts = [t for t in own.vocabulary if t.isalpha() and t.isascii()]
    for _ in range(5):
        word = "".join(rnd.choice(parts) for _ in range(900))
        taken, first = 0, None

        def symbols(word=word):
            nonlocal taken
            for c in word:
                taken += 1
                yield c

        out = []
        for token in own.stream(symbols()):
            first = first or taken
            out.append(token)
        assert first <= 2 * own.lookahead + 2 < len(word)
        assert out == own.merged(list(word))


def test_lookahead_of_a_chain_of_merges():
    # "ab" is made first; a "b" taken by it frees the "a" of "xa", and so on to the left
    merges = [("c", "d"), ("b", "c"), ("a", "b")]
    assert bpe.sufficient_lookahead(merges, {s: len(s) for m in merges for s in m}) == 3


def test_decoding_is_incremental_and_exact():
    own = bpe.Merger(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in texts()[:400] + ["😀 é日"]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        pieces = list(own.decode(ids))
        assert "".join(pieces) == (text or "") and len(pieces) == len(ids) + 1


def test_documents_are_digested_like_the_librarys(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rows = Tokenizer.from_file(path), list(enumerate(texts()[:300]))
    got = {r.doc_id: r for r in bpe.encode_documents(documents(rows), path).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(documents([]), path).count() == 0


def test_pieces_cover_simple_texts():
    rows = pa.array(["it's a  test\n\n x", "", "12 ab!'s  ", "é÷"])
    assert pretoken.simple_rows(rows).tolist() == [True, True, True, False]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert (token_files.unpack(packed, bits, len(ids)) == ids).all() and len(packed) == -(-1001 * bits // 8)


def test_random_access_to_a_file(tmp_path):
    rng = np.random.default_rng(1)
    ids, sizes = rng.integers(0, 50_257, 200_000).astype(np.uint32), np.array([0, 70_000, 1, 129_999])
    writer = token_files.IdWriter(str(tmp_path / "a.ids"), 17)
    writer.add([5, None, 6, 7], ids, sizes)
    assert writer.close() == (4, 200_000)
    reader = token_files.IdReader(str(tmp_path / "a.ids"))
    for a, b in [(0, 0), (0, 1), (65_535, 65_537), (131_071, 131_073), (199_999, 200_000), (10, 190_000)]:
        assert (reader.read(a, b) == ids[a:b]).all()
    assert reader.starts.tolist() == [0, 0, 70_000, 70_001, 200_000] and reader.nulls.tolist() == [False, True, False, False]


def test_files_hold_all_documents_in_order(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(9, "b c"), (2, None), (None, "x y"), (4, ""), (4, "It's <|endoftext|> 日本"), (4, "")]
    rows += [(100 + i, t) for i, t in enumerate(texts()[:200])]
    got = token_files.read_ids(token_files.write_ids(documents(rows), path)).orderBy("start").collect()
    crc = lambda t: zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, crc(t)) for i, t in rows)
    total = 0
    for r in got:
        assert r.start == total
        total += r.n_tokens
    assert token_files.read_ids(token_files.write_ids(documents([]), path)).count() == 0
