"""Substring dedup beside a brute-force count of all windows."""

import collections
import hashlib
import random
import re

import pytest

from supplygraph.llm.substrings import WINDOW, remove_repeats


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i: i + WINDOW]) for w in words for i in range(len(w) - WINDOW + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i: i + WINDOW])] > 1:
                gone.update(range(i, i + WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus():
    rnd = random.Random(1)
    bank = [[rnd.choice("abcdefghijklmnopqrs") + str(rnd.randrange(30)) for _ in range(120)] for _ in range(6)]
    texts = [None, "", "a b c", " ".join(["x"] * 80), "\n".join(["y"] * 35), "é\x0bü " * 40]
    for _ in range(120):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            if rnd.random() < 0.6:
                passage, at = rnd.choice(bank), rnd.randrange(90)
                words += passage[at: at + rnd.randrange(20, 60)]
            else:
                words += [str(rnd.random()) for _ in range(rnd.randrange(40))]
        texts.append(rnd.choice([" ", "\n", "  "]).join(words))
    return texts + texts[6:10]


@pytest.mark.parametrize("group_max", [2_000, 3])
def test_all_windows_are_found_whatever_the_size_of_a_part(documents, group_max):
    texts = corpus()
    ids = [None if i % 17 == 0 else i // 2 for i in range(len(texts))]
    got = remove_repeats(documents(list(zip(ids, texts, strict=True))), group_max=group_max)
    assert got.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
    assert rows == sorted((i is None, i or 0, *b) for i, b in zip(ids, brute(texts), strict=True))


def test_empty_table(documents):
    assert remove_repeats(documents([])).count() == 0
