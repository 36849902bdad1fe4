"""BagMinHash estimates, exact overlap, and classes beside all pairs."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from supplygraph.llm import near


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter([tuple(w[i: i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))


def similarity(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_estimate_the_weighted_similarity():
    rnd = random.Random(1)
    left, right = [], []
    for _ in range(40):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.choice([3, 30, 300, 1500]))] + ["x"] * rnd.choice([0, 50, 600])
        other = list(words)
        for _ in range(rnd.randrange(12)):
            other[rnd.randrange(len(other))] = "z"
        left.append(" ".join(words))
        right.append(" ".join(other))
    truth = np.array([similarity(a, b) for a, b in zip(left, right, strict=True)])
    assert np.allclose(near.overlap(pa.array(left), pa.array(right)), truth)
    one, two = (near.signatures(near.Bags(pa.array(t))) for t in (left, right))
    error = (one == two).mean(axis=1) - truth
    assert np.abs(error).max() < 5 * np.sqrt(0.25 / near.SIZE) and abs(error.mean()) < 0.01


def test_a_signature_does_not_depend_on_its_slice():
    texts = ["a b c d e f g", "x " * 30, "a b", ""]
    whole = near.signatures(near.Bags(pa.array(texts)))
    for i, t in enumerate(texts):
        assert (near.signatures(near.Bags(pa.array([t])))[0] == whole[i]).all()


def corpus():
    rnd = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a b"), (3, "a  b"), (4, " ")]
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(9)) for _ in range(rnd.randrange(5, 150))] for _ in range(20)]
    for i in range(5, 200):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = str(rnd.random())
        rows.append((i, " ".join(words)))
    return rows


def family():
    """Texts a little more or less similar to one another than the threshold, with long and repeated ones among them."""
    rnd = random.Random(6)
    base = [rnd.choice("abcdefghij") + str(rnd.randrange(9)) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base) * rnd.choice([1, 1, 1, 1, 1, 2])
        for _ in range(rnd.randrange(1, 5)):
            words[rnd.randrange(len(words))] = str(rnd.randrange(40))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("rows", "block"), [(corpus(), 256), (family(), 16)], ids=["corpus", "family"])
def test_classes_match_all_pairs(documents, monkeypatch, rows, block):
    monkeypatch.setattr(near, "BLOCK_TEXTS", block)
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(bags):
        for y, b in enumerate(bags[:x]):
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                parent[max(top(x), top(y))] = min(top(x), top(y))
    want = {rows[x][0]: rows[top(x)][0] for x in range(len(rows))}
    found = near.representatives(documents(rows)).collect()
    assert {r.key_id: r.class_id for r in found} == want
    assert {r.key_id for r in found if r.stays} == set(want.values())


def test_bridges_join_the_classes_that_the_overlaps_join():
    rows = family()[:60]
    for sides in ([0] * 60, [k % 2 for k in range(60)]):
        group = pa.table({
            "b1": list(range(60)), "b2": [0] * 60, "r1": [k // 2 for k in range(60)], "r2": [0] * 60,
            "side": sides, "text": [t for _, t in rows],
        })
        parent = [k // 2 for k in range(60)]
        links = [(a, c) for a in range(60) for c in range(a) if (sides == [0] * 60 or sides[a] != sides[c]) and similarity(rows[a][1], rows[c][1]) >= 0.8]
        found = near.bridges(group, 0.8).to_pylist()
        assert {(max(r["a1"], r["c1"]), min(r["a1"], r["c1"])) for r in found} <= set(links) and len(found) < 30

        def joined(pairs):
            label = list(parent)
            for a, c in pairs:
                x, y = sorted((label[a], label[c]))
                label = [x if v == y else v for v in label]
            return [label.index(v) for v in label]

        assert joined([(r["a1"], r["c1"]) for r in found]) == joined(links)


def test_one_of_each_class_stays_with_its_columns(documents):
    text = "one two three four five six seven"
    df = documents([(7, text), (7, text), (3, text), (None, text), (9, ""), (9, "")])
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, text), (9, ""), (9, "")]
    assert near.keep_one(documents([])).count() == 0
