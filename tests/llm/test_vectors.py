"""Codes beside Lloyd rounds over all pairs, and the trees beside plain comparison."""

import hashlib

import numpy as np
import pytest

from supplygraph.llm import vectors as V

DDL = "vec_id long, embedding array<float>, label int, code string, n int"


def brute(rows, parts=4, entries=256, rounds=4):
    """vec_id -> (code, error, label_error), and the digest of the codebooks; ids are distinct and not null."""
    fine = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(np.float32(x)) for x in r[1])), key=lambda r: r[0])
    x = np.array([[int(np.floor(np.float64(np.float32(v)) * 1024)) for v in r[1]] for r in fine], np.int64)
    x = x.reshape(len(fine), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def nearest():
        far = [((x[:, p][:, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return [f.argmin(axis=1) for f in far], sum(f.min(axis=1) for f in far)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[at[p] == e, p]
                if len(own):
                    books[p][e] = own.sum(axis=0) // len(own)
    at, error = nearest()
    by_label = {}
    for r, e in zip(fine, error.tolist(), strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    codes = {r[0]: ("".join(f"{at[p][k]:02x}" for p in range(parts)), int(error[k]), by_label[r[2]]) for k, r in enumerate(fine)}
    return codes, hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def check(spark, rows, entries=256):
    df = spark.createDataFrame([(i, e, lab, "x", 1) for i, e, lab in rows], DDL).repartition(3)
    got = V.compress(df, entries=entries).collect()
    codes, digest = brute(rows, entries=entries)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == codes
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_equal_to_all_pairs(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 16))
    rows = [(int(k * 3), [float(v) for v in (centres[k % 12] + draw.normal(size=16) * 0.1).astype(np.float32)], int(k % 5) if k % 7 else None) for k in range(900)]
    rows += [(5000 + k, [float(v) for v in np.float32(centres[0])], 1) for k in range(300)]  # one very common vector
    check(spark, rows)


def test_ties_small_tables_and_rows_that_go(spark):
    draw = np.random.default_rng(2)
    rows = [(k, [float(v) / 1024 for v in draw.integers(-1, 2, 8)], k % 2) for k in range(60)]
    rows += [(100, None, 1), (101, [1.0, None] * 4, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, 0)]
    check(spark, rows, entries=8)
    check(spark, rows[:5], entries=8)


def test_odd_rows_have_defined_results(spark):
    ok = [0.5] * 8
    rows = [(None, ok, 1), (1, ok, None), (1, ok, None), (2, [0.5] * 4, 1), (3, [], 1), (4, [1e30] + [0.0] * 7, 1), (5, [0.25] * 8, None)]
    df = spark.createDataFrame([(i, e, lab, "x", 1) for i, e, lab in rows], DDL)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error) for r in V.compress(df).collect())
    assert got == [(-1, "00000000", 0, 0), (1, "00000000", 0, 0), (1, "00000000", 0, 0), (5, "02020202", 0, 0)]
    assert V.compress(spark.createDataFrame([], DDL)).collect() == []
    assert V.compress(spark.createDataFrame([(1, None, 1, "x", 1)], DDL)).collect() == []


def test_many_labels_by_salted_join(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    draw = np.random.default_rng(4)
    check(spark, [(k, [float(v) for v in draw.normal(size=8).astype(np.float32)], None if k % 3 else k % 4) for k in range(300)])


@pytest.mark.parametrize("seed", range(8))
def test_walk_assigns_like_plain_comparison(seed):
    draw = np.random.default_rng(seed)
    wide = 2**27 if seed % 4 == 3 else 1000  # beyond exact floats in one of four
    width = int(draw.integers(1, 6))
    centres = draw.integers(-wide, wide, (10, width))
    points = centres[draw.integers(0, 10, 700)] + draw.integers(-3, 4, (700, width))
    entries = points[draw.integers(0, 700, int(draw.integers(1, 70)))]
    far = ((points[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    tree = V.unpack_tree(V.pack_tree(V.Tree(points, V.LEAF)), len(points), width, V.LEAF)
    book = V.Codebook(entries)
    entry, error = V.assign(tree, book)
    assert entry.tolist() == [int(np.argmin(row)) for row in far.tolist()] and error.tolist() == [min(row) for row in far.tolist()]
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    V.add_up(tree, book, sums, counts)
    assert counts.tolist() == np.bincount(entry, minlength=len(entries)).tolist()
    assert all((sums[e] == points[entry == e].sum(axis=0)).all() for e in range(len(entries)))


def test_nodes_are_assigned_whole():
    points = np.repeat(np.array([[0, 0], [1000, 1000]]), 500, axis=0)
    found = list(V.walk(V.Tree(points, V.LEAF), V.Codebook(np.array([[1, 1], [999, 999]]))))
    assert all(e >= 0 for _, _, e, _ in found) and len(found) < 8
