"""Quality counts, the chain CRF and decontamination beside brute force."""

import collections
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from supplygraph.llm import decontaminate, quality
from supplygraph.llm.crf import ChainCrf

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams, marked = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k: k + 3])] > 1:
            marked |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_counts():
    rnd = random.Random(1)
    texts = [None, "", "\n", "a\n\n", "a\na\n", "\na", "é ü\né ü\n\x0b\n x", "a b c a b c"]
    texts += ["".join(rnd.choice("ab \n#é\t") for _ in range(rnd.randrange(60))) for _ in range(500)]
    m = quality.Measured(pa.array(texts))
    got = list(zip(*[getattr(m, c).tolist() for c in quality.COUNTS], strict=True))
    assert got == [counts(t) for t in texts]


def test_viterbi_and_training():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1, 4, 2])
    x = (rng.random((15, 4)) < 0.5) * 1.0
    y = (x[:, 0] > 0).astype(int)
    field = ChainCrf(4).fit(x, y, lengths)
    assert (field.viterbi(x, lengths) == y).all()
    for seed in range(5):
        rng = np.random.default_rng(seed)
        field.weights, field.step = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
        got, at = field.viterbi(x, lengths), 0
        for n in lengths:
            s = field.scores(x[at: at + n])
            best = max(itertools.product([0, 1], repeat=int(n)), key=lambda z, s=s, n=n: sum(s[i, z[i]] for i in range(n)) + sum(field.step[z[i - 1], z[i]] for i in range(1, n)))
            assert list(best) == list(got[at: at + n])
            at += n


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(docs, field).select("row.doc_id", "base_failed", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged]) >= 0.98
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_quality_of_odd_tables(documents, spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = documents([(1, None), (None, text), (2, text), (2, text), (3, "a " * 60)])
    labels = spark.createDataFrame([(2, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(df, labels) is None
    assert sorted((r.doc_id or 0, r.source) for r in quality.keep_good(df, labels).collect()) == [(0, "s1"), (2, "s2"), (2, "s3")]
    assert quality.keep_good(documents([]), labels).count() == 0


def hit(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(i, w[k: k + min(window, len(w))]) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for t in texts:
        w, marked, found = words(t), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if w[k: k + len(g)] == g:
                    marked.update(range(k, k + len(g)))
                    if i is not None:
                        found.add(i)
        out.append((len(w), len(marked), sorted(found)))
    return out


def test_decontamination(documents, spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdé") + rnd.choice(["", "1", "B"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 10, 25])))) for i in range(25)] + [(None, "zz yy xx"), (7, None), (30, "A-b, c!")]
    texts = [None, "", "a b c"]
    for _ in range(120):
        w = [word() for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            source = (rnd.choice(items)[1] or "").split()
            w += source[rnd.randrange(len(source) + 1):][: rnd.randrange(30)]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(w))
    texts += texts[5:8]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = hit(texts, items)
    for block_bytes in (decontaminate.BLOCK_BYTES, 60):
        found = decontaminate.matches(documents(list(enumerate(texts))), benchmark, block_bytes=block_bytes)
        rows = {r.doc_id: r for r in found.collect()}
        digest = {r.doc_id: r for r in decontaminate.digest(found).collect()}
        for i, (n, h, its) in enumerate(want):
            assert (rows[i].n_words, sorted(set(rows[i]["items"])), digest[i].n_hit, digest[i].contaminated) == (n, its, h, h > 0), (i, texts[i])
    kept = decontaminate.remove_contaminated(documents(list(enumerate(texts))), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w[1]]
    assert kept.columns[-1] == "row" and decontaminate.remove_contaminated(documents([]), benchmark).count() == 0


def test_longest_matches_are_maximal(documents, spark):
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    text = "x y " + " ".join(f"w{i}" for i in range(5, 22)) + " z"
    row = decontaminate.matches(documents([(4, text)]), benchmark).first()
    best = max(row.longest, key=lambda m: m.length)
    assert (best.item_id, best.item_start, best.start, best.length) == (1, 5, 2, 17)


def test_measuring_takes_a_bounded_part_of_a_batch():
    text = "\n".join(" ".join(f"word{i * j % 97}" for i in range(40)) for j in range(14))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 1_000)], names=["text"])
    list(quality._judge(iter([batch.slice(0, 2)]), None))
    tracemalloc.start()
    n = sum(out.num_rows for out in quality._judge(iter([batch]), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000 and peak < 40e6
