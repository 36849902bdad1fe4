"""Base spans beside Python's own matching; the models on strings held out."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from supplygraph.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans(documents):
    rnd = random.Random(5)
    bits = ["token", "=", " ", '"', "api_key", "apikey: ", "Secret", "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abcdef", "é", "😀", "\n", "x/y+z", "token=secret=abc", "password: "]
    texts = [None, "", "token: token: abcdefgh", "passſword=abcdefg"] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(800)]
    found = secrets.scan(documents(list(enumerate(texts))), [0.0] * secrets.CLASSES**2)
    got = {r.doc_id: r for r in found.select("doc_id", secrets.listed(secrets.KINDS[:3]).alias("s"), F.sha2(secrets.listed(secrets.KINDS[:3]), 256).alias("h")).collect()}
    for i, text in enumerate(texts):
        assert got[i].s == brute(text), text
        assert got[i].h == hashlib.sha256(brute(text).encode()).hexdigest()


def test_models_tell_random_strings_from_identifiers(documents):
    rnd = random.Random(6)
    plain = "the internationalization of documentation requires understanding because applications throughout organisations "
    hexa = lambda n, a="0123456789abcdef": "".join(rnd.choice(a) for _ in range(n))
    rows = [(i, f'{plain} token = "{hexa(40)}" {plain}') for i in range(60)]
    base62 = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    secret = [hexa(32, base62) for _ in range(40)]
    ordinary = [f"{a}_{b}_for_{c}{rnd.randrange(10)}" for a in ("document", "application") for b in ("requires", "organisations") for c in ("understanding", "internationalization")]
    rows += [(100 + i, f"é see {s} there") for i, s in enumerate(secret)] + [(200 + i, f"é see {s} there") for i, s in enumerate(ordinary)]
    got = {r.doc_id: r.markov for r in secrets.scan(documents(rows)).collect()}
    hits = [i for i in range(40) if [(m.start, m.value) for m in got[100 + i]] == [(6, secret[i])]]
    assert len(hits) >= 38
    assert not any(got[200 + i] for i in range(len(ordinary))) and not any(got[i] for i in range(60))


def test_no_python_and_empty_tables(documents):
    found = secrets.scan(documents([(1, "a")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert secrets.scan(documents([])).count() == 0


def test_strings_without_digits_short_ones_and_ones_within_paths(documents):
    rnd = random.Random(9)
    plain = "the internationalization of documentation requires understanding because applications throughout organisations home projects configuration "
    random_of = lambda n, a: "".join(rnd.choice(a) for _ in range(n))
    letters = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
    rows = [(i, f'{plain} token = "{random_of(40, letters + "0123456789")}" {plain}') for i in range(60)]
    cases = {"letters": (32, letters, ""), "short": (16, letters + "0123456789", ""), "path": (32, letters + "0123456789", "/home/user/projects/documentation/configuration/understanding/applications/")}
    keys = {(k, name): (f"see {before}{key} there", 4 + len(before), key) for name, (n, a, before) in cases.items() for k in range(20) for key in [random_of(n, a)]}
    at = {500 + i: k for i, k in enumerate(keys)}
    rows += [(i, keys[k][0]) for i, k in at.items()]
    got = {r.doc_id: [(m.start, m.value) for m in r.markov] for r in secrets.scan(documents(rows)).collect()}
    for name in cases:
        hits = sum(any(m.startswith(key) or key in m for s, m in got[i]) and any(s <= start <= s + len(m) for s, m in got[i]) for i, k in at.items() if k[1] == name for _, start, key in [keys[k]])
        assert hits >= 18, (name, hits)
    assert not any(got[i] for i in range(60))
