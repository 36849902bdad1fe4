import random

from pyspark.sql import functions as F

from supplygraph.functions import names as N
from supplygraph.functions import similarity as Y
from supplygraph.operators import typosquat as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").repartition(2).select(fn("x")).first()[0]


def test_npm_names(spark):
    good = {"LoDash": "lodash", " @Angular/Core ": "@angular/core", "a.b_c~d": "a.b_c~d"}
    for raw, want in good.items():
        assert one(spark, raw, N.npm_name) == want
    bad = {"": "empty", "_x": "leading dot or underscore", "@s/.x": "leading dot or underscore", "a b": "illegal character", "a/b": "not a name", "x" * 215: "too long", "é": "illegal character"}
    for raw, why in bad.items():
        assert one(spark, raw, N.npm_name) is None
        assert one(spark, raw, N.npm_name_problem) == why


def test_purl_round_trip(spark):
    for name, version in [("@angular/core", "1.0.0"), ("lodash", "4.17.21-rc.1+b"), ("@a@b/c", "1")]:
        df = spark.createDataFrame([(name, version)], "n string, v string").repartition(2).select(N.version_purl("n", "v").alias("p"))
        back = df.select(N.parse_purl("p").alias("q")).first().q
        assert (back.ecosystem, back.name, back.version) == ("npm", name, version)
    assert one(spark, "pkg:npm/%40a/b", N.parse_purl).version is None
    assert one(spark, "lodash@1", N.parse_purl) is None


def test_ecosystems_do_not_collide(spark):
    df = spark.createDataFrame([("requests",)], "n string")
    r = df.select(N.package_purl("n"), N.package_purl("n", F.lit("pypi"))).first()
    assert r[0] != r[1]


def test_repositories_spelled_many_ways(spark):
    same = ["github:a/b", "A/b", "git+https://github.com/A/b.git", "git://github.com/a/b.git#main", "ssh://git@github.com/a/b", "git@github.com:a/b.git", "https://github.com/a/b/"]
    assert {one(spark, s, N.repository_key) for s in same} == {"repo:github.com/a/b"}
    assert one(spark, "https://gitlab.com/g/sub/p", N.repository_key) == "repo:gitlab.com/g/sub"
    assert [one(spark, s, N.repository_key) for s in ("nope", "", "https://github.com/a")] == [None, None, None]


def test_times_and_globs(spark):
    assert one(spark, "2024-01-02T03:04:05.123456789Z", N.epoch_seconds) == 1704164645
    assert one(spark, "2024-01-02", N.epoch_seconds) == 1704153600
    assert [one(spark, s, N.epoch_seconds) for s in ("soon", "", None)] == [0, 0, 0]
    for path, glob, want in [("a/b/c.js", "a/*.js", True), ("ajs", "a.js", False), ("a1.js", "a[!2-9].js", True), ("x(1).js", "x(1).js", True)]:
        assert spark.createDataFrame([(path, glob)], "p string, g string").repartition(2).select(N.glob_match("p", "g")).first()[0] is want


def osa(a, b):
    d = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return min(d[-1][-1], 3)


def test_distance_against_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(160)]
    pairs = [(a, b) for a in words[:80] for b in words[80:]]
    got = spark.createDataFrame(pairs, "a string, b string").repartition(4).select("a", "b", Y.osa_distance("a", "b").alias("d")).collect()
    assert [(r.a, r.b, r.d, osa(r.a, r.b)) for r in got if r.d != osa(r.a, r.b)] == []


def test_variants_never_miss_a_near_pair(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 7))) for _ in range(120)})
    names = spark.createDataFrame([(w,) for w in words], "name string")
    found = {(r.candidate, r.target) for r in T.candidates(names, names).collect()}
    assert [(a, b) for a in words for b in words if a != b and osa(a, b) <= 2 and (a, b) not in found] == []


def test_typosquat_rules(spark, rows):
    popular = spark.createDataFrame([("lodash", 50_000_000), ("express", 30_000_000), ("cross-env", 5_000_000), ("@types/lodash", 9_000_000), ("@angular/core", 4_000_000)], "name string, downloads long")
    names = spark.createDataFrame(
        [("lodahs", 3), ("lodashh", 3), ("crossenv", 10), ("l0dash", 1), ("lodash.merge", 5), ("@nestjs/lodash", 4), ("@typos/lodash", 4), ("expresss", None), ("express2", 29_000_000), ("@x/expres", 1), ("abc", 1)],
        "name string, downloads long",
    )
    got = {(c, t): k for c, t, k in rows(T.edges(names, popular), "candidate", "target", "technique")}
    assert got == {
        ("lodahs", "lodash"): "transposition", ("lodashh", "lodash"): "repeated_char", ("crossenv", "cross-env"): "separator",
        ("l0dash", "lodash"): "homoglyph", ("@typos/lodash", "@types/lodash"): "scope_confusion",
    }
