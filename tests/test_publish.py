import random

from supplygraph.operators import publish as P
from supplygraph.operators.history import with_previous

COLS = "package string, version string, published_at long, publisher string, has_install_script boolean, repository string"


def feed(spark, n=400, seed=1, hot=0.5):
    """A random feed where one package and one account make half of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        busy = rng.random() < hot
        t = 1_700_000_000 + rng.randrange(40 * 86400) // (1 if rng.random() < 0.5 else 400)
        rows.append(("hot" if busy else f"p{rng.randrange(20)}", f"1.{i}.0", t, "bot" if rng.random() < hot else f"u{rng.randrange(5)}",
                     rng.random() < 0.3, rng.choice([None, "github:a/b", "https://github.com/a/b", "github:c/d"])))
    return rows, spark.createDataFrame(rows, COLS)


def test_previous_across_slices(spark):
    rows, df = feed(spark)
    got = {r.version: (r.seq, r.previous.version if r.previous else None) for r in with_previous(df, "package", "published_at", "version", ["version"], 86400).collect()}
    want = {}
    for package in {r[0] for r in rows}:
        mine = sorted((r[2], r[1]) for r in rows if r[0] == package)
        for i, (_, v) in enumerate(mine):
            want[v] = (i + 1, mine[i - 1][1] if i else None)
    assert got == want


def test_burst_against_two_pointers(spark):
    rows, df = feed(spark)
    window, least = 3600, 3
    want = set()
    for package in {r[0] for r in rows}:
        mine = sorted((r[2], r[1]) for r in rows if r[0] == package)
        start, told = 0, set()
        for end in range(len(mine)):
            while mine[end][0] - mine[start][0] > window:
                start += 1
            if end - start + 1 >= least and start not in told:
                told.add(start)
                want.add((package, mine[end][1], mine[start][1], end - start + 1))
    got = {(r.package, r.version, r.start_version, r.n_versions) for r in P.publish_burst(df, window, least, width=7200).collect()}
    assert got == want and want


def test_correlated_burst_against_windows(spark):
    rows, df = feed(spark, 300, 7)
    window = 7200
    want = {}
    for who in {r[3] for r in rows}:
        mine = [(r[2], r[0]) for r in rows if r[3] == who]
        best = None
        for t, _ in mine:
            inside = [m for m in mine if t - window <= m[0] <= t]
            score = (len({p for _, p in inside}), len(inside), -t)
            if score[0] >= 3 and (best is None or score > best[0]):
                best = (score, min(m[0] for m in inside))
        if best:
            want[who] = (best[0][0], best[0][1], best[1], -best[0][2])
    got = {r.identity: (r.n_packages, r.n_artifacts, r.started_at, r.ended_at) for r in P.correlated_burst(df, window, 3, width=4 * 3600).collect()}
    assert got == want and want


def test_signals_compare_in_publish_order(spark, rows):
    df = spark.createDataFrame([
        ("a", "2.0.0", 100, "Ann", False, "github:o/r"), ("a", "1.9.1", 200, "eve", True, "git+https://github.com/o/r.git"),
        ("a", "2.1.0", 200 + 400 * 86400, "GitHub Actions", True, "github:o/new"), ("a", "2.2.0", 201 + 400 * 86400, "ann", True, None),
        ("a", "0.0.0", 0, "eve", True, None), ("b", "1.0.0", 5, "zed", True, None),
    ], COLS)
    maintainers = spark.createDataFrame([("a", "ANN")], "package string, username string")
    got = rows(P.signals(df, maintainers, horizon=None), "version", "signal")
    assert got == sorted([("1.9.1", "PUBLISHER_NOT_MAINTAINER"), ("1.9.1", "INSTALL_SCRIPT_ADDED"), ("2.1.0", "DORMANCY_BREAK"), ("2.1.0", "REPOSITORY_CHANGED"), ("2.2.0", "REPOSITORY_REMOVED"),
                          ("0.0.0", "PUBLISHER_NOT_MAINTAINER")][:5])


def test_horizon_limits_the_reported_version_only(spark, rows):
    now = 1_700_000_000
    df = spark.createDataFrame([("a", "1.0.0", now - 500 * 86400, "x", False, None), ("a", "1.1.0", now - 86400, "x", True, None)], COLS)
    got = rows(P.install_script_added(P.dated_history(df)).filter(P.is_recent(now)), "version", "witness")
    assert got == [("1.1.0", "1.0.0")]


def test_monorepo_release_is_cohesive(spark):
    scoped = [("@m/p%d" % i, "1.0.0", 1000 + i, "bot", False, None) for i in range(5)]
    spread = [("q%d" % i, "1.0.0", 1000 + i, "worm", False, f"github:o{i}/r") for i in range(4)]
    ci = [("c%d" % i, "1.0.0", 1000 + i, "GitHub Actions", False, None) for i in range(9)]
    got = {r.identity: r.verdict for r in P.correlated_burst(spark.createDataFrame(scoped + spread + ci, COLS)).collect()}
    assert got == {"bot": "release", "worm": "spread"}
