import random
from collections import deque

from pyspark.sql import functions as F

from supplygraph import session
from supplygraph.operators import advisories as A
from supplygraph.operators import build as B
from supplygraph.operators import findings as G
from supplygraph.operators import reach as R
from supplygraph.operators import views as W
from supplygraph.operators.fixpoint import components, condensed_reach, members_reached, reach, rendered, shortest_paths, witness_forest
from supplygraph.plans.domain import Fleet


def walk(roots, edges):
    """(pv) -> (depth, dev_only) of one lockfile by two plain searches."""
    out = {}
    for flag in (False, True):
        queue = deque((r, 1) for r, dev in roots if dev == flag)
        seen = {}
        while queue:
            node, depth = queue.popleft()
            if node not in seen:
                seen[node] = depth
                queue.extend((b, depth + 1) for a, b in edges if a == node)
        for node, depth in seen.items():
            old = out.get(node)
            out[node] = (min(depth, old[0]) if old else depth, (old[1] if old else True) and flag)
    return out


def test_closure_against_search_on_cyclic_graphs(spark, scratch):
    rng = random.Random(2)
    roots, edges, want = [], [], {}
    for lock in range(6):
        nodes = [f"p{i}" for i in range(12)]
        mine = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(18)})
        mine = [(a, b) for a, b in mine if a != b]
        starts = [(n, rng.random() < 0.5) for n in rng.sample(nodes, 3)]
        roots += [(lock, f"s{lock}", 10, n, dev) for n, dev in starts]
        edges += [(lock, a, b) for a, b in mine]
        want.update({(lock, n): v for n, v in walk(starts, mine).items()})
    got = B.closure(
        spark.createDataFrame(roots, "lock_id int, service string, observed_at long, pv string, dev boolean"),
        spark.createDataFrame(edges, "lock_id int, src string, dst string"), scratch,
    )
    assert {(r.lock_id, r.pv): (r.depth, r.dev_only) for r in got.collect()} == want


def test_production_path_beats_dev_path(spark, scratch):
    roots = spark.createDataFrame([(1, "s", 10, "a", True), (1, "s", 10, "b", False)], "lock_id int, service string, observed_at long, pv string, dev boolean")
    edges = spark.createDataFrame([(1, "a", "c"), (1, "b", "x"), (1, "x", "c"), (1, "c", "d")], "lock_id int, src string, dst string")
    got = {r.pv: (r.depth, r.via_direct, r.dev_only) for r in B.closure(roots, edges, scratch).collect()}
    assert got == {"a": (1, "a", True), "b": (1, "b", False), "x": (2, "b", False), "c": (2, "a", False), "d": (3, "a", False)}


def lock(spark, entries):
    schema = "lock_id int, path string, service_name string, name string, version string, link boolean, dev boolean, " + ", ".join(
        f"{c} map<string,string>" for c in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"))
    blank = dict(service_name=None, name=None, version=None, link=False, dev=False, dependencies={}, devDependencies={}, optionalDependencies={}, peerDependencies={})
    cols = ["lock_id", "path", *blank]
    return spark.createDataFrame([tuple({**blank, "lock_id": 1, **e}[c] for c in cols) for e in entries], schema)


def test_nested_resolution(spark, rows):
    entries = lock(spark, [
        {"path": "", "service_name": "web", "dependencies": {"a": "1"}, "devDependencies": {"b": "1", "gone": "1"}},
        {"path": "packages/api", "service_name": "api", "dependencies": {"a": "1"}},
        {"path": "node_modules/a", "name": "a", "version": "1.0.0", "dependencies": {"b": "2", "c": "1"}},
        {"path": "node_modules/a/node_modules/b", "name": "b", "version": "2.0.0", "dependencies": {"c": "1"}},
        {"path": "node_modules/b", "name": "b", "version": "1.0.0"},
        {"path": "node_modules/c", "name": "c", "version": "3.0.0", "peerDependencies": {"b": "*"}},
        {"path": "node_modules/api", "link": True},
    ])
    got = rows(B.dependency_edges(entries).fillna("-"), "kind", "service", "src", "dst", "dep")
    p = "pkg:npm/"
    assert got == sorted([
        ("direct", "web", "-", p + "a@1.0.0", "a"), ("direct", "web", "-", p + "b@1.0.0", "b"), ("unresolved", "web", "-", "-", "gone"),
        ("unresolved", "api", "-", "-", "a"), ("transitive", "-", p + "a@1.0.0", p + "b@2.0.0", "b"), ("transitive", "-", p + "a@1.0.0", p + "c@3.0.0", "c"),
        ("transitive", "-", p + "b@2.0.0", p + "c@3.0.0", "c"), ("transitive", "-", p + "c@3.0.0", p + "b@1.0.0", "b"),
    ])
    hoisted = B.dependency_edges(entries, workspace_hoist=True).filter("service = 'api'")
    assert rows(hoisted, "kind", "dst") == [("direct", p + "a@1.0.0")]
    dev = {r.dep: r.dev for r in B.dependency_edges(entries).filter("kind = 'direct'").collect()}
    assert dev == {"a": False, "b": True}


def test_components_on_random_graphs_and_a_hub(spark, scratch):
    rng = random.Random(9)
    links = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)]
    links += [("hub", f"h{i:03d}") for i in range(200)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    want = {n: find(n) for n in list(parent)}
    got = components(spark.createDataFrame(links, "a string, b string"), scratch)
    assert {r.node: r.root for r in got.collect()} == want


def test_alias_ranking(spark, scratch):
    f = spark.createDataFrame([("GHSA-b", "CVE-2"), ("GHSA-b", "PYSEC-1"), ("OSV-9", "GHSA-b"), ("PYSEC-7", None)], "osv_id string, alias string")
    got = {r.id: r.canonical for r in A.alias_components(f, scratch).collect()}
    assert got == {"GHSA-b": "CVE-2", "CVE-2": "CVE-2", "PYSEC-1": "CVE-2", "OSV-9": "CVE-2", "PYSEC-7": "PYSEC-7"}


def test_shortest_paths_against_enumeration(spark, scratch):
    rng = random.Random(4)
    nodes = [f"v{i}" for i in range(9)] + ["svc:a", "svc:b"]
    edges = sorted({(rng.choice(nodes[:9]), rng.choice(nodes)) for _ in range(30)})
    edges = [(a, b) for a, b in edges if a != b]
    want = []

    def grow(path):
        if path[-1].startswith("svc:"):
            want.append(tuple(path))
        elif len(path) <= 6:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    grow([*path, b])

    for s in ("v0", "v1"):
        grow([s])
    best = {}
    for path in sorted(want, key=lambda p: (len(p), p)):
        best.setdefault((path[0], path[-1]), []).append(path)
    got = shortest_paths(
        spark.createDataFrame([("v0",), ("v1",)], "source string"), spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame([("svc:a",), ("svc:b",)], "node string"), scratch, 6, 3,
    ).collect()
    assert sorted(tuple(r.path) for r in got) == sorted(p for ps in best.values() for p in ps[:3])


def test_reach_terminates_on_cycles_and_respects_the_bound(spark, scratch):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 10}") for i in range(10)], "src string, dst string")
    seed = spark.createDataFrame([("n0",)], "node string")
    assert reach(seed, edges, [], scratch, 50).count() == 10
    assert reach(seed, edges, [], scratch, 4).agg(F.max("depth")).first()[0] == 4


def test_heat_decays_to_the_floor(spark, scratch):
    affects = spark.createDataFrame([("p0", "critical", "A"), ("p3", "low", "B")], "pv string, severity string, advisory_id string")
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(12)] + [("p3", "p0")], "src string, dst string")
    got = {r.node: (r.heat, r.hops, r.source) for r in R.heat(affects, edges, scratch).collect()}
    assert got["p0"] == (1.0, 0, "p0") and got["p1"] == (0.86, 1, "p0") and got["p3"] == (0.58, 3, "p0")
    assert got["p6"][0] == 0.16 and "p7" not in got


def test_shared_identity_is_linear_and_complete(spark, rows):
    links = spark.createDataFrame([("m1", p) for p in "abcde"] + [("m2", "x"), ("m3", "a"), ("m3", "x")], "who string, pkg string")
    subjects = spark.createDataFrame([("a",), ("b",)], "pkg string")
    got = rows(R.shared_identity(links, subjects, "who", "pkg"), "who", "pkg", "other_subjects")
    assert got == [("m1", "a", 1), ("m1", "b", 1), ("m1", "c", 2), ("m1", "d", 2), ("m1", "e", 2), ("m3", "x", 1)]


def test_import_bridge_confidence(spark, rows):
    imports = spark.createDataFrame([("s", n) for n in ("root", "sole", "many", "none")], "service string, specifier string")
    entries = spark.createDataFrame([("s", "root", "root@1"), ("s", "root", "root@2"), ("s", "sole", "sole@1"), ("s", "many", "many@1"), ("s", "many", "many@2")], "service string, name string, pv string")
    hoisted = spark.createDataFrame([("s", "root@1")], "service string, pv string")
    assert rows(B.import_bridge(imports, hoisted, entries).fillna("-"), "specifier", "pv", "confidence") == [
        ("many", "many@1", "ambiguous"), ("many", "many@2", "ambiguous"), ("none", "-", "unmatched"), ("root", "root@1", "hoisted"), ("sole", "sole@1", "sole-version")]


def test_ignore_patterns_compare_components(spark, rows):
    files = spark.createDataFrame([(p,) for p in ("corpus/a/x", "corpus-tools/x", "web/corpus/x", "a/node_modules/b/x", "web/src/x", "old/web/src/x")], "path string")
    patterns = spark.createDataFrame([("corpus/  # fixtures",), ("/web/src/",), ("",), ("# all",)], "pattern string")
    got = rows(B.ignore_reason(F.col("path"), patterns, files).fillna("-"), "path", "ignored")
    assert got == sorted([("corpus/a/x", "corpus"), ("corpus-tools/x", "-"), ("web/corpus/x", "corpus"), ("a/node_modules/b/x", "structural"), ("web/src/x", "web/src"), ("old/web/src/x", "-")])


def test_clean_advisory_matches_nothing(spark):
    versions = spark.createDataFrame([("pkg:npm/a@1.0.0", 1, "a", "1.0.0", 5)], "pv string, pk int, name string, version string, published_at long")
    advisory = spark.createDataFrame([("X", 1, "a", ">=9.0.0", "9.9.9", "low", 1)], "advisory_id string, pk int, name string, affected_range string, fixed_version string, severity string, published long")
    assert A.attach_advisories(advisory, versions.drop("name")).count() == 0


def test_long_chains_lose_nothing(spark, scratch):
    n = 66
    chain = spark.createDataFrame([("L", f"v{i:03d}", f"v{i + 1:03d}") for i in range(n)], "lock_id string, src string, dst string")
    roots = spark.createDataFrame([("L", "svc", 1, "v000", False)], "lock_id string, service string, observed_at long, pv string, dev boolean")
    closed = B.closure(roots, chain, scratch)
    assert closed.count() == n + 1 and closed.agg({"depth": "max"}).first()[0] == n + 1
    m = 34
    up = R.exposure_paths(spark.createDataFrame([(f"v{m:03d}",)], "pv string"), chain.select("src", "dst"), scratch)
    assert up.count() == m and up.agg({"depth": "max"}).first()[0] == m


def test_components_of_a_long_path_converge(spark, scratch):
    rng = random.Random(2)
    order = list(range(2_000))
    rng.shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.root for r in components(links, scratch).collect()} == {0}


def test_a_hot_node_is_not_pinned_to_one_partition(spark, scratch):
    """The edges of a reach loop are joined as a written table: neither cached nor dealt out by key."""
    edges = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hub' ELSE concat('n', id) END AS src", "concat('m', id) AS dst")
    seeds = spark.createDataFrame([("hub", "hub")], "pv string, node string")
    assert reach(seeds, edges, ["pv"], scratch).count() == 1_001
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_best_paths_through_a_dense_layered_graph_stay_bounded(spark, scratch):
    """3 of 50 ** 8 paths for each pair, from rows bounded by nodes, targets and paths asked for."""
    layers, wide = 10, 50
    name = "concat('n', {}, '-', lpad({}, 2, '0'))"
    edges = spark.range(layers - 1).withColumnRenamed("id", "l").crossJoin(spark.range(wide).withColumnRenamed("id", "a")).crossJoin(
        spark.range(wide).withColumnRenamed("id", "b")).selectExpr(f"{name.format('l', 'a')} AS src", f"{name.format('l + 1', 'b')} AS dst")
    first = spark.range(wide).selectExpr(f"{name.format(0, 'id')} AS source")
    last = spark.range(wide).selectExpr(f"{name.format(layers - 1, 'id')} AS node")
    got = shortest_paths(first, edges, last, scratch, 10, 3).collect()
    assert len(got) == wide * wide * 3
    best = {tuple(r.path) for r in got if (r.source, r.target) == ("n0-00", "n9-07")}
    assert best == {("n0-00", *[f"n{k}-00" for k in range(1, 8)], f"n8-0{j}", "n9-07") for j in range(3)}
    assert spark.read.parquet(f"{scratch.root}/*-ways").count() <= layers * wide * wide * 4


def test_best_paths_where_the_best_ways_turn_back(spark, scratch):
    """The k best ways of a node all pass the source, so more have to be kept for the targets concerned."""
    edges = [("s", "w"), ("w", "z")] + [("z", f"z{i}") for i in range(2)] + [(f"z{i}", "t") for i in range(2)]
    edges += [("w", f"a{i}") for i in range(6)] + [(f"a{i}", "s") for i in range(6)] + [("s", "q"), ("q", "t")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    got = shortest_paths(spark.createDataFrame([("s",)], "source string"), frame, spark.createDataFrame([("t",)], "node string"), scratch, 8, 2)
    assert sorted(tuple(r.path) for r in got.collect()) == [("s", "q", "t"), ("s", "w", "z", "z0", "t")]


def test_best_paths_over_random_cyclic_graphs(spark, scratch):
    for seed in (1,):
        rng = random.Random(seed)
        edges = sorted({(f"v{rng.randrange(8)}", f"v{rng.randrange(8)}") for _ in range(26)} | {(f"v{rng.randrange(8)}", f"t{rng.randrange(2)}") for _ in range(4)})
        edges = [(a, b) for a, b in edges if a != b]
        best = {}

        def grow(path):
            if path[-1].startswith("t"):
                best.setdefault((path[0], path[-1]), []).append(tuple(path))
            elif len(path) <= 5:
                for a, b in edges:
                    if a == path[-1] and b not in path:
                        grow([*path, b])

        for s in ("v0", "v1", "v2"):
            grow([s])
        frame = spark.createDataFrame(edges, "src string, dst string")
        sources, ends = spark.createDataFrame([("v0",), ("v1",), ("v2",)], "source string"), spark.createDataFrame([("t0",), ("t1",)], "node string")
        order = lambda p: (len(p), p)
        got = shortest_paths(sources, frame, ends, scratch, 5, 2).collect()
        assert sorted(tuple(r.path) for r in got) == sorted(p for ps in best.values() for p in sorted(ps, key=order)[:2])
        got = shortest_paths(sources, frame, ends, scratch, 5, 3, any_target=True).collect()
        whole = {}
        for (s, _), ps in best.items():
            whole.setdefault(s, []).extend(ps)
        assert sorted(tuple(r.path) for r in got) == sorted(p for ps in whole.values() for p in sorted(ps, key=order)[:3])


def test_forest_paths_are_shortest_and_hold_the_least_predecessors(spark, scratch):
    rng = random.Random(6)
    edges = sorted({(f"v{rng.randrange(14):02d}", f"v{rng.randrange(14):02d}") for _ in range(30)})
    frame = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([(f"v{i:02d}", f"v{i:02d}") for i in range(4)], "pv string, node string")
    forest = witness_forest(seeds, frame, scratch)
    assert not any(t.startswith("array") for _, t in forest.dtypes)
    want = {}
    for s in (f"v{i:02d}" for i in range(4)):
        level, paths = {s: (s,)}, {s: (s,)}
        while level:
            step = {}
            for node, path in sorted(level.items()):
                for a, b in edges:
                    if a == node and b not in paths and b not in step:
                        step[b] = (*path, b)
            paths.update(step)
            level = step
        want.update({(s, n): p for n, p in paths.items()})
    assert {(r.pv, r.node): tuple(r.path) for r in rendered(forest, scratch).collect()} == want
    some = spark.createDataFrame([k for k in sorted(want)[::3]], "pv string, node string")
    assert {(r.pv, r.node): tuple(r.path) for r in rendered(forest, scratch, some).collect()} == {k: want[k] for k in sorted(want)[::3]}


def test_paths_of_a_long_chain_take_few_rounds(spark, scratch):
    n = 2_000
    forest = spark.range(n).selectExpr("'p' AS pv", "concat('v', id) AS node", "cast(id as int) AS depth", "IF(id = 0, null, concat('v', id - 1)) AS pred")
    got = rendered(forest, scratch, None).filter("depth = 1999 or depth = 700").collect()
    assert {r.depth: r.path for r in got} == {d: [f"v{i}" for i in range(d + 1)] for d in (700, 1999)}


def test_condensed_reach_over_random_cyclic_graphs(spark, scratch):
    for seed, (nodes, links) in enumerate([(30, 45)]):
        rng = random.Random(seed)
        edges = sorted({(f"v{rng.randrange(nodes):02d}", f"v{rng.randrange(nodes):02d}") for _ in range(links)})
        seen = {}
        for s in {x for e in edges for x in e}:
            todo, mine = [s], {s}
            while todo:
                node = todo.pop()
                for a, b in edges:
                    if a == node and b not in mine:
                        mine.add(b)
                        todo.append(b)
            seen[s] = mine
        want = {s: min(t for t in mine if s in seen[t]) for s, mine in seen.items()}
        frame, seeds = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("v01",), ("v02",), ("v07",), ("lone",)], "node string")
        member, reached = condensed_reach(seeds, frame, scratch)
        assert {r.node: r.root for r in member.collect() if r.node != "lone"} == want
        # one copy for a component, and written out the nodes themselves
        assert reached.select("root").distinct().count() == len({want.get(s, s) for s in ("v01", "v02", "v07", "lone")})
        got = {(r.node, r.reaches) for r in members_reached(seeds, member, reached).collect()}
        assert got == {(s, t) for s in ("v01", "v02", "v07") for t in seen.get(s, {s})} | {("lone", "lone")}


def test_known_rows_of_a_loop_do_not_move(spark, scratch, monkeypatch):
    """Many known rows are one bucketed table, which the anti join of a round reads where it lies."""
    monkeypatch.setattr(session, "BUCKETED_FROM", 150)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = lambda a, b: spark.range(a, b).selectExpr("concat('p', id % 3) AS pv", "id AS node")
    try:
        seen = session.GrowingTable(scratch, "plan", ["pv", "node"])
        seen.append(rows(0, 100))
        assert seen.table is None
        seen.append(rows(100, 200))
        seen.append(rows(200, 250))
        fresh = rows(150, 300).join(seen.read(), ["pv", "node"], "left_anti")
        text = fresh._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
        assert sorted(r.node for r in fresh.collect()) == list(range(250, 300)) and seen.read().count() == 250
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_loop_over_bucketed_state_gives_the_same(spark, scratch, monkeypatch):
    monkeypatch.setattr(session, "BUCKETED_FROM", 3)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a"), ("c", "c")], "pv string, node string")
    assert sorted(map(tuple, reach(seeds, edges, ["pv"], scratch).collect())) == [
        ("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("c", "a", 2), ("c", "b", 3), ("c", "c", 0), ("c", "d", 1)]


def test_functions_are_counted_by_sets_of_imports(spark):
    loads = [(pv, "s", i) for pv, imports in {"a": "xy", "b": "xy", "c": "x", "d": "yz", "e": "zy"}.items() for i in imports]
    calls = [(1, "s", "x"), (2, "s", "x"), (2, "s", "y"), (3, "s", "z"), (4, "t", "x")]
    got = G.function_counts(spark.createDataFrame(loads, "pv string, service string, specifier string"), spark.createDataFrame(calls, "fn long, service string, specifier string"))
    assert {r.pv: r.function_count for r in got.collect()} == {"a": 2, "b": 2, "c": 2, "d": 2, "e": 2}


def test_a_member_is_told_another_package_as_witness(spark, rows):
    flagged = spark.createDataFrame([("a@2", "a"), ("a@1", "a"), ("b@1", "b")], "pv string, name string")
    links = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "c"), ("n", "a"), ("n", "a"), ("o", "c")], "maintainer string, name string")
    assert rows(G.witnesses(flagged, links, "maintainer")) == [("m", "a", "b@1"), ("m", "b", "a@1"), ("m", "c", "a@1")]


def test_a_closure_dealt_out_by_lockfile_moves_no_row_in_a_round(spark, scratch, monkeypatch):
    """Its edges and known rows are bucketed by the lockfile; a round shuffles nothing and finds the same."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(i % 7, f"v{rng.randrange(9)}", f"v{rng.randrange(9)}") for i in range(90)], "lock_id long, src string, dst string")
    roots = spark.createDataFrame([(i % 7, f"s{i % 2}", 5, f"v{i % 4}", i % 3 == 0) for i in range(14)], "lock_id long, service string, observed_at long, pv string, dev boolean")
    want = sorted(map(tuple, B.closure(roots, edges, scratch).collect()))
    plans, real = [], session.DealtTable.append

    def spied(self, df, shuffle=False):
        plans.append((shuffle, df._jdf.queryExecution().executedPlan().toString()))
        return real(self, df, shuffle)

    monkeypatch.setattr(session.DealtTable, "append", spied)
    monkeypatch.setattr(session, "DEALT_FROM", 3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, B.closure(roots, edges, scratch).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want and len(plans) > 3
    assert all("Exchange" not in text for shuffle, text in plans[2:])
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_imports_of_subjects_are_found_backwards(spark, scratch):
    bridge = spark.createDataFrame([("s", "a", "a@1"), ("s", "b", "b@1"), ("t", "a", "a@1"), ("t", "z", None)], "service string, specifier string, pv string")
    depends = spark.createDataFrame([("a@1", "c@1"), ("c@1", "d@1"), ("b@1", "d@1"), ("d@1", "a@1")], "src string, dst string")
    subjects = spark.createDataFrame([("d@1",), ("x@1",)], "pv string")
    whole = R.import_reach(bridge, R.version_reach(bridge, depends, scratch)).filter("pv IN ('d@1', 'x@1')")
    got = sorted(map(tuple, R.imports_reaching(subjects, bridge, depends, scratch).select("service", "specifier", "pv", "hops").collect()))
    assert got == sorted(map(tuple, whole.select("service", "specifier", "pv", "hops").collect()))
    assert got == [("s", "a", "d@1", 2), ("s", "b", "d@1", 1), ("t", "a", "d@1", 2)]


def test_threats_do_not_write_every_imports_reach(spark):
    """Only the imports of flagged versions are walked; heat joins layers and writes no table of all edges."""
    fleet = Fleet(spark, "/root/testdata/sf0.001")
    assert fleet.threat.count() and fleet.heat.count()
    assert not {"import_reach", "heat_edges"} & set(fleet.__dict__)


def test_layered_heat_is_the_heat_over_all_edges(spark, scratch):
    fleet = Fleet.of(spark, "/root/testdata/sf0.001")
    want = R.heat(fleet.affects, R.heat_edges(fleet), scratch)
    assert sorted(map(tuple, fleet.heat.collect())) == sorted(map(tuple, want.collect()))


def test_edges_of_a_package_graph_need_no_heat(spark):
    fleet = Fleet(spark, "/root/testdata/sf0.001")
    assert W.package_graph(fleet, fleet.incident, heated=False)[1].count() > 0
    assert "heat" not in fleet.__dict__


def test_imports_are_bridged_by_the_root_copy_the_only_one_or_all(spark, rows):
    imports = spark.createDataFrame([("s", n) for n in "abcd"] * 2, "service string, specifier string")
    held = [("s", "a", "a@1"), ("s", "a", "a@2"), ("s", "b", "b@1"), ("s", "b", "b@1"), ("s", "c", "c@1"), ("s", "c", "c@2"), ("t", "d", "d@1")]
    entries = spark.createDataFrame(held, "service string, name string, pv string")
    hoisted = spark.createDataFrame([("s", "a@2"), ("s", "a@2"), ("t", "c@1")], "service string, pv string")
    assert {tuple(r) for r in B.import_bridge(imports, hoisted, entries).collect()} == {
        ("s", "a", "a@2", "hoisted"), ("s", "b", "b@1", "sole-version"), ("s", "c", "c@1", "ambiguous"), ("s", "c", "c@2", "ambiguous"), ("s", "d", None, "unmatched")}


def test_threat_details_need_no_lockfile_and_no_code(spark):
    fleet = Fleet(spark, "/root/testdata/sf0.001")
    assert W.threat_detail(fleet).count() > 0
    assert not {"threat", "lock_edge", "lock_root", "lock_closure", "bridge", "depends_on"} & set(vars(fleet))


def test_verdicts_need_holders_alone_and_the_holders_are_the_pairs_of_resolved_in(spark):
    fleet = Fleet(spark, "/root/testdata/sf0.001")
    rows = {r.pv: r.n_services for r in G.verdict(fleet).collect()}
    assert not {"threat", "lock_closure", "resolved_in", "bridge", "depends_on"} & set(vars(fleet))
    pairs = sorted(map(tuple, fleet.resolved_in.select("pv", "service").collect()))
    assert sorted(map(tuple, fleet.holders.select("pv", "service").collect())) == pairs
    assert rows == {r.pv: r.n_services for r in fleet.threat.filter("kind <> 'deprecated'").collect()}


def test_loaded_subjects_are_those_with_an_import_in_reach(spark, scratch):
    rnd = random.Random(5)
    for bound in (1, 3, 12):
        edges = {(f"v{rnd.randrange(40)}", f"v{rnd.randrange(40)}") for _ in range(45)}
        roots, subjects = {f"v{rnd.randrange(40)}" for _ in range(4)}, {f"v{k}" for k in range(0, 40, 2)}
        bridge = spark.createDataFrame([(r,) for r in roots] + [(None,)], "pv string")
        got = R.loaded_of(spark.createDataFrame([(s,) for s in subjects], "pv string"), bridge, lambda: spark.createDataFrame(list(edges), "src string, dst string"), scratch, bound)
        known = set(roots)
        for _ in range(bound):
            known |= {b for a, b in edges if a in known}
        assert sorted(r.pv for r in got.collect()) == sorted(known & subjects)


def test_threat_counts_build_no_closure(spark):
    fleet = Fleet(spark, "/root/testdata/sf0.001")
    in_code = {r.pv for r in fleet.loaded_threats.collect()}
    assert not {"threat", "lock_closure", "resolved_in", "calls_external"} & set(vars(fleet))
    assert in_code == {r.pv for r in fleet.threat.filter("in_code").collect()}
