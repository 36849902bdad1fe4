"""Plans and hot groups: what must hold when one key has a third of all rows."""

import os

import pytest
from pyspark.sql import functions as F

from supplygraph.operators.findings import confidence
from supplygraph.operators.fixpoint import top_k
from supplygraph.operators import reach as R
from supplygraph.operators import views as W
from supplygraph.plans import catalog
from supplygraph.plans.domain import Fleet
from supplygraph.session import KeyedTable, shared_dir

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    assert plan(top_k(df, ["g"], [F.col("id")], 5)).count("WindowGroupLimit") == 2


def test_hot_join_key_is_split(spark):
    """A key with most rows is divided among tasks by the adaptive skew join."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
             "spark.sql.shuffle.partitions": "32"}
    old = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        big = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.uuid().alias("v"))
        small = spark.range(200_000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
        joined = big.join(small, "k")
        assert joined.agg(F.count("*")).first()[0] == 200_000
        joined.write.format("noop").mode("overwrite").save()
        again = joined.groupBy("v").agg(F.max("w"))
        again.collect()
        assert "isSkew=true" in plan(again) or "skew=true" in plan(again)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_cross_join_and_no_python_in_any_plan(spark):
    for key in ("agg_assess", "typosquat_edges", "edge_satisfied_by", "q_shared_maintainer", "agg_threats", "win_correlated_burst", "agg_threat_counts"):
        text = plan(catalog.QUERIES[key](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key
        assert "Python" not in text and "ArrowEval" not in text, key


def test_pinned_lookup_reaches_the_scan(spark):
    fleet = Fleet.of(spark, SF)
    text = plan(fleet.resolved_in.filter("pv = 'x'").select("service"))
    assert "PushedFilters: [IsNotNull(pv), EqualTo(pv,x)]" in text and "ReadSchema: struct<pv:string,service:string>" in text


def test_scratch_is_shared_on_a_cluster(spark):
    assert os.path.isabs(shared_dir(spark).removeprefix("file:"))


def test_relations_never_escalate(spark):
    atoms = spark.createDataFrame([(["SHARED_MAINTAINER", "SHARED_PUBLISHER", "TYPOSQUAT_NEIGHBOR", "SHARED_REPOSITORY"],)], "a array<string>")
    assert atoms.select(confidence(F.col("a"))).first()[0] == "INVESTIGATE"


@pytest.mark.parametrize("key", ["agg_assess", "q_exposed_projects", "st_publish_events"])
def test_entry_queries_run(spark, key):
    assert catalog.QUERIES[key](spark, SF).count() > 0


def test_every_query_has_checking_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_sql_of_a_name_nobody_holds_falls_back_to_substrings(spark, tmp_path):
    """The query takes substrings where no name is equal; so does its SQL, whatever part 1 is called."""
    import duckdb

    key, con = "view_resolve_package_exact", duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {name}_0 AS SELECT * FROM '{SF}/{name}.parquet'")
        text = "SELECT * REPLACE (CASE WHEN p_partkey IN (1, 12) THEN 'red widget-1 big' ELSE p_name END AS p_name) FROM part_0" if name == "part" else f"SELECT * FROM {name}_0"
        con.sql(f"COPY ({text}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    df = catalog.QUERIES[key](spark, str(tmp_path))
    want = sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[key]})").fetchall())
    assert sorted(map(tuple, df.collect())) == want and {r[-1] for r in want} == {"substring"}


def test_every_affected_version_gets_its_paths(spark):
    fleet = Fleet.of(spark, SF)
    up = {}
    for src, dst in [(r.dst, r.src) for r in fleet.depends_on.collect()] + [(r.pv, "svc:" + r.service.lower()) for r in fleet.lock_root.collect()]:
        up.setdefault(src, set()).add(dst)
    want = {}
    for pv in {r.pv for r in fleet.affects.collect()}:
        seen, front, hops = {pv}, {pv}, 0
        while front and hops < 10 and not any(n.startswith("svc:") for n in front):
            front, hops = {d for n in front for d in up.get(n, ())} - seen, hops + 1
            seen |= front
        if any(n.startswith("svc:") for n in front):
            want[pv] = hops
    got = {}
    for key in ("q_paths_one_source", "q_paths_many", "view_dependency_path"):
        got = {r.source: r.hops for r in catalog.QUERIES[key](spark, SF).groupBy("source").agg(F.min("hops").alias("hops")).collect()}
        assert got == want, key


def test_code_tier_and_subsets_read_all_rows(spark):
    fleet = Fleet.of(spark, SF)
    entries = fleet.entry.collect()
    assert {(r.service, r.specifier) for r in fleet.external_import.collect()} == {(r.service, r.name) for r in entries}
    assert {(r.fn, r.service, r.specifier) for r in fleet.calls_external.collect()} == {(r.cust, r.service, r.name) for r in entries}
    run = lambda key: catalog.QUERIES[key](spark, SF).collect()
    assert {(r.src, r.dst_name, r.range) for r in run("edge_requires")} == {(r.src, r.dst_name, r.range) for r in fleet.requires.collect()}
    assert {(r.name, r.version) for r in run("universe_materialise")} >= {(r.name, r.version) for r in entries}
    nations = {r.n_nationkey: r.n_name.lower() for r in fleet.table("nation").collect()}
    claimed = {}
    for r in fleet.table("customer").collect():
        claimed.setdefault(nations[r.c_nationkey], set()).add(r.c_mktsegment)
    assert {r.service: r.n_workspaces for r in run("workspace_collisions")} == {k: len(v) for k, v in claimed.items() if len(v) > 1}


def test_full_graph_is_full_without_a_cap(spark):
    nodes = spark.range(2_500).selectExpr("format_string('p%05d', id) AS node")
    edges = nodes.selectExpr("node AS src", "'p02499' AS dst")
    shown = lambda *cap: [df.collect() for df in W.full_graph({"p": nodes}, {"e": edges}, *cap)]
    kept, links, stats = shown()
    assert len(kept) == len(links) == 2_500 and {tuple(r) for r in stats} == {("p", 2_500, 2_500), ("e", 2_500, 2_500)}
    kept, links, stats = shown(2_000)
    assert len(kept) == 2_000 and not links and {tuple(r) for r in stats} == {("p", 2_500, 2_000), ("e", 2_500, 0)}
    fleet = Fleet.of(spark, SF)
    assert catalog.QUERIES["view_full_graph"](spark, SF).where("label = 'package_version'").count() == fleet.package_version.count()


def test_a_pinned_lookup_opens_one_file_at_any_size(spark, scratch):
    for n in (1_000, 20_000):
        table = KeyedTable(scratch, spark.range(n).selectExpr("concat('k', lpad(id, 6, '0')) AS k", "id"), "k", "t", pieces=16)
        got = table.lookup("k000421")
        assert [r.id for r in got.collect()] == [421] and len(got.inputFiles()) == 1
        assert table.least() == "k000000" and table.lookup("absent", "zz").count() == 0
        assert sorted(r.id for r in table.lookup("k000001", "k000999").collect()) == [1, 999]


def test_keyed_tables_keep_hot_and_null_keys(spark, scratch):
    df = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN null ELSE concat('k', id) END AS k", "id")
    table = KeyedTable(scratch, df, "k", "t", pieces=8)
    assert table.lookup("hot").count() == 300 and table.lookup("k5").count() == 1
    assert KeyedTable(scratch, df.limit(0), "k", "t").lookup("hot").count() == 0


def test_tables_dealt_out_by_lockfile_hold_the_same_rows_and_move_none(spark, monkeypatch):
    from supplygraph import session
    from supplygraph.session import keys_apart

    plain = Fleet(spark, SF)
    monkeypatch.setattr(session, "DEALT_FROM", 0)
    dealt = Fleet(spark, SF)
    for table in ("entry", "lock_slot", "lock_edge", "lock_root", "package_version", "external_import", "lock_closure", "resolved_in", "holders", "bridge", "heat"):
        one, other = getattr(plain, table), getattr(dealt, table)
        assert sorted(map(str, one.collect())) == sorted(map(str, other.select(*one.columns).collect())), table
    with keys_apart(spark):
        for df in (dealt._below, dealt.lock_closure, dealt.external_import):
            assert "Exchange hashpartitioning" not in plan(df)


def test_a_written_table_leaves_no_shuffle_files(spark, scratch):
    def blocks():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")

    before = blocks()
    scratch.save(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.max("id")), "grouped")
    assert blocks() <= before


def test_heat_of_versions_reads_neither_closure_nor_code(spark):
    fleet = Fleet(spark, SF)
    whole = {(r.node, r.heat) for r in R.layered_heat(fleet.affects, R.heat_layers(Fleet.of(spark, SF)), fleet.scratch).collect()}
    fleet = Fleet(spark, SF)
    nodes = W.project_graph(fleet)[0]
    assert not {"bridge", "calls_external", "external_import", "heat", "threat"} & set(vars(fleet))
    assert {(r.pv, r.heat) for r in nodes.filter("heat IS NOT NULL").collect()} == {(n, h) for n, h in whole if n in {r.pv for r in fleet.resolved_in.collect()}}


def test_services_and_overview_count_neither_imports_nor_functions(spark):
    from supplygraph.operators import findings as G

    fleet, whole = Fleet(spark, SF), Fleet.of(spark, SF)
    one = W.service_profile(fleet, "NATION_3")
    assert not {"threat", "resolved_in", "calls_external"} & set(vars(fleet))
    assert {r.pv for r in one.collect()} == {r.pv for r in whole.resolved_in.filter("service = 'NATION_3'").join(whole.threat, "pv").collect()}
    G.fleet_overview(fleet)
    assert "threat" not in vars(fleet)
    graded = {(r.pv, r.kind, r.severity, r.in_code) for r in G.graded(fleet).collect()}
    assert graded == {(r.pv, r.kind, r.severity, r.in_code) for r in whole.threat.collect()}


def test_enrichment_needs_no_closure(spark):
    fresh = "/root/testdata/./sf0.001"  # tables that no other test has built
    catalog.QUERIES["st_enrich"](spark, fresh)
    assert not {"resolved_in", "lock_closure"} & set(vars(Fleet.of(spark, fresh)))


def test_blast_radius_deletes_the_shuffles_of_each_part(spark):
    from supplygraph.operators import findings as G

    fleet = Fleet.of(spark, SF)
    none = fleet.package.select(F.col("name").alias("candidate"), F.col("name").alias("target")).limit(0)
    wide = G.blast_radius(fleet, fleet.incident, none)
    # the parts are written tables, so the plan reads neither entries nor satisfied ranges
    files = " ".join(wide.inputFiles())
    assert "-entry" not in files and "-satisfied_by" not in files and "-resolved_in" not in files
