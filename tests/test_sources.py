import json
import os

from pyspark.sql import functions as F

from supplygraph.operators import build as B
from supplygraph.sources import documents as D
from supplygraph.sources import sinks as K
from supplygraph.streaming import feed as L


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


LOCK = {
    "name": "shop", "lockfileVersion": 3,
    "packages": {
        "": {"name": "shop", "dependencies": {"express": "^4"}, "devDependencies": {"jest": "^29"}},
        "node_modules/express": {"version": "4.18.0", "dependencies": {"debug": "2"}},
        "node_modules/express/node_modules/debug": {"version": "2.6.9"},
        "node_modules/debug": {"version": "4.3.4"},
        "node_modules/jest": {"version": "29.0.0", "dev": True, "dependencies": {"debug": "4"}},
        "node_modules/alias": {"name": "lodash", "version": "4.17.21"},
    },
}


def test_lockfile_files_end_to_end(spark, scratch, tmp_path, rows):
    write(tmp_path, "a/package-lock.json", LOCK)
    write(tmp_path, "b/package-lock.json", {"lockfileVersion": 1, "dependencies": {}})
    write(tmp_path, "a/node_modules/x/package-lock.json", LOCK)
    texts = D.read_whole(spark, str(tmp_path), "package-lock.json")
    kept = B.ignore_reason(F.col("path"), None, texts).filter("ignored IS NULL")
    locks = D.lockfiles(kept, "path", "text")
    assert rows(locks.filter("reject IS NOT NULL"), "lock_id") == [("b/package-lock.json",)]
    entries = D.lock_entries(locks)
    assert ("node_modules/alias", "lodash", False) in rows(entries, "path", "name", "root_level")
    edges = B.dependency_edges(entries)
    roots = edges.filter("kind = 'direct'").select("lock_id", "service", F.lit(1).cast("long").alias("observed_at"), F.col("dst").alias("pv"), "dev")
    closure = B.closure(roots, edges.filter("kind = 'transitive'").select("lock_id", "src", "dst"), scratch)
    assert rows(closure, "pv", "depth", "dev_only") == [
        ("pkg:npm/debug@2.6.9", 2, False), ("pkg:npm/debug@4.3.4", 2, True), ("pkg:npm/express@4.18.0", 1, False), ("pkg:npm/jest@29.0.0", 1, True)]


def test_findings_csv_round_trip(spark, tmp_path, rows):
    raw = [("LoDash", "4.17.20", "npm", "lock", "GHSA-1", "CVE-1 | GHSA-2", 'says "hi", ok', "", "HIGH", "4.17.21", "0", "2024-01-01T00:00:00Z", "", "two\nlines", "https://a"),
           ("", "1", "npm", "", "X", "", "", "", "", "", "", "", "", "", ""), ("a", "", "npm", "", "X", "", "", "", "", "", "", "", "", "", ""), ("_a", "1", "npm", "", "X", "", "", "", "7.5", "", "", "", "", "", "")]
    from supplygraph import schema as S
    df = spark.createDataFrame(raw, ", ".join(f"`{c}` string" for c in S.FINDING_COLUMNS))
    K.write_csv(K.findings_csv(df), str(tmp_path / "csv"))
    got = D.findings(D.read_findings_csv(spark, str(tmp_path / "csv")))
    assert rows(got.fillna("-", ["skipped"]), "osv_id", "skipped") == [("GHSA-1", "-"), ("X", "missing package or osv_id"), ("X", "no version"), ("X", "unkeyable name")]
    good = got.filter("skipped IS NULL").first()
    assert (good.package, good.aliases, good.severity_label, good.score, good.details) == ("lodash", ["CVE-1", "GHSA-2"], "high", None, "two\nlines")


def test_missing_columns_are_refused(spark, tmp_path):
    import pytest

    path = write(tmp_path, "x.csv", "package,version\na,1\n")
    with pytest.raises(ValueError):
        D.read_findings_csv(spark, path)


def test_requirements_and_discovery(spark, tmp_path, rows):
    write(tmp_path, "app/requirements.txt", "# top\nFlask_SQLAlchemy[x]==3.0 ; python_version>'3'\n-r other\nrequests\n")
    write(tmp_path, ".venv/requirements.txt", "zzz\n")
    files = D.list_files(spark, str(tmp_path)).filter(D.is_python_manifest(F.col("path")))
    assert rows(files, "path") == [("app/requirements.txt",)]
    lines = D.read_lines(spark, str(tmp_path / "app/requirements.txt")).withColumn("k", F.lit(1))
    assert rows(D.requirements(lines, "k", "line"), "name", "specifier") == [("flask-sqlalchemy", "==3.0"), ("requests", "")]


def test_artifacts_from_files(spark, tmp_path, rows):
    for name, text in [("svc/.claude/a.js", "x"), ("svc/.vscode/s.json", "the MARK here"), ("svc/src/setup_bun.js", "z"), ("svc/src/ok.js", "z"), (".husky/pre", "r")]:
        write(tmp_path, name, text)
    listed = D.list_files(spark, str(tmp_path), content=True).unionByName(D.watched_files(spark, str(tmp_path), ["", "svc"]))
    files = D.repo_files(listed).select(
        F.lit("r").alias("repo"), F.when(F.col("path").startswith("svc/"), "svc").alias("service"), F.regexp_replace("path", "^svc/", "").alias("path"), "content")
    services = spark.createDataFrame([("r", "svc"), ("r", "other")], "repo string, service string")
    got = rows(B.artifact_scan(files, ["src/*bun.js"], ["MARK"], services), "service", "path", "kind")
    assert got == [("other", ".husky/pre", "watched-dir"), ("svc", ".claude/a.js", "watched-dir"), ("svc", ".husky/pre", "watched-dir"), ("svc", ".vscode/s.json", "ioc-content"), ("svc", "src/setup_bun.js", "ioc-path")]


def test_merge_is_idempotent_and_keeps_what_says_something(spark, rows):
    schema = "k string, name string, n long, flag boolean, ord int"
    old = spark.createDataFrame([("a", "x", 5, True, 0), ("b", "y", 0, False, 0)], schema)
    new = spark.createDataFrame([("a", "", 0, False, 1), ("b", "z", -1, False, 1), ("c", None, 3, None, 1)], schema)
    once = K.merge_nodes(old, new, "k", "ord")
    assert rows(once.fillna("-").fillna(False)) == [("a", "x", 5, True), ("b", "z", -1, False), ("c", "-", 3, False)]
    twice = K.merge_nodes(once.withColumn("ord", F.lit(0)), new, "k", "ord")
    assert rows(twice.fillna("-").fillna(False)) == rows(once.fillna("-").fillna(False))


def test_stream_equals_batch(spark, tmp_path, rows):
    now = 1_700_000_000
    events = [(f"p{i % 7}", f"1.{i // 2}.0", now - i * 60, "u", False) for i in range(40)]
    df = spark.createDataFrame(events, "package string, version string, published_at long, publisher string, has_install_script boolean")
    df.unionByName(df).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = L.run_available(L.publish_events(stream, now), str(tmp_path), "out")
    want = L.publish_events(df, now)
    assert rows(got, "package", "version") == rows(want, "package", "version")
    assert os.path.isdir(tmp_path / "out-checkpoint")


def test_restart_continues_from_the_checkpoint(spark, tmp_path, rows):
    page = lambda n: json.dumps({"results": [{"id": f"pkg{n}", "seq": n}, {"id": "_design/a", "seq": n}], "last_seq": n}) + "\n"
    write(tmp_path, "pages/1.json", page(1))
    run = lambda: L.run_available(D.change_pages(D.read_change_feed(spark, str(tmp_path / "pages")), "value"), str(tmp_path), "changes")
    assert rows(run()) == [("pkg1", 1)]
    write(tmp_path, "pages/2.json", page(2))
    assert rows(run()) == [("pkg1", 1), ("pkg2", 2)]


def test_alert_grades(spark, rows):
    df = spark.createDataFrame([("a", ["S"], True), ("b", ["S"], False), ("c", [], True)], "package string, signals array<string>, in_fleet boolean")
    assert rows(df.withColumn("kind", L.alert_kind()), "package", "kind") == [("a", "fleet"), ("b", "anomaly"), ("c", "publish")]
