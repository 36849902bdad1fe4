"""Input documents to tables.

Every parser takes a DataFrame of texts (a path or key beside the text), so
the same code reads files, a landing table or a stream. ``read_*`` helpers add
the file listing. Unusable rows come back as rows with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph import schema as S
from supplygraph.functions import names as N
from supplygraph.functions import versions as V

# -- listing ---------------------------------------------------------------------


def read_whole(spark: SparkSession, root: str, name_glob: str) -> DataFrame:
    """(path, text) of every matching file below ``root``, one row each."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob).option("wholetext", "true")
    return reader.text(root).select(relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, root: str, name_glob: str = "*", content: bool = False) -> DataFrame:
    """(path, size[, content]); without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob).load(root)
    cols = [relative(F.col("path"), root).alias("path"), F.col("length").alias("size")]
    return files.select(*cols, "content") if content else files.select(*cols)


def watched_files(spark: SparkSession, root: str, services: list[str]) -> DataFrame:
    """(path, size, content) of the watched folders of the given services.

    Spark's listing leaves out names that begin with a dot, so these folders
    are named as inputs. Only their existence is looked up on the driver; the
    files below them are listed and read like any others. ``services`` holds
    folders relative to ``root``, "" being the root itself.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for service in services:
        for folder in S.WATCHED_DIRS:
            path = "/".join(p for p in (root.rstrip("/"), service.strip("/"), folder) if p)
            target = hadoop(path)
            if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
                found.append(path)
    if not found:
        return spark.createDataFrame([], "path string, size bigint, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found)
    return files.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), "content")


def relative(path: Column, root: str) -> Column:
    clean = root.removeprefix("file:").rstrip("/")
    clean = "/" + clean.lstrip("/")
    return F.regexp_replace(path, f"^file:/*{clean}/|^{clean}/", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


# -- lockfiles ---------------------------------------------------------------------


def lockfiles(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lock_version, name, packages, reject): one row per lockfile."""
    doc = texts.select(key, F.from_json(F.col(text), S.LOCKFILE).alias("d"))
    reject = F.when(F.col("d").isNull() | F.col("d.packages").isNull() | (F.size("d.packages") == 0), "no packages map")
    return doc.select(
        F.col(key).alias("lock_id"), F.coalesce("d.lockfileVersion", F.lit(1)).alias("lock_version"),
        F.col("d.name").alias("repo"), F.col("d.packages").alias("packages"), reject.alias("reject"),
    )


def lock_entries(locks: DataFrame) -> DataFrame:
    """One row per tree entry, services included.

    ``role``: service, package, link, unresolved (no version) or unkeyable.
    ``root_level`` marks the hoisted copy application code loads.
    """
    rows = locks.filter("reject IS NULL").select("lock_id", "repo", F.explode("packages").alias("path", "e"))
    is_service = ~F.col("path").startswith("node_modules/")
    name = F.coalesce(F.nullif(F.col("e.name"), F.lit("")), N.entry_name("path"))
    service = F.when(F.col("path") == "", F.coalesce("e.name", "repo")).otherwise(F.coalesce("e.name", "path"))
    version = F.nullif(F.coalesce("e.version", F.lit("")), F.lit(""))
    link = F.coalesce("e.link", F.lit(False))
    role = (
        F.when(link, "link").when(is_service, "service").when(version.isNull(), "unresolved")
        .when(N.npm_name(name).isNull(), "unkeyable").otherwise("package")
    )
    return rows.select(
        "lock_id", "path", role.alias("role"), F.when(is_service & ~link, service).alias("service_name"),
        name.alias("name"), version.alias("version"), link.alias("link"), F.coalesce("e.dev", F.lit(False)).alias("dev"),
        F.coalesce("e.integrity", F.lit("")).alias("integrity"), F.coalesce("e.resolved", F.lit("")).alias("resolved"),
        ((F.col("path") == F.concat(F.lit("node_modules/"), name)) & (role == "package")).alias("root_level"),
        *[F.col(f"e.{c}").alias(c) for c in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")],
    )


# -- Python ----------------------------------------------------------------------------


def requirements(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, name, specifier); comments, flags, markers and extras removed."""
    entry = N.strip(F.split(F.col(line), "#")[0])
    body = N.strip(F.split(entry, ";")[0])
    spec = F.regexp_extract(body, "([=<>!~].*)$", 1)
    name = N.pypi_name(F.split(F.regexp_extract(body, "^([^=<>!~]*)", 1), r"\[")[0])
    return lines.filter((entry != "") & ~entry.startswith("-")).select(
        key, name.alias("name"), N.strip(spec).alias("specifier")
    ).filter("name IS NOT NULL")


def is_python_manifest(path: Column) -> Column:
    """A manifest or lock that is not inside an installed environment."""
    name = F.substring_index(path, "/", -1)
    inside = F.arrays_overlap(F.split(path, "/"), F.array(F.lit(".venv"), F.lit("venv"), F.lit("site-packages")))
    return name.isin(sorted({*N.PYTHON_MANIFESTS, *N.PYTHON_LOCKS})) & ~inside


def pip_report(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and the edges whose both ends the report resolved."""
    doc = texts.select(key, F.explode(F.from_json(F.col(text), S.PIP_REPORT)["install"]).alias("i")).select(key, "i.metadata.*")
    nodes = doc.select(
        key, N.pypi_name("name").alias("name"), "version",
        F.coalesce("license_expression", "license", F.lit("")).alias("license"), "requires_python",
    ).filter("name IS NOT NULL")
    wanted = doc.select(
        key, N.pypi_name("name").alias("parent"), F.explode("requires_dist").alias("req")
    ).filter(~F.lower("req").rlike(r";.*\bextra\b"))
    child = N.pypi_name(F.regexp_extract("req", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    edges = wanted.select(key, "parent", child.alias("child")).distinct()
    held = nodes.select(key, F.col("name").alias("child")).distinct()
    return nodes, edges.join(held, [key, "child"], "left_semi").select(key, "parent", "child")


# -- registry ----------------------------------------------------------------------------


def _repo_text(raw: Column) -> Column:
    """A repository field is text or ``{url}``."""
    return F.coalesce(F.when(raw.startswith("{"), F.get_json_object(raw, "$.url")).otherwise(raw), F.lit(""))


def packuments(texts: DataFrame, text: str, full: bool = True) -> DataFrame:
    return texts.select(F.from_json(F.col(text), S.PACKUMENT).alias("d")).select("d.*").filter("name IS NOT NULL").withColumn("full", F.lit(full))


def packument_package(docs: DataFrame) -> DataFrame:
    """Package row; the repository falls back to the last version naming one."""
    versions = F.map_entries("versions")
    named = F.filter(versions, lambda e: _repo_text(e["value"]["repository"]) != "")
    last = F.array_max(F.transform(named, lambda e: F.struct(e["key"].alias("v"), _repo_text(e["value"]["repository"]).alias("r"))))["r"]
    own = F.nullif(_repo_text(F.col("repository")), F.lit(""))
    return docs.select(
        "name", F.coalesce(F.col("dist-tags")["latest"], F.lit("")).alias("latest"),
        F.coalesce(F.size("versions"), F.lit(0)).alias("version_count"),
        F.when(F.col("full"), F.coalesce(own, last, F.lit(""))).otherwise("").alias("repository"),
        (F.coalesce("deprecated", F.lit("")).isin("", "false") == F.lit(False)).alias("deprecated"),
    )


def packument_maintainers(docs: DataFrame) -> DataFrame:
    one = docs.filter("full").select("name", F.explode("maintainers").alias("m"))
    user = F.when(F.col("m").startswith("{"), F.get_json_object("m", "$.name")).otherwise(F.col("m"))
    email = F.when(F.col("m").startswith("{"), F.get_json_object("m", "$.email"))
    return one.select("name", user.alias("username"), F.coalesce(email, F.lit("")).alias("email")).filter("username <> ''")


def packument_versions(docs: DataFrame) -> DataFrame:
    rows = docs.select("name", "time", "full", F.explode("versions").alias("version", "v"))
    only = lambda c: F.when(F.col("full"), F.coalesce(c, F.lit(""))).otherwise("")
    return rows.select(
        "name", "version", F.coalesce("v.dist.integrity", F.lit("")).alias("integrity"),
        F.coalesce("v.hasInstallScript", F.lit(False)).alias("has_install_script"),
        (F.coalesce("v.deprecated", F.lit("")).isin("", "false") == F.lit(False)).alias("deprecated"),
        only(N.licence(F.col("v.license"))).alias("license"),
        only(F.col("v.description")).alias("description"),
        only(_repo_text(F.col("v.repository"))).alias("repository"),
        only(F.col("v._npmUser.name")).alias("publisher"), only(F.col("v._npmUser.email")).alias("publisher_email"),
        F.when(F.col("full"), N.epoch_seconds(F.col("time")[F.col("version")])).otherwise(0).cast("bigint").alias("published_at"),
    )


def packument_dependencies(docs: DataFrame) -> DataFrame:
    """(name, version, dst_name, range, dep_type, optional, peer, bundled)."""
    rows = docs.select("name", F.explode("versions").alias("version", "v"))
    fields = [("dependencies", "prod"), ("devDependencies", "dev"), ("optionalDependencies", "optional"), ("peerDependencies", "peer")]
    bundled = F.coalesce("v.bundleDependencies", "v.bundledDependencies", F.array().cast("array<string>"))
    out = None
    for field, kind in fields:
        part = rows.select("name", "version", bundled.alias("b"), F.explode(F.col(f"v.{field}")).alias("dst_name", "range")).select(
            "name", "version", "dst_name", F.coalesce(F.nullif("range", F.lit("")), F.lit("*")).alias("range"),
            F.lit(kind).alias("dep_type"), F.lit(kind == "optional").alias("optional"), F.lit(kind == "peer").alias("peer"),
            F.array_contains("b", F.col("dst_name")).alias("bundled"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def downloads(texts: DataFrame, text: str) -> DataFrame:
    """(name, downloads) of a bulk or a single answer; absent names stay unknown."""
    many = F.from_json(F.col(text), f"MAP<STRING,{S.DOWNLOAD_ENTRY}>")
    single = F.from_json(F.col(text), "downloads BIGINT, package STRING")
    one = F.when(
        single["package"].isNotNull() & single["downloads"].isNotNull(),
        F.create_map(single["package"], F.struct(single["downloads"].alias("downloads"), single["package"].alias("package"))),
    )
    rows = texts.select(F.explode(F.coalesce(one, many)).alias("raw", "e")).filter("e.downloads IS NOT NULL")
    return rows.select(N.npm_name("raw").alias("name"), F.col("e.downloads").alias("downloads")).filter("name IS NOT NULL")


def maintainer_search(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, package, maintainer) of every page."""
    page = F.from_json(F.col(text), S.MAINTAINER_SEARCH)
    hits = texts.select(key, F.explode(page["objects"]).alias("o")).select(key, F.col("o.package.name").alias("package"), F.col("o.package.maintainers").alias("m"))
    return hits.filter("package IS NOT NULL").select(
        key, "package", F.explode_outer(F.filter(F.transform("m", lambda m: F.coalesce(m["username"], m["name"])), lambda n: n.isNotNull())).alias("maintainer")
    )


def package_meta(texts: DataFrame, text: str) -> DataFrame:
    """Project documents of both registries: name, ecosystem, author, homepage, licence, latest."""
    get = lambda path: F.get_json_object(F.col(text), path)
    is_pypi = get("$.info.name").isNotNull()
    author = F.coalesce(get("$.author.name"), get("$.author"))
    return texts.select(
        F.when(is_pypi, N.pypi_name(get("$.info.name"))).otherwise(N.npm_name(get("$.name"))).alias("name"),
        F.when(is_pypi, "pypi").otherwise("npm").alias("ecosystem"),
        F.coalesce(F.when(is_pypi, get("$.info.author")).otherwise(author), F.lit("")).alias("author"),
        F.coalesce(F.when(is_pypi, get("$.info.home_page")).otherwise(get("$.homepage")), F.lit("")).alias("homepage"),
        F.coalesce(F.when(is_pypi, get("$.info.license")).otherwise(get("$.license")), F.lit("")).alias("license"),
        F.coalesce(F.when(is_pypi, get("$.info.version")).otherwise(get("$.dist-tags.latest")), F.lit("")).alias("latest"),
        F.when(is_pypi, F.filter(F.transform(F.split(F.coalesce(get("$.info.maintainer"), F.lit("")), ","), lambda p: N.strip(p)), lambda p: p != ""))
        .otherwise(F.transform(F.from_json(get("$.maintainers"), "ARRAY<STRUCT<name:STRING>>"), lambda m: m["name"])).alias("maintainers"),
    )


# -- advisories -----------------------------------------------------------------------------


def read_findings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows by header name; a file without the required columns is refused."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = {"package", "version", "ecosystem", "osv_id"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks required columns {sorted(missing)}")
    have = set(raw.columns)
    return raw.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in S.FINDING_COLUMNS])


def findings(raw: DataFrame) -> DataFrame:
    """Typed findings. ``skipped`` holds the reason a row is unusable, else NULL."""
    text = lambda c: N.strip(F.coalesce(F.col(c), F.lit("")))
    npm = F.lower(text("ecosystem")) == "npm"
    score = text("severity_score").try_cast("double")
    label = F.when(score.isNull(), F.lower(text("severity_score"))).otherwise("")
    name = F.when(npm, N.npm_name("package")).otherwise(text("package"))
    skipped = (
        F.when((text("package") == "") | (text("osv_id") == ""), "missing package or osv_id")
        .when(text("version") == "", "no version")
        .when(name.isNull(), "unkeyable name")
    )
    extra = [F.col(c) for c in raw.columns if c not in S.FINDING_COLUMNS]
    return raw.select(
        *extra, name.alias("package"), text("version").alias("version"), text("ecosystem").alias("ecosystem"),
        text("source_file").alias("source_file"), text("osv_id").alias("osv_id"), N.split_aliases("aliases").alias("aliases"),
        text("summary").alias("summary"), text("cvss_vector").alias("cvss_vector"), score.alias("score"),
        F.when(label.isin(list(S.SEVERITY_RANK)), label).otherwise("").alias("severity_label"),
        text("fixed_version").alias("fixed_version"), text("introduced_version").alias("introduced_version"),
        N.epoch_seconds("published").alias("published"), N.epoch_seconds("modified").alias("modified"),
        text("details").alias("details"), N.split_aliases("references").alias("references"), skipped.alias("skipped"),
    )


def _osv_row(record: Column, ecosystem: Column, name: Column, version: Column, source: Column) -> list[Column]:
    """The findings row of one record for one installed version.

    The first range containing the version speaks; when none does, all do.
    """
    ranges = F.flatten(F.transform(record["affected"], lambda a: F.coalesce(a["ranges"], F.array().cast(f"array<{S.OSV_RANGE}>"))))

    def holds(r: Column) -> Column:
        seen = F.filter(F.transform(r["events"], lambda e: e["introduced"]), lambda x: x.isNotNull())
        ends = F.filter(F.transform(r["events"], lambda e: e["fixed"]), lambda x: x.isNotNull())
        return V.loose_contains(version, F.get(seen, F.size(seen) - 1), F.get(ends, F.size(ends) - 1))

    inside = F.filter(ranges, holds)
    picked = F.when(F.size(inside) > 0, F.slice(inside, 1, 1)).otherwise(ranges)
    events = F.flatten(F.transform(picked, lambda r: r["events"]))
    listed = lambda f: F.array_join(F.array_distinct(F.filter(F.transform(events, lambda e: e[f]), lambda x: F.coalesce(x, F.lit("")) != "")), "; ")
    refs = record["references"]
    primary = F.coalesce(F.get(F.filter(refs, lambda r: r["type"] == "ADVISORY"), F.lit(0))["url"], F.get(refs, F.lit(0))["url"])
    plain = lambda c: F.coalesce(c, F.lit(""))
    return [
        name.alias("package"), version.alias("version"), ecosystem.alias("ecosystem"), source.alias("source_file"),
        plain(record["id"]).alias("osv_id"), plain(F.array_join(record["aliases"], " | ")).alias("aliases"),
        plain(record["summary"]).alias("summary"),
        plain(F.array_join(F.transform(record["severity"], lambda s: s["score"]), " | ")).alias("cvss_vector"),
        plain(record["database_specific"]["severity"]).alias("severity_score"),
        plain(listed("fixed")).alias("fixed_version"), plain(listed("introduced")).alias("introduced_version"),
        plain(record["published"]).alias("published"), plain(record["modified"]).alias("modified"),
        N.strip(F.replace(plain(record["details"]), F.lit("\n"), F.lit(" "))).alias("details"), plain(primary).alias("references"),
    ]


def osv_records(texts: DataFrame, text: str, ecosystem: str, name: str, version: str) -> DataFrame:
    """OSV record texts beside the installed version they were asked for."""
    rows = texts.withColumn("_r", F.from_json(F.col(text), S.OSV_RECORD))
    return rows.filter("_r.id IS NOT NULL").select(*_osv_row(F.col("_r"), F.col(ecosystem), F.col(name), F.col(version), F.lit("")))


def scan_reports(texts: DataFrame, text: str) -> DataFrame:
    """Scanner reports: results, packages, vulnerabilities."""
    result = texts.select(F.explode(F.from_json(F.col(text), S.SCAN_REPORT)["results"]).alias("r"))
    package = result.select(F.col("r.source.path").alias("source"), F.explode("r.packages").alias("p"))
    each = package.select("source", F.col("p.package").alias("q"), F.explode("p.vulnerabilities").alias("v"))
    return each.select(*_osv_row(F.col("v"), F.col("q.ecosystem"), F.col("q.name"), F.col("q.version"), F.coalesce("source", F.lit(""))))


def advisory_documents(texts: DataFrame, text: str) -> DataFrame:
    """Advisory contract files with their defaults."""
    d = F.from_json(F.col(text), S.ADVISORY)
    empty = F.array().cast("array<string>")
    return texts.select(d.alias("d")).filter("d.package IS NOT NULL").select(
        F.coalesce("d.advisory_id", F.lit("UNKNOWN")).alias("advisory_id"), F.col("d.package").alias("package"),
        F.coalesce("d.ecosystem", F.lit("npm")).alias("ecosystem"),
        F.coalesce("d.affected_versions", empty).alias("affected_versions"),
        F.coalesce("d.affected_range", F.lit("")).alias("affected_range"),
        F.coalesce(F.nullif("d.published_at", F.lit(0)), F.lit(S.UNKNOWN_TS)).cast("bigint").alias("published_at"),
        F.coalesce(F.nullif("d.withdrawn_at", F.lit(0)), F.lit(S.STILL_LIVE)).cast("bigint").alias("withdrawn_at"),
        F.coalesce("d.severity", F.lit("unknown")).alias("severity"),
        F.coalesce("d.iocs.paths", empty).alias("ioc_paths"), F.coalesce("d.iocs.content_markers", empty).alias("content_markers"),
    )


# -- code ------------------------------------------------------------------------------------


def code_facts(texts: DataFrame, text: str) -> dict[str, DataFrame]:
    """Tables of a code scan; edges keep only endpoints the scan declares."""
    doc = texts.select(F.from_json(F.col(text), S.CODE_SCAN).alias("d")).select("d.*").filter("service IS NOT NULL")
    item = lambda c: doc.select("service", F.explode(c).alias("x")).select("service", "x.*")
    pair = lambda c: doc.select("service", F.explode(c).alias("x")).select(
        "service", F.get("x", F.lit(0)).alias("src"), F.get("x", F.lit(1)).alias("dst"))
    functions, imports = item("functions"), item("externalImports")
    known = functions.select("service", "key").distinct()
    held = imports.select("service", "key").distinct()
    both = lambda df, right: df.join(known.withColumnRenamed("key", "src"), ["service", "src"], "left_semi").join(
        right.withColumnRenamed("key", "dst"), ["service", "dst"], "left_semi").distinct()
    return {
        "file": item("files"), "function": functions, "external_import": imports,
        "route": item("routes"), "calls": both(pair("calls"), known), "calls_external": both(pair("callsExternal"), held),
    }


def repo_files(files: DataFrame) -> DataFrame:
    """The files a scan looks at, whole."""
    return files.withColumn("content", F.col("content").cast("binary"))


def change_pages(texts: DataFrame, text: str) -> DataFrame:
    """(package, seq) of a change feed; works on a batch and on a stream."""
    rows = texts.select(F.explode(F.from_json(F.col(text), S.CHANGE_PAGE)["results"]).alias("c"))
    return rows.select(N.npm_name("c.id").alias("package"), F.col("c.seq").alias("seq")).filter("package IS NOT NULL")


def read_change_feed(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The feed as a stream of files with one page per line; the checkpoint is the cursor."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
