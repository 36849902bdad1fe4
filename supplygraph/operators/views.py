"""Read models: the tables other tools consume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplygraph import schema as S
from supplygraph.functions import names as N
from supplygraph.functions import versions as V
from supplygraph.operators import findings as G
from supplygraph.operators import reach as R
from supplygraph.operators.fixpoint import top_k

# -- lists ---------------------------------------------------------------------


def capped(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """First rows in order, each with the number of rows left out; all of them without a limit."""
    if limit is None:
        return df.withColumn("omitted", F.lit(0).cast("bigint"))
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(limit).withColumn("omitted", F.greatest(total - limit, F.lit(0)).cast("bigint"))


def capped_per(df: DataFrame, group: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The same per group; the count comes from its own partial aggregate."""
    if limit is None:
        return df.withColumn("omitted", F.lit(0).cast("bigint"))
    totals = df.groupBy(*group).agg(F.count("*").alias("_n"))
    return top_k(df, group, order, limit).join(totals, group).withColumn(
        "omitted", F.greatest(F.col("_n") - limit, F.lit(0)).cast("bigint")
    ).drop("_n")


def threat_list(threat: DataFrame, only_reaching: bool = False, severity: str = "", limit: int | None = None) -> DataFrame:
    """Threats, foremost first if ``limit`` asks for that many of them."""
    rows = threat.filter("in_code") if only_reaching else threat
    if severity:
        rows = rows.filter(F.col("severity") == severity.strip().lower())
    return capped(rows, G.threat_order(), limit)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """No self loops, each (src, dst) once."""
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("edge").alias("edge"))


def closure_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one set missing from the other, both ways."""
    cols = left.columns
    return left.join(right, cols, "left_anti").withColumn("side", F.lit("missed")).unionByName(
        right.join(left, cols, "left_anti").withColumn("side", F.lit("extra"))
    )


# -- graphs ---------------------------------------------------------------------


def package_graph(fleet, subjects: DataFrame, admits: int | None = None, related: int = 24, heated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Six layers around each subject version: nodes and edges.

    Without ``heated`` the nodes have no heat, which the edges never need. All versions that admit a subject are shown unless ``admits`` says how many.
    ``related`` names for each subject are a sample by name: all of them would
    be every account's members times its subjects (``reach.shared_identity`` has
    them in a row each).
    """
    mine = subjects.select("pv").distinct()
    threat_nodes = (
        R.advisories_for(mine, fleet.affects).select("pv", F.col("advisory_id").alias("node"))
        .unionByName(fleet.incident.join(mine, "pv", "left_semi").select("pv", F.col("incident_id").alias("node")))
    )
    admitted = capped_per(R.direct_dependents(mine, fleet.satisfied_by), ["pv"], [F.col("dependent")], admits).select(
        "pv", F.col("dependent").alias("node")
    )
    locks = fleet.entry.join(mine, "pv", "left_semi").select("pv", F.concat(F.lit("lock:"), F.col("lock_id").cast("string")).alias("node"), "service").distinct()
    projects = R.exposed(mine, fleet.resolved_in).select("pv", N.service_key("service").alias("node"))
    # neighbours: a few least names per account suffice for the least few overall
    named = fleet.package_version.join(mine, "pv", "left_semi").select("pv", "name")
    members = top_k(fleet.maintained_by.select("maintainer", "name").distinct(), ["maintainer"], [F.col("name")], related + 1)
    kin = (
        named.join(fleet.maintained_by.select("name", "maintainer").distinct(), "name")
        .join(members.select("maintainer", F.col("name").alias("node")), "maintainer")
        .filter("node <> name").select("pv", "node").distinct()
    )
    kin = top_k(kin, ["pv"], [F.col("node")], related).drop("rank")

    def layer(df: DataFrame, name: str) -> DataFrame:
        return df.select("pv", F.lit(name).alias("layer"), "node")

    nodes = (
        layer(threat_nodes, "threat").unionByName(layer(mine.withColumn("node", F.col("pv")), "version"))
        .unionByName(layer(admitted, "range-admits")).unionByName(layer(locks, "resolution"))
        .unionByName(layer(projects, "project")).unionByName(layer(kin, "related"))
    ).distinct()
    if heated:
        nodes = nodes.join(fleet.heat.select("node", "heat"), "node", "left")
    else:
        nodes = nodes.withColumn("heat", F.lit(None).cast("double"))
    # a compromised version is hot whatever its advisories say
    compromised = fleet.incident.select("pv", F.col("pv").alias("node"), F.lit(1.0).alias("_own")).distinct()
    nodes = nodes.join(compromised, ["pv", "node"], "left").withColumn("heat", F.greatest("heat", "_own")).drop("_own")

    def link(df: DataFrame, src: Column, dst: Column, name: str) -> DataFrame:
        return df.select("pv", src.alias("src"), dst.alias("dst"), F.lit(name).alias("edge"))

    pv, node = F.col("pv"), F.col("node")
    edges = (
        link(threat_nodes, node, pv, "names").unionByName(link(admitted, node, pv, "admits"))
        .unionByName(link(locks, pv, node, "resolved_by"))
        .unionByName(link(locks, node, N.service_key("service"), "lockfile_of"))
        .unionByName(link(kin, pv, node, "shares_identity"))
    ).distinct()
    return nodes.select("pv", "layer", "node", "heat"), edges


def project_graph(fleet, clean: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per service: every hot version and the clean direct ones (``clean`` of them, if given); their edges."""
    held = fleet.resolved_in.select("service", "pv", "depth").join(
        R.version_heat(fleet.hot_versions).select(F.col("node").alias("pv"), "heat"), "pv", "left"
    )
    cold = capped_per(held.filter(F.col("heat").isNull() & (F.col("depth") == 1)), ["service"], [F.col("pv")], clean).select(*held.columns)
    nodes = held.filter("heat IS NOT NULL").unionByName(cold).withColumn("layer", F.least("depth", F.lit(5)))
    nodes = fleet.scratch.save(nodes.select("service", "pv", "layer", "heat"), "project_nodes")
    within = fleet.lock_edge.join(fleet.entry.select("lock_id", "service").distinct(), "lock_id").select("service", "src", "dst").distinct()
    shown = nodes.select("service", "pv")
    edges = within.join(shown.withColumnRenamed("pv", "src"), ["service", "src"], "left_semi").join(
        shown.withColumnRenamed("pv", "dst"), ["service", "dst"], "left_semi"
    )
    return nodes, edges


def micro_graph(fleet, depth: DataFrame) -> DataFrame:
    """Code-tier nodes with their layer and heat."""
    handlers = fleet.route.select("fn", F.lit(True).alias("handles")).distinct()
    fn_key = F.concat(F.lit("fn:"), F.col("fn").cast("string"))
    functions = fleet.function.join(handlers, "fn", "left").join(depth, "fn", "left").select(
        fn_key.alias("node"), "service", F.when(F.col("handles"), "handler").otherwise("function").alias("layer"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("column"),
    )
    routes = fleet.route.select(F.concat(F.lit("route:"), F.col("pattern")).alias("node"), "service", F.lit("route").alias("layer"), F.lit(0).alias("column"))
    entries = fleet.function.select(N.service_key("service").alias("node"), "service", F.lit("entry").alias("layer"), F.lit(0).alias("column")).distinct()
    imports = fleet.external_import.select(
        F.concat(F.lit("import:"), F.col("service"), F.lit(":"), F.col("specifier")).alias("node"), "service",
        F.lit("import").alias("layer"), F.lit(S.MAX_CALL_RANK + 1).alias("column"),
    ).distinct()
    files = fleet.function.select(R.file_key().alias("node"), "service", F.lit("file").alias("layer"), F.lit(0).alias("column")).distinct()
    nodes = entries.unionByName(routes).unionByName(files).unionByName(functions).unionByName(imports)
    return nodes.join(fleet.heat.select("node", "heat"), "node", "left")


def micro_graph_edges(fleet) -> DataFrame:
    """``src, dst, edge`` between the nodes of ``micro_graph``."""
    fn = lambda c: F.concat(F.lit("fn:"), F.col(c).cast("string"))
    imported = F.concat(F.lit("import:"), F.col("service"), F.lit(":"), F.col("specifier"))
    link = lambda df, src, dst, edge: df.select(src.alias("src"), dst.alias("dst"), F.lit(edge).alias("edge"))
    return (
        link(fleet.function, N.service_key("service"), R.file_key(), "holds")
        .unionByName(link(fleet.function, R.file_key(), fn("fn"), "contains"))
        .unionByName(link(fleet.route, F.concat(F.lit("route:"), F.col("pattern")), fn("fn"), "handled_by"))
        .unionByName(link(fleet.calls, fn("src"), fn("dst"), "calls"))
        .unionByName(link(fleet.calls_external, fn("fn"), imported, "uses"))
        .distinct()
    )


def full_graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], cap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes, the edges between them, and the counts; with ``cap`` that many nodes per label at most.

    What a cap leaves out is the difference of ``n_total`` and ``n_shown``. ``nodes``: label to (node). ``edges``: type to (src, dst).
    """
    every = None
    for label, df in nodes.items():
        part = df.select(F.lit(label).alias("label"), "node")
        every = part if every is None else every.unionByName(part)
    every = every.distinct()
    kept = every if cap is None else top_k(every, ["label"], [F.col("node")], cap).drop("rank")
    links = None
    for kind, df in edges.items():
        part = df.select(F.lit(kind).alias("edge"), "src", "dst")
        links = part if links is None else links.unionByName(part)
    links = links.distinct()
    names = kept.select("node").distinct()
    shown = links.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(
        names.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )
    tally = lambda df, col, name: df.groupBy(F.col(col).alias("kind")).agg(F.count("*").alias(name))
    stats = (
        tally(every, "label", "n_total").join(tally(kept, "label", "n_shown"), "kind", "left")
        .unionByName(tally(links, "edge", "n_total").join(tally(shown, "edge", "n_shown"), "kind", "left"))
        .select("kind", "n_total", G.zero("n_shown"))
    )
    return kept, shown, stats


def node_detail(df: DataFrame) -> DataFrame:
    """(node, property, value) for every property that says something."""
    props = F.create_map(*[x for c in df.columns[1:] for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(F.col(df.columns[0]).alias("node"), F.explode(props).alias("property", "value")).filter(
        "value IS NOT NULL AND value NOT IN ('', '0', 'false')"
    )


# -- threats and fixes -------------------------------------------------------------


def fix_list(df: DataFrame, key: str, texts: str) -> DataFrame:
    """(key, fix, position): joined lists taken apart, distinct, in version order."""
    from pyspark.sql import Window

    parts = F.filter(F.transform(F.split(F.col(texts), "[;,]"), lambda p: N.strip(p)), lambda p: p != "")
    fixes = df.select(key, F.explode(parts).alias("fix")).distinct().withColumn("ver", V.semver("fix"))
    order = Window.partitionBy(key).orderBy(F.col("ver").isNull(), "ver", "fix")
    return fixes.withColumn("position", F.row_number().over(order)).drop("ver")


def recommended_fix(installed: DataFrame, fixes: DataFrame) -> DataFrame:
    """Smallest published fix above the installed version; never a downgrade.

    ``installed``: pv, version. ``fixes``: pv, fix.
    """
    ranked = installed.join(fixes, "pv").withColumn("ver", V.semver("fix")).withColumn("now", V.semver("version"))
    better = F.col("ver").isNotNull() & (F.col("now").isNull() | (F.col("ver") > F.col("now")))
    best = F.min_by("fix", F.when(better, F.struct("ver", "fix")))
    return ranked.groupBy("pv").agg(F.coalesce(best, F.lit("")).alias("recommended_fix"))


def threat_fixes(fleet) -> DataFrame:
    t = fleet.threat.select("pv", "version")
    return recommended_fix(t, fleet.affects.select("pv", F.col("fixed_version").alias("fix")))


def advisory_chips(fleet) -> DataFrame:
    """Every advisory with its least held version, if any."""
    example = fleet.affects.withColumn("ver", V.semver("version")).groupBy("advisory_id").agg(
        F.min_by("pv", F.struct("ver", "pv")).alias("example"), F.count("*").alias("n_held")
    )
    return fleet.advisory.select("advisory_id", "name", "severity").join(example, "advisory_id", "left").select(
        "advisory_id", "name", "severity", "example", G.zero("n_held")
    )


def resolve_package(fleet, query: str) -> DataFrame:
    """Exact name or ``name@version``, else a substring of held names."""
    held = fleet.resolved_in.join(fleet.package_version.select("pv", "name", "version"), "pv")
    text = query.strip().lower()
    at = text.rfind("@")
    name, version = (text[:at], text[at + 1:]) if at > 0 else (text, "")
    exact = (F.col("name") == name) & (F.lit(version == "") | (F.col("version") == version))
    mode = (
        F.when(exact, 0).when(F.col("name").contains(text), 1)
        .when(F.lit(bool(name)) & F.col("name").contains(name), 2)
    )
    ranked = held.withColumn("mode", mode).filter("mode IS NOT NULL")
    best = ranked.agg(F.min("mode")).scalar()
    return ranked.filter(F.col("mode") == best).groupBy("name", "version").agg(
        F.count_distinct("service").alias("n_services"), F.bool_or(F.col("depth") == 1).alias("direct"),
        F.bool_and("dev_only").alias("dev_only"),
        F.when(F.min("mode") == 0, "exact").otherwise("substring").alias("match_type"),
    )


def threat_detail(fleet) -> DataFrame:
    """One row per (threat, advisory) with texts and fixes."""
    return fleet.threat_base.select("pv", "kind", F.col("severity").alias("threat_severity")).join(
        fleet.affects.select("pv", "advisory_id", "severity", "fixed_version", "introduced_version"), "pv", "left"
    ).join(fleet.advisory.select("advisory_id", "summary"), "advisory_id", "left")


def impacted_services(fleet, subjects: DataFrame) -> DataFrame:
    return R.exposed(subjects, fleet.resolved_in).select(
        "pv", "service", (F.col("depth") == 1).alias("direct"), (~F.col("dev_only")).alias("production"), "depth"
    )


def remediation(fleet) -> DataFrame:
    """Per threat: the fix to take, who takes it directly, and how soon."""
    scanned = fleet.function.select("service").distinct().withColumn("scanned", F.lit(True))
    impact = fleet.resolved_in.join(scanned, "service", "left").groupBy("pv").agg(
        F.count_if(F.col("depth") == 1).alias("n_direct"), F.count_if(F.col("depth") > 1).alias("n_indirect"),
        F.count_if(~F.col("dev_only")).alias("n_production"), F.bool_or("scanned").alias("scanned"),
    )
    priority = (
        F.when(F.col("in_code"), "P1").when(F.col("scanned").isNull(), "UNKNOWN")
        .when(F.coalesce("n_production", F.lit(0)) > 0, "P3").otherwise("P3-dev")
    )
    return fleet.threat.join(impact, "pv", "left").join(threat_fixes(fleet), "pv", "left").select(
        "pv", "kind", "severity", F.coalesce("recommended_fix", F.lit("")).alias("recommended_fix"),
        G.zero("n_direct"), G.zero("n_indirect"), G.zero("n_production"), priority.alias("priority"),
    )


def scoped_threats(fleet) -> DataFrame:
    """Threats per workspace: only versions its services hold."""
    held = fleet.resolved_in.join(fleet.workspace, "service").groupBy("workspace", "pv").agg(
        F.count_distinct("service").alias("n_services")
    )
    return held.join(fleet.threat.drop("n_services"), "pv").join(threat_fixes(fleet), "pv", "left").select(
        "workspace", "pv", "kind", "severity", "in_code", "n_services", F.coalesce("recommended_fix", F.lit("")).alias("recommended_fix")
    )


def advisory_facts(by_hand: DataFrame, generated: DataFrame) -> DataFrame:
    """All advisory documents by id; a hand-written one replaces a generated one."""
    both = by_hand.withColumn("source_rank", F.lit(0)).unionByName(generated.withColumn("source_rank", F.lit(1)))
    rest = [c for c in both.columns if c not in ("advisory_id", "source_rank")]
    return both.groupBy("advisory_id").agg(
        F.min_by(F.struct(*rest), "source_rank").alias("d"), F.min("source_rank").alias("source_rank")
    ).select("advisory_id", "d.*", "source_rank")


def dependency_path(paths: DataFrame, per_spec: int | None = None) -> DataFrame:
    """Rendered chains ``service -> ... -> version``, ``per_spec`` of a version if given, with the number left out."""
    few = capped_per(paths.drop("rank"), ["source"], [F.col("hops"), F.col("path")], per_spec)
    label = lambda p: F.regexp_replace(F.regexp_replace(p, "^pkg:[^/]+/", ""), "^svc:", "")
    return few.select(
        "source", F.col("target").alias("service"), "hops",
        F.array_join(F.transform(F.reverse("path"), label), " -> ").alias("chain"), "omitted",
    )


def services(fleet) -> DataFrame:
    held = fleet.resolved_in.groupBy("service").agg(F.count("*").alias("n_packages"))
    return fleet.workspace.join(held, "service", "left").select("service", "workspace", G.zero("n_packages"))


def service_profile(fleet, service: str, limit: int | None = None) -> DataFrame:
    """Threats that a service holds, beside how many packages it holds, how many directly, and how many threats are left out."""
    mine = fleet.resolved_by(service)
    held, direct = mine.agg(F.count("*")).scalar(), mine.agg(F.count_if(F.col("depth") == S.DIRECT_DEPTH)).scalar()
    rows = mine.join(G.graded(fleet), "pv").withColumn("n_services", F.lit(1))
    return capped(rows, G.threat_order(), limit).select(
        "pv", "kind", "severity", "depth", "dev_only", "in_code", held.alias("n_packages"), direct.alias("n_direct"), "omitted"
    )


def search_advisories(fleet, query: str) -> DataFrame:
    """Substring search over id, package, summary and aliases of advisories that hit a held version."""
    text = F.lower(F.concat_ws("\n", "advisory_id", "name", "summary", "alias"))
    rows = fleet.advisory.join(fleet.advisory_alias, "advisory_id", "left")
    held = fleet.affects.select("advisory_id").distinct()
    return rows.filter(text.contains(query.strip().lower())).join(held, "advisory_id", "left_semi").select(
        "advisory_id", "name", "severity", "fixed_version"
    ).distinct()


def workspace_collisions(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.lower("service").alias("service")).agg(
        F.count_distinct("workspace").alias("n_workspaces")
    ).filter("n_workspaces > 1")


def scope_filter(rows: DataFrame, workspace: DataFrame, name: str) -> DataFrame:
    """Any service-keyed result cut to one workspace."""
    return rows.join(workspace.filter(F.col("workspace") == name).select("service"), "service", "left_semi")


# -- provenance and publishing ---------------------------------------------------------


def provenance(fleet, subjects: DataFrame, signals: DataFrame) -> DataFrame:
    """Who published a version, whether they are listed, and what was noticed."""
    listed = fleet.maintained_by.select("name", F.col("maintainer").alias("publisher"), F.lit(True).alias("listed")).distinct()
    counts = fleet.maintained_by.groupBy("name").agg(F.count_distinct("maintainer").alias("n_maintainers"))
    noticed = signals.groupBy(F.col("package").alias("name")).agg(F.count("*").alias("n_signals"))
    rows = (
        subjects.select("pv").distinct().join(fleet.published_by, "pv", "left").join(fleet.sourced_from.select("pv", "repo"), "pv", "left")
        .join(listed, ["name", "publisher"], "left").join(counts, "name", "left").join(noticed, "name", "left")
        .join(fleet.incident.groupBy("pv").agg(F.count("*").alias("n_incidents")), "pv", "left")
    )
    return rows.select(
        "pv", F.coalesce("publisher", F.lit("not recorded")).alias("publisher"),
        N.is_service_identity("publisher").alias("automation"),
        F.when(F.col("n_maintainers").isNotNull(), F.coalesce("listed", F.lit(False))).alias("listed"),
        F.coalesce("repo", F.lit("not recorded")).alias("repo"), G.zero("n_maintainers"), G.zero("n_incidents"), G.zero("n_signals"),
    )


# fixed values: order in which signals are read, most telling first
SIGNAL_ORDER = [
    "PUBLISHER_NOT_MAINTAINER", "INSTALL_SCRIPT_ADDED", "REPOSITORY_CHANGED", "REPOSITORY_REMOVED",
    "DORMANCY_BREAK", "PUBLISH_BURST",
]


def publish_anomalies(signals: DataFrame, held: DataFrame) -> DataFrame:
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SIGNAL_ORDER]), F.col("signal")), F.lit(99))
    return signals.join(held.select("package").distinct(), "package", "left_semi").withColumn(
        "signal_rank", order.cast("bigint")
    )


def attack_frontier(fleet, subjects: DataFrame) -> DataFrame:
    held = fleet.resolved_in.join(fleet.package_version.select("pv", "name"), "pv").select("name").distinct()
    return G.frontier(fleet, subjects).join(held.withColumn("h", F.lit(True)), "name", "left").withColumn(
        "already_used_here", F.coalesce("h", F.lit(False))
    ).drop("h")


def incident_dossier(fleet, squats: DataFrame) -> DataFrame:
    """Per incident, the size of every part of the answer.

    ``squats``: ``candidate, target``. ``n_identities`` are the accounts to look
    after: the package's maintainers and the version's publisher, if that is no
    service.
    """
    subjects = fleet.incident.select("pv", "name").distinct()
    wide = G.blast_radius(fleet, subjects, squats)
    accounts = subjects.join(fleet.maintained_by.select("name", F.col("maintainer").alias("who")), "name").select("pv", "who").unionByName(
        subjects.select("pv").join(fleet.published_by, "pv").filter(~N.is_service_identity("publisher")).select("pv", F.col("publisher").alias("who"))
    ).groupBy("pv").agg(F.count_distinct("who").alias("n_identities"))
    hot = fleet.heat.filter("hops > 0").groupBy(F.col("source").alias("pv")).agg(F.count("*").alias("n_hot"))
    ranges = fleet.scratch.save(G.range_only(fleet), "range_only")
    return fleet.incident.select("incident_id", "pv").join(wide, "pv").join(ranges.select("pv", "range_only"), "pv", "left").join(
        hot, "pv", "left"
    ).join(accounts, "pv", "left").select(
        "incident_id", "n_direct", "n_transitive", "n_entries", "n_projects", G.zero("range_only"), "n_live", "n_advisories",
        "n_shared_maintainer", "n_typosquats", G.zero("n_identities"), G.zero("n_hot"),
    )


def briefing(fleet, top: int = 12) -> DataFrame:
    """The situation of every workspace: counts and its foremost threats."""
    rows = scoped_threats(fleet).join(fleet.package_version.select("pv", "name", "version"), "pv")
    return capped_per(rows, ["workspace"], G.threat_order(), top).select(
        "workspace", "rank", "pv", "kind", "severity", "in_code", "n_services", "omitted"
    )


def repo_inventory(files: DataFrame) -> DataFrame:
    """Per repository: lockfiles kept or ignored and source files by extension.

    ``files``: repo, path, ignored (NULL when kept).
    """
    lock = F.substring_index("path", "/", -1) == "package-lock.json"
    kept = F.col("ignored").isNull()
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy("repo").agg(
        F.count_if(lock & kept).alias("n_lockfiles"), F.count_if(lock & ~kept).alias("n_ignored"),
        F.count_if(kept & ext.isin("js", "jsx", "mjs", "cjs")).alias("n_js"),
        F.count_if(kept & ext.isin("ts", "tsx")).alias("n_ts"),
        F.count_if(kept & (ext == "py")).alias("n_py"),
        (F.count_if(lock & kept) > 0).alias("usable"),
    )


# -- text audits ------------------------------------------------------------------------

# fixed values: words that make a message plausibly about supply chains
DOMAIN_WORDS = """
advisory advisories affect affected attack blast breach compromise compromised
cve cvss dependency dependencies dep deps deprecated exploit exposed exposure
fix fixed ghsa graph import imported incident ingest install installed lockfile
maintainer malicious npm package packages patch patched publish publisher
radius reach reachable reached remediate remediation repo repository resolve
resolved risk rotate scan scanned secure security service services severity
supply threat threats transitive upgrade version versions vulnerable
vulnerability vulnerabilities worm
""".split()

# fixed values: patterns of mentions and of plainly unrelated requests
SPEC_MENTION = r"(?i)(?<![\w@/-])(@?[a-z0-9][\w.-]*(?:/[\w.-]+)?)@(\d[\w.-]*)"
ANY_SPEC = r"[\w@/.-]+@[\w.-]+"
CREATIVE = (
    r"(?i)\b(write|compose|tell)\s+(me\s+)?(a|an|some)\s+"
    r"(poem|song|haiku|story|joke|essay|rap|limerick|screenplay)\b"
)
TRANSLATE = r"(?i)\btranslate\b.+\b(to|into)\s+\w+"
ARITHMETIC = r"\d\s*[+\-*/^%]\s*\d"


def ungrounded(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, spec): versions a text names that nothing on record knows.

    ``known``: spec, lower case.
    """
    mentions = texts.select(
        key,
        F.explode(F.regexp_extract_all(F.col(text), F.lit(SPEC_MENTION), F.lit(0))).alias("m"),
    )
    name = F.regexp_extract("m", r"^(.+)@[^@]*$", 1)
    version = F.regexp_replace(F.regexp_extract("m", r"@([^@]*)$", 1), r"[.,;:)-]+$", "")
    specs = mentions.filter(version != "").select(key, F.lower(F.concat(name, F.lit("@"), version)).alias("spec")).distinct()
    return specs.join(known.select("spec").distinct(), "spec", "left_anti").select(key, "spec")


def known_specs(fleet, published: DataFrame | None = None) -> DataFrame:
    """Held, affected, fixed and published versions."""
    spec = lambda n, v: F.lower(F.concat(F.col(n), F.lit("@"), F.col(v))).alias("spec")
    rows = fleet.package_version.select(spec("name", "version")).unionByName(
        fleet.advisory.select(spec("name", "fixed_version"))
    ).unionByName(fleet.affects.select(spec("name", "version")))
    if published is not None:
        rows = rows.unionByName(published.select(spec("package", "version")))
    return rows.distinct()


def off_topic(text) -> Column:
    """Why a message is refused, or NULL. Any domain word lets it through."""
    body = N.strip(text)
    words = F.split(F.regexp_replace(F.lower(body), "[^a-z]+", " "), " ")
    on_topic = F.arrays_overlap(words, F.array(*[F.lit(w) for w in DOMAIN_WORDS])) | body.rlike(ANY_SPEC)
    return (
        F.when((body == "") | on_topic, F.lit(None))
        .when(body.rlike(CREATIVE), "asked for creative writing")
        .when(body.rlike(TRANSLATE), "asked for a translation")
        .when((F.length(body) <= 60) & body.rlike(ARITHMETIC), "asked to do arithmetic")
    )
