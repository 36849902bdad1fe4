"""Graph construction: every edge type as a DataFrame job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplygraph import schema as S
from supplygraph.functions import names as N
from supplygraph.functions import versions as V
from supplygraph.operators.fixpoint import reach, top_k
from supplygraph.session import Scratch

# --------------------------------------------------------------------------
# lockfile tree
# --------------------------------------------------------------------------


def lookup_paths(from_path: Column, dep: Column, workspace_hoist: bool = False) -> Column:
    """Where a dependency may live: beside the package, then outwards.

    Each ``node_modules`` component marks one step out. A workspace path holds
    none, so its search ends there unless ``workspace_hoist`` adds the root.
    """
    outer = N.bound(
        lambda parts: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i) == "node_modules"),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
        F.split(from_path, "/"),
    )
    prefixes = F.concat(F.array(from_path), outer)
    if workspace_hoist:
        prefixes = F.array_distinct(F.concat(prefixes, F.array(F.lit(""))))
    return F.transform(
        prefixes, lambda p: F.when(p == "", F.concat(F.lit("node_modules/"), dep)).otherwise(
            F.concat(p, F.lit("/node_modules/"), dep)
        )
    )


def resolve_dependencies(declared: DataFrame, tree: DataFrame, workspace_hoist: bool = False) -> DataFrame:
    """Longest-prefix join: the deepest existing copy that ``from_path`` sees.

    ``declared``: lock_id, from_path, dep. ``tree``: lock_id, path.
    ``found_path`` is NULL where nothing satisfies the name.
    """
    wanted = declared.select("lock_id", "from_path", "dep").distinct()
    tried = wanted.withColumn("path", F.explode(lookup_paths(F.col("from_path"), F.col("dep"), workspace_hoist)))
    hits = (
        tried.join(tree.select("lock_id", "path").distinct(), ["lock_id", "path"])
        .groupBy("lock_id", "from_path", "dep")
        .agg(F.max_by("path", F.length("path")).alias("found_path"))
    )
    return wanted.join(hits, ["lock_id", "from_path", "dep"], "left")


def declared_dependencies(entries: DataFrame, dev: bool = True) -> DataFrame:
    """One row per declared name; a name also listed for development is dev."""
    maps = [("dependencies", False), ("optionalDependencies", False), ("peerDependencies", False)]
    if dev:
        maps.append(("devDependencies", True))
    rows = None
    for column, is_dev in maps:
        part = entries.filter(~F.coalesce("link", F.lit(False))).select(
            "lock_id", F.col("path").alias("from_path"), F.explode(F.map_keys(F.col(column))).alias("dep"),
            F.lit(is_dev).alias("dev"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("lock_id", "from_path", "dep").agg(F.bool_or("dev").alias("dev"))


def dependency_edges(entries: DataFrame, dev: bool = True, workspace_hoist: bool = False,
                     declared: DataFrame | None = None) -> DataFrame:
    """All resolved declarations of the given lockfile entries.

    Declarations come from the entries' maps, or from ``declared`` (lock_id,
    from_path, dep, dev) where they are a table of their own.

    Columns: lock_id, kind (``direct`` service to version, ``transitive``
    version to version, ``unresolved``), service, src, dst, dep, dev.
    """
    keyed = entries.withColumn("is_service", ~F.col("path").startswith("node_modules/")).withColumn(
        "pv", F.when(~F.col("is_service") & ~F.coalesce("link", F.lit(False)), N.version_purl("name", "version"))
    )
    declared = declared_dependencies(keyed, dev) if declared is None else declared
    found = resolve_dependencies(declared, keyed, workspace_hoist)
    to = keyed.select("lock_id", F.col("path").alias("found_path"), F.col("pv").alias("dst"))
    source = keyed.select(
        "lock_id", F.col("path").alias("from_path"), "is_service", F.col("service_name").alias("service"),
        F.col("pv").alias("src"),
    )
    rows = (
        declared.join(found, ["lock_id", "from_path", "dep"])
        .join(source, ["lock_id", "from_path"])
        .join(to, ["lock_id", "found_path"], "left")
    )
    kind = (
        F.when(F.col("found_path").isNull(), "unresolved")
        .when(F.col("dst").isNull(), F.lit(None))
        .when(F.col("is_service"), "direct")
        .when(F.col("src").isNotNull() & (F.col("src") != F.col("dst")), "transitive")
    )
    return (
        rows.withColumn("kind", kind).filter("kind IS NOT NULL")
        .select(
            "lock_id", "kind", F.when(F.col("is_service"), F.col("service")).alias("service"),
            F.when(F.col("kind") == "transitive", F.col("src")).alias("src"), "dst", "dep",
            F.when(F.col("kind") == "direct", F.col("dev")).alias("dev"),
        )
        .distinct()
    )


def npm_graph(entries: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Edge list of the scanner view: the root is a node, no dev dependencies."""
    edges = dependency_edges(entries, dev=False, declared=declared).filter("kind <> 'unresolved'")
    return edges.select(
        "lock_id", F.coalesce("src", N.service_key("service")).alias("parent"), F.col("dst").alias("child")
    ).distinct()


def repo_graph(*edge_lists: DataFrame) -> DataFrame:
    """Nodes of all manifests; ``direct`` marks what no other package pulls in.

    Each list holds parent (NULL for a root listing) and child.
    """
    edges = edge_lists[0]
    for more in edge_lists[1:]:
        edges = edges.unionByName(more)
    edges = edges.select("parent", "child")
    nodes = edges.select(F.col("child").alias("node")).union(edges.filter("parent IS NOT NULL").select("parent")).distinct()
    pulled = edges.filter("parent IS NOT NULL").select(F.col("child").alias("node"), F.lit(False).alias("top")).distinct()
    return nodes.join(pulled, "node", "left").select("node", F.coalesce("top", F.lit(True)).alias("direct"))


# --------------------------------------------------------------------------
# closures
# --------------------------------------------------------------------------


def closure(roots: DataFrame, edges: DataFrame, scratch: Scratch, max_depth: int | None = None, dealt: bool = False) -> DataFrame:
    """Versions reachable from each lockfile's direct dependencies.

    ``roots``: lock_id, service, observed_at, pv, dev. ``edges``: lock_id, src, dst.
    Production and dev roots are walked side by side, so a version reached
    both ways is known as production; depth is the shortest over both, and
    ``via_direct`` the least direct dependency among the shortest arrivals.
    ``dealt``: both are written tables dealt out by ``lock_id``.
    """
    seeds = roots.select(
        "lock_id", "service", "observed_at", "dev", F.col("pv").alias("node"), F.col("pv").alias("via")
    )
    walked = reach(
        seeds, edges, ["lock_id", "service", "observed_at", "dev"], scratch, max_depth,
        carry={"via": F.min("via")}, start_depth=S.DIRECT_DEPTH, edge_keys=["lock_id"], dealt=dealt,
    )
    return walked.groupBy("lock_id", "service", "observed_at", F.col("node").alias("pv")).agg(
        F.min("depth").alias("depth"),
        F.min(F.struct("depth", "via"))["via"].alias("via_direct"),
        F.bool_and("dev").alias("dev_only"),
    )


def holders(roots: DataFrame, edges: DataFrame, scratch: Scratch, dealt: bool = False) -> DataFrame:
    """``pv, service``: the pairs of ``resolved_in`` alone; depth, witness and dev flag are not walked for."""
    seeds = roots.select("lock_id", "service", F.col("pv").alias("node"))
    walked = reach(seeds, edges, ["lock_id", "service"], scratch, start_depth=S.DIRECT_DEPTH, edge_keys=["lock_id"], dealt=dealt)
    return walked.select(F.col("node").alias("pv"), "service").distinct()


def present_in(lock_closure: DataFrame) -> DataFrame:
    """Version to service, over all its lockfiles."""
    return lock_closure.groupBy("pv", "service").agg(
        F.min("depth").alias("depth"), F.bool_and("dev_only").alias("dev"),
        (F.min("depth") == S.DIRECT_DEPTH).alias("direct"),
    )


def resolved_in(lock_closure: DataFrame) -> DataFrame:
    """Version to service with a witness and the window it was held in."""
    return lock_closure.groupBy("pv", "service").agg(
        F.min("depth").alias("depth"),
        F.min(F.struct("depth", "via_direct"))["via_direct"].alias("via_direct"),
        F.bool_and("dev_only").alias("dev_only"),
        F.min("observed_at").alias("first_seen"),
        F.lit(S.STILL_LIVE).cast("bigint").alias("last_seen"),
    )


# --------------------------------------------------------------------------
# requirement and registry edges
# --------------------------------------------------------------------------


def requires(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """Version to declared package, kept when the package is in the universe."""
    return dependencies.join(packages.select(F.col("name").alias("dst_name")).distinct(), "dst_name", "left_semi")


def range_join(ranges: DataFrame, versions: DataFrame, package: str, include_prerelease: bool = False) -> DataFrame:
    """Distinct (package, range) pairs with each admitted version.

    The same texts recur over many packages. Each is parsed once, and the
    (range, version) test is made once per distinct pair of texts; what the
    packages hold is then an equi-join with the pairs that passed.
    """
    wanted = ranges.select(package, "range").distinct()
    held = wanted.join(versions, package)
    parsed = wanted.select("range").distinct().select("range", V.npm_range("range").alias("sets"))
    read = versions.select("version").distinct().select("version", V.semver("version").alias("ver"))
    passed = (
        held.select("range", "version").distinct().join(parsed, "range").join(read, "version")
        .filter(V.satisfies(F.col("ver"), F.col("sets"), include_prerelease)).select("range", "version", "ver")
    )
    return held.join(passed, ["range", "version"])


def satisfied_by(requirements: DataFrame, versions: DataFrame, affected: DataFrame,
                 keep: int = S.SATISFIED_PER_REQUIREMENT) -> DataFrame:
    """Newest ``keep`` admitted versions of a requirement, and every advised one.

    The choice depends on the range alone, so it is made once per distinct
    (package, range) and then joined back to the many requirements.
    """
    pairs = requirements.select(F.col("dst_pk").alias("pk"), "range").distinct()
    admitted = range_join(pairs, versions.select("pk", "pv", "version"), "pk").select("pk", "range", "pv", "ver")
    newest = top_k(admitted, ["pk", "range"], [F.desc("ver"), F.col("pv")], keep).select("pk", "range", "pv")
    advised = admitted.join(affected.select("pv").distinct(), "pv", "left_semi").select("pk", "range", "pv")
    chosen = newest.unionByName(advised).distinct()
    return (
        requirements.withColumnRenamed("dst_pk", "pk")
        .join(chosen.withColumnRenamed("pv", "dst"), ["pk", "range"])
        .groupBy("src", "dst").agg(F.min("range").alias("range"))
    )


def newest_versions(versions: DataFrame, k: int = S.NEWEST_PER_PACKAGE) -> DataFrame:
    parsed = versions.withColumn("ver", V.semver("version")).filter("ver IS NOT NULL")
    return top_k(parsed, ["name"], [F.desc("ver"), F.col("version")], k)


def universe(resolved: DataFrame, advised: DataFrame, known: DataFrame, k: int = S.NEWEST_PER_PACKAGE) -> DataFrame:
    """Versions worth a node: resolved, named by an npm advisory, or newest."""
    named = advised.filter(F.lower("ecosystem").isin("npm", "")).select(N.npm_name("name").alias("name"), "version")
    return (
        resolved.select("name", "version")
        .unionByName(named.filter("name IS NOT NULL"))
        .unionByName(newest_versions(known, k).select("name", "version"))
        .distinct()
    )


def provenance_edges(versions: DataFrame, maintainers: DataFrame) -> DataFrame:
    """(edge, src, dst) for maintainers, scopes, repositories and publishers.

    ``versions``: name, version, repository, publisher, publisher_email.
    ``maintainers``: name, username, email.
    """
    pv = N.version_purl("name", "version")
    pkg = N.package_purl("name")
    parts = [
        maintainers.select(F.lit("maintained_by").alias("edge"), pkg.alias("src"), N.account_key("username", "email").alias("dst")),
        versions.select(F.lit("owned_by").alias("edge"), pkg.alias("src"), N.organization_key(N.scope_of(N.npm_name("name"))).alias("dst")),
        versions.select(F.lit("sourced_from").alias("edge"), pv.alias("src"), N.repository_key("repository").alias("dst")),
        versions.select(F.lit("published_by").alias("edge"), pv.alias("src"), N.account_key("publisher", "publisher_email").alias("dst")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def lock_entries(lock_closure: DataFrame, entries: DataFrame) -> DataFrame:
    """One entry per closure member of a lockfile, with its stored flags."""
    stored = entries.groupBy("lock_id", "pv").agg(F.bool_and("dev").alias("dev"))
    return lock_closure.join(stored, ["lock_id", "pv"]).select(
        F.concat(F.lit("entry:"), F.col("service"), F.lit(":"), F.col("pv")).alias("entry"),
        "lock_id", "service", "pv", "depth", "dev",
    )


def pypi_resolved(nodes: DataFrame, requested: DataFrame) -> DataFrame:
    """Python version to service; the kind says how much the resolution proves."""
    return nodes.join(requested, ["service", "name"], "left").select(
        N.version_purl("name", "version", F.lit("pypi")).alias("pv"), "service",
        N.resolution_kind("manifest", "specifier").alias("kind"), F.lit(S.NO_DEPTH).alias("depth"),
    )


def import_bridge(imports: DataFrame, hoisted: DataFrame | None, entries: DataFrame) -> DataFrame:
    """Import to version: the root copy, else the only one, else every one.

    ``imports``: service, specifier. ``hoisted``: service, pv (root level).
    ``entries``: service, name, pv. ``pv`` is NULL for an unmatched import.
    Without ``hoisted`` the entries are distinct and have ``root`` (true or NULL).
    """
    from pyspark.sql import Window

    wanted = imports.select("service", "specifier").distinct()
    if hoisted is None:
        marked = entries.select("service", F.col("name").alias("specifier"), "pv", "root")
    else:
        # dealt out by what the next join needs, so that the rows move once
        held = entries.select("service", F.col("name").alias("specifier"), "pv").repartition("service", "pv").distinct()
        root = hoisted.select("service", "pv").distinct().withColumn("root", F.lit(True))
        marked = held.join(root, ["service", "pv"], "left")
    same = Window.partitionBy("service", "specifier")
    candidates = wanted.join(marked, ["service", "specifier"], "left").withColumn("n", F.count("pv").over(same)).withColumn("n_root", F.count("root").over(same))
    confidence = (
        F.when(F.col("n") == 0, "unmatched").when(F.col("n_root") > 0, "hoisted")
        .when(F.col("n") == 1, "sole-version").otherwise("ambiguous")
    )
    return (
        candidates.filter("n_root = 0 OR root")
        .select("service", "specifier", "pv", confidence.alias("confidence"))
    )


# --------------------------------------------------------------------------
# files
# --------------------------------------------------------------------------


def ignore_reason(path: Column, patterns: DataFrame | None, files: DataFrame) -> DataFrame:
    """``files`` with ``ignored``: NULL, ``structural`` or the pattern's text.

    A one-part pattern matches any component; a longer one matches from the
    root. Both become equalities on the path's components or prefixes, so the
    patterns are an ordinary join side.
    """
    parts = F.split(path, "/")
    tagged = files.withColumn("_structural", F.arrays_overlap(parts, F.array(*[F.lit(d) for d in S.ALWAYS_IGNORED])))
    if patterns is None:
        return tagged.withColumn("ignored", F.when(F.col("_structural"), "structural")).drop("_structural")
    clean = patterns.select(
        N.strip(F.regexp_replace(F.split("pattern", "#")[0], r"^\s*/+|/+\s*$", "")).alias("pattern")
    ).filter("pattern <> ''").distinct()
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
                           lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    probes = files.select(path.alias("_path"), F.explode(F.array_distinct(F.concat(parts, prefixes))).alias("pattern")).distinct()
    hits = probes.join(clean, "pattern").groupBy("_path").agg(F.min("pattern").alias("pattern"))
    return (
        tagged.withColumn("_path", path).join(hits, "_path", "left")
        .withColumn("ignored", F.when(F.col("_structural"), "structural").otherwise(F.col("pattern")))
        .drop("_structural", "_path", "pattern")
    )


def artifact_scan(files: DataFrame, ioc_paths: list[str], content_markers: list[str], services: DataFrame) -> DataFrame:
    """Persistence artefacts: service, path, kind, sha256.

    ``files``: repo, service (NULL for a file of the repository root), path,
    content. ``ioc_paths`` and ``content_markers`` are one advisory's indicator
    lists. A root artefact counts for every service of its repository.
    """
    content = F.col("content")
    watched, by_path, by_content = F.lit(False), F.lit(False), F.lit(False)
    for folder in S.WATCHED_DIRS:
        watched = watched | F.col("path").startswith(folder + "/")
    for glob in ioc_paths:
        by_path = by_path | N.glob_match(F.col("path"), F.lit(glob))
    for marker in content_markers:
        by_content = by_content | F.contains(content, F.encode(F.lit(marker), "UTF-8"))
    kind = F.when(by_path, "ioc-path").when(by_content, "ioc-content").otherwise("watched-dir")
    found = files.filter(watched | by_path).select("repo", "service", "path", kind.alias("kind"), F.sha2(content, 256).alias("sha256"))
    shared = found.filter("service IS NULL").drop("service").join(services.select("repo", "service").distinct(), "repo")
    return found.filter("service IS NOT NULL").unionByName(shared).drop("repo")
