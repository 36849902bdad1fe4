"""Questions about reachability. Batch by default; filter the subjects to pin one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplygraph import schema as S
from supplygraph.functions import names as N
from supplygraph.operators.fixpoint import reach, rendered, shortest_paths, witness_forest
from supplygraph.session import KeyedTable, Scratch


def exact_lookup(versions: KeyedTable, *pvs: str) -> DataFrame:
    """The rows of the given versions, from the files that may hold them."""
    return versions.lookup(*pvs)


def held_versions(versions: DataFrame, names: DataFrame) -> DataFrame:
    """Every version present of the given packages."""
    return versions.join(names.select("name").distinct(), "name", "left_semi")


def direct_dependents(subjects: DataFrame, satisfied_by: DataFrame) -> DataFrame:
    """Versions whose declared range admits the subject."""
    return subjects.select("pv").join(satisfied_by.withColumnRenamed("dst", "pv"), "pv").select(
        "pv", F.col("src").alias("dependent"), "range"
    )


def transitive_dependents(subjects: DataFrame, satisfied_by: DataFrame, scratch: Scratch,
                          max_depth: int = S.MAX_REVERSE_DEPTH) -> DataFrame:
    """Distinct versions that reach the subject backwards within the bound. ``satisfied_by`` is a written table."""
    back = satisfied_by.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = subjects.select("pv", F.col("pv").alias("node"))
    return reach(seeds, back, ["pv"], scratch, max_depth, saved=True).filter("depth > 0").select(
        "pv", F.col("node").alias("dependent"), "depth"
    )


def lockfile_entries(subjects: DataFrame, entries: DataFrame) -> DataFrame:
    return entries.join(subjects.select("pv").distinct(), "pv", "left_semi")


def exposed(subjects: DataFrame, resolved_in: DataFrame) -> DataFrame:
    """Services holding a subject version, with depth, witness and window."""
    return resolved_in.join(subjects.select("pv").distinct(), "pv", "left_semi")


def live_window(windows: DataFrame, resolved_in: DataFrame) -> DataFrame:
    """Interval overlap: the version was held while it was live.

    ``windows``: pv, since, until. An unknown time never overlaps.
    """
    return windows.select("pv", "since", "until").join(resolved_in, "pv").filter(
        "first_seen > 0 AND first_seen <= until AND last_seen >= since"
    )


def shared_identity(links: DataFrame, subjects: DataFrame, identity: str, member: str) -> DataFrame:
    """Members of every identity that also holds a subject.

    One row per (identity, member) with the number of *other* subjects the
    identity connects it to, so an account with a third of all packages costs
    its own size, not its square. Pin one subject to get its neighbours.
    """
    flagged = links.select(identity, member).distinct().join(
        subjects.select(F.col(subjects.columns[0]).alias(member), F.lit(1).alias("is_subject")).distinct(), member, "left"
    )
    totals = flagged.groupBy(identity).agg(F.count("is_subject").alias("n_subjects")).filter("n_subjects > 0")
    others = F.col("n_subjects") - F.coalesce("is_subject", F.lit(0))
    return flagged.join(totals, identity).select(
        identity, member, others.alias("other_subjects"), F.col("is_subject").isNotNull().alias("is_subject")
    ).filter("other_subjects > 0")


def imitators(squats: DataFrame, subjects: DataFrame) -> DataFrame:
    return squats.join(subjects.select(F.col("name").alias("target")).distinct(), "target", "left_semi")


def incidents_for(versions: DataFrame, incident: DataFrame) -> DataFrame:
    return versions.select("pv").join(incident.select("pv", "incident_id", "status", "live_from", "live_until"), "pv")


def advisories_for(versions: DataFrame, affects: DataFrame) -> DataFrame:
    return affects.join(versions.select("pv").distinct(), "pv", "left_semi").select(
        "pv", "advisory_id", "severity", "fixed_version", "introduced_version", "fixed_published_at"
    )


# -- paths -------------------------------------------------------------------


def upward_edges(depends_on: DataFrame, roots: DataFrame) -> DataFrame:
    """From a version to what depends on it, ending at services."""
    return depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(
        roots.select(F.col("pv").alias("src"), N.service_key("service").alias("dst")).distinct()
    )


def paths_one_source(subjects: DataFrame, up: DataFrame, services: DataFrame, scratch: Scratch,
                     max_hops: int, limit: int = S.PATHS_PER_SOURCE) -> DataFrame:
    """At most ``limit`` whole paths per version, shortest first."""
    return shortest_paths(
        subjects.select(F.col("pv").alias("source")), up, services.select(N.service_key("service").alias("node")),
        scratch, max_hops, limit, any_target=True,
    )


def paths_many(subjects: DataFrame, up: DataFrame, services: DataFrame, scratch: Scratch,
               max_hops: int = S.MAX_PATH_HOPS, k: int = S.PATHS_PER_PAIR) -> DataFrame:
    return shortest_paths(
        subjects.select(F.col("pv").alias("source")), up, services.select(N.service_key("service").alias("node")),
        scratch, max_hops, k,
    )


def exposure_forest(vulnerable: DataFrame, depends_on: DataFrame, scratch: Scratch, max_depth: int | None = None) -> DataFrame:
    """``pv, node, depth, pred``: everything above each vulnerable node, with one predecessor on a shortest path."""
    back = depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return witness_forest(vulnerable.select("pv", F.col("pv").alias("node")), back, scratch, max_depth)


def exposure_paths(vulnerable: DataFrame, depends_on: DataFrame, scratch: Scratch, max_depth: int | None = None) -> DataFrame:
    """One shortest path from each vulnerable node to everything above it: at every step back the least predecessor."""
    return rendered(exposure_forest(vulnerable, depends_on, scratch, max_depth), scratch).filter("depth > 0")


# -- code --------------------------------------------------------------------


def calling_functions(subjects: DataFrame, bridge: DataFrame, calls_external: DataFrame) -> DataFrame:
    """Functions that call an import resolving to a subject version."""
    hit = bridge.join(subjects.select("pv").distinct(), "pv", "left_semi")
    return hit.join(calls_external, ["service", "specifier"]).select("pv", "service", "fn", "specifier").distinct()


def reachable_routes(functions: DataFrame, calls: DataFrame, routes: DataFrame, scratch: Scratch,
                     max_depth: int = S.MAX_CALLER_DEPTH) -> DataFrame:
    """Routes handled by a function or by one of its callers within the bound."""
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = functions.select("fn", F.col("fn").alias("node")).distinct()
    callers = reach(seeds, back, ["fn"], scratch, max_depth)
    handler = routes.select(F.col("fn").alias("node"), "method", "pattern", F.col("service").alias("route_service"))
    return callers.join(handler, "node").select("fn", "method", "pattern", "route_service", "depth")


def artifacts_for(exposed_services: DataFrame, artifacts: DataFrame) -> DataFrame:
    return artifacts.join(exposed_services.select("service").distinct(), "service", "left_semi")


def watched_dir(path):
    out = F.lit("")
    for folder in reversed(S.WATCHED_DIRS):
        out = F.when(path.startswith(folder + "/") | (path == folder), folder).otherwise(out)
    return out


def persistence(artifacts: DataFrame) -> DataFrame:
    kind_rank = F.when(F.col("kind") == "ioc-content", 0).when(F.col("kind") == "ioc-path", 1).when(
        F.col("kind") == "watched-dir", 2
    ).otherwise(3)
    return artifacts.withColumn("watched_dir", watched_dir(F.col("path"))).withColumn("kind_rank", kind_rank)


def version_reach(bridge: DataFrame, depends_on: DataFrame, scratch: Scratch, max_depth: int = S.MAX_IMPORT_DEPTH) -> DataFrame:
    """``root, node, depth``: what each imported version loads, stored once however many imports lead to it."""
    roots = bridge.filter("pv IS NOT NULL").select(F.col("pv").alias("root")).distinct()
    return reach(roots.select("root", F.col("root").alias("node")), depends_on, ["root"], scratch, max_depth)


def import_reach(bridge: DataFrame, loaded: DataFrame) -> DataFrame:
    """For every import, the versions it can load and how far away they are. ``loaded``: ``version_reach``."""
    roots = bridge.filter("pv IS NOT NULL").select("service", "specifier", F.col("pv").alias("root")).distinct()
    return roots.join(loaded, "root").groupBy("service", "specifier", F.col("node").alias("pv")).agg(F.min("depth").alias("hops"))


def imports_reaching(subjects: DataFrame, bridge: DataFrame, depends_on: DataFrame, scratch: Scratch,
                     max_depth: int = S.MAX_IMPORT_DEPTH) -> DataFrame:
    """The rows of ``import_reach`` of the subject versions alone, found backwards from them."""
    back = depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    above = reach(subjects.select("pv", F.col("pv").alias("node")), back, ["pv"], scratch, max_depth)
    roots = bridge.filter("pv IS NOT NULL").select("service", "specifier", F.col("pv").alias("node")).distinct()
    return above.join(roots, "node").groupBy("service", "specifier", "pv").agg(F.min("depth").alias("hops"))


def loaded_of(subjects: DataFrame, bridge: DataFrame, depends_on, scratch: Scratch, max_depth: int = S.MAX_IMPORT_DEPTH) -> DataFrame:
    """``pv``: those subject versions that some import can load; which of them lead to it plays no part.

    Most are imported themselves. For the others (``depends_on`` is a function
    that is called only if there are any) one walk goes forwards from the
    imports, over the edges that lie on ways to these versions alone.
    """
    roots = scratch.save(bridge.filter("pv IS NOT NULL").select("pv").distinct(), "import_roots")
    wanted = subjects.select("pv").distinct()
    own = wanted.join(roots, "pv", "left_semi")
    left, n = scratch.save_counted(wanted.join(roots, "pv", "left_anti"), "not_imported")
    if not n:
        return own
    edges = depends_on()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    above = reach(left.select(F.col("pv").alias("node")), back, [], scratch, max_depth).select("node")
    ways = edges.join(above.withColumnRenamed("node", "dst"), "dst", "left_semi")
    starts = roots.select(F.col("pv").alias("node")).join(above, "node", "left_semi")
    loaded = reach(starts, ways, [], scratch, max_depth).select(F.col("node").alias("pv"))
    return own.unionByName(left.join(loaded, "pv", "left_semi"))


def code_reach(subjects: DataFrame, import_reach_: DataFrame, calls_external: DataFrame, calls: DataFrame,
               scratch: Scratch, max_callers: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (pv, layer, node, distance) and edges from versions to functions."""
    imports = import_reach_.join(subjects.select("pv").distinct(), "pv", "left_semi")
    users = imports.join(calls_external, ["service", "specifier"])
    import_key = F.concat(F.lit("import:"), F.col("service"), F.lit(":"), F.col("specifier"))
    fn_key = lambda c: F.concat(F.lit("fn:"), F.col(c).cast("string"))
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    callers = reach(
        users.select("pv", F.col("fn").alias("node")).distinct(), back, ["pv"], scratch, max_callers
    )
    nodes = (
        subjects.select("pv", F.lit("version").alias("layer"), F.col("pv").alias("node"), F.lit(0).alias("distance"))
        .unionByName(imports.select("pv", F.lit("import").alias("layer"), import_key.alias("node"), F.col("hops").alias("distance")))
        .unionByName(callers.select(
            "pv", F.when(F.col("depth") == 0, "function").otherwise("caller").alias("layer"),
            fn_key("node").alias("node"), F.col("depth").alias("distance")))
        .distinct()
    )
    inside = callers.select("pv", F.col("node").alias("dst"))
    call_edges = calls.join(inside, "dst").join(
        callers.select("pv", F.col("node").alias("src")), ["pv", "src"], "left_semi"
    ).select("pv", fn_key("src").alias("src"), fn_key("dst").alias("dst"), F.lit("calls").alias("edge"))
    edges = (
        imports.select("pv", F.col("pv").alias("src"), import_key.alias("dst"), F.lit("loaded_by").alias("edge"))
        .unionByName(users.select("pv", import_key.alias("src"), fn_key("fn").alias("dst"), F.lit("used_by").alias("edge")))
        .unionByName(call_edges)
        .distinct()
    )
    return nodes, edges


def truncated_callers(callers_frontier: DataFrame, calls: DataFrame) -> DataFrame:
    """Callers just past the drawn bound, counted per version."""
    return callers_frontier.join(calls.select(F.col("dst").alias("fn"), "src"), "fn").groupBy("pv").agg(
        F.count_distinct("src").alias("n_truncated")
    )


# -- heat --------------------------------------------------------------------


def file_key():
    """Key of the file of a function."""
    return F.concat(F.lit("file:"), F.col("service"), F.lit(":"), F.col("file"))


def upward(depends_on: DataFrame) -> DataFrame:
    return depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def heat_layers(fleet) -> dict[str, DataFrame]:
    """(src, dst) by layer: heat moves from ``src`` to ``dst``, against the graph's edges."""
    svc = N.service_key("service")
    imp = F.concat(F.lit("import:"), F.col("service"), F.lit(":"), F.col("specifier"))
    fn = lambda c: F.concat(F.lit("fn:"), F.col(c).cast("string"))
    route = F.concat(F.lit("route:"), F.col("pattern"))
    return {
        "versions": upward(fleet.depends_on),
        "services": fleet.lock_root.select(F.col("pv").alias("src"), svc.alias("dst")),
        "imports": fleet.bridge.filter("pv IS NOT NULL").select(F.col("pv").alias("src"), imp.alias("dst")),
        "users": fleet.calls_external.select(imp.alias("src"), fn("fn").alias("dst")),
        "callers": fleet.calls.select(fn("dst").alias("src"), fn("src").alias("dst")),
        "ends": fleet.route.select(fn("fn").alias("src"), route.alias("dst"))
        .unionByName(fleet.function.select(fn("fn").alias("src"), file_key().alias("dst"))),
    }


def heat_edges(fleet) -> DataFrame:
    """All layers' edges, each once."""
    parts = list(heat_layers(fleet).values())
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.distinct()


def _heat_seeds(affects: DataFrame) -> DataFrame:
    base = N.severity_base("severity")
    worst = affects.groupBy("pv").agg(
        F.max(F.struct(base.alias("base"), F.col("advisory_id").alias("advisory"), F.col("severity")))
        .alias("w")
    )
    return worst.select(
        F.col("w.base").alias("base"), F.col("w.severity").alias("severity"), F.col("pv").alias("node"),
        F.struct(F.col("pv").alias("source"), F.col("w.advisory").alias("advisory")).alias("origin"),
    )


def _heat_value() -> Column:
    return F.round(F.col("base") - F.col("depth") * S.HEAT_DECAY, 4)


def _heat_walk() -> dict:
    """What a walk carries, and that claims below the floor end."""
    return {"carry": {"origin": F.max("origin")}, "keep": _heat_value() >= S.HEAT_FLOOR}


def _hottest(walked: DataFrame) -> DataFrame:
    best = walked.groupBy("node").agg(
        F.max(F.struct(_heat_value().alias("heat"), (-F.col("depth")).alias("near"), F.col("severity"), F.col("origin"))).alias("b")
    )
    return best.select(
        "node", F.col("b.heat").alias("heat"), (-F.col("b.near")).alias("hops"), F.col("b.severity").alias("severity"),
        F.col("b.origin.source").alias("source"), F.col("b.origin.advisory").alias("advisory"),
    )


def heat(affects: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Hottest claim per node: seed base less a fixed cost per hop, floored.

    There are only as many starting values as severity words, so the walk is
    one breadth-first reach per (node, starting value) and the maximum is
    taken at the end; the floor bounds it to six rounds.
    """
    return _hottest(reach(_heat_seeds(affects), edges, ["base", "severity"], scratch, S.HEAT_HOPS, **_heat_walk()))


def version_walk(affects: DataFrame, arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """The claims on versions: no other layer leads back to them. ``arcs``: that layer, a written table."""
    return reach(_heat_seeds(affects), arcs, ["base", "severity"], scratch, S.HEAT_HOPS, saved=True, **_heat_walk())


def version_heat(versions: DataFrame) -> DataFrame:
    """``heat`` of the versions alone. ``versions``: ``version_walk``."""
    return _hottest(versions)


def layered_heat(affects: DataFrame, layers: dict[str, DataFrame], scratch: Scratch, versions: DataFrame | None = None) -> DataFrame:
    """``heat`` over ``heat_layers``: rounds are made within the versions and within the functions alone.

    Heat leads from layer to layer, so the edges of all others are joined once.
    ``versions``: ``version_walk``, if it is known.
    """
    group = ["base", "severity"]

    def onward(claims: DataFrame, arcs: DataFrame) -> DataFrame:
        """The nearest claims one hop on, of the greatest origin."""
        step = claims.withColumn("depth", F.col("depth") + 1).filter(_heat_walk()["keep"] & (F.col("depth") <= S.HEAT_HOPS))
        step = step.withColumnRenamed("node", "src").join(arcs, "src").groupBy(*group, F.col("dst").alias("node")).agg(
            F.max(F.struct((-F.col("depth")).alias("near"), "origin")).alias("b"))
        return step.select(*group, "node", (-F.col("b.near")).alias("depth"), F.col("b.origin").alias("origin"))

    versions = version_walk(affects, layers["versions"], scratch) if versions is None else versions
    imports = scratch.save(onward(versions, layers["imports"]), "hot_imports")
    users = scratch.save(onward(imports, layers["users"]), "hot_users")
    functions = reach(users.filter("depth = 2"), layers["callers"], group, scratch, S.HEAT_HOPS, start_depth=2, entering=users, **_heat_walk())
    walked = versions
    for layer in (onward(versions, layers["services"]), imports, functions, onward(functions, layers["ends"])):
        walked = walked.unionByName(layer)
    return _hottest(walked)


def call_depth(functions: DataFrame, calls: DataFrame, scratch: Scratch, cap: int = S.MAX_CALL_RANK) -> DataFrame:
    """Longest walk from a function nobody calls, capped; cycles stop at the cap.

    Round ``d`` holds the functions that end a walk of exactly ``d`` calls, so
    the last round a function appears in is its depth.
    """
    called = calls.select(F.col("dst").alias("fn")).distinct()
    level = scratch.save(functions.select("fn").distinct().join(called, "fn", "left_anti").withColumn("depth", F.lit(0)), "level0")
    levels = [level]
    edges = scratch.save(calls.select(F.col("src").alias("fn"), "dst"), "calls")
    for depth in range(1, cap + 1):
        level, n = scratch.save_counted(
            level.join(edges, "fn").select(F.col("dst").alias("fn"), F.lit(depth).alias("depth")).distinct(), f"level{depth}"
        )
        if n == 0:
            break
        levels.append(level)
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    ranked = rows.groupBy("fn").agg(F.max("depth").alias("depth"))
    return functions.select("fn").distinct().join(ranked, "fn", "left").select("fn", F.coalesce("depth", F.lit(0)).alias("depth"))
