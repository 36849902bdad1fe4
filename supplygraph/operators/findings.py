"""Grading, threats and summaries.

Sets of services, functions or packages are reported as counts beside the
long-form tables they come from, so no row ever holds an unbounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplygraph import schema as S
from supplygraph.functions import names as N
from supplygraph.operators import reach as R

RELATIONAL = ["SHARED_MAINTAINER", "SHARED_REPOSITORY", "SHARED_PUBLISHER", "TYPOSQUAT_NEIGHBOR"]


def confidence(atoms: Column) -> Column:
    """Fixed precedence; relationships alone are never more than a lead."""
    has = lambda *names: F.arrays_overlap(atoms, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(has("DIRECTLY_COMPROMISED"), "CERTAIN")
        .when(has("RESOLVES_COMPROMISED_VERSION", "TRANSITIVELY_EXPOSED"), "HIGH")
        .when(has("POSSIBLE_EXACT"), "MEDIUM")
        .when(has("POSSIBLE", "RESOLVES_SUBJECT_VERSION"), "LOW")
        .when(has(*RELATIONAL), "INVESTIGATE")
        .otherwise("LOW")
    )


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


# -- per service grading -------------------------------------------------------


def assess(fleet, ioc_paths: list[str] | None = None) -> DataFrame:
    """(advisory, service) findings with their tier, for all advisories at once."""
    hit = fleet.affects.select("advisory_id", "pv", "name")
    held = hit.join(fleet.resolved_in, "pv").groupBy("advisory_id", "service").agg(
        F.count_distinct("pv").alias("n_packages"), F.min("depth").alias("min_depth"),
        F.bool_and("dev_only").alias("dev_only"),
    )
    users = (
        hit.join(R.calling_functions(hit, fleet.bridge, fleet.calls_external), "pv")
        .select("advisory_id", "service", "fn").distinct()
    )
    users = fleet.scratch.save(users, "advisory_functions")
    used = users.groupBy("advisory_id", "service").agg(F.count("*").alias("n_functions"))
    routes = R.reachable_routes(users, fleet.calls, fleet.route, fleet.scratch)
    reached = (
        users.select("advisory_id", "fn").distinct().join(routes, "fn")
        .select("advisory_id", F.col("route_service").alias("service"), "method", "pattern").distinct()
        .groupBy("advisory_id", "service").agg(F.count("*").alias("n_routes"))
    )
    named = F.lit(False)
    for glob in ioc_paths or []:
        named = named | N.glob_match(F.col("path"), F.lit(glob))
    confirmed = F.col("kind").isin("ioc-path", "ioc-content") | named
    files = fleet.artifact.groupBy("service").agg(
        F.count("*").alias("n_artifacts"), F.count_if(confirmed).alias("n_confirmed")
    )
    rows = held.join(used, ["advisory_id", "service"], "left").join(reached, ["advisory_id", "service"], "left").join(
        files, "service", "left"
    )
    tier = (
        F.when(F.coalesce("n_confirmed", F.lit(0)) > 0, "P0").when(F.coalesce("n_routes", F.lit(0)) > 0, "P1")
        .when(F.coalesce("n_functions", F.lit(0)) > 0, "P2").otherwise("P3")
    )
    return rows.select(
        "advisory_id", "service", "n_packages", F.col("min_depth").cast("bigint").alias("min_depth"), "dev_only",
        zero("n_functions"), zero("n_routes"), zero("n_artifacts"), zero("n_confirmed"), tier.alias("tier"),
    )


# -- findings of a version -------------------------------------------------------


#: What speaks against a finding, by the reason that it holds for.
NEGATIVE = {
    "incident": "no incident names this version",
    "dev": "only a development dependency leads to it, so a production install leaves it out",
    "window": "held outside the time in which the version was live",
    "named": "no incident names this package",
    "held": "its own lockfiles are no evidence here",
    "alone": "nothing but the shared account speaks for it",
    "name": "nothing but the similar name speaks for it",
}


def witnesses(flagged: DataFrame, links: DataFrame, identity: str) -> DataFrame:
    """``identity, name, subject``: for each member of an identity, the least flagged version of another member.

    ``flagged``: ``pv, name``. The least version of each identity and the least
    of another package are enough: a member takes the first that is not its own.
    """
    marked = links.select(identity, "name").distinct().join(flagged.groupBy("name").agg(F.min("pv").alias("pv")), "name")
    first = marked.groupBy(identity).agg(F.min(F.struct("pv", "name")).alias("one"))
    second = marked.join(first, identity).filter(F.col("name") != F.col("one.name")).groupBy(identity).agg(F.min("pv").alias("two"))
    both = first.join(second, identity, "left")
    return links.select(identity, "name").distinct().join(both, identity).select(
        identity, "name", F.when(F.col("one.name") == F.col("name"), F.col("two")).otherwise(F.col("one.pv")).alias("subject"),
    ).filter("subject IS NOT NULL")


def findings(fleet, squats: DataFrame) -> DataFrame:
    """Every claim about a flagged version, one row per claim.

    ``subject`` is always a version; where an account or a name connects many
    flagged versions with a package, it is the least of them and the package has
    one row for the account, not one for each version. ``path`` leads from the
    entity to the subject, ``negatives`` says what speaks against the claim.
    """
    marked = fleet.incident.groupBy("pv").agg(F.min("incident_id").alias("incident_id"))
    advised = fleet.affects.groupBy("pv").agg(F.slice(F.array_sort(F.collect_set("advisory_id")), 1, 3).alias("advisories"))
    flagged = marked.join(advised, "pv", "full_outer").withColumn("compromised", F.col("incident_id").isNotNull())
    live = R.live_window(
        fleet.incident.select("pv", F.col("live_from").alias("since"), F.col("live_until").alias("until")), fleet.resolved_in
    ).select("pv", "service", F.lit(True).alias("live")).distinct()
    # one row per version with any overlap: absence elsewhere is then evidence
    any_live = live.select("pv", F.lit(True).alias("any_live")).distinct()
    said = {k: F.lit(v) for k, v in NEGATIVE.items()}

    def shape(df, subject, entity, kind, status, atoms, path, reason, negatives, identity=None):
        against = F.array_compact(F.array(*negatives)) if negatives else F.array().cast("array<string>")
        return df.select(
            subject.alias("subject"), (identity if identity is not None else F.lit(None).cast("string")).alias("identity"), entity.alias("entity"),
            F.lit(kind).alias("entity_type"), status.alias("status"), F.array_compact(atoms).alias("atoms"), F.array_compact(path).alias("path"),
            reason.alias("reason"), against.alias("negatives"),
        )

    pv = F.col("pv")
    direct = F.col("depth") == S.DIRECT_DEPTH
    own = shape(
        marked, pv, pv, "PackageVersion", F.lit("DIRECTLY_COMPROMISED"), F.array(F.lit("DIRECTLY_COMPROMISED")), F.array(pv),
        F.concat(F.lit("incident "), "incident_id", F.lit(" names it")), [],
    )
    vuln = shape(
        flagged.filter("advisories IS NOT NULL"), pv, pv, "PackageVersion", F.lit("VULNERABLE"), F.array(F.lit("KNOWN_VULNERABILITY")), F.array(pv),
        F.array_join("advisories", "; "), [F.when(~F.col("compromised"), said["incident"])],
    )
    projects = (
        fleet.resolved_in.join(flagged, "pv").join(live, ["pv", "service"], "left").join(any_live, "pv", "left")
    )
    via = F.when(~direct & (F.coalesce("via_direct", F.lit("")) != ""), F.col("via_direct"))
    held = shape(
        projects, pv, F.col("service"), "Project",
        F.when(direct, "DIRECTLY_EXPOSED").otherwise("TRANSITIVELY_EXPOSED"),
        F.array(
            F.lit("RESOLVES_COMPROMISED_VERSION"), F.when(~direct, F.lit("TRANSITIVELY_EXPOSED")),
            F.when(F.col("live"), F.lit("LIVE_WINDOW_OVERLAP")),
        ),
        F.array(F.col("service"), via, pv),
        F.concat(F.lit("a lockfile resolves "), pv, F.when(direct, "").otherwise(F.concat(F.lit(" at depth "), F.col("depth").cast("string"), F.coalesce(F.concat(F.lit(" via "), via), F.lit(""))))),
        [F.when(F.col("dev_only"), said["dev"]), F.when(F.col("live").isNull() & F.col("any_live"), said["window"])],
    )
    named = flagged.select("pv").join(fleet.package_version.select("pv", "name"), "pv")
    near = witnesses(named, fleet.maintained_by, "maintainer")
    account = F.concat(F.lit("maintainer "), F.col("maintainer"))
    kin = shape(
        near, F.col("subject"), F.col("name"), "Package", F.lit("RELATED / INVESTIGATE"), F.array(F.lit("SHARED_MAINTAINER")),
        F.array(F.col("name"), account, F.col("subject")), F.concat(account, F.lit(" also maintains the package of "), "subject"),
        [said["named"], said["held"], said["alone"]], account,
    )
    looks = shape(
        squats.select("candidate", "target").distinct().join(named.groupBy(F.col("name").alias("target")).agg(F.min("pv").alias("subject")), "target"),
        F.col("subject"), F.col("candidate"), "Package", F.lit("RELATED / INVESTIGATE"), F.array(F.lit("TYPOSQUAT_NEIGHBOR")),
        F.array(F.col("candidate"), F.col("target"), F.col("subject")), F.concat(F.lit("its name resembles "), "target"), [said["name"]],
    )
    rows = own.unionByName(vuln).unionByName(held).unionByName(kin).unionByName(looks)
    return rows.withColumn("n_negative", F.size("negatives").cast("bigint")).withColumn("confidence", confidence(F.col("atoms")))


def blast_radius(fleet, subjects: DataFrame, squats: DataFrame) -> DataFrame:
    """One wide row per subject version: the size of every answer."""
    # one by one, so that the shuffles of one part are gone before the next
    per = lambda df, name, what="*": fleet.scratch.save(df.groupBy("pv").agg(
        (F.count("*") if what == "*" else F.count_distinct(what)).alias(name)
    ), name)
    base = subjects.select("pv").distinct().join(fleet.package_version.select("pv", "name"), "pv")
    windows = fleet.incident.select("pv", F.col("live_from").alias("since"), F.col("live_until").alias("until"))
    names = base.select("name").distinct()
    # neighbours of a package: all members of its accounts but itself
    sizes = fleet.maintained_by.groupBy("maintainer").agg((F.count_distinct("name") - 1).alias("others"))
    neighbours = fleet.maintained_by.join(names, "name", "left_semi").join(sizes, "maintainer").groupBy("name").agg(
        F.sum("others").alias("n_shared_maintainer")
    )
    looks = squats.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("n_typosquats"))
    out = (
        base
        .join(per(R.direct_dependents(base, fleet.satisfied_by), "n_direct"), "pv", "left")
        .join(per(R.transitive_dependents(base, fleet.satisfied_by, fleet.scratch), "n_transitive"), "pv", "left")
        .join(per(R.lockfile_entries(base, fleet.entry), "n_entries", "lock_id"), "pv", "left")
        .join(per(R.exposed(base, fleet.resolved_in), "n_projects"), "pv", "left")
        .join(per(R.live_window(windows.join(base, "pv", "left_semi"), fleet.resolved_in), "n_live"), "pv", "left")
        .join(per(R.advisories_for(base, fleet.affects), "n_advisories"), "pv", "left")
        .join(neighbours, "name", "left")
        .join(looks, "name", "left")
    )
    counts = ["n_direct", "n_transitive", "n_entries", "n_projects", "n_live", "n_advisories", "n_shared_maintainer", "n_typosquats"]
    return out.select("pv", *[zero(c) for c in counts])


# -- threats ---------------------------------------------------------------------


def threat_base(fleet) -> DataFrame:
    """Every version with an advisory, an incident or a deprecation.

    Kind: compromised over vulnerable over deprecated. The window opens when
    the version was published (else the advisory) and closes with its last
    dated fix; any advisory without one keeps it open. Who holds or loads a
    version plays no part here.
    """
    closed = F.when(F.col("fixed_published_at") > 0, F.col("fixed_published_at")).otherwise(F.lit(S.STILL_LIVE))
    advised = fleet.affects.groupBy("pv").agg(
        F.max_by("severity", N.severity_base("severity")).alias("advisory_severity"),
        F.count("*").alias("n_advisories"),
        F.min(F.when(F.col("published") > 0, F.col("published"))).alias("first_advisory"),
        F.max(closed).cast("bigint").alias("last_fix"),
    )
    marked = fleet.incident.groupBy("pv").agg(F.min("incident_id").alias("incident_id"))
    dropped = fleet.package_version.filter("deprecated").select("pv", F.lit(True).alias("is_deprecated"))
    base = advised.join(marked, "pv", "full_outer").join(dropped, "pv", "full_outer").join(
        fleet.package_version.select("pv", "name", "version", "published_at"), "pv"
    )
    start = F.when(F.col("published_at") > 0, F.col("published_at")).otherwise(F.coalesce("first_advisory", F.lit(0)))
    return base.select(
        "pv", "name", "version",
        F.when(F.col("incident_id").isNotNull(), "compromised").when(F.col("n_advisories").isNotNull(), "vulnerable")
        .otherwise("deprecated").alias("kind"),
        F.coalesce(
            "advisory_severity", F.when(F.col("incident_id").isNotNull(), "critical"), F.lit("unknown")
        ).alias("severity"),
        zero("n_advisories"),
        F.when(F.col("n_advisories").isNotNull(), start).otherwise(F.lit(S.UNKNOWN_TS)).cast("bigint").alias("window_start"),
        F.coalesce("last_fix", F.lit(S.STILL_LIVE)).cast("bigint").alias("window_end"),
        F.concat(
            F.when(F.col("published_at") > 0, "version").otherwise("advisory"), F.lit(" published -> "),
            F.when(F.coalesce("last_fix", F.lit(S.STILL_LIVE)) == S.STILL_LIVE, "no dated fix").otherwise("fix released"),
        ).alias("window_basis"),
        F.col("is_deprecated").isNotNull().alias("deprecated"),
    )


def threats(fleet) -> DataFrame:
    """``threat_base`` with the services that hold a version and the imports and functions that load it."""
    base = fleet.threat_base
    held = base.select("pv", "window_start", "window_end").join(fleet.resolved_in, "pv")
    known = (F.col("window_start") > 0) & (F.col("first_seen") > 0)
    inside = (F.col("first_seen") <= F.col("window_end")) & (F.col("last_seen") >= F.col("window_start"))
    services = held.groupBy("pv").agg(
        F.count("*").alias("n_services"),
        F.count_if(known & inside).alias("live_services"),
        F.count_if(known & ~inside & (F.col("first_seen") > F.col("window_end"))).alias("after_fix_services"),
    )
    loads = fleet.scratch.save(R.imports_reaching(base.select("pv"), fleet.bridge, fleet.depends_on, fleet.scratch), "threat_loads")
    reach = loads.groupBy("pv").agg(F.count("*").alias("n_imports"), F.min("hops").alias("min_hops"))
    users = function_counts(loads, fleet.calls_external)
    return (
        base.join(services, "pv", "left").join(reach, "pv", "left").join(users, "pv", "left")
        .select(
            "pv", "name", "version", "kind", "severity", "n_advisories", "window_start", "window_end", "window_basis",
            "deprecated", zero("n_services"), zero("live_services"), zero("after_fix_services"),
            F.col("n_imports").isNotNull().alias("in_code"), F.col("min_hops").cast("bigint").alias("min_hops"),
            zero("n_imports"), zero("function_count"),
        )
    )


def function_counts(loads: DataFrame, calls_external: DataFrame) -> DataFrame:
    """Distinct functions that would run each version's code.

    Versions loaded by the same imports have the same functions (all of an
    import's subtree, as a rule), so functions are matched once per such class
    and not once per version. Candidates for a class have equal number, extremes
    and hash sum of their imports; rows then decide: in a class every import has
    as many versions as the class, else its versions stand for themselves.
    """
    key = F.struct("service", "specifier")
    mark = F.sum(F.xxhash64("service", "specifier").cast("decimal(38,0)"))
    summed = loads.groupBy("pv").agg(F.count("*").alias("k0"), F.min(key).alias("k1"), F.max(key).alias("k2"), mark.alias("k3"))
    marks = ["k0", "k1", "k2", "k3"]
    chosen = summed.groupBy(*marks).agg(F.min("pv").alias("chosen"), F.count("*").alias("members"))
    classes = summed.join(chosen, marks).select("pv", "chosen", "members")
    shared = loads.join(classes.filter("members > 1"), "pv").groupBy("chosen", "service", "specifier", "members").agg(F.count("*").alias("n"))
    unlike = shared.filter("n <> members").select("chosen").distinct().withColumn("unlike", F.lit(True))
    settled = classes.join(unlike, "chosen", "left").select("pv", F.when(F.col("unlike"), F.col("pv")).otherwise(F.col("chosen")).alias("chosen"))
    per_class = (
        loads.join(settled.select(F.col("chosen").alias("pv")).distinct(), "pv", "left_semi").join(calls_external, ["service", "specifier"])
        .select(F.col("pv").alias("chosen"), "fn").distinct().groupBy("chosen").agg(F.count("*").alias("function_count"))
    )
    return settled.join(per_class, "chosen").select("pv", "function_count")


def threat_order() -> list[Column]:
    """Reached code first, then compromise, severity and breadth."""
    return [
        F.desc("in_code"), F.desc(F.col("kind") == "compromised"), F.desc(N.severity_base("severity")),
        F.desc("n_services"), F.asc("name"), F.asc("version"),
    ]


# -- frontier ----------------------------------------------------------------------


def frontier_links(fleet) -> DataFrame:
    """(route, identity, name) without CI accounts on the publisher route."""
    return (
        fleet.published_by.filter(~N.is_service_identity("publisher")).select(
            F.lit("publisher").alias("route"), F.col("publisher").alias("identity"), "name")
        .unionByName(fleet.maintained_by.select(F.lit("maintainer").alias("route"), F.col("maintainer").alias("identity"), "name"))
        .unionByName(fleet.sourced_from.select(F.lit("repository").alias("route"), F.col("repo").alias("identity"), "name"))
        .distinct()
    )


def frontier_routes(fleet, subjects: DataFrame) -> DataFrame:
    """(route, identity, name): packages one of the subjects' identities reaches.

    A subject counts through the identities of its own version; the package
    itself is reached only from another subject.
    """
    links = frontier_links(fleet)
    mine = subjects.select("pv").distinct()
    own = (
        fleet.published_by.join(mine, "pv", "left_semi").filter(~N.is_service_identity("publisher")).select(
            F.lit("publisher").alias("route"), F.col("publisher").alias("identity"), "name")
        .unionByName(fleet.sourced_from.join(mine, "pv", "left_semi").select(F.lit("repository").alias("route"), F.col("repo").alias("identity"), "name"))
        .unionByName(
            fleet.maintained_by.join(
                fleet.package_version.join(mine, "pv", "left_semi").select("name").distinct(), "name", "left_semi"
            ).select(F.lit("maintainer").alias("route"), F.col("maintainer").alias("identity"), "name"))
        .distinct()
    )
    holders = own.groupBy("route", "identity").agg(F.count("*").alias("n_holders"))
    flagged = links.join(own.withColumn("own", F.lit(1)), ["route", "identity", "name"], "left")
    reached = flagged.join(holders, ["route", "identity"]).filter(F.col("n_holders") > F.coalesce("own", F.lit(0)))
    return reached.select("route", "identity", "name")


def frontier(fleet, subjects: DataFrame, cap: int = S.IMPACT_CAP) -> DataFrame:
    """Packages an attacker holding the subjects' identities could publish to.

    Impact is measured for all; ``impact_measured`` marks the rows within the
    reporting cap, taken by number of routes and name.
    """
    routes = frontier_routes(fleet, subjects)
    by_package = routes.groupBy("name").agg(
        F.count_distinct(F.when(F.col("route") == "publisher", F.col("identity"))).alias("n_publishers"),
        F.count_distinct(F.when(F.col("route") == "maintainer", F.col("identity"))).alias("n_maintainers"),
        F.count_distinct(F.when(F.col("route") == "repository", F.col("identity"))).alias("n_repositories"),
    )
    by_package = fleet.scratch.save(
        by_package.withColumn(
            "n_routes",
            (F.col("n_publishers") > 0).cast("bigint") + (F.col("n_maintainers") > 0).cast("bigint")
            + (F.col("n_repositories") > 0).cast("bigint"),
        ),
        "frontier",
    )
    impact = (
        fleet.resolved_in.select("pv", "service").join(fleet.package_version.select("pv", "name"), "pv")
        .select("name", "service").distinct().groupBy("name").agg(F.count("*").alias("n_services"))
    )
    first = by_package.orderBy(F.desc("n_routes"), "name").limit(cap).select("name", F.lit(True).alias("impact_measured"))
    return by_package.join(impact, "name", "left").join(first, "name", "left").select(
        "name", "n_publishers", "n_maintainers", "n_repositories", "n_routes", zero("n_services"),
        F.coalesce("impact_measured", F.lit(False)).alias("impact_measured"), F.lit("INVESTIGATE").alias("confidence"),
    )


def frontier_services(fleet, subjects: DataFrame) -> DataFrame:
    """What to watch and what to rotate: (item, kind), each once."""
    routes = fleet.scratch.save(frontier_routes(fleet, subjects), "routes")
    services = (
        fleet.resolved_in.join(
            fleet.package_version.join(routes.select("name").distinct(), "name", "left_semi").select("pv"), "pv", "left_semi"
        ).select("service").distinct()
    )
    return services.select(F.lit("service").alias("kind"), F.col("service").alias("item")).unionByName(
        routes.select(F.concat(F.lit("rotate-"), F.col("route")).alias("kind"), F.col("identity").alias("item")).distinct()
    )


# -- summaries -----------------------------------------------------------------------


def range_only(fleet) -> DataFrame:
    """Per version: how many ranges admit it."""
    return fleet.satisfied_by.groupBy(F.col("dst").alias("pv")).agg(F.count_distinct("src").alias("range_only"))


def range_vs_lock(fleet) -> DataFrame:
    """Per version: how many ranges admit it, how many projects resolve it."""
    possible = range_only(fleet)
    confirmed = fleet.resolved_in.groupBy("pv").agg(F.count_distinct("service").alias("confirmed"))
    return possible.join(confirmed, "pv", "full_outer").select("pv", zero("range_only"), zero("confirmed"))


def suggested_targets(fleet, limit: int | None = None) -> DataFrame:
    """Held versions by how much speaks for looking at them: all, or the first ``limit``."""
    advisories = fleet.affects.groupBy("pv").agg(F.count("*").alias("n_advisories"))
    marked = fleet.incident.select("pv", F.lit(1).alias("marked")).distinct()
    ranked = range_vs_lock(fleet).join(advisories, "pv", "left").join(marked, "pv", "left").select(
        "pv", zero("marked"), zero("n_advisories"), "range_only", "confirmed"
    )
    if limit is None:
        return ranked
    return ranked.orderBy(F.desc("marked"), F.desc("n_advisories"), F.desc("range_only"), F.desc("confirmed"), "pv").limit(limit)


def verdict(fleet) -> DataFrame:
    """One line per flagged version."""
    t = fleet.threat_base.filter("kind <> 'deprecated'")
    services = t.select("pv").join(fleet.holders, "pv").groupBy("pv").agg(F.count("*").alias("n_services"))
    t = t.join(services, "pv", "left").withColumn("n_services", zero("n_services"))
    fixes = fleet.affects.groupBy("pv").agg(F.count_distinct("fixed_version").alias("n_fixes"))
    headline = (
        F.when(F.col("kind") == "compromised", F.format_string("compromised, held by %d service(s)", "n_services"))
        .when(F.col("n_services") > 0, F.format_string("%s, held by %d service(s)", "severity", "n_services"))
        .otherwise("not held")
    )
    return t.join(fixes, "pv", "left").select("pv", "severity", "n_advisories", zero("n_fixes"), "n_services", headline.alias("headline"))


def verdict_items(fleet) -> DataFrame:
    """What a verdict names, one row an item: advisories, fixed versions, services."""
    flagged = fleet.threat.filter("kind <> 'deprecated'").select("pv")
    item = lambda df, kind, col: df.filter(F.col(col).isNotNull()).select("pv", F.lit(kind).alias("kind"), F.col(col).alias("item"))
    advised = fleet.affects.join(flagged, "pv", "left_semi")
    held = fleet.resolved_in.join(flagged, "pv", "left_semi")
    return item(advised, "advisory", "advisory_id").unionByName(item(advised, "fix", "fixed_version")).unionByName(item(held, "service", "service")).distinct()


def graded(fleet) -> DataFrame:
    """``threat_base`` with ``in_code``: how often and from where a version is loaded is not counted."""
    return fleet.threat_base.join(fleet.loaded_threats.select("pv").distinct().withColumn("loaded", F.lit(True)), "pv", "left").withColumn(
        "in_code", F.col("loaded").isNotNull()
    ).drop("loaded")


def fleet_overview(fleet) -> DataFrame:
    """Per service: what it holds and what is wrong with it."""
    held = fleet.resolved_in.select("pv", "service", "depth").join(fleet.package_version.select("pv", "name"), "pv").join(
        graded(fleet).select("pv", "kind", "severity", "in_code"), "pv", "left"
    )
    return held.groupBy("service").agg(
        F.count("*").alias("n_versions"),
        F.count_distinct("name").alias("n_packages"),
        F.count_if(F.col("depth") == S.DIRECT_DEPTH).alias("n_direct"),
        F.count("kind").alias("n_threats"),
        F.count_if("in_code").alias("n_reaching"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "moderate", "low", "unknown")],
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("compromised", "vulnerable", "deprecated")],
    )


def scan_summary(findings_: DataFrame, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """Findings per ecosystem, and the versions with most rows."""
    by_eco = findings_.groupBy("ecosystem").agg(
        F.count("*").alias("n_findings"), F.count_distinct("package").alias("n_packages")
    )
    worst = findings_.groupBy("package", "version").agg(F.count("*").alias("n_rows")).orderBy(
        F.desc("n_rows"), "package", "version"
    ).limit(top)
    return by_eco, worst


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("label"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def threat_counts(base: DataFrame, loaded: DataFrame, versions: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """Totals with the denominators they were looked for in. ``base``: ``threat_base``; ``loaded``: those of them that some import loads (``pv``)."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("compromised", "vulnerable", "deprecated")]
    size = lambda df: df.agg(F.count("*")).scalar()
    marked = base.select("pv", "kind").join(loaded.select("pv", F.lit(True).alias("in_code")).distinct(), "pv", "left")
    return marked.agg(F.count("*").alias("total"), F.count_if("in_code").alias("in_code"), *kinds).select(
        "*", size(versions).alias("versions"), size(imports).alias("imports"), size(functions).alias("functions")
    )


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    ioc = F.col("kind").isin("ioc-path", "ioc-content")
    return artifacts.agg(
        F.count("*").alias("total"), F.count_if(ioc).alias("ioc"), F.count_if(~ioc).alias("watched")
    )


def code_coverage(workspaces: DataFrame, functions: DataFrame) -> DataFrame:
    """Was any source of the workspace scanned? Decides unknown against not reached."""
    scanned = functions.select("service").distinct().withColumn("scanned", F.lit(True))
    return workspaces.join(scanned, "service", "left").groupBy("workspace").agg(
        F.coalesce(F.bool_or("scanned"), F.lit(False)).alias("has_code_graph")
    )
