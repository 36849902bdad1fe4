"""Sentinels, vocabularies and input schemas."""

from __future__ import annotations

# --- fixed values: sentinels shared with existing data -----------------------
UNKNOWN_TS = 0
STILL_LIVE = 4102444800
UNKNOWN_STR = ""
UNKNOWN_INT = -1
UNKNOWN_SCORE = -1
NO_DEPTH = -1
DIRECT_DEPTH = 1

# --- fixed values: severity words, their rank and their heat -----------------
SEVERITY_RANK = {"critical": 4, "high": 3, "moderate": 2, "medium": 2, "low": 1}
SEVERITY_BASE = {"critical": 1.0, "high": 0.85, "moderate": 0.65, "medium": 0.65, "low": 0.45}
UNRATED_BASE = 0.55
HEAT_DECAY = 0.14
HEAT_FLOOR = 0.05
HEAT_HOPS = 6

# --- fixed values: bounds of the traversals ----------------------------------
MAX_REVERSE_DEPTH = 5
MAX_IMPORT_DEPTH = 12
MAX_CALLER_DEPTH = 8
MAX_CALL_RANK = 6
MAX_PATH_HOPS = 10
PATHS_PER_PAIR = 3
PATHS_PER_SOURCE = 25

# --- fixed values: publish history -------------------------------------------
DORMANCY_SECONDS = 365 * 24 * 60 * 60
BURST_WINDOW_SECONDS = 15 * 60
BURST_MIN_VERSIONS = 3
BURST_MIN_PACKAGES = 3
RECENT_SECONDS = 90 * 24 * 60 * 60
FRESH_SECONDS = 15 * 60
DEFAULT_INCIDENT_SECONDS = 6 * 60 * 60

# --- fixed values: fan-out and report limits ---------------------------------
SATISFIED_PER_REQUIREMENT = 8
NEWEST_PER_PACKAGE = 3
TYPOSQUAT_TARGETS = 300
TYPOSQUAT_RATIO = 10
TYPOSQUAT_MIN_LENGTH = 4
IMPACT_CAP = 200

# --- fixed values: CI accounts that are not credentials ----------------------
SERVICE_EMAILS = ["npm-oidc-no-reply@github.com"]
SERVICE_USERS = ["github actions", "gitlab ci"]

# --- fixed values: folders -----------------------------------------------------
WATCHED_DIRS = [".claude", ".vscode", ".github/workflows", ".husky"]
ALWAYS_IGNORED = ["node_modules", ".git"]

# --- input schemas (Spark DDL) -------------------------------------------------
_DEPS = "MAP<STRING,STRING>"
LOCK_ENTRY = (
    "STRUCT<name:STRING,version:STRING,link:BOOLEAN,dev:BOOLEAN,integrity:STRING,resolved:STRING,"
    f"license:STRING,dependencies:{_DEPS},devDependencies:{_DEPS},optionalDependencies:{_DEPS},"
    f"peerDependencies:{_DEPS}>"
)
LOCKFILE = f"name STRING, lockfileVersion INT, packages MAP<STRING,{LOCK_ENTRY}>"

PACKUMENT_VERSION = (
    "STRUCT<dist:STRUCT<integrity:STRING>,hasInstallScript:BOOLEAN,deprecated:STRING,license:STRING,"
    "description:STRING,repository:STRING,_npmUser:STRUCT<name:STRING,email:STRING>,"
    f"dependencies:{_DEPS},devDependencies:{_DEPS},optionalDependencies:{_DEPS},peerDependencies:{_DEPS},"
    "bundleDependencies:ARRAY<STRING>,bundledDependencies:ARRAY<STRING>>"
)
PACKUMENT = (
    "name STRING, `dist-tags` MAP<STRING,STRING>, time MAP<STRING,STRING>, "
    "maintainers ARRAY<STRING>, repository STRING, deprecated STRING, "
    f"versions MAP<STRING,{PACKUMENT_VERSION}>"
)

FINDING_COLUMNS = [
    "package", "version", "ecosystem", "source_file", "osv_id", "aliases", "summary", "cvss_vector",
    "severity_score", "fixed_version", "introduced_version", "published", "modified", "details", "references",
]
FINDINGS_CSV = ", ".join(f"`{c}` STRING" for c in FINDING_COLUMNS)

OSV_RANGE = "STRUCT<type:STRING,events:ARRAY<STRUCT<introduced:STRING,fixed:STRING>>>"
OSV_RECORD = (
    "id STRING, aliases ARRAY<STRING>, summary STRING, details STRING, published STRING, modified STRING, "
    "severity ARRAY<STRUCT<type:STRING,score:STRING>>, database_specific STRUCT<severity:STRING>, "
    "references ARRAY<STRUCT<type:STRING,url:STRING>>, "
    f"affected ARRAY<STRUCT<package:STRUCT<name:STRING,ecosystem:STRING>,ranges:ARRAY<{OSV_RANGE}>>>"
)
OSV_RECORD_STRUCT = "STRUCT<" + OSV_RECORD.replace(" STRING", ":STRING").replace(" ARRAY<", ":ARRAY<").replace(
    " STRUCT<", ":STRUCT<") + ">"
SCAN_REPORT = (
    "results ARRAY<STRUCT<source:STRUCT<path:STRING>,packages:ARRAY<STRUCT<"
    "package:STRUCT<name:STRING,version:STRING,ecosystem:STRING>,"
    f"vulnerabilities:ARRAY<{OSV_RECORD_STRUCT}>>>>>"
)
ADVISORY = (
    "advisory_id STRING, ecosystem STRING, package STRING, affected_versions ARRAY<STRING>, "
    "affected_range STRING, published_at BIGINT, withdrawn_at BIGINT, severity STRING, "
    "iocs STRUCT<paths:ARRAY<STRING>,sha256:ARRAY<STRING>,content_markers:ARRAY<STRING>>"
)
CODE_SCAN = (
    "service STRING, files ARRAY<STRUCT<key:STRING,path:STRING,lang:STRING>>, "
    "functions ARRAY<STRUCT<key:STRING,name:STRING,file:STRING,line:INT,exported:BOOLEAN>>, "
    "calls ARRAY<ARRAY<STRING>>, "
    "externalImports ARRAY<STRUCT<key:STRING,specifier:STRING,file:STRING,names:ARRAY<STRING>>>, "
    "callsExternal ARRAY<ARRAY<STRING>>, "
    "routes ARRAY<STRUCT<key:STRING,method:STRING,pattern:STRING,file:STRING,line:INT,handler:STRING>>"
)
PIP_REPORT = (
    "install ARRAY<STRUCT<metadata:STRUCT<name:STRING,version:STRING,summary:STRING,"
    "requires_dist:ARRAY<STRING>,requires_python:STRING,license:STRING,license_expression:STRING>>>"
)
DOWNLOAD_ENTRY = "STRUCT<downloads:BIGINT,package:STRING>"
MAINTAINER_SEARCH = (
    "objects ARRAY<STRUCT<package:STRUCT<name:STRING,"
    "maintainers:ARRAY<STRUCT<username:STRING,name:STRING>>>>>"
)
CHANGE_PAGE = "results ARRAY<STRUCT<id:STRING,seq:BIGINT>>, last_seq BIGINT"
