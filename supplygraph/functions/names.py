"""Names, keys and other scalar rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplygraph import schema as S


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(fn, *cols) -> Column:
    """``fn`` of the given columns, each evaluated once per row.

    An expression used inside a lambda is otherwise evaluated again for every
    element; one step over a single-element array turns it into a variable.
    """
    row = F.struct(*[_c(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return F.get(F.transform(F.array(row), lambda t: fn(*[t[f"c{i}"] for i in range(len(cols))])), F.lit(0))


def strip(col) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_c(col), F.lit(" \t\n\r\f\v"))


# one test per name: legal characters, at most 214, an optional scope, and no
# leading dot or underscore
NPM_NAME = r"^(?=[a-z0-9._~@/-]{1,214}$)(?:@[^/]+/)?[^/._][^/]*$"


def npm_name(name) -> Column:
    """Canonical npm name, NULL when the text cannot be one."""
    text = F.lower(strip(name))
    return F.when(text.rlike(NPM_NAME), text)


def npm_name_problem(name) -> Column:
    """Why a string is not an npm name, or NULL when it is one."""
    text = F.lower(strip(name))
    bare = F.regexp_replace(text, "^@[^/]+/", "")
    return (
        F.when(_c(name).isNull(), "missing")
        .when(text.rlike(NPM_NAME), F.lit(None))
        .when(text == "", "empty")
        .when(F.length(text) > 214, "too long")
        .when((bare == "") | bare.contains("/"), "not a name")
        .when(bare.rlike("^[._]"), "leading dot or underscore")
        .otherwise("illegal character")
    )


def pypi_name(name) -> Column:
    """Lower case, one dash for any run of separators, no dash at an edge."""
    text = F.regexp_replace(F.lower(strip(name)), r"[-_.]+", "-")
    return F.when((text != "") & ~text.rlike("^-|-$"), text)


def scope_of(name) -> Column:
    """``@a/b`` -> ``@a``; NULL for an unscoped name. Expects a canonical name."""
    return F.when(_c(name).rlike("^@[^/]+/"), F.split(_c(name), "/")[0])


def bare_of(name) -> Column:
    return F.regexp_replace(_c(name), "^@[^/]+/", "")


def canonical_name(name, ecosystem) -> Column:
    return F.when(_c(ecosystem) == "pypi", pypi_name(name)).otherwise(npm_name(name))


def package_purl(name, ecosystem=None) -> Column:
    """``pkg:npm/%40scope/bare`` or ``pkg:pypi/name``; NULL when the name is invalid."""
    text = F.lower(strip(name))
    npm = F.when(text.rlike(NPM_NAME), F.concat(F.lit("pkg:npm/"), F.regexp_replace(text, "@(?=[^/]*/)", "%40")))
    if ecosystem is None:
        return npm
    return F.when(_c(ecosystem) == "pypi", F.concat(F.lit("pkg:pypi/"), pypi_name(name))).otherwise(npm)


def version_purl(name, version, ecosystem=None) -> Column:
    text = strip(version)
    return F.when(text != "", F.concat(package_purl(name, ecosystem), F.lit("@"), text))


def parse_purl(purl) -> Column:
    """``struct(ecosystem, name, version)``; the version follows the last ``@``."""
    body = F.regexp_extract(_c(purl), r"^pkg:([^/]*)/(.+)$", 2)
    has_version = body.rlike(r"^.+@[^@]*$")
    raw_name = F.when(has_version, F.regexp_extract(body, r"^(.+)@[^@]*$", 1)).otherwise(body)
    version = F.when(has_version, F.nullif(F.regexp_extract(body, r"@([^@]*)$", 1), F.lit("")))
    name = F.try_url_decode(F.regexp_replace(raw_name, r"\+", "%2B"))
    return F.when(
        body != "",
        F.struct(
            F.regexp_extract(_c(purl), r"^pkg:([^/]*)/", 1).alias("ecosystem"),
            name.alias("name"),
            version.alias("version"),
        ),
    )


def service_key(name) -> Column:
    return F.when(strip(name) != "", F.concat(F.lit("svc:"), F.lower(strip(name))))


def account_key(username, email=None) -> Column:
    """One key per publishing account: the user name, else a plausible e-mail."""
    user = F.when(strip(username) != "", F.concat(F.lit("npm-user:"), F.lower(strip(username))))
    if email is None:
        return user
    mail = strip(email)
    return F.coalesce(
        user, F.when(mail.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.concat(F.lit("email:"), F.lower(mail)))
    )


def organization_key(name) -> Column:
    return F.concat(F.lit("org:"), F.lower(F.regexp_replace(strip(name), "^@+", "")))


def is_service_identity(username, email=None) -> Column:
    """CI accounts stamp many unrelated packages; they are not a shared secret."""
    by_user = F.coalesce(F.lower(strip(username)).isin(S.SERVICE_USERS), F.lit(False))
    if email is None:
        return by_user
    return by_user | F.coalesce(F.lower(strip(email)).isin(S.SERVICE_EMAILS), F.lit(False))


def _repository_path(raw) -> Column:
    """``host/owner/name`` in lower case for any repository spelling, NULL if none."""
    text = strip(raw)
    short = r"^(?:github:)?([\w.-]+/[\w.-]+)$"
    url = F.regexp_replace(text, r"^git\+|#.*$", "")
    located = r"^(?:[a-z+]+://)?+(?:[^@/]+@)?([^/:]+)[/:]/*([^/]+)/+([^/]+).*$"
    path = F.when(text.rlike(short), F.regexp_replace(text, short, "github.com/$1")).when(
        url.rlike(located), F.regexp_replace(F.regexp_replace(url, located, "$1/$2/$3"), r"(?<=.)\.git$", "")
    )
    return F.lower(path)


def repository(raw) -> Column:
    """``struct(host, owner, name)``, NULL if there is no repository in the text."""
    parts = F.split(_repository_path(raw), "/")
    return F.when(
        parts.isNotNull(),
        F.struct(F.get(parts, F.lit(0)).alias("host"), F.get(parts, F.lit(1)).alias("owner"), F.get(parts, F.lit(2)).alias("name")),
    )


def repository_key(raw) -> Column:
    return F.concat(F.lit("repo:"), _repository_path(raw))


def epoch_seconds(raw) -> Column:
    """ISO-8601 text to epoch seconds, 0 when it cannot be read."""
    text = F.regexp_replace(strip(raw), r"(\.\d{6})\d+", "$1")
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), F.lit(S.UNKNOWN_TS)).cast("bigint")


def _lookup(col, table: dict, default) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


def severity_word(label) -> Column:
    word = F.lower(strip(label))
    return F.when(word != "", word).otherwise("unknown")


def severity_rank(label) -> Column:
    return _lookup(F.lower(strip(label)), S.SEVERITY_RANK, 0).cast("int")


def severity_base(label) -> Column:
    return _lookup(F.lower(strip(label)), S.SEVERITY_BASE, S.UNRATED_BASE).cast("double")


def split_aliases(raw) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(raw), F.lit("")), r"[|,]"), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def split_spec(spec) -> Column:
    """``name@version`` at the last ``@``; a leading ``@`` belongs to the scope."""
    text = strip(spec)
    has = text.rlike(r"^.+@[^@]*$")
    return F.struct(
        F.when(has, F.regexp_extract(text, r"^(.+)@[^@]*$", 1)).otherwise(text).alias("name"),
        F.when(has, F.regexp_extract(text, r"@([^@]*)$", 1)).otherwise("").alias("version"),
    )


def entry_name(path) -> Column:
    return F.substring_index(_c(path), "node_modules/", -1)


def specifier_package(specifier) -> Column:
    """Package root of an import: two segments when scoped, else one."""
    return F.regexp_extract(_c(specifier), r"^(@[^/]*/[^/]*|[^/]*)", 1)


def licence(raw_json) -> Column:
    """Licence given as text, ``{type}`` or a list of either. Takes raw JSON text."""
    raw = strip(raw_json)
    first = F.get_json_object(raw, "$[0]")
    return F.coalesce(
        F.when(
            raw.startswith("["),
            F.when(first.startswith("{"), F.get_json_object(raw, "$[0].type")).otherwise(first),
        )
        .when(raw.startswith("{"), F.get_json_object(raw, "$.type"))
        .when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
        .otherwise(raw),
        F.lit(""),
    )


# fixed values: Python lock files, whose content is an exact resolution
PYTHON_LOCKS = ["poetry.lock", "uv.lock", "Pipfile.lock", "requirements.lock"]
PYTHON_MANIFESTS = ["requirements.txt", "requirements.lock", "requirements-dev.txt"]


def resolution_kind(manifest, requested) -> Column:
    spec = F.coalesce(_c(requested), F.lit(""))
    return (
        F.when(F.substring_index(_c(manifest), "/", -1).isin(PYTHON_LOCKS), "locked")
        .when(spec.contains("==") & ~spec.contains("*"), "pinned")
        .otherwise("resolved")
    )


def date_word(ts) -> Column:
    value = _c(ts)
    return (
        F.when(value.isNull() | (value <= 0), "unknown")
        .when(value >= S.STILL_LIVE, "still live")
        .otherwise(F.date_format(F.timestamp_seconds(value), "yyyy-MM-dd"))
    )


def glob_regex(pattern) -> Column:
    """Shell glob to an anchored regular expression; ``*`` also crosses ``/``."""
    escaped = F.regexp_replace(_c(pattern), r"([.+^$(){}|\\])", r"\\$1")
    widened = F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(widened, r"\[!", "[^"), F.lit(")$"))


def glob_match(path, pattern) -> Column:
    return F.regexp_like(_c(path), glob_regex(pattern))


def with_default(col, default) -> Column:
    """Stored form of a property: lists become sorted text, flags 0/1, NULL a default."""
    return F.coalesce(_c(col), F.lit(default))


def flat_list(col) -> Column:
    return F.array_join(F.sort_array(F.coalesce(_c(col), F.array().cast("array<string>"))), "|")


def flag(col) -> Column:
    return F.coalesce(_c(col).cast("int"), F.lit(0))
