"""Look-alike names: folding, deletion variants and bounded edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplygraph.functions.names import _c, bare_of, bound, scope_of

# fixed values: confusable spellings, applied top to bottom
CONFUSABLES = [
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m"),
    ("1", "l"), ("1", "i"), ("l", "i"), ("0", "o"), ("5", "s"),
    ("2", "z"), ("8", "b"), ("6", "b"), ("9", "g"),
]


def no_separators(name) -> Column:
    return F.regexp_replace(_c(name), "[-._]", "")


def skeleton(name) -> Column:
    text = no_separators(F.lower(bare_of(name)))
    for seen, folded in CONFUSABLES:
        text = F.replace(text, F.lit(seen), F.lit(folded))
    return text


def deletion_variants(text) -> Column:
    """The text with up to two characters left out, never emptied."""
    return bound(_deletion_variants, text, F.length(_c(text)))


def _deletion_variants(whole: Column, n: Column) -> Column:
    until = lambda i: F.substr(whole, F.lit(1), i - 1)
    one = F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(until(i), F.substr(whole, i + 1))))

    def second(i: Column) -> Column:
        return F.transform(
            F.sequence(i + 1, n),
            lambda j: F.concat(until(i), F.substr(whole, i + 1, j - i - 1), F.substr(whole, j + 1)),
        )

    two = F.when(n > 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), second)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(whole), F.coalesce(one, none), F.coalesce(two, none)))


def has_doubled_char(longer, shorter) -> Column:
    """Is ``longer`` the other text with one character typed twice?"""
    return bound(_doubled, longer, shorter)


def _doubled(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b) + 1) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))),
        lambda i: (F.substr(a, i, F.lit(1)) == F.substr(a, i + 1, F.lit(1)))
        & (F.concat(F.substr(a, F.lit(1), i), F.substr(a, i + 2)) == b),
    )


def osa_distance(a, b) -> Column:
    """Edit distance where a swap of neighbours costs one; 3 stands for "further".

    Within two edits there are few shapes: plain edits (built-in Levenshtein),
    one swap, two swaps, or a swap beside one edit that touches other
    characters. Each is an equality or a one-edit test on the rest of the
    name, so nothing but near pairs costs more than the built-in function.
    """
    return bound(_osa, a, b)


def _osa(x: Column, y: Column) -> Column:
    one = F.lit(1)
    at = lambda text, i: F.substr(text, i, one)
    size, other = F.length(x), F.length(y)
    shift = other - size
    places = F.sequence(one, F.greatest(size - 1, one))
    plain = F.levenshtein(x, y, 2)
    differing = F.filter(F.sequence(one, F.greatest(size, one)), lambda i: at(x, i) != at(y, i))

    def crossed(k: int) -> Column:
        p, q = F.get(differing, F.lit(k)), F.get(differing, F.lit(k + 1))
        return (q - p == 1) & (at(x, p) == at(y, q)) & (at(x, q) == at(y, p))

    def edit_after(i: Column) -> Column:
        return (
            (F.substr(x, one, i - 1) == F.substr(y, one, i - 1)) & (at(x, i) == at(y, i + 1)) & (at(x, i + 1) == at(y, i))
            & (F.levenshtein(F.substr(x, i + 2), F.substr(y, i + 2), 1) >= 0)
        )

    def edit_before(i: Column) -> Column:
        j = i + shift
        return (
            (j >= 1) & (at(x, i) == at(y, j + 1)) & (at(x, i + 1) == at(y, j)) & (F.substr(x, i + 2) == F.substr(y, j + 2))
            & (F.levenshtein(F.substr(x, one, i - 1), F.substr(y, one, j - 1), 1) >= 0)
        )

    beside = (size >= 2) & (F.abs(shift) <= 1) & F.exists(places, lambda i: edit_after(i) | edit_before(i))
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None))
        .when(F.abs(shift) > 2, 3)
        .when(x == y, 0)
        .when((plain == 1) | ((shift == 0) & (F.size(differing) == 2) & crossed(0)), 1)
        .when(plain == 2, 2)
        .when(F.levenshtein(x, y, 4) < 0, 3)
        .when((shift == 0) & (F.size(differing) == 4) & crossed(0) & crossed(2), 2)
        .when(beside, 2)
        .otherwise(3)
        .cast("int")
    )


def scopes_comparable(candidate, target) -> Column:
    """Names in different scopes are compared only when the bare names agree."""
    return scope_of(candidate).eqNullSafe(scope_of(target)) | (bare_of(candidate) == bare_of(target))


def is_naming_convention(candidate, target, scope_distance) -> Column:
    """A family of names (``x.y``, ``@types/x``) rather than an imitation."""
    cb, tb = bare_of(candidate), bare_of(target)
    cs, ts = scope_of(candidate), scope_of(target)
    family = F.lit(False)
    for sep in (".", "-", "/", "_"):
        family = family | cb.startswith(F.concat(tb, F.lit(sep))) | tb.startswith(F.concat(cb, F.lit(sep)))
    return (
        F.when((cs.isNull() != ts.isNull()) & (cb == tb), True)
        .when(cs.isNotNull() & ts.isNotNull() & (cb == tb), (_c(scope_distance) > 2) | (_c(scope_distance) == 0))
        .otherwise(family)
    )


def technique(candidate, target, distance) -> Column:
    """How the name resembles its target; NULL when it does not."""
    return bound(
        _technique, bare_of(candidate), bare_of(target), _c(distance),
        ~scope_of(candidate).eqNullSafe(scope_of(target)), skeleton(candidate) == skeleton(target),
    )


def _technique(cb: Column, tb: Column, d: Column, other_scope: Column, same_shape: Column) -> Column:
    differing = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(cb), F.lit(1))),
        lambda i: F.substr(cb, i, F.lit(1)) != F.substr(tb, i, F.lit(1)),
    )
    swap = (
        (F.length(cb) == F.length(tb)) & (d == 1) & (F.size(differing) == 2)
        & (F.get(differing, F.lit(1)) - F.get(differing, F.lit(0)) == 1)
    )
    return (
        F.when((cb == tb) & other_scope, "scope_confusion")
        .when(no_separators(cb) == no_separators(tb), "separator")
        .when(same_shape, "homoglyph")
        .when(d == 0, F.lit(None))
        .when(swap, "transposition")
        .when(_doubled(cb, tb), "repeated_char")
        .when(d <= 2, "edit_distance")
    )
