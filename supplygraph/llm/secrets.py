"""Secret scan: three patterns, and character Markov models for what they miss.

All of it is DataFrame and SQL functions. Matches and their places come from
splitting a text at a pattern: the pieces between the matches and the matches
themselves add up to the offsets (in code points).

The method's spans are stretches matching ``CANDIDATE`` that no base span touches
and that are likelier under a Markov model of random strings than under one of
ordinary identifiers, by more than ``MARGIN`` per pair of neighbours, or in all by
more than ``LEAST_RATIO`` if they are shorter than ``SHORT``. Of a stretch that is not, its parts between ``+``,
``/``, ``_`` and ``-`` (``PART``) are judged in the same way. A string of less than
``LEAST`` characters is too short to tell and is not scored. Both models are
first-order models over character classes (a-z, A-Z and digits one by one, other
characters together). They are trained on strings whose label is known,
from every document that has a base span: what the base spans hold is random,
the words and numbers around them are ordinary, as written and in capitals. Pairs are counted by one partial
aggregation; the counts, at most 2 x 63 x 63 rows whatever the input, make one
constant array of log-likelihood ratios. The random model is drawn towards equal
chances by ``RANDOM_PRIOR`` so that other random alphabets than the sample's fit
it too, the ordinary one by ``ORDINARY_PRIOR`` towards its characters' shares.

Defined results: a null or empty text has no spans and the hash of the empty
list; equal rows each get a row; a text without candidates is not scored; if a
model has no sample, its pairs are equally likely; an empty table gives an empty
result; further columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph.llm import common as C

#: Base kinds in the order that ties follow: pattern, group that is measured, least length of it.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = {"assign": ASSIGN + VALUE, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
LEAST_VALUE = 6
#: What the models judge, by how much the log-likelihoods per pair must differ, and by how much in all in a string of less than SHORT characters.
LEAST = 8
CANDIDATE = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"
PART = f"(?:(?<=[+/_-])[A-Za-z0-9]{{{LEAST},}}|(?<![A-Za-z0-9])[A-Za-z0-9]{{{LEAST},}}(?=[+/_-]))"
MARGIN = 0.6
SHORT, LEAST_RATIO = 20, 20.0
RANDOM_PRIOR, ORDINARY_PRIOR = 200.0, 20.0
#: Ordinary strings of the training sample.
ORDINARY = "[A-Za-z0-9][A-Za-z0-9_-]{7,}"
#: Character classes by their place; everything else is the last class.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLASSES = len(SYMBOLS) + 1

SPAN = "struct<start:long,stop:long,value:string>"


def spans(text: str, pattern: str) -> Column:
    """``array<struct<start, stop, value>>`` of the pattern's matches, leftmost and not overlapping."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"""CASE WHEN {text} RLIKE '{quoted}' THEN aggregate(
        arrays_zip(slice(split({text}, '{quoted}', -1), 1, size(regexp_extract_all({text}, '{quoted}', 0))), regexp_extract_all({text}, '{quoted}', 0)),
        named_struct('at', 0L, 'found', cast(array() as array<{SPAN}>)),
        (a, p) -> named_struct('at', a.at + length(p['0']) + length(p['1']),
            'found', array_append(a.found, named_struct('start', a.at + length(p['0']), 'stop', a.at + length(p['0']) + length(p['1']), 'value', p['1']))),
        a -> a.found) ELSE cast(array() as array<{SPAN}>) END""")


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the arrays ``assign``, ``access`` and ``hex``; the value of an assignment is what is assigned."""
    found = C.documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    found = found.withColumns({kind: spans("text", pattern) for kind, pattern in PATTERNS.items()})
    assigned = F.transform("assign", lambda s: s.withField("value", F.regexp_replace(s["value"], f"^{ASSIGN}", "")))
    return found.withColumn("assign", F.filter(assigned, lambda s: F.length(s["value"]) >= LEAST_VALUE))


def symbol(value: str, at: str) -> str:
    """SQL for the class of a character, 0 to CLASSES - 1."""
    return f"coalesce(nullif(instr('{SYMBOLS}', substr({value}, {at}, 1)), 0), {CLASSES}) - 1"


def pairs(value: str) -> str:
    """SQL for the classes of each two neighbours, as one number each; for values of two characters or more."""
    return f"transform(sequence(1, length({value}) - 1), i -> ({symbol(value, 'i')}) * {CLASSES} + {symbol(value, 'i + 1')})"


def pair_counts(found: DataFrame) -> DataFrame:
    """``random, pair, n``: neighbours counted over the labelled strings of all documents."""
    known = found.where("size(assign) + size(access) + size(hex) > 0")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", PATTERNS["assign"], " "), PATTERNS["access"], " "), PATTERNS["hex"], " ")
    values = known.select(F.concat(F.col("assign.value"), F.col("access.value"), F.col("hex.value")).alias("random"), F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)).alias("ordinary"))
    values = values.withColumn("ordinary", F.concat("ordinary", F.transform("ordinary", F.upper)))
    labelled = values.select(F.explode(F.concat(
        F.transform("random", lambda v: F.struct(F.lit(True).alias("random"), v.alias("value"))), F.transform("ordinary", lambda v: F.struct(F.lit(False).alias("random"), v.alias("value"))),
    )).alias("s")).select("s.*").where("length(value) > 1")
    return labelled.select("random", F.explode(F.expr(pairs("value"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))


def ratios(counts: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each pair; the counts are at most 2 x CLASSES x CLASSES rows."""
    tables = {kind: [[0.0] * CLASSES for _ in range(CLASSES)] for kind in (True, False)}
    for row in counts.collect():
        tables[row.random][row.pair // CLASSES][row.pair % CLASSES] = float(row.n)
    seen = [1.0 + sum(line[k] for line in tables[False]) for k in range(CLASSES)]
    priors = {True: [RANDOM_PRIOR] * CLASSES, False: [ORDINARY_PRIOR * n / sum(seen) for n in seen]}
    shares = {}
    for kind, table in tables.items():
        prior = priors[kind]
        shares[kind] = [math.log((n + p) / (sum(line) + sum(prior))) for line in table for n, p in zip(line, prior, strict=True)]
    return [a - b for a, b in zip(shares[True], shares[False], strict=True)]


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``doc_id`` with the span arrays ``assign, access, hex, markov`` of every document."""
    found = base_spans(docs)
    model = ratios(pair_counts(found)) if model is None else model
    weights = "cast(split('" + ",".join(f"{w:.5f}" for w in model) + "', ',') as array<double>)"
    base = F.concat("assign", "access", "hex")
    apart = lambda c, others: ~F.exists(others, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    likely = lambda name: F.expr(
        f"filter({name}, s -> aggregate({pairs('s.value')}, 0D, (a, p) -> a + element_at({weights}, p + 1)) > IF(length(s.value) < {SHORT}, {LEAST_RATIO}D, {MARGIN} * (length(s.value) - 1)))"
    )
    found = found.withColumns({"stretch": spans("text", CANDIDATE), "part": spans("text", PART)})
    found = found.withColumn("whole", likely("stretch")).withColumn("whole", F.filter("whole", lambda c: apart(c, base)))
    found = found.withColumn("part", likely("part")).withColumn("part", F.filter("part", lambda c: apart(c, F.concat(base, F.col("whole")))))
    return found.withColumn("markov", F.concat("whole", "part")).select("doc_id", *KINDS)


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans by start, then by kind as listed, comma-joined."""
    parts = [F.expr(f"transform({k}, s -> named_struct('start', s.start, 'kind', {i}, 'stop', s.stop, 'name', '{k}'))") for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        C.sha256_utf8(listed(KINDS[:3])).alias("base_sha256"), listed(KINDS).alias("spans"),
    )
