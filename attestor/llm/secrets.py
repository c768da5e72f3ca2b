"""Secret scans: fixed patterns, then sliding-window entropy over candidate strings.

Everything is one row-local projection of built-in functions. A pattern's spans come from the
pieces between its matches: lengths of pieces and matches add up to positions (code points, end
exclusive), in chunks, so that a text full of matches costs little more than its length.

Base kinds (assign, access, hex) report every match that is long enough. The entropy kinds take
maximal runs of a character class as candidates and slide a window over them; the window's sum of
``c * log2 c`` over its character counts ``c`` is kept up by the counts of the one character that
leaves and the one that enters, in fixed-point integers. A run is reported from its first to its
last window of high entropy, unless an allow-list pattern covers it or it overlaps a span of
an earlier kind. Allow-list patterns cover the whole run, so that a token inside a path or a long key
that happens to hold a known word is still reported.

A null text counts as empty; texts without spans have empty lists. Repeated rows are scanned one
by one; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import whole_text
from attestor.session import bind

# Patterns of the base kinds (fixed values). A run of hex digits or an access key is long enough
# exactly if its maximal run is, so the least length stands in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

CHUNK = 256
UNIT = 1 << 20


@dataclass(frozen=True)
class EntropyClass:
    """A character class, what its candidates need, the window, and bits per character in it."""

    kind: str
    letters: str
    least: int
    needs: tuple[str, ...]
    window: int
    bits: float


# Limits lie above what words of a text reach and below what random strings reach.
CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", 24, ("[0-9]", "[A-Fa-f]"), 24, 3.05),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_-", 24, ("[0-9]", "[a-z]", "[A-Z]"), 24, 3.85),
)
# Strings that look random but are none: dashed ids, marks of samples, alphabets and counting within
# their own short segment, and paths whose parts are all words or numbers of any number. Each covers
# the whole run. A part ends where its letters end, and no repetition gives back what it took: one
# walk over the run, however long, without recursion.
_END = "(?=[/_+-]|$)"
_WORD = "(?:(?:[a-z]+(?:[A-Z][a-z]{2,})*+|(?:[A-Z][a-z]{2,})++|[A-Z]+|[A-Z][a-z])[0-9]{0,4}|[0-9]{1,4})"
_PLAIN_WORD = _WORD.replace("*+", "*").replace("++", "+")
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)^/?[^/]{0,64}(?:abcdefghij|0123456789|9876543210|qwertyuiop|example|sample|placeholder|changeme|dummy)[^/]{0,64}/?$",
    f"^[/_+-]*+(?:{_WORD}{_END}[/_+-]*+)*+$",
)
# The same language for engines without possessive repetition, which do not need it.
PLAIN = {ALLOWED[2]: f"^[/_+-]*(?:{_PLAIN_WORD}(?:[/_+-]+{_PLAIN_WORD})*)?[/_+-]*$"}


def mass(count: int) -> int:
    """``count * log2 count`` in fixed-point units."""
    return round(count * math.log2(count) * UNIT) if count else 0


def most_mass(window: int, bits: float) -> int:
    """The largest sum of masses in a window that has at least so many bits per character."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def spans_of(steps: Column, kind: int) -> Column:
    """Spans from an array of (gap, width, from, upto): from and upto lie inside the match, null
    where it is dropped."""
    n = F.size(steps)

    def run(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["width"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
        bases = F.aggregate(
            totals, start,
            lambda s, t: F.struct((s["at"] + t).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")),
            lambda s: s["seen"],
        )
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

        def step(s: Column, x: Column) -> Column:
            first = s["at"] + x["gap"]
            span = F.struct((first + x["from"]).alias("start"), F.lit(kind).alias("kind"), (first + x["upto"]).alias("end"))
            more = F.when(x["from"].isNull(), s["seen"]).otherwise(F.concat(s["seen"], F.array(span)))
            return F.struct((first + x["width"]).alias("at"), more.alias("seen"))

        inside = F.zip_with(chunks, bases, lambda c, b: F.aggregate(c, F.struct(b.alias("at"), none.alias("seen")), step, lambda s: s["seen"]))
        return F.flatten(inside)

    chunked = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))
    return bind(chunked, run)


def found(text: Column, pattern: str, kind: int, judge) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches; ``judge(match)`` gives (from, upto)."""
    none = F.array().cast("array<struct<gap:int,width:int,from:int,upto:int>>")

    def measure(pieces: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

        def one(piece: Column, match: Column) -> Column:
            return bind(judge(match), lambda part: F.struct(
                F.length(piece).alias("gap"), F.length(match).alias("width"), part["from"].alias("from"), part["upto"].alias("upto")
            ))

        return F.when(F.size(pieces) > 1, F.zip_with(gaps, matches, one)).otherwise(none)

    return bind(bind(F.split(text, pattern, -1), measure), lambda steps: spans_of(steps, kind))


def part(first: Column, upto: Column) -> Column:
    return F.struct(first.cast("int").alias("from"), upto.cast("int").alias("upto"))


def whole(match: Column) -> Column:
    return part(F.lit(0), F.length(match))


def assigned(match: Column) -> Column:
    fits = F.length(F.regexp_extract(match, ASSIGN, 1)) >= ASSIGN_LEAST
    return part(F.when(fits, 0), F.when(fits, F.length(match)))


def entropic(cls: EntropyClass, allowed: tuple[str, ...]):
    """Judge a candidate run: from its first to its last window of high entropy."""
    w = cls.window
    masses = F.array(*[F.lit(mass(c)).cast("long") for c in range(w + 2)])
    limit = F.lit(most_mass(w, cls.bits)).cast("long")

    def slide(codes: Column) -> Column:
        count = lambda start, code: F.size(F.filter(F.slice(codes, start, w), lambda x: x == code))
        first = F.slice(codes, F.lit(1), F.lit(w))
        whole_mass = F.aggregate(F.array_distinct(first), F.lit(0).cast("long"), lambda s, c: s + masses[count(F.lit(1), c)])

        def put(total: Column, at: Column, s: Column | None) -> Column:
            high = total <= limit
            low_at = F.when(high, at) if s is None else F.coalesce(s["low"], F.when(high, at))
            high_at = F.when(high, at + w) if s is None else F.when(high, at + w).otherwise(s["high"])
            return F.struct(total.alias("total"), low_at.cast("int").alias("low"), high_at.cast("int").alias("high"))

        def step(s: Column, i: Column) -> Column:
            # The window starting at position i (1-based) loses its first character and gains another.
            gone, come = codes[i - 1], codes[i - 1 + w]
            had, has = count(i, gone), count(i, come)
            change = masses[had - 1] - masses[had] + masses[has + 1] - masses[has]
            total = s["total"] + F.when(gone == come, F.lit(0).cast("long")).otherwise(change)
            return bind(total, lambda t: put(t, i, s))

        moves = F.when(F.size(codes) > w, F.sequence(F.lit(1), F.size(codes) - w)).otherwise(F.array().cast("array<int>"))
        begin = bind(whole_mass, lambda t: put(t, F.lit(0), None))
        return F.aggregate(moves, begin, step, lambda s: part(s["low"], s["high"]))

    def judge(match: Column) -> Column:
        fits = F.lit(True)
        for needed in cls.needs:
            fits = fits & match.rlike(needed)
        for pattern in allowed:
            fits = fits & ~match.rlike(pattern)
        codes = F.transform(F.split(match, ""), lambda c: F.ascii(c))
        nothing = part(F.lit(None), F.lit(None))
        return F.when(fits, bind(F.filter(codes, lambda c: c > 0), slide)).otherwise(nothing)

    return judge


def outside(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of the taken ones."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Per document: key, base and added, arrays of (start, kind, end) in order; kind counts
    ``KINDS`` and then ``classes``."""
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    base = F.struct(
        found(F.col("text"), ASSIGN, 0, assigned).alias("assign"),
        found(F.col("text"), ACCESS, 1, whole).alias("access"),
        found(F.col("text"), HEX, 2, whole).alias("hex"),
        *[
            found(F.col("text"), f"(?<![{c.letters}])[{c.letters}]{{{c.least},}}", 3 + i, entropic(c, allowed)).alias(c.kind)
            for i, c in enumerate(classes)
        ],
    )
    # inline() makes the spans a row's values, so that no later column computes them again.
    spans = rows.select("key", F.inline(F.array(base)))
    taken = F.concat("assign", "access", "hex")
    spans = spans.select("key", F.sort_array(taken).alias("base"), *[c.kind for c in classes])
    added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    for c in classes:
        added = F.concat(added, outside(F.col(c.kind), F.concat("base", added)))
    return spans.select(F.col("key").alias(key), "base", F.sort_array(added).alias("added"))


def joined(spans: Column, classes: tuple[EntropyClass, ...] = CLASSES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *(c.kind for c in classes))])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Per document: key, n_assign, n_access, n_hex, base_sha256, spans."""
    found_spans = scan(docs, key, text, allowed=allowed)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found_spans.select(
        key, *[number(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def _sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def report_sql(table: str = "documents", allowed: tuple[str, ...] = ALLOWED) -> str:
    """DuckDB SQL for ``report``: windows are compared one by one, not incrementally."""
    patterns = [ASSIGN, ACCESS, "[0-9a-f]{16,}", *(f"[{c.letters}]{{{c.least},}}" for c in CLASSES)]
    kinds = [*KINDS, *(c.kind for c in CLASSES)]
    scans = " UNION ALL ".join(
        f"SELECT doc_id, row_id, {k} AS kind, regexp_extract_all(x, {_sql_quote(p)}) AS m, string_split_regex(x, {_sql_quote(p)}) AS p FROM t"
        for k, p in enumerate(patterns)
    )
    passed = " OR ".join(
        f"(kind = {3 + i} AND " + " AND ".join([f"regexp_matches(s, {_sql_quote(n)})" for n in c.needs] + [f"NOT regexp_matches(s, {_sql_quote(PLAIN.get(a, a))})" for a in allowed]) + ")"
        for i, c in enumerate(CLASSES)
    )
    width = "CASE kind " + " ".join(f"WHEN {3 + i} THEN {c.window}" for i, c in enumerate(CLASSES)) + " END"
    limit = "CASE kind " + " ".join(f"WHEN {3 + i} THEN {most_mass(c.window, c.bits)}" for i, c in enumerate(CLASSES)) + " END"
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    value = f"list_sum(list_transform(map_values(list_histogram(string_split(substr(s, j + 1, w), ''))), lambda c: CAST(round(c * log2(c) * {UNIT}) AS BIGINT)))"
    free = "NOT EXISTS (SELECT 1 FROM {a} b WHERE b.row_id = e.row_id AND e.a < b.z AND b.a < e.z)"
    extra, taken = "", ["base"]
    for i in range(len(CLASSES)):
        clauses = " AND ".join(free.format(a=a) for a in taken)
        extra += f", add{i} AS (SELECT * FROM runs e WHERE kind = {3 + i} AND {clauses})"
        taken.append(f"add{i}")
    every = " UNION ALL ".join(f"SELECT * FROM {a}" for a in taken)
    text = f"string_agg({name} || ':' || a || ':' || z, ',' ORDER BY a, kind)"
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS x FROM {table}),
scans AS ({scans}),
cut AS (SELECT doc_id, row_id, kind, m, p, unnest(range(1, len(m) + 1)) AS i FROM scans),
found AS (
  SELECT doc_id, row_id, kind, m[i] AS s,
         CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS a
  FROM cut),
base AS (
  SELECT doc_id, row_id, kind, a, a + length(s) AS z FROM found
  WHERE kind IN (1, 2) OR (kind = 0 AND length(regexp_extract(s, {_sql_quote(ASSIGN)}, 1)) >= {ASSIGN_LEAST})),
moved AS (
  SELECT doc_id, row_id, kind, a, s, {width} AS w, unnest(range(length(s) - {width} + 1)) AS j
  FROM found WHERE {passed}),
runs AS (
  SELECT doc_id, row_id, kind, a + min(j) AS a, a + max(j) + any_value(w) AS z
  FROM moved WHERE {value} <= {limit} GROUP BY doc_id, row_id, kind, moved.a){extra},
every AS ({every}),
b AS (SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex, {text} AS spans FROM base GROUP BY row_id),
e AS (SELECT row_id, {text} AS spans FROM every GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM t LEFT JOIN b USING (row_id) LEFT JOIN e USING (row_id)
"""
