"""Triage: document type by cue words."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions.masking import bind_sql
from attestor.functions.text import sql_literal

# A word with the blank behind it, if exactly one blank parts it from the next word.
TOKEN = r"[a-z0-9_]+(?: (?=[a-z0-9_]))?"


def spellings(cue: str) -> list[str] | None:
    """The word sequences that a cue stands for (a last letter with ? may be missing); None if the
    cue is a pattern of another kind."""
    words = [re.fullmatch(r"([a-z0-9_]+?)([a-z0-9_]\?)?", word) for word in cue.split(" ")]
    if not all(words):
        return None
    return [" ".join(p) for p in product(*[[m[1]] + ([m[1] + m[2][0]] if m[2] else []) for m in words])]


def _whole(cue: str) -> str:
    """The cue as whole words: no letter, digit or underscore on either side."""
    return f"(?:^|[^a-z0-9_])(?:{cue})(?:[^a-z0-9_]|$)"


def _one_of(forms: list[str]) -> str:
    return f"IN ({', '.join(map(sql_literal, sorted(forms)))})"


def _found(number_of: dict[str, int]) -> str:
    """Numbers of the cues among the words of ``low``, in one scan of the text.

    The text is cut into words once. Words that begin a cue are looked up in one set, with the
    words behind them as far as the longest cue reaches; how many cues there are does not matter.
    """
    by_length: dict[int, list[str]] = {}
    for form in number_of:
        by_length.setdefault(form.count(" ") + 1, []).append(form)
    firsts = sorted({form.split(" ")[0] for form in number_of})
    # A sequence of n tokens has n - 1 blanks only if single blanks part all of them.
    said = {n: f"rtrim(array_join(slice(t, i + 1, {n}), ''))" for n in by_length}
    hits = ", ".join(f"IF({said[n]} {_one_of(forms)}, {said[n]}, NULL)" for n, forms in sorted(by_length.items()))
    per_word = f"CASE WHEN rtrim(w) {_one_of(firsts)} THEN array({hits}) ELSE cast(array() AS array<string>) END"
    forms = bind_sql(f"regexp_extract_all(low, {sql_literal(TOKEN)}, 0)", "t", f"array_compact(flatten(transform(t, (w, i) -> {per_word})))")
    numbers = f"map({', '.join(f'{sql_literal(f)}, {n}' for f, n in number_of.items())})"
    return f"array_distinct(transform({forms}, f -> element_at({numbers}, f)))"


def triage_of(masked: str, cues: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Struct of doc_type, confidence and reasoning from the cues found in the masked text.

    The cue list is configuration, so the cues become literals of one row-local expression: no join
    of documents with cues and no shuffle. A cue counts once, however often it occurs. Equal scores
    go to the type listed first; without any cue the type is unknown.
    """
    cues = cues or V.TRIAGE_CUES
    types = f"array({', '.join(sql_literal(t) for t in cues)})"
    number_of: dict[str, int] = {}
    points, number = [], 0
    for listed in cues.values():
        first, patterns = number, []
        for cue in listed:
            forms = spellings(cue)
            if forms is None:
                patterns.append(f"cast(low RLIKE {sql_literal(_whole(cue))} AS int)")
            else:
                number_of |= {form: number for form in forms if form not in number_of}
                number += 1
        points.append(" + ".join([f"size(filter(seen, n -> n >= {first} AND n < {number}))", *patterns]))
    seen = _found(number_of) if number_of else "cast(array() AS array<int>)"
    scores = bind_sql(f"lower(coalesce({masked}, ''))", "low", bind_sql(seen, "seen", f"array({', '.join(points)})"))
    summed = (
        f"named_struct('best', array_max(s), 'total', aggregate(s, 0, (a, b) -> a + b),"
        f" 'type', {types}[cast(array_position(s, array_max(s)) AS int) - 1])"
    )
    known = (
        "named_struct('doc_type', r.type, 'confidence', cast(r.best / r.total AS double),"
        " 'reasoning', concat(r.best, ' of ', r.total, ' cue(s) found point to ', r.type))"
    )
    unknown = (
        f"named_struct('doc_type', '{V.UNKNOWN}', 'confidence', 0D, 'reasoning', 'no cue found')"
    )
    decided = f"CASE WHEN r.total > 0 THEN {known} ELSE {unknown} END"
    return F.expr(bind_sql(bind_sql(scores, "s", summed), "r", decided))


def triage(docs: DataFrame, text: str = "scrubbed_text") -> DataFrame:
    """Add doc_type, confidence and reasoning."""
    typed = docs.select("*", triage_of(text).alias("triage_result"))
    return typed.select(*docs.columns, "triage_result.*")
