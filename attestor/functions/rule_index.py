"""An index of many patterns by literals that every match must hold.

A pattern can only match where one of its necessary literals stands. One scan of a text finds which
literals of the whole catalogue occur in it; a pattern none of whose literals occurs is not run, its
outcome is known. What is found is a superset (letter case is ignored, long literals are cut,
literals are told apart by a checksum), so outcomes never change.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from re import _constants as C
from re import _parser

from attestor.functions.masking import bind_sql
from attestor.functions.patterns import Refused, _literals
from attestor.functions.text import sql_literal

# Shorter literals stand in most texts; longer ones are cut, which keeps the scan's pattern small.
LEAST, MOST = 3, 12
# A pattern may stand for so many literals in a row.
ALTERNATIVES = 16


def necessary_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match holds at least one; None if there are none."""
    if re.match(r"\(\?[a-zA-Z]*[uU]", pattern):
        return None  # a letter may then match one that lower case does not lead to
    try:
        return _best(list(_parser.parse(pattern)))
    except (re.error, RecursionError, OverflowError):
        return None


def _best(items: list) -> list[str] | None:
    """The most telling of the literal sets that a sequence cannot do without."""
    found: list[list[str]] = []
    run = [""]
    for item in items:
        texts = _plain(item)
        if texts and len(run) * len(texts) <= ALTERNATIVES:
            run = [a + b for a in run for b in texts]
            continue
        found.append(run)
        run = [""]
        if texts:
            found.append(texts)
        else:
            found.append(_inside(item) or [])
    found.append(run)
    cut = [sorted({t.lower()[:MOST] for t in texts}) for texts in found if texts]
    usable = [texts for texts in cut if min(map(len, texts)) >= LEAST and len(texts) <= ALTERNATIVES]
    return max(usable, key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)


def _plain(item: tuple) -> list[str] | None:
    """All texts that an item stands for, if they are few and of printable ASCII characters."""
    try:
        texts = _literals([item])
    except Refused:
        return None
    return texts if all(t.isascii() and t.isprintable() for t in texts) else None


def _inside(item: tuple) -> list[str] | None:
    """The necessary literals of a group, of all parts of an alternation, of what is repeated."""
    kind, value = item
    if kind is C.SUBPATTERN and not (value[1] or value[2]):
        return _best(list(value[3]))
    if kind is C.BRANCH:
        parts = [_best(list(part)) for part in value[1]]
        return [t for part in parts for t in part] if all(parts) else None
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
        return _best(list(value[2]))
    return None


def _trie(words: set[str]) -> str:
    """A pattern for the longest of these words that stands at a place, shared by first letters."""
    by_first: dict[str, set[str]] = {}
    for word in words - {""}:
        by_first.setdefault(word[0], set()).add(word[1:])
    options = [(c if c.isalnum() else "\\" + c) + _trie(rest) for c, rest in sorted(by_first.items())]
    if not options:
        return ""
    return f"(?:{'|'.join(options)}){'?' if '' in words else ''}"


class RuleIndex:
    """The literals of a catalogue's patterns, and the scan that finds them."""

    def __init__(self, patterns: Iterable[str]) -> None:
        given = {p: necessary_literals(p) for p in patterns}
        self.literals_of = {p: literals for p, literals in given.items() if literals}

    def keys_sql(self, pattern: str | None) -> str:
        """The checksums of a pattern's literals; NULL for a pattern without any."""
        literals = self.literals_of.get(pattern)
        if literals is None:
            return "NULL"
        return f"array({', '.join(f'{k}L' for k in sorted({zlib.crc32(t.encode()) for t in literals}))})"

    def places_sql(self, patterns: dict[int, str], seen: str) -> str:
        """The places of those patterns (all with literals) of which a literal was seen, in any order,
        some perhaps repeated.

        The checksums are dealt into about as many bins as there are; one that was seen is compared
        with those of its own bin only.
        """
        places_of: dict[int, list[int]] = {}
        for place, pattern in patterns.items():
            for literal in self.literals_of[pattern]:
                places_of.setdefault(zlib.crc32(literal.encode()), []).append(place)
        kind = "array<struct<k:bigint,places:array<int>>>"
        bins: list[list[str]] = [[] for _ in places_of]
        for key, places in sorted(places_of.items()):
            bins[key % len(bins)].append(f"named_struct('k', {key}L, 'places', array({', '.join(map(str, sorted(set(places))))}))")
        if not bins:
            return "cast(array() AS array<int>)"
        dealt = ", ".join(f"cast(array({', '.join(b)}) AS {kind})" for b in bins)
        own = f"filter(array({dealt})[cast({seen}_k % {len(bins)} AS int)], b -> b.k = {seen}_k)"
        return f"flatten(flatten(transform({seen}, {seen}_k -> transform({own}, b -> b.places))))"

    def bind(self, text: str, seen: str, body: str) -> str:
        """``body`` with ``seen`` standing for the checksums of the literals that occur in ``text``.

        The scan looks for the longest literal at every place; the literals that this one begins
        with are those of its beginnings whose checksums the index knows.
        """
        literals = {t for literals in self.literals_of.values() for t in literals}
        if not literals:
            return bind_sql("cast(array() AS array<bigint>)", seen, body)
        scan = f"array_distinct(regexp_extract_all(lower({text}), {sql_literal(f'(?=({_trie(literals)}))')}, 1))"
        known = ", ".join(f"{k}L" for k in sorted({zlib.crc32(t.encode()) for t in literals}))
        beginnings = f"flatten(transform(said, f -> transform(sequence({LEAST}, length(f)), n -> crc32(left(f, n)))))"
        keys = f"array_distinct(filter({beginnings}, c -> c IN ({known})))"
        return bind_sql(bind_sql(scan, "said", keys), seen, body)
