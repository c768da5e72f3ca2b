"""Patterns from a catalogue file: which of them are safe to run on any text, and in which form.

A pattern is taken as it is if no text can make it read the same characters again and again: its
unbounded repetitions are over single characters that neither what follows them nor the pattern's
first character can be. One wildcard between two parts is put into an equal form that is tried once
per text or line, if the first part stands for a few literals none of which lies in another (the
first to begin is then the first to end). Everything else is refused: the rule is not evaluated and
named as such, because one hostile text of a few megabytes would keep its task busy for days.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser

from attestor.rule_catalogue import LINEAR

# Repetitions of up to so many are bounded work; so is a product of nested ones up to the square.
FEW = 64
MANY_LITERALS = 64
_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)
_SINGLE = (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN)
# Characters that stand for their kinds when sets are compared.
_SAMPLE = [chr(i) for i in range(0x180)] + ["١", " ", "　", "中", "K"]
_WILDCARD = re.compile(r"\.\*\??|\[\^\\n\]\*\??")


class Refused(ValueError):
    """The pattern is not known to be safe."""


def linear(pattern: str | None, counted: bool = False) -> str | None:
    """The pattern or an equal one in linear time; ``Refused`` if that is not proven.

    ``counted``: matches are counted, so that only the pattern as it stands will do.
    """
    if pattern is None or (pattern in LINEAR and not counted):
        return LINEAR.get(pattern, pattern)
    try:
        parsed = _parser.parse(pattern)
        re.compile(pattern)
    except (re.error, RecursionError, OverflowError) as error:
        raise Refused(f"not understood: {pattern}") from error
    try:
        _walk(list(parsed), [], _first(list(parsed), parsed.state.flags), parsed.state.flags, 1)
        return pattern
    except Refused:
        if counted:
            raise
    return _anchored(pattern, parsed.state.flags)


def is_safe(pattern: str | None, counted: bool = False) -> bool:
    try:
        linear(pattern, counted)
    except Refused:
        return False
    return True


def _chars(item: tuple, flags: int) -> set[str]:
    """Sample characters that one single-character item matches."""
    kind, value = item
    if kind is C.LITERAL:
        found = {chr(value)}
    elif kind is C.NOT_LITERAL:
        found = {c for c in _SAMPLE if c != chr(value)}
    elif kind is C.ANY:
        found = set(_SAMPLE) if flags & re.S else {c for c in _SAMPLE if c != "\n"}
    else:
        body = [v for v in value if v[0] is not C.NEGATE]
        found = set()
        for what, inner in body:
            if what is C.LITERAL:
                found.add(chr(inner))
            elif what is C.RANGE:
                found |= {c for c in _SAMPLE if inner[0] <= ord(c) <= inner[1]} | {chr(inner[0]), chr(inner[1])}
            elif what is C.CATEGORY:
                name = str(inner).rpartition("_")[2].lower()
                known = {"digit": r"\d", "space": r"\s", "word": r"\w"}[name]
                shape = known.upper() if "NOT" in str(inner) else known
                found |= {c for c in _SAMPLE if re.match(shape, c)}
        if len(body) < len(value):
            found = set(_SAMPLE) - found
    if flags & re.I:
        found |= {c.swapcase() for c in found if len(c.swapcase()) == 1}
    return found


def _first(items: list, flags: int) -> set[str]:
    """Characters that a sequence can begin with."""
    found: set[str] = set()
    for kind, value in items:
        if kind in _SINGLE:
            return found | _chars((kind, value), flags)
        if kind in _REPEATS:
            found |= _first(list(value[2]), flags)
            if value[0]:
                return found
        elif kind is C.SUBPATTERN:
            inner = list(value[3])
            found |= _first(inner, flags)
            if not _may_be_empty(inner):
                return found
        elif kind is C.BRANCH:
            for part in value[1]:
                found |= _first(list(part), flags)
            if not any(_may_be_empty(list(part)) for part in value[1]):
                return found
        elif kind is not C.AT:
            return set(_SAMPLE)
    return found


def _may_be_empty(items: list) -> bool:
    for kind, value in items:
        if kind in _SINGLE or (kind in _REPEATS and value[0]):
            return False
        if kind is C.SUBPATTERN and not _may_be_empty(list(value[3])):
            return False
        if kind is C.BRANCH and not any(_may_be_empty(list(part)) for part in value[1]):
            return False
    return True


def _walk(items: list, after: list, start: set[str], flags: int, times: int) -> None:
    """Refuse unless every unbounded repetition is one that no text makes expensive."""
    for i, (kind, value) in enumerate(items):
        rest = items[i + 1 :] + after
        if kind in _SINGLE or kind is C.AT:
            continue
        if kind is C.SUBPATTERN:
            if value[1] or value[2]:
                raise Refused("flags inside")
            _walk(list(value[3]), rest, start, flags, times)
        elif kind is C.BRANCH:
            for part in value[1]:
                _walk(list(part), rest, start, flags, times)
        elif kind in _REPEATS:
            most, inner = value[1], list(value[2])
            if most is C.MAXREPEAT or most > FEW:
                if len(inner) != 1 or inner[0][0] not in _SINGLE or times > 1:
                    raise Refused("nested")
                own = _chars(inner[0], flags)
                if rest and (own & _first(rest, flags) or own & start):
                    raise Refused("overlapping")
            elif times * most > FEW * FEW:
                raise Refused("nested")
            else:
                _walk(inner, rest, start, flags, max(times * most, 1 if most < 2 else 2))
        else:
            raise Refused(f"{kind}")


def _anchored(pattern: str, flags: int) -> str:
    """The equal form of ``first wildcard second``, tried once per text or line."""
    body = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    for at in _top_level(body):
        wild = _WILDCARD.match(body, at)
        if not wild:
            continue
        one, two = body[:at], body[wild.end() :]
        head = pattern[: len(pattern) - len(body)]
        words = [w.lower() for w in _literals(list(_parser.parse(head + one)))]
        if not words or not all(words) or any(a != b and a in b for a in words for b in words):
            raise Refused("first part")
        rest = list(_parser.parse(head + two))
        _walk([(C.ANY, None)] * bool(rest) + rest, [], set(), flags, 1)
        any_char = wild[0].rstrip("?")[:-1]
        given = "i" * bool(flags & re.I)
        if any_char == "." and flags & re.S:
            return f"(?s{given})\\A(?>.*?(?:{one})).*(?:{two})"
        if flags & (re.S | re.M):
            raise Refused("lines")
        lines = "dm" if any_char != "." else "m"
        return f"(?{lines}{given})^(?>{any_char}*?(?:{one})){any_char}*(?:{two})"
    raise Refused("no single wildcard")


def _top_level(body: str) -> list[int]:
    """Places outside of groups and classes."""
    found, depth, i = [], 0, 0
    while i < len(body):
        if depth == 0:
            found.append(i)
        if body[i] == "\\":
            i += 2
            continue
        if body[i] == "[":
            end = body.index("]", i + 2 + (body[i + 1 : i + 2] == "^"))
            i = end + 1
            continue
        if body[i] == "|" and depth == 0:
            return []
        depth += {"(": 1, ")": -1}.get(body[i], 0)
        i += 1
    return found


def _literals(items: list) -> list[str]:
    """All texts that a sequence stands for, if they are few."""
    parts: list[list[str]] = []
    for kind, value in items:
        if kind is C.LITERAL:
            parts.append([chr(value)])
        elif kind is C.SUBPATTERN and not (value[1] or value[2]):
            parts.append(_literals(list(value[3])))
        elif kind is C.BRANCH:
            parts.append([w for part in value[1] for w in _literals(list(part))])
        elif kind is C.IN and all(v[0] is C.LITERAL for v in value):
            parts.append([chr(v) for _, v in value])
        elif kind is C.MAX_REPEAT and value[:2] == (0, 1):
            parts.append(["", *_literals(list(value[2]))])
        elif kind is not C.AT:
            raise Refused("no literal")
        size = 1
        for p in parts:
            size *= len(p)
        if size > MANY_LITERALS:
            raise Refused("too many literals")
    return ["".join(p) for p in product(*parts)]
