import random
import re
import time

import pytest
from pyspark.sql import Row

from attestor.functions.patterns import Refused, is_safe, linear
from attestor.plans.audit import audit_uploads
from attestor.rule_catalogue import LINEAR, PREDICATES

REFUSED = [
    "(a+)+$", "(a|a)*b", r"\w+@\w+", r"(\d+\s*)*x", "a.*b.*c", ".*foo", r"(?s)a.{0,500}b", "(?:x{0,60}){0,60}{0,60}", r"(ab|a).*c",
    r"a[ab]*c", r"(?<!x)y", r"\p{L}+", "(", r"a(?i:b)+c",
]
KEPT = [r"(?i)\bdate\b", r"\d{3}", r"invoice\s*(no|number)\W*\w+", "abc", r"x[0-9]*y", r"(?i)a{0,40}b", "foo.*", r"colou?r"]
CHANGED = [r"(?is)valid from.*valid until", r"(?i)total due[^\n]*(INR|USD)", r"(?s)(entity|owner).*address", r"signed.*(now|\d{4})", r"(?i)colou?r\b.*\d", "a.*?b"]


def test_builtin_patterns_are_accepted_as_before():
    for must, must_not, n in PREDICATES.values():
        for pattern, counted in ((must, n > 1), (must_not, False)):
            if pattern:
                assert linear(pattern, counted) == LINEAR.get(pattern, pattern)


def test_what_is_kept_changed_and_refused():
    assert [linear(p) for p in KEPT] == KEPT
    assert all(linear(p) != p for p in CHANGED)
    assert [p for p in REFUSED if is_safe(p)] == []
    # Counting matches is not the same as finding one.
    assert not any(is_safe(p, counted=True) for p in CHANGED) and is_safe(r"\d{3}", counted=True)
    with pytest.raises(Refused):
        linear("(a+)+$")


def test_changed_patterns_are_equal(spark):
    rng = random.Random(3)
    words = ["valid from", "Valid Until", "total due", "INR", "entity", "owner", "address", "signed", "now", "2024", "color", "colour", "\n", " ", "a", "b", "\r\n"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in CHANGED:
        got = rows.select(rows.t.rlike(pattern).alias("plain"), rows.t.rlike(linear(pattern)).alias("changed")).collect()
        assert [r.plain for r in got] == [r.changed for r in got], pattern
        assert {r.plain for r in got} == {True, False}


def test_hostile_catalogue_and_text_end_in_seconds(spark):
    def rule(name, must):
        return Row(category="general", id=name, description="d", severity="LOW", regulation="r", must=must, must_not=None, min_count=1)

    rows = [rule("P-1", "(?is)valid from .*valid until"), rule("P-2", "(a+)+$"), rule("P-3", r"(?i)total due[^\n]*usd")]
    hostile = "valid from " * 200_000 + "total due " * 200_000 + "a" * 1_000_000
    docs = spark.createDataFrame([(1, "a.txt", 9, "text/plain", hostile)], "doc_id int, filename string, size_bytes int, declared_mime string, text string")
    start = time.monotonic()
    got = audit_uploads(docs, rows).first()
    assert time.monotonic() - start < 60
    assert got.not_evaluated == ["P-2"] and [v.split(":")[0] for v in got.violations] == ["P-1", "P-3"]
