import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from attestor.functions.rule_index import necessary_literals
from attestor.operators import verdict
from attestor.sources import catalogue

TELLING = {
    r"(?i)\bdate\b": ["date"],
    r"\[REDACTED_(GSTIN|PAN)\]": ["[redacted_gs", "[redacted_pa"],
    r"(?i)invoice\s*(no|number)\W*\w+": ["invoice"],
    "(?:ab|cd)ef": ["abef", "cdef"],
    "(?:total){2,}x": ["total"],
    "a.?bcd": ["bcd"],
}
WITHOUT = [r"\d{3}", "ab", r"date|\d{4}", "(?:total)*", "(?iu)kelvin", "(", "été", "(?!total)x"]


def test_literals_that_a_match_cannot_do_without():
    assert {p: necessary_literals(p) for p in TELLING} == TELLING
    assert [p for p in WITHOUT if necessary_literals(p)] == []


def _rule(i, must=None, must_not=None, n=1, category="general"):
    return Row(category=category, id=f"R-{i}", description=f"it's {i}", severity="HIGH", regulation="r", must=must, must_not=must_not, min_count=n)


RULES = [
    _rule(0, must=r"(?i)\bfirm 1\b"), _rule(1, must_not="firm 17"), _rule(2, must="firm 1", n=2), _rule(3, must=r"\d{3}"),
    _rule(4), _rule(5, must="(a+)+$"), _rule(6, must="(?i)TOTAL", must_not=r"tot\w"), _rule(7, must_not=r"\[a|b.c\]"),
    _rule(8, must="(?i)signed", category="memo"), _rule(9, must_not=r"\d", category="memo"), _rule(10, must="(?i)kilo", category="memo"),
]


def _texts():
    rng = random.Random(5)
    words = ["firm 1", "Firm 17", "firm 171", "total", "TOTAL", "tot", " ", "[a", "b.c]", "123", "signed", "Signed", "\n", "KILO", "Kilo", "İ", "ſigned", "😀"]
    return [None, "", *["".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(500)], "firm 1 " * 20_000]


def test_outcomes_are_those_of_running_every_pattern(spark):
    rows = spark.createDataFrame([(i, t, ["memo", "other", None][i % 3]) for i, t in enumerate(_texts())], "doc_id int, t string, k string")
    never = 10**9
    for rules in (RULES, catalogue.builtin_rows(), RULES[:1] * 300, RULES[3:5], []):
        plain = verdict.evaluations("t", "k", rules, never)
        got = rows.select(
            plain.alias("plain"), verdict.evaluations("t", "k", rules, 0).alias("indexed"),
            F.filter(plain, lambda r: r["passed"].isNull() | ~r["passed"]).alias("left"),
            verdict.evaluations("t", "k", rules, 0, open_only=True).alias("open"),
            verdict.evaluations("t", "k", rules, never, open_only=True).alias("open_plain"),
            verdict.applicable_count("k", rules).alias("n"),
        ).collect()
        for r in got:
            assert r.indexed == r.plain and r.open == r.left == r.open_plain and r.n == len(r.plain)
        assert not rules or any(r.open for r in got)


def test_verdict_without_the_rules_that_pass(spark):
    docs = spark.createDataFrame([(i, t, "memo") for i, t in enumerate(_texts())], "doc_id int, t string, doc_type string")
    whole = verdict.audit_verdict(docs.withColumn("evaluations", verdict.evaluations("t", "doc_type", RULES)))
    found = docs.withColumn("evaluations", verdict.evaluations("t", "doc_type", RULES, 0, open_only=True))
    assert verdict.audit_verdict(found, applicable=verdict.applicable_count("doc_type", RULES)).collect() == whole.collect()


def test_rules_that_only_bar_something_are_visited_when_seen(spark):
    """A lookup by what was seen, not a walk over the catalogue: the work follows what is found."""
    rules = [_rule(i, must_not=rf"(?i)\bfirm {i}\b") for i in range(400)]
    rules += [_rule(400 + i, must_not=f"firm {i}x", category="memo") for i in range(5)]
    open_only = verdict.evaluations("t", "k", rules, 0, open_only=True)
    texts = ["Firm 7 and FIRM 39, firm 399", "nothing", None, "firm 3x", "firm 400"]
    rows = spark.createDataFrame([(i, t, "memo") for i, t in enumerate(texts)], "doc_id int, t string, k string")
    got = {r.doc_id: [e.rule_id for e in r.e] for r in rows.select("doc_id", open_only.alias("e")).collect()}
    assert got == {0: ["R-7", "R-39", "R-399"], 1: [], 2: [r.id for r in rules], 3: ["R-403"], 4: []}
    # No step of the plan goes over all the rules of a block.
    assert "transform(concat(" not in verdict._open_with_outcomes(rules[:400], "t", verdict.RuleIndex(r.must_not for r in rules[:400]))
