"""Rule evaluation, verdicts and the merge of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions.masking import bind_sql
from attestor.functions.patterns import is_safe, linear
from attestor.functions.rule_index import RuleIndex
from attestor.functions.text import executive_summary, missing, severity_rank, sql_literal, text_preview
from attestor.operators.rulebook import applicable_rules

# Literal predicates are planned in arrays of this many rules, so that no expression gets huge.
RULES_PER_ARRAY = 200
# A rule of an indexed catalogue as data.
INDEXED = (
    "array<struct<must:string,must_not:string,n:int,slot:int,needs:array<bigint>,needs_not:array<bigint>>>"
)
# From so many rules on, one scan for their literals costs less than running every pattern.
INDEX_FROM = 64

EVALUATION = (
    "array<struct<category:string,rule_id:string,description:string,"
    "severity:string,regulation:string,passed:boolean>>"
)


def catalogue_rows(rules: DataFrame) -> list[Row]:
    """The rules (with predicates) as literals for planning. A catalogue is configuration."""
    return rules.orderBy("category_no", "seq").collect()


def _stated(rule: Row) -> bool:
    """Whether the rule states a predicate that is run.

    A pattern that could take more than linear time on some text is not: the rule counts as one
    that states no predicate.
    """
    counted = rule.must is not None and rule.min_count > 1
    given = rule.must is not None or rule.must_not is not None
    return given and is_safe(rule.must, counted) and is_safe(rule.must_not)


def _outcome_sql(rule: Row, text: str) -> str:
    """Whether one rule passes; the predicate is literal."""
    tests = []
    if _stated(rule) and rule.must is not None:
        must = sql_literal(linear(rule.must, rule.min_count > 1))
        tests.append(
            f"{text} RLIKE {must}" if rule.min_count <= 1
            else f"regexp_count({text}, {must}) >= {rule.min_count}"
        )
    if _stated(rule) and rule.must_not is not None:
        tests.append(f"NOT {text} RLIKE {sql_literal(linear(rule.must_not))}")
    return " AND ".join(tests) or "cast(NULL AS boolean)"


def _described(rule: Row) -> str:
    fields = {"category": rule.category, "rule_id": rule.id, "description": rule.description,
              "severity": rule.severity, "regulation": rule.regulation}
    return ", ".join(f"'{name}', {sql_literal(value)}" for name, value in fields.items())


def _rule_sql(rule: Row, passed: str) -> str:
    """One rule with its outcome as a SQL struct."""
    return f"named_struct({_described(rule)}, 'passed', {passed})"


def _chunked(items: list[str], kind: str = EVALUATION) -> str:
    parts = [items[i : i + RULES_PER_ARRAY] for i in range(0, len(items), RULES_PER_ARRAY)]
    return f"concat({', '.join(f'cast(array({chr(44).join(p)}) AS {kind})' for p in parts)})"


def _indexed(rules: list[Row], text: str, index: RuleIndex) -> tuple[str, str, str, list[int]]:
    """An indexed catalogue's rules as one constant, the test of one of them (``r``), the outcomes of
    the rules that keep literal patterns, compiled once per task (``always``), and those rules' places.

    A rule whose patterns all have necessary literals is data: its patterns are run only on a text in
    which one of them was seen. The others (``slot``) are looked up in ``always``.
    """
    always: list[str] = []
    constants = []
    slots = []
    for i, rule in enumerate(rules):
        patterns = [p for p in (rule.must, rule.must_not) if p is not None]
        if _stated(rule) and all(p in index.literals_of for p in patterns):
            must, must_not, slot = linear(rule.must, rule.min_count > 1), linear(rule.must_not), "NULL"
        else:
            must, must_not, slot = None, None, str(len(always))
            always.append(_outcome_sql(rule, text))
            slots.append(i)
        constants.append(
            f"named_struct('must', {sql_literal(must)}, 'must_not', {sql_literal(must_not)}, 'n', {rule.min_count}, 'slot', {slot},"
            f" 'needs', {index.keys_sql(rule.must)}, 'needs_not', {index.keys_sql(rule.must_not)})"
        )
    passed = (
        "CASE WHEN r.slot IS NOT NULL THEN always[r.slot] ELSE"
        f" (r.must IS NULL OR (arrays_overlap(r.needs, seen) AND IF(r.n > 1, regexp_count({text}, r.must) >= r.n, {text} RLIKE r.must)))"
        f" AND (r.must_not IS NULL OR NOT (arrays_overlap(r.needs_not, seen) AND {text} RLIKE r.must_not)) END"
    )
    literal = _chunked(always, "array<boolean>") if always else "cast(array() AS array<boolean>)"
    return _chunked(constants, INDEXED), passed, literal, slots


def _all_with_outcomes(rules: list[Row], text: str, index: RuleIndex) -> str:
    """Every rule with its outcome."""
    constants, passed, always, _ = _indexed(rules, text, index)
    outcomes = index.bind(text, "seen", bind_sql(always, "always", f"transform({constants}, r -> {passed})"))
    return f"zip_with({_described_all(rules)}, {outcomes}, (r, p) -> named_struct({_copied('r')}, 'passed', p))"


def _open_with_outcomes(rules: list[Row], text: str, index: RuleIndex) -> str:
    """The rules that do not pass, found without a visit to the others.

    A rule that only bars something passes unless one of its literals was seen, so those rules are
    looked up by what was seen. Rules that ask for something, and those without literals, are tested
    on every text.
    """
    constants, passed, always, slots = _indexed(rules, text, index)
    tested = sorted({*slots, *(i for i, rule in enumerate(rules) if rule.must is not None)})
    barred = index.places_sql({i: rule.must_not for i, rule in enumerate(rules) if i not in set(tested)}, "seen")
    always_tested = _chunked([str(i) for i in tested], "array<int>") if tested else "cast(array() AS array<int>)"
    # Nothing is known about a null text, so no rule passes.
    places = f"IF(seen IS NULL, sequence(0, {len(rules) - 1}), array_sort(array_distinct(concat({always_tested}, {barred}))))"
    outcomes = f"transform({places}, i -> named_struct('i', i, 'p', {bind_sql(f'{constants}[i]', 'r', passed)}))"
    left = f"filter({bind_sql(always, 'always', outcomes)}, o -> o.p IS NULL OR NOT o.p)"
    found = bind_sql(f"{_described_all(rules)}[o.i]", "r", f"named_struct({_copied('r')}, 'passed', o.p)")
    return f"transform({left}, o -> {found})"


def _described_all(rules: list[Row]) -> str:
    return _chunked([_rule_sql(rule, "cast(NULL AS boolean)") for rule in rules])


def _copied(rule: str) -> str:
    return ", ".join(f"'{f}', {rule}.{f}" for f in ("category", "rule_id", "description", "severity", "regulation"))


def _blocks(catalogue: list[Row]) -> dict[str, list[Row]]:
    blocks: dict[str, list[Row]] = {}
    for rule in catalogue:
        blocks.setdefault(rule.category, []).append(rule)
    return blocks


def _by_type(doc_type: str, of: dict[str, str], none: str) -> tuple[str, str]:
    """What holds for every type, and what for the document's own."""
    cases = " ".join(f"WHEN {sql_literal(c)} THEN {a}" for c, a in of.items())
    return of.get("general", none), f"CASE lower({doc_type}) {cases} ELSE {none} END" if cases else none


def applicable_count(doc_type: str, catalogue: list[Row]) -> Column:
    """The number of rules that apply to a document."""
    numbers = {c: str(len(rules)) for c, rules in _blocks(catalogue).items()}
    return F.expr(" + ".join(_by_type(doc_type, numbers, "0")))


def evaluations(
    text: str, doc_type: str, catalogue: list[Row], index_from: int = INDEX_FROM, open_only: bool = False
) -> Column:
    """Array of every applicable rule with its outcome, general rules first.

    Patterns are literals, compiled once per task, and only the rules of the document's own
    type are tested. One row stays one row: no product with the rules and no shuffle. A catalogue of
    at least ``index_from`` rules is indexed: one scan of the text tells which patterns can match.
    ``open_only`` leaves out the rules that pass; of thousands of rules that bar something only those
    are visited whose literals were seen.
    """
    blocks = _blocks(catalogue)
    none = f"cast(array() AS {EVALUATION})"
    if len(catalogue) < index_from:
        arrays = {c: _chunked([_rule_sql(rule, _outcome_sql(rule, text)) for rule in rules]) for c, rules in blocks.items()}
        every = F.expr(f"concat({', '.join(_by_type(doc_type, arrays, none))})")
        return F.filter(every, lambda r: r["passed"].isNull() | ~r["passed"]) if open_only else every
    index = RuleIndex(p for rule in catalogue for p in (rule.must, rule.must_not) if p is not None)
    if open_only:
        arrays = {c: _open_with_outcomes(rules, text, index) for c, rules in blocks.items()}
        return F.expr(index.bind(text, "seen", f"concat({', '.join(_by_type(doc_type, arrays, none))})"))
    # What is bound is copied, so only the outcomes are.
    arrays = {c: _all_with_outcomes(rules, text, index) for c, rules in blocks.items()}
    return F.expr(f"concat({', '.join(_by_type(doc_type, arrays, none))})")


def evaluate_rules(docs: DataFrame, rules: DataFrame, text: str = "scrubbed_text") -> DataFrame:
    """doc_id, rule_no, category, rule_id, …, passed: one row per document and applicable rule."""
    results = evaluations(text, "doc_type", catalogue_rows(rules))
    return docs.select(
        "doc_id", "doc_type", F.posexplode(results).alias("rule_no", "e")
    ).select("doc_id", "doc_type", "rule_no", "e.*")


def evaluate_rules_by_join(docs: DataFrame, rules: DataFrame, text: str = "scrubbed_text") -> DataFrame:
    """The same outcomes with the patterns as data, a copy of the text for each rule: a test aid."""
    subject = F.col(text)
    must = F.col("must").isNull() | (F.regexp_count(subject, "must") >= F.col("min_count"))
    must_not = F.col("must_not").isNull() | ~F.rlike(subject, F.col("must_not"))
    stated = F.col("must").isNotNull() | F.col("must_not").isNotNull()
    return applicable_rules(docs.select("doc_id", "doc_type", text), rules).select(
        "doc_id", "doc_type", "lookup_no", "seq", "category", "rule_id", "description",
        "severity", "regulation", F.when(stated, must & must_not).alias("passed"),
    )


def _verdict(total: Column, passed: Column, unknown: Column, rank: Column) -> dict[str, Column]:
    """``total`` rules were evaluated, ``unknown`` ones have no predicate and decide nothing: a
    document that breaks no rule but has such rules needs a review. Where nothing was evaluated but
    something should have been, there is no score."""
    severities = F.array(*[F.lit(s) for s in V.SEVERITIES])
    score = F.when(total > 0, F.floor(100 * passed / total)).when(unknown == 0, F.lit(100))
    return {
        "status": F.when(passed < total, F.lit(V.NON_COMPLIANT))
        .when(unknown > 0, F.lit(V.REVIEW_NEEDED)).otherwise(F.lit(V.COMPLIANT)),
        "severity": severities[F.coalesce(rank, F.lit(1)) - 1],
        "compliance_score": score.cast("int"),
    }


def violation_line(rule_id: Column, description: Column) -> Column:
    return F.concat(rule_id, F.lit(": "), description)


def recommendation_line(rule_id: Column, regulation: Column) -> Column:
    return F.concat(F.lit("Correct the document to meet "), rule_id, F.lit(" ("), regulation, F.lit(")."))


def audit_verdict(docs: DataFrame, results: str = "evaluations", applicable: Column | None = None) -> DataFrame:
    """Replace the evaluation array by status, severity, score, violations, recommendations and
    the ids of rules that could not be evaluated.

    ``applicable``: how many rules there are, where the array leaves out those that pass.
    """
    all_rules = F.col(results)
    failed = F.filter(all_rules, lambda r: ~r["passed"])
    unknown = F.filter(all_rules, lambda r: r["passed"].isNull())
    count = F.size(all_rules) if applicable is None else applicable
    total, broken = count - F.size(unknown), F.size(failed)
    worst = F.array_max(F.transform(failed, lambda r: severity_rank(r["severity"])))
    return docs.withColumns({
        **_verdict(total, total - broken, F.size(unknown), worst),
        "violations": F.transform(failed, lambda r: violation_line(r["rule_id"], r["description"])),
        "recommendations": F.transform(
            failed, lambda r: recommendation_line(r["rule_id"], r["regulation"])
        ),
        "not_evaluated": F.transform(unknown, lambda r: r["rule_id"]),
    }).drop(results)


def audit_verdict_by_group(evals: DataFrame) -> DataFrame:
    """The verdict from joined outcomes: one aggregation by document, the text left behind.

    The lists hold at most the applicable rules of one document.
    """
    broken = ~F.col("passed")
    order = F.struct("lookup_no", "seq")
    def listed(line: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(broken, F.struct(order.alias("o"), line.alias("t")))))
        return F.transform(rows, lambda r: r["t"])

    grouped = evals.groupBy("doc_id", "doc_type").agg(
        F.count("passed").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(F.col("passed").isNull()).alias("unknown"),
        F.max(F.when(broken, severity_rank("severity"))).alias("worst"),
        listed(violation_line(F.col("rule_id"), F.col("description"))).alias("violations"),
        listed(recommendation_line(F.col("rule_id"), F.col("regulation"))).alias("recommendations"),
    )
    return grouped.withColumns(
        _verdict(F.col("total"), F.col("passed"), F.col("unknown"), F.col("worst"))
    ).drop("total", "passed", "unknown", "worst")


def package_result(
    docs: DataFrame, rule_source: str = V.RULE_SOURCE, stages: str = V.STAGES
) -> DataFrame:
    """Add full_report: the complete audit record of one document as a struct.

    Verdicts that come without ``not_evaluated``, as those of a model, have evaluated every rule.
    """
    unknown = F.col("not_evaluated") if "not_evaluated" in docs.columns else F.array().cast("array<string>")
    report = F.struct(
        "filename", "doc_type", "status", "severity", "compliance_score",
        F.col("pii_detected").alias("pii_was_detected"),
        F.struct(
            "violations", "recommendations", F.lit(rule_source).alias("rule_source"), unknown.alias("not_evaluated")
        ).alias("audit_result"),
        "executive_summary",
        text_preview("scrubbed_text").alias("scrubbed_text_preview"),
        F.lit(stages).alias("pipeline"),
    )
    return docs.withColumn("full_report", report)


def with_summary(docs: DataFrame) -> DataFrame:
    """Add executive_summary."""
    names = ("doc_type", "status", "severity", "compliance_score", "violations", "recommendations", "not_evaluated")
    return docs.withColumn("executive_summary", executive_summary(*[F.col(n) for n in names]))


def latest_agent_output(events: DataFrame) -> DataFrame:
    """Per document the last non-empty text of triage and audit, and the last final text.

    ``max`` over (seq, text) combines on the map side, so a document with very many events
    is reduced before it is shuffled.
    """
    last = F.struct("seq", "text")
    spoken = F.length("text") > 0

    def of(author: str) -> Column:
        return F.coalesce(F.max(F.when(spoken & (F.col("author") == author), last))["text"], F.lit(""))

    return events.groupBy("doc_id").agg(
        of(V.TRIAGE_AUTHOR).alias("triage_raw"),
        of(V.AUDITOR_AUTHOR).alias("audit_raw"),
        F.max(F.when(F.col("is_final"), last))["text"].alias("final_text"),
    )


def merge_verdicts(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Parsed answers completed by the fallback answers, then by defaults.

    The fallback counts only where type, status or severity is missing; then an empty text,
    list or a zero score also gives way to it. Other columns of the answers are handed on as they are.
    """
    texts = ("doc_type", "status", "severity")
    lists = ("violations", "recommendations")
    p = {c: F.col(f"p.{c}") for c in (*texts, *lists, "compliance_score")}
    f = {c: F.col(f"f.{c}") for c in p}
    # A repeated fallback must not repeat its document: one answer each, the largest.
    columns = [c for c in fallback.columns if c != "doc_id"]
    fallback = fallback.groupBy("doc_id").agg(F.max(F.struct(*columns)).alias("f")).select("doc_id", "f.*")
    incomplete = missing(p["doc_type"]) | missing(p["status"]) | missing(p["severity"])
    joined = primary.alias("p").join(
        fallback.alias("f"), (F.col("p.doc_id") == F.col("f.doc_id")) & incomplete, "left"
    )
    used = F.col("f.doc_id").isNotNull()
    defaults = {"doc_type": V.UNKNOWN, "status": V.REVIEW_NEEDED, "severity": "MEDIUM"}

    def text_of(c: str) -> Column:
        picked = F.when(used & missing(p[c]), f[c]).otherwise(p[c])
        return F.when(missing(picked), F.lit(defaults[c])).otherwise(picked)

    def list_of(c: str) -> Column:
        empty = p[c].isNull() | (F.size(p[c]) == 0)
        return F.coalesce(F.when(used & empty, f[c]).otherwise(p[c]), F.array().cast("array<string>"))

    score = p["compliance_score"]
    zero = score.isNull() | (score == 0)
    return joined.select(
        F.col("p.doc_id").alias("doc_id"),
        *[text_of(c).alias(c) for c in texts],
        F.coalesce(F.when(used & zero, f["compliance_score"]).otherwise(score), F.lit(0)).alias("compliance_score"),
        *[list_of(c).alias(c) for c in lists],
        used.alias("used_fallback"),
        *[F.col(f"p.{c}") for c in primary.columns if c != "doc_id" and c not in p],
    )
