import json
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attestor.functions import json_fields, masking
from attestor.functions import text as T
from attestor.operators import redaction, rulebook, triage, verdict
from attestor.plans.audit import audit_uploads
from attestor.rule_catalogue import CATALOGUE, LINEAR, PREDICATES
from attestor.sources import catalogue


@pytest.fixture(scope="module")
def rules(spark):
    return catalogue.with_predicates(catalogue.load_rules(spark)).cache()


GOOD_INVOICE = (
    "TAX INVOICE\nSeller: Blue Tools Ltd\nInvoice No: 77\nDate: 2026-01-05\nSeller GSTIN: 22AAAAA0000A1Z5\n"
    "Seller PAN: ABCDE1234F\nHSN: 85044090\nTotal Amount Due: INR 900"
)
BAD_CONTRACT = "AGREEMENT between two parties\nSigned by Party A: ______ (blank)\nIt lacks a dispute clause"
EXPORT = "Names of people\nCard 4111-1111-1111-1111\nAadhaar 1234-5678-9012"


def _audited(spark, texts):
    rows = [(i, f"f{i}.txt", 100, "text/plain", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, filename string, size_bytes bigint, declared_mime string, text string")
    return audit_uploads(df, catalogue.builtin_rows()).orderBy("doc_id").collect()


def test_audit_outcomes(spark):
    good, bad, export, blank = _audited(spark, [GOOD_INVOICE, BAD_CONTRACT, EXPORT, " "])
    assert (good.doc_type, good.status, good.severity, good.compliance_score, good.violations, good.route) == (
        "invoice", "COMPLIANT", "LOW", 100, [], "auto",
    )
    assert "[REDACTED_GSTIN]" in good.full_report.scrubbed_text_preview and good.pii_detected
    assert (bad.doc_type, bad.status, bad.severity, bad.route) == ("contract", "NON_COMPLIANT", "CRITICAL", "pending")
    assert [v.split(":")[0] for v in bad.violations] == ["GEN-04", "CON-01", "CON-02", "CON-03", "CON-04"]
    assert bad.compliance_score == 37 and len(bad.recommendations) == 5
    assert export.doc_type == "unknown"
    assert [v.split(":")[0] for v in export.violations] == ["GEN-01", "GEN-02", "GEN-03", "GEN-04"]
    assert blank.route == "rejected" and blank.status is None and blank.reject_code == "no_text"


def test_summary_and_report_agree(spark):
    good, bad = _audited(spark, [GOOD_INVOICE, BAD_CONTRACT])
    assert "**Audit Status:** COMPLIANT ✅" in good.executive_summary and "No violations found" in good.executive_summary
    assert "- CON-01: Must include names" in bad.executive_summary
    assert bad.full_report.audit_result.violations == bad.violations


def test_literal_and_join_forms_agree(spark, rules):
    texts = [GOOD_INVOICE, BAD_CONTRACT, EXPORT, "FSSAI 12345 certificate valid from 2020 valid until 2021"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs = triage.triage(redaction.mask_documents(df)).cache()
    one = verdict.evaluate_rules(docs, rules).select("doc_id", "rule_id", "passed")
    other = verdict.evaluate_rules_by_join(docs, rules).select("doc_id", "rule_id", "passed")
    assert sorted(one.collect()) == sorted(other.collect())
    row_local = verdict.audit_verdict(
        docs.withColumn("e", verdict.evaluations("scrubbed_text", "doc_type", catalogue.builtin_rows())), "e"
    )
    grouped = verdict.audit_verdict_by_group(verdict.evaluate_rules_by_join(docs, rules))
    columns = ("doc_id", "status", "severity", "compliance_score", "violations", "recommendations")
    assert sorted(row_local.select(*columns).collect()) == sorted(grouped.select(*columns).collect())


def test_cues_are_whole_words_and_word_pairs(spark):
    cues = {"one": ("invoices?", "amount due", "x-ray"), "two": ("purchase orders?", "due date now", "iso"), "three": ("amounts?",)}
    said = {
        "Invoice": ("one", 1), "invoices, INVOICE": ("one", 1), "invoicess my_invoice invoice2": (None, 0), "amount due": ("one", 2),
        "amount  due": ("three", 1), "amount\ndue": ("three", 1), "amount, due": ("three", 1), "(amount due)": ("one", 2), "éiso": ("two", 1),
        "isoé iso": ("two", 1), "purchase order": ("two", 1), "purchase orders.": ("two", 1), "purchase ordersx": (None, 0), "due date now": ("two", 1),
        "due date": (None, 0), "an x-ray": ("one", 1), "x-rays": (None, 0), "iso purchase order invoice": ("two", 3), "": (None, 0), None: (None, 0),
    }
    rows = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    got = rows.select("i", triage.triage_of("text", cues).alias("t")).orderBy("i").collect()
    for row, (text, (kind, total)) in zip(got, said.items()):
        assert row.t.doc_type == (kind or "unknown"), text
        assert (f"of {total} cue" in row.t.reasoning) if total else row.t.reasoning == "no cue found", text
    assert triage.spellings("bills?") == ["bill", "bills"] and triage.spellings("a|b") is None
    many = {f"t{i}": tuple(f"word{i}x{j}" for j in range(50)) for i in range(40)}
    one = spark.createDataFrame([("say word7x3 and word7x4 or word9x1",)], "text string").select(triage.triage_of("text", many).alias("t")).first().t
    assert (one.doc_type, one.reasoning) == ("t7", "2 of 3 cue(s) found point to t7")


def test_rules_that_were_not_evaluated_are_named_everywhere(spark):
    general = [{"id": "G-1", "must": "date"}, {"id": "G-2"}]
    rows = [Row(category="general", id=r["id"], description="d", severity="LOW", regulation="r", must=r.get("must"), must_not=None, min_count=1) for r in general]
    texts = spark.createDataFrame([(0, "a.txt", 9, "text/plain", "the date"), (1, "b.txt", 9, "text/plain", "nothing")], "doc_id int, filename string, size_bytes int, declared_mime string, text string")
    good, bad = audit_uploads(texts, rows).orderBy("doc_id").collect()
    assert (good.status, good.compliance_score, good.full_report.audit_result.not_evaluated) == ("REVIEW_NEEDED", 100, ["G-2"])
    assert "**Audit Status:** REVIEW_NEEDED ⚠" in good.executive_summary
    assert "breaks no rule that was evaluated. 1 applicable rule(s) could not be evaluated: G-2." in good.executive_summary
    assert (bad.status, bad.compliance_score) == ("NON_COMPLIANT", 0)
    assert "The document breaks 1 applicable rule(s). 1 applicable rule(s) could not be evaluated: G-2." in bad.executive_summary
    alone = audit_uploads(texts, rows[1:]).first()
    assert (alone.status, alone.compliance_score) == ("REVIEW_NEEDED", None) and "**Compliance Score:** not scored" in alone.executive_summary


def test_audit_has_no_shuffle_and_no_python(spark):
    df = spark.range(10).selectExpr("id AS doc_id", "'a.txt' AS filename", "id AS size_bytes", "'' AS declared_mime", "'x' AS text")
    plan = audit_uploads(df, catalogue.builtin_rows())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_builtin_rows_equal_loaded_rules(rules):
    loaded = [r.asDict() for r in verdict.catalogue_rows(rules)]
    assert [{k: v for k, v in r.items() if k not in ("category_no", "seq")} for r in loaded] == [
        r.asDict() for r in catalogue.builtin_rows()
    ]
    assert len(loaded) == 20 and set(PREDICATES) == {r["id"] for r in loaded}


def test_catalogue_file_keeps_order_and_skips_other_keys(spark, tmp_path):
    path = tmp_path / "rules.json"
    document = {
        "_metadata": {"version": "9.1"},
        "zeta": [{"id": "Z-1", "description": "quote ' and \\ slash", "severity": "LOW", "regulation": "r"}],
        "notes": {"id": "not a list"},
        "alpha": [{"id": "A-1", "description": "d", "severity": "HIGH"}, {"id": "Z-1", "description": "second"}],
    }
    path.write_text(json.dumps(document, indent=2))
    rules = catalogue.load_rules(spark, str(path))
    rows = rules.orderBy("category_no", "seq").collect()
    assert [(r.category, r.seq, r.id) for r in rows] == [("zeta", 0, "Z-1"), ("alpha", 0, "A-1"), ("alpha", 1, "Z-1")]
    assert rows[1].regulation is None
    meta = catalogue.rules_metadata(spark, str(path)).first()
    assert (meta.version, meta.jurisdiction) == ("9.1", "India / General")
    found = rulebook.rule_by_id(rules, spark.createDataFrame([("Z-1",), ("nope",)], "rule_id string")).collect()
    by_id = {r.rule_id: r for r in found}
    assert by_id["Z-1"].category == "zeta" and by_id["Z-1"].found and by_id["Z-1"].error is None
    assert not by_id["nope"].found and by_id["nope"].error == "Rule not found"
    # A rule without a predicate is not evaluated, whatever its texts hold.
    checked = verdict.evaluations("text", "doc_type", verdict.catalogue_rows(catalogue.with_predicates(rules)))
    df = spark.createDataFrame([("x", "ZETA")], "text string, doc_type string")
    assert [e.passed for e in df.select(checked.alias("e")).first().e] == [None]
    judged = verdict.audit_verdict(df.select(checked.alias("e")), "e").first()
    assert (judged.status, judged.compliance_score, judged.not_evaluated, judged.violations) == ("REVIEW_NEEDED", None, ["Z-1"], [])


def test_large_catalogue_in_both_forms(spark):
    rows = [
        (0, "general", i, f"R-{i}", "text", "LOW", "rule", f"(?i)word{i % 7}\\b" if i % 3 else None, r"bad" if i % 5 == 0 else None, 1 + i % 2)
        for i in range(2000)
    ]
    schema = "category_no int, category string, seq int, id string, description string, severity string, regulation string, must string, must_not string, min_count int"
    large = spark.createDataFrame(rows, schema)
    docs = spark.createDataFrame([(1, "memo", "word1 word2 word2 bad"), (2, "memo", "Word3 WORD4 word5")], "doc_id int, doc_type string, scrubbed_text string")
    one = verdict.evaluate_rules(docs, large).select("doc_id", "rule_id", "passed").collect()
    other = verdict.evaluate_rules_by_join(docs, large).select("doc_id", "rule_id", "passed").collect()
    key = lambda r: (r.doc_id, r.rule_id)
    assert sorted(one, key=key) == sorted(other, key=key) and len(one) == 4000


def test_linear_predicates_say_the_same(spark):
    texts = [
        "Valid from 2020\nvalid until 2021", "valid until x valid from", "valid from", "the entity\n\nAddress: 1", "address entity", "certifies that address",
        "Total amount due: INR 5", "total amount due\nINR", "x total amount due y total amount due €", "fssai number is missing", "fssai\nnumber is missing", "FSSAI fssai 1 NUMBER IS MISSING",
        "Signed by A: ____", "signed by A\n____", "(blank) signed by", "signed by signed by (Blank)",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for plain, linear in LINEAR.items():
        rows = df.select(F.col("text").rlike(plain).alias("a"), F.col("text").rlike(linear).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {True, False}, plain


def test_patterns_stay_linear_on_hostile_texts(spark):
    hostile = ["valid from ", "entity ", "certifies that ", "total amount due ", "FSSAI ", "fssai1 ", "a" * 10, "1 ", "1234 ", "signed ", "invoice ", "HSN ", "_", " ", "scope of "]
    df = spark.createDataFrame([(i,) for i in range(len(hostile))], "i int")
    text = F.expr(f"repeat(element_at(array({', '.join(repr(h) for h in hostile)}), i + 1), cast(5000000 / length(element_at(array({', '.join(repr(h) for h in hostile)}), i + 1)) AS int))")
    docs = df.select(F.lit("certificate").alias("doc_type"), F.explode(F.array(F.lit("certificate"), F.lit("invoice"))).alias("kind"), text.alias("text"))
    checked = docs.select(verdict.evaluations("text", "kind", catalogue.builtin_rows()).alias("e"), masking.mask_all("text").alias("m"), T.strip(F.concat(F.col("text"), F.lit("x"))).alias("s"))
    start = time.perf_counter()
    assert checked.where(F.size("e") > 0).agg(F.sum(F.length("m") + F.length("s"))).first()[0] > 0
    assert time.perf_counter() - start < 120


def test_missing_catalogue_is_empty(spark, tmp_path):
    rules = catalogue.load_rules(spark, str(tmp_path / "absent.json"))
    assert rules.count() == 0
    meta = catalogue.rules_metadata(spark, str(tmp_path / "absent.json")).first()
    assert (meta.version, meta.jurisdiction) == ("1.0.0", "India / General")
    df = spark.createDataFrame([("x", "invoice")], "text string, doc_type string")
    assert df.select(verdict.evaluations("text", "doc_type", []).alias("e")).first().e == []


def test_export_round_trip(spark, tmp_path):
    rules = catalogue.load_rules(spark)
    catalogue.export_rules(rules, str(tmp_path / "out"))
    again = catalogue.load_rules(spark, str(tmp_path / "out"))
    columns = ("category", "seq", "id", "description", "severity", "regulation")
    assert sorted(rules.select(*columns).collect()) == sorted(again.select(*columns).collect())


def test_general_type_gets_general_rules_twice(spark):
    rules = catalogue.load_rules(spark)
    docs = spark.createDataFrame([("GENERAL",), ("Invoice",), ("other",), (None,)], "doc_type string")
    counts = {r.doc_type: r.rule_count for r in rulebook.rule_counts(docs, rules).collect()}
    assert counts == {"GENERAL": 8, "Invoice": 9, "other": 4, None: 4}
    listed = rulebook.applicable_rules(docs, rules).groupBy("doc_type").count().collect()
    assert {r.doc_type: r["count"] for r in listed} == counts


def test_rule_texts_and_summary(spark):
    rules = catalogue.load_rules(spark)
    types = spark.createDataFrame([("report",), ("report",)], "doc_type string")
    text = rulebook.rules_json(rules, types).first().rules_text
    assert json.loads(text) == CATALOGUE["general"] + CATALOGUE["report"]
    blocks = {r.category: r.block for r in rulebook.rules_summary(rules).collect()}
    assert blocks["report"].startswith("📁 REPORT: 3 rule(s)\n   • [REP-01] Must include")
    types = rulebook.supported_types(rules).collect()
    assert [t.category for t in types] == ["general", "invoice", "certificate", "contract", "report"]
    assert types[0].type_count == 5


ANSWERS = [
    ('{"a": 1}', '{"a":1}'),
    ('  ```json\n{"a": 1}\n```  ', '{"a":1}'),
    ('```{"a": 1}```', '{"a":1}'),
    ('Sure: {"a": {"b": 2}} done', '{"a":{"b":2}}'),
    ('{"a": 1} {"b": 2}', None),
    ('{"a": 1}, {"b": 2}', None),
    ('{"a": 1', None),
    ("no json", None),
    ("", None),
    (None, None),
    ("} {", None),
    ('{"a": "x}"} tail', '{"a":"x}"}'),
]


def test_json_is_found_like_a_strict_parser_would(value_of):
    got = value_of(lambda c: json_fields.extract_json(c).cast("string"), [a[0] for a in ANSWERS])
    assert got == [a[1] for a in ANSWERS]


def test_fields_cast_leniently(spark):
    df = spark.createDataFrame([('{"compliance_score":"90","violations":["a","b"],"status":null}',)], "text string")
    fields = df.select(json_fields.audit_fields(json_fields.extract_json("text")).alias("f")).first().f
    assert (fields.compliance_score, fields.violations, fields.status, fields.recommendations) == (90, ["a", "b"], None, None)


VERDICT = "doc_id int, doc_type string, status string, severity string, compliance_score int, violations array<string>, recommendations array<string>"


def test_fallback_only_where_incomplete(spark):
    primary = spark.createDataFrame([
        (1, "invoice", "COMPLIANT", "LOW", 0, None, None),
        (2, "", "COMPLIANT", None, 0, [], ["keep"]),
        (3, None, None, None, None, None, None),
        (4, "invoice", "", "HIGH", 50, ["x"], None),
    ], VERDICT)
    fallback = spark.createDataFrame([
        (1, "report", "NON_COMPLIANT", "HIGH", 9, ["f"], ["f"]),
        (2, "report", "NON_COMPLIANT", "HIGH", 9, ["f"], ["f"]),
        (4, None, None, None, 7, ["f"], None),
    ], VERDICT)
    rows = {r.doc_id: r for r in verdict.merge_verdicts(primary, fallback).collect()}
    assert tuple(rows[1])[1:7] == ("invoice", "COMPLIANT", "LOW", 0, [], [])
    assert tuple(rows[2])[1:7] == ("report", "COMPLIANT", "HIGH", 9, ["f"], ["keep"])
    assert tuple(rows[3])[1:7] == ("unknown", "REVIEW_NEEDED", "MEDIUM", 0, [], [])
    assert tuple(rows[4])[1:7] == ("invoice", "REVIEW_NEEDED", "HIGH", 50, ["x"], [])


def test_last_non_empty_answer_wins(spark):
    events = spark.createDataFrame([
        (1, 1, "TriageAgent", "first", False), (1, 2, "TriageAgent", "second", False), (1, 3, "TriageAgent", "", False),
        (1, 4, "ReporterAgent", "summary", True), (1, 5, "ReporterAgent", None, True), (2, 1, "Other", "x", False),
    ], "doc_id int, seq int, author string, text string, is_final boolean")
    rows = {r.doc_id: tuple(r)[1:] for r in verdict.latest_agent_output(events).collect()}
    assert rows == {1: ("second", "", None), 2: ("", "", None)}


def test_preview_and_context(spark):
    df = spark.createDataFrame([("x" * 500,), ("y" * 501,), ("z" * 4000,)], "text string")
    rows = df.select(T.text_preview("text").alias("p"), T.context_cut("text").alias("c")).collect()
    assert rows[0].p == "x" * 500 and rows[1].p == "y" * 500 + "..." and len(rows[2].c) == 3000
