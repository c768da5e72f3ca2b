"""The model audit does each step once: events gathered, answers parsed, derived texts tested."""

from pyspark.sql import functions as F

from attestor.functions import json_fields
from attestor.functions.text import strip
from attestor.operators import gate
from attestor.plans.model_audit import audit_answers

EVENTS = "doc_id int, seq int, author string, text string, is_final boolean"
FALLBACK = "doc_id int, doc_type string, status string, severity string, compliance_score int, violations array<string>, recommendations array<string>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_gathered_once_and_the_final_text_is_kept(spark, tmp_path):
    audit = '{"status":"NON_COMPLIANT","severity":"HIGH","compliance_score":"40","violations":["INV-01: x"]}'
    spark.createDataFrame([
        (1, 1, "TriageAgent", 'So: {"doc_type":"invoice"}.', False), (1, 2, "AuditorAgent", f"```json\n{audit}\n```", False),
        (1, 3, "ReporterAgent", "## Report", True),
        (2, 1, "AuditorAgent", audit + audit, False),
    ], EVENTS).write.parquet(f"{tmp_path}/events")
    masked = spark.createDataFrame([(1, "a.txt", "text", False), (2, "b.txt", "text", True), (3, "c.txt", "text", False)],
                                   "doc_id int, filename string, scrubbed_text string, pii_detected boolean")
    fallback = spark.createDataFrame([(2, "report", "COMPLIANT", "", 90, [], ["r"])] * 2, FALLBACK)
    results = audit_answers(masked, spark.read.parquet(f"{tmp_path}/events"), fallback)
    assert plan_of(results).count(" parquet") == 1
    rows = {r.doc_id: r for r in results.collect()}
    assert sorted(rows) == [1, 2]
    one, two = rows[1], rows[2]
    assert (one.doc_type, one.status, one.compliance_score, one.executive_summary, one.route) == (
        "invoice", "NON_COMPLIANT", 40, "## Report", "pending")
    assert (two.doc_type, two.status, two.severity, two.executive_summary, two.used_fallback) == (
        "report", "COMPLIANT", "MEDIUM", "", True)
    assert "final_text" not in results.columns


def test_an_answer_is_parsed_once(spark):
    df = spark.createDataFrame([('{"a": 1} {"b": 2}',), ("} x {",), ("{ x } }",), ('é {"a":"}"} 😀',)], "text string")
    found = df.select(json_fields.extract_json("text").alias("v"))
    assert plan_of(found).lower().count("parse_json") + plan_of(found).lower().count("parsejson") == 1
    assert [r[0] for r in found.select(F.col("v").cast("string")).collect()] == [None, None, None, '{"a":"}"}']


def test_strip_takes_all_white_space_from_both_ends_only(spark):
    texts = ["  a b \t\r\n　", "\u001c\u0085", "", None, "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strip("t")).collect()
    assert [r[0] for r in got] == [t if t is None else t.strip() for t in texts]


def test_a_derived_text_is_not_tested_below_the_exchange(spark):
    uploads = spark.range(6).repartition(3, "id").selectExpr(
        "concat(id, '.txt') AS filename", "1L AS size_bytes", "'text/plain' AS declared_mime",
        "CASE WHEN id % 2 = 0 THEN concat('n ', id) ELSE ' ' END AS text",
    )
    accepted = gate.accepted_with_text(uploads)
    assert "RLIKE" not in plan_of(accepted).partition("RepartitionByExpression")[2]
    assert accepted.columns == uploads.columns and accepted.count() == 3
