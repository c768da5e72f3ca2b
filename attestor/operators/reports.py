"""Report contents from ledger rows and the violation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions import text as T
from attestor.operators.rulebook import first_by_id
from attestor.session import small_side


def report_defaults(ledger: DataFrame) -> DataFrame:
    """Ledger rows with every report field present: stored values or the report defaults."""

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("report", path, kind)

    def text_or(name: str, default: str) -> Column:
        return F.when(T.missing(name), F.lit(default)).otherwise(F.col(name))

    none = F.array().cast("array<string>")
    unknown = F.coalesce(field("$.audit_result.not_evaluated", "array<string>"), none)
    return ledger.select(
        F.col("id").alias("log_id"),
        F.coalesce("timestamp", T.utc_now()).alias("timestamp"),
        "filename",
        text_or("doc_type", V.UNKNOWN).alias("doc_type"),
        text_or("status", V.NON_COMPLIANT).alias("status"),
        text_or("severity", "LOW").alias("severity"),
        F.coalesce(field("$.compliance_score", "int"), F.when(F.size(unknown) == 0, F.lit(0))).alias("compliance_score"),
        F.coalesce(field("$.pii_was_detected", "boolean"), F.lit(False)).alias("pii_detected"),
        F.coalesce(field("$.audit_result.violations", "array<string>"), none).alias("violations"),
        F.coalesce(field("$.audit_result.recommendations", "array<string>"), none).alias("recommendations"),
        F.coalesce(field("$.executive_summary", "string"), F.lit("")).alias("executive_summary"),
        F.coalesce(field("$.audit_result.rule_source", "string"), F.lit(V.RULE_SOURCE)).alias("rule_source"),
        unknown.alias("not_evaluated"),
    )


def violation_label(violation: Column, index: Column) -> Column:
    """The rule id in the text, or VIOL-n by position."""
    numbered = F.concat(F.lit("VIOL-"), (index + 1).cast("string"))
    return F.coalesce(T.violation_id(violation), numbered)


def number_violations(df: DataFrame) -> DataFrame:
    """doc_id, violation_no, violation_id, description: one row per violation."""
    return df.select("doc_id", F.posexplode("violations").alias("pos", "violation")).select(
        "doc_id",
        (F.col("pos") + 1).alias("violation_no"),
        violation_label(F.col("violation"), F.col("pos")).alias("violation_id"),
        T.violation_text("violation").alias("description"),
    )


def enrich_violations(numbered: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations with severity and regulation of the rule they name, if it is catalogued."""
    known = first_by_id(rules).select(
        F.col("rule_id").alias("violation_id"), "category", "severity", "regulation"
    )
    return numbered.join(small_side(known), "violation_id", "left")


def _lines(section: int, texts: Column) -> Column:
    return F.transform(
        texts,
        lambda t, i: F.struct(
            F.lit(section).alias("section_no"), (i + 1).alias("line_no"), t.alias("text")
        ),
    )


def report_line_array(fields: DataFrame) -> DataFrame:
    """log_id, timestamp and the report as an ordered array of lines, row by row."""
    said = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    listed = (F.size("violations") > 0) & (F.upper("status") != V.COMPLIANT)
    rows = F.transform(
        "violations",
        lambda v, i: F.concat(violation_label(v, i), F.lit(" | "), T.violation_text(v)),
    )
    advice = F.transform("recommendations", lambda r: F.concat(F.lit("-> "), T.clean_markdown(r)))
    title = lambda text: F.array(F.lit(text))
    sections = [
        title("Document Audit Report"),
        F.array(
            F.concat(F.lit("Audit ID: #"), F.col("log_id").cast("string")),
            said("Audit Date", T.report_timestamp("timestamp")),
            said("Document Category", T.capitalize("doc_type")),
            said("PII Status", T.pii_label("pii_detected")),
        ),
        F.array(
            said("VERDICT STATUS", T.verdict_label("status")),
            said("RISK SEVERITY", F.upper("severity")),
            said("COMPLIANCE SCORE", T.score_text("compliance_score")),
        ),
        F.concat(title("Executive Summary"), F.array(T.clean_markdown("executive_summary"))),
        F.concat(
            title("Detected Compliance Violations"),
            F.when(listed, rows).otherwise(title(V.NO_VIOLATIONS_BANNER)),
        ),
        F.when(F.size("recommendations") > 0, F.concat(title("Actionable Recommendations"), advice))
        .otherwise(F.array().cast("array<string>")),
        F.concat(
            title("Regulatory Standards Applied"),
            F.array(F.concat(F.lit("Rules applied are sourced from: "), F.col("rule_source"))),
        ),
        F.when(F.size("not_evaluated") > 0, F.concat(title("Rules Not Evaluated"), F.transform("not_evaluated", lambda r: F.concat(F.lit("-> "), r))))
        .otherwise(F.array().cast("array<string>")),
    ]
    lines = F.concat(*[_lines(n, s) for n, s in enumerate(sections, start=1)])
    return fields.select("log_id", "timestamp", "filename", lines.alias("lines"))


def report_lines(ledger: DataFrame) -> DataFrame:
    """Long table of report lines: log_id, section_no, line_no, text.

    No report is without lines; the outer form only spares a test for emptiness, which the
    optimizer would push down and pay for by composing every report twice.
    """
    lines = report_line_array(report_defaults(ledger))
    return lines.select("log_id", F.inline_outer("lines"))


def report_texts(ledger: DataFrame) -> DataFrame:
    """One rendered text per audit. The lines are still one row's array, so nothing is grouped."""
    lines = report_line_array(report_defaults(ledger))
    return lines.select(
        "log_id", "timestamp", "filename",
        F.array_join(F.transform("lines", lambda r: r["text"]), "\n").alias("report_text"),
    )
