"""Audits by an external model: its answers become packaged, routed and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import json_fields
from attestor.operators.review import needs_review
from attestor.operators.verdict import latest_agent_output, merge_verdicts, package_result


def parsed_answers(events: DataFrame) -> DataFrame:
    """Per document the last answers of triage and audit as fields, and the final text."""
    latest = latest_agent_output(events)
    found = latest.select(
        "doc_id", "final_text",
        json_fields.extract_json("triage_raw").alias("triage"),
        json_fields.extract_json("audit_raw").alias("audit"),
    )
    fields = found.select(
        "doc_id", "final_text", json_fields.triage_fields("triage").alias("t"), json_fields.audit_fields("audit").alias("a")
    )
    return fields.select("doc_id", "final_text", "t.doc_type", "a.*")


def audit_answers(masked: DataFrame, events: DataFrame, fallback: DataFrame) -> DataFrame:
    """Results of the masked documents that the model answered, with ``route``.

    Answers are completed by the fallback and by defaults; the final text is the summary. Severe
    results are routed to ``pending``, the others to ``auto``, as those of the rule audit are.
    """
    # The final text goes with the answers, so that the events are gathered once.
    verdicts = merge_verdicts(parsed_answers(events), fallback)
    summary = F.coalesce("final_text", F.lit("")).alias("executive_summary")
    judged = masked.join(verdicts.select(*[c for c in verdicts.columns if c != "final_text"], summary), "doc_id")
    return package_result(judged).withColumns({
        "session_id": F.md5(F.col("doc_id").cast("string")),
        "route": F.when(needs_review(), F.lit("pending")).otherwise(F.lit("auto")),
    })
