"""The whole audit as one row-local plan, and its single-pass store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from attestor.functions.files import file_ext
from attestor.functions.masking import mask_report
from attestor.operators.gate import gate_reason, guard_text
from attestor.operators.review import needs_review
from attestor.operators.triage import triage
from attestor.operators.verdict import INDEX_FROM, applicable_count, audit_verdict, evaluations, package_result, with_summary
from attestor.session import scratch_path

VERDICT_COLUMNS = (
    "doc_type", "confidence", "status", "severity", "compliance_score", "violations",
    "recommendations", "not_evaluated", "pii_detected", "executive_summary", "full_report", "session_id",
)


def gated(uploads: DataFrame) -> DataFrame:
    """Uploads with the first reason to reject them, if any, and whether they wait for OCR.

    An accepted image or PDF without text is OCR work, not a reject.
    """
    guarded = guard_text(gate_reason(uploads))
    waits = (F.col("reject_code") == "no_text") & (file_ext("filename") != ".txt")
    return guarded.withColumn("needs_ocr", F.coalesce(waits, F.lit(False))).withColumns({
        "reject_code": F.when(~F.col("needs_ocr"), F.col("reject_code")),
        "reject_detail": F.when(~F.col("needs_ocr"), F.col("reject_detail")),
    })


def audit_masked(masked: DataFrame, catalogue: list[Row]) -> DataFrame:
    """Triage, rules, verdict and summary of already masked documents."""
    typed = triage(masked)
    if len(catalogue) < INDEX_FROM:
        judged = audit_verdict(typed.withColumn("evaluations", evaluations("scrubbed_text", "doc_type", catalogue)))
    else:
        found = evaluations("scrubbed_text", "doc_type", catalogue, open_only=True)
        judged = audit_verdict(typed.withColumn("evaluations", found), applicable=applicable_count("doc_type", catalogue))
    return with_summary(judged)


def audit_uploads(uploads: DataFrame, catalogue: list[Row], auto_approve: bool = False) -> DataFrame:
    """Every upload with its verdict and ``route``: rejected, ocr, pending or auto.

    Everything is computed within the row: no join, no grouping, no shuffle, whatever the
    number of documents. The text of a rejected upload is emptied before masking, so
    rejects cost nothing further (a null text would leave every rule open). Store the result (``audit_to``) before filtering on
    verdict columns: a filter pushed below this plan would compute the audit twice.
    """
    checked = gated(uploads)
    accepted = F.col("reject_code").isNull() & ~F.col("needs_ocr")
    kept = [c for c in checked.columns if c != "text"]
    masked = (
        checked.select(*kept, F.when(accepted, F.col("text")).otherwise(F.lit("")).alias("text"))
        .select(*kept, mask_report("text").alias("masking_report"))
        .select(*kept, "masking_report.scrubbed_text", "masking_report.pii_detected")
    )
    audited = package_result(audit_masked(masked, catalogue)).withColumns({
        "session_id": F.md5(F.col("doc_id").cast("string")),
        "route": F.when(F.col("needs_ocr"), F.lit("ocr"))
        .when(~accepted, F.lit("rejected"))
        .when(needs_review(auto_approve=auto_approve), F.lit("pending"))
        .otherwise(F.lit("auto")),
    })
    return audited.select(
        *[c for c in kept if c != "needs_ocr"],
        *[F.when(accepted, F.col(c)).alias(c) for c in VERDICT_COLUMNS],
        "route",
    )


def ocr_work(uploads: DataFrame) -> DataFrame:
    """The work-list for OCR: accepted uploads that hold no text; the gate alone decides. What comes
    back re-enters through ``sources.documents.assemble_pages`` and ``with_ocr_text``."""
    return gated(uploads).where("needs_ocr").select("doc_id", "filename", "declared_mime")


def audit_to(uploads: DataFrame, catalogue: list[Row], path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Audit in one pass into a table partitioned by route, and read it back.

    Only ``columns`` (default: all) are computed and written; ``route`` always is. Reading one
    route afterwards prunes the others, and only the asked columns are read.
    """
    audited = audit_uploads(uploads, catalogue)
    if columns is not None:
        audited = audited.select(*columns, "route")
    audited.write.mode("overwrite").partitionBy("route").parquet(path)
    return uploads.sparkSession.read.schema(audited.schema).parquet(path)


def audit_staged(uploads: DataFrame, catalogue: list[Row], columns: tuple[str, ...] | None = None) -> DataFrame:
    return audit_to(uploads, catalogue, scratch_path(uploads.sparkSession, "audit"), columns)
