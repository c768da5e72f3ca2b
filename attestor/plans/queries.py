"""Registered queries: every operator over the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions import files, json_fields, masking, sql_functions
from attestor.functions import text as T
from attestor.operators import (
    batch, gate, ledger, redaction, reports, review, rulebook, triage, verdict,
)
from attestor.plans import inputs
from attestor.plans.audit import audit_staged, audit_uploads, ocr_work
from attestor.plans.model_audit import audit_answers, parsed_answers
from attestor.session import read_spread, scratch_path, staged
from attestor.sources import catalogue, documents, ledger_store, report_store
from attestor.streaming import approvals, arrivals

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, tuple[str, Query]] = {}


def query(name: str, survey_id: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _registry[name] = (survey_id, fn)
        return fn

    return register


def registered() -> dict[str, Query]:
    return {name: fn for name, (_, fn) in _registry.items()}


def survey_ids() -> dict[str, str]:
    return {name: survey_id for name, (survey_id, _) in _registry.items()}


# --- shared inputs ---------------------------------------------------------------------


def _joined(items: Column | str, separator: str = "|") -> Column:
    return F.array_join(items, separator)


def _business(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.business_documents(spark, sf)


def _rules(spark: SparkSession) -> DataFrame:
    return catalogue.with_predicates(catalogue.load_rules(spark))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """All texts: documents, raw pages and business documents."""
    docs = inputs.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = inputs.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    business = _business(spark, sf).select(F.lit("business").alias("kind"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(pages).unionByName(business)


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted business documents after masking."""
    return redaction.mask_documents(gate.accepted_with_text(_business(spark, sf)))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return triage.triage(_masked(spark, sf))


def _audited(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """All uploads with verdict and route, stored once; only the given columns if any."""
    return audit_staged(_business(spark, sf), catalogue.builtin_rows(), columns or None)


def _accepted(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("route").isin("auto", "pending"))


def _pending(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("route") == "pending")


def _auto(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("route") == "auto")


def _results(audited: DataFrame) -> DataFrame:
    """Results that reach the ledger at once, stamped with their arrival."""
    return _auto(audited).withColumnRenamed("received_at", "timestamp")


def _approved(spark: SparkSession, sf: str, audited: DataFrame) -> DataFrame:
    reviewed = review.apply_reviews(_pending(audited), inputs.reviews(spark, sf))
    approved, _ = review.apply_override(reviewed)
    return review.approved_results(approved)


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return ledger_store.read_ledger(spark, _ledger_path(spark, sf))


def _ledger_path(spark: SparkSession, sf: str) -> str:
    """A stored ledger: one batch passed at once, one batch approved by reviewers."""
    audited = _audited(spark, sf, "doc_id", "filename", "doc_type", "status", "severity", "received_at", "full_report", "session_id")
    path = scratch_path(spark, "ledger")
    ledger_store.append_ledger(_results(audited), path, "audit", 0)
    # Stored first: the ledger counts and samples its rows before it sorts them.
    ledger_store.append_ledger(staged(_approved(spark, sf, audited), "approved"), path, "approval", 0)
    return path


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.derive(inputs.VIOLATIONS, lineitem=inputs.table(spark, sf, "lineitem"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Latest model answers per document, parsed."""
    latest = verdict.latest_agent_output(inputs.agent_events(spark, sf))
    return latest.select(
        "doc_id",
        json_fields.triage_fields(json_fields.extract_json("triage_raw")).alias("t"),
        json_fields.audit_fields(json_fields.extract_json("audit_raw")).alias("a"),
    )


def _ts(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- flagship --------------------------------------------------------------------------


@query("full_audit", "all of §3.1")
def full_audit(spark: SparkSession, sf: str) -> DataFrame:
    audited = audit_uploads(_business(spark, sf), catalogue.builtin_rows())
    return audited.select(
        "doc_id", "filename", "route", "reject_code", "doc_type", "status", "severity",
        "compliance_score", "pii_detected", _joined("violations").alias("violations"),
        F.md5("executive_summary").alias("summary_md5"), "session_id",
    )


# --- masking ---------------------------------------------------------------------------


def _mask_query(function) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        masked = _texts(spark, sf).select("kind", "id", "text", function("text").alias("masked"))
        return masked.select(
            "kind", "id", F.length("masked").alias("masked_length"), F.md5("masked").alias("masked_md5")
        )

    return run


for _name, _id, _function in (
    ("mask_email", "M1", masking.mask_email),
    ("mask_card", "M2", masking.mask_card),
    ("mask_aadhaar", "M3", masking.mask_aadhaar),
    ("mask_pan", "M4", masking.mask_pan),
    ("mask_gstin", "M5", masking.mask_gstin),
    ("mask_phone", "M6", masking.mask_phone),
    ("mask_all", "M8", masking.mask_all),
):
    query(_name, _id)(_mask_query(_function))


@query("luhn_candidates", "M7")
def luhn_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(V.CARD), F.lit(0))
    return _texts(spark, sf).select("kind", "id", F.posexplode(found).alias("pos", "candidate")).select(
        "kind", "id", "pos", "candidate", masking.luhn_valid("candidate").alias("luhn_valid")
    )


@query("pii_detected", "M9")
def pii_detected(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select(
        "kind", "id", masking.pii_detected("text", masking.mask_all("text")).alias("pii_detected")
    )


@query("redaction_tags", "M10")
def redaction_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select(
        "kind", "id", _joined(masking.tags_used(masking.mask_all("text")), ",").alias("tags")
    )


@query("mask_reports", "M11")
def mask_reports(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.mask_documents(_texts(spark, sf)).select(
        "kind", "id", F.md5("scrubbed_text").alias("masked_md5"), "pii_detected", "original_length",
        "scrubbed_length", "skill", "version", _joined("redaction_tags_used", ",").alias("tags"),
    )


@query("redaction_profile", "A5")
def redaction_profile(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.redaction_profile(_texts(spark, sf))


@query("sql_masking", "UD1")
def sql_masking(spark: SparkSession, sf: str) -> DataFrame:
    name = sql_functions.register_redact_pii(spark)
    masked = spark.sql(f"SELECT kind, id, {name}(text) AS masked FROM {{texts}}", texts=_texts(spark, sf))
    return masked.select("kind", "id", F.md5("masked").alias("masked_md5"))


# --- gate and documents ----------------------------------------------------------------


@query("decoded_files", "S1")
def decoded_files(spark: SparkSession, sf: str) -> DataFrame:
    landed = inputs.derive(inputs.LANDED, documents=inputs.table(spark, sf, "documents"))
    body = F.encode("crlf_text", "UTF-8")
    content = F.when(F.col("broken"), F.concat(F.to_binary(F.lit("FF"), F.lit("hex")), body)).otherwise(body)
    decoded = documents.decode_documents(landed.select("doc_id", content.alias("content")))
    return decoded.select("doc_id", F.length("content").alias("length"), "is_valid", F.md5("text").alias("text_md5"))


@query("upload_manifest", "S2")
def upload_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return documents.manifest(_business(spark, sf))


@query("extraction_routes", "S3")
def extraction_routes(spark: SparkSession, sf: str) -> DataFrame:
    gated_uploads = gate.gate_reason(_business(spark, sf))
    return documents.extraction_route(gated_uploads).select("doc_id", "filename", "route", "needs_ocr")


@query("scanned_files", "S1")
def scanned_files(spark: SparkSession, sf: str) -> DataFrame:
    """Land every document's bytes in files of 50 documents, scan them back."""
    landed = inputs.derive(inputs.LANDED, documents=inputs.table(spark, sf, "documents"))
    folder = F.floor(F.col("doc_id") / 50).cast("bigint")
    body = F.encode("crlf_text", "UTF-8")
    broken = F.concat(F.to_binary(F.lit("FF"), F.lit("hex")), body).cast("string")
    value = F.when(folder % 7 == 3, broken).otherwise(F.col("crlf_text"))
    path = scratch_path(spark, "landed")
    rows = landed.select(folder.alias("folder"), "doc_id", value.alias("value"))
    rows.repartition("folder").sortWithinPartitions("folder", "doc_id").select("folder", "value").write.partitionBy("folder").option("lineSep", "\r\n").text(path)
    found = documents.scan_documents(spark, path, "*.txt")
    return found.select(
        F.regexp_extract("path", r"folder=(\d+)", 1).cast("bigint").alias("folder"), "length", "is_valid", "reject_code", F.md5("text").alias("text_md5")
    )


@query("ocr_work", "S3, F8")
def ocr_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return ocr_work(_business(spark, sf))


@query("reentered_audit", "S3, S4")
def reentered_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads without text get the pages recognised for them and are audited again."""
    turns = inputs.table(spark, sf, "conversations")
    pages = documents.assemble_pages(turns, "conv_id", "turn", "text").where("reject_code is null")
    uploads = _business(spark, sf).withColumn("conv_id", F.col("doc_id") % 40)
    recognised = uploads.where(F.expr("doc_id % 47 = 0")).select("doc_id", "conv_id").join(pages, "conv_id").select("doc_id", "text")
    audited = audit_uploads(documents.with_ocr_text(uploads.drop("conv_id"), recognised), catalogue.builtin_rows())
    return audited.select("doc_id", "route", "reject_code", "doc_type", "status", "severity", "pii_detected")


@query("assembled_conversations", "S4")
def assembled_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = inputs.table(spark, sf, "conversations")
    return documents.assemble_pages(turns, "conv_id", "turn", "text")


def _file_query(columns: Callable[[], dict[str, Column]]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        named = [c.alias(n) for n, c in columns().items()]
        return _business(spark, sf).select("doc_id", "filename", *named)

    return run


_EXT = lambda: files.file_ext("filename")
for _name, _id, _columns in (
    ("file_extensions", "F1", lambda: {"ext": _EXT()}),
    ("allowed_extensions", "F2", lambda: {"allowed": files.ext_allowed(_EXT())}),
    ("mime_mismatches", "F3", lambda: {"mismatch": files.mime_mismatch(_EXT(), "declared_mime")}),
    ("oversized_uploads", "F4", lambda: {"too_large": files.too_large("size_bytes"), "megabytes": files.megabytes_text("size_bytes")}),
    ("empty_uploads", "F5", lambda: {"is_empty": files.is_empty("size_bytes")}),
    ("session_keys", "X6", lambda: {"session_key": T.session_key("filename")}),
):
    query(_name, _id)(_file_query(_columns))


@query("gate_reasons", "F6")
def gate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return gate.gate_reason(_business(spark, sf)).select("doc_id", "filename", "reject_code", "reject_detail")


@query("gate_split", "F7")
def gate_split(spark: SparkSession, sf: str) -> DataFrame:
    accepted, rejected = gate.split_gate(_business(spark, sf))
    return accepted.select("doc_id", F.lit("accepted").alias("side")).unionByName(
        rejected.select("doc_id", F.lit("rejected").alias("side"))
    )


@query("text_guard", "F8")
def text_guard(spark: SparkSession, sf: str) -> DataFrame:
    return gate.guard_text(_business(spark, sf)).select("doc_id", "filename", "reject_code", "reject_detail")


@query("text_previews", "F12")
def text_previews(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select("doc_id", T.text_preview("text").alias("preview"))


@query("context_cuts", "F13")
def context_cuts(spark: SparkSession, sf: str) -> DataFrame:
    cut = T.context_cut("text")
    return inputs.table(spark, sf, "documents").select(
        "doc_id", F.length(cut).alias("cut_length"), F.md5(cut).alias("cut_md5")
    )


# --- rules -----------------------------------------------------------------------------


def _type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted documents per document type: one small row per type."""
    return staged(_typed(spark, sf).groupBy("doc_type").agg(F.count("*").alias("documents")), "types")


def _with_demand(rules: DataFrame, types: DataFrame) -> DataFrame:
    """Rules with the number of documents each applies to."""
    asked = rulebook.applicable_rules(types, rules).groupBy("rule_id").agg(F.sum("documents").alias("documents"))
    return rules.join(asked, rules["id"] == asked["rule_id"], "left").select(
        rules["*"], F.coalesce("documents", F.lit(0)).alias("documents")
    )


_RULE_COLUMNS = ("category_no", "category", "seq", "id", "description", "severity", "regulation", "documents")


@query("catalogue_rules", "S5")
def catalogue_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _with_demand(catalogue.load_rules(spark), _type_counts(spark, sf)).select(*_RULE_COLUMNS)


@query("exported_rules", "S8")
def exported_rules(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "rules")
    catalogue.export_rules(catalogue.load_rules(spark), path)
    rules = catalogue.load_rules(spark, path)
    return _with_demand(rules, _type_counts(spark, sf)).select(*_RULE_COLUMNS[1:])


@query("rules_response", "S10, J1")
def rules_response(spark: SparkSession, sf: str) -> DataFrame:
    response = rulebook.rules_response(
        _typed(spark, sf), catalogue.load_rules(spark), catalogue.rules_metadata(spark)
    )
    return response.withColumn("rule_ids", _joined("rule_ids", ","))


@query("applicable_rules", "J1")
def applicable_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _typed(spark, sf).select("doc_id", "doc_type")
    return rulebook.applicable_rules(docs, catalogue.load_rules(spark)).select(
        "doc_id", "doc_type", "lookup_no", "seq", "rule_id", "severity", "regulation"
    )


@query("combined_rules", "U1")
def combined_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = catalogue.load_rules(spark)
    return rulebook.applicable_rules(_type_counts(spark, sf), rules).select(
        "doc_type", "documents", "lookup_no", "category", "seq", "rule_id"
    )


@query("rule_counts", "A1")
def rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rulebook.rule_counts(_typed(spark, sf), catalogue.load_rules(spark))


@query("supported_types", "A3")
def supported_types(spark: SparkSession, sf: str) -> DataFrame:
    types = rulebook.supported_types(catalogue.load_rules(spark))
    counts = _type_counts(spark, sf)
    return types.join(counts, types["category"] == counts["doc_type"], "left").select(
        "category", "category_no", "rule_count", "type_count", F.coalesce("documents", F.lit(0)).alias("documents")
    )


@query("rules_summary", "A4")
def rules_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = rulebook.rules_summary(catalogue.load_rules(spark))
    counts = _type_counts(spark, sf)
    return summary.join(counts, summary["category"] == counts["doc_type"], "left").select(
        "category_no", "category", "rule_count", "block", F.coalesce("documents", F.lit(0)).alias("documents")
    )


@query("rule_lookup", "F11")
def rule_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = _violations(spark, sf).select(
        "doc_id", "line_no", "violation", F.coalesce(T.violation_id("violation"), F.lit("none")).alias("rule_id")
    )
    return rulebook.rule_by_id(catalogue.load_rules(spark), ids).select(
        "doc_id", "line_no", "violation", "rule_id", "found", "category", "severity", "error"
    )


@query("rules_json", "X4")
def rules_json(spark: SparkSession, sf: str) -> DataFrame:
    types = _type_counts(spark, sf)
    texts = rulebook.rules_json(catalogue.load_rules(spark), types)
    return types.join(texts, "doc_type").select("doc_type", "documents", "rules_text")


@query("sql_rules", "UD2")
def sql_rules(spark: SparkSession, sf: str) -> DataFrame:
    name = sql_functions.register_compliance_rules(spark, catalogue.load_rules(spark))
    return spark.sql(
        f"SELECT d.doc_type, d.documents, r.lookup_no, r.category, r.seq, r.rule_id"
        f" FROM {{types}} d, LATERAL {name}(d.doc_type) r",
        types=_type_counts(spark, sf),
    )


# --- triage, evaluation, verdict ---------------------------------------------------------


@query("triaged_documents", "T1")
def triaged_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select("doc_id", "doc_type", "confidence", "reasoning")


@query("rule_evaluations", "J2")
def rule_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    evaluated = verdict.evaluate_rules(_typed(spark, sf), _rules(spark))
    return evaluated.select("doc_id", "doc_type", "rule_id", "severity", "passed")


@query("rule_evaluations_by_join", "J2")
def rule_evaluations_by_join(spark: SparkSession, sf: str) -> DataFrame:
    evaluated = verdict.evaluate_rules_by_join(_typed(spark, sf), _rules(spark))
    return evaluated.select("doc_id", "doc_type", "rule_id", "severity", "passed")


@query("tag_evidence", "J3")
def tag_evidence(spark: SparkSession, sf: str) -> DataFrame:
    masked = _typed(spark, sf).withColumn("tags", _joined("redaction_tags_used", ","))
    results = verdict.evaluations("scrubbed_text", "doc_type", catalogue.builtin_rows())
    proofs = F.filter(results, lambda r: r["rule_id"].isin("INV-01", "INV-05"))
    return masked.select("doc_id", "tags", F.explode(proofs).alias("e")).select(
        "doc_id", "tags", "e.rule_id", "e.passed"
    )


_VERDICT = ("doc_id", "status", "severity", "compliance_score")


def _verdict_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *_VERDICT, _joined("violations").alias("violations"), _joined("recommendations").alias("recommendations")
    )


@query("audit_verdicts", "A2")
def audit_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    results = verdict.evaluations("scrubbed_text", "doc_type", catalogue.builtin_rows())
    judged = _typed(spark, sf).withColumn("evaluations", results)
    return _verdict_columns(verdict.audit_verdict(judged))


@query("audit_verdicts_by_group", "A2")
def audit_verdicts_by_group(spark: SparkSession, sf: str) -> DataFrame:
    evaluated = verdict.evaluate_rules_by_join(_typed(spark, sf), _rules(spark))
    return _verdict_columns(verdict.audit_verdict_by_group(evaluated))


SUPPLIED = {
    "_metadata": {"version": "7.1", "jurisdiction": "House"},
    "general": [
        {"id": "H-01", "description": "Must state a date.", "severity": "LOW", "regulation": "House rule 1", "must": r"(?i)\bdate\b"},
        {"id": "H-02", "description": "Must hold no address.", "severity": "HIGH", "regulation": "House rule 2", "must_not": r"\[REDACTED_EMAIL\]"},
        {"id": "GEN-02", "description": "No identity numbers.", "severity": "CRITICAL", "regulation": "House rule 3"},
    ],
    "certificate": [{"id": "H-09", "description": "Must look right.", "severity": "MEDIUM", "regulation": "House rule 9"}],
    "invoice": [{"id": "H-05", "description": "Must name two numbers.", "severity": "MEDIUM", "regulation": "House rule 5", "must": r"\d{3}", "min_count": 2}],
}


def many_house_rules(n: int = 2000) -> dict:
    """A catalogue of n rules; rule i bars firm 3i."""
    return {"general": [
        {"id": f"W-{i:04d}", "description": f"Must not concern firm {3 * i}.", "severity": V.SEVERITIES[i % 4],
         "regulation": "House list", "must_not": rf"(?i)\bfirm {3 * i}\b"}
        for i in range(n)
    ]}


def _supplied_rows(spark: SparkSession, supplied: dict = SUPPLIED) -> list[Row]:
    path = scratch_path(spark, "supplied")
    spark.range(1).select(F.lit(json.dumps(supplied)).alias("value")).coalesce(1).write.text(path)
    return verdict.catalogue_rows(catalogue.with_predicates(catalogue.load_rules(spark, path)))


@query("supplied_catalogue", "S5, J2, A2")
def supplied_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Audit with a catalogue file that states its own predicates, and one rule without any."""
    rows = _supplied_rows(spark)
    columns = ("doc_id", "status", "severity", "compliance_score", "violations", "not_evaluated")
    return _accepted(audit_staged(_business(spark, sf), rows, columns)).select(
        "doc_id", "status", "severity", "compliance_score", _joined("violations").alias("violations"), _joined("not_evaluated").alias("not_evaluated")
    )


@query("many_rules", "S5, J2, A2")
def many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Audit with a catalogue of 2,000 rules, by the index of their literals."""
    columns = ("doc_id", "status", "severity", "compliance_score", "violations")
    rows = _supplied_rows(spark, many_house_rules())
    return _verdict_only(_accepted(audit_staged(_business(spark, sf), rows, columns)))


def _verdict_only(df: DataFrame) -> DataFrame:
    return df.select(*_VERDICT, _joined("violations").alias("violations"))


@query("review_needed_reports", "F14, C7, C8, S6")
def review_needed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader of the stored report sees of rules that could not be evaluated."""
    columns = ("doc_id", "filename", "doc_type", "status", "severity", "received_at", "full_report", "session_id")
    audited = audit_staged(_business(spark, sf), _supplied_rows(spark), columns)
    path = scratch_path(spark, "ledger")
    ledger_store.append_ledger(_results(audited), path, "audit", 0)
    stored = ledger_store.read_ledger(spark, path)
    texts = reports.report_texts(stored).select("log_id", "report_text")
    seen = stored.join(texts, stored["id"] == texts["log_id"])
    shown = lambda pattern: F.regexp_extract("report_text", pattern, 1)
    return seen.select(
        "filename", "status",
        _joined(F.try_variant_get("report", "$.audit_result.not_evaluated", "array<string>")).alias("not_evaluated"),
        shown(r"Rules Not Evaluated\n-> ([^\n]*)").alias("shown_rules"),
        shown(r"COMPLIANCE SCORE: ([^\n]*)").alias("shown_score"),
        F.regexp_extract(F.try_variant_get("report", "$.executive_summary", "string"), r"Audit Status:\*\* ([^\n]*)", 1).alias("shown_status"),
        F.regexp_extract(F.try_variant_get("report", "$.executive_summary", "string"), r"### Executive Summary\n([^\n]*)", 1).alias("finding"),
    )


@query("executive_summaries", "C7")
def executive_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _accepted(_audited(spark, sf, "doc_id", "executive_summary")).select("doc_id", "executive_summary")


@query("packaged_results", "F14")
def packaged_results(spark: SparkSession, sf: str) -> DataFrame:
    report = _accepted(_audited(spark, sf, "doc_id", "full_report")).select("doc_id", "full_report.*")
    return report.select(
        "doc_id", "filename", "doc_type", "status", "severity", "compliance_score", "pii_was_detected",
        _joined("audit_result.violations").alias("violations"), "audit_result.rule_source",
        F.md5("executive_summary").alias("summary_md5"), "scrubbed_text_preview", "pipeline",
    )


@query("model_inputs", "X5")
def model_inputs(spark: SparkSession, sf: str) -> DataFrame:
    prompt = T.model_input(F.col("filename"), F.col("scrubbed_text"), F.col("pii_detected"))
    return _masked(spark, sf).select("doc_id", prompt.alias("model_input"))


# --- model answers -----------------------------------------------------------------------


@query("latest_agent_output", "A8")
def latest_agent_output(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.latest_agent_output(inputs.agent_events(spark, sf))


@query("latest_role_messages", "A8")
def latest_role_messages(spark: SparkSession, sf: str) -> DataFrame:
    turns = inputs.table(spark, sf, "conversations")
    events = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text",
        F.when(F.col("role") == "user", F.lit(V.TRIAGE_AUTHOR)).otherwise(F.lit(V.AUDITOR_AUTHOR)).alias("author"),
        (F.col("role") == "assistant").alias("is_final"),
    )
    return verdict.latest_agent_output(events)


@query("extracted_json", "X1")
def extracted_json(spark: SparkSession, sf: str) -> DataFrame:
    events = inputs.agent_events(spark, sf).select("doc_id", "seq", "text")
    found = events.withColumn("v", json_fields.extract_json("text"))
    return found.select(
        "doc_id", "seq", F.col("v").isNotNull().alias("found"),
        F.try_variant_get("v", "$.doc_type", "string").alias("doc_type"),
        F.try_variant_get("v", "$.status", "string").alias("status"),
    )


@query("triage_fields", "X2")
def triage_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("doc_id", "t.*")


@query("audit_fields", "X3")
def audit_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict_columns(_answers(spark, sf).select("doc_id", "a.*"))


def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    second = inputs.derive(inputs.FALLBACKS, orders=inputs.table(spark, sf, "orders"))
    none = F.array().cast("array<string>")
    return second.select(
        "doc_id", "doc_type", "status", "severity", "compliance_score",
        F.when(F.col("violation") == "", none).otherwise(F.array("violation")).alias("violations"),
        F.array("recommendation").alias("recommendations"),
    )


@query("model_audit", "A8, X1, X2, X3, J8, F14, F9, S6")
def model_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers all the way to routes and ledger rows."""
    masked = _masked(spark, sf).drop("reject_code", "reject_detail")
    results = audit_answers(masked, inputs.agent_events(spark, sf), _fallback(spark, sf)).select(
        "doc_id", "filename", F.col("received_at").alias("timestamp"), "doc_type", "status", "severity", "compliance_score",
        "violations", "executive_summary", "full_report", "session_id", "route",
    )
    results = staged(results, "model-audit")
    path = scratch_path(spark, "model-ledger")
    ledger_store.append_ledger(results.where("route = 'auto'"), path, "model", 0)
    stored = ledger_store.read_ledger(spark, path).select("id", F.col("filename").alias("stored_name"), F.try_variant_get("report", "$.status", "string").alias("report_status"))
    return results.join(stored, results["filename"] == stored["stored_name"], "left").select(
        "doc_id", "filename", "route", "doc_type", "status", "severity", "compliance_score", _joined("violations").alias("violations"),
        F.md5("executive_summary").alias("summary_md5"), "session_id", "id", "report_status",
    )


@query("merged_verdicts", "J8")
def merged_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    primary = parsed_answers(inputs.agent_events(spark, sf)).drop("final_text")
    merged = verdict.merge_verdicts(primary, _fallback(spark, sf))
    return merged.select(
        "doc_id", "doc_type", "status", "severity", "compliance_score",
        _joined("violations").alias("violations"), _joined("recommendations").alias("recommendations"),
        "used_fallback",
    )


# --- review ------------------------------------------------------------------------------


@query("routed_results", "F9")
def routed_results(spark: SparkSession, sf: str) -> DataFrame:
    results = _accepted(_audited(spark, sf, "doc_id", "filename", "severity"))
    pending, auto = review.route_reviews(results, F.col("filename").endswith(".PDF"))
    return pending.select("doc_id", "severity", F.lit("pending").alias("side")).unionByName(
        auto.select("doc_id", "severity", F.lit("auto").alias("side"))
    )


@query("review_notices", "A9")
def review_notices(spark: SparkSession, sf: str) -> DataFrame:
    notice = review.review_notice(_pending(_audited(spark, sf, "doc_id", "session_id", "severity", "violations")))
    return notice.withColumn("preview_violations", _joined("preview_violations"))


@query("violation_previews", "L2")
def violation_previews(spark: SparkSession, sf: str) -> DataFrame:
    preview = F.slice("violations", 1, V.PREVIEW_VIOLATIONS)
    return _accepted(_audited(spark, sf, "doc_id", "violations")).select("doc_id", _joined(preview).alias("preview_violations"))


_REVIEW = ("session_id", "review_no", "override_status", "reviewer_notes")


@query("first_reviews", "W1")
def first_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return review.first_review(inputs.reviews(spark, sf)).select(*_REVIEW, _ts("review_ts").alias("review_ts"))


@query("repeated_reviews", "W1")
def repeated_reviews(spark: SparkSession, sf: str) -> DataFrame:
    pending = _pending(_audited(spark, sf, "session_id"))
    return review.repeated_reviews(pending, inputs.reviews(spark, sf)).select(*_REVIEW, "error")


@query("reviewed_sessions", "J4")
def reviewed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    joined = review.apply_reviews(_pending(_audited(spark, sf, "doc_id", "session_id", "status", "severity")), inputs.reviews(spark, sf))
    return joined.select("doc_id", *_REVIEW, "status", "severity")


@query("unknown_sessions", "J5")
def unknown_sessions(spark: SparkSession, sf: str) -> DataFrame:
    pending = _pending(_audited(spark, sf, "session_id"))
    return review.unknown_sessions(pending, inputs.reviews(spark, sf)).select(*_REVIEW, "error")


@query("remaining_pending", "J6")
def remaining_pending(spark: SparkSession, sf: str) -> DataFrame:
    pending = _pending(_audited(spark, sf, "doc_id", "session_id", "severity"))
    return review.remaining_pending(pending, inputs.reviews(spark, sf)).select("doc_id", "session_id", "severity")


@query("override_checks", "F15")
def override_checks(spark: SparkSession, sf: str) -> DataFrame:
    return review.validate_override(inputs.reviews(spark, sf)).select(*_REVIEW, "override", "override_error")


@query("applied_overrides", "H1")
def applied_overrides(spark: SparkSession, sf: str) -> DataFrame:
    reviewed = review.apply_reviews(_pending(_audited(spark, sf, "doc_id", "session_id", "status", "severity")), inputs.reviews(spark, sf))
    approved, _ = review.apply_override(reviewed)
    return approved.select(
        "doc_id", "session_id", "final_status", "final_severity", "overridden", "report_status",
        "report_severity", "human_review.*",
    )


@query("refused_overrides", "H1")
def refused_overrides(spark: SparkSession, sf: str) -> DataFrame:
    reviewed = review.apply_reviews(_pending(_audited(spark, sf, "doc_id", "session_id", "status", "severity")), inputs.reviews(spark, sf))
    _, refused = review.apply_override(reviewed)
    return refused.select("doc_id", *_REVIEW, "override_error")


@query("review_timestamps", "D1")
def review_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.reviews(spark, sf).select("review_no", T.iso_timestamp("review_ts").alias("iso"))


# --- ledger ------------------------------------------------------------------------------


@query("ledger_entries", "U2")
def ledger_entries(spark: SparkSession, sf: str) -> DataFrame:
    audited = _audited(spark, sf, "doc_id", "filename", "doc_type", "status", "severity", "received_at", "full_report", "session_id")
    columns = ("doc_id", "filename", "doc_type", "status", "severity", "timestamp")
    entries = ledger.ledger_entries(
        _results(audited).select(*columns), _approved(spark, sf, audited).select(*columns)
    )
    return entries.withColumn("timestamp", _ts("timestamp"))


@query("ledger_ids", "W2")
def ledger_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_spread(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderdate"])
    numbered = ledger.assign_ids(orders, ["o_orderdate", "o_orderkey"], 100)
    return numbered.select("id", "o_orderkey")


@query("stored_ledger", "S6, S7")
def stored_ledger(spark: SparkSession, sf: str) -> DataFrame:
    def of(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("report", path, kind)

    return _ledger(spark, sf).select(
        "id", _ts("timestamp").alias("timestamp"), "filename", "doc_type", "status", "severity",
        "compliance_score", of("$.status").alias("report_status"),
        of("$.compliance_score", "int").alias("report_score"),
        _joined(of("$.audit_result.violations", "array<string>")).alias("violations"),
        of("$.human_review.reviewer_notes").alias("reviewer_notes"),
    )


@query("ledger_lookup", "F10")
def ledger_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger_store.find_by_id(spark, _ledger_path(spark, sf), 42).select("id", "filename", "status", "severity")


@query("latest_logs", "L1")
def latest_logs(spark: SparkSession, sf: str) -> DataFrame:
    logs = ledger_store.find_latest(spark, _ledger_path(spark, sf))
    return logs.select("id", _ts("timestamp").alias("timestamp"), "filename", "doc_type", "status", "severity")


@query("compliance_trend", "A6")
def compliance_trend(spark: SparkSession, sf: str) -> DataFrame:
    trend = ledger.compliance_trend(_ledger(spark, sf))
    return trend.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("batch_status", "J7")
def batch_status(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_status(spark, sf)


def _batch_status(spark: SparkSession, sf: str) -> DataFrame:
    results = _audited(spark, sf, "doc_id", "status", "severity", "violations", "reject_detail").withColumnRenamed("reject_detail", "error")
    return batch.batch_status(documents.manifest(_business(spark, sf)), results)


@query("batch_summary", "A7")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return batch.batch_summary(_batch_status(spark, sf))


# --- reports -----------------------------------------------------------------------------


@query("cleaned_markdown", "C1")
def cleaned_markdown(spark: SparkSession, sf: str) -> DataFrame:
    prose = inputs.derive(inputs.MARKDOWN, documents=inputs.table(spark, sf, "documents"))
    clean = prose.select("doc_id", T.clean_markdown("text").alias("clean"))
    return clean.select(
        "doc_id", F.length("clean").alias("clean_length"), F.md5("clean").alias("clean_md5"),
        F.substring_index("clean", "\n", 2).alias("first_lines"),
    )


@query("split_violations", "C2")
def split_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _violations(spark, sf).select(
        "doc_id", "line_no", "violation", T.violation_id("violation").alias("violation_id"),
        T.violation_text("violation").alias("description"),
    )


@query("numbered_violations", "W3")
def numbered_violations(spark: SparkSession, sf: str) -> DataFrame:
    results = _accepted(_audited(spark, sf, "doc_id", "violations")).select(
        "doc_id", F.transform("violations", lambda v, i: F.when(i == 0, F.split_part(v, F.lit(": "), F.lit(2))).otherwise(v)).alias("violations")
    )
    return reports.number_violations(results)


@query("enriched_violations", "J9")
def enriched_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = _violations(spark, sf).withColumn("violation_id", T.violation_id("violation"))
    return reports.enrich_violations(found, catalogue.load_rules(spark)).select(
        "doc_id", "line_no", "violation", "violation_id", "category", "severity", "regulation"
    )


@query("report_labels", "C3, C4, C5, C6")
def report_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _accepted(_audited(spark, sf, "doc_id", "doc_type", "pii_detected", "status", "severity")).select(
        "doc_id", T.capitalize("doc_type").alias("category"), T.pii_label("pii_detected").alias("pii"),
        T.verdict_label("status").alias("verdict"), T.severity_band("severity").alias("band"),
    )


@query("capitalized_texts", "C3")
def capitalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_spread(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    return orders.select(
        "o_orderkey", T.capitalize("o_orderpriority").alias("priority"), T.capitalize("o_orderstatus").alias("status")
    )


@query("event_bands", "C5, C6")
def event_bands(spark: SparkSession, sf: str) -> DataFrame:
    events = inputs.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "view", F.lit("Compliant")).when(F.col("event_type") == "click", F.lit(V.REVIEW_NEEDED)).otherwise(F.col("event_type"))
    level = F.when(F.col("event_type") == "error", F.lit("high")).when(F.col("event_type") == "view", F.lit("Low")).otherwise(F.col("event_type"))
    return events.select("event_id", T.verdict_label(status).alias("verdict"), T.severity_band(level).alias("band"))


@query("report_defaults", "C9")
def report_defaults(spark: SparkSession, sf: str) -> DataFrame:
    fields = reports.report_defaults(_thinned(_ledger(spark, sf)))
    return fields.select(
        "log_id", "filename", "doc_type", "status", "severity", "compliance_score", "pii_detected",
        _joined("violations").alias("violations"), F.md5("executive_summary").alias("summary_md5"), "rule_source",
    )


def _thinned(rows: DataFrame) -> DataFrame:
    """Ledger rows as they may also be found: fields empty and reports without content."""
    bare = F.col("severity") == "MEDIUM"
    return rows.withColumns({
        "doc_type": F.when(bare, F.lit(None)).otherwise(F.col("doc_type")),
        "status": F.when(bare, F.lit("")).otherwise(F.col("status")),
        "report": F.when(~bare, F.col("report")),
    })


@query("report_lines", "C8")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.report_lines(_ledger(spark, sf))


@query("report_texts", "S9, D2")
def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "reports")
    report_store.write_reports(_ledger(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.select("log_id", "filename", F.md5("report_text").alias("report_md5"), F.length("report_text").alias("report_length"))


@query("report_timestamps", "D2")
def report_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "events").select("event_id", T.report_timestamp("ts").alias("shown"))


# --- streaming ---------------------------------------------------------------------------


def _stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    columns = inputs.COLUMNS[name]
    schema = spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).schema
    return arrivals.arrivals(spark, f"{sf}/{name}.parquet*", schema)


@query("streamed_audit", "ST1")
def streamed_audit(spark: SparkSession, sf: str) -> DataFrame:
    uploads = inputs.derive(inputs.BUSINESS_DOCUMENTS, orders=_stream_of(spark, sf, "orders"))
    out = scratch_path(spark, "streamed-audit")
    arrivals.continuous_audit(uploads, catalogue.builtin_rows(), out, f"{out}/checkpoint").awaitTermination()
    return arrivals.audited_so_far(spark, out).select(
        "doc_id", "filename", "route", "reject_code", "doc_type", "status", "severity",
        "compliance_score", "pii_detected", _joined("violations").alias("violations"),
        F.md5("executive_summary").alias("summary_md5"), "session_id",
    )


@query("streamed_approvals", "ST2")
def streamed_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of the stream: approved and refused sessions, with their ledger rows counted."""
    held = staged(_pending(_audited(spark, sf, "doc_id", "filename", "doc_type", "status", "severity", "received_at", "full_report", "session_id")).drop("received_at"), "held")
    stream = inputs.derive(inputs.REVIEWS, events=_stream_of(spark, sf, "events"))
    out = scratch_path(spark, "streamed-approvals")
    approvals.continuous_approval(stream, held, out, f"{out}/checkpoint").awaitTermination()
    return _decisions(spark, out)


def _decisions(spark: SparkSession, out: str) -> DataFrame:
    approved = spark.read.parquet(f"{out}/approved").select(
        "session_id", "doc_id", F.lit("approved").alias("outcome"), "status", "severity",
        "human_review.reviewer_notes", F.col("human_review.timestamp").alias("decided"),
    )
    refused = spark.read.parquet(f"{out}/refused").select(
        "session_id", "doc_id", F.lit("refused").alias("outcome"), "status", "severity", "reviewer_notes", F.col("override_error").alias("decided"),
    )
    return approved.unionByName(refused)


def _both_streams(spark: SparkSession, sf: str) -> str:
    """Audit and approval as streams: sessions that the one holds reach the other, and both append
    to one ledger. Returns the folder of their tables."""
    out = scratch_path(spark, "both-streams")
    uploads = inputs.derive(inputs.BUSINESS_DOCUMENTS, orders=_stream_of(spark, sf, "orders"))
    arrivals.continuous_audit(uploads, catalogue.builtin_rows(), f"{out}/audit", f"{out}/checkpoints/audit", ledger=f"{out}/ledger").awaitTermination()
    schema = arrivals.audited_so_far(spark, f"{out}/audit").drop("batch_id", "route").schema
    held = arrivals.held_so_far(spark, f"{out}/audit", schema)
    stream = inputs.derive(inputs.REVIEWS, events=_stream_of(spark, sf, "events"))
    approvals.continuous_approval(stream, held, f"{out}/approval", f"{out}/checkpoints/approval", ledger=f"{out}/ledger").awaitTermination()
    return out


@query("streamed_sessions", "ST1, ST2")
def streamed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions about sessions that are themselves a stream."""
    return _decisions(spark, f"{_both_streams(spark, sf)}/approval")


@query("shared_ledger", "U2, S6, W2")
def shared_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The one ledger of both streams: passed results and approved ones, with ids without gaps."""
    stored = ledger_store.read_ledger(spark, f"{_both_streams(spark, sf)}/ledger")
    return stored.select("id", _ts("timestamp").alias("timestamp"), "filename", "doc_type", "status", "severity", "compliance_score")
