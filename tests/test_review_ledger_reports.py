import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions import text as T
from attestor.operators import batch, ledger, reports, review
from attestor.sources import catalogue, ledger_store, report_store

REVIEW = "session_id string, review_ts timestamp_ntz, review_no bigint, override_status string, reviewer_notes string"
DAY = dt.datetime(2026, 1, 1)


def _pending(spark):
    return spark.createDataFrame(
        [(i, f"s{i}", f"f{i}.txt", "invoice", "NON_COMPLIANT", s) for i, s in
         [(1, "HIGH"), (2, "CRITICAL"), (3, "HIGH"), (4, None), (5, "HIGH"), (6, "HIGH")]],
        "doc_id bigint, session_id string, filename string, doc_type string, status string, severity string",
    ).withColumn("full_report", F.struct("filename", "status", "severity", F.lit(7).alias("compliance_score")))


def _reviews(spark):
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    return spark.createDataFrame([
        ("s1", at(5), 2, "NON_COMPLIANT", "late"),
        ("s1", at(1), 1, "compliant", None),
        ("s2", at(2), 3, "maybe", "bad"),
        ("s3", at(3), 4, "", "only notes"),
        ("s4", at(4), 5, None, None),
        ("s9", at(4), 6, "COMPLIANT", None),
        ("s6", at(7), 8, "non_compliant", ""),
        ("s6", at(7), 7, None, "tie goes to the lower number"),
    ], REVIEW)


def test_each_session_is_used_once(spark):
    pending, reviews = _pending(spark), _reviews(spark)
    first = {r.session_id: r.review_no for r in review.first_review(reviews).collect()}
    assert first == {"s1": 1, "s2": 3, "s3": 4, "s4": 5, "s9": 6, "s6": 7}
    assert [r.review_no for r in review.unknown_sessions(pending, reviews).collect()] == [6]
    assert sorted(r.review_no for r in review.repeated_reviews(pending, reviews).collect()) == [2, 8]
    remaining = review.remaining_pending(pending, reviews)
    assert [r.session_id for r in remaining.collect()] == ["s5"]
    used = review.apply_reviews(pending, reviews)
    assert used.count() + remaining.count() == pending.count()


def test_hot_session_keeps_every_review(spark):
    reviews = spark.range(0, 3000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("s1")).otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("session_id"),
        F.lit(DAY).cast("timestamp_ntz").alias("review_ts"), F.col("id").alias("review_no"),
        F.lit(None).cast("string").alias("override_status"), F.lit(None).cast("string").alias("reviewer_notes"),
    )
    rows = [(r.session_id, r.review_no) for r in reviews.collect()]
    known = {f"s{i}" for i in range(1, 7)}
    first = {}
    for session, number in sorted(rows, key=lambda r: r[1]):
        first.setdefault(session, number)
    repeats = sorted(n for s, n in rows if s in known and n != first[s])
    pending = _pending(spark)
    assert sorted(r.review_no for r in review.repeated_reviews(pending, reviews).collect()) == repeats
    unknown = review.unknown_sessions(pending, reviews)
    assert sorted(r.review_no for r in unknown.collect()) == sorted(n for s, n in rows if s not in known)


def test_overrides(spark):
    reviewed = review.apply_reviews(_pending(spark), _reviews(spark))
    approved, refused = review.apply_override(reviewed)
    rows = {r.session_id: r for r in approved.collect()}
    assert [r.session_id for r in refused.collect()] == ["s2"]
    assert (rows["s1"].final_status, rows["s1"].final_severity, rows["s1"].overridden) == ("COMPLIANT", "LOW", True)
    assert rows["s1"].human_review.reviewer_notes == "Status overridden by human compliance auditor."
    assert rows["s1"].human_review.timestamp == "2026-01-01T00:01:00"
    assert rows["s3"].human_review.status_overridden is False and rows["s3"].overridden is True
    assert rows["s3"].human_review.original_status is None
    # Neither override nor notes: the report stays as it was, the ledger gets the default severity.
    assert rows["s4"].human_review is None and rows["s4"].report_severity is None and rows["s4"].final_severity == "HIGH"
    results = {r.session_id: r for r in review.approved_results(approved).collect()}
    assert results["s1"].full_report.status == "COMPLIANT" and results["s1"].status == "COMPLIANT"
    assert results["s4"].full_report.severity is None and results["s4"].severity == "HIGH"


def test_routing_defaults_and_auto_approval(spark):
    df = spark.createDataFrame([("LOW",), ("HIGH",), ("CRITICAL",), (None,), ("MEDIUM",)], "severity string")
    pending, auto = review.route_reviews(df)
    assert (pending.count(), auto.count()) == (2, 3)
    pending, auto = review.route_reviews(df, True)
    assert (pending.count(), auto.count()) == (0, 5)


def test_notice(spark):
    df = spark.createDataFrame([(1, "s", "HIGH", ["a", "b", "c", "d"])], "doc_id int, session_id string, severity string, violations array<string>")
    row = review.review_notice(df).first()
    assert row.preview_violations == ["a", "b", "c"] and row.violation_count == 4
    assert row.message.startswith("🚨 4 critical violation(s) detected.") and row.status == "AWAITING_HUMAN_REVIEW"


def _results(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, timestamp timestamp_ntz, filename string, doc_type string, status string, severity string")
    report = F.struct(
        F.lit(80).alias("compliance_score"), F.lit(True).alias("pii_was_detected"),
        F.struct(F.array(F.lit("INV-01: no id"), F.lit("loose text"), F.lit("INV-02: two\nlines")).alias("violations"),
                 F.array(F.lit("**Fix** it ✅")).alias("recommendations"), F.lit("mine").alias("rule_source")).alias("audit_result"),
        F.lit("# Title\n*fine*").alias("executive_summary"),
    )
    return df.withColumn("full_report", report)


def test_ledger_ids_go_on_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger_store.read_ledger(spark, path).count() == 0 and ledger_store.find_latest(spark, path).count() == 0
    first = _results(spark, [(2, DAY, "b.txt", "invoice", "COMPLIANT", None), (1, DAY, "a.txt", None, "", "HIGH")])
    second = _results(spark, [(3, DAY + dt.timedelta(days=1), None, "report", "NON_COMPLIANT", "LOW")])
    appended = [ledger_store.append_ledger(rows, path, "one", batch) for batch, rows in ((0, first), (1, second), (1, second), (0, first))]
    assert appended == [True, True, False, False]
    rows = {r.id: r for r in ledger_store.read_ledger(spark, path).collect()}
    assert {i: r.filename for i, r in rows.items()} == {1: "a.txt", 2: "b.txt", 3: "unknown"}
    assert rows[2].severity == "LOW" and rows[3].compliance_score == 80
    read = ledger_store.read_ledger(spark, path)
    assert ledger_store.ledger_by_id(read, 99).count() == 0 and ledger_store.find_by_id(spark, path, 99).count() == 0
    assert [r.id for r in ledger_store.latest_logs(read, 2).collect()] == [3, 2]
    for limit in (0, 101):
        with pytest.raises(ValueError):
            ledger_store.latest_logs(read, limit)


def test_writers_share_a_ledger_at_the_same_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    monkeypatch.setattr(ledger_store, "COMPACT", 4)
    frames = {(w, n): _results(spark, [(i, DAY + dt.timedelta(hours=n), f"{w}{n}-{i}", "x", "y", "LOW") for i in range(n)]) for w in "ab" for n in range(4)}

    def write(writer):
        return [ledger_store.append_ledger(frames[writer, n], path, writer, n) for n in (*range(4), 2)]

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(write, "ab")) == [[True, True, True, True, False]] * 2
    known = ledger_store.commits(spark, path)
    assert [c.version for c in known] == list(range(1, 9)) and {(c.writer, c.batch) for c in known} == set(frames)
    assert any(f.name.endswith(".all") for f in (tmp_path / "ledger" / "_commits").iterdir())
    rows = ledger_store.read_ledger(spark, path).collect()
    assert sorted(r.id for r in rows) == list(range(1, 13))
    assert sorted(r.filename for r in rows) == sorted(f"{w}{n}-{i}" for w in "ab" for n in range(4) for i in range(n))
    # Lookups read the batches that can hold the answer, and no others.
    one = ledger_store.find_by_id(spark, path, rows[0].id)
    assert one.first().filename == rows[0].filename and len({f.rsplit("/", 2)[-2] for f in one.inputFiles()}) == 1
    newest = ledger_store.find_latest(spark, path, 5)
    every = ledger_store.latest_logs(ledger_store.read_ledger(spark, path), 5)
    assert newest.drop("report").collect() == every.drop("report").collect()
    assert len({f.rsplit("/", 2)[-2] for f in newest.inputFiles()}) == 2


def test_a_claim_that_is_taken_goes_to_the_next_number(spark, tmp_path):
    log = ledger_store._Log(spark, str(tmp_path / "ledger"))
    one = log.claim("a", 0, "f", 3, None, None)
    assert not log._write("000000000001.json", [one])
    assert log.claim("a", 0, "g", 3, None, None) is None
    two = log.claim("b", 0, "h", 2, None, None)
    assert (one.start, one.last, two.start, two.last, two.version) == (0, 3, 3, 5, 2)


def test_default_time_is_now_in_utc(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger_store.append_ledger(_results(spark, [(1, None, "a.txt", "x", "y", "LOW")]), path, "one", 0)
    stamp = ledger_store.read_ledger(spark, path).first().timestamp
    assert abs(stamp - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(minutes=5)


def test_ids_are_dense_with_one_hot_time(spark):
    df = spark.range(0, 5000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("at"), F.col("id").alias("doc_id")
    )
    rows = ledger.assign_ids(df, ["at", "doc_id"], 10).collect()
    by_id = sorted(rows, key=lambda r: r.id)
    assert [r.id for r in by_id] == list(range(11, 5011))
    assert [(r["at"], r.doc_id) for r in by_id] == sorted((r["at"], r.doc_id) for r in rows)


def test_report_lines_and_texts(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger_store.append_ledger(_results(spark, [
        (1, DAY, "a.txt", "INVOICE", "NON_COMPLIANT", "odd"), (2, DAY, "b.txt", None, "compliant", None),
    ]), path, "one", 0)
    read = ledger_store.read_ledger(spark, path)
    lines = [(r.section_no, r.text) for r in reports.report_lines(read).where("log_id = 1").orderBy("section_no", "line_no").collect()]
    assert lines == [
        (1, "Document Audit Report"), (2, "Audit ID: #1"), (2, "Audit Date: 2026-01-01 00:00:00 UTC"),
        (2, "Document Category: Invoice"), (2, "PII Status: Redacted / Masked (Safe)"),
        (3, "VERDICT STATUS: NON-COMPLIANT"), (3, "RISK SEVERITY: ODD"), (3, "COMPLIANCE SCORE: 80/100"),
        (4, "Executive Summary"), (4, "Title\nfine"), (5, "Detected Compliance Violations"),
        (5, "INV-01 | no id"), (5, "VIOL-2 | loose text"), (5, "VIOL-3 | INV-02: two\nlines"),
        (6, "Actionable Recommendations"), (6, "-> Fix it [OK]"),
        (7, "Regulatory Standards Applied"), (7, "Rules applied are sourced from: mine"),
    ]
    report_store.write_reports(read, str(tmp_path / "reports"))
    texts = {r.log_id: r.report_text for r in spark.read.parquet(str(tmp_path / "reports")).collect()}
    assert texts[1] == "\n".join(t for _, t in lines)
    assert "[OK] No compliance violations detected." in texts[2] and "RISK SEVERITY: LOW" in texts[2]


def test_report_defaults_of_an_empty_row(spark):
    row = spark.sql("SELECT 5L AS id, TIMESTAMP_NTZ'2026-01-01' AS timestamp, 'f' AS filename, CAST(NULL AS STRING) AS doc_type,"
                    " '' AS status, CAST(NULL AS STRING) AS severity, parse_json('{}') AS report")
    got = reports.report_defaults(row).first()
    assert (got.doc_type, got.status, got.severity, got.compliance_score, got.pii_detected) == ("unknown", "NON_COMPLIANT", "LOW", 0, False)
    assert got.violations == [] and got.executive_summary == ""


MARKDOWN = [
    ("## Head\n**b** *i* `c`", "Head\nb i c"),
    ("“q” ‘s’ – — • ✅ ❌ ⚠ \U0001f6a8 ✔", "\"q\" 's' - - * [OK] [FAIL] [WARN] [ALERT] [OK]"),
    (" é 漢字 ", "é"),
    (None, ""),
    ("", ""),
]


def test_clean_markdown(value_of):
    assert value_of(T.clean_markdown, [m[0] for m in MARKDOWN]) == [m[1] for m in MARKDOWN]


def test_labels(value_of):
    assert value_of(T.capitalize, ["iNVOICE type", "", "x"]) == ["Invoice type", "", "X"]
    assert value_of(T.verdict_label, ["compliant", "REVIEW_NEEDED", None]) == ["COMPLIANT", "NON-COMPLIANT", "NON-COMPLIANT"]
    assert value_of(T.severity_band, ["low", "HIGH", "odd"]) == ["LOW", "HIGH", "CRITICAL"]
    assert value_of(T.session_key, ["a.b.txt"]) == ["audit_a_b_txt"]


def test_violations_split_and_enriched(spark):
    df = spark.createDataFrame([(1, ["INV-01: a", "free", "INV-02: x\ny", "ZZ-9:b", "INV-03: end\n"])], "doc_id int, violations array<string>")
    rows = {r.violation_no: r for r in reports.number_violations(df).collect()}
    assert [rows[i].violation_id for i in range(1, 6)] == ["INV-01", "VIOL-2", "VIOL-3", "ZZ-9", "INV-03"]
    assert [rows[i].description for i in (1, 2, 3, 4, 5)] == ["a", "free", "INV-02: x\ny", "b", "end"]
    enriched = {r.violation_id: r for r in reports.enrich_violations(reports.number_violations(df), catalogue.load_rules(spark)).collect()}
    assert enriched["INV-01"].severity == "HIGH" and enriched["VIOL-2"].severity is None and len(enriched) == 5


def test_iso_time_like_python(spark):
    times = [DAY, DAY + dt.timedelta(microseconds=120), DAY + dt.timedelta(seconds=5, microseconds=500000)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    assert [r[0] for r in df.select(T.iso_timestamp("ts")).collect()] == [t.isoformat() for t in times]


def test_batch_status(spark):
    manifest = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 5), (4, "d", 5)], "doc_id int, filename string, size_bytes bigint")
    results = spark.createDataFrame(
        [(1, "COMPLIANT", "LOW", [], None), (3, None, None, None, "x" * 60)],
        "doc_id int, status string, severity string, violations array<string>, error string",
    )
    rows = {r.doc_id: r for r in batch.batch_status(manifest, results).collect()}
    assert rows[1].message is None and rows[2].message == "File does not exist" and rows[4].message == "File does not exist"
    assert rows[3].message == "Error: " + "x" * 40 and rows[3].status == "UNKNOWN" and rows[3].error == "x" * 60
    assert batch.batch_summary(batch.batch_status(manifest, results)).agg(F.sum("files")).first()[0] == 4


def test_clean_markdown_strips_every_kind_of_space(value_of):
    # Texts without a mark are only trimmed, by the characters of the space class one by one.
    edged = [c + "a b" + c for c in V.SPACES]
    assert len(edged) > 20 and value_of(lambda c: F.col(c).rlike(f"^[{V.SPACE_CLASS}]"), edged, "c") == [True] * len(edged)
    assert value_of(T.clean_markdown, edged) == ["a b"] * len(edged)
    assert value_of(T.clean_markdown, ["a​b", "é", "`", "#", " * ", "\xa0“x” "]) == ["ab", "é", "", "", "*", '"x"']
