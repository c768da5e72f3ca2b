import datetime as dt
import os

from pyspark.sql import functions as F

from attestor.operators import review
from attestor.plans.audit import audit_uploads
from attestor.plans.inputs import business_documents
from attestor.session import staged
from attestor.sources import catalogue
from attestor.sources.ledger_store import read_ledger
from attestor.streaming import approvals, arrivals

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2026, 1, 1)


def test_stream_equals_batch_and_survives_repeats(spark, tmp_path):
    docs = business_documents(spark, SF)
    landing = str(tmp_path / "landing")
    docs.repartition(3).write.parquet(landing)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rows = catalogue.builtin_rows()
    for _ in range(2):  # the second run finds nothing new
        stream = arrivals.arrivals(spark, landing, docs.schema, files_per_batch=1)
        arrivals.continuous_audit(stream, rows, out, checkpoint).awaitTermination()
    got = arrivals.audited_so_far(spark, out)
    columns = ("doc_id", "route", "status", "severity", "compliance_score", "violations")
    expected = audit_uploads(docs, rows).select(*columns)
    assert got.select("batch_id").distinct().count() == 3
    assert got.select(*columns).exceptAll(expected).count() == 0 and got.count() == expected.count()
    ledger = read_ledger(spark, f"{out}/ledger")
    ids = sorted(r.id for r in ledger.select("id").collect())
    assert ids == list(range(1, got.where("route = 'auto'").count() + 1))


def _pending(spark, n):
    docs = business_documents(spark, SF)
    audited = audit_uploads(docs, catalogue.builtin_rows()).drop("received_at")
    return staged(staged(audited, "all").where("route = 'pending'").limit(n), "pending")


def test_stream_of_reviews_equals_batch(spark, tmp_path):
    pending = _pending(spark, 6)
    ids = sorted(r.session_id for r in pending.collect())
    rows = [
        (ids[0], 3, 1, "COMPLIANT", "fine"), (ids[0], 1, 2, "NON_COMPLIANT", "first by time"), (ids[1], 2, 3, None, ""), ("nobody", 2, 4, None, "x"),
        (ids[0], 5, 5, "COMPLIANT", "late"), (ids[2], 5, 6, "maybe", "bad"), (ids[3], 6, 7, "non_compliant", None),
        (ids[2], 8, 8, "COMPLIANT", "too late"), (ids[4], 9, 9, None, "noted"), (ids[1], 9, 10, None, None),
    ]
    reviews = spark.createDataFrame(
        [(s, DAY + dt.timedelta(days=d), n, o, t) for s, d, n, o, t in rows],
        "session_id string, review_ts timestamp_ntz, review_no int, override_status string, reviewer_notes string",
    )
    landing = tmp_path / "reviews"
    for part, (low, high) in enumerate(((1, 4), (5, 7), (8, 10))):  # three files, in order of time
        reviews.where(F.col("review_no").between(low, high)).coalesce(1).write.mode("append").parquet(str(landing))
        for file in landing.glob("part-*.parquet"):
            if not file.name.startswith("part-9"):
                os.utime(file.rename(landing / f"part-9{part}.parquet"), (part + 1, part + 1))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        stream = arrivals.arrivals(spark, str(landing), reviews.schema, files_per_batch=1)
        approvals.continuous_approval(stream, pending, out, str(tmp_path / "checkpoint")).awaitTermination()
    approved, refused = review.apply_override(review.apply_reviews(pending, reviews))
    columns = ("session_id", "status", "severity", "human_review", "timestamp")
    got = spark.read.parquet(f"{out}/approved").select("batch_id", *columns)
    assert got.select("batch_id").distinct().count() == 3
    assert sorted(map(str, got.drop("batch_id").collect())) == sorted(map(str, review.approved_results(approved).select(*columns).collect()))
    bad = spark.read.parquet(f"{out}/refused")
    assert [(r.session_id, r.review_no) for r in bad.collect()] == [(r.session_id, r.review_no) for r in refused.collect()] == [(ids[2], 6)]
    unknown = {r.review_no for r in spark.read.parquet(f"{out}/unknown").collect()}
    assert unknown == {1, 4, 5, 8, 10}
    ledger = read_ledger(spark, f"{out}/ledger").collect()
    assert sorted(r.id for r in ledger) == [1, 2, 3, 4]


REVIEW = "session_id string, review_ts timestamp_ntz, review_no int, override_status string, reviewer_notes string"


def test_sessions_held_while_the_stream_runs_are_approved(spark, tmp_path):
    pending = _pending(spark, 5).drop("route")
    ids = sorted(r.session_id for r in pending.collect())
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    audit, landing = str(tmp_path / "audit"), str(tmp_path / "reviews")

    def run(number, sessions, reviews, **how):
        if sessions:
            held = pending.where(F.col("session_id").isin(sessions)).coalesce(1)
            held.write.parquet(f"{audit}/results/batch_id={number}/route=pending")
        rows = [(s, DAY + dt.timedelta(days=d), n, o, "") for s, d, n, o in reviews]
        spark.createDataFrame(rows, REVIEW).coalesce(1).write.mode("append").parquet(landing)
        stream = arrivals.arrivals(spark, landing, spark.createDataFrame([], REVIEW).schema)
        held = arrivals.held_so_far(spark, audit, pending.schema)
        approvals.continuous_approval(stream, held, out, str(tmp_path / "checkpoint"), ledger=ledger, **how).awaitTermination()
        open_now = spark.read.parquet(f"{out}/open/batch_id={number}")
        return sorted(r.session_id for r in open_now.collect())

    # A review that comes before its session is told so; the session waits on.
    assert run(0, ids[:2], [(ids[0], 1, 1, None), (ids[3], 1, 2, None)]) == [ids[1]]
    assert run(1, ids[2:4], [(ids[3], 2, 4, "COMPLIANT"), (ids[3], 1, 3, "NON_COMPLIANT"), (ids[0], 2, 5, None)]) == [ids[1], ids[2]]
    assert run(2, [], [(ids[1], 3, 6, "bad")]) == [ids[2]]
    # What has waited until now is given up; what is held just now waits on.
    assert run(3, ids[4:], [("nobody", 3, 7, None)], expiry="0 seconds") == [ids[4]]
    approved = {r.session_id: r for r in spark.read.parquet(f"{out}/approved").collect()}
    assert sorted(approved) == sorted([ids[0], ids[3]]) and approved[ids[3]].status == "NON_COMPLIANT"
    by_table = {r.session_id: r for r in pending.collect()}
    assert approved[ids[0]].full_report.executive_summary == by_table[ids[0]].full_report.executive_summary
    assert [r.session_id for r in spark.read.parquet(f"{out}/refused").collect()] == [ids[1]]
    assert sorted(r.review_no for r in spark.read.parquet(f"{out}/unknown").collect()) == [2, 4, 5, 7]
    assert [r.session_id for r in spark.read.parquet(f"{out}/expired").collect()] == [ids[2]]
    assert sorted(r.id for r in read_ledger(spark, ledger).collect()) == [1, 2]
    # Only the last versions of the open sessions are kept.
    assert {r.batch_id for r in spark.read.parquet(f"{out}/open").select("batch_id").distinct().collect()} <= {2, 3}
