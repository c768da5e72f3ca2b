"""Results that meet their reviews are dealt out by rows, whatever the number of shuffle partitions."""

from attestor import session
from attestor.operators import review
from attestor.streaming import approvals

REVIEWS = "session_id string, review_ts timestamp_ntz, review_no bigint, override_status string, reviewer_notes string"


def test_the_rows_of_a_task_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    spark.range(1000).selectExpr("concat('s', id) AS session_id", "id AS doc_id").write.parquet(f"{tmp_path}/pending")
    pending = spark.read.parquet(f"{tmp_path}/pending")
    reviews = spark.range(1500).selectExpr(
        "concat('s', id % 750) AS session_id", "timestamp_ntz'2024-01-01 00:00:00' AS review_ts", "id AS review_no",
        "'' AS override_status", "CAST(NULL AS string) AS reviewer_notes",
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        taken = review.apply_reviews(pending, reviews)
        assert taken.rdd.getNumPartitions() >= 20
        assert {(r.session_id, r.review_no) for r in taken.collect()} == {(f"s{i}", i) for i in range(750)}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_stream_takes_results_of_earlier_micro_batches(spark, tmp_path):
    result = "session_id string, doc_id int, status string, severity string, filename string, full_report struct<status:string,severity:string>"
    row = lambda i: (f"s{i}", i, "NON_COMPLIANT", "HIGH", f"{i}.txt", ("NON_COMPLIANT", "HIGH"))
    none = spark.createDataFrame([], REVIEWS)
    held = [spark.createDataFrame([row(1), row(1), row(2)], result), spark.createDataFrame([row(3)], result)]
    approvals.decide(approvals._Tables(spark, str(tmp_path), 0), none, held[0], None, None)
    approvals.decide(approvals._Tables(spark, str(tmp_path), 1), none, held[1], None, None)
    reviews = spark.sql("SELECT s AS session_id, timestamp_ntz'2024-01-01 00:00:00' AS review_ts, 1L AS review_no, 'COMPLIANT' AS override_status,"
                        " '' AS reviewer_notes FROM VALUES ('s1'), ('s3'), ('s9') AS v(s)")
    approved = approvals.decide(approvals._Tables(spark, str(tmp_path), 2), reviews, held[0].where("false"), None, None)
    assert sorted(r.session_id for r in approved.collect()) == ["s1", "s3"]
    assert [r.session_id for r in spark.read.parquet(f"{tmp_path}/unknown/batch_id=2").collect()] == ["s9"]
