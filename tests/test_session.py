"""How much a task gets."""

from pyspark.sql import functions as F

from attestor import session
from attestor.operators import review
from attestor.operators.ledger import assign_ids


def _sizes(df):
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch, tmp_path):
    """More tasks than cores once there are more rows, however many splits the small files have."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    spark.range(20_000).select("id", (F.col("id") % 2).alias("k")).write.parquet(str(tmp_path / "t"))
    read = session.read_spread(spark, str(tmp_path / "t"), ["id", "k"])
    assert read.rdd.getNumPartitions() == 40 and max(_sizes(read)) < 650
    assert sorted(r.id for r in read.collect()) == list(range(20_000))
    few = session.spread(spark.range(100).coalesce(1))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_ids_are_numbered_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    written = []
    monkeypatch.setattr("attestor.operators.ledger.staged", lambda df, label: written.append(df) or session.staged(df, label))
    # One hot time, the rows told apart by their number only; repeated and null keys stay.
    rows = spark.range(12_000).select(F.lit(1).alias("t"), F.when(F.col("id") > 4, F.col("id")).alias("id0"))
    got = assign_ids(rows, ["t", "id0"], 7).select("id", "id0").collect()
    assert sorted(r.id for r in got) == list(range(8, 12_008))
    assert [r.id0 for r in sorted(got)[5:]] == list(range(5, 12_000))
    assert written[0].rdd.getNumPartitions() >= 20


def test_reports_are_shuffled_without_being_held_by_map_tasks(spark, monkeypatch, tmp_path):
    """No more partitions than Spark writes to directly, until a task would get five times its rows."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    written = []
    monkeypatch.setattr("attestor.operators.ledger.staged", lambda df, label: written.append(df) or session.staged(df, label))
    spark.range(3_000).selectExpr("id", "concat('s', id) AS session_id").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted(r.id for r in assign_ids(rows.drop("id"), ["session_id"]).select("id").collect()) == list(range(1, 3_001))
    assert 100 <= written[0].rdd.getNumPartitions() <= 200
    reviews = rows.selectExpr("session_id", "id AS review_no", "timestamp_ntz'2024-01-01 00:00:00' AS review_ts")
    assert review.apply_reviews(rows, reviews).rdd.getNumPartitions() <= 200
    assert session.shuffle_tasks_for(spark.range(1_500)) == 150
    assert session.shuffle_tasks_for(spark.range(20_000)) == 400
