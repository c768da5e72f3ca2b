"""Ledger operators: entries, ids and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attestor.session import shuffle_tasks_for, staged

_ROWS_PER_PARTITION_BITS = 33


def ledger_entries(auto: DataFrame, approved: DataFrame) -> DataFrame:
    """Everything that reaches the ledger: results passed at once and results approved later."""
    return auto.unionByName(approved, allowMissingColumns=True)


def assign_ids(df: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Consecutive ids after ``start`` in the given order, which should be unique.

    The rows are range-sorted in parts of bounded size, so a hot first key is split by the later
    ones, and staged with their place (partition, position). A second pass only adds the small table of
    partition offsets; no window ever holds the data in one task.
    """
    ordered = df.repartitionByRange(shuffle_tasks_for(df), *order).sortWithinPartitions(*order)
    placed = staged(ordered.withColumn("place", F.monotonically_increasing_id()), "ids")
    partition = F.shiftright("place", _ROWS_PER_PARTITION_BITS)
    position = F.col("place").bitwiseAND((1 << _ROWS_PER_PARTITION_BITS) - 1)
    sizes = placed.groupBy(partition.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    # One row per partition of the sort, at most a few thousand.
    return (
        placed.withColumn("part", partition)
        .join(F.broadcast(offsets), "part")
        .withColumn("id", start + F.col("offset") + position + 1)
        .drop("part", "offset", "place")
    )


def compliance_trend(ledger: DataFrame) -> DataFrame:
    """Audits and mean score per day, type, status and severity."""
    return ledger.groupBy(
        F.to_date("timestamp").alias("day"), "doc_type", "status", "severity"
    ).agg(F.count("*").alias("audits"), F.avg("compliance_score").alias("avg_score"))
