"""Batch runs over a list of expected files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import fixed_values as V


def batch_status(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Every expected file with its outcome; a missing file or an error is told in words.

    The message shows the start of the error, the whole of it stands beside.
    """
    outcome = results.select("doc_id", "status", "severity", "violations", "error")
    joined = manifest.join(outcome.withColumn("audited", F.lit(True)), "doc_id", "left")
    message = (
        F.when(F.col("audited").isNull() | F.col("size_bytes").isNull(), F.lit(V.NO_FILE))
        .when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.substring("error", 1, 40)))
    )
    return joined.select(
        "doc_id",
        "filename",
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
        F.coalesce(F.size("violations"), F.lit(0)).alias("violation_count"),
        message.alias("message"),
        "error",
    )


def batch_summary(status: DataFrame) -> DataFrame:
    """Files and violations per status, severity and message."""
    return status.groupBy("status", "severity", "message").agg(
        F.count("*").alias("files"), F.sum("violation_count").alias("violations")
    )
