"""Masking over document tables and the profile of what was masked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.masking import mask_report, removed_sql
from attestor.functions.text import blank_sql


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by the columns of the masking report."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, mask_report(text).alias("masking_report")).select(*kept, "masking_report.*")


def redaction_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents per tag and the characters that the tag's own pass removed from them.

    Blank texts are not masked. The outer explode keeps the optimizer from testing the list
    for emptiness below the masking, which would mask every text twice.
    """
    removed = F.expr(f"CASE WHEN NOT {blank_sql(text)} THEN {removed_sql(text)} END")
    return (
        docs.select(F.explode_outer(removed).alias("r"))
        .where(F.col("r").isNotNull())
        .groupBy("r.tag")
        .agg(F.count("*").alias("documents"), F.sum("r.removed").alias("chars_removed"))
    )
