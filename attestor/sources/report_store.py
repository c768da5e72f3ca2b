"""Rendered reports, one row per audit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attestor.operators.reports import report_texts


def write_reports(ledger: DataFrame, path: str) -> None:
    """One text report per audit, as rows: a file or folder each would be countless small files."""
    report_texts(ledger).write.mode("overwrite").parquet(path)
