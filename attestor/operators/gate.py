"""Upload gate: first failing check, split, and the guard against documents without text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions import files
from attestor.functions.text import is_blank


def _checks(ext: Column) -> list[tuple[str, Column, Column]]:
    """(code, failing condition, message) in the order the checks apply."""
    name, size, mime = F.col("filename"), F.col("size_bytes"), F.col("declared_mime")
    return [
        (
            "extension",
            ~files.ext_allowed(ext),
            F.concat(F.lit("Unsupported file type: '"), ext, F.lit(f"'. Allowed types: {V.ALLOWED_TEXT}")),
        ),
        (
            "mime",
            files.mime_mismatch(ext, mime),
            F.concat(
                F.lit("File type mismatch: '"), name, F.lit("' claims to be '"), ext,
                F.lit("' but content suggests '"), mime, F.lit("'. Possible spoofing attempt."),
            ),
        ),
        ("missing", size.isNull(), F.lit(V.NO_FILE)),
        (
            "size",
            files.too_large(size),
            F.concat(
                F.lit("File too large: "), files.megabytes_text(size),
                F.lit(f"MB. Maximum allowed size is {V.MAX_FILE_MB}MB."),
            ),
        ),
        (
            "empty",
            files.is_empty(size),
            F.concat(
                F.lit("Uploaded file '"), name,
                F.lit("' is empty (0 bytes). Please upload a valid document."),
            ),
        ),
    ]


def gate_reason(df: DataFrame) -> DataFrame:
    """Add reject_code and reject_detail of the first failing check; null where all pass."""
    code = F.lit(None).cast("string")
    detail = F.lit(None).cast("string")
    for name, fails, message in reversed(_checks(files.file_ext("filename"))):
        code = F.when(fails, F.lit(name)).otherwise(code)
        detail = F.when(fails, message).otherwise(detail)
    return df.withColumns({"reject_code": code, "reject_detail": detail})


def passes_gate() -> Column:
    """All checks passed, as plain conditions: the size bounds reach the parquet scan."""
    ext = files.file_ext("filename")
    size = F.col("size_bytes")
    return (
        (size > 0)
        & (size <= V.MAX_FILE_MB * V.BYTES_PER_MB)
        & files.ext_allowed(ext)
        & ~files.mime_mismatch(ext, F.col("declared_mime"))
    )


def split_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons); together they are the input."""
    passed = F.coalesce(passes_gate(), F.lit(False))
    return df.where(passes_gate()), gate_reason(df.where(~passed))


def accepted_with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Uploads that pass the gate and hold text: the input of masking and audit.

    The outer explode keeps the test of the text where it is: pushed below an exchange it would make a
    derived text twice, and there in as few tasks as the files have splits.
    """
    row = F.explode_outer(F.array(F.struct(*df.columns))).alias("row")
    return df.where(passes_gate()).select(row).select("row.*").where(~is_blank(text))


def guard_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the reject reason of documents without text, after any earlier reason."""
    blank = is_blank(text)
    code = F.when(blank, F.lit("no_text"))
    detail = F.when(
        blank, F.concat(F.lit("No text could be extracted from '"), F.col("filename"), F.lit("'."))
    )
    if "reject_code" in df.columns:
        code, detail = F.coalesce("reject_code", code), F.coalesce("reject_detail", detail)
    return df.withColumns({"reject_code": code, "reject_detail": detail})
