"""Landed documents: content scan, manifest, extraction routing and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions.files import file_ext
from attestor.functions.text import is_blank
from attestor.session import column

# A text cell holds at most 2 GB, and a character takes up to four bytes.
CELL_CHARS = 500_000_000


def decoded_text(content: Column | str) -> Column:
    """Strict UTF-8 text with line ends made ``\\n``; null where the bytes are not UTF-8."""
    content = column(content)
    text = F.regexp_replace(F.decode(content, "UTF-8"), r"\r\n?", "\n")
    return F.when(F.is_valid_utf8(content.cast("string")), text)


def decode_documents(df: DataFrame, content: str = "content") -> DataFrame:
    """Add text and is_valid; undecodable rows keep a null text for the reject output."""
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    return df.withColumns({"text": decoded_text(content), "is_valid": valid})


def scan_documents(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """path, length, text, is_valid, reject_code of every landed file below ``path``.

    With ``max_bytes`` the size condition reaches the reader, so the content of a larger file is
    never read; such a file keeps its row with reject_code ``size``. Bytes that are not UTF-8 give
    ``encoding``. Zero-byte files do not appear in a content scan; sizes are judged on the manifest.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    wanted = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    read = decode_documents(wanted.select("path", "length", "content")).drop("content")
    read = read.withColumn("reject_code", F.when(~F.col("is_valid"), F.lit("encoding")))
    if max_bytes is None:
        return read
    refused = files.where(F.col("length") > max_bytes).select(
        "path", "length",
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("boolean").alias("is_valid"),
        F.lit("size").alias("reject_code"),
    )
    return read.unionByName(refused)


def manifest(src: DataFrame) -> DataFrame:
    """Uploads as the uploader listed them, with zero-byte and missing files (size null)."""
    return src.select(
        "doc_id", "filename", F.col("size_bytes").cast("bigint").alias("size_bytes"), "declared_mime"
    )


def extraction_route(df: DataFrame) -> DataFrame:
    """Add route and needs_ocr: text files and PDFs with embedded text are read, the rest is OCR
    work. An upload with a reject_code has no route."""
    ext = file_ext("filename")
    route = (
        F.when(ext == ".txt", F.lit("text"))
        .when((ext == ".pdf") & ~is_blank("text"), F.lit("pdf_text"))
        .otherwise(F.lit("ocr"))
    )
    if "reject_code" in df.columns:
        route = F.when(F.col("reject_code").isNull(), route)
    return df.withColumn("route", route).withColumn("needs_ocr", F.coalesce(F.col("route") == "ocr", F.lit(False)))


def assemble_pages(pages: DataFrame, key: str, order: str, text: str, cell_chars: int = CELL_CHARS) -> DataFrame:
    """One row per document: key, text (its pages joined in order, empty ones dropped), reject_code.

    A document whose pages are all empty has the text ``''``. Lengths are added up first, without
    texts; a document that no text cell can hold is not gathered at all but comes out with a null
    text and reject_code ``too_long``, so every group that is gathered is bounded.
    """
    rows = pages.select(F.col(key), F.col(order).alias("page"), F.col(text).alias("text"))
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint") + 1)
    too_long = rows.groupBy(key).agg(chars.alias("chars")).where(F.col("chars") > cell_chars).select(key)
    listed = F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("page", "text"))))
    joined = rows.join(too_long, key, "left_anti").groupBy(key).agg(
        F.array_join(F.transform(listed, lambda r: r["text"]), "\n").alias("text")
    )
    refused = too_long.select(key, F.lit(None).cast("string").alias("text"), F.lit("too_long").alias("reject_code"))
    return joined.withColumn("reject_code", F.lit(None).cast("string")).unionByName(refused)


def with_ocr_text(uploads: DataFrame, recognised: DataFrame, key: str = "doc_id") -> DataFrame:
    """Uploads with the text that came back for them (one row per key) where they had none."""
    back = recognised.select(F.col(key), F.col("text").alias("ocr_text"))
    joined = uploads.join(back, key, "left")
    text = F.when(is_blank("text"), F.coalesce("ocr_text", "text")).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*uploads.columns)
