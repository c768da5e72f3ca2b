"""File-name and size predicates of the upload gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.session import column

# Last dot-suffix of the last path element; leading dots do not start a suffix.
EXTENSION = r"[^/.][^/]*(\.[^/.]*)$"


def file_ext(filename: Column | str) -> Column:
    """Lower-case extension with its dot, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(column(filename), F.lit("")), EXTENSION, 1))


def ext_allowed(ext: Column | str) -> Column:
    return column(ext).isin(*V.ALLOWED_EXTENSIONS)


def expected_mime(ext: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.MIME_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(table, column(ext))


def mime_mismatch(ext: Column | str, mime: Column | str) -> Column:
    """Both types known and different; an unknown type on either side passes."""
    differs = (column(mime) != "") & (expected_mime(ext) != column(mime))
    return F.coalesce(differs, F.lit(False))


def too_large(size_bytes: Column | str) -> Column:
    return column(size_bytes) > V.MAX_FILE_MB * V.BYTES_PER_MB


def is_empty(size_bytes: Column | str) -> Column:
    return column(size_bytes) == 0


def megabytes_text(size_bytes: Column | str) -> Column:
    """Size in MB with two decimals, halves to even, from integers only."""
    hundredths = F.bround(column(size_bytes) * 100 / V.BYTES_PER_MB, 0).cast("bigint")
    whole = F.floor(hundredths / 100).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
