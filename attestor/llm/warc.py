"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_archives`` makes one WARC record per row and lets Spark's text writer compress every output
file as one gzip stream (monolithic: no record can be reached without inflating all before it).
``normalise`` inflates such a file once, as a stream, rewrites every record as a gzip member of its
own and notes where each member lies; the notes are the archive's sidecar index, a Parquet table
that Spark commits. ``read_records`` seeks to single members through that index.

Of records with equal payloads of at least ``least`` bytes, the one with the largest key is the
response and the others revisit it (payloads are equal if their SHA-256 and length are). A null
payload is empty. Rows that repeat the largest key are all responses. Null keys never win against
others; copies without any key are all responses, as there is nothing to refer to. A null URL is
left out of the header. Empty tables give no archives, an empty index and no rows.

Rewritten archives carry the attempt in their name and only committed index rows name them, so
lost or repeated tasks leave no wrong data. Memory: one record and one buffer per task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import Workspace, bounded_batches, whole_text

LEAST_BYTES = 1000
CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 18

INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, uri string"
RECORD = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


# --- writing -------------------------------------------------------------------------------


def with_types(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """Per row: key, url, payload, digest, bytes, refers_to (null for responses)."""
    rows = pages.select(F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), whole_text(payload).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("same", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.where(F.col("bytes") >= least)
    groups = large.groupBy("same", "bytes").agg(F.max("key").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    met = rows.join(groups.select("same", "bytes", "first"), ["same", "bytes"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return met.select(
        "id", "url", "payload", "bytes", F.sha1(F.col("payload").cast("binary")).alias("digest"),
        F.when(revisits, F.col("first").cast("string")).alias("refers_to"),
    )


def header_value(value: Column) -> Column:
    """Percent-encode what could end a header line."""
    value = F.regexp_replace(value, r"\r", "%0D")
    return F.regexp_replace(value, r"\n", "%0A")


def record_text(date: str) -> Column:
    """One record without its closing line breaks, which the text writer appends."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c, F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), header_value(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z", records: int = 100_000) -> None:
    """Write monolithic ``*.gz`` archives of at most ``records`` records each below ``path``."""
    typed = with_types(pages, key, url, payload, least)
    writer = typed.select(record_text(date).alias("value")).write.option("compression", "gzip")
    writer.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(path)


# --- normalising ---------------------------------------------------------------------------


class RecordStream:
    """Records of a WARC stream, each as (header lines, raw bytes), from chunks of bytes."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            searched = 0
            while (end := self.held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
                searched = len(self.held)
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record's header")
                    return
            head = bytes(self.held[:end]).decode("utf-8", "surrogateescape")
            fields = header_fields(head)
            size = end + 4 + int(fields["content-length"])
            while len(self.held) < size + 4:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            yield fields, bytes(self.held[: size + 4])
            del self.held[: size + 4]


def header_fields(head: str) -> dict[str, str]:
    version, *lines = head.split(CRLF)
    if not version.startswith("WARC/"):
        raise ValueError(f"no record starts with {version[:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def inflate(file) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a bounded chunk at a time."""
    unzip = zlib.decompressobj(31)
    data = b""
    while data or (data := file.read(CHUNK)):
        out = unzip.decompress(data, CHUNK)
        if out:
            yield out
        data = unzip.unconsumed_tail
        if unzip.eof:
            data = unzip.unused_data
            unzip = zlib.decompressobj(31)
    if rest := unzip.flush():
        yield rest


def member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def normalise(spark: SparkSession, path: str, out: str) -> None:
    """Rewrite every ``*.gz`` archive below ``path`` with one member a record, into ``out``.

    ``out/index`` becomes the sidecar index. One task rewrites one archive.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                yield from rewrite(source, out)

    files = names.count()
    rewritten = names.repartition(max(files, 1)).mapInArrow(run, INDEX)
    rewritten.write.parquet(f"{out}/index")


def rewrite(source: str, out: str) -> Iterator[pa.RecordBatch]:
    """Rewrite one archive; yields its index in batches of rows once the file is whole."""
    system, path = _system(source)
    stem = path.rsplit("/", 1)[1].split(".")[0]
    target = f"{out.rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}.warc.gz"
    to_system, to_path = _system(target)
    to_system.create_dir(to_path.rsplit("/", 1)[0], recursive=True)
    rows: list[tuple] = []
    at = 0
    with system.open_input_stream(path, compression=None) as file, to_system.open_output_stream(to_path, compression=None) as archive:
        for fields, record in RecordStream(inflate(file)):
            packed = member(record)
            archive.write(packed)
            rows.append((target, at, len(packed), fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri")))
            at += len(packed)
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for start in range(0, len(rows), 5000):
        columns = zip(*rows[start : start + 5000])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


# --- reading -------------------------------------------------------------------------------


def read_records(spark: SparkSession, out: str, per_task: int = 4000) -> DataFrame:
    """All records of normalised archives, read member by member through the sidecar index.

    A response's payload must have the digest its header names; a revisit has none.
    """
    bounded_batches(spark)
    index = spark.read.schema(INDEX).parquet(f"{out}/index")
    # Neighbouring members go to one task in order: blocks of an archive, dealt evenly.
    tasks = max(1, index.count() // per_task)
    ranges = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if opened is None or opened[0] != archive:
                    if opened:
                        opened[1].close()
                    system, path = _system(archive)
                    opened = (archive, system.open_input_file(path))
                opened[1].seek(offset)
                rows.append(parse(zlib.decompress(opened[1].read(length), 31)))
                held += len(rows[-1][-1] or b"")
                if held > 1 << 25:
                    yield _record_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _record_batch(rows)
        if opened:
            opened[1].close()

    return ranges.mapInArrow(run, RECORD)


def parse(record: bytes) -> tuple:
    """Fields of one whole record, and its payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = header_fields(head.decode("utf-8", "surrogateescape"))
    payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    size = int(fields["warc-payload-length"]) if revisit else len(payload)
    return (fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, None if revisit else payload)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in RECORD.split(", ")])


def key_of(record_id: Column, kind: str = "bigint") -> Column:
    """The key inside a record id made by ``write_archives``."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:record:(.*)>$", 1), F.lit("")).cast(kind)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write, normalise and read back; per row: key, payload_bytes, payload_digest, record_type,
    refers_to, uri."""
    spark = pages.sparkSession
    space = Workspace(spark, "warc")
    write_archives(pages, space.path("monolithic"), key, url, payload)
    space.paths["monolithic"] = space.path("monolithic")
    normalise(spark, space.path("monolithic"), space.path("archives"))
    space.close()
    kind = pages.schema[key].dataType.simpleString()
    records = read_records(spark, space.path("archives"))
    return records.select(
        key_of(F.col("record_id"), kind).alias(key), "payload_bytes", "payload_digest", "record_type",
        key_of(F.col("refers_to"), kind).alias("refers_to"), "uri",
    )
