import gzip
import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor.llm import warc

BIG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
ROWS = [
    (1, "http://a.example/1", BIG), (9, "http://a.example/9", BIG), (4, None, BIG), (2, "http://a.example/x\r\nEvil: yes", "short"),
    (3, "http://a.example/3", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (10, "u", "x" * 999),
    (11, "u", "x" * 999), (12, "u", "long " * 200_000), (None, "u", BIG),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string").withColumns({"payload": F.lit(0), "id": F.lit(1), "bytes": F.lit(2)})


def expected():
    out = []
    for key, _, html in ROWS:
        body = (html or "").encode()
        same = [k for k, _, h in ROWS if (h or "").encode() == body and k is not None]
        refers = max(same) if len(body) >= 1000 and same and key != max(same) else None
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return Counter(out)


def test_round_trip(pages):
    got = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected()
    uris = {r.page_id: r.uri for r in got}
    assert uris[4] is None and uris[2] == "http://a.example/x%0D%0AEvil: yes"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_normalised_archives_and_their_index(spark, pages, tmp_path):
    warc.write_archives(pages.repartition(1), str(tmp_path / "mono"), records=5)
    files = list((tmp_path / "mono").glob("*.gz"))
    assert len(files) > 1
    for file in files:  # monolithic: one gzip member a file
        unzip = zlib.decompressobj(31)
        unzip.decompress(file.read_bytes())
        assert unzip.eof and not unzip.unused_data
    warc.normalise(spark, str(tmp_path / "mono"), str(tmp_path / "out"))
    index = spark.read.parquet(str(tmp_path / "out" / "index")).collect()
    assert len(index) == len(ROWS)
    by_archive = {}
    for row in sorted(index, key=lambda r: (r.archive, r.offset)):
        data = open(row.archive, "rb").read()
        assert by_archive.get(row.archive, 0) == row.offset
        by_archive[row.archive] = row.offset + row.length
        record = gzip.decompress(data[row.offset : row.offset + row.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert f"WARC-Record-ID: {row.record_id}".encode() in record
        assert len(data) >= by_archive[row.archive]
    # Neither bytes nor order of records change.
    before = sorted(gzip.decompress(f.read_bytes()) for f in files)
    assert sorted(gzip.decompress(open(a, "rb").read()) for a in by_archive) == before
    payloads = warc.read_records(spark, str(tmp_path / "out"), per_task=4).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in payloads} == {(h or "").encode() for _, _, h in ROWS}


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_stream_of_records_in_any_chunks(step):
    records = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + b"\r\n" * (n // 2) + b"\r\n\r\n" for n in (0, 2, 10, 4000)]
    data = b"".join(records)
    chunks = (data[i : i + step] for i in range(0, len(data), step))
    assert [raw for _, raw in warc.RecordStream(chunks)] == records


def test_damaged_archives_fail(tmp_path):
    record = b"WARC/1.1\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    for name, data in (("cut", record[:-8]), ("head", record[:12]), ("other", b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.RecordStream(iter([data])))


def test_inflate_is_bounded_and_reads_members(tmp_path):
    import io

    data = [b"\0" * 50_000_000, b"second"]
    packed = b"".join(gzip.compress(d) for d in data)
    parts = list(warc.inflate(io.BytesIO(packed)))
    assert max(map(len, parts)) <= warc.CHUNK * 2 and b"".join(parts) == b"".join(data)
