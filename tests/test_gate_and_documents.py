import os.path

from pyspark.sql import functions as F

from attestor.functions import files
from attestor.operators import gate
from attestor.sources import documents

NAMES = ["a.txt", "a.tar.GZ", ".txt", "a.", ".a.txt", "dir.x/file", "dir/.txt", "plain", "..a", "UP.PDF", "x.y.jpeg"]


def test_extension_like_os_path(value_of):
    assert value_of(files.file_ext, NAMES) == [os.path.splitext(n)[1].lower() for n in NAMES]


def _uploads(spark, rows):
    return spark.createDataFrame(rows, "filename string, size_bytes bigint, declared_mime string, text string")


def test_first_failure_wins_and_split_is_complete(spark):
    rows = [
        ("ok.txt", 10, "text/plain", "hello"),
        ("malware.exe", 0, None, "x"),
        ("spoof.txt", 6291456, "image/png", "x"),
        ("large.txt", 6291456, "text/plain", "x"),
        ("edge.txt", 5242880, "text/plain", "x"),
        ("empty.txt", 0, "text/plain", ""),
        ("gone.txt", None, None, None),
        ("SCAN.PDF", 9, "application/pdf", " \n\t"),
        ("x'; DROP TABLE y.txt", 9, None, "x"),
    ]
    df = _uploads(spark, rows)
    reasons = {r.filename: r for r in gate.gate_reason(df).collect()}
    codes = {name: r.reject_code for name, r in reasons.items()}
    assert codes == {
        "ok.txt": None, "malware.exe": "extension", "spoof.txt": "mime", "large.txt": "size",
        "edge.txt": None, "empty.txt": "empty", "gone.txt": "missing", "SCAN.PDF": None,
        "x'; DROP TABLE y.txt": None,
    }
    assert reasons["malware.exe"].reject_detail == (
        "Unsupported file type: '.exe'. Allowed types: ['.jpeg', '.jpg', '.pdf', '.png', '.txt']"
    )
    assert reasons["large.txt"].reject_detail == "File too large: 6.00MB. Maximum allowed size is 5MB."
    df = df.unionByName(_uploads(spark, [(None, 3, None, "x"), ("s.txt", 3, "", None)]))
    rows += [None, None]
    accepted, rejected = gate.split_gate(df)
    reasons = {r.filename: r.reject_code for r in rejected.collect()}
    assert None not in reasons.values() and reasons[None] == "extension"
    assert [r.filename for r in gate.accepted_with_text(df).orderBy("filename").collect()] == [
        "edge.txt", "ok.txt", "x'; DROP TABLE y.txt"
    ]
    assert accepted.count() + rejected.count() == len(rows) and accepted.count() == 5
    guarded = {r.filename: r.reject_code for r in gate.guard_text(accepted).collect()}
    assert guarded["SCAN.PDF"] == "no_text" and guarded["ok.txt"] is None


def test_megabytes_round_half_to_even(spark):
    sizes = [0, 1, 5242881, 6291456, 6422528, 6553600, 10_000_000, 123_456_789]
    df = spark.createDataFrame([(s,) for s in sizes], "size bigint")
    shown = [r[0] for r in df.select(files.megabytes_text("size")).collect()]
    assert shown == [f"{s / 1048576:.2f}" for s in sizes]


def test_content_scan_decodes_strictly(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("un\r\ndeux\rtrois é\n".encode())
    (tmp_path / "sub" / "b.txt").write_bytes(b"bad \xff\xfe")
    (tmp_path / "zero.txt").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.scan_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "un\ndeux\ntrois é\n" and rows["a.txt"].is_valid
    assert rows["b.txt"].text is None and not rows["b.txt"].is_valid
    assert rows.get("zero.txt") is None or rows["zero.txt"].text == ""


def test_oversized_files_keep_a_row_but_are_not_read(spark, tmp_path):
    (tmp_path / "small.txt").write_bytes(b"hello")
    (tmp_path / "large.txt").write_bytes(b"x" * 5000)
    scan = documents.scan_documents(spark, str(tmp_path), "*.txt", max_bytes=100)
    rows = {r.path.rsplit("/", 1)[1]: (r.length, r.text, r.is_valid) for r in scan.collect()}
    assert rows == {"small.txt": (5, "hello", True), "large.txt": (5000, None, None)}
    codes = {r.path.rsplit("/", 1)[1]: r.reject_code for r in scan.collect()}
    assert codes == {"small.txt": None, "large.txt": "size"}
    assert documents.scan_documents(spark, str(tmp_path), "*.txt").where("text is null").count() == 0


def test_extraction_route(spark):
    df = _uploads(spark, [("a.txt", 1, None, ""), ("b.pdf", 1, None, "text"), ("c.PDF", 1, None, "  "), ("d.png", 1, None, None)])
    rows = {r.filename: (r.route, r.needs_ocr) for r in documents.extraction_route(df).collect()}
    assert rows == {"a.txt": ("text", False), "b.pdf": ("pdf_text", False), "c.PDF": ("ocr", True), "d.png": ("ocr", True)}


def test_rejected_uploads_have_no_route(spark):
    df = _uploads(spark, [("a.exe", 1, None, ""), ("d.png", 1, None, None), ("e.png", 0, None, None)])
    rows = {r.filename: (r.route, r.needs_ocr) for r in documents.extraction_route(gate.gate_reason(df)).collect()}
    assert rows == {"a.exe": (None, False), "d.png": ("ocr", True), "e.png": (None, False)}


def test_pages_in_order(spark):
    pages = [("hot", i, f"page {i}") for i in range(2500)] + [("cold", 1, "b"), ("cold", 0, "a"), ("cold", 2, ""), ("cold", 3, None)]
    pages += [("blank", 0, ""), ("blank", 1, None)]
    df = spark.createDataFrame(pages, "doc string, page int, text string").orderBy(F.rand(1))
    expected = {"hot": "\n".join(f"page {i}" for i in range(2500)), "cold": "a\nb", "blank": ""}
    whole = documents.assemble_pages(df, "doc", "page", "text").collect()
    assert {r.doc: r.text for r in whole} == expected and {r.reject_code for r in whole} == {None}
    # What no cell can hold is told, not cut.
    bounded = {r.doc: (r.text, r.reject_code) for r in documents.assemble_pages(df, "doc", "page", "text", cell_chars=5000).collect()}
    assert bounded == {"hot": (None, "too_long"), "cold": ("a\nb", None), "blank": ("", None)}


def test_recognised_text_only_fills_blank_uploads(spark):
    df = _uploads(spark, [("a.txt", 1, None, "own"), ("b.png", 1, None, None), ("c.png", 1, None, " ")]).withColumn("doc_id", F.ascii("filename"))
    back = spark.createDataFrame([(97, "other"), (98, "read")], "doc_id int, text string")
    rows = {r.filename: r.text for r in documents.with_ocr_text(df, back).collect()}
    assert rows == {"a.txt": "own", "b.png": "read", "c.png": " "}
