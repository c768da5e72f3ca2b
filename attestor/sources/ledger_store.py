"""The append-only audit ledger: batches of several writers, ordered by a commit log.

A batch is written first and committed afterwards. A commit claims the next number of the log and with
it the ids that follow those of the commit before, so ids are unique and without gaps whoever writes.
The claim is a file that must not exist yet: of two writers that want the same number one gets it
and the other takes the next. A writer's batch is committed once; a repeat after a failure finds its
own commit and adds nothing, and nobody ever writes over another's rows.

Every commit states its first id, its rows and its range of times. Lookups read that manifest, which is
put together again every ``COMPACT`` commits, and then only the batches that can hold what they want.
"""

from __future__ import annotations

import json
import threading
import uuid
from bisect import bisect_right
from collections import defaultdict
from dataclasses import asdict, dataclass
from datetime import datetime
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions.text import utc_now
from attestor.operators.ledger import assign_ids
from attestor.session import small_side

LEDGER = (
    "id bigint, timestamp timestamp_ntz, filename string, doc_type string, status string, "
    "severity string, full_report string, compliance_score int, batch_id bigint"
)
COMPACT = 64
# File systems without an atomic rename (a local disk) are guarded within this process.
_locks: dict[str, threading.Lock] = defaultdict(threading.Lock)


@dataclass(frozen=True)
class Commit:
    """One committed batch: its number in the log, who wrote it, where, and what it holds."""

    version: int
    writer: str
    batch: int
    folder: str
    start: int
    rows: int
    earliest: str | None
    latest: str | None

    @property
    def last(self) -> int:
        return self.start + self.rows


class _Log:
    """The commit log of one ledger in any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.root = self._at("_commits")
        self.system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        if not self.system.exists(self.root):
            return []
        return sorted(f.getPath().getName() for f in self.system.listStatus(self.root))

    def _lines(self, name: str) -> list[Commit]:
        stream = self.system.open(self._at(f"_commits/{name}"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Commit(**json.loads(line)) for line in text.splitlines() if line]

    def commits(self) -> list[Commit]:
        """All commits in order: the newest compacted file, then the single ones behind it."""
        names = self._names()
        compacted = [n for n in names if n.endswith(".all")]
        found = self._lines(compacted[-1]) if compacted else []
        done = len(found)
        for name in names:
            if name.endswith(".json") and int(name.partition(".")[0]) > done:
                found += self._lines(name)
        return found

    def _write(self, name: str, commits: list[Commit]) -> bool:
        """Put a file in place unless there is one; it is whole as soon as it is seen."""
        target, draft = self._at(f"_commits/{name}"), self._at(f"_commits/.{name}-{uuid.uuid4().hex}")
        out = self.system.create(draft, True)
        out.write(bytearray("".join(json.dumps(asdict(c)) + "\n" for c in commits), "utf-8"))
        out.close()
        with _locks[self.path]:
            placed = not self.system.exists(target) and self.system.rename(draft, target)
        if not placed:
            self.system.delete(draft, False)
        return placed

    def claim(self, writer: str, batch: int, folder: str, rows: int, earliest: str | None, latest: str | None) -> Commit | None:
        """The batch's commit; None if the writer has committed this batch before."""
        while True:
            known = self.commits()
            if any((c.writer, c.batch) == (writer, batch) for c in known):
                return None
            commit = Commit(len(known) + 1, writer, batch, folder, known[-1].last if known else 0, rows, earliest, latest)
            if self._write(f"{commit.version:012d}.json", [commit]):
                if commit.version % COMPACT == 0:
                    self._write(f"{commit.version:012d}.all", [*known, commit])
                return commit


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The ledger's manifest; empty for a ledger that does not exist."""
    return _Log(spark, path).commits()


def _rows_of(spark: SparkSession, path: str, wanted: list[Commit]) -> DataFrame:
    """The rows of these commits, with their ids."""
    stored = LEDGER.replace(", batch_id bigint", "").replace("id bigint", "place bigint")
    filled = [c for c in wanted if c.rows]
    if not filled:
        return spark.createDataFrame([], LEDGER).withColumn("report", F.try_parse_json("full_report"))
    root = f"{path.rstrip('/')}/data"
    # One row a commit, by the folder that each row comes from.
    starts = spark.createDataFrame([(c.folder, c.start, c.version) for c in filled], "folder string, start bigint, batch_id bigint")
    rows = spark.read.schema(f"{stored}, folder string").option("basePath", root).parquet(*[f"{root}/folder={c.folder}" for c in filled])
    named = rows.join(small_side(starts), "folder").withColumn("id", F.col("start") + F.col("place"))
    return named.select("id", *[c for c in spark.createDataFrame([], LEDGER).columns if c != "id"]).withColumn("report", F.try_parse_json("full_report"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows with the report parsed to VARIANT; an absent ledger is empty."""
    return _rows_of(spark, path, commits(spark, path))


def ledger_rows(results: DataFrame) -> DataFrame:
    """Results in ledger form: defaults filled, the whole report serialised."""
    given = set(results.columns)
    stamp = F.coalesce("timestamp", utc_now()) if "timestamp" in given else utc_now()
    return results.select(
        *[c for c in ("id", "doc_id") if c in given],
        stamp.alias("timestamp"),
        F.coalesce("filename", F.lit("unknown")).alias("filename"),
        "doc_type",
        "status",
        F.coalesce("severity", F.lit("LOW")).alias("severity"),
        F.to_json("full_report").alias("full_report"),
        F.col("full_report.compliance_score").cast("int").alias("compliance_score"),
    )


def append_ledger(results: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Append one writer's batch of stored results; False if the ledger holds that batch already.

    Sorting samples its input first, so results should be read from a table (as those of an audit
    are); they are written once with their place in the batch and once as the ledger. Rows know their
    place, the commit knows the first id: a batch that loses a claim need not be written again.

    A batch's files follow the time order, so parquet statistics prune lookups by time without a
    folder per day, which would leave many small files. The score is stored typed beside the JSON,
    so trends never parse reports.
    """
    spark = results.sparkSession
    if any((c.writer, c.batch) == (writer, batch) for c in commits(spark, path)):
        return False
    stamp = F.coalesce("timestamp", utc_now()) if "timestamp" in results.columns else utc_now()
    rows = results.select("doc_id", stamp.alias("timestamp"), "filename", "doc_type", "status", "severity", "full_report")
    numbered = ledger_rows(assign_ids(rows, ["timestamp", "doc_id"])).drop("doc_id").withColumnRenamed("id", "place")
    folder = uuid.uuid4().hex
    place = f"{path.rstrip('/')}/data/folder={folder}"
    numbered.write.parquet(place)
    stored = spark.read.schema(numbered.schema).parquet(place)
    n, earliest, latest = stored.agg(F.count("*"), F.min("timestamp").cast("string"), F.max("timestamp").cast("string")).first()
    return _Log(spark, path).claim(writer, batch, folder, n, earliest, latest) is not None


def ledger_by_id(ledger: DataFrame, log_id: int) -> DataFrame:
    """The one row with this id, or none."""
    return ledger.where(F.col("id") == log_id)


def find_by_id(spark: SparkSession, path: str, log_id: int) -> DataFrame:
    """The same from the stored ledger: only the batch that holds the id is read."""
    return ledger_by_id(_rows_of(spark, path, [c for c in commits(spark, path) if c.start < log_id <= c.last]), log_id)


def latest_logs(ledger: DataFrame, limit: int = V.LOG_LIMIT_DEFAULT) -> DataFrame:
    """The newest audits; a limit outside 1..100 is an error. Equal times go by id."""
    if not V.LOG_LIMIT_MIN <= limit <= V.LOG_LIMIT_MAX:
        raise ValueError(f"limit must be between {V.LOG_LIMIT_MIN} and {V.LOG_LIMIT_MAX}")
    return ledger.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def find_latest(spark: SparkSession, path: str, limit: int = V.LOG_LIMIT_DEFAULT) -> DataFrame:
    """The same from the stored ledger: batches are read whose times can be among the newest.

    A batch is out once other batches hold enough rows that are all later than its latest.
    """
    known = sorted((c for c in commits(spark, path) if c.rows), key=lambda c: datetime.fromisoformat(c.earliest))
    begins = [datetime.fromisoformat(c.earliest) for c in known]
    # Rows of this batch and of all that begin after it.
    rows_from = [*accumulate(c.rows for c in reversed(known))][::-1] + [0]
    wanted = [c for c in known if rows_from[bisect_right(begins, datetime.fromisoformat(c.latest))] < limit]
    return latest_logs(_rows_of(spark, path, wanted), limit)
