"""Shared helpers: staged tables with an end of life, checked broadcasts, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import column, scratch_path

# A side of narrow fixed-width keys is broadcast only below this counted number of rows.
BROADCAST_KEYS = 400_000


class Workspace:
    """Tables staged in the shared scratch folder by one run of an operator.

    ``put`` writes a table once and reads it back, which cuts the lineage and survives lost
    executors. ``close`` removes what no later step reads; the tables named in ``keep`` feed
    the lazy result and stay.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = scratch_path(spark, label)
        self.paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path(name))
        self.paths[name] = self.path(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self, *keep: str) -> None:
        for name in [n for n in self.paths if n not in keep]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            target.getFileSystem(conf).delete(target, True)


def by_size(df: DataFrame) -> DataFrame:
    """Broadcast a staged table of narrow keys if its counted rows allow it, else shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hand Python tasks batches of bounded bytes: texts and sets are wide rows, and a batch is held
    at once. Sets the session's bound unless there is one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)


def hashed_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows, those of the lowest hashes of their key; all rows if there are no more.

    A threshold on the hash is a filter: no sort, and nothing is sent to the driver but a count.
    """
    n = rows.count()
    share = int(min(1.0, bound / max(n, 1)) * 2**32)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(2**32)) < share) if n > bound else rows


def whole_text(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(column(text).cast("string"), F.lit(""))


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of the text (null: empty), so Python tasks need not decode."""
    return whole_text(text).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
