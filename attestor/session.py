"""Session settings, the shared scratch folder and small planning helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is only ever broadcast after it was counted and measured against these.
BROADCAST_MAX_ROWS = 20_000
BROADCAST_MAX_CHARS = 16_000_000
# A row may grow to some kilobytes on its way; a task that sorts this many holds some hundred megabytes.
ROWS_PER_TASK = 100_000

_local_scratch: dict[str, str] = {}
# Scratch paths handed out, by application: the session owns them until ``drop_scratch``.
_handed_out: dict[str, list[str]] = {}


def build_session(app: str = "attestor", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is planned for.

    Shuffle partitions are left to the cluster: AQE merges small ones and splits skewed
    ones, so the initial number should be set high (several per core).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="attestor-")
    return _local_scratch[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder, never used before."""
    path = f"{scratch_dir(spark)}/attestor/{label}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this session; call it once their results have been used."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _handed_out.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame) -> int:
    """How many tasks row-heavy work on these rows should have: all cores busy, every task bounded."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def shuffle_tasks_for(df: DataFrame) -> int:
    """The same for stored rows that are shuffled with whole reports.

    With few enough partitions (``spark.shuffle.sort.bypassMergeThreshold``) a map task writes its rows
    straight to files. With more it holds all it reads, and one split takes in many files of well
    compressed reports. So there are more only where a task would get five times its rows.
    """
    context = df.sparkSession.sparkContext
    direct = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    wanted = tasks_for(df)
    return wanted if wanted <= direct else max(context.defaultParallelism, direct, -(-wanted // 5))


def spread(df: DataFrame) -> DataFrame:
    """Give row-heavy work enough tasks.

    Regular expressions over whole texts cost far more than moving the text once. A small
    table in one row group would be one task, and a few megabytes of narrow columns may become
    gigabytes of reports, so it is rows that tasks are counted by, not the bytes of their files.
    Rows are dealt out by a hash of all their columns (not by a key, which could be hot; a
    round-robin would sort all rows first). Input with enough splits is left alone.
    """
    wanted = tasks_for(df)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, F.xxhash64(*df.columns))


def read_spread(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Scan the given columns of a parquet table, spread for row-heavy work."""
    return spread(spark.read.parquet(path).select(*columns))


def small_side(df: DataFrame) -> DataFrame:
    """Mark a join side for broadcast if it is proven small; otherwise leave it to shuffle."""
    wide = df.select(F.to_json(F.struct("*")).alias("row")).limit(BROADCAST_MAX_ROWS + 1)
    rows, chars = wide.agg(F.count("*"), F.coalesce(F.sum(F.length("row")), F.lit(0))).first()
    fits = rows <= BROADCAST_MAX_ROWS and chars <= BROADCAST_MAX_CHARS
    return F.broadcast(df) if fits else df


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]
