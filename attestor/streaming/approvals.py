"""Continuous approval: results are held, reviews arrive, and each held session is decided once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestor import fixed_values as V
from attestor.functions.text import utc_now
from attestor.operators.review import apply_override, approved_results, first_review, with_reviews
from attestor.session import shuffle_tasks_for
from attestor.sources.ledger_store import append_ledger

# The open sessions: who waits since which micro-batch (-1: since before the stream) and time.
OPEN = "session_id string, held_in bigint, held_at timestamp_ntz"


class _Tables:
    """The tables of one approval stream; every micro-batch has a folder that a repeat overwrites."""

    def __init__(self, spark: SparkSession, out: str, batch_id: int) -> None:
        self.spark, self.out, self.batch_id = spark, out, batch_id

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.out}/{name}/batch_id={self.batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def open_before(self, held: DataFrame | None) -> DataFrame:
        """Sessions open after the micro-batch before this one, or at the start."""
        if self.batch_id:
            return self.spark.read.schema(OPEN).parquet(f"{self.out}/open/batch_id={self.batch_id - 1}")
        if held is None:
            return self.spark.createDataFrame([], OPEN)
        return held.select("session_id", F.lit(-1).cast("bigint").alias("held_in"), utc_now().alias("held_at"))

    def forget(self, name: str) -> None:
        """Remove what no repeat can ask for any more: all versions but the last two."""
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}/batch_id={self.batch_id - 2}")
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def decide(tables: _Tables, reviews: DataFrame, new: DataFrame | None, table: DataFrame | None, expiry: str | None) -> DataFrame:
    """Decide the sessions that these reviews take; the approved results.

    ``new`` are the results held since the last micro-batch, ``table`` those held before the stream.
    """
    held = tables.open_before(table)
    if new is not None:
        # The payload is stored once; what is carried on from batch to batch are the names.
        stored = tables.put("held", new)
        fresh = stored.select("session_id", F.lit(tables.batch_id).cast("bigint").alias("held_in"), utc_now().alias("held_at"))
        held = held.unionByName(fresh).groupBy("session_id").agg(F.min(F.struct("held_in", "held_at")).alias("first")).select("session_id", "first.*")
    over = F.lit(False) if expiry is None else F.col("held_at") < utc_now() - F.expr(f"INTERVAL {expiry}")
    waiting = tables.put("waiting", held.withColumn("expired", over))
    alive = waiting.where("not expired").drop("expired")
    first = tables.put("taken", first_review(reviews).join(alive.select("session_id", "held_in"), "session_id"))
    tables.put("open", alive.join(first.select("session_id"), "session_id", "left_anti"))
    tables.put("expired", waiting.where("expired").drop("expired"))
    taken = first.drop("held_in")
    rest = reviews.join(taken.select("session_id", "review_no"), ["session_id", "review_no"], "left_anti")
    tables.put("unknown", rest.withColumn("error", F.lit(V.NO_SESSION)))
    if new is None:
        found = with_reviews(table, taken, ["session_id"], max(shuffle_tasks_for(table), shuffle_tasks_for(taken)))
    else:
        # Only the micro-batches that hold a taken session are read.
        whole = tables.spark.read.schema(new.withColumn("batch_id", F.lit(0).cast("bigint")).schema).parquet(f"{tables.out}/held")
        named = first.withColumnRenamed("held_in", "batch_id")
        those = whole.join(F.broadcast(named.select("batch_id").distinct()), "batch_id", "left_semi")
        tasks = max(shuffle_tasks_for(those), shuffle_tasks_for(named))
        found = with_reviews(those, named, ["session_id", "batch_id"], tasks).drop("batch_id").dropDuplicates(["session_id"])
    approved, refused = apply_override(found)
    tables.put("refused", refused)
    for name in ("open", "waiting"):
        tables.forget(name)
    return tables.put("approved", approved_results(approved))


def continuous_approval(
    reviews: DataFrame, held: DataFrame, out: str, checkpoint: str, ledger: str | None = None, expiry: str | None = None
) -> StreamingQuery:
    """Decide held sessions as their reviews arrive.

    ``held`` is a stream of held results (``arrivals.held_so_far``), whose sessions can be approved as
    soon as they are held, or a stored table of them. Within a micro-batch results come before reviews
    and the earliest review by time and number wins, between micro-batches the one that came
    first. A result that nobody reviewed for the interval ``expiry`` ("30 days") is given up.

    A micro-batch reads the open sessions, not what was ever decided: their names are a table that each
    micro-batch writes anew, and it shrinks as sessions are decided. Written as well, below
    ``batch_id=n`` and overwritten by a repeat: ``held`` (new results), ``taken``, ``approved`` (results
    with their final values), ``refused`` (the override was no valid status; the session is gone all
    the same), ``unknown`` (no such session, or no more) and ``expired``. Approved results are
    appended to ``ledger`` (default ``out/ledger``), which may be shared with other writers.
    """
    given = F.struct(*reviews.columns)
    events = reviews.select(given.alias("review"))
    if held.isStreaming:
        events = events.unionByName(held.select(F.struct(*held.columns).alias("result")), allowMissingColumns=True)

    def store(batch: DataFrame, batch_id: int) -> None:
        tables = _Tables(batch.sparkSession, out, batch_id)
        own = batch.where("review is not null").select("review.*")
        new = batch.where("result is not null").select("result.*") if held.isStreaming else None
        results = decide(tables, own, new, None if held.isStreaming else held, expiry)
        append_ledger(results, ledger or f"{out}/ledger", f"approval {checkpoint}", batch_id)

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
