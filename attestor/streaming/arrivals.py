"""Continuous audit: documents arrive, are gated, masked, audited and routed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from attestor.plans.audit import audit_uploads
from attestor.session import spread
from attestor.sources.ledger_store import append_ledger


# A backlog is worked off in micro-batches of this many files.
FILES_PER_BATCH = 1000


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Parquet files as they land below ``path`` (a folder or a glob), oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def continuous_audit(
    uploads: DataFrame, catalogue: list[Row], out: str, checkpoint: str, auto_approve: bool = False, ledger: str | None = None
) -> StreamingQuery:
    """Audit every micro-batch and keep the results, and append those not held to the ledger.

    The audit is row-local, so the stream needs no state. Each batch is audited once into
    ``out/results/batch_id=n/route=…``, which a repeat overwrites; the ledger part is read back from
    there. ``ledger`` (default ``out/ledger``) may be shared with other writers; the checkpoint
    names this one, so a batch repeated after a failure is not appended again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        results = audit_uploads(spread(batch), catalogue, auto_approve)
        place = f"{out}/results/batch_id={batch_id}"
        results.write.mode("overwrite").partitionBy("route").parquet(place)
        stored = batch.sparkSession.read.schema(results.schema).parquet(place)
        auto = stored.where("route = 'auto'").withColumnRenamed("received_at", "timestamp")
        append_ledger(auto, ledger or f"{out}/ledger", f"audit {checkpoint}", batch_id)

    return (
        uploads.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def audited_so_far(spark: SparkSession, out: str) -> DataFrame:
    """All results of a continuous audit, with batch_id and route."""
    return spark.read.parquet(f"{out}/results")


def held_so_far(spark: SparkSession, out: str, schema: StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The results that a continuous audit holds for review, as a stream: also those it holds from
    now on. ``schema`` is that of the results without ``route``."""
    return arrivals(spark, f"{out}/results/batch_id=*/route=pending", schema, files_per_batch)
