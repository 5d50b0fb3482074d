"""Latest job status per entity from a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Job status meant by an event type.
STATUS_OF_EVENT = {
    "signup": "pending",
    "view": "processing",
    "click": "processing",
    "purchase": "completed",
    "error": "failed",
}


def status_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type) -> (entity_id, event_id, at, status)."""
    status = F.when(F.lit(False), F.lit(None).cast("string"))
    for event_type, name in STATUS_OF_EVENT.items():
        status = status.when(F.col("event_type") == event_type, F.lit(name))
    return events.select(
        F.col("user_id").alias("entity_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), status.alias("status")
    )


def latest_status(statuses: DataFrame) -> DataFrame:
    """One row per entity; works on a batch and, in update mode, on a stream.

    State is one row per entity.  The watermark drops events that arrive too
    late to matter but, with no time in the key, does not expire entities.
    """
    return statuses.groupBy("entity_id").agg(
        F.max_by("status", F.struct("at", "event_id")).alias("status"),
        F.max("at").alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def stream_job_status(events: DataFrame, path: str, checkpoint: str, *, watermark: str = "7 days") -> StreamingQuery:
    """Run the stream over what is there now; every batch writes its changed entities.

    A batch overwrites its own folder, so a batch repeated after a lost
    executor or driver leaves no second copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    updates = latest_status(status_events(events).withWatermark("at", watermark))
    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch: per entity, the row of its latest batch."""
    updates = spark.read.parquet(path)
    fields = ["status", "updated_at", "n_events"]
    return (
        updates.groupBy("entity_id")
        .agg(F.max_by(F.struct(*fields), "batch").alias("_last"))
        .select("entity_id", "_last.*")
    )
