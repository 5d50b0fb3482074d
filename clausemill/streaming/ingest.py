"""Incremental ingestion: landed documents -> versions and clauses, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausemill.operators import clauses as cl
from clausemill.operators import clean
from clausemill.operators.versions import COMPLETED, EMPTY_DOCUMENT, FAILED, dedupe_documents, reject_empty

VERSIONS_TYPE = "version_id long, content_hash string, status string, error_code string, clause_count long"


def _ingest_batch(batch: DataFrame, batch_id: int, pages_of: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Write ``marked``, ``pages``, ``clauses`` and ``versions``, each below ``batch=N``.

    Earlier batches are the known content; a repeated batch reads the same
    ones and overwrites its own folders, so a retry changes nothing.  A
    document that cannot be split becomes a failed version, not a failed job.
    """
    spark = batch.sparkSession

    def kept(frame: DataFrame, name: str) -> DataFrame:
        """Written to the batch's folder once and read from there, so that later steps do not compute it again."""
        folder = f"{path}/{name}/batch={batch_id}"
        frame.write.mode("overwrite").parquet(folder)
        return spark.read.schema(frame.schema).parquet(folder)

    known = (
        spark.read.schema(VERSIONS_TYPE + ", batch long").parquet(f"{path}/versions").where(F.col("batch") < batch_id)
    )
    marked = kept(dedupe_documents(batch, known), "marked")
    fresh = marked.where(F.col("outcome").isin("new", "re-ingest"))
    pages = kept(pages_of(fresh.select(*batch.columns)), "pages")
    clauses = kept(cl.split_clauses(clean.clean_pages(pages)), "clauses")
    checked = reject_empty(pages, clauses.select("doc_id"))
    taken = marked.where(F.col("outcome").isin("new", "re-ingest", EMPTY_DOCUMENT)).select("doc_id", "content_hash")
    versions = taken.join(checked, "doc_id", "left").select(
        F.col("doc_id").alias("version_id"),
        "content_hash",
        F.when(F.col("status") == "ok", F.lit(COMPLETED)).otherwise(F.lit(FAILED)).alias("status"),
        F.when(F.col("status").isNull(), F.lit(EMPTY_DOCUMENT)).otherwise(F.col("error_code")).alias("error_code"),
        F.coalesce("n_clauses", F.lit(0)).cast("long").alias("clause_count"),
    )
    versions.write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")


def stream_ingest(
    documents: DataFrame, pages_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Ingest what has landed in a stream of documents(doc_id, content_hash, ...) and stop.

    ``pages_of`` turns a batch of documents into pages(doc_id, page_number,
    text).  The checkpoint makes the source hand over every file once.
    """
    spark = documents.sparkSession
    spark.createDataFrame([], VERSIONS_TYPE).write.mode("overwrite").parquet(f"{path}/versions/batch=-1")
    return (
        documents.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: _ingest_batch(batch, batch_id, pages_of, path))
        .start()
    )


def ingested_versions(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of every version."""
    rows = spark.read.schema(VERSIONS_TYPE + ", batch long").parquet(f"{path}/versions")
    return (
        rows.groupBy("version_id")
        .agg(F.max_by(F.struct("content_hash", "status", "error_code", "clause_count"), "batch").alias("_v"))
        .select("version_id", "_v.*")
    )
