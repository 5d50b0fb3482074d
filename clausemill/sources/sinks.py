"""Writers.  All are idempotent: a retried job leaves the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.sources.commits import COMMIT, CommitLog

# The fields of a clause record file, in order.
CLAUSE_RECORD = (
    "id", "chapter", "clause_number", "level", "parent_clause", "text", "regulator",
    "document_name", "document_type", "effective_date", "page_number", "filename",
)


def write_clause_json(records: DataFrame, path: str) -> None:
    """JSON clause records, one folder per source file."""
    records.select(*CLAUSE_RECORD).write.mode("overwrite").partitionBy("filename").json(path)


def replace_version_clauses(clauses: DataFrame, path: str, versions: DataFrame | None = None, *, batch: str | None = None) -> bool:
    """Replace all clauses of the versions in the batch, leave other versions alone.

    ``versions`` (version_id) names the batch's versions: those without any
    clause now lose the clauses they had.  Clauses and versions become visible
    in one step; False, and nothing written, if ``batch`` was committed before.
    Null is a version like any other.
    """
    named = clauses.select("version_id")
    if versions is not None:
        named = named.unionByName(versions.select("version_id"))
    tables = {"clauses": clauses, "versions": named.distinct()}
    return CommitLog(clauses.sparkSession, path).commit(batch or uuid.uuid4().hex, tables)


def version_clauses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored clauses: of every version those of the last batch that named it."""
    log = CommitLog(spark, path)
    rows = log.read("clauses", schema)
    kind = rows.schema["version_id"].dataType.simpleString()
    last = log.read("versions", f"version_id {kind}").groupBy("version_id").agg(F.max(COMMIT).alias("_last"))
    last = last.withColumnRenamed("version_id", "_version")
    current = rows.join(last, F.col("version_id").eqNullSafe(F.col("_version")) & (F.col(COMMIT) == F.col("_last")))
    return current.select(*[c for c in rows.columns if c != COMMIT])


def compact_version_clauses(spark: SparkSession, path: str, schema: str) -> None:
    """Write the stored clauses as one new batch, so that readers need none of the older ones; then drop those."""
    log = CommitLog(spark, path)
    rows = version_clauses(spark, path, schema)
    log.commit(f"compact-{uuid.uuid4().hex}", {"clauses": rows, "versions": rows.select("version_id").distinct()}, full=True)
    log.clean()


def unique_chunks(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Chunks to append: one per (document_id, chunk_index), none that is stored."""
    key = ["document_id", "chunk_index"]
    rest = [c for c in fresh.columns if c not in key]
    one = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*").select(*fresh.columns)
    return one if stored is None else one.join(stored.select(*key), key, "left_anti")


def append_chunks(chunks: DataFrame, path: str, *, batch: str | None = None) -> bool:
    """Store the chunks that are not stored yet; False, and nothing written, if ``batch`` was committed before.

    Rows lie in the order of their organisation within a file, so a scan for one skips the rest.
    """
    spark = chunks.sparkSession
    log = CommitLog(spark, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    fresh = unique_chunks(log.read("chunks", schema).drop(COMMIT), chunks)
    return log.commit(batch or uuid.uuid4().hex, {"chunks": fresh.sortWithinPartitions("organization_id")})


def stored_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return CommitLog(spark, path).read("chunks", schema).drop(COMMIT)


def upsert_vectors(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Points by id after an upsert: the batch replaces vector and payload as a whole.

    Both sides carry ``batch_no``; the highest wins (within a batch the highest
    ``position``).  max_by combines map-side, so a hot id costs no large group.
    """
    fields = [c for c in stored.columns if c != "id"]
    both = stored.unionByName(batch.select(*stored.columns))
    return (
        both.groupBy("id")
        .agg(F.max_by(F.struct(*fields), F.struct("batch_no", "position")).alias("_p"))
        .select("id", "_p.*")
    )
