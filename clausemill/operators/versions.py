"""Documents, versions and ingestion jobs: duplicates, current versions, retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import metadata as md
from clausemill.functions.text import strip

PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
EMPTY_DOCUMENT = "EMPTY_DOCUMENT"
MAX_ERROR_CHARS = 2000
MAX_TITLE_CHARS = 500
MAX_TYPE_CHARS = 50


def dedupe_documents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Mark incoming(doc_id, content_hash, ...) rows whose content is known already.

    ``existing`` is (version_id, content_hash, status, clause_count).  Adds
    ``existing_version_id``, ``existing_clause_count``, ``first_doc_id`` (the
    document of this batch that carries the content) and ``outcome``: a
    completed version makes the row a 'duplicate', a version in any other
    state a 're-ingest', another row of the batch a 'duplicate_in_batch', all
    else is 'new'; a row without a hash has no content and is an
    'EMPTY_DOCUMENT'.  Of several versions with a content a completed one
    counts, then the lowest id.  The per-hash values come from a map-side
    aggregate, so a hash shared by many rows shuffles as a few.
    """
    completed_first = F.struct(F.coalesce(F.col("status") != COMPLETED, F.lit(True)).alias("open"), "version_id")
    known = existing.groupBy("content_hash").agg(
        F.min_by(F.struct("version_id", "clause_count", "status"), completed_first).alias("_known")
    )
    first = incoming.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc_id"))
    per_hash = first.join(known, "content_hash", "left")
    return incoming.join(per_hash, "content_hash", "left").select(
        *[F.col(c) for c in incoming.columns],
        F.col("_known.version_id").alias("existing_version_id"),
        F.when(F.col("_known.status") == COMPLETED, F.col("_known.clause_count")).alias("existing_clause_count"),
        "first_doc_id",
        F.when(F.col("content_hash").isNull(), F.lit(EMPTY_DOCUMENT))
        .when(F.col("_known.status") == COMPLETED, F.lit("duplicate"))
        .when(F.col("doc_id") != F.col("first_doc_id"), F.lit("duplicate_in_batch"))
        .when(F.col("_known").isNotNull(), F.lit("re-ingest"))
        .otherwise(F.lit("new"))
        .alias("outcome"),
    )


def upload_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads whose content exists in whatever state; an upload never re-ingests."""
    return incoming.join(existing.select("content_hash"), "content_hash", "left_semi")


def regulation_key(regulator_code: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", regulator_code, title), 256)


def resolve_regulation(requests: DataFrame, regulations: DataFrame) -> DataFrame:
    """Find each request(regulator_code, title, document_type) or give it a new key.

    Titles are compared whole; ``new_regulations`` cuts them for storage.  Adds
    ``regulation_id`` (text) and ``created``; equal requests share a key.
    """
    keyed = requests.withColumn("_title", F.col("title"))
    found = regulations.groupBy(F.col("regulator_code"), F.col("title").alias("_title")).agg(
        F.min("regulation_id").cast("string").alias("_found")
    )
    return keyed.join(found, ["regulator_code", "_title"], "left").select(
        *[F.col(c) for c in requests.columns],
        F.coalesce("_found", regulation_key(F.col("regulator_code"), F.col("_title"))).alias("regulation_id"),
        F.col("_found").isNull().alias("created"),
    )


def new_regulations(
    resolved: DataFrame, *, title_chars: int = MAX_TITLE_CHARS, type_chars: int = MAX_TYPE_CHARS
) -> DataFrame:
    """Rows to append, one per created key; title and type are cut to what the store holds."""
    return (
        resolved.where("created")
        .groupBy("regulation_id", "regulator_code")
        .agg(
            F.min(F.substring("title", 1, title_chars)).alias("title"),
            F.min(F.substring("document_type", 1, type_chars)).alias("document_type"),
        )
    )


def regulator_dimension(codes: DataFrame, regulators: DataFrame) -> DataFrame:
    """Regulators to insert for (regulator_code, extracted_jurisdiction) rows not yet present."""
    name = F.when(F.lit(False), F.lit(None).cast("string"))
    place = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, (full, where) in md.REGULATORS.items():
        name = name.when(F.col("regulator_code") == code, F.lit(full))
        place = place.when(F.col("regulator_code") == code, F.lit(where))
    distinct = codes.groupBy("regulator_code").agg(F.min("extracted_jurisdiction").alias("_extracted"))
    return distinct.join(
        regulators.select(F.col("code").alias("regulator_code")), "regulator_code", "left_anti"
    ).select(
        F.col("regulator_code").alias("code"),
        F.coalesce(name, F.col("regulator_code")).alias("name"),
        F.coalesce(place, "_extracted", F.lit("GLOBAL")).alias("jurisdiction"),
    )


def mark_current_version(versions: DataFrame) -> DataFrame:
    """The newest version of a regulation is current, all others are not (ties: highest id)."""
    newest = versions.groupBy("regulation_id").agg(F.max(F.struct("created_at", "version_id")).alias("_top"))
    return versions.drop("is_current").join(newest, "regulation_id").select(
        *[F.col(c) for c in versions.columns if c != "is_current"],
        (F.col("version_id") == F.col("_top.version_id")).alias("is_current"),
    )


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The most recent job of each entity (ties: highest job id), by a map-side aggregate."""
    fields = [c for c in jobs.columns if c != "entity_id"]
    return (
        jobs.groupBy("entity_id")
        .agg(F.max_by(F.struct(*fields), F.struct("created_at", "job_id")).alias("_job"))
        .select("entity_id", "_job.*")
    )


def finish_jobs(results: DataFrame, jobs: DataFrame, *, error_chars: int = MAX_ERROR_CHARS) -> DataFrame:
    """Final state per version of results(version_id, clause_count, error).

    Failed when there is an error or nothing was persisted; the error text is
    cut to ``error_chars`` characters, which the store holds, and goes to the version and its latest job alike.
    """
    nothing = F.lit("Pipeline reported success but no clauses were persisted to the database")
    error = F.substring(
        F.coalesce("error", F.when(F.coalesce("clause_count", F.lit(0)) == 0, nothing)), 1, error_chars
    )
    latest = latest_jobs(jobs).select(F.col("entity_id").alias("version_id"), "job_id")
    return results.join(latest, "version_id", "left").select(
        "version_id",
        "job_id",
        F.when(error.isNull(), F.lit(COMPLETED)).otherwise(F.lit(FAILED)).alias("status"),
        error.alias("error_message"),
        F.coalesce("clause_count", F.lit(0)).alias("clause_count"),
    )


def retry_candidates(
    versions: DataFrame, jobs: DataFrame, files: DataFrame, *, version_ids: Sequence | None = None
) -> DataFrame:
    """Versions to re-queue and those skipped because no source file is left.

    Without ids every pending or failed version is taken.  A version's file is
    its storage path or, failing that, ``<version_id>.pdf``; ``files`` is a
    listing (path).  The latest job is retried once more, or a job is created.
    """
    wanted = (
        versions.where(F.col("version_id").isin(list(version_ids)))
        if version_ids
        else versions.where(F.col("status").isin(PENDING, FAILED))
    )
    own = files.select(F.col("path").alias("storage_path"), F.lit(True).alias("_own")).distinct()
    fallback = files.select(F.col("path").alias("_fallback_path"), F.lit(True).alias("_other")).distinct()
    latest = latest_jobs(jobs).select(F.col("entity_id").alias("version_id"), "job_id", "retry_count")
    located = (
        wanted.withColumn("_fallback_path", F.concat(F.col("version_id").cast("string"), F.lit(".pdf")))
        .join(own, "storage_path", "left")
        .join(fallback, "_fallback_path", "left")
        .join(latest, "version_id", "left")
    )
    path = F.when(F.col("_own"), F.col("storage_path")).when(F.col("_other"), F.col("_fallback_path"))
    requeue = path.isNotNull()
    return located.select(
        "version_id",
        F.when(requeue, F.lit("requeued")).otherwise(F.lit("skipped")).alias("action"),
        F.when(requeue, F.lit(PENDING)).otherwise(F.col("status")).alias("status"),
        F.when(~requeue, F.concat(F.col("version_id").cast("string"), F.lit(" (PDF file not found on disk)"))).alias("reason"),
        F.when(requeue, F.coalesce("storage_path", path)).otherwise(F.col("storage_path")).alias("storage_path"),
        F.when(requeue, F.col("job_id")).alias("job_id"),
        F.when(requeue, F.when(F.col("job_id").isNull(), F.lit(0)).otherwise(F.coalesce("retry_count", F.lit(0)) + 1)).alias(
            "retry_count"
        ),
    )


def reject_empty(pages: DataFrame, clauses: DataFrame) -> DataFrame:
    """(doc_id, n_pages, status, error_code) per document of a batch."""
    filled = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.bool_or(strip(F.coalesce("text", F.lit(""))) != "").alias("_filled"),
    )
    counts = clauses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"))
    error = F.when(~F.col("_filled"), F.lit(EMPTY_DOCUMENT)).when(
        F.coalesce("n_clauses", F.lit(0)) == 0, F.lit("CLAUSE_SPLITTING_FAILED")
    )
    return filled.join(counts, "doc_id", "left").select(
        "doc_id",
        "n_pages",
        F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"),
        F.when(error.isNull(), F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
        error.alias("error_code"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals over results(failed, duplicate, clauses_created, embeddings_created).

    A duplicate counts as processed but adds no clauses or embeddings.
    """
    fresh = ~F.col("failed") & ~F.col("duplicate")
    return results.agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(~F.col("failed")).alias("processed"),
        F.count_if(F.col("failed")).alias("failed"),
        F.coalesce(F.sum(F.when(fresh, F.col("clauses_created"))), F.lit(0)).alias("clauses_created"),
        F.coalesce(F.sum(F.when(fresh, F.col("embeddings_created"))), F.lit(0)).alias("embeddings_created"),
        F.count_if(~F.col("failed") & F.col("duplicate")).alias("duplicates_skipped"),
    )
