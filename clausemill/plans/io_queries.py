"""Sources, sinks and batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import metadata as md
from clausemill.operators import clean, versions
from clausemill.operators import clauses as cl
from clausemill.plans import inputs as inp
from clausemill.plans.metadata_queries import META, SQL_READABLE
from clausemill.plans.registry import query, table, with_ctes
from clausemill.session import work_dir
from clausemill.sources import files, sinks


def _uploads(spark, folder):
    """documents -> (filename, content, length): most start like a PDF, some are empty or too long."""
    k = F.col("doc_id")
    name = inp.file_name(k, F.col("source"))
    content = (
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 13 == 0, F.lit(None).cast("string"))
        .when(k % 2 == 0, F.concat(F.lit("%PDF"), F.col("text")))
        .otherwise(F.col("text"))
    )
    rows = table(spark, folder, "documents").select("doc_id", name.alias("filename"), content.cast("binary").alias("content"))
    return rows.withColumn("length", F.length("content").cast("long"))


_ERRORS = """CASE WHEN content IS NULL THEN 'PDF file not found: ''' || filename || ''''
  WHEN NOT ends_with(lower(filename), '.pdf') THEN 'Unsupported file type. Only PDF uploads are accepted.'
  WHEN length = 0 THEN 'Uploaded file is empty' WHEN length > 3000 THEN 'Uploaded file exceeds the maximum size of 3000 bytes'
  WHEN content[1:4] <> '%PDF' THEN 'Uploaded file is not a valid PDF' END"""


@query(
    "src_binary_validate",
    with_ctes(
        {
            "uploads": f"""
  SELECT *, strlen(content) AS length FROM (SELECT doc_id, {inp.SQL_FILE_NAME} AS filename,
    CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '%PDF' || text ELSE text END AS content
  FROM documents) d""",
        },
        f"""SELECT doc_id, filename, length, CASE WHEN {_ERRORS} IS NULL THEN 'valid' ELSE 'invalid' END AS status, {_ERRORS} AS error FROM uploads""",
    ),
)
def src_binary_validate(spark, folder):
    return files.validate_uploads(_uploads(spark, folder), max_bytes=3000)


@query("src_pages", with_ctes(inp.RAW_PAGES, "SELECT doc_id, page_number, text, count(*) OVER (PARTITION BY doc_id) AS total_pages FROM raw_pages"))
def src_pages(spark, folder):
    return files.with_total_pages(inp.regulation_pages(spark, folder)).drop("source")


@query(
    "src_reject_empty",
    with_ctes(
        {
            **inp.CLAUSES,
            "blanked": """
  SELECT doc_id, page_number, text FROM raw_pages
  UNION ALL SELECT doc_id + 10000000, 1, ' ' || chr(10) FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT doc_id + 20000000, 1, 'short' FROM documents WHERE doc_id % 10 = 1""",
            "found": "SELECT doc_id, count(*) AS n FROM clause_rows GROUP BY 1",
        },
        """SELECT b.doc_id, b.n_pages, coalesce(f.n, 0) AS n_clauses, CASE WHEN NOT filled OR coalesce(f.n, 0) = 0 THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN NOT filled THEN 'EMPTY_DOCUMENT' WHEN coalesce(f.n, 0) = 0 THEN 'CLAUSE_SPLITTING_FAILED' END AS error_code
FROM (SELECT doc_id, count(*) AS n_pages, bool_or(trim(text, ' ' || chr(10)) <> '') AS filled FROM blanked GROUP BY 1) b
LEFT JOIN found f ON f.doc_id = b.doc_id""",
    ),
)
def src_reject_empty(spark, folder):
    """All documents, and further ones without text or without a clause."""
    pages = inp.regulation_pages(spark, folder).select("doc_id", "page_number", "text")
    k = F.col("doc_id")
    more = table(spark, folder, "documents").where((k % 10).isin(0, 1)).select(
        F.when(k % 10 == 0, k + 10_000_000).otherwise(k + 20_000_000).alias("doc_id"),
        F.lit(1).cast(pages.schema["page_number"].dataType).alias("page_number"),
        F.when(k % 10 == 0, F.lit(" \n")).otherwise(F.lit("short")).alias("text"),
    )
    pages = pages.unionByName(more)
    return versions.reject_empty(pages, cl.split_clauses(clean.clean_pages(pages)))


@query(
    "src_manifest",
    f"""SELECT doc_id, filename, CASE WHEN doc_id % 4 = 0 THEN 'Title ' || doc_id END AS title,
  coalesce(CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN 'SEBI' END, 'RBI') AS regulator,
  coalesce(CASE WHEN doc_id % 4 = 0 THEN 'circular' END, 'regulatory_document') AS source_type
FROM (SELECT doc_id, doc_id || ' ' || {inp.SQL_FILE_NAME} AS filename FROM documents)""",
)
def src_manifest(spark, folder):
    """The manifest is written as JSON and read back through the manifest reader."""
    k = F.col("doc_id")
    name = F.concat(k.cast("string"), F.lit(" "), inp.file_name(k, F.col("source")))
    listed = table(spark, folder, "documents").select("doc_id", name.alias("filename"))
    manifest = listed.where(k % 4 == 0).select(
        "filename",
        F.concat(F.lit("Title "), k.cast("string")).alias("title"),
        F.when(k % 3 != 0, F.lit("SEBI")).alias("regulator"),
        F.lit("circular").alias("source_type"),
    )
    path = work_dir(spark, "manifest")
    manifest.write.json(path)
    return files.apply_manifest(listed, files.read_manifest(spark, path, multi_line=False))


def _records(spark, folder):
    """One record per regulation text, in the layout of the clause files."""
    texts = inp.regulation_texts(spark, folder)
    meta = texts.select("doc_id", "filename", "text", md.document_metadata(F.col("text"), F.col("filename"), windows=md.HEAD).alias("m"))
    number = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(".1"))
    return meta.select(
        md.readable_clause_id(F.col("m.regulator"), F.col("m.document_name"), number).alias("id"),
        F.lit("").alias("chapter"),
        number.alias("clause_number"),
        F.lit(2).alias("level"),
        F.lit("").alias("parent_clause"),
        "text",
        F.coalesce("m.regulator", F.lit("")).alias("regulator"),
        F.coalesce("m.document_name", F.lit("")).alias("document_name"),
        F.coalesce("m.document_type", F.lit("")).alias("document_type"),
        F.coalesce("m.effective_date", F.lit("")).alias("effective_date"),
        F.lit(None).cast("int").alias("page_number"),
        F.concat((F.col("doc_id") % 20).cast("string"), F.lit("_clauses.json")).alias("filename"),
    )


@query(
    "snk_clause_json",
    with_ctes(
        META,
        f"""SELECT {SQL_READABLE} || '-' || (doc_id % 9) || '.1' AS id, (doc_id % 9) || '.1' AS clause_number, text,
  coalesce(regulator, '') AS regulator, coalesce(effective_date, '') AS effective_date, (doc_id % 20) || '_clauses.json' AS filename FROM doc_meta""",
    ),
)
def snk_clause_json(spark, folder):
    path = work_dir(spark, "clause-json")
    sinks.write_clause_json(_records(spark, folder), path)
    schema = "id string, clause_number string, text string, regulator string, effective_date string, filename string"
    return spark.read.schema(schema).json(path)


@query(
    "snk_clauses_replace",
    with_ctes(
        inp.CATALOG,
        """SELECT version_id, clause_id, CASE WHEN version_id % 3 = 0 THEN 'new ' || text ELSE text END AS text
FROM stored_clauses WHERE version_id % 3 <> 0 OR (clause_id % 2 = 0 AND version_id % 2 = 0)""",
    ),
)
def snk_clauses_replace(spark, folder):
    path = work_dir(spark, "clauses")
    stored = inp.stored_clauses(spark, folder).select("version_id", "clause_id", "text")
    sinks.replace_version_clauses(stored, path, batch="first")
    # Every third version is ingested again; odd ones among them yield no clause any more.
    batch = stored.where(F.col("version_id") % 3 == 0)
    again = batch.where((F.col("clause_id") % 2 == 0) & (F.col("version_id") % 2 == 0))
    changed = again.withColumn("text", F.concat(F.lit("new "), F.col("text")))
    for _ in range(2):  # a repeated run changes nothing
        sinks.replace_version_clauses(changed, path, batch, batch="second")
    return sinks.version_clauses(spark, path, "version_id long, clause_id long, text string")


@query(
    "snk_chunks",
    with_ctes(
        inp.ORG,
        """SELECT organization_id, document_id, chunk_index, content FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY content) AS rn FROM org_chunks) k WHERE rn = 1""",
    ),
)
def snk_chunks(spark, folder):
    path = work_dir(spark, "chunks")
    rows = inp.org_chunks(spark, folder).select("document_id", "chunk_index", "content", "organization_id")
    schema = "document_id long, chunk_index int, content string, organization_id long"
    sinks.append_chunks(rows.where(F.col("document_id") % 2 == 0), path, batch="first")
    for _ in range(2):  # a repeated run changes nothing
        sinks.append_chunks(rows, path, batch="second")
    return sinks.stored_chunks(spark, path, schema)


@query(
    "snk_vector_upsert",
    """SELECT entity AS id, payload, batch_no, position FROM (
  SELECT user_id AS entity, event_type AS payload, CAST(event_id // 500 AS INTEGER) AS batch_no, event_id AS position,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e WHERE rn = 1""",
)
def snk_vector_upsert(spark, folder):
    points = table(spark, folder, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("payload"),
        F.floor(F.col("event_id") / 500).cast("int").alias("batch_no"),
        F.col("event_id").alias("position"),
    )
    first, later = points.where("batch_no = 0"), points.where("batch_no > 0")
    return sinks.upsert_vectors(first, later)


@query(
    "ingest_batch_summary",
    """SELECT count(*) AS discovered, count(*) FILTER (NOT failed) AS processed, count(*) FILTER (failed) AS failed,
  CAST(coalesce(sum(n) FILTER (NOT failed AND NOT dup), 0) AS BIGINT) AS clauses_created,
  CAST(coalesce(sum(n) FILTER (NOT failed AND NOT dup), 0) AS BIGINT) AS embeddings_created, count(*) FILTER (NOT failed AND dup) AS duplicates_skipped
FROM (SELECT doc_id % 7 = 0 AS failed, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS dup, n_chars % 50 AS n FROM documents)""",
)
def ingest_batch_summary(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("content_hash"))
    none = docs.limit(0).select(
        F.col("doc_id").alias("version_id"), "content_hash", F.lit("").alias("status"), F.lit(0).alias("clause_count")
    )
    marked = versions.dedupe_documents(docs, none)
    created = F.col("n_chars") % 50
    return versions.batch_summary(
        marked.select(
            (F.col("doc_id") % 7 == 0).alias("failed"),
            (F.col("outcome") == "duplicate_in_batch").alias("duplicate"),
            created.alias("clauses_created"),
            created.alias("embeddings_created"),
        )
    )
