"""From pages to stored clauses and policy chunks, for whole batches of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import metadata as md
from clausemill.operators import clean, embed
from clausemill.operators import clauses as cl
from clausemill.session import saved


@dataclass(frozen=True)
class IngestResult:
    clauses: DataFrame
    metadata: DataFrame


def document_metadata(cleaned: DataFrame, files: DataFrame, **options) -> DataFrame:
    """(doc_id, meta) for once-cleaned pages; the text is cleaned once more for this.

    files(doc_id, filename); pages without a document have no file.  ``options``
    go to ``with_overrides``.
    """
    cleaned = cleaned.where(F.col("doc_id").isNotNull())
    joined = clean.clean_document(cleaned, passes=1, known_ids=True).join(files.select("doc_id", "filename"), "doc_id")
    extracted = joined.select("doc_id", md.document_metadata(F.col("text"), F.col("filename"), F.col("n_pages")).alias("meta"))
    return extracted.select("doc_id", md.with_overrides(F.col("meta"), **options).alias("meta"))


def enrich_clauses(clauses: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the 21-field metadata struct; the section falls back to the document's."""
    return clauses.join(metadata, "doc_id").select(
        F.col("doc_id").alias("version_id"),
        "clause_number",
        "seq",
        F.coalesce(F.nullif("section", F.lit("")), "meta.section").alias("section"),
        F.nullif("title", F.lit("")).alias("title"),
        "text",
        "page_number",
        "page_end",
        md.clause_metadata(
            F.col("meta"),
            document_id=F.col("doc_id").cast("string"),
            clause_number=F.col("clause_number"),
            parent=F.col("parent_clause"),
            section=F.col("section"),
            title=F.col("title"),
            level=F.col("level"),
            page_number=F.col("page_number"),
            page_end=F.col("page_end"),
        ).alias("metadata"),
    )


def ingest_regulations(
    pages: DataFrame, files: DataFrame, *, embedder=None, dim: int = embed.DEFAULT_DIMENSION, **options
) -> IngestResult:
    """Clean, split, describe, de-duplicate and embed all documents of a batch.

    Merging comes before embedding, so every clause is embedded once, from the
    text it is stored with.  Pages without a document have no metadata, so their
    clauses are in no result.  Cleaned pages are written once: read by two
    branches, the pages would be made, shuffled and cleaned for each.
    """
    known = pages.where(F.col("doc_id").isNotNull())
    cleaned = saved(clean.clean_pages(known, known_ids=True).select("doc_id", "page_number", "text"), "cleaned-pages")
    metadata = document_metadata(cleaned, files, **options)
    enriched = enrich_clauses(cl.split_clauses(cleaned, cleaned=True), metadata)
    merged = embed.merge_regulatory_clauses(enriched)
    return IngestResult(embed.embed_documents(merged, embedder=embedder, dim=dim), metadata)


def ingest_policies(pages: DataFrame, documents: DataFrame, *, embedder=None, dim: int = embed.DEFAULT_DIMENSION) -> DataFrame:
    """Embedded policy chunks; documents(doc_id, organization_id, document_name, document_type, version)."""
    chunks = cl.chunk_policy(cl.split_clauses(clean.clean_pages(pages)))
    described = chunks.join(documents, "doc_id").withColumn(
        "metadata",
        F.col("metadata")
        .withField("document_type", F.col("document_type"))
        .withField("document_name", F.col("document_name"))
        .withField("version", F.col("version")),
    )
    rows = described.select(
        F.col("doc_id").alias("document_id"),
        "organization_id",
        "chunk_index",
        "section_title",
        "clause_reference",
        "content",
        "metadata",
    )
    return embed.embed_documents(rows, text_col="content", embedder=embedder, dim=dim)
