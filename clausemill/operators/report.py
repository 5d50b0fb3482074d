"""Document-level compliance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.numbers import round_exact
from clausemill.operators.knn import knn_join_exact
from clausemill.operators.scans import numbered
from clausemill.operators.search import search_limit, text_fallback_match
from clausemill.session import saved

DOCUMENT = ("organization_id", "document_id")
PAIR_KEY = ("organization_id", "policy_document_id", "policy_clause_id", "regulatory_clause_id")

# Scores and texts of the document-level match.
STATUS_CUT = 0.75
ALIGNED_SCORE, PARTIAL_SCORE, TEXT_MATCH_SIMILARITY = 88.0, 60.0, 0.91
VECTOR_EXPLANATION = (
    "The policy language is semantically aligned with the regulatory requirement "
    "and provides relevant evidence for compliance review."
)
TEXT_EXPLANATION = (
    "The policy language aligns with the regulatory requirement and provides relevant evidence for compliance."
)
UNCOVERED_REQUIREMENT = "No sufficiently relevant organization policy clause found."
UNCOVERED_REASON = "No relevant clause matched the requirement above the configured threshold."

COUNTED = {
    "compliant_count": ("COMPLIANT",),
    "partially_compliant_count": ("PARTIALLY_COMPLIANT",),
    "non_compliant_count": ("NON_COMPLIANT",),
    "not_determinable_count": ("NOT_DETERMINABLE", "NO_RELEVANT_REGULATION_FOUND"),
}


def document_clauses(requests: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks of the requested documents, refused requests with an error code).

    requests(organization_id, document_id).  Order of a document's chunks is
    (chunk_index, chunk_id), given as ``position``.
    """
    docs = documents.select(
        "document_id", F.col("organization_id").alias("_owner"), F.col("status").alias("_status"), "document_name"
    )
    checked = requests.join(docs, "document_id", "left").withColumn(
        "error",
        F.when(F.col("_owner").isNull(), F.lit("NOT_FOUND"))
        .when(F.col("_owner") != F.col("organization_id"), F.lit("WRONG_ORGANIZATION"))
        .when(F.col("_status") != "processed", F.lit("NOT_PROCESSED")),
    )
    refused = checked.where(F.col("error").isNotNull()).select(*DOCUMENT, "error")
    accepted = checked.where(F.col("error").isNull()).select(*DOCUMENT, "document_name")
    return accepted.join(chunks, list(DOCUMENT)), refused


def positions(chunks: DataFrame, *, chunks_per_segment: int = 65536) -> DataFrame:
    """1-based reading position of each chunk of a document."""
    cut = chunks.withColumn("_segment", F.floor(F.col("chunk_index") / chunks_per_segment))
    return numbered(
        cut, group=DOCUMENT, segment="_segment", order=["chunk_index", "chunk_id"], name="position"
    ).drop("_segment")


def match_document_clauses(
    chunks: DataFrame, clauses: DataFrame, *, top_k: int | None = None, status_cut: float = STATUS_CUT
) -> DataFrame:
    """Every chunk against all embedded clauses: no threshold, no organisation, no status.

    The request's similarity threshold has no effect here, so there is no such
    parameter.
    """
    limit = search_limit(top_k)
    hits = knn_join_exact(
        chunks.select(F.col("chunk_id").alias("left_id"), F.col("embedding").alias("vector")),
        clauses.select(F.col("clause_id").alias("right_id"), F.col("embedding").alias("vector")),
        limit,
    )
    aligned = F.col("matching_score") >= status_cut
    return hits.select(
        F.col("left_id").alias("chunk_id"),
        F.col("right_id").alias("regulatory_clause_id"),
        F.col("similarity").alias("matching_score"),
        "rank",
    ).select(
        "*",
        F.when(aligned, F.lit(ALIGNED_SCORE)).otherwise(F.lit(PARTIAL_SCORE)).alias("compliance_score"),
        F.when(aligned, F.lit("COMPLIANT")).otherwise(F.lit("PARTIALLY_COMPLIANT")).alias("status"),
        F.lit(VECTOR_EXPLANATION).alias("explanation"),
        F.lit("REGULATION").alias("source"),
    )


def fallback_classification(text_hits: DataFrame, clauses: DataFrame, versions: DataFrame, regulations: DataFrame) -> DataFrame:
    """Fixed scores for text hits; the source is the regulation's title where it is known."""
    titled = (
        clauses.select("clause_id", "version_id")
        .join(versions.select("version_id", "regulation_id"), "version_id", "left")
        .join(regulations.select("regulation_id", "title"), "regulation_id", "left")
        .select("clause_id", "title")
    )
    return text_hits.join(titled, "clause_id", "left").select(
        "chunk_id",
        F.col("clause_id").alias("regulatory_clause_id"),
        F.lit(TEXT_MATCH_SIMILARITY).alias("matching_score"),
        "rank",
        F.lit(ALIGNED_SCORE).alias("compliance_score"),
        F.lit("COMPLIANT").alias("status"),
        F.lit(TEXT_EXPLANATION).alias("explanation"),
        F.coalesce("title", F.lit("REGULATION")).alias("source"),
    )


def match_with_fallback(
    chunks: DataFrame,
    clauses: DataFrame,
    versions: DataFrame,
    regulations: DataFrame,
    *,
    top_k: int | None = None,
    status_cut: float = STATUS_CUT,
) -> DataFrame:
    """Vector matches, and text matches for chunks that have none (no vector, or no clause has one).

    The vector matches are written once, when the function is called, and read by both branches.
    """
    by_vector = saved(match_document_clauses(chunks, clauses, top_k=top_k, status_cut=status_cut), "vector-matches")
    unmatched = chunks.join(by_vector.select("chunk_id").distinct(), "chunk_id", "left_anti")
    by_text = fallback_classification(
        text_fallback_match(unmatched, clauses, top_k=top_k), clauses, versions, regulations
    )
    return by_vector.unionByName(by_text)


def skip_irrelevant(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") != "NO_RELEVANT_REGULATION_FOUND")


def _summary() -> list[Column]:
    status = F.upper("status")
    return [
        F.count("status").alias("total_requirements"),
        *[F.count_if(status.isin(*names)).alias(column) for column, names in COUNTED.items()],
    ]


def overall_score(score: Column) -> Column:
    """Mean of the known scores on two decimals; null when none is known."""
    return round_exact(F.avg(score), 2)


def report_summary(results: DataFrame) -> DataFrame:
    return results.groupBy(*DOCUMENT).agg(*_summary(), overall_score(F.col("compliance_score")).alias("overall_score"))


def high_risk_findings(results: DataFrame) -> DataFrame:
    """Non-compliant rows, lowest score first within a document.

    The sort is by range, which may cut inside a document, so a document with
    very many findings is not one task.
    """
    score = F.coalesce("compliance_score", F.lit(0.0))
    return (
        results.where(F.upper("status") == "NON_COMPLIANT")
        .select(
            *DOCUMENT,
            "chunk_id",
            "regulatory_clause_id",
            "status",
            score.alias("compliance_score"),
            F.lit("HIGH").alias("severity"),
            F.col("explanation").alias("issue"),
        )
        .orderBy(*DOCUMENT, "compliance_score", "chunk_id", "regulatory_clause_id")
    )


def uncovered_requirements(document_chunks: DataFrame, results: DataFrame) -> DataFrame:
    """One placeholder per document that has chunks but not one matched clause."""
    return (
        document_chunks.select(*DOCUMENT)
        .distinct()
        .join(results.where(F.col("regulatory_clause_id").isNotNull()).select(*DOCUMENT), list(DOCUMENT), "left_anti")
        .select(
            *DOCUMENT,
            F.lit(UNCOVERED_REQUIREMENT).alias("regulatory_requirement"),
            F.lit(UNCOVERED_REASON).alias("reason"),
            F.lit("HIGH").alias("severity"),
        )
    )


def document_report(requested: DataFrame, document_chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per requested(organization_id, document_id, document_name).

    A document without chunks gets a zero report with neither score nor name.
    The per-row results stay in their own table, keyed by document; a report
    carries counts and score, so no cell grows with a document's size.
    """
    placed = document_chunks.select(*DOCUMENT, "chunk_id")
    results = skip_irrelevant(matches).join(placed, "chunk_id")
    summary = report_summary(results)
    uncovered = uncovered_requirements(document_chunks, results).select(*DOCUMENT, F.lit(1).alias("uncovered_count"))
    sizes = placed.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("n_chunks"))
    zero = F.lit(0).cast("long")
    return (
        requested.join(sizes, list(DOCUMENT), "left")
        .join(summary, list(DOCUMENT), "left")
        .join(uncovered, list(DOCUMENT), "left")
        .select(
            *DOCUMENT,
            F.when(F.col("n_chunks").isNotNull(), F.col("document_name")).alias("document_name"),
            "overall_score",
            F.coalesce("total_requirements", zero).alias("total_requirements"),
            *[F.coalesce(c, zero).alias(c) for c in COUNTED],
            F.coalesce(F.col("uncovered_count").cast("long"), zero).alias("uncovered_count"),
        )
    )


def assessments_from_matches(matches: DataFrame, document_chunks: DataFrame) -> DataFrame:
    """Rows to store, one per (organisation, document, policy clause, regulatory clause)."""
    return skip_irrelevant(matches).join(document_chunks.select(*DOCUMENT, "chunk_id"), "chunk_id").select(
        "organization_id",
        F.col("document_id").alias("policy_document_id"),
        F.col("chunk_id").alias("policy_clause_id"),
        "regulatory_clause_id",
        F.coalesce("matching_score", F.lit(0.0)).alias("matching_score"),
        "compliance_score",
        "status",
        "explanation",
        F.lit("document-compliance-v1").alias("analysis_version"),
        F.lit("document-compliance-service").alias("model_name"),
        F.when(F.col("compliance_score").isNotNull(), F.lit(1.0)).alias("confidence_score"),
        F.lit(1).alias("rank"),
    )


def insert_if_absent(stored: DataFrame, fresh: DataFrame, key: tuple[str, ...] = PAIR_KEY) -> DataFrame:
    """Rows of ``fresh`` whose key is not stored, one per key; stored rows stay as they are."""
    columns = [c for c in fresh.columns if c not in key]
    one = fresh.groupBy(*key).agg(F.min(F.struct(*columns)).alias("_row")).select(*key, "_row.*")
    return one.join(stored.select(*key), list(key), "left_anti").select(*fresh.columns)


def report_from_history(documents: DataFrame, assessments: DataFrame) -> DataFrame:
    """Reports rebuilt from stored assessments; nothing is ever uncovered here."""
    stored = assessments.withColumnRenamed("policy_document_id", "document_id")
    zero = F.lit(0).cast("long")
    return documents.join(report_summary(stored), list(DOCUMENT), "left").select(
        *DOCUMENT,
        "document_name",
        "overall_score",
        F.coalesce("total_requirements", zero).alias("total_requirements"),
        *[F.coalesce(c, zero).alias(c) for c in COUNTED],
        zero.alias("uncovered_count"),
    )
