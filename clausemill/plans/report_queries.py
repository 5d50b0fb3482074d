"""Document-level reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import report
from clausemill.plans import inputs as inp
from clausemill.plans.registry import query, table, with_ctes
from clausemill.session import saved

CUT = inp.POLICY_CUT

_REQUESTS = {
    **inp.ORG,
    "requests": """
  SELECT DISTINCT organization_id, document_id FROM org_chunks
  UNION ALL SELECT DISTINCT organization_id + 1, document_id FROM org_chunks WHERE document_id % 5 = 0
  UNION ALL SELECT n_nationkey, 1000 + n_nationkey FROM nation""",
}


def _requests(spark, folder):
    """Every document by its owner, some by a stranger, some that do not exist."""
    own = inp.org_chunks(spark, folder).select("organization_id", "document_id").distinct()
    strange = own.where(F.col("document_id") % 5 == 0).withColumn("organization_id", F.col("organization_id") + 1)
    missing = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("organization_id"),
        (F.col("n_nationkey") + 1000).cast("long").alias("document_id"),
    )
    return own.unionByName(strange).unionByName(missing)


def _accepted(spark, folder):
    return report.document_clauses(
        _requests(spark, folder), inp.org_documents(spark, folder), inp.org_chunks(spark, folder)
    )


@query(
    "document_clauses",
    with_ctes(
        _REQUESTS,
        """SELECT r.organization_id, r.document_id, k.chunk_id, k.chunk_index,
  row_number() OVER (PARTITION BY r.organization_id, r.document_id ORDER BY k.chunk_index, k.chunk_id) AS position
FROM requests r JOIN org_documents d ON d.document_id = r.document_id AND d.organization_id = r.organization_id AND d.status = 'processed'
JOIN org_chunks k ON k.document_id = r.document_id AND k.organization_id = r.organization_id""",
    ),
)
def document_clauses(spark, folder):
    rows, _ = _accepted(spark, folder)
    return report.positions(rows).select("organization_id", "document_id", "chunk_id", "chunk_index", "position")


@query(
    "document_clauses_refused",
    with_ctes(
        _REQUESTS,
        """SELECT r.organization_id, r.document_id, CASE WHEN d.document_id IS NULL THEN 'NOT_FOUND'
  WHEN d.organization_id <> r.organization_id THEN 'WRONG_ORGANIZATION' ELSE 'NOT_PROCESSED' END AS error
FROM requests r LEFT JOIN org_documents d ON d.document_id = r.document_id
WHERE d.document_id IS NULL OR d.organization_id <> r.organization_id OR d.status <> 'processed'""",
    ),
)
def document_clauses_refused(spark, folder):
    return _accepted(spark, folder)[1]


DOC_MATCHES = {
    **inp.REG_CLAUSES,
    **inp.ORG,
    "doc_matches": f"""
  SELECT chunk_id, organization_id, document_id, clause_id AS regulatory_clause_id, matching_score, rank,
    CASE WHEN matching_score >= {CUT} THEN 88.0::DOUBLE ELSE 60.0::DOUBLE END AS compliance_score,
    CASE WHEN matching_score >= {CUT} THEN 'COMPLIANT' ELSE 'PARTIALLY_COMPLIANT' END AS status
  FROM (SELECT k.chunk_id, k.organization_id, k.document_id, c.clause_id, round({inp.sql_cosine('c.embedding', 'k.embedding')}, 4) AS matching_score,
      CAST(row_number() OVER (PARTITION BY k.chunk_id ORDER BY round({inp.sql_cosine('c.embedding', 'k.embedding')}, 12) DESC, c.clause_id) AS INTEGER) AS rank
    FROM org_chunks k, reg_clauses c)
  WHERE rank <= 5""",
}


def _doc_matches(spark, folder):
    return report.match_document_clauses(
        inp.org_chunks(spark, folder), inp.reg_clauses(spark, folder), status_cut=CUT
    )


@query(
    "match_document_clauses",
    with_ctes(
        DOC_MATCHES,
        """SELECT chunk_id, regulatory_clause_id, matching_score, rank, compliance_score, status, 'REGULATION' AS source,
  'The policy language is semantically aligned with the regulatory requirement and provides relevant evidence for compliance review.' AS explanation
FROM doc_matches""",
    ),
)
def match_document_clauses(spark, folder):
    return _doc_matches(spark, folder)


_TEXT_HITS = {
    **inp.CATALOG,
    "text_hits": """
  SELECT chunk_id, clause_id, rank FROM (
    SELECT b.item_id AS chunk_id, d.doc_id AS clause_id, CAST(row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS INTEGER) AS rank
    FROM benchmark b JOIN documents d ON d.text ILIKE '%' || b.text[1:80] || '%') WHERE rank <= 5""",
}


@query(
    "fallback_classification",
    with_ctes(
        _TEXT_HITS,
        """SELECT chunk_id, clause_id AS regulatory_clause_id, rank, 0.91::DOUBLE AS matching_score, 88.0::DOUBLE AS compliance_score,
  'COMPLIANT' AS status, coalesce(r.title, 'REGULATION') AS source
FROM text_hits t LEFT JOIN versions v ON v.version_id = t.clause_id % 120 LEFT JOIN regulations r ON r.regulation_id = v.regulation_id""",
    ),
)
def fallback_classification(spark, folder):
    from clausemill.operators.search import text_fallback_match

    chunks = table(spark, folder, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content"))
    clauses = table(spark, folder, "documents").select(
        F.col("doc_id").alias("clause_id"), "text", (F.col("doc_id") % 120).alias("version_id")
    )
    return report.fallback_classification(
        text_fallback_match(chunks, clauses), clauses, inp.versions(spark, folder), inp.regulations(spark, folder)
    ).drop("explanation")


def _assessed(spark, folder):
    return inp.assessments(spark, folder).withColumnRenamed("policy_document_id", "document_id").withColumnRenamed(
        "policy_clause_id", "chunk_id"
    )


@query(
    "skip_irrelevant",
    with_ctes(
        inp.ASSESSMENTS,
        "SELECT status, count(*) AS n FROM assessments WHERE status <> 'NO_RELEVANT_REGULATION_FOUND' GROUP BY status",
    ),
)
def skip_irrelevant(spark, folder):
    return report.skip_irrelevant(_assessed(spark, folder)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = """count(*) AS total_requirements, count(*) FILTER (status = 'COMPLIANT') AS compliant_count,
  count(*) FILTER (status = 'PARTIALLY_COMPLIANT') AS partially_compliant_count, count(*) FILTER (status = 'NON_COMPLIANT') AS non_compliant_count,
  count(*) FILTER (status IN ('NOT_DETERMINABLE', 'NO_RELEVANT_REGULATION_FOUND')) AS not_determinable_count"""
_SUMMARY = {
    **inp.ASSESSMENTS,
    "counted": f"""
  SELECT organization_id, policy_document_id AS document_id, {_COUNTS}, avg(compliance_score) AS mean_score
  FROM assessments GROUP BY ALL""",
    "summary": f"SELECT * EXCLUDE mean_score, {inp.sql_round_exact('mean_score')} AS overall_score FROM counted",
}
_COUNT_NAMES = (
    "total_requirements, compliant_count, partially_compliant_count, non_compliant_count, not_determinable_count"
)


@query("report_summary", with_ctes(_SUMMARY, f"SELECT organization_id, document_id, {_COUNT_NAMES} FROM summary"))
def report_summary(spark, folder):
    return report.report_summary(_assessed(spark, folder)).drop("overall_score")


@query("overall_score", with_ctes(_SUMMARY, "SELECT organization_id, document_id, overall_score FROM summary"))
def overall_score(spark, folder):
    return report.report_summary(_assessed(spark, folder)).select("organization_id", "document_id", "overall_score")


@query(
    "high_risk_findings",
    with_ctes(
        inp.ASSESSMENTS,
        """SELECT organization_id, policy_document_id AS document_id, policy_clause_id AS chunk_id, regulatory_clause_id, status,
  coalesce(compliance_score, 0) AS compliance_score, 'HIGH' AS severity, explanation AS issue
FROM assessments WHERE status = 'NON_COMPLIANT'""",
    ),
)
def high_risk_findings(spark, folder):
    return report.high_risk_findings(_assessed(spark, folder))


@query(
    "uncovered_requirements",
    with_ctes(
        {**inp.ASSESSMENTS, "all_documents": """
  SELECT document_id, organization_id FROM policy_documents
  UNION ALL SELECT document_id + 1000000, organization_id FROM policy_documents WHERE document_id % 4 = 0"""},
        f"""SELECT organization_id, document_id, '{report.UNCOVERED_REQUIREMENT}' AS regulatory_requirement,
  '{report.UNCOVERED_REASON}' AS reason, 'HIGH' AS severity FROM all_documents p
WHERE NOT EXISTS (SELECT 1 FROM assessments a WHERE a.policy_document_id = p.document_id AND a.organization_id = p.organization_id)""",
    ),
)
def uncovered_requirements(spark, folder):
    """All documents, and further ones that nothing was matched with."""
    documents = inp.policy_documents(spark, folder)
    more = documents.where(F.col("document_id") % 4 == 0).withColumn("document_id", F.col("document_id") + 1_000_000)
    return report.uncovered_requirements(documents.unionByName(more), _assessed(spark, folder))


@query(
    "document_report",
    with_ctes(
        {
            **DOC_MATCHES,
            "documents_asked": """
  SELECT organization_id, document_id, document_name FROM org_documents
  UNION ALL SELECT organization_id, document_id + 1000000, 'More ' || document_id FROM org_documents""",
            "bare_chunks": """
  SELECT chunk_id + 1000000 AS chunk_id, organization_id, document_id + 1000000 AS document_id,
    CASE WHEN chunk_id % 9 = 0 THEN 'Clause ' || chunk_id || ' of topic ' ELSE 'No such text ' || chunk_id END AS content
  FROM org_chunks WHERE chunk_id % 9 < 2 AND document_id % 4 <> 1""",
            "results": """
  SELECT chunk_id, organization_id, document_id, compliance_score, status FROM doc_matches
  UNION ALL SELECT x.chunk_id, x.organization_id, x.document_id, 88.0::DOUBLE, 'COMPLIANT'
  FROM bare_chunks x JOIN reg_clauses c ON c.text ILIKE '%' || x.content || '%'""",
            "placed": """
  SELECT organization_id, document_id, count(*) AS n_chunks
  FROM (SELECT organization_id, document_id FROM org_chunks UNION ALL SELECT organization_id, document_id FROM bare_chunks) GROUP BY ALL""",
            "sums": f"""
  SELECT r.organization_id, r.document_id, {_COUNTS}, avg(compliance_score) AS mean_score FROM results r GROUP BY ALL""",
        },
        f"""SELECT d.organization_id, d.document_id, CASE WHEN p.n_chunks IS NOT NULL THEN d.document_name END AS document_name,
  {inp.sql_round_exact('s.mean_score')} AS overall_score,
  {", ".join(f"coalesce(s.{c.strip()}, 0) AS {c.strip()}" for c in _COUNT_NAMES.split(","))},
  CASE WHEN p.n_chunks IS NOT NULL AND s.document_id IS NULL THEN 1::BIGINT ELSE 0::BIGINT END AS uncovered_count
FROM documents_asked d LEFT JOIN placed p ON p.organization_id = d.organization_id AND p.document_id = d.document_id
LEFT JOIN sums s ON s.organization_id = d.organization_id AND s.document_id = d.document_id""",
    ),
)
def document_report(spark, folder):
    """All documents, and as many more: some with chunks that only their text can match, some with none at all."""
    chunks = inp.org_chunks(spark, folder).select("chunk_id", "organization_id", "document_id", "content", "embedding")
    k = F.col("chunk_id")
    text = F.when(k % 9 == 0, F.concat(F.lit("Clause "), k.cast("string"), F.lit(" of topic "))).otherwise(
        F.concat(F.lit("No such text "), k.cast("string"))
    )
    bare = chunks.where((k % 9 < 2) & (F.col("document_id") % 4 != 1)).select(
        (k + 1_000_000).alias("chunk_id"),
        "organization_id",
        (F.col("document_id") + 1_000_000).alias("document_id"),
        text.alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    chunks = chunks.unionByName(bare)
    matched = report.match_with_fallback(
        chunks, inp.reg_clauses(spark, folder), inp.versions(spark, folder), inp.regulations(spark, folder), status_cut=CUT
    )
    documents = inp.org_documents(spark, folder).select("organization_id", "document_id", "document_name")
    more = documents.select(
        "organization_id",
        (F.col("document_id") + 1_000_000).alias("document_id"),
        F.concat(F.lit("More "), F.col("document_id").cast("string")).alias("document_name"),
    )
    return report.document_report(documents.unionByName(more), chunks, matched)


@query(
    "report_from_history",
    with_ctes(
        _SUMMARY,
        f"""SELECT p.organization_id, p.document_id, p.document_name, s.overall_score,
  {", ".join(f"coalesce(s.{c.strip()}, 0) AS {c.strip()}" for c in _COUNT_NAMES.split(","))}, 0::BIGINT AS uncovered_count
FROM policy_documents p LEFT JOIN summary s ON s.organization_id = p.organization_id AND s.document_id = p.document_id""",
    ),
)
def report_from_history(spark, folder):
    return report.report_from_history(inp.policy_documents(spark, folder), inp.assessments(spark, folder))


@query(
    "snk_insert_if_absent",
    with_ctes(
        DOC_MATCHES,
        """SELECT organization_id, document_id AS policy_document_id, chunk_id AS policy_clause_id, regulatory_clause_id, matching_score,
  compliance_score, status, 1.0::DOUBLE AS confidence_score FROM doc_matches WHERE (chunk_id + regulatory_clause_id) % 3 <> 0""",
    ),
)
def snk_insert_if_absent(spark, folder):
    chunks = inp.org_chunks(spark, folder)
    # Written once: the matches are what takes the time, and the rows are read three times.
    fresh = saved(report.assessments_from_matches(_doc_matches(spark, folder), chunks), "assessments")
    stored = fresh.where((F.col("policy_clause_id") + F.col("regulatory_clause_id")) % 3 == 0)
    twice = fresh.unionByName(fresh.where(F.col("policy_clause_id") % 2 == 1))
    return report.insert_if_absent(stored, twice).select(
        *report.PAIR_KEY, "matching_score", "compliance_score", "status", "confidence_score"
    )
