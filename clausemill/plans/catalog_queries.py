"""Listings, versions, jobs and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import catalog, versions
from clausemill.plans import inputs as inp
from clausemill.plans.registry import query, table, with_ctes


@query(
    "paginate",
    """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer
ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50""",
)
def paginate(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    return catalog.paginate(rows, ["c_name", "c_custkey"], skip=50, limit=25)


@query(
    "paginate_after",
    """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer
WHERE (c_name, c_custkey) > ('Customer#000000020', 20) ORDER BY c_name, c_custkey LIMIT 25""",
)
def paginate_after(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    return catalog.paginate(rows, ["c_name", "c_custkey"], limit=25, after=["Customer#000000020", 20])


@query(
    "list_org_documents",
    with_ctes(
        inp.ORG,
        """SELECT document_id, organization_id, coalesce(source_filename, document_name) AS filename,
  coalesce(nullif(document_type, ''), 'OTHER') AS doc_type, status,
  (SELECT count(*) FROM org_documents WHERE organization_id = 3) AS total
FROM org_documents WHERE organization_id = 3 ORDER BY document_id LIMIT 20""",
    ),
)
def list_org_documents(spark, folder):
    return catalog.list_org_documents(inp.org_documents(spark, folder), 3)


_COUNTED = {
    **inp.CATALOG,
    "counts": "SELECT version_id, count(*) AS clause_count FROM stored_clauses GROUP BY 1",
}


@query("count_by_version", with_ctes(_COUNTED, "SELECT * FROM counts"))
def count_by_version(spark, folder):
    return catalog.count_by_version(inp.stored_clauses(spark, folder))


@query(
    "list_by_version",
    with_ctes(
        inp.CATALOG,
        """SELECT version_id, clause_id, clause_number, text, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY version_id ORDER BY clause_id, text) AS INTEGER) AS position FROM stored_clauses) s
WHERE position <= 10""",
    ),
)
def list_by_version(spark, folder):
    rows = catalog.list_by_version(inp.stored_clauses(spark, folder), order=("clause_id", "text"))
    return rows.select("version_id", "clause_id", "clause_number", "text", "position")


_DETAIL = """SELECT r.regulation_id, r.regulator_code, r.title, r.document_type, v.version_id, v.version, v.status, v.error_message,
  coalesce(c.clause_count, 0) AS clause_count
FROM regulations r LEFT JOIN versions v ON v.regulation_id = r.regulation_id AND v.is_current
LEFT JOIN counts c ON c.version_id = v.version_id"""


def _catalog(spark, folder):
    return inp.regulations(spark, folder), inp.versions(spark, folder), inp.stored_clauses(spark, folder)


@query("regulation_detail", with_ctes(_COUNTED, _DETAIL))
def regulation_detail(spark, folder):
    return catalog.regulation_detail(*_catalog(spark, folder))


@query(
    "regulation_status",
    with_ctes(
        {**_COUNTED, "detail": _DETAIL},
        """SELECT regulation_id, version_id, CASE WHEN version_id IS NULL THEN 'pending' ELSE status END AS status, clause_count FROM detail""",
    ),
)
def regulation_status(spark, folder):
    return catalog.regulation_status(*_catalog(spark, folder))


@query(
    "version_status",
    with_ctes(
        _COUNTED,
        """SELECT v.version_id, v.regulation_id, v.status, coalesce(c.clause_count, 0) AS clause_count, v.error_message
FROM versions v LEFT JOIN counts c ON c.version_id = v.version_id""",
    ),
)
def version_status(spark, folder):
    return catalog.version_status(inp.versions(spark, folder), inp.stored_clauses(spark, folder))


@query(
    "run_findings_count",
    """SELECT o_orderkey AS run_id, o_custkey AS document_id, o_orderstatus AS status, count(l_orderkey) AS findings_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def run_findings_count(spark, folder):
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status")
    )
    findings = table(spark, folder, "lineitem")
    return catalog.run_findings_count(runs, findings.select(F.col("l_orderkey").alias("run_id")))


@query(
    "catalog_text_filter",
    """SELECT p_partkey, p_name, p_type FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_type), 'eco')""",
)
def catalog_text_filter(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    by_both = catalog.catalog_text_filter(rows, "Ring", ["p_name", "p_type"])
    return by_both.unionByName(catalog.catalog_text_filter(rows, "eco", ["p_type"])).distinct()


@query(
    "unique_slug",
    """SELECT request_id, name, slug, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS outcome, reason FROM (
  SELECT request_id, name, slug, CASE WHEN name = '' OR slug = '' THEN 'BLANK'
    WHEN slug IN (SELECT lower(n_name) FROM nation) OR request_id <> min(request_id) OVER (PARTITION BY slug) THEN 'SLUG_EXISTS' END AS reason
  FROM (SELECT c_custkey AS request_id, trim(CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE c_name END) AS name,
          CASE WHEN c_custkey % 4 = 0 THEN coalesce(lower(n_name), '') ELSE 'org-' || (c_custkey // 3) END AS slug
        FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40) c) s""",
)
def unique_slug(spark, folder):
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    k = F.col("c_custkey")
    slug = F.when(k % 4 == 0, F.concat(F.lit(" "), F.coalesce(F.lower("n_name"), F.lit("")))).otherwise(
        F.concat(F.lit("org-"), F.floor(k / 3).cast("string"), F.lit("\t"))
    )
    requests = c.join(n, F.col("n_nationkey") == k % 40, "left").select(
        k.alias("request_id"), F.when(k % 10 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"), slug.alias("slug")
    )
    return catalog.unique_slug(requests, n.select(F.lower("n_name").alias("slug")))


@query(
    "duplicate_clauses",
    with_ctes(
        inp.CATALOG,
        """SELECT coalesce(c.m_document_name, r.title) AS document_name, c.clause_number, c.text[1:80] AS text_preview, count(*) AS duplicate_count
FROM stored_clauses c JOIN versions v ON v.version_id = c.version_id JOIN regulations r ON r.regulation_id = v.regulation_id
GROUP BY ALL HAVING count(*) > 1 ORDER BY duplicate_count DESC, document_name, clause_number, text_preview LIMIT 10""",
    ),
)
def duplicate_clauses(spark, folder):
    return catalog.duplicate_clauses(
        inp.stored_clauses(spark, folder), inp.versions(spark, folder), inp.regulations(spark, folder), key_chars=80
    )


@query(
    "duplicate_clauses_whole",
    with_ctes(
        inp.CATALOG,
        """SELECT document_name, clause_number, text[1:80] AS text_preview, duplicate_count FROM (
  SELECT coalesce(c.m_document_name, r.title) AS document_name, c.clause_number, c.text, count(*) AS duplicate_count
  FROM stored_clauses c JOIN versions v ON v.version_id = c.version_id JOIN regulations r ON r.regulation_id = v.regulation_id
  GROUP BY ALL HAVING count(*) > 1)
ORDER BY duplicate_count DESC, document_name, clause_number, text_preview, sha256(text) LIMIT 10""",
    ),
)
def duplicate_clauses_whole(spark, folder):
    return catalog.duplicate_clauses(
        inp.stored_clauses(spark, folder), inp.versions(spark, folder), inp.regulations(spark, folder)
    )


_PREVIEW = {
    **_COUNTED,
    "preview": """
  SELECT v.version_id, v.version, r.title, coalesce(c.clause_count, 0) AS clause_count
  FROM versions v JOIN regulations r ON r.regulation_id = v.regulation_id LEFT JOIN counts c ON c.version_id = v.version_id
  WHERE v.version LIKE 'test-%' OR v.version LIKE 'itest-%'""",
}


def _preview(spark, folder):
    regulations, stored_versions, clauses = _catalog(spark, folder)
    return catalog.cleanup_preview(stored_versions, regulations, clauses)


@query("cleanup_preview", with_ctes(_PREVIEW, "SELECT * FROM preview"))
def cleanup_preview(spark, folder):
    return _preview(spark, folder)


@query(
    "cleanup_totals",
    with_ctes(_PREVIEW, "SELECT count(*) AS versions, CAST(coalesce(sum(clause_count), 0) AS BIGINT) AS clauses FROM preview"),
)
def cleanup_totals(spark, folder):
    return catalog.cleanup_totals(_preview(spark, folder))


@query(
    "cleanup_cascade",
    with_ctes(
        {
            **inp.CATALOG,
            "kept_versions": "SELECT * FROM versions WHERE NOT (version LIKE 'test-%' OR version LIKE 'itest-%')",
            "kept_regulations": """
  SELECT * FROM regulations WHERE regulation_id IN (SELECT regulation_id FROM kept_versions)""",
            # Two regulators without a regulation, beside those that lose theirs.
            "all_regulators": "SELECT code FROM regulators UNION ALL VALUES ('NONE-1'), ('NONE-2')",
        },
        """SELECT 'clause' AS kind, CAST(clause_id AS VARCHAR) AS id FROM stored_clauses
  WHERE version_id NOT IN (SELECT version_id FROM versions WHERE version LIKE 'test-%' OR version LIKE 'itest-%')
UNION ALL SELECT 'version', CAST(version_id AS VARCHAR) FROM kept_versions
UNION ALL SELECT 'regulation', CAST(regulation_id AS VARCHAR) FROM kept_regulations
UNION ALL SELECT 'regulator', code FROM all_regulators WHERE code IN (SELECT regulator_code FROM kept_regulations)""",
    ),
)
def cleanup_cascade(spark, folder):
    regulations, stored_versions, clauses = _catalog(spark, folder)
    regulators = inp.regulators(spark, folder).select("code")
    regulators = regulators.unionByName(spark.range(1, 3).select(F.concat(F.lit("NONE-"), F.col("id").cast("string")).alias("code")))
    kept = catalog.cleanup_cascade(clauses, stored_versions, regulations, regulators)
    named = {
        "clause": kept["clauses"].select(F.col("clause_id").cast("string").alias("id")),
        "version": kept["versions"].select(F.col("version_id").cast("string").alias("id")),
        "regulation": kept["regulations"].select(F.col("regulation_id").cast("string").alias("id")),
        "regulator": kept["regulators"].select(F.col("code").alias("id")),
    }
    parts = [frame.select(F.lit(kind).alias("kind"), "id") for kind, frame in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---------------------------------------------------------------- documents and jobs

_HASHES = {
    "incoming": "SELECT doc_id, CASE WHEN doc_id % 23 <> 0 THEN sha256(text) END AS content_hash FROM documents",
    "existing": """
  SELECT doc_id AS version_id, sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status,
    doc_id % 17 AS clause_count FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id + 1000000, sha256(text), 'completed', 99 FROM documents WHERE doc_id % 6 = 0""",
}


def _uploads(spark, folder):
    docs = table(spark, folder, "documents")
    k = F.col("doc_id")
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    existing = hashed.where(k % 2 == 0).select(
        k.alias("version_id"),
        "content_hash",
        F.when(k % 3 == 0, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        (k % 17).alias("clause_count"),
    )
    # A failed version whose content was completed later under a higher id.
    later = hashed.where(k % 6 == 0).select(
        (k + 1_000_000).alias("version_id"), "content_hash", F.lit("completed").alias("status"), F.lit(99).cast("long").alias("clause_count")
    )
    incoming = hashed.withColumn("content_hash", F.when(k % 23 != 0, F.col("content_hash")))
    return incoming, existing.unionByName(later)


@query(
    "dedupe_documents",
    with_ctes(
        {
            **_HASHES,
            "known": """
  SELECT DISTINCT ON (content_hash) content_hash, version_id AS existing_version_id, status, clause_count
  FROM existing ORDER BY content_hash, status <> 'completed', version_id""",
        },
        """SELECT i.doc_id, i.content_hash, k.existing_version_id, CASE WHEN k.status = 'completed' THEN k.clause_count END AS existing_clause_count,
  CASE WHEN i.content_hash IS NOT NULL THEN min(i.doc_id) OVER (PARTITION BY i.content_hash) END AS first_doc_id,
  CASE WHEN i.content_hash IS NULL THEN 'EMPTY_DOCUMENT' WHEN k.status = 'completed' THEN 'duplicate' WHEN i.doc_id <> min(i.doc_id) OVER (PARTITION BY i.content_hash) THEN 'duplicate_in_batch'
       WHEN k.content_hash IS NOT NULL THEN 're-ingest' ELSE 'new' END AS outcome
FROM incoming i LEFT JOIN known k ON k.content_hash = i.content_hash""",
    ),
)
def dedupe_documents(spark, folder):
    return versions.dedupe_documents(*_uploads(spark, folder))


@query(
    "upload_conflicts",
    with_ctes(_HASHES, "SELECT * FROM incoming WHERE content_hash IN (SELECT content_hash FROM existing)"),
)
def upload_conflicts(spark, folder):
    return versions.upload_conflicts(*_uploads(spark, folder))


_TITLES = {
    **inp.CATALOG,
    "requests": """
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'AFRICA' END AS regulator_code,
    CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'Title ' || (c_custkey % 40) || repeat('x', 600) END AS title, 'CIRCULAR' AS document_type
  FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "resolved": """
  SELECT q.*, coalesce(CAST(r.regulation_id AS VARCHAR), sha256(q.regulator_code || chr(1) || q.title)) AS regulation_id,
    r.regulation_id IS NULL AS created
  FROM requests q LEFT JOIN regulations r ON r.regulator_code = q.regulator_code AND r.title = q.title""",
}


def _resolved(spark, folder):
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    k = F.col("c_custkey")
    requests = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey",
        F.when(k % 3 == 0, F.lit("ASIA")).when(k % 3 == 1, F.lit("EUROPE")).otherwise(F.lit("AFRICA")).alias("regulator_code"),
        F.when(k % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("Title "), (k % 40).cast("string"), F.repeat(F.lit("x"), 600))).alias("title"),
        F.lit("CIRCULAR").alias("document_type"),
    )
    return versions.resolve_regulation(requests, inp.regulations(spark, folder))


@query("resolve_regulation", with_ctes(_TITLES, "SELECT c_custkey, regulation_id, created FROM resolved"))
def resolve_regulation(spark, folder):
    return _resolved(spark, folder).select("c_custkey", "regulation_id", "created")


@query(
    "new_regulations",
    with_ctes(
        _TITLES,
        "SELECT regulation_id, regulator_code, min(title[1:500]) AS title, min(document_type) AS document_type FROM resolved WHERE created GROUP BY 1, 2",
    ),
)
def new_regulations(spark, folder):
    return versions.new_regulations(_resolved(spark, folder))


@query(
    "mark_current_version",
    with_ctes(
        inp.CATALOG,
        """SELECT version_id, regulation_id, row_number() OVER (PARTITION BY regulation_id ORDER BY created_at DESC, version_id DESC) = 1 AS is_current
FROM versions""",
    ),
)
def mark_current_version(spark, folder):
    return versions.mark_current_version(inp.versions(spark, folder)).select("version_id", "regulation_id", "is_current")


_LATEST = {
    **inp.JOBS,
    "latest": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1""",
}


@query(
    "job_state_transition",
    with_ctes(
        {
            **_LATEST,
            "results": """
  SELECT s_suppkey AS version_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 END AS clause_count,
    CASE WHEN s_suppkey % 5 = 0 THEN repeat('error ', 500) END AS error FROM supplier""",
        },
        """SELECT r.version_id, l.job_id, CASE WHEN e IS NULL THEN 'completed' ELSE 'failed' END AS status, e[1:2000] AS error_message,
  coalesce(clause_count, 0) AS clause_count
FROM (SELECT *, coalesce(error, CASE WHEN coalesce(clause_count, 0) = 0
        THEN 'Pipeline reported success but no clauses were persisted to the database' END) AS e FROM results) r
LEFT JOIN latest l ON l.entity_id = r.version_id""",
    ),
)
def job_state_transition(spark, folder):
    k = F.col("s_suppkey")
    results = table(spark, folder, "supplier").select(
        k.alias("version_id"),
        F.when(k % 4 != 0, k % 3).alias("clause_count"),
        F.when(k % 5 == 0, F.repeat(F.lit("error "), 500)).alias("error"),
    )
    return versions.finish_jobs(results, inp.jobs(spark, folder))


_FILES = {
    **inp.CATALOG,
    **_LATEST,
    "files": """
  SELECT storage_path AS path FROM versions WHERE version_id % 4 = 0
  UNION ALL SELECT s_suppkey || '.pdf' FROM supplier WHERE s_suppkey % 3 = 0""",
}


def _retry_sql(where: str) -> str:
    return with_ctes(
        _FILES,
        f"""SELECT version_id, CASE WHEN p IS NULL THEN 'skipped' ELSE 'requeued' END AS action, CASE WHEN p IS NULL THEN status ELSE 'pending' END AS status,
  CASE WHEN p IS NULL THEN version_id || ' (PDF file not found on disk)' END AS reason,
  CASE WHEN p IS NULL THEN storage_path ELSE coalesce(storage_path, p) END AS storage_path,
  CASE WHEN p IS NOT NULL THEN job_id END AS job_id,
  CASE WHEN p IS NOT NULL THEN CASE WHEN job_id IS NULL THEN 0 ELSE retry_count + 1 END END AS retry_count
FROM (SELECT v.*, l.job_id, l.retry_count, CASE WHEN storage_path IN (SELECT path FROM files) THEN storage_path
    WHEN version_id || '.pdf' IN (SELECT path FROM files) THEN version_id || '.pdf' END AS p
  FROM versions v LEFT JOIN latest l ON l.entity_id = v.version_id) v WHERE {where}""",
    )


def _retry(spark, folder, ids=None):
    stored = inp.versions(spark, folder)
    k = F.col("s_suppkey")
    files = stored.where(F.col("version_id") % 4 == 0).select(F.col("storage_path").alias("path")).unionByName(
        table(spark, folder, "supplier").where(k % 3 == 0).select(F.concat(k.cast("string"), F.lit(".pdf")).alias("path"))
    )
    return versions.retry_candidates(stored, inp.jobs(spark, folder), files, version_ids=ids)


@query("retry_candidates", _retry_sql("status IN ('pending', 'failed')"))
def retry_candidates(spark, folder):
    return _retry(spark, folder)


@query("retry_candidates_by_id", _retry_sql("version_id IN (1, 2, 3, 4, 5, 6)"))
def retry_candidates_by_id(spark, folder):
    return _retry(spark, folder, [1, 2, 3, 4, 5, 6])


@query(
    "paginate_ranges",
    """SELECT o_orderkey, o_totalprice, total FROM (
  SELECT o_orderkey, o_totalprice, count(*) OVER () AS total, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders) o
WHERE n > total // 2 AND n <= total // 2 + 50""",
)
def paginate_ranges(spark, folder):
    """The page in the middle of all orders."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    pages = catalog.page_ranges(orders, ["o_totalprice", "o_orderkey"], ranges=32)
    return pages.page(skip=pages.total // 2, limit=50)
