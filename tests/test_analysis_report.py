from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from clausemill.operators import analysis, catalog, ingest, report, versions

HIT = "organization_id long, clause_id long, rank int, chunk_id long, document_id long, document_name string, document_type string, " \
      "document_version string, section_title string, clause_reference string, similarity double, content string"  # fmt: skip


def pairs_with_hits(spark):
    pairs = spark.createDataFrame([(1, 7), (1, 8)], "organization_id long, clause_id long").select(
        "*", F.lit("Keep records").alias("clause_text"), F.lit("4.1").alias("clause_reference"), F.lit("").alias("regulation_name"),
        F.lit("RBI").alias("regulator"), F.lit(None).cast("string").alias("regulation_version"), F.lit("2016-01-01").alias("effective_date"),
    )
    hits = spark.createDataFrame(
        [(1, 7, 2, 21, 10, "Doc", "SOP", "1", None, None, 0.5, "second "), (1, 7, 1, 20, 10, "Doc", "SOP", "1", "Part", "3", 0.9123, " first")], HIT
    )
    return analysis.collect_hits(pairs, hits)


def verdict(**changes):
    body = {
        "compliance_status": "COMPLIANT", "confidence": 0.9, "reasoning": "r", "gaps": ["g"],
        "evidence": [
            {"chunk_id": "99", "document_id": "1", "similarity": 0.1, "relevance": "supports", "explanation": "unknown"},
            {"chunk_id": "21", "document_id": "666", "similarity": 1.0, "relevance": "contradicts", "explanation": "e21"},
            {"chunk_id": "20", "document_id": "666", "similarity": 0.0, "relevance": "supports", "explanation": "e20"},
        ],
    }
    return json.dumps({**body, **changes})


def test_prompt(spark):
    prompt = analysis.build_prompt(pairs_with_hits(spark).where("clause_id = 7")).first().prompt
    assert "Regulation Name: N/A\nRegulator: RBI\nRegulation Version: N/A\nEffective Date: 2016-01-01" in prompt
    assert prompt.index("--- Evidence E1 ---\nChunk ID: 20") < prompt.index("--- Evidence E2 ---\nChunk ID: 21")
    assert 'Similarity Score: 0.9123\nPolicy Content:\n"first"' in prompt and "Section: N/A" in prompt


def test_provider_sees_only_pairs_with_hits_and_evidence_is_reconciled(spark):
    answered, rejected = analysis.analyze_compliance(pairs_with_hits(spark), lambda prompt: F.lit(verdict()))
    got = {r.clause_id: r for r in answered.collect()}
    assert rejected.count() == 0
    assert [(e.chunk_id, e.document_id, e.similarity, e.relevance) for e in got[7].evidence] == [
        ("21", "10", 0.5, "contradicts"), ("20", "10", 0.9123, "supports"),
    ]
    assert (got[8].compliance_status, got[8].confidence, got[8].gaps) == ("INSUFFICIENT_EVIDENCE", 0.0, [analysis.NO_EVIDENCE_GAP])


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        (verdict(), None), (verdict(evidence=[], gaps=[]), None), (verdict(compliance_status="OK"), "INVALID_STATUS"),
        (verdict(confidence=1.5), "INVALID_CONFIDENCE"), (verdict(confidence=-0.1), "INVALID_CONFIDENCE"),
        (verdict(reasoning=None), "MISSING_REASONING"), ("{not json", "MALFORMED_JSON"), (None, "MALFORMED_JSON"),
        (verdict(evidence=[{"chunk_id": "1"}]), "INVALID_EVIDENCE"),
    ],
)
def test_verdict_schema(spark, raw, reason):
    rows = spark.createDataFrame([(raw,)], "verdict_json string")
    assert analysis.parse_verdict(rows).first().reject_reason == reason


def test_report_of_one_document(spark):
    docs = spark.createDataFrame([(1, 10, "A"), (1, 11, "empty"), (1, 12, "unmatched")], "organization_id long, document_id long, document_name string")
    chunks = spark.createDataFrame([(1, 10, 100), (1, 10, 101), (1, 12, 120)], "organization_id long, document_id long, chunk_id long")
    matches = spark.createDataFrame(
        [(100, 5, 88.0, "COMPLIANT"), (101, 6, None, "NON_COMPLIANT"), (101, 7, 60.0, "NO_RELEVANT_REGULATION_FOUND")],
        "chunk_id long, regulatory_clause_id long, compliance_score double, status string",
    )
    got = {r.document_id: r for r in report.document_report(docs, chunks, matches).collect()}
    assert (got[10].overall_score, got[10].total_requirements, got[10].compliant_count, got[10].non_compliant_count) == (88.0, 2, 1, 1)
    assert (got[11].document_name, got[11].overall_score, got[11].uncovered_count) == (None, None, 0)
    assert (got[12].total_requirements, got[12].uncovered_count) == (0, 1)


def test_text_fallback_only_without_vector_matches(spark):
    chunks = spark.createDataFrame([(1, "keep records here", [1.0, 0.0]), (2, "keep records here", None)], "chunk_id long, content string, embedding array<float>")
    clauses = spark.createDataFrame(
        [(5, "We KEEP records here always", 9, [0.8, 0.6]), (6, "other", 9, [0.0, 1.0])], "clause_id long, text string, version_id long, embedding array<float>"
    )
    vers = spark.createDataFrame([(9, 3)], "version_id long, regulation_id long")
    regs = spark.createDataFrame([(3, "KYC")], "regulation_id long, title string")
    got = report.match_with_fallback(chunks, clauses, vers, regs, top_k=1)
    rows = sorted((r.chunk_id, r.regulatory_clause_id, r.matching_score, r.compliance_score, r.status, r.source) for r in got.collect())
    assert rows == [(1, 5, 0.8, 88.0, "COMPLIANT", "REGULATION"), (2, 5, 0.91, 88.0, "COMPLIANT", "KYC")]


def test_insert_if_absent_keeps_stored_rows(spark):
    schema = "organization_id int, policy_document_id int, policy_clause_id int, regulatory_clause_id int, status string"
    stored = spark.createDataFrame([(1, 1, 1, 1, "OLD")], schema)
    fresh = spark.createDataFrame([(1, 1, 1, 1, "NEW"), (1, 1, 1, 2, "NEW"), (1, 1, 1, 2, "NEW")], schema)
    assert [tuple(r) for r in report.insert_if_absent(stored, fresh).collect()] == [(1, 1, 1, 2, "NEW")]


def test_pages_out_of_range():
    for kw in ({"skip": -1}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(catalog.InvalidPage):
            catalog.paginate(None, ["id"], **kw)


def test_duplicates_of_a_batch_and_of_the_store(spark):
    incoming = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d"), (6, None), (7, None), (8, "e")], "doc_id long, content_hash string")
    known = spark.createDataFrame([(90, "b", "completed", 7), (91, "c", "failed", 0), (10, "e", "failed", 0), (11, "e", "completed", 4)], "version_id long, content_hash string, status string, clause_count long")
    got = {r.doc_id: (r.outcome, r.existing_clause_count) for r in versions.dedupe_documents(incoming, known).collect()}
    assert got == {1: ("new", None), 2: ("duplicate_in_batch", None), 3: ("duplicate", 7), 4: ("re-ingest", None), 5: ("new", None),
                   6: ("EMPTY_DOCUMENT", None), 7: ("EMPTY_DOCUMENT", None), 8: ("duplicate", 4)}


def test_whole_ingest(spark):
    pages = spark.createDataFrame(
        [(1, 1, "Bank Bulletin\nReserve Bank of India rules dated 2016-02-25\n1. Keep the records\n1. Keep them long"), (1, 2, "Bank Bulletin\n2. Review the records")],
        "doc_id long, page_number int, text string",
    )
    files = spark.createDataFrame([(1, "rbi_kyc.pdf")], "doc_id long, filename string")
    result = ingest.ingest_regulations(pages, files, dim=16)
    rows = {r.clause_number: r for r in result.clauses.collect()}
    assert set(rows) == {"0", "1", "2"} and rows["1"].text == "Keep the records Keep them long" and rows["1"].n_merged == 2
    assert rows["2"].metadata.effective_date == "2016-02-25" and rows["2"].metadata.regulator == "RBI" and len(rows["2"].embedding) == 16
    meta = result.metadata.first().meta
    assert (meta.total_pages, meta.version, meta.document_type) == (2, "1.0", "regulation")
    docs = spark.createDataFrame([(1, 5, "Doc", "SOP", "2")], "doc_id long, organization_id long, document_name string, document_type string, version string")
    chunks = ingest.ingest_policies(pages, docs, dim=16).orderBy("chunk_index").collect()
    assert [(c.clause_reference, c.organization_id, c.metadata.document_type) for c in chunks] == [(None, 5, "SOP"), ("1", 5, "SOP"), ("2", 5, "SOP")]


def test_asked_pairs_with_their_hits_are_made_once(spark, tmp_path):
    """Every clause meets every organisation, but fields are added and hits gathered for the two that are asked."""
    import numpy as np

    from clausemill.plans.risk_queries import _pairs_with_hits

    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(64)], i % 10) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(1, 5).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = _pairs_with_hits(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan and "CoGroups" not in plan
    got = {(r.organization_id, r.clause_id): len(r.hits) for r in pairs.collect()}
    assert set(got) == {((i + o) % 10, i) for i in range(200) for o in (0, 1)}
    assert max(got.values()) <= 5 and any(got.values())


def test_assessments_to_store_are_matched_once(spark, tmp_path):
    """The matches are read three times, so that they are written and not made three times."""
    from clausemill.plans.report_queries import snk_insert_if_absent

    rows = [(i, [1.0, 0.1 * i], i % 2) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(1, 5).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    fresh = snk_insert_if_absent(spark, str(tmp_path))
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "CoGroups" not in plan
    pairs = [(r.policy_clause_id, r.regulatory_clause_id) for r in fresh.collect()]
    assert pairs and len(pairs) == len(set(pairs)) and all((a + b) % 3 for a, b in pairs)


def test_ingestion_makes_and_cleans_pages_once(spark, tmp_path):
    """Clauses and metadata read the same written pages; pages of no document are in no result."""
    from clausemill.operators import ingest

    text = "1. General\nBanks shall keep records of all transactions.\n(a) for ten years at least"
    rows = [(1, 1, text), (1, 2, "2. More\n" + text), (2, 1, text), (None, 1, text), (None, 2, text)]
    spark.createDataFrame(rows, "doc_id long, page_number int, text string").write.parquet(f"{tmp_path}/raw")
    files = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (None, "c.pdf")], "doc_id long, filename string")
    result = ingest.ingest_regulations(spark.read.parquet(f"{tmp_path}/raw"), files, dim=16)
    read = result.clauses.inputFiles()
    assert any("cleaned-pages" in f for f in read) and not any("/raw/" in f for f in read)
    assert {r.version_id for r in result.clauses.collect()} == {1, 2}
