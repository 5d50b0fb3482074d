"""Text filters through a trigram index, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import grams, search
from clausemill.plans import catalog_queries  # noqa: F401  (its SQL is used again here)
from clausemill.plans import inputs as inp
from clausemill.plans.registry import SQL, query, table
from clausemill.plans.vector_queries import _catalog, _hit_columns, _query_vector
from clausemill.session import work_dir


@query("filter_section_indexed", SQL["filter_section"])
def filter_section_indexed(spark, folder):
    catalog = _catalog(spark, folder)
    index = grams.build_gram_index(catalog, "clause_id", F.col("section"), work_dir(spark, "section-grams"))
    named = grams.rows_like(catalog, "clause_id", "section", "%data_ret%", index, ignore_case=True)
    return _hit_columns(search.search_topk(named, _query_vector(spark, folder), top_k=20))


@query("like_probe_indexed", SQL["like_probe"])
def like_probe_indexed(spark, folder):
    clauses = inp.reg_clauses(spark, folder)
    index = grams.build_gram_index(clauses, "clause_id", F.col("text"), work_dir(spark, "clause-grams"))
    held = grams.rows_like(clauses, "clause_id", "text", "%of topic 3%", index)
    return search.like_probe(held, "%of topic 3%", _query_vector(spark, folder))


@query("catalog_text_filter_indexed", SQL["catalog_text_filter"])
def catalog_text_filter_indexed(spark, folder):
    columns = ["p_name", "p_type"]
    rows = table(spark, folder, "part").select("p_partkey", *columns)
    index = grams.build_gram_index(rows, "p_partkey", grams.joined_columns(columns), work_dir(spark, "part-grams"))
    by_both = grams.rows_containing(rows, "p_partkey", columns, "Ring", index)
    return by_both.unionByName(grams.rows_containing(rows, "p_partkey", ["p_type"], "eco", index)).distinct()


PATTERNS = ("%Data Retention%", "the %tion.%", "%shall_be%", "%  and%", "%e.\n%")


@query(
    "documents_like_indexed",
    "\nUNION ALL ".join(
        f"SELECT {n} AS pattern_id, doc_id FROM documents WHERE text ILIKE '{p}'" for n, p in enumerate(PATTERNS)
    ),
)
def documents_like_indexed(spark, folder):
    """Five patterns, rare and frequent, over the whole texts of one index."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    index = grams.build_gram_index(documents, "doc_id", F.col("text"), work_dir(spark, "document-grams"))
    found = [
        grams.rows_like(documents, "doc_id", "text", p, index, ignore_case=True).select(F.lit(n).alias("pattern_id"), "doc_id")
        for n, p in enumerate(PATTERNS)
    ]
    every = found[0]
    for frame in found[1:]:
        every = every.unionByName(frame)
    return every
