"""Retrieval quality of ranked results against expected snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5)


def rank_of_match(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, match_rank): first rank whose text contains an expected snippet, ignoring case.

    results(query_id, rank, text), cases(query_id, snippets).  Queries without
    a match have no row.
    """
    hit = F.exists("snippets", lambda s: F.contains(F.lower(F.col("text")), F.lower(s)))
    return results.join(cases, "query_id").where(hit).groupBy("query_id").agg(F.min("rank").alias("match_rank"))


def evaluate_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case: hit@1, @3, @5, reciprocal rank and the top text ('' without results)."""
    top = results.groupBy("query_id").agg(F.min_by("text", "rank").alias("_top"))
    rank = F.col("match_rank")
    return (
        cases.select("query_id")
        .join(rank_of_match(results, cases), "query_id", "left")
        .join(top, "query_id", "left")
        .select(
            "query_id",
            *[F.coalesce(rank <= k, F.lit(False)).alias(f"hit_at_{k}") for k in CUTS],
            F.coalesce(1.0 / rank, F.lit(0.0)).alias("reciprocal_rank"),
            F.coalesce("_top", F.lit("")).alias("top_text"),
        )
    )


def retrieval_summary(evaluated: DataFrame) -> DataFrame:
    """Mean of every metric over the cases; zeros when there is none."""
    return evaluated.agg(
        *[F.coalesce(F.avg(F.col(f"hit_at_{k}").cast("double")), F.lit(0.0)).alias(f"hit_at_{k}") for k in CUTS],
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
    )
