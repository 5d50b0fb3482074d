"""Embedding of texts through a pluggable ``Column -> Column`` embedder.

An embedder maps text to ``array<float>``; a model goes into an iterator pandas
UDF that loads it once per worker, its batch size being
``spark.sql.execution.arrow.maxRecordsPerBatch``.  The default hashes term
frequencies in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.text import strip

DEFAULT_DIMENSION = 1024

# Fixed value: what a search query starts with before it is embedded locally.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

Embedder = Callable[[Column], Column]


def embed_documents(
    rows: DataFrame,
    *,
    text_col: str = "text",
    output_col: str = "embedding",
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIMENSION,
) -> DataFrame:
    """Add a unit vector per text (all zeros where the default finds no word)."""
    if embedder is not None:
        return rows.withColumn(output_col, embedder(F.col(text_col)))
    kept = [c for c in rows.columns if c != output_col]
    prepared = rows.select(*kept, F.coalesce(text_col, F.lit("")).alias("_text"))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+").transform(prepared)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim).transform(words)
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counts)
    return unit.select(*kept, vector_to_array("_unit", "float32").alias(output_col))


def embed_query(
    queries: DataFrame,
    *,
    text_col: str = "query",
    output_col: str = "vector",
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIMENSION,
    prefix: str = QUERY_PREFIX,
) -> DataFrame:
    """Embed stripped, non-blank queries behind the search prefix; blank ones are dropped."""
    asked = queries.withColumn("_asked", strip(F.col(text_col))).where(F.col("_asked") != "")
    prefixed = asked.withColumn("_asked", F.concat(F.lit(prefix), F.col("_asked")))
    return embed_documents(prefixed, text_col="_asked", output_col=output_col, embedder=embedder, dim=dim).drop("_asked")


def embed_backfill(
    rows: DataFrame, *, embedder: Embedder | None = None, dim: int = DEFAULT_DIMENSION, output_col: str = "embedding"
) -> DataFrame:
    """Embed only rows whose vector is missing or empty; others pass through unread by the embedder."""
    missing = F.col(output_col).isNull() | (F.size(output_col) == 0)
    done = embed_documents(rows.where(missing), embedder=embedder, dim=dim, output_col=output_col)
    return rows.where(~missing).unionByName(done.select(*rows.columns))


def embed_reindex(
    rows: DataFrame, *, version_id: object | None = None, embedder: Embedder | None = None, dim: int = DEFAULT_DIMENSION
) -> DataFrame:
    """Re-embed every clause with a text, or those of one version, from the text."""
    wanted = rows.where(F.col("text").isNotNull())
    if version_id is not None:
        wanted = wanted.where(F.col("version_id") == F.lit(version_id))
    return embed_documents(wanted, embedder=embedder, dim=dim)


def reindex_count(rows: DataFrame, *, version_id: object | None = None) -> DataFrame:
    """What a re-index would touch, without doing it."""
    wanted = rows.where(F.col("text").isNotNull())
    if version_id is not None:
        wanted = wanted.where(F.col("version_id") == F.lit(version_id))
    return wanted.agg(F.count(F.lit(1)).alias("clauses"), F.lit(0).cast("long").alias("updated"))


def dimension_histogram(rows: DataFrame, output_col: str = "embedding") -> DataFrame:
    return (
        rows.where(F.col(output_col).isNotNull())
        .groupBy(F.size(output_col).alias("dim"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def mean_vectors(rows: DataFrame, group: list[str], vector_col: str = "embedding") -> DataFrame:
    """Component-wise mean per group, not normalised again; null and empty vectors do not count.

    One running mean per group and task, so a large group never meets in one
    task.  The vectors of a group have one dimension.
    """
    given = rows.where(F.size(vector_col) > 0).withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    means = given.groupBy(*group).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(*group, vector_to_array("_m").alias(vector_col))


def merge_regulatory_clauses(clauses: DataFrame) -> DataFrame:
    """One clause per (version_id, clause_number).

    clauses(version_id, clause_number, seq, section, title, text, page_number,
    page_end, metadata, ...).  Merged texts are joined in order, pages widen,
    the last metadata that is there wins as a whole, all else is the first
    row's.
    """
    key = ["version_id", "clause_number"]
    rest = [c for c in clauses.columns if c not in {*key, "seq", "text", "page_number", "page_end", "metadata"}]
    text = F.when(F.col("n_merged") == 1, F.col("_single")).otherwise(F.coalesce("_joined", F.lit("")))
    return (
        clauses.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n_merged"),
            F.min("seq").alias("seq"),
            F.min_by(F.struct("text", *rest), "seq").alias("_first"),
            F.expr("listagg(nullif(trim(text), ''), ' ') WITHIN GROUP (ORDER BY seq)").alias("_joined"),
            F.min("page_number").alias("page_number"),
            F.max("page_end").alias("page_end"),
            F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("seq"))).alias("metadata"),
        )
        .withColumn("_single", F.col("_first.text"))
        .select(*key, "seq", *[f"_first.{c}" for c in rest], text.alias("text"), "page_number", "page_end", "metadata", "n_merged")
    )


def dedupe_regulatory_clauses(
    clauses: DataFrame, *, embedder: Embedder | None = None, dim: int = DEFAULT_DIMENSION
) -> DataFrame:
    """``merge_regulatory_clauses`` for rows that have an ``embedding`` already.

    Only merged clauses are embedded again.  Where an embedder returns null
    for a merged text, the mean of the old vectors stands in.
    """
    key = ["version_id", "clause_number"]
    merged = merge_regulatory_clauses(clauses)
    single = merged.where(F.col("n_merged") == 1)
    several = merged.where(F.col("n_merged") > 1)
    again = embed_documents(several.drop("embedding"), embedder=embedder, dim=dim)
    if embedder is not None:
        old = clauses.select(*key, F.col("embedding").alias("_old"))
        again = (
            again.join(mean_vectors(old, key, "_old"), key, "left")
            .withColumn("embedding", F.coalesce("embedding", F.col("_old").cast("array<float>")))
            .drop("_old")
        )
    return single.unionByName(again.select(*single.columns))
