"""Cleaning of page text: running furniture, page numbers, white space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx

PAGE_MARK = "page"


@dataclass(frozen=True)
class CleanOptions:
    page_numbers: bool = True
    headers_footers: bool = True
    whitespace: bool = True
    broken_words: bool = True
    scan_lines: int = 3
    min_ratio: float = 0.6
    min_pages: int = 2
    keep_paragraphs: bool = True
    reject_empty: bool = False


def clean_block(col: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Soft hyphens, broken words, page-number lines, white space - in this order."""
    col = tx.drop_soft_hyphens(col)
    if options.broken_words:
        col = tx.join_broken_words(col)
    if not options.whitespace:
        return tx.drop_page_number_lines(col) if options.page_numbers else col
    # The lines that stay are not joined and split again in between.
    lines = tx.split_lines(col)
    if options.page_numbers:
        lines = tx.no_page_numbers(lines)
    return tx.squeeze_lines(lines, keep_paragraphs=options.keep_paragraphs)


def clean_status(col: Column, options: CleanOptions = CleanOptions()) -> Column:
    """'ok', or why a block is refused: no text at all, or blank where that is not allowed."""
    status = F.when(col.isNull(), F.lit("TEXT_MISSING"))
    if options.reject_empty:
        status = status.when(tx.strip(col) == "", F.lit("EMPTY_TEXT"))
    return status.otherwise(F.lit("ok"))


def detect_furniture(pages: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """(doc_id, zone, line_key, occurrences) of repeated boundary lines.

    The first and last ``scan_lines`` non-blank lines of every page are counted
    per document - occurrences, not distinct pages.  The pages themselves are
    counted along under a mark of their own.  Only keys and counts are shuffled,
    after map-side counting, and lines seen once are gone before the counts of
    a document meet.
    """
    mark = F.array(F.struct(F.lit(PAGE_MARK).alias("zone"), F.lit("").alias("line_key")))
    filled = F.filter(tx.split_lines(F.col("text")), lambda line: ~tx.is_blank(line))
    n = options.scan_lines
    zones = (
        pages.select("doc_id", F.coalesce(filled, F.array().cast("array<string>")).alias("k")).select(
            "doc_id",
            F.explode(
                F.concat(
                    mark,
                    F.transform(
                        F.slice("k", 1, n), lambda k: F.struct(F.lit("header").alias("zone"), tx.line_key(k).alias("line_key"))
                    ),
                    F.transform(
                        F.slice("k", F.greatest(F.size("k") - (n - 1), F.lit(1)), F.lit(n)),
                        lambda k: F.struct(F.lit("footer").alias("zone"), tx.line_key(k).alias("line_key")),
                    ),
                )
            ).alias("z"),
        )
    )
    counts = (
        zones.groupBy("doc_id", "z.zone", "z.line_key")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where((F.col("occurrences") >= 2) | (F.col("zone") == PAGE_MARK))
    )
    n_pages = F.max(F.when(F.col("zone") == PAGE_MARK, F.col("occurrences"))).over(Window.partitionBy("doc_id"))
    threshold = F.greatest(F.lit(2), (F.col("n_pages") * F.lit(options.min_ratio)).cast("int"))
    return (
        counts.withColumn("n_pages", n_pages)
        .where(F.col("zone") != PAGE_MARK)
        .where((F.col("n_pages") >= options.min_pages) & (F.col("occurrences") >= threshold))
        .select("doc_id", "zone", "line_key", "occurrences")
    )


def strip_furniture(pages: DataFrame, furniture: DataFrame, *, known_ids: bool = False) -> DataFrame:
    """Drop every line, wherever it stands, whose key is furniture of its document.

    A key needs a count of at least ``min_ratio`` x pages out of at most
    ``scan_lines`` per page and zone, so a document has a handful of keys and
    they travel as one small array per document.  Few lines begin like one of
    them; only those get a key.  With ``known_ids`` no ``doc_id`` is null: the
    join is a plain one, and who groups its rows by document shuffles no text.
    """
    starts = F.collect_set(F.left("line_key", F.lit(1))).alias("_starts")
    per_doc = furniture.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("line_key").alias("_keys"), starts)
    kept = F.filter(
        tx.split_lines(F.col("text")),
        lambda line: ~(F.array_contains("_starts", tx.key_start(line)) & F.array_contains("_keys", tx.line_key(line))),
    )
    # Null-safe equality adds no null filter on one side, so both sides read one shuffle of the pages.
    same = F.col("doc_id") == F.col("_doc") if known_ids else F.col("doc_id").eqNullSafe(F.col("_doc"))
    return pages.join(per_doc, same, "left").select(
        *[F.col(c) for c in pages.columns if c != "text"],
        F.when(F.col("_keys").isNull(), F.col("text")).otherwise(tx.join_lines(kept)).alias("text"),
    )


def clean_pages(pages: DataFrame, options: CleanOptions = CleanOptions(), *, known_ids: bool = False) -> DataFrame:
    """Furniture removal, then block cleaning; pages left empty stay in the result."""
    if options.headers_footers:
        pages = strip_furniture(pages, detect_furniture(pages, options), known_ids=known_ids)
    return pages.withColumn("text", clean_block(F.col("text"), options))


def clean_document(
    pages: DataFrame, options: CleanOptions = CleanOptions(), *, passes: int = 1, known_ids: bool = False
) -> DataFrame:
    """(doc_id, text, n_pages): cleaned non-empty pages joined by a blank line, in page order.

    The metadata of a regulation is read from text that went through the page
    cleaning twice; ``passes=2`` gives that text.  One row per document is the
    result itself; uploads are limited to 25 MiB (see ``sources.files``).
    """
    for _ in range(passes):
        pages = clean_pages(pages, options, known_ids=known_ids)
    joined = F.expr(r"listagg(nullif(text, ''), '\n\n') WITHIN GROUP (ORDER BY page_number)")
    return pages.groupBy("doc_id").agg(
        F.coalesce(joined, F.lit("")).alias("text"), F.count(F.lit(1)).alias("n_pages")
    )
