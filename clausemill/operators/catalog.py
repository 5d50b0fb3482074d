"""Listings, counts, text filters and maintenance over the catalog tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.text import strip
from clausemill.session import saved

MAX_PAGE = 100
TEST_VERSION = r"^i?test-"


class InvalidPage(ValueError):
    """skip or limit is out of range."""


def _check_page(skip: int, limit: int) -> None:
    if skip < 0 or not 1 <= limit <= MAX_PAGE:
        raise InvalidPage(f"skip must be >= 0 and limit between 1 and {MAX_PAGE}")


def paginate(
    rows: DataFrame, order: list[str], *, skip: int = 0, limit: int = 20, after: list | None = None
) -> DataFrame:
    """One page of rows plus ``total``, the number of rows on all pages.

    ``skip`` makes one task pass over all rows before the page (``page_ranges``
    does not).  ``after``, the values of the ``order`` columns in the last row of
    the page before, costs the same for any page; the columns must tell rows
    apart and hold no nulls.
    """
    _check_page(skip, limit)
    total = rows.agg(F.count(F.lit(1))).scalar()
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)]))
    page = rows.orderBy(*order)
    return (page.offset(skip) if skip else page).limit(limit).withColumn("total", total)


@dataclass(frozen=True)
class PageRanges:
    """Rows cut into ranges of ``order`` (column ``_range``), with the number of rows in each."""

    rows: DataFrame
    order: tuple[str, ...]
    sizes: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.sizes)

    def page(self, *, skip: int = 0, limit: int = 20) -> DataFrame:
        """What ``paginate`` gives, from the ranges that the page lies in; the others are not read."""
        _check_page(skip, limit)
        before, opened, start = 0, [], 0
        for number, size in enumerate(self.sizes):
            if size and before < skip + limit and before + size > skip:
                start = start if opened else before
                opened.append(number)
            before += size
        held = self.rows.where(F.col("_range").isin(opened)) if opened else self.rows.where(F.lit(False))
        page = held.orderBy(*self.order).offset(skip - start if opened else 0).limit(limit)
        return page.drop("_range").withColumn("total", F.lit(self.total).cast("long"))


def page_ranges(rows: DataFrame, order: list[str], *, ranges: int | None = None) -> PageRanges:
    """Write rows in ranges of the ``order`` columns, once for all pages of a listing.

    The driver sees one count per range (``spark.sql.shuffle.partitions`` of
    them by default).  Rows equal in all ``order`` columns share a range, so the
    columns should tell rows apart; nulls come first.  A file holds one range,
    and its statistics keep it closed where the page lies elsewhere.
    """
    number = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(number, *order).withColumn("_range", F.spark_partition_id())
    stored = saved(cut, "page-ranges")
    counted = {r["_range"]: r["n"] for r in stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    return PageRanges(stored, tuple(order), tuple(counted.get(i, 0) for i in range(number)))


def list_org_documents(documents: DataFrame, organization_id, *, skip: int = 0, limit: int = 20) -> DataFrame:
    own = documents.where(F.col("organization_id") == F.lit(organization_id)).select(
        "document_id",
        "organization_id",
        F.coalesce(F.nullif("source_filename", F.lit("")), "document_name").alias("filename"),
        F.coalesce(F.nullif("document_type", F.lit("")), F.lit("OTHER")).alias("doc_type"),
        "status",
    )
    return paginate(own, ["document_id"], skip=skip, limit=limit)


def count_by_version(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("version_id").agg(F.count(F.lit(1)).alias("clause_count"))


def list_by_version(clauses: DataFrame, *, limit: int = 10, order: tuple[str, ...] = ("clause_id",)) -> DataFrame:
    """The first clauses of every version, by clause id."""
    order = Window.partitionBy("version_id").orderBy(*order)
    return clauses.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def regulation_detail(regulations: DataFrame, versions: DataFrame, clauses: DataFrame) -> DataFrame:
    """Regulations with their current version and its clause count, 0 without one."""
    current = versions.where("is_current").select(
        "regulation_id", "version_id", "version", "status", "error_message"
    )
    return (
        regulations.join(current, "regulation_id", "left")
        .join(count_by_version(clauses), "version_id", "left")
        .select(
            "regulation_id",
            "regulator_code",
            "title",
            "document_type",
            "version_id",
            "version",
            "status",
            "error_message",
            F.coalesce("clause_count", F.lit(0)).alias("clause_count"),
        )
    )


def regulation_status(regulations: DataFrame, versions: DataFrame, clauses: DataFrame) -> DataFrame:
    """Ingestion status of the current version; 'pending' and 0 when there is none."""
    return regulation_detail(regulations, versions, clauses).select(
        "regulation_id",
        "version_id",
        F.when(F.col("version_id").isNull(), F.lit("pending")).otherwise(F.col("status")).alias("status"),
        "clause_count",
    )


def version_status(versions: DataFrame, clauses: DataFrame) -> DataFrame:
    return versions.join(count_by_version(clauses), "version_id", "left").select(
        "version_id",
        "regulation_id",
        "status",
        F.coalesce("clause_count", F.lit(0)).alias("clause_count"),
        "error_message",
    )


def run_findings_count(runs: DataFrame, findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings_count"))
    return runs.join(counts, "run_id", "left").withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))


def catalog_text_filter(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns contains the term, ignoring case."""
    condition = F.lit(False)
    for column in columns:
        condition = condition | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(term.lower()))
    return rows.where(condition)


def unique_slug(requests: DataFrame, organizations: DataFrame) -> DataFrame:
    """requests(request_id, name, slug): accepted, or refused with a reason.

    Name and slug are trimmed and must not be blank; of several requests for a
    new slug the smallest request id gets it.
    """
    trimmed = requests.withColumn("name", strip(F.col("name"))).withColumn("slug", strip(F.col("slug")))
    taken = organizations.select("slug", F.lit(True).alias("_taken")).distinct()
    first = trimmed.groupBy("slug").agg(F.min("request_id").alias("_first"))
    reason = F.when(
        (F.coalesce("name", F.lit("")) == "") | (F.coalesce("slug", F.lit("")) == ""), F.lit("BLANK")
    ).when(F.col("_taken") | (F.col("request_id") != F.col("_first")), F.lit("SLUG_EXISTS"))
    return (
        trimmed.join(taken, "slug", "left")
        .join(first, "slug", "left")
        .select("request_id", "name", "slug", F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("refused")).alias("outcome"), reason.alias("reason"))
    )


def duplicate_clauses(
    clauses: DataFrame,
    versions: DataFrame,
    regulations: DataFrame,
    *,
    limit: int = 10,
    key_chars: int | None = None,
    preview_chars: int = 80,
) -> DataFrame:
    """Most repeated (document, clause number, text), shown by the text's first ``preview_chars`` characters.

    Texts are the same if they agree as a whole or, with ``key_chars``, in so
    many characters; whole texts are grouped by their hash.
    """
    key = F.sha2("text", 256) if key_chars is None else F.substring("text", 1, key_chars)
    named = (
        clauses.join(versions.select("version_id", "regulation_id"), "version_id")
        .join(regulations.select("regulation_id", "title"), "regulation_id")
        .select(
            F.coalesce("metadata.document_name", "title").alias("document_name"),
            "clause_number",
            key.alias("_key"),
            F.substring("text", 1, preview_chars).alias("text_preview"),
        )
    )
    shown = ["document_name", "clause_number", "text_preview"]
    return (
        named.groupBy("document_name", "clause_number", "_key")
        .agg(F.min("text_preview").alias("text_preview"), F.count(F.lit(1)).alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
        .orderBy(F.desc("duplicate_count"), *shown, "_key")
        .limit(limit)
        .select(*shown, "duplicate_count")
    )


def duplicate_clause_report(clauses: DataFrame, group: str = "doc_id") -> DataFrame:
    """Per document: extracted clauses, distinct numbers, numbers used more than once, and these numbers' groups.

    The groups stand in the order of ``duplicate_ids``, their pages and texts in
    that of the clauses; a character outside of ASCII is shown as ``?``.
    """
    shown = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    listed = F.sort_array(F.collect_list(F.struct("seq", F.struct("page_number", shown.alias("text")).alias("clause"))))
    per_number = clauses.groupBy(group, "clause_number").agg(F.count(F.lit(1)).alias("n"), listed.alias("listed"))
    several = F.when(F.col("n") > 1, F.struct(F.col("clause_number").alias("id"), F.col("listed.clause").alias("clauses")))
    return (
        per_number.groupBy(group)
        .agg(
            F.sum("n").alias("total_clauses"),
            F.count(F.lit(1)).alias("unique_numbers"),
            F.count_if(F.col("n") > 1).alias("duplicate_numbers"),
            F.sort_array(F.collect_list(several)).alias("_several"),
        )
        .withColumn("duplicate_ids", F.col("_several.id"))
        .withColumn("duplicate_pages", F.transform("_several", lambda d: d["clauses"]["page_number"]))
        .withColumn("duplicate_texts", F.transform("_several", lambda d: d["clauses"]["text"]))
        .drop("_several")
    )


def duplicate_clause_groups(clauses: DataFrame, group: str = "doc_id") -> DataFrame:
    """The clauses behind the duplicates, each with its group's size."""
    sizes = clauses.groupBy(group, "clause_number").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return clauses.join(sizes, [group, "clause_number"])


def _is_test_version():
    return F.col("version").rlike(TEST_VERSION)


def cleanup_preview(versions: DataFrame, regulations: DataFrame, clauses: DataFrame) -> DataFrame:
    """Test versions with their regulation title and clause count."""
    return (
        versions.where(_is_test_version())
        .join(regulations.select("regulation_id", "title"), "regulation_id")
        .join(count_by_version(clauses), "version_id", "left")
        .select("version_id", "version", "title", F.coalesce("clause_count", F.lit(0)).alias("clause_count"))
    )


def cleanup_totals(preview: DataFrame) -> DataFrame:
    return preview.agg(
        F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum("clause_count"), F.lit(0)).alias("clauses")
    )


def cleanup_cascade(
    clauses: DataFrame, versions: DataFrame, regulations: DataFrame, regulators: DataFrame
) -> dict[str, DataFrame]:
    """The four tables as they are after removing test versions and what they leave empty.

    Regulations without any version left go, then regulators without any
    regulation left - also those that had none before.
    """
    kept_versions = versions.where(~F.coalesce(_is_test_version(), F.lit(False)))
    test_ids = versions.where(_is_test_version()).select("version_id")
    kept_clauses = clauses.join(test_ids, "version_id", "left_anti")
    used = kept_versions.where(F.col("regulation_id").isNotNull()).select("regulation_id")
    kept_regulations = regulations.join(used, "regulation_id", "left_semi")
    codes = kept_regulations.where(F.col("regulator_code").isNotNull()).select(F.col("regulator_code").alias("code"))
    return {
        "clauses": kept_clauses,
        "versions": kept_versions,
        "regulations": kept_regulations,
        "regulators": regulators.join(codes, "code", "left_semi"),
    }
