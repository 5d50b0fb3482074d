"""Reading uploads and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MANIFEST_TYPE = (
    "filename string, title string, regulator string, category string, "
    "applicability array<string>, source_type string"
)
DEFAULT_REGULATOR = "RBI"
DEFAULT_SOURCE_TYPE = "regulatory_document"


def read_files(
    spark: SparkSession, path: str, announced: DataFrame | None = None, *, max_bytes: int = MAX_UPLOAD_BYTES
) -> DataFrame:
    """(filename, content, length) of the files below a folder; names are relative to it.

    The content of files above ``max_bytes`` is not loaded.  Spark's file index
    passes over empty files: with ``announced(filename[, length])``, a table of
    the uploads that should be there, such files appear with their announced
    length (0) and missing ones with null.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substr("path", F.lit(len(root.rstrip("/")) + 2)).alias("filename")
    fitting = found.where(F.col("length") <= max_bytes).select(name, "content", "length")
    others = found.where(F.col("length") > max_bytes).select(name, F.lit(None).cast("binary").alias("content"), "length")
    found = fitting.unionByName(others)
    if announced is None:
        return found
    said = "_said" if "length" in announced.columns else None
    wanted = announced.select("filename", *([F.col("length").alias(said)] if said else []))
    length = F.coalesce("length", said) if said else F.col("length")
    return wanted.join(found, "filename", "left").select("filename", "content", length.alias("length"))


def upload_error(filename: Column, content: Column, length: Column, *, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """The first failed check of an upload, or null; a missing file has neither content nor length."""
    # The messages.
    return (
        F.when(content.isNull() & length.isNull(), F.concat(F.lit("PDF file not found: '"), filename, F.lit("'")))
        .when(~F.endswith(F.lower(filename), F.lit(".pdf")), F.lit("Unsupported file type. Only PDF uploads are accepted."))
        .when(length == 0, F.lit("Uploaded file is empty"))
        .when(length > max_bytes, F.lit(f"Uploaded file exceeds the maximum size of {max_bytes} bytes"))
        .when(content.isNull() | (F.hex(F.substring(content, 1, 4)) != "25504446"), F.lit("Uploaded file is not a valid PDF"))
    )


def validate_uploads(files: DataFrame, *, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    error = upload_error(F.col("filename"), F.col("content"), F.col("length"), max_bytes=max_bytes)
    return files.select(
        *[F.col(c) for c in files.columns if c != "content"],
        F.when(error.isNull(), F.lit("valid")).otherwise(F.lit("invalid")).alias("status"),
        error.alias("error"),
    )


def page_totals(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages) of a pages table."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"))


def with_total_pages(pages: DataFrame) -> DataFrame:
    return pages.join(page_totals(pages), "doc_id")


def read_manifest(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """A JSON array per file, or with ``multi_line=False`` one entry per line."""
    return spark.read.schema(MANIFEST_TYPE).json(path, multiLine=multi_line)


def apply_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(filename, ...) with title, regulator and source type, in processing order.

    Of several manifest entries for a name one is taken.  Names containing
    'nbfc' come first, then by lower-cased name.
    """
    entry = manifest.groupBy("filename").agg(
        F.max(F.struct("title", "regulator", "source_type")).alias("_m")
    )
    named = files.join(entry, "filename", "left").select(
        *[F.col(c) for c in files.columns],
        F.col("_m.title").alias("title"),
        F.coalesce("_m.regulator", F.lit(DEFAULT_REGULATOR)).alias("regulator"),
        F.coalesce("_m.source_type", F.lit(DEFAULT_SOURCE_TYPE)).alias("source_type"),
    )
    return named.orderBy(
        F.when(F.contains(F.lower("filename"), F.lit("nbfc")), 0).otherwise(1), F.lower("filename"), "filename"
    )
