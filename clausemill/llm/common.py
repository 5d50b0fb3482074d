"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.session import work_dir

#: Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows without an id come after all others wherever documents are ordered by id.
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``frame`` written once below ``spark.checkpoint.dir`` and read back.

    This cuts the lineage: later steps read the files, and lost executors cost
    no more than the tasks that ran on them.
    """
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def order_id(name: str = "doc_id") -> Column:
    """The id by which documents are ordered, nulls last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def row_key(name: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart although ids may be null or repeated; rows that agree hold the same text."""
    return [
        F.coalesce(F.col(name).cast("long"), F.lit(0)).alias("_k_id"),
        F.col(name).isNull().alias("_k_null"),
        F.xxhash64(F.col(text)).alias("_k_text"),
    ]


def unused(frame: DataFrame, name: str) -> str:
    """``name``, or a longer one if a column of ``frame`` is already called so (Spark ignores case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
