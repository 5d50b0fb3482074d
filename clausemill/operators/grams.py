"""A stored trigram index of a text column, for LIKE, ILIKE and substring filters.

A filter on ``%part%`` can use neither statistics nor partitions and reads every
text.  The index is two tables: postings (gram, key), one row per row of the
text's table and distinct trigram, ranged and sorted by gram so that the grams
asked for are found by the files' statistics; and counts (gram, n).  A filter
reads the counts of its pattern's grams, the postings of the rarest ones, and
tests the texts of the rows that hold them all.

Trigrams are three characters in a row of the folded text (lower case, final
sigma as sigma), so one index serves filters with and without regard to case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.text import character_runs
from clausemill.operators.catalog import catalog_text_filter
from clausemill.session import saved

GRAM = 3
#: So many postings lists are intersected at most ...
MOST_LISTS = 4
#: ... and none that is so many times as long as the shortest.
LONGER = 16


def folded(text: Column) -> Column:
    """Lower case; what lower case makes of a sigma depends on its neighbours, so both forms count as one."""
    return F.translate(F.lower(text), "ς", "σ")


def literal_runs(pattern: str) -> list[str]:
    """What stands between the wildcards of a LIKE pattern; a backslash makes the next character a literal."""
    runs, run, at = [], "", 0
    while at < len(pattern):
        if pattern[at] in "%_":
            runs.append(run)
            run = ""
        else:
            at += pattern[at] == "\\"
            run += pattern[at : at + 1]
        at += 1
    return [r for r in [*runs, run] if r]


@dataclass(frozen=True)
class GramIndex:
    postings: DataFrame
    counts: DataFrame

    def holders(self, literals: list[str]) -> DataFrame | None:
        """The keys (column ``key``) of rows that may hold all literals, each once; None where any row may.

        Only literals of three characters or more narrow the search.  What comes
        to the driver are the counts of the literals' own grams.
        """
        spark = self.counts.sparkSession
        told = spark.range(1).select(F.array(*[folded(F.lit(s)) for s in literals]).alias("s")).first().s if literals else []
        asked = sorted({s[i : i + GRAM] for s in told for i in range(len(s) - GRAM + 1)})
        if not asked:
            return None
        known = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(asked)).collect()}
        if len(known) < len(asked):
            return self.postings.where(F.lit(False)).select("key")
        by_length = sorted(asked, key=lambda g: (known[g], g))[:MOST_LISTS]
        chosen = [g for g in by_length if known[g] <= LONGER * known[by_length[0]]]
        found = self.postings.where(F.col("gram").isin(chosen)).groupBy("key")
        return found.agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(chosen)).select("key")


def build_gram_index(rows: DataFrame, key: str, text: Column, path: str) -> GramIndex:
    """Write the index of ``text`` in rows, whose ``key`` leads back to them, below ``path``.

    Keys may repeat or be null; texts that are null or shorter than three
    characters have no postings.  The range partitioning is by gram and key, so
    a gram that most texts hold is spread over many files. It samples its input,
    so the entries are written once before; texts are taken apart once.
    """
    letters = F.filter(F.split(folded(text), ""), lambda c: c != "")
    entries = saved(
        rows.select(F.col(key).alias("key"), letters.alias("_letters"))
        .where(F.size("_letters") >= GRAM)
        .select(F.explode(F.array_distinct(character_runs(F.col("_letters"), GRAM))).alias("gram"), "key"),
        "gram-entries",
    )
    entries.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{path}/postings")
    postings = rows.sparkSession.read.schema(entries.schema).parquet(f"{path}/postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return read_gram_index(rows.sparkSession, path)


def read_gram_index(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"))


def _narrowed(rows: DataFrame, key: str, holders: DataFrame | None) -> DataFrame:
    if holders is None:
        return rows
    found = holders.withColumnRenamed("key", "_holder")
    return rows.join(found, rows[key].eqNullSafe(found["_holder"]), "left_semi")


def rows_like(rows: DataFrame, key: str, column: str, pattern: str, index: GramIndex, *, ignore_case: bool = False) -> DataFrame:
    """Rows whose column matches a LIKE pattern (ILIKE with ``ignore_case``), as without an index.

    A pattern without three literal characters in a row reads all rows.  Rows
    that came after the index was built are not found.
    """
    test = F.col(column).ilike(pattern) if ignore_case else F.col(column).like(pattern)
    return _narrowed(rows, key, index.holders(literal_runs(pattern))).where(test)


def rows_containing(rows: DataFrame, key: str, columns: list[str], term: str, index: GramIndex) -> DataFrame:
    """``catalog_text_filter`` over an index of ``joined_columns(columns)``."""
    return catalog_text_filter(_narrowed(rows, key, index.holders([term.lower()])), term, columns)


def joined_columns(columns: list[str]) -> Column:
    """One text whose grams hold those of every column."""
    return F.concat_ws("\n", *columns)
