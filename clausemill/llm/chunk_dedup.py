"""Exact de-duplication by content-defined chunk recipes.

A text is cut into chunks where its content says so, so equal stretches of text
give equal chunks. A chunk is named by its hash; the chunk texts are compared
once, and where one hash stands for several texts they get numbers. A document
is then its ordered list of chunk names, and documents are compared by these
short lists: their texts never travel to be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.llm.common import SPACE, saved

#: A chunk has this many characters at least, ends at the next cut, and ends anyway at the largest size.
MIN_CHARS, MAX_CHARS = 512, 4096
#: So many clashing names, 8 bytes each, are broadcast; more are joined by a shuffle.
MAX_BROADCAST_NAMES = 100_000
#: A cut follows such a pair of characters: their code points modulo small numbers, as regular-expression classes.
CUT = r"(?<=[aeiouAEIOU02468à-ÿ一-矿][b-dB-D1357.,;:!?а-р砀-鿿])"


def normalised(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The text cut where its content says so; the parts joined give the text."""
    pattern = rf"(?s).{{{min_chars},{max_chars - 1}}}?{CUT}|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """One row per row of ``docs`` with the document that stays for its text.

    Texts are equal when they are identical without white space. Of equal texts
    the one with the most code points before that stays, then the one with the
    smallest id (rows without an id last); of rows that agree in both, one.

    Gives ``doc_id, keep_id, group_size, kept, n_chars, text_sha256``; other
    columns of ``docs`` are not read. Null texts count as empty, and empty texts
    equal each other. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        normalised(F.col(text_col)).alias("norm"),
    )
    cut = source.select("doc_id", "n_chars", "norm", chunks(F.col("norm"), min_chars, max_chars).alias("parts"))
    rows = saved(
        cut.select(
            "doc_id",
            "n_chars",
            F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
            F.transform("parts", lambda part: chunk_hash(part)).alias("recipe"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "recipes",
    )
    texts = docs.select(normalised(F.col(text_col)).alias("norm")).select(
        F.explode(chunks(F.col("norm"), min_chars, max_chars)).alias("part")
    )
    # Texts that share a hash, numbered: expected to be none, and then no recipe changes.
    per_text = texts.select(chunk_hash(F.col("part")).alias("name"), "part").distinct()
    clashing = saved(per_text.groupBy("name").count().where("count > 1").select("name"), "clashing-names")
    if not clashing.isEmpty():
        if clashing.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES:
            clashing = F.broadcast(clashing)
        numbered = per_text.join(clashing, "name", "left_semi").withColumn(
            "n", F.row_number().over(Window.partitionBy("name").orderBy("part"))
        )
        clashes = saved(numbered, "clashes")
        rows = _told_apart(docs, rows, clashes, clashing, id_col, text_col, chunk_hash, min_chars, max_chars)
    # The second key makes Spark deal both sides of the join anew, so that it can split a recipe many rows share.
    groups = rows.groupBy("recipe").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("m"), F.col("doc_id").isNull().alias("e"), "doc_id", "_row")).alias("best"),
    )
    return rows.withColumn("_hash", F.xxhash64("recipe")).join(groups.withColumn("_hash", F.xxhash64("recipe")), ["_hash", "recipe"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best._row") == F.col("_row")).alias("kept"),
        "n_chars",
        "text_sha256",
    )


def _told_apart(docs, rows, clashes, clashing, id_col, text_col, chunk_hash, min_chars, max_chars) -> DataFrame:
    """``rows`` with the numbers of clashing chunks after the names; other rows keep their recipes.

    Only chunks whose name clashes are moved. Rows are recognised by id, length
    and digest, which is enough: rows that agree in them hold the same chunks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = ["_id", "n_chars", "text_sha256"]
    numbers = (
        docs.select(
            F.col(id_col).alias("_id"),
            F.length(text).cast("long").alias("n_chars"),
            normalised(F.col(text_col)).alias("norm"),
        )
        .select(*key[:2], F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks(F.col("norm"), min_chars, max_chars)).alias("pos", "part"))
        .withColumn("name", chunk_hash(F.col("part")))
        .join(clashing, "name", "left_semi")
        .join(clashes, ["name", "part"])
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("numbers"))
        .select(*key, F.flatten(F.transform("numbers", lambda x: F.array(x["pos"].cast("long"), x["n"].cast("long")))).alias("more"))
    )
    same = (
        rows["doc_id"].eqNullSafe(numbers["_id"])
        & (rows["n_chars"] == numbers["n_chars"])
        & (rows["text_sha256"] == numbers["text_sha256"])
    )
    # The names' count comes first, so no two lists can run into each other.
    recipe = F.concat(F.array(F.size("recipe").cast("long")), F.col("recipe"), F.col("more"))
    return rows.join(numbers, same, "left").select(
        rows["doc_id"],
        rows["n_chars"],
        rows["text_sha256"],
        "_row",
        F.when(F.col("more").isNull(), F.concat(F.array(F.size("recipe").cast("long")), "recipe")).otherwise(recipe).alias("recipe"),
    )
