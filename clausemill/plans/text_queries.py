"""Cleaning, splitting and chunking over the derived regulation pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators import catalog, clean, embed, ingest
from clausemill.operators import clauses as cl
from clausemill.plans import inputs as inp
from clausemill.plans.registry import query, with_ctes
from clausemill.session import saved


def _block_query(name: str, spark_expr, sql_expr) -> None:
    sql = with_ctes(inp.RAW_PAGES, f"SELECT doc_id, page_number, {sql_expr('text')} AS text FROM raw_pages")

    @query(name, sql)
    def run(spark, folder):
        return inp.regulation_pages(spark, folder).select("doc_id", "page_number", spark_expr(F.col("text")).alias("text"))


_block_query("clean_soft_hyphen", tx.drop_soft_hyphens, inp.sql_soft)
_block_query("clean_broken_words", tx.join_broken_words, inp.sql_broken)
_block_query("clean_page_numbers", tx.drop_page_number_lines, inp.sql_no_page_numbers)
_block_query("clean_whitespace", tx.squeeze_whitespace, inp.sql_whitespace)
_block_query("clean_block", clean.clean_block, inp.sql_clean)
_block_query(
    "clean_one_line",
    lambda c: tx.squeeze_whitespace(c, keep_paragraphs=False),
    lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))",
)


@query(
    "clean_header_footer_detect",
    with_ctes(inp.CLEAN_PAGES, "SELECT doc_id, zone, line_key, occurrences FROM c1_furniture"),
)
def header_footer_detect(spark, folder):
    return clean.detect_furniture(inp.regulation_pages(spark, folder))


@query(
    "clean_header_footer_strip",
    with_ctes(inp.CLEAN_PAGES, "SELECT doc_id, page_number, text FROM c1_stripped"),
)
def header_footer_strip(spark, folder):
    pages = inp.regulation_pages(spark, folder)
    return clean.strip_furniture(pages, clean.detect_furniture(pages)).select("doc_id", "page_number", "text")


@query("clean_pages", with_ctes(inp.CLEAN_PAGES, "SELECT doc_id, page_number, text FROM c1_pages"))
def clean_pages(spark, folder):
    return clean.clean_pages(inp.regulation_pages(spark, folder)).select("doc_id", "page_number", "text")


@query(
    "clean_document",
    with_ctes(
        inp.CLEAN_PAGES,
        """SELECT doc_id, coalesce(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY page_number), '') AS text
FROM c1_pages GROUP BY doc_id""",
    ),
)
def clean_document(spark, folder):
    return clean.clean_document(inp.regulation_pages(spark, folder)).select("doc_id", "text")


@query("clean_document_twice", with_ctes(inp.DOC_TEXT, "SELECT doc_id, text FROM doc_text"))
def clean_document_twice(spark, folder):
    return clean.clean_document(inp.regulation_pages(spark, folder), passes=2).select("doc_id", "text")


def _cleaned(spark, folder):
    return clean.clean_pages(inp.regulation_pages(spark, folder)).select("doc_id", "page_number", "text")


def cleaned_of_documents(spark, folder):
    """``_cleaned`` for steps that drop lines without a document: known only above, that would be asked of one branch of
    the cleaning, and the other would read ``documents`` and make the pages a second time."""
    pages = inp.regulation_pages(spark, folder).where(F.col("doc_id").isNotNull())
    return clean.clean_pages(pages).select("doc_id", "page_number", "text")


def _paged(lines):
    return lines.withColumn("page_number", cl.page_of(F.col("ord")))


def _lines(spark, folder):
    return _paged(cl.numbered_lines(cleaned_of_documents(spark, folder), cleaned=True))


@query("lines_explode", with_ctes(inp.CLAUSES, "SELECT doc_id, page_number, i - 1 AS pos, line FROM page_lines"))
def lines_explode(spark, folder):
    pos = F.col("ord").bitwiseAND(F.lit(0xFFFFFFFF))
    return _paged(cl.explode_lines(_cleaned(spark, folder), cleaned=True)).select("doc_id", "page_number", pos.alias("pos"), "line")


@query(
    "merge_standalone_numbers",
    with_ctes(inp.CLAUSES, "SELECT doc_id, page_number, line, count(*) AS n FROM merged GROUP BY ALL"),
)
def merge_standalone_numbers(spark, folder):
    merged = _paged(cl.merge_standalone_numbers(cl.explode_lines(cleaned_of_documents(spark, folder), cleaned=True)))
    return merged.groupBy("doc_id", "page_number", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "classify_line",
    with_ctes(
        inp.CLAUSES,
        """SELECT doc_id, page_number, line, kind, label, rest, header, opens, count(*) AS n
FROM bounds GROUP BY ALL""",
    ),
)
def classify_line(spark, folder):
    typed = _paged(cl.classify_lines(cl.merge_standalone_numbers(cl.explode_lines(cleaned_of_documents(spark, folder), cleaned=True))))
    keys = ["doc_id", "page_number", "line", "kind", "label", "rest", "header", "opens"]
    return typed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "structural_header",
    with_ctes(
        inp.CLAUSES,
        """SELECT doc_id, page_number, header AS section, opens, count(*) AS n
FROM bounds WHERE kind = 'structural' GROUP BY ALL""",
    ),
)
def structural_header(spark, folder):
    typed = _paged(cl.classify_lines(cl.merge_standalone_numbers(cl.explode_lines(cleaned_of_documents(spark, folder), cleaned=True))))
    return (
        typed.where(F.col("kind") == "structural")
        .groupBy("doc_id", "page_number", F.col("header").alias("section"), "opens")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _line_query(name: str, columns: list[str], sql_filter: str, spark_filter) -> None:
    listed = ", ".join(columns)
    sql = with_ctes(inp.CLAUSES, f"SELECT doc_id, page_number, line, {listed}, count(*) AS n FROM numbered WHERE {sql_filter} GROUP BY ALL")

    @query(name, sql)
    def run(spark, folder):
        rows = _lines(spark, folder).where(spark_filter())
        return rows.groupBy("doc_id", "page_number", "line", *columns).agg(F.count(F.lit(1)).alias("n"))


_line_query("clause_number_full", ["clause_number", "section"], "opens", lambda: F.col("opens"))
_line_query("clause_level", ["clause_number", "level"], "opens", lambda: F.col("opens"))


@query(
    "clause_group",
    with_ctes(
        inp.CLAUSES,
        """SELECT doc_id, seq_no AS clause_no, count(*) AS n_lines, min(page_number) AS first_page, max(page_number) AS last_page
FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY open_ord) AS seq_no FROM numbered WHERE open_ord IS NOT NULL)
GROUP BY doc_id, seq_no""",
    ),
)
def clause_group(spark, folder):
    groups = (
        _lines(spark, folder)
        .where(F.col("open_ord").isNotNull())
        .groupBy("doc_id", "open_ord")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.min("page_number").alias("first_page"),
            F.max("page_number").alias("last_page"),
        )
        .withColumn("segment", F.shiftright("open_ord", 40))
    )
    return cl.numbered(saved(groups, "clause-groups"), group=["doc_id"], segment="segment", order=["open_ord"], name="clause_no").select(
        "doc_id", "clause_no", "n_lines", "first_page", "last_page"
    )


@query(
    "preamble",
    with_ctes(
        inp.CLAUSES,
        "SELECT doc_id, text, title, level, page_number, page_end, count(*) AS n FROM preambles GROUP BY ALL",
    ),
)
def preamble(spark, folder):
    rows = cl.group_lines(_lines(spark, folder)).where(F.col("clause_number") == "0")
    return rows.groupBy("doc_id", "text", "title", "level", "page_number", "page_end").agg(
        F.count(F.lit(1)).alias("n")
    )


def _split(spark, folder):
    return cl.split_clauses(cleaned_of_documents(spark, folder), cleaned=True)


def _ordered(clauses):
    """Replace seq by the clause's position in its document; numbering reads the clauses twice, so they are written once."""
    cut = saved(clauses.withColumn("segment", F.shiftright("seq", 41)), "ordered-clauses")
    return cl.numbered(cut, group=["doc_id"], segment="segment", order=["seq"], name="position").drop("segment", "seq")


def _clause_query(name: str, columns: list[str]) -> None:
    listed = ", ".join(columns)
    sql = with_ctes(
        inp.CLAUSES,
        f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS position, clause_number, {listed} FROM clause_rows",
    )

    @query(name, sql)
    def run(spark, folder):
        rows = _split(spark, folder).select("doc_id", "seq", "clause_number", *columns)
        return _ordered(rows).select("doc_id", "position", "clause_number", *columns)


_clause_query("clause_text", ["text"])
_clause_query("clause_pages", ["page_number", "page_end"])
_clause_query("parent_clause", ["parent_clause", "section"])
_clause_query(
    "split_clauses", ["level", "title", "text", "parent_clause", "section", "page_number", "page_end"]
)


@query(
    "clause_min_length",
    with_ctes(
        inp.CLAUSES,
        """SELECT doc_id, count(*) AS kept, count(*) FILTER (length(text) < 10) AS short_but_titled
FROM clause_rows GROUP BY doc_id""",
    ),
)
def clause_min_length(spark, folder):
    return (
        _split(spark, folder)
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.length("text") < cl.MIN_CLAUSE_CHARS).alias("short_but_titled"))
    )


@query(
    "merge_chunks_by_number",
    with_ctes(
        inp.CLAUSES,
        """SELECT doc_id, clause_number, level, title, parent_clause, section, page_number, text, page_end, n_merged
FROM merged_numbers""",
    ),
)
def merge_chunks_by_number(spark, folder):
    return cl.merge_by_number(_split(spark, folder)).drop("seq")


@query(
    "chunk_policy",
    with_ctes(
        inp.CLAUSES,
        """SELECT * FROM (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INTEGER) AS chunk_index, text AS content,
    nullif(trim(CASE WHEN section <> '' THEN section ELSE title END), '') AS section_title,
    nullif(nullif(clause_number, '0'), '') AS clause_reference, page_number, page_end
  FROM merged_numbers) m
WHERE content <> ''""",
    ),
)
def chunk_policy(spark, folder):
    return cl.chunk_policy(_split(spark, folder)).drop("metadata")


@query(
    "duplicate_clause_report",
    with_ctes(
        inp.CLAUSES,
        r"""SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_clauses, count(*) AS unique_numbers, count(*) FILTER (n > 1) AS duplicate_numbers,
  coalesce(list(clause_number ORDER BY clause_number) FILTER (n > 1), []) AS duplicate_ids,
  coalesce(list(pages ORDER BY clause_number) FILTER (n > 1), []) AS duplicate_pages,
  coalesce(list(texts ORDER BY clause_number) FILTER (n > 1), []) AS duplicate_texts
FROM (SELECT doc_id, clause_number, count(*) AS n, list(page_number ORDER BY seq) AS pages,
        list(regexp_replace(text, '[^\x00-\x7F]', '?', 'g') ORDER BY seq) AS texts FROM clause_rows GROUP BY doc_id, clause_number) g
GROUP BY doc_id""",
    ),
)
def duplicate_clause_report(spark, folder):
    return catalog.duplicate_clause_report(_split(spark, folder))


@query(
    "duplicate_clause_groups",
    with_ctes(
        inp.CLAUSES,
        """SELECT c.doc_id, c.clause_number, c.page_number, c.text, m.n_merged AS occurrences, count(*) AS n
FROM clause_rows c JOIN merged_numbers m ON m.doc_id = c.doc_id AND m.clause_number = c.clause_number
WHERE m.n_merged > 1 GROUP BY ALL""",
    ),
)
def duplicate_clause_groups(spark, folder):
    rows = catalog.duplicate_clause_groups(_split(spark, folder))
    return rows.groupBy("doc_id", "clause_number", "page_number", "text", "occurrences").agg(
        F.count(F.lit(1)).alias("n")
    )


def _files(spark, folder):
    documents = inp.table(spark, folder, "documents")
    return documents.select("doc_id", inp.file_name(F.col("doc_id"), F.col("source")).alias("filename"))


@query(
    "dedupe_regulatory_clauses",
    with_ctes(
        inp.CLAUSES,
        """SELECT doc_id AS version_id, m.clause_number, m.n_merged,
  CASE WHEN n_merged = 1 THEN first_text ELSE m.text END AS text, min_page AS page_number, max_end AS page_end,
  nullif(m.title, '') AS title, last_level, last_title
FROM merged_numbers m JOIN (SELECT doc_id, clause_number, arg_min(text, seq) AS first_text, min(page_number) AS min_page,
    max(page_end) AS max_end, arg_max(level, seq) AS last_level, arg_max(nullif(title, ''), seq) AS last_title
  FROM clause_rows GROUP BY doc_id, clause_number) x USING (doc_id, clause_number)""",
    ),
)
def dedupe_regulatory_clauses(spark, folder):
    result = ingest.ingest_regulations(inp.regulation_pages(spark, folder, by_document=True), _files(spark, folder), dim=64)
    return result.clauses.select(
        "version_id",
        "clause_number",
        "n_merged",
        "text",
        "page_number",
        "page_end",
        "title",
        F.col("metadata.level").alias("last_level"),
        F.col("metadata.title").alias("last_title"),
    )


@query(
    "average_embedding_fallback",
    """SELECT CAST(label AS BIGINT) AS version_id, CAST(vec_id % 7 AS VARCHAR) AS clause_number, i - 1 AS i, round(avg(x), 6) AS x
FROM (SELECT label, vec_id, unnest(list_transform(embedding, lambda v: v::DOUBLE)) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
GROUP BY ALL""",
)
def average_embedding_fallback(spark, folder):
    rows = inp.table(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("version_id"),
        (F.col("vec_id") % 7).cast("string").alias("clause_number"),
        "embedding",
    )
    means = embed.mean_vectors(rows, ["version_id", "clause_number"])
    flat = means.select("version_id", "clause_number", F.posexplode("embedding").alias("i", "x"))
    return flat.select("version_id", "clause_number", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
