"""The operators' logical inputs, derived from the given tables.

The tables hold prose without clause numbers or page furniture, so both are
added by position: every transformation here exists twice, as Spark
expressions and as SQL text for the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.text import SOFT_HYPHEN, bind
from clausemill.plans.registry import table

LINES_PER_PAGE = 8

# ---------------------------------------------------------------- pages


def _line(line: Column, i: Column, doc_id: Column) -> Column:
    """Give the line at position i of a document a role: header, number, break ..."""
    role = (i + doc_id) % 12
    k = (F.floor(i / 12) + 1).cast("string")
    header = F.when(k.cast("int") % 2 == 0, F.concat(F.lit("Chapter "), k)).otherwise(
        F.concat(F.lit("Section "), k, F.lit(" — Topic of obligations"))
    )
    return (
        F.when(role == 0, F.concat(header, F.lit("\n"), line))
        .when(role == 1, F.concat(k, F.lit(". "), line))
        .when(role == 2, F.replace(line, F.lit("tion"), F.lit("ti- on")))
        .when(role == 3, F.concat(F.lit("(1) "), line))
        .when(role == 4, F.concat(F.lit("  "), line, F.lit(" \t x")))
        .when(role == 5, F.concat(F.lit("(a) "), line))
        .when(role == 6, F.concat(F.lit("(i) "), line))
        .when(role == 7, F.concat(F.lit("(ii) "), line))
        .when(role == 8, F.concat(F.lit("\n\n\n"), line))
        .when(role == 9, F.concat(k, F.lit("."), (i % 7).cast("string"), F.lit("\n"), line))
        .when(role == 10, F.concat(F.lit("12\n"), line))
        .otherwise(F.concat(F.substring(line, 1, 1), F.lit(SOFT_HYPHEN), F.expr("substring(line, 2)")))
    )


def regulation_pages(spark: SparkSession, folder: str, *, by_document: bool = False) -> DataFrame:
    """documents -> (doc_id, source, page_number, text) with numbering and furniture.

    ``by_document`` shuffles the documents instead of their pages, so that steps
    by document that follow find them together.
    """
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return pages_of_documents(documents.repartition("doc_id") if by_document else documents)


def pages_of_documents(documents: DataFrame) -> DataFrame:
    parts = F.split("text", "\n", -1)
    # Each line brings its number and the count: a size of ``parts`` beside the lines would be planned above them
    # and split the whole text again for every line.
    numbered = bind(
        parts,
        lambda p: F.transform(p, lambda line, i: F.struct(i.alias("i"), line.alias("line"), F.size(p).alias("n"))),
    )
    n_pages = F.ceil(F.col("l.n") / LINES_PER_PAGE).cast("int")
    lines = documents.select("doc_id", "source", F.explode(numbered).alias("l")).select(
        "doc_id", "source", n_pages.alias("n_pages"), "l.i", "l.line"
    )
    worded = lines.withColumn("line", _line(F.col("line"), F.col("i"), F.col("doc_id")))
    page = (F.floor(F.col("i") / LINES_PER_PAGE) + 1).cast("int")
    bodies = (
        worded.withColumn("page_number", page)
        .groupBy("doc_id", "source", "page_number", "n_pages")
        .agg(F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY i)").alias("body"))
    )
    return bodies.select(
        "doc_id",
        "source",
        "page_number",
        F.concat(
            F.lit("Source "), F.col("source"), F.lit("\n"), F.col("body"),
            F.when(F.col("page_number") % 2 == 0, F.lit("\nCONFIDENTIAL   copy")).otherwise(F.lit("\nConfidential copy")),
            F.lit("\nPage "), F.col("page_number").cast("string"), F.lit(" of "), F.col("n_pages").cast("string"),
        ).alias("text"),
    )


RAW_PAGES = {
    "doc_lines": """
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents""",
    "role_lines": """
  SELECT doc_id, source, i, i // 8 + 1 AS page_number,
    CASE (i + doc_id) % 12
      WHEN 0 THEN CASE WHEN (i // 12 + 1) % 2 = 0 THEN 'Chapter ' || (i // 12 + 1)
                       ELSE 'Section ' || (i // 12 + 1) || ' — Topic of obligations' END || chr(10) || line
      WHEN 1 THEN (i // 12 + 1) || '. ' || line
      WHEN 2 THEN replace(line, 'tion', 'ti- on')
      WHEN 3 THEN '(1) ' || line
      WHEN 4 THEN '  ' || line || ' ' || chr(9) || ' x'
      WHEN 5 THEN '(a) ' || line
      WHEN 6 THEN '(i) ' || line
      WHEN 7 THEN '(ii) ' || line
      WHEN 8 THEN chr(10) || chr(10) || chr(10) || line
      WHEN 9 THEN (i // 12 + 1) || '.' || (i % 7) || chr(10) || line
      WHEN 10 THEN '12' || chr(10) || line
      ELSE substr(line, 1, 1) || chr(173) || substr(line, 2)
    END AS line
  FROM doc_lines""",
    "page_bodies": """
  SELECT doc_id, source, page_number, string_agg(line, chr(10) ORDER BY i) AS body
  FROM role_lines GROUP BY ALL""",
    "raw_pages": """
  SELECT doc_id, source, page_number,
    'Source ' || source || chr(10) || body || chr(10)
      || CASE WHEN page_number % 2 = 0 THEN 'CONFIDENTIAL   copy' ELSE 'Confidential copy' END
      || chr(10) || 'Page ' || page_number || ' of ' || count(*) OVER (PARTITION BY doc_id) AS text
  FROM page_bodies""",
}

_LETTER = r"[0-9A-Za-z_\x{00C0}-\x{024F}]"
SQL_PAGE_NUMBER = (
    r"(?i)^\s*(\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|page\s+\d+(\s+of\s+\d+)?|\[\s*\d+\s*\])\s*$"
)


def sql_line_key(line: str) -> str:
    return rf"regexp_replace(lower(trim({line}, ' ' || chr(9))), '\s+', ' ', 'g')"


def sql_soft(x: str) -> str:
    return f"replace({x}, chr(173), '')"


def sql_broken(x: str) -> str:
    once = rf"regexp_replace({x}, '({_LETTER})-\s+({_LETTER})', '\1\2', 'g')"
    return rf"regexp_replace({once}, '({_LETTER})-\s+({_LETTER})', '\1\2', 'g')"


def sql_no_page_numbers(x: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({x}, chr(10)), "
        f"lambda l: NOT regexp_matches(l, '{SQL_PAGE_NUMBER}')), chr(10))"
    )


def sql_whitespace(x: str) -> str:
    tidy = (
        f"array_to_string(list_transform(string_split({x}, chr(10)), "
        r"lambda l: regexp_replace(trim(l, ' ' || chr(9)), '[ \t]+', ' ', 'g')), chr(10))"
    )
    return rf"regexp_replace(trim({tidy}, ' ' || chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"


def sql_clean(x: str) -> str:
    return sql_whitespace(sql_no_page_numbers(sql_broken(sql_soft(x))))


def clean_ctes(pages: str, prefix: str) -> dict[str, str]:
    """CTEs ``<prefix>furniture`` and ``<prefix>pages`` from a pages CTE."""
    return {
        f"{prefix}keys": f"""
  SELECT doc_id, page_number,
    list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_line_key('l')}), lambda k: k <> '') AS ks
  FROM {pages}""",
        f"{prefix}furniture": f"""
  SELECT z.doc_id, zone, line_key, count(*) AS occurrences
  FROM (SELECT doc_id, 'header' AS zone, unnest(ks[1:3]) AS line_key FROM {prefix}keys
        UNION ALL
        SELECT doc_id, 'footer', unnest(ks[greatest(len(ks) - 2, 1):]) FROM {prefix}keys) z
  JOIN (SELECT doc_id, count(*) AS n_pages FROM {pages} GROUP BY 1) t ON t.doc_id = z.doc_id AND n_pages >= 2
  GROUP BY z.doc_id, zone, line_key, n_pages
  HAVING count(*) >= greatest(2, CAST(floor(n_pages * 0.6::DOUBLE) AS BIGINT))""",
        f"{prefix}stripped": f"""
  SELECT p.doc_id, p.page_number,
    CASE WHEN f.ks IS NULL THEN p.text
         ELSE array_to_string(list_filter(string_split(p.text, chr(10)),
                lambda l: NOT list_contains(f.ks, {sql_line_key('l')})), chr(10)) END AS text
  FROM {pages} p LEFT JOIN (SELECT doc_id, list(DISTINCT line_key) AS ks FROM {prefix}furniture GROUP BY 1) f
    ON f.doc_id = p.doc_id""",
        f"{prefix}pages": f"SELECT doc_id, page_number, {sql_clean('text')} AS text FROM {prefix}stripped",
    }


CLEAN_PAGES = {**RAW_PAGES, **clean_ctes("raw_pages", "c1_")}
DOC_TEXT = {
    **CLEAN_PAGES,
    **clean_ctes("c1_pages", "c2_"),
    "doc_text": """
  SELECT doc_id, coalesce(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY page_number), '') AS text
  FROM c2_pages GROUP BY doc_id""",
}

# ---------------------------------------------------------------- clauses

_NUM = r"^(\d+(\.\d+){0,3})[.\s][ \t]*(.+)$"
_STR = r"^(Section|Article|Rule|Chapter)\s+([A-Za-z0-9]+(\.[A-Za-z0-9]+)*)[ \t]*[:\-—]?\s*(.*)$"
_PAREN = r"^\((\d+)\)[ \t]+(.+)$"
_ALPHA = r"(?i)^\(([a-z])\)[ \t]+(.+)$"
_ROMAN = r"(?i)^\(([ivxlc]+)\)[ \t]+(.+)$"

CLAUSES = {
    **CLEAN_PAGES,
    "page_lines": """
  SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM c1_pages WHERE text <> ''""",
    "all_lines": r"""
  SELECT doc_id, page_number, line,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_number, i) AS ord,
    regexp_matches(line, '(?i)^(\d+(\.\d+){0,3}\.?|\(\d+\)|\([a-z]\)|\([ivxlc]+\))$') AS alone
  FROM page_lines""",
    "filled": """
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord)
          - row_number() OVER (PARTITION BY doc_id, alone ORDER BY ord) AS island,
         lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS next_line
  FROM all_lines WHERE line <> ''""",
    "starters": """
  SELECT *, alone AND next_line IS NOT NULL
            AND row_number() OVER (PARTITION BY doc_id, alone, island ORDER BY ord) % 2 = 1 AS starts
  FROM filled""",
    "marked": """
  SELECT a.doc_id, a.page_number, a.ord, a.line, coalesce(s.starts, false) AS starts, s.next_line,
    coalesce(last_value(s.starts IGNORE NULLS) OVER (
      PARTITION BY a.doc_id ORDER BY a.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_start
  FROM all_lines a LEFT JOIN starters s ON s.doc_id = a.doc_id AND s.ord = a.ord""",
    "merged": """
  SELECT doc_id, page_number, ord, CASE WHEN starts THEN line || ' ' || next_line ELSE line END AS line
  FROM marked WHERE NOT after_start""",
    "typed": f"""
  SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{_STR}') THEN 'structural'
      WHEN regexp_matches(line, '{_NUM}') THEN 'numeric' WHEN regexp_matches(line, '{_PAREN}') THEN 'paren'
      WHEN regexp_matches(line, '{_ALPHA}') THEN 'alpha' WHEN regexp_matches(line, '{_ROMAN}') THEN 'roman'
      ELSE 'body' END AS kind
  FROM merged""",
    "parts": f"""
  SELECT *,
    CASE kind WHEN 'structural' THEN regexp_extract(line, '{_STR}', 2) WHEN 'numeric' THEN regexp_extract(line, '{_NUM}', 1)
      WHEN 'paren' THEN regexp_extract(line, '{_PAREN}', 1) WHEN 'alpha' THEN lower(regexp_extract(line, '{_ALPHA}', 1))
      WHEN 'roman' THEN lower(regexp_extract(line, '{_ROMAN}', 1)) END AS label,
    CASE kind WHEN 'structural' THEN trim(regexp_extract(line, '{_STR}', 4)) WHEN 'numeric' THEN trim(regexp_extract(line, '{_NUM}', 3))
      WHEN 'paren' THEN trim(regexp_extract(line, '{_PAREN}', 2)) WHEN 'alpha' THEN trim(regexp_extract(line, '{_ALPHA}', 2))
      WHEN 'roman' THEN trim(regexp_extract(line, '{_ROMAN}', 2)) END AS rest,
    CASE WHEN kind = 'structural' THEN regexp_extract(line, '{_STR}', 1) END AS keyword
  FROM typed""",
    "bounds": """
  SELECT *,
    CASE WHEN kind IN ('blank', 'body') THEN NULL
         WHEN kind = 'structural' THEN keyword <> 'Chapter' AND length(rest) >= 10 ELSE true END AS opens,
    CASE WHEN kind = 'structural' THEN keyword || ' ' || label || CASE WHEN rest <> '' THEN ' — ' || rest ELSE '' END END AS header
  FROM parts""",
    "level1": """
  SELECT *,
    coalesce(last_value(opens IGNORE NULLS) OVER before_row, false) AS open_before,
    coalesce(last_value(header IGNORE NULLS) OVER upto_row, '') AS section,
    coalesce(last_value(CASE WHEN kind = 'numeric' THEN label END IGNORE NULLS) OVER before_row, '') AS num,
    last_value(CASE WHEN opens IS NOT NULL THEN ord END IGNORE NULLS) OVER upto_row AS bound_ord,
    last_value(opens IGNORE NULLS) OVER upto_row AS open_now
  FROM bounds
  WINDOW before_row AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto_row AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "level2": """
  SELECT *, coalesce(last_value(CASE kind WHEN 'numeric' THEN label WHEN 'paren' THEN num || '(' || label || ')' END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS sub
  FROM level1""",
    "level3": """
  SELECT *, coalesce(last_value(CASE kind WHEN 'numeric' THEN label WHEN 'paren' THEN num || '(' || label || ')'
                                          WHEN 'alpha' THEN sub || '(' || label || ')' END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS alp,
    length(num) - length(replace(num, '.', '')) AS dots,
    kind = 'numeric' AND NOT open_before AS flush
  FROM level2""",
    "numbered": """
  SELECT *,
    CASE kind WHEN 'structural' THEN label WHEN 'numeric' THEN label WHEN 'paren' THEN num || '(' || label || ')'
      WHEN 'alpha' THEN sub || '(' || label || ')' WHEN 'roman' THEN alp || '(' || label || ')' END AS clause_number,
    CASE kind WHEN 'structural' THEN 1 WHEN 'numeric' THEN length(label) - length(replace(label, '.', '')) + 1
      WHEN 'paren' THEN dots + 2 WHEN 'alpha' THEN dots + 2 WHEN 'roman' THEN dots + 3 END AS level,
    CASE WHEN open_now THEN bound_ord END AS open_ord,
    count(*) FILTER (flush) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_flush
  FROM level3""",
    "opened": """
  SELECT doc_id, open_ord * 2 + 1 AS seq,
    max(CASE WHEN ord = open_ord THEN clause_number END) AS clause_number,
    max(CASE WHEN ord = open_ord THEN level END) AS level,
    max(CASE WHEN ord = open_ord THEN rest END) AS title,
    coalesce(string_agg(CASE WHEN ord = open_ord AND kind <> 'structural' THEN rest ELSE nullif(line, '') END, ' ' ORDER BY ord), '') AS text,
    max(CASE WHEN ord = open_ord THEN section END) AS section,
    arg_min(page_number, ord) AS page_number, arg_max(page_number, ord) AS page_end
  FROM numbered WHERE open_ord IS NOT NULL GROUP BY doc_id, open_ord""",
    "preambles": """
  SELECT g.doc_id, coalesce(f.ord * 2, 9223372036854775807) AS seq, '0' AS clause_number, 0 AS level, 'Preamble' AS title,
    g.text, '' AS section, g.page_number, g.page_end
  FROM (SELECT doc_id, n_flush, string_agg(nullif(line, ''), ' ' ORDER BY ord) AS text,
          arg_min(page_number, ord) AS page_number, arg_max(page_number, ord) AS page_end
        FROM numbered WHERE opens IS NULL AND NOT open_before GROUP BY doc_id, n_flush) g
  LEFT JOIN (SELECT doc_id, n_flush, ord FROM numbered WHERE flush) f ON f.doc_id = g.doc_id AND f.n_flush = g.n_flush + 1
  LEFT JOIN (SELECT doc_id, coalesce(arg_max(opens, ord) FILTER (opens IS NOT NULL), false) AS ends_open
             FROM numbered GROUP BY doc_id) e ON e.doc_id = g.doc_id
  WHERE length(g.text) >= 10 AND (f.ord IS NOT NULL OR NOT e.ends_open)""",
    "clause_rows": r"""
  SELECT doc_id, seq, clause_number, CAST(level AS INTEGER) AS level, title, text,
    CASE WHEN regexp_matches(clause_number, '^\([a-z]+\)$') THEN section
         WHEN contains(clause_number, '.') THEN regexp_extract(clause_number, '^(.*)\.[^.]*$', 1) ELSE '' END AS parent_clause,
    section, page_number, page_end
  FROM (SELECT doc_id, seq, clause_number, level, title, text, section, page_number, page_end FROM opened
        UNION ALL SELECT doc_id, seq, clause_number, level, title, text, section, page_number, page_end FROM preambles) u
  WHERE length(text) >= 10 OR title <> ''""",
    "merged_numbers": """
  SELECT doc_id, clause_number, min(seq) AS seq, count(*) AS n_merged,
    arg_min(level, seq) AS level, arg_min(title, seq) AS title, arg_min(section, seq) AS section,
    arg_min(parent_clause, seq) AS parent_clause, arg_min(page_number, seq) AS page_number,
    coalesce(string_agg(nullif(trim(text), ''), ' ' ORDER BY seq), '') AS text, arg_max(page_end, seq) AS page_end
  FROM clause_rows GROUP BY doc_id, clause_number""",
}

# ---------------------------------------------------------------- files and metadata


def file_name(doc_id: Column, source: Column) -> Column:
    """rbi_v2_src3.pdf, iso-src4.pdf, SEBI_src5.txt ... by document id."""
    return (
        F.when(doc_id % 5 == 0, F.concat(F.lit("rbi_v"), (doc_id % 3).cast("string"), F.lit("_"), source, F.lit(".pdf")))
        .when(doc_id % 5 == 1, F.concat(F.lit("ISO "), source, F.lit(".pdf")))
        .when(doc_id % 5 == 2, F.concat(F.lit("up/SEBI "), source, F.lit(".txt")))
        .when(doc_id % 5 == 3, F.concat(F.lit("nbfc-circular-"), source, F.lit(".PDF")))
        .otherwise(F.concat(F.lit("plain o'file "), source))
    )


SQL_FILE_NAME = """CASE doc_id % 5 WHEN 0 THEN 'rbi_v' || (doc_id % 3) || '_' || source || '.pdf'
  WHEN 1 THEN 'ISO ' || source || '.pdf' WHEN 2 THEN 'up/SEBI ' || source || '.txt'
  WHEN 3 THEN 'nbfc-circular-' || source || '.PDF' ELSE 'plain o''file ' || source END"""


def regulation_texts(spark: SparkSession, folder: str) -> DataFrame:
    """documents -> (doc_id, filename, text) whose text names regulators, types, dates, versions."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    doc_id = F.col("doc_id")
    day = (doc_id % 28 + 1).cast("string")
    month = (doc_id % 12 + 1).cast("string")
    year = (doc_id % 60 + 1990).cast("string")
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    who = (
        F.when(doc_id % 7 == 0, F.lit("Reserve Bank of India\n"))
        .when(doc_id % 7 == 1, F.lit("The Securities and  Exchange Board says\n"))
        .when(doc_id % 7 == 2, F.lit("PCI DSS controls\n"))
        .otherwise(F.lit(""))
    )
    what = (
        F.when(doc_id % 8 == 0, F.lit("Master  Direction on records\n"))
        .when(doc_id % 8 == 1, F.lit("These guidelines apply\n"))
        .when(doc_id % 8 == 2, F.lit("An act and its policies\n"))
        .otherwise(F.lit(""))
    )
    when = (
        F.when(doc_id % 4 == 0, F.concat(F.lit("Effective from "), day, F.lit("th "), F.element_at(names, (doc_id % 12 + 1).cast("int")), F.lit(", "), year))
        .when(doc_id % 4 == 1, F.concat(F.lit("Issued: "), year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")))
        .when(doc_id % 4 == 2, F.concat(F.lit("on "), F.lpad(day, 2, "0"), F.lit("/"), F.lpad(month, 2, "0"), F.lit("/"), year))
        .otherwise(F.lit("undated"))
    )
    extra = (
        F.when(doc_id % 9 == 0, F.concat(F.lit("\nversion: "), (doc_id % 5).cast("string"), F.lit(".1 of chapter "), (doc_id % 6).cast("string"), F.lit("A: Scope of\nrules")))
        .when(doc_id % 9 == 1, F.concat(F.lit("\nArticle "), (doc_id % 6).cast("string"), F.lit(".2 general duties")))
        .otherwise(F.lit(""))
    )
    return docs.select(
        "doc_id",
        file_name(doc_id, F.col("source")).alias("filename"),
        F.concat(who, what, when, extra, F.lit("\n"), F.col("text")).alias("text"),
    )


# Month names as they stand in the derived texts.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)

REG_TEXTS = {
    "reg_texts": f"""
  SELECT doc_id, {SQL_FILE_NAME} AS filename,
    CASE doc_id % 7 WHEN 0 THEN 'Reserve Bank of India' || chr(10)
      WHEN 1 THEN 'The Securities and  Exchange Board says' || chr(10) WHEN 2 THEN 'PCI DSS controls' || chr(10) ELSE '' END
    || CASE doc_id % 8 WHEN 0 THEN 'Master  Direction on records' || chr(10)
      WHEN 1 THEN 'These guidelines apply' || chr(10) WHEN 2 THEN 'An act and its policies' || chr(10) ELSE '' END
    || CASE doc_id % 4
      WHEN 0 THEN 'Effective from ' || (doc_id % 28 + 1) || 'th ' || [{", ".join(f"'{m}'" for m in MONTH_NAMES)}][doc_id % 12 + 1]
                  || ', ' || (doc_id % 60 + 1990)
      WHEN 1 THEN 'Issued: ' || (doc_id % 60 + 1990) || '-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-'
                  || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')
      WHEN 2 THEN 'on ' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0')
                  || '/' || (doc_id % 60 + 1990)
      ELSE 'undated' END
    || CASE doc_id % 9 WHEN 0 THEN chr(10) || 'version: ' || (doc_id % 5) || '.1 of chapter ' || (doc_id % 6) || 'A: Scope of' || chr(10) || 'rules'
      WHEN 1 THEN chr(10) || 'Article ' || (doc_id % 6) || '.2 general duties' ELSE '' END
    || chr(10) || text AS text
  FROM documents""",
}

# ---------------------------------------------------------------- vectors

POLICY_THRESHOLD = 0.2  # the given vectors hardly reach the default of 0.60
POLICY_CUT = 0.3


def reg_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors: regulatory clauses, spread over all versions, with a metadata struct."""
    e = table(spark, folder, "embeddings")
    n_versions = table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    v = F.col("vec_id")
    return e.select(
        v.alias("clause_id"),
        (v % n_versions + 1).alias("version_id"),
        F.concat((v % 30).cast("string"), F.lit("."), (v % 4).cast("string")).alias("clause_number"),
        F.concat(F.lit("Section "), (v % 7).cast("string"), F.when(v % 3 == 0, F.lit(" Data Retention")).otherwise(F.lit(""))).alias("section"),
        F.concat(F.lit("Clause "), v.cast("string"), F.lit(" of topic "), F.col("label").cast("string")).alias("text"),
        (v % 20 + 1).cast("int").alias("page_number"),
        F.struct(
            F.when(v % 6 == 0, F.concat(F.lit("Direction "), (v % 5).cast("string"))).alias("document_name"),
            F.when(v % 10 == 0, F.lit("ASIA")).alias("regulator"),
            F.when(v % 14 == 0, F.lit("EU")).alias("jurisdiction"),
            F.when(v % 22 == 0, F.lit("ACT")).alias("document_type"),
        ).alias("metadata"),
        "embedding",
        "label",
    )


REG_CLAUSES = {
    "reg_clauses": """
  SELECT vec_id AS clause_id, vec_id % (SELECT count(*) FROM supplier) + 1 AS version_id, (vec_id % 30) || '.' || (vec_id % 4) AS clause_number,
    'Section ' || (vec_id % 7) || CASE WHEN vec_id % 3 = 0 THEN ' Data Retention' ELSE '' END AS section,
    'Clause ' || vec_id || ' of topic ' || label AS text, CAST(vec_id % 20 + 1 AS INTEGER) AS page_number,
    CASE WHEN vec_id % 6 = 0 THEN 'Direction ' || (vec_id % 5) END AS m_document_name,
    CASE WHEN vec_id % 10 = 0 THEN 'ASIA' END AS m_regulator,
    CASE WHEN vec_id % 14 = 0 THEN 'EU' END AS m_jurisdiction,
    CASE WHEN vec_id % 22 = 0 THEN 'ACT' END AS m_document_type,
    list_transform(embedding, lambda x: x::DOUBLE) AS embedding, label
  FROM embeddings""",
}


def org_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors: policy chunks of organisation = label, three documents each."""
    e = table(spark, folder, "embeddings")
    v = F.col("vec_id")
    part = F.floor(v / 2) % 3
    return e.select(
        v.alias("chunk_id"),
        (F.col("label") * 3 + part).cast("long").alias("document_id"),
        F.col("label").cast("long").alias("organization_id"),
        F.floor(v / 6).cast("int").alias("chunk_index"),
        F.when(v % 5 != 0, F.concat(F.lit("Part "), (v % 11).cast("string"))).alias("section_title"),
        F.when(v % 7 != 0, (v % 13).cast("string")).alias("clause_reference"),
        F.concat(F.lit("Policy text "), v.cast("string"), F.lit(" ")).alias("content"),
        "embedding",
    )


def org_documents(spark: SparkSession, folder: str) -> DataFrame:
    ids = org_chunks(spark, folder).select("document_id", "organization_id").distinct()
    d = F.col("document_id")
    return ids.select(
        "document_id",
        "organization_id",
        F.concat(F.lit("Policy "), d.cast("string")).alias("document_name"),
        F.when(d % 4 != 0, F.concat(F.lit("policy_"), d.cast("string"), F.lit(".pdf"))).alias("source_filename"),
        F.when(d % 5 == 0, F.lit("")).when(d % 5 == 1, F.lit("KYC_POLICY")).when(d % 5 == 2, F.lit("SOP")).alias("document_type"),
        F.concat(F.lit("2026."), (d % 3).cast("string")).alias("version"),
        F.when(d % 7 == 6, F.lit("uploaded")).otherwise(F.lit("processed")).alias("status"),
    )


ORG = {
    "org_chunks": """
  SELECT vec_id AS chunk_id, CAST(label * 3 + (vec_id // 2) % 3 AS BIGINT) AS document_id, CAST(label AS BIGINT) AS organization_id,
    CAST(vec_id // 6 AS INTEGER) AS chunk_index,
    CASE WHEN vec_id % 5 <> 0 THEN 'Part ' || (vec_id % 11) END AS section_title,
    CASE WHEN vec_id % 7 <> 0 THEN CAST(vec_id % 13 AS VARCHAR) END AS clause_reference,
    'Policy text ' || vec_id || ' ' AS content, list_transform(embedding, lambda x: x::DOUBLE) AS embedding
  FROM embeddings""",
    "org_documents": """
  SELECT DISTINCT document_id, organization_id, 'Policy ' || document_id AS document_name,
    CASE WHEN document_id % 4 <> 0 THEN 'policy_' || document_id || '.pdf' END AS source_filename,
    CASE document_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'KYC_POLICY' WHEN 2 THEN 'SOP' END AS document_type,
    '2026.' || (document_id % 3) AS version,
    CASE WHEN document_id % 7 = 6 THEN 'uploaded' ELSE 'processed' END AS status
  FROM org_chunks""",
}


def sql_cosine(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


MATCHES = {
    **REG_CLAUSES,
    **ORG,
    "pair_sims": f"""
  SELECT k.organization_id, c.clause_id, k.chunk_id, {sql_cosine('c.embedding', 'k.embedding')} AS s
  FROM reg_clauses c, org_chunks k JOIN org_documents d
    ON d.document_id = k.document_id AND d.organization_id = k.organization_id AND d.status = 'processed'""",
    "match_hits": f"""
  SELECT * FROM (
    SELECT organization_id, clause_id, chunk_id, round(s, 4) AS similarity,
      CAST(row_number() OVER (PARTITION BY organization_id, clause_id ORDER BY round(s, 12) DESC, chunk_id) AS INTEGER) AS rank
    FROM pair_sims WHERE s >= {POLICY_THRESHOLD}) r
  WHERE rank <= 5""",
}

# ---------------------------------------------------------------- catalog


def regulators(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "region")
    k = F.col("r_regionkey")
    return r.select(
        F.col("r_name").alias("code"),
        F.initcap("r_name").alias("name"),
        F.when(k % 3 == 0, F.lit("IN")).when(k % 3 == 1, F.lit("EU")).otherwise(F.lit("GLOBAL")).alias("jurisdiction"),
    )


def regulations(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    k = F.col("n_nationkey")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        k.cast("long").alias("regulation_id"),
        F.col("r_name").alias("regulator_code"),
        F.col("n_name").alias("title"),
        F.when(k % 3 == 0, F.lit("ACT")).otherwise(F.lit("CIRCULAR")).alias("document_type"),
    )


def versions(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("version_id"),
        F.col("s_nationkey").cast("long").alias("regulation_id"),
        F.when(k % 6 == 0, F.concat(F.lit("test-"), k.cast("string")))
        .when(k % 6 == 1, F.concat(F.lit("itest-"), k.cast("string")))
        .otherwise(F.concat(F.lit("1."), (k % 4).cast("string")))
        .alias("version"),
        F.when(k % 5 == 0, F.lit("failed")).when(k % 5 == 1, F.lit("pending")).otherwise(F.lit("completed")).alias("status"),
        F.when(k % 5 == 0, F.lit("boom")).alias("error_message"),
        (k % 4 == 0).alias("is_current"),
        F.when(k % 3 == 0, F.lit("2024-01-01").cast("date")).alias("effective_date"),
        F.col("s_acctbal").alias("created_at"),
        F.when(k % 2 == 0, F.concat(F.lit("store/"), k.cast("string"), F.lit(".pdf"))).alias("storage_path"),
    )


def stored_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """One clause per order line; its version is the line's supplier."""
    li = table(spark, folder, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clause_id"),
        F.col("l_suppkey").alias("version_id"),
        F.col("l_linenumber").cast("string").alias("clause_number"),
        F.concat(F.lit("Quantity "), F.col("l_quantity").cast("int").cast("string")).alias("text"),
        F.struct(F.when(F.col("l_returnflag") == "R", F.lit("Returns Direction")).alias("document_name")).alias("metadata"),
    )


CATALOG = {
    "regulators": """
  SELECT r_name AS code, upper(r_name[1]) || lower(r_name[2:]) AS name,
    CASE r_regionkey % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'EU' ELSE 'GLOBAL' END AS jurisdiction FROM region""",
    "regulations": """
  SELECT CAST(n_nationkey AS BIGINT) AS regulation_id, r_name AS regulator_code, n_name AS title,
    CASE WHEN n_nationkey % 3 = 0 THEN 'ACT' ELSE 'CIRCULAR' END AS document_type
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "versions": """
  SELECT s_suppkey AS version_id, CAST(s_nationkey AS BIGINT) AS regulation_id,
    CASE s_suppkey % 6 WHEN 0 THEN 'test-' || s_suppkey WHEN 1 THEN 'itest-' || s_suppkey ELSE '1.' || (s_suppkey % 4) END AS version,
    CASE s_suppkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status,
    CASE WHEN s_suppkey % 5 = 0 THEN 'boom' END AS error_message, s_suppkey % 4 = 0 AS is_current,
    CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-01-01' END AS effective_date, s_acctbal AS created_at,
    CASE WHEN s_suppkey % 2 = 0 THEN 'store/' || s_suppkey || '.pdf' END AS storage_path
  FROM supplier""",
    "stored_clauses": """
  SELECT l_orderkey * 10 + l_linenumber AS clause_id, l_suppkey AS version_id, CAST(l_linenumber AS VARCHAR) AS clause_number,
    'Quantity ' || CAST(l_quantity AS INTEGER) AS text,
    CASE WHEN l_returnflag = 'R' THEN 'Returns Direction' END AS m_document_name
  FROM lineitem""",
}


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("entity_id"),
        F.col("event_id").alias("job_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"),
    )


JOBS = {
    "jobs": """
  SELECT user_id AS entity_id, event_id AS job_id, ts AS created_at, event_type AS status,
    CAST(event_id % 4 AS INTEGER) AS retry_count FROM events""",
}

# ---------------------------------------------------------------- risk and assessments

# Gap texts, at least one per severity step and some with words of two.
GAP_TEXTS = (
    "Completely absent control for onboarding",
    "Policy lacks a review date",
    "Partial coverage of the exceptions",
    "Minor formatting issue",
    "Control fails to log access",
    "Nothing else to note",
    "No evidence of encryption at rest",
    "Update the documentation",
    "Responsibilities are unclear",
    "Retention period not defined",
    "Recommended clarification of terms",
    "UNAUTHORIZED access possible",
)
SQL_GAP_TEXTS = "[" + ", ".join(f"'{g}'" for g in GAP_TEXTS) + "]"


def risk_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem x orders -> one analysis result per line."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    texts = F.array(*[F.lit(g) for g in GAP_TEXTS])
    n = len(GAP_TEXTS)
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    status = (
        F.when(F.col("l_linenumber") == 5, F.lit("insufficient_evidence"))
        .when(F.col("l_linenumber") == 6, F.lit("unknown"))
        .when(F.col("o_orderstatus") == "F", F.lit("COMPLIANT"))
        .when(F.col("o_orderstatus") == "O", F.lit("non_compliant"))
        .otherwise(F.lit("PARTIALLY_COMPLIANT"))
    )
    level = F.split("o_orderpriority", "-")[0]
    return joined.select(
        F.col("l_suppkey").alias("organization_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clause_id"),
        status.alias("status"),
        (F.col("l_discount") * 10.5).alias("confidence"),
        F.slice(
            F.array(F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(1.25), F.lit(-0.5)),
            F.lit(1), (F.col("l_partkey") % 5).cast("int"),
        ).alias("similarities"),
        F.transform(
            F.slice(F.array((F.col("l_partkey") % n), (F.col("l_orderkey") % n), F.lit(2).cast("long")), F.lit(1), (F.col("l_linenumber") % 4).cast("int")),
            lambda i: F.struct(
                F.element_at(texts, (i + 1).cast("int")).alias("description"),
                F.when(i == 3, F.lit("High")).when(i == 4, F.lit("odd")).alias("severity"),
            ),
        ).alias("gaps"),
        F.when(level == "1", F.lit("CRITICAL")).when(level == "2", F.lit("high")).when(level == "3", F.lit("MEDIUM")).when(level == "5", F.lit("LOW")).alias("criticality"),
    )


RISK_INPUTS = {
    "risk_inputs": f"""
  SELECT l_suppkey AS organization_id, l_orderkey * 10 + l_linenumber AS clause_id,
    CASE WHEN l_linenumber = 5 THEN 'insufficient_evidence' WHEN l_linenumber = 6 THEN 'unknown'
      WHEN o_orderstatus = 'F' THEN 'COMPLIANT' WHEN o_orderstatus = 'O' THEN 'non_compliant' ELSE 'PARTIALLY_COMPLIANT' END AS status,
    l_discount * 10.5::DOUBLE AS confidence,
    ([l_tax * 10::DOUBLE, l_quantity / 50::DOUBLE, 1.25::DOUBLE, -0.5::DOUBLE])[1:CAST(l_partkey % 5 AS INTEGER)] AS similarities,
    list_transform(([l_partkey % {len(GAP_TEXTS)}, l_orderkey % {len(GAP_TEXTS)}, 2])[1:CAST(l_linenumber % 4 AS INTEGER)],
      lambda i: {{'description': ({SQL_GAP_TEXTS})[i + 1], 'severity': CASE i WHEN 3 THEN 'High' WHEN 4 THEN 'odd' END}}) AS gaps,
    CASE o_orderpriority[1] WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'high' WHEN '3' THEN 'MEDIUM' WHEN '5' THEN 'LOW' END AS criticality
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    """orders -> stored assessments; whole scores keep means exact."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    status = (
        F.when(k % 13 == 0, F.lit("NOT_DETERMINABLE"))
        .when(k % 17 == 0, F.lit("NO_RELEVANT_REGULATION_FOUND"))
        .when(F.col("o_orderstatus") == "F", F.lit("COMPLIANT"))
        .when(F.col("o_orderstatus") == "O", F.lit("NON_COMPLIANT"))
        .otherwise(F.lit("PARTIALLY_COMPLIANT"))
    )
    return o.select(
        (F.col("o_custkey") % 50).alias("organization_id"),
        F.col("o_custkey").alias("policy_document_id"),
        k.alias("policy_clause_id"),
        (k % 1000).alias("regulatory_clause_id"),
        F.lit(0.5).alias("matching_score"),
        F.when(k % 11 != 0, F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("compliance_score"),
        status.alias("status"),
        F.concat(F.lit("Order "), k.cast("string")).alias("explanation"),
    )


def policy_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("document_id"),
        (F.col("c_custkey") % 50).alias("organization_id"),
        F.col("c_name").alias("document_name"),
    )


ASSESSMENTS = {
    "assessments": """
  SELECT o_custkey % 50 AS organization_id, o_custkey AS policy_document_id, o_orderkey AS policy_clause_id,
    o_orderkey % 1000 AS regulatory_clause_id, 0.5::DOUBLE AS matching_score,
    CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 5000)::DOUBLE END AS compliance_score,
    CASE WHEN o_orderkey % 13 = 0 THEN 'NOT_DETERMINABLE' WHEN o_orderkey % 17 = 0 THEN 'NO_RELEVANT_REGULATION_FOUND'
      WHEN o_orderstatus = 'F' THEN 'COMPLIANT' WHEN o_orderstatus = 'O' THEN 'NON_COMPLIANT' ELSE 'PARTIALLY_COMPLIANT' END AS status,
    'Order ' || o_orderkey AS explanation
  FROM orders""",
    "policy_documents": """
  SELECT c_custkey AS document_id, c_custkey % 50 AS organization_id, c_name AS document_name FROM customer""",
}


def sql_round_exact(x: str, digits: int = 2) -> str:
    """SQL for half-to-even rounding of the binary value of a non-negative double."""
    scale = f"{2 * 10**digits}::DOUBLE"
    p = f"(({x}) * {scale})"
    hi = f"(({x}) * 134217729::DOUBLE - (({x}) * 134217729::DOUBLE - ({x})))"
    err = f"(({hi} * {scale} - {p}) + (({x}) - {hi}) * {scale})"
    below = f"floor({p} / 2)"
    tie = f"({p} = floor({p}) AND {p} - 2 * floor({p} / 2) = 1)"
    up = (
        f"CASE WHEN {tie} AND {err} <> 0 THEN {err} > 0 WHEN {tie} THEN {below} - 2 * floor({below} / 2) = 1 "
        f"ELSE {p} - {below} * 2 > 1 END"
    )
    return f"(({below} + CASE WHEN {up} THEN 1 ELSE 0 END) / {10**digits}::DOUBLE)"
