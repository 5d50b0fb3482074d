"""Metadata extraction over texts that name regulators, types, dates and versions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clausemill.functions import metadata as md
from clausemill.functions import text as tx
from clausemill.operators import clean, ingest, versions
from clausemill.operators import clauses as cl
from clausemill.plans import inputs as inp
from clausemill.plans.registry import query, table, with_ctes
from clausemill.plans.text_queries import cleaned_of_documents
from clausemill.session import saved

# ------------------------------------------------------------- SQL pieces


def _cases(text: str, patterns: dict[str, str]) -> str:
    arms = " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{name}'" for name, p in patterns.items())
    return f"CASE {arms} END"


SQL_REGULATOR = (
    f"coalesce({_cases('text[1:5000]', md.REGULATOR_PATTERNS)}, {_cases('filename', md.REGULATOR_PATTERNS)})"
)
SQL_JURISDICTION = (
    f"CASE {SQL_REGULATOR} " + " ".join(f"WHEN '{c}' THEN '{v[1]}'" for c, v in md.REGULATORS.items()) + " END"
)
SQL_TYPE = _cases("(text[1:2000] || ' ' || filename)", md.TYPE_PATTERNS)
_MONTH = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+(" + "|".join(md.MONTHS) + r"),?\s+(\d{4})"
_ISO = r"(\d{4})-(\d{2})-(\d{2})"
_DMY = r"(\d{2})[./-](\d{2})[./-](\d{4})"
_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in md.MONTHS) + "]"


def sql_first_date(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '{_MONTH}') THEN regexp_extract({x}, '{_MONTH}', 3) || '-'
    || lpad(CAST(list_position({_MONTH_LIST}, lower(regexp_extract({x}, '{_MONTH}', 2))) AS VARCHAR), 2, '0') || '-'
    || lpad(regexp_extract({x}, '{_MONTH}', 1), 2, '0')
  WHEN regexp_matches({x}, '{_ISO}') THEN regexp_extract({x}, '{_ISO}', 0)
  WHEN regexp_matches({x}, '{_DMY}') THEN regexp_extract({x}, '{_DMY}', 3) || '-' || regexp_extract({x}, '{_DMY}', 2)
    || '-' || regexp_extract({x}, '{_DMY}', 1) END"""


_PUB = (
    r"(?i)(?:published|issued|publication\s+date)\s*[:\-]?\s*"
    r"((?:\d{1,2}(?:st|nd|rd|th)?\s+[\w\x{00C0}-\x{024F}]+\s+\d{4})|\d{4}-\d{2}-\d{2})"
)
_RAW_PUB = f"regexp_extract(text[1:8000], '{_PUB}', 1)"
SQL_PUBLICATION = f"CASE WHEN regexp_matches({_RAW_PUB}, '^{_ISO}') THEN {_RAW_PUB} ELSE {sql_first_date(_RAW_PUB)} END"
SQL_VERSION = (
    r"coalesce(nullif(regexp_extract(text[1:5000], '(?i)(?:version|ver\.?)\s*[:\-]?\s*([A-Za-z0-9._-]+)', 1), ''), "
    r"nullif(regexp_extract(filename, '(?i)v(\d+(?:\.\d+)*)', 1), ''))"
)
_SEC = r"(?i)((?:section|article|rule|chapter)\s+\d+[A-Za-z]?(?:\.[A-Za-z0-9]+)*[:\-—]?\s*([^\n]{0,80}))"
SQL_SECTION = rf"""nullif(CASE WHEN trim(regexp_extract(text[1:5000], '{_SEC}', 2)) <> ''
  THEN trim(split_part(regexp_extract(text[1:5000], '{_SEC}', 1), ':', 1), ' ' || chr(10)) || ' — ' || trim(regexp_extract(text[1:5000], '{_SEC}', 2))
  ELSE trim(split_part(regexp_extract(text[1:5000], '{_SEC}', 1), ':', 1), ' ' || chr(10)) END, '')"""
_BASE = "string_split(filename, '/')[-1]"
_STEM = rf"replace(replace(regexp_replace({_BASE}, '^(.+)\.[^.]+$', '\1'), '_', ' '), '-', ' ')"
_CHARS = f"string_split(lower({_STEM}), '')"
_TITLED = (
    f"array_to_string(list_transform({_CHARS}, lambda ch, i: "
    f"CASE WHEN i > 1 AND regexp_matches(({_CHARS})[i - 1], '\\p{{L}}') THEN ch ELSE upper(ch) END), '')"
)
_TELLING = (
    "list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9))), lambda l: l <> '')[1:15], "
    rf"lambda l: regexp_matches(l, '(?i){md.NAME_WORDS}') OR (length(l) > 20 AND regexp_matches(l, '^\p{{Lu}}')))"
)
SQL_NAME = f"nullif(coalesce(({_TELLING})[1][1:200], {_TITLED}), '')"


def _extract(name: str, spark_expr, sql_expr: str) -> None:
    @query(name, with_ctes(inp.REG_TEXTS, f"SELECT doc_id, filename, {sql_expr} AS value FROM reg_texts"))
    def run(spark, folder):
        return inp.regulation_texts(spark, folder).select(
            "doc_id", "filename", spark_expr(F.col("text"), F.col("filename")).alias("value")
        )


def whole(sql: str) -> str:
    """The same SQL over whole texts: without the windows."""
    return re.sub(r"\btext\[1:\d+\]", "text", sql).replace("[1:15]", "").replace("[1][1:200]", "[1]")


def _field(name: str, spark_expr, sql_expr: str) -> None:
    """A field as it is found in the head of a text, and in the whole of it."""
    _extract(name, lambda t, f: spark_expr(t, f, md.HEAD), sql_expr)
    _extract(f"{name}_whole", lambda t, f: spark_expr(t, f, md.WHOLE), whole(sql_expr))


_field("meta_regulator", lambda t, f, w: md.regulator(t, f, chars=w.regulator), SQL_REGULATOR)
_extract("meta_jurisdiction", lambda t, f: md.jurisdiction(md.regulator(t, f, chars=md.HEAD.regulator)), SQL_JURISDICTION)
_field("meta_doc_type", lambda t, f, w: md.document_type(t, f, chars=w.document_type), SQL_TYPE)
_field("meta_document_name", lambda t, f, w: md.document_name(t, f, lines=w.name_lines, chars=w.name_chars), SQL_NAME)
_extract("meta_first_date", lambda t, f: md.first_date(t), sql_first_date("text"))
_field("meta_publication_date", lambda t, f, w: md.publication_date(t, chars=w.publication_date), SQL_PUBLICATION)
_field("meta_version", lambda t, f, w: md.version(t, f, chars=w.version), SQL_VERSION)
_field("meta_section", lambda t, f, w: md.section(t, chars=w.section), SQL_SECTION)
_extract(
    "meta_parse_date",
    lambda t, f: md.parse_date(
        F.when(F.length(f) % 3 == 0, F.regexp_replace(md.first_date(t), r"-\d\d$", "-31")).otherwise(md.first_date(t))
    ),
    rf"TRY_CAST(CASE WHEN length(filename) % 3 = 0 THEN regexp_replace({sql_first_date('text')}, '-\d\d$', '-31') ELSE {sql_first_date('text')} END AS DATE)",
)
_extract("safe_filename", lambda t, f: tx.safe_file_name(f), f"CASE WHEN trim({_BASE}) IN ('', '.', '..') THEN 'upload.pdf' ELSE trim({_BASE}) END")
_extract("truncate_text", lambda t, f: tx.truncate(t), "CASE WHEN length(text) <= 500 THEN text ELSE text[1:497] || '...' END")
_extract("content_hash", lambda t, f: md.content_hash(t), "sha256(text)")
_extract("snk_stored_path", lambda t, f: md.stored_name(md.content_hash(t), f), "sha256(text)[1:16] || '_' || filename")

_META_FIELDS = {
    "document_name": SQL_NAME,
    "document_type": SQL_TYPE,
    "regulator": SQL_REGULATOR,
    "jurisdiction": SQL_JURISDICTION,
    "effective_date": sql_first_date("text"),
    "publication_date": SQL_PUBLICATION,
    "version": SQL_VERSION,
    "section": SQL_SECTION,
    "source": "filename",
}
META = {
    **inp.REG_TEXTS,
    "meta": "SELECT doc_id, text, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _META_FIELDS.items() if name != "jurisdiction")
    + ", filename FROM reg_texts",
    "doc_meta": "SELECT *, CASE regulator "
    + " ".join(f"WHEN '{c}' THEN '{v[1]}'" for c, v in md.REGULATORS.items())
    + " END AS jurisdiction FROM meta",
}


def _meta(spark, folder):
    return inp.regulation_texts(spark, folder).select(
        "doc_id", "filename", md.document_metadata(F.col("text"), F.col("filename"), windows=md.HEAD).alias("meta")
    )


@query("meta_document", with_ctes(META, f"SELECT doc_id, {', '.join(_META_FIELDS)} FROM doc_meta"))
def meta_document(spark, folder):
    return _meta(spark, folder).select("doc_id", *[F.col(f"meta.{name}").alias(name) for name in _META_FIELDS])


@query(
    "meta_overrides",
    with_ctes(
        META,
        """SELECT doc_id, 'RBI' AS regulator, CASE WHEN doc_id % 3 = 0 THEN 'Given title' ELSE document_name END AS document_name,
  'regulation' AS document_type, '1.0' AS version, CASE WHEN doc_id % 2 = 0 THEN 'Section X' ELSE section END AS section FROM doc_meta""",
    ),
)
def meta_overrides(spark, folder):
    doc_id = F.col("doc_id")
    changed = md.with_overrides(
        F.col("meta"),
        {"section": F.when(doc_id % 2 == 0, F.lit("Section X")), "version": F.lit("9")},
        title=F.when(doc_id % 3 == 0, F.lit("Given title")).otherwise(F.lit("")),
    )
    picked = _meta(spark, folder).select("doc_id", changed.alias("m"))
    return picked.select("doc_id", "m.regulator", "m.document_name", "m.document_type", "m.version", "m.section")


_DOTTED = r"^\d+(\.\d+)*$"
_BRACKET = r"^\([a-zA-Z0-9]+\)$"


@query(
    "meta_enrich_clause",
    with_ctes(
        {**inp.CLAUSES, **META},
        rf"""SELECT c.doc_id, c.seq_no AS position, c.clause_number, coalesce(nullif(c.section, ''), m.section) AS chapter,
  nullif(c.parent_clause, '') AS subsection,
  CASE WHEN regexp_matches(clause_number, '{_DOTTED}') THEN clause_number
       WHEN regexp_matches(clause_number, '{_BRACKET}') AND regexp_matches(parent_clause, '{_DOTTED}') THEN parent_clause END AS section_number,
  CASE WHEN regexp_matches(clause_number, '{_BRACKET}') THEN CASE WHEN regexp_matches(parent_clause, '{_DOTTED}')
       THEN parent_clause || clause_number ELSE clause_number END END AS sub_clause,
  coalesce(m.regulator, 'RBI') AS regulator, m.jurisdiction, m.effective_date
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS seq_no FROM clause_rows) c JOIN doc_meta m ON m.doc_id = c.doc_id""",
    ),
)
def meta_enrich_clause(spark, folder):
    names = ("chapter", "subsection", "section_number", "sub_clause", "regulator", "jurisdiction", "effective_date")
    clauses = cl.split_clauses(cleaned_of_documents(spark, folder), cleaned=True)
    enriched = ingest.enrich_clauses(clauses, _meta(spark, folder).select("doc_id", "meta"))
    cut = enriched.select("version_id", "seq", "clause_number", *[f"metadata.{n}" for n in names], F.shiftright("seq", 41).alias("segment"))
    # Numbering reads its rows twice, so they are written once.
    placed = cl.numbered(saved(cut, "enriched-clauses"), group=["version_id"], segment="segment", order=["seq"], name="position")
    return placed.select(F.col("version_id").alias("doc_id"), "position", "clause_number", *names)


_REG_DIM = " ".join(f"WHEN '{c}' THEN '{v[0]}'" for c, v in md.REGULATORS.items())
_REG_PLACE = " ".join(f"WHEN '{c}' THEN '{v[1]}'" for c, v in md.REGULATORS.items())


@query(
    "regulator_dimension",
    with_ctes(
        {**META, **inp.CATALOG},
        f"""SELECT code, CASE code {_REG_DIM} ELSE code END AS name,
  coalesce(CASE code {_REG_PLACE} END, place, 'GLOBAL') AS jurisdiction
FROM (SELECT code, min(place) AS place FROM (
        SELECT coalesce(regulator, 'X' || (doc_id % 3)) AS code, CASE WHEN doc_id % 3 = 1 THEN 'UK' END AS place FROM doc_meta
        UNION ALL SELECT r_name, NULL FROM region) GROUP BY code) d
WHERE code NOT IN (SELECT code FROM regulators)""",
    ),
)
def regulator_dimension(spark, folder):
    doc_id = F.col("doc_id")
    codes = _meta(spark, folder).select(
        F.coalesce("meta.regulator", F.concat(F.lit("X"), (doc_id % 3).cast("string"))).alias("regulator_code"),
        F.when(doc_id % 3 == 1, F.lit("UK")).alias("extracted_jurisdiction"),
    )
    known = table(spark, folder, "region").select(
        F.col("r_name").alias("regulator_code"), F.lit(None).cast("string").alias("extracted_jurisdiction")
    )
    return versions.regulator_dimension(codes.unionByName(known), inp.regulators(spark, folder))


_STOP = ", ".join(f"'{w}'" for w in md.ABBREVIATION_STOP_WORDS)
SQL_READABLE = f"""coalesce(nullif(upper(regulator), ''), 'DOC')[1:5] || '-' ||
  coalesce(nullif(array_to_string(list_transform(list_filter(regexp_extract_all(coalesce(document_name, ''), '[A-Za-z]{{3,}}'),
    lambda w: NOT list_contains([{_STOP}], lower(w)))[1:6], lambda w: upper(w[1])), ''), ''), 'DOC')"""


@query(
    "clause_readable_id",
    with_ctes(META, f"SELECT doc_id, {SQL_READABLE} || '-' || (doc_id % 9) || '.1' AS clause_id FROM doc_meta"),
)
def clause_readable_id(spark, folder):
    number = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(".1"))
    return _meta(spark, folder).select(
        "doc_id",
        md.readable_clause_id(F.col("meta.regulator"), F.col("meta.document_name"), number).alias("clause_id"),
    )


@query(
    "metadata_completeness",
    with_ctes(
        META,
        """SELECT count(*) AS clauses, count(*) FILTER (regulator IS NULL) AS no_regulator,
  count(*) FILTER (document_name IS NULL) AS no_document_name, count(*) FILTER (effective_date IS NULL) AS no_effective_date,
  count(*) AS no_chapter, count(*) AS incomplete FROM doc_meta""",
    ),
)
def metadata_completeness(spark, folder):
    # The document metadata has no chapter field, so every record lacks it.
    chapter = F.lit(None).cast("string")
    missing = md.missing_fields(
        F.col("meta.regulator"), F.col("meta.document_name"), F.col("meta.effective_date"), chapter
    )
    rows = _meta(spark, folder).select(missing.alias("missing"))
    return rows.agg(
        F.count(F.lit(1)).alias("clauses"),
        *[
            F.count_if(F.array_contains("missing", name)).alias(f"no_{name}")
            for name in ("regulator", "document_name", "effective_date", "chapter")
        ],
        F.count_if(F.size("missing") > 0).alias("incomplete"),
    )


@query(
    "clause_payload_validate",
    """SELECT doc_id, CASE WHEN nullif(n, '') IS NULL THEN 'MISSING_NUMBER' WHEN length(coalesce(t, '')) < 1 THEN 'EMPTY_TEXT' END AS reject_reason
FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id % 7 AS VARCHAR) END AS n,
             CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS t FROM documents)""",
)
def clause_payload_validate(spark, folder):
    doc_id = F.col("doc_id")
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.when(doc_id % 10 != 0, (doc_id % 7).cast("string")).alias("clause_number"),
        F.when(doc_id % 6 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
    )
    return rows.select("doc_id", cl.payload_rejection(F.col("clause_number"), F.col("text")).alias("reject_reason"))
