"""Document and clause metadata as string expressions.

"First match" always means the first pattern of a fixed priority list that
matches anywhere, not the leftmost match in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausemill.functions import text as tx

DEFAULT_REGULATOR = "RBI"


@dataclass(frozen=True)
class Windows:
    """How many characters from the start each field is looked for in, and how many lines and characters a name has; None: all."""

    regulator: int | None = None
    document_type: int | None = None
    publication_date: int | None = None
    version: int | None = None
    section: int | None = None
    name_lines: int | None = None
    name_chars: int | None = None


WHOLE = Windows()
# The windows of an extraction that reads only the head of a text.
HEAD = Windows(5000, 2000, 8000, 5000, 5000, 15, 200)

# How each regulator is recognised, in priority order.
REGULATOR_PATTERNS = {
    "RBI": r"\bReserve\s+Bank\s+of\s+India\b|\bRBI\b",
    "SEBI": r"\bSEBI\b|\bSecurities\s+and\s+Exchange\s+Board",
    "IRDAI": r"\bIRDAI\b|\bInsurance\s+Regulatory",
    "GDPR": r"\bGDPR\b|\bGeneral\s+Data\s+Protection\s+Regulation",
    "ISO": r"\bISO\b|\bInternational\s+Organization\s+for\s+Standardization",
    "PCI_DSS": r"\bPCI[\s-]?DSS\b",
}

# Regulator code -> (name, jurisdiction).
REGULATORS = {
    "RBI": ("Reserve Bank of India", "IN"),
    "SEBI": ("Securities and Exchange Board of India", "IN"),
    "IRDAI": ("Insurance Regulatory and Development Authority of India", "IN"),
    "GDPR": ("General Data Protection Regulation", "EU"),
    "ISO": ("International Organization for Standardization", "GLOBAL"),
    "PCI_DSS": ("Payment Card Industry Data Security Standard", "GLOBAL"),
}

# Document types, in priority order.
TYPE_PATTERNS = {
    "master direction": r"master\s+direction",
    "circular": r"\bcircular\b",
    "guideline": r"\bguideline[s]?\b",
    "notification": r"\bnotification\b",
    "act": r"\bact\b",
    "policy": r"\bpolic(?:y|ies)\b",
}

# Words that mark a line as the document's name.
NAME_WORDS = r"master\s+direction|circular|guideline|notification|regulation"

# Month names in calendar order.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)

# Words that do not count in a document's abbreviation.
ABBREVIATION_STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this",
    "direction", "directions", "master", "circular", "rbi",
)

# The patterns of dates, versions and sections.
# [0-9] instead of \\d: the class is tried at every character of whole documents.
MONTH_DATE = rf"(?i)([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({'|'.join(MONTHS)}),?\s+([0-9]{{4}})"
ISO_DATE = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
DAY_FIRST_DATE = r"([0-9]{2})[./-]([0-9]{2})[./-]([0-9]{4})"
PUBLICATION = (
    r"(?iU-u)(?:published|issued|publication\s+date)\s*[:\-]?\s*"
    r"((?:\d{1,2}(?:st|nd|rd|th)?\s+\w+\s+\d{4})|\d{4}-\d{2}-\d{2})"
)
VERSION = r"(?iU-u)(?:version|ver\.?)\s*[:\-]?\s*([A-Za-z0-9._-]+)"
FILE_VERSION = r"(?iU-u)v(\d+(?:\.\d+)*)"
SECTION = r"(?idU-u)((?:section|article|rule|chapter)\s+\d+[A-Za-z]?(?:\.[A-Za-z0-9]+)*[:\-—]?\s*(.{0,80}))"
DOTTED_NUMBER = r"(?U)^\d+(?:\.\d+)*$"


def _blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _first_pattern(text: Column, patterns: dict[str, str]) -> Column:
    def first(bound: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, pattern in patterns.items():
            out = out.when(bound.rlike("(?iU-u)" + pattern), F.lit(name))
        return out

    return tx.bind(text, first)


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def regulator(text: Column, filename: Column, *, chars: int | None = None) -> Column:
    return F.coalesce(
        _first_pattern(_head(text, chars), REGULATOR_PATTERNS),
        _first_pattern(filename, REGULATOR_PATTERNS),
    )


def jurisdiction(code: Column) -> Column:
    def place_of(bound: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, (_, place) in REGULATORS.items():
            out = out.when(bound == name, F.lit(place))
        return out

    return tx.bind(code, place_of)


def document_type(text: Column, filename: Column, *, chars: int | None = None) -> Column:
    return _first_pattern(F.concat(_head(text, chars), F.lit(" "), filename), TYPE_PATTERNS)


def document_name(text: Column, filename: Column, *, lines: int | None = None, chars: int | None = None) -> Column:
    """First telling line among the (first ``lines``) non-blank ones, else the file's title-cased stem."""
    most, lines = lines, F.filter(F.transform(tx.split_lines(text), tx.strip), lambda line: line != "")
    lines = lines if most is None else F.slice(lines, 1, most)
    telling = F.filter(
        lines,
        # The cheap test first: it settles most lines without the search for words.
        lambda line: ((F.length(line) > 20) & F.substring(line, 1, 1).rlike(r"\p{Lu}"))
        | line.rlike("(?iU-u)" + NAME_WORDS),
    )
    stem = tx.title_case(F.translate(tx.file_stem(filename), "_-", "  "))
    return _blank_to_null(F.coalesce(_head(F.get(telling, F.lit(0)), chars), stem))


def first_date(text: Column) -> Column:
    """'yyyy-mm-dd' of the first month-name date, else ISO date, else day-first date; unchecked."""

    months = F.array(*[F.lit(m) for m in MONTHS])

    # Each pattern goes over the text once; day, month and year come from the short match.
    def month_named(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, MONTH_DATE, i)
        month = F.array_position(months, F.lower(part(2))).cast("string")
        return F.when(found.isNotNull(), F.concat_ws("-", part(3), F.lpad(month, 2, "0"), F.lpad(part(1), 2, "0")))

    def day_first(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, DAY_FIRST_DATE, i)
        return F.when(found.isNotNull(), F.concat_ws("-", part(3), part(2), part(1)))

    return F.coalesce(
        tx.bind(F.regexp_substr(text, F.lit(MONTH_DATE)), month_named),
        F.regexp_substr(text, F.lit(ISO_DATE)),
        tx.bind(F.regexp_substr(text, F.lit(DAY_FIRST_DATE)), day_first),
    )


def publication_date(text: Column, *, chars: int | None = None) -> Column:
    raw = tx.strip(F.regexp_extract(_head(text, chars), PUBLICATION, 1))
    iso = "^" + ISO_DATE
    return tx.bind(raw, lambda found: F.when(found.rlike(iso), found).otherwise(first_date(found)))


def version(text: Column, filename: Column, *, chars: int | None = None) -> Column:
    return F.coalesce(
        _blank_to_null(F.regexp_extract(_head(text, chars), VERSION, 1)),
        _blank_to_null(F.regexp_extract(filename, FILE_VERSION, 1)),
    )


def section(text: Column, *, chars: int | None = None) -> Column:
    """'prefix — title'; the prefix is the whole match up to its first colon."""
    scan = _head(text, chars)

    def named(match: Column) -> Column:
        title = tx.strip(F.regexp_extract(match, SECTION, 2))
        prefix = tx.strip(F.substring_index(match, ":", 1))
        return F.when(title != "", F.concat(prefix, F.lit(" — "), title)).otherwise(prefix)

    return _blank_to_null(tx.bind(F.regexp_extract(scan, SECTION, 1), named))


def parse_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def document_metadata(
    text: Column, filename: Column, total_pages: Column | None = None, *, windows: Windows = WHOLE
) -> Column:
    """The 12-field document struct, blanks as null."""
    code = regulator(text, filename, chars=windows.regulator)
    nothing = F.lit(None).cast("string")
    return F.struct(
        document_name(text, filename, lines=windows.name_lines, chars=windows.name_chars).alias("document_name"),
        document_type(text, filename, chars=windows.document_type).alias("document_type"),
        code.alias("regulator"),
        jurisdiction(code).alias("jurisdiction"),
        first_date(text).alias("effective_date"),
        publication_date(text, chars=windows.publication_date).alias("publication_date"),
        version(text, filename, chars=windows.version).alias("version"),
        section(text, chars=windows.section).alias("section"),
        nothing.alias("subsection"),
        filename.alias("source"),
        filename.alias("filename"),
        (total_pages if total_pages is not None else F.lit(None)).cast("int").alias("total_pages"),
    )


def with_overrides(
    meta: Column,
    overrides: dict[str, Column] | None = None,
    *,
    regulator_code: Column | None = None,
    title: Column | None = None,
    document_type: Column | None = None,
    version: Column | None = None,
) -> Column:
    """Non-null overrides win over extracted fields, non-blank ingest options over both.

    An ingest without options uses regulator RBI, version 1.0 and type
    'regulation', and those defaults win as well.
    """
    options = {
        "regulator": F.lit(DEFAULT_REGULATOR) if regulator_code is None else regulator_code,
        "document_name": F.lit(None).cast("string") if title is None else title,
        "document_type": F.lit("regulation") if document_type is None else document_type,
        "version": F.lit("1.0") if version is None else version,
    }
    out = meta
    for name, value in (overrides or {}).items():
        out = out.withField(name, F.coalesce(value, meta[name]))
    for name, value in options.items():
        before = (overrides or {}).get(name)
        extracted = meta[name] if before is None else F.coalesce(before, meta[name])
        out = out.withField(name, F.coalesce(_blank_to_null(value), extracted))
    return out


def clause_metadata(
    meta: Column,
    *,
    document_id: Column,
    clause_number: Column,
    parent: Column,
    section: Column,
    title: Column,
    level: Column,
    page_number: Column,
    page_end: Column,
) -> Column:
    """The 21-field clause struct: the document's metadata plus the clause's place in it."""
    bracketed = clause_number.rlike(r"^\([a-zA-Z0-9]+\)$")
    dotted_parent = parent.rlike(DOTTED_NUMBER)
    chapter = F.coalesce(_blank_to_null(section), meta["section"])
    above = _blank_to_null(parent)
    return F.struct(
        document_id.alias("document_id"),
        meta["document_name"].alias("document_name"),
        meta["document_type"].alias("document_type"),
        F.coalesce(meta["regulator"], F.lit(DEFAULT_REGULATOR)).alias("regulator"),
        meta["jurisdiction"].alias("jurisdiction"),
        meta["effective_date"].alias("effective_date"),
        meta["publication_date"].alias("publication_date"),
        meta["version"].alias("version"),
        chapter.alias("section"),
        above.alias("subsection"),
        clause_number.alias("clause_number"),
        page_number.alias("page_number"),
        page_end.alias("page_end"),
        meta["source"].alias("source"),
        _blank_to_null(title).alias("title"),
        level.alias("level"),
        above.alias("parent_clause"),
        chapter.alias("chapter"),
        F.when(clause_number.rlike(DOTTED_NUMBER), clause_number)
        .when(bracketed & dotted_parent, parent)
        .alias("section_number"),
        F.when(bracketed & dotted_parent, F.concat(parent, clause_number))
        .when(bracketed, clause_number)
        .alias("sub_clause"),
        F.lit("regulatory_document").alias("source_type"),
    )


def readable_clause_id(code: Column, name: Column, clause_number: Column) -> Column:
    """REG-ABBREV-number, e.g. RBI-KYC-3.1."""
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("([A-Za-z]{3,})"), 1)
    telling = F.filter(words, lambda w: ~F.lower(w).isin(*ABBREVIATION_STOP_WORDS))
    letters = F.array_join(F.transform(F.slice(telling, 1, 6), lambda w: F.upper(F.substring(w, 1, 1))), "")
    short = F.substring(F.upper(F.coalesce(_blank_to_null(code), F.lit("DOC"))), 1, 5)
    return F.concat_ws("-", short, F.coalesce(_blank_to_null(letters), F.lit("DOC")), clause_number)


def missing_fields(
    regulator: Column, document_name: Column, effective_date: Column, chapter: Column
) -> Column:
    """Names of the required record fields that are null or blank."""
    required = {
        "regulator": regulator,
        "document_name": document_name,
        "effective_date": effective_date,
        "chapter": chapter,
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(value, F.lit("")) == "", F.lit(name)) for name, value in required.items()])
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stored_name(content_hash: Column, filename: Column) -> Column:
    return F.concat_ws("_", F.substring(content_hash, 1, 16), filename)
