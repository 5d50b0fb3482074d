"""Splitting of page text into numbered clauses.

A clause starts at a numbered line or a titled structural header and runs to
the next one; what a line means depends on what came before it in the same
document.  All "what came before" questions are running-last values, answered
by the segmented scans, so a long document is spread over many tasks and text
is shuffled twice: once to (document, segment), once to its clause.

``ord`` orders the lines of a document: page number in the high 32 bits, line
position in the low ones.  ``seq`` orders its clauses: twice the ord of the
opening line, odd for clauses, even for a preamble placed just before one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators.scans import BEFORE, UP_TO, numbered
from clausemill.session import saved

PAGES_PER_SEGMENT = 256
MIN_CLAUSE_CHARS = 10
AT_END = 9223372036854775807

# The forms of opening lines.
STRUCTURAL = (
    r"(?U)^(Section|Article|Rule|Chapter)\s+([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)[ \t]*[:\-—]?\s*(.*)$"
)
NUMERIC = r"(?U)^(\d+(?:\.\d+){0,3})[.\s][ \t]*(.+)$"
PAREN = r"(?U)^\((\d+)\)[ \t]+(.+)$"
ALPHA = r"(?i)^\(([a-z])\)[ \t]+(.+)$"
ROMAN = r"(?i)^\(([ivxlc]+)\)[ \t]+(.+)$"

# Lines that are nothing but a number or label.
STANDALONE = r"(?iU-u)^(?:\d+(?:\.\d+){0,3}\.?|\(\d+\)|\([a-z]\)|\([ivxlc]+\))$"

OPENERS = ("numeric", "paren", "alpha", "roman")


def explode_lines(
    pages: DataFrame, *, pages_per_segment: int = PAGES_PER_SEGMENT, cleaned: bool = False
) -> DataFrame:
    """pages(doc_id, page_number, text) -> (doc_id, segment, ord, line), lines stripped.

    ``cleaned`` texts (``clean.clean_pages``) have no line ends but line feeds.
    """
    raw = tx.split_lines(F.col("text"), line_feeds_only=cleaned)
    return pages.select(
        "doc_id", "page_number", F.posexplode(raw).alias("pos", "raw")
    ).select(
        "doc_id",
        # Never null, so that no null check is planned on one branch only: both
        # branches of the scans must read the same shuffle.
        F.coalesce(F.floor(F.col("page_number") / pages_per_segment), F.lit(0)).cast("long").alias("segment"),
        F.shiftleft(F.col("page_number").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("ord"),
        (tx.strip_line if cleaned else tx.strip_plain)(F.col("raw")).alias("line"),
    )


def page_of(order: Column) -> Column:
    return F.shiftright(order, 32).cast("int")


def merge_standalone_numbers(lines: DataFrame) -> DataFrame:
    """Join a line that is only a number with the next non-blank line.

    Among non-blank lines, the 1st, 3rd, 5th ... of a run of standalone lines
    takes the line after it; the taken line and the blank lines between vanish.
    The run position crosses segment borders through the carried tail length.
    """
    return _merged(lines)[0]


def _merged(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merge_standalone_numbers`` of all lines, and of the documents of several segments alone.

    Only the latter carry a state from segment to segment; what asks for that
    state reads their lines and not all lines a second time.
    """
    key = Window.partitionBy("doc_id", "segment")
    upto = key.orderBy("ord").rowsBetween(*UP_TO)
    before = key.orderBy("ord").rowsBetween(*BEFORE)
    filled = F.col("line") != ""

    flagged = lines.withColumn("_alone", F.col("line").rlike(STANDALONE))

    def runs(flagged: DataFrame) -> DataFrame:
        counted = flagged.withColumn("_count", F.count_if(F.col("_alone")).over(upto))
        run = counted.withColumn(
            "_break", F.last(F.when(filled & ~F.col("_alone"), F.col("_count")), ignorenulls=True).over(upto)
        )
        return run.select(
            "*",
            (F.col("_count") - F.coalesce("_break", F.lit(0))).alias("_tail"),
            # A frame that ends with the segment would be read again to its end for every line.
            F.expr("lead(nullif(line, ''), 1) IGNORE NULLS OVER (PARTITION BY doc_id, segment ORDER BY ord)").alias("_next"),
        )

    local = runs(flagged)
    summary = local.groupBy("doc_id", "segment").agg(
        F.count_if(F.col("_alone")).alias("n_alone"),
        F.max("_break").isNotNull().alias("broken"),
        F.max_by("_tail", "ord").alias("tail"),
        F.min_by("line", F.when(filled, F.col("ord"))).alias("first_line"),
    )
    doc = Window.partitionBy("doc_id").orderBy("segment")
    summary = summary.withColumn("_sum", F.sum("n_alone").over(doc.rowsBetween(*UP_TO)))
    carry = summary.select(
        "doc_id",
        "segment",
        (
            F.coalesce(F.lag("_sum").over(doc), F.lit(0))
            - F.coalesce(
                F.last(F.when(F.col("broken"), F.col("_sum") - F.col("tail")), ignorenulls=True).over(
                    doc.rowsBetween(*BEFORE)
                ),
                F.lit(0),
            )
        ).alias("_tail_in"),
        F.first("first_line", ignorenulls=True)
        .over(doc.rowsBetween(1, Window.unboundedFollowing))
        .alias("_next_in"),
        F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("_segments"),
    )

    def merged(carried: DataFrame) -> DataFrame:
        placed = (
            carried.withColumn("_run", F.when(F.col("_break").isNull(), F.col("_count") + F.col("_tail_in")).otherwise(F.col("_tail")))
            .withColumn("_run", F.when(F.col("_alone"), F.col("_run")).otherwise(F.lit(0)))
            .withColumn("_next", F.coalesce("_next", "_next_in"))
            .withColumn(
                "_prev",
                F.coalesce(F.last(F.when(filled, F.col("_run")), ignorenulls=True).over(before), F.col("_tail_in")),
            )
        )
        swallowed = (F.col("_prev") % 2 == 1) & (filled | F.col("_next").isNotNull())
        starts = (F.col("_run") % 2 == 1) & F.col("_next").isNotNull()
        return placed.where(~swallowed).select(
            "doc_id",
            "segment",
            "ord",
            F.when(starts, F.concat_ws(" ", "line", "_next")).otherwise(F.col("line")).alias("line"),
        )

    # All columns of the carried state are used on both sides, so that both read one shuffle of the lines.
    every, several = carry.drop("_segments"), carry.where("_segments > 1").drop("_segments")
    keys = ["doc_id", "segment"]
    return merged(local.join(every, keys)), merged(runs(flagged.join(several, keys)))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add kind, label, rest, and for structural headers section and opens."""
    line = F.col("line")
    kind = (
        F.when(line == "", "blank")
        .when(line.rlike(STRUCTURAL), "structural")
        .when(line.rlike(NUMERIC), "numeric")
        .when(line.rlike(PAREN), "paren")
        .when(line.rlike(ALPHA), "alpha")
        .when(line.rlike(ROMAN), "roman")
        .otherwise("body")
    )

    def part(group_of: dict[str, tuple[str, int]]) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, (pattern, index) in group_of.items():
            out = out.when(F.col("kind") == name, F.regexp_extract(line, pattern, index))
        return out

    typed = lines.withColumn("kind", kind).select(
        "*",
        F.lower(
            part({"numeric": (NUMERIC, 1), "paren": (PAREN, 1), "alpha": (ALPHA, 1), "roman": (ROMAN, 1)})
        ).alias("label"),
        tx.strip(
            part({"numeric": (NUMERIC, 2), "paren": (PAREN, 2), "alpha": (ALPHA, 2), "roman": (ROMAN, 2), "structural": (STRUCTURAL, 3)})
        ).alias("rest"),
        part({"structural": (STRUCTURAL, 1)}).alias("keyword"),
        part({"structural": (STRUCTURAL, 2)}).alias("header_number"),
    )
    header = F.concat_ws(" ", "keyword", "header_number")
    return typed.select(
        "doc_id",
        "segment",
        "ord",
        "line",
        "kind",
        F.when(F.col("kind") == "structural", F.col("header_number")).otherwise(F.col("label")).alias("label"),
        "rest",
        F.when(
            F.col("kind") == "structural",
            F.when(F.col("rest") != "", F.concat(header, F.lit(" — "), F.col("rest"))).otherwise(header),
        ).alias("header"),
        F.when(
            F.col("kind") == "structural",
            (F.col("keyword") != "Chapter") & (F.length("rest") >= MIN_CLAUSE_CHARS),
        )
        .when(F.col("kind").isin(*OPENERS), F.lit(True))
        .alias("opens"),
    )


def number_lines(classified: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """Resolve what each line inherits from earlier ones.

    ``several`` are the rows of the documents of more than one segment, if they
    are at hand; only these are summarised (all, if not given).

    Adds ``open_before``, ``open_ord`` (opening line of the clause the line
    belongs to, null outside any clause), ``clause_number``, ``level``,
    ``section``, ``flush`` (a numeric opener that finds no open clause),
    ``since`` (the flush before the line, -1 for none) and ``ends_open`` (does
    the document end inside a clause).

    A numeric opener forgets the paren and alpha labels before it, a paren
    opener the alpha labels; comparing the ords of the running-last labels says
    so without a cascade of windows.  Whether a segment's first boundary is a
    flush depends on earlier segments, so that one line is summarised apart
    (``first_numeric``) and settled once the carried-in state is known.
    """
    before = Window.partitionBy("doc_id", "segment").orderBy("ord").rowsBetween(*BEFORE)
    marks = {
        "bound": F.when(F.col("opens").isNotNull(), F.struct("ord", "opens")),
        "head": F.col("header"),
        "num": F.when(F.col("kind") == "numeric", F.struct("ord", "label")),
        "par": F.when(F.col("kind") == "paren", F.struct("ord", "label")),
        "alp": F.when(F.col("kind") == "alpha", F.struct("ord", "label")),
    }
    segment = Window.partitionBy("doc_id", "segment").orderBy("ord").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    early = F.when((F.col("kind") == "numeric") & F.col("l_bound").isNull(), F.col("ord"))

    def seen_before(lines: DataFrame) -> DataFrame:
        marked = lines.select("*", *[mark.alias(f"m_{name}") for name, mark in marks.items()])
        return marked.select(
            "*",
            *[F.last(f"m_{name}", ignorenulls=True).over(before).alias(f"l_{name}") for name in marks],
            F.last("m_bound", ignorenulls=True).over(segment).alias("w_bound"),
        ).withColumn("known_flush", F.when((F.col("kind") == "numeric") & ~F.col("l_bound.opens"), F.col("ord")))

    local = seen_before(classified).select(
        "*", F.max("known_flush").over(before).alias("l_flush"), F.min(early).over(before).alias("l_numeric")
    )
    summary = (seen_before(several) if several is not None else local).groupBy("doc_id", "segment").agg(
        *[
            F.max_by(f"m_{name}", F.when(F.col(f"m_{name}").isNotNull(), F.col("ord"))).alias(f"s_{name}")
            for name in marks
        ],
        F.max("known_flush").alias("s_flush"),
        F.min(early).alias("first_numeric"),
    )
    doc = Window.partitionBy("doc_id").orderBy("segment")
    earlier = doc.rowsBetween(*BEFORE)
    whole = doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = summary.select(
        "doc_id",
        "segment",
        "s_flush",
        "first_numeric",
        F.coalesce(F.last("s_bound.opens", ignorenulls=True).over(whole), F.lit(False)).alias("ends_open"),
        *[F.last(f"s_{name}", ignorenulls=True).over(earlier).alias(f"c_{name}") for name in marks],
    )
    entered_open = F.coalesce("c_bound.opens", F.lit(False))
    carried = carried.withColumn("first_flush", F.when(~entered_open, F.col("first_numeric")))
    carry = carried.select(
        "doc_id",
        "segment",
        F.col("ends_open").alias("c_ends_open"),
        "first_flush",
        F.max(F.coalesce("s_flush", "first_flush")).over(earlier).alias("c_flush"),
        *[f"c_{name}" for name in marks],
    )

    never = F.lit(-1).cast("long")
    # Segments that are not summarised are whole documents: nothing comes before them.
    whole_document = F.col("c_ends_open").isNull()
    seen = local.join(carry, ["doc_id", "segment"], "left").select(
        *[F.col(c) for c in classified.columns],
        F.coalesce("c_ends_open", "w_bound.opens", F.lit(False)).alias("ends_open"),
        *[F.coalesce(f"l_{name}", f"c_{name}").alias(f"_{name}") for name in marks],
        F.coalesce(
            "l_flush",
            F.when(whole_document, F.col("l_numeric")).when(F.col("first_flush") < F.col("ord"), F.col("first_flush")),
            "c_flush",
            never,
        ).alias("since"),
    )
    num_ord = F.coalesce("_num.ord", never)
    par_ord = F.coalesce("_par.ord", never)
    numeric = F.coalesce("_num.label", F.lit(""))
    with_paren = F.when(par_ord > num_ord, F.concat(numeric, F.lit("("), F.col("_par.label"), F.lit(")"))).otherwise(numeric)
    alpha_live = F.coalesce("_alp.ord", never) > F.greatest(num_ord, par_ord)
    with_alpha = F.when(alpha_live, F.concat(with_paren, F.lit("("), F.col("_alp.label"), F.lit(")"))).otherwise(with_paren)
    bracketed = F.concat(F.lit("("), F.col("label"), F.lit(")"))

    kind = F.col("kind")
    dots = F.length(numeric) - F.length(F.replace(numeric, F.lit("."), F.lit("")))
    deeper = F.when(numeric != "", dots).otherwise(F.lit(0))
    own_dots = F.length("label") - F.length(F.replace(F.col("label"), F.lit("."), F.lit("")))
    open_before = F.coalesce("_bound.opens", F.lit(False))
    return seen.select(
        *[F.col(c) for c in classified.columns],
        open_before.alias("open_before"),
        F.when(F.col("opens"), F.col("ord"))
        .when(F.col("opens").isNull() & open_before, F.col("_bound.ord"))
        .alias("open_ord"),
        F.when(kind.isin("structural", "numeric"), F.col("label"))
        .when(kind == "paren", F.concat(numeric, bracketed))
        .when(kind == "alpha", F.concat(with_paren, bracketed))
        .when(kind == "roman", F.concat(with_alpha, bracketed))
        .alias("clause_number"),
        F.when(kind == "structural", F.lit(1))
        .when(kind == "numeric", own_dots + 1)
        .when(kind.isin("paren", "alpha"), deeper + 2)
        .when(kind == "roman", deeper + 3)
        .cast("int")
        .alias("level"),
        F.coalesce(F.when(kind == "structural", F.col("header")), F.col("_head"), F.lit("")).alias("section"),
        ((kind == "numeric") & ~open_before).alias("flush"),
        "since",
        "ends_open",
    )


def parent_clause(number: Column, section: Column) -> Column:
    return (
        F.when(number.rlike(r"^\([a-z]+\)$"), section)
        .when(F.instr(number, ".") > 0, F.regexp_extract(number, r"^(.*)\.[^.]*$", 1))
        .otherwise(F.lit(""))
    )


def group_lines(numbered_lines: DataFrame) -> DataFrame:
    """Clause and preamble rows from numbered lines, with one shuffle of the text.

    Clause lines meet under their opening line, which contributes the text
    after the number.  Lines outside any clause are preamble: they meet under
    the flush before them and become clause '0' at the next flush, or at the
    end of a document that ends outside a clause; otherwise they are lost.  The
    flush line itself takes part in both groups - it dates the preamble.
    """
    is_opener = F.col("ord") == F.col("open_ord")
    loose = F.col("opens").isNull() & ~F.col("open_before")
    body = F.when(is_opener & (F.col("kind") != "structural"), F.col("rest")).otherwise(F.col("line"))
    head = F.struct("clause_number", "level", F.col("rest").alias("title"), "section")
    nothing = F.lit(None).cast("string")
    places = F.array_compact(
        F.array(
            F.when(
                F.col("open_ord").isNotNull(),
                F.struct(
                    F.lit(True).alias("clause"), F.col("open_ord").alias("at"), body.alias("body"), F.col("ord").alias("counted")
                ),
            ),
            F.when(
                loose | F.col("flush"),
                F.struct(
                    F.lit(False).alias("clause"),
                    F.col("since").alias("at"),
                    F.when(loose, F.col("line")).otherwise(nothing).alias("body"),
                    F.when(loose, F.col("ord")).alias("counted"),
                ),
            ),
        )
    )
    rows = numbered_lines.select(
        "doc_id", "ord", "ends_open",
        F.when(is_opener, head).alias("head"),
        F.when(F.col("flush"), F.col("ord")).alias("flush_ord"),
        F.explode(places).alias("place"),
    ).select("doc_id", "ord", "ends_open", "head", "flush_ord", "place.*")
    grouped = rows.groupBy("doc_id", "clause", "at").agg(
        F.max("head").alias("head"),
        F.coalesce(F.expr("listagg(nullif(body, ''), ' ') WITHIN GROUP (ORDER BY ord)"), F.lit("")).alias("text"),
        page_of(F.min("counted")).alias("page_number"),
        page_of(F.max("counted")).alias("page_end"),
        F.max("flush_ord").alias("flushed_at"),
        F.bool_or("ends_open").alias("ends_open"),
    )
    flushed = F.col("flushed_at").isNotNull() | ~F.col("ends_open")
    kept = F.col("clause") | (flushed & (F.length("text") >= MIN_CLAUSE_CHARS))
    clause = F.col("clause")
    return grouped.where(kept).select(
        "doc_id",
        F.when(clause, F.col("at") * 2 + 1).otherwise(F.coalesce(F.col("flushed_at") * 2, F.lit(AT_END))).alias("seq"),
        F.when(clause, F.col("head.clause_number")).otherwise(F.lit("0")).alias("clause_number"),
        F.when(clause, F.col("head.level")).otherwise(F.lit(0)).alias("level"),
        F.when(clause, F.col("head.title")).otherwise(F.lit("Preamble")).alias("title"),
        F.when(clause, F.col("head.section")).otherwise(F.lit("")).alias("section"),
        "text",
        "page_number",
        "page_end",
    )


def numbered_lines(
    pages: DataFrame, *, pages_per_segment: int = PAGES_PER_SEGMENT, cleaned: bool = False
) -> DataFrame:
    lines = explode_lines(pages, pages_per_segment=pages_per_segment, cleaned=cleaned)
    merged, several = _merged(lines)
    return number_lines(classify_lines(merged), classify_lines(several))


def split_clauses(
    pages: DataFrame, *, pages_per_segment: int = PAGES_PER_SEGMENT, cleaned: bool = False
) -> DataFrame:
    """pages(doc_id, page_number, text) -> clause records, ordered by seq within a document."""
    clauses = group_lines(numbered_lines(pages, pages_per_segment=pages_per_segment, cleaned=cleaned))
    return clauses.where((F.length("text") >= MIN_CLAUSE_CHARS) | (F.col("title") != "")).select(
        "doc_id",
        "seq",
        "clause_number",
        "level",
        "title",
        "text",
        parent_clause(F.col("clause_number"), F.col("section")).alias("parent_clause"),
        "section",
        "page_number",
        "page_end",
    )


def merge_by_number(clauses: DataFrame, group: str = "doc_id") -> DataFrame:
    """One row per clause number: texts joined in order, other fields of the first row.

    ``page_end`` is the last one known.  The number's rows meet in one cell
    because the joined text is the result.
    """
    first = F.struct("level", "title", "parent_clause", "section", "page_number")
    return (
        clauses.groupBy(group, "clause_number")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by(first, "seq").alias("first"),
            F.expr("listagg(nullif(trim(text), ''), ' ') WITHIN GROUP (ORDER BY seq)").alias("text"),
            F.max_by("page_end", F.when(F.col("page_end").isNotNull(), F.col("seq"))).alias("page_end"),
            F.count(F.lit(1)).alias("n_merged"),
        )
        .select(group, "seq", "clause_number", "first.*", F.coalesce("text", F.lit("")).alias("text"), "page_end", "n_merged")
    )


def chunk_policy(
    clauses: DataFrame,
    *,
    document_type: Column | None = None,
    document_name: Column | None = None,
    version: Column | None = None,
) -> DataFrame:
    """Policy chunks from clause records; the index counts merged clauses before empty ones go."""
    nothing = F.lit(None).cast("string")
    # Numbering reads its rows twice: written once, the clauses are not split again for the second time.
    merged = saved(merge_by_number(clauses).withColumn("_segment", F.shiftright("seq", 41)), "merged-clauses")
    indexed = numbered(merged, group=["doc_id"], segment="_segment", order=["seq"], name="_pos").withColumn(
        "chunk_index", (F.col("_pos") - 1).cast("int")
    )
    section_title = F.coalesce(
        F.nullif(tx.strip(F.when(F.col("section") != "", F.col("section")).otherwise(F.col("title"))), F.lit(""))
    )
    reference = F.nullif(F.nullif(tx.strip(F.col("clause_number")), F.lit("")), F.lit("0"))
    return (
        indexed.where(F.col("text") != "")
        .select(
            "doc_id",
            "chunk_index",
            F.col("text").alias("content"),
            section_title.alias("section_title"),
            reference.alias("clause_reference"),
            "page_number",
            "page_end",
            F.struct(
                section_title.alias("section_title"),
                reference.alias("clause_reference"),
                F.col("chunk_index"),
                (document_type if document_type is not None else nothing).alias("document_type"),
                (document_name if document_name is not None else nothing).alias("document_name"),
                (version if version is not None else nothing).alias("version"),
                F.col("page_number"),
                F.col("page_end"),
            ).alias("metadata"),
        )
    )


def payload_rejection(clause_number: Column, text: Column) -> Column:
    """Why a clause may not be stored, or null: it needs a number and at least one character."""
    return F.when(F.coalesce(clause_number, F.lit("")) == "", F.lit("MISSING_NUMBER")).when(
        F.length(F.coalesce(text, F.lit(""))) < 1, F.lit("EMPTY_TEXT")
    )
