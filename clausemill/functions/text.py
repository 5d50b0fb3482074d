"""String expressions shared by the cleaning and splitting operators.

Every function takes and returns a ``Column``, so the work stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space and as line ends.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
# These patterns are tried at every character of every text: each starts with a test that printable ASCII fails at once.
LINE_END = r"[[^ -~]&&[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]](?:(?<=\r)\n)?"
_RARE_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# White space inside a line; single blanks are left alone because they stay as they are.
_BLANK = "[[^!-~]&&[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]]"
BLANK_RUN = f"{_BLANK}(?:{_BLANK}+|(?<! ))"
SPACE_RUN = f"[{SPACES}]+"

# The five forms of a line that is only a page number.
PAGE_NUMBER_FORMS = (
    r"\d+",
    r"-\s*\d+\s*-",
    r"\d+\s*/\s*\d+",
    r"page\s+\d+(?:\s+of\s+\d+)?",
    r"\[\s*\d+\s*\]",
)
PAGE_NUMBER_LINE = rf"(?iU-u)^\s*(?:{'|'.join(PAGE_NUMBER_FORMS)})\s*$"

SOFT_HYPHEN = "\u00ad"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    Expressions around lambdas get no common-subexpression elimination, so a
    repeated argument would be evaluated again at every mention and nesting level.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Remove white space (any Unicode space or line end) at both ends."""
    return F.btrim(col, F.lit(SPACES))


def strip_plain(col: Column) -> Column:
    """``strip`` of a value at hand (it is mentioned often): trimming measures the whole text, so ends that are printable
    ASCII are told by their bytes first."""
    return _strip_plain(col, SPACES)


def strip_line(col: Column) -> Column:
    """``strip_plain`` of a line of a text whose only line ends are line feeds; others are not looked for."""
    return _strip_plain(col, "".join(c for c in SPACES if c not in _RARE_LINE_ENDS))


def _strip_plain(col: Column, spaces: str) -> Column:
    data = col.cast("binary")

    def inner(at: int) -> Column:
        return F.substring(data, at, 1).between(F.lit(bytearray(b"!")), F.lit(bytearray(b"~")))

    return F.when(inner(-1) & inner(1), col).otherwise(F.btrim(col, F.lit(spaces)))


def split_lines(col: Column, *, line_feeds_only: bool = False) -> Column:
    """Lines of a text; a final line end opens no further line, '' has no line.

    A text whose only line ends are line feeds is split without a pattern, and not
    searched for other line ends if it is known to have none.
    """

    def parts_of(text: Column) -> Column:
        if line_feeds_only:
            return F.split(text, "\n", -1)
        rare = [F.contains(text, F.lit(c)) for c in _RARE_LINE_ENDS]
        return F.when(reduce(Column.__or__, rare), F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))

    return bind(
        bind(col, parts_of),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def squeeze_blanks(col: Column) -> Column:
    """One blank for every run of white space inside a line; line ends stay."""
    return F.regexp_replace(col, BLANK_RUN, " ")


def squeeze_line(col: Column) -> Column:
    """``squeeze_blanks`` for a line: ASCII lines without a tab, a unit separator or two blanks stay as they are."""

    def squeezed(line: Column) -> Column:
        ascii_only = F.length(line) == F.octet_length(line)
        runs = [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\x1f")]
        return F.when(ascii_only & ~runs[0] & ~runs[1] & ~runs[2], line).otherwise(squeeze_blanks(line))

    return bind(col, squeezed)


def is_blank(line: Column) -> Column:
    """Nothing but white space; reads no further than the first other character."""
    return F.ltrim(line, F.lit(SPACES)) == ""


def line_key(line: Column) -> Column:
    """What lines are compared by: lower case, white space squeezed, stripped."""
    return bind(F.lower(squeeze_line(line)), strip_plain)


def key_start(line: Column) -> Column:
    """The first character of a line's ``line_key``, '' for a blank line."""
    return F.left(F.lower(F.left(F.ltrim(line, F.lit(SPACES)), F.lit(1))), F.lit(1))


def line_keys(col: Column) -> Column:
    """``line_key`` of a text's lines; ASCII lines lower and squeeze much faster than whole texts that are not ASCII."""
    return F.transform(split_lines(col), line_key)


def drop_soft_hyphens(col: Column) -> Column:
    return F.replace(col, F.lit(SOFT_HYPHEN), F.lit(""))


def join_broken_words(col: Column) -> Column:
    """Rejoin ``word- word`` across blanks or line ends.

    The lookarounds leave both letters unconsumed, so one pass reaches the
    fixpoint even for chains such as ``a- b- c``.  The hyphen is looked for
    first, and what stands before it only where there is one.
    """
    return F.regexp_replace(col, rf"(?U)-(?<=\w-){SPACE_RUN}(?=\w)", "")


def no_page_numbers(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~line.rlike(PAGE_NUMBER_LINE))


def drop_page_number_lines(col: Column) -> Column:
    return join_lines(no_page_numbers(split_lines(col)))


def squeeze_whitespace(col: Column, *, keep_paragraphs: bool = True) -> Column:
    return squeeze_lines(split_lines(col), keep_paragraphs=keep_paragraphs)


def squeeze_lines(lines: Column, *, keep_paragraphs: bool = True) -> Column:
    """``squeeze_whitespace`` of a text given as its lines."""
    joined = bind(join_lines(F.transform(lines, lambda line: bind(squeeze_line(line), strip_plain))), strip_plain)
    if keep_paragraphs:
        far = F.lit("\n\n\n")
        return bind(joined, lambda c: F.when(F.contains(c, far), F.regexp_replace(c, r"\n{3,}", "\n\n")).otherwise(c))
    return strip(F.regexp_replace(joined, SPACE_RUN, " "))


def truncate(col: Column, limit: int = 500) -> Column:
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.substring(col, 1, limit - 3), F.lit("...")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def safe_file_name(name: Column, default: str = "upload.pdf") -> Column:
    base = strip(base_name(F.coalesce(name, F.lit(""))))
    return F.when(base.isin("", ".", ".."), F.lit(default)).otherwise(base)


def title_case(col: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the rest."""

    def title(letters: Column) -> Column:
        return F.transform(
            letters,
            lambda ch, i: F.when((i > 0) & F.get(letters, i - 1).rlike(r"\p{L}"), ch).otherwise(F.upper(ch)),
        )

    return F.array_join(bind(F.split(F.lower(col), ""), title), "")


def character_runs(letters: Column, n: int) -> Column:
    """All runs of n characters of a text given as an array of at least one character."""
    if n == 1:
        return letters
    last = F.greatest(F.size(letters) - n, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.concat_ws("", *[F.get(letters, i + j) for j in range(n)])
    )
