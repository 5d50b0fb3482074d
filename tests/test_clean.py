from __future__ import annotations

import random

from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators import clean
from clausemill.operators.clean import CleanOptions


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first().x


def block(spark, text, **options):
    return one(spark, text, lambda c: clean.clean_block(c, CleanOptions(**options)))


def test_words_broken_at_line_ends_are_joined(spark):
    assert block(spark, "The institu-\ntion shall keep a- b- c.") == "The institution shall keep abc."
    assert "institu-" in block(spark, "institu-\ntion", broken_words=False)


def test_soft_hyphens_vanish(spark):
    assert block(spark, "regu\u00adlation") == "regulation"


def test_page_number_lines_vanish(spark):
    text = "Central Bank\n12\n- 12 -\n3/40\nPAGE 3\n[ 3 ]\nSection 3.1\nPage 12 of 40"
    assert block(spark, text) == "Central Bank\nSection 3.1"
    assert "42" in block(spark, "Content\n42\nMore", page_numbers=False).split("\n")


def test_white_space(spark):
    assert block(spark, "Clause   4.2\t\trequires  it.\n\n\n\nNext.") == "Clause 4.2 requires it.\n\nNext."
    assert block(spark, "a \n\n b", keep_paragraphs=False) == "a b"
    assert block(spark, "   ") == ""


def test_lines_follow_every_line_end(spark):
    split = lambda t: one(spark, t, tx.split_lines)
    assert split("a\r\nb\x0bc\u2028d\x85") == ["a", "b", "c", "d"]
    assert split("") == [] and split("\n") == [""] and split("a\n\n") == ["a", ""]


def test_status_of_missing_and_blank_text(spark):
    rows = spark.createDataFrame([(None,), (" ",), ("x",)], "text string")
    status = clean.clean_status(F.col("text"), CleanOptions(reject_empty=True))
    assert [r[0] for r in rows.select(status).collect()] == ["TEXT_MISSING", "EMPTY_TEXT", "ok"]


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_number int, text string")


def test_repeated_first_and_last_lines_go(spark):
    rows = pages(spark, *[f"BULLETIN/100\nSection {i}\nBody of page {i}.\nwww.bank.example" for i in (1, 2, 3)])
    got = {r.page_number: r.text for r in clean.clean_pages(rows).collect()}
    assert got == {i: f"Section {i}\nBody of page {i}." for i in (1, 2, 3)}


def test_one_page_has_no_furniture(spark):
    text = "Repeated Header\nMain content.\nRepeated Footer"
    assert clean.clean_pages(pages(spark, text)).first().text == text


def test_threshold_truncates_and_counts_occurrences(spark):
    # 4 pages: int(4 * 0.6) = 2, so two occurrences suffice - even on one page.
    rows = pages(spark, "Twice\nTwice\nx1", "x2", "x3", "x4")
    found = {(r.zone, r.line_key): r.occurrences for r in clean.detect_furniture(rows).collect()}
    assert found == {("header", "twice"): 2, ("footer", "twice"): 2}
    assert [r.text for r in clean.clean_pages(rows).orderBy("page_number").collect()] == ["x1", "x2", "x3", "x4"]


def test_document_joins_filled_pages(spark):
    row = clean.clean_document(pages(spark, "Chapter 1 content.", " ", "Chapter 2 content.")).first()
    assert (row.text, row.n_pages) == ("Chapter 1 content.\n\nChapter 2 content.", 3)


def test_a_text_is_split_once_for_all_its_lines(spark):
    """The count of lines comes along with each line; beside the explode it would split the whole text again per line."""
    from clausemill.plans import inputs

    docs = spark.createDataFrame([(1, "a\nb", "s"), (2, None, "s"), (3, "\n" * 20, None)], "doc_id long, text string, source string")
    pages = inputs.pages_of_documents(docs)
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.doc_id, r.page_number) for r in pages.collect()) == [(1, 1), (3, 1), (3, 2), (3, 3)]


def test_squeezing_line_by_line_equals_squeezing_the_text(spark):
    lines = ["a b", " a  b", "a\tb", "a\x1fb", "é  b", "Σ ", "ΑΣ", "", "a\r\nb", "a\x85 b", "- x"]
    rows = spark.createDataFrame([("\n".join(lines),)], "t string")
    whole = F.transform(tx.split_lines(F.lower(tx.squeeze_blanks(F.col("t")))), tx.strip)
    got = rows.select(tx.line_keys(F.col("t")).alias("a"), whole.alias("b")).first()
    assert got.a == got.b and got.a[:4] == ["a b"] * 4


def test_lines_of_odd_texts_and_how_often_they_are_split(spark):
    rng = random.Random(17)
    texts = ["", "\n", "a\r\nb\rc\n\r", "x\n", "\n\n"] + ["".join(rng.choice("a b12/-\t\r\n\n\x0b\x0c\x1c\x1d\x1e\x85  ­　é") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    steps = tx.squeeze_whitespace(tx.drop_page_number_lines(tx.join_broken_words(tx.drop_soft_hyphens(F.col("t")))))
    rows = frame.select("t", tx.split_lines(F.col("t")).alias("lines"), clean.clean_block(F.col("t")).alias("a"), steps.alias("b")).collect()
    assert all(r.lines == (None if r.t is None else r.t.splitlines()) and r.a == r.b for r in rows)
    plan = frame.select(clean.clean_block(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # in one place: by the pattern, or without it


def test_ends_told_by_bytes_are_stripped_alike(spark):
    ends = ["", " ", "\t", "\n", "\x1f", "\x7f", "!", "~", "a", "\x85", "\xa0", "é", "\u2003", "\u3000", "\u00ad", "😀"]
    frame = spark.createDataFrame([(a + mid + b,) for a in ends for b in ends for mid in ("", "x y", " ")] + [(None,)], "t string")
    both = frame.select(tx.strip_plain(F.col("t")).alias("a"), tx.strip(F.col("t")).alias("b"))
    assert both.where("NOT a <=> b").isEmpty()


def test_furniture_is_looked_for_among_lines_that_begin_like_it(spark):
    """What is no furniture by its first character gets no key, and what has the key goes, however it is written."""
    heads = ["ΑΣ  x", "\u3000İx", " 😀 a\tb", "ß", "Σ", "- 1 -x"]
    texts = [[f"{h}{' ' * n}\nbody {n}\n\t{h.lower()}\n\n Σmore {n}" for n in range(3)] for h in heads]
    rows = spark.createDataFrame([(d, n, t) for d, doc in enumerate(texts) for n, t in enumerate(doc)], "doc_id int, page_number int, text string")
    furniture = clean.detect_furniture(rows)
    keys = {}
    for r in furniture.collect():
        keys.setdefault(r.doc_id, set()).add(r.line_key)
    lines = rows.select("doc_id", "page_number", F.posexplode(tx.split_lines(F.col("text"))).alias("i", "line")).select("*", tx.line_key(F.col("line")).alias("key"))
    want = {}
    for r in lines.orderBy("doc_id", "page_number", "i").collect():
        want.setdefault((r.doc_id, r.page_number), []).extend([] if r.key in keys[r.doc_id] else [r.line])
    stripped = clean.strip_furniture(rows, furniture)
    assert {(r.doc_id, r.page_number): r.text for r in stripped.collect()} == {k: "\n".join(v) for k, v in want.items()}
    assert len(keys) == len(heads) and "_starts" in stripped._jdf.queryExecution().optimizedPlan().toString()
