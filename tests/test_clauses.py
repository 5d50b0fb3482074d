from __future__ import annotations

import pytest

import os
import random

from clausemill.operators import clauses as cl

FIELDS = ("clause_number", "level", "title", "text", "parent_clause", "section", "page_number", "page_end")


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_number int, text string")


def split(spark, *texts, **kw):
    return cl.split_clauses(pages(spark, *texts), **kw).orderBy("doc_id", "seq").collect()


def numbers(rows):
    return [r.clause_number for r in rows]


def test_numeric_hierarchy(spark):
    rows = split(spark, "  1. General\nAll must comply.\n\n  1.1 Scope\nApplies to banks.\n 1.2 Definitions\nCustomer means holder.")
    assert numbers(rows) == ["1", "1.1", "1.2"]
    assert [r.level for r in rows] == [1, 2, 2]
    assert [r.parent_clause for r in rows] == ["", "1", "1"]
    assert rows[0].text == "General All must comply."


def test_section_header_gives_context_and_a_clause(spark):
    rows = split(spark, "Section 4 — Data Retention\n\n4.1 Keep records for seven years.\n4.2 Protect records.")
    assert numbers(rows) == ["4", "4.1", "4.2"]
    assert rows[0].text == "Section 4 — Data Retention" and rows[0].level == 1
    assert {r.section for r in rows} == {"Section 4 — Data Retention"}


def test_sub_labels(spark):
    rows = split(spark, "2. Requirements\n(1) One thing\n(a) Keep logs\n(ii) roman\n(b) Review\n(i) single letter\n3. Next\n(a) again")
    assert numbers(rows) == ["2", "2(1)", "2(1)(a)", "2(1)(a)(ii)", "2(1)(b)", "2(1)(i)", "3", "3(a)"]
    assert [r.level for r in rows] == [1, 2, 2, 3, 2, 2, 1, 2]


def test_labels_without_a_number(spark):
    rows = split(spark, "Rule 1\n(1) first rule\n(a) inner\n(iv) deep\n")
    assert numbers(rows) == ["(1)", "(1)(a)", "(1)(a)(iv)"]
    assert rows[0].section == "Rule 1"
    alone = split(spark, "Rule 7\n(a) lettered only")
    assert (alone[0].clause_number, alone[0].parent_clause) == ("(a)", "Rule 7")


def test_parent_is_the_text_before_the_last_dot(spark):
    rows = split(spark, "4.1 Something\n(a) more of it\n2. Two things\n(a) and more")
    assert [(r.clause_number, r.parent_clause) for r in rows] == [("4.1", "4"), ("4.1(a)", "4"), ("2", ""), ("2(a)", "")]


def test_numbers_on_lines_of_their_own(spark):
    rows = split(spark, "Chapter III — Acceptance\n16.\nFrame a policy for customers.\n17.\n\nWithout prejudice.\n(1)\nno anonymous names.\n18.")
    assert numbers(rows) == ["16", "17", "17(1)"]
    assert rows[0].text == "Frame a policy for customers."
    assert rows[2].text == "no anonymous names. 18."


def test_runs_of_standalone_numbers_pair_up(spark):
    rows = split(spark, "1.\n(a)\n2.\nBody of the second one.")
    assert [(r.clause_number, r.text) for r in rows] == [("1", "(a)"), ("2", "Body of the second one.")]


def test_prose_that_starts_with_a_number_opens_a_clause(spark):
    rows = split(spark, "2016 was the year.\n12.5% of it\nSection shall apply")
    assert numbers(rows) == ["2016", "12"]
    assert rows[1].title == "5% of it"


def test_preamble_is_kept_flushed_or_lost(spark):
    flushed = split(spark, "Issued by the board\n1. First clause")
    assert [(r.clause_number, r.level, r.title) for r in flushed] == [("0", 0, "Preamble"), ("1", 1, "First clause")]
    assert numbers(split(spark, "only prose without numbers")) == ["0"]
    assert numbers(split(spark, "too short\n1. First clause")) == ["1"]
    # A paren opener does not flush; the document ends inside a clause: lost.
    assert numbers(split(spark, "prose that will be lost\n(1) a clause")) == ["(1)"]
    # ... but a later numeric opener outside any clause flushes what is pending.
    late = split(spark, "prose that waits here\n(1) a clause\nChapter 2\nmore prose here\n5. Five things")
    assert [(r.clause_number, r.text) for r in late] == [
        ("(1)", "a clause"), ("0", "prose that waits here more prose here"), ("5", "Five things"),
    ]


def test_pages_of_a_clause(spark):
    rows = split(spark, "1. Intro\nApplies to all.", "more of it\n1.1 Scope\nContinues.")
    assert [(r.page_number, r.page_end) for r in rows] == [(1, 2), (2, 2)]


def test_segments_do_not_change_the_result(spark):
    """The same random documents, cut into segments of 1, 2, 3 pages and not at all."""
    tokens = [
        "", "", "plain words here", "other body text", "Chapter 3", "Section 2 — Long enough title", "Rule 9 x",
        "3. Numbered clause", "4.2 Deeper clause", "(2) paren clause", "(b) alpha clause", "(iii) roman clause",
        "7.", "5.1", "(3)", "(c)", "(iv)",
    ]
    rng = random.Random(11)
    rows = [
        (doc, page, "\n".join(rng.choice(tokens) for _ in range(rng.randint(0, 4))))
        for doc in range(60)
        for page in range(1, rng.randint(2, 9))
    ]
    frame = spark.createDataFrame(rows, "doc_id int, page_number int, text string").cache()
    want = sorted(map(tuple, cl.split_clauses(frame, pages_per_segment=1000).collect()))
    assert len(want) > 200
    for size in (1, 2, 3):
        assert sorted(map(tuple, cl.split_clauses(frame, pages_per_segment=size).collect())) == want


def test_no_text_is_lost_inside_clauses(spark):
    rows = split(spark, "1. alpha beta\ngamma delta\n\n(a) epsilon\nzeta", "eta theta\n2. iota kappa")
    assert " ".join(r.text for r in rows) == "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_chunks_merge_equal_numbers(spark):
    records = cl.split_clauses(pages(spark, "4.1 Conduct due diligence.\nAnd more.", "4.1 Retain documents.\n4.2 Other duty"))
    chunks = cl.chunk_policy(records).orderBy("chunk_index").collect()
    assert [(c.chunk_index, c.clause_reference, c.page_number, c.page_end) for c in chunks] == [(0, "4.1", 1, 2), (1, "4.2", 2, 2)]
    assert chunks[0].content == "Conduct due diligence. And more. Retain documents."


def test_preamble_chunk_has_no_reference(spark):
    records = cl.split_clauses(pages(spark, "Issued by the board\n1. First clause"))
    chunks = cl.chunk_policy(records).orderBy("chunk_index").collect()
    assert [(c.clause_reference, c.section_title) for c in chunks] == [(None, "Preamble"), ("1", "First clause")]


def test_the_next_line_is_not_looked_for_to_the_end_of_the_segment(spark):
    rows = [(1, n, "\n".join(t)) for n, t in enumerate([["1.", "", "(a)", "x"], [""], ["2", ""], ["y", "3."]], 1)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    merged = cl.merge_standalone_numbers(cl.explode_lines(pages, pages_per_segment=2))
    assert [r.line for r in merged.orderBy("ord").collect() if r.line] == ["1. (a)", "x", "2 y", "3."]
    plan = merged._jdf.queryExecution().analyzed().toString()
    assert "lead(" in plan and "first(CASE WHEN" not in plan


def plan_of(spark, name):
    from clausemill.plans import metadata_queries, text_queries  # noqa: F401
    from clausemill.plans.registry import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
@pytest.mark.parametrize("name", ["classify_line", "structural_header", "clause_number_full", "clause_level"])
def test_documents_are_made_into_pages_once(spark, name):
    assert plan_of(spark, name).count("FileScan parquet") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
@pytest.mark.parametrize("name", ["clause_pages", "chunk_policy", "meta_enrich_clause"])
def test_clauses_are_not_split_again_to_be_numbered(spark, name):
    """Both branches of the numbering read what was written, not the pages."""
    plan = plan_of(spark, name)
    assert "listagg" not in plan and "documents.parquet" not in plan


def _odd_pages(spark, n_docs=6, n_pages=7):
    forms = ["", "2", "(a)", "Section 4 — Scope of duties", "Chapter 2", "3. Opening words", "(1) First item", "(b) second", "(ii) third",
             "plain words of the text", "(x)", "1.2", "closing words here"]
    rows = [
        (d, p, "\n".join(forms[(d * 5 + p * 7 + i * (3 + d)) % len(forms)] for i in range(5)))
        for d in range(n_docs)
        for p in range(n_pages if d else 1)
    ]
    return spark.createDataFrame(rows, "doc_id long, page_number int, text string")


@pytest.mark.parametrize("pages_per_segment", [2, 100])
def test_only_documents_of_several_segments_are_summarised(spark, pages_per_segment):
    lines = cl.explode_lines(_odd_pages(spark), pages_per_segment=pages_per_segment)
    merged, several = cl._merged(lines)
    left, right = cl.number_lines(cl.classify_lines(merged)), cl.number_lines(cl.classify_lines(merged), cl.classify_lines(several))
    numbered = [sorted(map(repr, frame.collect())) for frame in (left, right)]
    assert numbered[0] and numbered[0] == numbered[1]
    assert {r.doc_id for r in several.collect()} == {d for d in range(6) if d and pages_per_segment < 7}


def test_cleaned_text_is_not_searched_for_other_line_ends(spark):
    pages = spark.createDataFrame([(1, 1, "a\nb\n"), (1, 2, ""), (2, 1, "c\n\nd")], "doc_id long, page_number int, text string")
    cleaned, other = cl.explode_lines(pages, cleaned=True), cl.explode_lines(pages)
    assert cleaned.collect() == other.collect()
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "\u2028" not in plan and "\u2028" in other._jdf.queryExecution().executedPlan().toString()


def test_duplicate_report_lists_groups_with_pages_and_texts(spark):
    from clausemill.operators import catalog

    rows = [(1, 5, "2", 3, "zwei – é"), (1, 3, "2", 2, "two"), (1, 1, "10", 1, "ten"), (1, 9, "10", 4, "ten"), (1, 7, "3", 4, "x"), (2, 1, "1", 1, "y")]
    report = catalog.duplicate_clause_report(spark.createDataFrame(rows, "doc_id long, seq long, clause_number string, page_number int, text string"))
    got = {r.doc_id: r for r in report.collect()}
    assert (got[1].total_clauses, got[1].unique_numbers, got[1].duplicate_numbers) == (5, 3, 2)
    assert got[1].duplicate_ids == ["10", "2"]
    assert got[1].duplicate_pages == [[1, 4], [2, 3]]
    assert got[1].duplicate_texts == [["ten", "ten"], ["two", "zwei ? ?"]]
    assert (got[2].total_clauses, got[2].duplicate_ids, got[2].duplicate_pages, got[2].duplicate_texts) == (1, [], [], [])
