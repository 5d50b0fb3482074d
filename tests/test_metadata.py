from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import metadata as md
from clausemill.functions import text as tx


def extract(spark, text, filename):
    rows = spark.createDataFrame([(text, filename)], "text string, filename string")
    return rows.select(md.document_metadata(F.col("text"), F.col("filename")).alias("m")).first().m


def value(spark, expr, **columns):
    rows = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return rows.select(expr.alias("x")).first().x


def test_regulator_type_and_date(spark):
    m = extract(spark, "\n Reserve Bank of India\nMaster Direction - Know Your Customer, 2016\nEffective from 1st January 2016", "rbi_kyc.pdf")
    assert (m.regulator, m.document_type, m.effective_date, m.source) == ("RBI", "master direction", "2016-01-01", "rbi_kyc.pdf")
    assert m.document_name == "Reserve Bank of India" and m.jurisdiction == "IN"


def test_nothing_is_made_up(spark):
    m = extract(spark, "Short text only.", "unknown.pdf")
    assert (m.publication_date, m.version, m.regulator, m.document_type, m.effective_date) == (None,) * 5
    assert m.document_name == "Unknown"


def test_pattern_priority_beats_position(spark):
    assert value(spark, md.first_date(F.col("t")), t="on 03.04.2020 or 2021-05-06 or 7th March, 2022") == "2022-03-07"
    assert value(spark, md.first_date(F.col("t")), t="on 03.04.2020 or 2021-05-06") == "2021-05-06"
    assert value(spark, md.first_date(F.col("t")), t="on 03.04.2020") == "2020-04-03"


def test_publication_date_and_version(spark):
    assert value(spark, md.publication_date(F.col("t")), t="Issued: 12th May 2019 by") == "2019-05-12"
    assert value(spark, md.publication_date(F.col("t")), t="published 2019-05-12") == "2019-05-12"
    assert value(spark, md.version(F.col("t"), F.col("f")), t="Ver. 2.1-b", f="x_v9.pdf") == "2.1-b"
    assert value(spark, md.version(F.col("t"), F.col("f")), t="none", f="x_V9.2.pdf") == "9.2"


def test_section_repeats_its_title_without_a_colon(spark):
    assert value(spark, md.section(F.col("t")), t="see Section 4: Duties\nx") == "Section 4 — Duties"
    assert value(spark, md.section(F.col("t")), t="see Rule 3 Duties") == "Rule 3 Duties — Duties"


def test_invalid_dates_become_null(spark):
    assert value(spark, md.parse_date(F.col("t")), t="2016-02-31") is None
    assert str(value(spark, md.parse_date(F.col("t")), t="2016-02-28")) == "2016-02-28"


def test_title_case_and_file_names(spark):
    assert value(spark, tx.title_case(F.col("t")), t="o'NEIL v2kyc déjà") == "O'Neil V2Kyc Déjà"
    assert value(spark, tx.safe_file_name(F.col("t")), t="a/b/c.pdf") == "c.pdf"
    assert [value(spark, tx.safe_file_name(F.col("t")), t=t) for t in ("..", " ", "x/.")] == ["upload.pdf"] * 3


def test_readable_id(spark):
    got = value(spark, md.readable_clause_id(F.col("r"), F.col("n"), F.col("c")), r="pci_dss", n="Master Direction on Know Your Customer", c="3.1")
    assert got == "PCI_D-KYC-3.1"


def test_overrides(spark):
    rows = spark.createDataFrame([("GDPR text version 7", "f.pdf")], "text string, filename string")
    meta = md.document_metadata(F.col("text"), F.col("filename"))
    m = rows.select(md.with_overrides(meta, {"jurisdiction": F.lit("XX"), "section": F.lit(None).cast("string")}, title=F.lit("T")).alias("m")).first().m
    assert (m.regulator, m.version, m.document_type, m.document_name, m.jurisdiction, m.section) == ("RBI", "1.0", "regulation", "T", "XX", None)


def test_clause_metadata(spark):
    schema = "number string, parent string, section string, title string, level int, page int"
    rows = spark.createDataFrame(
        [("4.1", "4", "Section 4 — X", "T", 2, 3), ("(a)", "4.1", "", "", 3, 3), ("(b)", "Rule 1", "", "", 3, 3), ("4.1(a)", "4", "", "", 3, 3)], schema
    )
    meta = F.struct(
        *[F.lit("Section 9" if n == "section" else None).cast("string").alias(n) for n in
          ("document_name", "document_type", "regulator", "jurisdiction", "effective_date", "publication_date", "version", "section", "source")]
    )
    got = rows.select(
        md.clause_metadata(
            meta, document_id=F.lit("v"), clause_number=F.col("number"), parent=F.col("parent"), section=F.col("section"),
            title=F.col("title"), level=F.col("level"), page_number=F.col("page"), page_end=F.col("page"),
        ).alias("m")
    ).collect()
    picked = [(r.m.section_number, r.m.sub_clause, r.m.chapter, r.m.regulator) for r in got]
    assert picked == [
        ("4.1", None, "Section 4 — X", "RBI"), ("4.1", "4.1(a)", "Section 9", "RBI"),
        (None, "(b)", "Section 9", "RBI"), (None, None, "Section 9", "RBI"),
    ]
    assert len(got[0].m) == 21
