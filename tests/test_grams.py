from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clausemill.operators import catalog, grams
from clausemill.session import work_dir

TEXTS = [
    "Data Retention", "data_retention", "data-ret", "DATA RETENTION policy", "da", "", None, "back\\slash 100% sure", "ΟΔΟΣ και ΟΔΟΣΑ",
    "οδος", "emoji 😀😀😀 run", "İstanbul trade", "aaaaaa", "line\nbreak here", "x" * 5000 + "needle" + "y" * 5000,
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    drawn = [" ".join(rng.choice(["data", "Retention", "shall", "be", "kept", "bank"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    keyed = [(i, t) for i, t in enumerate(TEXTS + drawn)]
    # Repeated keys, null keys, and a column named as the index's own.
    keyed += [(3, "kept apart"), (None, "no key shall be"), (None, "data again")]
    return spark.createDataFrame([(k, t, "g") for k, t in keyed], "id long, text string, gram string").cache()


@pytest.fixture(scope="module")
def index(spark, rows):
    return grams.build_gram_index(rows, "id", F.col("text"), work_dir(spark, "grams"))


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


PATTERNS = [
    "%data%", "%Data_Ret%", "%data%kept%", "data%", "%bank", "%", "", "_", "%ab%", "%da%", "%shall be%", "%zzz%", "%100\\%%",
    "%k\\\\sl%", "%ΟΔΟΣ%", "%οδοσ%", "%😀😀😀%", "%İst%", "%needle%", "%aaaa%", "%e\nb%", "no key%", "%apart",
]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_the_index_changes_no_row(rows, index, ignore_case):
    for pattern in PATTERNS:
        plain = F.col("text").ilike(pattern) if ignore_case else F.col("text").like(pattern)
        got = rows_of(grams.rows_like(rows, "id", "text", pattern, index, ignore_case=ignore_case))
        assert got == rows_of(rows.where(plain)), pattern


def test_only_candidates_are_tested(rows, index):
    assert index.holders(grams.literal_runs("%needle%")).count() == 1
    assert index.holders(grams.literal_runs("%zzz%")).count() == 0
    assert index.holders(grams.literal_runs("%ab%_%")) is None
    shall_be = rows.where(F.col("text").ilike("%shall be%")).select("id").distinct().count()
    assert shall_be <= index.holders(["shall be"]).count() < rows.count() / 2
    plan = index.holders(["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [EqualTo(gram" in plan or "Or(" in plan


def test_literals_of_a_pattern():
    assert grams.literal_runs("%a\\%b_c\\\\%") == ["a%b", "c\\"]
    assert grams.literal_runs("") == [] == grams.literal_runs("%_%")


def test_terms_in_any_column(spark):
    rows = spark.createDataFrame([(1, "Ring road", None), (2, "ab", "SPRING"), (3, "ri", "ng"), (4, None, None)], "id int, a string, b string")
    index = grams.build_gram_index(rows, "id", grams.joined_columns(["a", "b"]), work_dir(spark, "grams"))
    for term in ("Ring", "ri", "", "i\nn", "zebra"):
        got = grams.rows_containing(rows, "id", ["a", "b"], term, index)
        assert rows_of(got) == rows_of(catalog.catalog_text_filter(rows, term, ["a", "b"])), term


def test_an_index_of_nothing(spark, rows):
    none, path = rows.limit(0), work_dir(spark, "grams")
    index = grams.build_gram_index(none, "id", F.col("text"), path)
    assert grams.rows_like(none, "id", "text", "%data%", index).count() == 0
    assert grams.read_gram_index(spark, path).counts.count() == 0
