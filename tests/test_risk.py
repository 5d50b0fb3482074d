from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clausemill.functions.numbers import round_exact, two_decimals
from clausemill.operators import risk

SCHEMA = (
    "id int, status string, confidence double, similarities array<double>, "
    "gaps array<struct<description:string,severity:string>>, criticality string"
)


def score(spark, *rows):
    frame = spark.createDataFrame(
        [(i, s, c, sims, [(g, None) if isinstance(g, str) else g for g in gaps], crit) for i, (s, c, sims, gaps, crit) in enumerate(rows)],
        SCHEMA,
    )
    good, bad = risk.score_risk(frame)
    return good.orderBy("id").collect(), bad.orderBy("id").collect()


def test_rounding_agrees_with_python(spark):
    rng = random.Random(5)
    values = [0.125, 2.675, 0.375, 1.005, 0.005, 0.0, 99.995, 11.655] + [rng.random() * 100 for _ in range(3000)]
    values += [round(rng.random() * 100, 3) for _ in range(3000)] + [k / 1000 for k in range(5, 2000, 10)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_exact(F.col("v")).alias("r"), two_decimals(F.col("v")).alias("t"))
    for row in got.collect():
        assert row.r == round(row.v, 2), row
        assert row.t == f"{row.v:.2f}", row


def test_known_scores(spark):
    rows, _ = score(
        spark,
        ("COMPLIANT", 0.50, [0.60], [], "LOW"),
        ("INSUFFICIENT_EVIDENCE", 0.0, [], ["No relevant evidence found"], "MEDIUM"),
        ("NON_COMPLIANT", 0.90, [0.85], ["Completely absent control for onboarding"], "HIGH"),
        ("compliant", 0.0, [0.70, 0.90], [], None),
    )
    assert [(r.risk_score, r.risk_level) for r in rows] == [(19.0, "LOW"), (41.5, "HIGH"), (91.75, "CRITICAL"), (22.0, "MEDIUM")]
    assert "cannot be treated as compliant" in rows[1].explanation
    assert "No policy gaps were identified" in rows[0].explanation
    assert rows[3].factor_breakdown.evidence_strength.contribution == 12.0
    assert rows[2].compliance_status == "NON_COMPLIANT"


def test_more_evidence_and_confidence_raise_the_score(spark):
    rows, _ = score(spark, ("COMPLIANT", 0.1, [0.1], [], "LOW"), ("COMPLIANT", 0.9, [0.9], [], "LOW"))
    assert rows[0].risk_score < rows[1].risk_score


@pytest.mark.parametrize(
    ("value", "level", "band"),
    [(19.99, "LOW", "low"), (20.0, "MEDIUM", "medium"), (39.99, "MEDIUM", "medium"), (40.0, "HIGH", "medium"),
     (69.99, "HIGH", "medium"), (70.0, "CRITICAL", "medium"), (70.01, "CRITICAL", "high")],
)
def test_levels_and_bands(spark, value, level, band):
    row = spark.range(1).select(risk.risk_level(F.lit(value)).alias("l"), risk.display_band(F.lit(value)).alias("b")).first()
    assert (row.l, row.b) == (level, band)


def test_gap_words(spark):
    texts = ["Control fails to log", "Policy lacks detail", "Partial coverage", "Minor formatting", "Nothing special", "non-compliant wording"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(risk.classify_gap(F.col("t")).alias("s"))
    assert [r.s for r in frame.collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MEDIUM", "HIGH"]


def test_given_severity_wins_when_valid(spark):
    rows, _ = score(spark, ("COMPLIANT", 0.5, [], [("no control", "low"), ("minor", "odd")], "LOW"))
    assert [g.severity for g in rows[0].identified_gaps] == ["LOW", "LOW"]


def test_rejections(spark):
    rows, bad = score(
        spark, ("COMPLIANT", 1.5, [], [], "LOW"), ("MAYBE", 0.5, [], [], "LOW"), ("COMPLIANT", 0.5, [], [], "URGENT"), ("COMPLIANT", 0.5, [], [], "low")
    )
    assert [r.id for r in rows] == [3]
    assert [r.id for r in bad] == [0, 1, 2]
    assert "Confidence" in bad[0].reject_reason and "status" in bad[1].reject_reason and "criticality" in bad[2].reject_reason


def test_weights_sum_to_one():
    assert sum(risk.WEIGHTS.values()) == pytest.approx(1.0)
