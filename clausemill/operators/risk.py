"""Deterministic weighted risk score with an auditable breakdown."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.numbers import hundredths, round_exact, two_decimals
from clausemill.functions.text import bind

# Severity of a compliance status.
STATUS_SEVERITY = {
    "COMPLIANT": 0.00,
    "PARTIALLY_COMPLIANT": 0.50,
    "NON_COMPLIANT": 1.00,
    "INSUFFICIENT_EVIDENCE": 0.60,
}

# The four-step scale used for criticality and for gap severity.
SCALE = {"LOW": 0.25, "MEDIUM": 0.50, "HIGH": 0.75, "CRITICAL": 1.00}

# Words that put a gap on a severity step, tried in this order.
GAP_WORDS = {
    "CRITICAL": (
        "critical", "no control", "unprotected", "completely absent", "severe", "unauthorized",
        "violation", "prohibited", "no evidence", "missing mandatory", "breach", "zero", "fail",
    ),
    "HIGH": (
        "lacks", "missing", "fails to", "not defined", "not implemented", "inadequate", "absent",
        "no policy", "unencrypted", "non-compliant", "omitted",
    ),
    "MEDIUM": (
        "partial", "incomplete", "unclear", "ambiguous", "inconsistent", "procedure",
        "not specified", "delay", "gap", "category", "exceptions",
    ),
    "LOW": (
        "minor", "documentation", "periodic review", "update", "formatting", "advisory",
        "guideline", "clarification", "recommended",
    ),
}

# Factor weights; they sum to 1.
WEIGHTS = {
    "compliance_severity": 0.40,
    "regulatory_criticality": 0.20,
    "gap_severity": 0.15,
    "evidence_strength": 0.15,
    "confidence": 0.10,
}

# Exclusive upper bounds of the risk levels; the rest is CRITICAL.
LEVEL_BOUNDS = {"LOW": 20.0, "MEDIUM": 40.0, "HIGH": 70.0}

DEFAULT_CRITICALITY = "MEDIUM"
GAP_TYPE = "struct<description:string,severity:string>"


def _lookup(key: Column, table: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, value in table.items():
        out = out.when(key == name, F.lit(value))
    return out


def classify_gap(text: Column) -> Column:
    """Severity of a gap text: the first step one of whose words it contains."""

    def step(lower: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for severity, words in GAP_WORDS.items():
            out = out.when(reduce(or_, [F.contains(lower, F.lit(w)) for w in words]), F.lit(severity))
        return out.otherwise(F.lit("MEDIUM"))

    return bind(F.lower(text), step)


def normalize_gaps(gaps: Column) -> Column:
    """array<struct<description, severity>> with every severity on the scale."""

    def one(gap: Column) -> Column:
        given = F.upper(gap["severity"])
        return F.struct(
            gap["description"].alias("description"),
            F.when(given.isin(*SCALE), given).otherwise(classify_gap(gap["description"])).alias("severity"),
        )

    return F.transform(gaps, one)


def gaps_from_text(texts: Column) -> Column:
    return F.transform(
        texts, lambda t: F.struct(t.alias("description"), F.lit(None).cast("string").alias("severity"))
    )


def max_gap_severity(gaps: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(gaps, lambda g: _lookup(g["severity"], SCALE))), F.lit(0.0))


def evidence_strength(similarities: Column) -> Column:
    """Mean similarity held to [0, 1]; no evidence counts 0."""
    total = F.aggregate(similarities, F.lit(0.0), lambda s, x: s + x.cast("double"))
    mean = total / F.size(similarities)
    return F.when(F.coalesce(F.size(similarities), F.lit(0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).otherwise(
        F.lit(0.0)
    )


def status_severity(status: Column) -> Column:
    return _lookup(F.upper(status), STATUS_SEVERITY)


def criticality_value(criticality: Column) -> Column:
    return _lookup(F.upper(F.coalesce(criticality, F.lit(DEFAULT_CRITICALITY))), SCALE)


def contribution(value: Column, factor: str) -> Column:
    return round_exact(value * F.lit(WEIGHTS[factor]) * F.lit(100.0), 2)


def total_score(contributions: list[Column]) -> Column:
    total = contributions[0]
    for part in contributions[1:]:
        total = total + part
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_exact(total, 2)))


def risk_level(score: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, upper in LEVEL_BOUNDS.items():
        out = out.when(score < upper, F.lit(name))
    return F.when(score.isNotNull(), out.otherwise(F.lit("CRITICAL")))


def display_band(score: Column) -> Column:
    """The three colours of the dashboard; its bounds differ from ``risk_level``."""
    return F.when(score < 20, F.lit("low")).when(score <= 70, F.lit("medium")).when(score.isNotNull(), F.lit("high"))


def rejection(status: Column, confidence: Column, criticality: Column) -> Column:
    """Why an input row cannot be scored, or null."""
    return (
        F.when(
            confidence.isNull() | F.isnan(confidence) | (confidence < 0.0) | (confidence > 1.0),
            F.concat(F.lit("Confidence must be between 0.0 and 1.0, got "), F.coalesce(confidence.cast("string"), F.lit("None"))),
        )
        .when(
            status_severity(status).isNull(),
            F.concat(F.lit("Invalid compliance status '"), F.coalesce(status, F.lit("None")), F.lit("'")),
        )
        .when(
            criticality_value(criticality).isNull(),
            F.concat(F.lit("Invalid regulatory criticality '"), criticality, F.lit("'")),
        )
    )


def _explanation() -> Column:
    def pts(factor: str) -> Column:
        return hundredths(F.col(f"c_{factor}"))

    uncertain = F.lit(
        " points (weight 40%). Lack of policy evidence introduces inherent compliance uncertainty, "
        "as absence of evidence cannot be treated as compliant."
    )
    plain = F.lit(" points (weight 40%).")
    return F.concat_ws(
        " ",
        F.concat(F.lit("Assessed compliance risk score is "), hundredths(F.col("risk_score")), F.lit(" ("), F.col("risk_level"), F.lit(").")),
        F.concat(
            F.lit("Compliance status is "), F.col("status_key"), F.lit(" contributing "), pts("compliance_severity"),
            F.when(F.col("status_key") == "INSUFFICIENT_EVIDENCE", uncertain).otherwise(plain),
        ),
        F.concat(
            F.lit("Regulatory requirement criticality is "), F.col("criticality_key"), F.lit(" contributing "),
            pts("regulatory_criticality"), F.lit(" points (weight 20%)."),
        ),
        F.when(
            F.col("n_gaps") > 0,
            F.concat(
                F.lit("Identified "), F.col("n_gaps").cast("string"), F.lit(" gap(s) with maximum severity "),
                hundredths(F.col("v_gap_severity")), F.lit(", contributing "), pts("gap_severity"), F.lit(" points (weight 15%)."),
            ),
        ).otherwise(F.concat(F.lit("No policy gaps were identified, contributing "), pts("gap_severity"), F.lit(" points (weight 15%)."))),
        F.concat(
            F.lit("Average verified evidence similarity is "), two_decimals(F.col("v_evidence_strength")), F.lit(", contributing "),
            pts("evidence_strength"), F.lit(" points (weight 15%). Step 2B model confidence is "),
            two_decimals(F.col("v_confidence")), F.lit(", contributing "), pts("confidence"), F.lit(" points (weight 10%)."),
        ),
    )


def _breakdown() -> Column:
    measured = ("evidence_strength", "confidence")

    def value(factor: str) -> Column:
        return (two_decimals if factor in measured else hundredths)(F.col(f"v_{factor}"))

    described = {
        "compliance_severity": F.concat(F.lit("Status "), F.col("status_key"), F.lit(" mapped to severity "), value("compliance_severity"), F.lit(".")),
        "regulatory_criticality": F.concat(
            F.lit("Regulatory clause criticality "), F.col("criticality_key"), F.lit(" mapped to "), value("regulatory_criticality"), F.lit(".")
        ),
        "gap_severity": F.when(
            F.col("n_gaps") > 0,
            F.concat(F.lit("Maximum gap severity "), value("gap_severity"), F.lit(" across "), F.col("n_gaps").cast("string"), F.lit(" gap(s).")),
        ).otherwise(F.lit("No identified gaps.")),
        "evidence_strength": F.concat(F.lit("Average verified evidence similarity is "), value("evidence_strength"), F.lit(".")),
        "confidence": F.concat(F.lit("Step 2B analysis confidence is "), value("confidence"), F.lit(".")),
    }
    return F.struct(
        *[
            F.struct(
                F.col(f"v_{name}").alias("value"),
                F.lit(weight).alias("weight"),
                F.col(f"c_{name}").alias("contribution"),
                described[name].alias("description"),
            ).alias(name)
            for name, weight in WEIGHTS.items()
        ]
    )


def score_risk(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score rows of (status, confidence, similarities, gaps, criticality, ...).

    ``similarities`` holds the verified evidence of the row (at most top-k
    values), ``gaps`` is ``array<struct<description, severity>>``.  Returns the
    scored rows and the rejected ones with a ``reject_reason``.
    """
    given = [c for c in inputs.columns if c not in ("status", "confidence", "similarities", "gaps", "criticality")]
    checked = inputs.withColumn("reject_reason", rejection(F.col("status"), F.col("confidence"), F.col("criticality")))
    rejected = checked.where(F.col("reject_reason").isNotNull())
    gaps = normalize_gaps(F.coalesce("gaps", F.array().cast(f"array<{GAP_TYPE}>")))
    valued = (
        checked.where(F.col("reject_reason").isNull())
        .withColumn("gaps", gaps)
        .select(
            *given,
            "gaps",
            F.upper("status").alias("status_key"),
            F.upper(F.coalesce("criticality", F.lit(DEFAULT_CRITICALITY))).alias("criticality_key"),
            F.size("gaps").alias("n_gaps"),
            status_severity(F.col("status")).alias("v_compliance_severity"),
            criticality_value(F.col("criticality")).alias("v_regulatory_criticality"),
            max_gap_severity(F.col("gaps")).alias("v_gap_severity"),
            evidence_strength(F.col("similarities")).alias("v_evidence_strength"),
            F.col("confidence").cast("double").alias("v_confidence"),
        )
    )
    parts = valued.select("*", *[contribution(F.col(f"v_{name}"), name).alias(f"c_{name}") for name in WEIGHTS])
    scored = parts.withColumn("risk_score", total_score([F.col(f"c_{name}") for name in WEIGHTS])).withColumn(
        "risk_level", risk_level(F.col("risk_score"))
    )
    result = scored.select(
        *given,
        "risk_score",
        "risk_level",
        F.col("status_key").alias("compliance_status"),
        F.col("v_confidence").alias("confidence"),
        _breakdown().alias("factor_breakdown"),
        F.col("gaps").alias("identified_gaps"),
        _explanation().alias("explanation"),
    )
    return result, rejected
