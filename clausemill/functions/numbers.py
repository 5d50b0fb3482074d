"""Rounding that agrees with correctly rounded, half-to-even decimal rounding of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 134217729.0  # 2**27 + 1: cuts a double into two 26-bit halves


def round_exact(value: Column, digits: int = 2) -> Column:
    """Round the *binary* value of a non-negative double, ties to even.

    Spark's ``round`` works on the shortest decimal text of a double, so it
    takes 2.675 (binary 2.67499...) to 2.68; the scores here must give 2.67.
    Doubling the scaled value puts ties on odd whole numbers; where the product
    lands on one, its rounding error - recovered exactly by splitting the
    factor - tells the side.
    """
    scale = F.lit(2.0 * 10.0**digits)
    # Plain arithmetic throughout, without lambdas, so that it is compiled; what
    # is mentioned twice is a few multiplications or computed once by Spark.
    product = value * scale
    high = value * F.lit(SPLITTER) - (value * F.lit(SPLITTER) - value)
    error = (high * scale - product) + (value - high) * scale
    below = F.floor(product / 2.0).cast("double")
    rest = product - below * 2.0
    even = F.pmod(below, F.lit(2.0)) == 0.0
    # rest is 1 exactly where the product lands on a tie.
    up = F.when(rest != 1.0, rest > 1.0).when(error != 0.0, error > 0.0).otherwise(~even)
    return (below + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(10.0**digits)


def two_decimals(value: Column) -> Column:
    """Text of any non-negative double on two decimals."""
    return hundredths(round_exact(value, 2))


def hundredths(value: Column) -> Column:
    """Text of a non-negative value that has no more than two decimals; whole cents are exact and need no decimal type."""
    cents = F.floor(value * 100.0 + 0.5)
    rest = F.pmod(cents, F.lit(100))
    whole = F.floor((cents - rest) / 100.0)
    return F.concat(whole.cast("string"), F.when(rest < 10, F.lit(".0")).otherwise(F.lit(".")), rest.cast("string"))
