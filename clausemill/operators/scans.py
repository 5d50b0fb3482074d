"""Running values over an ordered group without one task per group.

A window partitioned by a document reads that document in one task, and a
single document may hold a large share of all rows.  These helpers cut each
group into *segments*: the window runs per (group, segment), the segments are
summarised to one row each, the carried-in value is found by a window over
those few summary rows, and an equi-join brings it back.  The clause operators
follow the same steps with their own summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def numbered(
    df: DataFrame, *, group: Sequence[str], segment: str, order: Sequence[str], name: str
) -> DataFrame:
    """Add the 1-based position of each row in its group; ``segment`` must not decrease along ``order``."""
    local = Window.partitionBy(*group, segment).orderBy(*order)
    sizes = df.groupBy(*group, segment).agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*group).orderBy(segment).rowsBetween(*BEFORE)
    offsets = sizes.select(*group, segment, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    return (
        df.withColumn("_pos", F.row_number().over(local))
        .join(offsets, [*group, segment])
        .select(*[F.col(c) for c in df.columns], (F.col("_pos") + F.col("_offset")).alias(name))
    )
