"""Nearest-neighbour joins by cosine similarity.

Exact top-k needs every left vector compared with every right vector of its
scope.  Spark lays that work out as a grid: both sides are cut into blocks by a
hash of the row id, a cell is one (left block, right block) pair that emits at
most ``k`` rows per left vector and scope - never the pairs themselves.  No side
is broadcast or collected, and no scope value (organisation, hash bucket) can
make a cell larger, because blocks are cut by id.

``knn_join_exact`` holds a cell's left block, whose size is bounded, and lets the
right rows pass by scope after scope.  So right blocks may be long, which keeps
both the copies of rows and the candidates per left row few.  The other joins
run cells of two bounded blocks, each one matrix product: ``knn_join_approx``
only inside shared sign-hash buckets, so its cost grows with bucket sizes
instead of the whole product.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.operators.cells import RANK_DIGITS, SIMILARITY_DIGITS, cell_kernel, sign_kernel, stream_kernel

BLOCK_ROWS = 8192  # a 1024-dimension block is 64 MiB of doubles
HELD_VALUES = 1 << 22  # numbers in a left block that is held while right rows pass: 32 MiB of doubles
PASSING_ROWS = 1 << 18  # right rows that pass a block in one task, while there are few tasks
FEW_CELLS = 32
MIN_CELL_ROWS = 256  # below this a cell is not worth a task
#: Tables, planes and further buckets of the approximate join.
TABLES, BITS, PROBES = 16, 6, 3
MAX_BROADCAST_BUCKETS = 1 << 20
MIN_SIDE_BLOCKS = 8  # a middle-sized side is still spread over this many blocks


def _block_count(rows: Column, block_rows: int, spread_out: bool = True) -> Column:
    """Blocks for a side: bounded size, yet some parallelism for middle-sized inputs."""
    by_size = F.ceil(rows / F.lit(block_rows))
    if not spread_out:
        return F.greatest(by_size, F.lit(1)).cast("int")
    spread = F.least(F.lit(MIN_SIDE_BLOCKS), F.ceil(rows / F.lit(MIN_CELL_ROWS)))
    return F.greatest(by_size, spread, F.lit(1)).cast("int")


def _best(hits: DataFrame, k: int, digits: int | None = SIMILARITY_DIGITS) -> DataFrame:
    """Rank the cells' candidates by the raw similarity, then round it; Spark limits every group to k before the shuffle."""
    order = Window.partitionBy("left_id", "scope").orderBy(F.desc(F.round("similarity", RANK_DIGITS)), "right_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best if digits is None else best.withColumn("similarity", F.round("similarity", digits))


def _hit_fields(left: DataFrame, right: DataFrame) -> tuple[T.StructType, pa.Schema]:
    fields = [
        T.StructField("left_id", left.schema["left_id"].dataType),
        T.StructField("scope", right.schema["scope"].dataType),
        T.StructField("right_id", right.schema["right_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ]
    arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}
    return T.StructType(fields), pa.schema([(f.name, arrow[f.dataType]) for f in fields])


def _run_cells(left: DataFrame, right: DataFrame, keys: list[str], k: int, threshold: float | None, skip_self: bool) -> DataFrame:
    """Cogroup two sides on ``keys`` and run the kernel per cell."""
    fields, schema = _hit_fields(left, right)
    kernel = cell_kernel(k, threshold, schema, skip_self)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, fields)


def _stream_cells(left: DataFrame, right: DataFrame, k: int, threshold: float | None, skip_self: bool) -> DataFrame:
    """Both sides by ``block``, in one sorted stream per task: a block's left rows, then its right rows by scope."""
    fields, schema = _hit_fields(left, right)
    only_left, only_right = left.schema["left_vector"].dataType, right.schema["right_vector"].dataType
    nothing = lambda kind: F.lit(None).cast(kind)
    held = left.select(
        "block", F.lit(0).alias("side"), nothing(fields["scope"].dataType).alias("scope"),
        "left_id", "left_vector", nothing(fields["right_id"].dataType).alias("right_id"), nothing(only_right).alias("right_vector"),
    )
    passing = right.select(
        "block", F.lit(1).alias("side"), "scope",
        nothing(fields["left_id"].dataType).alias("left_id"), nothing(only_left).alias("left_vector"), "right_id", "right_vector",
    )
    rows = held.unionByName(passing).repartition("block").sortWithinPartitions("block", "side", "scope")
    return rows.mapInArrow(stream_kernel(k, threshold, schema, skip_self), fields)


def _sides(left: DataFrame, right: DataFrame, dim: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the rows whose vectors can be compared; ``search.check_dimensions`` gives the others."""
    if "scope" not in right.columns:
        right = right.withColumn("scope", F.lit(0))
    size = F.size("vector")
    fits = size == (right.where(size > 0).agg(F.mode(size, True)).scalar() if dim is None else F.lit(dim))
    scope = ["scope"] if "scope" in left.columns else []
    return (
        left.where(fits).select("left_id", *scope, F.col("vector").alias("left_vector")),
        right.where(fits).select("right_id", "scope", F.col("vector").alias("right_vector")),
    )


def _blocks(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _keyed_cells(
    left: DataFrame, right: DataFrame, key: list[str], block_rows: int, few_keys: bool, spread_out: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Cells inside each value of ``key``: a value that holds many rows is cut into a grid by id like a whole table.

    Without ``spread_out`` only values of more than ``block_rows`` rows are cut: every
    cut copies the other side's rows, and many keys are tasks enough.
    """
    count = _block_count(F.count(F.lit(1)), block_rows, spread_out)
    sizes = left.groupBy(*key).agg(count.alias("n_left")).join(right.groupBy(*key).agg(count.alias("n_right")), key)
    sizes = F.broadcast(sizes) if few_keys else sizes
    left_cells = (
        left.join(sizes, key)
        .withColumn("lb", F.pmod(F.xxhash64("left_id"), F.col("n_left")).cast("int"))
        .withColumn("rb", _blocks(F.col("n_right")))
        .drop("n_left", "n_right")
    )
    right_cells = (
        right.join(sizes, key)
        .withColumn("rb", F.pmod(F.xxhash64("right_id"), F.col("n_right")).cast("int"))
        .withColumn("lb", _blocks(F.col("n_left")))
        .drop("n_left", "n_right")
    )
    return left_cells, right_cells


def knn_join_exact(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    dim: int | None = None,
    threshold: float | None = None,
    block_rows: int | None = None,
    skip_self: bool = False,
) -> DataFrame:
    """Top-k of right(right_id, vector[, scope]) for every left(left_id, vector) and scope.

    Returns (left_id, scope, right_id, similarity, rank).  Rank and
    ``threshold`` go by the raw similarity, ties by right_id; the result shows
    it rounded to 4 decimals.  Only vectors of dimension ``dim`` are compared,
    by default the commonest of the right side.  A left block has ``block_rows``
    rows, by default as many as make ``HELD_VALUES`` numbers.
    """
    left, right = _sides(left, right, dim)
    left = left.drop("scope")
    rows = F.count(F.lit(1))
    by_size = F.ceil(F.sum(F.size("left_vector")) / F.lit(HELD_VALUES)) if block_rows is None else F.ceil(rows / F.lit(block_rows))
    spread = F.least(F.lit(MIN_SIDE_BLOCKS), F.ceil(rows / F.lit(MIN_CELL_ROWS)))
    n_left = left.agg(F.greatest(F.coalesce(by_size, F.lit(1)), spread, F.lit(1)).cast("int")).scalar()
    # Right blocks add candidates, so there are several only where left blocks are few.
    by_size = F.ceil(rows / F.lit(PASSING_ROWS if block_rows is None else block_rows))
    n_right = right.agg(F.greatest(F.least(by_size, F.ceil(F.lit(FEW_CELLS) / n_left)), F.lit(1)).cast("int")).scalar()
    place = F.col("lb") * n_right + F.col("rb")
    left_cells = left.withColumn("lb", F.pmod(F.xxhash64("left_id"), n_left).cast("int")).withColumn("rb", _blocks(n_right))
    right_cells = right.withColumn("rb", F.pmod(F.xxhash64("right_id"), n_right).cast("int")).withColumn("lb", _blocks(n_left))
    return _best(_stream_cells(left_cells.withColumn("block", place), right_cells.withColumn("block", place), k, threshold, skip_self), k)


def knn_join_scoped(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    dim: int | None = None,
    threshold: float | None = None,
    block_rows: int = BLOCK_ROWS,
    digits: int | None = SIMILARITY_DIGITS,
) -> DataFrame:
    """Like ``knn_join_exact``, but left(left_id, scope, vector) meets the rows of its own scope only.

    The scope is part of the cell's key, so work and output do not grow with
    the number of scopes; a scope that holds most rows is cut into cells by id.
    With ``digits=None`` similarities stay as they are.
    """
    left, right = _sides(left, right, dim)
    left_cells, right_cells = _keyed_cells(left, right, ["scope"], block_rows, few_keys=False)
    left_cells, right_cells = (side.withColumn("_scope", F.col("scope")) for side in (left_cells, right_cells))
    return _best(_run_cells(left_cells.drop("scope"), right_cells, ["_scope", "lb", "rb"], k, threshold, False), k, digits)


def sign_buckets(vector: Column, *, dim: int, tables: int, bits: int, seed: int, probes: int = 0) -> Column:
    """array<int>: per table, the bucket given by the sides of ``bits`` random planes, then the ``probes`` next ones."""
    return F.arrow_udf(sign_kernel(dim, tables, bits, seed, probes), "array<int>")(vector)


def knn_join_approx(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    dim: int,
    threshold: float | None = None,
    tables: int = TABLES,
    bits: int = BITS,
    probes: int = PROBES,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
    skip_self: bool = False,
) -> DataFrame:
    """Like ``knn_join_exact`` but only vectors sharing a hash bucket are compared.

    Similarities are exact; some partners may be missing.  Each of ``tables``
    cuts the space by ``bits`` random planes; a left vector looks into its own
    bucket and the ``probes`` buckets beyond the planes it is nearest to.  More
    tables and probes find more and compare more; ``comparisons`` counts.  A
    bucket of any size is cut into grid cells by id, so it costs many bounded
    tasks, not one large one.
    """
    left_b, right_b = _bucketed(left, right, dim, tables, bits, probes, seed)
    # At most tables * 2**bits rows, whatever the data: safe to broadcast while that is small.
    few = tables << bits <= MAX_BROADCAST_BUCKETS
    key = ["table", "bucket"]
    left_cells, right_cells = _keyed_cells(left_b, right_b, key, block_rows, few, spread_out=False)
    cells = _run_cells(left_cells, right_cells, [*key, "lb", "rb"], k, threshold, skip_self)
    distinct = cells.groupBy("left_id", "scope", "right_id").agg(F.max("similarity").alias("similarity"))
    return _best(distinct, k)


def _bucketed(left, right, dim, tables, bits, probes, seed) -> tuple[DataFrame, DataFrame]:
    left, right = _sides(left, right, dim)

    def entered(side: DataFrame, vector: str, beyond: int) -> DataFrame:
        codes = sign_buckets(F.col(vector), dim=dim, tables=tables, bits=bits, probes=beyond, seed=seed)
        entries = side.withColumn("b", codes).select(*side.columns, F.posexplode("b").alias("at", "bucket"))
        return entries.withColumn("table", F.expr(f"cast(at div {beyond + 1} as int)")).drop("at")

    return entered(left.drop("scope"), "left_vector", probes), entered(right, "right_vector", 0)


def comparisons(
    left: DataFrame, right: DataFrame, *, dim: int, tables: int = TABLES, bits: int = BITS, probes: int = PROBES, seed: int = 7
) -> DataFrame:
    """One row: the pairs that the approximate join compares, and those that the exact one does."""
    left_b, right_b = _bucketed(left, right, dim, tables, bits, probes, seed)
    key = ["table", "bucket"]
    met = left_b.groupBy(*key).agg(F.count(F.lit(1)).alias("l")).join(right_b.groupBy(*key).agg(F.count(F.lit(1)).alias("r")), key)
    left, right = _sides(left, right, dim)
    pairs = left.agg(F.count(F.lit(1))).scalar() * right.agg(F.count(F.lit(1))).scalar()
    return met.agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("compared")).withColumn("all_pairs", pairs)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact pairs, how many of them the approximate join found, and the share."""
    pair = ["left_id", "scope", "right_id"]
    marked = exact.select(*pair).join(approx.select(*pair, F.lit(1).alias("found")), pair, "left")
    return marked.agg(F.count(F.lit(1)).alias("exact_pairs"), F.count("found").alias("found_pairs")).withColumn(
        "recall", F.try_divide(F.col("found_pairs").cast("double"), F.col("exact_pairs"))
    )
