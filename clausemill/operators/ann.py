"""Nearest-neighbour joins through a trained index.

``train`` fits a coarse quantiser (spherical k-means) and code books for what a
vector's centroid leaves of it (product quantisation); every iteration is a
Spark job that sums per partition and then per centroid, and the driver holds
centroids and code books only, whose size is a parameter.  ``build`` writes the
index of *every* right vector: its cell and its code.

``knn_join_indexed`` is approximate: queries meet the codes of the cells that
may hold a neighbour, and only a short list of each query is compared by its
vectors.  ``knn_join_pruned`` is exact: after a first look into the nearest
cell, a cell is built for a query only if the triangle inequality lets one of
its members reach the query's k-th best.

Cells are cut into bundles of bounded size by a hash of the right id, queries of
a bundle into blocks by a hash of the left id; so neither a crowded cell nor one
that all queries ask for becomes a large task.  Rows without a direction (null,
empty or all zeros, or of another dimension) take no part; ties go to the
smaller right id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.operators import codes
from clausemill.operators.cells import RANK_DIGITS, SIMILARITY_DIGITS, cell_kernel
from clausemill.session import work_dir

SAMPLE_ROWS = 65_536  # about so many vectors train the index
MAX_CELLS = 4096
PARTS_OF_DIM = 4  # dimensions to a code byte
CODES = 256
ROUNDS = 4
SLABS = 8  # groups in which sums of partitions are added up
BLOCK_ROWS = 8192
#: The cells looked into at first, how far others may reach, and how many neighbours per asked one are compared by their vectors.
FIRST, REACH, SHORT_LIST = 2, 4.5, 40

_SUMS = "place long, n long, total array<double>"


class Index(NamedTuple):
    """``rows`` (right_id, cell, angle, code) are all vectors; the rest has a size fixed by parameters."""

    dim: int
    centroids: np.ndarray
    books: np.ndarray
    rows: DataFrame
    vectors: DataFrame
    count: np.ndarray
    farthest: np.ndarray
    mean: np.ndarray


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    """Written below ``spark.checkpoint.dir`` and read back: lost executors cost their tasks only."""
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _directed(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has the dimension, numbers only, and a direction."""
    fit = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)
    return rows.where(F.coalesce(fit, F.lit(False)))


def _means(sample: DataFrame, kernel, old: np.ndarray) -> np.ndarray:
    """The mean of the vectors at each place; places that none is nearest to stay as they were."""
    # A task adds the sums of many places: a call for each of them would cost more than the adding.
    sums = sample.mapInArrow(kernel, _SUMS).groupBy(F.pmod("place", F.lit(SLABS)).alias("slab")).applyInArrow(codes.add_sums, _SUMS).toArrow()
    new = old.copy().reshape(-1, old.shape[-1])
    if sums.num_rows:
        total = sums["total"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sums.num_rows, -1)
        new[sums["place"].to_numpy()] = total / sums["n"].to_numpy()[:, None]
    return new.reshape(old.shape)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def train(vectors: DataFrame, *, dim: int, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS):
    """(centroids, code books) of ``vectors`` (right_id, right_vector).

    Vectors whose id's hash is below a bound take part, about ``sample_rows`` of
    them (all of a smaller table); ``cells`` is the square root of the number of
    vectors by default, 4,096 at most.  The same rows give the same index up to
    the rounding of sums.
    """
    n = vectors.count()
    cells = max(1, min(cells or int(np.sqrt(n)), MAX_CELLS))
    mark = F.xxhash64("right_id")
    bound = min(2**63 - 1, int(-(2**63) + min(1.0, sample_rows / max(n, 1)) * 2**64))
    sample = vectors.where(mark <= F.lit(bound)).select(mark.alias("mark"), "right_id", F.col("right_vector").alias("vector"))
    sample = _written(sample, "ann-sample").coalesce(16)
    most = max(cells, CODES)
    begin = sample.orderBy("mark", "right_id").limit(most).select("vector").toArrow()["vector"]
    parts = -(-dim // PARTS_OF_DIM)
    if len(begin) == 0:
        return np.zeros((1, dim)), np.zeros((parts, 1, PARTS_OF_DIM))
    rows = codes.unit_rows(begin)
    centroids = rows[:cells]
    plain = sample.select("vector")
    for _ in range(rounds):
        centroids = _unit(_means(plain, codes.cell_sums(centroids), centroids))
    left = rows[:CODES] - centroids[codes.nearest(rows[:CODES], centroids)[0]]
    books = np.ascontiguousarray(codes._split(left, parts).transpose(1, 0, 2))
    for _ in range(rounds - 1):
        books = _means(plain, codes.code_sums(centroids, books), books)
    return centroids, books


def build(right: DataFrame, *, dim: int, **training) -> Index:
    """The index of all rows of right(right_id, vector)."""
    vectors = _directed(right.select("right_id", F.col("vector").alias("right_vector")), "right_vector", dim)
    centroids, books = train(vectors, dim=dim, **training)
    fields = T.StructType(
        [right.schema["right_id"], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("code", T.BinaryType())]
    )
    rows = _written(vectors.mapInArrow(codes.indexed(centroids, books), fields), "ann-index")
    # A row per cell, 4,096 at most.
    found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far"), F.avg("angle").alias("mean")).toArrow()
    count, far, mean = np.zeros(len(centroids), np.int64), np.zeros(len(centroids)), np.zeros(len(centroids))
    at = found["cell"].to_numpy()
    count[at], far[at], mean[at] = (found[c].to_numpy() for c in ("n", "far", "mean"))
    return Index(dim, centroids, books, rows, vectors, count, far, mean)


def _bundles(count: np.ndarray, rows: int, together: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its first bundle and the number of bundles it is cut into; small cells share one if they may."""
    base, pieces = np.zeros(len(count), np.int64), -(-count // rows)
    at, filled = 0, 0
    for c in np.flatnonzero(count):
        if filled and not (together and filled + count[c] <= rows):
            at, filled = at + 1, 0
        base[c], filled = at, filled + count[c]
        if pieces[c] > 1:
            at, filled = at + pieces[c], 0
    return base, pieces


def _placed(index: Index, base: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """The index's rows with their bundle."""
    schema = "cell int, base int, pieces int"
    cells = [(int(c), int(base[c]), int(pieces[c])) for c in np.flatnonzero(pieces)]
    # At most MAX_CELLS rows, whatever the data.
    where = F.broadcast(index.rows.sparkSession.createDataFrame(cells, schema))
    bundle = F.col("base") + F.pmod(F.xxhash64("right_id"), F.col("pieces")).cast("int")
    return index.rows.join(where, "cell").withColumn("bundle", bundle).drop("base", "pieces")


def _asked(index: Index, left: DataFrame, base, pieces, first: int, bound, floor: float | None, purpose: str) -> DataFrame:
    fields = T.StructType(
        [left.schema["left_id"], left.schema["left_vector"], T.StructField("bundle", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]
    )
    return _written(left.mapInArrow(codes.probes(index.centroids, base, pieces, first, bound, floor), fields), purpose)


def _met(asked: DataFrame, placed: DataFrame, kernel, fields: T.StructType, block_rows: int) -> DataFrame:
    """Every bundle with the queries that look into it, cut into blocks of queries."""
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int")
    sizes = asked.groupBy("bundle").agg(blocks.alias("blocks"))
    left = asked.join(sizes, "bundle").withColumn("block", F.pmod(F.xxhash64("left_id"), F.col("blocks")).cast("int"))
    right = placed.join(sizes, "bundle").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["bundle", "block"]
    return left.drop("blocks").groupBy(*key).cogroup(right.drop("blocks").groupBy(*key)).applyInArrow(kernel, fields)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("left_id").orderBy(F.desc(F.round("similarity", RANK_DIGITS)), "right_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_tau(left: DataFrame, first_hits: DataFrame, k: int) -> DataFrame:
    """Queries with the k-th best similarity they met so far; null if they met fewer."""
    tau = first_hits.where(F.col("rank") == k).select("left_id", F.col("similarity").alias("tau"))
    return left.join(tau, "left_id", "left")


_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}


def _fields(left: DataFrame, right: DataFrame, scope: bool = False) -> tuple[T.StructType, pa.Schema]:
    fields = [left.schema["left_id"], right.schema["right_id"], T.StructField("similarity", T.DoubleType())]
    if scope:
        fields.insert(1, T.StructField("scope", T.IntegerType()))
    return T.StructType(fields), pa.schema([(f.name, _ARROW[f.dataType]) for f in fields])


class Found(NamedTuple):
    """The join's rows, and what was asked: (left_id, left_vector, bundle, cells) of all looks into cells."""

    rows: DataFrame
    asked: DataFrame


def _queries(left: DataFrame, dim: int) -> DataFrame:
    return _directed(left.select("left_id", F.col("vector").alias("left_vector")), "left_vector", dim)


def search_index(
    left: DataFrame,
    index: Index,
    k: int,
    *,
    threshold: float | None = None,
    skip_self: bool = False,
    first: int = FIRST,
    reach: float = REACH,
    short_list: int = SHORT_LIST,
    block_rows: int = BLOCK_ROWS,
) -> Found:
    """Approximate top-k of the index for every left(left_id, vector): (left_id, right_id, similarity, rank).

    A query first meets the codes in its ``first`` nearest cells, which gives
    its k-th best so far, then those in all cells whose usual members, turned
    ``reach`` standard shares towards the query, come up to it.  The
    ``short_list * k`` best by their codes are compared by their vectors, so
    similarities are exact; a neighbour may be missing if its cell was not
    looked into or its code hid it.
    """
    left = _queries(left, index.dim)
    wide = max(k, short_list * k)
    base, pieces = _bundles(index.count, block_rows, together=True)
    placed = _placed(index, base, pieces)
    fields, schema = _fields(left, index.rows)
    kernel = codes.code_kernel(index.centroids, index.books, wide, schema, skip_self)
    asked = _asked(index, left, base, pieces, first, None, None, "ann-asked")
    near = _written(_top(_met(asked, placed, kernel, fields, block_rows), wide), "ann-near")
    mean, dim = index.mean, index.dim
    more = _asked(
        index, _with_tau(left, near, k), base, pieces, first, lambda s: codes.usual_bound(s, mean, reach, dim), threshold, "ann-more"
    )
    far = _met(more, placed, kernel, fields, block_rows)
    listed = _top(near.drop("rank").unionByName(far), wide).select("left_id", "right_id")
    pairs = listed.join(index.vectors, "right_id").join(left, "left_id")
    similarity = F.arrow_udf(codes.pair_cosine, "double")("left_vector", "right_vector")
    exact = pairs.select("left_id", "right_id", similarity.alias("similarity"))
    if threshold is not None:
        exact = exact.where(F.col("similarity") >= threshold)
    best = _top(exact, k).withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS))
    return Found(best, asked.unionByName(more))


def search_pruned(
    left: DataFrame,
    index: Index,
    k: int,
    *,
    threshold: float | None = None,
    skip_self: bool = False,
    first: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> Found:
    """Exact top-k, with the rows of ``knn.knn_join_exact``, comparing vectors only in cells that may hold a neighbour.

    No vector of a cell is nearer to a query than the angle to the centroid less
    the cell's largest angle.  Where that cannot reach the query's k-th best of
    the first look, nor ``threshold``, the cell is not built for the query.
    """
    left = _queries(left, index.dim)
    # A query's vector goes to every bundle it looks into, so small cells share one; the kernel keeps to the cells asked for.
    base, pieces = _bundles(index.count, block_rows, together=True)
    placed = _placed(index, base, pieces).drop("angle", "code").join(index.vectors, "right_id").withColumn("scope", F.lit(0))
    fields, schema = _fields(left, index.rows, scope=True)
    kernel = cell_kernel(k, threshold, schema, skip_self)
    asked = _asked(index, left, base, pieces, first, None, None, "ann-asked")
    near = _written(_top(_met(asked, placed, kernel, fields, block_rows), k), "ann-near")
    farthest = index.farthest
    more = _asked(
        index, _with_tau(left, near, k), base, pieces, first, lambda s: codes.far_bound(s, farthest), threshold, "ann-more"
    )
    far = _met(more, placed, kernel, fields, block_rows)
    best = _top(near.drop("rank").unionByName(far), k).drop("scope").withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS))
    return Found(best, asked.unionByName(more))


def knn_join_indexed(left: DataFrame, right: DataFrame, k: int, *, dim: int, **how) -> DataFrame:
    """``search_index`` over a fresh index of ``right``."""
    return search_index(left, build(right, dim=dim), k, **how).rows


def knn_join_pruned(left: DataFrame, right: DataFrame, k: int, *, dim: int, **how) -> DataFrame:
    """``search_pruned`` over a fresh index of ``right``."""
    return search_pruned(left, build(right, dim=dim), k, **how).rows


def comparisons(left: DataFrame, index: Index, found: Found) -> DataFrame:
    """One row: looks at a row of a cell (by code or by vector) and all pairs."""
    # A query meets a cut cell once per piece, each holding a part of its rows.
    cells = [(int(c), int(n)) for c, n in enumerate(index.count) if n]
    size = F.broadcast(left.sparkSession.createDataFrame(cells, "cell int, n long"))
    looks = found.asked.select("left_id", F.explode("cells").alias("cell")).distinct().join(size, "cell")
    pairs = left.count() * int(index.count.sum())
    return looks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).withColumn("all_pairs", F.lit(pairs).cast("long"))
