"""Index joins against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from clausemill.operators import ann, codes, knn

DIM = 16


def clustered(n, clusters=12, spread=0.15, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, DIM))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    # The first cluster holds a third of all rows.
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, clusters, n))
    return centres[which] + spread * rng.standard_normal((n, DIM)) / np.sqrt(DIM) * 4


def frame(spark, vectors, name):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>").repartition(3)


def brute(vectors, k, threshold=None):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    out = set()
    for i, row in enumerate(sims):
        best = sorted(range(len(row)), key=lambda j: (-round(row[j], 12), j))[:k]
        out |= {(i, j) for j in best if row[j] > -2 and (threshold is None or row[j] >= threshold)}
    return out


@pytest.fixture(scope="module")
def sides(spark):
    vectors = clustered(600)
    vectors[50:60] = vectors[40:50]  # copies: ties go to the smaller id
    left, right = frame(spark, vectors, "left_id"), frame(spark, vectors, "right_id")
    return vectors, left, ann.build(right, dim=DIM)


@pytest.mark.parametrize(("threshold", "block_rows"), [(None, 8192), (0.8, 32)])
def test_the_pruned_join_is_exact_and_compares_less(sides, threshold, block_rows):
    vectors, left, index = sides
    found = ann.search_pruned(left, index, 5, threshold=threshold, skip_self=True, block_rows=block_rows)
    assert {(r.left_id, r.right_id) for r in found.rows.collect()} == brute(vectors, 5, threshold)
    row = ann.comparisons(left, index, found).first()
    assert row.all_pairs == 360_000 and 0 < row.compared < 0.6 * row.all_pairs


@pytest.mark.parametrize("block_rows", [8192, 32])
def test_the_index_finds_nine_in_ten_with_less_than_a_third_of_the_looks(sides, block_rows):
    vectors, left, index = sides
    found = ann.search_index(left, index, 5, skip_self=True, block_rows=block_rows)
    rows = found.rows.collect()
    want = brute(vectors, 5)
    assert len({(r.left_id, r.right_id) for r in rows} & want) >= 0.9 * len(want)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert all(abs(r.similarity - unit[r.left_id] @ unit[r.right_id]) < 1e-4 for r in rows)
    row = ann.comparisons(left, index, found).first()
    assert 0 < row.compared < 0.3 * row.all_pairs


def test_every_row_is_indexed_from_a_sample(spark, sides):
    vectors, _, _ = sides
    index = ann.build(frame(spark, vectors, "right_id"), dim=DIM, cells=7, sample_rows=100)
    assert len(index.centroids) == 7 and index.count.sum() == 600
    assert sorted(r.right_id for r in index.rows.select("right_id").collect()) == list(range(600))


def test_rows_without_direction_take_no_part(spark):
    rows = [[1.0, 0.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [1.0, 1.0, 1.0], [1.0, 0.1]]
    left, right = frame(spark, rows, "left_id"), frame(spark, rows, "right_id")
    for join in (ann.knn_join_pruned, ann.knn_join_indexed):
        got = {(r.left_id, r.right_id) for r in join(left, right, 2, dim=2).collect()}
        assert got == {(0, 0), (0, 6), (6, 0), (6, 6)}
        assert join(left, right.limit(0), 2, dim=2).collect() == []
        assert join(left.limit(0), right, 2, dim=2).collect() == []


def test_bundles_hold_bounded_rows():
    base, pieces = ann._bundles(np.array([3, 0, 25, 4, 5, 2]), 10, together=True)
    assert pieces.tolist() == [1, 0, 3, 1, 1, 1]
    assert base.tolist() == [0, 0, 1, 4, 4, 5]
    base, _ = ann._bundles(np.array([3, 0, 25, 4]), 10, together=False)
    assert base.tolist() == [0, 0, 1, 4]


def test_no_member_exceeds_the_bound():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((400, DIM))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centre, members, asked = rows[0], rows[1:200], rows[200:]
    bound = codes.far_bound((asked @ centre)[:, None], np.arccos(members @ centre).max()[None])
    assert ((asked @ members.T).max(axis=1) <= bound[:, 0]).all()


def test_the_hashed_join_stays(sides, spark):
    vectors, left, _ = sides
    got = knn.knn_join_approx(left, frame(spark, vectors, "right_id"), 5, dim=DIM, skip_self=True)
    assert got.count() > 0


def test_a_query_that_looks_everywhere_is_written_once_per_bundle_in_bounded_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centroids = rng.standard_normal((300, DIM))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    base, pieces = ann._bundles(np.full(300, 4), 8, together=True)
    asked = rng.standard_normal((700, DIM))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(700)), pa.array(asked.tolist()), pa.array([None] * 700, pa.float64())], names=["left_id", "left_vector", "tau"]
    )
    kernel = codes.probes(centroids, base, pieces, 1, lambda near: np.full(near.shape, np.inf), None)
    out = list(kernel(iter([batch])))
    assert max(b.num_rows for b in out) <= codes.MAX_OUT_ROWS and sum(b.num_rows for b in out) <= 700 * 150
    got = pa.Table.from_batches(out)
    assert {(r["left_id"], r["bundle"]) for r in got.select(["left_id", "bundle"]).to_pylist()} >= {(i, b) for i in (0, 699) for b in range(150)}
    assert sum(len(c) for c in got["cells"].to_pylist()) == 700 * 299


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_cells_that_share_a_bundle_are_met_once(sides, block_rows):
    vectors, left, index = sides
    found = ann.search_pruned(left, index, 5, skip_self=True, block_rows=block_rows)
    bundles = {r.bundle for r in found.asked.select("bundle").distinct().collect()}
    assert len(bundles) <= max(1, 2 * 600 // block_rows + 1)
    pairs = [(r.left_id, r.right_id) for r in found.rows.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(vectors, 5)
