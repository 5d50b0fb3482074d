"""What one task does with cells and product codes of unit vectors, on Arrow batches.

Like ``cells``, the module is pickled by value, so workers need nothing but
numpy and pyarrow.  All arrays that functions carry have a size fixed by
parameters (cells, parts, codes, dimension), never by the table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from clausemill.operators.cells import QUERY_TILE, tile_topk, unit_rows, wanted_cells

SLACK = 1e-9  # bounds give way to rounding
ROW_TILE = 512  # so many rows meet all centroids at once
MAX_OUT_ROWS = 16_384  # looks in a batch; a query has one for each bundle it looks into


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(rows) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return unit_rows(pa.chunked_array([batch.column(name)]))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row and its cosine, a tile of rows at a time."""
    cell, cosine = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for at in range(0, len(rows), ROW_TILE):
        near = rows[at : at + ROW_TILE] @ centroids.T
        cell[at : at + ROW_TILE], cosine[at : at + ROW_TILE] = np.argmax(near, axis=1), near.max(axis=1)
    return cell, cosine


def _split(rows: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width): the dimensions dealt out in order, zeros behind the last."""
    width = -(-rows.shape[1] // parts)
    return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(len(rows), parts, width)


def encode(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    """uint8 (rows, parts): per part the nearest entry of its code book."""
    pieces = _split(residual, len(books))
    half = (books * books).sum(axis=2) / 2
    return np.stack([np.argmax(pieces[:, p] @ books[p].T - half[p], axis=1) for p in range(len(books))], axis=1).astype(np.uint8)


def _sums(places: np.ndarray, rows: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    order = np.argsort(places, kind="stable")
    met, first = np.unique(places[order], return_index=True)
    total[met] += np.add.reduceat(rows[order], first, axis=0)
    count += np.bincount(places, minlength=len(count))


def _summed(total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    met = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), _lists(total[met])], names=["place", "n", "total"])


def cell_sums(centroids: np.ndarray):
    """Per partition and cell: how many vectors are nearest to its centroid, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _column(batch, "vector")
                _sums(nearest(rows, centroids)[0], rows, total, count)
        yield _summed(total, count)

    return run


def code_sums(centroids: np.ndarray, books: np.ndarray):
    """The same for the entries of all code books, over what a vector's centroid leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, codes, width = books.shape
        total, count = np.zeros((parts * codes, width)), np.zeros(parts * codes, np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _column(batch, "vector")
                left = rows - centroids[nearest(rows, centroids)[0]]
                places = encode(left, books).astype(np.int64) + np.arange(parts) * codes
                _sums(places.reshape(-1), _split(left, parts).reshape(-1, width), total, count)
        yield _summed(total, count)

    return run


def add_sums(table: pa.Table) -> pa.Table:
    """The sums of all partitions, a row per place."""
    totals = table["total"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    met, at = np.unique(table["place"].to_numpy(), return_inverse=True)
    total, n = np.zeros((len(met), totals.shape[1])), np.zeros(len(met), np.int64)
    np.add.at(total, at, totals)
    np.add.at(n, at, table["n"].to_numpy())
    return pa.table({"place": pa.array(met), "n": pa.array(n), "total": _lists(total)})


def indexed(centroids: np.ndarray, books: np.ndarray):
    """Rows with their cell, the angle to its centroid, and the code of what it leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _column(batch, "right_vector")
            cell, near = nearest(rows, centroids)
            angle = np.arccos(np.clip(near, -1, 1))
            code = encode(rows - centroids[cell], books)
            raw = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("right_id"), pa.array(cell.astype(np.int32)), pa.array(angle), raw],
                names=["right_id", "cell", "angle", "code"],
            )

    return run


def _first(near: np.ndarray, filled: np.ndarray, first: int) -> np.ndarray:
    """bool (rows, cells): the ``first`` nearest cells that hold anything."""
    chosen = np.zeros(near.shape, bool)
    nearest = np.argsort(np.where(filled, -near, np.inf), axis=1, kind="stable")[:, : min(first, int(filled.sum()))]
    np.put_along_axis(chosen, nearest, True, axis=1)
    return chosen


def far_bound(near: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """What no vector of a cell can exceed: by the triangle inequality on angles, from the cell's farthest member."""
    return np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - farthest, 0)) + SLACK


def usual_bound(near: np.ndarray, mean: np.ndarray, reach: float, dim: int) -> np.ndarray:
    """What vectors of a cell hardly exceed: its usual member, turned ``reach`` usual shares of the rest towards the query."""
    across = np.sqrt(np.clip(1 - near * near, 0, 1))
    return np.cos(mean) * near + reach * np.sin(mean) * across / np.sqrt(dim)


def probes(centroids: np.ndarray, base: np.ndarray, pieces: np.ndarray, first: int, bound, floor: float | None):
    """A row per query and bundle to look into, with the cells wanted there.

    ``base`` and ``pieces`` give a cell's first bundle and how many it is cut
    into (0: the cell is empty).  Without ``bound`` a query looks into its
    ``first`` nearest cells, with it into all others whose bound reaches the
    query's ``tau`` (its k-th best so far) and ``floor``.
    """

    def looks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        near = _column(batch, "left_vector") @ centroids.T
        wanted = _first(near, pieces > 0, first)
        if bound is not None:
            tau = batch.column("tau").to_numpy(zero_copy_only=False).astype(float)
            tau = np.where(np.isnan(tau), -np.inf, tau)
            tau = tau if floor is None else np.maximum(tau, floor)
            wanted = ~wanted & (pieces > 0) & (bound(near) >= tau[:, None])
        row, cell = np.nonzero(wanted)
        again = pieces[cell]
        at = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
        row, cell = np.repeat(row, again), np.repeat(cell, again)
        bundle = base[cell] + at
        order = np.lexsort((cell, bundle, row))
        row, cell, bundle = row[order], cell[order], bundle[order]
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])]) if len(row) else np.zeros(0, int)
        ends = np.r_[start[1:], len(row)]
        for lo in range(0, len(start), MAX_OUT_ROWS):
            some, until = start[lo : lo + MAX_OUT_ROWS], ends[lo : lo + MAX_OUT_ROWS]
            taken = pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("left_id").take(taken),
                    batch.column("left_vector").take(taken),
                    pa.array(bundle[some].astype(np.int32)),
                    _ragged(cell[some[0] : until[-1]], until - some),
                ],
                names=["left_id", "left_vector", "bundle", "cells"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_TILE):
                yield from looks(batch.slice(at, ROW_TILE))

    return run


def code_kernel(centroids: np.ndarray, books: np.ndarray, k: int, schema: pa.Schema, skip_self: bool):
    """Per query the ``k`` best of a bundle by distance tables: one table look-up and addition per part and pair."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        cell = right["cell"].to_numpy()
        by_cell = np.argsort(cell, kind="stable")
        met, first = np.unique(cell[by_cell], return_index=True)
        ends = np.r_[first[1:], len(cell)]
        ids = right["right_id"].to_numpy()[by_cell]
        _, id_rank = np.unique(ids, return_inverse=True)
        code = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(cell), -1)[by_cell]
        left_ids, left_rows = left["left_id"].to_numpy(), unit_rows(left["left_vector"])
        wanted = wanted_cells(left["cells"], met)
        one = np.zeros(len(ids), np.int64)
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(left_rows), QUERY_TILE):
            tile = left_rows[at : at + QUERY_TILE]
            tables = np.einsum("bpw,pcw->pcb", _split(tile, len(books)), books, optimize=True).astype(np.float32)
            near = (centroids[met] @ tile.T).astype(np.float32)
            scores = np.full((len(tile), len(ids)), np.nan, np.float32)
            for c, (lo, hi) in enumerate(zip(first, ends, strict=True)):
                asking = np.flatnonzero(wanted[at : at + QUERY_TILE, c])
                if len(asking) == 0:
                    continue
                few = tables if len(asking) == len(tile) else np.ascontiguousarray(tables[:, :, asking])
                found = np.repeat(near[c, asking][None], hi - lo, axis=0)
                for p in range(len(books)):
                    found += few[p][code[lo:hi, p]]
                scores[asking, lo:hi] = found.T
            if skip_self:
                scores[left_ids[at : at + QUERY_TILE, None] == ids[None, :]] = np.nan
            rows, cols = tile_topk(scores, one, [0, len(ids)], id_rank, k, None)
            out[0].append(left_ids[at + rows])
            out[1].append(ids[cols])
            out[2].append(scores[rows, cols].astype(np.float64))
        return pa.table([pa.array(np.concatenate(c), type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def pair_cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """The similarity of each row's two vectors, with the arithmetic of the cells."""
    if len(left) == 0:
        return pa.array([], pa.float64())
    return pa.array(np.einsum("ij,ij->i", unit_rows(pa.chunked_array([left])), unit_rows(pa.chunked_array([right]))))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
