"""What one task of a nearest-neighbour join computes on its Arrow batches.

The module is pickled by value, so workers need nothing but numpy and pyarrow.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

QUERY_TILE = 256
#: So many right rows meet a tile at a time.
RIGHT_TILE = 4096
#: Candidates whose similarity is computed at a time.
PAIR_TILE = 65_536
#: Similarities are shown with so many digits, and ranked by the raw value but for its last rounding noise.
SIMILARITY_DIGITS = 4
RANK_DIGITS = 12


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension in an Arrow list column as unit rows; all-zero vectors become nan."""
    merged = column.combine_chunks()
    if isinstance(merged, pa.ChunkedArray):
        merged = pa.concat_arrays(merged.chunks)
    flat = merged.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(merged), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def tile_topk(sims, scopes, bounds, ids, k, threshold):
    """(row, column) of the best k per row and scope by the unrounded value; ties go to the smaller id.

    ``scopes`` is sorted and ``bounds`` delimits its runs.  Long runs are first
    cut to the values reaching their k-th best, ties included.
    """
    rounded = np.round(sims, RANK_DIGITS)
    keep = ~np.isnan(sims)
    if threshold is not None:
        keep &= sims >= threshold
    ranked = np.where(keep, rounded, -np.inf)
    for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
        if stop - start > 4 * k:
            part = ranked[:, start:stop]
            kth = np.partition(part, stop - start - k, axis=1)[:, stop - start - k]
            keep[:, start:stop] &= part >= kth[:, None]
    rows, cols = np.nonzero(keep)
    order = np.lexsort((ids[cols], -rounded[rows, cols], scopes[cols], rows))
    rows, cols = rows[order], cols[order]
    if len(rows) == 0:
        return rows, cols
    fresh = np.r_[True, (rows[1:] != rows[:-1]) | (scopes[cols[1:]] != scopes[cols[:-1]])]
    start_at = np.flatnonzero(fresh)
    position = np.arange(len(rows)) - np.repeat(start_at, np.diff(np.r_[start_at, len(rows)]))
    chosen = position < k
    return rows[chosen], cols[chosen]


def wanted_cells(lists: pa.ChunkedArray, met: np.ndarray) -> np.ndarray:
    """bool (rows, met): which of the cells ``met`` each row's list names."""
    lists = lists.combine_chunks()
    wanted, named = np.zeros((len(lists), len(met)), bool), lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place = np.searchsorted(met, named)
    # A cell cut into bundles may have no row in this one.
    there = (place < len(met)) & (met[np.minimum(place, len(met) - 1)] == named)
    wanted[owner[there], place[there]] = True
    return wanted


def cell_kernel(k: int, threshold: float | None, schema: pa.Schema, skip_self: bool):
    """Top-k of a cell's left rows and scopes; where left rows name ``cells``, of right rows in those only."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        _, scope_codes = np.unique(right["scope"].to_numpy(), return_inverse=True)
        by_scope = np.argsort(scope_codes, kind="stable")
        scope_codes = scope_codes[by_scope]
        bounds = np.r_[0, np.flatnonzero(np.diff(scope_codes)) + 1, len(scope_codes)]
        right_ids = right["right_id"].to_numpy()[by_scope]
        right_scope = right["scope"].to_numpy()[by_scope]
        right_rows = unit_rows(right["right_vector"])[by_scope]
        left_ids = left["left_id"].to_numpy()
        left_rows = unit_rows(left["left_vector"])
        _, id_rank = np.unique(right_ids, return_inverse=True)
        wanted = None
        if "cells" in left.column_names:
            met, cell = np.unique(right["cell"].to_numpy()[by_scope], return_inverse=True)
            wanted = wanted_cells(left["cells"], met)
        out_left, out_right, out_scope, out_sim = [], [], [], []
        for at in range(0, len(left_rows), QUERY_TILE):
            tile = left_rows[at : at + QUERY_TILE]
            sims = tile @ right_rows.T
            if skip_self:
                sims[left_ids[at : at + QUERY_TILE, None] == right_ids[None, :]] = np.nan
            if wanted is not None and not wanted[at : at + QUERY_TILE].all():
                sims[~wanted[at : at + QUERY_TILE][:, cell]] = np.nan
            rows, cols = tile_topk(sims, scope_codes, bounds, id_rank, k, threshold)
            out_left.append(left_ids[at + rows])
            out_right.append(right_ids[cols])
            out_scope.append(right_scope[cols])
            out_sim.append(sims[rows, cols])
        columns = (out_left, out_scope, out_right, out_sim)
        return pa.table(
            [pa.array(np.concatenate(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    return run


class _Best:
    """The best ``k`` so far of a block's left rows, among the right rows of one scope.

    Products are made in single precision and drop what cannot be among the
    best by more than their largest possible error; what remains is computed in
    double precision, pair by pair, so that equal vectors have equal values.
    """

    def __init__(self, left_ids: np.ndarray, left_rows: np.ndarray, k: int, threshold: float | None, skip_self: bool):
        self.ids, self.rows, self.single = left_ids, left_rows, left_rows.astype(np.float32)
        self.k, self.floor, self.skip_self = k, threshold, skip_self
        self.error = np.float32((left_rows.shape[1] + 8) * 2.0**-23)
        self.clear()

    def clear(self) -> None:
        shape = (len(self.ids), self.k)
        self.rounded, self.raw = np.full(shape, -np.inf), np.full(shape, -np.inf)
        self.right, self.filled = None, np.zeros(len(self.ids), np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        whole = ~np.isnan(rows).any(axis=1)
        ids, rows = ids[whole], rows[whole]
        if self.right is None:
            self.right = np.empty(self.rounded.shape, ids.dtype)
        for at in range(0, len(ids), RIGHT_TILE):
            self._meet(ids[at : at + RIGHT_TILE], rows[at : at + RIGHT_TILE])

    def _meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        single = np.ascontiguousarray(rows.astype(np.float32).T)
        by_id = np.argsort(ids, kind="stable") if self.skip_self else None
        for at in range(0, len(self.ids), QUERY_TILE):
            tile = slice(at, at + QUERY_TILE)
            sims = self.single[tile] @ single
            if by_id is not None:
                begin, end = (np.searchsorted(ids, self.ids[tile], side, sorter=by_id) for side in ("left", "right"))
                for i in np.flatnonzero(end > begin):
                    sims[i, by_id[begin[i] : end[i]]] = -np.inf
            least = np.where(self.filled[tile] == self.k, self.rounded[tile, -1], -np.inf)
            if self.floor is not None:
                least = np.maximum(least, self.floor)
            least = np.maximum(least - self.error, -2).astype(np.float32)  # no similarity is below -1
            near = sims >= least[:, None]
            if len(ids) > self.k and np.count_nonzero(near) > 4 * self.k * len(sims):
                near &= sims >= np.partition(sims, -self.k, axis=1)[:, [-self.k]] - 2 * self.error
            found = np.flatnonzero(near)
            if len(found):
                self._merge(at, *np.divmod(found, len(ids)), ids, rows)

    def _merge(self, at: int, r: np.ndarray, c: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        exact = np.empty(len(r))
        for p in range(0, len(r), PAIR_TILE):
            pairs = slice(p, p + PAIR_TILE)
            exact[pairs] = np.einsum("ij,ij->i", self.rows[at + r[pairs]], rows[c[pairs]])
        if self.floor is not None:
            reached = exact >= self.floor
            r, c, exact = r[reached], c[reached], exact[reached]
        rounded = np.round(exact, RANK_DIGITS)
        held = np.flatnonzero(np.bincount(r, minlength=1))
        old_r, old_c = np.nonzero(np.arange(self.k) < self.filled[at + held, None])
        old_r = held[old_r]
        row = np.r_[r, old_r]
        if not len(row):
            return
        right = np.concatenate([ids[c], self.right[at + old_r, old_c]])
        value, raw = np.r_[rounded, self.rounded[at + old_r, old_c]], np.r_[exact, self.raw[at + old_r, old_c]]
        _, id_rank = np.unique(right, return_inverse=True)
        order = np.lexsort((id_rank, -value, row))
        row = row[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        counts = np.diff(np.r_[starts, len(row)])
        place = np.arange(len(row)) - np.repeat(starts, counts)
        best = place < self.k
        row, place, order = at + row[best], place[best], order[best]
        self.rounded[row, place], self.raw[row, place], self.right[row, place] = value[order], raw[order], right[order]
        self.filled[at + held] = np.minimum(counts, self.k)

    def rows_of(self, scope: pa.Scalar, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        r, c = np.nonzero(np.arange(self.k) < self.filled[:, None])
        for at in range(0, len(r), PAIR_TILE):
            i, j = r[at : at + PAIR_TILE], c[at : at + PAIR_TILE]
            columns = [self.ids[i], [scope.as_py()] * len(i), self.right[i, j], self.raw[i, j]]
            yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)
        self.clear()


def stream_kernel(k: int, threshold: float | None, schema: pa.Schema, skip_self: bool):
    """Top-k of every block's left rows and scopes, from rows in the order of block, side (left first) and scope.

    A block's left rows are held, its right rows pass by and are forgotten, so
    that each left row and scope of a block gives at most ``k`` rows however
    many right rows there are.
    """

    def segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        block, side = batch["block"].to_numpy(), batch["side"].to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1
        for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(block)], strict=True):
            yield int(block[begin]), int(side[begin]), batch.slice(begin, end - begin)

    def values(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False)

    def vectors(column: pa.Array) -> np.ndarray:
        return unit_rows(pa.chunked_array([column]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, best, scope = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for block, side, part in segments(batch):
                if block != current:
                    if best is not None and scope is not None:
                        yield from best.rows_of(scope, schema)
                    current, held, best, scope = block, [], None, None
                if side == 0:
                    held.append((values(part["left_id"]), vectors(part["left_vector"])))
                    continue
                if not held:
                    continue
                if best is None:
                    best = _Best(*(np.concatenate(x) for x in zip(*held, strict=True)), k, threshold, skip_self)
                    held = [None]  # its rows are in best
                ids, rows = values(part["right_id"]), vectors(part["right_vector"])
                runs = pc.run_end_encode(part["scope"])
                begin = 0
                for end, value in zip(runs.run_ends.to_pylist(), runs.values, strict=True):
                    if scope is not None and not value.equals(scope):
                        yield from best.rows_of(scope, schema)
                    scope = value
                    best.add(ids[begin:end], rows[begin:end])
                    begin = end
        if best is not None and scope is not None:
            yield from best.rows_of(scope, schema)

    return run


def sign_kernel(dim: int, tables: int, bits: int, seed: int, probes: int = 0):
    """Per vector and table, the sides of ``bits`` random planes as one number, and the same with the nearest sides changed.

    The ``probes`` further numbers change the set of sides whose planes are, by
    the sum of squared distances, nearest to the vector.
    """

    def run(vectors: pa.Array) -> pa.Array:
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
        away = (rows @ planes).reshape(len(rows), tables, bits)
        weights = 1 << np.arange(bits)
        codes = ((away >= 0) * weights).sum(axis=2)
        found = [codes[:, :, None]]
        if probes:
            masks = np.arange(1, 1 << bits)
            member = (masks[:, None] >> np.arange(bits) & 1).astype(np.float64)
            cost = (away * away) @ member.T
            nearest = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
            found.append(codes[:, :, None] ^ masks[nearest])
        entries = np.concatenate(found, axis=2).reshape(len(rows), -1).astype(np.int32)
        offsets = np.arange(0, entries.size + 1, max(1, entries.shape[1]), dtype=np.int32)[: len(rows) + 1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(entries.reshape(-1)))

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
