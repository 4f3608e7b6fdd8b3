"""Exact nearest neighbours by a block matrix join over int8 tiles with error bounds.

Vectors are dealt into candidate groups, query rows into query groups; a task
multiplies one query block with one candidate group. The product is first taken
on int8 codes. With x = s q + e, the inner product of two vectors differs from
s_x s_y <q_x, q_y> by at most |e_x||y| + |x||e_y| + |e_x||e_y|, norms that are
known for each vector, so a pair whose upper bound lies below the lower bounds
of k others is out. What survives is computed again in double precision and
kept in a heap of k for each query; heaps of all groups are merged at the end.
Nothing is approximate in the result: recall is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, unpack

HEAP = "query_id long, ids binary"
FOUND = "query_id long, rank int, vec_id long, score double"


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and vector of every usable embedding: not null, no null or non-finite part, not all zero."""
    ends, values = column.offsets.to_numpy(), column.values
    data = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(usable):
        v = data[ends[row] : ends[row + 1]]
        if len(v) and np.isfinite(v).all() and v.any():
            yield int(row), v


def _blocks(groups: int, query_groups: int, every: int, rows: int = 4096):
    """Vectors packed by (dimension, query group, candidate group); queries go to all candidate groups of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            made: dict[tuple[int, int], tuple[list, list]] = {}
            for row, v in _vectors(batch.column(1)):
                for key in [(0, int(batch.column(2)[row].as_py()) % groups)] + (
                    [(1, int(batch.column(2)[row].as_py()) // groups % query_groups)] if ids[row] % every == 0 else []
                ):
                    made.setdefault((len(v), *key), ([], []))
                    held = made[len(v), *key]
                    held[0].append(ids[row])
                    held[1].append(v)
            out = []
            for (dim, side, group), (i, v) in made.items():
                for at in range(0, len(i), rows):
                    cell = pack(np.array(i[at : at + rows], np.int64), np.concatenate(v[at : at + rows]))
                    for other in range(query_groups if side == 0 else groups):
                        g, q = (group, other) if side == 0 else (other, group)
                        out.append((dim, q, g, side, cell))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["dim", "q", "g", "side", "cell"]
                )

    return run


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the vectors and norms of the errors."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    norms, errors = np.linalg.norm(x, axis=1), np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, norms, errors


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_of_tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, tile: int = 2048,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best of the vectors, as (ids, scores), best first, ties to the smaller id."""
    qc, qs, qn, qe = quantise(queries)
    vc, vs, vn, ve = quantise(vectors)
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)
    left = qc.astype(np.float32)
    for lo in range(0, len(ids), tile):
        part = slice(lo, lo + tile)
        # int8 products summed in float32 are exact up to 2^24; longer vectors go in pieces
        dims = range(0, left.shape[1], 1024)
        dots = sum((left[:, d : d + 1024] @ vc[part, d : d + 1024].T.astype(np.float32)).astype(np.float64) for d in dims)
        near = dots * qs[:, None] * vs[part][None, :]
        slack = qe[:, None] * vn[part][None, :] + qn[:, None] * ve[part][None, :] + qe[:, None] * ve[part][None, :]
        rounding = max(1e-12, 4 * np.finfo(float).eps * queries.shape[1])
        slack = slack * (1 + 1e-9) + rounding * (qn[:, None] * vn[part][None, :])
        near[query_ids[:, None] == ids[part][None, :]] = -np.inf
        width = near.shape[1]
        if width > k:
            lower = near - slack
            sure = np.partition(lower, width - k, axis=1)[:, width - k]
            floor = np.maximum(floor, sure)
        alive = (near + slack >= floor[:, None]) & np.isfinite(near)
        for i in np.flatnonzero(alive.any(1)):
            rows = np.flatnonzero(alive[i]) + lo
            scores = np.cumsum(vectors[rows] * queries[i], axis=1)[:, -1]  # in order of the components, whatever the engine
            best[i] = _merge(np.r_[best[i][0], ids[rows]], np.r_[best[i][1], scores], k)
            if len(best[i][0]) == k:
                floor[i] = max(floor[i], best[i][1][-1])
    return best


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        sides = table.column("side").to_pylist()
        cells = [unpack(c) for c in table.column("cell").to_pylist()]
        out = []

        def gathered(side: int) -> tuple[np.ndarray, np.ndarray]:
            own = [c for c, s in zip(cells, sides, strict=True) if s == side]
            if not own:
                return np.zeros(0, np.int64), np.zeros((0, dim))
            return np.concatenate([c[0] for c in own]), np.concatenate([c[1] for c in own]).reshape(-1, dim)

        ids, vectors = gathered(0)
        query_ids, queries = gathered(1)
        order = np.lexsort((*queries.T[::-1], query_ids))
        query_ids, queries = query_ids[order], queries[order]
        query_ids, first = np.unique(query_ids, return_index=True)
        queries = queries[first]
        for at in range(0, len(query_ids) if len(ids) else 0, 512):
            some = slice(at, at + 512)
            found = top_of_tile(query_ids[some], queries[some], ids, vectors, k)
            out += [(q, pack(*f)) for q, f in zip(query_ids[some].tolist(), found, strict=True) if len(f[0])]
        q, cell = zip(*out, strict=True) if out else ((), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "ids": pa.array(cell, pa.binary())})

    return run


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        cells = [unpack(c) for c in table.column("ids").to_pylist()]
        ids, scores = np.concatenate([c[0] for c in cells]), np.concatenate([c[1] for c in cells])
        ids, scores = _merge(ids, scores, k)
        n = len(ids)
        return pa.table({
            "query_id": pa.array([table.column("query_id")[0].as_py()] * n, pa.int64()),
            "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64()),
        })

    return run


def block_neighbours(
    embeddings: DataFrame, *, k: int = 20, every: int = 20, group_rows: int = 8192, query_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, in double precision.

    ``embeddings`` has vec_id and embedding. Queries are the rows whose vec_id
    is divisible by ``every``; candidates all rows but the query's own, of the
    query's dimension. Best first, ties to the smaller vec_id. Null, empty and
    zero vectors, vectors with null or non-finite parts and rows without
    vec_id take no part. Rows that repeat a vec_id are candidates each; as
    queries they give one list, for the vector that is smallest component by
    component. Other columns are ignored. An empty table gives an empty result.

    Group counts follow the row count, so a task always holds about
    ``group_rows`` candidates and ``query_rows`` queries; a query's heaps are
    one row for each candidate group.
    """
    rows = embeddings.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("deal"),
    )
    count = rows.count()
    groups = max(1, -(-count // group_rows))
    query_groups = max(1, -(-count // (every * query_rows)))
    blocks = rows.mapInArrow(_blocks(groups, query_groups, every), "dim long, q long, g long, side long, cell binary")
    heaps = blocks.groupBy("dim", "q", "g").applyInArrow(_search(k), HEAP)
    return heaps.groupBy("query_id").applyInArrow(_merged(k), FOUND)
