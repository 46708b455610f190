"""Exact top-k by inner product with a pivot table.

Vectors become integers. One more coordinate, sqrt(M - |x|^2) with M the largest squared norm (and 0
for queries), turns the largest inner product into the least Euclidean distance. Distances from every
vector to a few pivots are computed once; for a query the largest difference of pivot distances is a
lower bound of its distance to a candidate. Candidates are evaluated in the order of their bounds until
the next bound exceeds the k-th distance found, so the result is exact.

The table of candidates with their pivot distances is written once and read where it lies: nothing of it
is shuffled. Queries are the small side. They are broadcast in lots of a bounded size, with the k-th best
score that a sample of the candidates gives each, and a task carries its own k-th best from block to block.
A lot is one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a candidate block, pivots, and the sample that they are picked from.
BLOCK, PIVOTS, PIVOT_SAMPLE = 4096, 48, 1024
#: Queries that are broadcast at once: with 64 components and 48 pivots about 1 KB each.
QUERY_LOT = 16_384
#: Candidates that are evaluated before the bounds are looked at again; twice as many each time.
STEP = 128


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v: floor(256 * x) of each component. Rows that are null or hold null, NaN or an infinity are left out."""
    x = F.col("embedding").cast("array<double>")
    whole = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return whole.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256.0)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots far from one another: each next one is farthest from those picked."""
    if not len(sample):
        return sample
    picked, far = [0], np.full(len(sample), np.inf)
    while len(picked) < min(most, len(sample)):
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        picked.append(int(far.argmax()))
    return sample[picked]


class Pivots:
    """The pivots, the width of vectors and the largest squared norm."""

    def __init__(self, points: np.ndarray, width: int, norm: int):
        self.points, self.width, self.norm = points, width, norm

    def lifted(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the extra coordinate."""
        own = (v.astype(np.float64) ** 2).sum(axis=1)
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.norm - own))
        return np.column_stack((v, extra))

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None] - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(0.0, square))


def pick_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> tuple[Pivots, np.ndarray, np.ndarray]:
    """Pivots from a sample of at most ``sample`` rows (the least hashes of vec_id), far apart from each other; the sample's ids and vectors."""
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    width, norm = vectors.agg(F.max(F.size("v")), F.max(square)).first()
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").collect()
    points = np.zeros((len(rows), (width or 0)), np.int64)
    for i, r in enumerate(rows):
        points[i, : len(r["v"])] = r["v"]
    out = Pivots(np.empty((0, 0)), width or 0, norm or 0)
    out.points = _spread(out.lifted(points, query=False), pivots)
    return out, np.array([r["vec_id"] for r in rows], np.int64), points


def pivot_table(vectors: DataFrame, pivots: Pivots, scratch: Scratch) -> DataFrame:
    """vec_id, v and d, the distances to all pivots, written."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # a fixed number of points

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            far = p.distances(p.lifted(_matrix(b.column(1), p.width), query=False))
            ends = pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=["vec_id", "v", "d"])

    return scratch.save(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, d array<double>"))


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows @ query).astype(np.int64)


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, q_dist: np.ndarray, block: np.ndarray, block_ids: np.ndarray, b_dist: np.ndarray, norm: float, k: int, least: np.ndarray | None = None
) -> tuple[list[int], list[int], list[int], list[bool], int]:
    """Query number, vec_id, score, own of the k best of a block for each query, and how many candidates were evaluated.

    ``least`` holds for each query a score that its k-th best reaches anyway; candidates below it may be left out.
    ``own`` marks candidates that have the query's id and components.
    """
    out_q, out_v, out_s, out_own, tried = [], [], [], [], 0
    exact = np.abs(block).max(initial=0) * np.abs(queries).max(initial=0) * max(1, block.shape[1]) < 2**52
    fast, fast_q = (block.astype(np.float64), queries.astype(np.float64)) if exact else (block, queries)
    near, near_q = b_dist.astype(np.float32), q_dist.astype(np.float32)
    slack = 1e-6 + 1e-6 * (float(near.max(initial=0)) + float(near_q.max(initial=0)))  # rounding of the bounds
    same = np.isin(query_ids, block_ids)
    for i, own in enumerate(query_ids):
        bound = np.abs(near - near_q[i]).max(axis=1, initial=0.0)
        square = float((fast_q[i] ** 2).sum()) + norm

        def reach(score: float) -> float:  # equal distances are still looked at, for ties
            return np.sqrt(max(0.0, square - 2.0 * score)) * (1 + 1e-9) + slack  # noqa: B023

        there = np.arange(len(bound)) if least is None or least[i] == -np.inf else np.flatnonzero(bound <= reach(float(least[i])))
        order = there[np.argsort(bound[there], kind="stable")]
        scores, ids, rows = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, STEP
        while at < len(order):
            if len(scores) == k and bound[order[at]] > reach(float(scores[-1])):
                break
            some = order[at : at + step]
            at, step = at + step, 2 * step
            tried += len(some)
            scores = np.concatenate((scores, _products(fast[some], fast_q[i])))
            ids, rows = np.concatenate((ids, block_ids[some])), np.concatenate((rows, some))
            keep = np.lexsort((ids, -scores))[:k]
            scores, ids, rows = scores[keep], ids[keep], rows[keep]
        if least is not None:
            fine = scores >= least[i]
            scores, ids, rows = scores[fine], ids[fine], rows[fine]
        out_q += [i] * len(ids)
        out_v += ids.tolist()
        out_s += scores.tolist()
        out_own += ((ids == own) & (block[rows] == queries[i]).all(axis=1)).tolist() if same[i] else [False] * len(ids)
    return out_q, out_v, out_s, out_own, tried


class Lot:
    """Queries that are broadcast together, and the scores that their k-th best reach in the sample."""

    def __init__(self, rows: pa.Table, pivots: Pivots, sample_ids: np.ndarray, sample: np.ndarray, k: int):
        rows = rows.combine_chunks()
        self.rows, self.ids = (rows.column(c).to_numpy() for c in ("row", "vec_id"))
        v = rows.column("v")
        self.v = _matrix(v.chunk(0) if v.num_chunks else pa.array([], v.type), pivots.width)
        self.far, self.norm = pivots.distances(pivots.lifted(self.v, query=True)), float(pivots.norm)
        self.least = np.full(len(self.ids), -np.inf)
        for i, (own, q) in enumerate(zip(self.ids, self.v, strict=True)):
            scores = _products(sample[sample_ids != own], q)
            if len(scores) >= k:
                self.least[i] = np.partition(scores, -k)[-k]


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            held.append(part)
            n += part.num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _found(table: DataFrame, lot: Lot, width: int, k: int, block: int) -> DataFrame:
    """row (the query's), query_id, vec_id, score, own: of each task the k + 1 best candidates of each query, own ones too."""
    shared = table.sparkSession.sparkContext.broadcast(lot)  # QUERY_LOT queries

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        n, kinds = len(queries.ids), (np.int64, np.int64, np.int64, bool)
        least, best = queries.least.copy(), [np.empty(0, x) for x in kinds]
        for t in _blocks(batches, block):
            ids, v, d = (t.column(c).chunk(0) for c in ("vec_id", "v", "d"))
            far = d.flatten().to_numpy().reshape(len(ids), -1)
            got = best_of_block(queries.v, queries.ids, queries.far, _matrix(v, width), ids.to_numpy(), far, queries.norm, k + 1, least)
            best = [np.concatenate((x, np.array(y, kind))) for x, y, kind in zip(best, got[:4], kinds, strict=True)]
            order = np.lexsort((best[1], -best[2], best[0]))
            best = [x[order] for x in best]
            place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [x[place <= k] for x in best]
            count = np.bincount(best[0], minlength=n)
            full = np.flatnonzero(count > k)
            # One of the k + 1 may be the query's own row, so the last one is what k others reach.
            least[full] = np.maximum(least[full], best[2][np.cumsum(count)[full] - 1])
        at = best[0]
        arrays = [pa.array(queries.rows[at], pa.int64()), pa.array(queries.ids[at], pa.int64()), *[pa.array(x) for x in best[1:]]]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "query_id", "vec_id", "score", "own"])

    return table.mapInArrow(run, "row long, query_id long, vec_id long, score long, own boolean")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, lot: int = QUERY_LOT) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``vectors`` with the largest inner product.

    Both have vec_id and v (see ``quantised``). A query's own row (one with its id and components) is no
    candidate; ties go to the smaller vec_id; with fewer than k candidates all are returned. Rows that
    repeat a vec_id are candidates each, and queries each, with ranks of their own. Shorter vectors count as
    filled with zeros. An empty side gives no rows. Inner products must fit in a long.
    """
    scratch = Scratch(vectors.sparkSession)
    asked = scratch.save(queries.select("vec_id", "v", F.monotonically_increasing_id().alias("row")))
    lots = -(-asked.count() // lot)
    none = vectors.sparkSession.createDataFrame([], "row long, query_id long, vec_id long, score long, own boolean")
    pivots, sample_ids, sample = pick_pivots(vectors)
    if not lots or not len(sample):
        found = none
    else:
        table = pivot_table(vectors, pivots, scratch)
        parts = []
        for i in range(lots):
            own = asked.where(F.pmod(F.xxhash64("row"), F.lit(lots)) == i)
            made = _found(table, Lot(own.toArrow(), pivots, sample_ids, sample, k), pivots.width, k, block)
            parts.append(scratch.save(made) if lots > 1 else made)
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    few = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    so_far = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.col("n") - F.least("owns", F.lit(1))
    ranked = few.withColumn("owns", so_far).where(~(F.col("own") & (F.col("owns") == 1))).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
