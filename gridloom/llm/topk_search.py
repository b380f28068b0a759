"""Exact top-k search by inner product: columnar branch and bound.

Vectors lie in vertical slabs. For a tile of queries the products are summed up
block of components by block, all candidates of a slab at once. After each block
a candidate's score is at most what it has so far plus the mass that remains:
the norm of the query's remaining components times that of the candidate's. Those
that cannot reach the query's k-th best score any more are dropped, and the rest
are compacted to a list of (query, candidate), on which the later blocks are
summed up. Scores of survivors are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import BLOCK_BYTES, TILE, Best, Pass, Queries, Slab, answers, gathered, in_slabs, merged, products_fit, query_blocks, seeds, slabs_of, spans, whole_vectors

DENSE = 0.25  # with a larger share alive, a block is summed up for all candidates of the slab
NONE = -(1 << 63)
PROBE = 256  # candidates that give a first bound where there is none yet
FLOAT_STEP = 2.0**-50  # a floor as a double is off by less than this share of it


def remaining(x: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Norm of the components from each block on, a row a block and a last row of zeros; components lie along axis 0."""
    squares = np.array([(x[a:b].astype(float) ** 2).sum(axis=0) for a, b in parts])
    return np.sqrt(np.vstack([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros(x.shape[1])]))


def survivors(q: np.ndarray, x: np.ndarray, floor: np.ndarray, parts: list[tuple[int, int]], q_mass: np.ndarray, x_mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all pairs whose score reaches the query's floor.

    q has a query a row, x a candidate a column; both of one number type in which
    the products are exact.
    """
    slack = 1e-9 * q_mass[0][:, None] * x_mass[0] + 1e-3
    scores = np.zeros((len(q), x.shape[1]), q.dtype)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for k, (a, b) in enumerate(parts):
        if pairs is None:
            scores += q[:, a:b] @ x[a:b]
            alive = scores + q_mass[k + 1][:, None] * x_mass[k + 1] + slack >= floor[:, None]
            if k + 1 == len(parts) or alive.mean() < DENSE:
                pairs = np.nonzero(alive)
                scores = scores[pairs]
        else:
            i, j = pairs
            scores = scores + np.einsum("ij,ji->i", q[i, a:b], x[a:b, j])
            alive = scores + q_mass[k + 1][i] * x_mass[k + 1][j] + slack[i, j] >= floor[i]
            pairs, scores = (i[alive], j[alive]), scores[alive]
    assert pairs is not None
    fine = scores >= floor[pairs[0]]
    return pairs[0][fine], pairs[1][fine], scores[fine].astype(np.int64)


def first_floor(q: np.ndarray, ids: np.ndarray, slab_ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among some candidates; no bound where there are fewer than k."""
    scores = (q @ x).astype(float)
    scores[ids[:, None] == slab_ids] = -np.inf
    return np.partition(scores, -k, axis=1)[:, -k] if x.shape[1] >= k else np.full(len(q), -np.inf)


def search_slab(slab: Slab, block: Queries, best: Best) -> None:
    """Offer a slab's vectors to the queries of its length, tile by tile."""
    d = slab.x.shape[0]
    kind = np.float64 if products_fit(slab.x, block.q, d) else np.int64
    x, parts = slab.x.astype(kind), spans(d)
    x_mass = remaining(x, parts)
    for start in range(0, len(block.q), TILE):
        rows = slice(start, start + TILE)
        q = block.q[rows].astype(kind)
        floor = best.floor[rows].astype(float)
        if (best.floor[rows] == NONE).any():
            floor = np.maximum(floor, first_floor(q, block.ids[rows], slab.ids[:PROBE], x[:, :PROBE], best.k))
        i, j, score = survivors(q, x, floor - FLOAT_STEP * np.abs(floor), parts, remaining(q.T, parts), x_mass)
        other = slab.ids[j] != block.ids[start + i]
        best.add(start + i[other], score[other], slab.ids[j[other]])


def search_pass(spark: SparkSession, found: list[Queries], floors: np.ndarray, k: int) -> tuple[Pass, Broadcast]:
    """A pass of one block of queries over slabs, and the broadcast that it reads."""
    shared = spark.sparkContext.broadcast((found, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, bounds = shared.value
        by_length = {b.q.shape[1]: (b, Best(len(b.q), k, bounds[b.number].copy())) for b in queries}
        for batch in batches:
            for slab in slabs_of(batch):
                if slab.x.shape[0] in by_length:
                    search_slab(slab, *by_length[slab.x.shape[0]])
        for b, best in by_length.values():
            row, score, ids = best.rows()
            yield answers(b.number[row], b.ids[row], np.zeros(len(row), np.int64), ids, score)

    return run, shared


def floors_of(found: DataFrame, k: int, size: int) -> np.ndarray:
    """The k-th best score of each query so far, and no bound where there are fewer."""
    out = np.full(size, NONE, np.int64)
    for number, score in found.where(F.col("rank") == k).select("number", "score").collect():
        out[number] = score
    return out


def top_k(vectors: DataFrame, wanted: str = "id % 50 = 0", k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest integer inner product with each query, ties to the smaller id.

    `wanted` says over the column `id` which rows are queries; candidates are all
    rows of other ids. Components are floor(scale * component). Rows with a null id
    or a null, empty or not finite vector take no part. A query is compared with
    vectors of its own length. Rows that repeat an id and a vector are one query
    but as many candidates. With fewer candidates than k all are returned; an
    empty table gives no rows. Columns of other names are never read. Vectors
    whose products exceed 64 bits raise an error.

    Each block of queries makes two passes, one over some slabs for bounds and one
    over all for results.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale).where("id is not null")
    slabs = in_slabs(rows)
    few = seeds(slabs)

    def parts() -> Iterator[DataFrame]:
        for _, found in query_blocks(rows, wanted, block_bytes):
            size = sum(len(b.q) for b in found)
            run, shared = search_pass(spark, found, np.full(size, NONE, np.int64), k)
            floors = floors_of(merged(few, run, k), k, size)
            shared.destroy()
            run, shared = search_pass(spark, found, floors, k)
            yield merged(slabs, run, k).select("query_id", "rank", "vec_id", "score")
            shared.destroy()

    return gathered(spark, parts(), "query_id long, rank int, vec_id long, score long")
