"""Hard-negative mining with an orthogonal PCA rotation.

The eigenvectors of the rows' covariance turn every vector, so its first
components carry most of it; lengths and inner products stay. For each anchor
the products of leading components are summed up block by block. The rest of a
product is at most the product of the two residual norms, plus slack for the
rounding of rotation and sums. Rows that can't reach what the anchor still looks
for are discarded; survivors are verified with the integer product of the
vectors as they were.

One pass finds each anchor's positives, the best rows of its label. A second one
finds, for each positive's score, the best rows of other labels within the
band that the score allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy
from .topk_search import DENSE, NONE, remaining
from .vectors import BLOCK_BYTES, TILE, Best, Pass, Queries, Slab, answers, gathered, in_slabs, merged, products_fit, query_blocks, seeds, slabs_of, spans, whole_vectors

SUMS = "d int, at int, value double"


def moments(slabs: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """length -> (number of rows, sums, sums of products of components); d * d numbers a length reach the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab in slabs_of(batch):
                x = slab.x.astype(float)
                part = np.concatenate([[x.shape[1]], x.sum(axis=1), (x @ x.T).ravel()])
                held[len(x)] = held.get(len(x), 0) + part
        for d, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)], names=["d", "at", "value"])

    out: dict[int, np.ndarray] = {}
    for d, at, value in slabs.mapInArrow(run, SUMS).groupBy("d", "at").agg(F.sum("value")).collect():
        out.setdefault(d, np.zeros(1 + d + d * d))[at] = value
    return {d: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for d, v in out.items()}


def rotations(slabs: DataFrame) -> dict[int, np.ndarray]:
    """length -> the covariance's eigenvectors, a row each, by falling eigenvalue."""
    out = {}
    for d, (n, total, squares) in moments(slabs).items():
        _, vectors = np.linalg.eigh(squares / n - np.outer(total / n, total / n))
        out[d] = np.ascontiguousarray(vectors[:, ::-1].T)
    return out


def slack_of(d: int, a_norm: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """More than rotation and sums of doubles can be off, for pairs of these norms."""
    return 16 * d**1.5 * np.finfo(float).eps * (a_norm + 1) * (b_norm + 1)


def reaching(turned_q: np.ndarray, turned_x: np.ndarray, masks: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of all masked pairs whose product may reach the query's floor; components of x lie along axis 0."""
    d = len(turned_x)
    parts = spans(d)
    q_mass, x_mass = remaining(turned_q.T, parts), remaining(turned_x, parts)
    sums = np.zeros(masks.shape)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for k, (a, b) in enumerate(parts):
        if pairs is None:
            sums += turned_q[:, a:b] @ turned_x[a:b]
            bound = sums + q_mass[k + 1][:, None] * x_mass[k + 1] + slack_of(d, q_mass[0][:, None], x_mass[0])
            alive = masks & (bound >= floor[:, None])
            if k + 1 == len(parts) or alive.mean() < DENSE:
                pairs = np.nonzero(alive)
                sums = sums[pairs]
        else:
            i, j = pairs
            sums = sums + np.einsum("ij,ji->i", turned_q[i, a:b], turned_x[a:b, j])
            alive = sums + q_mass[k + 1][i] * x_mass[k + 1][j] + slack_of(d, q_mass[0][i], x_mass[0][j]) >= floor[i]
            pairs, sums = (i[alive], j[alive]), sums[alive]
    assert pairs is not None
    return pairs


def verified(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the pairs; some thousand pairs at once."""
    products_fit(x, q, len(x))
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 14):
        s = slice(a, a + (1 << 14))
        out[s] = np.einsum("ij,ji->i", q[i[s]], x[:, j[s]].astype(np.int64))
    return out


def positives_in(slab: Slab, turned_x: np.ndarray, block: Queries, turned_q: np.ndarray, best: Best) -> None:
    """Offer a slab's rows to the anchors of the same label."""
    for start in range(0, len(block.q), TILE):
        rows = slice(start, start + TILE)
        same = (block.labels[rows][:, None] == slab.labels) & (block.ids[rows][:, None] != slab.ids)
        if same.any():
            floor = np.where(best.floor[rows] == NONE, -np.inf, best.floor[rows])
            i, j = reaching(turned_q[rows], turned_x, same, floor)
            best.add(start + i, verified(block.q[rows], slab.x, i, j), slab.ids[j])


def negatives_in(slab: Slab, turned_x: np.ndarray, block: Queries, turned_q: np.ndarray, ceilings: np.ndarray, best: list[Best]) -> None:
    """Offer a slab's rows of other labels to each band of each anchor; ceilings has a band a row, best its rows."""
    for start in range(0, len(block.q), TILE):
        rows = slice(start, start + TILE)
        least = np.min([b.floor[rows] for b in best], axis=0)
        unlike = (block.labels[rows][:, None] != slab.labels) & (least != CLOSED)[:, None]
        if unlike.any():
            i, j = reaching(turned_q[rows], turned_x, unlike, least.astype(float))
            score = verified(block.q[rows], slab.x, i, j)
            for band, found in zip(ceilings, best, strict=True):
                inside = score <= band[start + i]
                found.add(start + i[inside], score[inside], slab.ids[j[inside]])


CLOSED = (1 << 63) - 1  # the floor of a band that holds nothing


def mining_pass(spark: SparkSession, found: list[Queries], turns: dict[int, np.ndarray], k: int, bands: tuple[np.ndarray, np.ndarray, np.ndarray] | None, floors: np.ndarray | None) -> tuple[Pass, Broadcast]:
    """A pass for positives (bands is None) or for negatives; bands: least score, greatest score and positive score by slot and query."""
    shared = spark.sparkContext.broadcast((found, turns, bands, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, turn, limits, known = shared.value
        work = {}
        for b in queries:
            d = b.q.shape[1]
            if limits is None:
                best = [Best(len(b.q), k, known[0][b.number].copy())]
            else:
                best = [Best(len(b.q), k, np.maximum(low, kept)[b.number]) for low, kept in zip(limits[0], known, strict=True)]
            work[d] = (b, b.q @ turn[d].T, best)
        for batch in batches:
            for slab in slabs_of(batch):
                d = len(slab.x)
                if d in work:
                    b, turned_q, best = work[d]
                    turned_x = turn[d] @ slab.x
                    if limits is None:
                        positives_in(slab, turned_x, b, turned_q, best[0])
                    else:
                        negatives_in(slab, turned_x, b, turned_q, limits[1][:, b.number], best)
        for b, _, best in work.values():
            for slot, kept in enumerate(best):
                row, score, ids = kept.rows()
                yield answers(b.number[row], b.ids[row], np.full(len(row), slot), ids, score)

    return run, shared


def bands_of(positives: list, size: int, k: int, low: int, high: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, greatest, positive's score) by slot and query: one slot for each distinct score of a query's positives."""
    least, most, score = (np.full((k, size), v, np.int64) for v in (CLOSED, NONE, NONE))
    used = np.zeros(size, np.int64)
    seen = set()
    for number, p in positives:
        if (number, p) not in seen:
            seen.add((number, p))
            slot, used[number] = used[number], used[number] + 1
            below, above = -((-low * p) // of), (high * p) // of
            if below <= above:
                least[slot, number], most[slot, number], score[slot, number] = below, above, p
    return least, most, score


def hard_negatives(
    vectors: DataFrame, wanted: str = "id % 50 = 0", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, of: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor (`wanted` over the column `id`) its best `positives` other rows of
    the same label, and for each of those the best `negatives` rows of other labels
    with low * positive_score <= of * negative_score <= high * positive_score. Scores
    are integer inner products of floor(scale * component), ties go to the smaller
    id. A negative positive_score has no such rows.

    Rows with a null id or label, or a null, empty or not finite vector take no part.
    An anchor is compared with vectors of its own length. Rows of the anchor's id
    are no positives of it; rows that repeat id, label and vector are one anchor but
    as many candidates. Anchors without positives, and positives without
    negatives, give no rows; nor does an empty table. Columns of other names are
    never read. Vectors whose products exceed 64 bits raise an error.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale, label_col).where("id is not null")
    slabs = in_slabs(rows)
    few, turns = seeds(slabs), rotations(slabs)

    def bounded(found: list[Queries], size: int, k: int, bands: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[DataFrame, Broadcast]:
        """The answers of one kind of pass: bounds from some slabs, then results from all."""
        slots = 1 if bands is None else len(bands[0])
        run, shared = mining_pass(spark, found, turns, k, bands, np.full((slots, size), NONE, np.int64))
        first = merged(few, run, k)
        floors = np.full((slots, size), NONE, np.int64)
        for number, slot, score in first.where(F.col("rank") == k).select("number", "slot", "score").collect():
            floors[slot, number] = score
        shared.destroy()
        run, shared = mining_pass(spark, found, turns, k, bands, floors)
        return merged(slabs, run, k), shared

    def parts() -> Iterator[DataFrame]:
        for _, found in query_blocks(rows, wanted, block_bytes):
            size = sum(len(b.q) for b in found)
            best, shared = bounded(found, size, positives, None)
            near = gathered(spark, iter([best.select("number", "query_id", "vec_id", "score")]), "number long, query_id long, vec_id long, score long")
            shared.destroy()
            bands = bands_of(near.select("number", "score").collect(), size, positives, low, high, of)
            hard, shared = bounded(found, size, negatives, bands)
            slots = [(int(n), int(s), int(bands[2][s, n])) for s, n in zip(*np.nonzero(bands[2] != NONE), strict=True)]
            names = spark.createDataFrame(slots, "number long, slot long, score long")
            pairs = near.join(names, ["number", "score"]).select("number", "slot", F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            yield hard.select("number", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["number", "slot"]).select(
                "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
            )
            shared.destroy()

    return gathered(spark, parts(), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
