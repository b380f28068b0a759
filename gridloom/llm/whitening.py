"""Whitening of embeddings by LOBPCG.

The leading eigenvectors of the covariance are found without forming it: each
round multiplies it with a block of residuals, a Spark job over the centred rows
whose tasks send d x m sums. Rayleigh-Ritz on the span of iterate, residuals and
previous directions gives the next iterate. The rounds end when a fresh product
certifies the residuals of the wanted components; then every row is projected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .vectors import Slab, in_slabs, largest, slabs_of, whole_vectors

GUARD = 8  # extra vectors in the block: rounds depend on the gap behind them
TOLERANCE = 1e-12  # residual norm, in terms of the largest eigenvalue
PATIENCE = 2  # rounds below the tolerance that don't halve the residual
ROUNDS = 500


def summed(slabs: DataFrame, answer: Callable[[Slab], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over all slabs of an array of fixed length: tasks sum up first, Spark adds the tasks' sums place by place.

    With `exact` the numbers are whole; they are added as decimals of 38 digits.
    """
    kind = "decimal(38,0)" if exact else "double"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for slab in slabs_of(batch):
                part = answer(slab)
                total = part if total is None else total + part
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)) if exact else pa.array(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], names=["at", "value"])

    found = slabs.mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").cast(kind).alias("value")).collect()
    out = np.zeros(len(found), object if exact else float)
    for at, value in found:
        out[at] = int(value) if exact else value
    return out


def exact_sums(slab: Slab) -> np.ndarray:
    """Number of rows, sums and sum of squares, as Python numbers."""
    x = slab.x
    small = largest(x) ** 2 * x.size < 1 << 63
    wide = x.astype(np.int64 if small else object)
    return np.array([x.shape[1], *wide.sum(axis=1).tolist(), int((wide * wide).sum())], object)


Product = Callable[[np.ndarray], np.ndarray]


def extended(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Orthonormal columns: those of x, then a basis of what the others add to their span."""
    norms = np.linalg.norm(others, axis=0)
    rest = others[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        rest = rest - x @ (x.T @ rest)
    left, sizes, _ = np.linalg.svd(rest, full_matrices=False)
    left = left[:, sizes > 1e-8]
    return np.linalg.qr(np.hstack([x, left]))[0]


def lobpcg(product: Product, d: int, wanted: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The `wanted` largest eigenvalues, their unit eigenvectors as columns, and the certified residual in terms of the largest.

    product multiplies the symmetric matrix of size d, positive semidefinite and not
    zero, with a block of columns; it is called once a round. Rounds go on below
    the tolerance while they still halve the residual.
    """
    m = min(d, wanted + GUARD)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((d, m)))[0]
    best: tuple[float, np.ndarray, np.ndarray] = (np.inf, np.zeros(0), basis)
    waited = 0
    for _ in range(rounds):
        images = product(basis)
        values, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        x = basis @ turn
        residual = images @ turn - x * values
        worst = float(np.linalg.norm(residual[:, :wanted], axis=0).max() / values[0])
        waited = 0 if worst < best[0] / 2 else waited + 1
        if worst < best[0]:
            best = (worst, values[:wanted], x[:, :wanted])
        if best[0] <= tolerance and waited >= PATIENCE or basis.shape[1] == d:
            return best[1], best[2], best[0]
        # what the iterate moved by, outside the last iterate, is the next direction block
        basis = extended(x, np.hstack([residual, basis[:, m:] @ turn[m:]]))
    raise RuntimeError(f"eigenvectors not found to {tolerance} in {rounds} rounds: residual {best[0]}")


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and leading component.

    x is floor(scale * component). All statistics are over the n distinct x. deviation
    is the sum over dimensions of (n*x - S)^2, null where it exceeds 64 bits;
    whitened is (x - S/n) projected on the component over the root of its
    eigenvalue; explained is the eigenvalue over the trace; identity_error is the
    greatest entry by size of whitened's covariance minus the identity.

    Rows whose vector is null, empty or not finite, or has another length than
    most rows (of equally frequent lengths the greatest), are left out. Null and
    repeated ids are kept, a row each. A component with no variance has no rows, so
    a table of one distinct vector, or an empty one, gives none. Of equal
    eigenvalues any eigenvectors are returned; the largest entry of each is
    positive. Columns of other names are never read.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.where(F.size("x") == d)
    fit = in_slabs(rows.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), "x").distinct())
    sums = summed(fit, exact_sums, exact=True)
    n, total, squares = int(sums[0]), sums[1 : d + 1], int(sums[d + 1])
    mean = np.array([int(s) / n for s in total])
    trace = (n * squares - sum(int(s) ** 2 for s in total)) / n**2

    def product(block: np.ndarray) -> np.ndarray:
        m = block.shape[1]

        def answer(slab: Slab) -> np.ndarray:
            centred = slab.x - mean[:, None]
            return (centred @ (centred.T @ block)).ravel()

        return summed(fit, answer).reshape(d, m) / n

    values, axes, _ = lobpcg(product, d, min(components, d)) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), None)
    keep = values > 1e-12 * trace
    values, axes = values[keep], axes[:, keep]
    if not len(values):
        return spark.createDataFrame([], schema)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    whitener = axes / np.sqrt(values)
    k = len(values)

    def spread_of(slab: Slab) -> np.ndarray:
        white = whitener.T @ (slab.x - mean[:, None])
        return np.concatenate([white.sum(axis=1), (white @ white.T).ravel()])

    found = summed(fit, spread_of) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    explained, sums_list = values / trace, [int(s) for s in total]

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * largest(x) + max(map(abs, sums_list))
        if most**2 * d < 1 << 63:
            return ((n * x - np.array(sums_list, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - np.array(sums_list, object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    @tidy
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            white = (x - mean) @ whitener
            at = np.repeat(np.arange(len(x)), k)
            far = pa.array(deviations(x), pa.int64())
            columns = [
                b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n, np.int64)), far.take(pa.array(at)),
                pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return rows.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(project, schema)
