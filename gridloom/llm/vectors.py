"""Whole-number vectors in vertical slabs, and passes of query blocks over them.

A slab holds some hundred vectors of one length, component by component: all
first components, then all second ones, and so on, so a block of components is
one stretch of memory. Slabs are written once to the shared folder. Queries go
out in blocks of bounded bytes; each pass over the slabs answers one block and
is merged by Spark. Nothing whole is collected: the driver sees one block of
queries and its bounds at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, tidy

SLAB_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
TILE = 512
EXACT = float(1 << 53)  # sums of whole numbers below it are exact as doubles


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0, label_col: str | None = None) -> DataFrame:
    """(id, label, x): x holds floor(scale * component) as longs.

    Rows whose vector is null or empty, or holds a null, NaN or infinite
    component, are left out; so are rows with a null label where a label is
    asked for. Other columns are never read.
    """
    v = F.col(f"`{vector_col}`")
    number = lambda c: c.cast("double")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < F.lit(float("inf"))))
    label = F.col(f"`{label_col}`").cast("long") if label_col else F.lit(0).cast("long")
    out = df.where(v.isNotNull() & (F.size(v) > 0)).where(sound)
    return out.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.transform(v, lambda c: F.floor(F.lit(scale) * number(c))).alias("x")).where("label is not null")


def in_slabs(vectors: DataFrame) -> DataFrame:
    """(d, n, ids, labels, x) of (id, label, x); x is d rows of n numbers, as 4-byte ones where they fit. Null ids become the least long."""

    def packed(d: int, ids: list[np.ndarray], labels: list[np.ndarray], rows: list[np.ndarray]) -> list[object]:
        x = np.ascontiguousarray(np.concatenate(rows).T)
        if x.size and -(1 << 31) <= x.min() and x.max() < 1 << 31:
            x = x.astype(np.int32)
        return [d, x.shape[1], np.concatenate(ids).tobytes(), np.concatenate(labels).tobytes(), x.tobytes()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        count: dict[int, int] = {}

        def flush(d: int) -> pa.RecordBatch:
            row = packed(d, *held.pop(d))
            count[d] = 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["d", "n", "ids", "labels", "x"])

        for b in batches:
            ids = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            labels = b.column(1).to_numpy(zero_copy_only=False)
            lengths = np.diff(b.column(2).offsets.to_numpy())
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                most = max(1, SLAB_BYTES // (8 * d))
                while len(at):
                    take, at = at[: most - count.get(d, 0)], at[most - count.get(d, 0) :]
                    rows = flat[(ends[take] - d)[:, None] + np.arange(d)]
                    for part, new in zip(held.setdefault(d, ([], [], [])), (ids[take], labels[take], rows), strict=True):
                        part.append(new)
                    count[d] = count.get(d, 0) + len(take)
                    if count[d] == most:
                        yield flush(d)
        for d in list(held):
            yield flush(d)

    return materialise(vectors.select(F.col("id").cast("long"), "label", "x").mapInArrow(run, "d int, n int, ids binary, labels binary, x binary"))


@dataclass
class Slab:
    """One slab as arrays: ids and labels of its n vectors, x of d rows and n columns."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def slabs_of(batch: pa.RecordBatch) -> Iterator[Slab]:
    """The slabs of a batch of in_slabs' rows."""
    d, n, ids, labels, x = (batch.column(k) for k in range(5))
    for k in range(batch.num_rows):
        raw, shape = x[k].as_buffer(), (d[k].as_py(), n[k].as_py())
        kind = np.int32 if len(raw) == 4 * shape[0] * shape[1] else np.int64
        yield Slab(np.frombuffer(ids[k].as_buffer(), np.int64), np.frombuffer(labels[k].as_buffer(), np.int64), np.frombuffer(raw, kind).reshape(shape))


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def products_fit(a: np.ndarray, b: np.ndarray, d: int) -> bool:
    """Whether inner products are exact as doubles; an error where they don't fit in a long at all."""
    most = largest(a) * largest(b) * d
    if most >= 1 << 63:
        raise ValueError("the inner products of these vectors do not fit in 64 bits")
    return most < EXACT


@dataclass
class Queries:
    """Queries of one length: numbers within the block, ids, labels and one vector a row."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray


@dataclass
class Best:
    """The k highest scores of each of m rows, ties by smaller id, and the score below which nothing can enter.

    `floor` may start at a proven bound: at least k scores of the row reach it.
    """

    m: int
    k: int
    floor: np.ndarray
    score: np.ndarray = field(init=False)
    id: np.ndarray = field(init=False)
    used: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.score = np.full((self.m, self.k), -(1 << 63), np.int64)
        self.id = np.full((self.m, self.k), (1 << 63) - 1, np.int64)
        self.used = np.zeros((self.m, self.k), bool)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer scores to rows; each row keeps its k best."""
        fine = score >= self.floor[row]
        row, score, ids = row[fine], score[fine], ids[fine]
        if not len(row):
            return
        touched = np.unique(row)
        old = self.used[touched]
        row = np.concatenate([np.repeat(touched, old.sum(axis=1)), row])
        score = np.concatenate([self.score[touched][old], score])
        ids = np.concatenate([self.id[touched][old], ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = rank < self.k
        row, score, ids, rank = row[keep], score[keep], ids[keep], rank[keep]
        self.used[touched] = False
        self.score[row, rank], self.id[row, rank], self.used[row, rank] = score, ids, True
        full = row[rank == self.k - 1]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all that is kept."""
        row, at = np.nonzero(self.used)
        return row, self.score[row, at], self.id[row, at]


def query_blocks(vectors: DataFrame, wanted: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list[Queries]]]:
    """Blocks of bounded size of the rows (id, label, x) that `wanted` holds for: (number of the block, its queries by length).

    Rows that repeat an id, a label and a vector are one query. The driver holds
    one block at a time.
    """
    chosen = materialise(vectors.where("id is not null").where(wanted).distinct())
    total = chosen.agg(F.sum(F.size("x"))).first()[0] or 0
    blocks = max(1, -(-8 * total // block_bytes))
    share = F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks))
    for block in range(blocks if total else 0):
        rows = chosen.where(share == block).sort("id", "label", "x").toArrow().combine_chunks()
        lists = rows.column("x").combine_chunks() if rows.num_rows else None
        if lists is None:
            continue
        ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        flat, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        ends = np.cumsum(size)
        found = []
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            found.append(Queries(at, ids[at], labels[at], flat[(ends[at] - d)[:, None] + np.arange(d)]))
        yield block, found


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ANSWER = "number long, query_id long, slot long, vec_id long, score long"


def answers(number: np.ndarray, query_id: np.ndarray, slot: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (number, query_id, slot, vec_id, score)], names=["number", "query_id", "slot", "vec_id", "score"])


def merged(slabs: DataFrame, run: Pass, k: int) -> DataFrame:
    """The k best answers of every (number, slot), with rank."""
    order = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "vec_id")
    return slabs.mapInArrow(tidy(run), ANSWER).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def gathered(spark: SparkSession, parts: Iterator[DataFrame], schema: str) -> DataFrame:
    """The rows of all parts, each written to one table in the shared folder as it comes."""
    path = shared_dir(spark)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def seeds(slabs: DataFrame) -> DataFrame:
    """About the square root of all slabs, by hash: what they hold bounds the answers of all.

    The bounds keep what a pass sends to the shuffle at some 2 k sqrt(slabs) rows
    a query, where k rows a task would grow with the table. They decide no
    result: whatever reaches a bound is looked at in the pass over all slabs.
    """
    step = max(1, math.isqrt(slabs.count()))
    return slabs.where(F.pmod(F.xxhash64("ids"), F.lit(step)) == 0)


def spans(d: int, least: int = 8, parts: int = 4) -> list[tuple[int, int]]:
    """Blocks of components: some `parts` of them, each of `least` components or more."""
    step = max(least, -(-d // parts))
    return [(a, min(d, a + step)) for a in range(0, d, step)]
