"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators import shared

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names in spark.checkpoint.dir; see operators.shared."""
    return shared.folder(spark)


def shared_uri(spark: SparkSession) -> str:
    """A fresh shared folder as a whole URI, for files that tasks write themselves.

    A path without a scheme is on whatever file system Spark takes it for: a
    table of one row is written there, and Spark names the place it is read from.
    """
    path = shared_dir(spark)
    if "://" in path:
        return path
    spark.range(1).coalesce(1).write.parquet(f"{path}/mark")
    place = spark.read.parquet(f"{path}/mark").select("_metadata.file_path").first()[0]
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", place.rpartition("/mark/")[0])


def materialise(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back.

    This cuts the lineage and survives lost executors; nothing that a later
    step reads is computed twice.
    """
    return shared.written(df)


def materialise_sparing(df: DataFrame) -> DataFrame:
    """materialise, with Arrow batches of at most BATCH_BYTES while it is written.

    A batch is in memory three times, twice beside the JVM's heap: for steps that
    follow each other in long-lived executors.
    """
    conf = df.sparkSession.conf
    before = conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        return shared.written(df)
    finally:
        conf.set(BATCH_CONF, before)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most `limit` bytes each (a longer row is alone)."""
    n = len(column)
    if not n:
        return
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def texts(column: pa.Array, start: int, stop: int) -> list[bytes]:
    """UTF-8 bytes of the rows; a null text is an empty one."""
    return [x if x is not None else b"" for x in column.slice(start, stop - start).cast(pa.binary()).to_pylist()]


def squeezed(df: DataFrame, text_col: str) -> DataFrame:
    """df with its texts packed by zstd: a third of the bytes in what a join deals out and writes. Nulls stay; see expanded."""
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for b in batches:
            for start, stop in slices(b.column(at)):
                part = b.slice(start, stop - start)
                packed = pa.array([x if x is None else squeeze(x) for x in part.column(at).cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([packed if k == at else c for k, c in enumerate(part.columns)], names=names)

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, kinds)


def expanded(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Row ranges of packed texts, of about SLICE_BYTES of text each, with the texts."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    start, held, out = 0, 0, []
    for k in range(len(column)):
        x = column[k].as_py()
        out.append(x if x is None else expand(x))
        held += len(out[-1] or b"")
        if held >= SLICE_BYTES or k + 1 == len(column):
            yield start, k + 1, out
            start, held, out = k + 1, 0, []


def spread(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... joined."""
    total = int(n.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Answer = Callable[[pa.Table], pa.Table]


def _hand_back() -> None:
    """Give freed memory back to the system: workers live on, and what they hold adds up over stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Run) -> Run:
    """run, handing memory back at its task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _hand_back()

    return tidied


def tidy_group(answer: Answer) -> Answer:
    """answer, handing memory back after each group (a bucket, so some megabytes of text)."""

    def tidied(group: pa.Table) -> pa.Table:
        out = answer(group)
        _hand_back()
        return out

    return tidied


def quiet_threads() -> None:
    """Executors run one task a core: no thread pools inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
