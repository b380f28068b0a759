"""Sharding by histogram sort: exact byte counts below probes, one exchange at the end.

Built-in DataFrame functions only. Rows are ordered by (key, tie); a splitter
between two shards is searched by counting the bytes below candidate
boundaries, in every partition at once, and narrowing each splitter's interval
to the bin that holds its target, until the bytes left in that bin are within
the tolerance. The driver only ever sees BINS sums for each open splitter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BINS = 256
TIE_BITS, ROW_BITS = 20, 42


def _decimals(values: list[int]) -> Column:
    return F.array(*[F.lit(str(v)).cast("decimal(38,0)") for v in values])


def _at_or_below(values: list[int], x: Column) -> Column:
    """How many of the sorted values are at most x: first the block is searched, then its values, so a row meets some 2 sqrt(n) of them."""
    if not values:
        return F.lit(0)
    block = max(1, math.isqrt(len(values)))
    cut = [values[k : k + block] for k in range(0, len(values), block)]
    before = F.size(F.filter(_decimals([c[0] for c in cut]), lambda v: v <= x))
    inside = F.size(F.filter(F.get(F.array(*map(_decimals, cut)), before - 1), lambda v: v <= x))
    return F.when(before == 0, 0).otherwise((before - 1) * block + inside)


def _cut(rows: DataFrame, targets: dict[int, int]) -> dict[int, int]:
    """For each target number of bytes a boundary with that many bytes below it, within its tolerance.

    rows: (key decimal(38,0), size); targets: bytes -> tolerance. A boundary b
    splits rows into key < b and key >= b.
    """
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return dict.fromkeys(targets, 0)
    low, high = int(low), int(high) + 1
    # interval of each open splitter: lower bound, width of its bins, bytes below the lower bound
    found: dict[int, int] = {}
    spans = {t: (low, high, 0) for t in targets}
    while spans:
        distinct = sorted({(a, b) for a, b, _ in spans.values()})
        steps = [-(-(b - a) // BINS) for a, b in distinct]
        span = _at_or_below([a for a, _ in distinct], F.col("key")) - 1
        found_in = rows.select("key", "size", span.alias("span")).select(
            "key", "size", "span", F.get(_decimals([a for a, _ in distinct]), F.col("span")).alias("a"), F.get(_decimals([b for _, b in distinct]), F.col("span")).alias("b"), F.get(_decimals(steps), F.col("span")).alias("step"),
        )
        binned = found_in.where("key < b").select((F.expr("(key - a) div step").cast("int") + F.col("span") * BINS).alias("bin"), "size")
        sums = {r["bin"]: r["bytes"] for r in binned.groupBy("bin").agg(F.sum("size").alias("bytes")).collect()}
        index = {span: k for k, span in enumerate(distinct)}
        following = {}
        for t, (a, b, below) in spans.items():
            step, base = -(-(b - a) // BINS), index[a, b] * BINS
            for i in range(BINS):
                here = sums.get(base + i, 0)
                if below + here >= t or a + (i + 1) * step >= b:
                    break
                below += here
            left, right, tolerance = a + i * step, min(b, a + (i + 1) * step), targets[t]
            if below + here - t <= tolerance and below + here >= t:
                found[t] = right
            elif t - below <= tolerance:
                found[t] = left
            elif right - left <= 1:  # one row is larger than the tolerance
                found[t] = right if below + here - t <= t - below else left
            else:
                following[t] = (left, right, below)
        spans = following
    return found


def histogram_shards(df: DataFrame, key: str, size: Column, shards: int = 8, tolerance: float = 0.001, ranges: int | None = None) -> DataFrame:
    """All rows of df, with size, shard (0..shards-1) and slot (gapless from 0 in its shard).

    Rows are ordered by `key` (a 64-bit integer; nulls come first), then by a
    hash of the row, then by a hash of the row number that the written table
    fixes, so that any number of equal keys or fully repeated rows can be cut
    anywhere. Shards
    differ by at most `tolerance` of a mean shard plus one row. Each shard is
    dealt in several finer ranges, so that no task holds a whole shard: a
    range is exchanged once, ordered, and its slots begin where the exact row
    counts of the ranges before it end.

    Null texts count by the size expression, texts of any length are one row
    each, an empty table gives no rows, and columns of df whose names clash with
    the three new ones are replaced. A key of another type than an integer is
    cast, so text that is no number counts as null.
    """
    spark = df.sparkSession
    df = df.drop("size", "shard", "slot")
    names = df.columns
    tie = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(1 << TIE_BITS))
    held = materialise(df.withColumns({"size": size.cast("long"), "__at": F.monotonically_increasing_id(), "__tie": tie}))
    place = F.expr(
        f"cast(coalesce(cast(`{key}` as decimal(38,0)), cast('-9223372036854775809' as decimal(38,0))) * cast({1 << (TIE_BITS + ROW_BITS)} as decimal(38,0))"
        f" + cast(__tie as decimal(38,0)) * cast({1 << ROW_BITS} as decimal(38,0)) + cast(pmod(xxhash64(__at), {1 << ROW_BITS}) as decimal(38,0)) as decimal(38,0))"
    )
    ordered = held.withColumn("__key", place)
    rows = ordered.select(F.col("__key").alias("key"), "size")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = ranges or max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fine = -(-parts // shards)
    wanted = [total * i // (shards * fine) for i in range(1, shards * fine)]
    loose, strict = total // (4 * shards * fine), min(int(tolerance * total / shards), total // (4 * shards * fine))
    found = _cut(rows, {t: loose for t in wanted} | {t: strict for t in wanted[fine - 1 :: fine]})
    bounds = sorted(found[t] for t in wanted)
    dealt = ordered.withColumn("__range", _at_or_below(bounds, F.col("__key")))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    shard_of = F.least(F.floor(F.col("__range") / fine), F.lit(shards - 1)).cast("int")
    starts = counts.withColumn("shard", shard_of).withColumn(
        "__start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = Window.partitionBy("__range").orderBy("__key", "__at")
    return (
        dealt.withColumn("__row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts.select("__range", "shard", "__start")), "__range")
        .withColumn("slot", (F.col("__start") + F.col("__row")).cast("long"))
        .select(*[F.col(f"`{c}`") for c in names], "size", "shard", "slot")
    )
