"""Packing documents into sequences by linear grouping and best fit.

All decisions are made on the histogram of piece lengths, which has at most
`capacity` rows whatever the size of the corpus:

1. lengths above a third of the capacity are large. Ordered by length they are
   cut into groups of equal cardinality, and each is rounded up to the largest
   of its group, which leaves few sizes;
2. the configurations (multisets of sizes that fit) are optimised by column
   generation: a simplex basis over configurations, priced by a knapsack over the
   sizes. A configuration costs its sequence and what will be lost of the room it
   leaves: as much of it as small lengths that exceed the room have of all
   small tokens. So room is left for small lengths to fill, or none;
3. each configuration's rounded items are replaced by actual lengths of their
   groups;
4. small lengths go, largest first, into the sequence with the least room that
   still holds them; new sequences are opened when none does.

The plan is a list of segments: the k-th to l-th pieces of a length go to a run
of sequences at an offset. Pieces find their segment by their rank among the
pieces of equal length, counted in buckets, so no task holds all pieces of a
frequent length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, spread, texts, tidy
from .tokens import encoder, with_end

SHARE = 1 / 3
GROUPS = 480
SEQUENCE_COST = 0.2  # of a configuration beside the share of its sequence that is lost
BUCKET_ROWS = 50_000


def linear_groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Cut lengths (length -> count), largest first, into runs [length, count] of equal cardinality."""
    left = sum(counts.values())
    out: list[list[list[int]]] = []
    runs = [[length, n] for length, n in sorted(counts.items(), reverse=True)]
    while runs:
        share = -(-left // max(1, groups - len(out)))
        group: list[list[int]] = []
        while share and runs:
            n = min(share, runs[0][1])
            group.append([runs[0][0], n])
            runs[0][1] -= n
            share, left = share - n, left - n
            if not runs[0][1]:
                runs.pop(0)
        out.append(group)
    return out


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, cost: np.ndarray) -> tuple[float, np.ndarray]:
    """Multiset of sizes with the most worth beyond its cost, which depends on the room that it leaves."""
    capacity = len(cost) - 1
    best = np.full(capacity + 1, -np.inf)  # by exact sum of the sizes
    best[0] = 0
    taken = []
    for _ in range(capacity // int(sizes.min())):
        value, choice = best.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes.tolist()):
            option = best[: capacity + 1 - s] + worth[g]
            better = option > value[s:] + 1e-12
            value[s:][better] = option[better]
            choice[s:][better] = g
        taken.append(choice)
        if (choice < 0).all():
            break
        best = value
    gain = best[1:] - cost[capacity - np.arange(1, capacity + 1)]
    used = int(gain.argmax()) + 1
    top, config = float(gain[used - 1]), np.zeros(len(sizes), np.int64)
    for choice in reversed(taken):
        if choice[used] >= 0:
            config[choice[used]] += 1
            used -= int(sizes[choice[used]])
    return top, config


def configurations(sizes: np.ndarray, demand: np.ndarray, cost: np.ndarray, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used; together they hold the demand of every size.

    cost: of a configuration, by the room that it leaves, from none to the whole capacity.
    """
    capacity, k = len(cost) - 1, len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    price = cost[capacity - sizes * (capacity // sizes)]
    inverse = np.linalg.inv(basis)
    for turn in range(1, rounds):
        gain, column = _best_configuration(sizes, price @ inverse, cost)
        if gain <= 1e-9:
            break
        amount, step = inverse @ demand, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], price[out] = column, cost[capacity - int(column @ sizes)]
        row = inverse[out] / step[out]
        inverse = np.linalg.inv(basis) if turn % 64 == 0 else inverse - np.outer(step, row)
        if turn % 64:
            inverse[out] = row
    amount = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-6).astype(np.int64)
    found, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-amount, kind="stable"):
        config = np.rint(basis[:, j]).astype(np.int64)
        uses = config > 0
        n = min(int(amount[j]), int((left[uses] // config[uses]).min()))
        if n:
            found.append((config, n))
            left -= n * config
    while left.any():  # a few items: what the rounding down has left
        config, room = np.zeros(k, np.int64), capacity
        for g in np.argsort(-sizes, kind="stable"):
            config[g] = min(int(left[g]), room // int(sizes[g]))
            room -= int(config[g] * sizes[g])
        n = int((left[config > 0] // config[config > 0]).min())
        found.append((config, n))
        left -= n * config
    return found


Bins = dict[int, list[tuple[list[int], int]]]


def best_fit(counts: dict[int, int], bins: Bins, capacity: int) -> None:
    """Put lengths, largest first, where the least room still holds them; open new sequences when none does.

    bins: room left -> (items, how many such sequences); it is changed in place.
    """

    def put(room: int, items: list[int], n: int) -> None:
        if n:
            bins.setdefault(room, []).append((items, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in sorted(r for r in bins if r >= s):
            if not left:
                break
            per = room // s
            for items, n in bins.pop(room):
                full = min(n, left // per)
                put(room - per * s, items + [s] * per, full)
                left, n = left - full * per, n - full
                if n and left:
                    put(room - left * s, items + [s] * left, 1)
                    left, n = 0, n - 1
                put(room, items, n)
        per = capacity // s
        put(capacity - per * s, [s] * per, left // per)
        if left % per:
            put(capacity - left % per * s, [s] * (left % per), 1)


def room_cost(small: dict[int, int], capacity: int) -> np.ndarray:
    """Cost of a configuration by the room that it leaves: its sequence, and the share of the room that small lengths are too long for."""
    mass = np.zeros(capacity + 1)
    for x, n in small.items():
        mass[x] = x * n
    longer = 1 - np.cumsum(mass) / mass.sum() if small else np.ones(capacity + 1)
    return SEQUENCE_COST + np.arange(capacity + 1) * np.maximum(longer, 0) / capacity


def grouped(large: dict[int, int], cost: np.ndarray, groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """Sequences of large lengths as (lengths in order, how many such sequences): rounded up in groups, optimised, and put back to actual lengths."""
    merged: dict[int, list[list[int]]] = {}
    for group in linear_groups(large, groups):
        merged.setdefault(group[0][0], []).extend(group)
    kinds = np.array(sorted(merged), np.int64)
    demand = np.array([sum(n for _, n in merged[int(k)]) for k in kinds], np.int64)
    out = []
    for config, times in configurations(kinds, demand, cost):
        slots = [int(k) for k in np.repeat(kinds, config)[::-1]]
        uses = {k: slots.count(k) for k in slots}
        while times:
            # each slot reads on in its group's runs; a chunk ends with the first run that ends
            chunk = min([times, *(max(1, merged[k][0][1] // m) for k, m in uses.items())])
            items = []
            for k in slots:
                run = merged[k][0]
                items.append(run[0])
                run[1] -= chunk
                if not run[1]:
                    merged[k].pop(0)
            out.append((items, chunk))
            times -= chunk
    return out


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths in order, how many such sequences) for a histogram length -> count."""
    whole = [([capacity], counts[capacity])] if counts.get(capacity) else []
    large = {x: n for x, n in counts.items() if capacity * SHARE < x < capacity and n}
    small = {x: n for x, n in counts.items() if 0 < x <= capacity * SHARE and n}
    bins: Bins = {}
    if large:
        for items, n in grouped(large, room_cost(small, capacity)):
            bins.setdefault(capacity - sum(items), []).append((items, n))
    best_fit(small, bins, capacity)
    return whole + [x for room in sorted(bins) for x in bins[room]]


def segments(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in plan:
        offset = 0
        for x in items:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int | None, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): ids of the whole text, the end id, cut at capacity."""
    kind = docs.schema[id_col].dataType

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path)
        for b in batches:
            for first, stop in slices(b.column(1), 1 << 20):
                ids, lengths = with_end(*encode(texts(b.column(1), first, stop)), end_id)
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                n = -(-lengths // capacity)
                at = np.repeat(np.arange(first, stop), n)
                number = spread(n)
                start = number * capacity
                length = np.minimum(capacity, np.repeat(lengths, n) - start)
                begin = np.repeat(ends - lengths, n) + start
                view = memoryview(ids).cast("B")
                part = [view[4 * x : 4 * (x + m)] for x, m in zip(begin.tolist(), length.tolist(), strict=True)]
                crc = [zlib.crc32(x) for x in part]
                columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(x) for x in part], pa.binary())] * with_ids, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there.

    Returns id, piece, start, length, ids_crc32[, ids], sequence_id, offset. Null
    and empty texts are the end id alone (no piece without an end id). Repeated
    rows are packed as often as they occur; which of equal pieces goes where is
    decided by id, piece and ids. A text of any length is encoded whole and cut.
    An empty table gives no rows. Other columns of docs are left out. An id whose
    name is one of those returned comes back with `_id` after its name.
    """
    if id_col in ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "rank", "__bucket", "__base", "__row"):
        out = pack(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")), vocabulary_path, capacity, end_id, "__id", "__text", with_ids)
        return out.toDF(f"{id_col}_id" if id_col in out.columns else id_col, *out.columns[1:])
    held = materialise(pieces(docs, vocabulary_path, capacity, end_id, id_col, text_col, with_ids))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = segments(plan_sequences(counts, capacity))
    starts, firsts, offsets = (table[:, 0] << 44) + table[:, 1], table[:, 2] - table[:, 1], table[:, 3]
    buckets = max(8, -(-sum(counts.values()) // BUCKET_ROWS))
    dealt = held.withColumn("__bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = dealt.withColumn("__row", F.row_number().over(inside) - 1).join(base, ["length", "__bucket"])
    names = held.columns
    ranked = ranked.select(*names, (F.col("__base") + F.col("__row")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy())
            at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(names))] + [pa.array(firsts[at] + rank), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
