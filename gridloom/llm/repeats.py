"""Which keys (64-bit hashes) occur more than once in a corpus, told to the rows that hold them.

Rows send their keys in packed blobs: each Arrow slice of rows is summed up
first, so a key that occurs a million times in a slice is one entry, and then
split over buckets by another hash. A bucket answers with the repeated keys
of each row. No step has one record for each key, and none depends on how often
a key occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices, tidy, tidy_group

SLICE = 1 << 20
HELD_BYTES = 96 << 20  # of text in a bucket of the held table
MOST_BUCKETS = 100_000  # more than Spark allows by default would fail
NARROW = 6  # bytes of a key where a rare false match does no harm
MANY = np.uint32(0xFFFFFFFF)
Keys = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def range_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[first:last] for each pair, mixed; equal contents have equal hashes."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), BASE), out=total[1:])
    back = powers(len(values) + 1, INVERSE)
    return mix((total[last] - total[first]) * back[first])


def word_places(batch: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(texts joined by spaces, begin and end of each word there, number of words of each text)."""
    sizes = np.fromiter(map(len, batch), np.int64, len(batch))
    whole = b" ".join(batch) + b" "
    inside = np.concatenate([[False], ~SPACE[np.frombuffer(whole, np.uint8)]])
    edges = np.diff(inside.view(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    per = np.diff(np.concatenate([[0], np.searchsorted(first, np.cumsum(sizes + 1))]))
    return whole, first, last, per


def words_of(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) for texts joined in one buffer."""
    whole, first, last, per = word_places(batch)
    return range_hashes(_TABLE[np.frombuffer(whole, np.uint8)], first, last), per


def buckets_for(held: DataFrame, bytes_each: int = 24 << 20) -> int:
    """Number of buckets, in proportion to the bytes of text."""
    total = held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(4, -(-int(total) // bytes_each))


def exact_copies(held: DataFrame) -> DataFrame:
    """(row_key, first, least) of the rows whose text others have too: the least place, and the least row_key."""
    content = held.where("size > 0").select("row_key", "place", "digest", "size")
    same = content.groupBy("digest", "size").agg(F.count("*").alias("copies"), F.min("place").alias("first"), F.min("row_key").alias("least")).where("copies > 1")
    return content.join(same, ["digest", "size"]).select("row_key", "first", "least").distinct()


def held_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, place, digest, size, body): a bucketed table of compressed texts in the shared folder.

    row_key is a number of its own for each row (the scan's task, then the row in
    it), fixed when the table is written; place is the id for ordering (null:
    least), digest a 128-bit hash of the text, size its bytes, body the text
    packed by zstd. Texts are dealt by row_key once; later joins on row_key leave
    them where they are. The table's entry in the session's catalog is removed at
    once: the returned frame reads the files.
    """
    import zstandard
    from xxhash import xxh3_128_digest

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()[0]
    n = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // HELD_BYTES)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            place = b.column(1).fill_null(-(1 << 63))
            for start, stop in slices(b.column(2), 4 * SLICE):
                texts = [x or b"" for x in b.column(2).slice(start, stop - start).cast(pa.binary()).to_pylist()]
                keys = np.arange(number, number + len(texts))
                number += len(texts)
                columns = [b.column(0).slice(start, stop - start), pa.array(keys, pa.int64()), place.slice(start, stop - start), pa.array(map(xxh3_128_digest, texts), pa.binary()), pa.array(map(len, texts), pa.int64()), pa.array(map(squeeze, texts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row_key", "place", "digest", "size", "body"])

    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{id_col}`").cast("long").alias("__place"), F.col(f"`{text_col}`"))
    packed = source.mapInArrow(run, f"id {kind}, row_key long, place long, digest binary, size long, body binary")
    path = shared_dir(spark)
    name = "gridloom_" + path.rpartition("-")[2]
    packed.repartition(n, "row_key").write.bucketBy(n, "row_key").sortBy("row_key").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files have a path of their own and stay
    return held


def bodies(column: pa.Array) -> list[bytes]:
    """The texts of a column of bodies."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


def body_slices(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, pa.Array], list[bytes]]]:
    """Columns and texts of parts of a batch, of about SLICE bytes of text each."""
    sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        part = batch.slice(start, stop - start)
        columns = {f.name: part.column(k) for k, f in enumerate(part.schema)}
        yield columns, bodies(columns["body"])
        start = stop


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    return keys.tobytes() if width == 8 else np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(blob: bytes, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(blob, np.uint64)
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def low(keys: np.ndarray, width: int) -> np.ndarray:
    """What `width` bytes keep of keys."""
    return keys if width == 8 else keys & np.uint64((1 << 8 * width) - 1)


def runs_of(values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal neighbours."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


REPLY = ["part", "ids", "counts", "entries"]
REPLY_SCHEMA = "part int, ids binary, counts binary, entries binary"


def replies(row: np.ndarray, entries: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Entries (rows of bytes) for rows, packed by row_key modulo parts: (part, row_keys, how many each, entries)."""
    part = row % parts
    order = np.lexsort((row, part))
    row, part, entries = row[order], part[order], entries[order]
    out, cuts = [], runs_of(part)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        edges = runs_of(row[lo:hi])
        out.append((int(part[lo]), row[lo:hi][edges[:-1]].tobytes(), np.diff(edges).astype("<u4").tobytes(), entries[lo:hi].tobytes()))
    return out


def gathered(answers: DataFrame, name: str, width: int) -> DataFrame:
    """(row_key, name): all entries of each row, of `width` bytes each; one record for each row that has any."""

    @tidy_group
    def merge(group: pa.Table) -> pa.Table:
        row, parts = [], []
        for ids, counts, entries in zip(*(group[c].to_pylist() for c in REPLY[1:]), strict=True):
            row.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, "<u4")))
            parts.append(np.frombuffer(entries, np.uint8).reshape(-1, width))
        row, all_ = np.concatenate(row), np.concatenate(parts)
        order = np.argsort(row, kind="stable")
        row, all_ = row[order], all_[order]
        cuts = runs_of(row)
        blobs = [all_[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"row_key": pa.array(row[cuts[:-1]], pa.int64()), name: pa.array(blobs, pa.binary())})

    return answers.groupBy("part").applyInArrow(merge, f"row_key long, {name} binary")


def key_bytes(keys: np.ndarray, width: int) -> np.ndarray:
    """Keys as rows of their low `width` bytes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def repeated_keys(rows: DataFrame, keys: Keys, buckets: int, across_rows: bool = False, width: int = 8) -> DataFrame:
    """Answers for gathered(): the keys of each row that occur again, `width` bytes of each.

    rows: held_texts and any further columns. keys(columns, texts) gives arrays
    (number of the text, key, many); an entry with `many` counts twice. With
    across_rows a key must occur in two rows; else twice anywhere.
    """
    names = ["bucket", *REPLY, "rows", "which", "keys"]

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for columns, texts in body_slices(b):
                own = columns["row_key"].to_numpy()
                which, key, many = keys(columns, texts)
                if not len(key):
                    continue
                order = np.lexsort((which, key))
                which, key, many = which[order], key[order], many[order]
                if across_rows:
                    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (which[1:] != which[:-1])])
                    which, key, many = which[fresh], key[fresh], many[fresh]
                bounds = runs_of(key)
                begin, count = bounds[:-1], np.diff(bounds)
                again = (count > 1) | np.logical_or.reduceat(many, begin)
                local = np.repeat(again, count)
                out: dict[str, list] = {n: [] for n in names}

                def put(out: dict[str, list] = out, **values: object) -> None:
                    for n in names:
                        out[n].append(values.get(n))

                row, found = own[which[local]], key[local]
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (found[1:] != found[:-1])]) if len(row) else np.zeros(0, bool)
                for part, *rest in replies(row[fresh], key_bytes(found[fresh], width), buckets):
                    put(bucket=part, part=part, **dict(zip(REPLY[1:], rest, strict=True)))
                key, which = key[begin], np.where(again, MANY, which[begin].astype(np.uint32))
                bucket = mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, key, which = bucket[order], low(key[order], width), which[order]
                cuts = runs_of(bucket)
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    used, place = np.unique(which[lo:hi], return_inverse=True)
                    single = used != MANY
                    ids = np.zeros(len(used), np.int64)
                    ids[single] = own[used[single]]
                    wide = len(used) >= 0xFFFF
                    code = np.where(single[place], place, int(MANY) if wide else 0xFFFF)
                    put(bucket=int(bucket[lo]), rows=ids.tobytes(), which=code.astype(np.uint32 if wide else np.uint16).tobytes(), keys=pack_keys(key[lo:hi], width))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, (pa.int32(), pa.int32(), *[pa.binary()] * 6), strict=True)], names=names)

    @tidy_group
    def answer(group: pa.Table) -> pa.Table:
        done, sent = group.filter(pc.is_valid(group["part"])), group.filter(pc.is_null(group["part"]))
        keys_, ids_, singles = [], [], []
        for ids, which, blob in zip(*(sent[n].to_pylist() for n in ("rows", "which", "keys")), strict=True):
            key = unpack_keys(blob, width)
            wide = len(which) == 4 * len(key)
            code = np.frombuffer(which, np.uint32 if wide else np.uint16)
            many = code == (MANY if wide else 0xFFFF)
            keys_.append(key)
            ids_.append(np.frombuffer(ids, np.int64)[np.where(many, 0, code)])
            singles.append(~many)
        out = [tuple(r.values()) for r in done.select(REPLY).to_pylist()]
        if keys_:
            key, row, single = np.concatenate(keys_), np.concatenate(ids_), np.concatenate(singles)
            order = np.argsort(key, kind="stable")
            key, row, single = key[order], row[order], single[order]
            like = np.concatenate([[False], key[1:] == key[:-1], [False]])
            hit = (like[1:] | like[:-1]) & single
            out += replies(row[hit], key_bytes(key[hit], width), buckets)
        return reply_table(out)

    sent = rows.mapInArrow(send, "bucket int, " + REPLY_SCHEMA + ", rows binary, which binary, keys binary")
    return sent.groupBy("bucket").applyInArrow(answer, REPLY_SCHEMA)


def reply_table(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(REPLY, columns, (pa.int32(), *[pa.binary()] * 3), strict=True)})


def unpack(blob: bytes | None, width: int = 8) -> np.ndarray:
    """Distinct keys of a row, sorted."""
    return np.unique(unpack_keys(blob, width)) if blob else np.zeros(0, np.uint64)
