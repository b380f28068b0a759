"""Token-id shards stored as wavelet matrices.

A shard file holds the ids of many documents, in document order, as one
wavelet matrix: bit-plane k has bit k (from the top) of every id, in the order
that stable partitions by the planes above have left. Rank over a plane is a
count kept for each 512 bits plus a popcount; select is a binary search in
those counts. The planes are cut into blocks of 64 KiB, each compressed alone,
so a lookup only opens the blocks that it visits.

Layout (little-endian): magic `GLWM0001`, u32 header length, header JSON
(n, bits, zeros of each plane, [offset, length] of every block, of the rank
tables and of the document table), then the blocks.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_uri, slices, texts, tidy
from .tokens import encoder, with_end

MAGIC = b"GLWM0001"
BLOCK = 1 << 16
RANK_BITS = 512
STEP = 1 << 16
SHARD_BYTES = 32 << 20  # of text: a task holds a shard's ids whole


def split_by(seq: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
    """Elements without the bit, then those with it, each in order. Steps are small enough for a core's cache."""
    out, a, b = np.empty_like(seq), 0, zeros
    for i in range(0, len(seq), STEP):
        part, mask = seq[i : i + STEP], one[i : i + STEP]
        high = np.flatnonzero(mask)
        k = len(part) - len(high)
        np.take(part, np.flatnonzero(~mask), out=out[a : a + k], mode="clip")
        np.take(part, high, out=out[b : b + len(high)], mode="clip")
        a, b = a + k, b + len(high)
    return out


def merge_by(value: np.ndarray, one: np.ndarray, zeros: int, bit: int) -> np.ndarray:
    """Undo split_by, and set the bit."""
    out, a, b, mark = np.empty_like(value), 0, zeros, value.dtype.type(bit)
    for i in range(0, len(value), STEP):
        part, mask = out[i : i + STEP], one[i : i + STEP]
        high = np.flatnonzero(mask)
        k = len(part) - len(high)
        part[np.flatnonzero(~mask)] = value[a : a + k]
        part[high] = value[b : b + len(high)] | mark
        a, b = a + k, b + len(high)
    return out


class WaveletMatrix:
    """access, rank, count, select and whole decoding over one encoded shard."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 8)
        self.head: dict[str, Any] = json.loads(data[12 : 12 + size])
        self.data, self.base = data, 12 + size
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self._block = lru_cache(maxsize=64)(self._read_block)
        self._ranks: dict[int, np.ndarray] = {}

    @staticmethod
    def encode(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, unnamed: int = 0) -> bytes:
        """Bytes of a shard: ids uint32, and the id (int64) and length of each document; the first `unnamed` documents have no id."""
        if len(ids) >= 1 << 32:
            raise ValueError("a shard's rank tables count to 2^32")
        top = int(ids.max()) if len(ids) else 0
        bits = max(1, top.bit_length())
        seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        parts: list[bytes] = []
        at = 0
        head: dict[str, Any] = {"n": len(ids), "bits": bits, "unnamed": unnamed, "zeros": [], "planes": [], "ranks": []}

        def put(blob: bytes) -> list[int]:
            nonlocal at
            import zstandard

            squeezed = zstandard.ZstdCompressor(level=1).compress(blob)
            parts.append(squeezed)
            at += len(squeezed)
            return [at - len(squeezed), len(squeezed)]

        for k in range(bits - 1, -1, -1):
            one = (seq & seq.dtype.type(1 << k)) != 0
            plane = np.packbits(one, bitorder="little")
            padded = np.concatenate([plane, np.zeros(-len(plane) % 64, np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(padded).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.int64)
            head["planes"].append([put(plane[i : i + BLOCK].tobytes()) for i in range(0, len(plane), BLOCK)])
            head["ranks"].append(put(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()))
            head["zeros"].append(len(one) - int(np.count_nonzero(one)))
            seq = split_by(seq, one, head["zeros"][-1])
        head["docs"] = put(np.stack([doc_ids.astype("<i8"), lengths.astype("<i8")]).tobytes())
        text = json.dumps(head, separators=(",", ":")).encode()
        return b"".join([MAGIC, struct.pack("<I", len(text)), text, *parts])

    def _open(self, where: list[int]) -> bytes:
        import zstandard

        at = self.base + where[0]
        return zstandard.ZstdDecompressor().decompress(self.data[at : at + where[1]])

    def _read_block(self, level: int, number: int) -> np.ndarray:
        return np.frombuffer(self._open(self.head["planes"][level][number]), np.uint8)

    def _rank_table(self, level: int) -> np.ndarray:
        if level not in self._ranks:
            self._ranks[level] = np.frombuffer(self._open(self.head["ranks"][level]), "<u4").astype(np.int64)
        return self._ranks[level]

    def _bytes(self, level: int, start: int, stop: int) -> np.ndarray:
        found = [self._block(level, b)[max(0, start - b * BLOCK) : stop - b * BLOCK] for b in range(start // BLOCK, -(-stop // BLOCK))]
        return np.concatenate(found) if found else np.zeros(0, np.uint8)

    def _ones(self, level: int, i: int) -> int:
        """Set bits among the first i of a plane."""
        whole, rest = divmod(i, RANK_BITS)
        count = int(self._rank_table(level)[whole])
        if rest:
            start = whole * RANK_BITS // 8
            bits = np.unpackbits(self._bytes(level, start, start + -(-rest // 8)), bitorder="little")[:rest]
            count += int(bits.sum())
        return count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value in a plane."""
        table = self._rank_table(level)
        before = table if bit else np.minimum(np.arange(len(table)) * RANK_BITS, self.n) - table
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * RANK_BITS
        bits = np.unpackbits(self._bytes(level, start // 8, min(start // 8 + RANK_BITS // 8, -(-self.n // 8))), bitorder="little")[: self.n - start]
        return start + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token occurs at places lo..hi-1."""
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._range(token, min(lo, hi), hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of the token."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the partitions are undone from the last plane to the first."""
        value = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = self._bytes(level, 0, -(-self.n // 8))
            one = np.unpackbits(plane, bitorder="little")[: self.n].view(bool)
            value = merge_by(value, one, self.zeros[level], 1 << (self.bits - 1 - level))
        return value.astype(np.uint32)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and number of ids of each document, in order."""
        both = np.frombuffer(self._open(self.head["docs"]), "<i8").reshape(2, -1)
        return both[0], both[1]


def write_shards(docs: DataFrame, path: str, vocabulary_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every text and write shard files in ascending id order below `path`.

    Returns the manifest (shard, file, n_docs, n_tokens). A file is written under
    a temporary name and then renamed, and its content only depends on its
    rows, so a repeated task replaces it by the same bytes. A shard holds about
    SHARD_BYTES of text, or one longer text. Null texts count as empty (the end
    id only). Rows of one id follow each other by their first 64 characters and
    then by a hash, so that an id, or no id, that many rows share is cut
    anywhere. Null ids come first; they are written as the least 64-bit integer
    and counted, so no id is taken for them. No rows, no files. Other columns
    are not read, whatever their names.
    """
    spark = docs.sparkSession
    text, own = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.coalesce(own, F.lit(-(1 << 63))).alias("id"), text.alias("text"), own.isNotNull().alias("named"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    place = ["named", "id", F.substring("text", 1, 64), F.xxhash64("text"), "tie"]
    dealt = rows.repartitionByRange(n, *place).sortWithinPartitions(*place).select("id", "text", "named")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(vocabulary_path)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        unnamed = 0
        for b in batches:
            doc_ids.append(b.column(0).to_numpy())
            unnamed += len(b.column(2)) - b.column(2).true_count
            for first, stop in slices(b.column(1), 1 << 20):
                found, n = with_end(*encode(texts(b.column(1), first, stop)), end_id)
                ids.append(found.astype(np.uint16) if not len(found) or found.max() < 1 << 16 else found)
                lengths.append(n)
        if not lengths:
            return
        whole = np.concatenate(ids)
        ids.clear()
        counts = np.concatenate(lengths)
        blob = WaveletMatrix.encode(whole, np.concatenate(doc_ids), counts, unnamed)
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}.wvm"
        temporary = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temporary) as out:
            out.write(blob)
        fs.move(temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (name, pa.string()), (len(counts), pa.int64()), (len(whole), pa.int64()))], names=["shard", "file", "n_docs", "n_tokens"])

    return materialise(dealt.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long"))


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32, shard, place, named); unnamed documents have the least 64-bit integer as doc_id."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).select("shard", "file", "base")
    n = max(1, manifest.count())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, base = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(f"{base}/{row['file']}") as f:
                    shard = WaveletMatrix(f.read())
                doc_ids, lengths = shard.documents()
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids), pa.array(row["base"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(np.arange(len(ends))), pa.array(np.arange(len(ends)) >= shard.head["unnamed"])],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place", "named"],
                )

    return offsets.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, place long, named boolean")


def token_shards(docs: DataFrame, vocabulary_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards into the shared folder and read the documents back from the files."""
    path = shared_uri(docs.sparkSession)
    return read_shards(write_shards(docs, path, vocabulary_path, end_id, id_col, text_col), path)
