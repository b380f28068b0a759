"""Removal of globally repeated runs of lines, found by content-defined chunks.

A text's lines are cut into chunks several times over. A rolling hash over the
hashes of the WINDOW lines before a gap and another over those after it, both
under the cutting's own seed, decide whether a chunk ends there, so insertions
and deletions only move the ends near them and a run of lines that several texts
share is cut alike in each. An end needs only one of its two sides: the run's own
lines can decide both its first and its last end, whatever stands around it.
Chunks have two lines or more.

Chunks are counted over the corpus by a 128-bit hash. Each occurrence but the
first (least id, then earliest in the text) is a hit. From each hit both texts are
compared on, line by line and both ways, as far as they agree, and that whole
run is removed from the later one. Lines are compared by 128-bit digests, and the
bytes of all lines of one digest have been compared before anything goes; should
two differ, all is decided by the bytes themselves.

One cutting alone misses most short runs in unlike texts; see README for how many
of all repeated runs the CUTTINGS together find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expanded, materialise_sparing, slices, squeezed, texts, tidy

WINDOW = 1
CUTTINGS = 8
SHARE = (7, 10)  # of the gaps, each side ends a chunk at so many
LEAST_LINES = 2
_WORD = (1 << 64) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of each hash, by seed."""
    h = (h ^ (h >> np.uint64(31))) * _ODD[0] + np.uint64(seed * int(_ODD[1]) & _WORD)
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    return h ^ (h >> np.uint64(32))


def _rolling(h: np.ndarray, position: np.ndarray, length: np.ndarray, ahead: bool) -> np.ndarray:
    """Hash of the WINDOW lines up to each line, or from it on, within its own text."""
    out = np.zeros(len(h), np.uint64)
    for k in range(WINDOW):
        weight = np.uint64(pow(int(_ODD[k % 3]), k // 3 + 1, 1 << 64))
        moved = np.roll(h, -k if ahead else k)
        inside = position + k < length if ahead else position >= k
        out += np.where(inside, moved * weight, np.uint64(0))
    return out


def chunk_ends(texts_lines: list[list[bytes]], seed: int) -> list[list[int]]:
    """End line (exclusive) of each chunk of each text under one seed.

    A chunk of fewer than LEAST_LINES lines goes on; only a text's last may be shorter.
    """
    from xxhash import xxh64_intdigest

    lengths = np.fromiter(map(len, texts_lines), np.int64, len(texts_lines))
    total = int(lengths.sum())
    h = np.fromiter((xxh64_intdigest(line) for lines in texts_lines for line in lines), np.uint64, total)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    position, length = np.arange(total) - first, np.repeat(lengths, lengths)
    part, of = np.uint64(SHARE[0]), np.uint64(SHARE[1])
    says = [(_mixed(_rolling(h, position, length, ahead), 2 * seed + ahead) >> np.uint64(8)) % of < part for ahead in (False, True)]
    # line k ends a chunk if the lines up to it say so, or those from the next one on
    cut = says[0] | np.append(says[1][1:], True) if total else says[0]
    cut[position + 1 == length] = True
    out: list[list[int]] = []
    start = 0
    for n in lengths.tolist():
        ends, last = [], 0
        for at in (np.flatnonzero(cut[start : start + n]) + 1).tolist():
            if at - last >= LEAST_LINES or at == n:
                ends.append(at)
                last = at
        out.append(ends)
        start += n
    return out


def pieces(texts_lines: list[list[bytes]]) -> list[list[tuple[int, int]]]:
    """For each text (first line, end line) of its chunks of all cuttings, each once, that hold two or more worded lines."""
    found: list[set[tuple[int, int]]] = [set() for _ in texts_lines]
    for seed in range(CUTTINGS):
        for own, ends in zip(found, chunk_ends(texts_lines, seed), strict=True):
            own.update(zip([0, *ends], ends, strict=False))
    out = []
    for lines, own in zip(texts_lines, found, strict=True):
        before = np.cumsum([0, *(bool(line.strip()) for line in lines)])
        out.append(sorted((a, e) for a, e in own if e - a >= LEAST_LINES and before[e] - before[a] >= LEAST_LINES))
    return out


Digest = Callable[[bytes], bytes]


def _digest(body: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(body)


def _itself(body: bytes) -> bytes:
    return body


def line_mark(line: bytes, digest: Digest) -> bytes:
    """A line's digest, with a first byte that tells whether it holds a word."""
    return (b"\1" if line.strip() else b"\0") + digest(line)


def grown(later: list[bytes], earlier: list[bytes], hits: list[tuple[int, int, int]], same: bool) -> list[tuple[int, int, int]]:
    """(first line, end line, shift) of the whole runs around hits (shift, first line, end line); lines are marks.

    Line k of later stands against line k - shift of earlier. A run begins and ends
    with a worded line, unless its hit does not. In one text (same) a hit that
    overlaps its first occurrence is none, and a run stops before it would. A hit
    whose lines don't agree is returned as (-1, -1, shift).
    """
    out: list[tuple[int, int, int]] = []
    for shift, first, end in sorted(hits):
        if same and end - first > shift:
            continue
        if out and out[-1][2] == shift and out[-1][0] <= first and end <= out[-1][1]:
            continue
        if later[first:end] != earlier[first - shift : end - shift]:
            out.append((-1, -1, shift))
            continue
        a, e = first, end
        fits = lambda: not same or e - a < shift  # noqa: B023, E731
        while a > 0 and a > shift and fits() and later[a - 1] == earlier[a - 1 - shift]:
            a -= 1
        while e < len(later) and e - shift < len(earlier) and fits() and later[e] == earlier[e - shift]:
            e += 1
        while a < first and later[a][:1] == b"\0":
            a += 1
        while e > end and later[e - 1][:1] == b"\0":
            e -= 1
        out.append((a, e, shift))
    return out


def extent(lines: list[bytes], run: dict) -> slice:
    """The lines of a run; one of a whole text's copy goes on to the text's first and last worded line."""
    if not run["whole"]:
        return slice(run["line"], run["until"])
    first = next(k for k, line in enumerate(lines) if line.strip())
    last = next(k for k in range(len(lines), 0, -1) if lines[k - 1].strip())
    return slice(min(first, run["line"]), max(last, run["until"]))


def _planned(docs: DataFrame, text_col: str, digest: Digest) -> DataFrame:
    """docs (with __key; texts packed) and two lists of runs of lines: __gone, to be removed, and __firsts, what they repeat.

    Both are null where a text shares no chunk.
    """
    kind = docs.schema["__key"].dataType.simpleString()
    bodies = docs.select("__key", F.col(f"`{text_col}`"))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(1)):
                several = [(k, t.split(b"\n")) for k, t in enumerate(texts(b.column(1), start, stop), start) if b"\n" in t]
                at, firsts, ends, hashes = [], [], [], []
                for (k, lines), own in zip(several, pieces([lines for _, lines in several]), strict=True):
                    at += [k] * len(own)
                    for first, end in own:
                        firsts.append(first)
                        ends.append(end)
                        hashes.append(digest(b"\n".join(lines[first:end])))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.binary())], names=["id", "line", "until", "hash"])

    @tidy
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(1)):
                found = [[line_mark(x, digest) for x in t.split(b"\n")] if b"\n" in t else None for t in texts(b.column(1), start, stop)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.array(found, pa.list_(pa.binary()))], names=["name", "marks"])

    found = materialise_sparing(bodies.mapInArrow(cut, f"id {kind}, line int, until int, hash binary"))
    again = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    shared = materialise_sparing(found.join(again, "hash"))
    firsts = shared.groupBy("hash").agg(F.min(F.struct("id", "line")).alias("first"))
    hits = shared.join(firsts, "hash").where(F.struct("id", "line") != F.col("first"))
    shift = F.col("line") - F.col("first.line")
    placed = hits.select("id", F.col("first.id").alias("fid"), shift.alias("shift"), "line", "until")
    # a copy of the whole text agrees with it to both ends: no lines need comparing
    copied = F.col("id.text") == F.col("fid.text")
    bounds = placed.where(copied & (F.col("id") != F.col("fid"))).groupBy("id", "fid").agg(F.min("line").alias("line"), F.max("until").alias("until"))
    copies = bounds.select(F.explode(F.array("id", "fid")).alias("id"), "line", "until", F.lit(True).alias("whole"), "fid").select("id", "line", "until", (F.col("id") != F.col("fid")).alias("gone"), "whole")
    pairs = materialise_sparing(placed.where(~copied | (F.col("id") == F.col("fid"))).groupBy("id", "fid").agg(F.collect_set(F.struct("shift", "line", "until")).alias("hits")))
    named = pairs.select("id").union(pairs.select("fid")).distinct()
    lines = bodies.mapInArrow(marks, f"name {kind}, marks array<binary>").where("marks is not null").join(named, F.col("name") == F.col("id"), "left_semi")
    lines = materialise_sparing(lines.groupBy("name").agg(F.first("marks").alias("marks")))  # rows that repeat an id and its text have the same marks
    sides = pairs.join(lines.select(F.col("name").alias("id"), F.col("marks").alias("later")), "id").join(lines.select(F.col("name").alias("fid"), F.col("marks").alias("earlier")), "fid")

    @tidy
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                later, earlier, own = (b.column(c)[k].as_py() for c in (2, 3, 4))
                runs = grown(later, earlier, [(h["shift"], h["line"], h["until"]) for h in own], b.column(0)[k] == b.column(1)[k])
                places = [(a, e) for a, e, _ in runs] + [(a - s, e - s) for a, e, s in runs if a >= 0]
                ids = pa.concat_arrays([b.column(0).take(pa.array([k] * len(runs), pa.int64())), b.column(1).take(pa.array([k] * (len(places) - len(runs)), pa.int64()))])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([a for a, _ in places], pa.int32()), pa.array([e for _, e in places], pa.int32()), pa.array([i < len(runs) for i in range(len(places))], pa.bool_())],
                    names=["id", "line", "until", "gone"],
                )

    runs = sides.select("id", "fid", "later", "earlier", "hits").mapInArrow(grow, f"id {kind}, line int, until int, gone boolean")
    runs = runs.withColumn("whole", F.lit(False)).union(copies)
    listed = lambda keep: F.collect_set(F.when(keep, F.struct("line", "until", "whole")))
    plan = runs.groupBy(F.col("id").alias("__id")).agg(listed(F.col("gone")).alias("__gone"), listed(~F.col("gone")).alias("__firsts"))
    return materialise_sparing(squeezed(docs, text_col).join(plan, F.col("__key") == F.col("__id"), "left").drop("__id"))


def _unlike(planned: DataFrame, text_col: str, digest: Digest) -> bool:
    """Whether two chunks or two lines have one digest and different bytes."""

    @tidy
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, _, found in expanded(b.column(0)):
                out: set[bytes] = set()  # equal lines of a slice are one
                for k, t in enumerate(found, start):
                    lines = t.split(b"\n")
                    for run in (*b.column(1)[k].as_py(), *b.column(2)[k].as_py()):
                        if run["line"] >= 0:
                            out.update(lines[extent(lines, run)])
                body = list(out)
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in body], pa.binary()), pa.array(body, pa.binary())], names=["hash", "body"])

    at_fault = planned.where(F.exists("__gone", lambda r: r["line"] < 0)).limit(1)
    if not at_fault.isEmpty():
        return True
    found = planned.where("__gone is not null").select(F.col(f"`{text_col}`"), "__gone", "__firsts").mapInArrow(marked, "hash binary, body binary")
    return not found.groupBy("hash").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").isEmpty()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = _digest) -> DataFrame:
    """docs with `text_col` rid of repeated runs of lines, and n_lines, n_removed_lines, n_removed_chunks.

    n_removed_chunks counts the stretches of removed lines. Each removed line is
    still there at an earlier place. Runs with fewer than two lines that hold a
    word are never removed, nor is any run's first occurrence, nor one that
    overlaps it.

    Null and empty texts stay as they are; an empty table gives an empty one. A
    text may be of any length: it is one row in each step. Rows are told apart by id
    and text, so ids may repeat or be null; rows that repeat an id and its text
    are one document and keep the same lines. Null ids come before all others. The
    three added columns replace columns of docs of those names; columns whose
    names begin with two underscores must not be `__key`, `__id`, `__gone` or
    `__firsts`.

    A chunk's rows are counted with partial sums and then marked by skew joins, so
    a run of lines that a third of all texts share is dealt over tasks. A pair of
    texts is compared once, each later text with the first of a chunk only.
    Should two unlike lines have one 128-bit digest, all is done anew with the
    bytes in its place.
    """
    docs = docs.drop("n_lines", "n_removed_lines", "n_removed_chunks")
    names = docs.columns
    text, own = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    keyed = docs.withColumn("__key", F.struct(own.isNotNull().alias("named"), own.alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("text")))
    ready = _planned(keyed, text_col, digest)
    if _unlike(ready, text_col, digest):
        ready = _planned(keyed, text_col, _itself)
    at_text = names.index(text_col)

    @tidy
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, found in expanded(b.column(at_text)):
                n = stop - start
                out: list[bytes | None] = []
                counts = np.zeros((3, n), np.int64)
                for k, t in enumerate(found):
                    gone = b.column(len(names))[start + k].as_py()
                    if t is not None:
                        counts[0, k] = t.count(b"\n") + 1
                        if gone:
                            lines = t.split(b"\n")
                            keep = np.ones(len(lines) + 1, bool)
                            for run in gone:
                                keep[extent(lines, run)] = False
                            counts[1, k] = (~keep).sum()
                            counts[2, k] = (keep[1:] & ~keep[:-1]).sum()
                            t = b"\n".join(line for line, kept in zip(lines, keep, strict=False) if kept)
                    out.append(t)
                columns = [pa.array(out, pa.binary()).cast(pa.string()) if c == at_text else b.column(c).slice(start, n) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c) for c in counts], names=[*names, "n_lines", "n_removed_lines", "n_removed_chunks"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return ready.select(*[F.col(f"`{c}`") for c in names], "__gone").mapInArrow(drop, f"{kinds}, n_lines long, n_removed_lines long, n_removed_chunks long")
