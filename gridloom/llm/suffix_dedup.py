"""Removal of bytes in strings that start in an earlier document too, by suffix arrays.

Anchors: of every `length` bytes of a text, the least hash of GRAM bytes is an
anchor, so equal strings of that length have equal anchors at equal places.
Only anchors whose GRAM bytes occur in two documents matter; each sends the bytes
around it (its context: all that a string over it can reach) to a bucket.

In a bucket the contexts of an anchor, to its right and, reversed, to its left,
are strings over symbols of SYMBOL bytes in byte order. One suffix array over all of
them, built by linear grouping, puts them in order; common prefixes of
neighbours then say which strings of `length` bytes are equal: those whose
right parts and left parts fall into one interval each. The least document of
each such class decides, and each anchor answers with one covered range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, tidy, tidy_group
from .gsaca import suffix_array
from .repeats import NARROW, REPLY, REPLY_SCHEMA, body_slices, buckets_for, exact_copies, gathered, held_texts, low, mix, repeated_keys, replies, reply_table, runs_of, unpack

GRAM = 16
SYMBOL = 12
CONTEXT_BYTES = 6 << 20  # bytes of text for each bucket of contexts: a suffix array in Python lists is large
BASE = 0x5851F42D4C957F2D
PAD = 0xFF  # never a byte of UTF-8
PLACES = 5  # places of a string over its anchor that are looked at together


def joined(batch: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer with `reach` pad bytes around each text, where each text begins, its length)."""
    pad = b"\xff" * reach
    sizes = np.fromiter(map(len, batch), np.int64, len(batch))
    return np.frombuffer(pad + pad.join(batch) + pad, np.uint8), reach + np.cumsum(sizes + reach) - sizes - reach, sizes


def _lanes(buf: np.ndarray, n: int) -> np.ndarray:
    """Little-endian 64-bit value at each of the first n bytes."""
    return np.ndarray((n,), "<u8", buf.tobytes(), 0, (1,)).astype(np.uint64)


def anchors(buf: np.ndarray, begin: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in buf, hashes of their GRAM bytes) of the anchors of all texts.

    Ties go to the leftmost place. A text shorter than `length` has none.
    """
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lanes = _lanes(buf, len(buf) - 7)
    h = mix(lanes[:n] ^ mix(lanes[8 : 8 + n] + np.uint64(0x9E3779B97F4A7C15)))
    del lanes
    width = length - GRAM + 1
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    whole = -(-n // width) * width
    rows = np.full(whole + width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = key
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & ((np.uint64(1) << bits) - np.uint64(1)) if n >= width else np.zeros(0, np.uint64)
    windows = np.maximum(sizes - length + 1, 0)
    starts = np.repeat(begin, windows) + spread(windows)
    mark = np.zeros(n, bool)
    mark[least[starts].astype(np.int64)] = True
    at = np.flatnonzero(mark)
    return at, h[at]


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for lane in wide.view(np.uint64).T:
        h = mix(h * np.uint64(BASE) + lane + np.uint64(1))
    return h


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct row of bytes, which of them each row is). Rows are compared byte by byte; a hash only brings equal ones together."""
    h = _row_hash(rows)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not (rows[order[1:][same]] == rows[order[:-1][same]]).all():  # a collision
        _, first, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        return first, inverse.ravel()
    fresh = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    inverse = np.empty(len(rows), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return order[fresh], inverse


def _names(rows: np.ndarray, group: np.ndarray | None) -> np.ndarray:
    """Rank of each row of bytes among all of them, within its group if there is one."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    lanes = list(wide.view(">u8").astype(np.uint64).T)
    keys = ([] if group is None else [group]) + lanes
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(rows), bool)
    for key in keys:
        fresh[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _ranked(strings: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (group, rows of bytes): the rank of each row, and the common prefix of each rank with the one before.

    Ranks are by group and then by bytes; the common prefix is -1 at a group's
    first rank. A row is a string of symbols of SYMBOL bytes; its first symbol
    also holds its group, so strings of a group are neighbours. All strings of
    all sets are joined and share one suffix array.
    """
    sets, parts, at, base = [], [], 0, 0
    for group, rows in strings:
        chosen, inverse = _distinct(np.concatenate([np.ascontiguousarray(group.astype("<i8")).view(np.uint8).reshape(-1, 8), rows], axis=1))
        own = rows[chosen]
        columns = [own[:, k : k + SYMBOL] for k in range(0, own.shape[1], SYMBOL)]
        later = _names(np.concatenate([np.pad(c, ((0, 0), (0, SYMBOL - c.shape[1]))) for c in columns[1:]]), None).reshape(len(columns) - 1, -1) if len(columns) > 1 else np.zeros((0, len(own)), np.int64)
        first = _names(columns[0], group[chosen])
        string = np.concatenate([first[None], later]).T + base
        base = int(string.max(initial=base)) + 1
        sets.append((group[chosen], own, inverse.ravel(), at + np.arange(len(string)) * string.shape[1]))
        at += string.size
        parts.append(string.ravel())
    order = suffix_array(np.concatenate(parts))
    rank_of = np.empty(len(order), np.int64)
    rank_of[order] = np.arange(len(order))
    out = []
    for group, own, inverse, begin in sets:
        by_rank = np.argsort(rank_of[begin])
        place = np.empty(len(begin), np.int64)
        place[by_rank] = np.arange(len(begin))
        rows, groups = own[by_rank], group[by_rank]
        common = np.full(len(rows), -1, np.int64)
        if len(rows) > 1:
            unlike = rows[1:] != rows[:-1]
            common[1:] = np.where(groups[1:] == groups[:-1], np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1]), -1)
        out.append((place[inverse], common))
    return out


def _pairs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Ranges as rows of eight bytes."""
    return np.ascontiguousarray(np.stack([lo, hi], axis=1).astype("<u4")).view(np.uint8).reshape(-1, 8)


def _meet(context: np.ndarray, reach: int) -> np.ndarray:
    """Which contexts may share a string with another: they share the bytes that all strings of some neighbouring places have.

    A context that meets no other there has no string in common with any, so it
    needs no order. Equal hashes bring no error: they only let a context in.
    """
    found = np.zeros(len(context), bool)
    for first in range(0, reach + 1, PLACES):
        last = min(first + PLACES - 1, reach)  # a string with o bytes before the anchor has reach - o after it
        h = _row_hash(context[:, reach - first : reach + GRAM + reach - last])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
    return found


def covered_ranges(context: np.ndarray, doc: np.ndarray, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry (document order `doc`, context number `which`): the covered range, relative to its anchor.

    context: the anchor's own bytes and those around it, distinct rows. An entry
    whose strings all are new has an empty range (0, 0).
    """
    width = length - GRAM + 1
    reach = width - 1
    _, gram = _distinct(np.ascontiguousarray(context[:, reach : reach + GRAM]))
    least = np.full(len(gram), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    low = np.full(len(doc), -1, np.int64)  # least and greatest number of bytes before the anchor, of the repeated strings
    high = np.full(len(doc), -1, np.int64)
    inside = context != PAD
    before, after = inside[:, :reach].sum(axis=1), inside[:, reach + GRAM :].sum(axis=1)
    # contexts that are alone with their gram need no order: only their own copies repeat them
    busy = np.flatnonzero(np.bincount(gram)[gram] > 1) if len(gram) else gram
    busy = busy[_meet(context[busy], reach)]
    best = np.repeat(least[:, None], width, axis=1)
    if len(busy):
        rows, own = context[busy], gram[busy]
        (right, right_common), (left, left_common) = _ranked([(own, rows[:, reach + GRAM :]), (own, rows[:, reach - 1 :: -1] if reach else rows[:, :0])])
        for o in range(width):
            right_id, left_id = np.cumsum(right_common < reach - o)[right], np.cumsum(left_common < o)[left]
            key = right_id * (len(left_common) + 1) + left_id
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            smallest = np.minimum.reduceat(least[busy][order], begin)
            best[busy[order], o] = np.repeat(smallest, np.diff(np.concatenate([begin, [len(order)]])))
    for o in range(width):
        fits = (before >= o) & (after >= reach - o)
        hit = fits[which] & (best[which, o] < doc)
        low = np.where(hit & (low < 0), o, low)
        high = np.where(hit, o, high)
    some = low >= 0
    return np.where(some, -high, 0), np.where(some, length - low, 0)


def repeated_bytes(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay).

    A byte goes when a string of `length` bytes over it also starts in a row with
    a smaller id. Rows of one id, repeated rows among them, don't repeat each
    other; null ids are smaller than any other; null and empty texts have no
    bytes; an empty table gives no rows. A text of any length is read whole and
    its contexts are dealt over all buckets. Other columns of docs are not read,
    whatever their names. `length` is at least GRAM + 1.

    Exact copies are grouped first: later copies go whole, the first stands for
    all. Cut characters make `kept` invalid UTF-8, so it is binary.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    reach = length - GRAM
    kind = docs.schema[id_col].dataType.simpleString()
    held = held_texts(docs, id_col, text_col)
    buckets, context_buckets = buckets_for(held), buckets_for(held, CONTEXT_BYTES)

    def grams(_: dict[str, pa.Array], batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf, begin, sizes = joined(batch, reach)
        at, h = anchors(buf, begin, sizes, length)
        return np.searchsorted(begin, at, "right") - 1, h, np.zeros(len(at), bool)

    flagged = gathered(repeated_keys(held, grams, buckets, across_rows=True, width=NARROW), "grams", NARROW)
    copies = exact_copies(held).join(held.select("row_key", "place").distinct(), "row_key").where("place > first").select("row_key", F.lit(True).alias("copy"))
    planned = held.join(flagged, "row_key", "left").join(copies, "row_key", "left").where("copy is null and grams is not null")
    names = ["bucket", *REPLY, "contexts", "rows", "places", "asks"]

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of a slice's anchors by bucket; of equal contexts only the slice's first document asks."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for b in batches:
            for columns, batch in body_slices(b):
                keys, place = (columns[c].to_numpy() for c in ("row_key", "place"))
                buf, begin, sizes = joined(batch, reach)
                found, hashes = anchors(buf, begin, sizes, length)
                bounds = np.searchsorted(found, np.concatenate([begin, [len(buf)]]))
                shared = np.zeros(len(found), bool)
                for k, blob in enumerate(columns["grams"].to_pylist()):
                    own = slice(bounds[k], bounds[k + 1])
                    shared[own] = np.isin(low(hashes[own], NARROW), unpack(blob, NARROW))
                if not shared.any():
                    continue
                doc = np.repeat(np.arange(len(batch)), np.diff(bounds))[shared]
                at = found[shared] - begin[doc]
                view = sliding_window_view(buf, 2 * reach + GRAM)
                context = view[at + begin[doc] - reach]
                h = _row_hash(context[:, reach : reach + GRAM])
                first, inverse = _distinct(context)
                least = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, place[doc])
                asks = place[doc] == least[inverse]
                out: dict[str, list] = {x: [] for x in names}

                def put(out: dict[str, list] = out, **values: object) -> None:
                    for x in names:
                        out[x].append(values.get(x))

                # the others' contexts are whole in an earlier document
                size = np.fromiter(map(len, batch), np.int64, len(batch))
                lo, hi = np.maximum(at - reach, 0)[~asks], np.minimum(at + GRAM + reach, size[doc])[~asks]
                for part, *rest in replies(keys[doc[~asks]], _pairs(lo, hi), context_buckets):
                    put(bucket=part, part=part, **dict(zip(REPLY[1:], rest, strict=True)))
                bucket = (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(context_buckets)).astype(np.int64)
                order = np.argsort(bucket[first], kind="stable")
                number = np.empty(len(first), np.int64)
                number[order] = np.arange(len(first))
                edges = runs_of(bucket[first][order])  # only buckets that a slice has something for
                entry = np.flatnonzero(asks)
                entry = entry[np.argsort(bucket[entry], kind="stable")]
                own_buckets = bucket[entry]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    chosen = first[order[lo:hi]]
                    k = int(bucket[chosen[0]])
                    own = entry[np.searchsorted(own_buckets, k) : np.searchsorted(own_buckets, k, "right")]
                    used, code = np.unique(doc[own], return_inverse=True)
                    triple = np.stack([number[inverse[own]] - lo, code.ravel(), at[own]], axis=1)
                    put(bucket=k, contexts=squeeze(context[chosen].tobytes()), rows=keys[used].tobytes(), places=place[used].tobytes(), asks=triple.astype("<u4").tobytes())
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
                yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(names, kinds, strict=True)], names=names)

    @tidy_group
    def answer(group: pa.Table) -> pa.Table:
        done, sent = group.filter(pc.is_valid(group["part"])), group.filter(pc.is_null(group["part"]))
        out = [tuple(r.values()) for r in done.select(REPLY).to_pylist()]
        if len(sent):
            import zstandard

            expand = zstandard.ZstdDecompressor().decompress
            context, row, place, which, at, shift = [], [], [], [], [], 0
            for c, r, p, e in zip(*(sent[x].to_pylist() for x in names[5:]), strict=True):
                e = np.frombuffer(e, "<u4").reshape(-1, 3).astype(np.int64)
                context.append(np.frombuffer(expand(c), np.uint8).reshape(-1, 2 * reach + GRAM))
                which.append(e[:, 0] + shift)
                row.append(np.frombuffer(r, np.int64)[e[:, 1]])
                place.append(np.frombuffer(p, np.int64)[e[:, 1]])
                at.append(e[:, 2])
                shift += len(context[-1])
            context, row, place, which, at = (np.concatenate(x) for x in (context, row, place, which, at))
            # equal contexts of several slices are one
            first, inverse = _distinct(context)
            low, high = covered_ranges(context[first], place, inverse[which], length)
            some = high > low
            out += replies(row[some], _pairs((at + low)[some], (at + high)[some]), context_buckets)
        return reply_table(out)

    sent = planned.select("row_key", "place", "size", "body", "grams").mapInArrow(send, "bucket int, " + REPLY_SCHEMA + ", contexts binary, rows binary, places binary, asks binary")
    ranges = gathered(sent.groupBy("bucket").applyInArrow(answer, REPLY_SCHEMA), "ranges", 8)
    ready = held.join(ranges, "row_key", "left").join(copies, "row_key", "left").select("id", "size", "body", "ranges", F.coalesce("copy", F.lit(False)).alias("copy"))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for columns, batch in body_slices(b):
                rows = []
                for text, blob, copy in zip(batch, columns["ranges"].to_pylist(), columns["copy"].to_pylist(), strict=True):
                    removed, spans, kept = 0, 0, text
                    if copy and len(text) >= length:
                        removed, spans, kept = len(text), 1, b""
                    elif blob:
                        edge = np.zeros(len(text) + 1, np.int64)
                        pair = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
                        np.add.at(edge, pair[:, 0], 1)
                        np.add.at(edge, pair[:, 1], -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                        removed, spans = int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).view(np.int8)) == 1).sum())
                    rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([columns["id"], *values], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return ready.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
