"""Repeated word windows by recompression.

Each text is a string of words. A round of recompression gives names to pairs,
and every third round to runs of equal symbols first: a bit of a symbol's own
hash says whether it can begin or end a pair in this round, so pairs never
overlap and a pair's fate depends on its two symbols alone. A name is the hash
of what it stands for, so names are global without a table of names: equal
substrings get equal symbols everywhere but near their ends. How far their ends
can reach is followed exactly, window by window, through all rounds.

A window can only occur twice if all symbols of its inner part do: the counts
of high-level symbols over the corpus leave few windows. Of a window's inner
symbols the least names the bucket where it is verified, so equal windows meet,
and windows that follow each other mostly go together: their words are sent
once, as a stretch. There, windows are compared word by word, exactly; a
collision of hashes costs time and changes nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, tidy, tidy_group
from .repeats import NARROW, REPLY, REPLY_SCHEMA, body_slices, buckets_for, exact_copies, gathered, held_texts, low, mix, range_hashes, repeated_keys, replies, reply_table, runs_of, unpack, word_places, words_of

RUNS_EVERY = 3  # rounds; a run at a window's end may go on outside, so naming runs more often leaves windows no inner part
KNOWN_BYTES = 16 << 20  # of stretches that a task remembers as sent with the note that they occur twice
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def rounds_for(width: int) -> int:
    """Rounds after which a symbol stands for about an eighth of a window on average: a round leaves three symbols of four."""
    return max(1, int(math.log(max(width, 8) / 8, 4 / 3)))


@dataclass
class Round:
    """How the symbols of one level became those of the next."""

    to: np.ndarray  # next symbol of each symbol
    run: bool
    left: np.ndarray  # pair rounds: whether a symbol can begin a pair


def compress(words: np.ndarray, begins: np.ndarray, rounds: int, trace: bool = False) -> tuple[np.ndarray, np.ndarray, list[Round]]:
    """(names, first word of each name, the rounds) of texts joined; begins marks each text's first word."""
    s, at, begin, history = words, np.arange(len(words)), begins, []
    for r in range(rounds if len(words) else 0):
        if r % RUNS_EVERY == 0:
            fresh = np.concatenate([[True], s[1:] != s[:-1]]) | begin
            first = np.flatnonzero(fresh)
            length = np.diff(np.concatenate([first, [len(s)]])).astype(np.uint64)
            names = np.where(length > 1, mix(s[first] ^ length * _Q), s[first])
            if trace:
                history.append(Round(np.cumsum(fresh) - 1, True, fresh))
            s, at, begin = names, at[fresh], begin[fresh]
        left = (mix(s + np.uint64((r + 1) * int(_P) % (1 << 64))) >> np.uint64(63)).astype(bool)
        pair = left[:-1] & ~left[1:] & ~begin[1:]
        fresh = np.concatenate([[True], ~pair])
        joined = np.concatenate([pair, [False]])
        follow = np.concatenate([s[1:], s[:1]])
        names = np.where(joined, mix(s * _P ^ mix(follow + _Q)), s)[fresh]
        if trace:
            history.append(Round(np.cumsum(fresh) - 1, False, left))
        s, at, begin = names, at[fresh], begin[fresh]
    return s, at, history


def inner(history: list[Round], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols p..q-1 of the last level that lie in words first..last-1 wherever these words occur."""
    p, q = first.copy(), last.copy()
    for step in history:
        live = p < q
        a, b = np.where(live, p, 0), np.where(live, q - 1, 0)
        if step.run:
            # the run at either end may go on outside
            na, nb = step.to[a] + 1, step.to[b]
        else:
            # a symbol that can't begin a pair may end one that began before the window; and the other way round
            na = step.to[a] + ~step.left[a]
            nb = step.to[b] + ~step.left[b]
        p, q = np.where(live, na, 0), np.where(live, nb, 0)
    return p, q


def _begins(per: np.ndarray, n: int) -> np.ndarray:
    begin = np.zeros(n, bool)
    starts = np.cumsum(per) - per
    begin[starts[per > 0]] = True
    return begin


def _windows(per: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every window."""
    n = np.maximum(per - width + 1, 0)
    text = np.repeat(np.arange(len(per)), n)
    starts = np.cumsum(per) - per
    return starts[text] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), text


def _cut_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return h if bits == 64 else h & np.uint64((1 << bits) - 1)


def candidates(batch: list[bytes], names: list[bytes | None], width: int, rounds: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, texts, least inner symbols) of the windows that can be repeated.

    names: the repeated symbols of each text. A window stays when all symbols of
    its inner part are repeated, or when it has no inner part; then a hash of
    its words stands for the symbol.
    """
    words, per = words_of(batch)
    words = _cut_bits(words, bits)
    s, at, history = compress(words, _begins(per, len(words)), rounds, trace=True)
    s = _cut_bits(s, bits)
    first, text = _windows(per, width)
    if not len(first):
        return first, text, np.zeros(0, np.uint64)
    p, q = inner(history, first, first + width)
    symbols = np.bincount(np.repeat(np.arange(len(per)), per)[at], minlength=len(per))
    single, lo = np.ones(len(s), bool), 0
    for blob, n in zip(names, symbols.tolist(), strict=True):
        if blob and n:
            single[lo : lo + n] = ~np.isin(low(s[lo : lo + n], NARROW), unpack(blob, NARROW))
        lo += n
    unlike = np.concatenate([[0], np.cumsum(single)])
    maybe = (p >= q) | (unlike[np.maximum(q, p)] == unlike[p])
    first, text, p, q = first[maybe], text[maybe], p[maybe], q[maybe]
    order = mix(s)
    least = np.where(p < q, np.iinfo(np.uint64).max, range_hashes(words, first, first + width))
    for k in range(int((q - p).max(initial=0))):
        inside = np.flatnonzero(p + k < q)
        least[inside] = np.minimum(least[inside], order[p[inside] + k])
    return first, text, least


@dataclass
class Stretches:
    """Runs of windows that follow each other and share a bucket: words first .. end - 1 of a text, and their bytes."""

    text: np.ndarray
    first: np.ndarray  # word of the text
    bucket: np.ndarray
    body: list[bytes]

    @classmethod
    def of(cls, batch: list[bytes], first: np.ndarray, text: np.ndarray, bucket: np.ndarray, width: int) -> "Stretches":
        """batch: texts whose words are joined by single spaces."""
        if not len(first):
            return cls(text, first, bucket, [])
        fresh = np.concatenate([[True], (first[1:] != first[:-1] + 1) | (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])])
        begin = np.flatnonzero(fresh)
        last = np.concatenate([begin[1:], [len(first)]]) - 1
        whole, a, b, per = word_places(batch)
        starts = np.cumsum(per) - per
        body = [whole[i:j] for i, j in zip(a[first[begin]].tolist(), b[first[last] + width - 1].tolist(), strict=True)]
        return cls(text[begin], first[begin] - starts[text[begin]], bucket[begin], body)


def repeated_in(stretches: list[bytes], many: np.ndarray, width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first word, end word) of the runs of windows that occur again among all stretches; one of `many` occurs twice by itself.

    Words get numbers from a dictionary and windows are compared number by
    number; hashes only bring equal ones together.
    """
    n = np.fromiter((s.count(b" ") + 1 for s in stretches), np.int64, len(stretches))
    number: dict[bytes, int] = {}
    words_in_turn = itertools.chain.from_iterable(s.split(b" ") for s in stretches)  # only distinct words are held
    ids = np.fromiter(map(number.setdefault, words_in_turn, itertools.count()), np.int64, int(n.sum()))
    del number
    per = n - width + 1
    own = np.repeat(np.arange(len(n)), per)
    at = np.repeat(np.cumsum(n) - n, per) + spread(per)
    h = _cut_bits(range_hashes(mix(ids.astype(np.uint64)), at, at + width), bits)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    for k in range(0, len(same), 1 << 14):
        some = np.flatnonzero(same[k : k + (1 << 14)]) + k
        words = np.arange(width)
        if not (ids[at[order[some]][:, None] + words] == ids[at[order[some + 1]][:, None] + words]).all():
            # a collision: such windows are ordered by their words
            order = np.lexsort([ids[at + w] for w in range(width)])
            same = np.ones(len(order) - 1, bool)
            for w in range(width):
                same &= ids[at[order[1:]] + w] == ids[at[order[:-1]] + w]
            break
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again |= many[own]
    place = spread(per)
    edge = again & np.concatenate([[True], ~again[:-1] | (own[1:] != own[:-1])]) if len(at) else again
    end = again & np.concatenate([~again[1:] | (own[1:] != own[:-1]), [True]]) if len(at) else again
    return own[edge], place[edge], place[end] + width


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges as rows of eight bytes."""
    return np.ascontiguousarray(np.stack([first, end], axis=1).astype("<u4")).view(np.uint8).reshape(-1, 8)


def repeated_windows(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, bits: int = 64) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words that stay, joined by a space).

    A word goes when a window of `width` words over it starts anywhere else too, in
    the same text or another. Null and empty texts have no words, an empty table
    gives no rows, and a repeated row is a second occurrence. A text of any
    length is read whole, and its stretches are dealt over all buckets. Other
    columns of docs are not read, whatever their names. Windows are
    compared by their words; `bits` of each hash are used before that, and fewer
    only cost time.

    Exact copies (equal 128-bit digests and sizes) are grouped first: one copy
    stands for all, and counts twice. A stretch that occurs twice in a slice of
    texts is answered there and sent once, and by a task that remembers it not
    again, so a passage that all texts share costs its bucket one entry a task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = held_texts(docs, id_col, text_col)
    buckets = buckets_for(held)
    rounds = rounds or rounds_for(width)

    def names(_: dict[str, pa.Array], batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, per = words_of(batch)
        s, at, _ = compress(_cut_bits(words, bits), _begins(per, len(words)), rounds)
        text = np.repeat(np.arange(len(per)), per)
        long = (per >= width)[text[at]]
        return text[at][long], _cut_bits(s, bits)[long], np.zeros(int(long.sum()), bool)

    columns = ["bucket", *REPLY, "texts", "rows", "places", "many"]

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        known: set[bytes] = set()
        known_bytes = 0
        for b in batches:
            for given, raw in body_slices(b):
                batch = [b" ".join(t.split()) for t in raw]
                own = given["row_key"].to_numpy()
                first, text, least = candidates(batch, given["names"].to_pylist(), width, rounds, bits)
                leads, self_ = given["least"].to_pylist(), own.tolist()
                copied = np.array([x is not None for x in leads], bool)
                tells = np.array([x is None or x == y for x, y in zip(leads, self_, strict=True)], bool)[text]
                bucket = (mix(least[tells] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(buckets)).astype(np.int64)
                found = Stretches.of(batch, first[tells], text[tells], bucket, width)
                if not found.body:
                    continue
                code: dict[bytes, int] = {}
                which = np.fromiter((code.setdefault(x, len(code)) for x in found.body), np.int64, len(found.body))
                count = np.bincount(which)
                one = np.full(len(count), -1)
                one[which[::-1]] = np.arange(len(which))[::-1]  # a stretch's first occurrence in the slice
                bodies = list(code)
                told_before = np.fromiter((x in known for x in bodies), bool, len(bodies))
                again = (count > 1) | told_before
                many = again | (np.bincount(which, copied[found.text]) > 0)
                out: dict[str, list] = {x: [] for x in columns}

                def put(out: dict[str, list] = out, **values: object) -> None:
                    for x in columns:
                        out[x].append(values.get(x))

                twice = np.flatnonzero(again[which] & ~copied[found.text])
                n = np.fromiter((found.body[k].count(b" ") + 1 for k in twice.tolist()), np.int64, len(twice))
                for part, *rest in replies(own[found.text[twice]], _ranges(found.first[twice], found.first[twice] + n), buckets):
                    put(bucket=part, part=part, **dict(zip(REPLY[1:], rest, strict=True)))
                for x in itertools.compress(bodies, many & ~told_before):
                    if known_bytes < KNOWN_BYTES:
                        known.add(x)
                        known_bytes += len(x)
                sent = np.flatnonzero(~told_before)
                sent = sent[np.argsort(found.bucket[one[sent]], kind="stable")]
                cuts = runs_of(found.bucket[one[sent]])
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    chosen = sent[lo:hi]
                    at = one[chosen]
                    put(
                        bucket=int(found.bucket[at[0]]), texts=squeeze(b"\n".join(bodies[k] for k in chosen.tolist())), rows=own[found.text[at]].tobytes(),
                        places=found.first[at].astype("<u4").tobytes(), many=many[chosen].tobytes(),
                    )
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
                yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(columns, kinds, strict=True)], names=columns)

    @tidy_group
    def answer(group: pa.Table) -> pa.Table:
        done, sent = group.filter(pc.is_valid(group["part"])), group.filter(pc.is_null(group["part"]))
        out = [tuple(r.values()) for r in done.select(REPLY).to_pylist()]
        if len(sent):
            import zstandard

            expand = zstandard.ZstdDecompressor().decompress
            stretches = [x for blob in sent["texts"].to_pylist() for x in expand(blob).split(b"\n")]
            row, place, many = (np.concatenate([np.frombuffer(x, t) for x in sent[c].to_pylist()]) for c, t in (("rows", np.int64), ("places", "<u4"), ("many", bool)))
            stretch, first, end = repeated_in(stretches, many, width, bits)
            asks = ~many[stretch]
            stretch, first, end = stretch[asks], first[asks], end[asks]
            base = place[stretch].astype(np.int64)
            out += replies(row[stretch], _ranges(base + first, base + end), buckets)
        return reply_table(out)

    copies = exact_copies(held).select("row_key", "least")
    flagged = gathered(repeated_keys(held, names, buckets, width=NARROW), "names", NARROW)
    planned = held.join(flagged, "row_key", "left").join(copies, "row_key", "left")
    told = planned.mapInArrow(send, "bucket int, " + REPLY_SCHEMA + ", texts binary, rows binary, places binary, many binary").groupBy("bucket").applyInArrow(answer, REPLY_SCHEMA)
    ranges = gathered(told, "ranges", 8)
    ready = held.join(ranges, "row_key", "left").join(copies, "row_key", "left").select("id", "size", "body", "ranges", F.col("least").isNotNull().alias("whole"))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for given, batch in body_slices(b):
                n_words, removed, kept = [], [], []
                for t, blob, whole in zip(batch, given["ranges"].to_pylist(), given["whole"].to_pylist(), strict=True):
                    own_words = t.split()
                    n = len(own_words)
                    gone = 0
                    if whole and n >= width:
                        gone, own_words = n, []
                    elif blob:
                        pair = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, pair[:, 0], 1)
                        np.add.at(edge, pair[:, 1], -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        gone, own_words = n - int(stay.sum()), list(itertools.compress(own_words, stay.tolist()))
                    n_words.append(n)
                    removed.append(gone)
                    kept.append(b" ".join(own_words))
                yield pa.RecordBatch.from_arrays([given["id"], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return ready.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")
