"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at a mask's places; the places between are
ignored, so a changed word there does not hide a shared passage. The two masks
for windows of WINDOW words are lossless: whatever WINDOW - LEAST words of a
window differ, one of the masks fits between them. Seeds of the benchmark meet
the seeds of all texts; each hit names a diagonal (item against text), and the
words on the diagonal are then compared one by one.

A passage counts when WINDOW consecutive words agree in LEAST places (0.8 or
more), or, for items that are shorter, the whole item agrees in 0.8 of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, spread, texts

WINDOW, LEAST = 13, 11
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 4, 6, 9, 10))
BLOCK_BYTES = 8 << 20
HITS = 1 << 20  # seed hits of a text that are held at once
SHIFT_BITS = 40  # of a diagonal's number; the item's is above
_FACTOR = 0x9E3779B97F4A7C15
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def allowed(n: int) -> tuple[int, int]:
    """(window, least agreeing words) for an item of n words."""
    return (WINDOW, LEAST) if n >= WINDOW else (n, -(-4 * n // 5))


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for an item of n words; a short item has the longest run that its differences must leave."""
    window, least = allowed(n)
    return MASKS if n >= WINDOW else (tuple(range(max(1, n // (window - least + 1)))),)


def _seeds(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(ids) - mask[-1]
    h = np.zeros(max(n, 0), np.uint64)
    for place in mask:
        h = (h + ids[place : place + n].astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Block:
    """Seeds of some benchmark items."""

    words: dict[bytes, int]
    ids: np.ndarray
    begin: np.ndarray
    masks: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray]]
    item_ids: list[int | None]
    n_items: list[int]

    @classmethod
    def of(cls, items: list[tuple[int | None, int, str]]) -> "Block":
        words: dict[bytes, int] = {}
        each = []
        for _, _, text in items:
            each.append(np.array([words.setdefault(w, len(words)) for w in text.encode().translate(LOWER).split()], np.int64))
        begin = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
        groups: dict[tuple[int, ...], list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for k, e in enumerate(each):
            for mask in masks_for(len(e)) if len(e) else ():
                h = _seeds(e, mask)
                groups.setdefault(mask, []).append((h, k, np.arange(len(h))))
        masks = {}
        for mask, found in groups.items():
            h = np.concatenate([f[0] for f in found])
            item = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
            order = np.argsort(h, kind="stable")
            masks[mask] = (h[order], item[order], np.concatenate([f[2] for f in found])[order])
        return cls(words, np.concatenate(each) if each else np.zeros(0, np.int64), begin, masks, [i[0] for i in items], [i[1] for i in items])

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, first word, last word + 1, agreeing words) of each item that the text holds."""
        words = text.translate(LOWER).split()
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        places = np.flatnonzero(known)
        hits = []
        for mask, (seeds, item, offset) in self.masks.items():
            at = places[places < len(ids) - mask[-1]]
            for place in mask[1:]:
                at = at[known[at + place]]
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for place in mask:
                h = (h + ids[at + place].astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR)
                h ^= h >> np.uint64(29)
            lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            n = hi - lo
            upto = np.concatenate([[0], np.cumsum(n)])
            start = 0
            while start < len(n) and upto[start] < upto[-1]:
                # a seed that an item and a text repeat has the product of both as hits: they become diagonals part by part
                stop = max(start + 1, int(np.searchsorted(upto, upto[start] + HITS, "right")) - 1)
                part = n[start:stop]
                k = np.repeat(lo[start:stop], part) + spread(part)
                hits.append(np.unique((item[k] << SHIFT_BITS) + np.repeat(at[start:stop], part) - offset[k] + (1 << (SHIFT_BITS - 1))))
                start = stop
        if not hits:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        diagonals = np.unique(np.concatenate(hits))
        shifts = (diagonals & ((1 << SHIFT_BITS) - 1)) - (1 << (SHIFT_BITS - 1))
        for item_no, shift in zip((diagonals >> SHIFT_BITS).tolist(), shifts.tolist(), strict=True):
            own = self.ids[self.begin[item_no] : self.begin[item_no + 1]]
            window, least = allowed(len(own))
            lo, hi = max(0, -shift), min(len(own), len(ids) - shift)
            if hi - lo < window:
                continue
            like = np.concatenate([[0], np.cumsum(own[lo:hi] == ids[lo + shift : hi + shift])])
            good = np.flatnonzero(like[window:] - like[:-window] >= least)
            if len(good):
                first, last = int(good[0]), int(good[-1]) + window
                found = (int(like[last] - like[first]), lo + first + shift, lo + last + shift)
                if item_no not in best or found[0] > best[item_no][0]:
                    best[item_no] = found
        return [(k, a, b, n) for k, (n, a, b) in best.items()]


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, least_words: int = 1) -> DataFrame:
    """(id, item_id, n_items, first_word, end_word, n_equal) for each text and benchmark text that share a passage.

    Equal benchmark texts are one item, with the least id (null only where none
    has an id) and their number. Null or empty texts on either side share
    nothing; an empty benchmark or an empty table gives no rows; a text row that
    is repeated gives its rows again. A text of any length is searched whole; of
    passages that tie the first found is told. Words are compared with A-Z
    lower-cased. Other columns are not read, whatever their names. Items of fewer
    than `least_words` words are left out: one of a word or two is in texts that
    have nothing to do with it.

    The benchmark is the query set: it goes to all tasks in blocks of about
    `block_bytes` (its size is counted first), and each block meets all texts,
    so no block grows with either table.
    """
    spark = docs.sparkSession
    long_enough = F.regexp_count(F.col(item_text), F.lit(r"[^\x20\x09-\x0D]+")) >= least_words  # null is not
    items = benchmark.where(long_enough).groupBy(F.col(item_text).alias("t")).agg(F.min(item_col).cast("long").alias("item"), F.count("*").alias("n"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, n_items long, first_word int, end_word int, n_equal int"
    out = spark.createDataFrame([], schema)
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == number).collect()
        block = spark.sparkContext.broadcast(Block.of(sorted(((r["item"], r["n"], r["t"]) for r in rows), key=lambda i: (i[0] is not None, i[0] or 0, i[2]))))

        def run(batches: Iterator[pa.RecordBatch], block: "object" = block) -> Iterator[pa.RecordBatch]:
            held = block.value
            for b in batches:
                for start, stop in slices(b.column(1)):
                    at, found = [], []
                    for k, t in enumerate(texts(b.column(1), start, stop), start):
                        for hit in held.search(t):
                            at.append(k)
                            found.append((held.item_ids[hit[0]], held.n_items[hit[0]], *hit[1:]))
                    columns = list(zip(*found, strict=True)) or [()] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "item_id", "n_items", "first_word", "end_word", "n_equal"])

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = found if number == 0 else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1) -> DataFrame:
    """The rows of docs that share no passage with the benchmark's items of `least_words` words or more.

    Rows are told apart by id and text, so ids may repeat or be null; null and
    empty texts stay, and an empty benchmark or table takes nothing. docs may
    have any other columns but `__row` and `__hit`.
    """
    keyed = docs.withColumn("__row", F.struct(F.col(f"`{id_col}`").alias("id"), F.md5(F.col(f"`{text_col}`").cast("binary")).alias("text")))
    hit = materialise(find_passages(keyed, benchmark, "__row", text_col, least_words=least_words).select(F.col("__row").alias("__hit")).distinct())  # so that its size decides on the join
    return keyed.join(hit, F.col("__row") == F.col("__hit"), "left_anti").drop("__row")
