"""Links between texts whose word shingles have a Jaccard similarity of a threshold or more.

Minima of the shingle hashes under BANDS * DEPTH hash functions are cut into
BANDS keys; texts that share a key are candidates, and each candidate pair's
shingle sets are then compared. A pair at similarity s has no common key with
probability (1 - s^DEPTH)^BANDS: 0.00007 at 0.8.

In a key of up to SMALL texts all pairs are compared. A larger one has a leader,
the text that shares the most keys with the others, and all are compared with
it. Texts like the leader are joined through it. Every other one may still be
like some text of the leader's: both are described by how they differ from the
leader (shingles they lack, and shingles they have more). With a text's
difference weighed as g = (1 - c) * lacking + c * more, c = t / (1 + t) at the
threshold t, two of them are alike only if their differences share at least
g1 + g2 - (1 - 2c) * |leader| shingles, and g exceeds the last term for each text unlike
the leader. So each must show that many differences that others show too, and both
have one of their rarer differences in common (a prefix in the order of how many
texts of the leader show a difference); only such pairs are compared. Texts meet by grades
of weight, for a partner known to be heavier must share more, so less of the
order need be looked at. Nothing is lost by that, and copies with edits of their own, however many, give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise_sparing, slices, spread, squeezed, texts, tidy
from .repeats import mix, words_of
from .simhash_trie import LOWER, fingerprint

WIDTH = 5
BANDS, DEPTH = 24, 5
SMALL = 8
HELD = 1 << 18  # differences that a task holds before it hands them on
STEP, LEAST_GRADE = 1.25, -4  # weights of one grade differ by this factor at most; all below slack * STEP ** (LEAST_GRADE + 1) have the least
_rng = np.random.default_rng(5)
_ODD = _rng.integers(0, 1 << 31, BANDS * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * DEPTH, np.uint32)
_PLACE = _rng.integers(0, 1 << 63, max(WIDTH, DEPTH) + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, number of each text) of texts.

    A shingle is a run of WIDTH words, A-Z lower-cased; all words of a shorter
    text; a text without words has none.
    """
    words, per = words_of([t.translate(LOWER) for t in batch])
    left = np.repeat(np.cumsum(per), per) - np.arange(len(words))  # words of the same text from here on
    h = np.minimum(left, WIDTH).astype(np.uint64)
    for k in range(WIDTH):
        h[: len(words) - k] += np.where(left[: len(words) - k] > k, words[k:] * _PLACE[k], np.uint64(0)) if k < len(words) else np.uint64(0)
    n = np.where(per > 0, np.maximum(per - WIDTH + 1, 1), 0)
    starts = np.cumsum(per) - per
    return mix(h[np.repeat(starts, n) + spread(n)]), n


def band_keys(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have words, their keys: a row of BANDS for each)."""
    h, n = shingles(batch)
    own = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[own]
    if not len(own):
        return own, np.zeros((0, BANDS), np.int64)
    low, work = h.astype(np.uint32), np.empty(len(h), np.uint32)
    least = np.empty((BANDS * DEPTH, len(own)), np.uint32)
    for f in range(BANDS * DEPTH):
        np.multiply(low, _ODD[f], out=work)
        np.add(work, _ADD[f], out=work)
        np.minimum.reduceat(work, starts, out=least[f])
    rows = least.reshape(BANDS, DEPTH, len(own)).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * _PLACE[-1]
    for k in range(DEPTH):
        keys = mix(keys ^ rows[:, k] * _PLACE[k])
    return own, keys.T.copy().view(np.int64)


@lru_cache(maxsize=4)
def _set(text: bytes) -> np.ndarray:
    return np.unique(shingles([text])[0])


@lru_cache(maxsize=4)
def _print(text: bytes) -> int:
    """SimHash fingerprint as a signed integer."""
    return int(np.array([fingerprint(text)], np.uint64).view(np.int64)[0])


def compared(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles of x that y lacks, of y that x lacks, how many both have)."""
    a, b = _set(x), _set(y)

    def within(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u if len(u) and len(v) else np.zeros(len(u), bool)

    in_b = within(a, b)
    return a[~in_b], b[~within(b, a)], int(in_b.sum())


def shown_again(rows: DataFrame) -> DataFrame:
    """(b, again) of rows (a, b, size, lacking, more): what b has more than any of its leaders and another text shows too.

    A text stands under as many leaders as it has keys, but each of its shingles is dealt once; very long
    texts are gathered in parts of about HELD shingles. What one text alone shows, mostly nearly all, goes no further.
    """
    parts = F.ceil((F.col("size") - F.size("lacking") + F.size("more")) / HELD)
    dealt = rows.select("b", "more", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    own = F.when(F.col("parts") == 1, F.col("more")).otherwise(F.filter("more", lambda h: F.pmod(h, F.col("parts")) == F.col("part")))
    shown = dealt.groupBy("b", "part").agg(F.array_distinct(F.flatten(F.collect_list(own))).alias("shown"))
    shown = materialise_sparing(shown.select("b", F.explode("shown").alias("h")))
    # written, so that a join may split the rows of a shingle that very many texts show
    twice = materialise_sparing(shown.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    return shown.join(twice, "h").groupBy("b").agg(F.collect_list("h").alias("again"))


def differences(rows: DataFrame) -> DataFrame:
    """rows (a, b, like, weight, slack, size, lacking, more) with `marks`: (n, mark) of those differences that n > 1 texts of the leader a show, the rarer first.

    What texts lack is counted by its place in the leader, in a list as long as
    the leader, which each of its rows then meets; of what they have more, what several texts show is dealt by shingle.
    """
    whole = rows.groupBy("a").agg(F.first("size").alias("size")).select("a", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("p"))
    lost = rows.select("a", F.explode("lacking").alias("p")).union(whole).groupBy("a", "p").agg((F.count("*") - 1).alias("n"))
    # written, so that a join may split the rows of a leader with very many texts
    lost = materialise_sparing(lost.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "n"))), lambda s: s["n"]).alias("lost")))
    token = materialise_sparing(rows.join(shown_again(rows).hint("merge"), "b").select("a", "b", F.explode(F.array_intersect("more", "again")).alias("h")))
    counts = token.groupBy("a", "h").agg(F.count("*").alias("n")).where("n > 1")  # a difference of one text meets no other
    mark = lambda h, lacks: F.struct(h.cast("long").alias("h"), F.lit(lacks).alias("l")).alias("mark")
    met = token.join(counts, ["a", "h"]).groupBy("a", "b").agg(F.collect_list(F.struct("n", mark(F.col("h"), False))).alias("met"))
    lacked = F.filter(F.transform("lacking", lambda p: F.struct(F.get("lost", p).alias("n"), mark(p, True))), lambda s: s["n"] > 1)
    marks = F.array_sort(F.concat(lacked, F.coalesce("met", F.array().cast("array<struct<n:bigint,mark:struct<h:bigint,l:boolean>>>"))))
    return rows.join(lost.hint("merge"), "a").join(met.hint("merge"), ["a", "b"], "left").select("a", "b", "like", "weight", "slack", marks.alias("marks"))


def grade_sides(ranked: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Prefix differences of texts for each grade of weight that a partner may have, each with how many of the text's differences stand from there on.

    A partner of weight w or more must share weight + w - slack differences, so the prefix
    is the shorter the heavier the partner. It shares at most w / c of its own, so grades
    far off give none. The first side has the lighter of two texts.
    """
    base = F.greatest("slack", F.lit(1.0))
    grade = F.greatest(F.lit(LEAST_GRADE), F.floor(F.log(F.greatest(F.col("weight"), base / 10) / base) / F.log(F.lit(STEP)))).cast("int")
    graded = ranked.withColumns({"grade": grade, "base": base})
    there = materialise_sparing(graded.groupBy("a").agg(F.collect_set("grade").alias("all"), F.collect_set(F.when(~F.col("like"), F.col("grade"))).alias("unlike")))
    low = F.when(F.col("other") > LEAST_GRADE, F.col("base") * F.pow(F.lit(STEP), F.col("other"))).otherwise(0.0)
    high = F.col("base") * F.pow(F.lit(STEP), F.col("other") + 1)
    # texts like the leader are joined through it, so they look for unlike ones only
    asked = graded.join(there.hint("merge"), "a").withColumn("other", F.explode(F.when(F.col("like"), F.col("unlike")).otherwise(F.col("all"))))
    asked = asked.where(high * 100 / percent + F.col("slack") >= F.col("weight") - F.lit(1e-6))
    n = F.size("marks")
    length = F.least(n, n - F.ceil(F.greatest(F.lit(1.0), F.col("weight") + low - F.col("slack")) - F.lit(1e-6)) + 1).cast("int")
    cut = asked.withColumn("length", length).where("length > 0")

    def side(rows: DataFrame, name: str, grades: tuple[str, str]) -> DataFrame:
        own = rows.select("a", F.col("b").alias(name), F.col("like").alias(f"{name}_like"), F.col("weight").alias(f"{name}_weight"), "slack", *[F.col(g).alias(k) for g, k in zip(grades, ("light", "heavy"), strict=True)], n.alias("n"), F.posexplode(F.slice("marks", F.lit(1), F.col("length"))).alias("at", "m"))
        return own.select("a", "light", "heavy", F.col("m.mark").alias("mark"), name, f"{name}_like", f"{name}_weight", "slack", (F.col("n") - F.col("at")).alias(f"{name}_left"))

    return side(cut.where("grade <= other"), "one", ("grade", "other")), side(cut.where("grade >= other"), "two", ("other", "grade")).drop("slack")


def near_pairs(ranked: DataFrame, percent: int) -> DataFrame:
    """(a, b) of texts of one leader that may be alike by their differences from it; every alike pair that the leader does not join is among them."""
    left, right = grade_sides(ranked, percent)
    # all that two alike texts share stands from their first common difference on, in both
    room = "(light < heavy or one < two) and not (one_like and two_like) and least(one_left, two_left) >= one_weight + two_weight - slack - 1e-6"
    met = left.join(right, ["a", "mark", "light", "heavy"]).where(room)
    return met.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()


def shingle_links(docs: DataFrame, text_col: str = "text", percent: int = 80) -> DataFrame:
    """(u, v): SimHash fingerprints of texts whose similarity is `percent` hundredths or more.

    Equal texts are one; texts that are null or without words have no links, and
    an empty table has none. Ids and other columns are not read. What is returned
    joins all linked texts of a key, many of them through their leader; it is
    not the list of all pairs.
    """
    source = docs.select(F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("node"), F.col(f"`{text_col}`").alias("text")).where("text is not null")

    @tidy
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(1)):
                own, found = band_keys(texts(b.column(1), start, stop))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), b.column(0).take(pa.array(np.repeat(own + start, BANDS)))], names=["key", "node"])

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes, bytes]]:
        import zstandard

        expand = lru_cache(maxsize=4)(zstandard.ZstdDecompressor().decompress)
        for b in batches:
            for k in range(b.num_rows):
                yield b, k, expand(b.column(2)[k].as_py()), expand(b.column(3)[k].as_py())

    def alike(more: np.ndarray, less: np.ndarray, both: int) -> bool:
        return both > 0 and 100 * both >= percent * (len(more) + len(less) + both)

    link = "u long, v long"

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of pairs (a, b, x, y)."""
        out: list[tuple[int, int]] = []
        for _, _, x, y in pairs_of(batches):
            if alike(*compared(x, y)):
                out.append((_print(x), _print(y)))
        u, v = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    @tidy
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of pairs (leader, node), and each node's differences: places of the leader's shingles that it lacks, and shingles that it has more."""
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        rows, held = [], 0

        def told() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "u", "v", "like", "size", "lacking", "more"])

        for b, k, x, y in pairs_of(batches):
            lacking, more, both = compared(x, y)
            like = alike(lacking, more, both)
            u, v = (_print(x), _print(y)) if like else (None, None)
            rows.append((b.column(0)[k].as_py(), b.column(1)[k].as_py(), u, v, like, len(lacking) + both, np.searchsorted(_set(x), lacking).astype(np.int32), more.view(np.int64)))
            held += len(lacking) + len(more)
            if held > HELD:
                yield told()
                rows, held = [], 0
        yield told()

    found = materialise_sparing(source.mapInArrow(keys, "key long, node binary"))
    own = F.xxhash64("node")
    shared = found.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").select("key")
    rest = materialise_sparing(found.join(shared, "key").distinct())
    nodes = materialise_sparing(rest.select("node").distinct()).hint("merge")  # they grow with the corpus: not to be broadcast
    bodies = materialise_sparing(squeezed(source, "text").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    a_text, b_text = (bodies.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    texts_of = lambda pairs: pairs.join(b_text, "b").join(a_text, "a").select("a", "b", "x", "y")

    sized = rest.groupBy("key").agg(F.count("*").alias("n"))
    placed = materialise_sparing(rest.join(sized, "key"))
    small, large = placed.where((F.col("n") > 1) & (F.col("n") <= SMALL)), placed.where(F.col("n") > SMALL)
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    links = texts_of(pairs).mapInArrow(compare, link)

    support = large.groupBy("node").agg(F.sum("n").alias("support"))
    leaders = large.join(support, "node").groupBy("key").agg(F.max(F.struct("support", "node"))["node"].alias("lead"))
    led = large.join(leaders, "key").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    told = materialise_sparing(texts_of(led).mapInArrow(lead, "a binary, b binary, u long, v long, like boolean, size int, lacking array<int>, more array<long>"))
    links = links.union(told.where("like").select("u", "v"))
    # a leader whose texts are all like it is done; the differences of the others' are weighed
    open_ = materialise_sparing(told.where("not like").select("a").distinct())
    rows = told.join(open_, "a").withColumns({"weight": (100 * F.size("lacking") + percent * F.size("more")) / (100 + percent), "slack": F.col("size") * (100 - percent) / (100 + percent)})
    ranked = materialise_sparing(differences(rows))
    near = materialise_sparing(near_pairs(ranked, percent))
    links = links.union(texts_of(near).mapInArrow(compare, link))
    return materialise_sparing(links.where("u <> v").distinct())
