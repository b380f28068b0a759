"""SimHash fingerprints and a self-join of their binary trie within a Hamming budget.

The trie is not built with pointers: a node is a range of the sorted
fingerprints that share a prefix. Two nodes of equal depth are walked together;
each step pairs their children, adds one differing bit for unlike children, and
drops the pair when the budget is exceeded. Pairs of small nodes are compared
directly by XOR and bit count.

On a cluster the first D levels of the walk are done by dealing: each prefix of
D bits is a block, and each pair of blocks whose prefixes differ in at most the
budget is one group. D grows with the number of distinct fingerprints, so
that a block stays bounded. A group sends the edges of a spanning forest of its
links only, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, texts, tidy
from .components import components

BLOCK = 1 << 15  # fingerprints in a block on average, at most
LEAF = 48  # pairs of a node pair that are compared directly
FRONT = 1 << 17  # node pairs that are walked at once
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the text's word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    first = np.concatenate([[0], ends[: len(last) - 1] + 1])
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(1)):
                fps = np.fromiter(map(fingerprint, texts(b.column(1), start, stop)), np.uint64, stop - start)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, fp long")


def _leaves(a: np.ndarray, b: np.ndarray, node: tuple[np.ndarray, ...], budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the budget of node pairs (range in a, range in b)."""
    la, ha, lb, hb = node[:4]
    na, nb = ha - la, hb - lb
    n = na * nb
    k = np.repeat(np.arange(len(n)), n)
    off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    i, j = la[k] + off // nb[k], lb[k] + off % nb[k]
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    near = np.bitwise_count(a[i] ^ b[j]) <= budget
    return i[near], j[near]


def trie_links(a: np.ndarray, b: np.ndarray, depth: int, differing: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted a and b within the budget; all of a share `depth` bits, so do all of b."""
    if not len(a) or not len(b):
        return
    one = np.ones(1, np.int64)
    stack = [(0 * one, len(a) * one, 0 * one, len(b) * one, differing * one, depth)]
    while stack:
        la, ha, lb, hb, d, at = stack.pop()
        if len(la) > FRONT:
            stack += [tuple(x[k : k + FRONT] for x in (la, ha, lb, hb, d)) + (at,) for k in range(0, len(la), FRONT)]
            continue
        small = ((ha - la) * (hb - lb) <= LEAF) | (at == 64)
        if small.any():
            if at == 64:  # equal fingerprints are met once only, so such nodes hold one each
                small[:] = True
            yield _leaves(a, b, tuple(x[small] for x in (la, ha, lb, hb)), budget, same)
            la, ha, lb, hb, d = (x[~small] for x in (la, ha, lb, hb, d))
        if not len(la):
            continue
        bit = np.uint64(1) << np.uint64(63 - at)
        low = bit - np.uint64(1)
        ma = np.searchsorted(a, (a[la] & ~(low | bit)) | bit)
        mb = np.searchsorted(b, (b[lb] & ~(low | bit)) | bit)
        parts = [(la, ma, lb, mb, d), (ma, ha, mb, hb, d), (la, ma, mb, hb, d + 1), (ma, ha, lb, mb, d + 1)]
        if same:  # within one trie the pair (right, left) of a node with itself is the pair (left, right)
            parts[3] = tuple(x[(la != lb)] for x in parts[3])
        la, ha, lb, hb, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (d <= budget) & (ha > la) & (hb > lb)
        stack.append(tuple(x[keep] for x in (la, ha, lb, hb, d)) + (at + 1,))


class Forest:
    """Union of index pairs; root() gives the smallest index of each tree."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            up = self.root()
            a, b = up[i], up[j]
            unlike = a != b
            if not unlike.any():
                return
            i, j, a, b = i[unlike], j[unlike], a[unlike], b[unlike]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def trie_self_join(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints of column fp.

    Links of a whole class of near fingerprints give a tree, not all pairs:
    whatever can be reached over links of at most `budget` bits can be reached
    over the returned ones. Nulls are dropped; repeated rows count once.
    """
    distinct = materialise(fps.where("fp is not null").select("fp").distinct())
    count = distinct.count()
    depth = max(3, -(-count // BLOCK)).bit_length()
    masks = np.array([sum(1 << b for b in bits) for k in range(budget + 1) for bits in combinations(range(depth), k)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            prefix = (fp.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)
            order = np.argsort(prefix, kind="stable")
            fp, prefix = fp[order], prefix[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(prefix)) + 1, [len(prefix)]])
            groups, sides, blobs = [], [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi > lo:
                    own = int(prefix[lo])
                    for other in own ^ masks:
                        groups.append(min(own, int(other)) << depth | max(own, int(other)))
                        sides.append(own > other)
                        blobs.append(fp[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(sides, pa.bool_()), pa.array(blobs, pa.binary())], names=["pair", "side", "fps"])

    def walk(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        left, right = pair >> depth, pair & ((1 << depth) - 1)
        side = np.array(rows["side"].to_pylist(), bool)
        both = [np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x, s in zip(rows["fps"].to_pylist(), side, strict=True) if s == k] or [np.zeros(0, np.uint64)])) for k in (False, True)]
        same = left == right
        a, b = (both[0], both[0]) if same else both
        forest = Forest(len(a) + (0 if same else len(b)))
        shift = 0 if same else len(a)
        for i, j in trie_links(a, b, depth, bin(left ^ right).count("1"), budget, same):
            forest.join(i, j + shift)
        root = forest.root()
        child = np.flatnonzero(root != np.arange(len(root)))
        everything = (a if same else np.concatenate([a, b])).view(np.int64)
        return pa.table({"u": everything[child], "v": everything[root[child]]})

    # the walk is long for its few bytes, so the number of tasks does not follow from their size
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), count >> 16)
    return distinct.mapInArrow(deal, "pair long, side boolean, fps binary").repartition(parts, "pair").groupBy("pair").applyInArrow(walk, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, links: DataFrame | None = None) -> DataFrame:
    """(id, fingerprint hex, component_id) for every row; component_id is the least id reachable.

    Documents link when their fingerprints differ in at most `budget` bits, or
    are a pair (u, v) of `links`.
    Texts that are null, empty or without words have fingerprint zero and link
    like any other; a text of any length gives one fingerprint. Rows with a null
    id keep a null id and count for their class only if no other id is there.
    Rows that repeat an id, with the same text or another, are rows of their own;
    an empty table gives no rows. Other columns are not read, whatever their
    names; the id may not be called fp, least, root, fingerprint or component_id.
    """
    rows = materialise(fingerprints(docs, id_col, text_col))
    least = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    edges = trie_self_join(rows, budget)
    roots = components(edges if links is None else edges.union(links.select("u", "v")))
    labelled = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(classes, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(id_col, hexed.alias("fingerprint"), "component_id")
