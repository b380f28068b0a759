import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from gridloom.llm import components, shingle_links, simhash_trie, spaced_seeds

from . import brute

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("same", [True, False])
def test_trie_links_are_all_pairs_within_the_budget(same):
    rng = np.random.default_rng(3)
    a = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64), np.arange(200, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(50, dtype=np.uint64)]))
    b = a if same else np.unique(np.concatenate([a[::3] ^ np.uint64(5), rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    got = {(int(i), int(j)) for x, y in simhash_trie.trie_links(a, b, 0, 0, 4, same) for i, j in zip(x, y, strict=True)}
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 4
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if not same or i < j}


def test_groups(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghijk") * 3 for _ in range(60)] for _ in range(6)]
    rows = []
    for d in range(60):
        words = list(base[d % 6])
        if d % 4 == 1:
            words[rng.randrange(60)] = "changed"
        rows.append((d * 3, " ".join(words)))
    rows += [(5, None), (4, ""), (2, " \n"), (9, "one two"), (9, "one two"), (8, "ONE TWO"), (None, "one two")]
    got = simhash_trie.simhash_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    label = brute.least_reachable(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for (d, _), c in zip(rows, label, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    expected = sorted((-1 if d is None else d, f"{p:016x}", least[c]) for (d, _), p, c in zip(rows, prints, label, strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expected
    assert simhash_trie.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (200, 200)]
    nodes = sorted({x for e in edges for x in e})
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == up


def test_masks_lose_nothing():
    from itertools import combinations

    window, least = spaced_seeds.WINDOW, spaced_seeds.LEAST
    for bad in combinations(range(window), window - least):
        assert any(all(s + p not in bad for p in m) for m in spaced_seeds.MASKS for s in range(window - m[-1]))
    for n in range(1, window):
        w, k = spaced_seeds.allowed(n)
        (mask,) = spaced_seeds.masks_for(n)
        for bad in combinations(range(n), w - k):
            assert any(all(s + p not in bad for p in mask) for s in range(n - mask[-1]))


def plain_hit(text, item):
    t, b = (x.lower().split() for x in (text or "", item or ""))
    if not b:
        return False
    w, least = spaced_seeds.allowed(len(b))
    return any(sum(b[i + k] == t[j + k] for k in range(w)) >= least for i in range(len(b) - w + 1) for j in range(len(t) - w + 1))


def test_passages(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 3)
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 4, 9, 12, 13, 20, 40])))) for k in range(25)] + [(90, None), (91, ""), (92, None)]
    items.append((93, items[4][1]))
    rows = []
    for d in range(160):
        words = [word() for _ in range(rng.choice([0, 3, 60]))]
        part = (items[rng.randrange(25)][1] or "").split()
        part = part[rng.randrange(3) :]
        for _ in range(rng.randrange(5)):
            if part:
                part[rng.randrange(len(part))] = "zzz"
        rows.append((d, " ".join(words[:30] + part + words[30:])))
    rows += [(None, rows[1][1]), (300, None)]
    least = {}
    for k, b in items:
        least[b] = min(k, least.get(b, k))
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 400):
        got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.find_passages(docs, bench, block_bytes=block_bytes).collect()}
        assert got == {(d, k) for d, t in rows for k, b in items if k == least[b] and plain_hit(t, b)}
    assert spaced_seeds.find_passages(docs, bench.limit(0)).count() == 0
    clean = {r["doc_id"] for r in spaced_seeds.decontaminate(docs, bench).collect()}
    assert clean == {d for d, t in rows if not any(plain_hit(t, b) for _, b in items)}


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_at_shingle_similarity_are_dropped(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    rows = []
    for d in range(0, 120, 3):
        base = words(120 + d)
        for k, changes in enumerate((0, 2, 6)):
            other = list(base)
            for at in rng.sample(range(5, len(base) - 5), changes):
                other[at] = words(1)[0]
            rows.append((d + k, " ".join(other).upper() if k == 1 else " ".join(other)))
    hot = words(200)
    rows += [(200 + k, " ".join([*hot[:-1], f"end{k}"])) for k in range(40)] + [(300, None), (301, "one two")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA + ", lang string, source string, n_chars long").repartition(3)
    prints = [plain_fingerprint(t) for _, t in rows]
    sets = [five_words(t or "") for _, t in rows]
    far = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and (prints[i] ^ prints[j]).bit_count() > 4}
    alike = {(i, j) for i, j in far if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0}
    assert len(alike) > 40
    label = brute.least_reachable(len(rows), lambda i, j: (i, j) not in far or (i, j) in alike)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {rows[c][0] for c in label}


def test_short_items_have_a_floor(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat today"), (2, "a cat"), (3, "no more")], SCHEMA)
    bench = spark.createDataFrame([(1, "the"), (2, " A  cat "), (3, "cat sat on the mat"), (4, None), (5, " ")], "item_id long, text string")
    hits = lambda least: {(r["doc_id"], r["item_id"]) for r in spaced_seeds.find_passages(docs, bench, least_words=least).collect()}
    assert hits(1) == {(1, 1), (1, 3), (2, 2)} and hits(2) == {(1, 3), (2, 2)} and hits(5) == {(1, 3)} and hits(6) == set()
    assert {r["doc_id"] for r in spaced_seeds.decontaminate(docs, bench, least_words=5).collect()} == {2, 3}


def test_the_query_against_brute_force(spark):
    import os

    from gridloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the test tables are not here")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    short = {d: t for d, t in docs if len((t or "").split()) < 300}  # the plain version takes minutes for the long ones
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_spaced_seeds"](spark, sf).collect() if r["doc_id"] in short}
    words = {k: set(b.lower().split()) for k, b in items}
    assert found == {(d, k) for d, t in short.items() for k, b in items if len(words[k] & set((t or "").lower().split())) > 8 and plain_hit(t, b)} and found
