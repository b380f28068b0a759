import math
import os
import random

import numpy as np
import pytest

from gridloom.llm import hard_negatives, queries, topk_search, vectors, whitening

from .test_pipeline import SF

VECTOR = "vec_id long, embedding array<float>, label int"


def whole(v, scale=256):
    return None if not v or any(c is None or not math.isfinite(c) for c in v) else [math.floor(scale * c) for c in v]


def plain_top(rows, k, asked=lambda i: i % 50 == 0):
    held = [(i, whole(v)) for i, v, *_ in rows if i is not None and whole(v)]
    queries_ = {(i, tuple(x)) for i, x in held if asked(i)}
    out = []
    for i, q in queries_:
        found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in held if j != i and len(x) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def plain_negatives(rows, positives=5, negatives=3):
    held = [(i, whole(v), lab) for i, v, lab in rows if i is not None and lab is not None and whole(v)]
    out = []
    for i, q, lab in {(i, tuple(x), lab) for i, x, lab in held if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j, other) for j, x, other in held if len(x) == len(q))
        same = [(-s, j) for s, j, other in scored if other == lab and j != i][:positives]
        for p, j in same:
            fits = [(-s, n) for s, n, other in scored if other != lab and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


def awkward(seed, n=400, d=12):
    """Vectors with near copies, ties, repeated rows, one very common vector, nulls of all kinds, and some of another length."""
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(20)]
    rows = []
    for k in range(n):
        v = [c + rng.gauss(0, 0.2) for c in base[k % 20]] if k % 3 else list(base[0])
        rows.append((k, [float(np.float32(c)) for c in v], rng.randrange(4)))
    rows += [(50, rows[50][1], rows[50][2]), (1000, None, 1), (1001, [], 1), (1002, [1.0] * (d - 1) + [None], 1), (1003, [1.0] * (d - 1) + [float("nan")], 1)]
    rows += [(1004, [float("inf")] * d, 1), (None, [0.5] * d, 1), (1050, [0.25, -0.5], 0), (1051, [0.5, 0.5], 0), (1052, [0.5, 0.5], 1), (1053, [1.0, 0.0], None), (1100, [0.0] * d, 2)]
    return rows


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_top_k(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "SLAB_BYTES", 3000)  # several slabs, so bounds from some of them
    rows = awkward(1)
    df = spark.createDataFrame(rows, VECTOR).repartition(5)
    got = sorted(map(tuple, topk_search.top_k(df, k=5, block_bytes=block_bytes).collect()))
    assert got == plain_top(rows, 5)
    clash = df.withColumn("score", df["label"]).withColumn("rank", df["label"]).withColumn("x", df["label"]).withColumn("query_id", df["label"])
    assert sorted(map(tuple, topk_search.top_k(clash, k=2).collect())) == plain_top(rows, 2)
    assert topk_search.top_k(df.limit(0)).count() == 0
    few = [(50, [1.0, 2.0], 0), (51, [2.0, 1.0], 0), (52, [2.0, 1.0], 0)]
    assert sorted(map(tuple, topk_search.top_k(spark.createDataFrame(few, VECTOR)).collect())) == plain_top(few, 5)


def test_bounds_discard_and_lose_nothing():
    rng = np.random.default_rng(2)
    q, x = np.floor(rng.normal(0, 40, (30, 40))), np.floor(rng.normal(0, 40, (40, 500)))
    parts = vectors.spans(40)
    assert parts[0] == (0, 10) and parts[-1][1] == 40
    scores = q @ x
    for floor in (np.full(30, -np.inf), np.sort(scores, axis=1)[:, -5], np.full(30, np.inf)):
        i, j, s = topk_search.survivors(q, x, floor, parts, topk_search.remaining(q.T, parts), topk_search.remaining(x, parts))
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(scores >= floor[:, None]), strict=True)}
        assert (scores[i, j] == s).all()


def test_wide_numbers_are_exact_or_refused(spark):
    big = float(1 << 21)
    rows = [(0, [big, 1.0], 0), (1, [big, 3.0], 0), (2, [big, 2.0], 0)]
    got = sorted(map(tuple, topk_search.top_k(spark.createDataFrame(rows, VECTOR)).collect()))
    assert got == plain_top(rows, 5) and got[0][3] > 1 << 53
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(spark.createDataFrame([(0, [1e12], 0), (1, [1e12], 0)], VECTOR)).count()


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_hard_negatives(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "SLAB_BYTES", 3000)
    rows = awkward(3)
    df = spark.createDataFrame(rows, VECTOR).repartition(5)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, block_bytes=block_bytes).collect()))
    assert got == plain_negatives(rows) and len(got) > 50
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    clash = df.withColumn("d", df["label"]).withColumn("positive_score", df["label"])
    assert sorted(map(tuple, hard_negatives.hard_negatives(clash).collect())) == got


def test_rotation_keeps_products_within_the_slack():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-900, 900, (24, 300)), rng.integers(-900, 900, (7, 24))
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    off = np.abs((q @ turn.T) @ (turn @ x) - q @ x)
    assert (off <= hard_negatives.slack_of(24, np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(x, axis=0))).all()
    floor = np.sort(q @ x, axis=1)[:, -3].astype(float)
    i, j = hard_negatives.reaching(q @ turn.T, turn @ x, np.ones((7, 300), bool), floor)
    wanted = set(zip(*map(list, np.nonzero(q @ x >= floor[:, None])), strict=True))
    assert wanted <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) < 200
    assert (hard_negatives.verified(q, x, i, j) == (q @ x)[i, j]).all()


def plain_whitening(rows, d, components):
    """(rows in order: id, x), n, S, eigenvalues, vectors."""
    held = [(i, whole(v)) for i, v, *_ in rows if whole(v) and len(whole(v)) == d]
    fit = np.array(sorted({tuple(x) for _, x in held}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return held, n, total, values[::-1][:components], axes[:, ::-1][:, :components], values.sum()


def held_to_plain(found, rows, d, components=4):
    held, n, total, values, axes, trace = plain_whitening(rows, d, components)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = {}
    assert len(found) == len(held) * len(values)
    for i, x in held:
        far = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total, strict=True))
        for c in range(len(values)):
            r = by[i, far][c + 1][0]
            exact = (np.array(x) - total / n) @ axes[:, c] / math.sqrt(values[c])
            if abs(exact) > 1e-6:
                signs.setdefault(c, np.sign(exact * r["whitened"]))
            assert r["n"] == n and abs(r["whitened"] - signs.get(c, 1) * exact) < 1e-8
            assert abs(r["explained"] - values[c] / trace) <= 1e-9 and r["identity_error"] <= 1e-9


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLAB_BYTES", 3000)
    for seed, d in ((5, 12), (6, 40), (7, 3)):
        rows = awkward(seed, 300, d)
        df = spark.createDataFrame(rows, VECTOR).repartition(5)
        clash = df.withColumn("component", df["label"]).withColumn("n", df["label"]).withColumn("at", df["label"])
        held_to_plain(whitening.whiten(clash).collect(), rows, d, min(4, d))
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTOR)).count() == 0
    line = [(k, [float(k), 2.0 * k, 0.0], 0) for k in range(9)]  # one component only
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(line, VECTOR)).collect()} == {1}
    far = spark.createDataFrame([(1, [4e6, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.0], 0), (4, [2.0, 5.0], 0)], VECTOR)
    assert {r["vec_id"]: r["deviation"] is None for r in whitening.whiten(far).collect()} == {1: True, 2: False, 3: False, 4: False}  # (n x - S)^2 of the first exceeds 64 bits


def test_lobpcg_finds_close_eigenvalues():
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    values = np.concatenate([[5.0, 4.0, 3.999, 3.998, 3.997], np.linspace(3.9, 0, 85)])
    matrix, calls = (q * values) @ q.T, []

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, axes, residual = whitening.lobpcg(product, 90, 4)
    assert np.allclose(found, values[:4], rtol=1e-12) and residual <= 1e-12
    assert np.abs(np.abs(np.sum(axes * q[:, :4], axis=0)) - 1).max() < 1e-12 and max(calls) <= 36
    with pytest.raises(RuntimeError):
        whitening.lobpcg(product, 90, 4, rounds=2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_vector_queries_against_plain_versions(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op11_columnar_topk(spark, SF).collect())) == plain_top(rows, 5)
    turned = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    assert sorted(map(tuple, queries.op12_pca_negatives(spark, SF).collect())) == plain_negatives(turned)
    held_to_plain(queries.op13_lobpcg_whitening(spark, SF).collect(), rows, 64)
