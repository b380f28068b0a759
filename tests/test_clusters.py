import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import grids
from gridloom.operators import cluster, isomorphism, overlap, splits
from gridloom.schemas import TASK

from . import plain_isomorphism as plain


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """On tables this small, generating code takes longer than all else."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


BASE = {
    "train": [{"input": [[8, 8, 5], [6, 0, 0]], "output": [[5, 6, 6]]}, {"input": [[3], [0], [3]], "output": [[0, 3], [3, 8]]}, {"input": [[5, 6]], "output": [[6, 5]]}],
    "test": [{"input": [[5, 0, 3, 6]], "output": [[3], [6]]}],
}
SHIFT = {c: (c + 4) % 10 for c in range(10)}


def image(task, turn, order=(2, 0, 1), colors=SHIFT):
    change = lambda g: [[colors[c] for c in r] for r in plain.turned(g, turn)]
    return {"train": [{k: change(g) for k, g in task["train"][i].items()} for i in order], "test": [{k: change(g) for k, g in p.items()} for p in task["test"]]}


def replay(left, right, found):
    """Whether the witness turns every example of left into its partner in right."""
    change = lambda g: [[found["color"][c] for c in r] for r in plain.turned(g, found["d4"])]
    return all({k: change(g) for k, g in p.items()} == right[s][j] for s in ("train", "test") for p, j in zip(left[s], found[f"{s}_permutation"], strict=True))


def searched(spark, left, others, **bound):
    """name -> what the joins find for left against each of the others."""
    records = spark.createDataFrame(rows({"left": left} | others), f"record_id string, task {TASK}")
    pairs = spark.createDataFrame([("left", name) for name in others], "left_id string, right_id string")
    return {r["right_id"]: r.asDict() for r in isomorphism.verify_pairs(pairs, records, **bound).collect()}


def test_every_image_is_found_with_a_witness(spark):
    others = {f"{turn}{order}": image(BASE, turn, order) for turn in grids.D4 for order in itertools.permutations(range(3))}
    found = searched(spark, BASE, others)
    assert len(found) == 48
    for name, other in others.items():
        assert found[name]["status"] == "matched" and replay(BASE, other, found[name])
        assert plain.find_isomorphism(BASE, other)["status"] == "matched"


def test_what_is_no_single_image_is_not_matched(spark):
    whole = image(BASE, "transpose", (0, 1, 2))
    swapped = {c: {SHIFT[8]: SHIFT[6], SHIFT[6]: SHIFT[8]}.get(c, c) for c in range(10)}
    others, expected = {}, {}
    for k in range(3):  # one example in other colours, or turned otherwise
        recolored = image({"train": [], "test": [whole["train"][k]]}, "identity", (), swapped)["test"][0]
        for name, example in (("recolored", recolored), ("turned", image(BASE, "rotate_180", (0, 1, 2))["train"][k])):
            others[f"{name}{k}"] = {"train": [example if i == k else p for i, p in enumerate(whole["train"])], "test": whole["test"]}
            expected[f"{name}{k}"] = "matched" if example == whole["train"][k] else "not-isomorphic"
    others["fewer"], expected["fewer"] = {"train": whole["train"][:2], "test": whole["test"]}, "not-isomorphic"
    found = searched(spark, BASE, others)
    assert {n: r["status"] for n, r in found.items()} == expected == {n: plain.find_isomorphism(BASE, t)["status"] for n, t in others.items()}
    assert all(r["d4"] is None and r["color"] is None for r in found.values() if r["status"] != "matched")
    merged = {c: 0 if c == 1 else c for c in range(10)}  # two colours become one: no bijection
    two = {"train": [{"input": [[0, 1]], "output": [[1]]}], "test": [{"input": [[1]], "output": [[0]]}]}
    assert searched(spark, two, {"m": image(two, "identity", (0,), merged)})["m"]["status"] == "not-isomorphic"


def test_bound_of_states(spark):
    other = {"o": image(BASE, "identity")}
    need = searched(spark, BASE, other)["o"]["explored"]
    assert searched(spark, BASE, other, max_states=need)["o"]["status"] == "matched"
    found = searched(spark, BASE, other, max_states=need - 1)["o"]
    assert (found["status"], found["explored"], found["d4"]) == ("inconclusive", need - 1, None)
    many = {"train": [{"input": [[1]], "output": [[2]]}] * 9, "test": [{"input": [[1]], "output": [[2]]}]}
    # equal examples: one state for each set of partners, 2^9 and the test's and the empty one's, for eight transforms
    assert searched(spark, many, {"o": many})["o"]["explored"] == 8 * (1 + 1 + 2**9 - 1)


def test_random_tasks_against_the_plain_search(spark):
    rng = random.Random(5)
    grid = lambda: [[rng.randrange(3) for _ in range(2)] for _ in range(2)]
    for _ in range(1):
        base = {"train": [{"input": grid(), "output": grid()} for _ in range(3)], "test": [{"input": grid()}]}
        base["train"].append(base["train"][0])
        others = {}
        for k in range(12):
            other = image(base, rng.choice(list(grids.D4)), tuple(rng.sample(range(4), 4)))
            if k % 2:
                other["train"][k % 4]["output"][0][0] = rng.randrange(10)
            others[str(k)] = other
        found = searched(spark, base, others)
        for name, other in others.items():
            assert found[name]["status"] == plain.find_isomorphism(base, other)["status"]
            assert found[name]["status"] != "matched" or replay(base, other, found[name])


def test_searches_within_rows_and_by_joins_agree(spark, monkeypatch):
    """Few states at once: no join for a level. What the rows hold, what is dealt and what is joined give the same counts and witnesses."""
    one = {"input": [[1, 2]], "output": [[2, 1]]}
    alike = {"train": [*BASE["train"], one, {"input": [[3, 4]], "output": [[4, 3]]}, one], "test": [*BASE["test"], {"input": [[7]]}]}
    others = {turn: {"train": image(alike, turn, (4, 2, 0, 5, 1, 3))["train"], "test": [*image(BASE, turn)["test"], {"input": [[1]]}]} for turn in ("rotate_90", "flip_vertical")}
    others["other"] = others["rotate_90"] | {"test": [*others["rotate_90"]["test"][:1], {"input": [[2, 2]]}]}
    inner, joined = isomorphism._by_levels, []
    monkeypatch.setattr(isomorphism, "_by_levels", lambda *given: joined.append(1) or inner(*given))
    found = searched(spark, alike, others)
    assert not joined and [found[n]["status"] for n in others] == ["matched", "matched", "not-isomorphic"]
    assert all(replay({**alike, "test": alike["test"][:1]}, {**others[n], "test": others[n]["test"][:1]}, found[n] | {"test_permutation": found[n]["test_permutation"][:1]}) for n in ("rotate_90", "flip_vertical"))
    for bound in ("STATES_IN_ROW", "EXAMPLES_IN_ROW"):
        with monkeypatch.context() as m:
            m.setattr(isomorphism, bound, 0)
            assert searched(spark, alike, others) == found
    assert len(joined) == 2
    need = found["rotate_90"]["explored"]
    assert searched(spark, alike, others, max_states=need - 1)["rotate_90"]["status"] == "inconclusive"


def all_pairs_clusters(tasks, max_states):
    """name -> least name of its cluster: every pair of tasks compared."""
    label = {n: n for n in tasks}
    for a, b in itertools.combinations(sorted(tasks), 2):
        if plain.find_isomorphism(tasks[a], tasks[b], max_states)["status"] == "matched" and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {n: low if x == high else x for n, x in label.items()}
    return label


def test_leaders_place_what_all_pairs_place(spark, monkeypatch):
    """Like signatures, several classes, some of them beyond the bound: clusters as by all pairs, with few comparisons."""
    demo = lambda mirrored, a, b: {"input": [[a, b, b]], "output": [[b, b, a] if mirrored else [a, b, b]]}
    colors = list(itertools.permutations(range(4), 2))
    tasks, classes = {}, 4
    for k, (a, b) in enumerate(colors[:6]):
        for mirrored in range(classes):
            tasks[f"{mirrored}{k}"] = {"train": [demo(i < mirrored, a, b) for i in range(classes - 1)], "test": [demo(False, a, b)]}
    # beyond the bound: nine like examples
    tasks |= {f"x{k}": {"train": [demo(False, a, b)] * 9, "test": [demo(False, a, b)]} for k, (a, b) in enumerate(colors[:5])}
    asked = []
    inner = isomorphism.verify_pairs

    def counted(pairs, records, max_states):
        asked.append(pairs.count())
        return inner(pairs, records, max_states)

    monkeypatch.setattr(cluster, "verify_pairs", counted)
    records = spark.createDataFrame(rows(tasks), f"record_id string, task {TASK}")
    clusters, edges = cluster.cluster_tasks(records, max_states=400)
    got = {r["record_id"]: r["cluster_id"] for r in clusters.collect()}
    assert got == all_pairs_clusters(tasks, 400) and len(set(got.values())) == classes + 5
    assert {r["status"] for r in edges.where("left_id like 'x%'").collect()} == {"inconclusive"}
    assert sum(asked) <= 6 * classes * classes + 2 * 5


def rows(tasks):
    pair = lambda p: (p["input"], p.get("output"))
    return [(k, (None, [pair(p) for p in t["train"]], [pair(p) for p in t["test"]])) for k, t in tasks.items()]


def test_witness_replays(spark):
    other = image(BASE, "rotate_270")
    found = plain.find_isomorphism(BASE, other)
    good = (found["d4"], found["color"], found["train_permutation"], found["test_permutation"])
    colors = found["color"]
    bad = [("flip_vertical", *good[1:]), (good[0], colors | {5: colors[6]}, *good[2:]), (good[0], {c: d for c, d in colors.items() if c != 3}, *good[2:]), (*good[:2], [0, 1, 2], good[3]), (*good[:2], good[2], [])]
    pairs = rows({"a": BASE, "b": other})
    df = spark.createDataFrame([(k, pairs[0][1], pairs[1][1], w) for k, w in enumerate([good, *bad])], f"k int, l {TASK}, r {TASK}, w struct<d4:string,color:map<int,int>,train_permutation:array<int>,test_permutation:array<int>>")
    held = {r["k"]: r["ok"] for r in df.select("k", cluster.witness_holds(F.col("l"), F.col("r"), F.col("w")).alias("ok")).collect()}
    assert held == {k: k == 0 for k in range(len(bad) + 1)}


def test_clusters_of_a_toy_set(spark):
    other = {"train": [{"input": [[5]], "output": [[6, 6]]}], "test": [{"input": [[5, 5]], "output": [[6]]}]}
    copy = {"train": BASE["train"][::-1], "test": BASE["test"]}
    records = spark.createDataFrame(rows({"r1": BASE, "r2": image(BASE, "anti_transpose"), "r3": other, "r4": copy}), f"record_id string, task {TASK}")
    clusters, edges = cluster.cluster_tasks(records)
    assert {r["record_id"]: r["cluster_id"] for r in clusters.collect()} == {"r1": "r1", "r2": "r1", "r3": "r3", "r4": "r1"}
    assert sorted(r["relation"] for r in edges.collect()) == ["exact-normalized-content", "global-d4-color-isomorphism"]


def test_components_along_a_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "node long")
    edges = spark.createDataFrame([(1, 3), (2, 3), (5, 4), (5, 6), (6, 7), (7, 8), (8, 9)], "u long, v long")
    got = {r["node"]: r["label"] for r in cluster.min_label_components(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1} | dict.fromkeys(range(4, 10), 4) | {10: 10, 11: 11}


def test_overlap_variants(spark):
    a = {"train": BASE["train"], "test": BASE["test"] + [{"input": [[3]], "output": [[4]]}]}
    reordered = {"train": a["train"][::-1], "test": a["test"][::-1]}
    relabelled = {"train": a["train"], "test": [{"input": p["input"], "output": [[0]]} for p in a["test"]]}
    for right, expected in ((reordered, (False, True, True, False, True, False, True)), (relabelled, (False, False, True, False, False, True, True))):
        sides = [spark.createDataFrame(rows({"t": t}), f"task_id string, task {TASK}") for t in (a, right)]
        assert tuple(overlap.split_overlap(*sides).first())[1:] == expected


def test_examples_sort_by_text(spark):
    t = {"train": [{"input": [[1], [2]], "output": [[0]]}, {"input": [[1, 2]], "output": [[0]]}], "test": [{"input": [[0]], "output": [[0]]}]}
    df = spark.createDataFrame(rows({"t": t}), f"task_id string, task {TASK}")
    assert df.select(overlap.normalized_text(F.col("task"))).first()[0].index("[[1,2]]") < df.select(overlap.normalized_text(F.col("task"))).first()[0].index("[[1],[2]]")


def test_quotas_and_splits(spark):
    items = spark.createDataFrame([(f"c{i:04d}",) for i in range(1008)], "cluster_id string")
    assigned = splits.assign_splits(items, "cluster_id", "20260806", [("train", 70), ("validation", 15), ("audit", 15)])
    counts = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 706, "validation": 151, "audit": 151}
    assert sorted(r["rank"] for r in assigned.collect()) == list(range(1, 1009))


def test_color_maps_are_distinct():
    maps = splits.color_maps("d", [1, 2, 3, 4])
    assert all(m[0] == 0 and sorted(m) == sorted(m.values()) == list(range(10)) for m in maps)
    assert all(a != b for a, b in itertools.combinations(maps, 2)) and grids.INVERSE_D4["rotate_90"] == "rotate_270"


def test_pairs_that_differ_in_colours_only_are_searched_once(spark, monkeypatch):
    """A thousand copies in other colours cost one search; each pair keeps its own colours."""
    sizes = []
    inner = isomorphism.partners
    monkeypatch.setattr(isomorphism, "partners", lambda pairs, records: sizes.append((pairs.count(), records.count())) or inner(pairs, records))
    others = {f"o{k}": image(BASE, "rotate_90", (1, 2, 0), {c: (c + k) % 10 for c in range(10)}) for k in range(10)}
    found = searched(spark, BASE, others)
    assert sizes == [(1, 2)]
    assert all(found[name]["status"] == "matched" and replay(BASE, other, found[name]) for name, other in others.items())


def test_blocks_are_dealt_in_strips(spark, monkeypatch):
    """A block of more pairs than a task is to make is dealt over several; every pair is made once."""
    monkeypatch.setattr(cluster, "PAIRS_A_TASK", 20)
    records = spark.createDataFrame([(i, "big" if i < 40 else "none" if i == 40 else f"k{i % 7}") for i in range(70)] + [(99, None)], "record_id int, k string")
    made = cluster.blocked_pairs(records, "k")
    keys = {r["record_id"]: r["k"] for r in records.collect()}
    expected = sorted((a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] is not None and keys[a] == keys[b])
    assert sorted(map(tuple, made.collect())) == expected
    assert max(r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 400


def test_components_by_contraction(spark, monkeypatch):
    """Against a plain union; ends that are no nodes, loops and repeated edges bring nothing, and the tables of later rounds shrink."""
    rng = random.Random(8)
    edges = [(i + 1, i) for i in range(300) if i % 60] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(7, 7), (900, 3), (900, 500), (5, 4), (4, 5)]
    label = list(range(620))
    for _ in range(620):
        for u, v in edges:
            if u != 900:
                label[u] = label[v] = min(label[u], label[v])
    sizes = []
    inner = cluster.shared.written
    monkeypatch.setattr(cluster.shared, "written", lambda df: (lambda out: sizes.append(out.count()) or out)(inner(df)))
    nodes = spark.createDataFrame([(i,) for i in range(620)], "node long")
    got = {r["node"]: r["label"] for r in cluster.min_label_components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict(enumerate(label))
    assert sum(sizes) < 9 * len(edges)
