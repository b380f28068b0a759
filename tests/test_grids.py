import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import grids

GRID = "g array<array<int>>"
#: What each transform is in terms of quarter turns counter-clockwise after a transposition or none.
BY_TURNS = {
    "identity": (False, 0), "rotate_90": (False, 3), "rotate_180": (False, 2), "rotate_270": (False, 1),
    "flip_horizontal": (True, 3), "flip_vertical": (True, 1), "transpose": (True, 0), "anti_transpose": (True, 2),
}


def turned(grid, name):
    first, quarters = BY_TURNS[name]
    return np.rot90(np.array(grid).T if first else np.array(grid), quarters).tolist()


@pytest.fixture(scope="module")
def shapes(spark):
    """Every shape from 1 x 1 to 5 x 6, one of 30 x 30 and one of 1 x 30."""
    sides = [(h, w) for h in range(1, 6) for w in range(1, 7)] + [(30, 30), (1, 30)]
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(rng.integers(0, 10, s).tolist(),) for s in sides], GRID).persist()


def test_transforms_are_turns_of_the_array(shapes):
    rows = shapes.select("g", *[turn(F.col("g")).alias(name) for name, turn in grids.D4.items()]).collect()
    assert list(grids.D4) == list(BY_TURNS) and len(rows) == 32
    assert all(row[name] == turned(row["g"], name) for row in rows for name in grids.D4)


def test_transforms_form_a_group(shapes):
    """Any two in a row are a third one, and the named inverse undoes each."""
    marked = [[1, 2], [3, 4], [5, 6]]
    third = {(a, b): next(c for c in BY_TURNS if turned(marked, c) == turned(turned(marked, a), b)) for a in BY_TURNS for b in BY_TURNS}
    assert all(third[name, grids.INVERSE_D4[name]] == "identity" for name in BY_TURNS)
    g = F.col("g")
    unlike = [grids.compose(grids.D4[a], grids.D4[b])(g) != grids.D4[c](g) for (a, b), c in third.items() if a != "identity"]
    for part in (unlike[:28], unlike[28:]):
        assert shapes.where(F.array_contains(F.array(*part), True)).isEmpty()


def test_recolouring_is_undone_by_the_inverse_map(shapes):
    rng = np.random.default_rng(9)
    for _ in range(3):
        mapping = dict(enumerate(map(int, rng.permutation(10))))
        there, back = grids.literal_map(mapping), grids.inverse_map(grids.literal_map(mapping))
        rows = shapes.select("g", grids.recolor(there)(F.col("g")).alias("there"), grids.recolor(back)(grids.recolor(there)(F.col("g"))).alias("again")).collect()
        assert all(r["again"] == r["g"] and r["there"] == [[mapping[c] for c in line] for line in r["g"]] for r in rows)


@pytest.mark.parametrize(("mapping", "closed"), [({5: 6, 6: 8, 8: 5}, True), ({3: 3}, True), ({4: 5, 5: 4, 6: 4}, False), ({4: 5, 5: 6}, False), ({7: 0}, False), ({1: 2, 2: 2}, False)])
def test_closed_bijections(spark, mapping, closed):
    assert spark.range(1).select(grids.is_closed_bijection(grids.literal_map(mapping))).first()[0] is closed


def test_colours_outside_a_map_stay(spark):
    df = spark.createDataFrame([([[4, 6], [5, 0]],)], GRID)
    assert df.select(grids.recolor(grids.literal_map({4: 5, 5: 4}))(F.col("g"))).first()[0] == [[5, 6], [4, 0]]


def test_permutations(spark):
    rng = np.random.default_rng(2)
    rows = [([f"v{k}" for k in range(n)], list(map(int, rng.permutation(n)))) for n in range(9)]
    v, o = F.col("v"), F.col("o")
    df = spark.createDataFrame(rows, "v array<string>, o array<int>")
    got = df.select("v", "o", grids.permute(v, o).alias("p"), grids.restore_order(grids.permute(v, o), o).alias("r"), grids.is_permutation(o, F.size(v)).alias("ok"), grids.is_permutation(o, F.size(v) + 1).alias("short"), grids.cyclic_left(o).alias("c"))
    for r in got.where("size(v) > 0").collect():
        assert r["p"] == [r["v"][k] for k in r["o"]] and r["r"] == r["v"] and r["ok"] and not r["short"] and r["c"] == r["o"][1:] + r["o"][:1]


def test_cells_and_colours(spark):
    df = spark.createDataFrame([([[7, 7, 2], [2, 7, 0]], [[7, 0, 2], [2, 7, 7]], [[7, 7], [2, 7]])], "g array<array<int>>, h array<array<int>>, short array<array<int>>")
    g = F.col("g")
    row = df.select(grids.dominant_color(g).alias("most"), grids.cell_matches(g, F.col("h")).alias("same"), grids.cell_matches(g, F.col("short")).alias("shape"), grids.mutate(g, 9).alias("other"), grids.color_count(g, 2).alias("twos")).first()
    assert (row["most"], row["same"], row["shape"], row["twos"]) == (7, 4, 0, 2)
    assert len(row["other"]) == 2 and all(a != b for x, y in zip(row["other"], [[7, 7, 2], [2, 7, 0]], strict=True) for a, b in zip(x, y, strict=True))


def test_attempts_are_numbered_by_place(spark):
    row = spark.range(1).select(grids.solutions_to_predictions(F.array(grids.grid_from_cells([[3, 3]]), grids.grid_from_cells([[1]])), F.array(grids.grid_from_cells([[0]]), grids.grid_from_cells([[2]]))).alias("p")).first()
    assert row["p"] == [{"attempt_1": [[3, 3]], "attempt_2": [[0]]}, {"attempt_1": [[1]], "attempt_2": [[2]]}]


def test_values_within_lambdas_are_worked_out_once(spark):
    """A random argument shows it: worked out again for each element, an order repeats values and a constant grid has several colours."""
    draw = lambda: F.floor(F.rand() * 10).cast("int")
    mapping = F.create_map(F.lit(1), F.lit(10) + draw(), F.lit(2), F.lit(20))
    g = F.lit([[1, 1, 1, 1, 1, 1], [2, 2, 2, 1, 1, 1]])
    shuffled = F.array(*[F.shuffle(F.sequence(F.lit(0), F.lit(9)))] * 2)
    order = F.shuffle(F.sequence(F.lit(0), F.lit(9)))
    row = spark.range(1).select(
        grids.constant(g, draw()).alias("constant"), grids.recolor(mapping)(g).alias("recolor"), grids.transpose(shuffled).alias("transpose"), grids.rotate_90(shuffled).alias("rotate"),
        grids.permute(order, F.sequence(F.lit(0), F.lit(9))).alias("permute"), grids.restore_order(F.sequence(F.lit(0), F.lit(9)), order).alias("restore"), grids.cyclic_left(order).alias("cyclic"),
    ).first()
    assert len({c for r in row["constant"] for c in r}) == 1
    assert len({c for r in row["recolor"] for c in r}) == 2
    assert all(sorted(side) == list(range(10)) for name in ("transpose", "rotate") for side in zip(*row[name], strict=True))
    assert all(sorted(row[name]) == list(range(10)) for name in ("permute", "restore", "cyclic"))
    assert spark.range(1).select(grids.recolor({1: 5, 5: 1, 12: 3})(F.lit([[1, 5, 2, 12, 13, -1]])).alias("g")).first()["g"] == [[5, 1, 2, 3, 13, -1]]
