import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import baseline, scoring
from gridloom.schemas import TASK

ANSWERS = "task_id string, output_index int, expected array<array<int>>"
ATTEMPTS = "task_id string, output_index int, attempt_no int, grid array<array<int>>"


def total(spark, answers, attempts, k):
    return scoring.score(spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(attempts, ATTEMPTS), k).first()


def test_two_outputs(spark):
    answers = [("multi", 0, [[1, 1], [1, 1]]), ("multi", 1, [[2, 2]])]
    attempts = [("multi", 0, 1, [[1, 1], [1, 1]]), ("multi", 1, 1, [[2, 0]]), ("multi", 1, 2, [[2, 2]])]
    one, two = total(spark, answers, attempts, 1), total(spark, answers, attempts, 2)
    assert (one["outputs_exact"], one["tasks_exact"], one["cells_correct"], one["cells_total"]) == (1, 0, 5, 6)
    assert (two["outputs_exact"], two["tasks_exact"], two["cells_correct"]) == (2, 1, 6)


def test_budget_missing_shape_and_weights(spark):
    tries = [("t", 0, 1, [[0]]), ("t", 0, 2, [[0]]), ("t", 0, 3, [[9]])]
    assert [total(spark, [("t", 0, [[9]])], tries, k)["outputs_exact"] for k in (2, 3)] == [0, 1]
    row = total(spark, [("missing", 0, [[1]]), ("shape", 0, [[1, 1]])], [("shape", 0, 1, [[1], [1]])], 2)
    assert (row["outputs_exact"], row["cells_correct"], row["cells_total"], row["tasks_predicted"]) == (0, 0, 3, 1)
    row = total(spark, [("m", 0, [[1]]), ("m", 1, [[2]]), ("s", 0, [[3]])], [("m", 0, 1, [[1]]), ("m", 1, 1, [[2]])], 2)
    assert row["output_exact_accuracy"] == pytest.approx(2 / 3) and row["task_exact_accuracy"] == 0.5
    empty = total(spark, [], [], 2)
    assert (empty["tasks_total"], empty["cell_accuracy"]) == (0, 0.0)


def test_scorers_agree_on_random_cases(spark):
    rng = random.Random(20260806)
    tasks, predictions = [], []
    for n in range(80):
        outputs = [[[rng.randrange(4) for _ in range(rng.randint(1, 4))]] for _ in range(rng.randint(1, 3))]
        tasks.append((f"t{n}", (None, [([[0]], [[0]])], [([[0]], o) for o in outputs])))
        if rng.random() < 0.75:
            predictions.append((f"t{n}", [{f"attempt_{i}": o if rng.random() < 0.35 else [[rng.randrange(4)]] for i in range(1, rng.randint(1, 4) + 1)} for o in outputs]))
    t = spark.createDataFrame(tasks, f"task_id string, task {TASK}")
    p = spark.createDataFrame(predictions, "task_id string, outputs array<map<string,array<array<int>>>>")
    for k in (1, 2, 3):
        a = scoring.score(scoring.explode_answers(t), scoring.explode_attempts(p), k).first()
        b = scoring.reference_score(t, p, k).first()
        assert b.asDict() == {c: a[c] for c in b.asDict()}


def task(train, test):
    return (None, [(i, o) for i, o in train], [(i, None) for i in test])


def test_candidates_in_rank_order(spark):
    turned = task([([[1, 2]], [[1], [2]])], [[[3, 4]]])
    mapped = task([([[0, 1]], [[2, 3]])], [[[0, 1, 9]]])
    unlike = task([([[0, 0]], [[1, 2]])], [[[5, 5]]])
    df = spark.createDataFrame([("turned", turned), ("mapped", mapped), ("unlike", unlike)], f"task_id string, task {TASK}")
    got = {}
    for r in baseline.rank_candidates(df, 2).orderBy("task_id", "rank").collect():
        got.setdefault(r["task_id"], []).append((r["solver"], r["grid"]))
    assert got["turned"][0] == ("rotate_90", [[3], [4]])
    assert got["mapped"] == [("color_mapping", [[2, 3, 9]]), ("copy_input", [[0, 1, 9]])]
    assert got["unlike"] == [("copy_input", [[5, 5]]), ("constant_color:0", [[0, 0]])]


def test_predictions_do_not_read_labels(spark):
    df = spark.createDataFrame([("a", (None, [([[1]], [[1]])], [([[2]], [[7]])])), ("b", (None, [([[1]], [[1]])], [([[2]], [[8]])]))], f"task_id string, task {TASK}")
    a, b = (df.where(F.col("task_id") == x) for x in "ab")
    strip = lambda d: [tuple(r)[1:] for r in baseline.rank_candidates(d).orderBy("rank").collect()]
    assert strip(a) == strip(b)
    made = baseline.predictions(baseline.rank_candidates(df)).where("task_id = 'a'").first()
    assert list(made["outputs"][0]) == ["attempt_1", "attempt_2"]
