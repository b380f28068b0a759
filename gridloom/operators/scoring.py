"""Top-K scoring with full denominators.

answers: (task_id, output_index, expected); attempts: (task_id, output_index,
attempt_no, grid). Missing tasks and outputs count as wrong, so answers are the
left side of every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids


def explode_answers(tasks: DataFrame) -> DataFrame:
    """(task_id, output_index, expected) from (task_id, task)."""
    return tasks.select("task_id", F.posexplode("task.test").alias("output_index", "pair")).select("task_id", "output_index", F.col("pair.output").alias("expected"))


def explode_attempts(predictions: DataFrame) -> DataFrame:
    """(task_id, output_index, attempt_no, grid) from (task_id, outputs)."""
    outputs = predictions.select("task_id", F.posexplode("outputs").alias("output_index", "attempts"))
    rows = outputs.select("task_id", "output_index", F.explode("attempts").alias("key", "grid"))
    return rows.select("task_id", "output_index", F.regexp_extract("key", r"^attempt_([1-9][0-9]*)\z", 1).try_cast("int").alias("attempt_no"), "grid")


def unknown_predictions(predictions: DataFrame, answers: DataFrame) -> DataFrame:
    """Task ids that are predicted but not asked for."""
    return predictions.select("task_id").distinct().join(answers.select("task_id").distinct(), "task_id", "left_anti")


def best_of_k(answers: DataFrame, attempts: DataFrame, top_k: int, exact: Column, matches: Column, keys: list[str]) -> DataFrame:
    """Per answer row (keys): whether any of the first K attempts is exact, and its best number of matches.

    Attempts are summed up before the join, so it only meets one row for each output.
    """
    if top_k < 1:
        raise ValueError("top_k must be a positive integer")
    joined = answers.join(attempts.where(F.col("attempt_no") <= top_k), keys, "left")
    return joined.groupBy(*keys).agg(
        F.coalesce(F.bool_or(exact), F.lit(False)).alias("exact"),
        F.coalesce(F.max(matches), F.lit(0)).cast("long").alias("matches"),
    )


def output_scores(answers: DataFrame, attempts: DataFrame, top_k: int = 2) -> DataFrame:
    """(task_id, output_index, exact, matches, cells) for every declared output."""
    keys = ["task_id", "output_index"]
    scored = best_of_k(answers, attempts, top_k, F.col("grid") == F.col("expected"), grids.cell_matches(F.col("grid"), F.col("expected")), keys)
    return scored.join(answers.select(*keys, grids.cell_count(F.col("expected")).alias("cells")), keys)


def task_scores(outputs: DataFrame, task: str = "task_id") -> DataFrame:
    """A task is exact when all its outputs are."""
    return outputs.groupBy(task).agg(F.bool_and("exact").alias("exact"), F.count("*").alias("outputs"), F.count_if("exact").alias("outputs_exact"), F.sum("matches").alias("matches"), F.sum("cells").alias("cells"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def score(answers: DataFrame, attempts: DataFrame, top_k: int = 2) -> DataFrame:
    """One row: the eleven metrics of a prediction set."""
    by_task = task_scores(output_scores(answers, attempts, top_k))
    predicted = attempts.select("task_id").distinct().withColumn("predicted", F.lit(True))
    row = by_task.join(predicted, "task_id", "left").agg(
        F.count("*").alias("tasks_total"),
        F.count_if("predicted").alias("tasks_predicted"),
        F.count_if("exact").alias("tasks_exact"),
        F.coalesce(F.sum("outputs"), F.lit(0)).alias("outputs_total"),
        F.coalesce(F.sum("outputs_exact"), F.lit(0)).alias("outputs_exact"),
        F.coalesce(F.sum("cells"), F.lit(0)).alias("cells_total"),
        F.coalesce(F.sum("matches"), F.lit(0)).alias("cells_correct"),
    )
    c = F.col
    return row.select(
        F.lit(top_k).alias("top_k"), "tasks_total", "tasks_predicted", "tasks_exact", ratio(c("tasks_exact"), c("tasks_total")).alias("task_exact_accuracy"),
        "outputs_total", "outputs_exact", ratio(c("outputs_exact"), c("outputs_total")).alias("output_exact_accuracy"),
        "cells_total", "cells_correct", ratio(c("cells_correct"), c("cells_total")).alias("cell_accuracy"),
    )


def reference_score(tasks: DataFrame, predictions: DataFrame, top_k: int = 2) -> DataFrame:
    """Exact counts by another formulation, over whole arrays: a check of score()."""
    both = tasks.select("task_id", "task").join(predictions.select("task_id", "outputs"), "task_id", "left")
    keys = F.transform(F.sequence(F.lit(1), F.lit(top_k)), lambda i: F.concat(F.lit("attempt_"), i.cast("string")))
    hit = F.transform(
        F.col("task.test"),
        lambda p, i: F.exists(keys, lambda k: F.coalesce(F.try_element_at(F.get(F.col("outputs"), i), k) == p["output"], F.lit(False))),
    )
    judged = both.select("task_id", hit.alias("hit"), F.col("outputs").isNotNull().alias("predicted"))
    return judged.agg(
        F.count("*").alias("tasks_total"),
        F.count_if("predicted").alias("tasks_predicted"),
        F.count_if(F.forall("hit", lambda h: h)).alias("tasks_exact"),
        F.coalesce(F.sum(F.size("hit")), F.lit(0)).alias("outputs_total"),
        F.coalesce(F.sum(F.size(F.filter("hit", lambda h: h))), F.lit(0)).alias("outputs_exact"),
    )
