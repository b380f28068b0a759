"""A contract for outside solvers: what they are shown, what they may return, and what becomes of failures.

A solver is a Python function of one label-free task (a dict as in a task file). It
returns, for each test input in order, a list of at most K grids, best first. It
runs in the tasks of the plan, once for each task, and never sees an id, a label
or another task. What it raises, or returns against the contract, is a row of
that task and touches no other.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids
from . import scoring

Solver = Callable[[dict[str, Any]], list[list[list[list[int]]]]]
RETURNED = "task_id string, output_index int, attempt_no int, grid array<array<int>>, seconds double, error string"


def contract_error(outputs: Any, tests: int, top_k: int) -> str | None:
    """What of the contract a solver's return breaks: output_count, attempt_count or grid."""
    if not isinstance(outputs, list) or len(outputs) != tests:
        return "output_count"
    for attempts in outputs:
        if not isinstance(attempts, list) or not 1 <= len(attempts) <= top_k:
            return "attempt_count"
        for g in attempts:
            rows = g if isinstance(g, list) and 1 <= len(g) <= 30 else [[]]
            sound = all(isinstance(r, list) and 1 <= len(r) <= 30 and len(r) == len(rows[0]) for r in rows)
            if not sound or not all(type(c) is int and 0 <= c <= 9 for r in rows for c in r):
                return "grid"
    return None


def run_solver(tasks: DataFrame, solver: Solver, top_k: int = 2) -> DataFrame:
    """(task_id, output_index, attempt_no, grid, seconds, error) of tasks (task_id, task).

    A row an attempt; a task that failed has one row with its error (the exception's
    name, or `contract:` and what is broken) and no grid. seconds is the solver's own
    time on the task.
    """
    seen = tasks.select("task_id", F.to_json(grids.challenge_only(F.col("task"))).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for task_id, text in zip(frame["task_id"], frame["text"], strict=True):
                task, began = json.loads(text), time.perf_counter()
                try:
                    outputs = solver(task)
                    broken = contract_error(outputs, len(task["test"]), top_k)
                    error = broken and f"contract:{broken}"
                except Exception as e:  # noqa: BLE001  whatever a solver raises is a row
                    error = type(e).__name__
                took = time.perf_counter() - began
                if error:
                    rows.append((task_id, None, None, None, took, error))
                else:
                    rows += [(task_id, i, k, g, took, None) for i, attempts in enumerate(outputs) for k, g in enumerate(attempts, 1)]
            yield pd.DataFrame(rows, columns=["task_id", "output_index", "attempt_no", "grid", "seconds", "error"]).astype({"output_index": "Int32", "attempt_no": "Int32"})

    return seen.mapInPandas(run, RETURNED)


def solver_report(tasks: DataFrame, returned: DataFrame, top_k: int = 2) -> DataFrame:
    """One row: tasks, errors by name, attempts, seconds, and exact tasks of all; a task that failed counts as wrong."""
    made = returned.where("error is null").select("task_id", "output_index", "attempt_no", "grid")
    exact = scoring.task_scores(scoring.output_scores(scoring.explode_answers(tasks), made, top_k)).agg(F.count("*").alias("tasks"), F.count_if("exact").alias("exact"))
    failed = returned.where("error is not null").groupBy("error").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    errors = failed.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "error", F.col("n").cast("string")))), ","), F.lit("")).alias("errors"))  # a row an error's name
    per = returned.groupBy("task_id").agg(F.count("grid").alias("attempts"), F.max("seconds").alias("seconds"))
    spent = per.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    return exact.crossJoin(errors).crossJoin(spent).select("tasks", "exact", "attempts", "errors", "seconds")  # one row each
