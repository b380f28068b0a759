"""The A/B run: one plan over two views that differ in nothing but their hidden labels.

Each view is written as two trees, what a solver may see and the labels. The
solver reads the files of the first only; its predictions are a written table
before any label is read. The proof joins both views' manifests, labels and
predictions. A solver whose predictions follow the labels can't pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import GRID
from ..sources import task_tree, tasks
from . import scoring, shared


@dataclass(frozen=True)
class View:
    """Where a view's trees and its predictions are."""

    folder: str

    @property
    def inputs(self) -> str:
        return f"{self.folder}/inputs"

    @property
    def labels(self) -> str:
        return f"{self.folder}/labels"


Solver = Callable[[DataFrame, View], DataFrame]


def write_view(labelled: DataFrame, folder: str) -> View:
    """The label-free files of tasks (task_id, task) with their manifest, and apart from them the labels."""
    view = View(folder)
    task_tree.write_tree(labelled, view.inputs, source_id="ab-view")
    labelled.select("task_id", F.to_json(F.transform("task.test", lambda p: p["output"])).alias("outputs")).write.mode("errorifexists").parquet(view.labels)
    return view


def read_inputs(spark: SparkSession, view: View) -> DataFrame:
    """(task_id, task) of the label-free files, read strictly and written; an invalid one is an error, and so is a view without files.

    The files are read by tasks, many in each: a scan would list and open them one by one.
    """
    found = task_tree.read_tree(spark, view.inputs).where("text is not null")
    files = found.select("path", F.regexp_extract("path", r"([^/]+)\.json\z", 1).alias("task_id"), "text")
    rows = tasks.parse_tasks(files, require_test_outputs=False)
    sound = F.when(F.size("errors") == 0, F.col("task")).otherwise(F.raise_error(F.concat(F.lit("invalid task file: "), "path")))
    read = shared.written(rows.select("task_id", sound.alias("task")))
    if read.isEmpty():
        raise tasks.DatasetError(f"{view.inputs}: no task files")
    return read


def read_labels(spark: SparkSession, view: View) -> DataFrame:
    """(task_id, outputs): the hidden outputs in order."""
    return spark.read.parquet(view.labels).select("task_id", F.from_json("outputs", f"array<{GRID}>").alias("outputs"))


def solve(view: View, inputs: DataFrame, solver: Solver) -> DataFrame:
    """(task_id, outputs) of the solver, written; the labels are read after it."""
    return shared.written(solver(inputs, view).select("task_id", "outputs"))


def exact_tasks(spark: SparkSession, view: View, predictions: DataFrame, top_k: int) -> DataFrame:
    """(task_id, exact) by the labels of the view."""
    answers = read_labels(spark, view).select("task_id", F.posexplode("outputs").alias("output_index", "expected"))
    scores = scoring.task_scores(scoring.output_scores(answers, scoring.explode_attempts(predictions), top_k))
    return scores.select("task_id", "exact")


def prepare(given: DataFrame, other: DataFrame, folder: str) -> list[tuple[View, DataFrame]]:
    """Both views of the same tasks (task_id, task), written as trees, each with what its files hold: for any number of solvers."""
    views = [write_view(labelled, f"{folder}/{name}") for name, labelled in (("a", given), ("b", other))]
    return [(view, read_inputs(given.sparkSession, view)) for view in views]


def ab_run(given: DataFrame, other: DataFrame, folder: str, solver: Solver, top_k: int = 2) -> DataFrame:
    """The proof of one solver over two views, given and other, that hold the same tasks (task_id, task) with unlike labels."""
    return proof(prepare(given, other, folder), solver, top_k)


def proof(views: list[tuple[View, DataFrame]], solver: Solver, top_k: int = 2) -> DataFrame:
    """One row: tasks, equal_inputs, changed_labels, equal_predictions, exact_a, exact_b, verdict.

    verdict is
    passed where every task is in both views with equal files and unlike labels, and
    its predictions are equal; else failed. Tasks that only one side has count as
    unequal. Views without tasks are an error, as any source without files is.
    """
    sides = []
    for name, (view, inputs) in zip("ab", views, strict=True):
        spark = inputs.sparkSession
        made = solve(view, inputs, solver)
        files = task_tree.read_manifest(spark, view.inputs).select(F.regexp_extract("path", r"([^/]+)\.json\z", 1).alias("task_id"), F.col("sha256").alias(f"file_{name}"))
        labels = spark.read.parquet(view.labels).select("task_id", F.sha2("outputs", 256).alias(f"label_{name}"))
        digests = made.select("task_id", F.sha2(F.to_json("outputs"), 256).alias(f"made_{name}"))
        exact = exact_tasks(spark, view, made, top_k).withColumnRenamed("exact", f"exact_{name}")
        sides.append(files.join(labels, "task_id", "full").join(digests, "task_id", "left").join(exact, "task_id", "left"))
    both = sides[0].join(sides[1], "task_id", "full")
    counted = both.agg(
        F.count("*").alias("tasks"), F.count_if(F.col("file_a") == F.col("file_b")).alias("equal_inputs"), F.count_if(F.col("label_a") != F.col("label_b")).alias("changed_labels"),
        F.count_if(F.col("made_a") == F.col("made_b")).alias("equal_predictions"), F.count_if("exact_a").alias("exact_a"), F.count_if("exact_b").alias("exact_b"),
    )
    whole = F.least("equal_inputs", "changed_labels", "equal_predictions") == F.col("tasks")
    return counted.withColumn("verdict", F.when(whole, "passed").otherwise("failed"))
