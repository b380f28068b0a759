"""Task, prediction and answer sources: JSON files, read strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validation
from ..schemas import PREDICTIONS, TASK


class DatasetError(ValueError):
    """A source is empty, or holds what it must not."""


def json_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, split, task_id, text) of the .json files at a path: a file, a folder, or all below it.

    A path without files is an error. Parts of the path sort as parts, not as text.
    """
    reader = spark.read.option("pathGlobFilter", "*.json")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    name = F.col("_metadata.file_path")
    rows = reader.text(path, wholetext=True).select(
        name.alias("path"), F.regexp_extract(name, r"([^/]+)/[^/]+\z", 1).alias("split"), F.regexp_extract(name, r"([^/]+)\.json\z", 1).alias("task_id"), F.col("value").alias("text")
    )
    if rows.select("path").limit(1).count() == 0:
        raise DatasetError(f"{path}: no task files")
    return rows


def path_order() -> Column:
    return F.split("path", "/")


def enumerate_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Files of a dataset: those directly in the folder, or else those of its split folders."""
    try:
        return json_files(spark, path)
    except DatasetError:  # no file directly in the folder
        return json_files(spark, f"{path.rstrip('/')}/*/")


def parse_tasks(files: DataFrame, require_test_outputs: bool = True) -> DataFrame:
    """files plus task and errors (codes, empty when valid); `name` must be the file's stem."""
    parsed = files.withColumn("task", F.from_json("text", TASK, {"mode": "PERMISSIVE"}))
    errors = validation.task_errors(F.col("text"), F.col("task"), require_test_outputs)
    stem = F.when(F.col("task.name").isNotNull() & (F.col("task.name") != F.col("task_id")), F.array(F.lit("name_is_not_stem"))).otherwise(F.array().cast("array<string>"))
    return parsed.withColumn("errors", F.concat(errors, stem))


def load_tasks(spark: SparkSession, path: str, require_test_outputs: bool = True, recursive: bool = False) -> DataFrame:
    """(split, task_id, path, task, errors)."""
    return parse_tasks(json_files(spark, path, recursive), require_test_outputs).select("split", "task_id", "path", "task", "errors")


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, path, task) of a split without its checks: whatever of the schema a text holds; null where it is no strict JSON."""
    return json_files(spark, path).select("task_id", "path", F.from_json("text", TASK, {"mode": "PERMISSIVE"}).alias("task"), F.try_parse_json("text").isNotNull().alias("strict")).select("task_id", "path", F.when(F.col("strict"), F.col("task")).alias("task"))


def batch_validate(tasks: DataFrame) -> DataFrame:
    """One row: files (each path once), and those with errors."""
    return tasks.dropDuplicates(["path"]).agg(F.count("*").alias("files"), F.count_if(F.size("errors") > 0).alias("invalid"))


def load_training_source(spark: SparkSession, name: str, path: str, expected: int) -> DataFrame:
    """(record_id, source, task_id, task, sha256) of a folder named training.

    Raises for another folder name, an evaluation part in the path, a wrong
    number of files, a repeated id or an invalid task.
    """
    parts = path.rstrip("/").split("/")
    if parts[-1] != "training" or "evaluation" in parts:
        raise DatasetError(f"{path}: only a training folder can be a source")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    text = files.select("path", F.regexp_extract("path", r"([^/]+)\.json\z", 1).alias("task_id"), F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"))
    rows = parse_tasks(text).select(F.concat_ws(":", F.lit(name), "task_id").alias("record_id"), F.lit(name).alias("source"), "task_id", "task", "sha256", "errors")
    found = rows.agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("ids"), F.count_if(F.size("errors") > 0).alias("bad")).first()
    if (found["n"], found["ids"], found["bad"]) != (expected, expected, 0):
        raise DatasetError(f"{path}: expected {expected} valid tasks of distinct ids, found {found['n']} files, {found['ids']} ids, {found['bad']} invalid")
    return rows.drop("errors")


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, outputs, errors) of a prediction file; a file that is no strict JSON object is one row with an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    strict = F.try_parse_json("text").isNotNull()
    rows = files.select(strict.alias("strict"), F.when(strict, F.from_json("text", PREDICTIONS)).alias("m"))
    entries = rows.select("strict", F.explode_outer("m").alias("task_id", "outputs"))
    errors = F.when(~F.col("strict") | F.col("outputs").isNull(), F.array(F.lit("strict_json"))).otherwise(validation.attempt_errors(F.col("outputs")))
    return entries.select("task_id", "outputs", errors.alias("errors"))


def prediction_errors(predictions: DataFrame, answers: DataFrame) -> DataFrame:
    """(task_id, errors) of all predictions that may not be scored against answers (task_id, output_index, expected)."""
    wanted = answers.groupBy("task_id").agg(F.count("*").alias("n"))
    rows = predictions.join(wanted, "task_id", "left")
    more = F.array_compact(F.array(F.when(F.col("n").isNull(), "unknown_task"), F.when(F.size("outputs") != F.col("n"), "output_count")))
    return rows.select("task_id", F.concat("errors", more).alias("errors")).where(F.size("errors") > 0)
