"""Sinks: challenge trees (task_tree), canonical and pretty JSON, atomic and no-clobber documents, split outputs."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids
from . import task_tree


def canonical_bytes(value: Any) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def pretty_bytes(value: Any) -> bytes:
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n").encode()


def write_document(path: str, value: Any, clobber: bool = True) -> None:
    """A whole document or none: written beside its place, flushed and renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if not clobber and target.exists():
        raise FileExistsError(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(pretty_bytes(value))
            out.flush()
            os.fsync(out.fileno())
        if clobber:
            os.replace(name, target)
        else:
            os.link(name, target)
    finally:
        if os.path.exists(name):
            os.unlink(name)


def write_challenge(tasks: DataFrame, destination: str, source: str = "", source_id: str = "redacted") -> None:
    """Label-free task files (task_id, task) and their manifest, whole or not at all; never below the source or over anything."""
    task_tree.write_tree(tasks, destination, source, source_id)


def write_split_trees(tasks: DataFrame, destination: str) -> None:
    """Inference rows and hidden solutions, in two trees of one table."""
    inference = tasks.select(F.lit("inference").alias("tree"), "task_id", F.to_json(grids.challenge_only(F.col("task"))).alias("text"))
    solutions = tasks.select(F.lit("solutions").alias("tree"), "task_id", F.to_json(F.transform("task.test", lambda p: p["output"])).alias("text"))
    inference.union(solutions).write.mode("errorifexists").partitionBy("tree").parquet(destination)
