"""Command line: validate, list, score, baseline, challenge. Exit 0: well; 1: invalid tasks; 2: an error."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import baseline, scoring
from .session import build_session
from .sources import sinks, tasks


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = None
    for path in a.paths:
        part = tasks.load_tasks(spark, path, not a.allow_missing_test_outputs)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.dropDuplicates(["path"])
    for r in rows.where(F.size("errors") > 0).select("path", "errors").orderBy(F.split("path", "/")).toLocalIterator():
        print(f"{r['path']}: {', '.join(r['errors'])}", file=sys.stderr)
    found = tasks.batch_validate(rows).first()
    print(f"{found['files']} files, {found['invalid']} invalid")
    return int(found["invalid"] > 0)


def _list(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = tasks.enumerate_dataset(spark, a.dataset)
    if a.tasks or a.json:
        listed = rows.select("split", "task_id", "path").orderBy("split", F.split("path", "/")).collect()
        if a.json:
            print(json.dumps({s: [r["task_id"] for r in listed if r["split"] == s] for s in sorted({r["split"] for r in listed})}))
        else:
            for r in listed:
                print(f"{r['split']}\t{r['task_id']}\t{r['path']}")
        return 0
    for r in rows.rollup("split").agg(F.count("*").alias("n")).select(F.coalesce("split", F.lit("total")).alias("split"), "n").orderBy(F.col("split") == "total", "split").collect():
        print(f"{r['split']}\t{r['n']}")
    return 0


def _checked(spark: SparkSession, path: str, labelled: bool = True):
    rows = tasks.load_tasks(spark, path, labelled)
    if rows.where(F.size("errors") > 0).limit(1).count():
        raise ValueError(f"{path}: invalid tasks")
    return rows


def _score(spark: SparkSession, a: argparse.Namespace) -> int:
    answers = scoring.explode_answers(_checked(spark, a.task_dir))
    predicted = tasks.load_predictions(spark, a.predictions)
    wrong = tasks.prediction_errors(predicted, answers).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['task_id']}: {', '.join(r['errors'])}" for r in wrong))
    row = scoring.score(answers, scoring.explode_attempts(predicted), a.top_k).first().asDict()
    print(json.dumps(row) if a.json else "\n".join(f"{k}\t{v}" for k, v in row.items()))
    return 0


def _baseline(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _checked(spark, a.task_dir, labelled=a.score)
    ranked = baseline.rank_candidates(rows, 2)
    if baseline.short_outputs(rows, ranked, 2).limit(1).count():
        raise ValueError("too few distinct candidates")
    made = baseline.predictions(ranked)
    if a.output:
        sinks.write_document(a.output, {r["task_id"]: r["outputs"] for r in made.toLocalIterator()})
    counts = {r["solver"]: r["attempts"] for r in baseline.solver_counts(ranked).collect()}
    report = {"task_dir": a.task_dir, "top_k": 2, "solver_attempt_counts": counts}
    if a.score:
        attempts = ranked.select("task_id", "output_index", F.col("rank").alias("attempt_no"), "grid")
        report["score"] = scoring.score(scoring.explode_answers(rows), attempts, 2).first().asDict()
    if a.metadata:
        sinks.write_document(a.metadata, report)
    print(json.dumps(report))
    return 0


def _challenge(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _checked(spark, a.source, labelled=False)
    sinks.write_challenge(rows, a.destination, a.source)
    print(json.dumps({"tasks": rows.count(), "destination": a.destination}))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    commands = top.add_subparsers(dest="command", required=True)
    for name, run, arguments in (
        ("validate", _validate, [("paths", {"nargs": "+"}), ("--allow-missing-test-outputs", {"action": "store_true"})]),
        ("list", _list, [("dataset", {}), ("--tasks", {"action": "store_true"}), ("--json", {"action": "store_true"})]),
        ("score", _score, [("predictions", {}), ("task_dir", {}), ("--top-k", {"type": int, "default": 2}), ("--json", {"action": "store_true"})]),
        ("baseline", _baseline, [("task_dir", {}), ("--output", {}), ("--metadata", {}), ("--score", {"action": "store_true"}), ("--json", {"action": "store_true"})]),
        ("challenge", _challenge, [("source", {}), ("destination", {}), ("--json", {"action": "store_true"})]),
    ):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for flag, options in arguments:
            p.add_argument(flag, **options)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(spark or build_session(), a)
    except (ValueError, FileExistsError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
