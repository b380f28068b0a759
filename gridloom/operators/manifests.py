"""Manifests: benchmark inventories, exposure tiers, task orders, method admission, reproduction funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validation import TASK_ID
from . import evidence


def benchmark_errors(tasks: DataFrame, expected: DataFrame) -> DataFrame:
    """(benchmark, split, error) of tasks (benchmark, split, task_id) against expected (benchmark, split, n)."""
    counts = tasks.groupBy("benchmark", "split").agg(F.count("*").alias("found"), F.count_distinct("task_id").alias("ids"), F.count_if(~F.col("task_id").rlike(TASK_ID)).alias("bad"))
    both = expected.join(counts, ["benchmark", "split"], "full")
    checks = F.array_compact(
        F.array(
            F.when(F.col("found").isNull(), "missing-split"), F.when(F.col("n").isNull(), "unknown-split"), F.when(F.col("found") != F.col("n"), "count"),
            F.when(F.col("found") != F.col("ids"), "duplicate-id"), F.when(F.col("bad") > 0, "id-format"),
        )
    )
    per_split = both.select("benchmark", "split", F.explode(checks).alias("error"))
    crossing = tasks.groupBy("benchmark", "task_id").agg(F.count_distinct("split").alias("k")).where("k > 1")
    return per_split.union(crossing.select("benchmark", F.lit(None).cast("string"), F.concat(F.lit("crosses-splits:"), "task_id")))


def benchmark_totals(tasks: DataFrame) -> DataFrame:
    """Counts of tasks (benchmark, split, task, bytes) per split, per benchmark and over all."""
    rows = tasks.select("benchmark", "split", "bytes", F.size("task.train").alias("train"), F.size("task.test").alias("test"))
    return rows.rollup("benchmark", "split").agg(F.count("*").alias("tasks"), F.sum("train").alias("train_pairs"), F.sum("test").alias("test_pairs"), F.sum("bytes").alias("bytes"))


def exposure(paths: DataFrame, rules: Sequence[dict[str, str]]) -> DataFrame:
    """paths plus tier, rule and reason; a path that no rule matches has nulls (and is an error of the inventory)."""
    p = F.col("path")
    return paths.withColumns({"tier": evidence.first_rule(p, rules, "tier"), "rule": evidence.first_rule(p, rules, "glob"), "reason": evidence.first_rule(p, rules, "reason")})


def control_plane_errors(runs: DataFrame, policies: DataFrame) -> DataFrame:
    """(path, errors) of attestation records (path, text) of the policies (path, method_id, runner, scope, allowed)."""
    both = runs.join(policies, "path").withColumn("m", F.from_json("text", "map<string,string>"))
    get = lambda k: F.try_element_at(F.col("m"), F.lit(k))
    checks = {f"identity:{k}": get(k).eqNullSafe(F.col(k)) for k in ("method_id", "runner", "scope")}
    checks |= {
        "status": get("status").isin("passed", "failed"),
        "unknown-field": F.size(F.array_except(F.map_keys("m"), F.col("allowed"))) == 0,
        "run-id": F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1) == get("run_id"),
        "manifest": (get("status") != "passed") | F.coalesce(get("manifest").startswith("{"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]))
    return both.select("path", broken.alias("errors"))


def admission(methods: DataFrame, rosters: Sequence[DataFrame], layers: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(keys that not all rosters have, conditional counts of the methods)."""
    return evidence.roster_agreement([methods.select("method_id"), *[r.select("method_id") for r in rosters]], "method_id"), evidence.funnel(methods, layers)


def reproduction_funnel(records: DataFrame, declared: DataFrame, layers: Sequence[str]) -> DataFrame:
    """(method_id, layer, declared, observed, agrees): the latest record of each method and layer against the declaration.

    records: (method_id, layer, status, started, ended, path); declared: (method_id, layer, status).
    """
    order = F.coalesce("ended", "started", F.lit(""))
    last = evidence.latest(records.withColumn("__t", order).select("method_id", "layer", "status", "__t", "path"), ["method_id", "layer"], [F.col("__t"), F.col("path")])
    grid = declared.select("method_id").distinct().withColumn("layer", F.explode(F.array(*[F.lit(x) for x in layers])))
    stated = declared.select("method_id", "layer", F.col("status").alias("declared"))
    out = grid.join(stated, ["method_id", "layer"], "left").join(last.select("method_id", "layer", F.col("status").alias("observed")), ["method_id", "layer"], "left")
    return out.withColumn("agrees", F.col("declared").eqNullSafe(F.col("observed")))
