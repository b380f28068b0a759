"""The protocol root: contracts, gates with their evidence, what is still open, and readiness.

Contracts and gate lists are documents of a few entries; they come as tables, so
that every rule's breaches are rows with a code and none stops the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validation import codes
from . import evidence

#: What a scoring contract must say, and the states of a gate.
PRIMARY_METRIC = "output_exact_pass_at_k"
DENOMINATOR_POLICY = "all_declared_test_outputs"
MISSING_POLICY = "zero_credit_in_declared_denominator"
GATE_STATUSES = ["blocked", "in_progress", "passed", "pending"]


def _listed(paths: Column) -> dict[str, Column]:
    return {"evidence": F.size(paths) > 0, "repeated-evidence": F.size(F.array_distinct(paths)) == F.size(paths)}


def scoring_contract_errors(contracts: DataFrame) -> DataFrame:
    """contracts (name, top_k, denominator_policy, missing_output_policy, evidence) plus `errors`."""
    c = F.col
    checks = {"name": c("name") == PRIMARY_METRIC, "top_k": c("top_k") >= 1, "denominator": c("denominator_policy") == DENOMINATOR_POLICY, "missing-output": c("missing_output_policy") == MISSING_POLICY}
    return contracts.withColumn("errors", codes(checks | _listed(c("evidence"))))


def benchmark_contract_errors(contracts: DataFrame, counts: DataFrame, top_k: int) -> DataFrame:
    """(benchmark, errors): contracts (benchmark, generation, top_k, tasks, outputs, evidence) against counts (benchmark, found_tasks, found_outputs)."""
    c = F.col
    both = contracts.withColumn("__declared", F.lit(True)).join(counts, "benchmark", "full")
    checks = {
        "generation": c("generation") == c("benchmark"),
        "top_k": c("top_k") == top_k,
        "counts": (c("tasks") >= 1) & (c("outputs") >= c("tasks")),
        "denominator": (c("tasks") == c("found_tasks")) & (c("outputs") == c("found_outputs")),
    }
    errors = F.when(c("__declared").isNull(), F.array(F.lit("undeclared"))).when(c("found_tasks").isNull(), F.array(F.lit("unknown-benchmark"))).otherwise(codes(checks | _listed(c("evidence"))))
    return both.select("benchmark", errors.alias("errors"))


def evidence_inventory(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, sha256, bytes, uses) of every declared evidence path once, from an inventory (path, sha256, bytes); nulls where no such file is."""
    return declared.groupBy("path").agg(F.count("*").alias("uses")).join(observed.select("path", "sha256", "bytes"), "path", "left").select("path", "sha256", "bytes", "uses")


def gate_errors(gates: DataFrame, mandatory: Sequence[str]) -> DataFrame:
    """(id, error) of gates (id, status, required, blocker, evidence) and of mandatory ids that are missing or optional."""
    c = F.col
    own = codes(
        {
            "status": c("status").isin(*GATE_STATUSES), "blocker": (c("status") == "passed") | (F.length(F.trim(F.coalesce("blocker", F.lit("")))) > 0),
            "evidence": (c("status") != "passed") | (F.size("evidence") > 0), "repeated-evidence": F.size(F.array_distinct("evidence")) == F.size("evidence"),
        }
    )
    rows = gates.select("id", F.explode(own).alias("error"))
    twice = evidence.duplicates(gates, "id").select("id", F.lit("duplicate").alias("error"))
    if not mandatory:
        return rows.union(twice)
    roster = gates.sparkSession.createDataFrame([(i,) for i in mandatory], "id string")
    known = gates.groupBy("id").agg(F.bool_or("required").alias("required"))
    lacking = roster.join(known, "id", "left").select("id", F.when(c("required").isNull(), "missing").when(~c("required"), "optional").alias("error")).where("error is not null")
    return rows.union(twice).union(lacking)


def readiness(gates: DataFrame, unresolved: DataFrame, frozen: bool) -> DataFrame:
    """One row: gates by status (all statuses, zero-filled), required and unmet gates, whether `unresolved` (gate_id) lists just these, and freeze_ready."""
    unmet = gates.where(F.col("required") & (F.col("status") != "passed")).select(F.col("id").alias("gate_id"))
    unlike = evidence.reconcile(unmet, unresolved, "gate_id").where("state <> 'both'")
    counts = evidence.zero_filled(gates, "status", GATE_STATUSES)
    by_status = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("gate_status_counts"))
    totals = gates.agg(F.count_if("required").alias("required_gates"), F.count_if(F.col("required") & (F.col("status") != "passed")).alias("required_unmet"))
    open_ = unlike.agg((F.count("*") == 0).alias("unresolved_agrees"))
    ready = totals.crossJoin(open_).crossJoin(by_status)  # one row each
    return ready.withColumn("freeze_ready", F.lit(frozen) & (F.col("required_unmet") == 0))


def prediction_shape_errors(predictions: DataFrame, top_k: int) -> DataFrame:
    """(task_id, output_index, keys) of outputs whose attempts are not exactly attempt_1 .. attempt_K."""
    expected = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(top_k)), lambda i: F.concat(F.lit("attempt_"), i.cast("string"))))
    rows = predictions.select("task_id", F.posexplode_outer("outputs").alias("output_index", "attempts"))
    keys = F.array_sort(F.map_keys("attempts"))
    return rows.where(F.col("attempts").isNull() | (keys != expected)).select("task_id", "output_index", keys.alias("keys"))


def score_contract_errors(score: DataFrame, tasks: int, outputs: int, top_k: int) -> DataFrame:
    """score plus `errors`: denominators that are not the declared ones."""
    expected = {"top_k": top_k, "tasks_total": tasks, "tasks_predicted": tasks, "outputs_total": outputs}
    return score.withColumn("errors", codes({name: F.col(name) == value for name, value in expected.items()}))


def passed_evidence_errors(records: DataFrame) -> DataFrame:
    """(path, errors, warnings) of passed run records (path, text): a passed record states who, how and what it produced.

    Errors keep a record from counting; a warning is metadata that later
    records carry and early ones lack.
    """
    field = lambda name: F.get_json_object("text", f"$.{name}")
    filled = lambda name: F.length(F.trim(F.coalesce(field(name), F.lit("")))) > 0
    digest = lambda name: F.coalesce(field(name), F.lit("")).rlike(r"^[0-9a-f]{64}\z")
    errors = {"status": field("status") == "passed", "method_id": filled("method_id"), "runner": filled("runner"), "ended": filled("ended_at_utc"), "result_digest": digest("result_sha256")}
    warnings = {"run_id": filled("run_id"), "started": filled("started_at_utc"), "source_digest": digest("source_sha256")}
    return records.select("path", codes(errors).alias("errors"), codes(warnings).alias("warnings"))


def prediction_run_errors(records: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, errors) of prediction runs (path, text) against an inventory of files (path, sha256).

    A run must not have seen test labels, must score after inference, and must
    name its predictions with the digest that the file has. A strict run also
    shows that mutated labels change nothing, and that it had no network.
    """
    field = lambda name: F.get_json_object("text", f"$.{name}")
    named = records.select("path", "text", field("results.predictions_path").alias("__file"), field("results.predictions_sha256").alias("__sha"))
    both = named.join(files.select(F.col("path").alias("__file"), F.col("sha256").alias("__found")), "__file", "left")
    checks = {
        "top_k": field("attempt_budget.top_k").try_cast("long") >= 1, "labels-seen": field("challenge_firewall.inference_received_test_labels") == "false",
        "scored-before": field("challenge_firewall.scoring_after_inference") == "true", "predictions-missing": F.col("__found").isNotNull(), "predictions-digest": F.col("__found").isNull() | (F.col("__found") == F.col("__sha")),
    }
    if strict:
        checks |= {"mutation-check": field("challenge_firewall.label_mutation_check") == "passed", "network": field("challenge_firewall.network_policy") == "denied"}
    return both.select("path", codes(checks).alias("errors"))


def run_inventory(files: DataFrame, rules: Sequence[dict[str, str]]) -> DataFrame:
    """(path, sha256, bytes, tier, rule, kind, status, method_id, run_id, runner, scope) of run records and results (path, text).

    Older field names stand in where the newer ones are missing.
    """
    field = lambda *names: F.coalesce(*[F.get_json_object("text", f"$.{n}") for n in names])
    p = F.col("path")
    return files.select(
        "path", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), evidence.first_rule(p, rules, "tier").alias("tier"), evidence.first_rule(p, rules, "glob").alias("rule"),
        F.when(p.endswith("-run.json") | p.endswith("/run.json"), "run_record").otherwise("result").alias("kind"), field("status").alias("status"), field("method_id", "baseline_id").alias("method_id"),
        field("run_id").alias("run_id"), field("runner").alias("runner"), field("scope", "level").alias("scope"),
    )


def audit_layer(inventory: DataFrame, allowed: DataFrame) -> DataFrame:
    """The latest record of each method among run records whose runner the method allows (method_id, runner); ordered by time, then path."""
    rows = inventory.where("kind = 'run_record'").join(allowed.select("method_id", "runner").distinct(), ["method_id", "runner"], "left_semi")
    at = F.coalesce("ended", "started", F.lit(""))
    return evidence.latest(rows.withColumn("__at", at), ["method_id"], [F.col("__at"), F.col("path")]).drop("__at")


def materialisation_errors(files: DataFrame, audit: DataFrame) -> DataFrame:
    """(task_id, error) of challenge files (task_id, sha256, hidden_outputs) against a source audit (task_id, sha256)."""
    both = audit.select("task_id", F.col("sha256").alias("audited")).join(files, "task_id", "full")
    errors = F.array_compact(
        F.array(
            F.when(F.col("sha256").isNull(), "missing"), F.when(F.col("audited").isNull(), "not-audited"),
            F.when(F.col("sha256") != F.col("audited"), "digest"), F.when(F.col("hidden_outputs") > 0, "hidden-output"),
        )
    )
    return both.select("task_id", F.explode(errors).alias("error"))


def robustness(outcomes: DataFrame) -> DataFrame:
    """Per method, over outcomes (method_id, task_id, variant, passed) with the variant `original`: paired drop, retention and worst cases.

    paired_drop: mean of original less mean of the variants, by task;
    retention: variants passed of tasks whose original passed; all_variants:
    tasks that pass the original and every variant; worst_variant: the least
    share of tasks that any one variant leaves.
    """
    passed, original = F.col("passed").cast("int"), F.col("variant") == "original"
    per = outcomes.groupBy("method_id", "task_id").agg(
        F.max(F.when(original, passed)).alias("base"), F.sum(F.when(~original, passed)).alias("kept"), F.count(F.when(~original, passed)).alias("n"),
    )
    tasks = per.where("base is not null and n > 0").groupBy("method_id").agg(
        F.count("*").alias("tasks"), F.avg(F.col("base") - F.col("kept") / F.col("n")).alias("paired_drop"),
        F.try_divide(F.sum(F.when(F.col("base") == 1, F.col("kept"))).cast("double"), F.sum(F.when(F.col("base") == 1, F.col("n")))).alias("retention"),
        F.avg(((F.col("base") == 1) & (F.col("kept") == F.col("n"))).cast("double")).alias("all_variants"),
    )
    worst = outcomes.where(~original).groupBy("method_id", "variant").agg(F.avg(passed).alias("share")).groupBy("method_id").agg(F.min("share").alias("worst_variant"))
    return tasks.join(worst, "method_id")
