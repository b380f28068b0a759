"""The development split: cluster, assign, annotate, view, and the checks on all of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import baseline, cluster, overlap, scoring, shared, splits


@dataclass
class Development:
    """Tables of one build. Annotations never change an assignment."""

    records: DataFrame  # record_id, source, task_id, task, content
    edges: DataFrame
    assigned: DataFrame  # record_id, cluster_id, split
    descriptors: DataFrame
    manifest: DataFrame
    contamination: DataFrame
    clean_records: DataFrame
    clean_edges: DataFrame


def build(records: DataFrame, seed: str, weights: list[tuple[str, int]], flagged: DataFrame, max_states: int = cluster.MAX_STATES) -> Development:
    """records: (record_id, source, task_id, task); flagged: (record_id) of a locked ledger."""
    # they are read for clusters, labels and annotations: whatever makes them runs once
    rows = shared.written(records.select("record_id", "source", "task_id", "task", overlap.fingerprint(overlap.normalized_text(F.col("task"))).alias("content")))
    clusters, edges = cluster.cluster_tasks(rows.select("record_id", "task"), max_states)
    clusters, edges = clusters.persist(), edges.persist()
    items = splits.assign_splits(clusters.select("cluster_id").distinct(), "cluster_id", seed, weights).select("cluster_id", "split")
    assigned = clusters.join(items, "cluster_id").join(rows.select("record_id", "source"), "record_id")
    kept, ends = splits.clean_view(assigned, edges, flagged)
    return Development(
        rows, edges, assigned, cluster.describe_clusters(clusters, rows.select("record_id", "source", "content")),
        splits.split_manifest(assigned), splits.contamination(assigned, flagged), kept, ends,
    )


def errors(dev: Development, flagged: DataFrame) -> list[str]:
    """Codes of the rules that a build breaks: every record once, no crossing, no inconclusive merge, clean view a pure exclusion."""
    found = []
    ids = dev.records.select("record_id")
    if not splits.unchanged(ids, dev.assigned.select("record_id")):
        found.append("coverage")
    if not splits.crossing(dev.assigned).isEmpty():
        found.append("crossing")
    same = dev.edges.where("status = 'matched'").join(dev.assigned.select(F.col("record_id").alias("left_id"), F.col("cluster_id").alias("l")), "left_id").join(dev.assigned.select(F.col("record_id").alias("right_id"), F.col("cluster_id").alias("r")), "right_id")
    if not same.where("l <> r").isEmpty():
        found.append("unmerged-edge")
    if not splits.missing_ids(flagged, dev.records, "record_id").isEmpty():
        found.append("unknown-ledger-id")
    if not dev.clean_records.join(flagged.select("record_id").distinct(), "record_id", "left_semi").isEmpty():
        found.append("flagged-kept")
    kept = dev.clean_records.select("record_id", "cluster_id", "split")
    if not kept.exceptAll(dev.assigned.select("record_id", "cluster_id", "split")).isEmpty():
        found.append("reallocated")
    ends = dev.clean_edges.select(F.explode(F.array("left_id", "right_id")).alias("record_id")).distinct()
    if not ends.join(kept.select("record_id"), "record_id", "left_anti").isEmpty():
        found.append("dangling-edge")
    return found


def runtime(dev: Development, split: str) -> DataFrame:
    """(cluster_id, task_id, task) of a split's representatives: the least record of each cluster."""
    mine = dev.assigned.where(F.col("split") == split).groupBy("cluster_id").agg(F.min("record_id").alias("record_id"))
    return mine.join(dev.records.select("record_id", "task_id", "task"), "record_id").select("cluster_id", "task_id", "task")


def runtime_checks(tasks: DataFrame, top_k: int = 2) -> DataFrame:
    """One row: inference inputs that change under label mutation (0), exact outputs of oracle sentinels (all), and under mutated labels (0)."""
    shown = tasks.select("task_id", F.to_json(grids.challenge_only(F.col("task"))).alias("t"))
    mutated = tasks.select("task_id", grids.mutate_labels(F.col("task")).alias("task"))
    again = mutated.select("task_id", F.to_json(grids.challenge_only(F.col("task"))).alias("t"))
    stable = shown.exceptAll(again).agg(F.count("*").alias("changed_inputs"))
    sentinels = scoring.explode_attempts(tasks.select("task_id", grids.sentinel_predictions(F.col("task"), top_k).alias("outputs")))
    counts = [scoring.score(scoring.explode_answers(t), sentinels, top_k).select(F.col("outputs_exact").alias(n), F.col("outputs_total").alias(f"{n}_total")) for n, t in (("oracle", tasks), ("mutated", mutated))]
    return stable.crossJoin(counts[0]).crossJoin(counts[1])  # one row each


def baseline_digest(tasks: DataFrame, top_k: int = 2) -> DataFrame:
    """(task_id, digest) of the predictions: equal digests under both label variants are the firewall's proof."""
    made = baseline.predictions(baseline.rank_candidates(tasks, top_k))
    return made.select("task_id", F.sha2(F.to_json("outputs"), 256).alias("digest"))
