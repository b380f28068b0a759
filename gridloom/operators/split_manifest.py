"""The rules of a split manifest, all observed in one plan: a row a rule, with how many offend against it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import digests


@dataclass(frozen=True)
class Manifest:
    """What a manifest says, as tables."""

    records: DataFrame  # record_id, source
    members: DataFrame  # cluster_id, record_id
    allocation: DataFrame  # split, cluster_id
    flagged: DataFrame  # record_id of the contamination ledger
    flagged_clusters: DataFrame  # cluster_id
    declared: DataFrame  # name, value: counts and digests as text


def _counted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, offenders) of conditions over rows."""
    sums = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(rule) for rule, bad in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("offenders")) for rule in rules])).alias("r")).select("r.*")


def observed(manifest: Manifest) -> DataFrame:
    """(name, value) that `declared` must say: counts of the whole, of splits and of flagged ones, and digests of the ordered lists."""
    m = manifest
    text = lambda name, n: F.struct(F.lit(name).alias("name"), n.cast("string").alias("value"))
    whole = [
        m.records.agg(text("records", F.count("*")).alias("o")), m.members.agg(text("clusters", F.count_distinct("cluster_id")).alias("o")),
        m.flagged.agg(text("flagged-records", F.count_distinct("record_id")).alias("o")), m.flagged_clusters.agg(text("flagged-clusters", F.count_distinct("cluster_id")).alias("o")),
    ]
    held = m.allocation.join(m.members, "cluster_id", "left").groupBy("split").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("record_id").alias("records"))
    entry = lambda what: F.struct(F.concat(F.lit(f"{what} of "), "split").alias("name"), F.col(what).cast("string").alias("value"))
    per = held.select(F.explode(F.array(entry("clusters"), entry("records"))).alias("o"))
    listed = {
        "digest of records": digests.json_list(m.records, [], [F.col("record_id")], F.struct("record_id", "source")),
        "digest of members": digests.json_list(m.members, [], [F.col("cluster_id"), F.col("record_id")], F.struct("cluster_id", "record_id")),
        "digest of allocation": digests.json_list(m.allocation, [], [F.col("split"), F.col("cluster_id")], F.struct("cluster_id", "split")),
    }
    out = per
    for part in [*whole, *[d.select(F.struct(F.lit(name).alias("name"), F.col("digest").alias("value")).alias("o")) for name, d in listed.items()]]:
        out = out.union(part)
    return out.select("o.name", "o.value")


def with_declared(manifest: Manifest) -> Manifest:
    """The manifest, declaring what is observed in it."""
    return replace(manifest, declared=observed(manifest))


def rule_offenders(manifest: Manifest, splits: list[str]) -> DataFrame:
    """(rule, offenders) for every rule; a sound manifest has none.

    Records: each once, in one cluster, and no member that is no record. Clusters:
    named by their least member, in one of the named splits and no other, and none
    allocated that has no members. Ledger: only records, and its clusters are just
    those that hold one. Declared counts and digests: each as observed, none missing
    or more. A null id matches nothing, and so offends.
    """
    m = manifest
    once = m.records.groupBy("record_id").agg(F.count("*").alias("n"))
    placed = m.members.groupBy("record_id").agg(F.count_distinct("cluster_id").alias("places"))
    ledger = m.flagged.select("record_id").distinct().withColumn("flag", F.lit(True))
    records = once.join(placed, "record_id", "full").join(ledger, "record_id", "full")
    by_record = _counted(
        records,
        {
            "duplicate-record": F.col("n") > 1, "unknown-member": F.col("n").isNull() & F.col("places").isNotNull(), "uncovered-record": F.col("n").isNotNull() & F.col("places").isNull(),
            "record-in-two-clusters": F.col("places") > 1, "unknown-flagged": F.col("flag") & F.col("n").isNull(),
        },
    )
    clusters = m.members.join(ledger, "record_id", "left").groupBy("cluster_id").agg(F.min("record_id").alias("least"), F.bool_or(F.coalesce("flag", F.lit(False))).alias("hit"))
    dealt = m.allocation.groupBy("cluster_id").agg(F.count_distinct("split").alias("splits"), F.count_if(~F.col("split").isin(splits)).alias("strange"))
    named = m.flagged_clusters.select("cluster_id").distinct().withColumn("named", F.lit(True))
    rows = clusters.join(dealt, "cluster_id", "full").join(named, "cluster_id", "full")
    by_cluster = _counted(
        rows,
        {
            "cluster-name": F.col("cluster_id") != F.col("least"), "unknown-cluster": F.col("splits").isNotNull() & F.col("least").isNull(), "unassigned-cluster": F.col("least").isNotNull() & F.col("splits").isNull(),
            "cluster-crosses-splits": F.col("splits") > 1, "unexpected-split": F.col("strange") > 0, "flagged-clusters": F.coalesce("hit", F.lit(False)) != F.coalesce("named", F.lit(False)),
        },
    )
    both = observed(m).join(m.declared.select("name", F.col("value").alias("said")), "name", "full").withColumn("wrong", ~F.col("value").eqNullSafe(F.col("said")))
    digest = F.col("name").startswith("digest of ")
    by_declared = _counted(both, {"declared-count": F.col("wrong") & ~digest, "declared-digest": F.col("wrong") & digest})
    return by_record.union(by_cluster).union(by_declared)
