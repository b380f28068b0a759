"""Quotas, deterministic splits, stratified selection, contamination and clean views."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def domain_hash(*parts: Column | str | int) -> Column:
    """Hex SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def largest_remainder(weights: DataFrame, total: Column, weight: str, tie: list[Column], group: list[str] | None = None) -> DataFrame:
    """weights plus `quota`: total shared in proportion to the weight, the rest by largest remainder, then by `tie`.

    Integers only. Weights are a small table (splits, strata), so one window over
    all of a group's rows is right.
    """
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    rows = weights.withColumn("__sum", F.sum(weight).over(whole)).withColumn("__product", total * F.col(weight))
    rows = rows.withColumns({"__base": F.expr("__product div __sum"), "__rest": F.expr("__product % __sum")})
    rows = rows.withColumn("__left", total - F.sum("__base").over(whole))
    rank = F.row_number().over(whole.orderBy(F.desc("__rest"), *tie))
    return rows.withColumn("quota", (F.col("__base") + F.when(rank <= F.col("__left"), 1).otherwise(0)).cast("long")).drop("__sum", "__product", "__base", "__rest", "__left")


def hash_rank(items: DataFrame, id_col: str, seed: str, buckets: int = 64) -> DataFrame:
    """items plus `rank` (from 1) by SHA-256 of seed, NUL, id.

    Distributed: the hash's first bytes give ranges of near equal size; a range's
    rows are ranked alone, and the counts of the ranges before it are added.
    """
    rows = items.withColumn("__hash", domain_hash(seed, F.col(id_col)))
    rows = rows.withColumn("__range", F.expr(f"cast(conv(substr(__hash, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296"))
    counts = rows.groupBy("__range").agg(F.count("*").alias("n"))
    before = counts.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__hash", id_col))
    return rows.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn("rank", (F.col("__before") + F.col("__own")).cast("long")).drop("__hash", "__range", "__own", "__before")


def assign_splits(items: DataFrame, id_col: str, seed: str, weights: list[tuple[str, int]]) -> DataFrame:
    """items plus `rank` and `split`: hash-ranked items cut by the cumulative quotas, in the order given."""
    spark = items.sparkSession
    table = spark.createDataFrame([(k, n, w) for k, (n, w) in enumerate(weights)], "position int, split string, weight long")
    total = items.agg(F.count("*").alias("__total"))
    quotas = largest_remainder(table.crossJoin(total), F.col("__total"), "weight", [F.col("split")])  # one row on the right
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = quotas.withColumn("high", F.sum("quota").over(upto)).select("split", (F.col("high") - F.col("quota")).alias("low"), "high")
    ranked = hash_rank(items, id_col, seed)
    return ranked.join(F.broadcast(bounds), (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))).drop("low", "high")


def split_manifest(assigned: DataFrame, split: str = "split", source: str = "source") -> DataFrame:
    """Records and distinct clusters of each split and source."""
    return assigned.groupBy(split, source).agg(F.count("*").alias("records"), F.count_distinct("cluster_id").alias("clusters"))


def demo_bin(n: Column) -> Column:
    return F.when(n <= 4, n.cast("string")).otherwise("5+")


def test_bin(n: Column) -> Column:
    return F.when(n == 1, "1").otherwise("2+")


def area_bin(n: Column) -> Column:
    return F.when(n <= 100, "1-100").when(n <= 400, "101-400").otherwise("401-900")


def color_bin(n: Column) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 6, "4-6").otherwise("7-10")


def features(task: Column) -> dict[str, Column]:
    """Visible features of a task: no output cell is read, only output shapes of demonstrations."""
    inputs = F.concat(F.transform(task["train"], lambda p: p["input"]), F.transform(task["test"], lambda p: p["input"]))
    colors = F.array_sort(F.array_distinct(F.flatten(F.flatten(inputs))))
    change = F.exists(task["train"], lambda p: (F.size(p["input"]) != F.size(p["output"])) | (F.size(F.element_at(p["input"], 1)) != F.size(F.element_at(p["output"], 1))))
    return {
        "demonstration_count": F.size(task["train"]),
        "test_input_count": F.size(task["test"]),
        "max_input_area": F.array_max(F.transform(inputs, lambda g: F.size(g) * F.size(F.element_at(g, 1)))),
        "input_colors": colors,
        "input_color_count": F.size(colors),
        "demonstration_shape_change": change,
    }


def stratum_key(demo: Column, test: Column, area: Column, color: Column, change: Column) -> Column:
    """Bins joined by |; the boolean is printed with a capital, as digests of keys expect."""
    return F.concat_ws("|", demo_bin(demo), test_bin(test), area_bin(area), color_bin(color), F.initcap(change.cast("string")))


def capped_quotas(strata: DataFrame, quota: int, domain: str, seed: int, benchmark: str, stratum: str = "stratum") -> DataFrame:
    """strata (stratum, population) plus `quota` by largest remainder, ties by a domain hash and then the key.

    Fails while it runs where the population is smaller than the quota, or a
    stratum's quota is larger than its population.
    """
    if quota < 1:
        raise ValueError("the quota must be positive")
    tie = [domain_hash(domain, seed, "quota", benchmark, F.col(stratum)), F.col(stratum)]
    whole = Window.partitionBy(F.lit(0))  # strata are few
    shared = largest_remainder(strata.withColumn("__all", F.sum("population").over(whole)), F.lit(quota).cast("long"), "population", tie)
    fits = (F.col("__all") >= quota) & (F.col("quota") <= F.col("population"))
    message = F.lit(f"quota of {benchmark} exceeds its population")
    return shared.withColumn("quota", F.when(fits, F.col("quota")).otherwise(F.raise_error(message).cast("long"))).drop("__all")


def stratified_quota(items: DataFrame, id_col: str, stratum: str, quota: int, domain: str, seed: int, benchmark: str) -> DataFrame:
    """All items plus population, quota, rank_sha256, stratum_rank, selected.

    Within a stratum the least hash ranks are taken. No stratum gives more than
    `quota` items, so only so many of each are ranked, in two steps (a task's own
    least, then theirs); the others' stratum_rank is null.
    """
    strata = items.groupBy(stratum).agg(F.count("*").alias("population"))
    shared = capped_quotas(strata, quota, domain, seed, benchmark, stratum)
    rows = items.withColumn("rank_sha256", domain_hash(domain, seed, "rank", benchmark, F.col(id_col)))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("rank_sha256", id_col))
    first = rows.select(stratum, id_col, "rank_sha256", place.alias("stratum_rank")).where(F.col("stratum_rank") <= quota)
    ranked = rows.join(first, [stratum, id_col, "rank_sha256"], "left").join(F.broadcast(shared), stratum)
    return ranked.withColumn("selected", F.coalesce(F.col("stratum_rank") <= F.col("quota"), F.lit(False)))


def decision_reason(excluded: Column, selected: Column) -> Column:
    return F.when(excluded, "excluded-selected-elsewhere").when(selected, "selected").otherwise("not-selected")


def select_benchmark(candidates: DataFrame, id_col: str, stratum: str, quota: int, domain: str, seed: int, benchmark: str, excluded: DataFrame | None = None) -> DataFrame:
    """Every candidate plus population, quota, rank_sha256, eligible, selected and decision_reason.

    excluded (id_col): ids that another benchmark has selected; they take no part
    in populations and quotas, and have nulls there.
    """
    if excluded is None:
        left, out = candidates, None
    else:
        ids = excluded.select(id_col).distinct()
        left, out = candidates.join(ids, id_col, "left_anti"), candidates.join(ids, id_col, "left_semi")
    chosen = stratified_quota(left, id_col, stratum, quota, domain, seed, benchmark).withColumn("eligible", F.lit(True))
    names = [*candidates.columns, "population", "quota", "rank_sha256", "eligible", "selected"]
    rows = chosen.select(*names)
    if out is not None:
        null, rank = F.lit(None).cast("long"), domain_hash(domain, seed, "rank", benchmark, F.col(id_col))
        rows = rows.union(out.select(*candidates.columns, null, null, rank, F.lit(False), F.lit(False)))
    return rows.withColumn("decision_reason", decision_reason(~F.col("eligible"), F.col("selected")))


def select_in_turn(benchmarks: list[tuple[str, DataFrame, int]], id_col: str, stratum: str, domain: str, seed: int) -> DataFrame:
    """select_benchmark for each (name, candidates, quota) in turn; ids selected before are excluded from the later ones."""
    rows = taken = None
    for name, candidates, quota in benchmarks:
        chosen = select_benchmark(candidates, id_col, stratum, quota, domain, seed, name, taken).select(F.lit(name).alias("benchmark"), "*")
        own = shared.written(chosen.where("selected").select(id_col))  # the later benchmarks read it
        taken = own if taken is None else taken.union(own)
        rows = chosen if rows is None else rows.union(chosen)
    return rows


def feature_distribution(items: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, n): how often each value of each feature occurs, in one pass over the items."""
    return items.unpivot([], features, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))


def latin_rows(items: DataFrame, key: str, rows: int = 4) -> DataFrame:
    """items plus `idx`, its place in the order of `key`, and `latin_row`, that modulo the number of rows."""
    return order_index(items, key).withColumnRenamed("order_index", "idx").withColumn("latin_row", F.pmod("idx", F.lit(rows)))


def order_index(rows: DataFrame, key: str) -> DataFrame:
    """rows plus `order_index` (from 0) in the order of `key`.

    Rows are dealt by ranges of the key and written; a range's rows are then
    numbered alone, after the rows of the ranges before it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.written(rows.repartitionByRange(n, key).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn("order_index", F.col("__before") + F.col("__own") - 1).drop("__range", "__own", "__before")


def preview(ids: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """One row: how many distinct ids there are, and the first n of them in order."""
    distinct = ids.select(id_col).distinct()
    first = distinct.orderBy(id_col).limit(n).agg(F.array_sort(F.collect_list(id_col)).alias("first"))
    return distinct.agg(F.count("*").alias("n")).crossJoin(first)  # one row each


def contamination(assigned: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per split: clusters and records, and those that a ledger of record ids flags (a cluster by any member)."""
    rows = assigned.join(flagged.select("record_id").distinct().withColumn("flag", F.lit(True)), "record_id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    clusters = rows.groupBy("split", "cluster_id").agg(F.bool_or("flag").alias("flag"), F.count("*").alias("records"))
    return clusters.groupBy("split").agg(
        F.count("*").alias("clusters"), F.count_if("flag").alias("flagged_clusters"), F.sum("records").alias("records"), F.coalesce(F.sum(F.when(F.col("flag"), F.col("records"))), F.lit(0)).alias("flagged_records")
    )


def missing_ids(ledger: DataFrame, records: DataFrame, id_col: str) -> DataFrame:
    return ledger.select(id_col).distinct().join(records.select(id_col), id_col, "left_anti")


def clean_view(assigned: DataFrame, edges: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept records, kept edges): flagged clusters go whole, nothing is reallocated; an edge stays when both ends do."""
    bad = assigned.join(flagged.select("record_id").distinct(), "record_id", "left_semi").select("cluster_id").distinct()
    kept = assigned.join(bad, "cluster_id", "left_anti")
    ids = kept.select("record_id")
    ends = edges.join(ids.withColumnRenamed("record_id", "left_id"), "left_id", "left_semi").join(ids.withColumnRenamed("record_id", "right_id"), "right_id", "left_semi")
    return kept, ends


def crossing(assigned: DataFrame) -> DataFrame:
    """Clusters that are in more than one split."""
    return assigned.groupBy("cluster_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Both tables hold the same rows, each as often."""
    return before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def task_orders(items: DataFrame, id_col: str, benchmark: Column, domain: str, seeds: list[int]) -> DataFrame:
    """(benchmark, seed, place, id): items ordered by a domain hash, for each seed."""
    rows = items.select(benchmark.alias("benchmark"), F.col(id_col), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    rows = rows.withColumn("__hash", domain_hash(domain, F.col("benchmark"), F.col("seed"), F.col(id_col)))
    place = F.row_number().over(Window.partitionBy("benchmark", "seed").orderBy("__hash", id_col))
    return rows.select("benchmark", "seed", place.alias("place"), id_col)


def color_order(domain: str, seed: int, salt: int) -> tuple[int, ...]:
    """The colours 1..9 in the order of their domain hashes."""
    digest = {c: hashlib.sha256("\0".join(map(str, (domain, seed, "color", salt, c))).encode()).hexdigest() for c in range(1, 10)}
    return tuple(sorted(digest, key=digest.__getitem__))


def color_maps(domain: str, seeds: list[int], salts: int = 1000) -> list[dict[int, int]]:
    """One colour permutation for each seed: zero stays, and neither the identity nor an earlier map comes again.

    Raises ValueError where none of a seed's first `salts` orders will do.
    """
    used = [tuple(range(1, 10))]
    for seed in seeds:
        fresh = next((o for o in (color_order(domain, seed, salt) for salt in range(salts)) if o not in used), None)
        if fresh is None:
            raise ValueError(f"no colour map is left for seed {seed}")
        used.append(fresh)
    return [dict(enumerate((0, *order))) for order in used[1:]]
