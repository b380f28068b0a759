"""Registered queries over tasks, selections, protocols, inventories and files, each beside its DuckDB SQL."""

from __future__ import annotations

import json
from dataclasses import replace

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grids, validation
from ..operators import adapters, baseline, cluster, evidence, firewall, isomorphism, ledgers, manifests, overlap, protocol, resources, scoring, shared, split_manifest, splits, variants
from ..sources import inventory, sinks, task_tree, tasks
from . import development
from .projections import order_tasks, table
from .queries import PERMUTATION, RULES, STRATUM_SQL, _strata
from .registry import long, query
from .task_sql import CANDIDATE_SQL, D4_SQL, SCORE_SQL, TASK_SQL, _fits

# ---- tasks


@query(
    "challenge_tasks",
    f"""WITH {TASK_SQL} SELECT CAST(t AS VARCHAR) AS task_id, CAST(len(train) AS INTEGER) AS demonstrations, CAST(0 AS INTEGER) AS hidden_outputs, CAST(to_json(x) AS VARCHAR) AS test_input FROM tk""",
)
def challenge_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """What a solver may see of every task."""
    seen = order_tasks(spark, sf).select("task_id", grids.challenge_only(F.col("task")).alias("task"))
    return seen.select("task_id", F.size("task.train").alias("demonstrations"), F.size(F.filter("task.test", lambda p: p["output"].isNotNull())).alias("hidden_outputs"), F.to_json(F.col("task.test")[0]["input"]).alias("test_input"))


@query(
    "prediction_turns",
    f"""WITH {CANDIDATE_SQL} SELECT CAST(t AS VARCHAR) AS task_id, CAST(to_json({D4_SQL["rotate_90"].format(g="x")}) AS VARCHAR) AS attempt_1,
    CAST(to_json(list_transform({D4_SQL["rotate_90"].format(g="x")}, lambda r: list_transform(r, lambda c: cs[1]))) AS VARCHAR) AS attempt_2 FROM b0""",
)
def prediction_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Two solutions of each test input, the input and its dominant colour, as attempts, all turned by a quarter."""
    first = F.transform("task.test", lambda p: grids.copy_input(p["input"]))
    second = F.transform("task.test", lambda p: grids.constant(p["input"], grids.dominant_color(p["input"])))
    made = order_tasks(spark, sf).select("task_id", grids.transform_predictions(grids.solutions_to_predictions(first, second), grids.rotate_90)[0].alias("o"))
    return made.select("task_id", *[F.to_json(F.col("o")[k]).alias(k) for k in ("attempt_1", "attempt_2")])


@query(
    "normalized_tasks",
    f"""WITH {TASK_SQL} SELECT CAST(t AS VARCHAR) AS task_id, sha256('{{"test":[' || CAST(to_json({{'input': x, 'output': y}}) AS VARCHAR) || '],"train":[' || list_aggregate(list_sort(list_transform(train, lambda p: CAST(to_json({{'input': p.i, 'output': p.o}}) AS VARCHAR))), 'string_agg', ',') || ']}}') AS digest FROM tk""",
)
def normalized_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return order_tasks(spark, sf).select("task_id", overlap.fingerprint(overlap.normalized_text(F.col("task"))).alias("digest"))


def _signature_sql(pair: str, given: str, made: str) -> str:
    def one(g: str) -> str:
        counts = f"list_sort(list_transform(list_distinct(flatten({g})), lambda c: len(list_filter(flatten({g}), lambda v: v = c))))"
        return f"CAST(to_json({{'sides': [least(len({g}), len({g}[1])), greatest(len({g}), len({g}[1]))], 'counts': {counts}}}) AS VARCHAR)"

    return f"{one(f'{pair}{given}')} || '/' || {one(f'{pair}{made}')}"


@query(
    "task_signatures",
    f"""WITH {TASK_SQL}, s AS (SELECT t, sha256(list_aggregate(list_sort(list_transform(train, lambda p: {_signature_sql("p.", "i", "o")})), 'string_agg', ';') || '|' || {_signature_sql("", "x", "y")}) AS signature FROM tk)
    SELECT signature, count(*) AS n, min(t) AS least FROM s GROUP BY 1""",
)
def task_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks by the blocking signature that their isomorphic images share."""
    rows = order_tasks(spark, sf).select(F.col("task_id").cast("long").alias("t"), cluster.task_signature(F.col("task")).alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("t").alias("least"))


@query(
    "solver_transforms",
    f"""WITH {TASK_SQL} SELECT CAST(t AS VARCHAR) AS task_id, concat_ws(',', {", ".join(f"CASE WHEN {_fits(n)} THEN '{n}' END" for n in D4_SQL)}) AS transforms FROM tk""",
)
def solver_transforms(spark: SparkSession, sf: str) -> DataFrame:
    return order_tasks(spark, sf).select("task_id", F.array_join(baseline.fitting_transforms(F.col("task.train")), ",").alias("transforms"))


@query(
    "color_mappings",
    f"""WITH {CANDIDATE_SQL}, p AS (SELECT t, unnest(prs) AS v FROM b0 WHERE len(list_distinct(list_transform(prs, lambda v: v // 10))) = len(prs)) SELECT CAST(t AS VARCHAR) AS task_id, CAST(v // 10 AS INTEGER) AS source, CAST(v % 10 AS INTEGER) AS target FROM p""",
)
def color_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Colour mappings that the demonstrations of a task show, where they show one."""
    return order_tasks(spark, sf).select("task_id", F.explode(baseline.color_mapping(F.col("task.train"))).alias("source", "target"))


@query("witness_replay", f"WITH {TASK_SQL} SELECT CAST(t AS VARCHAR) AS task_id, 'matched' AS status, true AS holds FROM tk")
def witness_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Each task against its turned and recoloured copy in reverse order of examples: the witness found, replayed over every cell."""
    base = shared.written(order_tasks(spark, sf))
    order = F.reverse(F.sequence(F.lit(0), F.size("task.train") - 1))
    copies = base.select("task_id", grids.transform_task(F.col("task"), grids.compose(grids.anti_transpose, grids.recolor(grids.literal_map(PERMUTATION))), order).alias("task"))
    named = lambda df, side: df.select(F.concat(F.lit(side), "task_id").alias("record_id"), "task")
    records = shared.written(named(base, "a").union(named(copies, "b")))
    pairs = base.select(F.concat(F.lit("a"), "task_id").alias("left_id"), F.concat(F.lit("b"), "task_id").alias("right_id"))
    found = cluster.verify_pairs(pairs, shared.written(isomorphism.forms(records)))
    side = lambda end, name: records.select(F.col("record_id").alias(end), F.col("task").alias(name)).hint("merge")
    rows = found.join(side("left_id", "l"), "left_id").join(side("right_id", "r"), "right_id")
    witness = F.struct("d4", "color", "train_permutation", "test_permutation")
    return rows.select(F.substr("left_id", F.lit(2)).alias("task_id"), "status", cluster.witness_holds(F.col("l"), F.col("r"), witness).alias("holds"))


def _damaged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, tasks): by customer, sound attempts, one attempt, a gap, a wrong name, none; and the odd customers' under an unknown id too."""
    base = order_tasks(spark, sf)
    g, kind = F.col("task.test")[0]["input"], F.col("task_id").cast("long") % 5
    named = lambda *names: F.array(F.create_map(*[x for n in names for x in (F.lit(n), g)]))
    outputs = F.when(kind == 0, named("attempt_1", "attempt_2")).when(kind == 1, named("attempt_1")).when(kind == 2, named("attempt_2")).when(kind == 3, named("guess_1")).otherwise(F.array(F.map_filter(F.create_map(F.lit("x"), g), lambda k, v: F.lit(False))))
    rows = base.select("task_id", outputs.alias("outputs"))
    unknown = rows.where(F.col("task_id").cast("long") % 2 == 1).select(F.concat(F.lit("x"), "task_id").alias("task_id"), "outputs")
    return rows.union(unknown), base


@query(
    "prediction_errors",
    f"""WITH {TASK_SQL}, p AS (SELECT CAST(t AS VARCHAR) AS task_id, t % 5 AS kind, false AS unknown FROM tk UNION ALL SELECT 'x' || t, t % 5, true FROM tk WHERE t % 2 = 1),
    e AS (SELECT task_id, concat_ws(',', CASE kind WHEN 2 THEN 'attempt_gap' WHEN 3 THEN 'attempt_key,attempt_gap' WHEN 4 THEN 'no_attempt,attempt_gap' END, CASE WHEN unknown THEN 'unknown_task' END) AS errors FROM p)
    SELECT task_id, errors FROM e WHERE errors <> ''""",
)
def prediction_errors(spark: SparkSession, sf: str) -> DataFrame:
    predictions, base = _damaged(spark, sf)
    judged = predictions.withColumn("errors", validation.attempt_errors(F.col("outputs")))
    return tasks.prediction_errors(judged, scoring.explode_answers(base)).select("task_id", F.array_join("errors", ",").alias("errors"))


@query(
    "prediction_shape",
    f"""WITH {TASK_SQL}, p AS (SELECT CAST(t AS VARCHAR) AS task_id, t % 5 AS kind FROM tk UNION ALL SELECT 'x' || t, t % 5 FROM tk WHERE t % 2 = 1)
    SELECT task_id, CASE kind WHEN 1 THEN 'attempt_1' WHEN 2 THEN 'attempt_2' WHEN 3 THEN 'guess_1' ELSE '' END AS keys FROM p WHERE kind <> 0""",
)
def prediction_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs that do not have exactly two attempts."""
    return protocol.prediction_shape_errors(_damaged(spark, sf)[0], 2).select("task_id", F.array_join("keys", ",").alias("keys"))


@query("score_contract", f"WITH {TASK_SQL} SELECT count(*) AS tasks_total, concat_ws(',', CASE WHEN count(*) <> 1498 THEN 'tasks_total,tasks_predicted' END, 'outputs_total') AS errors FROM tk")
def score_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline's score against declared denominators, of which the number of outputs is wrong."""
    score = baseline.run(shared.written(order_tasks(spark, sf)), 2)[2]
    return protocol.score_contract_errors(score, 1498, 0, 2).select("tasks_total", F.array_join("errors", ",").alias("errors"))


@query(
    "firewall_digests",
    f"""WITH {CANDIDATE_SQL} SELECT CAST(t AS VARCHAR) AS task_id, sha256('[{{"attempt_1":' || CAST(to_json(best[1].g) AS VARCHAR) || ',"attempt_2":' || CAST(to_json(best[2].g) AS VARCHAR) || '}}]') AS digest, true AS same FROM cd""",
)
def firewall_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each task's predictions, and whether a run that sees other hidden labels gives the same."""
    base = shared.written(order_tasks(spark, sf))
    other = base.select("task_id", grids.mutate_labels(F.col("task"), 3).alias("task"))
    return development.baseline_digest(base).join(development.baseline_digest(other).withColumnRenamed("digest", "again"), "task_id").select("task_id", "digest", (F.col("digest") == F.col("again")).alias("same"))


@query(
    "robustness",
    f"""WITH {SCORE_SQL}, u AS (SELECT t, exact, shifted_exact, matches * 2 > cells AS most, t % 3 = 0 AS third FROM so), m(method_id) AS (VALUES ('strict'), ('half')),
    o AS (SELECT method_id, t, CASE WHEN method_id = 'strict' THEN exact ELSE most END AS b, CASE WHEN method_id = 'strict' THEN shifted_exact ELSE third END AS v1, NOT third AS v2 FROM u, m),
    p AS (SELECT method_id, t, CAST(b AS INT) AS b, CAST(v1 AS INT) AS v1, CAST(v2 AS INT) AS v2 FROM o)
    SELECT method_id, count(*) AS tasks, round(avg(b - (v1 + v2) / 2), 9) AS paired_drop, round(CAST(sum(b * (v1 + v2)) AS DOUBLE) / sum(b * 2), 9) AS retention, round(avg(b * v1 * v2), 9) AS all_variants, round(least(avg(v1), avg(v2)), 9) AS worst_variant FROM p GROUP BY 1""",
)
def robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Two readings of the baseline's results, with two variants of each task."""
    base = shared.written(order_tasks(spark, sf))
    attempts = shared.written(baseline.rank_candidates(base, 2).select("task_id", "output_index", F.col("rank").alias("attempt_no"), "grid"))  # both readings score them
    own = scoring.task_scores(scoring.output_scores(scoring.explode_answers(base), attempts, 2))
    moved = scoring.task_scores(scoring.output_scores(scoring.explode_answers(base.select("task_id", grids.mutate_labels(F.col("task")).alias("task"))), attempts, 2))
    rows = own.select("task_id", "exact", (F.col("matches") * 2 > F.col("cells")).alias("most"), (F.col("task_id").cast("long") % 3 == 0).alias("third")).join(moved.select("task_id", F.col("exact").alias("moved")), "task_id")
    outcome = lambda method, variant, passed: F.struct(F.lit(method).alias("method_id"), F.lit(variant).alias("variant"), F.col(passed).alias("passed") if isinstance(passed, str) else passed.alias("passed"))
    listed = [outcome("strict", "original", "exact"), outcome("strict", "v1", "moved"), outcome("strict", "v2", ~F.col("third")), outcome("half", "original", "most"), outcome("half", "v1", "third"), outcome("half", "v2", ~F.col("third"))]
    found = protocol.robustness(rows.select("task_id", F.explode(F.array(*listed)).alias("o")).select("task_id", "o.*"))
    return found.select("method_id", "tasks", *[F.round(c, 9).alias(c) for c in ("paired_drop", "retention", "all_variants", "worst_variant")])


# ---- selection and splits


def _selection_sql(name: str, where: str, quota: int) -> str:
    return f"""{name}_it AS (SELECT doc_id, stratum FROM it WHERE {where}), {name}_pop AS (SELECT stratum, count(*) AS population FROM {name}_it GROUP BY 1), {name}_tot AS (SELECT count(*) AS n FROM {name}_it),
{name}_b AS (SELECT stratum, population, {quota} * population // n AS base, {quota} * population % n AS rest FROM {name}_pop, {name}_tot),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, sha256('gridloom' || chr(0) || '7' || chr(0) || 'quota' || chr(0) || '{name}' || chr(0) || stratum), stratum) AS place, {quota} - sum(base) OVER () AS spare FROM {name}_b),
{name}_qu AS (SELECT stratum, population, CAST(base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM {name}_r),
{name}_k AS (SELECT i.doc_id, i.stratum, q.population, q.quota, row_number() OVER (PARTITION BY i.stratum ORDER BY sha256('gridloom' || chr(0) || '7' || chr(0) || 'rank' || chr(0) || '{name}' || chr(0) || CAST(i.doc_id AS VARCHAR)), i.doc_id) AS place FROM {name}_it i JOIN {name}_qu q USING (stratum))"""


@query(
    "selection_in_turn",
    f"""WITH {STRATUM_SQL.split("pop AS")[0].rstrip().rstrip(",")}, {_selection_sql("second", "doc_id % 3 <> 0", 24)}, {_selection_sql("first", "doc_id NOT IN (SELECT doc_id FROM second_k WHERE place <= quota)", 40)}
    SELECT 'second' AS benchmark, doc_id, stratum, population, quota, place <= quota AS selected, CASE WHEN place <= quota THEN 'selected' ELSE 'not-selected' END AS decision_reason FROM second_k
    UNION ALL SELECT 'first', doc_id, stratum, population, quota, place <= quota, CASE WHEN place <= quota THEN 'selected' ELSE 'not-selected' END FROM first_k
    UNION ALL SELECT 'first', doc_id, stratum, NULL, NULL, false, 'excluded-selected-elsewhere' FROM second_k WHERE place <= quota""",
)
def selection_in_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's decision in two benchmarks: what the second selects is excluded from the first."""
    docs = _strata(spark, sf)
    rows = splits.select_in_turn([("second", docs.where("doc_id % 3 <> 0"), 24), ("first", docs, 40)], "doc_id", "stratum", "gridloom", 7)
    return rows.select("benchmark", "doc_id", "stratum", "population", "quota", "selected", "decision_reason")


TASK_STRATUM_SQL = f"""{TASK_SQL}, tf AS (SELECT t, len(train) AS demos, list_max(list_transform(list_concat(list_transform(train, lambda p: p.i), [x]), lambda g: len(g) * 4)) AS area, len(list_distinct(flatten(flatten(list_concat(list_transform(train, lambda p: p.i), [x]))))) AS colors FROM tk),
it AS (SELECT t AS doc_id, CASE WHEN demos <= 4 THEN CAST(demos AS VARCHAR) ELSE '5+' END || '|1|' || CASE WHEN area <= 100 THEN '1-100' WHEN area <= 400 THEN '101-400' ELSE '401-900' END || '|' || CASE WHEN colors <= 3 THEN '1-3' WHEN colors <= 6 THEN '4-6' ELSE '7-10' END || '|False' AS stratum, demos FROM tf)"""


@query(
    "fixed_design",
    f"""WITH {TASK_STRATUM_SQL}, {_selection_sql("second", "doc_id % 2 = 0", 32)}, {_selection_sql("first", "doc_id NOT IN (SELECT doc_id FROM second_k WHERE place <= quota)", 32)},
    s AS (SELECT 'second' AS benchmark, doc_id FROM second_k WHERE place <= quota UNION ALL SELECT 'first', doc_id FROM first_k WHERE place <= quota), d AS (SELECT benchmark, it.demos FROM s JOIN it USING (doc_id))
    SELECT benchmark, category, n, true AS round_trips FROM (
      SELECT benchmark, 'd4_only' AS category, count(*) * 8 AS n FROM d GROUP BY 1 UNION ALL SELECT benchmark, 'color_only', count(*) * 4 FROM d GROUP BY 1 UNION ALL SELECT benchmark, 'd4_plus_color', count(*) * 4 FROM d GROUP BY 1
      UNION ALL SELECT benchmark, 'demonstration_order', count(*) * 2 FROM d WHERE demos >= 3 GROUP BY 1)""",
)
def fixed_design(spark: SparkSession, sf: str) -> DataFrame:
    """Two benchmarks of 32 tasks each by visible features, the second's tasks left out of the first, and all variants of these 64."""
    base = shared.written(order_tasks(spark, sf).withColumn("doc_id", F.col("task_id").cast("long")))
    f = splits.features(F.col("task"))
    stratum = splits.stratum_key(f["demonstration_count"], f["test_input_count"], f["max_input_area"], f["input_color_count"], f["demonstration_shape_change"])
    candidates = base.select("doc_id", stratum.alias("stratum"))
    chosen = splits.select_in_turn([("second", candidates.where("doc_id % 2 = 0"), 32), ("first", candidates, 32)], "doc_id", "stratum", "gridloom", 7).where("selected")
    place = F.row_number().over(Window.partitionBy("benchmark").orderBy("rank_sha256", "doc_id")) - 1  # 32 rows of each
    picked = chosen.select("benchmark", "doc_id", place.alias("idx")).join(base, "doc_id")
    made = variants.design(picked.select("task_id", "task", "idx"), splits.color_maps("gridloom", [1, 2, 3, 4])).join(picked.select("task_id", "benchmark"), "task_id")
    return made.groupBy("benchmark", "category").agg(F.count("*").alias("n"), F.bool_and("round_trip").alias("round_trips"))


@query(
    "color_map_rows",
    """WITH s(seed) AS (VALUES (1), (2), (3), (4)), c AS (SELECT seed, unnest(range(1, 10)) AS c FROM s)
    SELECT CAST(seed AS INTEGER) AS seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY sha256('gridloom' || chr(0) || seed || chr(0) || 'color' || chr(0) || '0' || chr(0) || c)) AS INTEGER) AS source, CAST(c AS INTEGER) AS target FROM c UNION ALL SELECT seed, 0, 0 FROM s""",
)
def color_map_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The four colour maps of the variants' design."""
    rows = [(k, a, b) for k, m in enumerate(splits.color_maps("gridloom", [1, 2, 3, 4]), 1) for a, b in m.items()]
    return spark.createDataFrame(rows, "seed int, source int, target int")


@query("order_index", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) - 1 AS order_index FROM customer")
def order_index(spark: SparkSession, sf: str) -> DataFrame:
    return long(splits.order_index(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name"), "order_index")


@query(
    "missing_preview",
    """WITH m AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) SELECT count(*) AS n, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM m ORDER BY doc_id LIMIT 5)) AS first FROM m""",
)
def missing_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as a ledger of English documents: how many of its ids are missing, and the first five."""
    missing = splits.missing_ids(table(spark, sf, "labels"), table(spark, sf, "documents").where("lang = 'en'"), "doc_id")
    return splits.preview(missing, "doc_id").select("n", F.array_join(F.col("first").cast("array<string>"), ",").alias("first"))


@query(
    "benchmark_errors",
    """WITH t AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS benchmark, CASE WHEN c_custkey % 5 = 0 THEN 'evaluation' ELSE 'training' END AS split, CASE WHEN c_custkey % 100 = 7 THEN 'Customer' ELSE lpad(lower(hex(c_custkey // 2)), 8, '0') END AS task_id FROM customer),
    e(benchmark, split, n) AS (VALUES ('a', 'training', 1), ('a', 'evaluation', 0), ('b', 'training', 2), ('c', 'training', 3)),
    s AS (SELECT benchmark, split, count(*) AS found, count(DISTINCT task_id) AS ids, count(*) FILTER (WHERE NOT regexp_matches(task_id, '^[0-9a-f]{8}$')) AS bad FROM t GROUP BY 1, 2),
    b AS (SELECT coalesce(e.benchmark, s.benchmark) AS benchmark, coalesce(e.split, s.split) AS split, n, found, ids, bad FROM e FULL JOIN s ON e.benchmark = s.benchmark AND e.split = s.split)
    SELECT benchmark, split, 'missing-split' AS error FROM b WHERE found IS NULL UNION ALL SELECT benchmark, split, 'unknown-split' FROM b WHERE n IS NULL UNION ALL SELECT benchmark, split, 'count' FROM b WHERE found <> n
    UNION ALL SELECT benchmark, split, 'duplicate-id' FROM b WHERE found <> ids UNION ALL SELECT benchmark, split, 'id-format' FROM b WHERE bad > 0
    UNION ALL SELECT benchmark, NULL, 'crosses-splits:' || task_id FROM t GROUP BY benchmark, task_id HAVING count(DISTINCT split) > 1""",
)
def benchmark_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tasks of two benchmarks, whose ids repeat and some of which are no ids."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("b").alias("benchmark"), F.when(k % 5 == 0, "evaluation").otherwise("training").alias("split"),
        F.when(k % 100 == 7, "Customer").otherwise(F.lpad(F.lower(F.hex(F.floor(k / 2))), 8, "0")).alias("task_id"),
    )
    expected = spark.createDataFrame([("a", "training", 1), ("a", "evaluation", 0), ("b", "training", 2), ("c", "training", 3)], "benchmark string, split string, n long")
    return manifests.benchmark_errors(rows, expected)


# ---- manifests and protocol

_RULE_CASES = "CASE WHEN regexp_matches(url, '^https://.*\\.example\\.org/.*$') THEN {0} WHEN regexp_matches(url, '^.*page=[0-9].*$') THEN {1} WHEN regexp_matches(url, '^http://.*$') THEN {2} ELSE {3} END"


def _rule_sql(field: str) -> str:
    return _RULE_CASES.format(*[f"'{r[field]}'" for r in RULES])


@query("exposure_manifest", f"""SELECT page_id, {_rule_sql("tier")} AS tier, {_rule_sql("glob")} AS rule, {_rule_sql("reason")} AS reason FROM pages""")
def exposure_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.exposure(table(spark, sf, "pages").select("page_id", F.col("url").alias("path")), RULES).drop("path")


@query(
    "order_digests",
    """WITH s(seed) AS (VALUES (11), (22), (33)), o AS (SELECT seed, item_id, sha256('order' || chr(0) || 'bench' || chr(0) || CAST(seed AS VARCHAR) || chr(0) || CAST(item_id AS VARCHAR)) AS h FROM benchmark, s)
    SELECT CAST(seed AS BIGINT) AS seed, count(*) AS n, sha256('[' || string_agg('"' || item_id || '"', ',' ORDER BY h, item_id) || ']') AS digest FROM o GROUP BY 1""",
)
def order_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the benchmark's order under each seed."""
    orders = splits.task_orders(table(spark, sf, "benchmark"), "item_id", F.lit("bench"), "order", [11, 22, 33])
    return long(evidence.ordered_digest(orders, ["seed"], F.col("place"), F.col("item_id").cast("string")), "seed")


@query(
    "evidence_inventory",
    """SELECT CAST(l_partkey AS VARCHAR) AS path, count(*) AS uses, any_value(sha256(p_name)) AS sha256, any_value(CAST(strlen(p_name) AS BIGINT)) AS bytes FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY 1""",
)
def evidence_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as declarations of parts, of which the larger are there."""
    declared = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("path"))
    observed = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("path"), F.sha2("p_name", 256).alias("sha256"), F.octet_length("p_name").cast("long").alias("bytes"))
    return protocol.evidence_inventory(declared, observed)


GATE_SQL = """ga AS (SELECT 'g' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'pending' WHEN 2 THEN 'blocked' ELSE 'unheard' END AS status, s_suppkey % 3 <> 0 AS required, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE s_name END AS blocker,
    CASE s_suppkey % 7 WHEN 0 THEN [] WHEN 1 THEN ['p', 'p'] ELSE ['p', 'q'] END AS evidence FROM supplier)"""


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    listed = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 1, F.array(F.lit("p"), F.lit("p"))).otherwise(F.array(F.lit("p"), F.lit("q")))
    status = F.element_at(F.array(*map(F.lit, ("passed", "pending", "blocked", "unheard"))), (k % 4 + 1).cast("int"))
    return table(spark, sf, "supplier").select(F.concat(F.lit("g"), k.cast("string")).alias("id"), status.alias("status"), (k % 3 != 0).alias("required"), F.when(k % 5 == 0, " ").otherwise(F.col("s_name")).alias("blocker"), listed.alias("evidence"))


@query(
    "gate_errors",
    f"""WITH {GATE_SQL} SELECT id, 'status' AS error FROM ga WHERE status = 'unheard' UNION ALL SELECT id, 'blocker' FROM ga WHERE status <> 'passed' AND trim(blocker) = '' UNION ALL SELECT id, 'evidence' FROM ga WHERE status = 'passed' AND len(evidence) = 0
    UNION ALL SELECT id, 'repeated-evidence' FROM ga WHERE len(list_distinct(evidence)) < len(evidence) UNION ALL SELECT 'g3', 'optional' UNION ALL SELECT 'nowhere', 'missing'""",
)
def gate_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as gates; of three mandatory ones one is optional and one missing."""
    return protocol.gate_errors(_gates(spark, sf), ["g2", "g3", "nowhere"])


@query(
    "protocol_readiness",
    f"""WITH {GATE_SQL}, c AS (SELECT v.status, count(ga.id) AS n FROM (VALUES ('blocked'), ('in_progress'), ('passed'), ('pending')) AS v(status) LEFT JOIN ga ON ga.status = v.status GROUP BY 1),
    w AS (SELECT count(*) FILTER (WHERE required) AS r, count(*) FILTER (WHERE required AND status <> 'passed') AS u FROM ga)
    SELECT c.status, c.n, w.r AS required_gates, w.u AS required_unmet, lists.k = 0 AS unresolved_agrees, false AS freeze_ready, lists.name AS listed FROM c, w, (VALUES ('all', 0), ('most', 1)) AS lists(name, k)""",
)
def protocol_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Readiness with a list of all open gates, and with one that lacks a gate: a row for each status."""
    gates, out = _gates(spark, sf), None
    unmet = gates.where("required and status <> 'passed'").select(F.col("id").alias("gate_id"))
    for name, listed in (("all", unmet), ("most", unmet.where("gate_id <> 'g1'"))):
        row = protocol.readiness(gates, listed, frozen=True).select(F.explode("gate_status_counts").alias("status", "n"), "required_gates", "required_unmet", "unresolved_agrees", "freeze_ready", F.lit(name).alias("listed"))
        out = row if out is None else out.union(row)
    return out


@query(
    "scoring_contracts",
    """SELECT r_regionkey AS k, concat_ws(',', CASE WHEN r_regionkey = 1 THEN 'name' END, CASE WHEN r_regionkey = 0 THEN 'top_k' END, CASE WHEN r_regionkey = 2 THEN 'denominator' END, CASE WHEN r_regionkey = 3 THEN 'missing-output' END, CASE WHEN r_regionkey = 4 THEN 'repeated-evidence' END) AS errors FROM region""",
)
def scoring_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """A contract for each region, wrong in one way."""
    k = F.col("r_regionkey")
    contracts = table(spark, sf, "region").select(
        k.alias("k"), F.when(k == 1, "other").otherwise(protocol.PRIMARY_METRIC).alias("name"), k.alias("top_k"), F.when(k == 2, "some").otherwise(protocol.DENOMINATOR_POLICY).alias("denominator_policy"),
        F.when(k == 3, "skip").otherwise(protocol.MISSING_POLICY).alias("missing_output_policy"), F.when(k == 4, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("evidence"),
    )
    return protocol.scoring_contract_errors(contracts).select("k", F.array_join("errors", ",").alias("errors"))


@query(
    "benchmark_contracts",
    """WITH c AS (SELECT 'r' || n_regionkey AS benchmark, count(*) AS found FROM nation GROUP BY 1), d AS (SELECT r_regionkey AS k, 'r' || (r_regionkey + 1) AS benchmark FROM region)
    SELECT coalesce(c.benchmark, d.benchmark) AS benchmark, CASE WHEN d.k IS NULL THEN 'undeclared' WHEN c.found IS NULL THEN 'unknown-benchmark' ELSE concat_ws(',', CASE WHEN k = 1 THEN 'generation' END, CASE WHEN k = 0 THEN 'top_k' END, CASE WHEN k = 3 THEN 'counts' END, CASE WHEN k >= 2 OR c.found <> 5 THEN 'denominator' END, CASE WHEN k = 2 THEN 'evidence' END) END AS errors
    FROM c FULL JOIN d ON c.benchmark = d.benchmark""",
)
def benchmark_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as benchmarks of five nations, declared one further than they are."""
    k = F.col("r_regionkey")
    name = F.concat(F.lit("r"), (k + 1).cast("string"))
    contracts = table(spark, sf, "region").select(
        name.alias("benchmark"), F.when(k == 1, "other").otherwise(name).alias("generation"), F.when(k == 0, 1).otherwise(2).alias("top_k"), F.when(k == 2, 4).otherwise(5).alias("tasks"), F.when(k == 3, 4).otherwise(5).alias("outputs"),
        F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("evidence"),
    )
    counts = table(spark, sf, "nation").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("benchmark")).agg(F.count("*").alias("found_tasks"), F.count("*").alias("found_outputs"))
    return protocol.benchmark_contract_errors(contracts, counts, 2).select("benchmark", F.array_join("errors", ",").alias("errors"))


@query(
    "eligibility_errors",
    """WITH b AS (SELECT c_custkey AS position, 'm' || (c_custkey % 1400) AS method_id, c_name AS name FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey < 1400),
    i AS (SELECT CASE WHEN c_custkey % 40 = 1 THEN c_custkey + 1 ELSE c_custkey END AS position, 'm' || c_custkey AS method_id, CASE WHEN c_custkey % 50 = 0 THEN 'renamed' ELSE c_name END AS name, c_mktsegment AS segment, c_custkey % 6 AS k FROM customer WHERE c_custkey % 10 <> 7),
    j AS (SELECT i.*, b.name AS bname, b.position AS bposition FROM i JOIN b USING (method_id))
    SELECT method_id, 'method_id' AS field, 'missing' AS error FROM b WHERE method_id NOT IN (SELECT method_id FROM i) UNION ALL SELECT method_id, 'method_id', 'extra' FROM i WHERE method_id NOT IN (SELECT method_id FROM b)
    UNION ALL SELECT method_id, 'segment', 'value' FROM j WHERE segment = 'MACHINERY' UNION ALL SELECT method_id, 'name', 'differs' FROM j WHERE name <> bname UNION ALL SELECT method_id, 'position', 'order' FROM j WHERE position <> bposition
    UNION ALL SELECT method_id, 'code_trust_class', 'value' FROM j WHERE k = 5 UNION ALL SELECT method_id, 'risks', 'value' FROM j WHERE k = 1 UNION ALL SELECT method_id, 'risks', 'repeats-primary' FROM j WHERE k = 2 UNION ALL SELECT method_id, 'risks', 'duplicate' FROM j WHERE k = 3""",
)
def eligibility_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as an inventory of methods, against a baseline of other customers."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("m"), k.cast("string"))
    base = c.where("c_custkey % 10 <> 3 and c_custkey < 1400").select(k.alias("position"), name.alias("method_id"), F.col("c_name").alias("name"))
    risks = F.when(k % 6 == 1, F.array(F.lit("odd"))).when(k % 6 == 2, F.array(F.lit("trusted"))).when(k % 6 == 3, F.array(F.lit("unsafe"), F.lit("unsafe"))).otherwise(F.array(F.lit("unsafe")))
    held = c.where("c_custkey % 10 <> 7").select(
        F.when(k % 40 == 1, k + 1).otherwise(k).alias("position"), name.alias("method_id"), F.when(k % 50 == 0, "renamed").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"),
        F.when(k % 6 == 5, "unknown").otherwise("trusted").alias("code_trust_class"), risks.alias("risks"),
    )
    return ledgers.eligibility_errors(held, base, {"segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"], "code_trust_class": ["trusted", "unsafe"]})


@query(
    "admission_counts",
    """SELECT count(*) AS methods, count(*) FILTER (WHERE c_acctbal > 0) AS sound, count(*) FILTER (WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS admitted, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unlisted FROM customer""",
)
def admission_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as methods, orders as a roster."""
    methods = table(spark, sf, "customer").withColumnRenamed("c_custkey", "method_id")
    roster = table(spark, sf, "orders").select(F.col("o_custkey").alias("method_id"))
    sound = F.col("c_acctbal") > 0
    unlike, counts = manifests.admission(methods, [roster], {"methods": F.lit(True), "sound": sound, "admitted": sound & (F.col("c_mktsegment") == "BUILDING")})
    return counts.crossJoin(unlike.agg(F.count("*").alias("unlisted")))  # one row each


@query(
    "summary_differences",
    """WITH a AS (SELECT event_type, user_id % 7 AS part, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2), b AS (SELECT event_type, user_id % 7 AS part, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE NOT (event_type = 'click' AND value > 40) AND user_id % 7 <> 5 GROUP BY 1, 2),
    j AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.part, b.part) AS part, a.n AS an, b.n AS bn, a.total AS left_total, b.total AS right_total FROM a FULL JOIN b ON a.event_type = b.event_type AND a.part = b.part)
    SELECT event_type, part, 'n' AS field FROM j WHERE NOT coalesce(an = bn, false) UNION ALL SELECT event_type, part, 'total' FROM j WHERE NOT coalesce(abs(left_total - right_total) <= 1e-12, false)""",
)
def summary_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Event totals, recomputed and as stored by a table that lacks some."""
    e = table(spark, sf, "events").withColumn("part", F.pmod("user_id", F.lit(7)))
    total = lambda rows: rows.groupBy("event_type", "part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    stored = e.where("not (event_type = 'click' and value > 40) and part <> 5")
    return ledgers.summary_differences(total(e), total(stored), ["event_type", "part"], ["n", "total"])


@query(
    "passed_evidence",
    """SELECT CAST(event_id AS VARCHAR) AS path, concat_ws(',', CASE WHEN event_type = 'error' THEN 'status' END, CASE WHEN user_id % 5 = 0 THEN 'runner' END, CASE WHEN value < 1 THEN 'ended' END, CASE WHEN event_id % 11 = 0 THEN 'result_digest' END) AS errors, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'run_id' END, 'source_digest') AS warnings FROM events""",
)
def passed_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Events as passed run records with some fields empty."""
    e, sha = table(spark, sf, "events"), F.sha2(F.col("event_id").cast("string"), 256)
    record = F.to_json(
        F.struct(
            F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"), F.col("event_type").alias("method_id"), F.when(F.col("user_id") % 5 == 0, " ").otherwise("r").alias("runner"),
            F.when(F.col("value") >= 1, "2026").alias("ended_at_utc"), F.when(F.col("event_id") % 11 == 0, "x").otherwise(sha).alias("result_sha256"), F.when(F.col("event_id") % 2 == 1, F.col("event_id").cast("string")).alias("run_id"), F.lit("2026").alias("started_at_utc"),
        )
    )
    found = protocol.passed_evidence_errors(e.select(F.col("event_id").cast("string").alias("path"), record.alias("text")))
    return found.select("path", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(
    "prediction_run_errors",
    """SELECT CAST(event_id AS VARCHAR) AS path, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'top_k' END, CASE WHEN event_type = 'error' THEN 'labels-seen' END, CASE WHEN user_id % 6 = 0 THEN 'scored-before' END, CASE WHEN event_id % 100 >= 90 THEN 'predictions-missing' END,
    CASE WHEN event_id % 100 < 90 AND event_id % 7 = 0 THEN 'predictions-digest' END, CASE WHEN value < 2 THEN 'mutation-check' END, CASE WHEN user_id % 8 = 1 THEN 'network' END) AS errors FROM events""",
)
def prediction_run_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Events as strict prediction runs over ninety files."""
    k, sha = F.col("event_id"), lambda c: F.sha2(c.cast("string"), 256)
    place = F.pmod("event_id", F.lit(100))
    flags = F.struct(
        F.when(F.col("event_type") == "error", "true").otherwise("false").alias("inference_received_test_labels"), (F.col("user_id") % 6 != 0).alias("scoring_after_inference"),
        F.when(F.col("value") < 2, "not_run").otherwise("passed").alias("label_mutation_check"), F.when(F.col("user_id") % 8 == 1, "open").otherwise("denied").alias("network_policy"),
    )
    results = F.struct(place.cast("string").alias("predictions_path"), F.when(k % 7 == 0, "other").otherwise(sha(place)).alias("predictions_sha256"))
    record = F.to_json(F.struct(F.struct(F.when(k % 13 == 0, 0).otherwise(2).alias("top_k")).alias("attempt_budget"), flags.alias("challenge_firewall"), results.alias("results")))
    files = spark.range(90).select(F.col("id").cast("string").alias("path"), sha(F.col("id")).alias("sha256"))
    found = protocol.prediction_run_errors(table(spark, sf, "events").select(k.cast("string").alias("path"), record.alias("text")), files, strict=True)
    return found.select("path", F.array_join("errors", ",").alias("errors"))


def _run_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text): events as run records and results; older ones with the older field names."""
    e = table(spark, sf, "events")
    old, method = F.col("event_id") % 3 == 0, F.concat(F.lit("m"), F.pmod("user_id", F.lit(9)).cast("string"))
    record = F.struct(
        F.when(F.col("value") > 20, "passed").otherwise("failed").alias("status"), F.when(~old, method).alias("method_id"), F.when(old, method).alias("baseline_id"), F.col("event_type").alias("runner"),
        F.when(~old, "full").alias("scope"), F.when(old, "smoke").alias("level"),
    )
    return e.select(F.concat(F.lit("reports/"), method, F.lit("/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 4 == 0, "/result.json").otherwise("/run.json")).alias("path"), F.to_json(record).alias("text"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ended"))


RUN_SQL = """rf AS (SELECT 'reports/m' || (user_id % 9) || '/' || event_id || CASE WHEN event_id % 4 = 0 THEN '/result.json' ELSE '/run.json' END AS path, CASE WHEN event_id % 4 = 0 THEN 'result' ELSE 'run_record' END AS kind, CASE WHEN value > 20 THEN 'passed' ELSE 'failed' END AS status,
    'm' || (user_id % 9) AS method_id, event_type AS runner, CASE WHEN event_id % 3 = 0 THEN 'smoke' ELSE 'full' END AS scope, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ended, CASE WHEN event_id % 4 = 0 THEN 'other' ELSE 'run' END AS tier FROM events)"""
RUN_RULES = [{"glob": "reports/*/run.json", "tier": "run", "reason": "record"}, {"glob": "*", "tier": "other", "reason": "default"}]


@query("run_inventory", f"WITH {RUN_SQL} SELECT path, tier, kind, status, method_id, runner, scope FROM rf")
def run_inventory(spark: SparkSession, sf: str) -> DataFrame:
    found = protocol.run_inventory(_run_files(spark, sf).select("path", "text"), RUN_RULES)
    return found.select("path", "tier", "kind", "status", "method_id", "runner", "scope")


@query("audit_layer", f"WITH {RUN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY ended DESC, path DESC) AS n FROM rf WHERE kind = 'run_record' AND runner IN ('click', 'view')) SELECT method_id, path, status, runner FROM r WHERE n = 1")
def audit_layer(spark: SparkSession, sf: str) -> DataFrame:
    """The latest record of each method by a runner that it allows."""
    files = _run_files(spark, sf)
    runs = protocol.run_inventory(files.select("path", "text"), RUN_RULES).join(files.select("path", "ended"), "path").withColumn("started", F.lit(None).cast("string"))
    allowed = spark.createDataFrame([(f"m{k}", r) for k in range(9) for r in ("click", "view")], "method_id string, runner string")
    return protocol.audit_layer(runs, allowed).select("method_id", "path", "status", "runner")


@query(
    "materialisation_errors",
    """WITH a AS (SELECT page_id, sha256(html) AS sha FROM pages WHERE page_id % 10 <> 4), f AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN sha256(url) ELSE sha256(html) END AS sha, page_id % 9 = 1 AS hidden FROM pages WHERE page_id % 10 <> 5),
    j AS (SELECT coalesce(a.page_id, f.page_id) AS id, a.sha AS audited, f.sha, f.hidden FROM a FULL JOIN f ON a.page_id = f.page_id)
    SELECT CAST(id AS VARCHAR) AS task_id, 'missing' AS error FROM j WHERE sha IS NULL UNION ALL SELECT CAST(id AS VARCHAR), 'not-audited' FROM j WHERE audited IS NULL UNION ALL SELECT CAST(id AS VARCHAR), 'digest' FROM j WHERE sha <> audited UNION ALL SELECT CAST(id AS VARCHAR), 'hidden-output' FROM j WHERE hidden""",
)
def materialisation_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as challenge files against an audit of other pages."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    audit = p.where("page_id % 10 <> 4").select(k.cast("string").alias("task_id"), F.sha2("html", 256).alias("sha256"))
    files = p.where("page_id % 10 <> 5").select(k.cast("string").alias("task_id"), F.when(k % 7 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("sha256"), (k % 9 == 1).cast("int").alias("hidden_outputs"))
    return protocol.materialisation_errors(files, audit)


@query(
    "resource_gate",
    """WITH u AS (SELECT user_id, count(*) AS samples, max(value) AS peak FROM events GROUP BY 1) SELECT user_id, concat_ws(',', CASE WHEN NOT samples >= 100 THEN 'samples' END, CASE WHEN NOT peak <= 200 THEN 'peak' END) AS blockers FROM u""",
)
def resource_gate(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("samples"), F.max("value").alias("peak"))
    return per.select("user_id", F.array_join(resources.gate_blockers({"samples": F.col("samples") >= 100, "peak": F.col("peak") <= 200}), ",").alias("blockers"))


# ---- text sources


@query("gpu_processes", "SELECT CAST(sum(CASE WHEN user_id % 4 = 1 AND event_type <> 'error' THEN user_id * 1048576 ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (WHERE event_type = 'error') AS unreadable FROM events")
def gpu_processes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of a GPU tool; those of errors have no memory."""
    memory = F.when(F.col("event_type") == "error", "[N/A]").otherwise(F.col("user_id").cast("string"))
    lines = table(spark, sf, "events").select(F.concat_ws(", ", F.lit("GPU-1"), F.pmod("user_id", F.lit(4)).cast("string"), F.col("event_type"), memory).alias("value"))
    return inventory.gpu_processes(lines, 1)


@query(
    "cgroup_mounts",
    """SELECT CAST(n.n_nationkey AS INTEGER) AS hierarchy, '/' || n.n_name AS path, CAST(r.r_regionkey AS INTEGER) AS mount_id, '/sys/' || replace(r.r_name, ' ', '-') AS mount_point FROM nation n, region r WHERE (r.r_regionkey = 0 AND n.n_nationkey = 0) OR (r.r_regionkey > 0 AND n.n_nationkey > 0 AND n.n_nationkey % 5 = r.r_regionkey)""",
)
def cgroup_mounts(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as mounts, the first of the unified kind, and nations as memberships with one controller."""
    k, n = F.col("r_regionkey").cast("string"), F.col("n_nationkey")
    kind = F.when(F.col("r_regionkey") == 0, F.lit("cgroup2 cgroup rw")).otherwise(F.concat(F.lit("cgroup cgroup rw,c"), k))
    mount = table(spark, sf, "region").select(F.concat(k, F.lit(" 1 0:1 / /sys/"), F.replace("r_name", F.lit(" "), F.lit("-")), F.lit(" rw shared:1 - "), kind).alias("value"))
    member = table(spark, sf, "nation").select(F.concat(n.cast("string"), F.lit(":"), F.when(n == 0, "").otherwise(F.concat(F.lit("c"), (n % 5).cast("string"))), F.lit(":/"), "n_name").alias("value"))
    return inventory.cgroup_mounts(inventory.mounts(mount), inventory.memberships(member)).select("hierarchy", "path", "mount_id", "mount_point")


@query("tree_listing", "SELECT '100644' AS mode, 'blob' AS kind, sha1(html) AS oid, 'p/' || page_id || '.html' AS path FROM pages")
def tree_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as the entries of NUL-separated tree listings, one for each host."""
    entry = F.concat(F.lit("100644 blob "), F.sha1("html"), F.lit("\t"), F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html"))
    payload = table(spark, sf, "pages").groupBy(F.parse_url("url", F.lit("HOST"))).agg(F.array_join(F.collect_list(entry), "\0").alias("payload"))
    return inventory.git_tree(payload)


@query("blob_oids", "SELECT page_id, sha1('blob ' || strlen(html) || chr(0) || html) AS oid FROM pages")
def blob_oids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")).select("page_id", inventory.blob_oid().alias("oid"))


@query(
    "file_extensions",
    """WITH p AS (SELECT CASE p_size % 4 WHEN 0 THEN 'a/' || p_name || '.TXT' WHEN 1 THEN 'b.d/' || p_brand WHEN 2 THEN '.' || p_type ELSE p_name || '.tar.gz' END AS path FROM part), n AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS name FROM p),
    e AS (SELECT regexp_extract(name, '(\\.[^.]+)$', 1) AS suffix FROM n) SELECT CASE WHEN suffix = '' THEN '<none>' ELSE lower(suffix) END AS extension, count(*) AS n FROM e GROUP BY 1""",
)
def file_extensions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 4
    path = F.when(k == 0, F.concat(F.lit("a/"), "p_name", F.lit(".TXT"))).when(k == 1, F.concat(F.lit("b.d/"), "p_brand")).when(k == 2, F.concat(F.lit("."), "p_type")).otherwise(F.concat("p_name", F.lit(".tar.gz")))
    return inventory.extensions(table(spark, sf, "part").select(path.alias("path")))


@query("requirement_lines", "SELECT replace(p_name, ' ', '-') || '==' || p_size AS requirement, count(*) AS n FROM part WHERE p_size % 5 NOT IN (0, 1) GROUP BY 1")
def requirement_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as lines of a requirements file: some are comments, some options."""
    k, own = F.col("p_size") % 5, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("=="), F.col("p_size").cast("string"))
    value = F.when(k == 0, F.concat(F.lit("# "), own)).when(k == 1, F.concat(F.lit("--hash="), own)).when(k == 2, F.concat(own, F.lit("  # note"))).otherwise(own)
    return inventory.requirement_lines(table(spark, sf, "part").select(value.alias("value"))).groupBy("requirement").agg(F.count("*").alias("n"))


@query("submodule_entries", "SELECT s_name AS name, 'ext/' || s_suppkey AS path, 'https://host/' || s_nationkey AS url FROM supplier")
def submodule_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as entries of module lists, one list for each nation."""
    block = F.concat(F.lit('[submodule "'), "s_name", F.lit('"]\n\tpath = ext/'), F.col("s_suppkey").cast("string"), F.lit("\n\turl = https://host/"), F.col("s_nationkey").cast("string"), F.lit("\n"))
    texts = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(block), "").alias("text"))
    return inventory.submodules(texts)


@query("yaml_scalars", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) END AS value FROM part")
def yaml_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """A scalar of a small YAML text for each part: quoted, plain with a comment, or missing."""
    k = F.col("p_size") % 3
    text = F.concat(F.lit("top: 1\n"), F.when(k == 0, F.concat(F.lit('name: "'), "p_name", F.lit('"\n'))).when(k == 1, F.concat(F.lit("name: "), F.col("p_size").cast("string"), F.lit("  # size\n"))).otherwise(F.lit("  name: inner\n")))
    return table(spark, sf, "part").select("p_partkey", inventory.yaml_scalar(text, "name").alias("value"))


# ---- files


def _put(folder: str, name: str, text: str) -> None:
    fs, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(text.encode())


def _nation_task(k: int, r: int) -> str:
    """A task file's text: most are sound, every seventh repeats a key, is ragged, or has another's name."""
    task = {"train": [{"input": [[k % 10, r]], "output": [[r, k % 10]]}], "test": [{"input": [[r]], "output": [[k // 10]]}]}
    if k % 7 == 4:
        task["train"][0]["output"] = [[1], [1, 2]]
    if k % 7 == 6:
        task["name"] = "other"
    text = json.dumps(task)
    return '{"train": [], ' + text[1:] if k % 7 == 2 else text


def _nation_files(spark: SparkSession, sf: str, sound: bool = False) -> str:
    """A folder with a task file for each of the nations (a fixed dimension of 25), in training and evaluation."""
    folder = shared.folder(spark)
    for r in table(spark, sf, "nation").collect():
        k = r["n_nationkey"]
        if not sound or k % 7 not in (2, 4, 6):
            _put(folder, f"{'evaluation' if k % 2 else 'training'}/{k:08x}.json", _nation_task(k, r["n_regionkey"]))
    return folder


NATION_SQL = """nf AS (SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'evaluation' ELSE 'training' END AS split, lpad(lower(hex(n_nationkey)), 8, '0') AS task_id, n_nationkey AS k, n_regionkey AS r, CASE n_nationkey % 7 WHEN 2 THEN 'strict_json' WHEN 4 THEN 'train_output' WHEN 6 THEN 'name_is_not_stem' ELSE '' END AS errors FROM nation)"""


@query("task_files", f"WITH {NATION_SQL} SELECT split, task_id, errors FROM nf")
def task_files(spark: SparkSession, sf: str) -> DataFrame:
    """The nations' task files, enumerated by split, read strictly and validated."""
    rows = tasks.parse_tasks(tasks.enumerate_dataset(spark, _nation_files(spark, sf)))
    return rows.select("split", "task_id", F.array_join("errors", ",").alias("errors"))


@query("task_split", f"WITH {NATION_SQL} SELECT task_id, r AS test_input FROM nf WHERE split = 'training' AND k % 7 <> 2")
def task_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split as a map of ids to tasks, without the checks; a text that is no strict JSON has no task."""
    rows = tasks.load_split(spark, f"{_nation_files(spark, sf)}/training")
    return rows.where("task is not null").select("task_id", F.col("task.test")[0]["input"][0][0].alias("test_input"))


@query("batch_validation", f"WITH {NATION_SQL} SELECT count(*) AS files, count(*) FILTER (WHERE errors <> '') AS invalid FROM nf")
def batch_validation(spark: SparkSession, sf: str) -> DataFrame:
    folder = _nation_files(spark, sf)
    rows = tasks.load_tasks(spark, folder, recursive=True)
    return tasks.batch_validate(rows.unionByName(tasks.load_tasks(spark, f"{folder}/training")))


@query("training_source", f"WITH {NATION_SQL} SELECT 'nations:' || task_id AS record_id, k // 10 AS label FROM nf WHERE split = 'training' AND errors = ''")
def training_source(spark: SparkSession, sf: str) -> DataFrame:
    """The sound training files as a source of records."""
    folder = _nation_files(spark, sf, sound=True)
    expected = table(spark, sf, "nation").where("n_nationkey % 2 = 0 and n_nationkey % 7 not in (2, 4, 6)").count()
    rows = tasks.load_training_source(spark, "nations", f"{folder}/training", expected)
    return rows.select("record_id", F.col("task.test")[0]["output"][0][0].alias("label"))


@query("file_inventory", f"WITH {NATION_SQL} SELECT split || '/' || task_id || '.json' AS path FROM nf WHERE split = 'evaluation' UNION ALL SELECT 'training/' || task_id || '.json' FROM nf WHERE split = 'training' AND k <> 0")
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """All files by two patterns that overlap, without one that is excluded."""
    folder = _nation_files(spark, sf)
    rows = inventory.relative(inventory.inventory(spark, folder, f"{folder}/training", glob="*.json"), folder.partition("://")[2] or folder)
    return inventory.leaves(rows, spark.createDataFrame([("training/00000000.json",)], "path string")).where("bytes > 0").select("path")


@query("file_tree", f"WITH {NATION_SQL} SELECT count(*) AS files FROM nf")
def file_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Size and digest of the tree, where writing it again gives the same."""
    first, second = (inventory.tree_digest(inventory.relative(inventory.inventory(spark, f, glob="*.json"), f.partition("://")[2] or f)) for f in (_nation_files(spark, sf), _nation_files(spark, sf)))
    return first.join(second.select("digest"), "digest").select("files")


@query("prediction_file", f"WITH {TASK_SQL}, n AS (SELECT CAST(n_nationkey AS VARCHAR) AS task_id, n_regionkey AS r FROM nation) SELECT task_id, CASE WHEN r = 3 THEN 'attempt_gap' ELSE '' END AS errors FROM n")
def prediction_file(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction file with a task for each nation."""
    rows = table(spark, sf, "nation").collect()  # a fixed dimension of 25
    folder = shared.folder(spark)
    _put(folder, "predictions.json", json.dumps({str(r["n_nationkey"]): [{f"attempt_{2 if r['n_regionkey'] == 3 else 1}": [[r["n_regionkey"]]]}] for r in rows}))
    found = tasks.load_predictions(spark, f"{folder}/predictions.json")
    return found.select("task_id", F.array_join("errors", ",").alias("errors"))


@query("ledger_file", "SELECT lpad(lower(hex(n_nationkey)), 8, '0') AS task_id FROM nation")
def ledger_file(spark: SparkSession, sf: str) -> DataFrame:
    """The nations' ids as a locked ledger: written, hashed, read and checked."""
    import hashlib

    ids = sorted(f"{r['n_nationkey']:08x}" for r in table(spark, sf, "nation").collect())  # a fixed dimension of 25
    digest = hashlib.sha256(json.dumps(ids, separators=(",", ":")).encode()).hexdigest()
    text = json.dumps({"status": "passed", "scope": "cross-benchmark-labeled-task-overlap", "overlap": {"id_overlap": ids, "id_overlap_count": len(ids), "overlap_digest": digest, "test_io_exact": ids}})
    folder = shared.folder(spark)
    _put(folder, "ledger.json", text)
    return ledgers.load_ledger(spark, f"{folder}/ledger.json", hashlib.sha256(text.encode()).hexdigest())


@query("locked_manifest", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def locked_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the nations with its own digest: written, hashed, read and checked."""
    import hashlib

    body = {"nations": [[r["n_name"], r["n_regionkey"]] for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]}  # a fixed dimension of 25
    own = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    text = json.dumps(body | {"manifest_sha256": own}, indent=1)
    folder = shared.folder(spark)
    _put(folder, "manifest.json", text)
    document = ledgers.load_locked_manifest(spark, f"{folder}/manifest.json", hashlib.sha256(text.encode()).hexdigest())
    return spark.createDataFrame([tuple(x) for x in document["nations"]], "name string, region int")


@query("code_inventory", f"WITH {NATION_SQL} SELECT split || '/' || task_id || '.json' AS path FROM nf WHERE split = 'training' OR k < 10")
def code_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """The files of two globs that overlap."""
    return inventory.code_inventory(spark, _nation_files(spark, sf), ["training/*.json", "*/0000000[0-9].json"]).where("bytes > 0").select("path")


#: A task's file as the sink writes it: two spaces a level, keys in order.
_PRETTY_ROW = "'        [\n' || list_aggregate(list_transform(r, lambda c: '          ' || c), 'string_agg', ',\n') || '\n        ]'"
_PRETTY_GRID = "'[\n' || list_aggregate(list_transform({g}, lambda r: " + _PRETTY_ROW + "), 'string_agg', ',\n') || '\n      ]'"
_FILE_SQL = (
    "'{\n  \"test\": [\n    {\n      \"input\": ' || " + _PRETTY_GRID.format(g="x") + " || '\n    }\n  ],\n  \"train\": [\n' || list_aggregate(list_transform(train, lambda p: '    {\n      \"input\": ' || "
    + _PRETTY_GRID.format(g="p.i") + " || ',\n      \"output\": ' || " + _PRETTY_GRID.format(g="p.o") + " || '\n    }'), 'string_agg', ',\n') || '\n  ]\n}\n'"
)


@query("challenge_tree", f"""WITH {TASK_SQL} SELECT CAST(t AS VARCHAR) AS task_id, CAST(len(train) AS INTEGER) AS demonstrations, 0 AS hidden, sha256({_FILE_SQL}) AS sha256, 'equal' AS digest FROM tk""")
def challenge_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The label-free tree of all tasks, written as files and read back, against its manifest."""
    folder = shared.folder(spark)
    sinks.write_challenge(order_tasks(spark, sf), folder)
    both = task_tree.read_tree(spark, folder).withColumn("task_id", F.when(F.col("text").isNotNull(), F.regexp_extract("path", r"([^/]+)\.json\z", 1)))
    parsed = F.from_json("text", "struct<train:array<struct<input:string,output:string>>,test:array<struct<input:string,output:string>>>")
    return both.select("task_id", F.size(parsed["train"]).alias("demonstrations"), F.size(F.filter(parsed["test"], lambda p: p["output"].isNotNull())).alias("hidden"), "sha256", F.when(F.col("own") == F.col("sha256"), "equal").otherwise("unlike").alias("digest"))


@query(
    "firewall_run",
    f"""WITH {SCORE_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE exact) AS hits, count(*) FILTER (WHERE shifted_exact) AS shifted FROM so)
    SELECT 'baseline' AS solver, n AS tasks, n AS equal_inputs, n AS changed_labels, n AS equal_predictions, hits AS exact_a, shifted AS exact_b, 'passed' AS verdict FROM n
    UNION ALL SELECT 'told', n, n, n, CAST(0 AS BIGINT), n, n, 'failed' FROM n""",
)
def firewall_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two views that differ in their hidden labels, each solved from its files alone: the baseline passes, a solver that is handed the labels fails."""
    given = shared.written(order_tasks(spark, sf))
    other = given.select("task_id", grids.mutate_labels(F.col("task")).alias("task"))

    def told(inputs: DataFrame, view: firewall.View) -> DataFrame:
        labels = firewall.read_labels(spark, view).select("task_id", F.transform("outputs", lambda g: grids.attempts(F.array(g, g))).alias("outputs"))
        return inputs.select("task_id").join(labels, "task_id")

    def honest(inputs: DataFrame, _: firewall.View) -> DataFrame:
        return baseline.predictions(baseline.rank_candidates(inputs, 2))

    rows, views = None, firewall.prepare(given, other, shared.folder(spark))  # each tree is written once and read once
    for name, solver in (("baseline", honest), ("told", told)):
        proof = firewall.proof(views, solver, 2).select(F.lit(name).alias("solver"), "*")
        rows = proof if rows is None else rows.union(proof)
    return rows


@query("split_trees", f"""WITH {TASK_SQL} SELECT 'solutions' AS tree, CAST(t AS VARCHAR) AS task_id, CAST(to_json([y]) AS VARCHAR) AS labels FROM tk UNION ALL SELECT 'inference', CAST(t AS VARCHAR), NULL FROM tk""")
def split_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Inference files and hidden solutions, written apart and read back."""
    folder = shared.folder(spark)
    sinks.write_split_trees(order_tasks(spark, sf), folder)
    rows = spark.read.parquet(folder)
    return rows.select("tree", "task_id", F.when(F.col("tree") == "solutions", F.col("text")).alias("labels"))


@query(
    "challenge_view",
    """WITH m AS (SELECT page_id AS k, sha256(html) AS sha FROM pages WHERE page_id % 10 <> 4), f AS (SELECT page_id AS k, CASE WHEN page_id % 7 = 0 THEN sha256(url) ELSE sha256(html) END AS sha FROM pages WHERE page_id % 10 <> 5),
    j AS (SELECT coalesce(m.k, f.k) AS k, m.sha AS declared, f.sha FROM m FULL JOIN f ON m.k = f.k)
    SELECT CAST(k AS VARCHAR) AS path, CASE WHEN sha IS NULL THEN 'missing' WHEN declared IS NULL THEN 'undeclared' ELSE 'mismatch' END AS error FROM j WHERE sha IS DISTINCT FROM declared UNION ALL SELECT '*', 'task-count'""",
)
def challenge_view(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as the files of a view against its manifest; no task of it shows a label, but there are more than declared."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    manifest = p.where("page_id % 10 <> 4").select(k.cast("string").alias("path"), F.sha2("html", 256).alias("sha256"))
    files = p.where("page_id % 10 <> 5").select(k.cast("string").alias("path"), F.when(k % 7 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("sha256"))
    seen = order_tasks(spark, sf).select(F.col("task_id").alias("path"), grids.challenge_only(F.col("task")).alias("task"))
    return inventory.challenge_view_errors(manifest, files, seen, expected_tasks=0)


# ---- split manifests, one row a rule

#: Customers as records, three to a cluster, and one fault for each rule at rows of its own.
_MANIFEST_SQL = """b AS (SELECT c_custkey AS k, c_nationkey AS source, (c_custkey - 1) // 3 * 3 + 1 AS c FROM customer),
r AS (SELECT k AS record_id, source FROM b WHERE k % 71 <> 5 UNION ALL SELECT k, source FROM b WHERE k % 97 = 0 AND k % 71 <> 5),
m AS (SELECT c AS cluster_id, k AS record_id FROM b WHERE k % 89 <> 0 UNION ALL SELECT c + 3, k FROM b WHERE k % 83 = 0),
a AS (SELECT CASE WHEN c % 10 < 7 THEN 'train' WHEN c % 10 < 9 THEN 'validation' ELSE 'audit' END AS split, c AS cluster_id FROM (SELECT DISTINCT c FROM b) WHERE c % 79 <> 0
      UNION ALL SELECT 'audit', c FROM (SELECT DISTINCT c FROM b) WHERE c % 73 = 0 AND c % 79 <> 0 UNION ALL SELECT 'test', c FROM (SELECT DISTINCT c FROM b) WHERE c % 67 = 0 UNION ALL SELECT 'train', -c FROM (SELECT DISTINCT c FROM b) WHERE c % 61 = 0),
fl AS (SELECT CASE WHEN k % 130 = 26 THEN -k ELSE k END AS record_id FROM b WHERE k % 13 = 0),
fc AS (SELECT DISTINCT c AS cluster_id FROM b WHERE k % 13 = 0 AND k % 11 <> 0)"""


def _customer_manifest(spark: SparkSession, sf: str) -> split_manifest.Manifest:
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("source"), F.expr("(c_custkey - 1) div 3 * 3 + 1").alias("c"))
    c = b.select("c").distinct()
    records = b.where("k % 71 <> 5").select(F.col("k").alias("record_id"), "source")
    records = records.union(records.where("record_id % 97 = 0"))
    members = b.where("k % 89 <> 0").select(F.col("c").alias("cluster_id"), F.col("k").alias("record_id")).union(b.where("k % 83 = 0").select(F.col("c") + 3, "k"))
    split = F.when(F.col("c") % 10 < 7, "train").when(F.col("c") % 10 < 9, "validation").otherwise("audit")
    allocation = c.where("c % 79 <> 0").select(split.alias("split"), F.col("c").alias("cluster_id")).union(c.where("c % 73 = 0 and c % 79 <> 0").select(F.lit("audit"), "c"))
    allocation = allocation.union(c.where("c % 67 = 0").select(F.lit("test"), "c")).union(c.where("c % 61 = 0").select(F.lit("train"), -F.col("c")))
    flagged = b.where("k % 13 = 0").select(F.when(F.col("k") % 130 == 26, -F.col("k")).otherwise(F.col("k")).alias("record_id"))
    clusters = b.where("k % 13 = 0 and k % 11 <> 0").select(F.col("c").alias("cluster_id")).distinct()
    none = spark.createDataFrame([], "name string, value string")
    return split_manifest.Manifest(records, members, allocation, flagged, clusters, none)


@query(
    "manifest_rules",
    f"""WITH {_MANIFEST_SQL}, rc AS (SELECT record_id, count(*) AS n FROM r GROUP BY 1), mc AS (SELECT record_id, count(DISTINCT cluster_id) AS n FROM m GROUP BY 1),
    cl AS (SELECT cluster_id, min(record_id) AS least, bool_or(record_id IN (SELECT record_id FROM fl)) AS hit FROM m GROUP BY 1), al AS (SELECT cluster_id, count(DISTINCT split) AS n, count(*) FILTER (WHERE split = 'test') AS strange FROM a GROUP BY 1)
    SELECT 'duplicate-record' AS rule, count(*) AS offenders FROM rc WHERE n > 1
    UNION ALL SELECT 'unknown-member', count(*) FROM mc WHERE record_id NOT IN (SELECT record_id FROM r) UNION ALL SELECT 'uncovered-record', count(*) FROM rc WHERE record_id NOT IN (SELECT record_id FROM m)
    UNION ALL SELECT 'record-in-two-clusters', count(*) FROM mc WHERE n > 1 UNION ALL SELECT 'unknown-flagged', count(DISTINCT record_id) FROM fl WHERE record_id NOT IN (SELECT record_id FROM r)
    UNION ALL SELECT 'cluster-name', count(*) FROM cl WHERE cluster_id <> least UNION ALL SELECT 'unknown-cluster', count(*) FROM al WHERE cluster_id NOT IN (SELECT cluster_id FROM m)
    UNION ALL SELECT 'unassigned-cluster', count(*) FROM cl WHERE cluster_id NOT IN (SELECT cluster_id FROM a) UNION ALL SELECT 'cluster-crosses-splits', count(*) FROM al WHERE n > 1
    UNION ALL SELECT 'unexpected-split', count(*) FROM al WHERE strange > 0
    UNION ALL SELECT 'flagged-clusters', (SELECT count(*) FROM cl WHERE hit AND cluster_id NOT IN (SELECT cluster_id FROM fc)) + (SELECT count(*) FROM fc WHERE cluster_id NOT IN (SELECT cluster_id FROM cl WHERE hit))
    UNION ALL SELECT 'declared-count', CAST(3 AS BIGINT) UNION ALL SELECT 'declared-digest', CAST(1 AS BIGINT)""",
)
def manifest_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of all customers with a fault for each rule; of its declared values two counts and a digest are wrong and one count is missing."""
    manifest = split_manifest.with_declared(_customer_manifest(spark, sf))
    wrong = F.col("name").isin("records", "clusters of audit", "digest of members")
    declared = manifest.declared.where("name <> 'flagged-records'").select("name", F.when(wrong, F.concat("value", F.lit("0"))).otherwise(F.col("value")).alias("value"))
    return split_manifest.rule_offenders(replace(manifest, declared=shared.written(declared)), ["train", "validation", "audit"])


@query(
    "manifest_values",
    f"""WITH {_MANIFEST_SQL}, h AS (SELECT split, count(DISTINCT a.cluster_id) AS clusters, count(m.record_id) AS records FROM a LEFT JOIN m USING (cluster_id) GROUP BY 1)
    SELECT 'records' AS name, CAST(count(*) AS VARCHAR) AS value FROM r UNION ALL SELECT 'clusters', CAST(count(DISTINCT cluster_id) AS VARCHAR) FROM m UNION ALL SELECT 'flagged-records', CAST(count(DISTINCT record_id) AS VARCHAR) FROM fl
    UNION ALL SELECT 'flagged-clusters', CAST(count(*) AS VARCHAR) FROM fc UNION ALL SELECT 'clusters of ' || split, CAST(clusters AS VARCHAR) FROM h UNION ALL SELECT 'records of ' || split, CAST(records AS VARCHAR) FROM h
    UNION ALL SELECT 'digest of records', sha256('[' || string_agg('{{"record_id":' || record_id || ',"source":' || source || '}}', ',' ORDER BY record_id) || ']') FROM r
    UNION ALL SELECT 'digest of members', sha256('[' || string_agg('{{"cluster_id":' || cluster_id || ',"record_id":' || record_id || '}}', ',' ORDER BY cluster_id, record_id) || ']') FROM m
    UNION ALL SELECT 'digest of allocation', sha256('[' || string_agg('{{"cluster_id":' || cluster_id || ',"split":"' || split || '"}}', ',' ORDER BY split, cluster_id) || ']') FROM a""",
)
def manifest_values(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and digests of the customers' manifest."""
    return split_manifest.observed(_customer_manifest(spark, sf))


# ---- outside solvers


def _mirror(task: dict) -> list:
    return [[[r[::-1] for r in p["input"]], p["input"]] for p in task["test"]]


def _fragile(task: dict) -> list:
    rows = len(task["train"][0]["input"])
    if rows == 1:
        raise ValueError("too small")
    return [] if rows == 2 else [[[[10]]] if rows == 3 else [p["input"]] for p in task["test"]]


@query(
    "adapter_run",
    f"""WITH {TASK_SQL}, e AS (SELECT *, list_transform(x, lambda r: list_reverse(r)) AS mirrored, len(train[1].i) AS rows FROM tk),
    f AS (SELECT *, CASE rows WHEN 1 THEN 'ValueError' WHEN 2 THEN 'contract:output_count' WHEN 3 THEN 'contract:grid' END AS error FROM e)
    SELECT 'mirror' AS solver, count(*) AS tasks, count(*) FILTER (WHERE y = mirrored OR y = x) AS exact, 2 * count(*) AS attempts, '' AS errors FROM e
    UNION ALL SELECT 'fragile', count(*), count(*) FILTER (WHERE error IS NULL AND y = x), count(*) FILTER (WHERE error IS NULL),
    (SELECT coalesce(string_agg(error || '=' || n, ',' ORDER BY error || '=' || n), '') FROM (SELECT error, count(*) AS n FROM f WHERE error IS NOT NULL GROUP BY 1)) FROM f""",
)
def adapter_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two outside solvers over all tasks; one of them fails on small ones, in three ways."""
    base = shared.written(order_tasks(spark, sf))
    rows = None
    for name, solver in (("mirror", _mirror), ("fragile", _fragile)):
        returned = shared.written(adapters.run_solver(base, solver))
        report = adapters.solver_report(base, returned).select(F.lit(name).alias("solver"), "tasks", "exact", "attempts", "errors")
        rows = report if rows is None else rows.union(report)
    return rows
