"""The registered queries of the library and their DuckDB SQL.

Each query runs an operator of the library over a projection of the test tables;
where SQL can say the same, it stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grids, validation
from ..operators import baseline, cluster, digests, evidence, ledgers, manifests, overlap, resources, runs, scoring, shared, splits, stats, variants
from ..sources import inventory
from . import development
from .projections import GRID_SQL, PATTERN_SQL, flat_cells, order_grids, order_tasks, pattern_tasks, table
from .registry import QUERIES, SQL, Query, query  # noqa: F401  the driver's contract reads them here
from .registry import long as _long
from .task_sql import CANDIDATE_SQL, SCORE_SQL, TASK_SQL


# ---- scoring


def _order_answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    answers = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.pmod(F.floor("o_totalprice"), F.lit(10)).alias("expected"))
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return answers, line.select("o_orderkey", place.alias("attempt_no"), F.pmod(F.floor("l_quantity"), F.lit(10)).alias("value"))


def _order_scores(spark: SparkSession, sf: str) -> DataFrame:
    answers, attempts = _order_answers(spark, sf)
    scored = scoring.best_of_k(answers, attempts, 2, F.col("value") == F.col("expected"), F.lit(10) - F.abs(F.col("value") - F.col("expected")), ["o_orderkey"])
    return scored.join(answers.select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("cells", F.lit(10))


ORDER_SCORES = """a AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) % 10 AS expected FROM orders),
t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, CAST(floor(l_quantity) AS BIGINT) % 10 AS v FROM lineitem),
s AS (SELECT a.o_orderkey, a.o_custkey, coalesce(bool_or(v = expected), false) AS exact, coalesce(max(10 - abs(v - expected)), 0) AS matches
      FROM a LEFT JOIN t ON t.l_orderkey = a.o_orderkey AND t.n <= 2 GROUP BY 1, 2)"""


@query(
    "score_topk",
    f"""WITH {ORDER_SCORES}
    SELECT count(*) AS outputs_total, count(*) FILTER (WHERE exact) AS outputs_exact, CAST(count(*) FILTER (WHERE exact) AS DOUBLE) / count(*) AS output_exact_accuracy,
           CAST(sum(matches) AS BIGINT) AS cells_correct, count(*) * 10 AS cells_total FROM s""",
)
def score_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _order_scores(spark, sf)
    out = rows.agg(F.count("*").alias("outputs_total"), F.count_if("exact").alias("outputs_exact"), F.sum("matches").alias("cells_correct"), F.sum("cells").cast("long").alias("cells_total"))
    return out.withColumn("output_exact_accuracy", scoring.ratio(F.col("outputs_exact"), F.col("outputs_total")))


@query(
    "score_task_strict",
    f"""WITH {ORDER_SCORES}
    SELECT o_custkey, bool_and(exact) AS exact, count(*) AS outputs, count(*) FILTER (WHERE exact) AS outputs_exact, CAST(sum(matches) AS BIGINT) AS matches FROM s GROUP BY 1""",
)
def score_task_strict(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.task_scores(_order_scores(spark, sf), "o_custkey").drop("cells")


@query("unknown_predictions", "SELECT DISTINCT doc_id AS task_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id IS NOT NULL")
def unknown_predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("task_id"))
    return scoring.unknown_predictions(table(spark, sf, "labels").select(F.col("doc_id").alias("task_id")), docs)


@query(
    "candidate_topk",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM c)
    SELECT user_id, event_type, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 2""",
)
def candidate_topk(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ranked = baseline.first_k_distinct(counts, ["user_id"], F.col("event_type"), F.struct(-F.col("n"), "event_type"), 2)
    return _long(ranked.select("user_id", "event_type", "rank"), "rank")


@query("baseline_predictions", f"WITH {CANDIDATE_SQL}, n AS (SELECT *, unnest(range(1, len(best) + 1)) AS k FROM cd) SELECT CAST(t AS VARCHAR) AS task_id, 0 AS output_index, CAST(k AS INTEGER) AS rank, best[k].s AS solver, CAST(to_json(best[k].g) AS VARCHAR) AS grid FROM n")
def baseline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    ranked = baseline.rank_candidates(order_tasks(spark, sf), 2)
    return ranked.select("task_id", "output_index", "rank", "solver", F.to_json("grid").alias("grid"))


METRICS_SQL = f"""{SCORE_SQL}, m AS (SELECT count(*) AS n, count(*) FILTER (WHERE exact) AS hits, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(matches) AS BIGINT) AS matches FROM so)"""


@query(
    "baseline_score",
    f"""WITH {METRICS_SQL} SELECT 2 AS top_k, n AS tasks_total, n AS tasks_predicted, hits AS tasks_exact, CAST(hits AS DOUBLE) / n AS task_exact_accuracy, n AS outputs_total, hits AS outputs_exact,
    CAST(hits AS DOUBLE) / n AS output_exact_accuracy, cells AS cells_total, matches AS cells_correct, CAST(matches AS DOUBLE) / cells AS cell_accuracy FROM m""",
)
def baseline_score(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.run(shared.written(order_tasks(spark, sf)), 2)[2]  # the tasks are read for candidates and for answers


@query("baseline_solver_counts", f"WITH {CANDIDATE_SQL} SELECT solver, count(*) AS attempts FROM (SELECT unnest(list_transform(best, lambda e: e.s)) AS solver FROM cd) GROUP BY 1")
def baseline_solver_counts(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.solver_counts(baseline.rank_candidates(order_tasks(spark, sf), 2))


@query("reference_score", f"WITH {METRICS_SQL} SELECT n AS tasks_total, n AS tasks_predicted, hits AS tasks_exact, n AS outputs_total, hits AS outputs_exact FROM m")
def reference_score(spark: SparkSession, sf: str) -> DataFrame:
    tasks = order_tasks(spark, sf)
    return scoring.reference_score(tasks, baseline.predictions(baseline.rank_candidates(tasks, 2)), 2)


@query("score_cross_check", "SELECT CAST(0 AS BIGINT) AS tasks_total, CAST(0 AS BIGINT) AS tasks_predicted, CAST(0 AS BIGINT) AS tasks_exact, CAST(0 AS BIGINT) AS outputs_total, CAST(0 AS BIGINT) AS outputs_exact")
def score_cross_check(spark: SparkSession, sf: str) -> DataFrame:
    """Both scorers over the same predictions: one row of differences, all zero."""
    tasks = shared.written(order_tasks(spark, sf))
    ranked = shared.written(baseline.rank_candidates(tasks, 2))
    attempts = ranked.select("task_id", "output_index", F.col("rank").alias("attempt_no"), "grid")
    a, b = scoring.score(scoring.explode_answers(tasks), attempts, 2), scoring.reference_score(tasks, baseline.predictions(ranked), 2)
    both = a.crossJoin(b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns]))  # one row each
    return both.select(*[(F.col(c) - F.col(f"r_{c}")).alias(c) for c in b.columns])


# ---- grid algebra

PLACES = {
    "identity": ("i", "j"), "rotate_90": ("j", "h - 1 - i"), "rotate_180": ("h - 1 - i", "3 - j"), "rotate_270": ("3 - j", "i"),
    "flip_horizontal": ("i", "3 - j"), "flip_vertical": ("h - 1 - i", "j"), "transpose": ("j", "i"), "anti_transpose": ("3 - j", "h - 1 - i"),
}


def _d4(name: str) -> Query:
    return lambda spark, sf: flat_cells(order_grids(spark, sf).select("k", grids.D4[name](F.col("g")).alias("g")))


for _name, (_i, _j) in PLACES.items():
    query(f"grid_d4_{_name}", f"WITH {GRID_SQL} SELECT k, {_i} AS i, {_j} AS j, cell FROM cells")(_d4(_name))

PERMUTATION = {0: 0, 1: 7, 7: 1, 2: 9, 9: 2}
_CASES = " ".join(f"WHEN {a} THEN {b}" for a, b in PERMUTATION.items())


@query("grid_color_perm", f"WITH {GRID_SQL} SELECT k, i, j, CAST(CASE cell {_CASES} ELSE cell END AS BIGINT) AS cell FROM cells")
def grid_color_perm(spark: SparkSession, sf: str) -> DataFrame:
    mapping = grids.literal_map(PERMUTATION)
    return flat_cells(order_grids(spark, sf).select("k", grids.recolor(mapping)(F.col("g")).alias("g")))


@query("grid_round_trip", f"WITH {GRID_SQL} SELECT k, t.name, CAST(to_json(list(cell ORDER BY i, j)) AS VARCHAR) AS cells FROM cells, (VALUES " + ", ".join(f"('{n}')" for n in PLACES) + ") AS t(name) GROUP BY k, t.name")
def grid_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All cells after each D4 transform with a recolouring and then both inverses: a row for each grid and transform."""
    g, trips, inverse = F.col("g"), [], {b: a for a, b in PERMUTATION.items()}
    for name, turn in grids.D4.items():
        there = grids.compose(turn, grids.recolor(PERMUTATION))
        back = grids.compose(grids.recolor(inverse), grids.D4[grids.INVERSE_D4[name]])
        trips.append(F.struct(F.lit(name).alias("name"), F.to_json(F.flatten(back(there(g)))).alias("cells")))
    return order_grids(spark, sf).select("k", F.explode(F.array(*trips)).alias("t")).select("k", "t.*")  # the grids are made once for all transforms


@query(
    "dominant_color",
    f"""WITH {GRID_SQL}, n AS (SELECT k, cell, count(*) AS n FROM cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, cell) AS r FROM n)
    SELECT k, cell AS color FROM r WHERE r = 1""",
)
def dominant_color(spark: SparkSession, sf: str) -> DataFrame:
    return order_grids(spark, sf).select("k", grids.dominant_color(F.col("g")).cast("long").alias("color"))


@query(
    "grid_cell_matches",
    f"""WITH {GRID_SQL} SELECT a.k, CAST(sum(CASE WHEN a.cell = b.cell THEN 1 ELSE 0 END) AS BIGINT) AS matches, count(*) AS cells
    FROM cells a JOIN cells b ON a.k = b.k AND a.i = b.i AND b.j = 3 - a.j GROUP BY 1""",
)
def grid_cell_matches(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("g")
    return _long(order_grids(spark, sf).select("k", grids.cell_matches(grids.flip_horizontal(g), g).alias("matches"), grids.cell_count(g).alias("cells")), "matches", "cells")


@query("grid_shape_mismatch", f"WITH {GRID_SQL} SELECT k, CAST(0 AS BIGINT) AS matches FROM cells GROUP BY k HAVING max(h) <> 4")
def grid_shape_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("g")
    return _long(order_grids(spark, sf).where(F.size("g") != 4).select("k", grids.cell_matches(grids.transpose(g), g).alias("matches")), "matches")


@query("mutation_impact", f"WITH {GRID_SQL} SELECT k, count(*) AS changed, CAST(sum((cell + 3) % 10) AS BIGINT) AS total FROM cells GROUP BY 1")
def mutation_impact(spark: SparkSession, sf: str) -> DataFrame:
    g, m = F.col("g"), grids.mutate(F.col("g"), 3)
    total = F.aggregate(F.flatten(m), F.lit(0), lambda a, x: a + x)
    return _long(order_grids(spark, sf).select("k", (grids.cell_count(g) - grids.cell_matches(m, g)).alias("changed"), total.alias("total")), "changed", "total")


@query(
    "color_multiplicities",
    f"""WITH {GRID_SQL}, n AS (SELECT k, cell, count(*) AS n FROM cells GROUP BY 1, 2)
    SELECT n.k, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS counts, least(max(h), 4) AS short_side, greatest(max(h), 4) AS long_side
    FROM n JOIN (SELECT DISTINCT k, h FROM ln) s ON n.k = s.k GROUP BY n.k""",
)
def color_multiplicities(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("g")
    counts = F.array_join(F.transform(grids.color_multiplicities(g), lambda n: n.cast("string")), ",")
    return _long(order_grids(spark, sf).select("k", counts.alias("counts"), F.least(grids.height(g), grids.width(g)).alias("short_side"), F.greatest(grids.height(g), grids.width(g)).alias("long_side")), "short_side", "long_side")


@query("example_order", f"WITH {GRID_SQL} SELECT k, (i + 1) % h AS i, j, cell FROM cells")
def example_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows reordered by a cyclic order and restored, then turned by it once."""
    order = grids.cyclic_left(F.sequence(F.lit(0), F.size("g") - 1))
    moved = order_grids(spark, sf).select("k", grids.permute(F.col("g"), order).alias("m"), order.alias("o"))
    restored = moved.select("k", grids.restore_order(F.col("m"), F.col("o")).alias("g"), "o")
    return flat_cells(restored.select("k", grids.restore_order(F.col("g"), F.col("o")).alias("g")))


@query(
    "color_map_learn",
    """WITH p AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_linestatus) AS t, min(l_linestatus) AS l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2),
    g AS (SELECT l_orderkey FROM p GROUP BY 1 HAVING max(t) = 1) SELECT l_orderkey, l_returnflag, l_linestatus, n FROM p WHERE l_orderkey IN (SELECT l_orderkey FROM g)""",
)
def color_map_learn(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.learn_functional_dependency(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linestatus")


# ---- overlap, digests, inventories


@query("overlap_exact", "SELECT d.doc_id, b.item_id FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -item_id, text FROM benchmark WHERE item_id % 2 = 1) d JOIN benchmark b ON d.text = b.text")
def overlap_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, and odd benchmark items among them under negative ids, against the benchmark."""
    items = table(spark, sf, "benchmark")
    docs = table(spark, sf, "documents").select("doc_id", "text").union(items.where("item_id % 2 = 1").select(-F.col("item_id"), "text"))
    return docs.select("doc_id", overlap.fingerprint(F.col("text")).alias("f")).join(items.select("item_id", overlap.fingerprint(F.col("text")).alias("f")), "f").select("doc_id", "item_id")


@query("content_fingerprint", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS representative FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", overlap.fingerprint(F.col("text")).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("representative")).where("n > 1")


#: How the other side's tasks differ, by customer: not at all, train examples reversed, test output changed, test input changed.
OVERLAP_SQL = f"""{TASK_SQL}, ov AS (SELECT t, t % 4 AS kind, list_reverse(train) = train AS same_reversed FROM tk),
oi AS (SELECT t, unnest(['id_overlap'] || CASE WHEN kind = 0 OR kind = 1 AND same_reversed THEN ['raw_without_name_exact'] ELSE [] END || CASE WHEN kind <= 1 THEN ['semantic_labeled_exact', 'ordered_test_io_exact', 'test_io_exact'] ELSE [] END
       || CASE WHEN kind <= 2 THEN ['challenge_semantic_exact', 'ordered_test_inputs_exact', 'test_inputs_exact'] ELSE [] END) AS variant FROM ov)"""


def _two_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers' tasks, and the same tasks with what OVERLAP_SQL says changed."""
    tasks = order_tasks(spark, sf)
    t, kind = F.col("task"), F.col("task_id").cast("long") % 4
    input_changed = F.transform(t["test"], lambda p: F.struct(grids.mutate(p["input"]).alias("input"), p["output"].alias("output")))
    mutated = grids.mutate_labels(t)
    train = F.when(kind == 1, F.reverse(t["train"])).otherwise(t["train"])
    test = F.when(kind == 2, mutated["test"]).when(kind == 3, input_changed).otherwise(t["test"])
    return tasks, tasks.select("task_id", F.struct(t["name"].alias("name"), train.alias("train"), test.alias("test")).alias("task"))


@query(
    "task_overlap_summary",
    f"""WITH {OVERLAP_SQL} SELECT (SELECT count(*) FROM tk) AS left_task_count, (SELECT count(*) FROM tk) AS right_task_count, {", ".join(f"count(*) FILTER (WHERE variant = '{v}') AS {v}_count" for v in ("id_overlap", *overlap.VARIANTS))} FROM oi""",
)
def task_overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_summary(*_two_sides(spark, sf))


@query("task_overlap_ids", f"WITH {OVERLAP_SQL} SELECT variant, CAST(t AS VARCHAR) AS task_id FROM oi")
def task_overlap_ids(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_ids(*_two_sides(spark, sf))


@query("task_overlap_digests", f"""WITH {OVERLAP_SQL} SELECT variant, count(*) AS n, sha256('[' || string_agg('"' || t || '"', ',' ORDER BY CAST(t AS VARCHAR)) || ']') AS digest FROM oi GROUP BY 1""")
def task_overlap_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each variant's sorted list of ids."""
    return overlap.overlap_digests(*_two_sides(spark, sf))


@query(
    "inventory_digest",
    """SELECT source, count(*) AS n, sha256('[' || string_agg('"' || CAST(doc_id AS VARCHAR) || ':' || sha256(text) || '"', ',' ORDER BY doc_id) || ']') AS digest FROM documents GROUP BY 1""",
)
def inventory_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each source's whole ordered list of (id, digest), streamed."""
    docs = table(spark, sf, "documents").select("source", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("t"))
    return evidence.ordered_digest(docs, ["source"], F.col("doc_id"), F.col("t"))


@query("inventory_tree_digest", """SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, sha256('[' || string_agg('{"bytes":' || strlen(html) || ',"path":"p/' || page_id || '.html","sha256":"' || sha256(html) || '"}', ',' ORDER BY 'p/' || page_id || '.html') || ']') AS digest FROM pages WHERE html IS NOT NULL""")
def inventory_tree_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as the files of a tree: its size, and the digest of its whole listing in path order."""
    pages = table(spark, sf, "pages").where("html is not null")
    listing = pages.select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))
    return inventory.tree_digest(listing)


#: Pages as files of a repository for each of seven: nested folders, and names whose order depends on the slash that ends a folder's.
TREE_SQL = """SELECT 'r' || page_id % 7 AS repository, page_id, html, CASE page_id % 5 WHEN 0 THEN 'a/b/' WHEN 1 THEN 'a/' WHEN 2 THEN 'a.d/c/e/' WHEN 3 THEN 'a-b/' ELSE '' END || 'a' || page_id || '.html' AS path FROM pages WHERE html IS NOT NULL"""


def _page_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("a/b/", "a/", "a.d/c/e/", "a-b/", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    named = F.concat(folder, F.lit("a"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf, "pages").where("html is not null").select(F.concat(F.lit("r"), (F.col("page_id") % 7).cast("string")).alias("repository"), named.alias("path"), F.encode("html", "UTF-8").alias("content"))


def _level(depth: int, source: str) -> str:
    """Folders of a depth, as entries of the folders above them."""
    return f"""l{depth} AS (SELECT repository, regexp_extract(folder, '^(?:(.*)/)?[^/]+$', 1) AS folder, regexp_extract(folder, '([^/]+)$', 1) || '/' AS key, hex(encode('40000 ' || regexp_extract(folder, '([^/]+)$', 1))) || '00' || sha1(unhex(hex(encode('tree ' || CAST(sum(len(line)) // 2 AS BIGINT))) || '00' || string_agg(line, '' ORDER BY encode(key)))) AS line
    FROM ({source}) WHERE folder <> '' AND len(folder) - len(replace(folder, '/', '')) = {depth - 1} GROUP BY repository, folder)"""


@query(
    "tree_oids",
    f"""WITH p AS ({TREE_SQL}), f AS (SELECT repository, regexp_extract(path, '^(?:(.*)/)?[^/]+$', 1) AS folder, regexp_extract(path, '([^/]+)$', 1) AS key,
      hex(encode('100644 ' || regexp_extract(path, '([^/]+)$', 1))) || '00' || sha1('blob ' || strlen(html) || chr(0) || html) AS line FROM p),
    {_level(3, "SELECT * FROM f")}, {_level(2, "SELECT * FROM f UNION ALL SELECT * FROM l3")}, {_level(1, "SELECT * FROM f UNION ALL SELECT * FROM l2")}
    SELECT repository, sha1(unhex(hex(encode('tree ' || CAST(sum(len(line)) // 2 AS BIGINT))) || '00' || string_agg(line, '' ORDER BY encode(key)))) AS oid
    FROM (SELECT * FROM f UNION ALL SELECT * FROM l1) WHERE folder = '' GROUP BY 1""",
)
def tree_oids(spark: SparkSession, sf: str) -> DataFrame:
    """git's object id of each repository's root tree, folded up from its deepest folders."""
    files = _page_files(spark, sf).select("repository", "path", F.lit("100644").alias("mode"), inventory.blob_oid("content").alias("oid"))
    return digests.tree_oids(files)


@query(
    "prefixed_digests",
    f"""WITH p AS ({TREE_SQL}) SELECT repository, count(*) AS n, sha256(unhex(string_agg(lpad(to_hex(strlen(path)), 16, '0') || hex(encode(path)) || lpad(to_hex(strlen(html)), 16, '0') || hex(encode(html)), '' ORDER BY string_split(path, '/')))) AS digest FROM p GROUP BY 1""",
)
def prefixed_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each repository's paths and contents, each with its length before it."""
    return digests.length_prefixed(_page_files(spark, sf), ["repository"])


# ---- clusters, splits, selection


@query(
    "cluster_blocks",
    """SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""",
)
def cluster_blocks(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.struct("p_brand", "p_type", "p_size").alias("signature"))
    return cluster.blocked_pairs(parts, "signature")


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "source", F.sha2("text", 256).alias("content"))
    return cluster.exact_groups(docs, "content").withColumnRenamed("representative", "cluster_id").join(docs.select("record_id", "source", "content"), "record_id")


@query("components_min_label", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY sha256(text)) AS label FROM documents")
def components_min_label(spark: SparkSession, sf: str) -> DataFrame:
    groups = _clusters(spark, sf)
    edges = groups.where("record_id <> cluster_id").select(F.col("record_id").alias("u"), F.col("cluster_id").alias("v"))
    return cluster.min_label_components(groups.select(F.col("record_id").alias("node")), edges)


@query(
    "components_of_paths",
    """WITH b AS (SELECT o_orderkey AS node, o_custkey % 50 <> 0 AND o_orderkey % 40 <> 0 AS joined FROM orders) SELECT node, max(CASE WHEN NOT joined THEN node END) OVER (ORDER BY node) AS label FROM b""",
)
def components_of_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nodes, each linked to the one before it unless its customer or number begins a new path."""
    o = table(spark, sf, "orders")
    linked = o.where("o_custkey % 50 <> 0 and o_orderkey % 40 <> 0").select(F.col("o_orderkey").alias("u"), (F.col("o_orderkey") - 1).alias("v"))
    return cluster.min_label_components(o.select(F.col("o_orderkey").alias("node")), linked)


STATES = 200  # the bound of both queries: part tasks with seven plain demonstrations have 258 states


@query(
    "isomorphism_clusters",
    f"""WITH {TASK_SQL}, {PATTERN_SQL},
    k AS (SELECT 'part:' || part AS record_id, m, u, CASE WHEN 2 * (2 ** u + 2 ** (m - u)) > {STATES} THEN 100 * a + 10 * b + c END AS own FROM pa)
    SELECT side || ':' || t AS record_id, 'base:' || t AS cluster_id FROM tk, (VALUES ('base'), ('copy')) AS v(side)
    UNION ALL SELECT record_id, min(record_id) OVER (PARTITION BY m, u, own) FROM k""",
)
def isomorphism_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks and their turned, recoloured copies, each pair one cluster; and the parts' tasks.

    The parts' tasks have like signatures, differ in how many demonstrations are
    mirrored, and are beyond the bound of states where seven are alike: those stay
    apart but for equal content.
    """
    tasks = shared.written(order_tasks(spark, sf))
    turned = tasks.select(F.concat(F.lit("copy:"), "task_id").alias("record_id"), grids.transform_task(F.col("task"), grids.compose(grids.rotate_90, grids.recolor(grids.literal_map(PERMUTATION)))).alias("task"))
    patterns = pattern_tasks(spark, sf).select(F.concat(F.lit("part:"), F.col("part").cast("string")).alias("record_id"), "task")
    records = tasks.select(F.concat(F.lit("base:"), "task_id").alias("record_id"), "task").union(turned).union(patterns)
    clusters, _ = cluster.cluster_tasks(records, STATES)
    return clusters


def _states_sql() -> str:
    """States of one transform for u of m mirrored demonstrations against w of m, those with fewer partners joined first."""
    f = lambda n: f"factorial(CAST({n} AS INTEGER))"
    choose = lambda n, k: f"({f(n)} // ({f(k)} * {f(f'{n} - {k}')}))"
    upto = lambda n, c: f"coalesce(list_sum(list_transform(range(1, least({n}, {c}) + 1), lambda l: {choose(c, 'l')})), 0)"
    both = lambda n1, c1, n2, c2: f"2 + {upto(n1, c1)} + CASE WHEN {n1} <= {c1} THEN {choose(c1, f'least({n1}, {c1})')} * {upto(n2, c2)} ELSE 0 END"
    return f"""CASE WHEN (u > 0 AND w = 0) OR (u < m AND w = m) THEN 0 WHEN u = 0 THEN 2 + {upto("m", "(m - w)")} WHEN u = m THEN 2 + {upto("m", "w")}
        WHEN w < m - w THEN {both("u", "w", "(m - u)", "(m - w)")} ELSE {both("(m - u)", "(m - w)", "u", "w")} END"""


@query(
    "isomorphism_search",
    f"""WITH {PATTERN_SQL}, p AS (SELECT l.part AS left_id, r.part AS right_id, l.m, l.u, r.u AS w FROM pa l JOIN pa r ON r.part = l.part + 4),
    e AS (SELECT left_id, right_id, u = w AS same, CAST(2 * ({_states_sql()}) AS BIGINT) AS states FROM p)
    SELECT left_id, right_id, CASE WHEN states > {STATES} THEN 'inconclusive' WHEN same THEN 'matched' ELSE 'not-isomorphic' END AS status, least(states, {STATES}) AS explored FROM e""",
)
def isomorphism_search(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's task against that of four parts on: what the search finds, and the exact number of its states."""
    tasks = shared.written(pattern_tasks(spark, sf).select(F.col("part").alias("record_id"), "task"))
    pairs = tasks.select(F.col("record_id").alias("left_id"), (F.col("record_id") + 4).alias("right_id"))
    return _long(cluster.verify_pairs(pairs, tasks, STATES), "explored").select("left_id", "right_id", "status", "explored")


@query("cluster_descriptor", "SELECT sha256(text) AS content, min(doc_id) AS representative, count(*) AS members, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def cluster_descriptor(spark: SparkSession, sf: str) -> DataFrame:
    rows = _clusters(spark, sf)
    out = cluster.describe_clusters(rows.select("record_id", "cluster_id"), rows.select("record_id", "source", "content"))
    names = rows.where("record_id = cluster_id").select("cluster_id", "content")
    return out.join(names, "cluster_id").select("content", "representative", "members", F.size("source_counts").cast("long").alias("sources"))


WEIGHTS = [("train", 70), ("validation", 15), ("audit", 15)]
SPLIT_SQL = """cl AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY sha256(text)) AS cluster_id FROM documents),
rk AS (SELECT cluster_id, row_number() OVER (ORDER BY sha256('20260806' || chr(0) || CAST(cluster_id AS VARCHAR)), cluster_id) AS rank, count(*) OVER () AS total FROM cl),
w(position, split, weight) AS (VALUES (0, 'train', 70), (1, 'validation', 15), (2, 'audit', 15)),
q0 AS (SELECT position, split, total * weight // 100 AS base, total * weight % 100 AS rest, total FROM w, (SELECT count(*) AS total FROM cl)),
q1 AS (SELECT *, total - sum(base) OVER () AS spare, row_number() OVER (ORDER BY rest DESC, split) AS place FROM q0),
q2 AS (SELECT position, split, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS quota FROM q1),
q AS (SELECT split, quota, sum(quota) OVER (ORDER BY position) AS high FROM q2),
sp AS (SELECT rk.cluster_id, CAST(rk.rank AS BIGINT) AS rank, q.split FROM rk JOIN q ON rk.rank > q.high - q.quota AND rk.rank <= q.high)"""


def _assigned(spark: SparkSession, sf: str, clusters: DataFrame | None = None) -> DataFrame:
    clusters = _clusters(spark, sf) if clusters is None else clusters
    items = clusters.select("cluster_id").distinct()
    return splits.assign_splits(items, "cluster_id", "20260806", WEIGHTS).select("cluster_id", "rank", "split")


@query("split_quota_70_15_15", f"WITH {SPLIT_SQL} SELECT cluster_id, rank, split FROM sp")
def split_quota(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf)


RECORD_SQL = f"""{SPLIT_SQL}, rc AS (SELECT d.doc_id AS record_id, d.source, min(d.doc_id) OVER (PARTITION BY sha256(d.text)) AS cluster_id FROM documents d),
ra AS (SELECT rc.*, sp.split FROM rc JOIN sp ON rc.cluster_id = sp.cluster_id), fl AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"""


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    clusters = shared.written(_clusters(spark, sf))  # the texts are hashed and joined once
    rows = shared.written(clusters.join(_assigned(spark, sf, clusters), "cluster_id"))
    return rows, table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("record_id"))


@query("split_manifest", f"WITH {RECORD_SQL} SELECT split, source, count(*) AS records, count(DISTINCT cluster_id) AS clusters FROM ra GROUP BY 1, 2")
def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_manifest(_records(spark, sf)[0])


@query("split_crossing", f"WITH {RECORD_SQL} SELECT cluster_id, count(DISTINCT source) AS splits FROM ra GROUP BY 1 HAVING count(DISTINCT source) > 1")
def split_crossing(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters whose records would be in several splits if the sources were the splits."""
    return splits.crossing(_records(spark, sf)[0].select("cluster_id", F.col("source").alias("split")))


@query(
    "contamination_by_split",
    f"""WITH {RECORD_SQL}, c AS (SELECT split, cluster_id, bool_or(record_id IN (SELECT doc_id FROM fl)) AS flag, count(*) AS n FROM ra GROUP BY 1, 2)
    SELECT split, count(*) AS clusters, count(*) FILTER (WHERE flag) AS flagged_clusters, CAST(sum(n) AS BIGINT) AS records, CAST(coalesce(sum(n) FILTER (WHERE flag), 0) AS BIGINT) AS flagged_records FROM c GROUP BY 1""",
)
def contamination_by_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.contamination(*_records(spark, sf))


@query(
    "clean_view",
    f"""WITH {RECORD_SQL}, bad AS (SELECT DISTINCT cluster_id FROM ra WHERE record_id IN (SELECT doc_id FROM fl)), kept AS (SELECT * FROM ra WHERE cluster_id NOT IN (SELECT cluster_id FROM bad))
    SELECT split, count(*) AS records, count(DISTINCT cluster_id) AS clusters, count(*) FILTER (WHERE record_id <> cluster_id) AS edges FROM kept GROUP BY 1""",
)
def clean_view(spark: SparkSession, sf: str) -> DataFrame:
    rows, flagged = _records(spark, sf)
    edges = rows.where("record_id <> cluster_id").select(F.col("cluster_id").alias("left_id"), F.col("record_id").alias("right_id"))
    kept, ends = splits.clean_view(rows, edges, flagged)
    per = kept.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("cluster_id").alias("clusters"))
    own = ends.join(kept.select(F.col("record_id").alias("right_id"), "split"), "right_id").groupBy("split").agg(F.count("*").alias("edges"))
    return per.join(own, "split", "left").select("split", "records", "clusters", F.coalesce("edges", F.lit(0)).alias("edges"))


STRATUM_SQL = """it AS (SELECT doc_id, lang || '|' || CASE WHEN n_chars <= 1000 THEN 'short' WHEN n_chars <= 4000 THEN 'middle' ELSE 'long' END AS stratum FROM documents),
pop AS (SELECT stratum, count(*) AS population FROM it GROUP BY 1), tot AS (SELECT count(*) AS n FROM it),
b AS (SELECT stratum, population, 32 * population // n AS base, 32 * population % n AS rest FROM pop, tot),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, sha256('gridloom' || chr(0) || '7' || chr(0) || 'quota' || chr(0) || 'documents' || chr(0) || stratum), stratum) AS place, 32 - sum(base) OVER () AS spare FROM b),
qu AS (SELECT stratum, population, CAST(base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r)"""


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("n_chars") <= 1000, "short").when(F.col("n_chars") <= 4000, "middle").otherwise("long")
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("|", "lang", size).alias("stratum"))


@query(
    "stratified_quota",
    f"""WITH {STRATUM_SQL}, k AS (SELECT it.doc_id, it.stratum, sha256('gridloom' || chr(0) || '7' || chr(0) || 'rank' || chr(0) || 'documents' || chr(0) || CAST(it.doc_id AS VARCHAR)) AS rank_sha256 FROM it),
    z AS (SELECT k.*, qu.quota, row_number() OVER (PARTITION BY k.stratum ORDER BY rank_sha256, doc_id) AS stratum_rank FROM k JOIN qu ON k.stratum = qu.stratum)
    SELECT doc_id, stratum, quota, CAST(stratum_rank AS BIGINT) AS stratum_rank, rank_sha256 FROM z WHERE stratum_rank <= quota""",
)
def stratified_quota(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.stratified_quota(_strata(spark, sf), "doc_id", "stratum", 32, "gridloom", 7, "documents").where("selected")
    return _long(rows.select("doc_id", "stratum", "quota", "stratum_rank", "rank_sha256"), "quota", "stratum_rank")


@query("stratum_quotas", f"WITH {STRATUM_SQL} SELECT stratum, population, quota FROM qu")
def stratum_quotas(spark: SparkSession, sf: str) -> DataFrame:
    strata = _strata(spark, sf).groupBy("stratum").agg(F.count("*").alias("population"))
    tie = [splits.domain_hash("gridloom", 7, "quota", "documents", F.col("stratum")), F.col("stratum")]
    return splits.largest_remainder(strata, F.lit(32).cast("long"), "population", tie)


@query(
    "task_order",
    """WITH s(seed) AS (VALUES (11), (22), (33))
    SELECT 'bench' AS benchmark, CAST(seed AS BIGINT) AS seed, item_id,
           CAST(row_number() OVER (PARTITION BY seed ORDER BY sha256('order' || chr(0) || 'bench' || chr(0) || CAST(seed AS VARCHAR) || chr(0) || CAST(item_id AS VARCHAR)), item_id) AS BIGINT) AS place FROM benchmark, s""",
)
def task_order(spark: SparkSession, sf: str) -> DataFrame:
    return _long(splits.task_orders(table(spark, sf, "benchmark"), "item_id", F.lit("bench"), "order", [11, 22, 33]), "seed", "place")


@query(
    "latin_rows",
    """SELECT item_id, CAST((row_number() OVER (ORDER BY item_id) - 1) % 4 AS BIGINT) AS latin_row, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS idx FROM benchmark""",
)
def latin_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Index and Latin row of each benchmark item."""
    return _long(splits.latin_rows(table(spark, sf, "benchmark").select("item_id"), "item_id"), "idx", "latin_row")



FEATURE_SQL = """f AS (SELECT doc_id, lang, CASE WHEN n_chars <= 100 THEN '1-100' WHEN n_chars <= 400 THEN '101-400' ELSE '401-900' END AS size_bin, CASE WHEN doc_id % 7 <= 4 THEN CAST(doc_id % 7 AS VARCHAR) ELSE '5+' END AS demo_bin,
CASE WHEN doc_id % 2 = 1 THEN '1' ELSE '2+' END AS test_bin, CASE WHEN doc_id % 11 <= 3 THEN '1-3' WHEN doc_id % 11 <= 6 THEN '4-6' ELSE '7-10' END AS color_bin, CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END AS change FROM documents)"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", splits.demo_bin(d % 7).alias("demo_bin"), splits.test_bin(F.when(d % 2 == 1, 1).otherwise(2)).alias("test_bin"), splits.area_bin(F.col("n_chars")).alias("size_bin"),
        splits.color_bin(d % 11).alias("color_bin"), F.initcap((d % 3 == 0).cast("string")).alias("change"),
    )


@query(
    "feature_distribution",
    f"""WITH {FEATURE_SQL}, u AS (SELECT 'demo_bin' AS feature, demo_bin AS value FROM f UNION ALL SELECT 'test_bin', test_bin FROM f UNION ALL SELECT 'size_bin', size_bin FROM f UNION ALL SELECT 'color_bin', color_bin FROM f UNION ALL SELECT 'change', change FROM f)
    SELECT feature, value, count(*) AS n FROM u GROUP BY 1, 2""",
)
def feature_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return splits.feature_distribution(_features(spark, sf), ["demo_bin", "test_bin", "size_bin", "color_bin", "change"])


@query("stratum_keys", f"WITH {FEATURE_SQL} SELECT demo_bin || '|' || test_bin || '|' || size_bin || '|' || color_bin || '|' || change AS stratum_key, count(*) AS n FROM f GROUP BY 1")
def stratum_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    key = splits.stratum_key(d % 7, F.when(d % 2 == 1, 1).otherwise(2), F.col("n_chars"), d % 11, d % 3 == 0)
    return table(spark, sf, "documents").groupBy(key.alias("stratum_key")).agg(F.count("*").alias("n"))


@query(
    "task_features",
    f"""WITH {TASK_SQL}, f AS (SELECT t, train, list_concat(list_transform(train, lambda p: p.i), [x]) AS gs FROM tk)
    SELECT CAST(t AS VARCHAR) AS task_id, CAST(len(train) AS INTEGER) AS demonstration_count, 1 AS test_input_count, CAST(list_max(list_transform(gs, lambda g: len(g) * len(g[1]))) AS INTEGER) AS max_input_area,
    CAST(len(list_distinct(flatten(flatten(gs)))) AS INTEGER) AS input_color_count, list_bool_or(list_transform(train, lambda p: len(p.i) <> len(p.o) OR len(p.i[1]) <> len(p.o[1]))) AS demonstration_shape_change FROM f""",
)
def task_features(spark: SparkSession, sf: str) -> DataFrame:
    return order_tasks(spark, sf).select("task_id", *[c.alias(n) for n, c in splits.features(F.col("task")).items() if n != "input_colors"])


# ---- audits (J11, A19-A27, W06, X*)

RULES = [
    {"glob": "https://*.example.org/*", "tier": "organisation", "reason": "host"},
    {"glob": "*page=[0-9]*", "tier": "paged", "reason": "query"},
    {"glob": "http://*", "tier": "plain", "reason": "scheme"},
    {"glob": "*", "tier": "other", "reason": "default"},
]


@query(
    "rule_classify",
    """SELECT CASE WHEN regexp_matches(url, '^https://.*\\.example\\.org/.*$') THEN 'organisation' WHEN regexp_matches(url, '^.*page=[0-9].*$') THEN 'paged' WHEN regexp_matches(url, '^http://.*$') THEN 'plain' ELSE 'other' END AS tier, count(*) AS n FROM pages GROUP BY 1""",
)
def rule_classify(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.histogram(table(spark, sf, "pages").select(evidence.first_rule(F.col("url"), RULES, "tier").alias("tier")), "tier")


TYPES = ["click", "purchase", "refund", "signup", "view", "never-seen"]


@query(
    "zero_filled_counts",
    "WITH v(event_type) AS (VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ") SELECT v.event_type, count(e.event_id) AS n FROM v LEFT JOIN events e ON e.event_type = v.event_type GROUP BY 1",
)
def zero_filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.zero_filled(table(spark, sf, "events"), "event_type", TYPES)


@query(
    "latest_attempt",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return evidence.latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(
    "set_reconcile",
    """WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels)
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'extra' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'both' END AS state FROM d FULL JOIN l ON d.doc_id = l.doc_id""",
)
def set_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.reconcile(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "set_operations",
    """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT item_id FROM benchmark)
    UNION ALL SELECT 'union_all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT item_id FROM benchmark)""",
)
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    d, lb = (table(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    out = None
    for name, rows in (("intersect", d.intersect(lb)), ("except", d.subtract(lb)), ("union", d.unionByName(b).distinct()), ("union_all", d.unionByName(b))):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query(
    "macro_micro_accuracy",
    """WITH s AS (SELECT d.source, avg(CAST(l.quality AS DOUBLE)) AS acc, count(*) AS n, sum(l.quality) AS good FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1)
    SELECT round(avg(acc), 9) AS macro, round(CAST(sum(good) AS DOUBLE) / sum(n), 9) AS micro, count(*) AS sources FROM s""",
)
def macro_micro_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    out = evidence.macro_micro(rows, "source", "quality")
    return out.select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), F.col("groups").alias("sources"))


@query(
    "cost_audit",
    """SELECT event_type, round(sum(coalesce(value, 0)), 4) AS total, count(*) FILTER (WHERE value > 0) AS positive, count(*) AS n, round(avg(value), 6) AS mean, CAST(max(event_id % 50 + 1) AS DOUBLE) AS stored_mean, count(DISTINCT (user_id, event_type, event_id % 3)) AS keys,
    round(sum(coalesce(value, 0)) / CAST(max(event_id % 50 + 1) AS DOUBLE), 4) AS divisor FROM events GROUP BY 1""",
)
def cost_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumns({"stored": (F.pmod("event_id", F.lit(50)) + 1).cast("double"), "third": F.pmod("event_id", F.lit(3))})
    out = evidence.cost_audit(rows, ["event_type"], "value", "stored", ["user_id", "event_type", "third"])
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "divisor": F.round("divisor", 4)})


@query(
    "funnel_summary",
    """SELECT count(*) AS discovered, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS terminal, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed,
    count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS admitted FROM orders""",
)
def funnel_summary(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return evidence.funnel(table(spark, sf, "orders"), {"discovered": F.lit(True), "terminal": s.isin("F", "O"), "passed": s == "F", "admitted": (s == "F") & (p > 100000)})


@query(
    "roster_agreement",
    """WITH u AS (SELECT DISTINCT c_nationkey AS key, 0 AS pos FROM customer UNION SELECT DISTINCT s_nationkey, 1 FROM supplier UNION SELECT r_regionkey, 2 FROM region)
    SELECT key, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS present FROM u GROUP BY 1 HAVING count(*) < 3""",
)
def roster_agreement(spark: SparkSession, sf: str) -> DataFrame:
    tables = [table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key")), table(spark, sf, "region").select(F.col("r_regionkey").alias("key"))]
    return evidence.roster_agreement(tables, "key").select("key", F.array_join(F.transform("present", lambda x: x.cast("string")), ",").alias("present"))


@query(
    "rollup_inventory",
    """SELECT r_name, n_name, count(*) AS customers, CAST(sum(length(c_name)) AS BIGINT) AS bytes FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def rollup_inventory(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.length("c_name")).alias("bytes"))


@query("split_counts", "SELECT coalesce(lang, 'total') AS split, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.totals(table(spark, sf, "documents").select(F.col("lang").alias("split")), "split")



SOURCES = [f"src{k}" for k in range(20)]


@query(
    "source_pivot",
    "SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE source = '{x}') AS {x}" for x in SOURCES) + ", count(*) FILTER (WHERE source IS NULL OR source NOT IN (" + ", ".join(f"'{x}'" for x in SOURCES) + ")) AS other FROM documents GROUP BY 1",
)
def source_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language and source; sources beyond the declared ones are counted together."""
    declared = F.when(F.col("source").isin(SOURCES), F.col("source")).otherwise("other")
    docs = table(spark, sf, "documents").select("lang", declared.alias("declared"))
    return docs.groupBy("lang").pivot("declared", [*SOURCES, "other"]).agg(F.count(F.lit(1))).na.fill(0)


# ---- validation


@query(
    "schema_errors",
    """SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT coalesce(role IN ('user', 'assistant', 'system'), false) THEN 'role' END, CASE WHEN NOT coalesce(length(trim(text)) > 0, false) THEN 'text' END, CASE WHEN NOT coalesce(turn >= 0, false) THEN 'turn' END) AS errors
    FROM conversations""",
)
def schema_errors(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"role": F.col("role").isin("user", "assistant", "system"), "text": F.length(F.trim("text")) > 0, "turn": F.col("turn") >= 0}
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(validation.codes(checks), ",").alias("errors"))


@query(
    "attempt_contiguity",
    """WITH c AS (SELECT conv_id, turn % 3 <> 2 OR conv_id % 2 = 0 AS there, turn FROM conversations), n AS (SELECT conv_id, count(DISTINCT turn) FILTER (WHERE there) AS n, max(turn) FILTER (WHERE there) AS top FROM c GROUP BY 1)
    SELECT conv_id, CASE WHEN n = 0 THEN 'no_attempt,attempt_gap' WHEN top + 1 <> n THEN 'attempt_gap' ELSE '' END AS errors FROM n""",
)
def attempt_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as the attempts at one output; every other conversation lacks each third."""
    there = F.expr("turn % 3 <> 2 or conv_id % 2 = 0")
    names = F.collect_set(F.when(there, F.concat(F.lit("attempt_"), (F.col("turn") + 1).cast("string"))))
    made = table(spark, sf, "conversations").groupBy("conv_id").agg(names.alias("names"))
    attempts = F.map_from_entries(F.transform("names", lambda n: F.struct(n, grids.grid_from_cells([[1]]))))
    return made.select("conv_id", F.array_join(validation.attempt_errors(F.array(attempts)), ",").alias("errors"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


#: Some documents with an access key of the documented form put in.
_PLANTED = "CASE WHEN doc_id % 9 = 4 THEN concat(text, ' key AKIA', 'ABCDEFGH', 'IJKLMNOP') ELSE text END"


@query("secret_scan", f"SELECT doc_id FROM (SELECT doc_id, {_PLANTED} AS text FROM documents) WHERE " + " OR ".join(f"regexp_matches(text, '{_re2(p)}')" for p in validation.SECRET_VALUES))
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(_PLANTED).alias("text")).where(validation.looks_secret(F.col("text"))).select("doc_id")


@query(
    "path_safety",
    """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages)
    SELECT page_id, CASE WHEN path IS NULL OR path = '' THEN 'empty' WHEN contains(path, '\\') THEN 'separator' WHEN starts_with(path, '/') THEN 'absolute' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive' WHEN path = '.' THEN 'root'
    WHEN regexp_matches('/' || path || '/', '/(\\.|\\.\\.|)/') THEN 'component' END AS error FROM p""",
)
def path_safety(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", r"^https?://[^/]*/", "")
    return table(spark, sf, "pages").select("page_id", validation.repo_path_error(path).alias("error"))


@query(
    "metric_consistency",
    """WITH m AS (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS num, floor(l_quantity / 8) AS den, CASE WHEN l_partkey % 3 = 0 THEN round(l_linenumber / floor(l_quantity / 8), 3) ELSE l_linenumber / floor(l_quantity / 8) END AS v FROM lineitem)
    SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE NOT num <= den) AS over_denominator, count(*) FILTER (WHERE NOT coalesce(den <> 0 AND abs(v - num / den) <= greatest(1e-12 * greatest(abs(v), abs(num / den)), 1e-12), false)) AS unlike FROM m GROUP BY 1""",
)
def metric_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers over a part of the quantity as metrics; some values are rounded, some denominators zero."""
    num, den = F.col("l_linenumber").cast("double"), F.floor(F.col("l_quantity") / 8).cast("double")
    value = F.when(F.col("l_partkey") % 3 == 0, F.round(F.try_divide(num, den), 3)).otherwise(F.try_divide(num, den))
    rows = table(spark, sf, "lineitem").select("l_orderkey", validation.metric_errors(F.struct(num.alias("numerator"), den.alias("denominator"), value.alias("value"))).alias("e"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.array_contains("e", "numerator")).alias("over_denominator"), F.count_if(F.array_contains("e", "value")).alias("unlike"))


# ---- statistics (T01-T08) and resources


@query(
    "holm_adjust",
    """WITH p AS (SELECT event_type, 1.0 / (1 + count(*) % 37) AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS rank, count(*) OVER () AS m FROM p)
    SELECT event_type, round(CAST(p AS DOUBLE), 9) AS p, round(CAST(max(least(1.0, (m - rank + 1) * p)) OVER (ORDER BY p, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 9) AS adjusted FROM r""",
)
def holm_adjust(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("event_type").agg((F.lit(1.0) / (1 + F.pmod(F.count("*"), F.lit(37)))).alias("p"))
    return stats.holm(rows, "p", "event_type").select("event_type", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


@query(
    "paired_discordance",
    """SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS both, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS first_only, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS second_only, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS neither FROM labels""",
)
def paired_discordance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").agg(*stats.discordance(F.col("quality"), 1 - F.col("toxic")))


@query(
    "paired_exact_p",
    """WITH t AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    k AS (SELECT lang, a, b, a + b AS d, unnest(range(least(a, b) + 1)) AS i FROM t)
    SELECT lang, a AS first_only, b AS second_only, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2)))) END, 7) AS p_value FROM k GROUP BY lang, a, b""",
)
def paired_exact_p(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    both = rows.groupBy("lang").agg(F.count_if(F.expr("quality = 1 and toxic = 1")).alias("first_only"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("second_only"))
    return stats.paired_exact(both).withColumn("p_value", F.round("p_value", 7))


def _user_effects(spark: SparkSession, sf: str) -> DataFrame:
    """(grp, cluster, effect): a user's mean value, less the rounded constant 50; users are the clusters."""
    per = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value") - 50, 3).alias("effect"))
    return per.select(F.pmod("user_id", F.lit(5)).cast("long").alias("grp"), F.col("user_id").alias("cluster"), "effect")


@query("randomization_test")
def randomization_test(spark: SparkSession, sf: str) -> DataFrame:
    names = ("method", "clusters", "nonzero", "statistic", "p_value", "resamples")
    f = lambda d: dict(zip(names, stats.sign_flip(d["effect"].tolist(), 20260806, 10_000), strict=True))
    return stats.by_group(_user_effects(spark, sf), "grp", "method string, clusters int, nonzero int, statistic double, p_value double, resamples int", f)


@query("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    names = ("clusters", "resamples", "estimate", "lower", "upper")
    f = lambda d: dict(zip(names, stats.bootstrap_mean(d["effect"].tolist(), 20260806, 10_000), strict=True))
    return stats.by_group(_user_effects(spark, sf), "grp", "clusters int, resamples int, estimate double, lower double, upper double", f)


@query("robust_logistic")
def robust_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of labelled documents against toxicity and length, by source as cluster, for each language."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    rows = rows.select("lang", "source", "quality", F.lit(1.0).alias("one"), "toxic", F.log1p("n_chars").alias("length"))
    return _fits(spark, stats.grouped_logistic(rows, "lang", "quality", ["one", "toxic", "length"], "source"), "lang string", [1, 2])


def _fits(spark: SparkSession, reports: dict[object, dict], group: str, picked: list[int]) -> DataFrame:
    """One row for each group: status, sizes, and the joint test of the picked coefficients."""
    rows = []
    for name, r in sorted(reports.items()):
        wald = stats.wald_block(r["coefficients"], r["covariance"], picked) if r["status"] == "ok" else (None, None, None)
        rows.append((name, r["status"], r["iterations"], r["observations"], r["clusters"], wald[0], wald[2]))
    return spark.createDataFrame(rows, f"{group}, status string, iterations int, observations long, clusters long, statistic double, p_value double")


@query(
    "logistic_two_groups",
    """WITH r AS (SELECT CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS c, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS y, l_discount > 0.05 AS x FROM lineitem),
    g AS (SELECT line, count(*) AS n, count(DISTINCT c) AS k, count(*) FILTER (WHERE NOT x) AS n0, count(*) FILTER (WHERE x) AS n1, avg(y) FILTER (WHERE NOT x) AS p0, avg(y) FILTER (WHERE x) AS p1 FROM r GROUP BY 1),
    u AS (SELECT line, c, sum(CASE WHEN x THEN 0 ELSE y - p0 END) / any_value(n0 * p0 * (1 - p0)) AS u0, sum(CASE WHEN x THEN y - p1 ELSE 0 END) / any_value(n1 * p1 * (1 - p1)) AS u1 FROM r JOIN g USING (line) GROUP BY 1, 2),
    v AS (SELECT line, sum(u0 * u0) AS v00, sum(u1 * u1) AS v11, sum(u0 * u1) AS v01 FROM u GROUP BY 1),
    f AS (SELECT line, n, k, ln(p0 / (1 - p0)) AS b0, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS b1, v00 + v11 - 2 * v01 AS var1, CAST(k AS DOUBLE) / (k - 1) * (n - 1) / (n - 2) AS scale FROM g JOIN v USING (line))
    SELECT line, n AS observations, k AS clusters, round(b0, 6) AS intercept, round(b1, 6) AS effect, round(sqrt(var1 * scale), 6) AS standard_error FROM f""",
)
def logistic_two_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Large quantities against a high discount, by supplier as cluster, for each line number: a design whose fit has a closed form."""
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("line"), "l_suppkey", (F.col("l_quantity") > 25).cast("int").alias("y"), F.lit(1).alias("one"), (F.col("l_discount") > 0.05).cast("int").alias("x"))
    found = stats.grouped_logistic(rows, "line", "y", ["one", "x"], "l_suppkey")
    out = [(g, r["observations"], r["clusters"], *(round(b, 6) for b in r["coefficients"]), round(r["covariance"][3] ** 0.5, 6)) for g, r in found.items()]
    return spark.createDataFrame(out, "line long, observations long, clusters long, intercept double, effect double, standard_error double")


@query(
    "sign_flip_exact",
    """WITH e AS (SELECT event_type AS grp, user_id % 11 AS c, floor(avg(value)) - 50 AS effect FROM events GROUP BY 1, 2), v AS (SELECT grp, count(*) AS clusters, list(effect ORDER BY c) FILTER (WHERE effect <> 0) AS live FROM e GROUP BY 1),
    m AS (SELECT grp, clusters, live, unnest(range(CAST(pow(2, len(live)) AS BIGINT))) AS mask FROM v),
    s AS (SELECT grp, clusters, live, list_sum(list_transform(range(1, len(live) + 1), lambda q: CASE WHEN (mask >> (q - 1)) & 1 = 1 THEN live[q] ELSE -live[q] END)) AS total FROM m)
    SELECT grp, 'exact-enumeration' AS method, CAST(clusters AS INTEGER) AS clusters, CAST(len(live) AS INTEGER) AS nonzero, abs(list_sum(live)) AS statistic, count(*) FILTER (WHERE abs(total) >= abs(list_sum(live)) - 1e-9) / CAST(count(*) AS DOUBLE) AS p_value, CAST(count(*) AS INTEGER) AS resamples
    FROM s GROUP BY grp, clusters, live""",
)
def sign_flip_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number effects of eleven groups of users on each type of event, over all signs."""
    effects = table(spark, sf, "events").groupBy(F.col("event_type").alias("grp"), F.pmod("user_id", F.lit(11)).alias("cluster")).agg((F.floor(F.avg("value")) - 50).cast("double").alias("effect"))
    names = ("method", "clusters", "nonzero", "statistic", "p_value", "resamples")
    f = lambda d: dict(zip(names, stats.sign_flip(d["effect"].tolist(), 1, 10_000), strict=True))
    return stats.by_group(effects, "grp", "method string, clusters int, nonzero int, statistic double, p_value double, resamples int", f)


EFFECTS = [0.025, 0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25]


@query("power_grid")
def power_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Nine effects by three numbers of tasks, 2,000 simulations each."""
    return stats.minimum_effects(stats.power_grid(spark, [32, 64, 120], EFFECTS, 0.5, 0.3, 2_000, 0.05, 20260806), 0.8)


@query("minimum_effects", "SELECT l_linenumber AS task_count, min(l_discount) FILTER (WHERE l_tax >= 0.06) AS minimum_effect FROM lineitem GROUP BY 1")
def minimum_effects(spark: SparkSession, sf: str) -> DataFrame:
    """The rule for the least sufficient effect, over line items as cells of a grid."""
    grid = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("task_count"), F.col("l_discount").alias("effect"), F.col("l_tax").alias("power"))
    return stats.minimum_effects(grid, 0.06)


@query(
    "resource_summary",
    """SELECT user_id AS run_id, count(*) AS samples, CAST(greatest(floor(epoch(max(ts))) - floor(epoch(min(ts))), 0) AS BIGINT) AS wall_time_seconds, max(value) AS peak, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1""",
)
def resource_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    samples = e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("sample_no"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("monotonic_seconds"), F.lit(0.0).alias("process_cpu_seconds"),
        F.col("value").alias("current_rss_bytes"), F.col("value").alias("process_peak_rss_bytes"), F.col("value").alias("gpu_memory_bytes"), "ts",
    )
    span = samples.groupBy("run_id").agg(resources.delta("monotonic_seconds", F.struct("ts", "sample_no")).alias("wall_time_seconds"))
    use = resources.usage(samples.withColumn("monotonic_seconds", F.unix_micros(F.col("ts").cast("timestamp"))))
    return use.select("run_id", "samples", F.col("sampled_peak_current_rss_bytes").alias("peak"), F.col("current_rss_bytes").alias("last")).join(span, "run_id")


@query("calibration_median", "SELECT event_type, median(value) AS median, count(value) AS trials FROM events GROUP BY 1")
def calibration_median(spark: SparkSession, sf: str) -> DataFrame:
    return resources.calibrated(table(spark, sf, "events"), "event_type", "value")


@query(
    "cumulative_share",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, CAST(sum(n) OVER (ORDER BY event_type) AS BIGINT) AS upto FROM c""",
)
def cumulative_share(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cumulative(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")



# ---- variants, manifests, documents


@query(
    "variant_categories",
    f"""WITH {GRID_SQL}, o AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 2),
    d AS (SELECT n - 1 AS demos FROM t)
    SELECT category, n, true AS round_trips FROM (
      SELECT 'd4_only' AS category, count(*) * 8 AS n FROM d UNION ALL SELECT 'color_only', count(*) * 4 FROM d UNION ALL SELECT 'd4_plus_color', count(*) * 4 FROM d
      UNION ALL SELECT 'demonstration_order', count(*) * 2 FROM d WHERE demos >= 3) WHERE n > 0""",
)
def variant_categories(spark: SparkSession, sf: str) -> DataFrame:
    tasks = order_tasks(spark, sf).withColumn("idx", F.col("task_id").cast("long") % 97)
    return variants.categories(variants.design(tasks, splits.color_maps("gridloom", [1, 2, 3, 4])))


@query(
    "variant_latin_balance",
    f"""WITH {TASK_SQL}, c(slot, d4) AS (VALUES (0, 'rotate_90'), (1, 'rotate_180'), (2, 'flip_horizontal'), (3, 'transpose'))
    SELECT d4, CAST((t % 97 % 4 + slot) % 4 AS INTEGER) AS color_index, count(*) AS n FROM tk, c GROUP BY 1, 2""",
)
def variant_latin_balance(spark: SparkSession, sf: str) -> DataFrame:
    tasks = order_tasks(spark, sf).withColumn("idx", F.col("task_id").cast("long") % 97)
    return variants.latin_balance(variants.design(tasks, splits.color_maps("gridloom", [1, 2, 3, 4]), only="d4_plus_color"))


@query(
    "label_mutation_audit",
    f"""WITH {SCORE_SQL} SELECT CAST(0 AS BIGINT) AS differing, count(*) FILTER (WHERE exact) AS original, CAST(sum(matches) AS BIGINT) AS original_cells, count(*) FILTER (WHERE shifted_exact) AS mutated, CAST(sum(shifted_matches) AS BIGINT) AS mutated_cells FROM so""",
)
def label_mutation_audit(spark: SparkSession, sf: str) -> DataFrame:
    return variants.mutation_audit(shared.written(order_tasks(spark, sf)))


@query("json_keys", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return evidence.histogram(keys, "key")


@query("reproduction_funnel", """WITH l AS (SELECT user_id % 7 AS m, event_type, CASE WHEN value > 50 THEN 'passed' ELSE 'failed' END AS status, row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY CAST(value AS VARCHAR) DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events),
    g AS (SELECT m, t FROM (SELECT DISTINCT user_id % 7 AS m FROM events), (VALUES ('click'), ('view'), ('audit')) AS v(t))
    SELECT CAST(g.m AS VARCHAR) AS method_id, g.t AS layer, CASE WHEN g.t = 'view' THEN 'passed' END AS declared, l.status AS observed, (CASE WHEN g.t = 'view' THEN 'passed' END) IS NOT DISTINCT FROM l.status AS agrees
    FROM g LEFT JOIN l ON l.m = g.m AND l.event_type = g.t AND l.r = 1""")
def reproduction_funnel(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    method = F.pmod("user_id", F.lit(7)).cast("string").alias("method_id")
    records = e.select(method, F.col("event_type").alias("layer"), F.when(F.col("value") > 50, "passed").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("started"), F.col("value").cast("string").alias("ended"), F.col("event_id").cast("string").alias("path"))
    declared = e.select(method).distinct().select("method_id", F.lit("view").alias("layer"), F.lit("passed").alias("status"))
    return manifests.reproduction_funnel(records, declared, ["click", "view", "audit"])


@query("benchmark_totals", """WITH t AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2),
    r AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS benchmark, CASE WHEN o_custkey % 3 = 0 THEN 'evaluation' ELSE 'training' END AS split, n FROM t)
    SELECT benchmark, split, count(*) AS tasks, CAST(sum(n - 1) AS BIGINT) AS train_pairs, count(*) AS test_pairs, CAST(sum(n) AS BIGINT) AS bytes FROM r GROUP BY ROLLUP (benchmark, split)""")
def benchmark_totals(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("task_id").cast("long")
    tasks = order_tasks(spark, sf).select(F.when(key % 2 == 0, "a").otherwise("b").alias("benchmark"), F.when(key % 3 == 0, "evaluation").otherwise("training").alias("split"), "task", (F.size("task.train") + F.size("task.test")).alias("bytes"))
    return manifests.benchmark_totals(tasks)


@query(
    "input_verification",
    """WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), o AS (SELECT DISTINCT d.doc_id, sha256(replace(d.text, 'the', 'THE')) AS sha FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
    SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN o.sha IS NULL THEN 'missing' WHEN o.sha <> d.sha THEN 'mismatch' END AS error FROM d LEFT JOIN o ON o.doc_id = d.doc_id""",
)
def input_verification(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as declared inputs; the labelled ones, slightly changed, as the observed files."""
    docs = table(spark, sf, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    declared = docs.select(F.lit("input").alias("role"), path, F.sha2("text", 256).alias("sha256"))
    labelled = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    observed = labelled.select(path, F.sha2(F.replace("text", F.lit("the"), F.lit("THE")), 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    return evidence.verify_inputs(declared, observed).select("path", "error")


EVENT_SCHEMA = {
    "type": "object", "required": ["k", "kind"], "additionalProperties": False,
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 89}},
}


@query(
    "json_schema_issues",
    """WITH e AS (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_filter(json_keys(props), lambda n: n <> 'k') AS others FROM events),
    i AS (SELECT '$.kind: required' AS issue FROM e WHERE NOT list_contains(others, 'kind') UNION ALL SELECT '$.k: range' FROM e WHERE k NOT BETWEEN 10 AND 89 UNION ALL SELECT '$.k: required' FROM e WHERE k IS NULL
          UNION ALL SELECT '$.' || n || ': unknown' FROM (SELECT unnest(others) AS n FROM e))
    SELECT issue, count(*) AS n FROM i GROUP BY 1""",
)
def json_schema_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of every event's properties under a small schema that many break."""
    rows = table(spark, sf, "events").select(runs.document_issues(EVENT_SCHEMA)("props").alias("issues"))
    return rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def _assertions(spark: SparkSession, sf: str) -> DataFrame:
    """Two assertions on every event's properties as evidence for its type's gate: its key is its id modulo 100; another place, that is not there, is null."""
    e = table(spark, sf, "events")
    docs = e.select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    asked = e.select(F.col("event_type").alias("gate_id"), F.col("event_id").cast("string").alias("path"), F.explode(F.array(F.struct(F.lit("/k").alias("p"), F.pmod("event_id", F.lit(100)).cast("string").alias("v")), F.struct(F.lit("/none/0").alias("p"), F.lit("null").alias("v")))).alias("a"))
    return evidence.evaluate_assertions(asked.select("gate_id", "path", F.col("a.p").alias("pointer"), F.col("a.v").alias("equals")), docs)


ASSERTION_SQL = """pa AS (SELECT event_type AS gate_id, CAST(event_id AS VARCHAR) AS path, '/k' AS pointer, coalesce(json_extract_string(props, '$.k') = CAST(event_id % 100 AS VARCHAR), false) AS passed FROM events
    UNION ALL SELECT event_type, CAST(event_id AS VARCHAR), '/none/0', false FROM events)"""


@query("json_pointer_assertions", f"WITH {ASSERTION_SQL} SELECT gate_id, pointer, passed, count(*) AS n FROM pa GROUP BY 1, 2, 3")
def json_pointer_assertions(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).groupBy("gate_id", "pointer", "passed").agg(F.count("*").alias("n"))


@query(
    "gate_readiness",
    f"""WITH {ASSERTION_SQL}, g AS (SELECT DISTINCT event_type AS id, CASE WHEN event_type IN ('click', 'view') THEN 'passed' ELSE 'pending' END AS status, event_type <> 'error' AS required FROM events UNION ALL SELECT 'none', 'passed', true),
    r AS (SELECT gate_id, bool_and(passed) AS ok, count(*) AS n FROM pa GROUP BY 1)
    SELECT g.id, g.status, g.required, coalesce(r.n, 0) AS assertions, concat_ws(',', CASE WHEN g.status = 'passed' AND r.n IS NULL THEN 'no-assertion' END, CASE WHEN NOT r.ok THEN 'assertion-failed' END) AS errors, g.required AND g.status <> 'passed' AS unmet
    FROM g LEFT JOIN r ON r.gate_id = g.id""",
)
def gate_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """A gate for each type of event, and one without any assertion."""
    gates = table(spark, sf, "events").select(F.col("event_type").alias("id")).distinct().select("id", F.when(F.col("id").isin("click", "view"), "passed").otherwise("pending").alias("status"), (F.col("id") != "error").alias("required"))
    gates = gates.union(spark.createDataFrame([("none", "passed", True)], "id string, status string, required boolean"))
    return evidence.gate_readiness(gates, _assertions(spark, sf)).withColumn("errors", F.array_join("errors", ","))


@query(
    "lookup_mismatches",
    """SELECT l.l_partkey, l.l_suppkey, CASE WHEN p.p_partkey IS NULL THEN 'missing' ELSE 'different' END AS error FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
    WHERE p.p_partkey IS NULL OR CAST(floor(l.l_quantity) AS BIGINT) IS DISTINCT FROM CAST(p.p_size AS BIGINT)""",
)
def lookup_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.floor("l_quantity").alias("size"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("size"))
    return ledgers.lookup_mismatches(items, parts, ["l_partkey"], ["size"], keep=["l_suppkey"])


@query(
    "challenge_summary",
    """WITH t AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2)
    SELECT count(*) AS task_count, CAST(sum(n - 1) AS BIGINT) AS train_pair_count, count(*) AS test_pair_count, CAST(sum(n - 1) AS BIGINT) AS train_output_key_count, count(*) AS test_output_key_count, CAST(sum(2 * n) AS BIGINT) AS validated_grid_count FROM t""",
)
def challenge_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.challenge_summary(order_tasks(spark, sf))


#: Events' properties below other keys, some of which no record may have.
_NESTED = """concat('{"list":[{"', CASE WHEN event_id % 11 = 3 THEN 'API-Key' WHEN event_id % 7 = 2 THEN 'password' WHEN event_id % 5 = 1 THEN 'password_hint' ELSE 'note' END, '":"say \\"secret\\": no"}],"props":', coalesce(props, 'null'), '}')"""


@query("forbidden_fields", "SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 11 = 3 OR event_id % 7 = 2) AS forbidden, count(*) FILTER (WHERE event_id % 11 = 3) AS api_keys FROM events")
def forbidden_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(ledgers.forbidden_names(F.expr(_NESTED.replace("\\", "\\\\"))).alias("names"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.size("names") > 0).alias("forbidden"), F.count_if(F.array_contains("names", "api_key")).alias("api_keys"))


@query(
    "development_build",
    f"""WITH {TASK_SQL}, cl AS (SELECT 's:' || t AS cluster_id FROM tk), rk AS (SELECT cluster_id, row_number() OVER (ORDER BY sha256('20260806' || chr(0) || cluster_id), cluster_id) AS rank FROM cl),
    w(position, split, weight) AS (VALUES (0, 'train', 70), (1, 'validation', 15), (2, 'audit', 15)), q0 AS (SELECT position, split, total * weight // 100 AS base, total * weight % 100 AS rest, total FROM w, (SELECT count(*) AS total FROM cl)),
    q1 AS (SELECT *, total - sum(base) OVER () AS spare, row_number() OVER (ORDER BY rest DESC, split) AS place FROM q0), q2 AS (SELECT position, split, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS quota FROM q1),
    q AS (SELECT split, quota, sum(quota) OVER (ORDER BY position) AS high FROM q2), sp AS (SELECT rk.cluster_id, q.split FROM rk JOIN q ON rk.rank > q.high - q.quota AND rk.rank <= q.high),
    fl AS (SELECT 's:' || c_custkey AS id FROM customer WHERE c_acctbal < 0)
    SELECT split, count(*) AS clusters, count(*) FILTER (WHERE cluster_id IN (SELECT id FROM fl)) AS flagged_clusters, count(*) AS records, count(*) FILTER (WHERE cluster_id IN (SELECT id FROM fl)) AS flagged_records FROM sp GROUP BY 1""",
)
def development_build(spark: SparkSession, sf: str) -> DataFrame:
    """Records, clusters and flagged counts by split of the whole build over all customers' tasks."""
    tasks = order_tasks(spark, sf)
    records = tasks.select(F.concat(F.lit("s:"), "task_id").alias("record_id"), F.lit("s").alias("source"), "task_id", "task")
    flagged = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("s:"), F.col("c_custkey").cast("string")).alias("record_id"))
    return development.build(records, "20260806", WEIGHTS, flagged).contamination


@query("runtime_checks", f"WITH {TASK_SQL} SELECT CAST(0 AS BIGINT) AS changed_inputs, count(*) AS oracle, count(*) AS oracle_total, CAST(0 AS BIGINT) AS mutated, count(*) AS mutated_total FROM tk")
def runtime_checks(spark: SparkSession, sf: str) -> DataFrame:
    return development.runtime_checks(order_tasks(spark, sf))


@query(
    "metric_contract",
    f"""WITH {METRICS_SQL} SELECT 'output_exact_pass_at_k' AS metric, 2 AS top_k, hits AS numerator, n AS denominator, CAST(hits AS DOUBLE) / n AS value, 'all_declared_test_outputs' AS policy FROM m
    UNION ALL SELECT 'strict_task_exact_pass_at_k', 2, hits, n, CAST(hits AS DOUBLE) / n, 'all_declared_tasks' FROM m UNION ALL SELECT 'micro_cell_accuracy', 2, matches, cells, CAST(matches AS DOUBLE) / cells, 'diagnostic_only' FROM m""",
)
def metric_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the baseline's score, a row for each."""
    contract = ledgers.metric_contract(baseline.run(shared.written(order_tasks(spark, sf)), 2)[2])
    rows = contract.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), f"{m}.*") for m in contract.columns])).alias("m"))
    return rows.select("m.*")


from . import audits  # noqa: E402,F401  its queries register themselves
