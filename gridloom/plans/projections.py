"""The generic test tables seen as the library's inputs: grids, tasks, attempts, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, g): a grid for each order; a row for each line, in a total order of all columns that feed a cell."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    digit = lambda c: F.pmod(F.floor(c), F.lit(10)).cast("int")
    row = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.array(digit(F.col("l_linenumber")), digit(F.col("l_quantity")), digit(F.col("l_partkey")), digit(F.col("l_suppkey"))).alias("cells"),
    )
    rows = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"])
    return line.groupBy(F.col("l_orderkey").alias("k")).agg(rows.alias("g"))


def flat_cells(df: DataFrame, grid: str = "g", key: str = "k") -> DataFrame:
    """(k, i, j, cell) of a grid column."""
    rows = df.select(key, F.posexplode(grid).alias("i", "row"))
    cells = rows.select(key, "i", F.posexplode("row").alias("j", "cell"))
    return cells.select(key, *[F.col(c).cast("long").alias(c) for c in ("i", "j", "cell")])


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, task): per customer, orders as examples whose output is the mirrored or recoloured input."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    grids = order_grids(spark, sf_dir).join(orders, F.col("k") == F.col("o_orderkey"))
    out = F.when(F.col("o_custkey") % 2 == 0, F.transform("g", lambda r: F.reverse(r))).otherwise(F.transform("g", lambda r: F.transform(r, lambda c: F.pmod(c + 1, F.lit(10)))))
    pair = F.struct("k", F.struct(F.col("g").alias("input"), out.alias("output")).alias("p"))
    grouped = grids.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(pair)), lambda s: s["p"]).alias("pairs")).where(F.size("pairs") >= 2)
    n = F.size("pairs")
    task = F.struct(F.lit(None).cast("string").alias("name"), F.slice("pairs", F.lit(1), n - 1).alias("train"), F.slice("pairs", n, F.lit(1)).alias("test"))
    return grouped.select(F.col("o_custkey").cast("string").alias("task_id"), task.alias("task"))


GRID_SQL = """ln AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i,
         count(*) OVER (PARTITION BY l_orderkey) AS h,
         CAST(l_linenumber AS BIGINT) % 10 AS c0, CAST(floor(l_quantity) AS BIGINT) % 10 AS c1, l_partkey % 10 AS c2, l_suppkey % 10 AS c3
  FROM lineitem),
cells AS (
  SELECT k, h, i, CAST(0 AS BIGINT) AS j, c0 AS cell FROM ln UNION ALL SELECT k, h, i, CAST(1 AS BIGINT), c1 FROM ln
  UNION ALL SELECT k, h, i, CAST(2 AS BIGINT), c2 FROM ln UNION ALL SELECT k, h, i, CAST(3 AS BIGINT), c3 FROM ln)"""


def pattern_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, m, u, colors, task): for each part a task of m demonstrations, of which the first u mirror their input.

    All tasks of one m have like signatures; they are isomorphic just where they
    have the same u.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    t = F.pmod(F.col("p_partkey") * 7 + F.col("p_size"), F.lit(720)).cast("int")
    a = F.floor(t / 72).cast("int")
    b = F.pmod(a + 1 + F.pmod(F.floor(t / 8), F.lit(9)), F.lit(10)).cast("int")
    rest = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: (c != F.col("a")) & (c != F.col("b")))
    rows = part.select("p_partkey", F.element_at(F.array(*map(F.lit, (1, 2, 3, 7))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int")).alias("m"), (3 * F.pmod("p_size", F.lit(3))).cast("int").alias("third"), t.alias("t"), a.alias("a"), b.alias("b"))
    rows = rows.select("p_partkey", "m", F.least("m", "third").alias("u"), "a", "b", F.element_at(rest, F.pmod("t", F.lit(8)) + 1).alias("c"))
    line = F.array("a", "b", "b", "c", "c", "c")
    pair = lambda out: F.struct(F.array(line).alias("input"), F.array(out).alias("output"))
    train = F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: pair(F.when(i <= F.col("u"), F.reverse(line)).otherwise(line)))
    task = F.struct(F.lit(None).cast("string").alias("name"), train.alias("train"), F.array(pair(line)).alias("test"))
    return rows.select(F.col("p_partkey").alias("part"), "m", "u", F.array("a", "b", "c").alias("colors"), task.alias("task"))


#: part, m, u and the three colours of pattern_tasks; most states of its search against an image: 2 * (2^u + 2^(m-u)).
PATTERN_SQL = """pt AS (SELECT p_partkey AS part, [1, 2, 3, 7][p_partkey % 4 + 1] AS m, 3 * (p_size % 3) AS third, CAST((p_partkey * 7 + p_size) % 720 AS BIGINT) AS t FROM part),
pc AS (SELECT part, m, least(m, third) AS u, t, t // 72 AS a, (t // 72 + 1 + (t // 8) % 9) % 10 AS b FROM pt),
pa AS (SELECT part, m, u, a, b, list_filter(range(0, 10), lambda c: c <> a AND c <> b)[t % 8 + 1] AS c FROM pc)"""
