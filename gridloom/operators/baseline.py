"""The deterministic candidate pipeline: generate, rank, keep the first K distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grids
from . import scoring


def fits(train: Column, turn: grids.Transform) -> Column:
    """Whether a transform maps every training input to its output."""
    return F.forall(train, lambda p: F.coalesce(turn(p["input"]) == p["output"], F.lit(False)))


def fitting_transforms(train: Column) -> Column:
    """Names of the D4 transforms that fit, in D4 order."""
    return F.array_compact(F.array(*[F.when(fits(train, turn), F.lit(name)) for name, turn in grids.D4.items()]))


def cell_pairs(train: Column) -> Column:
    """Distinct (source, target) colours over all cells of all training pairs."""
    cells = F.transform(train, lambda p: F.zip_with(F.flatten(p["input"]), F.flatten(p["output"]), lambda s, t: F.struct(s.alias("s"), t.alias("t"))))
    return F.array_sort(F.array_distinct(F.flatten(cells)))


def color_mapping(train: Column) -> Column:
    """source -> target colour where that is a function and all shapes agree; else null. Many may go to one."""
    # pairs as whole numbers: distinct ones are found by hash, those of structs by comparing each with all
    code = lambda s, t: F.shiftleft(s.cast("long"), 32) + t.cast("long") + (1 << 31)
    cells = F.transform(train, lambda p: F.zip_with(F.flatten(p["input"]), F.flatten(p["output"]), code))
    source = lambda c: F.shiftright(c, 32).cast("int")
    target = lambda c: (c - F.shiftleft(F.shiftright(c, 32), 32) - (1 << 31)).cast("int")

    def learnt(codes: Column) -> Column:
        sources = F.transform(codes, source)
        works = (F.size(F.array_distinct(sources)) == F.size(codes)) & F.forall(codes, lambda c: c.isNotNull())
        return F.when(works, F.map_from_arrays(sources, F.transform(codes, target)))

    return F.when(F.forall(train, lambda p: grids.same_shape(p["input"], p["output"])), grids.bound(F.sort_array(F.array_distinct(F.flatten(cells))), learnt))


def learn_functional_dependency(rows: DataFrame, group: list[str], source: str, target: str) -> DataFrame:
    """(group, source, target, n) for groups in which every source has one target: the relational form.

    Two aggregations on nested keys: distinct pairs first, so a frequent pair is
    one row before it is dealt.
    """
    pairs = rows.groupBy(*group, source, target).agg(F.count("*").alias("n"))
    per_source = pairs.groupBy(*group, source).agg(F.count("*").alias("targets"), F.min(target).alias(target), F.sum("n").alias("n"))
    good = per_source.groupBy(*group).agg(F.max("targets").alias("most")).where("most = 1").select(*group)
    return per_source.join(good, group, "left_semi").select(*group, source, target, "n")


def candidates(task: Column, grid: Column, mapping: Column, top_k: int) -> Column:
    """Candidates (solver, grid) for one test input, in rank order, repeats included.

    The constants differ from each other, so K of them are enough for K distinct
    candidates, if there are so many colours. `mapping` is the task's colour
    mapping as a column of its own: an expression would be worked out for every cell.
    """

    def one(solver: Column | str, g: Column) -> Column:
        return F.struct((F.lit(solver) if isinstance(solver, str) else solver).alias("solver"), g.alias("grid"))

    train = task["train"]
    geometric = F.array_compact(F.array(*[F.when(fits(train, turn), one(name, turn(grid))) for name, turn in grids.D4.items()]))
    mapped = F.array_compact(F.array(F.when(mapping.isNotNull(), one("color_mapping", grids.recolor(mapping)(grid)))))

    def plain(colors: Column) -> Column:
        fixed = F.array(one("copy_input", grid), one("dominant_color", grids.constant(grid, F.element_at(colors, 1))))
        return F.concat(fixed, F.transform(F.slice(colors, 1, min(top_k, grids.CELLS)), lambda c: one(F.concat(F.lit("constant_color:"), c.cast("string")), grids.constant(grid, c))))

    return F.concat(geometric, mapped, grids.bound(grids.colors_by_frequency(grid), plain))


def first_k_distinct(rows: DataFrame, group: list[str], value: Column, order: Column, k: int) -> DataFrame:
    """Keep the first row of each value, then the first k of each group, as rank 1..k."""
    rows = rows.withColumns({"__value": value, "__order": order})
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group, "__value").orderBy("__order"))).where("__n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("__order")))
    return ranked.where(F.col("rank") <= k).drop("__value", "__order", "__n")


def rank_candidates(tasks: DataFrame, top_k: int = 2) -> DataFrame:
    """(task_id, output_index, rank, solver, grid) for every test input; labels are dropped first."""
    if top_k < 1:
        raise ValueError("top_k must be a positive integer")
    seen = tasks.select("task_id", grids.challenge_only(F.col("task")).alias("task"))
    seen = seen.withColumn("mapping", color_mapping(F.col("task.train")))
    inputs = seen.select("task_id", "task", "mapping", F.posexplode("task.test").alias("output_index", "pair"))
    made = inputs.select("task_id", "output_index", candidates(F.col("task"), F.col("pair.input"), F.col("mapping"), top_k).alias("c"))
    made = made.withColumn("t", F.transform("c", lambda x: x["grid"]))
    # an input's candidates are one short array: the first of each grid is kept in place, without a shuffle
    once = F.filter("c", lambda x, i: F.array_position("t", F.get(F.col("t"), i)) == i + 1)
    return made.select("task_id", "output_index", F.posexplode(F.slice(once, 1, top_k)).alias("place", "x")).select("task_id", "output_index", (F.col("place") + 1).alias("rank"), "x.solver", "x.grid")


def short_outputs(tasks: DataFrame, ranked: DataFrame, top_k: int) -> DataFrame:
    """Test inputs that have fewer than K distinct candidates."""
    inputs = tasks.select("task_id", F.posexplode("task.test").alias("output_index", "pair")).drop("pair")
    counts = ranked.groupBy("task_id", "output_index").agg(F.count("*").alias("n"))
    return inputs.join(counts, ["task_id", "output_index"], "left").where(F.coalesce("n", F.lit(0)) < top_k)


def predictions(ranked: DataFrame) -> DataFrame:
    """(task_id, outputs): attempts as maps, outputs in order."""
    entry = F.struct("rank", F.struct(F.concat(F.lit("attempt_"), F.col("rank").cast("string")).alias("key"), F.col("grid").alias("value")).alias("e"))
    per_output = ranked.groupBy("task_id", "output_index").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["e"])).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("output_index", "m")), lambda a, b: a["output_index"] - b["output_index"]), lambda s: s["m"])
    return per_output.groupBy("task_id").agg(ordered.alias("outputs"))


def solver_counts(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("solver").agg(F.count("*").alias("attempts")).orderBy("solver")


def run(tasks: DataFrame, top_k: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, solver counts, score): the score reads the finished attempts only."""
    ranked = rank_candidates(tasks, top_k)
    attempts = ranked.select("task_id", "output_index", F.col("rank").alias("attempt_no"), "grid")
    return predictions(ranked), solver_counts(ranked), scoring.score(scoring.explode_answers(tasks), attempts, top_k)
