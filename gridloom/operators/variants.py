"""Task variants with round-trip proofs, the Latin design, and label-mutation audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids
from . import baseline, scoring, shared

#: Fixed value: the transforms that are combined with colour maps.
COMBINED_D4 = ("rotate_90", "rotate_180", "flip_horizontal", "transpose")


def variant_count(demos: Column, tests: Column) -> Column:
    """Variants of a task: 8 turns, 4 recolourings and 4 combinations, and the example orders that its size allows."""
    return F.lit(len(grids.D4) + 4 + len(COMBINED_D4)) + F.when(demos >= 3, 2).otherwise(0) + (tests >= 2).cast("int") + (tests >= 3).cast("int")


def _orders(n: Column) -> dict[str, Column]:
    base = F.sequence(F.lit(0), n - 1)
    return {"cyclic-left": grids.cyclic_left(base), "reverse": F.reverse(base)}


def design(tasks: DataFrame, color_maps: list[dict[int, int]], d4: list[str] | None = None, only: str | None = None) -> DataFrame:
    """(task_id, variant_id, category, latin_row, color_index, d4, round_trip, variant) for tasks (task_id, task, idx).

    idx is the task's place in its benchmark; idx modulo 4 is its row of the
    Latin square that pairs the combined transforms with the four colour maps.
    One row for each variant comes from an array of structs, so a task is read
    once. round_trip says that the inverse restores the task exactly. `only` names
    a category where the variants of the others are not asked for.
    """
    seen = tasks.select("task_id", "idx", grids.challenge_only(F.col("task")).alias("task"))
    task, row = F.col("task"), F.pmod("idx", F.lit(4)).cast("int")

    def variant(name: Column | str, category: str, turn: Column | None, color: Column | None, forward: grids.Transform, inverse: grids.Transform, train: Column | None = None, test: Column | None = None) -> Column:
        null = lambda kind: F.lit(None).cast(kind)
        return grids.bound(grids.transform_task(task, forward, train, test), lambda made: F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("variant_id"), F.lit(category).alias("category"), (turn if turn is not None else null("string")).alias("d4"),
            (color if color is not None else null("int")).alias("color_index"), grids.restore_task(made, inverse, train, test).eqNullSafe(task).alias("round_trip"), made.alias("variant"),
        ))

    options = [] if only not in (None, "d4_only") else [variant(f"d4-{n}", "d4_only", F.lit(n), None, grids.D4[n], grids.D4[grids.INVERSE_D4[n]]) for n in d4 or list(grids.D4)]
    inverse_maps = [{v: k for k, v in m.items()} for m in color_maps]
    options += [] if only not in (None, "color_only") else [variant(f"color-{k}", "color_only", None, F.lit(k), grids.recolor(m), grids.recolor(back)) for k, (m, back) in enumerate(zip(color_maps, inverse_maps, strict=True))]
    table, back_table = (F.array(*map(grids.color_table, maps)) for maps in (color_maps, inverse_maps))
    for slot, name in enumerate(COMBINED_D4 if only in (None, "d4_plus_color") else ()):
        index = F.pmod(row + slot, F.lit(4))
        forward = grids.compose(grids.D4[name], grids.recolor_by(F.get(table, index)))
        inverse = grids.compose(grids.recolor_by(F.get(back_table, index)), grids.D4[grids.INVERSE_D4[name]])
        options.append(variant(F.concat(F.lit(f"combo-{name}-color-"), index.cast("string")), "d4_plus_color", F.lit(name), index, forward, inverse))
    for split, category, least in (("train", "demonstration_order", {"cyclic-left": 3, "reverse": 3}), ("test", "test_order", {"cyclic-left": 2, "reverse": 3})):
        if only not in (None, category):
            continue
        n = F.size(task[split])
        for name, order in _orders(n).items():
            made = variant(f"{'demo' if split == 'train' else 'test'}-order-{name}", category, None, None, grids.identity, grids.identity, **{split: order})
            options.append(F.when(n >= least[name], made))
    rows = seen.select("task_id", row.alias("latin_row"), F.explode(F.array_compact(F.array(*options))).alias("v"))
    return rows.select("task_id", "latin_row", "v.*")


def latin_balance(variants: DataFrame) -> DataFrame:
    """How often each combined transform meets each colour map; a sound design has equal counts."""
    return variants.where("category = 'd4_plus_color'").groupBy("d4", "color_index").agg(F.count("*").alias("n"))


def categories(variants: DataFrame) -> DataFrame:
    return variants.groupBy("category").agg(F.count("*").alias("n"), F.bool_and("round_trip").alias("round_trips"))


def mutation_audit(tasks: DataFrame, offset: int = 1, top_k: int = 2) -> DataFrame:
    """One row: predictions that differ when hidden labels are mutated (0), and the scores under both labels.

    Candidates are made from the label-free view, so both runs must agree; a
    scorer that is sensitive to labels must not.
    """
    mutated = tasks.select("task_id", grids.mutate_labels(F.col("task"), offset).alias("task"))
    first, second = (baseline.rank_candidates(t, top_k) for t in (tasks, mutated))
    # each run is made once, and read for the comparison and for both scores
    first, second = shared.written(first), shared.written(second)
    side = lambda rows, weight: rows.withColumn("__weight", F.lit(weight))
    apart = side(first, 1).union(side(second, -1)).groupBy(*first.columns).agg(F.sum("__weight").alias("more")).where("more <> 0")
    differing = apart.agg(F.coalesce(F.sum(F.abs("more")), F.lit(0)).alias("differing"))
    attempts = first.select("task_id", "output_index", F.col("rank").alias("attempt_no"), "grid")
    scores = [scoring.score(scoring.explode_answers(t), attempts, top_k).select(F.col("outputs_exact").alias(n), F.col("cells_correct").alias(f"{n}_cells")) for n, t in (("original", tasks), ("mutated", mutated))]
    return differing.crossJoin(scores[0]).crossJoin(scores[1])  # one row each
