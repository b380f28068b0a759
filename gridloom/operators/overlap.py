"""Normalised task content, fingerprints, and the overlap of two task sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import digests

VARIANTS = ("raw_without_name_exact", "semantic_labeled_exact", "challenge_semantic_exact", "ordered_test_io_exact", "test_io_exact", "ordered_test_inputs_exact", "test_inputs_exact")


def example_text(pair: Column, with_output: bool = True) -> Column:
    """Canonical JSON of an example: keys in order, no spaces, an absent output left out."""
    return F.to_json(pair) if with_output else F.to_json(F.struct(pair["input"].alias("input")))


def example_texts(pairs: Column, ordered: bool, with_output: bool = True) -> Column:
    """Examples as canonical JSON; unless ordered, sorted by that text (not by array order)."""
    out = F.transform(pairs, lambda p: example_text(p, with_output))
    return out if ordered else F.array_sort(out)


def normalized_text(task: Column, train_ordered: bool = False, test_ordered: bool = False, with_output: bool = True) -> Column:
    """Canonical JSON of a task without its name."""
    test = F.array_join(example_texts(task["test"], test_ordered, with_output), ",")
    train = F.array_join(example_texts(task["train"], train_ordered), ",")
    return F.concat(F.lit('{"test":['), test, F.lit('],"train":['), train, F.lit("]}"))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def forms(task: Column) -> dict[str, Column]:
    """The text that must agree for each variant of equality."""
    inputs = F.transform(task["test"], lambda p: F.to_json(p["input"]))
    return {
        "raw_without_name_exact": normalized_text(task, True, True),
        "semantic_labeled_exact": normalized_text(task),
        "challenge_semantic_exact": normalized_text(task, with_output=False),
        "ordered_test_io_exact": F.array_join(example_texts(task["test"], True), ","),
        "test_io_exact": F.array_join(example_texts(task["test"], False), ","),
        "ordered_test_inputs_exact": F.array_join(inputs, ","),
        "test_inputs_exact": F.array_join(F.array_sort(inputs), ","),
    }


def split_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(task_id, one boolean for each variant) of the ids on both sides.

    Each side is reduced to digests before the join.
    """
    sides = [df.select("task_id", *[fingerprint(form).alias(f"{side}_{name}") for name, form in forms(F.col("task")).items()]) for side, df in (("l", left), ("r", right))]
    both = sides[0].join(sides[1], "task_id")
    return both.select("task_id", *[(F.col(f"l_{n}") == F.col(f"r_{n}")).alias(n) for n in VARIANTS])


def overlap_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """(variant, task_id): the ids on both sides under `id_overlap`, and under each variant those that agree in it."""
    named = [F.when(F.col(n), F.lit(n)) for n in VARIANTS]
    return split_overlap(left, right).select(F.explode(F.array_compact(F.array(F.lit("id_overlap"), *named))).alias("variant"), "task_id")


def overlap_digests(left: DataFrame, right: DataFrame) -> DataFrame:
    """(variant, n, digest): how many ids each variant has, and the digest of their sorted JSON list; variants without any are left out."""
    return digests.json_list(overlap_ids(left, right), ["variant"], [F.col("task_id")], F.col("task_id"))


def overlap_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: the sizes of both sides and the counts of each variant."""
    found = split_overlap(left, right).agg(F.count("*").alias("id_overlap_count"), *[F.count_if(n).alias(f"{n}_count") for n in VARIANTS])
    sizes = left.agg(F.count("*").alias("left_task_count")).crossJoin(right.agg(F.count("*").alias("right_task_count")))  # one row each
    return sizes.crossJoin(found)
