"""Audits: zero-filled counts, roster reconciliation, rules, gates, evidence, funnels, admission."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import digests


def glob_regex(glob: str) -> str:
    """A glob whose * also crosses slashes, as a Java pattern for the whole path."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2)
        if c == "[" and close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}\\z"


def first_rule(path: Column, rules: Sequence[dict[str, str]], field: str) -> Column:
    """The field of the first rule whose glob matches; null when none does."""
    value = F.lit(None).cast("string")
    for rule in reversed(rules):
        value = F.when(path.rlike(glob_regex(rule["glob"])), F.lit(rule[field])).otherwise(value)
    return value


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def zero_filled(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(value, n) for every declared value, 0 where it doesn't occur; other values are left out."""
    declared = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return declared.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reconcile(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, state) of a full outer join on distinct keys: both, missing (not observed), extra (not declared)."""
    left = declared.select(key).distinct().withColumn("__d", F.lit(True))
    right = observed.select(key).distinct().withColumn("__o", F.lit(True))
    state = F.when(F.col("__d") & F.col("__o"), "both").when(F.col("__d"), "missing").otherwise("extra")
    return left.join(right, key, "full").select(key, state.alias("state"))


def order_matches(left: Column, right: Column) -> Column:
    """Equal lists, as opposed to equal sets."""
    return left == right


def latest(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group: a max over a struct, so partial results shrink before the shuffle."""
    names = [c for c in rows.columns if c not in group]
    keys = [o.alias(f"__{k}") for k, o in enumerate(order)]
    top = rows.select(*group, F.struct(*keys, *names).alias("__row")).groupBy(*group).agg(F.max("__row").alias("__row"))
    return top.select(*group, *[F.col(f"__row.{n}").alias(n) for n in names])


def verify_inputs(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(role, path, sha256, observed, error) of declared inputs against an inventory (path, sha256, bytes)."""
    seen = observed.select("path", F.col("sha256").alias("observed"), "bytes")
    rows = declared.join(duplicates(declared, "path").select("path", F.lit(True).alias("twice")), "path", "left").join(seen, "path", "left")
    error = (
        F.when(F.coalesce(F.col("role") == "", F.lit(True)), "role").when(F.col("twice"), "duplicate-path")
        .when(~F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), "digest").when(F.col("observed").isNull(), "missing").when(F.col("observed") != F.col("sha256"), "mismatch")
    )
    return rows.select("role", "path", "sha256", "observed", "bytes", error.alias("error"))


def pointer(document: object, path: str) -> tuple[bool, object]:
    """(found, value) of an RFC 6901 pointer; a missing place is not a null."""
    if path == "":
        return True, document
    if not path.startswith("/"):
        return False, None
    for raw in path[1:].split("/"):
        token = raw.replace("~1", "/").replace("~0", "~")
        if isinstance(document, dict) and token in document:
            document = document[token]
        elif isinstance(document, list) and re.fullmatch(r"-?\d+", token) and 0 <= int(token) < len(document):
            document = document[int(token)]
        else:
            return False, None
    return True, document


def evaluate_assertions(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """assertions (gate_id, path, pointer, equals as JSON) against documents (path, text): plus `passed`.

    Values are compared as canonical JSON, so true, 1 and 1.0 are three values.
    """
    import json

    rows = assertions.join(documents.select("path", "text"), "path", "left").select("gate_id", "path", "pointer", "equals", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        for f in frames:
            passed = []
            for where, expected, body in zip(f["pointer"], f["equals"], f["text"], strict=True):
                try:
                    found, value = pointer(json.loads(body), where) if body is not None else (False, None)
                    passed.append(found and text(value) == text(json.loads(expected)))
                except ValueError:
                    passed.append(False)
            yield f.drop(columns="text").assign(passed=passed)

    return rows.mapInPandas(run, "gate_id string, path string, pointer string, equals string, passed boolean")


def gate_readiness(gates: DataFrame, results: DataFrame) -> DataFrame:
    """Per gate (id, status, required): error codes for passed gates without sound evidence, and whether it is unmet."""
    per = results.groupBy("gate_id").agg(
        F.bool_and("passed").alias("all_passed"),
        F.bool_or(F.col("pointer") != "/status").alias("semantic"),
        F.count("*").alias("assertions"),
        (F.count("*") != F.count_distinct("path", "pointer")).alias("repeated"),
    )
    rows = gates.join(per, gates["id"] == per["gate_id"], "left").drop("gate_id")
    passed = F.col("status") == "passed"
    errors = F.array_compact(
        F.array(
            F.when(passed & F.col("assertions").isNull(), "no-assertion"),
            F.when(F.col("all_passed") == F.lit(False), "assertion-failed"),
            F.when(passed & (F.col("semantic") == F.lit(False)), "status-only"),
            F.when(F.col("repeated"), "repeated-assertion"),
        )
    )
    return rows.select("id", "status", "required", F.coalesce("assertions", F.lit(0)).alias("assertions"), errors.alias("errors"), (F.col("required") & ~passed).alias("unmet"))


def funnel(records: DataFrame, layers: dict[str, Column]) -> DataFrame:
    """One row: how many records pass each layer's condition."""
    return records.agg(*[F.count_if(F.coalesce(ok, F.lit(False))).alias(name) for name, ok in layers.items()])


def roster_agreement(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that are not in all tables, with the positions of those that have them."""
    rows = None
    for k, t in enumerate(tables):
        part = t.select(key).distinct().withColumn("at", F.lit(k))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("present")).where(F.size("present") < len(tables))


def ordered_digest(rows: DataFrame, group: list[str], order: Column, text: Column) -> DataFrame:
    """(group, n, digest): SHA-256 over the JSON list of a group's texts, in order; see digests."""
    return digests.json_list(rows, group, [order, text], text)


def last_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """As latest(), by a window: keeps columns that have no order, such as maps."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def macro_micro(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: macro (the mean of the groups' means), micro (the mean over all rows) and the number of groups; nulls of value are left out."""
    per = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(F.col(value).cast("double")).alias("__sum"), F.count("*").alias("__n"))
    return per.agg(F.avg(F.col("__sum") / F.col("__n")).alias("macro"), F.try_divide(F.sum("__sum"), F.sum("__n")).alias("micro"), F.count("*").alias("groups"))


def cost_audit(rows: DataFrame, group: list[str], cost: str, stored: str, key: list[str]) -> DataFrame:
    """Per group: total, positive and all costs, their true mean, the stored mean, what the total was divided by for it, and distinct keys.

    A missing cost is nothing in the total and is not counted in the mean.
    """
    c = F.col(cost)
    sums = rows.groupBy(*group).agg(
        F.sum(F.coalesce(c, F.lit(0.0))).alias("total"), F.count_if(c > 0).alias("positive"), F.count("*").alias("n"), F.avg(c).alias("mean"), F.max(stored).alias("stored_mean"),
        F.count_distinct(F.struct(*key)).alias("keys"),
    )
    return sums.withColumn("divisor", F.try_divide("total", "stored_mean"))


def totals(rows: DataFrame, column: str, total: str = "total") -> DataFrame:
    """(column, n) of every value, and of all rows under the name `total`."""
    counts = rows.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).alias("__all"))
    return counts.select(F.when(F.col("__all") == 1, total).otherwise(F.col(column)).alias(column), "n")
