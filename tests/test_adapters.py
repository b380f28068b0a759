import pytest
from pyspark.sql import functions as F

from gridloom.operators import adapters
from gridloom.schemas import TASK


def frame(spark, n):
    rows = [(f"t{k}", (None, [([[k % 10]], [[1]])], [([[k % 10, 2]], [[2, k % 10]]), ([[3]], [[3]])])) for k in range(n)]
    return spark.createDataFrame(rows, f"task_id string, task {TASK}").repartition(3)


def moody(task):
    assert all("output" not in p for p in task["test"]) and set(task) == {"train", "test"}
    k = task["train"][0]["input"][0][0]
    if k == 1:
        raise KeyError("x")
    if k == 2:
        return [[[[1]]]]
    if k == 3:
        return [[[[1]]] * 3, [[[1]]]]
    if k == 4:
        return [[[[1, 2], [3]]], [[[1]]]]
    if k == 5:
        return [[[[True]]], [[[1]]]]
    return [[[p["input"][0][::-1]], p["input"]] for p in task["test"]]


def test_failures_are_rows_of_their_task(spark):
    tasks = frame(spark, 20)
    got = adapters.run_solver(tasks, moody).collect()
    by = {}
    for r in got:
        by.setdefault(r["task_id"], []).append(r)
    assert len(by) == 20 and all(r["seconds"] >= 0 for r in got)
    wanted = {1: "KeyError", 2: "contract:output_count", 3: "contract:attempt_count", 4: "contract:grid", 5: "contract:grid"}
    for k in range(20):
        rows = by[f"t{k}"]
        if k % 10 in wanted:
            assert [(r["error"], r["grid"], r["output_index"]) for r in rows] == [(wanted[k % 10], None, None)]
        else:
            assert sorted((r["output_index"], r["attempt_no"]) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 2)]
            assert {(r["output_index"], r["attempt_no"]): r["grid"] for r in rows}[0, 1] == [[2, k % 10]]
    report = adapters.solver_report(tasks, spark.createDataFrame(got, adapters.RETURNED)).first()
    assert (report["tasks"], report["exact"], report["attempts"]) == (20, 10, 40)
    assert report["errors"] == "KeyError=2,contract:attempt_count=2,contract:grid=4,contract:output_count=2"


def test_no_tasks(spark):
    none = frame(spark, 1).limit(0)
    assert adapters.run_solver(none, moody).count() == 0
    report = adapters.solver_report(none, adapters.run_solver(none, moody)).first()
    assert tuple(report) == (0, 0, 0, "", 0.0)


@pytest.mark.parametrize("returned, code", [(None, "output_count"), ([[]], "attempt_count"), ([[[[0] * 31]]], "grid"), ([[[]]], "grid"), ([[[[0]]]], None), ([[[[1.0]]]], "grid")])
def test_contract(returned, code):
    assert adapters.contract_error(returned, 1, 2) == code


def test_rules_of_a_manifest(spark):
    from dataclasses import replace

    from gridloom.operators import split_manifest

    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    base = split_manifest.Manifest(
        make([(k, "s") for k in range(1, 9)], "record_id int, source string"), make([(1 if k < 5 else 5, k) for k in range(1, 9)], "cluster_id int, record_id int"),
        make([("train", 1), ("audit", 5)], "split string, cluster_id int"), make([(6,)], "record_id int"), make([(5,)], "cluster_id int"), make([], "name string, value string"),
    )
    base = split_manifest.with_declared(base)
    broken = lambda m: {r["rule"] for r in split_manifest.rule_offenders(m, ["train", "audit"]).where(F.col("offenders") > 0).collect()}
    assert broken(base) == set()
    cases = {
        "unknown-flagged": replace(base, flagged=base.flagged.union(make([(77,)], "record_id int"))),
        "cluster-crosses-splits": replace(base, allocation=base.allocation.union(make([("audit", 1)], "split string, cluster_id int"))),
        "declared-digest": replace(base, records=base.records.withColumn("source", F.lit("other"))),
        "flagged-clusters": replace(base, flagged_clusters=make([(1,)], "cluster_id int")),
        "declared-count": replace(base, declared=base.declared.where("name <> 'clusters of train'")),
    }
    for rule, manifest in cases.items():
        assert rule in broken(manifest)
