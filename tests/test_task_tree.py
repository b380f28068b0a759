import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from gridloom.functions import grids
from gridloom.operators import baseline, firewall
from gridloom.schemas import TASK
from gridloom.sources import task_tree, tasks


def named(k):
    """A task whose demonstrations mirror their input; every third has a name that is not ASCII."""
    rows = [[k % 10, 1, 2], [3, (k + 4) % 10, 5]]
    mirrored = [r[::-1] for r in rows]
    return ("n\u00e9" if k % 3 == 0 else None, [(rows, mirrored), (mirrored, rows)], [(rows, mirrored)])


def frame(spark, ids, task=named):
    return spark.createDataFrame([(f"t{k}", task(k)) for k in ids], f"task_id string, task {TASK}").repartition(3)


def plain_file(task):
    name, train, test = task
    value = {"train": [{"input": a, "output": b} for a, b in train], "test": [{"input": a} for a, _ in test]} | ({"name": name} if name else {})
    return (json.dumps(value, indent=2, sort_keys=True) + "\n").encode()


def test_a_tree_is_the_plain_files_and_their_manifest(spark, tmp_path):
    place = str(tmp_path / "tree")
    task_tree.write_tree(frame(spark, range(20)), place, source=str(tmp_path / "labels"), source_id="x:y", tree_format="some-format")
    expected = {f"t{k}.json": plain_file(named(k)) for k in range(20)}
    assert {n: (tmp_path / "tree" / n).read_bytes() for n in os.listdir(place) if n != "MANIFEST"} == expected
    files = [{"path": n, "sha256": hashlib.sha256(b).hexdigest()} for n, b in sorted(expected.items())]
    manifest = {"format": "some-format", "source_id": "x:y", "tasks_total": 20, "files": files}
    assert (tmp_path / "tree" / "MANIFEST").read_bytes() == (json.dumps(manifest, indent=2, sort_keys=True) + "\n").encode()
    assert sorted(map(tuple, task_tree.read_manifest(spark, place).collect())) == [(f["path"], f["sha256"]) for f in files]
    back = tasks.load_tasks(spark, place, require_test_outputs=False)
    assert back.count() == 20 and back.where(F.exists("task.test", lambda p: p["output"].isNotNull())).isEmpty()
    assert os.listdir(tmp_path) == ["tree"]


def test_an_empty_tree(spark, tmp_path):
    place = str(tmp_path / "none")
    task_tree.write_tree(frame(spark, range(1)).limit(0), place)
    expected = {"format": task_tree.FORMAT, "source_id": "redacted", "tasks_total": 0, "files": []}
    assert (tmp_path / "none" / "MANIFEST").read_bytes() == (json.dumps(expected, indent=2, sort_keys=True) + "\n").encode()
    assert task_tree.read_manifest(spark, place).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    place = str(tmp_path / "tree")
    rows = task_tree.tree_rows(frame(spark, range(30)))
    for broken in (
        rows.withColumn("text", F.when(F.col("path") == "t7.json", "no json").otherwise(F.col("text"))),  # a task that dies half way
        rows.withColumn("text", F.when(F.col("path") == "t7.json", '{"test":[{"output":[[1]]}]}').otherwise(F.col("text"))),  # a label that leaks
        rows.union(rows.limit(1)),  # two tasks for one file: found on commit
        rows.withColumn("path", F.concat(F.lit("../"), "path")),
    ):
        with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of it
            broken.write.format("task_tree").mode("append").save(place)
        assert os.listdir(tmp_path) == []


def test_nothing_is_overwritten(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    task_tree.write_tree(frame(spark, range(2)), str(tmp_path / "tree"))  # an empty folder is as good as none
    before = sorted(os.listdir(tmp_path / "tree"))
    with pytest.raises(Exception, match="not empty"):
        task_tree.write_tree(frame(spark, range(3)), str(tmp_path / "tree"))
    with pytest.raises(task_tree.TreeError):
        task_tree.write_tree(frame(spark, range(3)), str(tmp_path / "labels" / "in"), source=str(tmp_path / "labels"))
    with pytest.raises(task_tree.TreeError):
        task_tree.write_tree(frame(spark, range(3)), str(tmp_path / "labels"), source=str(tmp_path / "labels"))
    assert sorted(os.listdir(tmp_path / "tree")) == before == ["MANIFEST", "t0.json", "t1.json"]


def test_the_run_over_two_views(spark, tmp_path):
    given = frame(spark, range(12), lambda k: (None, *named(k)[1:]))
    other = given.select("task_id", grids.mutate_labels(F.col("task")).alias("task"))
    seen = []

    def honest(inputs, view):
        seen.append(view.inputs)
        assert inputs.where(F.exists("task.test", lambda p: p["output"].isNotNull())).isEmpty()
        return baseline.predictions(baseline.rank_candidates(inputs, 2))

    def told(inputs, view):
        return firewall.read_labels(spark, view).select("task_id", F.transform("outputs", lambda g: grids.attempts(F.array(g, g))).alias("outputs"))

    run = lambda name, a, b, solver: tuple(firewall.ab_run(a, b, str(tmp_path / name), solver).first())
    assert run("honest", given, other, honest) == (12, 12, 12, 12, 12, 0, "passed")
    assert seen == [str(tmp_path / "honest" / side / "inputs") for side in "ab"]
    assert run("told", given, other, told) == (12, 12, 12, 0, 12, 12, "failed")
    assert run("same", given, given, honest)[2:] == (0, 12, 12, 12, "failed")  # equal labels prove nothing
    assert run("less", given, other.where("task_id <> 't3'"), honest)[-1] == "failed"
    with pytest.raises(tasks.DatasetError):
        run("none", given.limit(0), other.limit(0), honest)


@pytest.mark.parametrize("value", [[], {}, [[]], {"b": [1, -2, True], "a": {"é": None, "c": [1.5, "x\n", [0]]}}, [[1, 2], [], {}], [True, 1], "s"])
def test_file_bytes_are_those_of_json(value):
    assert task_tree.file_bytes(value) == (json.dumps(value, indent=2, sort_keys=True) + "\n").encode()


def test_several_solvers_share_the_files(spark, tmp_path, monkeypatch):
    """Each view is written once and its files are read once, whatever the number of solvers."""
    calls = []
    for module, name in ((task_tree, "write_tree"), (tasks, "load_tasks")):
        inner = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, inner=inner, name=name, **k: calls.append(name) or inner(*a, **k))
    given = frame(spark, range(5), lambda k: (None, *named(k)[1:]))
    other = given.select("task_id", grids.mutate_labels(F.col("task")).alias("task"))
    views = firewall.prepare(given, other, str(tmp_path / "views"))
    for _ in range(2):
        assert firewall.proof(views, lambda inputs, _: baseline.predictions(baseline.rank_candidates(inputs, 2))).first()["verdict"] == "passed"
    assert sorted(calls) == ["load_tasks"] * 2 + ["write_tree"] * 2


def test_read_tree_reads_its_files_in_tasks_and_shows_what_is_unlike(spark, tmp_path, monkeypatch):
    """Whole files beside their manifest, some in one task's share; no scan of a small file each, and unlisted, changed and missing files show."""
    pair = "struct<input:array<array<int>>,output:array<array<int>>>"
    schema = f"task_id string, task struct<name:string,train:array<{pair}>,test:array<{pair}>>"
    tasks = spark.createDataFrame([(f"t{k}", {"name": None, "train": [([[k]], [[1]])], "test": [([[2]], [[3]])]}) for k in range(9)], schema)
    folder = str(tmp_path / "tree")
    task_tree.write_tree(tasks, folder)
    monkeypatch.setattr(task_tree, "FILES_A_TASK", 2)
    whole = task_tree.read_tree(spark, folder)
    assert whole.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 5)
    assert {(r["path"], r["text"], r["own"] == r["sha256"]) for r in whole.collect()} == {(f"t{k}.json", (tmp_path / f"tree/t{k}.json").read_text(), True) for k in range(9)}
    (tmp_path / "tree/t1.json").write_text("{}")
    (tmp_path / "tree/t2.json").unlink()
    (tmp_path / "tree/more.json").write_text("{}")
    odd = {r["path"]: (r["text"], r["own"] is None, r["sha256"] is None) for r in task_tree.read_tree(spark, folder).collect() if r["own"] != r["sha256"]}
    assert odd == {"t1.json": ("{}", False, False), "t2.json": (None, True, False), "more.json": ("{}", False, True)}


def test_views_are_read_in_tasks(spark, tmp_path, monkeypatch):
    """No scan of single files; an invalid file and a view without files are errors."""
    monkeypatch.setattr(firewall.tasks, "json_files", lambda *_: pytest.fail("files are scanned one by one"))
    pair = ([[1, 2]], [[2, 1]])
    given = spark.createDataFrame([(f"t{k}", (None, [pair], [pair])) for k in range(5)], f"task_id string, task {TASK}")
    view = firewall.write_view(given, str(tmp_path / "v"))
    seen = {r["task_id"]: r["task"] for r in firewall.read_inputs(spark, view).collect()}
    assert sorted(seen) == [f"t{k}" for k in range(5)] and all(t["test"][0]["output"] is None and t["train"][0]["output"] == [[2, 1]] for t in seen.values())
    (tmp_path / "v/inputs/t3.json").write_text('{"train": [], "train": [], "test": []}')
    with pytest.raises(Exception, match="invalid task file"):
        firewall.read_inputs(spark, view)
    with pytest.raises(firewall.tasks.DatasetError):
        firewall.read_inputs(spark, firewall.write_view(given.limit(0), str(tmp_path / "none")))
