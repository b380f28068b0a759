import json
import os

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.functions import validation
from gridloom.operators import evidence, manifests, resources, splits, variants
from gridloom.schemas import TASK
from gridloom.sources import inventory, sinks, tasks

MULTI = {"train": [{"input": [[4, 7]], "output": [[7, 4]]}], "test": [{"input": [[5, 4, 7]], "output": [[7, 4, 5]]}, {"input": [[7], [4]], "output": [[9], [4]]}]}
PREDICTIONS = {"multi": [{"attempt_1": [[7, 4, 5]]}, {"attempt_1": [[9], [0]], "attempt_2": [[9], [4]]}]}


@pytest.fixture
def dataset(tmp_path):
    folder = tmp_path / "data" / "evaluation"
    folder.mkdir(parents=True)
    (folder / "multi.json").write_text(json.dumps(MULTI))
    (tmp_path / "predictions.json").write_text(json.dumps(PREDICTIONS))
    return tmp_path


BAD = {
    "duplicate": '{"train": [], "train": [], "test": []}',
    "ragged": json.dumps(MULTI | {"train": [{"input": [[0], [0, 1]], "output": [[1]]}]}),
    "boolean": json.dumps(MULTI | {"train": [{"input": [[True]], "output": [[1]]}]}),
    "float": json.dumps(MULTI | {"train": [{"input": [[1.0]], "output": [[1]]}]}),
    "range": json.dumps(MULTI | {"train": [{"input": [[10]], "output": [[1]]}]}),
    "name": json.dumps(MULTI | {"name": "other"}),
    "key": json.dumps(MULTI | {"extra": 1}),
    "pairkey": json.dumps(MULTI | {"train": [{"input": [[1]], "output": [[1]], "x": 1}]}),
    "missing": json.dumps({"train": MULTI["train"]}),
    "empty": json.dumps(MULTI | {"train": []}),
    "nooutput": json.dumps(MULTI | {"train": [{"input": [[1]]}]}),
    "wide": json.dumps(MULTI | {"train": [{"input": [[0] * 31], "output": [[1]]}]}),
}


def test_every_defect_is_an_error(spark, tmp_path):
    for name, text in (BAD | {"good": json.dumps(MULTI | {"name": "good"})}).items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["task_id"]: r["errors"] for r in tasks.load_tasks(spark, str(tmp_path)).collect()}
    assert got.pop("good") == []
    assert all(got.values()), got
    assert got["duplicate"] == ["strict_json"] and "name_is_not_stem" in got["name"] and "unknown_key" in got["key"] and "train_unknown_key" in got["pairkey"]
    row = tasks.batch_validate(tasks.load_tasks(spark, str(tmp_path))).first()
    assert (row["files"], row["invalid"]) == (len(BAD) + 1, len(BAD))


def test_unlabelled_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(MULTI | {"test": [{"input": [[1]]}]}))
    assert tasks.load_tasks(spark, str(tmp_path)).first()["errors"] == ["test_output"]
    assert tasks.load_tasks(spark, str(tmp_path), require_test_outputs=False).first()["errors"] == []
    (tmp_path / "t.json").write_text(json.dumps(MULTI | {"test": [{"input": [[1]], "output": [[11]]}]}))
    assert tasks.load_tasks(spark, str(tmp_path), require_test_outputs=False).first()["errors"] == ["test_output"]


def test_prediction_errors(spark, tmp_path):
    bad = {"guess": [{"guess_1": [[1]]}], "gap": [{"attempt_2": [[1]]}], "zero": [{"attempt_01": [[1]]}], "none": [{}], "grid": [{"attempt_1": [[1], [1, 2]]}], "count": [{"attempt_1": [[1]]}] * 2, "typo": [{"attempt_1": [[1]]}], "fine": [{"attempt_1": [[1]], "attempt_2": [[1]]}]}
    (tmp_path / "p.json").write_text(json.dumps(bad))
    answers = spark.createDataFrame([(k, 0, [[1]]) for k in bad if k != "typo"], "task_id string, output_index int, expected array<array<int>>")
    got = {r["task_id"]: r["errors"] for r in tasks.prediction_errors(tasks.load_predictions(spark, str(tmp_path / "p.json")), answers).collect()}
    assert set(got) == set(bad) - {"fine"}
    assert got["gap"] == ["attempt_gap"] and got["count"] == ["output_count"] and got["typo"] == ["unknown_task"] and got["grid"] == ["grid"]


def test_command_line(spark, dataset, capsys):
    folder = str(dataset / "data" / "evaluation")
    assert cli.main(["validate", folder], spark) == 0
    assert cli.main(["score", str(dataset / "predictions.json"), folder, "--top-k", "1", "--json"], spark) == 0
    one = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (one["outputs_exact"], one["tasks_exact"], one["cells_correct"], one["cells_total"]) == (1, 0, 4, 5)
    assert cli.main(["list", str(dataset / "data")], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "total\t1"
    assert cli.main(["baseline", folder, "--score", "--output", str(dataset / "out.json")], spark) == 0
    assert set(json.loads((dataset / "out.json").read_text())) == {"multi"}
    assert cli.main(["challenge", folder, str(dataset / "challenge")], spark) == 0
    assert "output" not in json.loads((dataset / "challenge" / "multi.json").read_text())["test"][0]
    assert cli.main(["challenge", folder, folder + "/inside"], spark) == 2
    (dataset / "bad").mkdir()
    (dataset / "bad" / "x.json").write_text("{}")
    assert cli.main(["validate", str(dataset / "bad")], spark) == 1


def test_training_source(spark, tmp_path):
    folder = tmp_path / "training"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(MULTI))
    assert tasks.load_training_source(spark, "s", str(folder), 1).first()["record_id"] == "s:a"
    for path, n in ((str(folder), 2), (str(tmp_path), 1)):
        with pytest.raises(tasks.DatasetError):
            tasks.load_training_source(spark, "s", path, n)


def test_inventory_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "none").write_text("two")
    (tmp_path / "b" / ".dot").write_text("hidden")
    rows = inventory.relative(inventory.inventory(spark, str(tmp_path)), str(tmp_path))
    assert {r["path"]: r["bytes"] for r in rows.collect()} == {"a.txt": 3, "b/none": 3}
    assert inventory.tree_digest(rows).first()["files"] == 2
    assert {r["extension"]: r["n"] for r in inventory.extensions(rows).collect()} == {".txt": 1, "<none>": 1}
    target = str(tmp_path / "doc.json")
    sinks.write_document(target, {"b": 1, "a": "é"})
    assert open(target, encoding="utf-8").read() == '{\n  "a": "é",\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        sinks.write_document(target, {}, clobber=False)
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b", "doc.json"]
    view = inventory.challenge_view_errors(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string"), spark.createDataFrame([("a", "9"), ("c", "3")], "path string, sha256 string"), spark.createDataFrame([("a", (None, [], [([[1]], [[2]])]))], f"path string, task {TASK}"))
    assert {tuple(r) for r in view.collect()} == {("a", "mismatch"), ("b", "missing"), ("c", "undeclared"), ("a", "hidden-output")}


def test_text_formats(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    row = inventory.gpu_processes(lines("GPU-1, 123, worker, 24", "GPU-2, 123, worker, 6", "GPU-1, 9, other, 1", "broken"), 123).first()
    assert tuple(row) == (30 * 1048576, 1)
    mounts = inventory.mounts(lines("30 23 0:26 / /sys/fs/cgroup rw,nosuid - cgroup2 cgroup rw", "31 23 0:27 / /sys/fs/cgroup/cpu rw - cgroup cgroup rw,cpu"))
    members = inventory.memberships(lines("0::/user.slice", "4:cpu,cpuacct:/x", "5:memory:/y"))
    assert {(r["hierarchy"], r["mount_id"]) for r in inventory.cgroup_mounts(mounts, members).collect()} == {(0, 30), (4, 31)}
    tree = inventory.git_tree(spark.createDataFrame([("100644 blob " + "a" * 40 + "\tx y.py\x00040000 tree " + "b" * 40 + "\td\x00",)], "payload string"))
    assert [(r["kind"], r["path"]) for r in tree.collect()] == [("blob", "x y.py"), ("tree", "d")]
    assert [r[0] for r in inventory.requirement_lines(lines("a==1  # why", "", "# c", "-r x", "b")).collect()] == ["a==1", "b"]
    assert tuple(inventory.submodules(spark.createDataFrame([('[submodule "m"]\n\tpath = p/m\n\turl = https://h/m\n',)], "text string")).first()) == ("m", "p/m", "https://h/m")


def test_paths_rules_and_secrets(spark):
    df = spark.createDataFrame([("a/b",), ("",), ("/a",), ("a\\b",), ("C:x",), ("a/../b",), (".",), ("a//b",), (None,)], "p string")
    got = [r[0] for r in df.select(validation.repo_path_error(F.col("p"))).collect()]
    assert got == [None, "empty", "absolute", "separator", "drive", "component", "root", "component", "empty"]
    rules = [{"glob": "a/*/x.json", "tier": "deep"}, {"glob": "a/[!b]?", "tier": "two"}, {"glob": "*", "tier": "rest"}]
    df = spark.createDataFrame([("a/1/2/x.json",), ("a/cd",), ("a/bd",)], "p string")
    assert [r[0] for r in df.select(evidence.first_rule(F.col("p"), rules, "tier")).collect()] == ["deep", "two", "rest"]
    df = spark.createDataFrame([("key sk-" + "a" * 20,), ("ask-me",), ("-----BEGIN RSA PRIVATE KEY-----",)], "t string")
    assert [r[0] for r in df.select(validation.looks_secret(F.col("t"))).collect()] == [True, False, True]


def test_gates(spark):
    docs = spark.createDataFrame([("a/run.json", '{"status":"passed","n":1,"x/y":[null]}')], "path string, text string")
    rows = [("g1", "a/run.json", "/status", '"passed"'), ("g1", "a/run.json", "/n", "1"), ("g2", "a/run.json", "/status", '"passed"'), ("g3", "a/run.json", "/n", "true"), ("g4", "a/run.json", "/x~1y/0", "null"), ("g5", "a/run.json", "/none", "null")]
    results = evidence.evaluate_assertions(spark.createDataFrame(rows, "gate_id string, path string, pointer string, equals string"), docs)
    assert [r["passed"] for r in results.orderBy("gate_id", "pointer").collect()] == [True, True, True, False, True, False]
    gates = spark.createDataFrame([(f"g{k}", "passed", True) for k in range(1, 7)] + [("g7", "blocked", True)], "id string, status string, required boolean")
    got = {r["id"]: (r["errors"], r["unmet"]) for r in evidence.gate_readiness(gates, results).collect()}
    assert got["g1"] == ([], False) and got["g2"][0] == ["status-only"] and got["g3"][0] == ["assertion-failed"] and got["g6"][0] == ["no-assertion"] and got["g7"] == ([], True)


def test_manifests_and_funnels(spark):
    t = spark.createDataFrame([("b", "s", "0123abcd"), ("b", "s", "bad"), ("b", "t", "0123abcd")], "benchmark string, split string, task_id string")
    expected = spark.createDataFrame([("b", "s", 3), ("b", "u", 1)], "benchmark string, split string, n int")
    assert {(r["split"], r["error"]) for r in manifests.benchmark_errors(t, expected).collect()} == {("s", "count"), ("s", "id-format"), ("t", "unknown-split"), ("u", "missing-split"), (None, "crosses-splits:0123abcd")}
    policies = spark.createDataFrame([("p/r1/run.json", "m", "x", "s", ["method_id", "runner", "scope", "status", "run_id", "manifest"])], "path string, method_id string, runner string, scope string, allowed array<string>")
    run = {"method_id": "m", "runner": "x", "scope": "s", "status": "passed", "run_id": "r1", "manifest": {}}
    for change, errors in (({}, []), ({"extra": 1}, ["unknown-field"]), ({"run_id": "r2"}, ["run-id"]), ({"runner": "y"}, ["identity:runner"])):
        rows = spark.createDataFrame([("p/r1/run.json", json.dumps(run | change))], "path string, text string")
        assert manifests.control_plane_errors(rows, policies).first()["errors"] == errors


def test_usage_and_variants(spark):
    samples = spark.createDataFrame([("r", 0, 1.0, 0.5, None, 10, None), ("r", 1, 3.5, 2.0, 7, 20, 5), ("r", 2, 4.0, 2.5, 6, 30, None)], "run_id string, sample_no int, monotonic_seconds double, process_cpu_seconds double, current_rss_bytes long, process_peak_rss_bytes long, gpu_memory_bytes long")
    row = resources.usage(samples).first()
    assert (row["wall_time_seconds"], row["process_cpu_seconds"], row["sampled_peak_current_rss_bytes"], row["current_rss_bytes"], row["sampled_peak_gpu_memory_bytes"]) == (3.0, 2.0, 7, 6, 5)
    pair = ([[1, 2, 3], [0, 4, 5]], [[1], [2]])
    many = [(f"t{k}", k, (None, [pair] * (1 + k % 4), [([[1, 2]], [[3]])] * (1 + k % 3))) for k in range(16)]
    made = variants.design(spark.createDataFrame(many, f"task_id string, idx int, task {TASK}"), splits.color_maps("d", [1, 2, 3, 4]))
    assert made.where("not round_trip").count() == 0
    counts = {r["task_id"]: r["n"] for r in made.groupBy("task_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {f"t{k}": 16 + 2 * (1 + k % 4 >= 3) + (1 + k % 3 >= 2) + (1 + k % 3 >= 3) for k in range(16)}
    assert {r["n"] for r in variants.latin_balance(made).collect()} == {4}
    row = variants.mutation_audit(spark.createDataFrame([(a, t) for a, _, t in many[:3]], f"task_id string, task {TASK}")).first()
    assert row["differing"] == 0


def test_one_category_of_variants_is_as_among_all(spark):
    """Asked for alone, a category's variants are those that all of them hold; the others are not made."""
    pair = ([[1, 2, 3], [0, 4, 5]], [[1], [2]])
    many = spark.createDataFrame([(f"t{k}", k, (None, [pair] * (1 + k), [([[1, 2]], [[3]])] * (1 + k))) for k in range(4)], f"task_id string, idx int, task {TASK}")
    maps = splits.color_maps("d", [1, 2, 3, 4])
    rows = lambda df: sorted(map(str, df.collect()))
    whole = variants.design(many, maps)
    for category in ("d4_only", "color_only", "d4_plus_color", "demonstration_order", "test_order"):
        assert rows(variants.design(many, maps, only=category)) == rows(whole.where(F.col("category") == category))
