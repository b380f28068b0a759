import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evidence, ledgers, protocol, shared, splits, stats
from gridloom.sources import inventory


def test_selection_takes_each_id_once_and_says_why(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(f"t{k:03d}", rng.choice("abcde")) for k in range(200)], "id string, stratum string")
    rows = splits.select_in_turn([("x", items.where("id < 't120'"), 20), ("y", items, 30)], "id", "stratum", "d", 1).collect()
    chosen = [r["id"] for r in rows if r["selected"]]
    assert len(chosen) == len(set(chosen)) == 50 and len(rows) == 320
    taken = {r["id"] for r in rows if r["selected"] and r["benchmark"] == "x"}
    for r in rows:
        excluded = r["benchmark"] == "y" and r["id"] in taken
        assert r["decision_reason"] == ("excluded-selected-elsewhere" if excluded else "selected" if r["selected"] else "not-selected")
        assert (r["population"] is None) == excluded and r["eligible"] != excluded


def test_quotas_beyond_the_population_fail(spark):
    items = spark.createDataFrame([("a", "s"), ("b", "s")], "id string, stratum string")
    with pytest.raises(Exception, match="exceeds its population"):
        splits.stratified_quota(items, "id", "stratum", 3, "d", 1, "b").collect()
    with pytest.raises(ValueError):
        splits.stratified_quota(items, "id", "stratum", 0, "d", 1, "b")
    with pytest.raises(ValueError, match="no colour map"):
        splits.color_maps("d", [1, 1, 1], salts=1)


def test_order_index_and_preview(spark):
    names = [f"n{k}" for k in random.Random(4).sample(range(1000), 300)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    assert {r["name"]: r["order_index"] for r in splits.order_index(df, "name").collect()} == {n: k for k, n in enumerate(sorted(names))}
    row = splits.preview(df.union(df), "name", 3).first()
    assert (row["n"], row["first"]) == (300, sorted(names)[:3])


def test_readiness_of_a_frozen_protocol(spark):
    gates = spark.createDataFrame([("a", "passed", True), ("b", "pending", False)], "id string, status string, required boolean")
    none = spark.createDataFrame([], "gate_id string")
    row = protocol.readiness(gates, none, frozen=True).first()
    assert row["freeze_ready"] and row["unresolved_agrees"] and row["gate_status_counts"] == {"blocked": 0, "in_progress": 0, "passed": 1, "pending": 1}
    assert not protocol.readiness(gates, none, frozen=False).first()["freeze_ready"]
    extra = spark.createDataFrame([("b",)], "gate_id string")
    assert not protocol.readiness(gates, extra, frozen=True).first()["unresolved_agrees"]


def test_distributed_fits_equal_local_ones(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        for c in range(30):
            for _ in range(8):
                x = round(float(rng.normal()), 1)
                rows.append((f"g{g}", c, 1.0, x, int(rng.random() < 1 / (1 + np.exp(-(0.3 * g + x))))))
    rows += [("all", c, 1.0, 0.5, 1) for c in range(9)] + [("few", 1, 1.0, 0.1 * k, k % 2) for k in range(9)] + [("flat", c, 1.0, 2.0, c % 2) for c in range(9)]
    found = stats.grouped_logistic(spark.createDataFrame(rows, "g string, c int, one double, x double, y int").repartition(4), "g", "y", ["one", "x"], "c")
    assert {g: r["status"] for g, r in found.items()} == {"g0": "ok", "g1": "ok", "g2": "ok", "all": "separation", "few": "insufficient-clusters", "flat": "singular-design"}
    for g in ("g0", "g1", "g2"):
        mine = [r for r in rows if r[0] == g]
        local = stats.logistic_gee(np.array([[r[2], r[3]] for r in mine]), np.array([r[4] for r in mine], float), np.array([r[1] for r in mine]))
        assert found[g]["coefficients"] == pytest.approx(local["coefficients"]) and found[g]["covariance"] == pytest.approx(local["covariance"])


def test_draws_are_pythons(spark):
    for seed in (0, 7, 2**70):
        plain, mine = random.Random(seed), stats.Draws(seed)
        assert [plain.random() for _ in range(50)] == mine.uniform(50).tolist()
        assert [plain.getrandbits(1) for _ in range(50)] == mine.bits(50).tolist()
        assert [plain.randrange(37) for _ in range(500)] == next(mine.below(37))[:500].tolist()


def test_locked_manifest_refuses_changes(spark, tmp_path):
    import hashlib

    path = tmp_path / "m.json"
    body = '{"a":[1,2]}'
    text = '{"a":[1,2],"manifest_sha256":"%s"}' % hashlib.sha256(body.encode()).hexdigest()
    path.write_text(text)
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert ledgers.load_locked_manifest(spark, str(path), digest) == {"a": [1, 2]}
    with pytest.raises(ValueError, match="file-digest"):
        ledgers.load_locked_manifest(spark, str(path), "0" * 64)
    path.write_text(text.replace("[1,2]", "[1,3]"))
    with pytest.raises(ValueError, match="manifest_sha256"):
        ledgers.load_locked_manifest(spark, str(path), hashlib.sha256(path.read_bytes()).hexdigest())


def test_links_are_refused(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    assert [r["path"] for r in inventory.code_inventory(spark, str(tmp_path), ["*.py"]).collect()] == ["a.py"]
    (tmp_path / "b.py").symlink_to(tmp_path / "a.py")
    with pytest.raises(ValueError, match="symbolic links"):
        inventory.code_inventory(spark, str(tmp_path), ["*.py"])


def test_macro_micro_and_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1), ("b", None)], "g string, v int")
    row = evidence.macro_micro(df, "g", "v").first()
    assert (row["macro"], row["micro"], row["groups"]) == (pytest.approx(2.5 / 3), 0.75, 3)
    assert sorted((r["g"] or "", r["n"]) for r in evidence.totals(df, "g").collect()) == [("", 1), ("a", 2), ("b", 2), ("total", 5)]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(Session())
    assert shared.folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared.written(spark.range(3)).agg(F.sum("id")).first()[0] == 3
