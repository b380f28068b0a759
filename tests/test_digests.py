import hashlib
import json
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from gridloom.operators import digests
from gridloom.sources import inventory


def test_lists_are_hashed_whole_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), k, f"\u00e9\"{k}\n" if k % 3 else "x") for k in range(700)] + [(None, 1, "n"), (None, 0, "m"), ("a", 900, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(5)
    expected = {}
    for g, _, t in sorted(rows, key=lambda r: r[1]):
        expected.setdefault(g, [])
        if t is not None:
            expected[g].append(t)
    whole = lambda items: hashlib.sha256(json.dumps(items, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    got = {r["g"]: (r["n"], r["digest"]) for r in digests.json_list(df.where("t is not null"), ["g"], [F.col("k")], F.col("t")).collect()}
    assert got == {g: (len(x), whole(x)) for g, x in expected.items()}
    for part in (df.where("g = 'b'"), df.limit(0)):
        items = [t for g, _, t in sorted(rows, key=lambda r: r[1]) if g == "b"] if part.count() else []
        assert tuple(digests.json_list(part, [], [F.col("k")], F.col("t")).first()) == (len(items), whole(items))


def test_a_tree_listing(spark):
    rows = [("b/x", 3, "22"), ("a", 1, "11"), ("b", 2, "33")]
    item = [{"bytes": n, "path": p, "sha256": s} for p, n, s in sorted(rows)]
    got = inventory.tree_digest(spark.createDataFrame(rows, "path string, bytes long, sha256 string").repartition(2)).first()
    assert tuple(got) == (3, 6, hashlib.sha256(json.dumps(item, separators=(",", ":")).encode()).hexdigest())


def test_git_tree_matches_git(spark, tmp_path):
    if not shutil.which("git"):
        pytest.skip("git is not here")
    for name in ("a.txt", "b/c/d.txt", "b/e", "b.txt", "b-f/g", "z", "q/r/s/t/u"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, text=True, check=True).stdout
    git("init", "-q")
    git("add", "-A")
    tree = git("write-tree").strip()
    rows = [("one", r[3], r[0], r[1]) for r in (line.split(maxsplit=3) for line in git("ls-files", "-s").splitlines())]
    schema = "repository string, path string, mode string, oid string"
    flat = [("two", "a.txt", "100644", rows[0][3])]
    alone = hashlib.sha1(b"tree 33\x00100644 a.txt\x00" + bytes.fromhex(rows[0][3])).hexdigest()
    got = {r["repository"]: r["oid"] for r in digests.tree_oids(spark.createDataFrame(rows + flat, schema).repartition(3)).collect()}
    assert got == {"one": tree, "two": alone}
    assert digests.tree_oids(spark.createDataFrame([], schema)).count() == 0
    for twice in ([("r", "a", "100644", "0" * 40), ("r", "a/b", "100644", "0" * 40)], [("r", "a", "100644", "0" * 40)] * 2):
        with pytest.raises(ValueError, match="two entries"):
            digests.tree_oids(spark.createDataFrame(twice, schema))


def test_prefixed_digest(spark):
    files = [("r", "b/x", b"2"), ("r", "a", b"1"), ("r", "b.y", b"")]
    expected = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in (b"a", b"1", b"b/x", b"2", b"b.y", b""))).hexdigest()
    got = digests.length_prefixed(spark.createDataFrame(files, "repository string, path string, content binary"), ["repository"]).first()
    assert (got["n"], got["digest"]) == (3, expected)  # parts of a path sort as parts
