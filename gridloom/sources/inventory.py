"""File inventories, digests and small text formats."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests


def inventory(spark: SparkSession, *paths: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, sha256, bytes) of the files at the given places; a file that several of them name is one row.

    Files whose names begin with a dot or an underscore are hidden from Spark's readers and so from the inventory.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return rows.distinct()


def code_inventory(spark: SparkSession, root: str, globs: Sequence[str]) -> DataFrame:
    """(path, sha256, bytes) of the files below a root that any of the globs names, each once, with paths below the root.

    Raises for symbolic links among them (on a local root; stores have none) and
    for a glob without files.
    """
    local = root.removeprefix("file://")
    if "://" not in local:
        links = sorted(str(p) for g in globs for p in Path(local).glob(g) if p.is_symlink())
        if links:
            raise ValueError(f"symbolic links: {', '.join(links[:5])}")
    reader = spark.read.format("binaryFile")
    rows = [reader.load(f"{root.rstrip('/')}/{g}").select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")) for g in globs]
    for g, part in zip(globs, rows, strict=True):
        if part.isEmpty():
            raise ValueError(f"{g}: no files")
    return relative(reduce(DataFrame.union, rows).distinct(), local if "://" not in local else root.partition("://")[2])


def relative(rows: DataFrame, root: str) -> DataFrame:
    """Paths below root."""
    pattern = "^(?:file:/*)?/*" + "/".join(re.escape(p) for p in root.strip("/").split("/")) + "/"
    return rows.withColumn("path", F.regexp_replace("path", pattern, ""))


def tree_digest(rows: DataFrame) -> DataFrame:
    """One row: SHA-256 over the canonical JSON list of (bytes, path, sha256), in path order; streamed, see digests."""
    sums = rows.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sums.crossJoin(digests.json_list(rows, [], [F.col("path")], F.struct("bytes", "path", "sha256")).select("digest"))  # one row each


def leaves(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    return rows.join(excluded.select("path"), "path", "left_anti")


def challenge_view_errors(manifest: DataFrame, observed: DataFrame, tasks: DataFrame, expected_tasks: int | None = None) -> DataFrame:
    """(path, error) of an inference view: manifest (path, sha256) against files, any hidden test output, and another number of tasks than expected."""
    both = manifest.select("path", F.col("sha256").alias("declared")).join(observed.select("path", "sha256"), "path", "full")
    files = both.select("path", F.when(F.col("sha256").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").when(F.col("sha256") != F.col("declared"), "mismatch").alias("error"))
    labelled = tasks.select("path", F.when(F.exists("task.test", lambda p: p["output"].isNotNull()), "hidden-output").alias("error"))
    found = files.union(labelled)
    if expected_tasks is not None:
        found = found.union(tasks.agg(F.lit("*").alias("path"), F.when(F.count("*") != expected_tasks, "task-count").alias("error")))
    return found.where("error is not null")


def git_tree(payload: DataFrame, column: str = "payload") -> DataFrame:
    """(mode, kind, oid, path) of a NUL-separated recursive tree listing."""
    entry = payload.select(F.explode(F.split(column, "\\x00")).alias("e")).where("e <> ''")
    pattern = r"(?s)^(\d{6}) (\w+) ([0-9a-f]{40,64})\t(.*)\z"
    return entry.select(*[F.regexp_extract("e", pattern, k).alias(n) for k, n in enumerate(("mode", "kind", "oid", "path"), 1)])


def blob_oid(content: str = "content") -> Column:
    """The git object id of a file's bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.char(F.lit(0))), "UTF-8"), F.col(content)))


def extensions(rows: DataFrame) -> DataFrame:
    """(extension, n): a name's last suffix, `.x` for a dotfile's whole name, <none> without a dot."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    suffix = F.regexp_extract(name, r"(\.[^.]+)\z", 1)
    return rows.groupBy(F.when(suffix == "", "<none>").otherwise(F.lower(suffix)).alias("extension")).agg(F.count("*").alias("n"))


def gpu_processes(lines: DataFrame, pid: int) -> DataFrame:
    """One row for a GPU tool's CSV (uuid, pid, name, MiB): bytes of one process, and rows that can't be read."""
    parts = F.split(F.col("value"), r"\s*,\s*")
    rows = lines.where(F.trim("value") != "").select(F.get(parts, 1).try_cast("int").alias("pid"), F.get(parts, F.size(parts) - 1).try_cast("long").alias("mib"), F.size(parts).alias("n"))
    bad = (F.col("n") < 4) | F.col("pid").isNull() | F.col("mib").isNull()
    return rows.agg(F.sum(F.when(~bad & (F.col("pid") == pid), F.col("mib") * 1048576)).alias("bytes"), F.count_if(bad).alias("unreadable"))


def mounts(lines: DataFrame) -> DataFrame:
    """(mount_id, root, mount_point, fs_type, options) of mountinfo lines."""
    halves = F.split("value", " - ", 2)
    left, right = F.split(F.get(halves, 0), " "), F.split(F.get(halves, 1), " ")
    return lines.select(F.get(left, 0).try_cast("int").alias("mount_id"), F.get(left, 3).alias("root"), F.get(left, 4).alias("mount_point"), F.get(right, 0).alias("fs_type"), F.split(F.get(right, 2), ",").alias("options"))


def memberships(lines: DataFrame) -> DataFrame:
    """(hierarchy, controllers, path) of cgroup lines; the unified hierarchy is 0 and has no controllers."""
    parts = F.split("value", ":", 3)
    names = F.filter(F.split(F.get(parts, 1), ","), lambda c: c != "")
    return lines.where("value <> ''").select(F.get(parts, 0).try_cast("int").alias("hierarchy"), names.alias("controllers"), F.get(parts, 2).alias("path"))


def cgroup_mounts(mount_rows: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Memberships with their mount: unified by type, older ones by a common controller. Both sides are a few lines of one host."""
    v2 = (F.col("fs_type") == "cgroup2") & (F.col("hierarchy") == 0) & (F.size("controllers") == 0)
    v1 = (F.col("fs_type") == "cgroup") & F.arrays_overlap("options", "controllers")
    return member_rows.join(F.broadcast(mount_rows), v2 | v1)


def requirement_lines(lines: DataFrame) -> DataFrame:
    """Requirement lines without comments, blanks and options."""
    text = F.trim(F.regexp_replace("value", r"(^|\s)#.*\z", ""))
    return lines.select(text.alias("requirement")).where("requirement <> '' and not startswith(requirement, '-')")


def submodules(text: DataFrame, column: str = "text") -> DataFrame:
    """(name, path, url) of a .gitmodules text."""
    block = text.select(F.explode(F.regexp_extract_all(column, F.lit(r'(?s)\[submodule "[^"]+"\][^\[]*'), F.lit(0))).alias("b"))
    return block.select(F.regexp_extract("b", r'\[submodule "([^"]+)"\]', 1).alias("name"), *[F.regexp_extract("b", rf"(?m)^\s*{k}\s*=\s*(\S+)", 1).alias(k) for k in ("path", "url")])


def yaml_scalar(text: Column, key: str) -> Column:
    """The scalar of a top-level key of a YAML text, without quotes or a comment; null where there is none."""
    line = rf"(?m)^{re.escape(key)}:[ \t]*"
    quoted = F.regexp_extract(text, line + r"(?:\"([^\"]*)\"|'([^']*)')[ \t]*(?:#.*)?$", 0)
    inside = F.regexp_extract(quoted, r"(?s):[ \t]*[\"'](.*)[\"'][^\"']*\z", 1)
    plain = F.regexp_extract(text, line + r"([^\s#\"'][^#\n]*?)[ \t]*(?:#.*)?$", 1)
    return F.when(quoted != "", inside).when(plain != "", plain)
