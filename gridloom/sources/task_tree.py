"""A Spark sink for trees of task files with a manifest: all of it appears, or none.

Tasks of the write put their files into a staging folder beside the destination,
each file under another name first and then renamed, so a second attempt of a
task replaces whole files by equal ones. On commit the manifest is merged from
the tasks' own sorted lists, one line of each in memory, and the staging folder
becomes the destination by one rename. A write that fails takes its staging
folder with it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import grids
from ..operators import shared

FILES_A_TASK = 2000
LISTS = ".lists"  # the tasks' own lists, gone before the tree is in place
FORMAT = "challenge-tree-v1"


class TreeError(ValueError):
    """A tree that must not be written."""


def file_bytes(value: Any) -> bytes:
    """Pretty JSON, keys in order, ASCII, with a last newline."""
    return (_pretty(value, "\n") + "\n").encode()


def _pretty(value: Any, line: str) -> str:
    """What json.dumps gives with an indent of two; it takes a Python step for each number, this one for each row."""
    inner = f"{line}  "
    if isinstance(value, list) and value:
        parts = map(repr, value) if all(type(x) is int for x in value) else (_pretty(x, inner) for x in value)
        return f"[{inner}{f',{inner}'.join(parts)}{line}]"
    if isinstance(value, dict) and value:
        return f"{{{inner}{f',{inner}'.join(f'{json.dumps(k)}: {_pretty(value[k], inner)}' for k in sorted(value))}{line}}}"
    return json.dumps(value)


def _inside(path: str, parent: str) -> bool:
    return (path.rstrip("/") + "/").startswith(parent.rstrip("/") + "/")


@dataclass
class Written(WriterCommitMessage):
    """What a task of the write has put down: its list's name, and the number of its files."""

    name: str
    files: int


class TreeWriter(DataSourceWriter):
    """Rows (path, text): text is a task's JSON, path its place in the tree."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.destination = options["path"].rstrip("/")
        self.source_id, self.format = options.get("source_id", "redacted"), options.get("format", FORMAT)
        self.staging = f"{self.destination.rpartition('/')[0]}/.{self.destination.rpartition('/')[2]}.{uuid.uuid4().hex}"
        missing = {"path", "text"} - set(schema.names)
        if missing:
            raise TreeError(f"columns missing: {sorted(missing)}")
        from pyarrow.fs import FileSelector

        fs, path = self._place(self.destination)
        if fs.get_file_info(FileSelector(path, allow_not_found=True)):
            raise TreeError(f"{self.destination}: not empty")

    @staticmethod
    def _place(uri: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(uri)

    def _put(self, fs, path: str, payload: bytes) -> None:
        parent = path.rpartition("/")[0]
        if parent not in self.made:
            fs.create_dir(parent, recursive=True)
            self.made.add(parent)
        fresh = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as out:
            out.write(payload)
        fs.move(fresh, path)

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = self._place(self.staging)
        self.made = set()
        lines = []
        for row in iterator:
            path = row["path"]
            if not path or path.startswith("/") or any(part in ("", ".", "..") or part.startswith(".") for part in path.split("/")) or path == "MANIFEST":
                raise TreeError(f"no place in a tree: {path!r}")
            task = json.loads(row["text"])
            payload = file_bytes(task)
            self._put(fs, f"{root}/{path}", payload)
            with fs.open_input_stream(f"{root}/{path}") as back:
                again = back.read()
            if again != payload or any("output" in pair for pair in task.get("test", [])):
                raise TreeError(f"{path}: the written file is not the label-free task")
            lines.append([path.split("/"), hashlib.sha256(payload).hexdigest()])
        name = uuid.uuid4().hex
        self._put(fs, f"{root}/{LISTS}/{name}", "".join(json.dumps(x) + "\n" for x in sorted(lines)).encode())
        return Written(name, len(lines))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self._place(self.staging)
        done = [m for m in messages if isinstance(m, Written)]
        with ExitStack() as held, fs.open_output_stream(f"{root}/MANIFEST") as out:
            lists = [held.enter_context(fs.open_input_stream(f"{root}/{LISTS}/{m.name}")) for m in done]
            before, total = None, 0
            out.write(b'{\n  "files": [')
            for parts, sha256 in heapq.merge(*map(_lines, lists)):
                if parts == before:
                    raise TreeError(f"two tasks for {'/'.join(parts)}")
                entry = json.dumps({"path": "/".join(parts), "sha256": sha256}, indent=2, sort_keys=True).replace("\n", "\n    ")
                out.write(f"{',' if total else ''}\n    {entry}".encode())
                before, total = parts, total + 1
            rest = json.dumps({"format": self.format, "source_id": self.source_id, "tasks_total": total}, indent=2, sort_keys=True)
            out.write((("\n  " if total else "") + "]," + rest[1:] + "\n").encode())
        fs.delete_dir(f"{root}/{LISTS}")
        target = self._place(self.destination)[1]
        from pyarrow.fs import FileType

        if fs.get_file_info(target).type == FileType.Directory:
            fs.delete_dir(target)  # it was found empty
        fs.move(root, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self._place(self.staging)
        from pyarrow.fs import FileType

        if fs.get_file_info(root).type == FileType.Directory:
            fs.delete_dir(root)


def _lines(stream) -> Iterator[list]:
    """The entries of a sorted list, some kilobytes at a time."""
    rest = b""
    while chunk := stream.read(1 << 16):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from map(json.loads, whole)


class TaskTree(DataSource):
    """df.write.format("task_tree").option("source_id", ...).mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "task_tree"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise TreeError("a tree is never overwritten")
        return TreeWriter(dict(self.options), schema)


def tree_rows(tasks: DataFrame) -> DataFrame:
    """(path, text): the label-free tasks (task_id, task) as files; absent names and outputs are left out."""
    return tasks.select(F.concat("task_id", F.lit(".json")).alias("path"), F.to_json(grids.challenge_only(F.col("task"))).alias("text"))


def write_tree(tasks: DataFrame, destination: str, source: str = "", source_id: str = "redacted", tree_format: str = FORMAT) -> None:
    """Label-free files and their manifest in a folder that is empty or not there, and not below the source."""
    if source and _inside(destination, source):
        raise TreeError("the destination lies inside the source")
    tasks.sparkSession.dataSource.register(TaskTree)
    tree_rows(tasks).write.format("task_tree").option("source_id", source_id).option("format", tree_format).mode("append").save(destination)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of a tree's manifest, an entry a record: it is split like any text, so it may be of any length."""
    entries = spark.read.text(f"{folder}/MANIFEST", lineSep="    {\n")
    path = F.regexp_extract("value", r'\A\s*"path": ("(?:[^"\\]|\\.)*")', 1)
    rows = entries.select(path.alias("p"), F.regexp_extract("value", r'"sha256": "([0-9a-f]{64})"', 1).alias("sha256")).where("p <> ''")
    return rows.select(F.from_json(F.concat(F.lit('{"p":'), "p", F.lit("}")), "p string")["p"].alias("path"), "sha256")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, own, sha256) of a tree's task files and its manifest: own is the file's digest, sha256 the listed one.

    A file that is not listed has no sha256, a listed one that is not there no text. Only
    names pass one task, as in any flat folder; the files are read by tasks of FILES_A_TASK.
    """
    import pyarrow as pa

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        for _ in batches:
            fs, root = FileSystem.from_uri(folder)
            found = [f.path[len(root.rstrip("/")) + 1 :] for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and f.path.endswith(".json")]
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 10_000], pa.string())], names=["path"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, raw = b.slice(at, 256), []
                for path, there in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if there:
                        with fs.open_input_stream(f"{root.rstrip('/')}/{path}") as stream:
                            raw.append(stream.read())
                    else:
                        raw.append(None)
                own = [x if x is None else hashlib.sha256(x).hexdigest() for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x if x is None else x.decode() for x in raw], pa.string()), pa.array(own, pa.string()), part.column(1)], names=["path", "text", "own", "sha256"])

    there = spark.range(1).coalesce(1).mapInArrow(names, "path string").withColumn("there", F.lit(True))
    both = shared.written(there.join(read_manifest(spark, folder), "path", "full").select("path", "sha256", F.coalesce("there", F.lit(False)).alias("there")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-both.count() // FILES_A_TASK))
    return both.repartition(tasks, "path").mapInArrow(contents, "path string, text string, own string, sha256 string")
