"""Digests of ordered lists, streamed: no list is ever gathered in a row.

Groups are dealt over tasks and sorted there; a hash state takes a group's pieces
as they come, so a task holds one batch of rows whatever the length of the list. A
SHA digest is sequential by its nature: one group's pieces pass one task, as short
texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def streamed(rows: DataFrame, group: list[str], order: list[Column], piece: Column, between: bytes = b"", before: bytes = b"", after: bytes = b"", algorithm: str = "sha256") -> DataFrame:
    """(group, n, digest): the hash over before, all pieces (binary) in order with `between` between them, and after.

    Null pieces are left out and not counted. Without group columns there is one
    row, also of no rows.
    """
    names = [f"g{k}" for k in range(len(group))]
    keys = [f"o{k}" for k in range(len(order))]
    # without a group all pieces have one key; their sort is by order alone
    dealt = rows.select(*[F.col(f"`{g}`").alias(n) for g, n in zip(group, names, strict=True)], *[o.alias(k) for o, k in zip(order, keys, strict=True)], piece.cast("binary").alias("piece")).where("piece is not null")
    dealt = dealt.repartition(*names) if group else dealt.repartition(1)
    dealt = dealt.sortWithinPartitions(*names, *keys).select(*names, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        state, n = hashlib.new(algorithm), 0

        def told() -> pa.RecordBatch:
            state.update(after)
            values = [*(last or ()), n, state.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, told_schema, strict=True)], names=[f.name for f in told_schema])

        told_schema: list[pa.Field] = []
        for b in batches:
            if not told_schema:
                told_schema = [*[b.schema.field(k) for k in range(len(names))], pa.field("n", pa.int64()), pa.field("digest", pa.string())]
            start = 0
            found = list(zip(*[b.column(k).to_pylist() for k in range(len(names))], strict=True)) if names else [()] * b.num_rows
            while start < b.num_rows:
                end = start + 1
                while end < b.num_rows and found[end] == found[start]:
                    end += 1
                if found[start] != last:
                    if last is not None:
                        yield told()
                    last, n, state = found[start], 0, hashlib.new(algorithm)
                    state.update(before)
                state.update((between if n else b"") + between.join(b.column(len(names)).slice(start, end - start).to_pylist()))
                n += end - start
                start = end
        if last is not None:
            yield told()

    kinds = "".join(f"`{n}` {dealt.schema[n].dataType.simpleString()}, " for n in names)
    out = dealt.mapInArrow(run, f"{kinds}n long, digest string")
    if group:
        return out.toDF(*group, "n", "digest")
    nothing = hashlib.new(algorithm, before + after).hexdigest()
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.lit(nothing)).alias("digest"))


def json_list(rows: DataFrame, group: list[str], order: list[Column], item: Column) -> DataFrame:
    """(group, n, digest): SHA-256 over the JSON list of a group's items, in order; an item is any column that JSON can hold."""
    one = F.to_json(F.array(item))  # an element's own text stands between the brackets
    return streamed(rows, group, order, F.encode(F.substring(one, F.lit(2), F.length(one) - 2), "UTF-8"), b",", b"[", b"]")


def length_prefixed(files: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, digest): SHA-256 over path and content of files in path order, each with its length in eight bytes before it."""
    sized = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0")), c)
    return streamed(files, group, [F.split("path", "/")], F.concat(sized(F.encode("path", "UTF-8")), sized(F.col("content").cast("binary"))))


def tree_oids(files: DataFrame, group: str = "repository") -> DataFrame:
    """(group, oid): git's object id of the root tree of each group's files (path, mode, oid).

    Level by level from the deepest folder up: each round hashes all folders of one
    depth, a folder's entries streamed in git's order (a folder's name counts as
    if it ended in a slash), and hands them to the round above. Two entries of
    one name in a folder are an error.
    """
    parent = F.regexp_extract("path", r"(?s)\A(?:(.*)/)?[^/]+\z", 1)
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    entry = lambda mode, oid: F.concat(F.encode(F.concat(mode, F.lit(" "), F.col("name")), "UTF-8"), F.lit(b"\0"), F.unhex(oid))
    own = files.select(F.col(group).alias("g"), parent.alias("folder"), name.alias("name"), "mode", "oid").select("g", "folder", depth.alias("depth"), "name", F.encode("name", "UTF-8").alias("key"), entry(F.col("mode"), F.col("oid")).alias("line"))
    own = shared.written(own)
    top = own.agg(F.max("depth")).first()[0]
    if top is None:
        return files.select(group).limit(0).withColumn("oid", F.lit(""))
    above: DataFrame | None = None
    for level in range(top, -1, -1):
        here = own.where(F.col("depth") == level).select("g", "folder", "name", "key", "line")
        entries = shared.written(here if above is None else here.union(above))
        twice = entries.groupBy("g", "folder", "name").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0]['g']}: two entries of one name: {twice[0]['folder']}/{twice[0]['name']}")
        size = entries.groupBy("g", "folder").agg(F.sum(F.octet_length("line")).alias("size"))
        head = size.select("g", "folder", F.lit(b"").alias("key"), F.encode(F.concat(F.lit("tree "), F.col("size").cast("string"), F.lit("\0")), "UTF-8").alias("line"))
        found = streamed(entries.select("g", "folder", "key", "line").union(head), ["g", "folder"], [F.col("key")], F.col("line"), algorithm="sha1")
        if level == 0:
            return found.select(F.col("g").alias(group), F.col("digest").alias("oid"))
        up = found.select("g", F.regexp_extract("folder", r"(?s)\A(?:(.*)/)?[^/]+\z", 1).alias("up"), F.regexp_extract("folder", r"([^/]+)\z", 1).alias("name"), F.col("digest").alias("oid"))
        above = up.select("g", F.col("up").alias("folder"), "name", F.encode(F.concat("name", F.lit("/")), "UTF-8").alias("key"), entry(F.lit("40000"), F.col("oid")).alias("line"))
    raise AssertionError("the root is always there")
