import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm.queries import QUERIES

from . import brute
from .test_near import five_words, plain_fingerprint, plain_hit
from .test_quality_warc_shards import measures

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp(f"stage{k}")) + "/t"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [sorted(d.collect(), key=lambda r: tuple(r)) for d in out]


def test_each_stage_against_a_plain_version(stages):
    source, quality, lines, near, clean, packed = stages
    assert all(r.asDict().keys() == source[0].asDict().keys() for rows in stages[:5] for r in rows)
    base = {r["doc_id"] for r in source if not measures(r["text"])[-1]}
    kept = {r["doc_id"] for r in quality}
    assert kept <= base and len(kept) > 0.8 * len(base)

    expected = {}
    for d, text, gone, _ in brute.line_runs([(r["doc_id"], r["text"]) for r in quality]):
        if not gone or re.search(r"[^\x20\x09-\x0D]", text or ""):
            expected[d] = (text, len(text)) if gone else (text, next(r["n_chars"] for r in quality if r["doc_id"] == d))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines} == expected
    assert sum(r["n_chars"] for r in lines) < sum(r["n_chars"] for r in quality)

    ids, prints, sets = [r["doc_id"] for r in lines], [plain_fingerprint(r["text"]) for r in lines], [five_words(r["text"] or "") for r in lines]
    alike = lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0
    label = brute.least_reachable(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or alike(i, j))
    assert [r["doc_id"] for r in near] == sorted({ids[c] for c in label})
    assert len(near) < len(lines)


def test_decontamination_and_packing(spark, stages):
    _, _, _, near, clean, packed = stages
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near if not any(plain_hit(r["text"], b) for b in items)}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in packed) // 2048) + 3


def test_run_is_the_stages(spark, stages):
    got = sorted(corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect(), key=tuple)
    assert [tuple(r) for r in got] == [tuple(r.asDict()[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in sorted(stages[-1], key=lambda r: tuple(r)[:5])]


def test_rows_are_repeated_and_null(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 2]
    assert corpus_pipeline.drop_repeated_lines(spark, docs, SF).count() == 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    found = QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if name.startswith("op5_") else ("embeddings", "vec_id") if name.startswith(("op11_", "op12_", "op13_")) else ("documents", "doc_id")
    whole = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    asked = {v for v in whole if v % 50 == 0} if name.startswith(("op11_", "op12_")) else whole
    mine = {"op11": "query_id", "op12": "anchor_id"}.get(name[:4], key)
    got = {r[0] for r in found.select(mine).collect()}
    assert got <= asked if name.startswith(("op1_", "op12_")) else got == asked


def test_rows_with_null_ids_are_texts_of_their_own(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = lambda c: " ".join(f"{c}{k}" for k in range(80))
    lines = "\n".join(f"line {k} of a text" for k in range(40))
    rows = [(None, long("a"), "en", "s", 1), (None, long("b"), "en", "s", 1), (None, None, "en", "s", 0), (4, long("c"), "en", "s", 1), (4, long("d"), "en", "s", 1), (4, long("d"), "en", "s", 1)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r["text"] or "") for r in kept) == sorted({t or "" for _, t, *_ in rows})
    docs = spark.createDataFrame([(None, lines), (None, "x\n" + lines), (None, None), (None, "one"), (5, lines), (5, "p q\nr s")], "doc_id long, text string")
    got = corpus_pipeline.line_dedup(docs).collect()
    assert len(got) == 6 and {r["text"] for r in got} >= {None, "one", "p q\nr s"}
    assert sum(r["n_removed_lines"] for r in got if r["doc_id"] == 5) >= 30
    assert sum(r["n_removed_lines"] for r in got if r["doc_id"] is None) >= 30
    bench = spark.createDataFrame([(1, long("a"))], "item_id long, text string")
    clean = corpus_pipeline.decontaminate(spark.createDataFrame(rows, schema), bench).collect()
    assert sorted((r["text"] or "") for r in clean) == sorted((t or "") for _, t, *_ in rows[1:])
