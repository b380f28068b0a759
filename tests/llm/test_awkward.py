"""Repeated and null ids, clashing columns, empty tables and very long texts, for every operator and stage."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import histogram_shards, line_chunks, packing, quality_crf, queries, recompression, shingle_links, simhash_trie, spaced_seeds, suffix_dedup, tokens, warc, wavelet

from . import brute
from .test_near import five_words, plain_fingerprint

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
CLASH = ["n_words", "kept", "length", "piece", "shard", "slot", "size", "fingerprint", "component_id", "n_lines", "item_id", "place", "start", "body", "rank", "row_key", "key", "hash", "id", "number", "first", "u", "v", "node", "named", "tie"]


def word(rng):
    return "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))


@pytest.fixture(scope="module")
def rows():
    """Ids that repeat with other texts, null ids, null and empty texts, repeated rows, shared lines and passages."""
    rng = random.Random(21)
    passage = [word(rng) for _ in range(70)]
    lines = [" ".join(word(rng) for _ in range(8)) for _ in range(12)]
    out = []
    for k in range(30):
        own = [word(rng) for _ in range(60)]
        text = " ".join(own[:30] + passage[k % 7 :] + own[30:]) + "\n" + "\n".join(lines[k % 4 : k % 4 + 6]) + "\n" + " ".join(word(rng) for _ in range(9))
        out.append((None if k % 6 == 0 else k % 11, text))
    return [*out, *out[:4], (None, None), (None, ""), (5, ""), (5, None), (12, " \n\n "), (12, "one")]


OPERATORS = {
    "op1": lambda d: spaced_seeds.find_passages(d, d.sparkSession.createDataFrame([(None, " ".join(["aa bb cc dd ee"] * 4)), (3, "ff")], "item_id long, text string")),
    "op2": lambda d: suffix_dedup.repeated_bytes(d).drop("kept"),
    "op3": lambda d: recompression.repeated_windows(d, width=10),
    "op4": lambda d: packing.pack(d, tokens.vocabulary("word_bpe_49k.json"), capacity=64).drop("sequence_id", "offset"),
    "op6": lambda d: quality_crf.quality(d, None),
    "op7": lambda d: wavelet.token_shards(d, tokens.vocabulary("byte_bpe_50k.json"), 2).drop("shard", "place"),
    "op8": lambda d: line_chunks.line_dedup(d).select("doc_id", "text", "n_removed_lines", "n_removed_chunks"),
    "op9": simhash_trie.simhash_groups,
    "links": shingle_links.shingle_links,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_and_empty_tables_make_no_difference(spark, rows, name):
    plain = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wide = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    key = lambda r: repr(tuple(r))
    expected = OPERATORS[name](plain)
    assert sorted(map(key, OPERATORS[name](wide).select(*expected.columns).collect())) == sorted(map(key, expected.collect()))
    assert OPERATORS[name](plain.limit(0)).count() == 0


def test_clashing_pages_and_shards(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x" * 1200, "z"), (1, "http://a.b/d", "x" * 1200, "z"), (None, "http://a.b/c", "x" * 1200, "z"), (None, None, None, "z"), (4, "http://a.b/c", "", "z")], "page_id long, url string, html string, digest string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages).collect())
    assert got == [(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "response", None), (4, "response", None)]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    rows = spark.createDataFrame([(k % 5 if k % 3 else None, "t", k) for k in range(500)], "doc_id long, size string, shard int")
    found = histogram_shards.histogram_shards(rows, "doc_id", F.lit(10), 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert {r["n"] for r in found} <= {62, 63} and all(r["top"] + 1 == r["n"] for r in found)
    assert histogram_shards.histogram_shards(rows.limit(0), "doc_id", F.lit(10), 8).count() == 0


def test_ids_named_like_results(spark):
    docs = spark.createDataFrame([(7, "a b c")], "length long, text string")
    row = packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"), id_col="length").first()
    assert (row["length_id"], row["length"]) == (7, 4)


def test_null_items_and_ids_stay_null(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    items = spark.createDataFrame([(None, passage)], "item_id long, text string")
    found = spaced_seeds.find_passages(spark.createDataFrame([(None, passage), (2, "x")], SCHEMA), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(None, None)]
    docs = spark.createDataFrame([(None, "a"), (-(1 << 63), "b"), (None, None)], SCHEMA)
    got = wavelet.token_shards(docs, tokens.vocabulary("byte_bpe_50k.json"), 2).select(F.when(F.col("named"), F.col("doc_id")).alias("d"), "n_tokens").collect()
    assert sorted((r["d"] is not None, r["n_tokens"]) for r in got) == [(False, 1), (False, 2), (True, 2)]


def test_texts_of_many_megabytes(spark):
    """Two long texts that share half, for every operator of documents."""
    rng = np.random.default_rng(3)
    stock = ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(40_000)]
    half = " ".join(stock[i] for i in rng.integers(0, len(stock), 800_000))
    texts = [half + "\n" + " ".join(stock[i] for i in rng.integers(0, len(stock), 800_000)) for _ in range(2)]
    assert min(map(len, texts)) > 10_000_000
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, "short")], SCHEMA).repartition(3)
    two = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(docs).select("doc_id", "n_removed").collect()}
    assert two[1] == two[3] == 0 and len(half) <= two[2] < len(half) + 1000
    three = {r["doc_id"]: r["n_removed"] for r in recompression.repeated_windows(docs).select("doc_id", "n_removed").collect()}
    assert three == {1: 800_000, 2: 800_000, 3: 0}
    pieces = packing.pack(docs, tokens.vocabulary("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("top")).collect()
    lengths = {r["doc_id"]: r["n_tokens"] for r in wavelet.token_shards(docs, tokens.vocabulary("byte_bpe_50k.json")).collect()}
    assert all(r["top"] <= 2048 for r in pieces) and lengths[1] > 1_600_000 and lengths[3] == 1
    assert {r["doc_id"]: r["kept"] for r in quality_crf.quality(docs, None).collect()} == {1: True, 2: True, 3: False}
    kept = {r["doc_id"]: r["n_removed_lines"] for r in line_chunks.line_dedup(docs.unionByName(docs.select((F.col("doc_id") + 10).alias("doc_id"), "text"))).collect()}
    assert kept == {1: 0, 2: 0, 3: 0, 11: 2, 12: 2, 13: 0}
    classes = {r["doc_id"]: r["component_id"] for r in simhash_trie.simhash_groups(docs).collect()}
    assert classes[1] == 1 and classes[3] == 3
    items = spark.createDataFrame([(9, " ".join(texts[1].split()[-40:]))], "item_id long, text string")
    assert [r["doc_id"] for r in spaced_seeds.find_passages(docs, items).collect()] == [2]


# ---- exactness against plain versions


def test_windows_are_compared_by_words_where_hashes_collide(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = sorted((repr(d), n, gone, kept) for d, n, gone, kept in brute.windows(rows, 10))
    for bits in (64, 5, 1):
        got = recompression.repeated_windows(docs, width=10, bits=bits).collect()
        assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == expected


def test_stretches_with_colliding_hashes():
    rng = random.Random(2)
    stretches = [" ".join(rng.choice("abc") for _ in range(rng.randint(4, 12))).encode() for _ in range(60)]
    many = np.array([rng.random() < 0.1 for _ in stretches])
    seen = {}
    for s, m in zip(stretches, many, strict=True):
        w = s.split()
        for k in range(len(w) - 3):
            seen[tuple(w[k : k + 4])] = seen.get(tuple(w[k : k + 4]), 0) + (2 if m else 1)
    expected = set()
    for n, s in enumerate(stretches):
        w = s.split()
        expected |= {(n, k) for k in range(len(w) - 3) if seen[tuple(w[k : k + 4])] > 1 or many[n]}
    for bits in (64, 3):
        own, first, end = recompression.repeated_in(stretches, many, 4, bits)
        assert {(int(n), k) for n, a, b in zip(own, first, end, strict=True) for k in range(a, b - 3)} == expected


def test_a_gram_that_many_texts_share_with_unlike_surroundings(spark):
    rng = random.Random(6)
    gram = "the same twenty one"
    rows = [(k, "".join(rng.choices("abcdefg ", k=40)) + gram + "".join(rng.choices("abcdefg ", k=40))) for k in range(400)]
    rows += [(500 + k, rows[k][1]) for k in range(20)] + [(600 + k, "zz" + rows[k][1][:70]) for k in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        got = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute.strings(rows, 50))


def test_line_pieces_are_compared_by_bytes_where_digests_collide(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: repr(tuple(r))
    plain = sorted(map(key, line_chunks.line_dedup(docs).collect()))
    weak = line_chunks.line_dedup(docs, digest=lambda body: bytes([len(body) % 3]))
    assert sorted(map(key, weak.collect())) == plain


def test_number_of_sequences_reaches_the_bound():
    for sf, more in (("sf0.001", 1), ("sf0.01", 1)):
        path = f"/root/testdata/{sf}/documents.parquet"
        if not os.path.exists(path):
            pytest.skip("the test tables are not here")
        import pyarrow.parquet as pq

        found = pq.read_table(path, columns=["text"])["text"].to_pylist()
        _, n = tokens.PieceEncoder(tokens.vocabulary("word_bpe_49k.json")).encode([t or "" for t in found])
        counts = {}
        for length in (n + 1).tolist():
            for piece in [2048] * (length // 2048) + [length % 2048] * (length % 2048 > 0):
                counts[piece] = counts.get(piece, 0) + 1
        plan = packing.plan_sequences(counts, 2048)
        assert all(sum(items) <= 2048 for items, _ in plan)
        held = {}
        for items, times in plan:
            for x in items:
                held[x] = held.get(x, 0) + times
        assert held == counts
        assert sum(times for _, times in plan) <= -(-sum(x * k for x, k in counts.items()) // 2048) + more


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_queries_with_checksums_against_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    word_bpe = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    expected = []
    for d, t in docs:
        ids = word_bpe.encode(t or "", add_special_tokens=False).ids + [0]
        expected += [(d, k, k * 2048, len(ids[k * 2048 : k * 2048 + 2048]), zlib.crc32(np.array(ids[k * 2048 : k * 2048 + 2048], "<u4").tobytes())) for k in range(-(-len(ids) // 2048))]
    packed = queries.op4_best_fit_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(expected)
    shards = queries.op10_histogram_shards(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in shards} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t in docs}
    order = [r["doc_id"] for r in sorted(shards, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    loads = [sum(r["size"] for r in shards if r["shard"] == k) for k in range(8)]
    assert max(loads) - min(loads) <= max(r["size"] for r in shards) * 2


def test_near_copies_in_a_large_key_lose_no_link(spark):
    """A hundred edits of one text, and of a second one that shares half of it: links join what brute force joins."""
    rng = random.Random(31)
    first = [word(rng) for _ in range(120)]
    second = first[:60] + [word(rng) for _ in range(60)]
    texts = []
    for k in range(160):
        base = list(first if k % 3 else second)
        for at in rng.sample(range(len(base)), rng.choice([0, 1, 2, 3, 4, 6])):
            base[at] = word(rng) + "x"
        texts.append(" ".join(base))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    prints = [int(np.array([simhash_trie.fingerprint(t.encode())], np.uint64).view(np.int64)[0]) for t in texts]
    sets = [five_words(t) for t in texts]
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                up[root(prints[i])] = root(prints[j])
    expected = {frozenset(p for p in prints if root(p) == r) for r in {root(p) for p in prints}}
    up = {p: p for p in prints}
    for u, v in shingle_links.shingle_links(docs).collect():
        up[root(u)] = root(v)
    assert {frozenset(p for p in prints if root(p) == r) for r in {root(p) for p in prints}} == expected


def test_texts_unlike_their_leader_meet_few_others(spark):
    """Families about as far from one leader: texts that lack the same half of it are not all paired, and no alike pair is missed."""
    rng = random.Random(47)
    rows, sets, size = [], {}, 400
    for family in range(12):
        core = set(rng.sample(range(size), 120 + 12 * family))
        for k in range(12):
            lacking = core ^ set(rng.sample(range(size), 60 if k % 2 else 6))
            more = {family * 10_000 + x for x in rng.sample(range(50), 45)} | {(family * 12 + k) * 1_000_000 + x for x in range(1, 6)}
            name = bytes([family, k])
            sets[name] = {-1 - x for x in range(size) if x not in lacking} | more
            rows.append((b"lead", name, False, (100 * len(lacking) + 80 * len(more)) / 180, size * 20 / 180, size, sorted(lacking), sorted(more)))
    frame = spark.createDataFrame(rows, "a binary, b binary, like boolean, weight double, slack double, size int, lacking array<int>, more array<long>")
    ranked = shingle_links.differences(frame).cache()
    alike = {(x, y) for x in sets for y in sets if x < y and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])}
    found = {(bytes(r["a"]), bytes(r["b"])) for r in shingle_links.near_pairs(ranked, 80).collect()}
    assert len(alike) > 100 and alike <= found
    left, right = shingle_links.grade_sides(ranked, 80)
    met = left.join(right, ["a", "mark", "light", "heavy"]).where("light < heavy or one < two").count()
    halves = [set(r["marks"]) for r in ranked.select("marks").collect()]
    assert met * 10 < sum(len(x & y) for i, x in enumerate(halves) for y in halves[:i])


def exploded(spark, begun):
    """Rows that explode() made in all jobs from number `begun` on, or, without it, the number of jobs so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    if begun is None:
        return runs.size()
    made = 0
    for run in (runs.apply(k) for k in range(begun, runs.size())):
        nodes, told = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            if node.name() == "Generate" and (n := told.get(metrics.apply(0).accumulatorId())).isDefined():
                made += int(n.get().replace(",", ""))
    return made


@pytest.mark.parametrize("held", [shingle_links.HELD, 16])
def test_what_one_text_alone_shows_is_dealt_once_for_all_its_leaders(spark, monkeypatch, held):
    """Texts under six leaders each, most of whose shingles no other text shows; very long ones are gathered in parts."""
    monkeypatch.setattr(shingle_links, "HELD", held)
    rng = random.Random(53)
    rows = []
    for k in range(30):
        own = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)]
        for leader in range(6):
            more = [*own, *rng.sample(range(leader * 20, leader * 20 + 40), 8)]  # neighbouring leaders' texts share some
            rows.append((bytes([leader]), bytes([9, k]), False, 50.0, 5.0, 50, sorted(rng.sample(range(50), 3)), more))
    frame = spark.createDataFrame(rows, "a binary, b binary, like boolean, weight double, slack double, size int, lacking array<int>, more array<long>").localCheckpoint()
    begun = exploded(spark, None)
    got = {(bytes(r["a"]), bytes(r["b"])): [(m["n"], m["mark"]["h"], m["mark"]["l"]) for m in r["marks"]] for r in shingle_links.differences(frame).collect()}
    made = exploded(spark, begun)
    expected = {}
    for a, b, *_, lacking, more in rows:
        n = lambda x, at: sum(x in r[at] for r in rows if r[0] == a)  # noqa: E731, B023
        marks = [(n(p, 6), p, True) for p in lacking] + [(n(h, 7), h, False) for h in more]
        expected[a, b] = sorted(m for m in marks if m[0] > 1)
    assert got == expected and any(got.values())
    assert 0 < made < sum(len(r[7]) for r in rows)


# ---- stages

FULL = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_with_any_columns_and_repeated_ids(spark, rows):
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    docs = spark.createDataFrame(full, FULL).repartition(3).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH) if c not in ("item_id",)])
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert lines.columns == docs.columns and lines.where("n_words <> 0 or slot <> 5").isEmpty()
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.columns == docs.columns
    distinct = {(d, t) for d, t in rows}
    wordy = [(d, t) for d, t in distinct if (t or "").split()]
    prints = [plain_fingerprint(t) for _, t in wordy]
    sets = [five_words(t) for _, t in wordy]
    near_pair = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    classes = len(set(brute.least_reachable(len(wordy), near_pair)))
    assert len([r for r in near.collect() if (r["text"] or "").split()]) == classes
    if os.path.isdir(SF):
        judged = corpus_pipeline.quality_rules(spark, docs, SF)
        assert judged.columns == docs.columns
        clean = corpus_pipeline.drop_benchmark(spark, docs, SF)
        assert clean.columns == docs.columns and clean.count() == len(rows)
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.where("piece = 0").count() == len(rows)
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.pack_sequences):
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_a_bare_checkpoint_path_is_on_sparks_own_file_system(spark):
    from gridloom.llm.common import shared_uri

    assert shared_uri(spark).startswith("file:///")
    assert not spark.conf.get("spark.checkpoint.dir").startswith("file:")
