import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from gridloom.llm import histogram_shards, quality_crf, warc

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "do", "ri", "ta", "ne", "lu"]) for _ in range(rng.randint(1, 4)))
    out = []
    for d in range(n):
        good = rng.random() < 0.6
        lines = []
        for _ in range(rng.randint(4, 12)):
            words = [word() for _ in range(rng.randint(8, 20))]
            lines.append(" ".join(words) + "." if good or rng.random() < 0.2 else " ".join(w + rng.choice(["***", "$$$", "|"]) for w in words))
        out.append((d, "\n".join(lines), int(good)))
    return out


def test_base_measures(spark):
    rows = [(d, t) for d, t, _ in corpus(30, 1)] + [(100, None), (101, ""), (102, "\n\n a\na\na\n a"), (103, "x y z " * 60), (104, "é ü ß\n" * 30), (105, "a b c d a b c"), (105, "a b c d a b c"), (None, "w " * 80)]
    got = quality_crf.quality(spark.createDataFrame(rows, SCHEMA).repartition(3), None).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    mine = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got]
    assert sorted(mine, key=key) == sorted(((d, *measures(t)) for d, t in rows), key=key)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    chain = quality_crf.Chain(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)) * 2)
    counts = [1, 5, 8, 3]
    x, text = rng.normal(size=(sum(counts), 3)), np.repeat(np.arange(4), counts)
    got = chain.decode(x, text, 4)
    for k in range(4):
        own = x[text == k]

        def score(labels, own=own):
            return sum(chain.emit[a] @ v for a, v in zip(labels, own, strict=True)) + sum(chain.move[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(score([m >> i & 1 for i in range(len(own))]) for m in range(1 << len(own)))
        assert score(got[text == k].tolist()) == pytest.approx(best)


def test_held_out_accuracy(spark):
    train, test = corpus(240, 2), corpus(200, 3)
    docs = spark.createDataFrame([(d, t) for d, t, _ in train], SCHEMA)
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in train] + [(None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    chain = quality_crf.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_crf.quality(spark.createDataFrame([(d, t) for d, t, _ in test], SCHEMA), chain).collect()}
    judged = [(got[d]["kept"], bool(q)) for d, _, q in test if not got[d]["base_failed"]]
    assert np.mean([a == b for a, b in judged]) > 0.95
    assert all(a for a, b in judged if b)
    assert quality_crf.fit(docs, labels.where("quality = 1")) is None
    assert quality_crf.quality(spark.createDataFrame([], SCHEMA), chain).count() == 0


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(k, f"http://h{k % 5}.example.org/p{k % 7}?q={k}", f"<p>{k}</p>") for k in range(60)]
    rows += [(100, "https://a.b/", big), (101, "https://a.b/", big), (99, None, big), (102, "bad url\r\nX: y", other), (103, "http://[x", other), (104, "u", "x" * 999), (105, "u", "x" * 999), (106, "", None), (107, "http://e/", ""), (None, "http://n/", other)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    expected = []
    for p, u, h in rows:
        body = (h or "").encode()
        top = max((q for q, _, g in rows if (g or "") == (h or "") and q is not None), default=None)
        again = len(body) >= 1000 and p != top
        expected.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(expected, key=key)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_index_lookups(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [(k, f"http://site{k % 40}.example.com/x/{k}", f"page {k}") for k in range(3000)]
    captures = warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    index = warc.write_index(captures, path, parts=3)
    keys = spark.createDataFrame([(warc.capture_key(rows[k][1], k),) for k in (0, 7, 1234, 2999)] + [("com,nowhere)/ 1",)], "key string")
    got = warc.look_up(keys, index, path).collect()
    assert len(got) == 4
    fs, base = pafs.FileSystem.from_uri(path)
    for r in got:
        with fs.open_input_file(f"{base}/{r['file']}") as f:
            f.seek(r["offset"])
            record = warc.parse(gzip.decompress(f.read(r["length"])))
        assert record["payload"].decode() == f"page {warc._page(record['fields']['WARC-Record-ID'])}"
    with fs.open_input_file(f"{base}/{index.first()['file']}") as f:
        one = warc.CaptureIndex(f)
        assert len(one.directory) > 1 and one.firsts == sorted(one.firsts)


@pytest.mark.parametrize(("url", "key"), [("HTTP://WWW.Example.com:80/a?b#c", "com,example,www)/a?b"), ("https://e.org:8443", "org,e:8443)/"), (None, ""), ("no host", "no%20host")])
def test_reversed_host(url, key):
    assert warc.reversed_host_key(url) == key


def shards(df, n=8, **more):
    return histogram_shards.histogram_shards(df, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 1, shards=n, **more).collect()


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(10**12), "x" * rng.randrange(200)) for _ in range(900)] + [(5, "same")] * 400 + [(None, None)] * 3 + [(-(1 << 63), ""), ((1 << 63) - 1, "z")]
    got = shards(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(d), t or "") for d, t in rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * 201 + 0.002 * sum(sizes.values()) / 8
    for s in range(8):
        own = sorted((r["slot"], -(1 << 70) if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == s)
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    bounds = [[d for d in (r["doc_id"] for r in got if r["shard"] == s) if d is not None] for s in range(8)]
    assert all(max(a) <= min(b) for a, b in zip(bounds, bounds[1:], strict=False) if a and b)


def test_shards_of_small_and_odd_tables(spark):
    assert shards(spark.createDataFrame([], SCHEMA)) == []
    one = shards(spark.createDataFrame([(1, "a")], SCHEMA))
    assert len(one) == 1 and one[0]["slot"] == 0
    clash = spark.createDataFrame([(k, "t", 9, "s") for k in range(20)], SCHEMA + ", size long, shard string")
    got = shards(clash, 4)
    assert Counter(r["shard"] for r in got) == dict.fromkeys(range(4), 5) and {r["size"] for r in got} == {2}


def test_training_reads_long_texts_to_their_end(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_crf, "train", lambda x, quality, text: seen.append((x, quality, text)))
    rows = [(1, "a b c d\n" * 300 + "\n".join(["1 2 3 4"] * 700)), (2, "a b c d\ne f g h")]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    for most in (256, 48, 5000):
        quality_crf.fit(spark.createDataFrame(rows, SCHEMA), labels, sample_lines=most)
        x, quality, text = seen.pop()
        own = x[text == 0]
        assert len(own) == 1000 if most == 5000 else len(own) <= most
        assert (own[:, 4] == 1).any() and (text == 1).sum() == 2
