import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import line_chunks, suffix_dedup
from gridloom.llm.gsaca import suffix_array
from gridloom.llm.line_chunks import CUTTINGS, chunk_ends, line_dedup, pieces
from gridloom.llm.queries import QUERIES
from gridloom.llm.recompression import repeated_windows
from gridloom.llm.suffix_dedup import repeated_bytes

from . import brute

SCHEMA = "doc_id long, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def awkward(seed, alphabet, sep, longest):
    """Rows that share parts, with nulls, empty texts, runs, copies and repeated rows."""
    rng = random.Random(seed)
    base = [rng.choice(alphabet) for _ in range(longest)]
    rows = []
    for d in range(90):
        n, at = rng.choice([0, 5, 40, 150]), rng.randrange(longest - 150)
        part = base[at : at + n]
        for _ in range(rng.randrange(4)):
            if part:
                part[rng.randrange(len(part))] = rng.choice(alphabet)
        if rng.random() < 0.25:
            part += [alphabet[0]] * rng.randrange(90)
        rows.append((d, sep.join(part)))
    return rows + [(3, rows[5][1]), (None, rows[7][1]), (500, None), (7, rows[7][1]), (7, rows[7][1]), (501, sep.join(["ab"] * 70)), (502, sep.join(["ab"] * 66))]


@pytest.mark.parametrize("width", [5, 12])
def test_word_windows(spark, width):
    rows = awkward(width, ["a", "b", "ccc", "dé"], " ", 600)
    got = repeated_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(brute.windows(rows, width), key=key)


@pytest.mark.parametrize("length", [20, 50])
def test_byte_strings(spark, length):
    rows = awkward(length, list("abcd é"), "", 900)
    got = repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3), length=length).collect()
    mine = [(brute.NULL_ID if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:5]) for r in got]
    assert sorted(mine) == sorted(brute.strings(rows, length))


def test_dedup_of_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated_windows(empty).count() == repeated_bytes(empty).count() == line_dedup(empty).count() == 0
    odd = spark.createDataFrame([(1, "x y", 5, "z"), (2, "x y", 6, None)], SCHEMA + ", size long, body string")
    assert repeated_windows(odd, width=2).count() == repeated_bytes(odd).count() == 2
    clash = spark.createDataFrame([(1, "a\nb", 5)], SCHEMA + ", n_lines long")
    assert line_dedup(clash).columns == ["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks"]


def by_rule(rows):
    return sorted(brute.line_runs(rows), key=repr)


def removed(found):
    return sorted(((r["doc_id"], r["text"], r["n_removed_lines"], r["n_removed_chunks"]) for r in found.collect()), key=repr)


def test_line_chunks(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefgh") * 4 for _ in range(6))
    shared = [line() for _ in range(30)]
    rows = [(d, "\n".join([line() for _ in range(d % 7)] + shared[d % 5 :] + [line() for _ in range(3)])) for d in range(40)]
    rows += [(None, rows[3][1]), (70, None), (71, ""), (72, "\n\n\n"), (73, "one line"), (73, "one line"), (74, "\n\n\n")]
    got = removed(line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == by_rule(rows)
    assert sum(r[2] for r in got) > 900


def test_a_copied_text_loses_all_its_lines(spark):
    text = "\n".join(f"line {k} of a longer text" for k in range(40))
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame([(1, text), (2, text)], SCHEMA)).collect()}
    assert got[1]["text"] == text and got[2]["n_removed_lines"] == 40


def test_chunks_are_cut_by_the_lines_alone():
    """The operator's cutting is the plain one, and lines put before or after a text move no far ends."""
    rng = random.Random(11)
    texts = [[bytes(rng.choices(b"abc ", k=rng.randrange(9))) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    for seed in range(CUTTINGS):
        for lines, ends in zip(texts, chunk_ends(texts, seed), strict=True):
            assert [e for _, e in brute.line_cuts(lines, seed)] == ends
    assert any(len(own) > 8 for own in pieces(texts))
    long = [b"line %d" % k for k in range(200)]
    for seed in range(CUTTINGS):
        before, after = chunk_ends([long, [b"x", *long, b"y"]], seed)
        assert {e + 1 for e in before if 60 < e < 190} == {e for e in after if 61 < e < 191}


def test_chunks_decide(monkeypatch):
    """Texts whose lines all hold words are cut by chunk_ends, once for each cutting, and by nothing else."""
    seen = []

    def whole(texts_lines, seed):
        seen.append(seed)
        return [[len(lines)] for lines in texts_lines]

    monkeypatch.setattr(line_chunks, "chunk_ends", whole)
    assert line_chunks.pieces([[b"a b", b"c d", b"e f"]]) == [[(0, 3)]] and len(seen) == CUTTINGS


def plain_runs(rows):
    """(id, text) without the lines of worded pairs that an earlier row or line has; rows in order of their id."""
    seen, out = {}, []
    for place, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        worded = [k for k, line in enumerate(lines) if line.strip()]
        gone = set()
        for a, b in zip(worded, worded[1:]):
            row, until = seen.setdefault(tuple(lines[a : b + 1]), (place, b + 1))
            if row < place or a >= until:
                gone |= set(range(a, b + 1))
        out.append((d, t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_short_runs_in_unlike_texts(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("abcdefgh") * 4 for _ in range(6))
    shared = [[line() for _ in range(n)] for n in (2, 3, 4, 5, 8)]
    rows = [(d, "\n".join([line() for _ in range(1 + d % 3)] + shared[d % 5] + [line() for _ in range(2)])) for d in range(40)]
    rows += [(50, "x y\n" * 5 + "z"), (51, "p q\nx y\nx y\nr s"), (52, None), (53, ""), (54, "one line")]
    got = removed(line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == by_rule(rows)
    whole = {d: t for d, t in plain_runs(rows)}
    gone = sum(n for d, _, n, _ in got if d < 40)
    assert gone >= 0.9 * 7 * 22 and all(len(t or "") >= len(whole[d] or "") for d, t, _, _ in got if d < 40)
    blank = [(1, "\n\na b\nc d\n\n"), (2, "e f\n\na b\nc d\n\ng h"), (3, "\n\na b\nc d\n\n")]
    assert removed(line_dedup(spark.createDataFrame(blank, SCHEMA))) == by_rule(blank)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
def test_the_query_against_the_rule_and_all_repeated_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    expected = {d: ((t or "").count("\n") + 1 if t is not None else 0, n, parts, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n, parts in brute.line_runs(rows)}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], r["n_removed_chunks"], r["kept_sha256"]) for r in QUERIES["op8_line_chunks"](spark, "/root/testdata/sf0.01").collect()}
    assert {d: g[1:] for d, g in got.items()} == {d: e[1:] for d, e in expected.items()}
    source = {d: t for d, t in rows}
    assert all(g[0] == (source[d].count("\n") + 1 if source[d] is not None else 0) for d, g in got.items())
    lines = lambda t: (t or "").count("\n") + 1 if t else 0
    brute_gone = sum(lines(source[d]) - lines(t) for d, t in plain_runs(rows))
    assert sum(g[1] for g in got.values()) >= 0.9 * brute_gone


def test_contexts_without_a_common_string_need_no_order(monkeypatch):
    """Contexts of one gram that share nothing longer are not put into the suffix array; those that do are."""
    ordered = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s: ordered.append(len(s)) or suffix_array(s))
    rng = np.random.default_rng(3)
    reach, gram = 34, np.frombuffer(b"the common sixteen bytes"[:16], np.uint8)
    sides = rng.integers(97, 123, (40, 2 * reach), np.uint8)
    context = np.concatenate([sides[:, :reach], np.repeat(gram[None], 40, axis=0), sides[:, reach:]], axis=1)
    doc = np.arange(40)
    low, high = suffix_dedup.covered_ranges(context, doc, doc, 50)
    assert ordered == [] and not low.any() and not high.any()
    context[7, 20:] = context[30, 20:]  # 14 bytes before the anchor and all after it
    low, high = suffix_dedup.covered_ranges(context, doc, doc, 50)
    assert len(ordered) == 1 and np.flatnonzero(high > low).tolist() == [30] and (low[30], high[30]) == (-14, 50)
