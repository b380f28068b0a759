"""Document quality: counting rules, then a linear-chain CRF over lines.

Each line gets a feature vector of character shares; a conditional random field
with the labels content and boilerplate scores lines and label changes, and
Viterbi decoding gives the best labels of the whole text. The share of the
text's bytes in content lines decides whether it stays.

The field is trained here, on a bounded sample of labelled documents. Labels are
of documents, so lines start with their document's label; a first, chainless
model then relabels the ordinary-looking lines of poor documents as content,
and the chain is trained on these.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, tidy
from .repeats import words_of

SAMPLE_DOCS = 3000
SHARE = 0.5
CHAIN = 24  # lines of a training chain; longer texts give several chains
SAMPLE_LINES = 256  # lines of a longer text that the training uses, in chains from the whole text
FEATURES = 10


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


SPACE = _lut(b" \t\n\x0b\x0c\r")
SYMBOL = _lut(b"#*$%&|<>")
LOUD = _lut(b"!?")
UPPER = _lut(bytes(range(65, 91)))
LOWER = _lut(bytes(range(97, 123)))
DIGIT = _lut(b"0123456789")
BAR = _lut(b"|")
HEAD = np.ones(256, np.uint8)  # bytes that begin a code point
HEAD[0x80:0xC0] = 0
WORD_BITS = 21


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that occur twice or more."""
    n = len(words)
    if n < width + 1:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, itertools.count()), np.int64, n)
    if width * WORD_BITS < 64 and n < 1 << WORD_BITS:
        keys = ids[: n - width + 1].copy()
        for k in range(1, width):
            keys = keys << WORD_BITS | ids[k : n - width + 1 + k]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        like = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][like]] = True
        twice[order[:-1][like]] = True
    else:
        rows = np.stack([ids[k : n - width + 1 + k] for k in range(width)], axis=1)
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = counts[inverse.ravel()] > 1
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


@dataclass
class Lines:
    """Lines of several texts in order: features, bytes, and the text that each belongs to."""

    x: np.ndarray
    n_bytes: np.ndarray
    text: np.ndarray
    dup: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray


def lines_of(batch: list[bytes]) -> Lines:
    """Features of every line; a text without a newline is one line."""
    sizes = np.fromiter(map(len, batch), np.int64, len(batch))
    buf = np.frombuffer(b"\n".join(batch) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first_byte = np.cumsum(sizes + 1) - sizes - 1
    text = np.searchsorted(first_byte, starts, "right") - 1

    def total(lut: np.ndarray) -> np.ndarray:
        c = np.cumsum(lut[buf], dtype=np.int32)
        return c[ends] - np.where(starts > 0, c[np.maximum(starts, 1) - 1], 0) - lut[10]

    space, symbol, loud, upper, lower, digit, bar, head = map(total, (SPACE, SYMBOL, LOUD, UPPER, LOWER, DIGIT, BAR, HEAD))
    gap = SPACE[buf]
    begins = np.cumsum((gap == 0) & (np.concatenate([[1], gap[:-1]]) == 1), dtype=np.int32)
    words = begins[ends] - np.where(starts > 0, begins[np.maximum(starts, 1) - 1], 0)
    hashes, _ = words_of(batch)
    of_line = np.repeat(np.arange(len(words)), words)
    stammer = np.bincount(of_line[1:][(hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])], minlength=len(words))
    dup = np.zeros(len(starts), bool)
    at = 0
    for t in batch:
        found = t.split(b"\n")
        if len(found) > 1:
            seen: set[bytes] = set()
            for k, line in enumerate(found):
                if line in seen:
                    dup[at + k] = True
                else:
                    seen.add(line)
        at += len(found)
    dup &= words > 0
    n = ends - starts
    some = np.maximum(n - space, 1)
    per_word = np.maximum(words, 1)
    x = np.stack(
        [
            np.ones(len(n)), np.minimum(symbol / per_word, 3) / 3, np.minimum(loud / per_word, 2) / 2, upper / np.maximum(upper + lower, 1), digit / some,
            np.minimum(bar / per_word, 1), dup.astype(float), np.minimum(np.log1p(words) / 5, 1), np.minimum((head - space) / per_word / 20, 1), stammer / per_word,
        ],
        axis=1,
    )
    return Lines(x, n, text, dup, head - space, symbol)


@dataclass
class Chain:
    """Weights of the field: emit[label, feature], move[from, to]; label 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, x: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        """Viterbi labels of all lines; texts are walked side by side."""
        if not len(x):
            return np.zeros(0, np.int64)
        score = x @ self.emit.T
        counts = np.bincount(text, minlength=n_texts)
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        counts, first = counts[order], first[order]
        best = np.zeros((n_texts, 2))
        back = np.zeros((len(x), 2), np.int8)
        live = n_texts
        for t in range(int(counts[0])):
            live = int(np.searchsorted(-counts, -t, "left"))
            at = first[:live] + t
            if t:
                ways = best[:live, :, None] + self.move
                back[at] = ways.argmax(axis=1)
                best[:live] = ways.max(axis=1) + score[at]
            else:
                best[:live] = score[at]
        label = np.zeros(len(x), np.int64)
        now = best.argmax(axis=1)
        for t in range(int(counts[0]) - 1, -1, -1):
            live = int(np.searchsorted(-counts, -t, "left"))
            at = first[:live] + t
            label[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return label


def _chains(x: np.ndarray, y: np.ndarray, text: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each chain, their labels, which places hold a line, and each chain's weight."""
    place = np.arange(len(text)) - np.searchsorted(text, text)
    chain = np.unique(text.astype(np.int64) << 32 | place // CHAIN, return_inverse=True)[1].ravel()
    xs, ys, mask = np.zeros((chain.max() + 1, CHAIN, x.shape[1])), np.zeros((chain.max() + 1, CHAIN), np.int64), np.zeros((chain.max() + 1, CHAIN), bool)
    xs[chain, place % CHAIN], ys[chain, place % CHAIN], mask[chain, place % CHAIN] = x, y, True
    own = np.zeros(len(xs))
    own[chain] = weight  # a chain's lines are of one document
    return xs, ys, mask, own


def train(x: np.ndarray, quality: np.ndarray, text: np.ndarray, steps: int = 160, rate: float = 0.5, decay: float = 1e-3) -> Chain:
    """Fit the field by gradient ascent; quality is the label of each line's document.

    Good and poor documents weigh alike in sum, however many of each there are.
    """
    y = quality.astype(np.int64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 5.0 * (x.T @ (weight * (y - p)) - decay * w)
    y = np.where((y == 0) & (x @ w > 0), 1, y)
    xs, ys, mask, own = _chains(x, y, text, weight)
    emit, move = np.stack([-w / 2, w / 2]), np.zeros((2, 2))
    total = mask.sum(axis=1) @ own
    hot = np.eye(2)[ys] * mask[:, :, None]
    seen_emit = np.einsum("ntl,ntd,n->ld", hot, xs, own, optimize=True)
    seen_move = np.einsum("nta,ntb,n->ab", hot[:, :-1], hot[:, 1:], own, optimize=True)
    for _ in range(steps):
        score = xs @ emit.T
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, CHAIN):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], forward[:, t], forward[:, t - 1])
        log_z = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(CHAIN - 2, -1, -1):
            step = np.logaddexp.reduce(move + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
        node = np.exp(forward + backward - log_z[:, None, None]) * mask[:, :, None]
        edge = np.exp(forward[:, :-1, :, None] + move + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - log_z[:, None, None, None]) * mask[:, 1:, None, None]
        node, edge = node * own[:, None, None], edge * own[:, None, None, None]
        emit = emit + rate * ((seen_emit - np.einsum("ntl,ntd->ld", node, xs)) / total * 10 - decay * emit)
        move = move + rate * ((seen_move - edge.sum(axis=(0, 1))) / total * 10 - decay * move)
    return Chain(emit, move)


def sampled(x: np.ndarray, name: object, most: int) -> np.ndarray:
    """Rows of x in order: all up to `most`, else those of the chains whose hashes with `name` are least."""
    from xxhash import xxh64_intdigest

    if len(x) <= most:
        return x
    order = sorted(range(-(-len(x) // CHAIN)), key=lambda k: xxh64_intdigest(f"{name} {k}"))
    return np.concatenate([x[k * CHAIN : (k + 1) * CHAIN] for k in sorted(order[: max(1, most // CHAIN)])])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Chain | None:
    """Train on at most `sample_docs` labelled documents, the first by a hash of their id.

    Of a text longer than `sample_lines` lines, chains chosen by hash from its
    whole length are used. The bounds are on the training rows only. Returns None unless both labels
    occur; then no text is rejected for its lines.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(1)):
                found = lines_of(texts(b.column(1), start, stop))
                per = np.split(found.x[:, 1:].astype(np.float32), np.flatnonzero(np.diff(found.text)) + 1)
                names = b.column(0).slice(start, stop - start).to_pylist()
                keep = pa.array([sampled(x, name, sample_lines).tobytes() for x, name in zip(per, names, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), b.column(2).slice(start, stop - start), keep], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").orderBy("doc_id", "x").limit(sample_docs).toArrow().to_pylist()
    if len({r["quality"] for r in got}) < 2:
        return None
    each = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES - 1) for r in got]
    counts = np.array([len(e) for e in each])
    x = np.concatenate(each).astype(float)
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    return train(x, np.repeat([r["quality"] for r in got], counts), np.repeat(np.arange(len(got)), counts))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def quality(docs: DataFrame, chain: Chain | None, share: float = SHARE, keep_columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict for every row of docs, beside `keep_columns` (default: the id).

    A null or empty text has no words and fails the base rules. Whole texts are
    read, of any length; repeated rows get equal verdicts, whatever their ids; an
    empty table gives an empty one. A kept column that has a measure's name gives
    way to the measure. One narrow pass, no shuffle.
    """
    measures = {m.split()[0] for m in MEASURES.split(", ")}
    columns = [c for c in keep_columns or [id_col] if c not in measures]
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias("__text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(len(columns))):
                found = texts(b.column(len(columns)), start, stop)
                lines, n = lines_of(found), stop - start
                words = [t.split() for t in found]
                n_words = np.fromiter(map(len, words), np.int64, n)
                repeat = np.fromiter(map(repeated_words, words), np.int64, n)
                add = lambda v: np.bincount(lines.text, v, n).astype(np.int64)  # noqa: B023, E731
                failed = (n_words < 50) | (100 * repeat > 50 * n_words)
                label = chain.decode(lines.x, lines.text, n) if chain else np.ones(len(lines.text), np.int64)
                part = np.bincount(lines.text, lines.n_bytes * label, n) / np.maximum(np.bincount(lines.text, lines.n_bytes, n), 1)
                out = [b.column(k).slice(start, n) for k in range(len(columns))]
                out += [pa.array(v) for v in (n_words, add(lines.word_chars), add(lines.symbols), add(lines.dup), repeat, part, failed, ~failed & (part >= share))]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, *(m.split()[0] for m in MEASURES.split(", "))])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")
    return source.mapInArrow(run, f"{kinds}, {MEASURES}")
