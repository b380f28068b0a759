"""Plain formulations that the operators are held against."""

import hashlib
from collections import Counter

NULL_ID = -(1 << 63)


def windows(rows, width):
    """(id, n_words, n_removed, kept): words under windows that occur twice anywhere."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in words for i in range(len(w) - width + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def strings(rows, length):
    """(id, n_bytes, n_removed, n_spans, sha256): bytes under strings that also start in a smaller id."""
    texts = [(NULL_ID if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            key = t[i : i + length]
            least[key] = min(d, least.get(key, d))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def least_reachable(n, near):
    """Smallest index reachable over the symmetric relation near(i, j)."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if label[j] < label[i] and near(i, j):
                    label[i], changed = label[j], True
    return label


def line_cuts(lines, seed):
    """(first line, end line) of each chunk of a text's lines under one seed, counted with plain numbers."""
    from xxhash import xxh64_intdigest

    word = (1 << 64) - 1
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def says(line, number):
        h = xxh64_intdigest(line) * odd[0] & word
        h = ((h ^ h >> 31) * odd[0] + number * odd[1]) & word
        h = (h ^ h >> 29) * odd[2] & word
        return ((h ^ h >> 32) >> 8) % 10 < 7

    out, start = [], 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or k - start >= 2 and (says(lines[k - 1], 2 * seed) or says(lines[k], 2 * seed + 1)):
            out.append((start, k))
            start = k
    return out


def line_runs(rows, cuttings=8):
    """(id, text, lines removed, stretches removed) by the rule of line chunks; a row's place is (id, text)."""
    place = lambda d, t: (d is not None, d if d is not None else 0, hashlib.md5(t).digest())
    held, firsts, chunks = {}, {}, {}
    for d, t in rows:
        body = (t or "").encode()
        held[place(d, body)] = body.split(b"\n")
    worded = lambda part: sum(bool(x.strip()) for x in part) > 1
    for p, lines in held.items():
        chunks[p] = {c for seed in range(cuttings) for c in line_cuts(lines, seed) if c[1] - c[0] > 1 and worded(lines[c[0] : c[1]])}
        for a, e in chunks[p]:
            key = tuple(lines[a:e])
            firsts[key] = min((p, a), firsts.get(key, (p, a)))
    gone = {}
    for p, lines in held.items():
        keep = [True] * len(lines)
        for a, e in chunks[p]:
            q, b = firsts[tuple(lines[a:e])]
            if (q, b) == (p, a) or (q == p and b + e - a > a):
                continue
            other, shift, i, j = held[q], a - b, a, e
            room = lambda: q != p or j - i < shift  # noqa: B023, E731
            while min(i, i - shift) > 0 and room() and lines[i - 1] == other[i - 1 - shift]:
                i -= 1
            while j < len(lines) and j - shift < len(other) and room() and lines[j] == other[j - shift]:
                j += 1
            while i < a and not lines[i].strip():
                i += 1
            while j > e and not lines[j - 1].strip():
                j -= 1
            keep[i:j] = [False] * (j - i)
        gone[p] = keep
    out = []
    for d, t in rows:
        body = (t or "").encode()
        keep = gone[place(d, body)]
        text = b"\n".join(x for x, k in zip(held[place(d, body)], keep, strict=True) if k).decode()
        out.append((d, t if t is None else text, keep.count(False), sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep))))
    return out
