"""Suffix array by linear grouping, without recursion or renaming (Baier, CPM 2016).

Phase 1 sorts suffixes into groups by their Lyndon prefixes: groups are taken in
descending order; each member points to the nearest smaller suffix before it,
and the suffixes pointed to move behind their group, by how many members point
to them. Phase 2 emits every group's order by walking the same pointers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer string in ascending order (a shorter prefix comes first)."""
    n = len(symbols) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    s = np.concatenate([np.asarray(symbols, np.int64), [np.min(symbols) - 1]])
    order = np.argsort(s, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(s[order]) != 0]))
    sizes = np.diff(np.concatenate([begins, [n]]))
    first = np.empty(n, np.int64)
    first[order] = np.repeat(begins, sizes)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    sa, group, place = order.tolist(), first.tolist(), at.tolist()
    size = [0] * n
    for b, k in zip(begins.tolist(), sizes.tolist(), strict=True):
        size[b] = k
    before, done = [-1] * n, bytearray(n)

    end = n
    while end:
        low = group[sa[end - 1]]
        pointed: dict[int, int] = {}
        for i in sa[low:end] if end - low == 1 else sorted(sa[low:end]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j] if done[j] else j - 1
            before[i] = j
            done[i] = 1
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if len(pointed) == 1:
            (p,) = pointed
            g = group[p]
            last = g + size[g] - 1
            if last != g:
                q, k = sa[last], place[p]
                sa[k], place[q], sa[last], place[p] = q, k, p, last
                size[g] -= 1
                group[p], size[last] = last, 1
        elif pointed:
            times = set(pointed.values())
            for t in sorted(times, reverse=True):
                some = list(pointed) if len(times) == 1 else [p for p, c in pointed.items() if c == t]
                moved: dict[int, int] = {}
                for p in some:
                    g = group[p]
                    m = moved.get(g, 0)
                    last = g + size[g] - 1 - m
                    q, k = sa[last], place[p]
                    sa[k], place[q], sa[last], place[p] = q, k, p, last
                    moved[g] = m + 1
                starts = {g: g + size[g] - m for g, m in moved.items()}
                for p in some:
                    group[p] = starts[group[p]]
                for g, m in moved.items():
                    size[g] -= m
                for g, m in moved.items():
                    size[starts[g]] = m
        end = low

    out, free, put = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    put[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = 1
            j = before[j]
    return np.array(out[1:], np.int64)
