"""The customers' tasks of projections.order_tasks, their transforms and the baseline's candidates in DuckDB SQL over lists."""

from __future__ import annotations

from .projections import GRID_SQL

_TRANSPOSED = "list_transform(range(1, len({g}[1]) + 1), lambda j: list_transform({g}, lambda r: r[j]))"
_MIRRORED = "list_transform({g}, lambda r: list_reverse(r))"
_TURNED = "list_transform(range(1, len({g}[1]) + 1), lambda j: list_transform(list_reverse({g}), lambda r: r[j]))"
#: Each transform of a grid expression {g}.
D4_SQL = {
    "identity": "{g}",
    "rotate_90": _TURNED,
    "rotate_180": f"list_reverse({_MIRRORED})",
    "rotate_270": f"list_reverse({_TRANSPOSED})",
    "flip_horizontal": _MIRRORED,
    "flip_vertical": "list_reverse({g})",
    "transpose": _TRANSPOSED,
    "anti_transpose": f"list_reverse({_TURNED})",
}

TASK_SQL = f"""{GRID_SQL},
og AS (SELECT l_orderkey AS k, list([c0, c1, c2, c3] ORDER BY i) AS g FROM (SELECT k AS l_orderkey, i, c0, c1, c2, c3 FROM ln) GROUP BY 1),
op AS (SELECT o_custkey AS t, k, g, CASE WHEN o_custkey % 2 = 0 THEN list_transform(g, lambda r: list_reverse(r)) ELSE list_transform(g, lambda r: list_transform(r, lambda c: (c + 1) % 10)) END AS o
       FROM og JOIN orders ON o_orderkey = k),
ta AS (SELECT t, list({{'i': g, 'o': o}} ORDER BY k) AS ps FROM op GROUP BY 1 HAVING count(*) >= 2),
tk AS (SELECT t, ps[1:len(ps) - 1] AS train, ps[len(ps)].i AS x, ps[len(ps)].o AS y FROM ta)"""


def _fits(name: str) -> str:
    return f"list_bool_and(list_transform(train, lambda p: ({D4_SQL[name].format(g='p.i')}) = p.o))"


def _constant(color: str) -> str:
    return f"list_transform(x, lambda r: list_transform(r, lambda c: {color}))"


CANDIDATE_SQL = f"""{TASK_SQL},
b0 AS (SELECT *, list_distinct(flatten(list_transform(train, lambda p: list_transform(range(1, len(flatten(p.i)) + 1), lambda q: flatten(p.i)[q] * 10 + flatten(p.o)[q])))) AS prs,
       list_transform(list_sort(list_transform(range(0, 10), lambda c: (100000 - len(list_filter(flatten(x), lambda v: v = c))) * 10 + c)), lambda q: q % 10) AS cs FROM tk),
b1 AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_fits(n)} THEN {{'s': '{n}', 'g': {D4_SQL[n].format(g='x')}}} END" for n in D4_SQL)},
       CASE WHEN len(list_distinct(list_transform(prs, lambda v: v // 10))) = len(prs)
            THEN {{'s': 'color_mapping', 'g': list_transform(x, lambda r: list_transform(r, lambda c: coalesce(list_filter(prs, lambda v: v // 10 = c)[1] % 10, c)))}} END,
       {{'s': 'copy_input', 'g': x}}, {{'s': 'dominant_color', 'g': {_constant("cs[1]")}}},
       {{'s': 'constant_color:' || cs[1], 'g': {_constant("cs[1]")}}}, {{'s': 'constant_color:' || cs[2], 'g': {_constant("cs[2]")}}}], lambda e: e IS NOT NULL) AS found FROM b0),
b2 AS (SELECT *, list_transform(found, lambda e: e.g) AS gs FROM b1),
cd AS (SELECT t, x, y, list_filter(found, lambda e, i: list_position(gs, e.g) = i)[1:2] AS best FROM b2)"""

#: An output's score: whether one of its two candidates is right, and the most cells that one of them has right.
SCORE_SQL = f"""{CANDIDATE_SQL},
ce AS (SELECT t, x, y, list_transform(best, lambda e: e.g = y) AS hit, list_transform(best, lambda e: CASE WHEN len(e.g) = len(y) AND len(e.g[1]) = len(y[1]) THEN len(list_filter(range(1, len(flatten(y)) + 1), lambda q: flatten(e.g)[q] = flatten(y)[q])) ELSE 0 END) AS same,
       list_transform(best, lambda e: CASE WHEN len(e.g) = len(y) AND len(e.g[1]) = len(y[1]) THEN len(list_filter(range(1, len(flatten(y)) + 1), lambda q: flatten(e.g)[q] = (flatten(y)[q] + 1) % 10)) ELSE 0 END) AS shifted,
       list_transform(best, lambda e: e.g = list_transform(y, lambda r: list_transform(r, lambda c: (c + 1) % 10))) AS shifted_hit FROM cd),
so AS (SELECT t, list_bool_or(hit) AS exact, list_max(same) AS matches, len(flatten(y)) AS cells, list_bool_or(shifted_hit) AS shifted_exact, list_max(shifted) AS shifted_matches FROM ce)"""
