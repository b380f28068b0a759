"""The search for one isomorphism in plain Python: the yardstick for the joins of the library."""

from typing import Any

from gridloom.functions import grids

MAX_STATES = 100_000


def turned(grid: list[list[int]], name: str) -> list[list[int]]:
    rows = [list(r) for r in grid]
    if name in ("transpose", "rotate_90", "rotate_270", "anti_transpose"):
        rows = [list(r) for r in zip(*rows, strict=True)]
    if name in ("flip_horizontal", "rotate_180", "rotate_90", "anti_transpose"):
        rows = [r[::-1] for r in rows]
    if name in ("flip_vertical", "rotate_180", "rotate_270", "anti_transpose"):
        rows = rows[::-1]
    return rows


ColorPairs = frozenset[tuple[int, int]]


def _one_to_one(pairs: ColorPairs) -> bool:
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _color_pairs(left: dict[str, Any], right: dict[str, Any]) -> ColorPairs | None:
    """Colours that stand at the same cells of two examples; None unless shapes are equal and the pairs are one to one."""
    met: set[tuple[int, int]] = set()
    for side in ("input", "output"):
        a, b = left.get(side), right.get(side)
        if (a is None) != (b is None):
            return None
        if a is not None:
            if [len(row) for row in a] != [len(row) for row in b]:
                return None
            for row, other in zip(a, b, strict=True):
                met.update(zip(row, other, strict=True))
    found = frozenset(met)
    return found if _one_to_one(found) else None


def _choices(left: dict[str, Any], right: dict[str, Any], turn: str) -> list[tuple[tuple[str, int], dict[int, ColorPairs]]]:
    """For each example of left, turned: the examples of right that it can become, with the colour pairs of each."""
    out = []
    for split in ("train", "test"):
        for i, pair in enumerate(left[split]):
            image = {side: turned(g, turn) for side, g in pair.items() if g is not None}
            found = ((j, _color_pairs(image, other)) for j, other in enumerate(right[split]))
            out.append(((split, i), {j: colors for j, colors in found if colors is not None}))
    return out


def find_isomorphism(left: dict[str, Any], right: dict[str, Any], max_states: int = MAX_STATES) -> dict[str, Any]:
    """{status, explored, d4, color, train_permutation, test_permutation} for two tasks.

    The examples of left are joined in turn with the examples of right that
    each can become, those with the fewest choices first. A state is what has been joined so
    far: the colour pairs and the partners taken. States that agree in both are
    one, so equal examples do not multiply them. All eight transforms share one
    budget of states.
    """
    nothing = {"d4": None, "color": None, "train_permutation": None, "test_permutation": None}
    explored = 0
    if any(len(left[s]) != len(right[s]) for s in ("train", "test")):
        return {"status": "not-isomorphic", "explored": explored, **nothing}
    for turn in grids.D4:
        choices = _choices(left, right, turn)
        if not all(partners for _, partners in choices):
            continue
        states: dict[tuple[ColorPairs, frozenset[tuple[str, int]]], dict[tuple[str, int], int]] = {}
        level = {(frozenset(), frozenset()): {}}
        for example, partners in [(None, None), *sorted(choices, key=lambda c: len(c[1]))]:
            if example is not None:
                level = {
                    (colors | own, taken | {(example[0], j)}): placed | {example: j}
                    for (colors, taken), placed in states.items()
                    for j, own in partners.items()
                    if (example[0], j) not in taken and _one_to_one(colors | own)
                }
            if explored + len(level) > max_states:
                return {"status": "inconclusive", "explored": max_states, **nothing}
            explored += len(level)
            states = level
        if states:
            (colors, _), placed = min(states.items(), key=lambda s: sorted(s[1].items()))
            order = {split: [placed[split, i] for i in range(len(left[split]))] for split in ("train", "test")}
            return {"status": "matched", "explored": explored, "d4": turn, "color": dict(sorted(colors)), "train_permutation": order["train"], "test_permutation": order["test"]}
    return {"status": "not-isomorphic", "explored": explored, **nothing}
