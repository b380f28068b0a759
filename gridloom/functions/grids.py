"""Grid algebra as Column expressions on array<array<int>>.

Everything here is a composition of built-in array functions: no Python runs for
rows. A task is a struct with train and test arrays of (input, output) structs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]
CELLS = 10


def bound(value: Column, use: Transform) -> Column:
    """use of a value that is worked out once: an expression within a lambda is worked out anew for each of its elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def height(g: Column) -> Column:
    return F.size(g)


def width(g: Column) -> Column:
    return F.size(F.element_at(g, 1))


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def identity(g: Column) -> Column:
    return g


def flip_horizontal(g: Column) -> Column:
    return F.transform(g, lambda r: F.reverse(r))


def flip_vertical(g: Column) -> Column:
    return F.reverse(g)


def rotate_180(g: Column) -> Column:
    return F.reverse(flip_horizontal(g))


def transpose(g: Column) -> Column:
    return bound(g, lambda v: F.transform(_upto(width(v)), lambda j: F.transform(v, lambda r: F.get(r, j))))


def rotate_90(g: Column) -> Column:
    """A quarter turn clockwise: the columns, each read from the last row up."""
    return bound(F.reverse(g), lambda v: F.transform(_upto(F.size(F.element_at(v, -1))), lambda j: F.transform(v, lambda r: F.get(r, j))))


def rotate_270(g: Column) -> Column:
    return F.reverse(transpose(g))


def anti_transpose(g: Column) -> Column:
    return F.reverse(rotate_90(g))


#: The order decides which transform wins where several fit.
D4: dict[str, Transform] = {
    "identity": identity,
    "rotate_90": rotate_90,
    "rotate_180": rotate_180,
    "rotate_270": rotate_270,
    "flip_horizontal": flip_horizontal,
    "flip_vertical": flip_vertical,
    "transpose": transpose,
    "anti_transpose": anti_transpose,
}
INVERSE_D4 = {name: {"rotate_90": "rotate_270", "rotate_270": "rotate_90"}.get(name, name) for name in D4}


def compose(first: Transform, second: Transform) -> Transform:
    return lambda g: second(first(g))


def recolor(mapping: Column | dict[int, int]) -> Transform:
    """Colours that the map lacks stay as they are. A fixed map is looked up by place, not by key."""
    if isinstance(mapping, dict):
        return recolor_by(color_table(mapping), mapping)
    return lambda g: bound(mapping, lambda m: F.transform(g, lambda r: F.transform(r, lambda c: F.coalesce(F.try_element_at(m, c), c))))


def color_table(mapping: dict[int, int]) -> Column:
    """The colour that each of the ten becomes."""
    return F.array(*[F.lit(mapping.get(c, c)) for c in range(CELLS)])


def recolor_by(table: Column, rest: dict[int, int] | None = None) -> Transform:
    """Colours replaced by a table of all ten; others by the rest of a map, or they stay."""
    others = F.create_map(*[F.lit(x) for pair in sorted((rest or {}).items()) if not 0 <= pair[0] < CELLS for x in pair])
    more = any(not 0 <= c < CELLS for c in rest or {})
    new = lambda t: lambda c: F.coalesce(F.get(t, c), *([F.try_element_at(others, c)] if more else []), c)
    return lambda g: bound(table, lambda t: F.transform(g, lambda r: F.transform(r, new(t))))


def literal_map(mapping: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])


def inverse_map(mapping: Column) -> Column:
    return F.map_from_arrays(F.map_values(mapping), F.map_keys(mapping))


def is_closed_bijection(mapping: Column) -> Column:
    """Keys and values are the same set, each once."""
    values = F.map_values(mapping)
    return (F.array_sort(F.map_keys(mapping)) == F.array_sort(values)) & (F.size(F.array_distinct(values)) == F.size(values))


def is_permutation(order: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_sort(order) == _upto(n)).otherwise(F.size(order) == 0)


def permute(values: Column, order: Column) -> Column:
    return bound(values, lambda v: F.transform(order, lambda i: F.get(v, i)))


def restore_order(values: Column, order: Column) -> Column:
    """Undo permute: the value at order[i] comes back from place i."""
    return bound(values, lambda v: bound(order, lambda o: F.transform(_upto(F.size(o)), lambda i: F.get(v, F.array_position(o, i).cast("int") - 1))))


def cyclic_left(order: Column) -> Column:
    return bound(order, lambda o: F.concat(F.slice(o, 2, F.greatest(F.size(o) - 1, F.lit(0))), F.slice(o, 1, 1)))


def copy_input(g: Column) -> Column:
    return g


def constant(g: Column, color: Column) -> Column:
    """A grid of the same shape in one colour."""
    return bound(color, lambda c: F.transform(g, lambda r: F.transform(r, lambda _: c)))


def color_count(g: Column, color: Column | int) -> Column:
    wanted = F.lit(color) if isinstance(color, int) else color
    return F.size(F.filter(F.flatten(g), lambda c: c == wanted))


def colors_by_frequency(g: Column) -> Column:
    """All ten colours, the most frequent first, ties by colour."""
    counted = lambda cells: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.struct((F.size(F.array_remove(cells, c)) - F.size(cells)).alias("n"), c.alias("c")))
    return F.transform(F.sort_array(bound(F.flatten(g), counted)), lambda s: s["c"])


def dominant_color(g: Column) -> Column:
    return F.element_at(colors_by_frequency(g), 1)


def color_multiplicities(g: Column) -> Column:
    count = lambda cells: lambda c: F.when(c.isNull(), 0).otherwise(F.size(cells) - F.size(F.array_remove(cells, c)))
    return F.sort_array(bound(F.flatten(g), lambda cells: F.transform(F.array_distinct(cells), count(cells))))


def same_shape(a: Column, b: Column) -> Column:
    rows = F.zip_with(a, b, lambda x, y: F.size(x) == F.size(y))
    return (F.size(a) == F.size(b)) & F.forall(rows, lambda ok: F.coalesce(ok, F.lit(False)))


def cell_count(g: Column) -> Column:
    return F.size(F.flatten(g))


def cell_matches(candidate: Column, expected: Column) -> Column:
    """Equal cells; 0 unless every row has the expected length."""
    equal = F.zip_with(F.flatten(candidate), F.flatten(expected), lambda x, y: (x == y).cast("int"))
    total = F.aggregate(equal, F.lit(0), lambda acc, x: acc + x)
    return F.when(same_shape(candidate, expected), total).otherwise(F.lit(0))


def mutate(g: Column, offset: int = 1) -> Column:
    """Every colour shifted by an offset that is not a multiple of ten."""
    if offset % CELLS == 0:
        raise ValueError("the offset must change every cell")
    return F.transform(g, lambda r: F.transform(r, lambda c: F.pmod(c + offset, F.lit(CELLS))))


def map_pair(pair: Column, transform: Transform) -> Column:
    return F.struct(transform(pair["input"]).alias("input"), F.when(pair["output"].isNotNull(), transform(pair["output"])).alias("output"))


def transform_task(task: Column, transform: Transform, train_order: Column | None = None, test_order: Column | None = None) -> Column:
    """Apply a grid transform to all grids, then reorder the examples."""
    parts = {}
    for split, order in (("train", train_order), ("test", test_order)):
        pairs = F.transform(task[split], lambda p: map_pair(p, transform))
        parts[split] = pairs if order is None else permute(pairs, order)
    return F.struct(task["name"].alias("name"), parts["train"].alias("train"), parts["test"].alias("test"))


def restore_task(task: Column, inverse: Transform, train_order: Column | None = None, test_order: Column | None = None) -> Column:
    parts = {}
    for split, order in (("train", train_order), ("test", test_order)):
        pairs = task[split] if order is None else restore_order(task[split], order)
        parts[split] = F.transform(pairs, lambda p: map_pair(p, inverse))
    return F.struct(task["name"].alias("name"), parts["train"].alias("train"), parts["test"].alias("test"))


def transform_predictions(outputs: Column, transform: Transform) -> Column:
    return F.transform(outputs, lambda o: F.transform_values(o, lambda _, g: transform(g)))


def challenge_only(task: Column) -> Column:
    """The task without any test output: what a solver may see."""
    hidden = F.transform(task["test"], lambda p: F.struct(p["input"].alias("input"), F.lit(None).cast("array<array<int>>").alias("output")))
    return F.struct(task["name"].alias("name"), task["train"].alias("train"), hidden.alias("test"))


def mutate_labels(task: Column, offset: int = 1) -> Column:
    test = F.transform(task["test"], lambda p: F.struct(p["input"].alias("input"), mutate(p["output"], offset).alias("output")))
    return F.struct(task["name"].alias("name"), task["train"].alias("train"), test.alias("test"))


def attempts(grids: Column) -> Column:
    """attempt_1, attempt_2, ... -> grid."""
    entries = F.transform(grids, lambda g, i: F.struct(F.concat(F.lit("attempt_"), (i + 1).cast("string")).alias("key"), g.alias("value")))
    return F.map_from_entries(entries)


def sentinel_predictions(task: Column, top_k: int) -> Column:
    """Each hidden label, as every one of K attempts."""
    return F.transform(task["test"], lambda p: attempts(F.array_repeat(p["output"], top_k)))


def solutions_to_predictions(first: Column, second: Column) -> Column:
    """Two lists of grids, by position, as attempts 1 and 2 of each output."""
    return F.zip_with(first, second, lambda a, b: attempts(F.array(a, b)))


def grid_from_cells(rows: Sequence[Sequence[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(int(c)) for c in r]) for r in rows])
