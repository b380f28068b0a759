"""The search for isomorphisms by levels: one for each example, all pairs and transforms at once.

A state of a pair and a transform is what has been joined so far: the colours that
stand for each other and the partners taken. The next level joins every state
with the partners that its next example can have, keeps what is still one to
one, and makes one of states that agree in both. States are counted exactly for
each pair; a pair that passes the bound is inconclusive and leaves the search.
Tasks that are equal but for their colours are one in the search.
Pairs that can't have more than STATES_IN_ROW states at once, which are almost all, go
through their levels within their row; for the others each level is a join.
Built-in functions only; each joined level is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grids
from . import shared

MAX_STATES = 100_000
STATES_IN_ROW = 4096  # a transform whose numbers of partners have a greater product is searched by joins
EXAMPLES_IN_ROW = 64
LYING = ("rotate_90", "rotate_270", "transpose", "anti_transpose")
PAIR = ["left_id", "right_id"]
NODE = [*PAIR, "turn"]


def _listed(task: Column) -> Column:
    """(split, place, input, output) of all examples."""

    def of(split: str) -> Column:
        return F.transform(task[split], lambda p, i: F.struct(F.lit(split).alias("split"), i.alias("place"), p["input"].alias("input"), p["output"].alias("output")))

    return F.concat(of("test"), of("train"))


def _examples(records: DataFrame, name: str) -> DataFrame:
    """({name}_id, split, place, input, output) of all examples."""
    return records.select(F.col("record_id").alias(f"{name}_id"), F.explode(_listed(F.col("task"))).alias("e")).select(f"{name}_id", "e.*")


def _shape(g: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(grids.height(g).alias("h"), grids.width(g).alias("w"), F.array_join(grids.color_multiplicities(g), ",").alias("counts")))


def _met(left: Column, right: Column) -> Column:
    """The colours that stand at the same cells of two grids of one shape; none where both are absent."""
    both = F.zip_with(F.flatten(left), F.flatten(right), lambda a, b: F.struct(a.alias("key"), b.alias("value")))
    return F.coalesce(F.array_distinct(both), F.array().cast("array<struct<key:int,value:int>>"))


def _one_to_one(colors: Column) -> Column:
    side = lambda name: F.size(F.array_distinct(F.transform(colors, lambda c: c[name])))
    return (side("key") == F.size(colors)) & (side("value") == F.size(colors))


def _sides(e: Column, on_its_side: bool = False) -> Column:
    """An example's split, and the heights and widths of its grids; where it is on its side, widths and heights."""
    ends = (grids.width, grids.height) if on_its_side else (grids.height, grids.width)
    return F.struct(e["split"].alias("split"), F.array(*[F.coalesce(end(e[g]), F.lit(-1)) for g in ("input", "output") for end in ends]).alias("shape"))


def _numbered(e: Column) -> Column:
    """(key, place, names) of an example: one becomes another by a bijection of colours just where keys are equal, name by name.

    A key is the split, the shapes and the cells, each as the place of its colour among the colours as they first appear, names.
    """
    cells = F.concat(F.flatten(e["input"]), F.coalesce(F.flatten(e["output"]), F.array().cast("array<int>")))
    key = lambda c, n: F.struct(_sides(e).alias("sides"), F.transform(c, lambda x: F.array_position(n, x)).alias("places"))
    return grids.bound(cells, lambda c: grids.bound(F.array_distinct(c), lambda n: F.struct(key(c, n).alias("key"), e["place"].alias("place"), n.alias("names"))))


def partners(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(left_id, right_id, turns): the examples of right that each turned example of left can become, a pair in one row.

    turns: (turn, steps) of the transforms that leave no example without a partner; a step is
    an example (choices, split, i, options), those with the fewest partners first, an option (split, i, j, colors).
    The row of a pair has at most eight times examples squared options: for tasks of few examples.
    """
    left = pairs.select(*PAIR).join(records.select(F.col("record_id").alias("left_id"), F.col("task").alias("l")).hint("merge"), "left_id")
    both = left.join(records.select(F.col("record_id").alias("right_id"), F.col("task").alias("r")).hint("merge"), "right_id")
    listed = both.select(*PAIR, _listed(F.col("l")).alias("l"), _listed(F.col("r")).alias("r"))
    fit = lambda on_its_side: F.size(F.array_except(F.transform("l", lambda e: _sides(e, on_its_side)), F.transform("r", lambda e: _sides(e)))) == 0
    seen = listed.select(*PAIR, "l", F.transform("r", _numbered).alias("seen"), fit(False).alias("upright"), fit(True).alias("lying"))

    def step(e: Column) -> Column:
        colors = lambda o: F.sort_array(F.zip_with(e["names"], o["names"], lambda a, b: F.struct(a.alias("key"), b.alias("value"))))
        split = e["key"]["sides"]["split"]
        option = lambda o: F.struct(split.alias("split"), e["place"].alias("i"), o["place"].alias("j"), colors(o).alias("colors"))
        options = F.transform(F.filter("seen", lambda o: o["key"] == e["key"]), option)
        return grids.bound(options, lambda o: F.struct(F.size(o).alias("choices"), split.alias("split"), e["place"].alias("i"), o.alias("options")))

    moved = lambda turn: lambda e: F.struct(e["split"].alias("split"), e["place"].alias("place"), turn(e["input"]).alias("input"), F.when(e["output"].isNotNull(), turn(e["output"])).alias("output"))
    turned = [F.when(F.col("lying" if name in LYING else "upright"), F.struct(F.lit(k).alias("turn"), F.transform("l", moved(turn)).alias("examples"))) for k, (name, turn) in enumerate(grids.D4.items())]
    turns = F.transform(F.filter(F.array(*turned), lambda t: t.isNotNull()), lambda t: F.struct(t["turn"].alias("turn"), F.sort_array(F.transform(F.transform(t["examples"], _numbered), step)).alias("steps")))
    return seen.select(*PAIR, F.filter(turns, lambda t: F.forall(t["steps"], lambda s: s["choices"] > 0)).alias("turns"))


def _in_row(turns: Column, max_states: int) -> Column:
    """(explored, best) of a pair, all its transforms searched one after another: for pairs that can't have many states at once.

    A transform that alone passes the bound of states goes no further.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    state = F.struct(none("struct<key:int,value:int>").alias("colors"), none("struct<split:string,j:int>").alias("taken"), none("struct<split:string,i:int,j:int>").alias("placed"))

    def grow(s: Column, options: Column) -> Column:
        place = lambda o: F.struct(o["split"].alias("split"), o["j"].alias("j"))
        free = F.filter(options, lambda o: ~F.array_contains(s["taken"], place(o)))
        grown = lambda o: F.struct(
            F.sort_array(F.array_union(s["colors"], o["colors"])).alias("colors"), F.sort_array(F.concat(s["taken"], F.array(place(o)))).alias("taken"), F.concat(s["placed"], F.array(F.struct(o["split"].alias("split"), o["i"].alias("i"), o["j"].alias("j")))).alias("placed")
        )
        return F.filter(F.transform(free, grown), lambda n: _one_to_one(n["colors"]))

    def level(acc: Column, step: Column) -> Column:
        # of states that agree the first stays, which has the least places
        merged = lambda g: F.filter(g, lambda n, k: (k == 0) | (F.struct(n["colors"], n["taken"]) != grids.bound(F.get(g, k - 1), lambda b: F.struct(b["colors"], b["taken"]))))
        grown = F.sort_array(F.flatten(F.transform(F.filter(acc["states"], lambda s: acc["explored"] <= max_states), lambda s: grow(s, step["options"]))))
        return grids.bound(grids.bound(grown, merged), lambda m: F.struct(m.alias("states"), (acc["explored"] + F.size(m)).alias("explored")))

    def searched(t: Column) -> Column:
        last = F.aggregate(t["steps"], F.struct(F.array(state).alias("states"), F.lit(1).cast("long").alias("explored")), lambda acc, s: level(acc, s).cast(acc_type))
        best = lambda s: F.struct(t["turn"].alias("turn"), F.sort_array(s["placed"]).alias("placed"), s["colors"].alias("colors"))
        return grids.bound(last, lambda e: F.struct(e["explored"].alias("explored"), F.array_min(F.transform(e["states"], best)).alias("best")))

    acc_type = "struct<states:array<struct<colors:array<struct<key:int,value:int>>,taken:array<struct<split:string,j:int>>,placed:array<struct<split:string,i:int,j:int>>>>,explored:bigint>"
    found = F.transform(turns, searched)
    return grids.bound(found, lambda f: F.struct(F.aggregate(f, F.lit(0).cast("long"), lambda n, x: n + x["explored"]).alias("explored"), F.array_min(F.transform(f, lambda x: x["best"])).alias("best")))


def _dealt_partners(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(left_id, right_id, turn, split, i, j, colors): the examples of right that each turned example of left can become."""
    turned = [F.struct(F.lit(k).alias("turn"), turn(F.col("input")).alias("input"), F.when(F.col("output").isNotNull(), turn(F.col("output"))).alias("output")) for k, turn in enumerate(grids.D4.values())]
    left = _examples(records.join(pairs.select(F.col("left_id").alias("record_id")).distinct(), "record_id", "left_semi"), "left")
    left = left.select("left_id", "split", F.col("place").alias("i"), F.explode(F.array(*turned)).alias("t")).select("left_id", "split", "i", "t.turn", F.col("t.input").alias("a"), F.col("t.output").alias("b"))
    right = _examples(records.join(pairs.select(F.col("right_id").alias("record_id")).distinct(), "record_id", "left_semi"), "right")
    right = right.select("right_id", "split", F.col("place").alias("j"), F.col("input").alias("c"), F.col("output").alias("d"))
    shapes = lambda a, b: F.struct(_shape(F.col(a)).alias("input"), _shape(F.col(b)).alias("output"))
    met = pairs.join(left.withColumn("shape", shapes("a", "b")), "left_id").join(right.withColumn("shape", shapes("c", "d")), ["right_id", "split", "shape"])
    colors = F.array_sort(F.array_union(_met(F.col("a"), F.col("c")), _met(F.col("b"), F.col("d"))))
    return met.select(*NODE, "split", "i", "j", colors.alias("colors")).where(_one_to_one(F.col("colors")))


def _levels(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """partners with the level of their example: those with the fewest partners first; transforms that leave an example without any are gone."""
    example = [*NODE, "split", "i"]
    choices = found.groupBy(example).agg(F.count("*").alias("choices"))
    whole = choices.groupBy(NODE).agg(F.count("*").alias("n")).join(sizes, PAIR).where("n = examples").select(*NODE, "n")
    order = Window.partitionBy(NODE).orderBy("choices", "split", "i")
    placed = choices.join(whole, NODE).withColumn("level", F.row_number().over(order)).drop("choices")
    return found.join(placed.hint("merge"), example)


def forms(records: DataFrame) -> DataFrame:
    """(record_id, form, n_train, n_test, names, task): the task with its colours numbered as they first appear, names being those colours.

    Tasks that differ in nothing but colours have one form, a digest. A search
    meets the same states for them, for it only asks which colours stand at the
    same cells.
    """
    rows = lambda p: F.concat(p["input"], F.coalesce(p["output"], F.array().cast("array<array<int>>")))
    names = F.array_distinct(F.flatten(F.flatten(F.transform(F.concat("task.train", "task.test"), rows))))
    number = lambda n: lambda g: F.transform(g, lambda r: F.transform(r, lambda c: F.array_position(n, c).cast("int") - 1))
    made = records.select("record_id", names.alias("names"), grids.bound(names, lambda n: grids.transform_task(F.col("task"), number(n))).alias("task"))
    return made.select("record_id", F.sha2(F.to_json(F.struct("task.train", "task.test")), 256).alias("form"), F.size("task.train").alias("n_train"), F.size("task.test").alias("n_test"), "names", "task")


def _search(alike: DataFrame, records: DataFrame, max_states: int) -> DataFrame:
    """(left_id, right_id, explored, best) of pairs (left_id, right_id, examples); pairs without any state have no row."""
    few = F.col("examples") <= EXAMPLES_IN_ROW
    # written whole, then filtered: a filter would be pushed below what its column is made of, and make that anew for each example
    found = shared.written(partners(alike.where(few), records)).where(F.size("turns") > 0)
    states = F.transform("turns", lambda t: F.aggregate(t["steps"], F.lit(1.0), lambda n, s: n * s["choices"]))
    narrow = F.forall(states, lambda n: n <= STATES_IN_ROW)
    ends = found.where(narrow).select(*PAIR, _in_row(F.col("turns"), max_states).alias("end")).select(*PAIR, "end.explored", "end.best")
    step = found.where(~narrow).select(*PAIR, F.explode("turns").alias("t")).select(*PAIR, "t.turn", F.size("t.steps").cast("long").alias("n"), F.posexplode("t.steps").alias("level", "step"))
    steps = step.select(*NODE, "n", (F.col("level") + 1).alias("level"), F.explode("step.options").alias("o")).select(*NODE, "n", "level", "o.*")
    many = alike.where(~few)
    if not many.isEmpty():
        dealt = _levels(shared.written(_dealt_partners(many.select(*PAIR), records)), many)
        steps = steps.unionByName(dealt.select(*steps.columns))
    steps = shared.written(steps)
    return ends if steps.isEmpty() else ends.unionByName(_by_levels(steps, max_states))


def _by_levels(steps: DataFrame, max_states: int) -> DataFrame:
    """(left_id, right_id, explored, best) of pairs whose examples' partners are in steps, a join for each level."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = steps.select(*NODE, "n").distinct()
    within_pair = Window.partitionBy(*PAIR)
    # spent: the pair's states so far, on each of its states
    states = start.select("*", F.count("*").over(within_pair).alias("spent"), none("struct<key:int,value:int>").alias("colors"), none("struct<split:string,j:int>").alias("taken"), none("struct<split:string,i:int,j:int>").alias("placed"))
    levels = [states]
    for level in range(1, (steps.agg(F.max("level")).first()[0] or 0) + 1):
        options = steps.where(F.col("level") == level).select(*NODE, "split", "i", "j", F.col("colors").alias("own"))
        joined = states.where(F.col("spent") <= max_states).join(options.hint("merge"), NODE).where(~F.array_contains("taken", F.struct("split", "j")))
        grown = joined.select(
            *NODE, "n", "spent", F.array_sort(F.array_union("colors", "own")).alias("colors"), F.array_sort(F.concat("taken", F.array(F.struct("split", "j")))).alias("taken"), F.concat("placed", F.array(F.struct("split", "i", "j"))).alias("placed")
        ).where(_one_to_one(F.col("colors")))
        merged = grown.groupBy(*NODE, "n", "spent", "colors", "taken").agg(F.min("placed").alias("placed"))
        states = shared.written(merged.withColumn("spent", F.col("spent") + F.count("*").over(within_pair)).select(*levels[0].columns))
        levels.append(states)
    best = F.when(F.size("placed") == F.col("n"), F.struct("turn", F.array_sort("placed").alias("placed"), "colors"))
    return reduce(DataFrame.union, levels).groupBy(PAIR).agg(F.max("spent").alias("explored"), F.min(best).alias("best"))


def verify_pairs(pairs: DataFrame, records: DataFrame, max_states: int = MAX_STATES) -> DataFrame:
    """(left_id, right_id, status, explored, d4, color, train_permutation, test_permutation) of pairs of records (record_id, task).

    explored counts the states of all eight transforms, the empty one of each that
    leaves every example a partner included. status: matched, with the first
    transform's witness; inconclusive where explored would pass max_states
    (explored is the bound then); not-isomorphic. A pair with a record that is not
    there has no row; equal pairs are one. Pairs of equal forms are searched once.
    records may be what forms has made of them, written, for many calls.
    """
    asked_for = pairs.select(*PAIR).distinct()
    made = records
    if "form" not in records.columns:
        ids = asked_for.select(F.explode(F.array(*PAIR)).alias("record_id")).distinct()
        made = shared.written(forms(records.join(ids.hint("merge"), "record_id", "left_semi")))
    side = lambda name: made.select(*[F.col(c).alias(f"{name}_{c}") for c in ("form", "n_train", "n_test", "names")], F.col("record_id").alias(f"{name}_id")).hint("merge")
    asked = shared.written(asked_for.join(side("left"), "left_id").join(side("right"), "right_id"))
    both = [F.col(f"{name}_form").alias(f"{name}_id") for name in ("left", "right")]
    alike = shared.written(asked.where("left_n_train = right_n_train and left_n_test = right_n_test").select(*both, (F.col("left_n_train") + F.col("left_n_test")).alias("examples")).distinct())
    needed = alike.select(F.explode(F.array(*PAIR)).alias("form")).distinct()
    # one record of each form stands for it: these are chosen by narrow rows, the tasks follow
    chosen = shared.written(made.select("form", "record_id").join(needed.hint("merge"), "form", "left_semi").groupBy("form").agg(F.min("record_id").alias("record_id")))
    tasks = shared.written(made.select("record_id", "task").join(chosen, "record_id").select(F.col("form").alias("record_id"), "task"))
    ends = _search(alike, tasks, max_states).select(F.col("left_id").alias("left_form"), F.col("right_id").alias("right_form"), "explored", "best")
    last = asked.select(*PAIR, "left_names", "right_names", "left_form", "right_form").join(ends.hint("merge"), ["left_form", "right_form"], "left").withColumn("explored", F.coalesce("explored", F.lit(0)))
    over, found = F.col("explored") > max_states, F.col("best").isNotNull()
    sure = lambda c: F.when(found & ~over, c)
    own = lambda c: F.struct(F.get("left_names", c["key"]).alias("key"), F.get("right_names", c["value"]).alias("value"))
    order = lambda split: F.transform(F.filter("best.placed", lambda p: p["split"] == split), lambda p: p["j"])
    return shared.written(
        last.select(
            *PAIR, F.when(over, "inconclusive").when(found, "matched").otherwise("not-isomorphic").alias("status"), F.least("explored", F.lit(max_states)).cast("int").alias("explored"),
            sure(F.element_at(F.array(*map(F.lit, grids.D4)), F.col("best.turn") + 1)).alias("d4"), sure(F.map_from_entries(F.sort_array(F.transform("best.colors", own)))).alias("color"), sure(order("train")).alias("train_permutation"), sure(order("test")).alias("test_permutation"),
        )
    )
