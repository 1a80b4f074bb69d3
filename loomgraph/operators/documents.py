"""JSON documents of any depth as lists of leaves, all by expressions: flattened over variants, changed on paths, written again.

A leaf is (path, json): path holds a step (name, pos) per level, pos being null for object keys, json the text of a scalar or
of an empty object or array. A document without leaves does not exist: a scalar is the leaf of the empty path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = "array<struct<name:string,pos:int>>"
LEAVES = f"array<struct<path:{PATH},json:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row, also where use has it in lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def no_path() -> Column:
    return F.from_json(F.lit("[]"), PATH)


def depth(document: Column) -> Column:
    """How deep objects and arrays are nested in a JSON text."""
    marks = F.regexp_replace(F.regexp_replace(document, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, mark: Column) -> Column:
        now = s["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), start, step)["most"]


def leaves(document: Column, arrays: bool = True) -> Column:
    """The leaves of a JSON text in order of their paths; without arrays an array is a leaf as a whole. Null for null, an error for no JSON."""

    def below(x: Column, name: Column, pos: Column, value: Column) -> Column:
        return F.struct(F.concat(x["path"], F.array(F.struct(name.alias("name"), pos.cast("int").alias("pos")))).alias("path"), value.alias("v"))

    def opened(x: Column) -> Column:
        held = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))
        out = F.when(F.size(held) > 0, F.transform(held, lambda e: below(x, e["key"], F.lit(None), e["value"])))
        if arrays:
            items = F.try_variant_get(x["v"], "$", "array<variant>")
            out = out.when(F.size(items) > 0, F.transform(items, lambda e, i: below(x, F.lit(None).cast("string"), i, e)))
        return out.otherwise(F.array(x))

    def all_of(text: Column) -> Column:
        start = F.array(F.struct(no_path().alias("path"), F.parse_json(text).alias("v")))
        levels = F.sequence(F.lit(1), F.greatest(depth(text), F.lit(1)))
        flat = F.aggregate(levels, start, lambda acc, _: F.flatten(F.transform(acc, opened)))
        texts = F.transform(flat, lambda x: F.struct(x["path"].alias("path"), F.coalesce(F.to_json(x["v"]), F.lit("null")).alias("json")))
        return F.when(text.isNotNull(), F.array_sort(texts))

    return let(document, all_of)


def _quoted(name: Column) -> Column:
    """A name as a JSON string."""
    text = F.to_json(F.array(name))
    return F.when(name.rlike(r"^[A-Za-z0-9_ .-]*$"), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def _close(path: Column, least: Column) -> Column:
    """The brackets that close the levels of path from the last one back to level least."""
    n = F.size(path)
    part = F.slice(path, least, F.greatest(n - least + 1, F.lit(0)))
    return F.reverse(F.array_join(F.transform(part, lambda s: F.when(s["pos"].isNull(), "}").otherwise("]")), ""))


def _label(step: Column) -> Column:
    return F.when(step["pos"].isNull(), F.concat(_quoted(step["name"]), F.lit(":"))).otherwise("")


def _open(path: Column, least: Column) -> Column:
    """Brackets and labels of the levels of path from least on."""
    part = F.slice(path, least, F.greatest(F.size(path) - least + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda s: F.concat(F.when(s["pos"].isNull(), "{").otherwise("["), _label(s))), "")


def written(parts: Column) -> Column:
    """The JSON text of leaves, in one pass: between neighbours brackets close and open where their paths part.

    No leaf's path may begin with another's; array places must be without gaps. Keys come in order of their names.
    """
    start = F.struct(no_path().alias("path"), F.lit("").alias("text"))

    def step(s: Column, leaf: Column) -> Column:
        path, last = leaf["path"], s["path"]
        apart = F.array_position(F.zip_with(path, last, lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False))), False)
        apart = F.when(apart > 0, apart).otherwise(F.size(path) + 1).cast("int")  # the first level at which they differ
        between = F.concat(_close(last, apart + 1), F.lit(","), _label(F.get(path, apart - 1)), _open(path, apart + 1))
        lead = F.when(s["text"] == "", _open(path, F.lit(1))).otherwise(between)
        return F.struct(path.alias("path"), F.concat(s["text"], lead, leaf["json"]).alias("text"))

    return let(F.aggregate(F.array_sort(parts), start, step), lambda end: F.concat(end["text"], _close(end["path"], F.lit(1))))


def renamed(parts: Column, change) -> Column:
    """Leaves whose object keys are changed by an expression of the name; of keys that become equal below one object all leaves must differ."""
    step = lambda s: F.struct(F.when(s["pos"].isNull(), change(s["name"])).alias("name"), s["pos"].alias("pos"))
    return F.transform(parts, lambda x: F.struct(F.transform(x["path"], step).alias("path"), x["json"].alias("json")))


def _key(path: Column) -> Column:
    """A path as a text that no other path has: a mark of its own before each level."""
    mark = "\u0001"
    return F.array_join(F.transform(path, lambda s: F.coalesce(F.concat(F.lit(mark), F.replace(s["name"], F.lit(mark), F.lit(mark + "1"))), F.concat(F.lit(mark + "0"), s["pos"].cast("string")))), "")


def _prefixes(path: Column, whole: bool) -> Column:
    n = F.size(path) if whole else F.size(path) - 1
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: _key(F.slice(path, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))


def merged(first: Column, second: Column) -> Column:
    """Leaves of objects merged key by key, the second winning; arrays and scalars are replaced as a whole.

    Both were made without arrays. Conflicts are found by intersecting sets of paths, so the work grows with the leaves, not with their pairs.
    """
    paths = lambda parts: F.transform(parts, lambda x: _key(x["path"]))
    above = lambda parts, whole: F.flatten(F.transform(parts, lambda x: _prefixes(x["path"], whole)))
    bare = lambda parts: F.filter(parts, lambda x: x["json"] == "{}")
    other = lambda parts: F.filter(parts, lambda x: x["json"] != "{}")

    def conflicts(d: Column) -> Column:
        one, two = d["one"], d["two"]
        return F.struct(
            one.alias("one"),
            two.alias("two"),
            # what the second says at a place of the first or above it
            F.array_intersect(above(one, True), paths(other(two))).alias("over"),
            # places of the first below which the second goes on; an empty object of the second replaces what is no object,
            F.concat(F.array_intersect(paths(one), above(two, False)), F.array_intersect(paths(other(one)), paths(bare(two)))).alias("gone"),
            # and is nothing new to an object
            F.array_intersect(paths(bare(two)), F.concat(above(one, False), paths(bare(one)))).alias("objects"),
        )

    def resolved(d: Column) -> Column:
        kept = F.filter(d["one"], lambda x: ~F.arrays_overlap(_prefixes(x["path"], True), d["over"]) & ~F.array_contains(d["gone"], _key(x["path"])))
        return F.concat(kept, F.filter(d["two"], lambda x: ~((x["json"] == "{}") & F.array_contains(d["objects"], _key(x["path"])))))

    return let(let(F.struct(first.alias("one"), second.alias("two")), conflicts), resolved)


def put(leaves_: Column, steps: list[str | int], value: Column) -> Column:
    """Leaves with those of a JSON text at a path; missing objects and array places are made, places in between are null.

    Null where the path leads through a scalar, or through an object by a place or an array by a name; a null counts as missing.
    """
    return let(leaves_, lambda parts: _put(parts, steps, value))


def _put(parts: Column, steps: list[str | int], value: Column) -> Column:
    whole = F.array(*(F.struct((F.lit(s) if isinstance(s, str) else F.lit(None).cast("string")).alias("name"), (F.lit(s) if isinstance(s, int) else F.lit(None)).cast("int").alias("pos")) for s in steps))
    n = len(steps)
    begins = lambda path, k: F.slice(path, 1, k) == F.slice(whole, 1, k)

    def stands_in(k: int) -> Column:
        """Whether a scalar ends above step k, or steps of the other kind stand beside it."""
        name = isinstance(steps[k], str)
        ends = F.exists(parts, lambda x: (F.size(x["path"]) == k) & begins(x["path"], k) & ~x["json"].isin("null", "{}" if name else "[]"))
        mixed = F.exists(parts, lambda x: (F.size(x["path"]) > k) & begins(x["path"], k) & (F.get(x["path"], k)["pos"].isNotNull() if name else F.get(x["path"], k)["pos"].isNull()))
        return ends | mixed

    def gaps(k: int, place: int) -> Column:
        """Nulls for the places that an array lacks before place."""
        there = F.filter(kept, lambda x: (F.size(x["path"]) > k) & begins(x["path"], k))
        last = F.coalesce(F.array_max(F.transform(there, lambda x: F.get(x["path"], k)["pos"])), F.lit(-1))
        missing = F.when(last < place - 1, F.sequence(last + 1, F.greatest(last + 1, F.lit(place - 1)))).otherwise(F.array().cast("array<int>"))
        step = lambda i: F.array(F.struct(F.lit(None).cast("string").alias("name"), i.alias("pos")))
        return F.transform(missing, lambda i: F.struct(F.concat(F.slice(whole, 1, k), step(i)).alias("path"), F.lit("null").alias("json")))

    blocked = stands_in(0)
    for k in range(1, n):
        blocked = blocked | stands_in(k)
    kept = F.filter(parts, lambda x: ~F.when(F.size(x["path"]) >= n, begins(x["path"], n)).otherwise(x["path"] == F.slice(whole, F.lit(1), F.size(x["path"]))))
    fresh = F.transform(leaves(value), lambda x: F.struct(F.concat(whole, x["path"]).alias("path"), x["json"].alias("json")))
    filled = F.concat(kept, fresh, *(gaps(k, place) for k, place in enumerate(steps) if isinstance(place, int) and place > 0))
    return F.when(~blocked, filled)
