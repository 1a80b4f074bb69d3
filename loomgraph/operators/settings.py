"""Paths and merges of nested settings, as maps from dotted paths to JSON values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators import documents as J


def get_path(settings: Column, path: str, default: Column | None = None, strict: bool = False) -> Column:
    """The value at a path such as a.b[0]; where it is missing the default, an error if strict, else null. A JSON null counts as missing."""
    found = F.get_json_object(settings, "$." + path if path else "$")
    if strict:
        return F.coalesce(found, F.raise_error(F.lit(f"setting path '{path}' not found")).cast("string"))
    return found if default is None else F.coalesce(found, default)


def get_setting(settings: Column, category: str, setting: str, strict: bool = False) -> Column:
    """A setting of a category; the parts of a.b and the setting may be written in kebab-case or camelCase."""
    return get_path(settings, ".".join(_snake(part) for part in [*category.split("."), setting]), strict=strict)


def get_category(settings: Column, category: str, strict: bool = False) -> Column:
    """All settings of a category, as JSON."""
    return get_path(settings, category, strict=strict)


def _snake(name: str) -> str:
    """An underscore before each capital but a leading one, all in small letters; dashes are underscores, too."""
    return re.sub(r"(?s)(?<=.)([A-Z])", r"_\1", name.replace("-", "_")).translate(_SMALL)


_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def keys_converted(documents: Column, to: str) -> Column:
    """JSON documents with all keys, at any depth, in camelCase (to = "camel") or snake_case ("snake"); keys come in order of their names."""
    change = {"camel": X.camel, "snake": lambda k: F.lower(F.regexp_replace(k, "([A-Z])", "_$1"))}[to]
    return J.written(J.renamed(J.leaves(documents), change))


def set_path(settings: Column, path: str, value: Column) -> Column:
    """settings with a JSON value at a path such as a.b[0]; missing objects and array places are made; keys come in order of their names.

    Null if the path leads through something that is neither object nor array; null settings are an empty object, a null value is JSON's null.
    """
    steps: list[str | int] = [int(i) if i else n for n, i in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path)]
    return J.written(J.put(J.leaves(F.coalesce(settings, F.lit("{}"))), steps, F.coalesce(value, F.lit("null"))))


def deep_merged(first: Column, second: Column) -> Column:
    """Objects merged key by key, the second winning; arrays and scalars are replaced. A null document leaves the other one."""
    both = J.written(J.merged(J.leaves(first, arrays=False), J.leaves(second, arrays=False)))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(both)


def checked_set(settings: Column, path: str, value: Column, types: dict[str, str]) -> Column:
    """struct(settings, error): settings with a JSON value at a dotted path, if every object on the way is one and all typed paths keep their type.

    A name that is missing becomes an object; anything else on the way, null included, is the error "not an object: <name>". types maps
    dotted paths to string, number, whole, boolean or object; the first that no longer holds is "wrong type: <path>". With an error settings
    stay as they were.
    """
    names = path.split(".")
    if not all(names):
        raise ValueError("the path has an empty name")
    at = lambda parts: "$" + "".join(f"['{p}']" for p in parts)
    kind = lambda v, where: F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, where, "variant")), "^[A-Z]+", 0), F.lit("MISSING"))
    held = {"string": ["STRING"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "whole": ["BIGINT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"]}

    def way(v: Column) -> Column:
        error = F.when(kind(v, "$") != "OBJECT", F.lit(f"not an object: {names[0]}"))
        for n in range(1, len(names)):
            error = F.coalesce(error, F.when(~kind(v, at(names[:n])).isin("OBJECT", "MISSING"), F.lit(f"not an object: {names[n - 1]}")))
        return error

    def typed(v: Column) -> Column:
        return F.coalesce(*(F.when(~kind(v, at(p.split("."))).isin(held[t]), F.lit(f"wrong type: {p}")) for p, t in types.items()), F.lit(None).cast("string"))

    def judged(d: Column) -> Column:
        error = F.coalesce(d["error"], F.when(d["new"].isNotNull(), J.let(F.parse_json(d["new"]), typed)))
        return J.let(F.struct(d["new"].alias("new"), error.alias("error")), lambda e: F.struct(F.when(e["error"].isNull(), e["new"]).otherwise(settings).alias("settings"), e["error"].alias("error")))

    made = J.let(J.let(F.parse_json(F.coalesce(settings, F.lit("{}"))), way), lambda error: F.struct(F.when(error.isNull(), set_path(settings, path, value)).alias("new"), error.alias("error")))
    return J.let(made, judged)


def partial_merge(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns overwritten only where the change has a value."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns))


def section_merge(old: Column, new: Column, sections: dict[str, str]) -> Column:
    """Whole sections replaced where the new one parses as its type: sections maps names to DDL types."""
    parts = [F.coalesce(F.from_json(F.get_json_object(new, f"$.{s}"), t), F.from_json(F.get_json_object(old, f"$.{s}"), t)).alias(s) for s, t in sections.items()]
    return F.struct(*parts)


def visible(settings: Column, fields: list[str]) -> Column:
    """Only the named top-level fields, as a map of JSON values; everything else is left out."""
    pairs = F.create_map(*[x for f in fields for x in (F.lit(f), F.get_json_object(settings, f"$.{f}"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())
