"""Maps, arrays and JSON as metadata hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(*maps: Column) -> Column:
    """The entries of all maps, by key; of equal keys the last map's counts, and a null map has none. It needs no setting of the
    session: entries stand from the last map to the first, and the first of each key stays."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(m), none) for m in reversed(maps)]))
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.array_sort(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)))


def last(values: Column) -> Column:
    """The last element; null for an empty or null array."""
    return F.try_element_at(values, F.lit(-1))


def json_value(text: Column, path: str, kind: str = "string", default: str | int | float | bool | None = None) -> Column:
    """What a JSON text has at a path, or a default where it has nothing or null there or isn't JSON."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), path, kind), F.lit(default).cast(kind))


def json_text(value: Column) -> Column:
    """A map, struct or array as JSON; an empty object for null."""
    return F.coalesce(F.to_json(value), F.lit("{}"))
