"""JSON containment, as `@>` has it: an object has all keys of the other with values that contain theirs, a list an element that contains each."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType


def leaves(value: Any, path: str = "") -> Iterator[str]:
    """Paths with scalars at their ends, without places in lists; what contains a value has all of its leaves."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from leaves(inner, f"{path}{json.dumps(key)}:")
    elif isinstance(value, list):
        for inner in value:
            yield from leaves(inner, f"{path}[]")
    else:
        yield f"{path}={json.dumps(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value)}"


def hashes(value: Any) -> list[int]:
    found = (xxhash.xxh64_intdigest(x) for x in set(leaves(value)))
    return sorted(h - (1 << 64) if h >> 63 else h for h in found)


def holds(whole: Any, part: Any, top: bool = True) -> bool:
    """Whether a value contains another. A list at the top contains a scalar that it has."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and holds(whole[k], v, False) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(holds(w, p, False) for w in whole) for p in part)
    if top and isinstance(whole, list):
        return any(holds(w, part, False) for w in whole)
    return not isinstance(whole, (dict, list)) and isinstance(whole, bool) == isinstance(part, bool) and whole == part


def _parsed(text: str | None) -> Any:
    """The value of a JSON text; an object that nothing but {} is contained in for what is none."""
    try:
        return json.loads(text) if text is not None else {}
    except ValueError:
        return {}


@F.pandas_udf(ArrayType(LongType()))
def items(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hashes of the leaves of a JSON text."""
    for part in values:
        yield part.map(lambda x: hashes(_parsed(x)))


def contains(value: Column, part: Any) -> Column:
    """Whether the JSON text contains a value; null where it is null or no JSON."""

    @F.pandas_udf(BooleanType())
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in values:
            yield some.map(lambda x: holds(_parsed(x), part))

    return F.when(F.try_parse_json(value).isNotNull(), run(value))
