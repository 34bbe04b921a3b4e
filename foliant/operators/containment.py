"""An index over JSON and lists of texts: which rows contain a value, by the hashes of its leaves, with a second look at the rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import containment

ITEMS = "column string, item long, id string, document_id string"


def entries(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, item, id, document_id: a row for each leaf of the JSON texts, or of the arrays, in some columns."""
    kinds = dict(rows.dtypes)
    each = [F.struct(F.lit(c).alias("column"), (containment.items(F.to_json(c) if kinds[c].startswith("array") else F.col(c))).alias("items")) for c in columns]
    found = rows.select("id", "document_id", F.explode(F.array(*each)).alias("x"))
    return found.select("x.column", F.explode("x.items").alias("item"), "id", "document_id")


def containing(rows: DataFrame, index: DataFrame, column: str, part: Any) -> DataFrame:
    """The rows whose column contains the value. Rows that have all of its leaves are looked up and looked at once more, since leaves
    may lie in different elements of a list; a value without leaves, such as {}, asks for all rows."""
    wanted = containment.hashes(part)
    kind = dict(rows.dtypes)[column]
    if wanted:
        found = index.where((F.col("column") == column) & F.col("item").isin(wanted)).groupBy("id").agg(F.count_distinct("item").alias("n"))
        rows = rows.join(found.where(F.col("n") == len(wanted)).select("id"), "id", "left_semi")
    return rows.where(containment.contains(F.to_json(column) if kind.startswith("array") else F.col(column), part))
