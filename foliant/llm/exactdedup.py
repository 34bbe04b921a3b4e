"""Exact dedup: a persistent digest index, bucketed and sorted by hash; new rows are anti-joined with it and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import Runs
from .shared import SPACE, batch_of, batches, column, workspace, written


def normalised(text):
    """text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """order (the id) and digest (32 bytes, SHA-256 of the normalised text) of each row."""
    return docs.select(column(id_col).alias("order"), F.unhex(F.sha2(normalised(column(text_col).cast("string")), 256)).alias("digest"))


def keyed(df: DataFrame) -> DataFrame:
    """With h1, h2 from the first 16 bytes of the digest, as the runs want it."""
    part = lambda at: F.conv(F.hex(F.substring("digest", at, 8)), 16, -10).cast("long")
    return df.withColumns({"h1": part(1), "h2": part(9)})


def add(index: Runs, new: DataFrame) -> None:
    """Puts the digests of new rows (order, digest) into the index. A digest that the index has keeps its row there;
    of equal new ones, the smallest order is stored, and null only where there is no other."""
    index.add(keyed(new).groupBy("h1", "h2").agg(F.min("order").alias("keep_order")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_batches: int = 4, fanout: int = 2, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size (rows of docs with this text), kept, text_sha256.

    path: where the index lies or shall lie, and stays: rows whose text an earlier call has brought are dropped in favour of the row
    that stayed then. Without one the index is thrown away. buckets: of a new index.

    Rows arrive in n_batches batches of ascending id, so the row that stays is the one with the smallest id. Ids may be of any type
    that can be sorted; texts sort by their bytes, so "10" is before "9". Null ids come after all others, and a null text equals an empty one. Of rows with the same id and text all are kept or dropped alike. An empty
    table gives no rows. Other columns of docs are not read, whatever their names.
    """
    spark, at = docs.sparkSession, workspace(docs.sparkSession, "exact")
    found = digests(docs, id_col, text_col)
    stored = keyed(written(found, f"{at}/digests"))
    cuts = batches(stored, "order", n_batches)
    index = Runs(spark, path or f"{at}/index", fanout, buckets)
    for i in range(len(cuts) + 1):
        add(index, stored.where(batch_of(F.col("order"), cuts) == i))
    sizes = stored.groupBy("h1", "h2").agg(F.count("*").alias("group_size"))
    groups = index.all().join(sizes, ["h1", "h2"])
    groups = written(groups, f"{at}/groups")
    return stored.join(groups, ["h1", "h2"]).select(
        F.col("order").alias(id_col),
        F.col("keep_order").alias("keep_id"),
        "group_size",
        F.col("order").eqNullSafe(F.col("keep_order")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
