"""Row numbers over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window


def bounds(df: DataFrame, order: str, parts: int, sample: int = 10_000) -> list:
    """Up to parts - 1 values that cut those of a column into ranges of about the same number of rows. Of values other than numbers
    about `sample`, picked by their hashes, tell them."""
    if isinstance(df.schema[order].dataType, NumericType):
        found = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
        return sorted(set(found or []))
    some = df.where(F.col(order).isNotNull())
    share = min(1.0, sample / max(1, some.count()))
    values = sorted(r[0] for r in some.where(F.pmod(F.xxhash64(order), F.lit(1 << 40)) < int(share * (1 << 40))).select(order).distinct().collect())
    return sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []


def numbered(df: DataFrame, order: str, name: str, descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with its rows' numbers, from 1, by a column whose values differ; null comes first.

    The column's values are cut into `parts` ranges, by bounds that are fixed beforehand, and rows are numbered within their range;
    the ranges' counts, one row each, are summed up in a single small task and added.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(df, order, parts)
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda b: b < F.col(order))) if cuts else F.lit(0)
    ranged = df.withColumn("__part", F.when(F.col(order).isNull(), 0).otherwise(part))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    # One row for each range, so the table is as small as `parts` says.
    found = ranged.withColumn("__within", F.row_number().over(Window.partitionBy("__part").orderBy(F.col(order).asc_nulls_first()))).join(F.broadcast(starts), "__part")
    number = F.col("__start") + F.col("__within")
    return found.withColumn(name, F.col("__all") + 1 - number if descending else number).drop("__part", "__within", "__start", "__all")
