"""Mixing sources to target weights: repetition rates from token totals, whole copies and one Bernoulli copy by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, column, workspace, written

#: A document is never taken more often than this.
MOST = 3
#: Weights of the sources in their order, repeated.
WEIGHTS = (1, 2, 3)
SEED = 20


def words(text: Column) -> Column:
    """Number of runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of key: the same in each run, on any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def totals(sized: DataFrame, path: str) -> DataFrame:
    """source, source_size, and place: the source's place among all by code point, from 0, null last.

    Sources are ranged over the partitions and numbered there; only a count for each partition is summed up in one task.
    """
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), f"{path}/totals")
    ranged = sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, f"{path}/ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranged.withColumn("nth", F.row_number().over(within)).join(starts, "part").select("source", "source_size", (F.col("start") + F.col("nth") - 1).alias("place"))


def targets(sized: DataFrame, path: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target.

    The sum of all sizes is shared by weight. Where a share is above `most` times the source's size it is set to that, and the
    excess is shared again among the others, until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(totals(sized, path).withColumn("weight", weight), f"{path}/weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > most * F.col("source_size")
        full, rest, n = table.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == held or not rest:
            break
        level, held = float(total - most * (full or 0)) / float(rest), n
    share = F.least(F.col("weight") * F.lit(level or 0.0), most * F.col("source_size").cast("double"))
    return table.select("source", "source_size", share.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """id, source, size, source_size, target and copies (how often the mix takes the row) for each row of docs.

    A source's rate is its target over its size. A row is taken floor(rate) times, and once more with the probability of the
    fraction, decided by a hash of id and seed: rows with the same id are decided alike, null ids too. Null sources are a source
    of their own. A source without words has the rate 0. An empty table gives no rows. Only the three named columns are read.
    """
    path = workspace(docs.sparkSession, "mix")
    sized = docs.select(column(id_col).alias("id"), column(source_col).cast("string").alias("source"), words(column(text_col)).alias("size"))
    sized = written(sized, f"{path}/sized")
    shares = written(targets(sized, path, weights, most), f"{path}/targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    copies = F.floor("rate") + (uniform(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    out = sized.join(shares, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, each as often as mix_plan() says.

    Rate and copies depend on a row's source and id alone, so the plan's join is on the few sources, not on the rows. Null ids,
    sources and texts, repeated rows and an empty table are dealt with as in mix_plan(); a text without words is taken as its source
    is. Other columns may have any name and type.
    """
    path = workspace(docs.sparkSession, "mixed")
    sized = docs.select(column(source_col).cast("string").alias("source"), words(column(text_col)).alias("size"))
    shares = written(targets(sized, path, weights, most), f"{path}/targets")
    rates = shares.select(F.col("source").alias("of"), F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"))
    whole = docs.select(F.struct("*").alias("row"), column(source_col).cast("string").alias("source"), column(id_col).alias("id"))
    out = whole.join(rates, F.col("source").eqNullSafe(F.col("of")))
    copies = F.floor("rate") + (uniform(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("n", copies).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")
