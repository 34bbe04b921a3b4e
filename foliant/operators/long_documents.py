"""Structure and chunks of documents that are too long for one task.

A document is dealt to blocks by the values of its order, and blocks to tasks. What a block must know of those before it is small, the
headings that are still open or the last place where packing begins anew, and is found by a prefix over blocks, FAN at a time. The
results are those of structure.analyze() and chunks.build_chunks(), for documents of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch
from . import structure
from .chunks import CHUNK, Sizes, arrow_schema, packable, packing

#: Values of the order in a block: at most so many units of a document come together in a task.
BLOCK = 8192
#: States that one group of a prefix holds; more blocks make more levels.
FAN = 64


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that the cluster shares and read again: what is used twice isn't computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ahead(totals: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    """key, at, before: of each row (key, at, state; key and at are unique) the fold of the states of its key with a lesser `at`.

    fold: from an array of states to a state, associative; an empty array gives the state of nothing, null states are passed over. No task
    holds more than FAN states of a key: they are folded in groups of FAN values of `at`, the groups' states again, and so on up.
    """
    totals = kept(totals.select("key", F.col("at").cast("long").alias("at"), "state"), "prefix")
    least, most = totals.agg(F.min("at"), F.max("at")).first()
    up = F.call_function("div", F.col("at") - F.lit(least or 0), F.lit(FAN))
    grouped = totals.withColumn("up", up)
    earlier = F.collect_list("state").over(Window.partitionBy("key", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    within = grouped.select("key", "up", "at", earlier.alias("earlier"))
    if least is None or most - least < FAN:
        return within.select("key", "at", fold(F.col("earlier")).alias("before"))
    states = F.transform(F.sort_array(F.collect_list(F.struct("at", "state"))), lambda x: x["state"])
    sums = grouped.where("state is not null").groupBy("key", "up").agg(fold(states).alias("state"))
    places = grouped.select("key", "up").distinct().join(sums, ["key", "up"], "left")
    above = ahead(places.withColumnRenamed("up", "at"), fold).withColumnsRenamed({"at": "up", "before": "above"})
    whole = F.filter(F.concat(F.array("above"), F.col("earlier")), lambda x: x.isNotNull())
    return within.join(above, ["key", "up"]).select("key", "at", fold(whole).alias("before"))


def under(before: Column, own: Column) -> Column:
    """Open headings after two stretches, from those of each: a heading closes all before it of its own level and below."""
    return F.concat(F.filter(before, lambda x: F.coalesce(x["level"] < F.get(own, F.lit(0))["level"], F.lit(True))), own)


def _stacks(states: Column) -> Column:
    return F.aggregate(states, F.array().cast("array<struct<at:bigint,title:string,level:int>>"), under)


def _last(states: Column) -> Column:
    return F.array_max(states)


def _sum(states: Column) -> Column:
    return F.aggregate(states, F.lit(0).cast("long"), lambda n, x: n + x)


#: Columns that are made on the way.
OWN = ("key", "at", "title", "sure", "open", "before", "cut", "begun", "piece")


def _pathed(df: DataFrame, document: str, order: str, file_type: str, clean_twice: bool, block: int) -> DataFrame:
    """Elements with section_path, and the piece of its document that each is packed with."""
    if block < 1:
        raise ValueError("a block must have at least one value of the order")
    taken = {c.lower() for c in df.columns} & set(OWN)
    if taken:
        raise ValueError(f"these columns would be overwritten: {sorted(taken)}")
    title, sure = F.when(F.col("heading_level").isNotNull(), F.col("text")), F.col("text").rlike(r"[\p{L}\p{N}]")
    # A struct equals another one where both hold null, so a null document is a document like any other.
    place = {"key": F.struct(F.col(document).alias("document")), "at": F.call_function("div", F.col(order).cast("long"), F.lit(block))}
    rows = kept(structure.typed(df, file_type, clean_twice).withColumns({"title": title, "sure": sure}), "elements").withColumns(place)
    opened = structure.open_headings(F.col("heading_level"), F.col("title"), ["key", "at"], order)
    in_block = Window.partitionBy("key", "at").orderBy(order)
    before = F.lag(F.col("sure") & F.col("title").isNull()).over(in_block)
    named = F.last("title", ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, -1))
    # The last title of a path is that of the last heading: where it changes, the path does.
    cut = F.coalesce(F.col("sure") & before & (F.col("title") != named), F.lit(False))

    ends = rows.where("title is not null").withColumn("open", opened).groupBy("key", "at").agg(F.max_by("open", order).alias("open"))
    begins = rows.withColumn("cut", cut).groupBy("key", "at").agg(F.max(F.when(F.col("cut"), F.col("at"))).alias("piece"))
    blocks = kept(begins.join(ends, ["key", "at"], "left"), "blocks")
    stacks = ahead(blocks.withColumnRenamed("open", "state"), _stacks)
    pieces = ahead(blocks.withColumnRenamed("piece", "state"), _last).withColumnRenamed("before", "piece")
    rows = rows.withColumns({"open": opened, "cut": cut})
    rows = rows.withColumn("begun", F.max("cut").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(stacks.join(pieces, ["key", "at"]), ["key", "at"], "left")
    rows = rows.withColumn("section_path", F.transform(under(F.col("before"), F.col("open")), lambda x: x["title"]))
    # The piece of a document's beginning is -1.
    rows = rows.withColumn("piece", F.when(F.col("begun"), F.col("at")).otherwise(F.coalesce("piece", F.lit(-1))))
    return rows.withColumn("section", F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.col("section"))).drop(*[c for c in OWN if c != "piece"])


def analyze(df: DataFrame, document: str = "document_id", order: str = "unit_ordinal", file_type: str = "file_type", clean_twice: bool = True, block: int = BLOCK) -> DataFrame:
    """As structure.analyze(), with documents dealt to tasks by blocks. order: whole numbers from 0 on, different within a document. Cleaned
    units are written once. Columns with names of OWN are an error."""
    return _pathed(df, document, order, file_type, clean_twice, block).drop("piece")


def build_chunks(df: DataFrame, sizes: Sizes | None = None, document: str = "document_id", order: str = "unit_ordinal", file_type: str = "file_type", clean_twice: bool = True, block: int = BLOCK) -> DataFrame:
    """Chunks (columns of CHUNK) of units: those of chunks.build_chunks() over structure.analyze(), with long documents packed in pieces.

    Packing begins anew, without overlap, where a section ends: at a heading with another title than the one before, behind an element
    that isn't a heading. A block's first such heading begins a piece, which goes up to the next block's that has one; pieces are
    packed as tasks of their own, and their chunks numbered by a prefix sum. A section isn't cut, so one far above `block` elements is
    one task, that holds one chunk of it at a time. Elements without any letter or digit never stand at a cut, as packing may pass over them.
    """
    rows = _pathed(df, document, order, file_type, clean_twice, block)
    rows = packable(rows, document, order, "piece").repartition("document_id", "piece").sortWithinPartitions("document_id", "piece", "__order")
    made = CHUNK + ", piece bigint"
    packed = kept(rows.mapInArrow(packing(sizes or Sizes(), arrow_schema(made), "piece"), made), "pieces").withColumn("key", F.struct(F.col("document_id").alias("document")))
    # Written, the table of starts has a known size, by which Spark sends it to all tasks where it is small.
    starts = kept(ahead(packed.groupBy("key", F.col("piece").alias("at")).agg(F.count("*").alias("state")), _sum).withColumnRenamed("at", "piece"), "starts")
    numbered = packed.join(starts, ["key", "piece"]).withColumn("chunk_index", (F.col("chunk_index") + F.col("before")).cast("int"))
    return numbered.drop("key", "piece", "before")
