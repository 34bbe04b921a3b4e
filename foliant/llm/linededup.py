"""Line dedup: levelled sorted runs of line hashes; each batch of documents is anti-joined with them and adds its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .runs import Runs
from .shared import batch_of, batches, column, hash128, map_arrow, workspace, written

#: A line whose key is shorter than this many code points is never dropped.
LEAST = 10


def line_key(line: Column) -> Column:
    """line without white space at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """order, row (a hash of the text, for rows that share an id), at (place of the line), h1, h2: of lines with a key long enough."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    lines = docs.select(column(id_col).alias("order"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keys = lines.where(F.length("line") >= least).select("order", "row", "at", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= least).select("order", "row", "at", *hash128(F.col("key")))


def drops(docs: DataFrame, id_col: str, text_col: str, least: int, n_batches: int, fanout: int, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """order, row and the places of the lines to drop, for each row that loses any."""
    spark, at = docs.sparkSession, workspace(docs.sparkSession, "lines")
    cuts = batches(docs.select(column(id_col).alias("order")), "order", n_batches)
    found = written(occurrences(docs, id_col, text_col, least).withColumn("batch", batch_of(F.col("order"), cuts)), f"{at}/lines", "batch")
    index = Runs(spark, path or f"{at}/index", fanout, buckets)
    for i in range(len(cuts) + 1):
        index.add(found.where(F.col("batch") == i).groupBy("h1", "h2").agg(F.min("order").alias("order")))
    # A key lies in one run, with the document that holds it first; that document keeps its lines of this key, all others lose theirs.
    firsts = index.all().select("h1", "h2", F.col("order").alias("first"))
    lost = found.drop("batch").join(firsts.withColumnsRenamed({"h1": "f1", "h2": "f2"}), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & F.col("order").eqNullSafe(F.col("first")), "left_anti")
    return lost.groupBy("order", "row").agg(F.sort_array(F.collect_list("at")).alias("places"))


def rebuild(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key, text and places: key, the kept text, the number of lines and of dropped ones, and the kept text's SHA-256."""
    for batch in source:
        kept, n_lines, n_dropped, sha = [], [], [], []
        for value, places in zip(batch["text"], batch["places"]):
            text = value.as_py() or ""
            lines = text.split("\n")
            gone = set(places.values.to_pylist()) if places.is_valid else ()
            if gone:
                text = "\n".join([x for i, x in enumerate(lines) if i not in gone])
            kept.append(text)
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            sha.append(hashlib.sha256(text.encode()).hexdigest())
        new = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([batch["key"], *new], ["key", "kept_text", "n_lines", "n_dropped", "kept_sha256"])


def _rebuilt(docs: DataFrame, key: Column, id_col: str, text_col: str, *how) -> DataFrame:
    """key, kept_text, n_lines, n_dropped, kept_sha256 for each row of docs."""
    lost = drops(docs, id_col, text_col, *how).withColumnsRenamed({"order": "of", "row": "which"})
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), column(id_col).alias("order"), F.xxhash64(text).alias("row"), text.alias("text"))
    both = rows.join(lost, F.col("order").eqNullSafe(F.col("of")) & (F.col("row") == F.col("which")), "left").select("key", "text", "places")
    new = [StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())]
    return map_arrow(both, rebuild, StructType([rows.schema["key"], *new]))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, n_batches: int = 4, fanout: int = 2, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """id_col, kept_text, n_lines, n_dropped, kept_sha256 for each row of docs.

    path: where the index of lines lies or shall lie, and stays: lines that documents of an earlier call hold are lost, but for that
    document itself. Without one the index is thrown away. buckets: of a new index.

    A key of at least `least` code points that several documents hold stays in the document with the smallest id only, there with
    all its lines. Ids may be of any type that can be sorted; texts sort by their bytes, so "10" is before "9". Null ids count as
    one document after all others, null texts as empty, which is one empty line. Rows that
    share an id count as one document. A document that loses all its lines gets an empty text. An empty table gives no rows.
    Only the two named columns are read, so others may have any name. A line may be of any length; a text is held whole.
    """
    return _rebuilt(docs, column(id_col), id_col, text_col, least, n_batches, fanout, path, buckets).withColumnRenamed("key", id_col)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, n_batches: int = 4, fanout: int = 2, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """All rows and columns of docs with the text that line_dedup() keeps, as a string and never null: ids, nulls, repeated rows and
    an empty table are dealt with as there. The other columns travel with their row, whatever their names and types."""
    rest = [c for c in docs.columns if c != text_col]
    out = _rebuilt(docs, F.struct(*map(column, rest)), id_col, text_col, least, n_batches, fanout, path, buckets)
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("key").getField(c).alias(c) for c in docs.columns])
