"""Checks of chunks before they are stored: an issue row for each fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import count_tokens, is_blank

#: Chunks of fewer tokens get a warning.
SMALL = 20


def _issue(condition: Column, code: str, name: str | None, severity: str = "error") -> Column:
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(name).cast("string").alias("field_name")))


def validate(chunks: DataFrame, collection: str = "document_id", order: str = "chunk_index", most: int = 700, small: int = SMALL, expected: DataFrame | None = None) -> DataFrame:
    """collection, severity, code, chunk_index, field_name: one row for each issue.

    chunks: document_id, chunk_index, content, token_count, file_name, blob_name, file_type, and if they are there page_start,
    page_end, paragraph_start, paragraph_end. A collection is what is stored together; its chunks stand in the order `order`.
    expected: collections that must have chunks. One pass finds all issues of single chunks; those of a collection are sums over it.
    """
    if most < 1 or not 0 <= small <= most:
        raise ValueError("most must be at least 1 and small between 0 and most")
    chunks = chunks.withColumn("__in", F.col(collection).cast("string")) if collection else chunks.withColumn("__in", F.lit("all"))
    has = lambda *names: all(n in chunks.columns for n in names)
    tokens, counted = F.col("token_count"), count_tokens(F.col("content"))
    fine = tokens >= 0
    below = lambda a, b: (F.col(a) < F.lit(0 if "para" in a else 1)) | (F.col(b) < F.col(a))
    single = [
        _issue(is_blank(F.col("document_id").cast("string")), "EMPTY_DOCUMENT_ID", "document_id"),
        _issue(F.col("chunk_index") < 0, "NEGATIVE_CHUNK_INDEX", "chunk_index"),
        _issue(is_blank(F.col("content")), "EMPTY_CHUNK_CONTENT", "content"),
        _issue(tokens < 0, "NEGATIVE_TOKEN_COUNT", "token_count"),
        _issue(fine & (tokens != counted), "TOKEN_COUNT_MISMATCH", "token_count"),
        _issue(fine & (counted > most), "CHUNK_EXCEEDS_MAX_TOKENS", "token_count"),
        _issue(fine & (counted > 0) & (counted < small), "VERY_SMALL_CHUNK", "token_count", "warning"),
        *([_issue(below("page_start", "page_end"), "INVALID_PAGE_RANGE", "page_end")] if has("page_start", "page_end") else []),
        *([_issue(below("paragraph_start", "paragraph_end"), "INVALID_PARAGRAPH_RANGE", "paragraph_end")] if has("paragraph_start", "paragraph_end") else []),
        *[_issue(is_blank(F.col(n)), f"MISSING_{n.upper()}", n) for n in ("file_name", "blob_name", "file_type") if has(n)],
    ]
    found = chunks.select("__in", F.col("chunk_index").cast("int").alias("chunk_index"), F.explode(F.filter(F.array(*single), lambda x: x.isNotNull())).alias("i"))
    out = found.select("__in", "i.severity", "i.code", "chunk_index", "i.field_name")

    nth = F.row_number().over(Window.partitionBy("__in").orderBy(order))
    placed = chunks.select("__in", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), nth.alias("nth"))
    sums = placed.groupBy("__in").agg(F.count_distinct("document_id").alias("ids"), F.count_if(F.col("nth") - 1 != F.col("chunk_index")).alias("gaps"))
    whole = sums.select("__in", F.explode(F.filter(F.array(_issue(F.col("ids") > 1, "INCONSISTENT_DOCUMENT_IDS", "document_id"), _issue(F.col("gaps") > 0, "NON_SEQUENTIAL_CHUNK_INDEXES", "chunk_index")), lambda x: x.isNotNull())).alias("i"))
    out = out.unionByName(whole.select("__in", "i.severity", "i.code", F.lit(None).cast("int").alias("chunk_index"), "i.field_name"))
    twice = placed.groupBy("__in", "chunk_index").agg(F.count("*").alias("n")).where("n > 1")
    one = lambda df, code, name: df.select("__in", F.lit("error").alias("severity"), F.lit(code).alias("code"), "chunk_index", F.lit(name).alias("field_name"))
    out = out.unionByName(one(twice, "DUPLICATE_CHUNK_INDEX", "chunk_index"))
    if expected is not None:
        none = expected.select(F.col(collection).cast("string").alias("__in")).join(chunks.select("__in"), "__in", "left_anti").withColumn("chunk_index", F.lit(None).cast("int"))
        out = out.unionByName(one(none, "EMPTY_CHUNK_COLLECTION", None))
    return out.withColumnRenamed("__in", "collection")


def summary(issues: DataFrame) -> DataFrame:
    """collection, errors, warnings, is_valid."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return issues.groupBy("collection").agg(errors.alias("errors"), warnings.alias("warnings"), (errors == 0).alias("is_valid"))
