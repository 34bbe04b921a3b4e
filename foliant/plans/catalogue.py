"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import field_queries, index_queries, search_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **search_queries.QUERIES, **table_queries.QUERIES, **field_queries.QUERIES, **index_queries.QUERIES}
SQL: dict[str, str] = {**text_queries.SQL, **search_queries.SQL, **table_queries.SQL, **field_queries.SQL, **index_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question end to end: exact similarity, top-k, documents, route."""
    return search_queries.vector_topk(spark, sf_dir)
