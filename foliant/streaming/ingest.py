"""Ingestion as a stream: files are taken in as they appear in a folder. An addition; batches are what the operators are made for."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest, open_store

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store_path: str, checkpoint: str, model: Callable[[list[str]], Any], name: str, dimensions: int, files_a_batch: int = 1000, bucket_rows: int = 1 << 16, **more: Any) -> StreamingQuery:
    """Starts a query that ingests the files of a folder, up to files_a_batch at a time, and ends when all that are there are taken in.

    A batch that is run again after a failure ends in the same state, as documents are merged by their place. It writes its
    own documents, and now and then merges runs of the store. Run it again, or on a schedule, for files that came later.
    """
    files = spark.readStream.schema(FILE).format("binaryFile").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/")

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", F.regexp_replace("path", f"^.*?{base}/", "").alias("name"), F.col("length").alias("size"), "content")
        ingest(open_store(batch.sparkSession, store_path, bucket_rows), rows, F.lit(folder), model, name, dimensions, F.current_timestamp(), **more)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
