"""Tables of documents, chunks and images: upsert, replacement, cascades, constraints. Each takes and returns DataFrames.

A table's new state is written beside the old one and put in its place at once; there is no change in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_blank

KEY = ("source_container", "source_blob_name")
#: Fields that an upsert takes from the new row.
REPLACED = ("file_name", "file_type", "mime_type", "file_size_bytes", "checksum", "metadata")
STATUSES = ("pending", "processing", "completed", "failed")
CONTENT_TYPES = ("text", "list", "table", "image_caption")
ERROR_LENGTH = 4000

# The tables' columns.
DOCUMENTS = "id string, file_name string, file_type string, source_container string, source_blob_name string, mime_type string, file_size_bytes long, checksum string, processing_status string, processing_error string, metadata string, created_at timestamp, updated_at timestamp"
CHUNKS = "id string, document_id string, chunk_index int, content string, embedding array<float>, content_type string, token_count int, section_path array<string>, metadata string, created_at timestamp"
IMAGES = "id string, document_id string, image_index int, page_number int, image_file_name string, image_container string, image_blob_name string, caption string, caption_embedding array<float>, mime_type string, width int, height int, metadata string, created_at timestamp"

UNIQUE = {"documents": [("id",), KEY], "document_chunks": [("id",), ("document_id", "chunk_index")], "document_images": [("id",), ("document_id", "image_index")]}


def document_key(container: Column, blob: Column) -> Column:
    """A document's id: the same for the same place, on each run."""
    return F.sha2(F.concat_ws("/", container, blob), 256)


def defaults(documents: DataFrame, now: Column) -> DataFrame:
    """documents with the default of each column that is null."""
    filled = {"processing_status": F.lit("pending"), "metadata": F.lit("{}"), "created_at": now, "updated_at": now}
    return documents.withColumns({n: F.coalesce(F.col(n), v) for n, v in filled.items() if n in documents.columns})


def upsert_documents(current: DataFrame, incoming: DataFrame, now: Column, version: Column | None = None) -> DataFrame:
    """current after the incoming rows (KEY and REPLACED) have come in.

    A new key gets an id; a known one keeps id and created_at. Either way the status is processing, and the error is gone. Of
    incoming rows with the same key the one with the greatest version counts, or any if no version is given. One shuffle of each side.
    """
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy((version if version is not None else F.lit(0)).desc()))
    latest = incoming.withColumn("__nth", nth).where("__nth = 1").select(*KEY, *[F.col(c).alias(f"__{c}") for c in REPLACED], F.lit(True).alias("__new"))
    both = current.join(latest, list(KEY), "full_outer")
    new = F.coalesce("__new", F.lit(False))
    changed = {c: F.when(new, F.col(f"__{c}")).otherwise(F.col(c)) for c in REPLACED} | {
        "id": F.coalesce("id", document_key(*map(F.col, KEY))),
        "processing_status": F.when(new, "processing").otherwise(F.col("processing_status")),
        "processing_error": F.when(~new, F.col("processing_error")),
        "created_at": F.coalesce("created_at", now),
        "updated_at": F.when(new, now).otherwise(F.col("updated_at")),
    }
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in current.columns])


def replace_children(current: DataFrame, new: DataFrame, replaced: DataFrame, key: str = "document_id") -> DataFrame:
    """current without the rows of the replaced documents, and the new rows. A document without new rows is left with none."""
    return current.join(replaced.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(new, allowMissingColumns=True)


def mark(documents: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """documents with the status and error of outcomes (id, status, error); errors are cut to ERROR_LENGTH, completed ones have none."""
    told = outcomes.select("id", F.col("status").alias("__status"), F.col("error").alias("__error"))
    error = F.when(F.col("__status") == "failed", F.substring("__error", 1, ERROR_LENGTH))
    changed = {"processing_status": F.coalesce("__status", "processing_status"), "processing_error": F.when(F.col("__status").isNotNull(), error).otherwise(F.col("processing_error")), "updated_at": F.when(F.col("__status").isNotNull(), now).otherwise(F.col("updated_at"))}
    return documents.join(told, "id", "left").select(*[changed.get(c, F.col(c)).alias(c) for c in documents.columns])


def unknown(outcomes: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcomes of documents that aren't there."""
    return outcomes.join(documents.select("id"), "id", "left_anti")


def without(children: DataFrame, deleted: DataFrame, key: str = "document_id", parent: str = "id") -> DataFrame:
    """children after their parents were deleted."""
    return children.join(deleted.select(F.col(parent).alias(key)), key, "left_anti").select(*children.columns)


def orphans(children: DataFrame, parents: DataFrame, key: str = "document_id", parent: str = "id") -> DataFrame:
    """children whose parent isn't there; none, if references hold."""
    return children.join(parents.select(F.col(parent).alias(key)), key, "left_anti").select(*children.columns)


def per_parent(children: DataFrame, key: str = "document_id", **counted: Column) -> DataFrame:
    """key and, by name, how many of its rows meet a condition."""
    return children.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])


def duplicates(df: DataFrame, keys: tuple[str, ...], first: str | None = None) -> DataFrame:
    """keys and n of the keys that several rows have, and the least value of a column `first`. Rows with a null in the key never conflict."""
    full = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return full.groupBy(*keys).agg(F.count("*").alias("n"), *([F.min(first).alias("first")] if first else [])).where("n > 1")


def json_is(value: Column, kind: str) -> Column:
    """Whether a text is JSON of a kind; null where it is null or no JSON."""
    return F.schema_of_variant(F.try_parse_json(value)).startswith(kind)


def is_json(value: Column) -> Column:
    """Whether a text is JSON, as a column of that type asks for; null where it is null."""
    return F.when(value.isNotNull(), F.try_parse_json(value).isNotNull())


def rules(table: str) -> dict[str, Column]:
    """Conditions that each row of a table must meet. As in SQL, a condition that is null is met."""
    c = F.col
    return {
        "documents": {
            "file_type": c("file_type").isin("pdf", "docx"),
            "processing_status": c("processing_status").isin(*STATUSES),
            "file_size": c("file_size_bytes") >= 0,
        },
        "document_chunks": {
            "chunk_index": c("chunk_index") >= 0,
            "token_count": c("token_count") >= 0,
            "content": ~is_blank(c("content")),
            "section_path": c("section_path").isNotNull(),
            "metadata": json_is(c("metadata"), "OBJECT"),
        },
        "document_images": {
            "image_index": c("image_index") >= 0,
            "page_number": c("page_number") > 0,
            "width": c("width") > 0,
            "height": c("height") > 0,
            "metadata": json_is(c("metadata"), "OBJECT"),
        },
    }[table]


def violations(df: DataFrame, table: str | dict[str, Column]) -> DataFrame:
    """The rows of df that break rules, with their names in `violated`. One pass for all rules."""
    checks = rules(table) if isinstance(table, str) else table
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(True)), n) for n, v in checks.items()]))
    return df.withColumn("violated", broken).where(F.size("violated") > 0)


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]


def missing_columns(df: DataFrame, schema: str) -> list[str]:
    """Columns of the schema that df lacks or has in another type."""
    have = dict(df.dtypes)
    return [name for name, kind in (x.split(" ", 1) for x in schema.split(", ")) if have.get(name) != kind.replace("long", "bigint")]


def mispaired(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """item_id, has_chunk, has_embedding of what has no partner or several; empty if chunks (document_id, chunk_index) and embeddings (item_id) fit."""
    left = chunks.groupBy(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")).alias("item_id")).agg(F.count("*").alias("c"))
    right = embeddings.groupBy("item_id").agg(F.count("*").alias("e"))
    both = left.join(right, "item_id", "full_outer")
    one = F.coalesce(F.col("c") == 1, F.lit(False)) & F.coalesce(F.col("e") == 1, F.lit(False))
    return both.where(~one).select("item_id", F.col("c").isNotNull().alias("has_chunk"), F.col("e").isNotNull().alias("has_embedding"))
