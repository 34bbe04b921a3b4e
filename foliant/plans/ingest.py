"""From files to stored chunks with vectors: parse, clean, classify, cut, check, embed, store, and mark each document done or failed."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext, names
from ..functions.containment import hashes as leaves_of
from ..functions.names import item_id
from ..functions.vectors import is_valid
from ..operators import containment, embedding, long_documents, structure, tables
from ..operators.chunks import Sizes, build_chunks
from ..operators.validate import validate
from ..sources import files as sources
from ..sources.store import Change, Store, Table, Work


#: Units from which on a document is long for one task.
LONG = 100_000


def _rules(table: str) -> dict[str, Column]:
    """The rules of a table, and that its metadata are JSON."""
    return tables.rules(table) | {"json": tables.is_json(F.col("metadata"))}


#: The tables of the store, with the indexes that are kept with them: postings of the chunks' words, and the leaves of their metadata
#: and section paths.
TABLES = {
    "documents": Table(
        tables.DOCUMENTS, tables.KEY, filters=("processing_status", "checksum"), ranges=("created_at", "file_size_bytes"), unique=(("id",), tables.KEY), rules=lambda: _rules("documents"),
        cascades=tuple((t, "document_id") for t in ("document_chunks", "document_images", "image_blobs", "postings", "items")),
    ),
    "document_chunks": Table(tables.CHUNKS, ("document_id",), unique=(("id",), ("document_id", "chunk_index")), rules=lambda: _rules("document_chunks"), references=(("document_id", "documents", "id"),)),
    "document_images": Table(tables.IMAGES, ("document_id",), unique=(("id",), ("document_id", "image_index")), rules=lambda: _rules("document_images"), references=(("document_id", "documents", "id"),)),
    "image_blobs": Table("image_blob_name string, document_id string, content binary", ("document_id",), references=(("document_id", "documents", "id"),)),
    "postings": Table("lexeme string, id string, document_id string, pos int", ("lexeme",), owner=("document_id",)),
    "items": Table(containment.ITEMS, ("item",), owner=("document_id",)),
}


def open_store(spark: SparkSession, path: str, bucket_rows: int = 1 << 16, keep: int = 2, **how: int) -> Store:
    """The store that ingest() writes to."""
    return Store(spark, path, TABLES, bucket_rows, keep=keep, **how)


def indexes(chunks: DataFrame, stemming: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of the tables postings and items for chunks."""
    words = fulltext.postings(chunks.select(F.struct("id", "document_id").alias("key"), "content"), "key", "content", stemming)
    return words.select("lexeme", "key.id", "key.document_id", "pos"), containment.entries(chunks, ["metadata", "section_path"])


def matching(store: Store, query: fulltext.Query) -> DataFrame:
    """id and rank of the stored chunks that a query matches; the postings of its lexemes alone are read."""
    named = query.lexemes(True)
    wanted = store.spark.createDataFrame([(x,) for x in named], "lexeme string")
    return fulltext.keyword_rank(store.read("postings", keys=wanted), "id", query)


def containing(store: Store, column: str, part: Any) -> DataFrame:
    """The stored chunks whose metadata or section_path contains a value; only the leaves of the value are looked up."""
    wanted = store.spark.createDataFrame([(x,) for x in leaves_of(part)], "item long")
    return containment.containing(store.read("document_chunks"), store.read("items", keys=wanted), column, part)


def delete_documents(store: Store, documents: DataFrame) -> None:
    """Deletes documents (KEY) with all that belongs to them, in one commit."""
    store.apply([Change("documents", documents.select(*tables.KEY), lambda old: old.where("false"))])


def preview(files: DataFrame, parsers: dict[str, sources.Parser] | None = None) -> DataFrame:
    """Units of documents, without any write."""
    return sources.parse(sources.documents(files), parsers)


def incoming(files: DataFrame, container: Column) -> DataFrame:
    """A row of the table of documents for each file that can be parsed, with its id."""
    rows = sources.documents(files).withColumns({"source_container": container, "source_blob_name": F.col("name")})
    key = tables.document_key(F.col("source_container"), F.col("source_blob_name"))
    return rows.select(key.alias("document_id"), "path", "source_container", "source_blob_name", "file_name", "file_type", "mime_type", F.col("size").alias("file_size_bytes"), "checksum", F.lit("{}").alias("metadata"), "content")


def _images(work: Work, new: DataFrame, ids: DataFrame, container: Column, captioner: Callable[[bytes, str], str], model: Callable[[list[str]], Any], name: str, now: Column) -> tuple[DataFrame, list[Change]]:
    """The images of documents: captions, vectors of the captions, bytes. Returns document_id and image_error of each document
    with a caption that failed, whose old images stay, and the changes that give all others their new images, which may be none."""
    found = sources.images(new).join(ids, "path").join(new.select("path", "source_blob_name"), "path")
    size = sources.image_size(F.col("content"))
    found = found.withColumns({"width": size["width"], "height": size["height"], "blob": names.image_blob(F.col("source_blob_name"), F.col("document_id"), F.col("image_index"), F.col("file_name"))})
    told = work.write("images", embedding.caption(found, captioner, name))
    failed = told.where("error is not null").groupBy("document_id").agg(F.max("error").alias("image_error"))
    good = told.join(failed, "document_id", "left_anti")
    vectors = embedding.embed(embedding.image_inputs(good), model, name)
    rows = good.withColumn("item_id", names.image_item_id(F.col("document_id"), F.col("image_index"))).join(vectors.select("item_id", "embedding"), "item_id", "left")
    rows = rows.select(
        F.sha2("item_id", 256).alias("id"), "document_id", "image_index", "page_number", F.col("file_name").alias("image_file_name"), container.alias("image_container"), F.col("blob").alias("image_blob_name"), "caption", F.col("embedding").alias("caption_embedding"),
        "mime_type", "width", "height", F.lit("{}").alias("metadata"), now.alias("created_at"),
    )
    rows, replaced = work.write("image_rows", rows), work.write("replaced", ids.join(failed, "document_id", "left_anti").select("document_id").distinct())
    contents = good.select(F.col("blob").alias("image_blob_name"), "document_id", "content")
    return failed, [Change("image_blobs", replaced, lambda old: tables.replace_children(old, contents, replaced)), Change("document_images", replaced, lambda old: tables.replace_children(old, rows, replaced))]


def ingest(
    store: Store, files: DataFrame, container: Column, model: Callable[[list[str]], Any], name: str, dimensions: int, now: Column, sizes: Sizes | None = None, parsers: dict[str, sources.Parser] | None = None, captioner: Callable[[bytes, str], str] | None = None, stemming: bool = True
) -> DataFrame:
    """Brings files (of sources.blobs()) into the store, and returns document_id, status, error of each.

    A document that is there already keeps id and time of creation, and its chunks are replaced. One that can't be parsed, has no
    text, has faulty chunks or no proper vectors is marked as failed, and its old chunks stay; the others go on. Running it again
    over the same files ends in the same state. Two commits: documents become known as `processing`, and then chunks, images, postings,
    containment index and outcomes change together or not at all. What is written is in proportion to these documents, whatever the
    size of the store; steps are written to a place of this run's own, so none is computed twice, and runs don't meet. captioner:
    describes images; with it, the images of the files are stored too, and a caption that fails makes its document a failed one.
    stemming: of the postings.
    """
    sizes, work = sizes or Sizes(), store.work()
    new = incoming(files, container)
    keys = work.write("keys", new.select(*tables.KEY).distinct())
    store.update("documents", keys, lambda old: tables.upsert_documents(old, new, now))
    documents = store.read("documents", keys=keys)
    ids = new.select("path", "document_id", "source_container", "source_blob_name").join(documents.select(F.col("id").alias("known"), *tables.KEY), list(tables.KEY), "left")
    ids = work.write("ids", ids.select("path", F.coalesce("known", "document_id").alias("document_id")))
    parsed = sources.parse(new.select("path", "file_type", "content"), parsers)
    units = work.write("units", parsed.join(ids, "path"))

    meta = new.drop("document_id").join(ids, "path").select("document_id", "file_name", F.col("source_blob_name").alias("blob_name"), "file_type")
    typed = units.where("error is null").join(meta.select("document_id", "file_type"), "document_id")
    # Where a document is long for one task, all are dealt to tasks by blocks, with the same chunks.
    long = (units.agg(F.max("unit_ordinal")).first()[0] or 0) >= LONG
    made = long_documents.build_chunks(typed, sizes) if long else build_chunks(structure.analyze(typed), sizes)
    extra = F.to_json(F.struct("section", "page_start", "page_end", "paragraph_start", "paragraph_end", "styles", "element_metadata"))
    chunks = work.write("chunks", made.withColumn("metadata", extra).join(meta, "document_id"))

    faulty = validate(chunks, most=sizes.most).where("severity = 'error'").groupBy("collection").agg(F.concat_ws(", ", F.sort_array(F.collect_set("code"))).alias("issues"))
    good = chunks.join(faulty.select(F.col("collection").alias("document_id")), "document_id", "left_anti")
    vectors = work.write("vectors", embedding.embed(embedding.chunk_inputs(good), model, name))

    paired = good.withColumn("item_id", item_id(F.col("document_id"), F.col("chunk_index"))).join(vectors, "item_id", "left")
    bad = F.max(F.when(~is_valid(F.col("embedding"), dimensions), F.coalesce("error", F.lit("a vector is missing or has the wrong size"))))
    embedded = paired.groupBy("document_id").agg(bad.alias("no_vector"), F.count("*").alias("n"))
    unread = units.groupBy("document_id").agg(F.max("error").alias("unread"))
    unseen, changes = _images(work, new, ids, container, captioner, model, name, now) if captioner else (store.spark.createDataFrame([], "document_id string, image_error string"), [])
    told = ids.join(unread, "document_id", "left").join(unseen, "document_id", "left").join(faulty.withColumnRenamed("collection", "document_id"), "document_id", "left").join(embedded, "document_id", "left")
    error = F.coalesce("unread", "issues", "no_vector", F.when(F.col("n").isNull(), "the document has no text"), "image_error")
    outcomes = work.write("outcomes", told.select("document_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error")).distinct())

    done = outcomes.where("status = 'completed'").select("document_id")
    rows = paired.join(done, "document_id", "left_semi").select(F.sha2("item_id", 256).alias("id"), "document_id", "chunk_index", "content", "embedding", "content_type", "token_count", "section_path", "metadata", now.alias("created_at"))
    rows = work.write("rows", rows)
    words, leaves = indexes(rows, stemming)
    for table, new_rows in (("document_chunks", rows), ("postings", words), ("items", leaves)):
        changes.append(Change(table, done, lambda old, new_rows=new_rows: tables.replace_children(old, new_rows, done)))
    store.apply([*changes, Change("documents", keys, lambda old: tables.mark(old, outcomes.withColumnRenamed("document_id", "id"), now))])
    work.clear("outcomes")
    return outcomes
