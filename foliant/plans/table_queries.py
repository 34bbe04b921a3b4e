"""Queries over tables of documents, chunks and chats: upsert, replacement, cascades, constraints, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text, values
from ..operators import chat, embedding, evaluation, tables
from ..session import table

THEN, NOW = "2024-01-01 00:00:00", "2024-06-01 12:00:00"


def _now(at: str = NOW):
    return F.lit(at).cast("timestamp")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they come from a store: a container for each source, a pdf or docx file each."""
    kind = F.when(F.col("lang") == "en", "pdf").otherwise("docx")
    blob = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), kind)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_container"), blob.alias("source_blob_name"), names.file_name(blob).alias("file_name"), names.file_type(blob).alias("file_type"),
        names.document_mime(kind).alias("mime_type"), F.col("n_chars").cast("long").alias("file_size_bytes"), F.sha2("text", 256).alias("checksum"), F.lit("{}").alias("metadata"), "doc_id",
    )


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that were judged before are in the table already, as completed or failed ones."""
    told = table(spark, sf_dir, "labels")
    rows = _incoming(spark, sf_dir).join(told, "doc_id")
    status = F.when(F.col("quality") == 1, "completed").otherwise("failed")
    error = F.when(F.col("quality") != 1, "unreadable")
    return rows.select(
        F.concat(F.lit("old-"), F.col("doc_id").cast("string")).alias("id"), "file_name", "file_type", "source_container", "source_blob_name", "mime_type", F.lit(0).cast("long").alias("file_size_bytes"),
        "checksum", status.alias("processing_status"), error.alias("processing_error"), "metadata", _now(THEN).alias("created_at"), _now(THEN).alias("updated_at"),
    )


def upsert_documents(spark, sf_dir):
    done = tables.upsert_documents(_current(spark, sf_dir), _incoming(spark, sf_dir).drop("doc_id"), _now())
    return done.select("id", "source_container", "source_blob_name", "file_name", "file_type", "file_size_bytes", "checksum", "processing_status", "processing_error", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def _fragments(spark, sf_dir, size, docs=None):
    rows = docs if docs is not None else table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("document_id"), F.posexplode(text.word_fragments(F.col("text"), size)).alias("chunk_index", "content"))


def replace_chunks(spark, sf_dir):
    """The judged documents are cut anew, in longer chunks."""
    judged = table(spark, sf_dir, "labels").select("doc_id")
    new = _fragments(spark, sf_dir, 200, table(spark, sf_dir, "documents").join(judged, "doc_id", "left_semi"))
    done = tables.replace_children(_fragments(spark, sf_dir, 100), new, judged.withColumnRenamed("doc_id", "document_id"))
    return done.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


def cascade_delete(spark, sf_dir):
    """The vectors that are left when toxic documents go."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    children = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "label")
    return tables.without(children, gone)


def orphans(spark, sf_dir):
    """Labels of documents that have no vector."""
    parents = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return tables.orphans(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id"), parents)


def mark_status(spark, sf_dir):
    told = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("completed").alias("status"))
    outcomes = told.select(F.concat(F.lit("old-"), F.col("doc_id").cast("string")).alias("id"), "status", F.repeat(F.lit("long error "), 500).alias("error"))
    done = tables.mark(_current(spark, sf_dir), outcomes, _now())
    return done.groupBy("processing_status").agg(F.count("*").alias("n"), F.max(F.length("processing_error")).cast("long").alias("longest_error"))


def constraint_violations(spark, sf_dir):
    """Documents whose language stands in for their file type: most break the rule."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "pdf").otherwise(F.col("lang")).alias("file_type"), F.lit("pending").alias("processing_status"), (F.col("n_chars") - 100).alias("file_size_bytes"))
    return tables.violations(rows, "documents").select("id", F.array_join("violated", ",").alias("violated"))


def duplicate_keys(spark, sf_dir):
    """Combinations of language and source that several documents have."""
    return tables.duplicates(table(spark, sf_dir, "documents"), ("lang", "source"))


def duplicate_content(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return tables.duplicates(rows, ("checksum",), first="doc_id")


def mispaired(spark, sf_dir):
    """Documents without a vector, and the other way round."""
    chunks = table(spark, sf_dir, "documents").select(F.lit("d").alias("document_id"), F.col("doc_id").alias("chunk_index"))
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d:"), F.col("vec_id").cast("string")).alias("item_id"))
    return tables.mispaired(chunks, vectors)


def embedding_contract(spark, sf_dir):
    """A model that gives a text's length as its vector, called in batches; it sees each text once."""
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    done = embedding.embed(inputs, lambda texts: ([[float(len(t or ""))] for t in texts], len(texts)), "length")
    return done.select(F.col("item_id").cast("long").alias("doc_id"), F.element_at("embedding", 1).cast("long").alias("length"), "model", "error")


def image_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    blob = names.image_blob(F.concat(F.lit("in/my "), F.col("source"), F.lit(".pdf")), F.col("doc_id").cast("string"), F.length("source"), F.when(F.col("lang") == "en", "a/pic.JPE"))
    return rows.select("doc_id", blob.alias("blob"), names.image_mime(F.lit("..JPE")).alias("mime"), names.item_id(F.col("doc_id").cast("string"), F.col("n_chars")).alias("item"))


def ingestion_counts(spark, sf_dir):
    return evaluation.ingestion_counts(_current(spark, sf_dir))


def chat_titles(spark, sf_dir):
    return chat.titles(table(spark, sf_dir, "conversations"))


def chat_history(spark, sf_dir):
    return chat.history(table(spark, sf_dir, "conversations"), active=1).select("conv_id", "label", "messages", F.col("place").cast("long").alias("place"))


def json_props(spark, sf_dir):
    """Fields of the JSON that events carry, through a variant, with a default for what is missing."""
    rows = table(spark, sf_dir, "events")
    keys = rows.select("event_type", values.json_value(F.col("props"), "$.k", default="none").alias("k"), tables.json_is(F.col("props"), "OBJECT").alias("is_object"))
    return keys.groupBy("event_type", "k", "is_object").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (upsert_documents, replace_chunks, cascade_delete, orphans, mark_status, constraint_violations, duplicate_keys, duplicate_content, mispaired, embedding_contract, image_names, ingestion_counts, chat_titles, chat_history, json_props)}

INCOMING = """
WITH incoming AS (
  SELECT doc_id, source AS source_container, lang || '/' || doc_id || '.' || CASE WHEN lang = 'en' THEN 'pdf' ELSE 'docx' END AS source_blob_name,
         doc_id || '.' || CASE WHEN lang = 'en' THEN 'pdf' ELSE 'docx' END AS file_name, CASE WHEN lang = 'en' THEN 'pdf' ELSE 'docx' END AS file_type,
         n_chars AS file_size_bytes, sha256(text) AS checksum FROM documents
)
"""
WORDS = r"regexp_extract_all(text, '[^ \t\n\v\f\r]+')"
CUT = "SELECT doc_id AS document_id, i // {0} AS chunk_index, md5(string_agg(w, ' ' ORDER BY i)) AS content_md5 FROM w WHERE {1} GROUP BY doc_id, i // {0}"

SQL = {
    "upsert_documents": INCOMING + """
SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'old-' || i.doc_id ELSE sha256(source_container || '/' || source_blob_name) END AS id, source_container, source_blob_name, file_name, file_type, file_size_bytes, checksum,
       'processing' AS processing_status, CAST(NULL AS VARCHAR) AS processing_error, CASE WHEN l.doc_id IS NOT NULL THEN '2024-01-01' ELSE '2024-06-01' END AS created, '2024-06-01' AS updated
FROM incoming i LEFT JOIN labels l USING (doc_id)
""",
    "replace_chunks": f"WITH w AS (SELECT doc_id, unnest({WORDS}) AS w, unnest(range(len({WORDS}))) AS i FROM documents) "
    + CUT.format(100, "doc_id NOT IN (SELECT doc_id FROM labels)") + " UNION ALL " + CUT.format(200, "doc_id IN (SELECT doc_id FROM labels)"),
    "cascade_delete": "SELECT vec_id AS document_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "orphans": "SELECT doc_id AS document_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "mark_status": """
SELECT CASE WHEN toxic = 1 THEN 'failed' ELSE 'completed' END AS processing_status, count(*) AS n, CAST(CASE WHEN toxic = 1 THEN 4000 END AS BIGINT) AS longest_error
FROM labels JOIN documents USING (doc_id) GROUP BY toxic
""",
    "constraint_violations": """
SELECT doc_id AS id, concat_ws(',', CASE WHEN lang <> 'en' THEN 'file_type' END, CASE WHEN n_chars < 100 THEN 'file_size' END) AS violated FROM documents WHERE lang <> 'en' OR n_chars < 100
""",
    "duplicate_keys": "SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "duplicate_content": "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1",
    "mispaired": """
SELECT 'd:' || coalesce(doc_id, vec_id) AS item_id, doc_id IS NOT NULL AS has_chunk, vec_id IS NOT NULL AS has_embedding
FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL
""",
    "embedding_contract": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS length, 'length' AS model, CAST(NULL AS VARCHAR) AS error FROM documents",
    "image_names": """
SELECT doc_id, 'extracted-images/my-' || source || '/' || doc_id || '/' || format('{:04d}_', length(source)) || CASE WHEN lang = 'en' THEN 'pic.JPE' ELSE 'image-' || length(source) END AS blob,
       'image/jpeg' AS mime, doc_id || ':' || n_chars AS item FROM documents
""",
    "ingestion_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS succeeded, count(*) FILTER (WHERE quality <> 1) AS failed FROM labels JOIN documents USING (doc_id)",
    "chat_titles": """
SELECT conv_id, CASE WHEN length(q) > 35 THEN left(q, 32) || '...' ELSE q END AS title FROM (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
""",
    "chat_history": """
WITH q AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS q, count(*) AS messages FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, messages, CASE WHEN length(q) > 35 THEN left(q, 32) || '...' ELSE q END AS t FROM q WHERE q IS NOT NULL)
SELECT conv_id, CASE WHEN conv_id = 1 THEN '› ' ELSE '' END || CASE WHEN length(t) > 30 THEN left(t, 27) || '...' ELSE t END AS label, messages, row_number() OVER (ORDER BY conv_id DESC) AS place FROM t
""",
    "json_props": "SELECT event_type, coalesce(json_extract_string(props, '$.k'), 'none') AS k, json_type(props) = 'OBJECT' AS is_object, count(*) AS n FROM events GROUP BY ALL",
}
