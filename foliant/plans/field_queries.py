"""Queries over single fields and small tables: text rules, labels, links, vectors, maps, image lists, provider items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headings, names, text, values, vectors
from ..operators import embedding, retrieval, tables
from ..session import table
from ..sources import files
from . import text_queries


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as fields that may be blank: what counts as text, as a number, and as a question."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), (F.col("turn") - 2).cast("string"), F.lit(" "))).otherwise(F.lit(" \n")).alias("field"), "text")
    number = text.optional_int(F.col("field"))
    return rows.select("conv_id", "turn", text.is_blank(F.col("field")).alias("blank"), text.required(F.col("field")).alias("required"), number.cast("long").alias("number"), text.positive_int(F.col("field")).cast("long").alias("positive"), retrieval.valid_question(F.col("text"), 200).alias("is_question"))


def labels_and_links(spark, sf_dir):
    """Labels of routes, where a blob is read, data URLs, and the steps in which an answer is shown."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("t"), F.element_at(F.array(F.lit("internal"), F.lit("web"), F.lit("unavailable"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int")).alias("route"))
    return rows.select(
        "doc_id", names.route_label(F.col("route")).alias("label"), files.read_url(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("link"),
        names.data_url(F.lit("image/png"), F.encode(F.col("source"), "UTF-8")).alias("data"), names.steps(F.col("t")).cast("long").alias("steps"), names.beginning(F.col("t"), F.lit(3)).alias("third_step"), names.image_mime(F.col("source")).alias("mime"),
    )


def vector_forms(spark, sf_dir):
    """Vectors as text, the first given of several, and a constant one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * 4).cast("float")).alias("v"))
    given = vectors.first_given(F.when(F.col("vec_id") % 2 == 0, F.array().cast("array<float>")), F.when(F.col("vec_id") % 3 == 0, F.col("v")), vectors.constant(0.5, 3))
    return rows.select("vec_id", F.array_join(F.transform(given, lambda x: (x * 2).cast("long").cast("string")), ",").alias("given"), F.length(vectors.literal(vectors.constant(0.5, 3))).cast("long").alias("length"), F.round(vectors.norm(F.col("v")), 6).alias("norm"))


def map_merge(spark, sf_dir):
    """Metadata of documents merged with those of their labels: later entries win, a missing map has none; then fields of it with defaults."""
    told = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    rows = table(spark, sf_dir, "documents").join(told, F.col("doc_id") == F.col("id"), "left")
    own = F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.lit("unknown"))
    judged = F.when(F.col("id").isNotNull(), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")))
    both = rows.select("doc_id", values.merged(own, judged).alias("m"), F.split("source", "r").alias("parts"))
    whole = values.json_text(F.col("m"))
    return both.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("entries"), values.json_value(whole, "$.quality").alias("quality"), values.json_value(whole, "$.toxic", "long", -1).alias("toxic"), values.last(F.col("parts")).alias("last_part"))


def _images(spark, sf_dir):
    """Documents as images of the sources' files: ten pages, some without a size."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("source").alias("path"), (F.col("doc_id") % 10).cast("int").alias("page_number"), (F.col("doc_id") % 7).cast("int").alias("xref"), F.col("doc_id").alias("place"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("width"), F.col("n_chars").alias("height"))


def image_lists(spark, sf_dir):
    """Images once a page, numbered through their document."""
    return files.distinct_images(_images(spark, sf_dir)).select("path", "page_number", "xref", "place", F.col("image_index").cast("long").alias("image_index"))


def largest_images(spark, sf_dir):
    return files.largest(_images(spark, sf_dir), order="place").select("path", "place", "width")


def document_counts(spark, sf_dir):
    """Pages, paragraphs and images of each source's file; images are the rows with a size."""
    rows = _images(spark, sf_dir)
    units = rows.select("path", "page_number", F.when(F.col("xref") > 2, F.col("xref")).alias("paragraph_number"))
    return files.counts(units, rows.where("width is not null")).select("path", "page_count", "paragraph_count", "image_count")


def chunk_violations(spark, sf_dir):
    """Rules of chunks on documents: a count that is negative for short ones, blank contents, metadata that are no objects, no section path."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(d.alias("id"), (d - 3).alias("chunk_index"), (F.col("n_chars") - 200).alias("token_count"), F.when(d % 4 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("content"), F.when(d % 5 > 0, F.array("source")).alias("section_path"), F.when(d % 3 == 0, "[1]").when(d % 3 == 1, '{"a": 1}').otherwise(F.lit("{")).alias("metadata"))
    return tables.violations(rows, "document_chunks").select("id", F.array_join("violated", ",").alias("violated"))


def image_violations(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(d.alias("id"), (d - 2).alias("image_index"), F.when(d % 2 == 0, d % 6).alias("page_number"), (d % 4).alias("width"), F.when(d % 3 > 0, F.lit(-1)).alias("height"), F.lit("{}").alias("metadata"))
    return tables.violations(rows, "document_images").select("id", F.array_join("violated", ",").alias("violated"))


def column_defaults(spark, sf_dir):
    told = table(spark, sf_dir, "labels")
    rows = told.select("doc_id", F.when(F.col("quality") == 1, "completed").alias("processing_status"), F.when(F.col("toxic") == 1, '{"t": 1}').alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"), F.when(F.col("toxic") == 1, F.lit("2024-02-02").cast("timestamp")).alias("updated_at"))
    filled = tables.defaults(rows, F.lit("2024-06-01").cast("timestamp"))
    return filled.select("doc_id", "processing_status", "metadata", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def provider_items(spark, sf_dir):
    """A provider's vectors meet their inputs by index; some are missing, some have the wrong size."""
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("source").alias("item"))
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"), F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"))
    paired = embedding.by_index(items, inputs)
    faulty = embedding.faulty_vectors(paired, 64).select("index", F.lit(1).alias("f"))
    return paired.join(faulty, "index", "left").select("index", "item", F.col("f").isNotNull().alias("faulty"))


def lost_items(spark, sf_dir):
    """Documents that got no vector, and vectors of none."""
    inputs = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("item_id"))
    return embedding.lost(inputs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id")))


def faulty_inputs(spark, sf_dir):
    """Inputs with a blank id or text, and ids that come twice."""
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") != 1, F.col("conv_id").cast("string")).otherwise(F.lit(" ")).alias("item_id"), F.when(F.col("role") == "user", F.col("text")).alias("text"))
    blank, twice = embedding.faulty_inputs(rows).select("item_id"), embedding.repeated_ids(rows)
    return blank.groupBy("item_id").agg(F.count("*").alias("blank")).join(twice.withColumnRenamed("n", "times"), "item_id", "full_outer").select("item_id", F.coalesce("blank", F.lit(0)).alias("blank"), F.coalesce("times", F.lit(1)).alias("times"))


def chunks_by_document(spark, sf_dir):
    """How many turns each conversation has, and which have a user's turn without any from the other side."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "document_id")
    rows = tables.per_parent(turns, chunks=F.lit(True), asked=F.col("role") == "user")
    return rows.select("document_id", "chunks", (F.col("asked") == F.col("chunks")).alias("unanswered"))


def element_kinds(spark, sf_dir):
    """What lines are by style, declared type and metadata: levels of heading styles, then tables and lists in their order."""
    d = F.col("doc_id")
    pick = lambda n, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (d % n + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.strip(F.regexp_extract("text", "^[^\n]*", 0)).alias("line"), pick(6, None, "Table Grid", " heading 2", "List Paragraph", "Heading 10 ", "Heading").alias("style"), pick(5, None, "Table_Row ", " bullet", "text", "tabular").alias("declared"), pick(7, "TABLE", "list", None, "x", None, None, None).alias("told"))
    kind = headings.body_type(F.coalesce("line", F.lit("")), F.col("style"), F.col("declared"), F.col("told"))
    return rows.select("doc_id", headings.style_level(F.col("style")).cast("long").alias("level"), kind.alias("kind"))


QUERIES = {f.__name__: f for f in (text_rules, labels_and_links, vector_forms, map_merge, image_lists, largest_images, document_counts, chunk_violations, image_violations, column_defaults, provider_items, lost_items, faulty_inputs, chunks_by_document, element_kinds)}

LIST_ITEM = text_queries.LIST_ITEM
BLANK = r"NOT regexp_matches(coalesce({0}, ''), '[^ \t\n\v\f\r]')"
IMAGES = "images AS (SELECT source AS path, doc_id % 10 AS page_number, doc_id % 7 AS xref, doc_id AS place, CASE WHEN doc_id % 5 > 0 THEN n_chars END AS width, n_chars AS height FROM documents)"

SQL = {
    "text_rules": rf"""
WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN ' ' || chr(9) || text || chr(10) || ' ' WHEN turn % 3 = 1 THEN ' ' || (turn - 2) || ' ' ELSE ' ' || chr(10) END AS field FROM conversations),
s AS (SELECT *, regexp_replace(field, '^\s+|\s+$', '', 'g') AS bare FROM r)
SELECT conv_id, turn, {BLANK.format('field')} AS blank, nullif(bare, '') AS required, TRY_CAST(bare AS BIGINT) AS number, CASE WHEN TRY_CAST(bare AS BIGINT) > 0 THEN TRY_CAST(bare AS BIGINT) END AS positive,
       regexp_matches(coalesce(text, ''), '\S') AND length(text) <= 200 AS is_question FROM s
""",
    "labels_and_links": """
WITH r AS (SELECT *, text AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '📚 Internal Knowledge' WHEN 1 THEN '🌐 Web Search' WHEN 2 THEN '⚠️ No Reliable Source Found' ELSE '🤖 AI Response' END AS label, source || '/' || doc_id || '.pdf' AS link,
       'data:image/png;base64,' || base64(encode(source)) AS data, CAST(len(string_split(t, ' ')) AS BIGINT) AS steps, array_to_string(string_split(t, ' ')[1:3], ' ') AS third_step, 'application/octet-stream' AS mime FROM r
""",
    "vector_forms": """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 4) AS FLOAT)) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN array_to_string(list_transform(v, lambda x: CAST(CAST(x * 2 AS BIGINT) AS VARCHAR)), ',') ELSE '1,1,1' END AS given, CAST(13 AS BIGINT) AS length, round(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM r
""",
    "map_merge": """
SELECT d.doc_id, 'lang=' || lang || ';quality=' || coalesce(CAST(quality AS VARCHAR), 'unknown') || coalesce(';toxic=' || toxic, '') AS entries, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality,
       CAST(coalesce(toxic, -1) AS BIGINT) AS toxic, string_split(source, 'r')[-1] AS last_part FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "image_lists": f"""
WITH {IMAGES}, once AS (SELECT path, page_number, xref, min(place) AS place FROM images GROUP BY ALL)
SELECT CAST(page_number AS INTEGER) AS page_number, path, CAST(xref AS INTEGER) AS xref, place, row_number() OVER (PARTITION BY path ORDER BY page_number, place) - 1 AS image_index FROM once
""",
    "largest_images": f"""
WITH {IMAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(width, 0) * coalesce(height, 0) DESC, place) AS nth FROM images)
SELECT path, place, width FROM r WHERE nth = 1
""",
    "document_counts": f"WITH {IMAGES} SELECT path, count(DISTINCT page_number) AS page_count, count(*) FILTER (WHERE xref > 2) AS paragraph_count, count(width) AS image_count FROM images GROUP BY path",
    "chunk_violations": rf"""
WITH r AS (SELECT doc_id AS id, concat_ws(',', CASE WHEN doc_id - 3 < 0 THEN 'chunk_index' END, CASE WHEN n_chars - 200 < 0 THEN 'token_count' END, CASE WHEN doc_id % 4 = 0 OR {BLANK.format('text')} THEN 'content' END,
  CASE WHEN doc_id % 5 = 0 THEN 'section_path' END, CASE WHEN doc_id % 3 = 0 THEN 'metadata' END) AS violated FROM documents)
SELECT id, violated FROM r WHERE violated <> ''
""",
    "image_violations": """
WITH r AS (SELECT doc_id AS id, concat_ws(',', CASE WHEN doc_id - 2 < 0 THEN 'image_index' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <= 0 THEN 'page_number' END, CASE WHEN doc_id % 4 <= 0 THEN 'width' END, CASE WHEN doc_id % 3 > 0 THEN 'height' END) AS violated FROM documents)
SELECT id, violated FROM r WHERE violated <> ''
""",
    "column_defaults": """
SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'pending' END AS processing_status, CASE WHEN toxic = 1 THEN '{"t": 1}' ELSE '{}' END AS metadata, '2024-06-01' AS created, CASE WHEN toxic = 1 THEN '2024-02-02' ELSE '2024-06-01' END AS updated FROM labels
""",
    "provider_items": 'SELECT doc_id AS "index", source AS item, vec_id % 9 = 0 AS faulty FROM documents JOIN embeddings ON doc_id = vec_id',
    "lost_items": """
WITH a AS (SELECT doc_id AS item_id FROM documents WHERE doc_id % 3 > 0)
SELECT coalesce(a.item_id, vec_id) AS item_id, a.item_id IS NOT NULL AS was_input FROM a FULL JOIN embeddings ON a.item_id = vec_id WHERE a.item_id IS NULL OR vec_id IS NULL
""",
    "faulty_inputs": rf"""
WITH r AS (SELECT CASE WHEN turn <> 1 THEN CAST(conv_id AS VARCHAR) ELSE ' ' END AS item_id, CASE WHEN role = 'user' THEN text END AS text FROM conversations),
g AS (SELECT item_id, count(*) AS times, count(*) FILTER (WHERE {BLANK.format('item_id')} OR {BLANK.format('text')}) AS blank FROM r GROUP BY item_id)
SELECT item_id, blank, times FROM g WHERE blank > 0 OR times > 1
""",
    "element_kinds": rf"""
WITH r AS (SELECT doc_id, trim(regexp_extract(coalesce(text, ''), '^[^\n]*')) AS line, [NULL, 'Table Grid', ' heading 2', 'List Paragraph', 'Heading 10 ', 'Heading'][doc_id % 6 + 1] AS style,
  [NULL, 'Table_Row ', ' bullet', 'text', 'tabular'][doc_id % 5 + 1] AS declared, ['TABLE', 'list', NULL, 'x', NULL, NULL, NULL][doc_id % 7 + 1] AS told FROM documents),
s AS (SELECT *, coalesce(lower(trim(declared)), '') AS d, coalesce(lower(told), '') AS m, coalesce(lower(style), '') AS st FROM r)
SELECT doc_id, CAST(nullif(regexp_extract(trim(style), '(?i)^heading\s+([1-9]\d*)$', 1), '') AS BIGINT) AS level,
       CASE WHEN d IN ('table', 'table_row', 'tabular') OR m IN ('table', 'table_row', 'tabular') OR contains(st, 'table') THEN 'table'
            WHEN d IN ('list', 'list_item', 'bullet', 'numbered_list') OR contains(st, 'list') OR regexp_matches(line, '{LIST_ITEM}') THEN 'list' ELSE 'text' END AS kind FROM s
""",
    "chunks_by_document": "SELECT conv_id AS document_id, count(*) AS chunks, bool_and(role = 'user') AS unanswered FROM conversations GROUP BY conv_id",
}
