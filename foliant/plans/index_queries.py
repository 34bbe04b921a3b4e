"""Queries over stored indexes: postings that were replaced in part, containment, vectors in lists; and search over keys that are texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import containment, fulltext
from ..operators import containment as lookups
from ..operators import retrieval, vector_index
from ..session import scratch, spread, table
from ..sources.store import Change, Store, Table
from . import search_queries

INDEXES = {"postings": Table("lexeme string, doc_id long, pos int", ("lexeme",), owner=("doc_id",)), "items": Table(lookups.ITEMS, ("item",), owner=("document_id",))}
K = 10


def stored_keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all documents, a tenth of them with another text at first, which is then replaced; ranks are those of the texts as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = Store(spark, scratch(spark, "postings"), INDEXES)
    old = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit(search_queries.WORDS)).otherwise(F.col("text")))
    for some in (old, docs.where("doc_id % 10 = 0")):
        words = fulltext.postings(some, "doc_id", "text", stemming=False)
        store.apply([Change("postings", some.select("doc_id"), lambda _, words=words: words)])
    query = fulltext.parse(search_queries.WORDS, stemming=False)
    wanted = spark.createDataFrame([(x,) for x in query.lexemes(True)], "lexeme string")
    return fulltext.keyword_rank(store.read("postings", keys=wanted), "doc_id", query).select("doc_id", F.round(F.least("rank", F.lit(1.0)), 9).alias("rank"))


def _metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    size = F.when(F.col("n_chars") >= 2000, "long").otherwise("short")
    meta = F.struct("lang", F.struct("source", (F.col("doc_id") % 5).alias("shelf")).alias("from"), F.array(size, F.col("lang")).alias("tags"))
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("document_id"), F.to_json(meta).alias("metadata"), F.split("source", "r").alias("section_path"))


def metadata_containment(spark, sf_dir):
    """Documents whose metadata contain an object, and those whose path contains a part, by an index of their leaves in a store."""
    rows = _metadata(spark, sf_dir)
    store = Store(spark, scratch(spark, "items"), INDEXES)
    entries = lookups.entries(rows, ["metadata", "section_path"])
    store.apply([Change("items", rows.select("document_id").distinct(), lambda _: entries)])
    found = None
    for column, part in (("metadata", {"from": {"shelf": 3}, "tags": ["long"]}), ("metadata", {"lang": "en", "tags": ["en", "short"]}), ("section_path", ["c3"])):
        wanted = spark.createDataFrame([(x,) for x in containment.hashes(part)], "item long")
        one = lookups.containing(rows, store.read("items", keys=wanted), column, part).select(F.col("id").cast("long").alias("doc_id"), F.lit(str(part)).alias("contains"))
        found = one if found is None else found.unionByName(one)
    return found


def retrieve_text_ids(spark, sf_dir):
    """The blended search of many questions where questions and chunks go by texts."""
    name = lambda c, p: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 9, "0"))
    chunks = table(spark, sf_dir, "embeddings").select(name("vec_id", "c-").alias("id"), "vec_id", "embedding")
    asked = chunks.where("vec_id % 20 = 0").select(name("vec_id", "q-").alias("query_id"), "embedding", F.when(F.col("vec_id") % 40 == 0, search_queries.WORDS).otherwise(search_queries.WORDS.split()[0]).alias("question"))
    texts = table(spark, sf_dir, "documents").select(name("doc_id", "c-").alias("id"), "text")
    asked = retrieval.alike(asked)
    index = fulltext.postings(spread(texts), "id", "text", stemming=False, only=search_queries.EITHER)
    ranks = fulltext.keyword_rank_batch(index, "id", asked.where("query_id = asked_as").select("query_id", "question"), stemming=False)
    best = retrieval.vector_topk_batch(chunks, asked, 5, ranks=ranks, by="asked_as")
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_index_topk(spark, sf_dir):
    """The ten nearest rows of each question by the index."""
    index = vector_index.build(table(spark, sf_dir, "embeddings"), scratch(spark, "vectors"), key="vec_id", k=K)
    return vector_index.search(index, _asked(spark, sf_dir), K).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_index_recall(spark, sf_dir):
    """How many pairs of question and true neighbour there are, by the exact scan, and whether the index finds 95 in 100 of them."""
    index = vector_index.build(table(spark, sf_dir, "embeddings"), scratch(spark, "vectors"), key="vec_id", k=K)
    asked = _asked(spark, sf_dir)
    exact = retrieval.vector_topk_batch(index.vectors.withColumnRenamed("v", "embedding"), asked, K, key="key").select("query_id", F.col("key").alias("id"))
    found = vector_index.search(index, asked, K).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("questions"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.95 * F.count("*")).alias("enough"))


QUERIES = {f.__name__: f for f in (stored_keyword_rank, metadata_containment, retrieve_text_ids, vector_index_topk, vector_index_recall)}

SQL = {
    "stored_keyword_rank": search_queries.SQL["keyword_rank_and"],
    "metadata_containment": """
SELECT doc_id, '{''from'': {''shelf'': 3}, ''tags'': [''long'']}' AS contains FROM documents WHERE doc_id % 5 = 3 AND n_chars >= 2000
UNION ALL SELECT doc_id, '{''lang'': ''en'', ''tags'': [''en'', ''short'']}' FROM documents WHERE lang = 'en' AND NOT coalesce(n_chars >= 2000, false)
UNION ALL SELECT doc_id, '[''c3'']' FROM documents WHERE list_contains(string_split(source, 'r'), 'c3')
""",
    "retrieve_text_ids": f"""
SELECT 'q-' || lpad(CAST(query_id AS VARCHAR), 9, '0') AS query_id, 'c-' || lpad(CAST(id AS VARCHAR), 9, '0') AS id, score, rank FROM ({search_queries.SQL["blended_topk_batch"]})
""",
    "vector_index_recall": """
SELECT count(*) AS questions, CAST(sum(least(10, n)) AS BIGINT) AS neighbours, true AS enough FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 20 = 0
""",
}
