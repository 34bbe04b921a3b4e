"""From questions to answers: embed, search, route, prompt, generate. All questions go through each step together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.fulltext import keyword_rank_batch
from ..functions.names import route_label
from ..operators import embedding, retrieval

SYSTEM = "Answer from the given context only. Say so where it doesn't hold the answer."
INTERNAL = ("Internal document context:", "Provide a clear, well-grounded answer based only on the internal document context.")
WEB = ("Web search results:", "Provide a clear answer based only on the web search results.")


@dataclass(frozen=True)
class Settings:
    text_k: int = retrieval.TEXT_K
    image_k: int = retrieval.IMAGE_K
    web_k: int = retrieval.WEB_K
    threshold: float = retrieval.THRESHOLD
    system: str = SYSTEM
    stemming: bool = True

    def __post_init__(self):
        if min(self.text_k, self.image_k, self.web_k) < 1 or not 0 <= self.threshold <= 1:
            raise ValueError("numbers of results must be positive and the threshold between 0 and 1")


def _placed(chunks: DataFrame) -> DataFrame:
    """chunks with page, section and paragraphs; stored ones have them in their metadata."""
    of = lambda name, kind: F.get_json_object("metadata", f"$.{name}").cast(kind)
    told = {"page": ("page_start", "int"), "section": ("section", "string"), "paragraph_start": ("paragraph_start", "int"), "paragraph_end": ("paragraph_end", "int")}
    return chunks.withColumns({c: of(*where) for c, where in told.items() if c not in chunks.columns}) if "metadata" in chunks.columns else chunks


def retrieve(questions: DataFrame, chunks: DataFrame, documents: DataFrame, index: DataFrame, settings: Settings | None = None) -> DataFrame:
    """query_id, id, document_id, document_name, score, rank and the other columns of chunks: the best blended matches of each question.

    questions: query_id, question, embedding. Chunks are scored in blocks of questions, and joined again only once they are chosen.
    """
    settings = settings or Settings()
    questions = retrieval.alike(questions)
    ranks = keyword_rank_batch(index, "id", questions.where("query_id = asked_as"), settings.stemming)
    chunks = _placed(chunks)
    names = documents.select(F.col("id").alias("document_id"), F.col("file_name").alias("document_name"))
    known = chunks.join(names.select("document_id"), "document_id", "left_semi")
    best = retrieval.vector_topk_batch(known, questions, settings.text_k, ranks=ranks, by="asked_as")
    return best.join(chunks.drop("embedding"), "id").join(names, "document_id")


def _asked(questions: DataFrame, model: Callable[[list[str]], Any]) -> tuple[DataFrame, DataFrame]:
    """The valid questions, and those of them that the model gave a vector, with it."""
    valid = questions.where(retrieval.valid_question(F.col("question")))
    vectors = embedding.embed(valid.select(F.col("query_id").cast("string").alias("item_id"), F.col("question").alias("text")), model, "questions")
    return valid, valid.join(vectors.select("item_id", "embedding"), F.col("query_id").cast("string") == F.col("item_id")).where("embedding is not null").drop("item_id")


def _own_sources(found: DataFrame) -> DataFrame:
    """query_id, own: the chunks of a question as its sources, in the order of their rank."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "title", "location", "score")))
    one = lambda x: F.struct(F.lit("internal").alias("source_type"), x["title"].alias("title"), x["location"].alias("location"), F.lit(None).cast("string").alias("url"), x["score"].alias("score"))
    return retrieval.sources(found).groupBy("query_id").agg(F.transform(rows, one).alias("own"))


def grounded(questions: DataFrame, chunks: DataFrame, documents: DataFrame, index: DataFrame, model: Callable[[list[str]], Any], generate: Callable[[Column], Column], settings: Settings | None = None) -> DataFrame:
    """A row for each valid question: answer, sources, retrieved_chunk_count, requires_web_search.

    No threshold: whatever chunks there are make the prompt. Where there are none, the answer is a fixed one and a search of the web
    is called for.
    """
    settings = settings or Settings()
    valid, asked = _asked(questions, model)
    found = retrieve(asked, chunks, documents, index, settings)
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = valid.join(counts, "query_id", "left").join(retrieval.document_context(found), "query_id", "left").join(_own_sources(found), "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    text = retrieval.prompt(settings.system, INTERNAL[0], F.col("context"), F.col("question"), INTERNAL[1])
    told = F.when(n > 0, generate(text)).otherwise(retrieval.NO_CHUNKS)
    return rows.select("query_id", "question", told.alias("answer"), F.col("own").alias("sources"), n.alias("retrieved_chunk_count"), (n == 0).alias("requires_web_search"))


def answer(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, index: DataFrame, model: Callable[[list[str]], Any], generate: Callable[[Column], Column], images: DataFrame | None = None, web: DataFrame | None = None, settings: Settings | None = None
) -> DataFrame:
    """A row for each valid question (query_id of any type, question): route, label, reason, counts, highest score, answer, sources, image ids.

    model embeds texts, generate is a function of a column of prompts. web: results of a search (query_id, position, title, link,
    snippet) for questions that the documents don't answer; without it such questions have no source. images: id, document_id,
    caption_embedding, found for internally answered questions only.
    """
    settings = settings or Settings()
    valid, asked = _asked(questions, model)
    found = retrieve(asked, chunks, documents, index, settings)
    nothing = questions.where("false").select("query_id", F.lit(0).alias("position"), *[F.lit("").alias(c) for c in ("title", "link", "snippet")])
    results = retrieval.web_results(web, settings.web_k) if web is not None else nothing
    routes = retrieval.route(valid, found, settings.threshold, results)

    inside, outside = retrieval.document_context(found), retrieval.web_context(results)
    prompts = routes.join(valid, "query_id").join(inside, "query_id", "left").join(outside.withColumnRenamed("context", "web_context"), "query_id", "left")
    text = F.when(F.col("route") == "internal", retrieval.prompt(settings.system, INTERNAL[0], F.col("context"), F.col("question"), INTERNAL[1]))
    text = text.when(F.col("route") == "web", retrieval.prompt(settings.system, WEB[0], F.col("web_context"), F.col("question"), WEB[1]))
    told = retrieval.answers(routes, prompts.select("query_id", "question", text.alias("prompt")), generate)

    links = results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "title", "link"))), lambda x: F.struct(F.lit("web").alias("source_type"), x["title"].alias("title"), F.lit(None).cast("string").alias("location"), x["link"].alias("url"), F.lit(None).cast("double").alias("score"))).alias("links"))
    told = told.join(_own_sources(found), "query_id", "left").join(links, "query_id", "left")
    told = told.withColumn("sources", F.when(F.col("route") == "internal", F.col("own")).when(F.col("route") == "web", F.col("links")))
    if images is not None:
        internal = asked.join(routes.where("route = 'internal'").select("query_id"), "query_id", "left_semi")
        seen = retrieval.vector_topk_batch(images, internal, settings.image_k, vector="embedding") if "embedding" in images.columns else retrieval.vector_topk_batch(images.withColumnRenamed("caption_embedding", "embedding"), internal, settings.image_k)
        shown = seen.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("images"))
        told = told.join(shown, "query_id", "left")
    else:
        told = told.withColumn("images", F.lit(None).cast(ArrayType(chunks.schema["id"].dataType)))
    return told.select("query_id", "question", "route", route_label(F.col("route")).alias("label"), "route_reason", "retrieved_chunk_count", "highest_retrieval_score", "web_result_count", F.lit(settings.threshold).alias("retrieval_threshold"), "answer", "sources", "images")
