"""Scores of answered questions; what needs a language model gets it passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .embedding import Client

#: Limits of calls of a judge.
JUDGE = Client(timeout=120.0)


def routing(questions: DataFrame, answered: DataFrame, key: str = "id") -> DataFrame:
    """questions (expected_route) with actual_route, correct, highest_retrieval_score and route_reason. Unanswered ones are wrong."""
    rows = questions.join(answered.select(key, F.col("route").alias("actual_route"), "highest_retrieval_score", "route_reason"), key, "left")
    return rows.withColumn("correct", F.coalesce(F.col("actual_route") == F.col("expected_route"), F.lit(False)))


def accuracy(results: DataFrame) -> DataFrame:
    """total, correct_count, accuracy; 0 where there is no question."""
    right = F.count_if("correct")
    share = F.coalesce(F.try_divide(right.cast("double"), F.count("*").cast("double")), F.lit(0.0))
    return results.agg(F.count("*").alias("total"), right.alias("correct_count"), share.alias("accuracy"))


def metric_means(scores: DataFrame, digits: int = 4) -> DataFrame:
    """metric and value: the mean of each metric (metric, score), NaN and null left out, rounded."""
    good = F.when(~F.isnan("score"), F.col("score"))
    return scores.groupBy("metric").agg(F.round(F.avg(good), digits).alias("value"))


def judged(answered: DataFrame, judge: Callable[[str, str, list[str], str], dict[str, float]], metrics: list[str], client: Client = JUDGE) -> DataFrame:
    """id, metric, score, error: what a judging model says of each answer (id, question, answer, contexts, reference), such as
    faithfulness, context precision and recall. A metric that it leaves out, or a call that fails for good, gives a null score, which
    metric_means() passes over; the others go on."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            out = []
            for key, question, answer, contexts, reference in zip(*(frame[c] for c in ("id", "question", "answer", "contexts", "reference"))):
                try:
                    told, error = client(judge, question, answer, list(contexts) if contexts is not None else [], reference), None
                except Exception as e:
                    told, error = {}, str(e) or type(e).__name__
                out += [(key, m, told.get(m), error) for m in metrics]
            yield pd.DataFrame(out, columns=["id", "metric", "score", "error"])

    rows = answered.select("id", "question", "answer", "contexts", "reference")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, metric string, score double, error string")


def verdicts(items: DataFrame, judge: Callable[[str, str, str], bool], client: Client = JUDGE) -> DataFrame:
    """id, kind, place, verdict, error for each item (id, kind, place, text, against): a chunk of the retrieved ones is asked for its use
    for the answer, a statement of the reference for a chunk that has it, a claim of the answer for a context that supports it. judge(kind,
    text, against) says yes or no; a call that fails for good gives a null verdict."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            out = []
            for key, kind, place, text, against in zip(*(frame[c] for c in ("id", "kind", "place", "text", "against"))):
                try:
                    told, error = bool(client(judge, kind, text, against)), None
                except Exception as e:
                    told, error = None, str(e) or type(e).__name__
                out.append((key, kind, place, told, error))
            yield pd.DataFrame(out, columns=["id", "kind", "place", "verdict", "error"])

    rows = items.select("id", "kind", "place", "text", "against")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, kind string, place {dict(rows.dtypes)['place']}, verdict boolean, error string")


def context_precision(chunks: DataFrame, key: str = "id") -> DataFrame:
    """key and score of each question's chunks (key, place, verdict): the mean, over the useful chunks, of the share of useful ones up to
    there. 0 where none is useful; null where a verdict is missing, or there is no chunk."""
    so_far = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    useful = F.col("verdict").cast("double")
    rows = chunks.withColumns({"__nth": F.row_number().over(Window.partitionBy(key).orderBy("place")), "__sum": F.sum(useful).over(so_far)})
    total = F.coalesce(F.try_divide(F.sum(useful * F.col("__sum") / F.col("__nth")), F.sum(useful)), F.lit(0.0))
    return rows.groupBy(key).agg(F.when(F.count("verdict") == F.count("*"), total).alias("score"))


def confirmed(items: DataFrame, key: str = "id") -> DataFrame:
    """key and score: the share of items (key, verdict) that were confirmed, null where a verdict is missing. Over the statements of a
    reference answer that is context recall, over the claims of an answer its faithfulness."""
    return items.groupBy(key).agg(F.when(F.count("verdict") == F.count("*"), F.count_if("verdict") / F.count("*")).alias("score"))


def answer_metrics(judged: DataFrame, key: str = "id") -> DataFrame:
    """key, metric, score from verdicts(): context_precision of chunks, context_recall of statements, faithfulness of claims."""
    parts = {"chunk": ("context_precision", context_precision), "statement": ("context_recall", confirmed), "claim": ("faithfulness", confirmed)}
    found = [how(judged.where(F.col("kind") == kind), key).select(key, F.lit(metric).alias("metric"), "score") for kind, (metric, how) in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def ingestion_counts(documents: DataFrame) -> DataFrame:
    """total, succeeded, failed."""
    count = lambda s: F.count_if(F.col("processing_status") == s)
    return documents.agg(F.count("*").alias("total"), count("completed").alias("succeeded"), count("failed").alias("failed"))


def retrieval_scores(results: DataFrame) -> DataFrame:
    """Least, median, mean and greatest of the highest retrieval scores."""
    s = F.col("highest_retrieval_score")
    return results.agg(F.min(s).alias("least"), F.median(s).alias("median"), F.avg(s).alias("mean"), F.max(s).alias("greatest"))
