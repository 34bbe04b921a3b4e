"""A training corpus from documents: quality rules, line dedup, near duplicates, a mix of sources, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe import bpe_encode
from foliant.llm.jaccardjoin import keep_first
from foliant.llm.linededup import drop_lines
from foliant.llm.mix import mix
from foliant.llm.quality import keep_good
from foliant.llm.queries import tokenizer
from foliant.llm.shared import names, workspace, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null, empty and blank texts among them; rows that come twice stay or go twice. The limits are
    fitted from the table labels, or are hand-set, wide ones where sf_dir has none. All columns are kept, whatever their names.
    An empty table gives no rows, here and in all stages."""
    path = f"{sf_dir}/labels.parquet"
    labelled = sf_dir and "labels.parquet" in names(spark, sf_dir)
    return keep_good(docs, labels=spark.read.parquet(path) if labelled else None)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of several documents stays in the first of them. All documents stay, a text may become empty; n_chars follows the text.
    A null text becomes an empty one; rows without an id count as one document after all others, rows that share one as one."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id; those without an id come last. Of rows with
    the same id and text one stays; a text without words is a group of its own."""
    return keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it. Rows without a source are a source of their own; rows that share an
    id, or have none, are drawn alike."""
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row; a null or empty text has none. A row that comes twice stays two."""
    return bpe_encode(docs, tokenizer("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: Compression, MinHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage over the written table of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = workspace(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"{at}/{n}")
    return docs
