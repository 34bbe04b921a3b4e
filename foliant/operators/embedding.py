"""Calls of models in batches, and the checks that their answers go through. The models are functions that the caller passes in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from queue import Empty, Queue
from threading import Thread
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import CAPTIONED, image_item_id, item_id
from ..functions.text import is_blank, required
from ..functions.vectors import is_valid
from .numbering import numbered

BATCH = 32


def chunk_inputs(chunks: DataFrame) -> DataFrame:
    """item_id and text of chunks."""
    return chunks.select(item_id(F.col("document_id"), F.col("chunk_index")).alias("item_id"), F.col("content").alias("text"))


def image_inputs(images: DataFrame) -> DataFrame:
    return images.select(image_item_id(F.col("document_id"), F.col("image_index")).alias("item_id"), F.col("caption").alias("text"))


def batched(inputs: DataFrame, order: str, size: int = BATCH, within: str | None = None) -> DataFrame:
    """inputs with `batch`, the number of the batch that a row falls in, from 0. order: a column whose values differ, within each
    value of `within` or else in the whole table, which is numbered range by range."""
    if size < 1:
        raise ValueError("a batch must have at least one row")
    if within:
        rows = inputs.withColumn("__nth", F.row_number().over(Window.partitionBy(within).orderBy(order)))
    else:
        rows = numbered(inputs, order, "__nth")
    return rows.withColumn("batch", F.floor((F.col("__nth") - 1) / size)).drop("__nth")


@dataclass(frozen=True)
class Client:
    """How a model is called: seconds that an answer may take, and how often a failed call is made again, after waits that double.

    The call runs in a thread of its own; one that takes too long is left to itself and counts as failed.
    """

    timeout: float = 30.0
    retries: int = 2
    wait: float = 0.5

    def __post_init__(self):
        if self.timeout <= 0 or self.retries < 0 or self.wait < 0:
            raise ValueError("the timeout must be positive, retries and wait not negative")

    def __call__(self, call: Callable[..., Any], *given: Any) -> Any:
        for attempt in range(self.retries + 1):
            try:
                return self._once(call, given)
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)

    def _once(self, call: Callable[..., Any], given: tuple[Any, ...]) -> Any:
        box: Queue = Queue()

        def run() -> None:
            try:
                box.put((call(*given), None))
            except Exception as e:
                box.put((None, e))

        Thread(target=run, daemon=True).start()
        try:
            value, error = box.get(timeout=self.timeout)
        except Empty:
            raise TimeoutError(f"no answer within {self.timeout:g} seconds") from None
        if error is not None:
            raise error
        return value


#: Limits of calls for vectors and for captions.
EMBEDDING, CAPTION = Client(), Client(timeout=60.0)


def embed(inputs: DataFrame, model: Callable[[list[str]], tuple[list[list[float] | None], int | None]], name: str, size: int = BATCH, client: Client = EMBEDDING) -> DataFrame:
    """item_id, embedding, model, total_tokens (of the row's batch, on its first row), error.

    model: from texts to vectors in their order, and the tokens used. It is called for `size` texts at a time within a task. If a
    call fails for good, as client has it, or gives another number of vectors, its rows have an error in place of vectors, and the others go on.
    """

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            out = []
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                try:
                    vectors, used = client(model, part["text"].tolist())
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                    error = None
                except Exception as e:
                    vectors, used, error = [None] * len(part), None, str(e) or type(e).__name__
                out += [(i, v, name, used if n == 0 else None, error) for n, (i, v) in enumerate(zip(part["item_id"], vectors))]
            yield pd.DataFrame(out, columns=["item_id", "embedding", "model", "total_tokens", "error"])

    return inputs.select("item_id", "text").mapInPandas(run, "item_id string, embedding array<float>, model string, total_tokens long, error string")


def caption(images: DataFrame, model: Callable[[bytes, str], str], name: str, client: Client = CAPTION) -> DataFrame:
    """images (content, mime_type, ...) with caption, caption_model and error. Images of other types than CAPTIONED are left out, a blank caption is an error."""

    @F.pandas_udf("struct<caption:string,error:string>")
    def told(content: pd.Series, mime: pd.Series) -> pd.DataFrame:
        out = []
        for data, kind in zip(content, mime):
            try:
                text = (client(model, bytes(data), kind) or "").strip()
                out.append((text or None, None if text else "the model gave no caption"))
            except Exception as e:
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["caption", "error"])

    good = images.where(F.lower("mime_type").isin(CAPTIONED) & (F.length("content") > 0))
    return good.withColumn("__told", told("content", "mime_type")).select("*", "__told.caption", F.lit(name).alias("caption_model"), "__told.error").drop("__told")


def faulty_inputs(inputs: DataFrame) -> DataFrame:
    """Inputs with a blank id or text."""
    return inputs.where(is_blank(F.col("item_id")) | is_blank(F.col("text")))


def repeated_ids(inputs: DataFrame) -> DataFrame:
    return inputs.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1")


def faulty_vectors(embeddings: DataFrame, dimensions: int) -> DataFrame:
    """Rows whose vector isn't of so many numbers."""
    return embeddings.where(~is_valid(F.col("embedding"), dimensions))


def lost(inputs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """item_id that one side has and the other lacks."""
    a, b = inputs.select("item_id", F.lit(1).alias("a")), embeddings.select("item_id", F.lit(1).alias("b"))
    return a.join(b, "item_id", "full_outer").where("a is null or b is null").select("item_id", F.col("a").isNotNull().alias("was_input"))


def by_index(items: DataFrame, inputs: DataFrame, index: str = "index") -> DataFrame:
    """A provider's items joined with their inputs by index."""
    return inputs.join(items, index)


def totals(batches: DataFrame, *by: str) -> DataFrame:
    """input_count, total_tokens (null if a batch has none) and whether the models are one, over batches (n, total_tokens, model), or
    for each value of `by`."""
    whole = F.when(F.count_if(F.col("total_tokens").isNull()) == 0, F.sum("total_tokens"))
    return batches.groupBy(*by).agg(F.sum("n").alias("input_count"), whole.alias("total_tokens"), (F.count_distinct("model") == 1).alias("one_model"))


def caption_text(text: Column) -> Column:
    return required(text)
