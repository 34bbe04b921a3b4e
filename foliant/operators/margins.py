"""Headers and footers that the pages of a document repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, fewer_blank_lines, margin_form, strip


def _ends(text: Column) -> tuple[Column, Column]:
    """Places of the first and last line with text, from 0; null if there is none."""
    full = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(x.rlike(r"(?U)\S"), i)), lambda i: i.isNotNull())
    return F.array_min(full), F.array_max(full)


def _marked(pages: DataFrame, text: str) -> DataFrame:
    """pages with cleaned texts, the places of their first and last line, and what these are compared by."""
    first, last = _ends(F.col(text))
    lines = F.split(text, "\n", -1)
    once = F.explode(F.array(clean_text(F.col(text)))).alias(text)  # a plain column would be computed at each place that names it
    marked = pages.select(*[once if c == text else F.col(c) for c in pages.columns]).withColumns({"__first": first, "__last": last})
    return marked.withColumns({"__head": margin_form(F.get(lines, F.col("__first"))), "__foot": margin_form(F.get(lines, F.col("__last")))})


def _often(marked: DataFrame, document: str, ratio: float, least_pages: int) -> DataFrame:
    sizes = marked.groupBy(document).agg(F.count("*").alias("__pages"), F.count("__first").alias("__full"))
    ends = F.array(F.struct(F.lit("head").alias("place"), F.col("__head").alias("line")), F.struct(F.lit("foot").alias("place"), F.col("__foot").alias("line")))
    counts = marked.where("__first is not null").select(document, F.explode(ends).alias("c")).groupBy(document, "c.place", "c.line").agg(F.count("*").alias("n"))
    needed = F.greatest(F.lit(2), F.floor(F.col("__full") * ratio + 0.999))
    enough = (F.col("__pages") >= least_pages) & (F.col("n") >= needed) & (F.col("line") != "")
    return counts.join(sizes, document).where(enough).select(document, "place", "line", "n")


def repeated_lines(pages: DataFrame, document: str = "document_id", text: str = "text", ratio: float = 0.6, least_pages: int = 3) -> DataFrame:
    """document, place (head or foot), line (digits masked), n: first and last lines that enough pages of a document have."""
    return _often(_marked(pages, text), document, ratio, least_pages)


def clean_pages(pages: DataFrame, document: str = "document_id", text: str = "text", ratio: float = 0.6, least_pages: int = 3) -> DataFrame:
    """pages with cleaned texts, without first and last lines that enough pages of their document have in the same place.

    Enough: two, and the share `ratio` of the pages with text, rounded up from a thousandth on. Documents with fewer than
    least_pages pages are cleaned only. Lines are counted for each document and place; the frequent ones, few for a document,
    are joined back.
    """
    if not 0 < ratio <= 1 or least_pages < 1:
        raise ValueError("ratio must be in (0, 1] and least_pages at least 1")
    lines = F.split(text, "\n", -1)
    marked = _marked(pages, text)
    often = _often(marked, document, ratio, least_pages)
    often = often.groupBy(document).agg(*[F.collect_set(F.when(F.col("place") == p, F.col("line"))).alias(f"__{p}s") for p in ("head", "foot")])
    gone = lambda x, i: F.when(((i == F.col("__first")) & F.array_contains("__heads", F.col("__head"))) | ((i == F.col("__last")) & F.array_contains("__foots", F.col("__foot"))), "").otherwise(x)
    left = strip(fewer_blank_lines(F.array_join(F.transform(lines, gone), "\n")))
    out = marked.join(often, document, "left").withColumn(text, F.when(F.col("__heads").isNull(), F.col(text)).otherwise(left))
    return out.select(*pages.columns)
