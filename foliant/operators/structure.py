"""From the units of a document to its typed elements with section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.headings import body_type, heading_level
from ..functions.text import clean_text, optional_int, required

#: Levels that section_path() tracks one by one; deeper headings, which only styles can name, are rare and kept as a list.
TRACKED = 9

UNIT = {"text": "string", "style": "string", "section": "string", "content_type": "string", "page_number": "int", "paragraph_number": "int", "metadata": "map<string,string>"}


def units(df: DataFrame) -> DataFrame:
    """df with all fields of a unit; those that it lacks are null."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in UNIT.items() if name not in df.columns})


def lines_as_units(df: DataFrame, document: str = "document_id", order: str = "unit_ordinal") -> DataFrame:
    """Each line of a unit as a unit of its own, numbered through the document: headings are found within pages then."""
    rows = df.select("*", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    nth = F.row_number().over(Window.partitionBy(document).orderBy(order, "at")) - 1
    return rows.withColumn(order, nth).withColumn("text", F.col("line")).drop("at", "line")


def running_section(df: DataFrame, document: str = "document_id", order: str = "unit_ordinal") -> Column:
    """Text of the last unit so far whose style is a heading."""
    styled = F.when(F.lower("style").startswith("heading"), F.col("text"))
    return F.last(styled, ignorenulls=True).over(Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def open_headings(level: Column, title: Column, keys: list[str], order: str) -> Column:
    """at, title, level of the headings that a row stands under, from the top, over the rows of the same keys; a heading stands under itself.

    Of each level the last heading so far counts, unless a heading of a higher level came after it. All levels share one
    window, so one sort by the keys serves them. Levels have no end: those beyond TRACKED are a list of all such headings so far, of
    which those after the last tracked one make a stack.
    """
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct(F.col(order).cast("long").alias("at"), title.alias("title"), level.cast("int").alias("level"))
    last = [F.last(F.when(level == n, here), ignorenulls=True).over(so_far) for n in range(1, TRACKED + 1)]
    held = [last[0]] + [F.when(F.coalesce(last[n]["at"] > F.greatest(F.lit(-1), *[x["at"] for x in last[:n]]), F.lit(False)), last[n]) for n in range(1, TRACKED)]
    tracked = F.filter(F.array(*held), lambda x: x.isNotNull())
    since = F.greatest(F.lit(-1), *[x["at"] for x in last])
    deep = F.filter(F.collect_list(F.when(level > TRACKED, here)).over(so_far), lambda x: x["at"] > since)
    none = F.filter(deep, lambda _: F.lit(False))
    stack = F.aggregate(deep, none, lambda held, x: F.concat(F.filter(held, lambda y: y["level"] < x["level"]), F.array(x)))
    return F.concat(tracked, F.when(F.size(deep) > 0, stack).otherwise(none))


def section_path(level: Column, title: Column, document: str, order: str) -> Column:
    """Titles of the headings that a row of a document stands under, from the top."""
    return F.transform(open_headings(level, title, [document], order), lambda x: x["title"])


def typed(df: DataFrame, file_type: str = "file_type", clean_twice: bool = True) -> DataFrame:
    """Units with text, cleaned, with heading_level and element_type: what analyze() knows of a unit without those before it."""
    text = clean_text(clean_text(F.col("text"))) if clean_twice else clean_text(F.col("text"))
    rows = units(df).withColumn(file_type, F.ltrim(F.lower(F.col(file_type)), F.lit("."))).where(F.col(file_type).isin("pdf", "docx"))
    # Exploded, a cleaned text is computed once: a filter on it would be pushed down and compute it again.
    rows = rows.select(*[c for c in rows.columns if c != "text"], F.explode(F.filter(F.array(text), lambda t: t != "")).alias("text"))
    rows = rows.withColumns({n: required(F.col(n)) for n in ("style", "section", "content_type")} | {n: optional_int(F.col(n)) for n in ("page_number", "paragraph_number")})
    rows = rows.withColumn("heading_level", heading_level(F.col("text"), F.col("style"), F.col(file_type)))
    kind = body_type(F.col("text"), F.col("style"), F.col("content_type"), F.try_element_at("metadata", F.lit("content_type")))
    return rows.withColumn("element_type", F.when(F.col("heading_level").isNotNull(), "heading").otherwise(kind))


def analyze(df: DataFrame, document: str = "document_id", order: str = "unit_ordinal", file_type: str = "file_type", clean_twice: bool = True) -> DataFrame:
    """Elements of documents: element_type, heading_level, section, section_path and cleaned text, one for each unit with text.

    df: units (fields of UNIT, what is missing is null) with document, order and file_type, which is pdf or docx; units of other
    types are left out, as are documents' order gaps. clean_twice: clean a text that may have been cleaned before once more,
    which matters where a page number stood between a hyphen and the rest of its word.
    """
    rows = typed(df, file_type, clean_twice)
    rows = rows.withColumn("section_path", section_path(F.col("heading_level"), F.col("text"), document, order))
    return rows.withColumn("section", F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.col("section")))
