"""What a unit of a document is: heading with its level, table, list or text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_case, is_list_item, let, strip, words

# Fixed values of the heading rules.
LONGEST, MOST_WORDS = 140, 16
SENTENCE_END = r"[.!?;]$"
STYLE = r"(?iU)^heading\s+([1-9]\d*)$"
NUMBERED = r"(?U)^(\d+(?:\.\d+){0,5})\.?\s+(\S.*)$"
CONNECTORS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
TABLES = ["table", "table_row", "tabular"]
LISTS = ["list", "list_item", "bullet", "numbered_list"]


def heading_length(text: Column) -> Column:
    return (text != "") & (F.length(text) <= LONGEST) & (F.size(words(text)) <= MOST_WORDS)


def style_level(style: Column) -> Column:
    """Level in a heading style's name, else null."""
    return F.nullif(F.regexp_extract(strip(style), STYLE, 1), F.lit("")).try_cast("int")


def numbered_level(text: Column) -> Column:
    """Number of parts of a heading's number, else null."""
    number, title = F.regexp_extract(text, NUMBERED, 1), strip(F.regexp_extract(text, NUMBERED, 2))
    parts = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    return F.when(heading_length(text) & (number != "") & ~title.rlike(SENTENCE_END) & ~text.contains("\n"), parts)


def is_uppercase_heading(text: Column) -> Column:
    letters = text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")
    return heading_length(text) & ~text.rlike(SENTENCE_END) & letters


def is_title_heading(text: Column) -> Column:
    """Whether all words but connectors start with a capital; a single word needs four characters."""
    fit = heading_length(text) & ~text.rlike(SENTENCE_END) & ~text.contains("\n")
    return F.when(fit, let(words(text), _titled)).otherwise(False)


def _titled(all_words: Column) -> Column:
    first = F.element_at(all_words, 1)
    bare = F.transform(all_words, lambda x, i: F.struct(F.regexp_replace(x, r"^[()\[\]{}:,\-/]+|[()\[\]{}:,\-/]+$", "").alias("w"), i.alias("i")))
    meaning = F.filter(bare, lambda x: (x["w"] != "") & ((x["i"] == 0) | ~fold_case(x["w"]).isin(CONNECTORS)))
    capital = lambda x: x["w"].rlike(r"^\p{Lu}") | (x["w"].rlike(r"\p{Lu}") & ~x["w"].rlike(r"[\p{Ll}\p{Lt}]"))
    single = (F.length(first) >= 4) & first.rlike(r"^\p{Lu}")
    return F.when(F.size(all_words) == 1, single).otherwise(let(meaning, lambda m: (F.size(m) > 0) & F.forall(m, capital)))


def heading_level(text: Column, style: Column, file_type: Column) -> Column:
    """Level of a heading by style (docx only), number, capitals or title, in this order; null for all else. text is stripped."""
    return F.coalesce(
        F.when(F.ltrim(F.lower(file_type), F.lit(".")) == "docx", style_level(style)),
        numbered_level(text),
        F.when(F.coalesce(is_uppercase_heading(text), F.lit(False)), 1),
        F.when(F.coalesce(is_title_heading(text), F.lit(False)), 2),
    )


def body_type(text: Column, style: Column, declared: Column, metadata_type: Column) -> Column:
    """table, list or text of what is no heading."""
    named, style = fold_case(strip(declared)), F.coalesce(fold_case(style), F.lit(""))
    return (
        F.when(named.isin(TABLES) | fold_case(metadata_type).isin(TABLES) | style.contains("table"), "table")
        .when(named.isin(LISTS) | style.contains("list") | is_list_item(text), "list")
        .otherwise("text")
    )
