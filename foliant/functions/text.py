"""Text columns: white space, cleaning of extracted pages, tokens and sentences. All are built from Spark's own functions.

White space, digits, letters and word characters are Unicode's, hence (?U) in the patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what a line is.
PAGE_NUMBER = r"(?iU)^(?:page\s+)?\d+(?:\s+of\s+\d+)?$"
BULLET = "^[•‣◦⁃∙]"
LIST_ITEM = r"(?U)^(?:[-*]\s+|\d+[.)]\s+|[a-zA-Z][.)]\s+|\([a-zA-Z0-9]+\)\s+)"
NUMBERED = r"(?U)^\d+(?:\.\d+){0,5}\.?\s+\S+"
ENDING = r"[.!?:;]$"
#: A line that is a list item or numbered heading only once text follows its marker.
BARE = r"(?U)^(?:[-*]|\d+(?:\.\d+)*[.)]?|[a-zA-Z][.)]|\([a-zA-Z0-9]+\))$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row. As a plain expression it would be computed at each place, in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def required(text: Column) -> Column:
    """The stripped text; null where it is blank."""
    return F.when(~is_blank(text), strip(text))


def optional_int(value: Column) -> Column:
    """A number from a text, null where it isn't one."""
    return strip(value.cast("string")).try_cast("int")


def positive_int(value: Column) -> Column:
    number = optional_int(value)
    return F.when(number > 0, number)


def line_endings(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def repair_hyphens(text: Column) -> Column:
    """Joins words that a hyphen cuts at a line's end, where the next line goes on in lower case."""
    return F.regexp_replace(text, r"(?U)(?<=\w)-[ \t]*\n[ \t]*(?=[a-z])", "")


def single_spaces(text: Column) -> Column:
    """Runs of white space within a line as one space."""
    return F.regexp_replace(text, r"(?U)[^\S\r\n]+", " ")


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def bullet(line: Column) -> Column:
    """A bullet symbol at the start as `- `; `-` where nothing follows."""
    rest = strip(F.regexp_replace(line, BULLET, ""))
    return F.when(line.rlike(BULLET), F.when(rest == "", "-").otherwise(F.concat(F.lit("- "), rest))).otherwise(line)


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def is_numbered(line: Column) -> Column:
    return line.rlike(NUMBERED)


def lines(text: Column) -> Column:
    """Stripped lines without page numbers, with bullets made alike."""
    stripped = F.transform(F.split(text, "\n", -1), strip)
    return F.transform(F.filter(stripped, lambda x: ~is_page_number(x)), bullet)


def _goes_on(current: Column, following: Column) -> Column:
    """Whether a line continues the text before it."""
    fresh = (current != "") & (following != "") & ~current.rlike(ENDING)
    marked = is_list_item(current) | is_numbered(current) | is_list_item(following) | is_numbered(following)
    return fresh & ~marked & following.rlike(r"^\p{Ll}")


def _joined(rows: Column) -> Column:
    """Joins each line to the one before it where _goes_on says so. Right unless a line is a bare marker: what a line is then doesn't
    depend on what it was joined to."""
    tied = F.transform(rows, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.when(_goes_on(F.get(rows, i - 1), x), " ").otherwise("\n"), x)))
    return F.array_join(tied, "")


def _folded(rows: Column) -> Column:
    """The same by a fold over the joined text, right for bare markers too."""
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(state: Column, line: Column) -> Column:
        now, done = state["now"], state["done"]
        ended = F.when(now.isNull(), done).otherwise(F.concat(done, now, F.lit("\n")))
        on = now.isNotNull() & F.coalesce(_goes_on(now, line), F.lit(False))
        return F.struct(F.when(on, done).otherwise(ended).alias("done"), F.when(on, F.concat(now, F.lit(" "), line)).otherwise(line).alias("now"))

    return F.aggregate(rows, start, step, lambda s: F.concat(s["done"], F.coalesce(s["now"], F.lit(""))))


def merge_lines(rows: Column) -> Column:
    """The text of an array of lines, with wrapped lines joined by a space."""
    return let(rows, lambda r: F.when(F.exists(r, lambda x: x.rlike(BARE)), _folded(r)).otherwise(_joined(r)))


def fewer_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def clean_text(text: Column) -> Column:
    """Line ends, hyphens, white space, page numbers, bullets, wrapped lines and blank lines, in this order; null and blank texts give an empty one."""
    whole = single_spaces(repair_hyphens(line_endings(F.coalesce(text, F.lit("")))))
    return strip(fewer_blank_lines(merge_lines(lines(whole))))


def count_tokens(text: Column) -> Column:
    """Number of words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def within_limit(text: Column, most: int) -> Column:
    if most < 1:
        raise ValueError("a limit of tokens must be at least 1")
    return count_tokens(text) <= most


def split_sentences(text: Column) -> Column:
    """Sentences by their closing mark and the white space after it; stripped, without empty ones."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_fragments(text: Column, size: int) -> Column:
    """The words in pieces of `size`, the last one shorter."""
    starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return let(words(text), lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, size), " ")))


def trailing_words(text: Column, n: int) -> Column:
    """The last n words."""
    return let(words(text), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), n), " "))


def fold_case(text: Column) -> Column:
    """Lower case, with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def margin_form(line: Column) -> Column:
    """A page's first or last line as it is compared with those of other pages: digits masked, case folded."""
    masked = F.regexp_replace(strip(fold_case(line)), r"(?U)\d+", "<number>")
    return F.regexp_replace(masked, r"(?U)\s+", " ")
