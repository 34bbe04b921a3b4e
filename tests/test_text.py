"""Text functions against their rules, written down as plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import headings, names, text


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


LIST = re.compile(r"^(?:[-*]\s+|\d+[.)]\s+|[a-zA-Z][.)]\s+|\([a-zA-Z0-9]+\)\s+)")
NUMBERED = re.compile(r"^\d+(?:\.\d+){0,5}\.?\s+\S+")


def cleaned(raw):
    """The cleaning rules, one after the other."""
    if raw is None or not raw.strip():
        return ""
    raw = raw.replace("\r\n", "\n").replace("\r", "\n")
    raw = re.sub(r"(?<=\w)-[ \t]*\n[ \t]*(?=[a-z])", "", raw)
    raw = re.sub(r"[^\S\r\n]+", " ", raw)
    lines = [x.strip() for x in raw.split("\n")]
    lines = [x for x in lines if not re.fullmatch(r"(?:page\s+)?\d+(?:\s+of\s+\d+)?", x, re.I)]
    lines = [("- " + x[1:].strip()).strip() if x[:1] and x[0] in "•‣◦⁃∙" else x for x in lines]
    out = []
    for line in lines:
        now = out[-1] if out else ""
        marked = LIST.match(now) or NUMBERED.match(now) or LIST.match(line) or NUMBERED.match(line)
        if now and line and now[-1] not in ".!?:;" and not marked and line[0].islower():
            out[-1] = f"{now} {line}"
        else:
            out.append(line)
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip()


CASES = [
    "manu-\nfacturing", "Risk-\nAssessment", "Page 3 of 9\nx\n12", "• x\n•\n‣y", "a b", "a\n\n\n\nb", "a\r\nb\rc", "the pump\nmust stop.", "end.\nnext", "Note:\nnext", "- item\nmore",
    "2.1 Scope\nof work", "a)\nfoo\nbar", "(1)\nfoo\nbar\nbaz", "1.2\nscope\nmore", "-\nfoo\nbar", "é-\na", "", None, "   ", "x\na)\nfoo\nbar", "Vor-\n  \tgang", "ünder\nübung",
]


def test_clean_text(spark):
    assert apply(spark, text.clean_text, CASES) == [cleaned(c) for c in CASES]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["foo", "Bar", "a)", "(1)", "-", "1.2", "- x", "end.", "Note:", "", "12", "page 4", "é", "•", " ", "b-"]), min_size=0, max_size=9).map("\n".join), min_size=40, max_size=80))
def test_clean_text_on_any_lines(spark, raws):
    assert apply(spark, text.clean_text, raws) == [cleaned(r) for r in raws]


def test_cleaning_twice_differs(spark):
    raw = ["- foo-\n12\nbar"]
    once = apply(spark, text.clean_text, raw)
    assert once == ["- foo-\nbar"]
    assert apply(spark, text.clean_text, once) == ["- foobar"]


def test_tokens_and_sentences(spark):
    values = ["one two\tthree", "", None, "  ", "A b. C d!  E? f", "x.y z."]
    assert apply(spark, text.count_tokens, values) == [3, 0, 0, 0, 6, 2]
    assert apply(spark, text.split_sentences, ["A b. C d!  E? f", "x.y z.", ""]) == [["A b.", "C d!", "E?", "f"], ["x.y z."], []]
    assert apply(spark, lambda c: text.within_limit(c, 2), ["a b", "a b c"]) == [True, False]
    with pytest.raises(ValueError):
        text.within_limit(F.lit(""), 0)


def test_words(spark):
    many = " ".join(map(str, range(1600)))
    pieces = apply(spark, lambda c: text.word_fragments(c, 500), [many, "", "a"])
    assert [len(p.split()) for p in pieces[0]] == [500, 500, 500, 100] and pieces[1:] == [[], ["a"]]
    assert apply(spark, lambda c: text.trailing_words(c, 2), ["a b c", "a", ""]) == ["b c", "a", ""]
    assert apply(spark, text.optional_int, [" 7 ", "x", "3.0", None]) == [7, None, None, None]
    assert apply(spark, text.required, ["  x\t", " ", None]) == ["x", None, None]
    assert apply(spark, text.margin_form, ["  Straße  12 \t von 7"]) == ["strasse <number> von <number>"]


HEADINGS = [
    ("Heading 2", "some text goes on.", "docx", 2), ("Heading 2", "some text goes on.", "pdf", None), (None, "1 Introduction", "pdf", 1), (None, "2.3 Risk Assessment", "pdf", 2),
    (None, "4.2.1 Requirements", "pdf", 3), (None, "1 Wear gloves.", "pdf", None), (None, "SAFETY RULES", "pdf", 1), (None, "Design of Safety Systems", "pdf", 2), (None, "The", "pdf", None),
    (None, "Scope", "pdf", 2), (None, "A" * 141, "pdf", None), (None, "Word " * 17, "pdf", None), (None, "Some words here", "pdf", None), (None, "(Draft) Of Things", "pdf", 2), ("heading 12", "x y", ".DOCX", 12),
    (None, "2.1 Scope\nof work", "pdf", None), (None, "12 34", "pdf", 1), (None, "--- ---", "pdf", None),
]


def test_heading_levels(spark):
    rows = spark.createDataFrame([(i, s, t.strip(), f) for i, (s, t, f, _) in enumerate(HEADINGS)], "i int, s string, t string, f string")
    found = rows.select("i", headings.heading_level(F.col("t"), F.col("s"), F.col("f")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in found] == [h[3] for h in HEADINGS]


def test_body_types(spark):
    cases = [("x", None, "table_row", None, "table"), ("x", "Table Grid", None, None, "table"), ("x", None, "bullet", None, "list"), ("x", "List Paragraph", None, None, "list"), ("(a) x", None, None, None, "list"), ("x", None, None, "Tabular", "table"), ("x", None, "other", None, "text"), ("a)", None, None, None, "text")]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, t string, s string, d string, m string")
    found = rows.select("i", headings.body_type(*map(F.col, "tsdm")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in found] == [c[4] for c in cases]


def test_names(spark):
    cases = [(12, "A", 1, 2, "Page 12"), (None, "A", 1, 2, "Section: A, Paragraphs 1–2"), (None, "A", 1, 1, "Section: A, Paragraph 1"), (None, "A", 1, None, "Section: A, Paragraph 1"), (None, "A", None, None, "Section: A"), (None, None, 3, 4, "Paragraphs 3–4"), (None, None, None, None, None)]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, p int, s string, a int, b int")
    assert [r["x"] for r in rows.select("i", names.location(*map(F.col, "psab")).alias("x")).orderBy("i").collect()] == [c[4] for c in cases]
    assert apply(spark, names.chat_title, ["x" * 35, "x" * 36]) == ["x" * 35, "x" * 32 + "..."]
    assert apply(spark, lambda c: names.history_title(c, F.lit(True)), ["x" * 30, "x" * 31]) == ["› " + "x" * 30, "› " + "x" * 27 + "..."]
    assert apply(spark, names.extension, ["..JPEG", "jpe", " PNG ", "", None]) == ["jpg", "jpg", "png", "png", "png"]
    assert apply(spark, names.route_label, ["web", "other", None]) == ["🌐 Web Search", "🤖 AI Response", "🤖 AI Response"]
    assert apply(spark, names.document_mime, ["pdf", "zip"]) == ["application/pdf", "application/octet-stream"]
    assert apply(spark, lambda c: names.error_message(c, F.lit("Kind")), ["x" * 5000, " ", None]) == ["x" * 4000, "Kind", "Kind"]
    assert apply(spark, names.progressive, ["a b c"]) == [["a", "a b", "a b c"]]
