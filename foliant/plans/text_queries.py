"""Queries over texts: cleaning, tokens, sentences, headings, chunks. Each has SQL beside it where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import headings, names, text
from ..operators import chunks, long_documents, margins, structure, validate
from ..session import spread, table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a docx file whose lines are its paragraphs."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("unit_ordinal", "text"))
    return rows.withColumns({"file_type": F.lit("docx"), "paragraph_number": F.col("unit_ordinal") + 1})


def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.count_tokens(F.col("text")).cast("long").alias("tokens"))


def oversized_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~text.within_limit(F.col("text"), 700)).select("doc_id", text.count_tokens(F.col("text")).cast("long").alias("tokens"))


def sentence_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0))
    return docs.select("doc_id", F.size("s").cast("long").alias("sentences"), longest.cast("long").alias("longest"), F.try_element_at("s", F.lit(-1)).alias("last"))


def word_fragments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.word_fragments(F.col("text"), 500)).alias("fragment", "content"))
    return docs.select("doc_id", F.col("fragment").cast("long").alias("fragment"), F.count("*").over(Window.partitionBy("doc_id")).alias("fragments"), text.count_tokens(F.col("content")).cast("long").alias("tokens"), F.md5("content").alias("content_md5"))


def trailing_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.trailing_words(F.col("text"), 75).alias("tail"))


def clean_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


FIXTURE = [
    (1, "manu-\nfacturing and\nmore"),
    (2, "Risk-\nAssessment"),
    (3, "Page 3 of 9\nbody text\n12"),
    (4, "• first\n•\n‣  second"),
    (5, "a\u00a0b\r\nc\rd\n\n\n\n\ne"),
    (6, "the pump\nmust stop.\nNote:\nnext\n- item\nmore"),
    (7, "2.1 Scope\nof work"),
    (8, "  \n "),
    (9, None),
]


def clean_fixture(spark, sf_dir):
    """Each document's source as a last paragraph behind one of the odd texts."""
    raw = F.element_at(F.array(*[F.lit(t) for _, t in FIXTURE]), (F.col("doc_id") % len(FIXTURE) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce(raw, F.lit("")), F.lit("\n\n"), F.col("source")).alias("raw"))
    return rows.select("doc_id", text.clean_text(F.col("raw")).alias("cleaned"))


def classify_lines(spark, sf_dir):
    rows = _units(spark, sf_dir).withColumn("text", text.strip(F.col("text"))).where("text <> ''")
    level = headings.heading_level(F.col("text"), F.lit(None).cast("string"), F.lit("pdf"))
    kind = headings.body_type(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return rows.select("document_id", F.col("unit_ordinal").cast("long").alias("unit_ordinal"), level.cast("long").alias("level"), F.when(level.isNotNull(), "heading").otherwise(kind).alias("kind"))


def heading_paths(spark, sf_dir):
    rows = _units(spark, sf_dir).withColumn("text", text.strip(F.col("text"))).where("text <> ''")
    level = headings.heading_level(F.col("text"), F.lit(None).cast("string"), F.lit("pdf"))
    path = structure.section_path(F.col("level"), F.col("text"), "document_id", "unit_ordinal")
    return rows.withColumn("level", level).withColumn("path", F.array_join(path, " > ")).select("document_id", F.col("unit_ordinal").cast("long").alias("unit_ordinal"), "path")


def running_section(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("style", F.when(F.col("role") == "user", "Heading 1").otherwise("Normal"))
    return rows.select("conv_id", "turn", structure.running_section(rows, "conv_id", "turn").alias("section"))


def analyze_elements(spark, sf_dir):
    found = structure.analyze(_units(spark, sf_dir))
    return found.select("document_id", "unit_ordinal", "element_type", "heading_level", F.array_join("section_path", " > ").alias("path"), F.md5("text").alias("text_md5"))


def analyze_pages(spark, sf_dir):
    """Headings, paragraphs and list items of web pages as styled units."""
    tags = r"(?s)<(h1|p|li)>(.*?)(?=</?(?:p|li|h1|ul|article)\b|<br)"
    found = table(spark, sf_dir, "pages").select("page_id", F.arrays_zip(F.regexp_extract_all("html", F.lit(tags), 1).alias("tag"), F.regexp_extract_all("html", F.lit(tags), 2).alias("text")).alias("u"))
    rows = found.select(F.col("page_id").alias("document_id"), F.posexplode("u").alias("unit_ordinal", "u")).select("document_id", "unit_ordinal", F.regexp_replace("u.text", "<[^>]*>", "").alias("text"), F.col("u.tag").alias("tag"))
    style = F.when(F.col("tag") == "h1", "Heading 1").when(F.col("tag") == "li", "List Paragraph")
    found = structure.analyze(rows.withColumns({"style": style, "file_type": F.lit("docx")}))
    return found.select("document_id", "unit_ordinal", "element_type", "heading_level", "section")


def repeated_margins(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "text"))
    return margins.repeated_lines(pages, ratio=0.02).select("document_id", "place", "line", "n")


def clean_pages(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "doc_id", "text"))
    return margins.clean_pages(pages, ratio=0.02).select("doc_id", F.md5("text").alias("text_md5"))


def chunk_documents(spark, sf_dir):
    found = chunks.build_chunks(structure.analyze(_units(spark, sf_dir)))
    return found.select("document_id", "chunk_index", "content_type", "token_count", "section", F.array_join("section_path", " > ").alias("path"), "paragraph_start", "paragraph_end", F.md5("content").alias("content_md5"))


#: Values of the order for each document of a source, and documents in a block.
LINES, DOCUMENTS = 10_000_000, 1024


def chunk_sources(spark, sf_dir):
    """Each source as one long document: the lines of its documents, by id."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("document_id"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    units = rows.select("document_id", (F.col("doc_id") * LINES + F.col("line")).alias("unit_ordinal"), "text", F.lit("docx").alias("file_type"))
    found = long_documents.build_chunks(units, block=LINES * DOCUMENTS)
    return found.select("document_id", "chunk_index", "content_type", "token_count", "section", F.array_join("section_path", " > ").alias("path"), F.md5("content").alias("content_md5"))


def chunk_issues(spark, sf_dir):
    """Faults of chunks: here each document is one, so long and short ones have issues."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("content"), text.count_tokens(F.col("text")).alias("token_count"), F.lit("a").alias("file_name"), F.lit(" ").alias("blob_name"), F.lit("pdf").alias("file_type"))
    return validate.validate(rows).groupBy("collection", "severity", "code", "field_name").agg(F.count("*").alias("n"))


def source_locations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    page = F.when(F.col("lang") == "en", F.col("doc_id"))
    section = F.when(F.col("lang") != "de", F.col("source"))
    first, last = F.when(F.col("lang") != "es", F.col("n_chars")), F.when(F.length("source") > 4, F.col("n_chars") + F.length("source") - 5)
    return rows.select("doc_id", names.location(page, section, first, last).alias("location"))


QUERIES = {f.__name__: f for f in (token_count, oversized_docs, sentence_stats, word_fragments, trailing_words, clean_documents, clean_fixture, classify_lines, heading_paths, running_section, analyze_elements, analyze_pages, repeated_margins, clean_pages, chunk_documents, chunk_sources, chunk_issues, source_locations)}

WS = r"[ \t\n\v\f\r]"
TOKENS = f"CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS BIGINT)"
LIST_ITEM = r"^([-*]\s+|\d+[.)]\s+|[a-zA-Z][.)]\s+|\([a-zA-Z0-9]+\)\s+)"
NUMBERED = r"^\d+(\.\d+){0,5}\.?\s+\S+"


def _marked(line: str) -> str:
    return f"(regexp_matches({line}, '{LIST_ITEM}') OR regexp_matches({line}, '{NUMBERED}'))"


def _cleaned(source: str) -> str:
    """cleaned(doc_id, source, cleaned) over a table of doc_id, source, text."""
    return rf"""
whole AS (
  SELECT doc_id, source, regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
         '([\p{{L}}\p{{N}}_])-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g'), '[ \t\v\f\x{{a0}}]+', ' ', 'g') AS t FROM {source}
), split AS (
  SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS nth FROM whole
), kept AS (
  SELECT doc_id, source, nth, trim(line) AS line FROM split WHERE NOT regexp_matches(trim(line), '(?i)^(page\s+)?\d+(\s+of\s+\d+)?$')
), bulleted AS (
  SELECT doc_id, source, nth, CASE WHEN regexp_matches(line, '^[•‣◦⁃∙]') THEN rtrim('- ' || trim(regexp_replace(line, '^[•‣◦⁃∙]', ''))) ELSE line END AS line FROM kept
), tied AS (
  SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY nth) AS before FROM bulleted
), joined AS (
  SELECT doc_id, source, nth, line, CASE WHEN before IS NULL THEN '' WHEN before <> '' AND line <> '' AND NOT regexp_matches(before, '[.!?:;]$')
         AND NOT {_marked('before')} AND NOT {_marked('line')} AND regexp_matches(line, '^\p{{Ll}}') THEN ' ' ELSE chr(10) END AS sep FROM tied
), cleaned AS (
  SELECT d.doc_id, d.source, coalesce(trim(regexp_replace(string_agg(sep || line, '' ORDER BY nth), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)), '') AS cleaned
  FROM {source} d LEFT JOIN joined j ON d.doc_id = j.doc_id GROUP BY d.doc_id, d.source
)"""


CLEANED = f"WITH {_cleaned('documents')}\n"

TITLE_WORD = r"regexp_replace(regexp_replace(w, '^[()\[\]{}:,\-/]+', ''), '[()\[\]{}:,\-/]+$', '')"



def _lined(source: str) -> str:
    """lined(document_id, unit_ordinal, line, level) over a table of document_id, unit_ordinal and line, without blank lines."""
    return rf"""
worded AS (
  SELECT *, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS words FROM {source} WHERE line <> ''
), fit AS (
  SELECT *, length(line) <= 140 AND len(words) <= 16 AND NOT regexp_matches(line, '[.!?;]$') AS fits,
         list_filter(list_transform(words, lambda w, i: {{'w': {TITLE_WORD}, 'i': i}}),
                     lambda x: x.w <> '' AND (x.i = 1 OR lower(x.w) NOT IN ('a','an','and','as','at','by','for','from','in','of','on','or','the','to','with'))) AS meaning
  FROM worded
), lined AS (
  SELECT document_id, unit_ordinal, line, CAST(CASE
    WHEN fits AND regexp_matches(line, '^\d+(\.\d+){{0,5}}\.?\s+\S.*$') THEN 1 + len(regexp_extract_all(regexp_extract(line, '^(\d+(\.\d+){{0,5}})', 1), '\.'))
    WHEN fits AND regexp_matches(line, '\p{{L}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') THEN 1
    WHEN fits AND len(words) = 1 AND length(line) >= 4 AND regexp_matches(line, '^\p{{Lu}}') THEN 2
    WHEN fits AND len(words) > 1 AND len(meaning) > 0 AND len(list_filter(meaning, lambda x: NOT regexp_matches(x.w, '^\p{{Lu}}')
         AND NOT (regexp_matches(x.w, '\p{{Lu}}') AND NOT regexp_matches(x.w, '[\p{{Ll}}\p{{Lt}}]')))) = 0 THEN 2 END AS BIGINT) AS level
  FROM fit
)"""


LINED = rf"""
WITH raw AS (
  SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS unit_ordinal FROM documents
), stripped AS (
  SELECT document_id, unit_ordinal, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM raw
), {_lined("stripped")}
"""

#: seen(document_id, unit_ordinal, a, b, c): the last headings of the first three levels so far, over rows of document_id, unit_ordinal, line, level.
SEEN = r"""seen AS (
  SELECT *,
         last_value(CASE WHEN level = 1 THEN {'at': unit_ordinal, 'title': line} END IGNORE NULLS) OVER w AS a,
         last_value(CASE WHEN level = 2 THEN {'at': unit_ordinal, 'title': line} END IGNORE NULLS) OVER w AS b,
         last_value(CASE WHEN level = 3 THEN {'at': unit_ordinal, 'title': line} END IGNORE NULLS) OVER w AS c
  FROM lined WINDOW w AS (PARTITION BY document_id ORDER BY unit_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

#: Which document a cleaned line is of, and its place there: each document for itself, or a source with all its documents' lines.
OF_DOCUMENTS = "SELECT doc_id // 10000000 AS document_id, doc_id % 10000000 AS unit_ordinal, cleaned AS line FROM cleaned"
OF_SOURCES = "SELECT coalesce(d.source, '') AS document_id, c.doc_id AS unit_ordinal, c.cleaned AS line FROM cleaned c JOIN documents d ON d.doc_id = c.doc_id // 10000000"

#: elements(document_id, unit_ordinal, line, level, kind, path) over the lines of documents, each cleaned by itself.
ELEMENTS = rf"""
WITH RECURSIVE units AS (
  SELECT doc_id * 10000000 + nth AS doc_id, '' AS source, line AS text
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS nth FROM documents)
), {_cleaned("units")}, bare AS (
  {OF_DOCUMENTS}
), {_lined("bare")}, {SEEN}, elements AS (
  SELECT document_id, unit_ordinal, line, level, CASE WHEN level IS NOT NULL THEN 'heading' WHEN regexp_matches(line, '{LIST_ITEM}') THEN 'list' ELSE 'text' END AS kind,
         list_filter([a.title, CASE WHEN b.at > coalesce(a.at, -1) THEN b.title END, CASE WHEN c.at > greatest(coalesce(a.at, -1), coalesce(b.at, -1)) THEN c.title END], lambda x: x IS NOT NULL) AS path
  FROM seen
)
"""


def _sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^ \t\n\v\f\r]+')"


#: chunked(document_id, idx, els, path): the elements of each chunk. cuts parts elements above 700 tokens, a part a step; packed makes
#: chunks, one a step for each document: from `at` on up to the first element that doesn't fit, with the overlap `ov` before them.
CHUNKED = ELEMENTS + rf""", sized AS (
  SELECT document_id, unit_ordinal, line, kind, path, len({_words("line")}) AS n FROM elements
), big AS (
  SELECT document_id, unit_ordinal, s, list_transform(s, lambda x: len({_words("x")})) AS ns FROM (SELECT document_id, unit_ordinal, {_sentences("line")} AS s FROM sized WHERE n > 700)
), cuts AS (
  SELECT document_id, unit_ordinal, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS nth, CAST([] AS VARCHAR[]) AS parts FROM big
  UNION ALL
  SELECT document_id, unit_ordinal, stop, nth + len(parts),
         CASE WHEN ns[pos] > 700 THEN list_transform(range(0, ns[pos], 500), lambda i: array_to_string({_words("s[pos]")}[i + 1:i + 500], ' ')) ELSE [array_to_string(s[pos:stop - 1], ' ')] END
  FROM (
    SELECT c.*, s, ns, CASE WHEN ns[pos] > 700 THEN pos + 1 ELSE coalesce(list_filter(range(pos + 1, len(ns) + 1), lambda j: ns[j] > 700 OR list_sum(ns[pos:j]) > 500)[1], len(ns) + 1) END AS stop
    FROM cuts c JOIN big b ON c.document_id = b.document_id AND c.unit_ordinal = b.unit_ordinal AND c.pos <= len(b.ns)
  )
), pieces AS (
  SELECT document_id, unit_ordinal, nth + i AS piece, parts[i + 1] AS line FROM (SELECT *, unnest(range(len(parts))) AS i FROM cuts)
), frags AS (
  SELECT document_id, unit_ordinal, 0 AS piece, line, n, kind, path FROM sized WHERE n <= 700
  UNION ALL SELECT document_id, unit_ordinal, piece, p.line, len({_words("p.line")}), kind, path FROM pieces p JOIN sized s USING (document_id, unit_ordinal)
), counted AS (
  SELECT document_id, unit_ordinal, piece, {{'t': line, 'n': n, 'k': kind, 'p': path, 'para': unit_ordinal + 1}} AS e,
         sum(n) OVER w AS c, count(*) FILTER (WHERE kind <> 'heading') OVER w AS b
  FROM frags WINDOW w AS (PARTITION BY document_id ORDER BY unit_ordinal, piece ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), docs AS (
  SELECT document_id, list(e ORDER BY unit_ordinal, piece) AS f, list(CAST(c AS BIGINT) ORDER BY unit_ordinal, piece) AS c, list(b ORDER BY unit_ordinal, piece) AS b FROM counted GROUP BY document_id
), packed AS (
  SELECT document_id, CAST(0 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS pos, CAST(NULL AS STRUCT(t VARCHAR, n BIGINT, k VARCHAR, para BIGINT)) AS ov FROM docs
  UNION ALL
  SELECT document_id, idx + 1, stop, CASE WHEN NOT parted AND text <> '' AND len({_words("text")}) + f[stop].n <= 700 THEN {{'t': text, 'n': len({_words("text")}), 'k': coalesce(last.k, ov.k), 'para': coalesce(last.para, ov.para)}} END
  FROM (
    SELECT *, CASE WHEN len(s) = 0 THEN '' WHEN ns[1] > 75 THEN array_to_string({_words("s[1]")}[-75:], ' ')
                   ELSE array_to_string(list_reverse(s[1:len(list_filter(range(1, len(s) + 1), lambda j: list_sum(ns[1:j]) <= 75))]), ' ') END AS text
    FROM (
      SELECT *, list_transform(s, lambda x: len({_words("x")})) AS ns FROM (
        SELECT *, f[stop - 1].p <> f[stop].p AND (ov IS NOT NULL OR len(body) > 0) AS parted, body[-1] AS last,
               list_reverse(flatten(list_transform(list_concat(CASE WHEN ov IS NULL THEN CAST([] AS VARCHAR[]) ELSE [ov.t] END, list_transform(body, lambda x: x.t)), lambda x: {_sentences("x")})))[1:76] AS s
        FROM (
          SELECT *, list_filter(f[pos:stop - 1], lambda x: x.k <> 'heading') AS body FROM (
            SELECT p.*, f, list_filter(range(pos + 1, least(len(f), pos + 701) + 1), lambda j: f[j - 1].p <> f[j].p AND (ov IS NOT NULL OR b[j - 1] > coalesce(b[pos - 1], 0)) OR coalesce(ov.n, 0) + c[j] - coalesce(c[pos - 1], 0) > 700)[1] AS stop
            FROM packed p JOIN docs d ON p.document_id = d.document_id
          ) WHERE stop IS NOT NULL
        )
      )
    )
  )
), chunked AS (
  SELECT document_id, idx, list_concat(CASE WHEN ov IS NULL THEN [] ELSE [{{'t': ov.t, 'n': ov.n, 'k': ov.k, 'p': f[pos].p, 'para': ov.para}}] END, f[pos:stop - 1]) AS els
  FROM (SELECT p.*, f, coalesce(lead(pos) OVER (PARTITION BY p.document_id ORDER BY idx), len(f) + 1) AS stop FROM packed p JOIN docs d ON p.document_id = d.document_id)
)
"""


def _chunks(more: str) -> str:
    return rf"""
SELECT CAST(document_id AS VARCHAR) AS document_id, CAST(idx AS INTEGER) AS chunk_index, CASE WHEN len(kinds) > 0 AND len(list_filter(kinds, lambda k: k <> 'list')) = 0 THEN 'list' ELSE 'text' END AS content_type,
       CAST(len({_words("content")}) AS INTEGER) AS token_count, path[-1] AS section, array_to_string(path, ' > ') AS path, {more}md5(content) AS content_md5
FROM (
  SELECT document_id, idx, list_filter(list_transform(els, lambda x: x.k), lambda k: k <> 'heading') AS kinds, list_transform(els, lambda x: x.para) AS paras,
         list_filter(els, lambda x: len(x.p) = list_max(list_transform(els, lambda y: len(y.p))))[1].p AS path,
         trim(array_to_string(list_transform(els, lambda x, i: CASE WHEN i = 1 THEN '' WHEN x.k = 'list' AND els[i - 1].k = 'list' THEN chr(10) ELSE chr(10) || chr(10) END || trim(x.t)), '')) AS content
  FROM chunked
)
"""


def _form(line: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(replace(lower({line}), 'ß', 'ss')), '\d+', '<number>', 'g'), '\s+', ' ', 'g')"


#: often(document_id, place, line, n): what the first and last lines of enough pages are, over sources as documents.
MARGINS = CLEANED + rf""", bounds AS (
  SELECT source AS document_id, list_filter(string_split(cleaned, chr(10)), lambda x: trim(x) <> '') AS l FROM cleaned
), lines AS (
  SELECT document_id, 'head' AS place, l[1] AS line FROM bounds WHERE len(l) > 0 UNION ALL SELECT document_id, 'foot', l[-1] FROM bounds WHERE len(l) > 0
), counts AS (SELECT document_id, place, {_form("line")} AS line, count(*) AS n FROM lines GROUP BY ALL),
sizes AS (SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE len(l) > 0) AS full_pages FROM bounds GROUP BY document_id),
often AS (
  SELECT document_id, place, line, n FROM counts JOIN sizes USING (document_id) WHERE pages >= 3 AND n >= greatest(2, floor(full_pages * CAST(0.02 AS DOUBLE) + 0.999)) AND line <> ''
)
"""

SQL = {
    "token_count": f"SELECT doc_id, {TOKENS} AS tokens FROM documents",
    "oversized_docs": f"SELECT doc_id, {TOKENS} AS tokens FROM documents WHERE {TOKENS} > 700",
    "sentence_stats": r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest, s[-1] AS last FROM s
""",
    "word_fragments": rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS w, unnest(range(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')))) AS i FROM documents),
f AS (SELECT doc_id, CAST(i // 500 AS BIGINT) AS fragment, count(*) AS tokens, md5(string_agg(w, ' ' ORDER BY i)) AS content_md5 FROM w GROUP BY doc_id, i // 500)
SELECT doc_id, fragment, count(*) OVER (PARTITION BY doc_id) AS fragments, tokens, content_md5 FROM f
""",
    "trailing_words": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS w FROM documents)
SELECT doc_id, array_to_string(w[greatest(1, len(w) - 74):len(w)], ' ') AS tail FROM w
""",
    "clean_documents": CLEANED + "SELECT doc_id, cleaned FROM cleaned",
    "clean_fixture": r"""
WITH t AS (SELECT * FROM (VALUES (1, 'manufacturing and more'), (2, 'Risk-' || chr(10) || 'Assessment'), (3, 'body text'), (4, '- first' || chr(10) || '-' || chr(10) || '- second'),
 (5, 'a b c d' || chr(10) || chr(10) || 'e'), (6, 'the pump must stop.' || chr(10) || 'Note:' || chr(10) || 'next' || chr(10) || '- item' || chr(10) || 'more'),
 (7, '2.1 Scope' || chr(10) || 'of work'), (8, ''), (9, '')) v(id, cleaned))
SELECT doc_id, CASE WHEN cleaned <> '' THEN cleaned || chr(10) || chr(10) ELSE '' END || source AS cleaned FROM documents JOIN t ON id = doc_id % 9 + 1
""",
    "classify_lines": LINED + f"SELECT document_id, unit_ordinal, level, CASE WHEN level IS NOT NULL THEN 'heading' WHEN regexp_matches(line, '{LIST_ITEM}') THEN 'list' ELSE 'text' END AS kind FROM lined",
    "heading_paths": LINED
    + f", {SEEN}"
    + r"""
SELECT document_id, unit_ordinal, concat_ws(' > ', a.title, CASE WHEN b.at > coalesce(a.at, -1) THEN b.title END,
       CASE WHEN c.at > greatest(coalesce(a.at, -1), coalesce(b.at, -1)) THEN c.title END) AS path
FROM seen
""",
    "analyze_elements": ELEMENTS + "SELECT document_id, CAST(unit_ordinal AS INTEGER) AS unit_ordinal, kind AS element_type, CAST(level AS INTEGER) AS heading_level, array_to_string(path, ' > ') AS path, md5(line) AS text_md5 FROM elements",
    "analyze_pages": rf"""
WITH cut AS (
  SELECT page_id, unnest(string_split(regexp_replace(html, '(</?(?:p|li|h1|ul|article)\b|<br)', chr(1) || '\1', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(html, '(</?(?:p|li|h1|ul|article)\b|<br)', chr(1) || '\1', 'g'), chr(1)), 1) AS place FROM pages
), found AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS nth, regexp_extract(part, '^<(h1|p|li)>', 1) AS tag, regexp_replace(regexp_replace(part, '^<(h1|p|li)>', ''), '<[^>]*>', '', 'g') AS text
  FROM cut WHERE regexp_matches(part, '^<(h1|p|li)>')
), units AS (SELECT page_id * 10000000 + nth AS doc_id, tag AS source, text FROM found), {_cleaned("units")}, bare AS (
  SELECT doc_id // 10000000 AS document_id, doc_id % 10000000 AS unit_ordinal, source AS tag, cleaned AS line FROM cleaned
), {_lined("bare").replace("SELECT document_id, unit_ordinal, line, CAST(CASE", "SELECT document_id, unit_ordinal, tag, line, CAST(CASE WHEN tag = 'h1' THEN 1")}, {SEEN}
SELECT document_id, CAST(unit_ordinal AS INTEGER) AS unit_ordinal, CASE WHEN level IS NOT NULL THEN 'heading' WHEN tag = 'li' OR regexp_matches(line, '{LIST_ITEM}') THEN 'list' ELSE 'text' END AS element_type, CAST(level AS INTEGER) AS heading_level,
       coalesce(CASE WHEN c.at > greatest(coalesce(a.at, -1), coalesce(b.at, -1)) THEN c.title END, CASE WHEN b.at > coalesce(a.at, -1) THEN b.title END, a.title) AS section
FROM seen
""",
    "chunk_documents": CHUNKED + _chunks("CAST(list_min(paras) AS INTEGER) AS paragraph_start, CAST(list_max(paras) AS INTEGER) AS paragraph_end, "),
    "chunk_sources": CHUNKED.replace(OF_DOCUMENTS, OF_SOURCES) + _chunks(""),
    "running_section": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations",
    "repeated_margins": MARGINS + "SELECT document_id, place, line, n FROM often",
    "clean_pages": MARGINS
    + r""", numbered AS (
  SELECT doc_id, source, cleaned, string_split(cleaned, chr(10)) AS l FROM cleaned
), ends AS (
  SELECT *, list_filter(range(1, len(l) + 1), lambda i: trim(l[i]) <> '') AS full_lines FROM numbered
), forms AS (
  SELECT *, """
    + _form("l[full_lines[1]]")
    + " AS head, "
    + _form("l[full_lines[-1]]")
    + r""" AS foot FROM ends
), told AS (SELECT document_id, list(line) FILTER (WHERE place = 'head') AS heads, list(line) FILTER (WHERE place = 'foot') AS feet FROM often GROUP BY document_id),
left_over AS (
  SELECT doc_id, cleaned, t.document_id IS NULL AS whole, list_transform(l, lambda x, i: CASE WHEN i = full_lines[1] AND coalesce(list_contains(heads, head), false) OR i = full_lines[-1] AND coalesce(list_contains(feet, foot), false) THEN '' ELSE x END) AS kept
  FROM forms f LEFT JOIN told t ON f.source = t.document_id
)
SELECT doc_id, md5(CASE WHEN whole THEN cleaned ELSE trim(regexp_replace(array_to_string(kept, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) END) AS text_md5 FROM left_over
""",
    "chunk_issues": rf"""
WITH c AS (SELECT source AS collection, doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS BIGINT) AS tokens,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth, count(*) OVER (PARTITION BY source, doc_id) AS same FROM documents),
i AS (
  SELECT collection, 'error' AS severity, 'MISSING_BLOB_NAME' AS code, 'blob_name' AS field_name FROM c
  UNION ALL SELECT collection, 'error', 'CHUNK_EXCEEDS_MAX_TOKENS', 'token_count' FROM c WHERE tokens > 700
  UNION ALL SELECT collection, 'warning', 'VERY_SMALL_CHUNK', 'token_count' FROM c WHERE tokens > 0 AND tokens < 20
  UNION ALL SELECT collection, 'error', 'EMPTY_CHUNK_CONTENT', 'content' FROM c WHERE tokens = 0
  UNION ALL SELECT DISTINCT collection, 'error', 'NON_SEQUENTIAL_CHUNK_INDEXES', 'chunk_index' FROM c WHERE nth <> doc_id
)
SELECT collection, severity, code, field_name, count(*) AS n FROM i GROUP BY ALL
""",
    "source_locations": """
WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id END AS page, CASE WHEN lang <> 'de' THEN source END AS section, CASE WHEN lang <> 'es' THEN n_chars END AS a,
  CASE WHEN length(source) > 4 THEN n_chars + length(source) - 5 END AS b FROM documents),
p AS (SELECT *, CASE WHEN b IS NOT NULL AND b <> a THEN 'Paragraphs ' || a || '–' || b WHEN a IS NOT NULL THEN 'Paragraph ' || a END AS para FROM r)
SELECT doc_id, CASE WHEN page IS NOT NULL THEN 'Page ' || page WHEN section IS NOT NULL AND para IS NOT NULL THEN 'Section: ' || section || ', ' || para
  WHEN section IS NOT NULL THEN 'Section: ' || section ELSE para END AS location FROM p
""",
}
