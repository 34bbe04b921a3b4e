"""Keyword search: lexemes with positions, queries of words, phrases, `or` and `-`, and cover density ranks.

Stemming is Porter's second algorithm for English, run over distinct words only; all else is done by Spark's own functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# English words without meaning of their own.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them"
    " their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing"
    " a an the and but if or because as until while of at by for with about against between into through during before after above below to"
    " from up down in out on off over under again further then once here there when where why how all any both each few more most other some"
    " such no nor not only own same so than too very s t can will just don should now".split()
)
#: Weight of a lexeme in a cover; all lexemes have the lowest class.
WEIGHT = 0.1
#: Bytes of questions, with 64 for each, that are sent to all executors.
ASKED_BYTES = 8 << 20

VOWEL = "[aeiouy]"
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
FIXED = frozenset("sky news howe atlas cosmos bias andes".split())
FIXED_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts begin that follow the first, and the second, consonant after a vowel."""
    m = re.match("gener|commun|arsen", word)
    first = m.end() if m else (n.end() if (n := re.search(f"{VOWEL}[^aeiouy]", word)) else len(word))
    n = re.compile(f"{VOWEL}[^aeiouy]").search(word, first)
    return first, n.end() if n else len(word)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of an English word in lower case."""
    if len(word) <= 2 or word in FIXED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.lstrip("'")
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in FIXED_LATER:
        return word
    if m := re.search("(eed|eedly)$", word):
        word = word[: m.start()] + "ee" if m.start() >= r1 else word
    elif (m := re.search("(ed|edly|ing|ingly)$", word)) and re.search(VOWEL, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for ending in sorted(STEP_2, key=len, reverse=True):
        if word.endswith(ending):
            if len(word) - len(ending) >= r1:
                word = word[: -len(ending)] + STEP_2[ending]
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word.endswith("logi"):
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and re.search("[cdeghkmnrt]li$", word):
            word = word[:-2]
    for ending in sorted([*STEP_3, "ative"], key=len, reverse=True):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if ending == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + STEP_3[ending]
            break
    for ending in sorted([*STEP_4, "ion"], key=len, reverse=True):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r2 and (ending != "ion" or word[:at].endswith(("s", "t"))):
                word = word[:at]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not SHORT.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(StringType())
def stemmed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in words:
        yield part.map(stem, na_action="ignore")


def terms(text: Column) -> Column:
    """Words of letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(docs: DataFrame, id_col: str, text_col: str, stemming: bool = True, only: Query | None = None) -> DataFrame:
    """id_col, lexeme, pos: a row for each word but stop words, which still count in the positions (from 1).

    only: a query that isn't stemmed. Texts that lack a word which it needs are passed over, and of the others its words alone
    become rows; its ranks are those of the whole index.
    """
    words = terms(F.col(text_col))
    if only is None:
        rows = docs.select(F.col(id_col), F.posexplode(words).alias("at", "word")).where(~F.col("word").isin(*STOP))
        return rows.select(id_col, (stemmed("word") if stemming else F.col("word")).alias("lexeme"), (F.col("at") + 1).alias("pos"))
    if stemming:
        raise ValueError("a stem doesn't tell which words of a text it stands for")
    lower, named, may = F.lower(F.col(text_col)), only.lexemes(True), F.lit(False)
    for must in (only.lexemes_of(a) for a in only.alternatives):
        holds = F.lit(bool(must))
        for word in must:
            holds = holds & lower.contains(word)
        may = may | holds
    numbered = F.filter(F.transform(words, lambda w, i: F.struct((i + 1).alias("pos"), w.alias("lexeme"))), lambda x: x["lexeme"].isin(named))
    return docs.where(may).select(F.col(id_col), F.explode(numbered).alias("x")).select(id_col, "x.lexeme", "x.pos")


def store_postings(index: DataFrame, id_col: str, table: str, path: str, buckets: int = 64, parts: int = 8) -> DataFrame:
    """postings as a table in buckets of their lexemes, sorted: a query reads the buckets of its lexemes only. The rows of a frequent
    lexeme are written by up to `parts` tasks, each to a file of its own."""
    dealt = index.repartition(F.col("lexeme"), F.pmod(F.xxhash64(id_col), F.lit(parts)))
    dealt.write.bucketBy(buckets, "lexeme").sortBy("lexeme", id_col, "pos").option("path", path).mode("overwrite").saveAsTable(table)
    return index.sparkSession.table(table)


@dataclass(frozen=True)
class Term:
    """Lexemes that follow each other at the given distances; one lexeme for a plain word."""

    lexemes: tuple[str, ...]
    distances: tuple[int, ...] = (0,)


@dataclass(frozen=True)
class Query:
    """Alternatives, each of terms that must and terms that must not occur. No alternative: nothing matches."""

    alternatives: tuple[tuple[tuple[Term, ...], tuple[Term, ...]], ...]

    @staticmethod
    def lexemes_of(alternative: tuple[tuple[Term, ...], tuple[Term, ...]]) -> list[str]:
        """The lexemes that an alternative needs."""
        return sorted({x for t in alternative[0] for x in t.lexemes})

    def lexemes(self, unwanted: bool = False) -> list[str]:
        """Those that some alternative needs, and with `unwanted` those that must not occur."""
        return sorted({x for a in self.alternatives for ts in (a if unwanted else a[:1]) for t in ts for x in t.lexemes})


def parse(question: str, stemming: bool = True) -> Query:
    """A query as people type it: words together, "phrases", or, and a - before what isn't wanted. Nothing is an error."""
    out, must, never = [], [], []
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', question):
        if word.lower() == "or" and not sign and (must or never):
            out.append((tuple(must), tuple(never)))
            must, never = [], []
            continue
        found = [(i, stem(w) if stemming else w) for i, w in enumerate(re.findall(r"[^\W_]+", (phrase or word).lower())) if w not in STOP]
        if found:
            (never if sign else must).append(Term(tuple(w for _, w in found), tuple(i - found[0][0] for i, _ in found)))
    out.append((tuple(must), tuple(never)))
    return Query(tuple(a for a in out if a[0] or a[1]))


@lru_cache(maxsize=10_000)
def parsed(question: str | None, stemming: bool) -> Query:
    return parse(question or "", stemming)


def _hits(found: DataFrame, id_col: str, term: Term) -> DataFrame:
    """id_col and the positions where a phrase begins."""
    first = found.where(F.col("lexeme") == term.lexemes[0]).select(id_col, "pos")
    for lexeme, distance in zip(term.lexemes[1:], term.distances[1:]):
        other = found.where(F.col("lexeme") == lexeme).select(id_col, (F.col("pos") - distance).alias("pos"))
        first = first.join(other, [id_col, "pos"], "left_semi")
    return first


def _covers(found: DataFrame, id_col: str, lexemes: list[str]) -> DataFrame:
    """id_col, begin and end (position and number) of the stretches that hold all lexemes and begin with one of them.

    Going through a document's postings in order, the stretch that ends at one begins at the least of the last places of all
    lexemes. Of the ends of a beginning the first counts.
    """
    order = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("pos", "nth")
    last = [F.last(F.when(F.col("lexeme") == x, place), ignorenulls=True).over(order) for x in lexemes]
    rows = found.where(F.col("lexeme").isin(lexemes)).select(id_col, place.alias("end"), F.array(*last).alias("last"))
    rows = rows.where(F.forall("last", lambda x: x.isNotNull())).select(id_col, "end", F.array_min("last").alias("begin"))
    return rows.groupBy(id_col, "begin").agg(F.min("end").alias("end"))


def keyword_rank(index: DataFrame, id_col: str, query: Query) -> DataFrame:
    """id_col and rank of the documents that a query matches; all others have the rank 0 and no row.

    A document's rank is the sum over its covers, the stretches that satisfy the query and hold no shorter one: WEIGHT each,
    divided by 1 + the number of words in it that the query doesn't name. index: postings. Only the postings of the query's
    lexemes are looked at, a filter that reaches the scan of a written index.
    """
    wanted = query.lexemes()
    if not wanted:
        return index.select(id_col, F.lit(0.0).alias("rank")).limit(0)
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    found = index.where(F.col("lexeme").isin(wanted)).select(id_col, "lexeme", "pos", nth.alias("nth"))
    covers = None
    for must, never in query.alternatives:
        if not must:
            continue
        some = _covers(found, id_col, sorted({x for t in must for x in t.lexemes}))
        for term in must:
            if len(term.lexemes) > 1:
                some = some.join(_hits(found, id_col, term), id_col, "left_semi")
        for term in never:
            some = some.join(_hits(index.where(F.col("lexeme").isin(list(term.lexemes))), id_col, term), id_col, "left_anti")
        covers = some if covers is None else covers.unionByName(some)
    if len(query.alternatives) > 1:
        covers = covers.groupBy(id_col, "begin").agg(F.min("end").alias("end"))
        after = Window.partitionBy(id_col).orderBy("begin").rowsBetween(1, Window.unboundedFollowing)
        covers = covers.withColumn("inner", F.min("end").over(after)).where(F.col("inner").isNull() | (F.col("inner") > F.col("end")))
    noise = (F.col("end.pos") - F.col("begin.pos")) - (F.col("end.nth") - F.col("begin.nth"))
    return covers.groupBy(id_col).agg(F.sum(F.lit(WEIGHT) / (1 + noise)).alias("rank"))


def cover_ranks(found: list[tuple[int, str]], query: Query) -> float:
    """The rank of one document: found has positions and lexemes of its postings that the query names, in order. 0 where it doesn't match."""
    at: dict[str, list[int]] = {}
    for pos, lexeme in found:
        at.setdefault(lexeme, []).append(pos)

    def holds(term: Term) -> bool:
        sets = [{p - d for p in at.get(x, ())} for x, d in zip(term.lexemes, term.distances)]
        return bool(set.intersection(*sets))

    wanted = set(query.lexemes())
    own = [(pos, lexeme) for pos, lexeme in found if lexeme in wanted]
    ends: dict[int, int] = {}  # by the place of a cover's first posting, that of its last
    for must, never in query.alternatives:
        if not must or any(holds(t) for t in never) or not all(holds(t) for t in must if len(t.lexemes) > 1):
            continue
        lexemes, last = {x for t in must for x in t.lexemes}, {}
        for n, (_, lexeme) in enumerate(own):
            if lexeme in lexemes:
                last[lexeme] = n
                if len(last) == len(lexemes):
                    begin = min(last.values())
                    ends[begin] = min(n, ends.get(begin, n))
    total, least = 0.0, len(own)
    for begin in sorted(ends, reverse=True):
        end = ends[begin]
        if len(query.alternatives) == 1 or end < least:
            total += WEIGHT / (1 + (own[end][0] - own[begin][0]) - (end - begin))
        least = min(least, end)
    return total


def keyword_rank_batch(index: DataFrame, id_col: str, questions: DataFrame, stemming: bool = True, query_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """query_col, id_col, rank of all documents that match, for many questions (query_col, text_col) in one pass over the index.

    Questions are parsed in tasks. Their lexemes, one row for each, meet the postings; what a question finds in a document is
    brought together, never more than the document has words, and ranked there as keyword_rank() would. Questions up to ASKED_BYTES, a
    size that is looked up first, are sent to all tasks, so that only the postings that they name are shuffled.
    """
    own, known = dict(questions.dtypes)[query_col], dict(index.dtypes)[id_col]
    size = questions.agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit(""))) + 64)).first()[0] or 0
    sent = F.broadcast if size <= ASKED_BYTES else lambda df: df

    def lexemes(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            rows = [(q, x) for q, text in zip(frame["q"], frame["text"]) for x in parsed(text, stemming).lexemes(True)]
            yield pd.DataFrame(rows, columns=["q", "lexeme"])

    def ranks(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            found = [cover_ranks([(x["pos"], x["lexeme"]) for x in rows], parsed(text, stemming)) for text, rows in zip(frame["text"], frame["found"])]
            yield pd.DataFrame({"q": frame["q"], "id": frame["id"], "rank": found})

    asked = questions.select(F.col(query_col).alias("q"), F.col(text_col).alias("text"))
    wanted = asked.mapInPandas(lexemes, f"q {own}, lexeme string")
    rows = index.select(F.col(id_col).alias("id"), "lexeme", "pos").join(sent(wanted), "lexeme").groupBy("q", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "lexeme"))).alias("found"))
    found = rows.join(sent(asked), "q").select("q", "id", "text", "found").mapInPandas(ranks, f"q {own}, id {known}, rank double").where("rank > 0")
    return found.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "rank")
