"""Language ID: unigram pieces over a fixed public vocabulary; a forward algorithm sums all segmentations of a word.

Each language has a probability for each piece, learnt by expectation maximisation from word counts. A text's score for a language
is the product of its words' probabilities, a word's probability the sum over all ways to cut it into pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import spread
from .shared import column, map_arrow, workspace, written

#: Runs of letters and of characters that are neither digits nor letters but count as numbers, such as fractions.
RUNS = re.compile(r"[^\W\d_]+")
#: From here on characters may be marks, such as the vowel signs of many scripts; a word is a letter with all letters and marks behind it.
MARKS = re.compile("[\u0300-\U0010ffff]")
MARKED, PIECE = regex.compile(r"\p{L}[\p{L}\p{M}]*"), regex.compile(r"[\p{L}\p{M}]+")
#: Mark of a word's start in the vocabulary.
START = "▁"
#: Longest piece, and words from this length on are summed by logarithms: a shorter one's probability stays in a double's range.
LONGEST, LONG = 16, 32
#: Words that are summed together, and characters of long ones.
TOGETHER, CHARACTERS = 4000, 100_000
#: Probability of a character that no piece has, in all languages alike.
UNKNOWN = 1e-7
#: Words that a task remembers at most.
CACHE = 300_000


_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict[str, int]):
    """Numbers of pieces, and tables to find all pieces in a row of characters at once.

    tables: for each length the sorted hashes of its pieces, with their numbers and characters. A hash is extended by a character
    at a time; what it finds is compared character by character.
    """

    def __init__(self, found: dict[str, int]):
        super().__init__(found)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, LONGEST + 1):
            own = [p for p in self if len(p) == n]
            if own:
                codes = codepoints("".join(own)).reshape(-1, n)
                keys = np.zeros(len(own), np.uint64)
                for k in range(n):
                    keys = extended(keys, codes[:, k])
                by = np.argsort(keys)
                self.tables[n] = keys[by], np.array([self[p] for p in own], np.int64)[by], codes[by]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def extended(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    x = keys * _BASE + codes.astype(np.uint64) + np.uint64(1)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def pieces(path: str) -> Vocabulary:
    """Pieces of letters in a sentencepiece model, with numbers from 1; 0 stands for an unknown character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [p for i in range(model.get_piece_size()) if PIECE.fullmatch((p := model.id_to_piece(i)).lstrip(START) or "x") and len(p) <= LONGEST]
    return Vocabulary({p: i + 1 for i, p in enumerate(dict.fromkeys(p for p in found if p.lower() == p))})


def words_of(text: str) -> list[str]:
    """Runs of letters and of marks that follow them, lower-cased."""
    lower = text.lower()
    if MARKS.search(lower):
        return MARKED.findall(lower)
    found = RUNS.findall(lower)
    if found and not "".join(found).isalpha():
        return "".join([c if c.isalpha() else " " for run in found for c in (*run, " ")]).split()
    return found


def parted(words: list[str]) -> Iterator[slice]:
    """Slices of words, sorted by length, that are summed together: either all shorter than LONG, or of bounded size, or one word."""
    at = 0
    while at < len(words):
        to = at + 1
        while to < len(words) and (to - at < TOGETHER if len(words[to]) < LONG else len(words[at]) >= LONG and (to - at + 1) * len(words[to]) <= CHARACTERS):
            to += 1
        yield slice(at, to)
        at = to


class Lattice:
    """All cuts of a list of words: an edge for each piece that lies in a word. If any is of LONG characters or more, all sums are
    kept as logarithms, else as they are."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        self.n, self.sizes = len(words), np.array([len(w) + 1 for w in words], np.int64)
        self.long = int(self.sizes.max(initial=0)) > LONG
        chars = codepoints(START + START.join(words)) if words else np.zeros(0, np.uint32)
        word = np.repeat(np.arange(self.n), self.sizes)
        ends = np.cumsum(self.sizes)
        begins = (ends - self.sizes)[word]
        found: list[tuple[np.ndarray, np.ndarray, int]] = []  # first characters, pieces, length
        at, keys = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for n in range(1, LONGEST + 1):
            fits = at + n <= ends[word[at]]
            at, keys = at[fits], keys[fits]
            if not len(at):
                break
            keys = extended(keys, chars[at + n - 1])
            piece = np.zeros(len(at), np.int64)
            if n in vocabulary.tables:
                known, numbers, codes = vocabulary.tables[n]
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = np.flatnonzero(known[place] == keys)
                hit = hit[(chars[at[hit, None] + np.arange(n)] == codes[place[hit]]).all(axis=1)]
                piece[hit] = numbers[place[hit]]
            some = slice(None) if n == 1 else np.flatnonzero(piece)
            found.append((at[some], piece[some], n))
        first = np.concatenate([f[0] for f in found] or [at])
        self.of, self.start = word[first], first - begins[first]
        self.end = self.start + np.repeat([f[2] for f in found], [len(f[0]) for f in found]).astype(np.int64)
        self.piece = np.concatenate([f[1] for f in found] or [at])

    def _sweep(self, p: np.ndarray, at: np.ndarray, to: np.ndarray, first: np.ndarray, order: range) -> np.ndarray:
        """[word, position, language]: from 1 at the positions `first`, the sum over the ways to each position."""
        state = np.full((self.n, int(self.sizes.max(initial=0)) + 1, p.shape[1]), -np.inf if self.long else 0.0)
        state[np.arange(self.n), first] = 0 if self.long else 1
        by = np.lexsort((self.of, to))
        bounds = np.searchsorted(to[by], np.arange(state.shape[1] + 1))
        for x in order:
            mine = by[bounds[x] : bounds[x + 1]]
            if len(mine):
                of = self.of[mine]
                cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                before, piece = state[of, at[mine]], p[self.piece[mine]]
                if self.long:
                    state[of[cuts], x] = np.logaddexp.reduceat(before + piece, cuts, axis=0)
                else:
                    state[of[cuts], x] = np.add.reduceat(before * piece, cuts, axis=0)
        return state

    def forward(self, p: np.ndarray) -> np.ndarray:
        """The sum over the cuts of what precedes a position. p: [piece, language]; logarithms where the lattice is long."""
        return self._sweep(p, self.start, self.end, np.zeros(self.n, np.int64), range(1, int(self.sizes.max(initial=0)) + 1))

    def backward(self, p: np.ndarray) -> np.ndarray:
        return self._sweep(p, self.end, self.start, self.sizes, range(int(self.sizes.max(initial=0)) - 1, -1, -1))

    def log_probabilities(self, p: np.ndarray) -> np.ndarray:
        """[word, language]"""
        whole = self.forward(np.log(p) if self.long else p)[np.arange(self.n), self.sizes]
        return whole if self.long else np.log(whole)

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, for one language, where word i stands counts[i] times."""
        p = p.reshape(-1, 1)
        q = np.log(p) if self.long else p
        before, after = self.forward(q)[..., 0], self.backward(q)[..., 0]
        whole = before[np.arange(self.n), self.sizes]
        if self.long:
            share = np.exp(before[self.of, self.start] + q[self.piece, 0] + after[self.of, self.end] - whole[self.of])
        else:
            share = before[self.of, self.start] * q[self.piece, 0] * after[self.of, self.end] / whole[self.of]
        return np.bincount(self.piece, share * counts[self.of], len(p))


class Model:
    """languages, and p: [piece, language]."""

    def __init__(self, path: str, languages: list[str], p: np.ndarray):
        self.path, self.languages, self.p, self.cache = path, languages, p, {}

    def learn(self, words: Iterable[str]) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()
        vocabulary, cache = pieces(self.path), self.cache
        new = sorted({w for w in words if w not in cache}, key=len)
        for some in parted(new):
            cache.update(zip(new[some], Lattice(new[some], vocabulary).log_probabilities(self.p)))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and its posterior among all, given equal priors; the first by name where two are equal. Texts without a letter: und, 0."""
        split = [words_of(t) for t in texts]
        self.learn(w for words in split for w in words)
        out = []
        for words in split:
            if not words or not self.languages:
                out.append(("und", 0.0))
                continue
            log = np.sum([self.cache[w] for w in words], axis=0)
            best = int(log.argmax())
            out.append((self.languages[best], float(1 / np.exp(log - log[best]).sum())))
        return out


def count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            counts.update((lang, w) for w in words_of(text.as_py() or ""))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "word", "n"])


def expect(path: str, languages: list[str], p: np.ndarray):
    """Expected uses of the pieces in (lang, word, n): [language * pieces], one row of lang number, piece, use for each that has any."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = pieces(path), np.zeros_like(p)
        for batch in source:
            by: dict[str, list[tuple[str, int]]] = {}
            for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n"))):
                by.setdefault(lang, []).append((word, n))
            for lang, found in by.items():
                found.sort(key=lambda x: len(x[0]))
                words, counts, k = [x[0] for x in found], np.array([x[1] for x in found], float), languages.index(lang)
                for some in parted(words):
                    total[:, k] += Lattice(words[some], vocabulary).expected(p[:, k], counts[some])
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[piece, k], pa.float64())], ["k", "piece", "n"])

    return run


def train(labelled: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000, rounds: int = 3, prior: float = 0.05) -> Model:
    """A model from rows with a language; without any, one that knows no language.

    Words of any length count. Null and empty texts add nothing, rows without a language aren't read further. A row that comes
    twice counts twice; ids may be null, such rows are picked or left together. Other columns aren't read, whatever their names.
    sample_rows: rows of a language to learn from, about; a hash of the id picks them, their texts are read whole. The word
    counts stay distributed; only the expected uses of the pieces, at most one number for each piece and language, come to the
    driver in each of `rounds` rounds. prior: uses of each piece that are added to those expected.
    """
    spark = labelled.sparkSession
    rows = labelled.where(column(lang_col).isNotNull()).select(column(id_col).cast("string").alias("id"), column(lang_col).cast("string").alias("lang"), column(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, vocabulary = sorted(sizes), pieces(path)
    p = np.full((len(vocabulary) + 1, len(languages)), 1 / max(1, len(vocabulary)))
    p[0] = UNKNOWN
    if not languages:
        return Model(path, languages, p)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / sizes[lang]))])[F.col("lang")]
    sample = rows.where(draw < rate).select("lang", "text")
    counts = map_arrow(spread(sample), count_words, "lang string, word string, n long")
    counts = written(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), workspace(spark, "words"))
    for _ in range(rounds):
        uses = counts.mapInArrow(expect(path, languages, p), "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        new = np.full_like(p, prior)
        new[uses["piece"], uses["k"]] += uses["n"]
        new[0] = 0
        p = new / new.sum(axis=0)
        p[0] = UNKNOWN
    return Model(path, languages, p)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row of docs. Only these two columns are read, and only the text has a say.

    A text that is null or has no letter (a character that Unicode calls one) gives `und` and the score 0, and so does each text
    where nothing could be learnt. Rows with equal texts get the same language, rows that come twice stay two; ids may be null. An
    empty table gives no rows. A single run of letters is held whole, with 8 bytes for each letter and language. The model, of a
    size that vocabulary and languages bound, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.path, model.languages, model.p))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in source:
            found: list[tuple[str, float]] = []
            texts = [t.as_py() or "" for t in batch["text"]]
            for i in range(0, len(texts), 256):
                found += own.predict(texts[i : i + 256])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_arrow(spread(rows), run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learnt from: crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit(""))) % 5 == 0
