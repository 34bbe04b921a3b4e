"""Phrase collocations by Toivonen's sampling: a sample proposes frequent phrases, one full pass counts them and their negative border
exactly, and phrases of the border that turn out frequent are extended in further passes until none is left.

A phrase is counted if both phrases that are one word shorter are proposed: that is the proposed phrases and the border around them.
Proposals are bitmaps over hashes, of a size that doesn't grow beyond a bound. Whatever a bitmap says yes to is counted at all its
occurrences, so false positives cost counting and change nothing: which phrases are frequent is told by exact counts only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .shared import column, map_arrow, workspace, written

#: Words that are counted together in a task; a text of more is a part of its own.
PART = 1_000_000
#: A proposal bitmap has 2**most bits at most, which is 8 MB for each length of phrase.
MOST_BITS = 26
#: Rows of a list are gathered in so many parts before they meet.
PARTS = 32


def _clean() -> bytes:
    """Bytes of a text to bytes of words: A-Z lower-cased, what ends a piece as a full stop, tab as space."""
    out = bytearray(range(256))
    for b in b".,;:!?\n\x0b\x0c\r":
        out[b] = ord(".")
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    out[9] = 32
    return bytes(out)


CLEAN = _clean()


def tokens(text: str) -> list[bytes]:
    """The words of a text, with a full stop, which no word holds, wherever a piece ends."""
    return text.encode().translate(CLEAN).replace(b".", b" . ").split()


def word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


def longer(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but the last word and of the last word."""
    with np.errstate(over="ignore"):
        h = (first ^ (word * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Proposals:
    """A bitmap for each length of phrase that may be extended; without bitmaps everything may."""

    def __init__(self, maps: dict[int, np.ndarray] | None = None):
        self.maps = maps

    def has(self, k: int, hashes: np.ndarray) -> np.ndarray:
        if self.maps is None:
            return np.ones(len(hashes), bool)
        bits = self.maps[k]
        at = hashes & np.uint64(8 * len(bits) - 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def count_part(ids: np.ndarray, words: list[bytes], lang_of: np.ndarray, langs: list[str], hashes: np.ndarray, passes: list[Proposals], longest: int) -> Iterator[pa.RecordBatch]:
    """The counts of the phrases that the last of the passes counts and no earlier one has. ids: words in their order, 0 between pieces.
    A phrase is named by its language, a tab and its words."""
    spelled, own_lang = pa.array(words, pa.binary()).cast(pa.string()), pa.array([f"{x}\t" for x in langs], pa.string())

    def rows(parts: list[np.ndarray], f: np.ndarray, extended: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(f), 1 << 16):
            some = [p[at : at + (1 << 16)] for p in parts]
            phrase = [spelled.take(pa.array(p)) for p in some]
            phrase = pc.binary_join_element_wise(*phrase, " ") if len(phrase) > 1 else phrase[0]
            name = pc.binary_join_element_wise(own_lang.take(pa.array(lang_of[some[0]])), phrase, "")
            yield pa.RecordBatch.from_arrays([name, pa.array(extended[at : at + (1 << 16)]), pa.array(f[at : at + (1 << 16)])], ["name", "extended", "f"])

    there, own = ids > 0, hashes[ids]
    if len(passes) == 1:
        of = np.bincount(ids, minlength=len(words))[1:]
        n = np.bincount(lang_of[1:], weights=of, minlength=len(langs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([own_lang, pa.array(np.ones(len(langs), bool)), pa.array(n)], ["name", "extended", "f"])
        yield from rows([np.arange(1, len(words))], of.astype(np.int64), passes[0].has(1, hashes[1:]))
    # open_[j][i]: pass j extends the phrase of k words that starts at i.
    h, open_ = own, [there & p.has(1, hashes)[ids] for p in passes]
    for k in range(2, longest + 1):
        if len(h) < 2:
            return
        done = np.zeros(len(h) - 1, bool)
        h = longer(h[:-1], own[k - 1 :])
        for j, p in enumerate(passes):
            new = open_[j][:-1] & open_[j][1:] & ~done
            done |= new
            # Later passes extend at once what they count for the first time, so they leave no border.
            open_[j] = (p.has(k, h) & there[: len(h)] & there[k - 1 :]) | (new & (j > 0)) if k < longest else new
        at = np.flatnonzero(new)
        if len(at):
            key = ids[at] << 32 | ids[at + 1]
            for i in range(2, k):
                key = np.searchsorted(np.unique(key), key) << 32 | ids[at + i]
            _, first, f = np.unique(key, return_index=True, return_counts=True)
            first = at[first]
            yield from rows([ids[first + i] for i in range(k)], f.astype(np.int64), np.ones(len(first), bool) if k == longest else open_[-1][first])


def counter(sent, longest: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [Proposals(m) for m in sent.value]

        def part(known: dict[str, dict[bytes, int]], runs: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
            words, lang_of, hashes, langs = [b""] * n, np.zeros(n, np.int64), np.zeros(n, np.uint64), list(known)
            for k, lang in enumerate(langs):
                for word, at in known[lang].items():
                    if at:
                        words[at], lang_of[at], hashes[at] = word, k, word_hash(word, lang)
            yield from count_part(np.concatenate(runs), words, lang_of, langs, hashes, passes, longest)

        known, runs, size, number = {}, [], 0, numbers(1)
        for batch in source:
            for text, lang in zip(batch["text"], batch["lang"]):
                if (name := lang.as_py()) not in known:
                    known[name] = defaultdict(number.__next__, {b".": 0})
                found = tokens(text.as_py())
                found.append(b".")
                runs.append(np.fromiter(map(known[name].__getitem__, found), np.int64, len(found)))
                size += len(found)
                if size >= PART:
                    yield from part(known, runs, next(number))
                    known, runs, size, number = {}, [], 0, numbers(1)
        if runs:
            yield from part(known, runs, next(number))

    return run


def counts(rows: DataFrame, passes: list[dict[int, np.ndarray] | None], longest: int, least: int) -> DataFrame:
    """lang, phrase, k, extended, f: phrases of k words found `least` times or more; k is 0 where f counts all words of a language.
    extended: the pass has counted the phrases around this one too. Tasks have added up what they met, so rows are dealt as they are."""
    sent = rows.sparkSession.sparkContext.broadcast(passes)
    found = map_arrow(rows, counter(sent, longest), "name string, extended boolean, f long").repartition("name")
    phrase = F.substring_index("name", "\t", -1)
    total = found.groupBy("name").agg(F.sum("f").alias("f"), F.max("extended").alias("extended")).where((F.col("f") >= least) | F.endswith("name", F.lit("\t")))
    k = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    return total.select(F.expr("left(name, length(name) - length(substring_index(name, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), k.cast("int").alias("k"), "extended", "f")


def positions(size: int):
    """lang, phrase and k to the bit of each phrase in a bitmap of `size` bits, from 1."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist()):
                first, *more = [np.array([word_hash(w, lang)], np.uint64) for w in phrase.encode().split(b" ")]
                for word in more:
                    first = longer(first, word)
                at.append(int(first[0]) & (size - 1))
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(at, pa.int64())], ["k", "at"])

    return run


def propose(frequent: DataFrame, longest: int, most_bits: int = MOST_BITS) -> dict[int, np.ndarray]:
    """Bitmaps of the phrases shorter than `longest`, some 64 bits a phrase but 2**most_bits in all at most: `longest` - 1 of them come to the driver."""
    some = frequent.where((F.col("k") > 0) & (F.col("k") < longest)).select("lang", "phrase", "k")
    bits = min(most_bits, max(15, (64 * max(1, some.count())).bit_length()))
    bit = map_arrow(some, positions(1 << bits), "k int, at long").select("k", (F.col("at") + 1).alias("at"))
    maps = {k: np.zeros(1 << bits - 3, np.uint8) for k in range(1, longest)}
    for r in bit.groupBy("k", F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        at = (r["page"] - 1) * 4096
        maps[r["k"]][at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return maps


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, share: float = 0.05, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, phrase, k, f: all phrases of 1 to `longest` words found `least` times or more in a language, and k = 0 for all its words.

    share: of the texts, picked by their hash, that propose; of a phrase that has `least` occurrences they must hold about half as many
    as expected, and two at least. The sample decides how much the first full pass counts and whether there is a second, never the result.
    """
    spark, at = docs.sparkSession, workspace(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"))
    sample = spread(rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))))
    rows, few = spread(rows), max(2, round(0.5 * share * least))
    # The sample is mined a length at a time, each from the one before.
    proposed = written(counts(sample, [None], 1, few), f"{at}/sample-1")
    for k in range(2, longest):
        proposed = written(counts(sample, [propose(proposed, k, most_bits)], k, few), f"{at}/sample-{k}")
    passes, found = [propose(proposed, longest, most_bits)], []
    while True:
        found.append(written(counts(rows, passes, longest, least), f"{at}/{len(found)}"))
        border = found[-1].where(~F.col("extended") & (F.col("k") < longest))
        if border.isEmpty():
            break
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        passes.append(propose(whole, longest, most_bits))
    return spark.read.schema(found[0].schema).parquet(*[f"{at}/{i}" for i in range(len(found))]).select("lang", "phrase", "k", "f")


def _words(phrase: Column, first: Column, n: Column) -> Column:
    return F.concat_ws(" ", F.slice(phrase, first, n))


def score(mined: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of the phrases of two words and more of mine(): the cut with the lowest score, of equal ones the first."""
    single = mined.where("k > 0").select("lang", "phrase", "f")
    cut = mined.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    words = F.split("phrase", " ")
    cut = cut.withColumn("first", _words(words, F.lit(1), F.col("cut"))).withColumn("rest", _words(words, F.col("cut") + 1, F.col("k") - F.col("cut")))
    left = single.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = single.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    big = [F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")]
    parts = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).select("lang", "phrase", "k", "a", "cut", "l", "r", *[b.alias(n) for b, n in zip(big, ("da", "dl", "dr"))])
    parts = parts.withColumn("score", F.expr("(1000000 * (da * da)) div (dl * dr)"))
    best = parts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, within: int = 50, top: int = 2000, share: float = 0.05, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    Texts are lower-cased in A-Z, cut at `.,;:!?` and line ends, and split at spaces and tabs. A phrase of 2 to `longest` words with a
    occurrences, a >= `least`, is cut in two where 1000000 * a * a / (l * r), rounded down, is lowest; l and r count both parts. A phrase
    inside a longer one that has `within` percent of its occurrences or more is dropped. Equal scores are ranked by a, then by phrase.

    A null text is empty, a null language is `und`; rows that come twice count twice; an empty table gives no rows. Other columns
    aren't read. A text is held whole by one task, with its words. Lists of a language are gathered in parts, so no task meets more than
    `top` rows of each of 32 parts at the end, whatever a language holds.
    """
    mined = mine(docs, text_col, lang_col, least, longest, share, most_bits)
    scored = written(score(mined), workspace(docs.sparkSession, "scores"))
    size = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")
    sub = scored.where("k > 2").select("lang", "k", "a", F.split("phrase", " ").alias("words"), size)
    sub = sub.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    around = sub.groupBy("lang", _words(F.col("words"), F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    n = mined.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = kept.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
