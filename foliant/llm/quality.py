"""Quality rules: word and line counts, and compression bands over whole documents and fixed chunks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..session import spread
from .shared import SPACE, column, map_arrow, workspace, written

WORD = re.compile(f"[^{SPACE}]+")
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
LEVEL, CHUNK = 3, 4096
#: Lengths in bytes up to which a band goes; the last has no end.
UP_TO = (256, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 16384, 65536)
#: How fit() sets limits: quantiles of the good documents, moved outwards by so many standard deviations of the logarithm of the ratio, by
#: LOWER or UPPER of it at least. Prose of one kind lies within 0.1 of it, while tables, code, lists and laws go beyond it on the upper
#: side by far more than by what any one corpus shows; base64 and random bytes are 0.4 and more below.
SHARE, DEVIATIONS, LOWER, UPPER, FEWEST = 0.005, 4.0, 0.20, 0.45, 50
#: A document with an id that this divides is held out when limits are fitted.
HELD_OUT = 5


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio of UTF-8 bytes to zstandard bytes.

    low, high: what a whole document of each length may have, by UP_TO; chunk_low, chunk_high: what each chunk of CHUNK bytes of a longer
    one may have. The last chunk is the end of the text, and overlaps the one before, so every byte is in a chunk of that
    length. many: the same for scripts whose letters take several bytes each, which any compression shortens by about that.
    """

    low: tuple[float, ...]
    high: tuple[float, ...]
    chunk_low: float
    chunk_high: float
    many: Bands | None = None

    def keeps(self, n_bytes: int, ratio: float, least: float, largest: float) -> bool:
        """What kept() says, for one document."""
        i = bisect_left(UP_TO, n_bytes)
        return self.low[i] <= ratio <= self.high[i] and (n_bytes <= CHUNK or self.chunk_low <= least and largest <= self.chunk_high)

    def kept(self) -> Column:
        """Whether a measured document and all its chunks lie within."""
        def within(b: Bands) -> Column:
            low, high = (F.when(F.lit(False), 0.0) for _ in range(2))
            for limit, x, y in zip(UP_TO, b.low, b.high):
                low, high = low.when(F.col("n_bytes") <= limit, F.lit(x)), high.when(F.col("n_bytes") <= limit, F.lit(y))
            whole = F.col("ratio").between(low.otherwise(b.low[-1]), high.otherwise(b.high[-1]))
            return whole & ((F.col("n_bytes") <= CHUNK) | (F.col("least_chunk_ratio") >= b.chunk_low) & (F.col("largest_chunk_ratio") <= b.chunk_high))

        return F.when(F.col("many_bytes"), within(self.many)).otherwise(within(self)) if self.many else within(self)


#: Hand-set limits for text of a kind that nothing is known of: base64 and random bytes stay below 1.35 at any length, a passage that
#: is repeated soon exceeds 4. They reject nothing that is near to prose.
_LOW, _HIGH = (1.05, 1.05, 1.2, 1.2, 1.38, 1.38, 1.38, 1.38, 1.42, 1.42, 1.42, 1.42, 1.42), (2.4, 2.4, 2.7, 2.7, 3.2, 3.2, 3.2, 3.2, 3.6, 3.6, 3.6, 4.2, 4.8)
WIDE = Bands(_LOW, _HIGH, 1.38, 3.2, Bands(_LOW, tuple(2 * x for x in _HIGH), 1.38, 6.4))


def chunks(raw: bytes) -> list[bytes]:
    starts = [*range(0, len(raw) - CHUNK, CHUNK), max(0, len(raw) - CHUNK)]
    return [raw[at : at + CHUNK] for at in starts]


def compressed(raw: bytes, packed: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Ratio of the whole, and least and largest ratio of a chunk."""
    whole = len(raw) / len(packed.compress(raw)) if raw else 0.0
    if len(raw) <= CHUNK:
        return whole, whole, whole
    ratios = [len(part) / len(packed.compress(part)) for part in chunks(raw)]
    return whole, min(ratios), max(ratios)


def repeated(words: list[str]) -> int:
    """Number of words that lie in a 3-word window found twice or more."""
    first: dict[tuple[str, str, str], int] = {}
    marked = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            marked[j : j + 3] = marked[i : i + 3] = b"\1\1\1"
    return sum(marked)


def duplicate_lines(text: str) -> int:
    """Number of lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts and ratios of a text; other columns go through."""
    packed = zstandard.ZstdCompressor(level=LEVEL)
    for batch in source:
        rows = []
        for value in batch["text"]:
            text = value.as_py() or ""
            words, raw = WORD.findall(text), text.encode()
            again = repeated(words)
            failed = len(words) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(words)
            rows.append((len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), again, len(raw), failed, 2 * len(raw) > 3 * len(text), *compressed(raw, packed)))
        columns = list(zip(*rows)) or [()] * len(MEASURED)
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*rest, *(f.name for f in MEASURED)])


MEASURED = [
    *(StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")),
    *(StructField(n, BooleanType()) for n in ("base_failed", "many_bytes")),
    *(StructField(n, DoubleType()) for n in ("ratio", "least_chunk_ratio", "largest_chunk_ratio")),
]


def measured(rows: DataFrame) -> DataFrame:
    """rows (text and others) with the counts and ratios in place of the text."""
    rest = [f for f in rows.schema if f.name != "text"]
    return map_arrow(spread(rows), measure, StructType([*rest, *MEASURED]))


def held_out() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0


def fit(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> tuple[Bands, dict[str, dict[str, int]]]:
    """Bands from the measured documents (id and measures) that labels (id_col, label_col) call good, 1, and that pass the base rules; and
    what they do to the labelled documents that were held out: by good and bad, how many there are, how many the base
    rules take, and how many the bands take beyond these.

    Each length, and each of the two kinds of scripts, with FEWEST good documents or more has limits of its own, all others have those of
    WIDE. All labelled documents count, as aggregates by length, whatever their number; only labels and measures are joined, no texts.
    """
    label = labels.select(column(id_col).alias("id"), column(label_col).alias("label")).where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    both = found.join(label, "id")
    size = sum(((F.col("n_bytes") > n).cast("int") for n in UP_TO), F.lit(0))
    good = both.where(~held_out() & (F.col("label") == 1) & ~F.col("base_failed"))
    log = lambda c: F.log(F.greatest(c, F.lit(1e-9)))
    whole = good.select("many_bytes", size.alias("band"), log("ratio").alias("low"), log("ratio").alias("high"))
    part = good.where(F.col("n_bytes") > CHUNK).select("many_bytes", F.lit(-1).alias("band"), log("least_chunk_ratio").alias("low"), log("largest_chunk_ratio").alias("high"))
    cut = lambda c, of, way, least: F.exp(F.percentile_approx(c, of, 10_000) + way * F.greatest(DEVIATIONS * F.stddev_pop(c), F.lit(least)))
    limits = whole.unionByName(part).groupBy("many_bytes", "band").agg(F.count("*").alias("n"), cut("low", SHARE, -1, LOWER).alias("low"), cut("high", 1 - SHARE, 1, UPPER).alias("high"))
    # Two kinds of scripts by thirteen lengths and the chunks at most.
    told = {(r["many_bytes"], r["band"]): (r["low"], r["high"]) for r in limits.where(F.col("n") >= FEWEST).collect()}

    def bands(many: bool, wide: Bands) -> Bands:
        both = [told.get((many, i), x) for i, x in enumerate(zip(wide.low, wide.high))]
        return Bands(*map(tuple, zip(*both)), *told.get((many, -1), (wide.chunk_low, wide.chunk_high)), None if many else bands(True, wide.many))

    fitted = bands(False, WIDE)
    taken = F.count_if(~F.col("base_failed") & ~fitted.kept())
    rows = both.where(held_out()).groupBy("label").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("base_failed"), taken.alias("rejected")).collect()
    return fitted, {("bad", "good")[r["label"]]: {k: r[k] for k in ("n", "base_failed", "rejected")} for r in rows}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None, labels: DataFrame | None = None, label_col: str = "quality") -> DataFrame:
    """id_col, the counts, base_failed, kept, the length in bytes and the three ratios for each row of docs.

    kept is false if base_failed (fewer than 50 words, or more than half of them in repeated 3-word windows), else true where the
    document and all its chunks lie within the bands: those given, else those that fit() gets from labels (id_col, label_col), else WIDE. A null text counts as empty: no words, ratio 0, failed. Ids may be null or
    repeated; an empty table gives no rows. Only the two named columns are read, texts once. No shuffle but of labels and measures.
    """
    rows = measured(docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")))
    if bands is None and labels is not None:
        rows = written(rows, workspace(docs.sparkSession, "quality"))
        bands, _ = fit(rows, labels, id_col, label_col)
    kept = ~F.col("base_failed") & (bands or WIDE).kept()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(F.col("id").alias(id_col), *counts, kept.alias("kept"), "n_bytes", "many_bytes", "ratio", "least_chunk_ratio", "largest_chunk_ratio")


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands | None = None, labels: DataFrame | None = None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, whose text quality() keeps with these bands or labels. A row's columns travel with it, whatever
    their names and types; nothing is joined to the texts, which are read twice if there are labels. Null, empty and blank texts
    go; a row that comes twice stays or goes twice. An empty table gives no rows."""
    if bands is None and labels is not None:
        rows = measured(docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")))
        bands, _ = fit(written(rows, workspace(docs.sparkSession, "quality")), labels, id_col, label_col)
    rows = docs.select(column(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    return measured(rows).where(~F.col("base_failed") & (bands or WIDE).kept()).select("row.*")
