"""N-gram Jaccard join: MinHash bands find candidates, Bayes' rule prunes them hash by hash, the rest is verified on the whole sets.

Documents with the same set of shingles are one node with a weight; nodes that share a bucket of a band are candidates. A pair is
looked at in one bucket only, that of the first band in which the two agree, and buckets with the same nodes are one. A large
bucket is cut into blocks, and each two blocks meet in a task of their own. Pairs are counted there and never written: what leaves a
task is, for each node, its number of links and one node that it is connected with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import spread
from .components import components
from .shared import SPACE, column, delete, map_arrow, placed, workspace, written

WORD = re.compile(f"[^{SPACE}]+")
WORDS, THRESHOLD = 5, 0.8
#: At a similarity of 0.8, 32 bands of 4 hashes miss a pair once in 20 million times.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes that are compared before each look at the posterior probability, and the probability below which a pair is dropped. All
#: looks together lose a pair of similarity 0.8 with probability 1.1e-11, far less than the bands.
STEP, TOLERANCE = 16, 1e-12
#: Nodes of a block, and about the bytes of their shingles. Larger buckets are cut, so a task holds two blocks at most.
BLOCK, BLOCK_BYTES = 1024, 64 << 20
#: Nodes of a tile within a block, and columns of the tile's matrix.
TILE, COLUMNS = 256, 8192
CACHE = 500_000

_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _M)
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


class Shingler:
    """Sets of hashes of `n` successive words; a text of fewer words is one shingle, one without words has none."""

    def __init__(self, n: int = WORDS):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode())
        codes = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = min(self.n, len(words))
        total = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            total = _mixed(total * _M + codes[i : len(words) - n + 1 + i])
        return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima, the upper half of their bits."""
    a, b = _functions()
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[i : i + 1024, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each signature: [node, BANDS]"""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for r in range(ROWS):
        key = _mixed(key * _M + parts[:, :, r])
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... hashes: the fewest matches with which a similarity of at least threshold has a posterior probability of
    tolerance or more, where all similarities are equally likely beforehand."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def candidates(a: np.ndarray, b: np.ndarray, band: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the signatures a and b that agree in `band` and in none before it, and that no look at the posterior drops.
    same: a and b are the same rows, each pair is wanted once."""
    i, j = np.nonzero(np.triu(np.ones((len(a), len(b)), bool), 1)) if same else (x.ravel() for x in np.indices((len(a), len(b))))
    for k in range(band + 1):
        at = slice(k * ROWS, (k + 1) * ROWS)
        agree = (a[i, at] == b[j, at]).all(axis=1)
        keep = agree if k == band else ~agree
        i, j = i[keep], j[keep]
    matches = np.zeros(len(i), np.int64)
    for step, least in enumerate(least_matches(threshold)):
        if not len(i):
            break
        at = slice(step * STEP, (step + 1) * STEP)
        matches += (a[i, at] == b[j, at]).sum(axis=1)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j]."""
    if len(i) <= 2 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    sets = [*a, *b]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    rows, column = rows[keep], number[column[keep]]
    by = np.argsort(column, kind="stable")
    rows, column = rows[by], column[by]
    total = np.zeros((len(a), len(b)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, (low, low + COLUMNS))
        dense = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        dense[rows[s:e], column[s:e] - low] = 1
        total += dense[: len(a)] @ dense[len(a) :].T
    return total[i, j].astype(np.int64)


class Group:
    """The nodes of a bucket that meet in one task."""

    def __init__(self, rows: dict[str, list], exact: bool, threshold: float):
        self.nodes = np.array(rows["node"], np.int64)
        self.block, self.band = np.array(rows["block"]), rows["band"][0]
        self.copies = np.array(rows["copies"], np.int64)
        self.exact, self.threshold = exact, threshold
        self.crossed = rows["bi"][0] != rows["bj"][0]
        self.left = rows["bi"][0]
        if exact:
            self.sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            self.sig = np.stack([signature(s) for s in self.sets])
        else:
            self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, HASHES)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the pairs that pass, tile by tile."""
        every = np.arange(len(self.nodes))
        left, right = (every[self.block == self.left], every[self.block != self.left]) if self.crossed else (every, every)
        for p in range(0, len(left), TILE):
            for q in range(0 if self.crossed else p, len(right), TILE):
                x, y = left[p : p + TILE], right[q : q + TILE]
                i, j = candidates(self.sig[x], self.sig[y], self.band, not self.crossed and p == q, self.threshold)
                if len(i) and self.exact:
                    a, b = [self.sets[n] for n in x], [self.sets[n] for n in y]
                    both = shared(a, b, i, j)
                    union = np.array([len(s) for s in a])[i] + np.array([len(s) for s in b])[j] - both
                    keep = both >= self.threshold * union - 1e-9
                    i, j = i[keep], j[keep]
                if len(i):
                    yield x[i], y[j]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with a link, the number of documents that each is linked to, and for each a node that all of its part have in common."""
        links, root = np.zeros(len(self.nodes), np.int64), np.arange(len(self.nodes))
        for i, j in self.pairs():
            np.add.at(links, i, self.copies[j])
            np.add.at(links, j, self.copies[i])
            while len(i):  # the larger root of each pair points to the smaller one, until none differ
                a, b = root[i], root[j]
                low, high = np.minimum(a, b), np.maximum(a, b)
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
        at = np.flatnonzero(links)
        return self.nodes[at], links[at], self.nodes[root[at]]


KEYS = ("bucket", "bi", "bj")


def groups(source: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows with equal KEYS, which come one after the other; a node that comes twice counts once."""
    rest: dict[str, list] = {}
    for batch in source:
        rows = {n: batch[n].to_pylist() for n in batch.schema.names}
        if rest:
            rows = {n: rest[n] + rows[n] for n in rows}
        keys = np.stack([np.array(rows[k], np.int64) for k in KEYS])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for s, e in zip(cuts, cuts[1:]):
            yield _once({n: v[s:e] for n, v in rows.items()})
        rest = {n: v[cuts[-1] :] for n, v in rows.items()}
    if rest:
        yield _once(rest)


def _once(rows: dict[str, list]) -> dict[str, list]:
    first = list({node: i for i, node in reversed(list(enumerate(rows["node"])))}.values())
    return rows if len(first) == len(rows["node"]) else {n: [v[i] for i in sorted(first)] for n, v in rows.items()}


def meet(exact: bool, threshold: float):
    """For each group: the rows of those nodes that have a candidate, or, with the sets at hand, what Group.found() gives."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "links", "root"] if exact else ["bucket", "bi", "bj", "band", "block", "node", "copies"]
        out: list[list] = [[] for _ in names]
        for rows in groups(source):
            if len(rows["node"]) > 1:
                nodes, links, root = Group(rows, exact, threshold).found()
                if exact:
                    for column, x in zip(out, (nodes, links, root)):
                        column += x.tolist()
                elif len(nodes):
                    chosen = set(nodes.tolist())
                    at = [i for i, n in enumerate(rows["node"]) if n in chosen]
                    for column, n in zip(out, names):
                        column += [rows[n][i] for i in at]
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def sketch(words: int):
    """order, row, k1, k2 (the digest of the set; null for a text without words), sig, and size, the number of shingles."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in source:
            k1, k2, sigs, sizes = [], [], [], []
            for value in batch["text"]:
                s = shingler(value.as_py() or "")
                sizes.append(len(s))
                if len(s):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    k1.append(int.from_bytes(digest[:8], "big", signed=True))
                    k2.append(int.from_bytes(digest[8:], "big", signed=True))
                    sigs.append(signature(s).tobytes())
                else:
                    k1.append(None)
                    k2.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch["order"], batch["row"], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], ["order", "row", "k1", "k2", "sig", "size"])

    return run


def bands(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket_key, band, node, size: BANDS rows for each node."""
    for batch in source:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys = band_keys(np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint32).reshape(-1, HASHES))
            node = np.repeat(np.asarray(part["node"]), BANDS)
            band = np.tile(np.arange(BANDS), part.num_rows)
            size = np.repeat(np.asarray(part["size"]), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(band, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64())], ["bucket_key", "band", "node", "size"])


def shingle_sets(words: int):
    """node and shingles of the rows whose set is the node's."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in source:
            nodes, sets = [], []
            for node, k1, value in zip(batch["node"].to_pylist(), batch["k1"].to_pylist(), batch["text"]):
                s = shingler(value.as_py() or "")
                if len(s) and int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "big", signed=True) == k1:
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _meeting(members: DataFrame, run, schema: str) -> DataFrame:
    """Brings together the rows of each KEYS, and runs over them group by group."""
    return map_arrow(members.repartition(*KEYS).sortWithinPartitions(*KEYS), run, schema)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """order, row, class (order and row of the first of the class) and n_links for each row of docs; see jaccard_join()."""
    spark, at = docs.sparkSession, workspace(docs.sparkSession, "jaccard")
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(column(id_col).alias("order"), F.xxhash64(text).alias("row"), text.alias("text"))
    of_sketch = [*rows.schema.fields[:2], *(StructField(n, LongType()) for n in ("k1", "k2")), StructField("sig", BinaryType()), StructField("size", LongType())]
    sketches = written(map_arrow(spread(rows), sketch(words), StructType(of_sketch)), f"{at}/sketches")
    sets = sketches.where(F.col("k1").isNotNull()).groupBy("k1", "k2")
    nodes = sets.agg(F.min(placed("order", "row")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), f"{at}/nodes")

    banded = map_arrow(nodes.select("node", "sig", "size"), bands, "bucket_key long, band long, node long, size long")
    buckets = banded.groupBy("bucket_key", "band").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y")).where("n > 1")
    kept = buckets.groupBy("n", "size", "x", "y").agg(F.min(F.struct("band", "bucket_key")).alias("one"))  # buckets of the same nodes
    n_blocks = F.least("n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") * 8 / BLOCK_BYTES)))
    kept = written(kept.select("one.*", n_blocks.alias("n_blocks"), F.monotonically_increasing_id().alias("bucket")), f"{at}/buckets")

    members = banded.drop("size").join(kept, ["bucket_key", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("other")
    members = members.select("bucket", "band", "node", "block", meets)
    members = members.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "band", "block", "node")
    members = members.join(nodes.select("node", "copies", "sig"), "node")
    members = members.select(*KEYS, "band", "block", "node", "copies", "sig")
    whole = "bucket long, bi long, bj long, band long, block long, node long, copies long"
    near = written(_meeting(members, meet(False, threshold), whole), f"{at}/near")

    wanted = nodes.join(near.select("node").distinct(), "node").select("node", "k1", F.col("first.order").alias("of"), F.col("first.row").alias("which"))
    texts = rows.join(wanted, F.col("order").eqNullSafe(F.col("of")) & (F.col("row") == F.col("which")))
    of = map_arrow(texts.select("node", "k1", "text"), shingle_sets(words), "node long, shingles binary")
    linked = written(_meeting(near.join(of, "node"), meet(True, threshold), "node long, links long, root long"), f"{at}/links")

    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "k1", "k2", "first", "copies").join(links, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    known = written(known, f"{at}/known")
    first = known.groupBy("root").agg(F.min("first").alias("class"))
    known = known.join(first, "root").select("k1", "k2", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = written(known, f"{at}/classes")
    for done in ("nodes", "buckets", "near", "links", "known"):  # nothing that is returned reads them
        delete(spark, f"{at}/{done}")
    out = sketches.select("order", "row", "k1", "k2").join(known, ["k1", "k2"], "left")
    return out.select("order", "row", F.coalesce("class", placed("order", "row")).alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """id_col, class_id, n_links for each row of docs.

    Two rows are linked if the Jaccard similarity of their sets of `words` successive words is at least `threshold`; n_links is the
    number of other rows that a row is linked with, copies included. class_id is the smallest id among the rows that links connect
    with it. A text of fewer words is one shingle; a null, empty or blank text has no links and is a class of its own. Ids may be of
    any type that can be sorted; texts sort by their bytes, so "10" is before "9". Null ids come after all others. An empty table gives no rows. Only the two named columns are read.
    """
    out = classes(docs, id_col, text_col, words, threshold, block)
    return out.select(F.col("order").alias(id_col), F.col("class.order").alias("class_id"), "n_links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that come first in their class by id; of rows with the same id and text, any one. Null ids and
    texts, ids of other types and an empty table are dealt with as in jaccard_join(): each row without words is a class of its own,
    but rows without words that share an id, or have none, stay as one for each text. Other columns may have any name and type."""
    found = classes(docs, id_col, text_col, words, threshold)
    first = F.col("order").eqNullSafe(F.col("class.order")) & (F.col("row") == F.col("class.row"))
    firsts = written(found.where(first).select("order", "row").distinct(), workspace(docs.sparkSession, "firsts"))
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("doc"), column(id_col).alias("of"), F.xxhash64(text).alias("which"))
    both = whole.join(firsts, F.col("of").eqNullSafe(F.col("order")) & (F.col("which") == F.col("row")))
    nth = F.row_number().over(Window.partitionBy("of", "which").orderBy(F.lit(0)))
    return both.withColumn("nth", nth).where("nth = 1").select("doc.*")
