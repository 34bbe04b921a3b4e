"""Ranked lexical search: posting lists cut into blocks of similar documents, each with the coordinatewise maximum of its documents.

Documents are dealt to shards, so a term's list is spread over all of them and none grows with the corpus. In a shard each posting list is
clustered: some of its documents are representatives, each document goes to the one that is most like it. A block's summary is the
coordinatewise maximum of its documents' gains. A query goes through its terms from the weightiest to the lightest. A document of
a later list that also has an earlier term has been scored by then, or lies in a block that was skipped for good; so a summary needs
the coordinates of its own term and lighter ones only, which keeps those of the long lists of common words short and makes bounds
tight. What a query can get from a block is at most the product with its summary, which is exact arithmetic of integers; a block is
skipped only where that is below the query's k-th best score so far. Once all terms that are left can't reach that score together, their lists aren't
looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..session import spread
from .shared import column, hash128, map_arrow, workspace, written

#: Documents of a shard at most, and cells of its table of documents by terms, which bound a task's memory.
SHARD, CELLS = 1024, 4 << 20
#: Shards of a file: a reader of Parquet holds up to 4096 rows of one, whatever their size.
FILE = 8
#: Documents of a block, on average; twice as many at most.
BLOCK = 32
#: Numbers that stand for a document where documents are compared for clustering.
SKETCH = 48
#: Bytes of queries that are searched for in one pass over the documents.
QUERY_BYTES = 256 << 10


def _clean() -> bytes:
    """Bytes of a text to bytes of terms: A-Z lower-cased, what parts terms as space."""
    inside = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
    return bytes((b + 32 if 65 <= b < 91 else b) if b in inside else 32 for b in range(256))


CLEAN = _clean()


def terms(text: str) -> list[bytes]:
    return text.encode().translate(CLEAN).split()


@dataclass
class Index:
    """shards: rows of the index; n_docs and length: documents with a term, and their terms; weights: of the vocabulary's terms."""

    shards: DataFrame
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    n_docs: int
    length: int
    id_type: object


def vectors(sent):
    """id and text to id, n (terms of the text), and the vocabulary's terms in it with how often each occurs."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in source:
            n, found, often = [], [], []
            for value in batch["text"]:
                words = terms(value.as_py() or "")
                n.append(len(words))
                of = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                found.append([t for t, _ in of])
                often.append([c for _, c in of])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], ["id", "n", "terms", "often"])

    return run


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def cluster(likeness: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the documents of a list, block by block, and where each block starts. likeness: a row for each document."""
    n = -(-len(likeness) // block)
    if n < 2:
        return np.arange(len(likeness)), np.zeros(1, np.int64)
    nearest = (likeness @ likeness[np.arange(n) * len(likeness) // n].T).argmax(1)
    order = np.argsort(nearest, kind="stable")
    first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
    within = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order, np.flatnonzero(within % (2 * block) == 0)


def placed(weights: np.ndarray) -> np.ndarray:
    """The place of each term among all, from the weightiest."""
    out = np.empty(len(weights), np.int64)
    out[np.argsort(-weights, kind="stable")] = np.arange(len(weights))
    return out


def shard(ids: pa.Array, starts: np.ndarray, found: np.ndarray, gains: np.ndarray, weights: np.ndarray, block: int) -> list:
    """The columns of one row of the index. Document i has the entries starts[i] to starts[i + 1] of found (its terms) and gains."""
    n, place = len(ids), placed(weights)
    of = np.repeat(np.arange(n), np.diff(starts))
    here, at = np.unique(place[found], return_inverse=True)
    here = np.argsort(place)[here]
    table = np.zeros((n, len(here)), np.int32)
    table[of, at] = gains
    base = np.random.default_rng(1).standard_normal((len(weights), SKETCH), np.float32)
    like = np.zeros((n, SKETCH), np.float32)
    for a in range(0, n, 256):
        like[a : a + 256] = (table[a : a + 256] * weights[here].astype(np.float32)) @ base[here]
    like /= np.maximum(np.linalg.norm(like, axis=1, keepdims=True), 1e-9)
    by_term = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[by_term], np.arange(len(here) + 1))
    block_term, members, sizes, entries, sum_terms, sum_gains = [], [], [], [], [], []
    for t in range(len(here)):
        docs = of[by_term[edges[t] : edges[t + 1]]]
        order, first = cluster(like[docs], block)
        docs = docs[order]
        most = np.maximum.reduceat(table[docs, t:], first, axis=0)
        rows, cols = np.nonzero(most)
        block_term.append(np.full(len(first), here[t]))
        members.append(docs)
        sizes.append(np.diff(first, append=len(docs)))
        entries.append(np.bincount(rows, minlength=len(first)))
        sum_terms.append(here[t + cols])
        sum_gains.append(most[rows, cols])
    joined = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (block_term, members, sizes, entries, sum_terms, sum_gains)]
    return [ids, starts.astype(np.int32), found.astype(np.int32), gains.astype(np.int32), *joined]


COLUMNS = ["starts", "found", "gains", "block_term", "members", "sizes", "entries", "sum_terms", "sum_gains"]


def packed(ids: pa.Array, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row of the index: its ids, the lengths of its columns, and the columns compressed."""
    whole = zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype("<i4").tobytes() for x in columns))
    listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array([len(x) for x in columns], pa.int32()))]
    return pa.RecordBatch.from_arrays([*listed, pa.array([whole], pa.binary())], ["ids", "lengths", "packed"])


def unpacked(row: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    whole = np.frombuffer(zstandard.decompress(row["packed"][i].as_py()), "<i4")
    return dict(zip(COLUMNS, np.split(whole, np.cumsum(row["lengths"][i].as_py())[:-1])))


def sharder(sent, n_docs: int, length: int, block: int, most: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        per = max(1, min(most, CELLS // max(1, len(weights))))

        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = [whole[c].chunk(0) if whole[c].num_chunks == 1 else pa.concat_arrays(whole[c].chunks) for c in ("id", "n", "terms", "often")]
            starts = lists[2].offsets.to_numpy().astype(np.int64)
            found, often = (x.flatten().to_numpy().astype(np.int64) for x in lists[2:])
            m = np.array([25 + 75 * n * n_docs // length for n in lists[1].to_pylist()], np.int64)
            gains = 1_000_000_000 * often // (1000 * often + 8 * np.repeat(m, np.diff(starts)))
            ids, *rest = shard(lists[0], starts - starts[0], found, gains, weights, block)
            return packed(ids, rest)

        held, size = [], 0
        for batch in source:
            while batch.num_rows:
                part = batch.slice(0, per - size)
                held.append(part)
                size, batch = size + part.num_rows, batch.slice(part.num_rows)
                if size == per:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    return run


def build(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK, most: int = SHARD) -> Index:
    """The index of all documents over a vocabulary, at path or else in a workspace. Counts are those of whole texts."""
    spark, at = docs.sparkSession, path or workspace(docs.sparkSession, "ranked")
    sc = spark.sparkContext
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = StructType([rows.schema["id"], StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("often", ArrayType(LongType()))])
    found = written(map_arrow(spread(rows), vectors(sc.broadcast(vocabulary)), schema), f"{at}/vectors")
    n_docs, length = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    # One row a term of the vocabulary, which is bounded.
    df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    kinds = StructType([StructField("ids", ArrayType(id_type)), StructField("lengths", ArrayType(IntegerType())), StructField("packed", BinaryType())])
    # Rows without a term of the vocabulary have no score.
    some = spread(found.where(F.size("terms") > 0), 1 << 20)
    map_arrow(some, sharder(sc.broadcast(weights), n_docs, length or 1, block, most), kinds).write.option("maxRecordsPerFile", FILE).parquet(f"{at}/shards")
    return Index(spark.read.schema(kinds).parquet(f"{at}/shards"), vocabulary, weights, n_docs, length or 0, id_type)


class Best:
    """The k best documents of a query so far; ids without a value come last among equals."""

    def __init__(self, k: int):
        self.k, self.found, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.found += [(-int(s), i is None, 0 if i is None else i) for s, i in zip(scores, ids)]
        self.found.sort()
        del self.found[self.k :]
        if len(self.found) == self.k:
            self.least = max(1, -self.found[-1][0])


class Shard:
    """One row of the index."""

    def __init__(self, row: pa.RecordBatch, i: int, n_terms: int):
        part = unpacked(row, i)
        self.ids = row["ids"].slice(i, 1).flatten()
        self.starts, self.found, self.gains, self.members = part["starts"].astype(np.int64), part["found"], part["gains"], part["members"]
        self.first = np.concatenate([[0], np.cumsum(part["sizes"], dtype=np.int64)])
        self.entries = np.concatenate([[0], np.cumsum(part["entries"], dtype=np.int64)])
        self.sum_terms, self.sum_gains = part["sum_terms"], part["sum_gains"]
        # The blocks of a term lie side by side.
        self.low, self.high = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        edges = np.flatnonzero(np.diff(part["block_term"], prepend=-1, append=-1))
        self.low[part["block_term"][edges[:-1]]], self.high[part["block_term"][edges[:-1]]] = edges[:-1], edges[1:]
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.found, self.gains)

    def search(self, query: np.ndarray, dense: np.ndarray, best: Best) -> tuple[int, int]:
        """Puts the documents of this shard that belong there into best. query: its terms, from the weightiest; dense: its weights by
        term. Returns how many documents were scored, and how many blocks were skipped."""
        left = np.cumsum((dense[query] * self.most[query])[::-1])[::-1]
        seen, scored, skipped = np.zeros(len(self.ids), bool), 0, 0
        for t, rest in zip(query, left):
            if rest < best.least:
                break
            low, high = self.low[t], self.high[t]
            if low == high:
                continue
            e = self.entries[low : high + 1]
            bounds = np.add.reduceat(dense[self.sum_terms[e[0] : e[-1]]] * self.sum_gains[e[0] : e[-1]], e[:-1] - e[0])
            for b in np.argsort(-bounds, kind="stable"):
                if bounds[b] < best.least:
                    skipped += int((bounds < best.least).sum())
                    break
                docs = self.members[self.first[low + b] : self.first[low + b + 1]]
                docs = docs[~seen[docs]]
                if len(docs):
                    seen[docs] = True
                    scored += len(docs)
                    starts, sizes = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
                    at = ranges(starts, sizes)
                    scores = np.add.reduceat(dense[self.found[at]] * self.gains[at], np.cumsum(sizes) - sizes)
                    good = np.flatnonzero(scores >= best.least)
                    if len(good):
                        best.add(scores[good], self.ids.take(pa.array(docs[good])).to_pylist())
        return scored, skipped


def searcher(sent, k: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_terms = sent.value
        best, dense = [Best(k) for _ in queries], np.zeros(n_terms, np.int64)
        kind = None
        for batch in source:
            kind = batch["ids"].type.value_type
            for i in range(batch.num_rows):
                part = Shard(batch, i, n_terms)
                for (_, _, query, weight), found in zip(queries, best):
                    dense[query] = weight
                    part.search(query, dense, found)
                    dense[query] = 0
        rows = [(h1, h2, None if none else i, -s) for (h1, h2, _, _), found in zip(queries, best) for s, none, i in found.found]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind), pa.array(cols[3], pa.int64())], ["h1", "h2", "id", "score"])

    return run


def search(index: Index, queries: list[tuple[int, int, list[bytes]]], k: int = 10) -> DataFrame:
    """h1, h2, id, score: the k best documents of each task's shards for queries (two hashes, and terms with repeats)."""
    ready, place = [], placed(index.weights)
    for h1, h2, words in queries:
        often = sorted(Counter(index.vocabulary[w] for w in words if w in index.vocabulary).items(), key=lambda x: place[x[0]])
        query = np.array([t for t, _ in often], np.int64)
        ready.append((h1, h2, query, np.array([c for _, c in often], np.int64) * index.weights[query]))
    schema = StructType([StructField("h1", LongType()), StructField("h2", LongType()), StructField("id", index.id_type), StructField("score", LongType())])
    return map_arrow(index.shards, searcher(index.shards.sparkSession.sparkContext.broadcast((ready, len(index.vocabulary))), k), schema)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, query_bytes: int = QUERY_BYTES, block: int = BLOCK, most: int = SHARD) -> DataFrame:
    """item_col, rank, id_col, score: the k best documents for each row of items, with a score above 0, all if there are fewer.

    A text's terms are its runs of ASCII letters, digits and characters above U+007F, A-Z lower-cased. With N documents that have a term, L
    terms in all of them, df documents that hold a term, tf occurrences in a document of n terms and m = 25 + 75 * n * N div L, the term adds
    floor(1000 * ln((2N + 2) / (2df + 1))) * (1000000000 * tf div (1000 * tf + 8m)) for each time the query has it.

    Equal scores are ranked by ascending id, null ids last; each row of docs is a document, also where ids repeat. A null text has no
    terms; such an item, and one whose terms no document has, gives no rows, as empty tables do. Rows of items that repeat give their rows
    each; other columns aren't read. A text is held whole; ids may be of any type that Python can compare.

    Queries are read some query_bytes at a time, in blocks by their hashes, and each block is one index over its terms and one search: all
    documents are read for each. Index and search hold a shard at a time, of `most` documents and a bounded table.
    """
    spark = docs.sparkSession
    asked = items.select(column(item_col).alias("item"), column(item_text_col).cast("string").alias("asked")).where(F.col("asked").isNotNull()).select("item", "asked", *hash128(F.col("asked")))
    texts = asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "asked")
    n = -(-(texts.agg(F.sum(F.octet_length("asked"))).first()[0] or 0) // query_bytes)
    found = None
    for i in range(max(1, n)):
        queries = [(r["h1"], r["h2"], terms(r["asked"])) for r in texts.where(F.pmod("h1", F.lit(max(1, n))) == i).collect()]
        vocabulary = {w: t for t, w in enumerate(sorted({w for _, _, words in queries for w in words}))}
        part = search(build(docs, vocabulary, id_col, text_col, None, block, most), queries, k)
        part = written(part, f"{workspace(spark, 'ranked')}/best")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("item", "h1", "h2").join(ranked, ["h1", "h2"]).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
