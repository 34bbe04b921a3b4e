"""Questions against chunks and images: exact similarity, blended ranks, top-k, routes, sources and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.fulltext import keyword_rank, parse
from ..functions.names import location
from ..functions.text import is_blank, strip
from ..functions.vectors import blend, cosine

# Fixed values of retrieval.
TEXT_K, IMAGE_K, WEB_K, THRESHOLD, SIMILARITY_WEIGHT = 5, 3, 5, 0.30, 0.80
NO_SOURCES = "The internal documents did not contain enough relevant information, and no useful web results were found."
NO_CHUNKS = "The available documents do not contain enough information to answer this question."
#: Bytes of the query vectors that are sent to all executors, and that a band of more of them has; queries and rows of a product, and pairs
#: that are scored at once in doubles.
QUERY_BYTES, QUERY_TILE, ROW_BLOCK, PAIRS = 64 << 20, 1024, 4096, 1 << 17


def checked_k(k: int | None, default: int) -> int:
    """k, or the default for none and 0; a negative k is an error."""
    k = k or default
    if k < 0:
        raise ValueError("k must be positive")
    return k


def top(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k rows with the greatest score; of equal ones those with the smallest key. NaN and null come last."""
    ranked = F.when(~F.isnan(score), F.col(score)).desc_nulls_last()
    return df.orderBy(ranked, F.col(key)).limit(k)


def top_by(df: DataFrame, group: list[str], k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows of each group with their rank; rows beyond k are dropped before the shuffle where Spark can."""
    order = Window.partitionBy(*group).orderBy(F.when(~F.isnan(score), F.col(score)).desc_nulls_last(), F.col(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar(df: DataFrame, vector: str, query: list[float], score: str = "score") -> DataFrame:
    """df with the cosine similarity to one query vector. Rows without a vector are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = float(np.sqrt(np.dot(query, query)))
    return df.where(F.col(vector).isNotNull()).withColumn(score, cosine(F.col(vector), q, norm_b=F.lit(size)))


def vector_topk(chunks: DataFrame, query: list[float], k: int | None = None, vector: str = "embedding", key: str = "id", documents: DataFrame | None = None) -> DataFrame:
    """The chunks most similar to one query, with their documents where these are given. Vectors are gone before rows leave a task."""
    rows = similar(chunks, vector, query).drop(vector)
    return top(rows if documents is None else rows.join(_named(documents), "document_id"), checked_k(k, TEXT_K), key=key)


def vector_topk_batch(chunks: DataFrame, queries: DataFrame, k: int | None = None, vector: str = "embedding", key: str = "id", query_key: str = "query_id", other: bool = False, ranks: DataFrame | None = None, weight: float = SIMILARITY_WEIGHT, by: str | None = None) -> DataFrame:
    """query_key, key, score, rank: the k chunks most similar to each query (query_key, vector). Keys are of any type that can be sorted.

    Queries up to QUERY_BYTES, which is looked up first, are sent to all tasks, a matrix product for each tile of queries and block of
    chunks. More of them never pass the driver: queries are dealt to bands and chunks to columns, and each cell of that grid is
    a task of its own. Either way a task returns its k best for each query, and these few are ranked; what is shuffled doesn't
    grow with the number of chunks times queries. other: a query's own key isn't among its results.

    ranks: keyword ranks (query_key, key, rank) of those pairs that have one; scores then are `weight` of the similarity and the
    rest of the rank. A chunk comes to the product with its ranks. by: a column of queries that names the query whose ranks
    hold, as alike() gives it: queries that ask for the same words then have their ranks once.
    """
    k = checked_k(k, TEXT_K)
    rows = chunks.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    v = F.col(vector).cast("array<double>").alias("v")
    asked = queries.where(F.col(vector).isNotNull() & F.col(query_key).isNotNull()).select(F.col(query_key).alias("query"), F.col(by or query_key).alias("as"), v)
    if ranks is not None:
        told = ranks.where(F.col("rank").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct(F.col(query_key).alias("as"), F.col("rank").cast("double").alias("rank"))).alias("ranks"))
        rows = rows.join(told, "key", "left")
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    found = _nearest(rows, asked, k, other, weight if ranks is not None else None)
    return top_by(found, ["query"], k, key="key").select(F.col("query").alias(query_key), F.col("key").alias(key), "score", "rank")


def alike(questions: DataFrame, text: str = "question", query_key: str = "query_id", name: str = "asked_as") -> DataFrame:
    """questions with the least key of those that have the same text."""
    first = questions.groupBy(F.col(text).alias("__text")).agg(F.min(query_key).alias(name))
    return questions.join(first, F.col(text).eqNullSafe(F.col("__text"))).drop("__text")


def _nearest(rows: DataFrame, asked: DataFrame, k: int, other: bool, weight: float | None) -> DataFrame:
    """query, key, score: of each task's rows (key, v, and with a weight ranks) the k best for each query (query, as, v)."""
    spark = rows.sparkSession
    schema = StructType([asked.schema["query"], rows.schema["key"], StructField("score", DoubleType())])
    size = asked.agg(F.sum(8 * F.size("v").cast("long"))).first()[0] or 0
    if size <= QUERY_BYTES:
        found = asked.toArrow()
        sent = spark.sparkContext.broadcast((found["query"].to_pylist(), found["as"].to_pylist(), [np.array(v, np.float64) for v in found["v"].to_pylist()]))
        return rows.mapInArrow(_against(sent, schema, k, other, weight), schema)
    bands = -(-size // QUERY_BYTES)
    columns = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // bands)
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    none = lambda df, *names: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    more = ["ranks"] if weight is not None else []
    up = asked.select(F.pmod(F.xxhash64("query"), F.lit(bands)).cast("int").alias("band"), F.explode(number(columns)).alias("column"), F.lit(0).alias("side"), "query", "as", "v", *none(rows, "key", *more))
    down = rows.select(F.explode(number(bands)).alias("band"), F.pmod(F.xxhash64("key"), F.lit(columns)).cast("int").alias("column"), F.lit(1).alias("side"), *none(asked, "query", "as"), "v", "key", *more)
    cells = up.unionByName(down).repartition(bands * columns, "band", "column").sortWithinPartitions("band", "column", "side")
    return cells.mapInArrow(_cells(schema, k, other, weight), schema)


class Best:
    """The k best keys of some queries so far. Keys are held as numbers of `names`; a tile of queries has its own arrays of candidates.

    Candidates beyond the k-th best score of a query are dropped as they come; the others are held until there are so many that
    sorting them pays.
    """

    def __init__(self, ids: list, k: int):
        self.ids, self.k, self.names = ids, k, []
        self.least = np.full(len(ids), -np.inf)
        self.held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(0, len(ids), QUERY_TILE)]

    def tiles(self) -> Iterator[tuple[int, slice]]:
        return ((i, slice(i * QUERY_TILE, min(len(self.ids), (i + 1) * QUERY_TILE))) for i in range(len(self.held)))

    def candidates(self, least: np.ndarray, scores: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in scores, a row for a query whose k-th best score is `least`, that may be among the k best; scores are right but for a margin."""
        cut = least - margin
        fresh = np.flatnonzero(np.isneginf(least))
        if len(fresh) and scores.shape[1] > self.k:
            cut[fresh] = np.partition(scores[fresh], -self.k, axis=1)[:, -self.k] - 2 * margin
        return np.nonzero((scores >= cut.astype(scores.dtype)[:, None]) & (scores > -np.inf))

    def put(self, tile: int, rows: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """rows: places of queries in their tile."""
        if not len(rows):
            return
        self.held[tile].append((rows, names, scores))
        t = slice(tile * QUERY_TILE, (tile + 1) * QUERY_TILE)
        if sum(len(x[0]) for x in self.held[tile]) > 2 * self.k * len(self.ids[t]) or np.isneginf(self.least[t][rows]).any():
            self._sort(tile, t)

    def _sort(self, tile: int, t: slice) -> None:
        if not self.held[tile]:
            return
        rows, names, scores = (np.concatenate(x) for x in zip(*self.held[tile]))
        by = np.lexsort((-scores, rows))
        rows, names, scores = rows[by], names[by], scores[by]
        same = (rows[1:] == rows[:-1]) & (scores[1:] == scores[:-1])
        if same.any():  # of equal scores the smallest key
            tied = np.append(False, same) | np.append(same, False)
            some = np.unique(names[tied])
            place = np.empty(len(some), np.int64)
            place[sorted(range(len(some)), key=lambda i: self.names[some[i]])] = np.arange(len(some))
            order = np.zeros(len(rows), np.int64)
            order[tied] = place[np.searchsorted(some, names[tied])]
            by = np.lexsort((order, -scores, rows))
            rows, names, scores = rows[by], names[by], scores[by]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        few, last = nth < self.k, nth == self.k - 1
        self.held[tile] = [(rows[few], names[few], scores[few])]
        self.least[t][rows[last]] = scores[last]

    def forget(self) -> None:
        """Leaves names that no candidate has, once they are most."""
        if len(self.names) <= 100_000 + 4 * self.k * len(self.ids):
            return
        for tile, t in self.tiles():
            self._sort(tile, t)
        parts = [x for held in self.held for x in held]
        used = np.unique(np.concatenate([x[1] for x in parts])) if parts else np.array([], np.int64)
        self.held = [[(r, np.searchsorted(used, n), s) for r, n, s in held] for held in self.held]
        self.names = [self.names[i] for i in used]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for tile, t in self.tiles():
            self._sort(tile, t)
            for row, name, score in self.held[tile]:
                columns = [[self.ids[t][i] for i in row], [self.names[i] for i in name], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """v with rows of length 1, and which of them have a length."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        v = v / np.sqrt((v**2).sum(axis=1))[:, None]
    return v, np.isfinite(v).all(axis=1)


class _Similar(Best):
    """The best by similarity, blended with ranks where there is a weight, for queries whose vectors have the same length.

    A product in single precision tells which pairs may be among the best, by a bound of its errors; these few are scored in doubles.
    """

    def __init__(self, ids: list, alike: list, vectors: list[np.ndarray], k: int, other: bool, weight: float | None):
        self.other, self.weight = other, weight
        queries, good = unit(np.array(vectors, np.float64).reshape(len(ids), -1))
        good = np.flatnonzero(good)
        super().__init__([ids[i] for i in good], k)
        self.queries, self.single = queries[good], queries[good].astype(np.float32)
        self.margin = 2 * (self.queries.shape[1] + 8) * 2.0**-23
        whose: dict = {}
        self.whose = np.array([whose.setdefault(alike[i], len(whose)) for i in good], np.int64)
        self.groups, self.at = list(whose), {}
        for i, x in enumerate(self.ids):
            self.at.setdefault(x, []).append(i)

    def add(self, keys: list, v: np.ndarray, told: tuple[np.ndarray, pa.Array, np.ndarray] | None = None) -> None:
        """told: of each rank the place of its key, whose it is, and the rank."""
        v, good = unit(v)
        first = len(self.names)
        self.names += keys
        own = [(q, i) for i, x in enumerate(keys) for q in self.at.get(x, ())] if self.other else []
        pairs = np.array(own, np.int64).reshape(-1, 2)
        known = self._known(told)
        with np.errstate(over="ignore"):
            single = np.where(good[:, None], v, 0).astype(np.float32)
        for tile, t in self.tiles():
            groups, place = np.unique(self.whose[t], return_inverse=True)
            at = np.full(len(self.groups), -1)
            at[groups] = np.arange(len(groups))
            here = at[known[0]] >= 0
            ranks = (at[known[0][here]], known[1][here], known[2][here])
            for start in range(0, len(keys), ROW_BLOCK):
                some = slice(start, start + ROW_BLOCK)
                new = self.single[t] @ single[some].T
                blend = None
                if self.weight is not None:
                    blend = np.zeros((len(groups), new.shape[1]))
                    within = (ranks[1] >= some.start) & (ranks[1] < some.stop)
                    np.maximum.at(blend, (ranks[0][within], ranks[1][within] - start), round(1 - self.weight, 10) * np.minimum(ranks[2][within], 1.0))
                    new *= np.float32(self.weight)
                    if within.any():
                        new += blend.astype(np.float32)[place]
                new[:, ~good[some]] = -np.inf
                mine = pairs[(pairs[:, 0] >= t.start) & (pairs[:, 0] < t.stop) & (pairs[:, 1] >= some.start) & (pairs[:, 1] < some.stop)]
                new[mine[:, 0] - t.start, mine[:, 1] - start] = -np.inf
                row, col = self.candidates(self.least[t], new, self.margin)
                for a in range(0, len(row), PAIRS):
                    r, c = row[a : a + PAIRS], col[a : a + PAIRS]
                    scores = (self.queries[t][r] * v[some][c]).sum(axis=1)
                    if blend is not None:
                        scores = self.weight * scores + blend[place[r], c]
                    self.put(tile, r, first + start + c, scores)
        self.forget()

    def _known(self, told: tuple[np.ndarray, pa.Array, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ranks whose they are, as numbers of groups, the places of their keys, and they themselves."""
        if told is None or not len(self.groups):
            return np.array([], np.int64), np.array([], np.int64), np.array([])
        found = pc.index_in(told[1], value_set=pa.array(self.groups, told[1].type))
        has = np.asarray(pc.is_valid(found))
        return np.asarray(found.drop_null()).astype(np.int64), told[0][has], told[2][has]


def _by_length(ids: list, alike: list, vectors: list[np.ndarray], k: int, other: bool, weight: float | None) -> dict[int, _Similar]:
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        lengths.setdefault(len(v), []).append(i)
    return {n: _Similar(*([x[i] for i in at] for x in (ids, alike, vectors)), k, other, weight) for n, at in lengths.items() if n}


def _meet(best: dict[int, _Similar], batch: pa.RecordBatch) -> None:
    """Puts the keys of a batch (key, v, ranks) into the queries' best."""
    offsets, flat, keys = np.asarray(batch["v"].offsets), np.asarray(batch["v"].flatten()), batch["key"].to_pylist()
    lengths, offsets = np.diff(offsets), offsets - offsets[0]
    told = None
    if "ranks" in batch.schema.names:
        ranks = batch["ranks"]
        x = ranks.flatten()
        told = (np.repeat(np.arange(len(keys)), np.asarray(pc.fill_null(pc.list_value_length(ranks), 0))), x.field("as"), np.asarray(x.field("rank")))
    for n, found in best.items():
        fits = np.flatnonzero(lengths == n)
        if len(fits):
            whole = flat.reshape(-1, n) if len(fits) == len(keys) else flat[offsets[fits][:, None] + np.arange(n)]
            own = told
            if told is not None and len(fits) < len(keys):
                place = np.full(len(keys), -1)
                place[fits] = np.arange(len(fits))
                some = place[told[0]] >= 0
                own = (place[told[0]][some], told[1].filter(pa.array(some)), told[2][some])
            found.add([keys[i] for i in fits], whole, own)


def _against(sent, schema: StructType, k: int, other: bool, weight: float | None):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _by_length(*sent.value, k, other, weight)
        for batch in source:
            _meet(best, batch)
        for found in best.values():
            yield from found.rows(to_arrow_schema(schema))

    return run


def _cells(schema: StructType, k: int, other: bool, weight: float | None):
    """Cells one after the other, in each the queries before the rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, alike, vectors, best = None, [], [], [], None
        for batch in source:
            cell = np.stack([np.asarray(batch[c]) for c in ("band", "column", "side")])
            edges = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if (at := (cell[0, a], cell[1, a])) != now:
                    for found in (best or {}).values():
                        yield from found.rows(to_arrow_schema(schema))
                    now, ids, alike, vectors, best = at, [], [], [], None
                part = batch.slice(a, b - a)
                if cell[2, a] == 0:
                    ids += part["query"].to_pylist()
                    alike += part["as"].to_pylist()
                    vectors += [np.array(v, np.float64) for v in part["v"].to_pylist()]
                    continue
                best = _by_length(ids, alike, vectors, k, other, weight) if best is None else best
                _meet(best, part)
        for found in (best or {}).values():
            yield from found.rows(to_arrow_schema(schema))

    return run


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("document_id"), F.col("file_name").alias("document_name"))


def hybrid_topk(chunks: DataFrame, documents: DataFrame, index: DataFrame, question: str, query: list[float], k: int | None = None, stemming: bool = True, completed_only: bool = False) -> DataFrame:
    """The k chunks with the best blend of similarity and keyword rank, with their documents.

    chunks: id, document_id, embedding, ... ; documents: id, file_name, ... ; index: postings by chunk id. All chunks are scored
    exactly, and vectors are gone before anything is joined. A chunk without its document isn't found. completed_only: nor is one
    of a document that isn't completed.
    """
    if is_empty(question):
        raise ValueError("the question is empty")
    ranks = keyword_rank(index, "id", parse(question, stemming))
    rows = similar(chunks, "embedding", query, "similarity").drop("embedding").join(ranks, "id", "left")
    rows = rows.withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    rows = rows.withColumn("score", blend(F.col("similarity"), F.col("rank"), SIMILARITY_WEIGHT))
    whole = documents.where("processing_status = 'completed'") if completed_only else documents
    return top(rows.join(_named(whole), "document_id"), checked_k(k, TEXT_K))


def image_topk(images: DataFrame, documents: DataFrame, query: list[float], k: int | None = None) -> DataFrame:
    """The k captioned images most similar to a query, with their documents."""
    rows = similar(images, "caption_embedding", query).drop("caption_embedding")
    return top(rows.join(_named(documents), "document_id"), checked_k(k, IMAGE_K))


def is_empty(question: str | None) -> bool:
    return not isinstance(question, str) or not question.strip()


def route(questions: DataFrame, retrieved: DataFrame, threshold: float = THRESHOLD, web: DataFrame | None = None, query_key: str = "query_id") -> DataFrame:
    """query_key, retrieved_chunk_count, highest_retrieval_score, web_result_count, route, route_reason for each question.

    Internal where chunks were found and the best score reaches the threshold; NaN doesn't. Else web, or unavailable where web (a
    row for each result) is given and has nothing.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    best = retrieved.groupBy(query_key).agg(F.count("*").alias("n"), F.max("score").alias("best"))
    rows = questions.select(query_key).join(best, query_key, "left")
    n, score = F.coalesce("n", F.lit(0)), F.coalesce("best", F.lit(0.0))
    met = (n > 0) & ~F.isnan(score) & (score >= threshold)
    rows = rows.select(query_key, n.alias("retrieved_chunk_count"), score.alias("highest_retrieval_score"), met.alias("met"))
    if web is not None:
        rows = rows.join(web.groupBy(query_key).agg(F.count("*").alias("w")), query_key, "left")
    found = F.coalesce("w", F.lit(0)) if web is not None else F.lit(1)
    reason = F.when(F.col("met"), "retrieval_score_met_threshold").when(F.col("retrieved_chunk_count") == 0, "no_chunks_retrieved").otherwise("retrieval_score_below_threshold")
    to = F.when(F.col("met"), "internal").when(found > 0, "web").otherwise("unavailable")
    count = F.when(~F.col("met"), found) if web is not None else F.lit(None).cast("long")
    return rows.select(query_key, "retrieved_chunk_count", "highest_retrieval_score", count.alias("web_result_count"), to.alias("route"), reason.alias("route_reason"))


def web_results(found: DataFrame, k: int | None = None, query_key: str = "query_id") -> DataFrame:
    """Of each query's results (position, title, link, snippet) the first k, and of these the ones with title and link, trimmed."""
    nth = F.row_number().over(Window.partitionBy(query_key).orderBy("position"))
    first = found.withColumn("__nth", nth).where(F.col("__nth") <= checked_k(k, WEB_K)).drop("__nth")
    good = first.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))
    return good.withColumns({n: strip(F.coalesce(n, F.lit(""))) for n in ("title", "link", "snippet")})


def sources(retrieved: DataFrame) -> DataFrame:
    """retrieved (document_name or null, document_id, page, section, paragraph_start, paragraph_end, score) with title and location."""
    title = F.coalesce("document_name", F.col("document_id").cast("string"))
    return retrieved.withColumn("title", title).withColumn("location", location(F.col("page"), F.col("section"), F.col("paragraph_start"), F.col("paragraph_end")))


def grouped_sources(found: DataFrame, most: int = 3, query_key: str = "query_id", order: str = "rank") -> DataFrame:
    """query_key, title, locations, place: sources of the same title together, in the order of their first, `most` of them; each location once."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce("location", F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col("location").alias("l")))))
    groups = found.groupBy(query_key, "title").agg(F.min(order).alias("first"), F.array_distinct(F.transform(rows, lambda x: x["l"])).alias("locations"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("first"))
    return groups.withColumn("place", place).where(F.col("place") <= most).drop("first")


def _numbered(rows: DataFrame, query_key: str, order: str, text: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(query_key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def document_context(retrieved: DataFrame, query_key: str = "query_id", order: str = "rank") -> DataFrame:
    """query_key and context: the chunks of a question, numbered from 1, each under its document's name and page."""
    nth = F.row_number().over(Window.partitionBy(query_key).orderBy(order))
    title = F.coalesce("document_name", F.col("document_id").cast("string"))
    head = F.concat(F.lit("Source "), nth.cast("string"), F.lit(": "), title, F.coalesce(F.concat(F.lit(", page "), F.col("page").cast("string")), F.lit("")))
    rows = retrieved.select(query_key, order, F.concat(head, F.lit("\n"), strip(F.col("content"))).alias("t"))
    return _numbered(rows, query_key, order, F.col("t"))


def web_context(found: DataFrame, query_key: str = "query_id", order: str = "position") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(query_key).orderBy(order))
    text = F.concat(F.lit("Source "), nth.cast("string"), F.lit("\nTitle: "), F.col("title"), F.lit("\nURL: "), F.col("link"), F.lit("\nSnippet: "), F.col("snippet"))
    return _numbered(found.select(query_key, order, text.alias("t")), query_key, order, F.col("t"))


def prompt(system: str, heading: str, context: Column, question: Column, closing: str) -> Column:
    """System text, context under its heading, question, and closing line, with blank lines between."""
    return F.concat_ws("\n\n", F.lit(system), F.lit(heading), context, F.lit("User question:"), strip(question), F.lit(closing))


def answers(routes: DataFrame, prompts: DataFrame, generate, query_key: str = "query_id") -> DataFrame:
    """routes with the answer of `generate`, a function of a column of prompts; what has no source gets a fixed answer."""
    rows = routes.join(prompts, query_key, "left")
    return rows.withColumn("answer", F.when(F.col("route") == "unavailable", NO_SOURCES).otherwise(generate(F.col("prompt"))))


def valid_question(question: Column, longest: int = 2000) -> Column:
    return ~is_blank(question) & (F.length(question) <= longest)
