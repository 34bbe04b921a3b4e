import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import fulltext, vectors
from foliant.operators import embedding, evaluation, retrieval


def test_stems():
    cases = {
        "caresses": "caress", "flies": "fli", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "agreed": "agre", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "happy": "happi", "by": "by", "say": "say",
        "relational": "relat", "conditional": "condit", "generously": "generous", "national": "nation", "protective": "protect", "equipment": "equip", "workers": "worker", "requirements": "requir", "consistency": "consist", "knightly": "knight",
        "skies": "sky", "dying": "die", "news": "news", "proceed": "proceed", "running": "run", "controlled": "control", "geologist": "geologist", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "rolling": "roll",
    }
    assert {w: fulltext.stem(w) for w in cases} == cases


def test_parse():
    q = fulltext.parse('Workers "protective equipment" or gloves -hot "" the')
    (must, never), (must2, never2) = q.alternatives
    assert [t.lexemes for t in must] == [("worker",), ("protect", "equip")] and never == () and must[1].distances == (0, 1)
    assert [t.lexemes for t in must2] == [("glove",)] and [t.lexemes for t in never2] == [("hot",)]
    assert fulltext.parse("the of").alternatives == () and fulltext.parse('or "').alternatives == ()
    assert fulltext.parse('"end of line"').alternatives[0][0][0].distances == (0, 2)


def ranks(spark, docs, question, stemming=False):
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    query = fulltext.parse(question, stemming)
    plain = lambda index: {r["id"]: round(r["rank"], 6) for r in fulltext.keyword_rank(index, "id", query).collect()}
    found = plain(fulltext.postings(df, "id", "text", stemming))
    assert stemming or plain(fulltext.postings(df, "id", "text", False, only=query)) == found
    return found


def test_keyword_rank(spark):
    docs = ["cat " * 3, "cat " * 12, "cat x dog", "dog cat y z w cat dog", "dog", None, "cat dogs"]
    assert ranks(spark, docs, "cat") == {0: 0.3, 1: 1.2, 2: 0.1, 3: 0.2, 6: 0.1}
    both = ranks(spark, docs, "cat dog")
    assert both[2] == 0.05 and set(both) == {2, 3}
    assert both[3] == 0.2  # dog cat and, after a cat that a shorter stretch follows, cat dog
    assert ranks(spark, docs, "cat dog", True)[6] == 0.1
    assert ranks(spark, docs, '"dog cat"') == {3: both[3]}
    assert ranks(spark, docs, "cat -dog") == {0: 0.3, 1: 1.2, 6: 0.1}
    assert ranks(spark, docs, "cat or dog")[4] == 0.1 and ranks(spark, docs, "cat or dog")[3] == 0.4
    assert ranks(spark, docs, "the") == {} and ranks(spark, docs, "absent") == {} and ranks(spark, docs, "cat absent") == {}


def test_ranks_like_brute_force(spark):
    import random

    rng = random.Random(5)
    docs = [" ".join(rng.choice(["p", "q", "r", "z1", "z2", "z3"]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    found = ranks(spark, docs, "p q r")
    for n, d in enumerate(docs):
        words, total, seen = d.split(), 0.0, set()
        for e in range(len(words)):
            if words[e] not in "pqr":
                continue
            last = [max((i for i in range(e + 1) if words[i] == w), default=None) for w in "pqr"]
            if None in last or min(last) in seen:
                continue
            b = min(last)
            seen.add(b)
            entries = sum(w in "pqr" for w in words[b : e + 1])
            total += 0.1 / (1 + (e - b) - (entries - 1))
        assert found.get(n, 0) == pytest.approx(total, abs=2e-6)


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0, 0.0], [-3.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], None), (None, [1.0], None), ([1.0], [1.0, 0.0], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<float>, b array<float>, x double")
    assert [r[0] for r in df.orderBy("i").select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [r[2] for r in rows]
    valid = df.orderBy("i").select(vectors.is_valid(F.col("a"), 2), vectors.is_valid(F.array(F.lit(None).cast("float"), F.lit(1.0)), 2)).collect()
    assert [r[0] for r in valid] == [True, True, True, True, False, False] and not valid[0][1]
    one = df.limit(1).select(vectors.literal(vectors.constant(0.5, 3)), vectors.first_given(F.array().cast("array<float>"), F.col("a"))).first()
    assert one[0] == "[0.5,0.5,0.5]" and one[1] == [1.0, 0.0]


def test_topk_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8)).round(1)
    v[7] = 0
    v[30] = v[31]
    rows = [(i, x.tolist() if i != 9 else None) for i, x in enumerate(v)] + [(1000, [1.0, 2.0])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 7 * 64)
    monkeypatch.setattr(retrieval, "QUERY_TILE", 3)
    queries = chunks.where("id % 10 = 0 and id < 1000").select(F.col("id").alias("query_id"), "embedding")
    found = {}
    for r in retrieval.vector_topk_batch(chunks, queries, 4, other=True).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    u = np.array([x if i not in (7, 9) else np.full(8, np.nan) for i, x in enumerate(v.astype(np.float32).astype(float))])
    u = u / np.sqrt((u**2).sum(axis=1, keepdims=True))
    for q in range(0, 200, 10):
        scores = [(-s, i) for i, s in enumerate(u @ u[q]) if i != q and not math.isnan(s)]
        assert [found[q][k] for k in range(1, 5)] == [i for _, i in sorted((round(s, 12), i) for s, i in scores)[:4]]
    one = retrieval.vector_topk(chunks, v[0].tolist(), 3).collect()
    assert [r["id"] for r in one][1:] == [found[0][1], found[0][2]] and one[0]["id"] == 0


def test_blended_topk_by_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4)).round(1)
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, [0.0] * 4), (91, [1.0])], "id long, embedding array<float>").repartition(3)
    queries = chunks.where("id % 20 = 0 and id < 60").select(F.col("id").alias("query_id"), "embedding")
    told = {(q, i): float(rng.choice([0.1, 0.5, 3.0])) for q in (0, 20, 40) for i in rng.choice(60, 15, replace=False)} | {(20, 90): 1.0, (20, 91): 1.0}
    ranks = spark.createDataFrame([(int(q), int(i), r) for (q, i), r in told.items()], "query_id long, id long, rank double")
    u = v.astype(np.float32).astype(float)
    u = u / np.sqrt((u**2).sum(axis=1, keepdims=True))
    found = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in retrieval.vector_topk_batch(chunks, queries, 6, ranks=ranks).collect()}
    for q in (0, 20, 40):
        scores = sorted((-round(0.8 * s + 0.2 * min(1.0, told.get((q, i), 0.0)), 9), i) for i, s in enumerate(u @ u[q]))[:6]
        assert [found[q, n + 1] for n in range(6)] == [(i, -s) for s, i in scores]


def test_equal_questions_share_their_ranks(spark, monkeypatch):
    """A question's words are ranked once, whatever the number of questions that ask for them; small tiles, and a grid, give the same."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 4)).round(1)
    v[8] = v[9]
    chunks = spark.createDataFrame([(f"c{i:02d}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<float>").repartition(3)
    texts = ["cat dog" if i % 2 else "cat" for i in range(30)]
    asked = spark.createDataFrame([(f"q{i:02d}", v[i].tolist(), t) for i, t in enumerate(texts)], "query_id string, embedding array<float>, question string")
    words = ["cat " * (i % 4) + "stone " * (i % 3) + "dog" * (i % 5 == 0) for i in range(90)]
    index = fulltext.postings(spark.createDataFrame([(f"c{i:02d}", w) for i, w in enumerate(words)], "id string, text string"), "id", "text", stemming=False)
    asked = retrieval.alike(asked)
    ranks = fulltext.keyword_rank_batch(index, "id", asked.where("query_id = asked_as").select("query_id", "question"), stemming=False)
    told = {(r["query_id"], r["id"]): r["rank"] for r in ranks.collect()}
    assert {q for q, _ in told} == {"q00", "q01"} and len(told) == sum("cat" in w for w in words) + sum("cat" in w and "dog" in w for w in words)
    u = v.astype(np.float32).astype(float)
    u = u / np.sqrt((u**2).sum(axis=1, keepdims=True))
    want = {}
    for q in range(30):
        scores = [(-round(0.8 * s + 0.2 * min(1.0, told.get((f"q{q % 2:02d}", f"c{i:02d}"), 0.0)), 9), f"c{i:02d}") for i, s in enumerate(u @ u[q])]
        want |= {(f"q{q:02d}", n): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:6], 1)}
    run = lambda: {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in retrieval.vector_topk_batch(chunks, asked, 6, ranks=ranks, by="asked_as").collect()}
    assert run() == want
    monkeypatch.setattr(retrieval, "QUERY_TILE", 7)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 11)
    assert run() == want
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 300)
    assert run() == want


def test_text_keys_share_ranks(spark, sf_dir, monkeypatch):
    """The query over keys that are texts asks for the ranks of its two texts, not of each question."""
    from foliant.plans import index_queries

    seen, real = [], fulltext.keyword_rank_batch
    monkeypatch.setattr(fulltext, "keyword_rank_batch", lambda index, key, questions, **how: seen.append(questions) or real(index, key, questions, **how))
    assert index_queries.retrieve_text_ids(spark, sf_dir).count() > 0
    assert sorted(r["question"] for r in seen[0].collect()) == ["thing", "thing tion"]


def test_only_asked_postings_are_shuffled(spark):
    """Few questions are sent to the postings: these meet no exchange before they are filtered."""
    index = fulltext.postings(spark.range(200).select(F.col("id"), F.lit("cat dog bird").alias("text")), "id", "text", stemming=False)
    questions = spark.createDataFrame([(1, "cat"), (2, "dog bird")], "query_id int, question string")
    plan = fulltext.keyword_rank_batch(index, "id", questions, stemming=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan



def test_stored_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"cat w{i} dog") for i in range(50)], "id int, text string")
    index = fulltext.store_postings(fulltext.postings(docs, "id", "text", False), "id", "stored_postings", str(tmp_path / "postings"), buckets=8)
    try:
        query = fulltext.parse("cat w7", False)
        ranked = fulltext.keyword_rank(index, "id", query)
        assert [r["id"] for r in ranked.collect()] == [7]
        plan = index.where(F.col("lexeme").isin("cat", "w7"))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(lexeme, [cat,w7])]" in plan
        told = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED stored_postings").collect()}
        assert told["Num Buckets"] == "8" and told["Bucket Columns"] == "[`lexeme`]"
    finally:
        spark.sql("DROP TABLE stored_postings")


def test_k():
    assert retrieval.checked_k(0, 5) == 5 and retrieval.checked_k(None, 3) == 3 and retrieval.checked_k(2, 5) == 2
    with pytest.raises(ValueError):
        retrieval.checked_k(-1, 5)


def test_routes(spark):
    questions = spark.createDataFrame([(i,) for i in range(6)], "query_id int")
    found = spark.createDataFrame([(0, 0.3), (0, 0.1), (1, 0.2999), (3, float("nan")), (4, 0.1), (5, -0.2)], "query_id int, score double")
    web = spark.createDataFrame([(1,), (1,), (2,), (3,)], "query_id int")
    got = {r["query_id"]: (r["route"], r["route_reason"], r["web_result_count"]) for r in retrieval.route(questions, found, web=web).collect()}
    low = "retrieval_score_below_threshold"
    assert got == {0: ("internal", "retrieval_score_met_threshold", None), 1: ("web", low, 2), 2: ("web", "no_chunks_retrieved", 1), 3: ("web", low, 1), 4: ("unavailable", low, 0), 5: ("unavailable", low, 0)}
    zero = {r["query_id"]: r["route"] for r in retrieval.route(questions, found, 0.0).collect()}
    assert zero == {0: "internal", 1: "internal", 2: "web", 3: "web", 4: "internal", 5: "web"}
    with pytest.raises(ValueError):
        retrieval.route(questions, found, 1.5)


def test_web_results_and_context(spark):
    rows = [(1, p, f" t{p} ", None if p == 2 else f"l{p}", None) for p in range(1, 7)]
    found = retrieval.web_results(spark.createDataFrame(rows, "query_id int, position int, title string, link string, snippet string"))
    assert [r["position"] for r in found.orderBy("position").collect()] == [1, 3, 4, 5]
    context = retrieval.web_context(found).first()["context"]
    assert context.startswith("Source 1\nTitle: t1\nURL: l1\nSnippet: \n\nSource 2\nTitle: t3")
    docs = spark.createDataFrame([(1, 2, "b", "d2", None, " two "), (1, 1, None, "d1", 4, "one")], "query_id int, rank int, document_name string, document_id string, page int, content string")
    assert retrieval.document_context(docs).first()["context"] == "Source 1: d1, page 4\none\n\nSource 2: b\ntwo"
    whole = docs.limit(1).select(retrieval.prompt("sys", "Context:", F.lit("c"), F.lit(" q "), "end")).first()[0]
    assert whole == "sys\n\nContext:\n\nc\n\nUser question:\n\nq\n\nend"


def test_grouped_sources(spark):
    rows = [(1, 1, "A", "p1"), (1, 2, "B", None), (1, 3, "A", "p2"), (1, 4, "A", "p1"), (1, 5, "C", ""), (1, 6, "D", "x")]
    found = retrieval.grouped_sources(spark.createDataFrame(rows, "query_id int, rank int, title string, location string")).orderBy("place").collect()
    assert [(r["title"], r["locations"]) for r in found] == [("A", ["p1", "p2"]), ("B", []), ("C", [])]


def test_hybrid_and_images(spark):
    chunks = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [0.0, 1.0]), (3, 11, [1.0, 0.0])], "id long, document_id long, embedding array<float>")
    docs = spark.createDataFrame([(10, "a", "completed"), (11, "b", "failed")], "id long, file_name string, processing_status string")
    index = fulltext.postings(spark.createDataFrame([(2, "gloves"), (3, "gloves gloves")], "id long, text string"), "id", "text")
    best = retrieval.hybrid_topk(chunks, docs, index, "glove", [1.0, 0.0], 3).collect()
    assert {r["id"]: round(r["score"], 6) for r in best} == {1: 0.8, 2: 0.02, 3: 0.84}
    assert {r["id"] for r in retrieval.hybrid_topk(chunks, docs, index, "glove", [1.0, 0.0], 3, completed_only=True).collect()} == {1, 2}
    with pytest.raises(ValueError):
        retrieval.hybrid_topk(chunks, docs, index, " ", [1.0, 0.0])
    images = chunks.select("id", "document_id", F.when(F.col("id") != 3, F.col("embedding")).alias("caption_embedding"))
    assert {r["id"] for r in retrieval.image_topk(images, docs, [1.0, 0.0]).collect()} == {1, 2}


def test_embedding(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts], sum(map(len, texts))

    inputs = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "bad"), ("d", "z")], "item_id string, text string").coalesce(1)
    rows = {r["item_id"]: r for r in embedding.embed(inputs, model, "m", 2).collect()}
    assert rows["b"]["embedding"] == [2.0, 1.0] and rows["a"]["total_tokens"] == 3 and rows["b"]["total_tokens"] is None
    assert rows["c"]["error"] == rows["d"]["error"] == "refused" and rows["c"]["embedding"] is None
    faulty = embedding.faulty_vectors(embedding.embed(inputs, model, "m", 2), 2)
    assert {r["item_id"] for r in faulty.collect()} == {"c", "d"}
    assert {r["item_id"] for r in embedding.lost(inputs, inputs.where("item_id <> 'a'")).collect()} == {"a"}
    totals = spark.createDataFrame([(5, 5, "m"), (7, None, "m")], "n int, total_tokens int, model string")
    assert embedding.totals(totals).first()["total_tokens"] is None and embedding.totals(totals.fillna(7)).first()["total_tokens"] == 12
    images = spark.createDataFrame([(b"1", "image/png"), (b"2", "image/bmp"), (b"3", "image/gif")], "content binary, mime_type string")
    told = embedding.caption(images, lambda c, m: " cat " if c == b"1" else " ", "eye").collect()
    assert {(r["caption"], r["error"]) for r in told} == {("cat", None), (None, "the model gave no caption")}


def test_calls_of_models():
    import time

    calls = []

    def often(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x * 2

    assert embedding.Client(wait=0)(often, 4) == 8 and len(calls) == 3
    with pytest.raises(OSError):
        embedding.Client(retries=1, wait=0)(lambda: (_ for _ in ()).throw(OSError("down")))
    before = time.time()
    with pytest.raises(TimeoutError):
        embedding.Client(timeout=0.05, retries=1, wait=0)(time.sleep, 5)
    assert time.time() - before < 2
    for bad in ({"timeout": 0}, {"retries": -1}, {"wait": -1}):
        with pytest.raises(ValueError):
            embedding.Client(**bad)


def test_judged_scores(spark):
    rows = spark.createDataFrame([(1, "q", "a", ["c"], "r"), (2, "bad", "a", None, None)], "id int, question string, answer string, contexts array<string>, reference string")

    def judge(question, answer, contexts, reference):
        if question == "bad":
            raise RuntimeError("refused")
        return {"faithfulness": len(contexts) / 2}

    found = evaluation.judged(rows, judge, ["faithfulness", "context_recall"], embedding.Client(retries=0))
    assert {(r["id"], r["metric"]): (r["score"], r["error"]) for r in found.collect()} == {(1, "faithfulness"): (0.5, None), (1, "context_recall"): (None, None), (2, "faithfulness"): (None, "refused"), (2, "context_recall"): (None, "refused")}
    assert {r["metric"]: r["value"] for r in evaluation.metric_means(found).collect()} == {"faithfulness": 0.5, "context_recall": None}


def test_batches_of_a_whole_table(spark):
    rows = spark.range(100).selectExpr("id * 7 % 100 AS id", "id % 3 AS g").repartition(5)
    assert sorted((r["id"], r["batch"]) for r in embedding.batched(rows, "id", 32).collect()) == [(i, i // 32) for i in range(100)]
    assert embedding.batched(rows, "id", 10, "g").where("batch = 3").count() == 4 + 3 + 3
    assert embedding.batched(rows.limit(0), "id").collect() == []
    words = rows.selectExpr("concat('w', id) AS id")
    order = sorted(f"w{i}" for i in range(100))
    assert sorted((r["id"], r["batch"]) for r in embedding.batched(words, "id", 7).collect()) == [(w, n // 7) for n, w in enumerate(order)]
    with pytest.raises(ValueError):
        embedding.batched(rows, "id", 0)


def test_evaluation(spark):
    q = spark.createDataFrame([(1, "internal"), (2, "web"), (3, "internal")], "id int, expected_route string")
    a = spark.createDataFrame([(1, "internal", 0.5, "r"), (2, "internal", 0.4, "r")], "id int, route string, highest_retrieval_score double, route_reason string")
    results = evaluation.routing(q, a)
    assert evaluation.accuracy(results).first()["accuracy"] == pytest.approx(1 / 3)
    assert evaluation.accuracy(results.limit(0)).first()["accuracy"] == 0.0
    scores = spark.createDataFrame([("m", 0.5), ("m", float("nan")), ("m", 1.0), ("n", None)], "metric string, score double")
    assert {r[0]: r[1] for r in evaluation.metric_means(scores).collect()} == {"m": 0.75, "n": None}
    assert evaluation.retrieval_scores(results).first()["greatest"] == 0.5


def test_batch_ranks_equal_single_ones(spark):
    import random

    rng = random.Random(11)
    docs = [" ".join(rng.choice("cat dog bird the fish stone".split()) for _ in range(rng.randint(0, 20))) for _ in range(80)]
    index = fulltext.postings(spark.createDataFrame(list(enumerate(docs)), "id int, text string"), "id", "text")
    asked = ["cat", "cat dog", '"cat dog"', "cat dog bird", "cat -fish", "cat dog or stone", '"dog the cat" or bird -stone', "the", "-cat", "none"]
    queries = {n: fulltext.parse(q) for n, q in enumerate(asked)}
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    many = {(r["query_id"], r["id"]): round(r["rank"], 9) for r in fulltext.keyword_rank_batch(index, "id", questions).collect()}
    single = {(n, r["id"]): round(r["rank"], 9) for n, q in queries.items() for r in fulltext.keyword_rank(index, "id", q).collect()}
    assert many == single and len({n for n, _ in many}) == 7


def test_answers(spark):
    from foliant.plans.answer import Settings, answer, grounded

    chunks = spark.createDataFrame([(1, 10, [1.0, 0.0], "Wear gloves.", 3, None, None, None), (2, 11, [0.9, 0.1], "Hard hats.", None, "S", 1, 2), (3, 99, [1.0, 0.0], "an orphan", 1, None, None, None)], "id long, document_id long, embedding array<float>, content string, page int, section string, paragraph_start int, paragraph_end int")
    docs = spark.createDataFrame([(10, "a.pdf"), (11, "b.docx")], "id long, file_name string")
    index = fulltext.postings(chunks, "id", "content")
    images = spark.createDataFrame([(7, 10, [1.0, 0.0]), (8, 10, None)], "id long, document_id long, caption_embedding array<float>")
    questions = spark.createDataFrame([(1, "which gloves?"), (2, "weather today"), (3, " "), (4, "nothing known")], "query_id long, question string")
    web = spark.createDataFrame([(2, 1, " Sun ", "http://w", None)], "query_id long, position int, title string, link string, snippet string")
    model = lambda texts: ([[1.0, 0.0] if "gloves" in t else [0.0, -1.0] for t in texts], 1)
    got = {r["query_id"]: r for r in answer(questions, chunks, docs, index, model, lambda p: F.concat(F.lit("re: "), p), images, web).collect()}
    assert {q: r["route"] for q, r in got.items()} == {1: "internal", 2: "web", 4: "unavailable"}
    one = got[1]
    assert one["highest_retrieval_score"] == pytest.approx(0.8 + 0.2 * 0.1) and [s["title"] for s in one["sources"]] == ["a.pdf", "b.docx"] and one["sources"][0]["location"] == "Page 3" and one["images"] == [7]
    assert one["answer"].startswith("re: Answer from") and "Source 1: a.pdf, page 3\nWear gloves.\n\nSource 2: b.docx" in one["answer"]
    assert [s["url"] for s in got[2]["sources"]] == ["http://w"] and got[4]["answer"] == retrieval.NO_SOURCES and got[4]["sources"] is None
    with pytest.raises(ValueError):
        Settings(text_k=0)
    plain = {r["query_id"]: r for r in grounded(questions, chunks, docs, index, model, lambda p: F.concat(F.lit("re: "), p)).collect()}
    assert set(plain) == {1, 2, 4} and plain[1]["answer"] == one["answer"] and plain[1]["retrieved_chunk_count"] == 2 and not plain[2]["requires_web_search"]
    none = grounded(questions, chunks.limit(0), docs, index, model, lambda p: p).collect()
    assert all(r["answer"] == retrieval.NO_CHUNKS and r["requires_web_search"] and r["sources"] is None and r["retrieved_chunk_count"] == 0 for r in none) and len(none) == 3


def test_metrics_of_answers(spark):
    """Rank-weighted precision, recall and faithfulness from the verdicts of a judge; a judge that fails leaves its metric out."""
    items = [("a", "chunk", p, t, "x") for p, t in enumerate(["yes", "no", "yes", "no"])] + [("a", "statement", p, t, "x") for p, t in enumerate(["yes", "yes", "no"])]
    items += [("b", "chunk", 0, "no", "x"), ("b", "claim", 0, "yes", "x"), ("b", "claim", 1, "fails", "x"), ("c", "claim", 0, "yes", None)]
    asked = spark.createDataFrame(items, "id string, kind string, place int, text string, against string")

    def judge(kind, text, against):
        if text == "fails":
            raise ValueError("no verdict")
        return text == "yes"

    told = evaluation.verdicts(asked, judge, embedding.Client(timeout=5.0, retries=0))
    assert {r["error"] for r in told.where("verdict is null").collect()} == {"no verdict"}
    found = {(r["id"], r["metric"]): r["score"] for r in evaluation.answer_metrics(told).collect()}
    assert found == {("a", "context_precision"): pytest.approx((1 + 2 / 3) / 2), ("a", "context_recall"): pytest.approx(2 / 3), ("b", "context_precision"): 0.0, ("b", "faithfulness"): None, ("c", "faithfulness"): 1.0}
