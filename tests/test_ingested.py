"""What ingest() keeps: answers over stored chunks, postings and containment index kept up, deletion, constraints."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from foliant.functions import containment, fulltext
from foliant.operators import containment as lookups
from foliant.operators import retrieval
from foliant.plans import ingest as plans
from foliant.plans.answer import answer, grounded
from foliant.sources import files
from foliant.sources.store import Change, Refused

from .test_tables import NOW, docx

TOPICS = {"gloves": "Workers must wear protective gloves near the press.", "alarm": "When the alarm rings everybody leaves the building.", "forklift": "Only trained drivers may use the forklift truck."}


def vector(text):
    lower = text.lower()
    return [float(sum(w in lower for w in words)) + 0.01 for words in (("glove", "press"), ("alarm", "building"), ("forklift", "driver"))]


def model(texts):
    return [vector(t) for t in texts], len(texts)


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    """Files, and a store that has taken them in, to be copied by each test."""
    at = tmp_path_factory.mktemp("first")
    (at / "blobs").mkdir()
    for name, text in TOPICS.items():
        (at / "blobs" / f"{name}.docx").write_bytes(docx(("H1", f"About {name}"), ("", text + " Read this page with care. " * 6), image=name == "alarm"))
    told = take(spark, plans.open_store(spark, str(at / "store"), bucket_rows=20), at / "blobs", captioner=lambda content, mime: "a picture of an alarm bell in a building")
    assert {r["status"] for r in told} == {"completed"}
    return at


@pytest.fixture
def folder(first, tmp_path):
    return shutil.copytree(first / "blobs", tmp_path / "blobs")


@pytest.fixture
def store(spark, first, tmp_path):
    shutil.copytree(first / "store", tmp_path / "store")
    return plans.open_store(spark, str(tmp_path / "store"), bucket_rows=20)


def take(spark, store, folder, *names, **how):
    some = files.blobs(spark, str(folder))
    some = some.where(F.col("name").isin([f"{n}.docx" for n in names])) if names else some
    return plans.ingest(store, some, F.lit("c"), model, "m", 3, F.lit(NOW).cast("timestamp"), **how).collect()


def test_answers_over_stored_chunks(spark, store):
    """Ids of stored chunks, documents, images and of the questions are texts."""
    asked = {"q-gloves": "Who must wear gloves?", "q-alarm": "What happens when the alarm rings?", "q-none": " "}
    questions = spark.createDataFrame(list(asked.items()), "query_id string, question string")
    chunks, documents = store.read("document_chunks"), store.read("documents")
    index = store.read("postings").select("id", "lexeme", "pos")
    echo = lambda prompt: F.concat(F.lit("re: "), prompt)
    found = {r["query_id"]: r for r in answer(questions, chunks, documents, index, model, echo, store.read("document_images")).collect()}
    assert set(found) == {"q-gloves", "q-alarm"} and {r["route"] for r in found.values()} == {"internal"}
    first = {q: r["sources"][0]["title"] for q, r in found.items()}
    assert first == {"q-gloves": "gloves.docx", "q-alarm": "alarm.docx"}
    assert found["q-alarm"]["images"] == [store.read("document_images").first()["id"]] and "alarm rings everybody" in found["q-alarm"]["answer"]
    plain = {r["query_id"]: r for r in grounded(questions, chunks, documents, index, model, echo).collect()}
    assert {q: r["sources"][0]["title"] for q, r in plain.items()} == first and not plain["q-alarm"]["requires_web_search"]


def ranks(store, question):
    return {r["id"]: round(r["rank"], 9) for r in plans.matching(store, fulltext.parse(question)).collect()}


def anew(store, question):
    index = fulltext.postings(store.read("document_chunks"), "id", "content")
    return {r["id"]: round(r["rank"], 9) for r in fulltext.keyword_rank(index, "id", fulltext.parse(question)).collect()}


QUESTIONS = ["gloves press", '"forklift truck" or alarm', "workers -gloves", "page care", "drivers"]


def test_the_keyword_index_is_kept_up(spark, store, folder, tmp_path):
    """After a document has changed, ranks are those of an index built anew, and only new runs were written."""
    at = tmp_path / "store" / "data" / "postings"
    before = {str(p): p.stat().st_mtime_ns for p in at.rglob("*.parquet")}
    (folder / "gloves.docx").write_bytes(docx(("H1", "About boots"), ("", "Drivers wear boots. " * 8)))
    assert [r["status"] for r in take(spark, store, folder, "gloves")] == ["completed"]
    for question in QUESTIONS:
        assert ranks(store, question) == anew(store, question)
    assert ranks(store, "gloves") == {} and len(ranks(store, "boots")) == 1
    assert all((p := str(f)) not in before or f.stat().st_mtime_ns == before[p] for f in at.rglob("*.parquet")) and all(any(str(f) == p for f in at.rglob("*.parquet")) for p in before)


def test_the_containment_index_is_kept_up(spark, store, folder):
    everything = store.read("document_chunks").select("id", "metadata", "section_path").collect()
    for column, part in (("section_path", ["About alarm"]), ("section_path", ["About alarm", "none"]), ("metadata", {"section": "About gloves"}), ("metadata", {"paragraph_start": 1}), ("metadata", {"section": None}), ("metadata", {}), ("section_path", [])):
        want = {r["id"] for r in everything if containment.holds(r["section_path"] if column == "section_path" else json.loads(r["metadata"]), part)}
        assert {r["id"] for r in plans.containing(store, column, part).collect()} == want
    (folder / "alarm.docx").write_bytes(docx(("H1", "About bells"), ("", "Bells ring. " * 12)))
    take(spark, store, folder, "alarm")
    assert plans.containing(store, "section_path", ["About alarm"]).count() == 0 and plans.containing(store, "section_path", ["About bells"]).count() == 1


def test_documents_are_deleted_with_all_that_is_theirs(spark, store):
    documents = store.read("documents")
    plans.delete_documents(store, documents.where("file_name = 'alarm.docx'"))
    assert {t: store.read(t).count() for t in ("documents", "document_chunks", "document_images", "image_blobs")} == {"documents": 2, "document_chunks": 2, "document_images": 0, "image_blobs": 0}
    assert ranks(store, "alarm") == {} and plans.containing(store, "section_path", ["About alarm"]).count() == 0


def test_the_store_refuses_what_breaks_its_rules(spark, store):
    """Each check, unique key and reference of the tables."""
    def changed(table, **values):
        row = store.read(table).limit(1)
        new = row.select(*[values[c].cast(row.schema[c].dataType).alias(c) if c in values else c for c in row.columns])
        return Change(table, new.select(*store.tables[table].owners()), lambda old: new)

    lit, none = F.lit, F.lit(None)
    bad = [("documents", {"file_type": lit("txt")}), ("documents", {"processing_status": lit("lost")}), ("documents", {"file_size_bytes": lit(-1)})]
    bad += [("document_chunks", {c: v}) for c, v in {"chunk_index": lit(-1), "token_count": lit(-1), "content": lit(" "), "section_path": none, "metadata": lit("[]")}.items()]
    bad += [("document_images", {c: v}) for c, v in {"image_index": lit(-1), "page_number": lit(0), "width": lit(0), "height": lit(0), "metadata": lit("oops")}.items()]
    bad += [("document_chunks", {"document_id": lit("nobody's")}), ("document_images", {"document_id": lit("nobody's")}), ("documents", {"source_blob_name": lit("elsewhere")})]
    versions = store.versions()
    for table, values in bad:
        with pytest.raises(Refused):
            store.apply([changed(table, **values)])
    both = store.read("document_chunks").limit(1)
    with pytest.raises(Refused, match="not unique"):
        store.apply([Change("document_chunks", both, lambda old: both.union(both))])
    assert store.versions() == versions
    nulls = store.read("document_images").select("document_id", *[F.lit(0).alias("image_index")], F.lit("{}").alias("metadata"), F.lit("i").alias("id"))
    store.apply([Change("document_images", nulls, lambda old: nulls)])
    assert store.read("document_images").first()["width"] is None


def test_containment():
    cases = [
        ({"a": {"b": [1, 2]}, "c": "x"}, {"a": {"b": [2]}}, True), ({"a": {"b": [1, 2]}}, {"a": {"b": [3]}}, False), ({"a": 1}, {"a": 1.0}, True), ({"a": 1}, {"a": True}, False), ({"a": [1]}, {"a": 1}, False),
        ([1, 2], 1, True), ([1, [2]], [[2]], True), ([1, 2], [2, 2, 1], True), ({"a": None}, {"a": None}, True), ({}, {"a": None}, False), ({"a": {}}, {"a": {}}, True), ({"a": 1}, {"a": {}}, False), ("x", "x", True), ([{"k": 1, "l": 2}], [{"k": 1}], True), ([{"k": 1}, {"l": 2}], [{"k": 1, "l": 2}], False),
    ]
    for whole, part, result in cases:
        assert containment.holds(whole, part) == result, (whole, part)
        assert not result or {*containment.hashes(part)} <= {*containment.hashes(whole)} or not isinstance(part, (dict, list))


def test_lookups_look_twice(spark):
    """Rows whose leaves lie in different elements have all items and contain nothing; odd texts are passed over."""
    texts = ['[{"k": 1}, {"l": 2}]', '[{"k": 1, "l": 2}]', None, "no json", "{}", '{"k": 1}']
    rows = spark.createDataFrame([(str(i), "d", t) for i, t in enumerate(texts)], "id string, document_id string, metadata string")
    index = lookups.entries(rows, ["metadata"])
    find = lambda part: {r["id"] for r in lookups.containing(rows, index, "metadata", part).collect()}
    assert find([{"k": 1, "l": 2}]) == {"1"} and find([{"k": 1}]) == {"0", "1"} and find({}) == {"4", "5"} and find({"k": 1}) == {"5"}


def test_search_in_a_grid(spark, monkeypatch):
    """More questions than may be sent to a task: bands of questions and columns of chunks, the same result."""
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6)).round(1)
    v[5] = v[6]
    chunks = spark.createDataFrame([(f"c{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("short", [1.0]), (None, [1.0] * 6)], "id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(v[:40])] + [("q-short", [2.0]), ("none", None)], "query_id string, embedding array<float>")
    run = lambda: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in retrieval.vector_topk_batch(chunks, asked, 4).collect())
    plain = run()
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 500)
    monkeypatch.setattr(retrieval, "QUERY_TILE", 3)
    assert run() == plain and len(plain) == 40 * 4 + 1 and ("q-short", 1, "short", 1.0) in plain
    assert ("q5", 1, "c005", 1.0) in plain and ("q5", 2, "c006", 1.0) in plain


def test_long_documents_are_stored_alike(spark, store, folder, tmp_path, monkeypatch):
    (folder / "alarm.docx").write_bytes(docx(*[x for i in range(30) for x in (("H1", f"Part {i} of it"), ("", f"Words of part {i} stand here. " * 30))]))
    shutil.copytree(store.path, tmp_path / "other")
    other = plans.open_store(spark, str(tmp_path / "other"), bucket_rows=20)
    take(spark, store, folder, "alarm")
    monkeypatch.setattr(plans, "LONG", 1)
    take(spark, other, folder, "alarm")
    rows = lambda s: sorted((r["id"], r["chunk_index"], r["content"], r["section_path"], r["metadata"]) for r in s.read("document_chunks").collect())
    assert rows(store) == rows(other) and len(rows(store)) > 30
