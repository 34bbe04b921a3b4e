import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import chunks, margins, structure, validate
from foliant.operators.chunks import Element, Packer, Sizes


def elements(*parts):
    return [Element(*p) if isinstance(p, tuple) else Element(p) for p in parts]


def packed(parts, sizes=Sizes()):
    packer = Packer("d", sizes)
    out = [c for e in parts for c in packer.put(e)]
    return [*out, *packer.flush()]


def words(n, start=0):
    return " ".join(f"w{i}" + ("." if i % 10 == 9 else "") for i in range(start, start + n))


def test_heading_paths_like_a_dictionary(spark):
    import random

    rng, rows, expected = random.Random(3), [], {}
    for d in range(40):
        active = {}
        for o in range(30):
            level = rng.choice([None, None, 1, 2, 3, 4, 9, 10, 12, 31])
            if level:
                active = {k: v for k, v in active.items() if k < level} | {level: f"{d}-{o}"}
            rows.append((d, o, level, f"{d}-{o}"))
            expected[d, o] = [active[k] for k in sorted(active)]
    df = spark.createDataFrame(rows, "document_id int, unit_ordinal int, level int, title string")
    found = df.select("document_id", "unit_ordinal", structure.section_path(F.col("level"), F.col("title"), "document_id", "unit_ordinal").alias("p")).collect()
    assert {(r[0], r[1]): r[2] for r in found} == expected


def test_analyze(spark):
    rows = [("a", 0, "SAFETY RULES", None, None), ("a", 1, "body text here.", None, None), ("a", 2, "Heading text goes here", "Heading 2", None), ("a", 3, "• point", None, None), ("a", 4, " ", None, None), ("a", 5, "x | y", None, "table_row"), ("b", 0, "plain words.", None, None)]
    df = spark.createDataFrame(rows, "document_id string, unit_ordinal int, text string, style string, content_type string").withColumns({"file_type": F.lit(".DOCX"), "section": F.lit(" given ")})
    found = {(r["document_id"], r["unit_ordinal"]): r for r in structure.analyze(df).collect()}
    assert [found["a", i]["element_type"] for i in (0, 1, 2, 3, 5)] == ["heading", "text", "heading", "list", "table"]
    assert found["a", 3]["section_path"] == ["SAFETY RULES", "Heading text goes here"] and found["a", 3]["text"] == "- point"
    assert ("a", 4) not in found and found["b", 0]["section"] == "given" and found["b", 0]["section_path"] == []
    assert structure.analyze(df.withColumn("file_type", F.lit("txt"))).count() == 0


def test_lines_as_units(spark):
    df = spark.createDataFrame([("a", 0, "x\ny"), ("a", 1, "z")], "document_id string, unit_ordinal int, text string")
    assert [(r["unit_ordinal"], r["text"]) for r in structure.lines_as_units(df).orderBy("unit_ordinal").collect()] == [(0, "x"), (1, "y"), (2, "z")]


def test_packing_rules():
    two = packed(elements((words(400), "text", ("S",), "S"), (words(400, 400), "text", ("S",), "S")))
    assert len(two) == 2 and two[1][4] <= 475 and two[1][2].split()[0] not in two[0][2].split()[:300]
    other = packed(elements((words(400), "text", ("S",), "S"), (words(400, 400), "text", ("T",), "T")))
    assert [c[4] for c in other] == [400, 400]
    assert len(packed(elements(("A", "heading", ("A",), "A"), ("B", "heading", ("A", "B"), "B"), ("text", "text", ("A", "B"), "B")))) == 1
    assert [c[4] for c in packed(elements(words(650).replace(".", "")))] == [650]
    plain = " ".join(f"w{i}" for i in range(1600))
    assert [len(e.text.split()) for e in chunks.fragments(Element(plain), Sizes())] == [500, 500, 500, 100]
    assert packed([]) == [] and packed(elements(" ")) == []


def test_content_and_type():
    content = packed(elements(("T", "heading", ("T",), "T"), ("- a", "list", ("T",), "T"), ("- b", "list", ("T",), "T")))[0]
    assert content[2] == "T\n\n- a\n- b" and content[3] == "list" and content[7] == "T"
    assert packed(elements(("x", "table"), ("- b", "list")))[0][3] == "table"
    pages = packed([Element("a", page=3, paragraph=None, style="S"), Element("b", page=2, paragraph=7, style="S")])[0]
    assert pages[5:7] == (2, 3) and pages[9:11] == (7, 7) and pages[11] == ["S"]


def test_overlap_is_dropped_where_it_does_not_fit():
    sizes = Sizes(target=10, most=12, overlap=5)
    out = packed(elements("a b c d e f. g h i j.", "k l m n o p q r s t."), sizes)
    assert [c[4] for c in out] == [10, 10]
    out = packed(elements("a b c d e f. g h i j.", "k l m n o."), sizes)
    assert out[1][2].startswith("g h i j.") and out[1][4] == 9


@pytest.mark.parametrize("target,most,overlap", [(0, 1, 0), (5, 4, 0), (1, 2, 2), (1, 2, -1)])
def test_sizes(target, most, overlap):
    with pytest.raises(ValueError):
        Sizes(target, most, overlap)


def test_chunks_of_documents(spark, sf_dir):
    from foliant.plans.text_queries import _units

    found = chunks.build_chunks(structure.analyze(_units(spark, sf_dir)), Sizes(50, 70, 8)).orderBy("document_id", "chunk_index").collect()
    by = {}
    for r in found:
        assert 1 <= r["token_count"] <= 70 and r["token_count"] == len(r["content"].split())
        assert r["chunk_index"] == len(by.setdefault(r["document_id"], []))
        by[r["document_id"]].append(r)
    docs = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for d, rows in by.items():
        left = re.sub(r"\s", "", "".join(docs[d].split()))
        total = sum(r["token_count"] for r in rows)
        overlaps = sum(int(m["overlap_token_count"]) for r in rows for m in (r["element_metadata"] or []) if "is_overlap" in m)
        assert left and total - overlaps == len(docs[d].split())


def test_clean_pages(spark):
    def pages(heads, foot="x"):
        return [(h, f"{t}\nBody number {i} here.\n{foot} {i}") for h, group in heads.items() for i, t in enumerate(group)]

    rows = pages({"three": ["ACME 1", "Acme 2", "acme 3", "Other one", "More two"], "two": ["Head A", "Head A", "q w", "e r", "t z"], "few": ["Same", "Same"]})
    df = spark.createDataFrame(rows, "document_id string, text string")
    out = {}
    for r in margins.clean_pages(df).collect():
        out.setdefault(r[0], []).append(r[1])
    assert sum("cme" in t.lower() for t in out["three"]) == 0 and all("Body number" in t for t in out["three"])
    assert not any("\nx " in t for t in out["two"]) and sum(t.startswith("Head A") for t in out["two"]) == 2
    assert all(t.startswith("Same") for t in out["few"])
    with pytest.raises(ValueError):
        margins.clean_pages(df, ratio=0)


def test_validation_codes(spark):
    long = " ".join(["w"] * 701)
    ok = " ".join(["w"] * 30)
    rows = [
        ("a", "a", 0, ok, 30, "f", "b", "pdf", 1, 2), ("a", "b", 0, long, 701, "f", "b", "pdf", 2, 1), ("a", "a", 5, "few words", 2, "f", "b", "pdf", None, None),
        ("c", " ", -1, " ", -1, None, "", " ", 0, None), ("d", "d", 0, ok, 29, "f", "b", "pdf", 1, 1),
    ]
    df = spark.createDataFrame(rows, "pack string, document_id string, chunk_index int, content string, token_count int, file_name string, blob_name string, file_type string, page_start int, page_end int")
    expected = spark.createDataFrame([("a",), ("z",)], "pack string")
    found = validate.validate(df, "pack", expected=expected)
    codes = {(r["collection"], r["code"]) for r in found.collect()}
    assert codes == {
        ("a", "INCONSISTENT_DOCUMENT_IDS"), ("a", "DUPLICATE_CHUNK_INDEX"), ("a", "NON_SEQUENTIAL_CHUNK_INDEXES"), ("a", "CHUNK_EXCEEDS_MAX_TOKENS"), ("a", "INVALID_PAGE_RANGE"), ("a", "VERY_SMALL_CHUNK"),
        ("c", "EMPTY_DOCUMENT_ID"), ("c", "NEGATIVE_CHUNK_INDEX"), ("c", "NON_SEQUENTIAL_CHUNK_INDEXES"), ("c", "EMPTY_CHUNK_CONTENT"), ("c", "NEGATIVE_TOKEN_COUNT"), ("c", "MISSING_FILE_NAME"), ("c", "MISSING_BLOB_NAME"), ("c", "MISSING_FILE_TYPE"), ("c", "INVALID_PAGE_RANGE"),
        ("d", "TOKEN_COUNT_MISMATCH"), ("z", "EMPTY_CHUNK_COLLECTION"),
    }
    told = {r["collection"]: r for r in validate.summary(found).collect()}
    assert told["a"]["warnings"] == 1 and not told["d"]["is_valid"]
