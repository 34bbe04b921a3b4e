import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import chunks, long_documents, structure
from foliant.operators.chunks import Sizes
from foliant.plans.text_queries import _units


def made(spark, seed, documents, units, names):
    """Units with headings of all depths, also with the same title twice, marks without a letter, empty texts, gaps in the order and a null
    document."""
    rng, rows = random.Random(seed), []
    for d in range(documents):
        at = 0
        for _ in range(units if d else units * 4):
            at += rng.choice((1, 1, 1, 3))
            kind = rng.random()
            if kind < names:
                rows.append((None if d == 1 else f"d{d}", at, rng.choice(("Scope of it", "Aims of it", "Parts of it")), f"Heading {rng.choice((1, 2, 3, 10, 12))}"))
            else:
                text = "" if kind > 0.97 else "-- * --" if kind > 0.94 else " ".join(f"w{rng.randrange(99)}" + ("." if rng.random() < 0.2 else "") for _ in range(rng.choice((1, 5, 20, 120))))
                rows.append((None if d == 1 else f"d{d}", at, text, None))
    return spark.createDataFrame(rows, "document_id string, unit_ordinal int, text string, style string").withColumn("file_type", F.lit("docx"))


def same(one, other):
    rows = lambda df: sorted((repr(r) for r in df.select(*sorted(df.columns)).collect()))
    assert rows(one) == rows(other)


@pytest.mark.parametrize("block,fan", [(1, 8), (7, 3), (100_000, 64)])
def test_blocks_give_what_whole_documents_give(spark, monkeypatch, block, fan):
    monkeypatch.setattr(long_documents, "FAN", fan)
    units = long_documents.kept(made(spark, block, 3, 40, 0.2), "units")
    whole = structure.analyze(units)
    same(long_documents.analyze(units, block=block), whole)
    sizes = Sizes(30, 50, 8)
    same(long_documents.build_chunks(units, sizes, block=block), chunks.build_chunks(whole, sizes))


def test_documents_of_the_table(spark, sf_dir):
    units = _units(spark, sf_dir)
    same(long_documents.build_chunks(units, Sizes(50, 70, 8), block=3), chunks.build_chunks(structure.analyze(units), Sizes(50, 70, 8)))


def test_one_section_and_no_rows(spark):
    units = made(spark, 5, 3, 80, 0)
    same(long_documents.build_chunks(units, Sizes(30, 50, 8), block=10), chunks.build_chunks(structure.analyze(units), Sizes(30, 50, 8)))
    assert long_documents.build_chunks(units.where("false")).count() == 0 and long_documents.analyze(units.where("text = 'none'")).count() == 0
    with pytest.raises(ValueError):
        long_documents.analyze(units, block=0)
    with pytest.raises(ValueError):
        long_documents.build_chunks(units.withColumn("At", F.lit(1)))


def test_pieces_of_one_document_are_many_tasks(spark, monkeypatch):
    seen = []
    whole = long_documents.kept

    def watched(df, name):
        out = whole(df, name)
        if name == "pieces":
            seen.append(out)
        return out

    monkeypatch.setattr(long_documents, "kept", watched)
    rows = spark.range(4000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("unit_ordinal"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("Part of it "), "id")).otherwise("some words stand here.").alias("text"))
    units = rows.withColumns({"style": F.when(F.col("unit_ordinal") % 10 == 0, "Heading 1"), "file_type": F.lit("docx")})
    found = long_documents.build_chunks(units, block=100).orderBy("chunk_index").select("chunk_index", "section").collect()
    assert [tuple(r) for r in found] == [(i, f"Part of it {i * 10}") for i in range(400)]
    assert seen[0].select("piece").distinct().count() == 41


def test_prefix_over_levels(spark, monkeypatch):
    monkeypatch.setattr(long_documents, "FAN", 4)
    rng = random.Random(1)
    rows = [(k, at, None if rng.random() < 0.2 else rng.randrange(9)) for k in (None, "a", "b") for at in sorted(rng.sample(range(10**6, 10**6 + 900), 200))]
    df = spark.createDataFrame(rows, "k string, at long, state long").select(F.struct("k").alias("key"), "at", "state")
    found = {(r["key"]["k"], r["at"]): r["before"] for r in long_documents.ahead(df, long_documents._sum).collect()}
    assert found == {(k, at): sum(s or 0 for j, a, s in rows if j == k and a < at) for k, at, _ in rows}
