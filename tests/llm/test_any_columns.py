"""Operators and pipeline stages on ids of other types, on columns of any name, and on nulls, repeated rows and empty tables."""

import time

import pytest

from foliant.llm import bpe, exactdedup, jaccardjoin, langid, linededup, mix, quality, tokencount
from foliant.llm.queries import tokenizer

from .test_dedup import exact, lines, same
from .test_near_duplicates import brute

ODD = "`my col` string, `a.b` int, `row` string, `key` string, `doc` int, `of` string, `n` int, `id` string, `order` int, `batch` int, kept boolean, `x``y` array<struct<`p q`:int>>"
OTHERS = ("m", 1, "r", "k", 2, "o", 3, "i", 4, 5, True, [(7,)])


def table(spark, rows, kind="long"):
    """rows: (id, text, source)."""
    whole = [(i, t, "en", s, len(t or ""), *OTHERS) for i, t, s in rows]
    return spark.createDataFrame(whole, f"doc_id {kind}, text string, lang string, source string, n_chars long, {ODD}")


PROSE = " ".join(f"w{i * 7919 % 1000}" for i in range(80))
ROWS = [("9", PROSE, "a"), ("10", PROSE + "\nA line of two documents", "b"), ("b", "a line of TWO documents \nown " + PROSE[:200], "a"), (None, PROSE, None), (None, None, "a"), ("c", "", None), ("b", "a line of TWO documents \nown " + PROSE[:200], "a")]


def by_rank(rows):
    """Ids as numbers in their order, for the brute-force versions, and back."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    rank = {x: n for n, x in enumerate(ids)} | {None: None}
    return [(rank[i], *rest) for i, *rest in rows], {n: x for x, n in rank.items()}


KINDS = {"string": lambda x: x, "long": lambda x: x and (1 << 63) - 1 - ord(x[0])}


@pytest.mark.parametrize("kind", list(KINDS))
def test_ids_of_any_type(spark, kind):
    rows = [(KINDS[kind](i), t, s) for i, t, s in ROWS]
    numbered, back = by_rank(rows)
    df = table(spark, rows, kind)
    assert dict(df.dtypes)["doc_id"] == ("bigint" if kind == "long" else kind)
    same(exactdedup.exact_dedup(df, n_batches=2).collect(), [(back[i], back[k], *rest) for i, k, *rest in exact(numbered)])
    same(linededup.line_dedup(df, n_batches=2).collect(), [(back[i], *rest) for i, *rest in lines(numbered)])
    same(jaccardjoin.jaccard_join(df).collect(), [(back[i], back[c], n) for i, c, n in brute(numbered)])
    assert jaccardjoin.keep_first(df).schema == df.schema


def test_columns_of_any_name(spark):
    df = table(spark, ROWS, "string")
    found = {}
    for name, run in {"good": quality.keep_good, "lines": linededup.drop_lines, "first": jaccardjoin.keep_first, "mix": mix.mix}.items():
        out = run(df)
        rows = found[name] = out.collect()
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        assert rows and all(r["a.b"] == 1 and r["my col"] == "m" and r["x`y"] == [(7,)] for r in rows)
        none = run(df.where("false"))
        assert none.collect() == [] and none.columns == df.columns
    kept, cut, firsts = (found[f] for f in ("good", "lines", "first"))
    assert {r["doc_id"] for r in kept} == {"9", "10", None}
    assert sorted(r["text"] for r in cut) == sorted(e[1] for e in lines(by_rank(ROWS)[0]))
    assert len([r for r in firsts if not r["text"]]) == 2


def test_named_columns_of_any_name(spark):
    name = "my `id`.a b"
    df = table(spark, ROWS, "string").drop("my col", "a.b", "x`y").withColumnsRenamed({"doc_id": name, "text": "the.text", "source": "from where"})
    words, pieces = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")
    model = langid.train(df, pieces, name, "the.text", rounds=1)
    unigram = tokencount.fit(df, pieces, "the.text", rounds=1)
    runs = {
        "bpe": lambda x: bpe.bpe_encode(x, words, name, "the.text"), "exact": lambda x: exactdedup.exact_dedup(x, name, "the.text"), "lines": lambda x: linededup.line_dedup(x, name, "the.text"),
        "lang": lambda x: langid.identify(x, model, name, "the.text"), "tokens": lambda x: tokencount.token_counts(x, unigram, name, "the.text"), "quality": lambda x: quality.quality(x, name, "the.text"),
        "jaccard": lambda x: jaccardjoin.jaccard_join(x, name, "the.text"),
    }
    for run in runs.values():
        out = run(df)
        assert out.columns[0] == name and sorted(repr(r[0]) for r in out.collect()) == sorted(repr(r[0]) for r in ROWS)
    assert mix.mix_plan(df, name, "the.text", "from where").count() == len(ROWS)
    for run in (lambda x: mix.mix(x, name, "the.text", "from where"), lambda x: linededup.drop_lines(x, name, "the.text"), lambda x: jaccardjoin.keep_first(x, name, "the.text"), lambda x: quality.keep_good(x, "the.text")):
        out = run(df)
        assert out.columns == df.columns and out.count() > 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Each stage takes nulls, repeated rows and odd names, and hands the columns on; the last has a row for each row that it gets."""
    import corpus_pipeline as cp

    blank = [(None, None, "a"), (12, "", None)]
    rows = [(9, PROSE, "a"), (10, PROSE + "\nA line of two documents", "b"), (11, "a line of TWO documents \nown " + PROSE, "a"), (None, PROSE, None), (None, None, "a"), (12, "", None), (11, "a line of TWO documents \nown " + PROSE, "a")]
    for rows in (rows, blank):
        docs = table(spark, rows)
        for n, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, "")
            if n < len(cp.STAGES) - 1:
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            assert out.count() <= 3 * len(rows)


def test_long_lines_of_white_space(spark):
    """The time to strip a line grows with its length, not with the square of it."""
    text = "x" + " " * 1_000_000 + "y\n" + "\t" * 1_000_000 + "end of it all\nEND OF IT ALL"
    df = spark.createDataFrame([(1, "END of it all"), (2, text)], "doc_id long, text string")
    before = time.time()
    found = {r["doc_id"]: r["n_dropped"] for r in linededup.line_dedup(df, n_batches=1).collect()}
    assert found == {1: 0, 2: 2} and time.time() - before < 20
    from pyspark.sql import functions as F

    one = spark.range(1).select(F.concat(F.lit("x"), F.repeat(F.lit(" "), 1_000_000), F.lit("y")).alias("line"))
    before = time.time()
    assert one.select(F.length(linededup.line_key(F.col("line")))).first()[0] == 1_000_002 and time.time() - before < 2
