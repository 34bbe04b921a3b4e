"""The queries and the pipeline: against SQL where there is any, else against brute force over the smallest tables."""

import duckdb
import pytest

from foliant.llm import quality
from foliant.llm.queries import QUERIES, SQL

from .test_dedup import lines
from .test_near_duplicates import brute
from .test_text_models import counted

COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_mix": "doc_id size source_size target taken", "op3_line_dedup": "doc_id n_lines n_dropped kept_sha256", "op4_language": "doc_id held_out lang_pred score",
    "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op6_main_text": "page_id url text n_chars", "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_jaccard_join": "doc_id class_id n_links", "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op11_phrases": "lang rank phrase a l r n score", "op12_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op13_search": "item_id rank doc_id score",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns_and_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    rows = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "op11_phrases":
        assert 0 < df.count() <= 2000 * rows("documents").select("lang").distinct().count()
    elif name == "op12_chat":
        assert df.count() == rows("conversations").select("conv_id").distinct().count() + 1
    elif name == "op13_search":
        assert 0 < df.count() <= 10 * rows("benchmark").count()
    else:
        assert df.count() == rows("pages" if name in ("op6_main_text", "op10_warc") else "documents").count()


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, cur.fetchall()))


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_jaccard_join(spark, sf_dir):
    found = QUERIES["op9_jaccard_join"](spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=repr) == brute(documents(spark, sf_dir))


def test_main_text(spark, sf_dir):
    """The pages' articles, cut out by their tags."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op6_main_text"](spark, sf_dir).collect():
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split()) and r["n_chars"] == len(r["text"])


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for n, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        assert n == len(cp.STAGES) - 1 or (out.columns == columns and dict(out.dtypes) == dict(docs.dtypes))
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        seen.append([r.asDict() for r in docs.collect()])
    raw = documents(spark, sf_dir)
    bands = _fitted(spark, sf_dir)
    good = [(i, t) for i, t in raw if _kept(t, bands)]
    assert sorted(r["doc_id"] for r in seen[0]) == sorted(i for i, _ in good)
    cut = [(e[0], e[1]) for e in lines(good)]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in seen[1]) == sorted((i, t, len(t)) for i, t in cut)
    firsts = sorted(i for i, c, _ in brute(cut) if i == c)
    assert sorted(r["doc_id"] for r in seen[2]) == firsts
    assert {r["doc_id"] for r in seen[3]} <= set(firsts)
    assert sorted(r["doc_id"] for r in seen[4]) == sorted(r["doc_id"] for r in seen[3])
    assert sorted(map(repr, (sorted(r.items()) for r in seen[4]))) == sorted(repr(sorted(r.asDict().items())) for r in cp.run(spark, sf_dir).collect())


def _fitted(spark, sf_dir):
    """The limits that the query fits from labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(quality.F.col("doc_id").alias("id"), "text")
    return quality.fit(quality.measured(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]


def _kept(text, bands):
    """The verdict by hand: base rules, then the ratio of the whole and of each 4096 bytes, the last of them at the end of the text."""
    import zstandard

    text = text or ""
    n_words, *_, again = counted(text)
    if n_words < 50 or 2 * again > n_words:
        return False
    raw = text.encode()
    bands = bands.many if 2 * len(raw) > 3 * len(text) else bands
    ratio = lambda part: len(part) / len(zstandard.compress(part, 3))
    at = sum(len(raw) > limit for limit in quality.UP_TO)
    if not bands.low[at] <= ratio(raw) <= bands.high[at]:
        return False
    parts = [raw[start : start + 4096] if start + 4096 <= len(raw) else raw[-4096:] for start in range(0, len(raw), 4096)] if len(raw) > 4096 else []
    return all(bands.chunk_low <= ratio(p) <= bands.chunk_high for p in parts)


def test_quality(spark, sf_dir):
    """Counts and verdict of each document, both by hand."""
    texts, bands = dict(documents(spark, sf_dir)), _fitted(spark, sf_dir)
    for r in QUERIES["op8_quality"](spark, sf_dir).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == _kept(texts[r["doc_id"]], bands)


def test_quality_keeps_good_documents(spark, sf_dir):
    """Of the labelled good documents, held-out ones too, the bands reject none that pass the base rules."""
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    found = QUERIES["op8_quality"](spark, sf_dir.replace("0.001", "0.01")).join(labels, "doc_id").where("quality = 1").select("base_failed", "kept").collect()
    assert len(found) > 100 and all(r["kept"] != r["base_failed"] for r in found)
