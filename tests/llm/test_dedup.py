"""Exact dedup, line dedup and the index of runs, against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm.exactdedup import exact_dedup
from foliant.llm.linededup import drop_lines, line_dedup
from foliant.llm.runs import Runs

LAST = 1 << 63
SPACES = " \t\n\x0b\x0c\r"


def order(i):
    return LAST if i is None else i


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    out = []
    for (i, *_), n in zip(rows, norm):
        group = [order(r[0]) for r, m in zip(rows, norm) if m == n]
        keep = min(group)
        out.append((i, None if keep == LAST else keep, len(group), order(i) == keep, sha(n)))
    return out


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def lines(rows):
    first = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(order(i), first.get(key(x), LAST))
    out = []
    for i, t, *_ in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((i, "\n".join(kept), len(whole), len(whole) - len(kept), sha("\n".join(kept))))
    return out


def same(found, expected):
    low = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert low(found) == low(expected)


@pytest.mark.parametrize("n", [1, 4])
def test_exact_dedup(make, odd, n):
    same(exact_dedup(make(odd), n_batches=n).collect(), exact(odd))


def test_exact_dedup_of_a_hot_group(make):
    rows = [(i, "same  text" if i % 3 else f"text {i}") for i in range(600)]
    random.Random(1).shuffle(rows)
    same(exact_dedup(make(rows), n_batches=5, fanout=2).collect(), exact(rows))


def test_empty_tables(make):
    for run in (exact_dedup, line_dedup, drop_lines):
        assert run(make([])).collect() == []


@pytest.mark.parametrize("n", [1, 4])
def test_line_dedup(make, odd, n):
    same(line_dedup(make(odd), n_batches=n).collect(), lines(odd))


def test_lines_in_many_documents(make):
    rng = random.Random(2)
    pool = ["A common line here", "  a COMMON line here\t", "short", "ÄÖÜ is kept as is", "äöü is kept as is", "", "line with\x0btab inside", "x" * 10, "y" * 9, "ends oddly \u2028", "ends oddly\u2028", "\x85 ends oddly \x85"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own line of {i} {rng.random()}"] * 3) for _ in range(rng.randint(1, 8)))) for i in rng.sample(range(1000), 120)]
    rows += [(rows[0][0], "A common line here\nA common line here\nnew"), (5000, "\r\n\n a common line here \r\n")]
    same(line_dedup(make(rows), n_batches=6, fanout=2).collect(), lines(rows))


def test_drop_lines_keeps_all_columns(make, odd):
    df = make(odd)
    found = drop_lines(df)
    assert found.columns == df.columns
    same([(r["doc_id"], r["text"], r["source"], r["__row"]) for r in found.collect()], [(e[0], e[1], r[2], "r") for e, r in zip(lines(odd), odd)])


def test_runs_levels_and_reopening(spark):
    rng, seen = random.Random(4), {}
    index = Runs(spark, fanout=2, buckets=3)
    for n in range(7):
        batch = {(rng.randint(0, 40), 0): n for _ in range(15)}
        fresh = {k for k in batch if k not in seen}
        df = spark.createDataFrame([(*k, v) for k, v in batch.items()], "h1 long, h2 long, v int")
        assert {(r["h1"], r["h2"]) for r in index.new(df).collect()} == fresh
        index.add(df)
        seen |= {k: batch[k] for k in fresh}
        assert all(len(level) <= 2 for level in index.levels)
    assert {(r["h1"], r["h2"]): r["v"] for r in index.all().collect()} == seen and index.all().count() == len(seen)
    assert len(index.levels) == 3
    for t in index.tables():
        spark.sql(f"DROP TABLE {t}")  # as in a new session
    again = Runs(spark, index.path)
    assert again.levels == index.levels and again.buckets == 3
    assert again.new(spark.createDataFrame([(*next(iter(seen)), 1), (99, 99, 1)], "h1 long, h2 long, v int")).count() == 1


def test_new_rows_against_a_digest_index(make, spark, tmp_path):
    from foliant.llm.exactdedup import add, digests

    at = f"file://{tmp_path}/index"
    add(Runs(spark, at, buckets=2), digests(make([(1, "a b"), (2, "c")])))
    add(Runs(spark, at), digests(make([(3, "a  b"), (4, "d"), (5, "d")])))
    again = Runs(spark, at)
    assert sorted(r["keep_order"] for r in again.all().collect()) == [1, 2, 4] and len(again.tables()) == 2


def test_an_index_that_stays(make, spark, tmp_path):
    """What comes later is held against what came before, for texts and for lines; a second run over the same rows changes nothing."""
    at, old, new = f"file://{tmp_path}", [(1, "a b"), (2, "a  b"), (3, "one line of text\nown 3")], [(4, "a b"), (5, "new"), (6, "ONE line of text\nown 6")]
    for _ in range(2):
        first = exact_dedup(make(old), n_batches=1, path=f"{at}/texts", buckets=2).collect()
        assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in first} == {1: (1, True), 2: (1, False), 3: (3, True)}
    later = exact_dedup(make(new), n_batches=2, path=f"{at}/texts").collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in later} == {4: (1, 1, False), 5: (5, 1, True), 6: (6, 1, True)}
    assert {r["n_dropped"] for r in line_dedup(make(old), n_batches=1, path=f"{at}/lines", buckets=2).collect()} == {0}
    assert {r["doc_id"]: r["kept_text"] for r in line_dedup(make(new), n_batches=1, path=f"{at}/lines").collect()} == {4: "a b", 5: "new", 6: "own 6"}
    index = Runs(spark, f"{at}/texts")
    before = {tuple(r) for r in index.all().collect()}
    index.rebucket(5)
    again = Runs(spark, f"{at}/texts")
    assert again.buckets == 5 and len(again.tables()) == 1 and {tuple(r) for r in again.all().collect()} == before


def test_the_runs_are_joined_without_a_shuffle(spark):
    index = Runs(spark, fanout=4, buckets=3)
    one = spark.range(100).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    index.add(one)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.new(one.repartition(3, "h1", "h2"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
