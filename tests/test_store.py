"""The store: runs, merging, buckets that split, one commit for several tables, constraints, filters."""

import time

import pytest
from pyspark.sql import functions as F

from foliant.sources.store import Change, Refused, Store, Table

PLAIN = {"t": Table("k int, v string", ("k",))}


@pytest.fixture
def make(spark, tmp_path):
    return lambda tables=PLAIN, **how: Store(spark, str(tmp_path / "store"), tables, **how)


def files(tmp_path):
    return {str(p): p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet")}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, v string")


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "k int")


def held(store, table="t"):
    return {r["k"]: r["v"] for r in store.read(table).collect()}


def test_a_change_writes_what_changes(spark, make, tmp_path):
    """Bytes written are in proportion to the change, not to the store."""
    store = make(bucket_rows=500)
    store.write("t", spark.range(20_000).selectExpr("cast(id as int) k", "repeat(md5(cast(id as string)), 5) v"))
    before = files(tmp_path)
    base = store.state().runs["t"][0]
    assert base["bits"] == 6 and len(base["buckets"]) == 64
    some = keys(spark, 3, 500, 99_999)
    store.update("t", some, lambda old: rows(spark, (3, "new"), (99_999, "new")))
    after = files(tmp_path)
    assert all(after[p] == n for p, n in before.items()) and sum(after.values()) - sum(before.values()) < 0.01 * sum(before.values())
    found = held(store)
    assert len(found) == 20_000 and found[3] == found[99_999] == "new" and 500 not in found
    assert store.read("t", keys=keys(spark, 3, 4)).count() == 2 and store.read("t", version=1).where("v = 'new'").count() == 0
    plan = store.read("t", keys=keys(spark, 4)).inputFiles()
    assert len(plan) < 10  # one bucket of the base, and the small run


def test_runs_merge_and_buckets_split(spark, make):
    store = make(bucket_rows=100, fanout=3, level_rows=100)
    want = {}
    for i in range(9):
        new = {k: f"{i}" for k in range(i * 30, i * 30 + 60)}
        gone = {i * 30 + 1}
        want = {k: v for k, v in want.items() if k not in new} | {k: v for k, v in new.items() if k not in gone}
        store.update("t", keys(spark, *new), lambda old, new=new, gone=gone: rows(spark, *((k, v) for k, v in new.items() if k not in gone)))
        runs = store.state().runs["t"]
        assert len(runs) <= 6
        assert [store._level(r) for r in runs] == sorted((store._level(r) for r in runs), reverse=True)
    assert held(store) == want
    assert max(r["bits"] for r in store.state().runs["t"]) >= 2 and store.read("t", keys=keys(spark, 8 * 30 + 2)).first()["v"] == "8"


def test_the_change_is_judged_against_what_others_did(spark, make):
    store = make(keep=9)
    store.write("t", spark.range(200).selectExpr("cast(id as int) k", "'old' v"))
    calls = []

    def slow(old):
        if not calls:  # while this one works, others change another row, and the same one
            store.update("t", keys(spark, 7), lambda old: rows(spark, (7, "theirs")))
            store.update("t", keys(spark, 1), lambda old: old.selectExpr("k", "concat(v, '+') v"))
        calls.append(1)
        return old.selectExpr("k", "concat(v, '!') v")

    store.update("t", keys(spark, 1), slow)
    found = held(store)
    assert found[1] == "old+!" and found[7] == "theirs" and len(found) == 200 and len(calls) == 2
    with pytest.raises(Refused):
        store.update("t", keys(spark, 1), lambda old: rows(spark, (2, "not asked for")))
    assert held(store) == found


TWO = {
    "parents": Table("id int, name string, state string", ("name",), filters=("state",), unique=(("id",), ("name",)), rules=lambda: {"state": F.col("state").isin("new", "done")}, cascades=(("children", "parent"),)),
    "children": Table("parent int, n int, v string", ("parent",), unique=(("parent", "n"),), references=(("parent", "parents", "id"),)),
}


def parents(spark, *found):
    return spark.createDataFrame(list(found), "id int, name string, state string")


def children(spark, *found):
    return spark.createDataFrame(list(found), "parent int, n int, v string")


def replace(spark, table, new, owner):
    return Change(table, new.select(owner).distinct(), lambda old: new)


def everything(store):
    return {t: sorted(map(tuple, store.read(t).collect())) for t in TWO}


def test_all_or_nothing(spark, make, tmp_path):
    """A writer that dies between two tables leaves the state before; its folders are told by its intent and deleted."""
    store = make(TWO)
    store.apply([replace(spark, "parents", parents(spark, (1, "a", "new")), "name"), replace(spark, "children", children(spark, (1, 0, "x")), "parent")])
    before = everything(store)
    assert before == {"parents": [(1, "a", "new")], "children": [(1, 0, "x")]} and store.versions() == [1]
    changes = [replace(spark, "parents", parents(spark, (1, "a", "done")), "name"), replace(spark, "children", children(spark, (1, 0, "y"), (1, 1, "z")), "parent")]

    class Killed(BaseException):
        pass

    def die():
        store._drop = lambda *a: None  # nothing is tidied up by a process that is gone
        raise Killed

    n = len(files(tmp_path))
    with pytest.raises(Killed):
        store.apply(changes, prepared=die)
    store = make(TWO)
    assert everything(store) == before and len(files(tmp_path)) > n
    assert store.recover(older_than=3600) == [] and len(store.recover(older_than=0)) == 2 and len(files(tmp_path)) == n
    store.apply(changes)
    assert everything(store) == {"parents": [(1, "a", "done")], "children": [(1, 0, "y"), (1, 1, "z")]} and store._names(f"{store.path}/intents") == []


def test_constraints_hold(spark, make, tmp_path):
    store = make(TWO, bucket_rows=10)
    store.write("parents", parents(spark, *((i, f"p{i}", "new") for i in range(100))))
    store.apply([replace(spark, "children", children(spark, *((i, n, "v") for i in range(100) for n in range(2))), "parent")])
    before, n = everything(store), len(files(tmp_path))
    bad = {
        "rules": replace(spark, "parents", parents(spark, (200, "q", "odd")), "name"),
        "not unique: id": replace(spark, "parents", parents(spark, (200, "q", "new"), (200, "r", "new")), "name"),
        "not unique: name": replace(spark, "parents", parents(spark, (200, "q", "new"), (201, "q", "new")), "name"),
        "there already: id": replace(spark, "parents", parents(spark, (5, "another name", "new")), "name"),
        "not unique: parent, n": replace(spark, "children", children(spark, (1, 0, "x"), (1, 0, "y")), "parent"),
        "names nothing in parents": replace(spark, "children", children(spark, (1, 0, "x"), (555, 0, "orphan")), "parent"),
    }
    for message, change in bad.items():
        with pytest.raises(Refused, match=message):
            store.apply([change])
        assert everything(store) == before and len(files(tmp_path)) == n
    # Nulls break nothing, a row may keep its own id, and a child may come with its parent.
    store.apply([replace(spark, "parents", parents(spark, (5, "p5", None), (None, "x", None), (300, "y", "done")), "name"), replace(spark, "children", children(spark, (300, 0, "x")), "parent")])
    assert store.read("parents", keys=parents(spark, (0, "p5", ""))).first()["state"] is None and store.read("children").count() == 201


def test_children_go_with_their_parents(spark, make):
    store = make(TWO)
    store.apply([replace(spark, "parents", parents(spark, (1, "a", "new"), (2, "b", "new")), "name"), replace(spark, "children", children(spark, (1, 0, "x"), (2, 0, "y")), "parent")])
    version = store.versions()[-1]
    store.apply([Change("parents", parents(spark, (0, "a", "")).select("name"), lambda old: old.where("false"))])
    assert everything(store) == {"parents": [(2, "b", "new")], "children": [(2, 0, "y")]} and store.versions()[-1] == version + 1


def test_values_are_looked_up_by_filters(spark, make):
    """Only the buckets whose filter may have the value are read."""
    store = make(TWO, bucket_rows=64)
    store.write("parents", parents(spark, *((i, f"p{i}", "done" if i == 77 else "new") for i in range(1000))))
    store.apply([replace(spark, "parents", parents(spark, (2000, "later", "done")), "name")])
    found = store.read("parents", where={"state": "done"})
    assert {r["id"] for r in found.collect()} == {77, 2000} and len(found.inputFiles()) < len(store.read("parents").inputFiles()) / 3
    one = store.read("parents", where={"id": 500})
    assert one.first()["name"] == "p500" and len(one.inputFiles()) <= 3
    assert store.read("parents", where={"id": 500, "state": "done"}).collect() == [] and store.read("parents", where={"state": "none such"}).collect() == []


def test_ranges_are_looked_up_by_their_ends(spark, make):
    """Runs and buckets whose least and greatest values leave no room for a range aren't read."""
    store = make({"t": Table("k int, day timestamp, size double", ("k",), ranges=("day", "size"))}, bucket_rows=50, fanout=9)
    rows = spark.range(600).selectExpr("cast(id as int) k", "timestamp'2024-01-01' + make_dt_interval(cast(id div 100 as int)) day", "if(id % 7 = 0, null, id / 10) size")
    for i in range(6):
        some = rows.where(f"k div 100 = {i}")
        store.update("t", some.select("k"), lambda _, some=some: some)
    found = store.read("t", where={"day": ("2024-01-03 00:00:00", "2024-01-04 00:00:00")})
    assert sorted(r["k"] for r in found.collect()) == list(range(200, 400)) and len(found.inputFiles()) <= len(store.read("t").inputFiles()) / 2
    assert sorted(r["k"] for r in store.read("t", where={"size": (12.35, 12.95)}).collect()) == [k for k in range(124, 130) if k % 7]
    assert store.read("t", where={"day": ("2025-01-01", "2026-01-01")}).collect() == [] and store.read("t", where={"day": ("2024-01-01", "2024-01-01"), "size": (0.0, 0.2)}).count() == 2


def test_rows_by_word_and_by_document(spark, make):
    """A table whose rows lie by one column and are replaced by another: an index of words."""
    store = make({"words": Table("word string, doc int", ("word",), owner=("doc",))}, bucket_rows=50, fanout=3, level_rows=50)
    want = {}
    for i in range(5):
        docs = {d: [f"w{(d * 7 + i * j) % 40}" for j in range(9)] for d in range(i * 4, i * 4 + 8)}
        want |= docs
        new = spark.createDataFrame([(w, d) for d, ws in docs.items() for w in ws], "word string, doc int")
        store.apply([Change("words", new.select("doc").distinct(), lambda old, new=new: new)])
    for word in ("w0", "w7", "none"):
        found = store.read("words", keys=spark.createDataFrame([(word,)], "word string"))
        assert sorted(r["doc"] for r in found.collect()) == sorted(d for d, ws in want.items() for w in ws if w == word)


def test_a_table_without_rows(spark, make):
    store = make()
    assert store.read("t").collect() == [] and store.read("t", keys=keys(spark, 1)).collect() == [] and store.versions() == []
    store.update("t", keys(spark, 1), lambda old: old)
    assert held(store) == {} and time.time() > 0
