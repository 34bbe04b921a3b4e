import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from foliant.llm.mix import mix, mix_plan


def shares(sizes):
    """Water filling in fractions: {source: size} to {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = Fraction(total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in rest)) if rest else Fraction(0)
        above = {s for s in rest if level * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: Fraction(3 * sizes[s]) if s in full else level * weight[s] for s in order}
        full |= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_copies(make, odd):
    rows = odd + [(100 + i, "word " * (i % 7 + 1), f"src{i % 11}") for i in range(400)] + [(2000 + i, "ein Wort\x0bzwei " * 50, "Zhot") for i in range(200)] + [(3000, "", "nothing"), (3001, None, "nothing")]
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += size(t)
    want = shares(sizes)
    found = mix_plan(make(rows)).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        rate = float(want[r["source"]] / sizes[r["source"]]) if sizes[r["source"]] else 0
        assert r["copies"] in (int(rate + 1e-9), int(rate - 1e-9) + 1) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    assert sum(want.values()) == sum(sizes.values())
    assert taken["Zhot"] == pytest.approx(float(want["Zhot"]), rel=0.15)
    assert sorted(map(tuple, mix_plan(make(rows).repartition(7)).collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_mix_emits_the_plan(make, odd):
    df = make(odd)
    plan = defaultdict(int)
    for r in mix_plan(df).collect():
        plan[r["id"], r["size"]] += r["copies"]
    out = mix(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"], size(r["text"])] += 1
    assert got == {k: v for k, v in plan.items() if v}


def test_empty_and_wordless(make):
    assert mix_plan(make([])).collect() == [] and mix(make([])).collect() == []
    assert [r["copies"] for r in mix_plan(make([(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


def test_no_python_on_the_main_path(make, odd):
    plan = mix(make(odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bernoulli_is_even(make):
    rows = [(i, "w", "a") for i in range(3000)] + [(i, "w w", "b") for i in range(3000, 6000)]
    by = mix_plan(make(rows)).groupBy("source").agg(F.sum("copies").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    for r in by:
        assert r["n"] == pytest.approx(3000 * r["t"] / r["s"], rel=0.05)
