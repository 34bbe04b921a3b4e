import math
import random
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import jaccardjoin as jj
from foliant.llm.components import components

LAST = 1 << 63


def shingles(text, n=5):
    words = jj.WORD.findall(text or "")
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    ids = [LAST if r[0] is None else r[0] for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    first = defaultdict(lambda: LAST)
    for i in range(len(rows)):
        first[find(i)] = min(first[find(i)], ids[i])
    whole = lambda x: None if x == LAST else x
    return sorted(((r[0], whole(first[find(i)]), links[i]) for i, r in enumerate(rows)), key=repr)


def found(make, rows, **more):
    return sorted(map(tuple, jj.jaccard_join(make(rows), **more).collect()), key=repr)


def prose(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
    return words


def groups(rng, sizes):
    rows, n = [], 0
    for size in sizes:
        base = prose(rng, rng.randint(60, 200))
        for _ in range(size):
            rows.append((n, " ".join(edited(rng, base, rng.randint(0, 4)))))
            n += 1
    rng.shuffle(rows)
    return rows


def test_odd_rows(make, odd):
    rows = odd + [(30, "three words only"), (31, "three words  only"), (32, "three words"), (33, "a b c d e"), (34, "a b c d e")]
    assert found(make, rows) == brute(rows)


def test_empty(make):
    assert found(make, []) == [] and jj.keep_first(make([])).collect() == []
    assert found(make, [(1, None), (2, "")]) == [(1, 1, 0), (2, 2, 0)]


@pytest.mark.parametrize("block", [3, 2048])
def test_groups_in_blocks(make, block):
    rows = groups(random.Random(3), [1] * 30 + [2] * 10 + [25, 40])
    assert found(make, rows, block=block) == brute(rows)


def test_blocks_of_bounded_bytes(make, monkeypatch):
    """Long texts are dealt to more blocks than their number asks for; the result is the same."""
    rows = groups(random.Random(5), [1] * 5 + [12, 20])
    monkeypatch.setattr(jj, "BLOCK_BYTES", 4000)
    assert found(make, rows) == brute(rows)


def test_many_copies_and_near_copies(make):
    rng = random.Random(6)
    base = prose(rng, 150)
    rows = [(i, " ".join(base)) for i in range(150)] + [(1000 + i, " ".join(edited(rng, base, i % 5))) for i in range(200)] + groups(rng, [1] * 100)
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    assert found(make, rows) == brute(rows)


def test_a_passage_that_many_share(make):
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [(i, " ".join(passage + prose(rng, rng.choice([5, 10, 14, 15, 20, 40])))) for i in range(120)]
    assert found(make, rows, block=16) == brute(rows)


def test_keep_first(make, odd):
    df = make(odd)
    kept = jj.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((repr(r["doc_id"]), (r["text"] or "")[:20]) for r in kept.collect()) == sorted(
        (repr(i), (t or "")[:20]) for n, (i, t, *_) in enumerate(odd) if n not in (1, 2, 8, 9, 10)
    )  # 2 copies 1 twice, as does a row without an id; 8 has the parts of 7 in another order; 9 comes before its near copy without an id


def test_posterior():
    least = jj.least_matches(0.8, 1e-6)
    assert len(least) == jj.HASHES // jj.STEP and list(least) == sorted(least)
    for k, m in enumerate(least):
        n = (k + 1) * jj.STEP
        grid = np.linspace(0, 1, 200_001)
        density = grid**m * (1 - grid) ** (n - m)
        assert density[grid >= 0.8].sum() / density.sum() >= 0.99e-6
        if m:
            density = grid ** (m - 1) * (1 - grid) ** (n - m + 1)
            assert density[grid >= 0.8].sum() / density.sum() <= 1.01e-6


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(30)]
    i, j = (x.ravel() for x in np.indices((20, 10)))
    expected = [len(np.intersect1d(sets[a], sets[20 + b])) for a, b in zip(i, j)]
    assert jj.shared(sets[:20], sets[20:], i, j).tolist() == expected
    assert jj.shared(sets[:20], sets[20:], i[:5], j[:5]).tolist() == expected[:5]


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + rng.randint(1, 80)) for _ in range(60)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_pruning_loses_less_than_the_bands():
    """Probability that a pair of similarity 0.8 fails at one of the looks, and that no band has it."""
    left, lost = np.ones(1), 0.0
    one = np.array([math.comb(jj.STEP, k) * 0.8**k * 0.2 ** (jj.STEP - k) for k in range(jj.STEP + 1)])
    for least in jj.least_matches():
        left = np.convolve(left, one)
        lost += left[:least].sum()
        left[:least] = 0
    assert lost < 1e-3 * (1 - 0.8**jj.ROWS) ** jj.BANDS
