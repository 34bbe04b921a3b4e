"""Phrase mining against counting every phrase, with proposals that are good, bad and missing."""

import random
import re
from collections import Counter, defaultdict

import pytest

from foliant.llm import phrases

SCHEMA = "text string, lang string, phrase string, k int, `a b` int"


def brute(rows, least=10, longest=3, within=50, top=2000):
    """By exact counts of all phrases."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p for q, b in many.items() for p, a in many.items() if 1 < len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= within * a}
        kept = []
        for p, a in many.items():
            score, cut = min(((10**6 * a * a) // (c[p[:i]] * c[p[i:]]), i) for i in range(1, len(p)))
            if p not in gone:
                kept.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows(seed=3, n=300):
    rng = random.Random(seed)
    words = ["new", "york", "City", "the", "of", "in", "größe", "l'eau", "x\x00y", "naïve", "a/b", "ſ", "zz\x1cq"]
    out = []
    for _ in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  ", "\x0b", "!?"]) for _ in range(rng.randint(0, 40)))
        out.append((text, rng.choice(["en", "en", "de", "", None, "und"])))
    return out + [("New York City hall", "en")] * 12 + [("of of of of of of of of of of of of", "fr"), (None, "en"), (None, None), ("", "xx"), ("big data " * 3000, "long")]


def table(spark, some):
    return spark.createDataFrame([(t, lang, "p", 1, 2) for t, lang in some], SCHEMA)


def found(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def test_by_brute_force(spark):
    some = rows()
    assert found(table(spark, some)) == brute(some)


def test_sample_never_decides(spark, monkeypatch):
    """No sample, a tiny one, and bitmaps so small that they say yes to nearly everything: the result is the same. Border failures
    make further passes."""
    some, passes = rows(5, 150), []
    inner = phrases.counts
    monkeypatch.setattr(phrases, "counts", lambda *a: passes.append(len(a[1])) or inner(*a))
    want = brute(some, top=40)
    for how in ({"share": 0.0}, {"share": 0.02}, {"share": 1.0}):
        passes.clear()
        assert found(table(spark, some), top=40, **how) == want
        assert passes[:3] == [1, 1, 1] and (2 in passes) == (how["share"] < 1) and max(passes) <= 2
    monkeypatch.setattr(phrases, "PART", 50)
    assert found(table(spark, some), top=40, share=0.1) == want


def test_longer_phrases(spark):
    some = rows(8, 120)
    assert found(table(spark, some), longest=5, least=4, within=80) == brute(some, 4, 5, 80)
    assert found(table(spark, some), longest=2) == brute(some, longest=2)


def test_small_bitmaps_are_enough():
    """What a bitmap wrongly says yes to is counted, never lost; a full one lets everything through."""
    import numpy as np

    full = phrases.Proposals({1: np.full(4096, 255, np.uint8)})
    assert full.has(1, np.arange(100, dtype=np.uint64)).all()
    one = np.zeros(4096, np.uint8)
    one[1] = 4
    assert [i for i in range(64) if phrases.Proposals({1: one}).has(1, np.array([i], np.uint64))[0]] == [10]


def test_counts_beyond_64_bits(spark):
    """1000000 * a * a and l * r pass 64 bits."""
    big = 4_000_000_000
    mined = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big + 3), ("en", "a b", 2, big)], "lang string, phrase string, k int, f long")
    r = phrases.score(mined).first()
    assert r["score"] == 10**6 * big * big // ((big + 1) * (big + 3))


@pytest.mark.parametrize("some", [[], [(None, None)], [("", "en"), ("...", "en")]])
def test_nothing(spark, some):
    assert found(table(spark, some)) == []
