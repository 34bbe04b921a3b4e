"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from foliant.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    sets = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in sets), sum(sum(c.values()) for _, c in sets)
    df = Counter(w for _, c in sets for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in sets:
            if c:
                m = 25 + 75 * sum(c.values()) * n_docs // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
                if s > 0:
                    scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["Über", "naïve", "x9", "a_b", "ſ", "日本"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    same = "copies of one text w1 w2 w3 rare"
    docs += [(1000 + i, same) for i in range(200)] + [(2000 - i, same.upper() + " more") for i in range(5)]
    docs += [(3000, None), (3001, ""), (3002, " .,- "), (None, same), (3003, "w5 " * 5000), (5, "the id five again rare")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(25)] + [(100, same), (101, None), (102, ""), (103, "nothing-of-that"), (104, "w1 w1 w1"), (104, "rare"), (105, same), (100, same)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, h1 int, rank int")
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, `doc id` string")


def found(*frames, **how):
    return sorted((tuple(r) for r in ranked.ranked_search(*frames, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_by_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert found(*frames(spark, docs, items)) == want
    # Small shards and blocks, so that bounds decide, and queries in several passes.
    assert found(*frames(spark, docs, items), most=50, block=4) == want
    assert found(*frames(spark, docs, items), query_bytes=800, k=3) == brute(docs, items, 3)


def test_ids_that_are_texts(spark):
    docs, items = corpus(2, 60)
    docs = [(None if i is None else f"{i:05d}", t) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    want = sorted(((item, rank, i, s) for item, rank, i, s in brute([(None if i is None else int(i), t) for i, t in docs], items)), key=repr)
    assert sorted(((a, r, None if i is None else int(i), s) for a, r, i, s in found(d, frames(spark, [], items)[1])), key=repr) == want


def test_nothing(spark):
    d, items = frames(spark, [], [(1, "word")])
    assert found(d, items) == [] and found(frames(spark, [(1, "word")], [])[0], frames(spark, [], [])[1]) == []
    assert found(*frames(spark, [(1, None)], [(1, "word")])) == []
    # A term that every document has may weigh nothing, and then finds nothing.
    assert found(*frames(spark, [(i, "word") for i in range(2000)], [(1, "word")])) == brute([(i, "word") for i in range(2000)], [(1, "word")])


def parts(n=600, n_terms=80, groups=6, block=16):
    """A shard of documents of `groups` subjects."""
    rng = np.random.default_rng(3)
    lists = [np.unique(np.concatenate([rng.integers(0, 8, 3), 8 + (i % groups) * 12 + rng.integers(0, 12, 6)])) for i in range(n)]
    starts, found = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)
    gains, weights = rng.integers(1, 10**6, len(found)), rng.integers(1, 9000, n_terms)
    ids, *columns = ranked.shard(pa.array(range(n)), starts, found, gains, weights, block)
    return ranked.packed(ids, columns), starts, found, gains, weights


def test_blocks_and_summaries():
    """Each list holds its documents once, in blocks of bounded size, and a summary is the exact maximum over its block, of its own
    term and lighter ones."""
    batch, starts, found, gains, weights = parts()
    place = ranked.placed(weights)
    part, terms_of = ranked.Shard(batch, 0, 80), ranked.unpacked(batch, 0)["block_term"]
    own = [dict(zip(found[a:b], gains[a:b])) for a, b in zip(starts, starts[1:])]
    listed = {}
    for b, t in enumerate(terms_of):
        docs = part.members[part.first[b] : part.first[b + 1]].tolist()
        assert 0 < len(docs) <= 32
        listed.setdefault(t, []).extend(docs)
        most = Counter()
        for d in docs:
            for u, g in own[d].items():
                if place[u] >= place[t]:
                    most[u] = max(most[u], g)
        at = slice(part.entries[b], part.entries[b + 1])
        assert dict(zip(part.sum_terms[at].tolist(), part.sum_gains[at].tolist())) == dict(most)
    assert {t: sorted(d) for t, d in listed.items()} == {t: [i for i, o in enumerate(own) if t in o] for t in {*found.tolist()}}


def test_bounds_skip_blocks():
    """Blocks whose bound is too low aren't scored, and the result is that of scoring all."""
    batch, starts, found, gains, weights = parts()
    part, scored, skipped = ranked.Shard(batch, 0, 80), 0, 0
    for g in range(6):
        query = np.array(sorted(range(8 + g * 12, 8 + g * 12 + 7), key=ranked.placed(weights).__getitem__))
        dense = np.zeros(80, np.int64)
        dense[query] = weights[query]
        best = ranked.Best(10)
        a, b = part.search(query, dense, best)
        scored, skipped = scored + a, skipped + b
        all_of = np.add.reduceat(dense[found] * gains, starts[:-1])
        assert [(-s, i) for s, _, i in best.found] == [(all_of[i], i) for i in np.lexsort((np.arange(600), -all_of))[:10]]
    assert skipped > 0 and scored < 0.2 * 6 * 600
