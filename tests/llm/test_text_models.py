"""BPE, token counts, language ID and quality rules."""

import hashlib
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import bpe, langid, quality, tokencount
from foliant.llm.queries import tokenizer

WORD_BPE, PIECES = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["don't", "WE'LL", "<|endoftext|>", "<|startoftext|>", "<|", "İı", "ΑΣ", "ﬁ", "é", "한국", "²½", " ", "\x1c", "👍🏽", "aaaa", "!!??", "Straße"]), max_size=8).map("".join)))
def test_bpe_equals_the_library(library, text):
    mine, theirs = bpe.load(WORD_BPE).encode(text), library.encode(text, add_special_tokens=False).ids
    assert mine == theirs
    assert bpe.load(WORD_BPE).decode(mine) == library.decode(theirs, skip_special_tokens=False)


def test_words_merge_together_as_alone():
    one = bpe.load(WORD_BPE)
    rng = random.Random(1)
    words = ["".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 14))) for _ in range(500)] + ["a" * 500, "ab" * 300]
    assert one.encode_words(words) == [one.encode_words([w])[0] for w in words]


def test_bpe_operator(make, odd, library):
    texts = {}
    for i, t, *_ in odd:
        texts.setdefault(i, []).append(t or "")
    found = bpe.bpe_encode(make(odd), WORD_BPE, with_ids=True, with_text=True).collect()
    assert len(found) == len(odd)
    for r in found:
        ids = [library.encode(t, add_special_tokens=False).ids for t in texts[r["doc_id"]]]
        assert r["ids"] in ids and r["n_tokens"] == len(r["ids"]) and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.bpe_encode(make([]), WORD_BPE).collect() == []


def viterbi(word, model):
    """Cheapest cut of one word, and among equal ones that with the fewest pieces, without sharing."""
    word = tokencount.START + word
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        size = len(word[e - 1].encode())
        options = [(best[e - 1][0] + size * model.byte_cost, best[e - 1][1] + size)]
        options += [(model.cost[word[s:e]] + best[s][0], best[s][1] + 1) for s in range(e) if word[s:e] in model.cost]
        best.append(min(options))
    return best[-1][1]


def test_token_counts(make, odd, monkeypatch):
    rows = odd + [(50, "naïve 한국어 👍 ﬁne  x www.example.com/ÄÖ " + "z" * 300)]
    model = tokencount.fit(make(rows), PIECES)
    found = tokencount.token_counts(make(rows), model).collect()
    expected = sorted((i is None, i or 0, len(tokencount.WORD.findall(t or "")), sum(viterbi(w, model) for w in tokencount.WORD.findall(t or ""))) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_pretokens"], r["n_tokens"]) for r in found) == expected
    assert tokencount.token_counts(make([]), model).collect() == []
    nothing = tokencount.fit(make([(1, None)]), PIECES)
    assert nothing.cost == tokencount.ranked(PIECES).cost


def best_cuts(words, model):
    """Uses of pieces in the best cuts, word by word, without a trie."""
    total = Counter()
    for word in words:
        word = tokencount.START + word
        best = [(0.0, 0, [])]
        for e in range(1, len(word) + 1):
            size = len(word[e - 1].encode())
            options = [(best[e - 1][0] + size * model.byte_cost, best[e - 1][1] + size, best[e - 1][2])]
            options += [(model.cost[word[s:e]] + best[s][0], best[s][1] + 1, [*best[s][2], word[s:e]]) for s in range(e) if word[s:e] in model.cost]
            best.append(min(options, key=lambda x: x[:2]))
        total.update(best[-1][2])
    return total


def test_fitted_probabilities(make, monkeypatch):
    """Two rounds of counting, by brute force; the probabilities of pieces and a byte sum to 1, and frequent pieces get cheaper."""
    texts = ["the nation's internationalisation", "nation nation naïve 👍", "station to station", None, ""]
    monkeypatch.setattr(tokencount, "WORDS", 2)
    words = [w for t in texts for w in tokencount.WORD.findall(t or "")]
    model = tokencount.ranked(PIECES)
    for _ in range(2):
        model = tokencount.Unigram.by_uses(tokencount.vocabulary(PIECES), best_cuts(words, model))
    fitted = tokencount.fit(make(list(enumerate(texts))), PIECES, rounds=2)
    assert fitted.cost == pytest.approx(model.cost) and fitted.byte_cost == pytest.approx(model.byte_cost)
    assert sum(np.exp(-c) for c in fitted.cost.values()) + np.exp(-fitted.byte_cost) == pytest.approx(1)
    assert fitted.cost["▁nation"] < tokencount.ranked(PIECES).cost["▁nation"]


def test_a_trie_shares_prefixes():
    trie = tokencount.Trie(tokencount.ranked(PIECES))
    trie.count("internation")
    n = len(trie.nodes)
    trie.count("international")
    assert len(trie.nodes) == n + 2


def test_words_are_scored_depth_by_depth(monkeypatch):
    """Counts and uses are those of single words, each prefix is one node, and no word is scored by itself but where few are so long;
    one by one they took 879 CPU seconds a GB."""
    rng = random.Random(5)
    words = {"".join(rng.choice("aeinrst'éß中👍") for _ in range(rng.randint(1, 12))) for _ in range(800)} | {"▁", "\x00", "▁▁", "international", "internation", "n" * 31, "क्ष"}
    words |= {"".join(rng.choice("aeinrst中👍") for _ in range(200)) for _ in range(20)}
    long, short = ["n" * 65, "ab" * 300, "n" * 40], sorted(words)
    zipf = tokencount.ranked(PIECES)
    for model in (zipf, tokencount.Unigram(dict.fromkeys(zipf.cost, 1.0), 1.0), tokencount.Unigram({}, 2.0), tokencount.Unigram({"▁ab": 1.0, "中é": 2.0}, 3.0)):
        levels = tokencount.Levels(model, short)
        assert levels.counts() == [viterbi(w, model) for w in short]
        assert levels.nodes == len({(tokencount.START + w)[:n] for w in short for n in range(1, len(w) + 2)})
        path, expected = tokencount.Path(model), Counter()
        for i, word in enumerate(short):
            for piece in path.cut(word):
                expected[piece] += i + 1
        assert {p: n for p, n in zip(model.cost, levels.uses(range(1, len(short) + 1)).tolist()) if n} == expected
    assert tokencount.Levels(zipf, []).counts() == []
    monkeypatch.setattr(tokencount, "CHARACTERS", 300 << 5)
    scored, step = [], tokencount.Unigram.step
    monkeypatch.setattr(tokencount.Unigram, "step", lambda self, word, *more: scored.append(word[1:]) or step(self, word, *more))
    texts = [" ".join(short), " ".join(long + short[:9]), None, "", *short]
    run = tokencount.counter(SimpleNamespace(value=zipf))
    expected = [sum(viterbi(w, zipf) for w in (t or "").split(" ") if w) for t in texts]
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})
    assert next(run(iter([batch])))["n_tokens"].to_pylist() == expected
    whole = pa.RecordBatch.from_pydict({"word": sorted(short + long), "n": [2] * (len(short) + len(long))})
    (found,) = tokencount.uses(zipf)(iter([whole]))
    assert dict(zip(*found.to_pydict().values())) == {p: 2 * n for p, n in best_cuts(short + long, zipf).items()}
    assert set(scored) == set(long)
    monkeypatch.setattr(tokencount, "TOGETHER", 50)
    for most in (10**6, 20):
        monkeypatch.setattr(tokencount, "WORDS", most)
        assert next(run(iter([batch])))["n_tokens"].to_pylist() == expected


def every_cut(word, vocabulary, p):
    word = langid.START + word
    if not word:
        return 1.0

    def total(s):
        if s == len(word):
            return np.ones(p.shape[1])
        out = np.zeros(p.shape[1])
        for e in range(s + 1, min(len(word), s + langid.LONGEST) + 1):
            piece = vocabulary.get(word[s:e], 0)
            if piece or e == s + 1:
                out = out + p[piece] * total(e)
        return out

    return total(0)


def test_forward_sums_all_cuts():
    vocabulary = langid.pieces(PIECES)
    p = np.random.default_rng(1).random((len(vocabulary) + 1, 3)) / 1000
    words = ["a", "the", "nation", "straße", "ωx", "queue"]
    found = langid.Lattice(words, vocabulary).log_probabilities(p)
    for w, x in zip(words, found):
        assert x == pytest.approx(np.log(every_cut(w, vocabulary, p)))
    for w in ["ab" * 5000, "nationtheqüeue" * 40, "n" * 32]:
        lattice = langid.Lattice([w, "nation"], vocabulary)
        assert lattice.long and np.isfinite(lattice.log_probabilities(p)).all()
        assert lattice.log_probabilities(p)[1] == pytest.approx(found[2])
    lattice = langid.Lattice(["nationtheq" * 3], vocabulary)
    plain, uses = lattice.log_probabilities(p), lattice.expected(p[:, 0], np.array([3.0]))
    lattice.long = True
    assert lattice.log_probabilities(p) == pytest.approx(plain) and lattice.expected(p[:, 0], np.array([3.0])) == pytest.approx(uses)


def test_words_are_parted_by_length():
    words = sorted(["a" * n for n in range(1, 60)] + ["b" * 60_000, "c" * 60_000] + ["d"] * 9000, key=len)
    parts = [words[s] for s in langid.parted(words)]
    assert [w for p in parts for w in p] == words and list(langid.parted([])) == []
    assert all(len(p) <= langid.TOGETHER and (len(p) == 1 or len(p[-1]) < langid.LONG or len(p[0]) >= langid.LONG and len(p) * len(p[-1]) <= langid.CHARACTERS) for p in parts)


def test_words_are_letters():
    assert langid.words_of("½ ² ① x½y Straße3 ωΧ_a ٣ Ⅷ") == ["x", "y", "straße", "ωχ", "a"]


def test_marks_belong_to_their_letters():
    assert langid.words_of("हिन्दी भाषा, น้ำ x\u0301y İx") == ["हिन्दी", "भाषा", "น้ำ", "x\u0301y", "i\u0307x"]
    assert langid.words_of("\u0301 \u0301\u0301 ½\u0301") == [] and langid.words_of("\u0301a – b½") == ["a", "b"]


def test_languages_told_apart_by_marks(spark):
    """The same letters with other vowel signs are other words; a text of marks alone has no letter."""
    rng = random.Random(3)
    word = lambda signs: "".join(rng.choice("कखगनम") + rng.choice(signs) for _ in range(3))
    signs = {"aa": ["\u093e", "\u093f", ""], "uu": ["\u0941", "\u0947", ""]}
    rows = [(i, " ".join(word(signs[x]) for _ in range(30)), x) for i, x in enumerate(["aa", "uu"] * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), tokenizer("piece_bpe_32k.model"), rounds=2)
    new = [(i, " ".join(word(signs[x]) for _ in range(12)), x) for i, x in enumerate(["aa", "uu"] * 20)] + [(99, "\u093e \u0941", None)]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
    assert found[99] == "und" and sum(found[i] == x for i, _, x in new[:-1]) >= 38


def test_expected_uses():
    """Each character of each word is covered by the pieces that are expected."""
    vocabulary = langid.pieces(PIECES)
    p = np.full(len(vocabulary) + 1, 1e-4)
    lengths = np.array([1, *map(len, vocabulary)])
    for word in ("nation", "nation" * 50):
        uses = langid.Lattice([word, "the"], vocabulary).expected(p, np.array([2.0, 3.0]))
        assert (uses * lengths).sum() == pytest.approx(2 * (len(word) + 1) + 3 * 4)


def test_language(spark, sf_dir):
    from foliant.llm.queries import op4_language

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op4_language(spark, sf_dir).collect()
    assert len(found) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(make, odd, spark):
    model = langid.train(make([(i, t, s) for i, t, s in odd]), PIECES, sample_rows=100, rounds=1)
    found = langid.identify(make([(1, None), (2, "123 .."), (None, "straße"), (4, "word " * 3 + "w" * 3000)]), model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in found] == [(1, "und"), (2, "und"), (None, "en"), (4, "en")] and found[0]["score"] == 0
    assert langid.identify(make([]), model).collect() == []
    twice = langid.identify(make([(1, "½ ²"), (2, "①"), (3, "the river"), (3, "the river"), (None, "")]), model).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] == 0) for r in twice) == [(0, "und", True), (1, "und", True), (2, "und", True), (3, "en", False), (3, "en", False)]
    nothing = langid.train(make([]), PIECES)
    assert [r["lang_pred"] for r in langid.identify(make([(1, "text")]), nothing).collect()] == ["und"]


def test_languages_without_spaces(spark):
    """Each word is a run of 60 characters, the two languages differ in how often they use them."""
    rng = random.Random(3)
    text = lambda weights: " ".join("".join(rng.choices("abdegiklmnoprstu", weights, k=60)) for _ in range(4))
    rising = list(range(1, 17))
    rows = [(i, text(rising if i % 2 else rising[::-1]), "aa" if i % 2 else "bb") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 40"), PIECES)
    found = langid.identify(df.where("doc_id >= 40"), model).collect()
    assert len(found) == 40 and all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "bb") for r in found)


def counted(text):
    text = text or ""
    words = quality.WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if quality.WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_quality(make, odd):
    rows = [r for r in odd if r[0] != 6] + [(20, "one two three four\n" * 30), (21, "a b c d a b c\n\nline\nline\n \n ##$%"), (22, "x\ny\nx\nx")]
    found = {}
    for r in quality.quality(make(rows)).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:6])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    expected = {}
    for i, t, *_ in rows:
        expected.setdefault(i, []).append(counted(t))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in expected.items()}
    assert quality.quality(make([])).collect() == []


def test_compression_bands(make):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    syllables = ["ka", "lo", "mi", "ren", "to", "sha", "vel", "qui", "dor", "an", "be", "st"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    once = prose(300)
    base64ish = " ".join(noise(40) for _ in range(300))
    rows = [(1, prose(100)), (2, prose(5000)), (3, base64ish), (4, prose(2000) + base64ish), (5, "\n".join([once] * 6)), (6, prose(60))]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(make(rows)).collect()}
    assert kept[1] == kept[2] == kept[6] == (False, True)
    assert kept[3] == kept[4] == (False, False) and not kept[5][1]
    packed = zstandard.ZstdCompressor(level=3)
    whole, low, high = quality.compressed(b"a" * 100_000, packed)
    assert whole > 1000 and low <= high and not quality.WIDE.keeps(100_000, whole, low, high)
    assert [r["doc_id"] for r in quality.keep_good(make(rows)).orderBy("doc_id").collect()] == [1, 2, 6]
    assert quality.keep_good(make(rows)).columns == make(rows).columns


def samples(seed, n):
    """Prose of syllables, random letters, and a passage that is repeated with other words between, n of each."""
    rng = random.Random(seed)
    syllables = ["th", "er", "an", "in", "on", "ed", "nd", "ha", "re", "ou", "ea", "ing", "tion", "st", "en", "of", "wh", "ti", "es", "or", "sh", "ly", "ble", "at"]
    prose = lambda k: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", "", ",", ".\n"]) for _ in range(k))
    noise = lambda k: " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(12)) for _ in range(k))
    cyrillic = str.maketrans("abcdefghilnorstuvw", "абцдефгхилнорстувщ")
    size = lambda: rng.randint(60, 900)
    again = prose(90)
    return [prose(size()) for _ in range(n)], [noise(size() + 300) for _ in range(n)], [" ".join(f"{prose(40)} {again}" for _ in range(8)) for _ in range(n)], [prose(size()).translate(cyrillic) for _ in range(n)]


def test_bands_from_labels(spark, make):
    """Limits come from the labelled documents that aren't held out, and hold for those that are; other scripts have limits of their own."""
    good, noise, again, cyrillic = samples(7, 800)
    texts = good + noise[:60] + again[:60] + cyrillic[:400]
    labels = spark.createDataFrame([(i, int(i < 800 or i >= 920), "x") for i in range(len(texts))] + [(10**6, 1, "gone"), (3, None, "y")], "doc_id long, quality int, id string")
    rows = make(list(enumerate(texts)))
    found = quality.quality(rows, labels=labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] for i in range(800)) and not any(kept[i] for i in range(800, 920)) and all(kept[920 + i] for i in range(400))
    measures = quality.measured(rows.select(quality.F.col("doc_id").alias("id"), "text"))
    bands, figures = quality.fit(measures, labels)
    assert figures["good"]["rejected"] == 0 and figures["bad"]["rejected"] + figures["bad"]["base_failed"] == figures["bad"]["n"] > 10
    assert all(kept[r["doc_id"]] == (not r["base_failed"] and (bands.many if r["many_bytes"] else bands).keeps(r["n_bytes"], r["ratio"], r["least_chunk_ratio"], r["largest_chunk_ratio"])) for r in found)
    # Lengths with too few good documents have the hand-set limits.
    assert bands.low[0] == quality.WIDE.low[0] and bands.low[8] != quality.WIDE.low[8] and bands.many.high[8] > bands.high[8]
    assert quality.fit(measures, labels.where("quality = 7"))[0] == quality.WIDE and quality.fit(measures.limit(0), labels) == (quality.WIDE, {})
    assert [r["doc_id"] for r in quality.keep_good(rows, labels=labels).orderBy("doc_id").collect()] == sorted(i for i, k in kept.items() if k)


def test_fitted_limits_leave_other_prose_alone(spark, make):
    """Limits fitted on made-up prose keep real English of several kinds: help topics and docstrings that come with Python."""
    import importlib
    import inspect

    import pydoc_data.topics

    names = "argparse asyncio collections csv datetime decimal difflib email functools http.client inspect io itertools json logging os pathlib pickle random re shutil socket statistics string subprocess tarfile tempfile textwrap threading typing unittest urllib.parse zipfile turtle doctest optparse fractions ast calendar cmd codecs configparser contextlib dataclasses enum pandas numpy".split()
    modules = [importlib.import_module(n) for n in names]
    owners = [x for m in modules for x in (m, *(v for v in vars(m).values() if inspect.isclass(v)))]
    texts = {d for o in owners for x in (o, *vars(o).values()) if isinstance(d := getattr(x, "__doc__", None), str)} | set(pydoc_data.topics.topics.values())
    real = sorted(t for t in texts if len(t) > 800)
    good, *_ = samples(9, 500)
    labels = spark.createDataFrame([(i, 1) for i in range(500)], "doc_id long, quality int")
    found = quality.quality(make(list(enumerate(good + real))), labels=labels).where("doc_id >= 500 and not base_failed").collect()
    assert len(found) > 100 and sum(not x["kept"] for x in found) <= 0.05 * len(found)


def test_the_end_of_a_text_is_judged():
    rng = random.Random(8)
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(900))
    raw = "".join(rng.choice(["river ", "stone ", "over ", "cloud ", "seven "]) for _ in range(900)).encode()[:4096]
    packed = zstandard.ZstdCompressor(level=3)
    tail = raw + b"same " * 180
    for text in (raw + noise.encode(), tail, tail * 3):
        parts = quality.chunks(text)
        assert {len(p) for p in parts} == {4096} and text.startswith(parts[0]) and text.endswith(parts[-1]) and len(parts) == -(-len(text) // 4096)
    ratio = lambda part: len(part) / len(packed.compress(part))
    assert quality.chunks(raw) == [raw]
    assert quality.compressed(tail, packed)[2] == max(ratio(tail[:4096]), ratio(tail[-4096:])) > quality.compressed(raw, packed)[0]
