"""Token counts of a unigram tokeniser by trie-shared dynamic programming.

The distinct pre-tokens of a batch are put in a trie. A node holds the best score of its prefix and the number of pieces that reach
it, computed when the node is made, from its ancestors on the path: prefixes that words share are scored once. The number at a
word's last node is the word's count. All nodes of one depth are made together; an automaton over the pieces tells which of them end
at a node. The vocabulary is a public one; its pieces' probabilities are fitted to the words of all documents, by counting how often
the best cuts use each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import spread
from .shared import SPACE, column, delete, map_arrow, workspace, written

WORD = re.compile(f"[^{SPACE}]+")
START = "▁"
#: Nodes of a trie; a task drops the trie when it has more, and starts a new one.
NODES = 1_500_000
#: Distinct words that a task counts before it hands them on, and whose numbers it remembers.
WORDS = 1_000_000
#: Characters of the texts whose new words are scored together, and of one trie at most. Fewer long words than FEW go one by one, since
#: a depth has too few nodes then.
TOGETHER, CHARACTERS, FEW = 2_000_000, 640_000, 16


class Unigram:
    """Costs (negative log-probabilities) of pieces, and of a byte of a character that no piece has.

    ends: the lengths of the pieces of three characters or more, by their last three.
    """

    def __init__(self, cost: dict[str, float], byte_cost: float):
        self.cost, self.byte_cost = cost, byte_cost
        ends: dict[str, set[int]] = {}
        for piece in cost:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}

    def step(self, word: str, at: int, cost: Sequence[float], pieces: Sequence[int]) -> tuple[float, int, int]:
        """Of the prefix of `at` characters: the least cost, among equal ones the fewest pieces, and the last piece's length, 0 for
        bytes. cost and pieces: those of the shorter prefixes, by length."""
        known, char = self.cost, word[at - 1]
        if (c := known.get(char)) is not None:
            best, n, length = cost[at - 1] + c, pieces[at - 1] + 1, 1
        else:
            size = len(char.encode())
            best, n, length = cost[at - 1] + size * self.byte_cost, pieces[at - 1] + size, 0
        if at > 1 and (c := known.get(word[at - 2 : at])) is not None:
            c += cost[at - 2]
            if c < best or c == best and pieces[at - 2] + 1 < n:
                best, n, length = c, pieces[at - 2] + 1, 2
        for back in self.ends.get(word[at - 3 : at], ()) if at > 2 else ():
            if back <= at and (c := known.get(word[at - back : at])) is not None:
                c += cost[at - back]
                if c < best or c == best and pieces[at - back] + 1 < n:
                    best, n, length = c, pieces[at - back] + 1, back
        return best, n, length

    @cached_property
    def pieces(self) -> tuple[str, ...]:
        return tuple(self.cost)

    @cached_property
    def prices(self) -> np.ndarray:
        """The pieces' costs, in their order."""
        return np.fromiter(self.cost.values(), float, len(self.cost))

    @classmethod
    def by_uses(cls, pieces: Iterable[str], uses: dict[str, float], prior: float = 0.1) -> Unigram:
        """Probabilities in proportion to uses and `prior`; a byte is as rare as a piece that is never used."""
        weight = {p: uses.get(p, 0.0) + prior for p in pieces}
        total = math.log(sum(weight.values()) + prior)
        return cls({p: total - math.log(w) for p, w in weight.items()}, total - math.log(prior))


class Trie:
    """Prefixes of pre-tokens with the least cost to reach them, and among equal costs the fewest pieces."""

    def __init__(self, model: Unigram):
        self.model, self.next, self.nodes = model, {}, [(0.0, 0)]

    def count(self, word: str) -> int:
        """Number of pieces of a pre-token."""
        word = START + word
        node, known, find, model = 0, [(0.0, 0)], self.next, self.model
        at = 0
        for at, char in enumerate(word, 1):  # along the prefixes that are there
            child = find.get((node, char))
            if child is None:
                break
            node = child
            known.append(self.nodes[node])
        else:
            return known[-1][1]
        cost, pieces = [x[0] for x in known], [x[1] for x in known]
        for at in range(at, len(word) + 1):
            best, n, _ = model.step(word, at, cost, pieces)
            cost.append(best)
            pieces.append(n)
            find[node, word[at - 1]] = node = len(self.nodes)
            self.nodes.append((best, n))
        return pieces[-1]


class Automaton:
    """Which pieces end at a character, from left to right (Aho and Corasick). A state is the longest beginning of a piece that ends there.

    keys, child: a state and the character after it as one sorted number, and where they lead. fail: the state of the next shorter
    beginning. begin, number: the pieces that end at state s, shortest first, are number[begin[s] : begin[s + 1]].
    """

    def __init__(self, pieces: Sequence[str]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        step: list[dict[str, int]] = [{}]
        own: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            s = 0
            for char in piece:
                if (to := step[s].get(char)) is None:
                    to = step[s][char] = len(step)
                    step.append({})
                s = to
            own[s] = i
        fail, ends, level = [0] * len(step), [()] * len(step), [0]
        while level:
            for s in level:
                for char, to in step[s].items():
                    back = fail[s]
                    while back and char not in step[back]:
                        back = fail[back]
                    fail[to] = step[back].get(char, 0) if s else 0
                    ends[to] = (*ends[fail[to]], own[to]) if to in own else ends[fail[to]]
            level = [to for s in level for to in step[s].values()]
        edges = sorted((s << 21 | ord(char), to) for s, x in enumerate(step) for char, to in x.items())
        self.keys, self.child = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
        self.fail = np.array(fail, np.int64)
        self.begin = np.cumsum([0, *map(len, ends)])
        self.number = np.array([i for x in ends for i in x], np.int64)
        self.many = np.diff(self.begin)
        #: Whether the last character is a piece by itself.
        self.known = np.zeros(len(step), bool)
        some = np.flatnonzero(self.many)
        self.known[some] = self.length[self.number[self.begin[some]]] == 1

    def after(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states that characters lead to."""
        out, todo = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(todo) and len(self.keys):
            key = state << 21 | char
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] = self.child[at[hit]]
            left = np.flatnonzero(~hit & (state > 0))
            todo, state, char = todo[left], self.fail[state[left]], char[left]
        return out


@lru_cache(maxsize=2)
def automaton(pieces: tuple[str, ...]) -> Automaton:
    return Automaton(pieces)


class Levels:
    """A trie of many pre-tokens, made depth by depth from words that come sorted: prefixes that words share are one node, scored once.
    At the place of a word's prefix there are the least cost, among equal ones the fewest pieces, and the last piece's number, -1
    for bytes. In another order the results are the same, and fewer nodes are shared."""

    def __init__(self, model: Unigram, words: Sequence[str]):
        self.automaton, self.price, self.byte_cost = automaton(model.pieces), model.prices, model.byte_cost
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = np.frombuffer("".join([START + w for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.last = np.cumsum(size + 1) - 1  # places of whole words
        self.first = self.last - size
        places = int(size.sum()) + len(words)
        self.cost, self.count, self.piece = np.zeros(places), np.zeros(places, np.int64), np.full(places, -1, np.int64)
        self.nodes = 0
        row, state, same = np.arange(len(words)), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for depth in range(1, int(size.max(initial=0)) + 1):
            if not (stays := size[row] >= depth).all():
                row, state, same = row[stays], state[stays], same[stays]
            char = text[self.first[row] - row + depth - 1]
            same[0] = False
            same[1:] &= (row[1:] == row[:-1] + 1) & (char[1:] == char[:-1])  # as the word before
            new, node = np.flatnonzero(~same), np.cumsum(~same) - 1
            at = self.first[row] + depth
            to = self.automaton.after(state[new], char[new])
            best, n, by = self._best(to, char[new], at[new])
            self.cost[at], self.count[at], self.piece[at], state = best[node], n[node], by[node], to[node]
            self.nodes += len(new)

    def _best(self, state: np.ndarray, char: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of new nodes: the least cost, the pieces, the last one's number. char, at: the last characters and the places of the prefixes."""
        auto, cost, count = self.automaton, self.cost, self.count
        best, n, by = np.full(len(at), np.inf), np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        if len(raw := np.flatnonzero(~auto.known[state])):
            size = 1 + (char[raw] > 0x7F) + (char[raw] > 0x7FF) + (char[raw] > 0xFFFF)
            best[raw], n[raw] = cost[at[raw] - 1] + size * self.byte_cost, count[at[raw] - 1] + size
        some, k = np.flatnonzero(auto.many[state]), 0
        while len(some):
            piece = auto.number[auto.begin[state[some]] + k]
            before = at[some] - auto.length[piece]
            c, m = cost[before] + self.price[piece], count[before] + 1
            good = (c < best[some]) | (c == best[some]) & (m < n[some])
            to = some[good]
            best[to], n[to], by[to] = c[good], m[good], piece[good]
            k += 1
            some = some[auto.many[state[some]] > k]
        return best, n, by

    def counts(self) -> list[int]:
        """Number of pieces of each word."""
        return self.count[self.last].tolist()

    def uses(self, times: Sequence[int]) -> np.ndarray:
        """How often the best cuts use each piece, where word i stands times[i] times."""
        total, at, first, times = np.zeros(len(self.price), np.int64), self.last, self.first, np.asarray(times, np.int64)
        while len(at):
            piece, back = self.piece[at], np.ones(len(at), np.int64)
            known = piece >= 0
            np.add.at(total, piece[known], times[known])
            back[known] = self.automaton.length[piece[known]]
            at = at - back
            left = at > first
            at, first, times = at[left], first[left], times[left]
        return total


def parted(words: Iterable[str]) -> Iterator[tuple[list[str], bool]]:
    """The words in sorted lists of about the same length and bounded size, and whether a list is scored as one trie."""
    by: dict[int, list[str]] = {}
    for word in words:
        by.setdefault(max(5, len(word).bit_length()), []).append(word)
    for size, found in by.items():
        found.sort()
        most = max(1, CHARACTERS >> size)
        for i in range(0, len(found), most):
            yield (some := found[i : i + most]), size == 5 or len(some) >= FEW


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[str, ...]:
    """Pieces of a sentencepiece file that stand for text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))


def ranked(path: str) -> Unigram:
    """What fit() starts from: uses by Zipf's law over the pieces' rank in the file."""
    pieces = vocabulary(path)
    return Unigram.by_uses(pieces, {p: 1e6 / r for r, p in enumerate(pieces, 1)})


def count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and n: how often each pre-token occurs, summed up within a task as far as memory allows."""
    counts: Counter[str] = Counter()
    for batch in source:
        for value in batch["text"]:
            counts.update(WORD.findall(value.as_py() or ""))
        if len(counts) > WORDS:
            yield from _counted(counts)
            counts = Counter()
    yield from _counted(counts)


def _counted(counts: Counter[str]) -> Iterator[pa.RecordBatch]:
    words, numbers = list(counts), list(counts.values())
    for at in range(0, len(words), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string()), pa.array(numbers[at : at + 50_000], pa.int64())], ["word", "n"])


class Path:
    """The trie's path of one word at a time: of words that come sorted, each extends what it shares with the one before, so prefixes
    are scored once and no more than a path is held."""

    def __init__(self, model: Unigram):
        self.model, self.word = model, ""
        self.cost, self.pieces, self.last = [0.0], [0], [0]

    def cut(self, word: str) -> list[str]:
        """The pieces of a pre-token, from the last; characters that go by bytes are left out."""
        word, old, keep = START + word, self.word, 0
        if word[: len(old)] == old:
            keep = len(old)
        else:
            while word[: keep + 1] == old[: keep + 1]:
                keep += 1
        cost, pieces, last, model = self.cost, self.pieces, self.last, self.model
        del cost[keep + 1 :], pieces[keep + 1 :], last[keep + 1 :]
        for at in range(keep + 1, len(word) + 1):
            best, n, length = model.step(word, at, cost, pieces)
            cost.append(best)
            pieces.append(n)
            last.append(length)
        self.word, at, out = word, len(word), []
        while at:
            length = last[at]
            if length:
                out.append(word[at - length : at])
            at -= length or 1
        return out


def uses(model: Unigram):
    """piece and n: how often the best cuts of the words, which come sorted, use each piece; a row a piece and task at most."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        path, used = Path(model), np.zeros(len(model.cost), np.int64)
        for batch in source:
            times = dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist()))
            for some, together in parted(times):
                if together:
                    used += Levels(model, some).uses([times[w] for w in some])
                    continue
                for word in some:
                    for piece in path.cut(word):
                        total[piece] += times[word]
        for piece, n in zip(model.cost, used.tolist()):
            if n:
                total[piece] += n
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], ["piece", "n"])

    return run


def fit(docs: DataFrame, path: str, text_col: str = "text", rounds: int = 1) -> Unigram:
    """Probabilities of the pieces of a sentencepiece file from all texts of docs.

    Distinct pre-tokens are counted once, and stay sorted; in each round their best cuts under the costs so far are counted, a number
    for each piece of the vocabulary, which come to the driver. Null and empty texts add nothing; without any word the costs by rank stay.
    """
    at, model = workspace(docs.sparkSession, "words"), ranked(path)
    rows = docs.select(column(text_col).cast("string").alias("text"))
    words = written(map_arrow(spread(rows), count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).sortWithinPartitions("word"), at)
    for _ in range(rounds):
        found = map_arrow(words, uses(model), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if found:
            model = Unigram.by_uses(vocabulary(path), {r["piece"]: r["n"] for r in found})
    delete(docs.sparkSession, at)
    return model


def counted(model: Unigram, words: set[str]) -> Iterator[tuple[str, int]]:
    """The words, each with its number of pieces."""
    trie = Trie(model)
    for some, together in parted(words):
        if together:
            yield from zip(some, Levels(model, some).counts())
            continue
        for word in some:
            if len(trie.nodes) > NODES:
                trie = Trie(model)
            yield word, trie.count(word)


def counter(sent):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known: dict[str, int] = {}
        for batch in source:
            tokens, words, split, size = [], [], [], 0
            for i, value in enumerate(batch["text"], 1):
                text = value.as_py() or ""
                split.append(WORD.findall(text))
                size += len(text)
                if size < TOGETHER and i < batch.num_rows:
                    continue
                new = set().union(*split).difference(known)
                if len(known) + len(new) > WORDS:
                    known, new = {}, set().union(*split)
                known.update(counted(model, new))
                tokens += [sum([known[w] for w in found]) for found in split]
                words += map(len, split)
                split, size = [], 0
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pretokens, n_tokens for each row of docs.

    Pre-tokens are the runs of characters other than white space, each led by the mark of a word's start. model: of fit(),
    which as large as the vocabulary is sent to all executors. A null or empty text has no tokens. Ids may be null
    or repeated; an empty table gives no rows. Only the two named columns are read. No shuffle; a task holds one batch, the
    numbers of at most WORDS words (but for a text with more), and one trie of bounded size (but for a single longer word).
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(spread(rows), counter(sent), StructType([rows.schema["id"], StructField("n_pretokens", LongType()), StructField("n_tokens", LongType())])).withColumnRenamed("id", id_col)
