"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie side by side in one symbol list. An index maps each pair of neighbours that has a merge rank
to all its positions; active ranks are taken in ascending order from a heap, each is applied at all its positions, and the lists
of the pairs that a merge makes are extended. Words don't touch, and of the pairs in a word the one with the lowest rank is
always the first to come up, so each word is merged as it would be alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import spread
from .shared import column, map_arrow

#: Words that a task remembers at most; beyond it, it starts afresh.
CACHE = 400_000
#: Code points of text that are split and looked up together.
CHUNK = 1_000_000


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable in Latin-1, else
    the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(more)
            more += 1
    return out


def _class(prefix: str, low: int = 0x250) -> str:
    return "".join(re.escape(chr(c)) for c in range(low) if unicodedata.category(chr(c))[0] == prefix)


#: Texts of these characters only are split by FAST: no composition, no context in lower-casing, categories that don't change.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ‐-‧€]*")
#: The word pattern of the vocabulary over PLAIN texts, with Unicode's letters and numbers spelled out.
FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


class WordBPE:
    """Encoder and decoder for a tokenizers file with byte-level BPE over split words, no post-processor and no decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, tokenizer = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or spec.get("decoder") or spec.get("post_processor") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with options")
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.bytes_of = {c: b for b, c in chars.items()}
        self.inner = [vocab.get(chars[b], -1) for b in range(256)]
        self.last = [vocab.get(chars[b] + end, -1) for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.pairs = sorted(self.merges, key=lambda p: self.merges[p][0])
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.plain_rules = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        self.cache: dict[str, tuple[int, str, str, tuple[int, ...]]] = {}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by the pair occurrence index over all of them."""
        symbols: list[int] = []
        after: list[int] = []
        starts: list[int] = []
        for word in words:
            raw = word.encode()
            starts.append(len(symbols))
            symbols += [self.inner[b] for b in raw[:-1]]
            symbols.append(self.last[raw[-1]])
            after += range(len(after) + 1, len(symbols))
            after.append(-1)
        before = [-1] * len(symbols)
        where: dict[int, list[int]] = {}
        merges, heap = self.merges, []
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
                pair = symbols[i] << 32 | symbols[j]
                if pair in where:
                    where[pair].append(i)
                elif pair in merges:
                    where[pair] = [i]
                    heap.append(merges[pair][0])
        heapq.heapify(heap)
        while heap:
            pair = self.pairs[heapq.heappop(heap)]
            places, merged = where.pop(pair), merges[pair][1]
            left, right = pair >> 32, pair & 0xFFFFFFFF
            places.sort()
            for i in places:
                j = after[i]
                if j < 0 or symbols[i] != left or symbols[j] != right:
                    continue  # an earlier merge took one of the two
                symbols[i], symbols[j] = merged, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    new = merged << 32 | symbols[k]
                    if new in where:
                        where[new].append(i)
                    elif new in merges:
                        where[new] = [i]
                        heapq.heappush(heap, merges[new][0])
                h = before[i]
                if h >= 0:
                    new = symbols[h] << 32 | merged
                    if new in where:
                        where[new].append(h)
                    elif new in merges:
                        where[new] = [h]
                        heapq.heappush(heap, merges[new][0])
        out = []
        for at, end in zip(starts, [*starts[1:], len(symbols)]):
            out.append([s for s in symbols[at:end] if s >= 0])
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens, after normalisation."""
        if self.plain_rules and PLAIN.fullmatch(text):
            return FAST.findall(text.lower())
        norm = self.normalizer.normalize_str(text) if self.normalizer else text
        bytes_of = self.bytes_of
        return [bytes(bytes_of[c] for c in w).decode() for w, _ in self.splitter.pre_tokenize_str(norm)]

    def words(self, text: str) -> list[str]:
        """Words and added tokens of a text. An added token stands as such; no word of the pattern equals one."""
        if self.cut is None or "<|" not in text and not self.cut.search(text):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, as the library does where a file names no decoder; special tokens are kept."""
        return " ".join([self.tokens[i] for i in ids])

    def learn(self, words: Iterable[str]) -> None:
        """Puts words into the cache."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = [w for w in set(words) if w not in cache]
        plain = [w for w in new if w not in self.special]
        for word in new:
            if word in self.special:
                cache[word] = (1, str(self.special[word]), word, (self.special[word],))
        for word, ids in zip(plain, self.encode_words(plain)):
            cache[word] = (len(ids), " ".join(map(str, ids)), self.decode(ids), tuple(ids))

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn(words)
        return [i for w in words for i in self.cache[w][3]]


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """Once a Python worker."""
    return WordBPE(path)


def chunks(texts: Iterable[str], most: int = CHUNK) -> Iterator[list[str]]:
    """Texts in lists of about `most` code points; a longer text stands alone."""
    out, size = [], 0
    for text in texts:
        out.append(text)
        size += len(text) + 50
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encoder(path: str, with_ids: bool, with_text: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in source:
            counts, sha, decoded_sha, ids, decoded = [], [], [], [], []
            for part in chunks(t.as_py() or "" for t in batch["text"]):
                split = [bpe.words(t) for t in part]
                bpe.learn({w for words in split for w in words})
                cache = bpe.cache
                for words in split:
                    found = [cache[w] for w in words]
                    joined = " ".join([f[1] for f in found])
                    text = " ".join([f[2] for f in found])
                    counts.append(sum([f[0] for f in found]))
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids.append([i for f in found for i in f[3]])
                    if with_text:
                        decoded.append(text)
            columns = {"id": batch["id"], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if with_text:
                columns["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 for each row of docs, and with the flags also ids and decoded.

    path: a tokenizers file that all executors have. Ids are those of the library with add_special_tokens=False; added tokens that
    stand in a text become their ids. A null or empty text has no ids and decodes to an empty text. Ids may be null or repeated;
    an empty table gives no rows. Only the two named columns are read. No shuffle; a task holds one Arrow batch and a
    bounded cache of words.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    schema = [rows.schema["id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if with_ids:
        schema.append(StructField("ids", ArrayType(IntegerType())))
    if with_text:
        schema.append(StructField("decoded", StringType()))
    return map_arrow(spread(rows), encoder(path, with_ids, with_text), StructType(schema)).withColumnRenamed("id", id_col)
