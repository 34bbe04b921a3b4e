"""Chunks of bounded token counts, with overlap, from a document's elements.

Packing carries a state that resets on size and section, so it runs in Python, a document at a time over rows sorted by document and
order. Only the current chunk's elements are held, never a whole document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"(?<=[.!?])\s+")

CHUNK = (
    "document_id string, chunk_index int, content string, content_type string, token_count int, page_start int, page_end int, section string,"
    " section_path array<string>, paragraph_start int, paragraph_end int, styles array<string>, element_metadata array<map<string,string>>"
)


@dataclass(frozen=True)
class Sizes:
    """Tokens that a chunk aims at when long elements are cut, has at most, and repeats from the chunk before."""

    target: int = 500
    most: int = 700
    overlap: int = 75

    def __post_init__(self):
        if self.target < 1 or self.most < 1 or self.overlap < 0 or self.target > self.most or self.overlap >= self.most:
            raise ValueError("sizes must be positive, with target up to most and overlap below it")


@dataclass(frozen=True)
class Element:
    text: str
    kind: str = "text"
    path: tuple[str, ...] = ()
    section: str | None = None
    page: int | None = None
    paragraph: int | None = None
    style: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def tokens(self) -> int:
        return len(self.text.split())


def sentences(text: str) -> list[str]:
    return [s for part in SENTENCE.split(text) if (s := part.strip())]


def fragments(element: Element, sizes: Sizes) -> list[Element]:
    """The element, or if it is above the most, parts of whole sentences up to the target; a sentence above the most is cut by words."""
    if element.tokens <= sizes.most:
        return [element]
    parts: list[str] = []
    held: list[str] = []
    n = 0
    for sentence in sentences(element.text):
        words = sentence.split()
        if held and (len(words) > sizes.most or n + len(words) > sizes.target):
            parts.append(" ".join(held))
            held, n = [], 0
        if len(words) > sizes.most:
            parts += [" ".join(words[i : i + sizes.target]) for i in range(0, len(words), sizes.target)]
        else:
            held.append(sentence)
            n += len(words)
    if held:
        parts.append(" ".join(held))
    told = {"is_split_fragment": "true", "split_fragment_count": str(len(parts))}
    return [replace(element, text=p, metadata={**element.metadata, **told, "split_fragment_index": str(i)}) for i, p in enumerate(parts)]


def overlap(buffer: list[Element], following: Element, most: int) -> Element | None:
    """The last sentences of the buffer's body, up to `most` tokens, under the section of what follows."""
    body = [e for e in buffer if e.kind != "heading"]
    chosen: list[str] = []
    n = 0
    for sentence in reversed([s for e in body for s in sentences(e.text)]):
        words = sentence.split()
        if chosen and n + len(words) > most:
            break
        words = words[-most:] if len(words) > most else words
        chosen.append(sentence if len(words) == len(sentence.split()) else " ".join(words))
        n += len(words)
        if n >= most:
            break
    if not chosen:
        return None
    text, last = " ".join(reversed(chosen)), body[-1]
    told = {"is_overlap": "true", "overlap_token_count": str(len(text.split()))}
    return replace(last, text=text, path=following.path, section=following.section, metadata={**last.metadata, **told})


def joined(elements: list[Element]) -> str:
    """Texts with a blank line between, list items on lines that follow each other."""
    out, before = "", None
    for e in elements:
        text = e.text.strip()
        out += ("" if before is None else "\n" if before.kind == e.kind == "list" else "\n\n") + text
        before = e
    return out.strip()


def chunk(document: str, index: int, buffer: list[Element]) -> tuple[Any, ...]:
    content = joined(buffer)
    body = [e.kind for e in buffer if e.kind != "heading"]
    kind = "table" if "table" in body else "list" if body and set(body) == {"list"} else "text"
    path = max((e.path for e in buffer if e.path), key=len, default=())
    pages, paragraphs = [e.page for e in buffer if e.page is not None], [e.paragraph for e in buffer if e.paragraph is not None]
    styles = list(dict.fromkeys(e.style for e in buffer if e.style))
    ends = lambda x: (min(x, default=None), max(x, default=None))
    return (document, index, content, kind, len(content.split()), *ends(pages), path[-1] if path else None, list(path), *ends(paragraphs), styles, [e.metadata for e in buffer if e.metadata])


class Packer:
    """Chunks of one document, element by element."""

    def __init__(self, document: str, sizes: Sizes):
        self.document, self.sizes, self.index = document, sizes, 0
        self.buffer: list[Element] = []
        self.tokens = 0

    def flush(self) -> Iterator[tuple[Any, ...]]:
        if self.buffer:
            yield chunk(self.document, self.index, self.buffer)
            self.index, self.buffer, self.tokens = self.index + 1, [], 0

    def put(self, whole: Element) -> Iterator[tuple[Any, ...]]:
        if not whole.text.strip():
            return
        for e in fragments(whole, self.sizes):
            parted = bool(self.buffer) and self.buffer[-1].path != e.path and any(x.kind != "heading" for x in self.buffer)
            if parted or self.buffer and self.tokens + e.tokens > self.sizes.most:
                again = overlap(self.buffer, e, self.sizes.overlap) if not parted and self.sizes.overlap else None
                yield from self.flush()
                if again and again.tokens + e.tokens <= self.sizes.most:
                    self.buffer, self.tokens = [again], again.tokens
            self.buffer.append(e)
            self.tokens += e.tokens


def packing(sizes: Sizes, schema: pa.Schema, piece: str | None = None):
    """Packs rows that come document by document in order. piece: a column with the number of a part of a document that is packed for itself;
    it is the last column of the chunks then."""
    names = ["document_id", "text", "element_type", "section_path", "section", "page_number", "paragraph_number", "style", "metadata"]

    def batch(rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(_column(c, f), f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer: Packer | None = None
        of: tuple[Any, ...] = ()
        for part in source:
            out: list[tuple[Any, ...]] = []
            pieces = part[piece].to_pylist() if piece else [None] * part.num_rows
            for nth, document, text, kind, path, section, page, paragraph, style, metadata in zip(pieces, *(part[n].to_pylist() for n in names)):
                if packer is None or (packer.document, *of) != (document, *((nth,) if piece else ())):
                    out += (c + of for c in packer.flush()) if packer else []
                    packer, of = Packer(document, sizes), (nth,) if piece else ()
                out += (c + of for c in packer.put(Element(text or "", kind, tuple(path or ()), section, page, paragraph, style, dict(metadata or ()))))
            yield batch(out)
        if packer:
            yield batch([c + of for c in packer.flush()])

    return run


def _column(values: Any, to: pa.Field) -> list[Any]:
    return [[list(m.items()) for m in v] for v in values] if to.name == "element_metadata" else list(values)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def packable(elements: DataFrame, document: str, order: str, *more: str) -> DataFrame:
    """The columns that packing() reads, with __order."""
    return elements.select(F.col(document).cast("string").alias("document_id"), F.col(order).alias("__order"), "text", "element_type", "section_path", "section", "page_number", "paragraph_number", "style", "metadata", *more)


def build_chunks(elements: DataFrame, sizes: Sizes | None = None, document: str = "document_id", order: str = "unit_ordinal") -> DataFrame:
    """Chunks (columns of CHUNK) of the documents whose elements analyze() gives. One shuffle, by document: a document is packed in one
    task, which holds one chunk of it at a time. For documents that are long for one task there is long_documents.build_chunks()."""
    rows = packable(elements, document, order).repartition("document_id").sortWithinPartitions("document_id", "__order")
    return rows.mapInArrow(packing(sizes or Sizes(), arrow_schema(CHUNK)), CHUNK)
