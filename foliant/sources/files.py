"""Blobs, documents, tables: how data come in and go out."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import document_mime, file_name, file_type, image_mime
from ..functions.text import is_blank, required
from .pdf import pdf_images, pdf_units

SUPPORTED = ("pdf", "docx")
#: Bytes of an image that are searched for its size.
HEADERS = 1 << 20
UNIT = "path string, unit_ordinal int, text string, page_number int, section string, paragraph_number int, style string, error string"
IMAGE = "path string, image_index int, file_name string, mime_type string, content binary, page_number int, width int, height int"


def blobs(spark: SparkSession, container: str, contents: bool = True) -> DataFrame:
    """path, name (below the container), size and content of all files below a container. Only what is selected is read."""
    if not container or not container.strip():
        raise ValueError("the container's name is empty")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(container)
    base = container.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.regexp_replace("path", f"^.*?{base}/", "")
    return files.select("path", name.alias("name"), F.col("length").alias("size"), *(["content"] if contents else []))


def documents(files: DataFrame) -> DataFrame:
    """The files that can be parsed, with file_name, file_type, mime_type, and a digest where their content is at hand."""
    rows = files.withColumns({"file_name": file_name(F.col("path")), "file_type": file_type(F.col("path"))}).where(F.col("file_type").isin(*SUPPORTED))
    rows = rows.withColumn("mime_type", document_mime(F.col("file_type")))
    return rows.withColumn("checksum", F.sha2("content", 256)) if "content" in files.columns else rows


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def docx_units(content: bytes) -> list[dict[str, Any]]:
    """Paragraphs with text of a docx file: text, style name, place among all paragraphs from 1, and the heading so far."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names: dict[str, str] = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                named = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId", "")] = named.get(f"{_W}val", "") if named is not None else ""
    out, section = [], None
    for n, paragraph in enumerate(body.findall(f"{_W}p") if body is not None else [], 1):
        parts = []
        for node in paragraph.iter():
            parts.append(node.text or "" if node.tag == f"{_W}t" else "\t" if node.tag == f"{_W}tab" else "\n" if node.tag in (f"{_W}br", f"{_W}cr") else "")
        text = "".join(parts).strip()
        chosen = paragraph.find(f"{_W}pPr/{_W}pStyle")
        style = names.get(chosen.get(f"{_W}val", ""), chosen.get(f"{_W}val")) if chosen is not None else "Normal"
        if text:
            section = text if style.lower().startswith("heading") else section
            out.append({"text": text, "style": style, "paragraph_number": n, "section": section})
    return out


def docx_images(content: bytes) -> list[dict[str, Any]]:
    """Images that a docx file's relationships name, each part once; those outside of the file are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        rels = "word/_rels/document.xml.rels"
        if rels not in archive.namelist():
            return []
        out: dict[str, dict[str, Any]] = {}
        for rel in ElementTree.fromstring(archive.read(rels)).iter(f"{_R}Relationship"):
            part = "word/" + rel.get("Target", "").lstrip("/").removeprefix("word/")
            if rel.get("TargetMode") != "External" and rel.get("Type", "").endswith("/image") and part not in out and part in archive.namelist():
                out[part] = {"file_name": part.rsplit("/", 1)[-1], "content": archive.read(part)}
        return list(out.values())


Parser = Callable[[bytes], list[dict[str, Any]]]


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Units (UNIT) of documents. parsers: by file type, in place of the engine's own or for other types.

    A file that can't be parsed gives one row with an error and no text, and the others go on.
    """
    known: dict[str, Parser] = {"docx": docx_units, "pdf": pdf_units, **(parsers or {})}
    names = [c.split()[0] for c in UNIT.split(", ")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, kind, content in zip(batch["path"].to_pylist(), batch["file_type"].to_pylist(), batch["content"]):
                try:
                    if kind not in known:
                        raise ValueError(f"no parser for {kind}")
                    data = content.as_py()
                    if not data:
                        raise ValueError("the document is empty")
                    rows = [{"path": path, "unit_ordinal": n, **u} for n, u in enumerate(known[kind](data))]
                except Exception as e:
                    rows = [{"path": path, "unit_ordinal": 0, "error": str(e) or type(e).__name__}]
                kinds = {"string": pa.string(), "int": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in (c.split() for c in UNIT.split(", "))], names)

    return files.select("path", "file_type", "content").mapInArrow(run, UNIT)


def images(files: DataFrame) -> DataFrame:
    """image_index, file_name, mime_type, content and page_number of the images in documents, numbered within each. Files that can't
    be read have none. A document's images leave its task one by one."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, kind, content in zip(batch["path"], batch["file_type"].to_pylist(), batch["content"]):
                try:
                    rows = (docx_images if kind == "docx" else pdf_images)(content.as_py() or b"")
                except Exception:  # parse() tells what is wrong with the file
                    continue
                for n, x in enumerate(rows):
                    columns = [pa.array([path.as_py()]), pa.array([n], pa.int32()), pa.array([x["file_name"]]), pa.array([x["content"]], pa.binary()), pa.array([x.get("page_number")], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "image_index", "file_name", "content", "page_number"])

    rows = files.select("path", "file_type", "content").mapInArrow(run, "path string, image_index int, file_name string, content binary, page_number int")
    return rows.select("path", "image_index", "file_name", image_mime(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).alias("mime_type"), "content", "page_number")


def _size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height in the headers of png, gif, jpeg and bmp files."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


def image_size(content):
    """width and height of images, null where they can't be read."""

    @F.pandas_udf("struct<width:int,height:int>")
    def size(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_size(bytes(x or b"")) for x in heads], columns=["width", "height"], dtype="Int32")

    # A jpeg's sizes stand behind its other headers, which may be long: where they aren't within HEADERS, the whole value is walked.
    # All other formats have them in the first bytes.
    head = size(F.substring(content, 1, HEADERS))
    more = size(F.when(head["width"].isNull() & (F.length(content) > HEADERS) & (F.substring(content, 1, 2) == F.unhex(F.lit("FFD8"))), content))
    return F.when(head["width"].isNotNull(), head).otherwise(more)


def largest(found: DataFrame, by: str = "path", order: str = "image_index") -> DataFrame:
    """Of each document the image with the greatest area, sizes that aren't known as 0; of equal ones the first."""
    area = F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))
    return found.groupBy(by).agg(F.max_by(F.struct(*[c for c in found.columns if c != by]), F.struct(area, -F.col(order))).alias("i")).select(by, "i.*")


def blob_name(name):
    """A blob's name without white space around; null where it is blank or ends in . or .. as a folder does."""
    bare = required(name)
    return F.when(~file_name(bare).isin(".", "..") & (file_name(bare) != ""), bare)


def mock_chunks(spark: SparkSession, question: str, keywords: list[str], rows: list[tuple], schema: str, k: int) -> DataFrame:
    """Fixed chunks for tests: the first k rows if the question names a keyword, else none."""
    asked = (question or "").lower()
    return spark.createDataFrame(rows[: k if any(w.lower() in asked for w in keywords) else 0], schema)


def distinct_images(found: DataFrame, order: str = "place") -> DataFrame:
    """Images (path, page_number, xref, ...) each once a page, numbered through the document from 0."""
    first = Window.partitionBy("path", "page_number", "xref").orderBy(order)
    once = found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return once.withColumn("image_index", F.row_number().over(Window.partitionBy("path").orderBy("page_number", order)) - 1)


def counts(units: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path, page_count, paragraph_count of documents, and with their images (path, ...) also image_count, 0 for none."""
    rows = units.groupBy("path").agg(F.count_distinct("page_number").alias("page_count"), F.count("paragraph_number").alias("paragraph_count"))
    if found is None:
        return rows
    return rows.join(found.groupBy("path").agg(F.count("*").alias("image_count")), "path", "left").fillna(0, "image_count")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header, quoted fields and line ends within them."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_url(container, blob, secret: str | None = None, expires=None):
    """Where a blob is read: container and name, null for a blank name. With a secret, a link that holds until `expires` (a timestamp
    column): its end in seconds and an HMAC-SHA-256 of place and end, made in the JVM; valid_url() tells whether it still holds."""
    place = F.when(~is_blank(blob), F.concat_ws("/", container, blob))
    if secret is None:
        return place
    until = F.unix_timestamp(expires).cast("string")
    return F.concat(place, F.lit("?expires="), until, F.lit("&signature="), _signature(F.concat_ws("\n", place, until), secret))


def valid_url(url, secret: str, now):
    """Whether a signed link is whole, ours, and not over at `now`."""
    part = lambda n: F.regexp_extract(url, r"^(.*)\?expires=(\d+)&signature=([0-9a-f]{64})$", n)
    own = _signature(F.concat_ws("\n", part(1), part(2)), secret)
    return F.coalesce((part(3) == own) & (F.unix_timestamp(now) < part(2).cast("long")), F.lit(False))


def _signature(text, secret: str):
    """HMAC (RFC 2104) of a text with SHA-256, in hex."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
