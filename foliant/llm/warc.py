"""WARC: archives with a record for each page, read back, and a global index of captures merged from local sorted runs.

Spark's text writer puts records into archives of bounded size, with the two line ends that close a record as its line separator;
so they lie in any store that Spark writes to, and a lost task leaves nothing behind. Reading an archive back gives a run of captures,
sorted by URL key and time. The runs are cut at common borders, and a loser tree merges what lies between two borders.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha1
from itertools import islice
from typing import Any
from urllib.parse import urlsplit
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import column, map_arrow, workspace, written

# WARC 1.1 and its profile of revisits.
VERSION, END = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Bytes of an archive, about; a longer record has an archive of its own. An archive is read as one value, so a task holds one.
ARCHIVE = 64 << 20
#: Captures between two borders of the merge, about: what a task holds.
CAPTURES = 200_000
#: Time of capture where the pages have none.
DATE = "2000-01-01T00:00:00Z"


class LoserTree:
    """Merges sorted runs: an inner node holds the loser of its match, so that the next item costs one match a level."""

    def __init__(self, runs: Iterable[Iterable[Any]], key: Callable[[Any], Any]):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.runs += [iter(())] * (self.k - len(self.runs))
        self.items: list[Any] = [None] * self.k
        self.keys: list[tuple[bool, Any, int]] = [(True, None, i) for i in range(self.k)]
        for i in range(self.k):
            self._pull(i)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _pull(self, i: int) -> None:
        item = next(self.runs[i], None)
        self.items[i], self.keys[i] = item, (True, None, i) if item is None else (False, self.key(item), i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x[0] or y[0]:
            return not x[0] or y[0] and x[2] < y[2]
        return x[1:] < y[1:]

    def _replay(self, i: int) -> None:
        """Plays run i up to the root. While the tree fills, the first to come to a node waits there."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[Any]:
        while not self.keys[first := self.losers[0]][0]:
            yield self.items[first]
            self._pull(first)
            self._replay(first)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host parts from the top-level domain down, without `www`, then path and query, in lower case, without scheme, default port and fragment."""
    try:
        parts = urlsplit((url or "").strip().lower())
        name, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    if not name:
        return (url or "").strip().lower()
    labels = name.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _field(value: str) -> str:
    """A header's value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(place: str, page_id: int | None, url: str | None, date: str, html: str, digest: str, size: int, revisit: bool, refers_to: int | None = None, refers_url: str | None = None, refers_date: str | None = None) -> str:
    """A record without its closing line ends. A revisit has the HTTP header of its capture, with the full length, and no payload.

    place: archive and number, from which the record's id is made, so that rows with the same page id have different ones. The ids
    of pages are in fields of our own.
    """
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {size}{END}{END}"
    block = http if revisit else http + html
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid5(NAMESPACE_URL, place)}>", f"WARC-Date: {_field(date)}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            lines += [f"WARC-Refers-To-Target-URI: {_field(refers_url)}", f"WARC-Refers-To-Date: {_field(refers_date or DATE)}"]
    length = len(http) if revisit else len(http) + size
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return END.join(lines) + END + END + block


def archived(most: int, run_id: str):
    """archive and value (a record) of each page. An archive is named by task and number: a task that runs again names the same."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, filled, total = TaskContext.get().partitionId(), 0, 0, 0
        for batch in source:
            names, values = [], []
            for row in zip(*(batch[c] for c in ("id", "url", "date", "html", "digest", "size", "revisit", "refers_to", "refers_url", "refers_date"))):
                page_id, url, date, html, digest, size, revisit, *refers = (x.as_py() for x in row)
                n = 1000 if revisit else size + 500
                if filled and filled + n > most:
                    number, filled = number + 1, 0
                filled, total = filled + n, total + 1
                names.append(f"{part:06d}-{number:05d}")
                values.append(record(f"{run_id}/{part}/{total}", page_id, url, date, html, digest, size, revisit, *refers))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["archive", "value"])

    return run


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields (names in lower case) and block of each record of an archive. Lengths come from the headers, so a block may hold anything."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        lines = content[at:end].decode().split(END)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = end + 4
        stop = block + int(fields["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} isn't closed at {stop}")
        yield at, stop + 4 - at, fields, content[block:stop]
        at = stop + 4


CAPTURE = "url_key string, timestamp string, id long, run string, seq long, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def captures(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The run of each archive: its captures sorted by URL key, time and record, with their place in the archive."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    for batch in source:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            rows = []
            for offset, length, fields, block in records(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                if kind == "response" and (len(payload) != size or sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: the payload at {offset} isn't what was written")
                url = fields.get("warc-target-uri")
                page_id, refers_to = (int(fields[n]) if n in fields else None for n in ("page-id", "refers-to-page-id"))
                rows.append((url_key(url), fields["warc-date"], page_id, path, 0, offset, length, size, digest, kind, refers_to, url))
            rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
            rows = [(*r[:4], i, *r[5:]) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)


ORDER = ("url_key", "timestamp", "id", "run", "seq")


def merge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures between two borders, which come run by run, in one order. They stay in Arrow's columns; the tree merges their
    numbers, by the columns of ORDER."""
    batches = list(source)
    if not batches:
        return
    whole = pa.Table.from_batches(batches)
    url, at, page, run, seq = (whole[c].to_pylist() for c in ORDER)
    cuts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
    tree = LoserTree((range(s, e) for s, e in zip(cuts, [*cuts[1:], len(run)])), lambda i: (url[i], at[i], page[i] is None, page[i] or 0, run[i], seq[i]))
    order = iter(tree)
    while some := list(islice(order, 5000)):
        yield from whole.take(pa.array(some, pa.int64())).combine_chunks().to_batches()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, least: int = LEAST, most: int = ARCHIVE) -> None:
    """Writes a record for each row of pages to archives below path.

    Of equal payloads of at least `least` bytes, the row with the largest id is a response and the others revisit it. Null ids come
    before all others; a group with null ids only has responses. Rows with equal id and payload are alike: all responses, or all
    revisits; each is a record with an id of its own. Null html is an empty payload, a null url leaves the target out. date_col: the
    time of capture, a timestamp or text in WARC's form; without it, and where it is null, DATE stands. Other columns aren't read.
    """
    html = F.coalesce(column(html_col).cast("string"), F.lit(""))
    rows = pages.select(column(id_col).cast("long").alias("id"), column(url_col).cast("string").alias("url"), html.alias("html"), _time(pages, date_col).alias("date"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max_by(F.struct("id", "url", "date"), "id").alias("one"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", *(F.col(f"one.{a}").alias(b) for a, b in (("id", "response"), ("url", "refers_url"), ("date", "refers_date"))))
    groups = written(groups, workspace(pages.sparkSession, "payloads"))
    both = rows.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.lit(False))
    both = both.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("response"))}).drop("response")
    map_arrow(both, archived(most, path), "archive string, value string").write.partitionBy("archive").option("lineSep", END + END).text(path)


def _time(pages: DataFrame, date_col: str | None) -> Column:
    if date_col is None:
        return F.lit(DATE)
    value = column(date_col)
    if not isinstance(pages.select(value).schema[0].dataType, StringType):
        value = F.date_format(F.to_utc_timestamp(value.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(value, F.lit(DATE))


def read_archives(spark, path: str) -> DataFrame:
    """The captures of all archives below path, a sorted run each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_arrow(files, captures, CAPTURE)


def merge_index(runs: DataFrame, most: int = CAPTURES) -> DataFrame:
    """All captures in the order of URL key, time and record, over partitions that follow each other.

    Borders come from a sample of the keys, so many that about `most` captures lie between two; ids, runs and places are part of the
    keys, so a URL with very many captures is cut as well. What lies between two borders comes sorted by run and place, spilling
    if it must, and is merged by a loser tree with as many leaves as there are runs; a task holds these captures and no more.
    """
    n = max(-(-runs.count() // most), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = runs.repartitionByRange(n, "url_key", "timestamp", F.col("id").asc_nulls_last(), "run", "seq").sortWithinPartitions("run", "seq")
    return map_arrow(cut, merge, CAPTURE)


def warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, path: str | None = None) -> DataFrame:
    """The merged index of archives that are written from pages and read back: one row for each row of pages, in order.

    Columns: those of CAPTURE. path: where the archives go; if none is given, below the shared folder. An empty table gives no rows.
    Nulls, repeated rows and times: see write_archives().
    """
    spark = pages.sparkSession
    path = path or f"{workspace(spark, 'warc')}/archives"
    write_archives(pages, path, id_col, url_col, html_col, date_col)
    runs = written(read_archives(spark, path), workspace(spark, "captures"))
    return merge_index(runs)
