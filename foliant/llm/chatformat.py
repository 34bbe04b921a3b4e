"""Chats to training text by a grammar that can be read back: what a text is parsed to decides whether its content has to be escaped.

    turn = "<s>[INST] " text " [/INST]"                 of the user
         | " " text " </s>"                             of the assistant; text is what the loss mask covers
         | "<<SYS>>\\n" text "\\n<</SYS>>\\n"              of the system
         | "[TURN] " role-as-JSON "\\n" text " [/TURN]"   of anybody else

A formatted chat is its turns, one after the other. The parser goes from left to right: the next mark after an opening must be the
closing one. Each turn is rendered as it is, parsed, and compared with its source; where they differ, its content is escaped and it is
parsed again. Escaping puts a backslash behind the first character of every mark, also of marks that have some there already, and
unescaping takes one away, so both are exact inverses.

Turns are rendered where a range of (chat, turn) brings them together, so that a chat of any length is spread over many tasks. A chat
becomes one row, a long one or one that a range cuts becomes several, numbered in order.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .shared import column, map_arrow, workspace

#: Opening and closing of a turn, by role; other roles have OTHER.
FORMS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
OTHER = ("[TURN] ", " [/TURN]")
_ANGLE, _SQUARE = r"(?:/?s>|</?SYS>>)", r"(?:/?INST\]|/?TURN\])"
MARK = re.compile(rf"<{_ANGLE}|\[{_SQUARE}")
#: The first character of a mark with any number of backslashes behind it.
_ANY = re.compile(rf"<(?=\\*{_ANGLE})|\[(?=\\*{_SQUARE})")
_ESCAPED = re.compile(rf"([<\[])\\(?:(?<=<\\)(?=\\*{_ANGLE})|(?<=\[\\)(?=\\*{_SQUARE}))")
#: Code points of a formatted part, after which a chat goes on in another row.
PART = 1 << 20


class Unreadable(ValueError):
    """A text that the grammar doesn't have."""


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(role: str | None, text: str, escaped: bool) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    start, end = FORMS.get(role, OTHER)
    if role not in FORMS:
        start += escape(json.dumps(role, ensure_ascii=False)) + "\n"
    body = escape(text) if escaped else text
    return f"{start}{body}{end}", len(start), len(start) + len(body)


def parsed(text: str, at: int = 0) -> tuple[str | None, str, int]:
    """Role and text of the turn that begins at a place, and where it ends."""
    role, (start, end) = next(((r, f) for r, f in FORMS.items() if text.startswith(f[0], at)), (None, OTHER))
    if not text.startswith(start, at):
        raise Unreadable(f"no turn at {at}")
    body = at + len(start)
    close = MARK.search(text, body)
    stop = close.start() - (len(end) - len(end.lstrip())) if close else -1
    if stop < body or not text.startswith(end, stop):
        raise Unreadable(f"no end of the turn at {at}")
    if (start, end) == OTHER:
        line = text.find("\n", body, stop)
        try:
            role = json.loads(unescape(text[body : max(body, line)]))
        except ValueError:
            raise Unreadable(f"no role at {body}") from None
        body = line + 1
    return role, unescape(text[body:stop]), stop + len(end)


def turns(text: str) -> Iterator[tuple[str | None, str]]:
    at = 0
    while at < len(text):
        role, content, at = parsed(text, at)
        yield role, content


def round_trip(role: str | None, text: str) -> tuple[str, int, int]:
    """rendered(), with the content escaped if what is parsed from it isn't its source."""
    for escaped in (False, True):
        out = rendered(role, text, escaped)
        try:
            if parsed(out[0]) == (role, text, len(out[0])):
                return out
        except Unreadable:
            pass
    raise Unreadable(f"a turn of {role!r} can't be read back")


def renderer(part: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, nothing = TaskContext.get().partitionId(), object()
        rows, size, nth = [], 0, 0
        chat, first, cut = nothing, True, False
        texts, spans, length, n_turns, given = [], [], 0, 0, []
        kind = None

        def close(whole: bool) -> None:
            nonlocal nth, size, texts, spans, length, n_turns, given
            text = "".join(texts)
            if list(turns(text)) != given:
                raise Unreadable("the turns of a chat can't be told apart")
            rows.append((chat, pid, nth, whole, n_turns, text, [s for s, _ in spans], [e for _, e in spans]))
            nth, size = nth + 1, size + length
            texts, spans, length, n_turns, given = [], [], 0, 0, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [kind, pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], NAMES)

        for b in source:
            kind = b["chat"].type
            for key, role, text in zip(b["chat"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist()):
                if chat is nothing or key != chat:
                    if chat is not nothing:
                        # What a range begins or ends with may go on in another one.
                        close(not first and not cut)
                        first, cut = False, False
                    chat = key
                elif length >= part:
                    close(False)
                    cut = True
                out, start, end = round_trip(role, text)
                if role == "assistant":
                    spans.append((length + start, length + end))
                texts.append(out)
                given.append((role, text))
                length, n_turns = length + len(out), n_turns + 1
                if size >= 8 << 20 or len(rows) >= 4096:
                    yield batch()
                    rows, size = [], 0
        if chat is not nothing:
            close(False)
            yield batch()

    return run


NAMES = ["chat", "range", "nth", "whole", "n_turns", "formatted", "loss_starts", "loss_ends"]


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", path: str | None = None, part: int = PART) -> DataFrame:
    """A written table: chat, range, nth, whole, n_turns, formatted, loss_starts, loss_ends, read back from path or a workspace.

    whole: this row is the whole chat; else its rows, by range and nth, are the chat's parts one after the other. The loss mask covers the
    code points from loss_starts[i] up to loss_ends[i] of formatted. unescape() gives the texts back.

    Turns are in the order of turn_col, null first; those that share a number are in the order of role and then of a hash of the text, and
    rows that come twice are two turns. A null text is empty; a null role is a role of its own, as is any other name. Rows without
    a chat id are one chat. An empty table gives no rows. Only the four named columns are read. A part of some `part` code points is
    held at once, and a text.
    """
    chat, turn = column(conv_col).alias("chat"), column(turn_col).alias("turn")
    role, text = column(role_col).cast("string").alias("role"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text")
    order = ["chat", "turn", "role", "h"]
    some = rows.select(chat, turn, role, text).withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = [IntegerType(), LongType(), BooleanType(), LongType(), StringType(), ArrayType(IntegerType()), ArrayType(IntegerType())]
    schema = StructType([some.schema["chat"], *[StructField(n, k) for n, k in zip(NAMES[1:], kinds)]])
    at = path or workspace(rows.sparkSession, "chats")
    map_arrow(some.select("chat", "role", "text"), renderer(part), schema).write.option("compression", "zstd").parquet(at)
    return rows.sparkSession.read.schema(schema).parquet(at)


def digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of chats, those of a chat one after the other, to a row for each chat."""
    nothing = object()
    chat, rows, kind = nothing, [], None
    names = ["chat", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for b in source:
        kind = b["chat"].type
        for key, text, starts, ends in zip(*(b[c].to_pylist() for c in ("chat", "formatted", "loss_starts", "loss_ends"))):
            if chat is nothing or key != chat:
                if chat is not nothing:
                    rows.append((chat, n, told.hexdigest(), loss_chars, loss.hexdigest(), chars))
                chat, n, told, loss_chars, loss, chars = key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for role, content in turns(text):
                told.update(f"{role or ''}\n{content}\n".encode())
                n += 1
            for s, e in zip(starts, ends):
                content = unescape(text[s:e])
                loss_chars += len(content)
                loss.update(content.encode())
            chars += len(text)
        if len(rows) > 1000:
            yield batch()
            rows = []
    if chat is not nothing:
        rows.append((chat, n, told.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield batch()


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for each chat of what format_chats() has written: all by
    parsing the formatted texts, and the loss by its mask.

    A chat in one row is read where it lies. Parts of a chat meet, sorted, and are digested one after the other, as a SHA-256 of
    a whole chat can't be had otherwise; a task holds a batch of parts, never a chat.
    """
    schema = StructType([formatted.schema["chat"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])
    needed = ["chat", "formatted", "loss_starts", "loss_ends"]
    one = map_arrow(formatted.where("whole").select(*needed), digest, schema)
    parts = formatted.where("not whole").repartition("chat").sortWithinPartitions("chat", "range", "nth")
    return one.unionByName(map_arrow(parts.select(*needed), digest, schema)).withColumnRenamed("chat", conv_col)
