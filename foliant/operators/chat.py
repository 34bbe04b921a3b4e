"""Chats: titles, history, and their state after a series of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import chat_title, history_title
from .numbering import numbered


def titles(messages: DataFrame, chat: str = "conv_id", turn: str = "turn") -> DataFrame:
    """chat and title of chats with a question: their first one, shortened."""
    first = messages.where("role = 'user'").groupBy(chat).agg(F.min_by("text", turn).alias("question"))
    return first.select(chat, chat_title(F.col("question")).alias("title"))


def history(messages: DataFrame, active: int | None = None, chat: str = "conv_id", turn: str = "turn", user: str | None = None) -> DataFrame:
    """user, chat, label, messages, place: chats that have messages, newest (the greatest chat) first.

    user: whose chats they are; each user's are numbered for themselves. Without it they count as one user's, and are numbered
    range by range: no task sees more than its range and a count for each.
    """
    keys = [user, chat] if user else [chat]
    asked = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(turn)))
    rows = messages.groupBy(*keys).agg(asked.alias("question"), F.count("*").alias("messages")).where("question is not null")
    label = history_title(chat_title(F.col("question")), F.col(chat) == F.lit(active) if active is not None else F.lit(False))
    rows = rows.select(*keys, label.alias("label"), "messages")
    if not user:
        return numbered(rows, chat, "place", descending=True)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(chat))))


def after(actions: DataFrame, user: str = "user_id", order: str = "seq") -> DataFrame:
    """user, chat, messages, title of the chats that are left after actions (action: ask, clear or delete; chat; text).

    A clear takes back messages and title, a delete the chat; what came before the last of them doesn't count. A chat without
    messages is kept only if it was cleared.
    """
    last = F.max(F.when(F.col("action").isin("clear", "delete"), F.struct(order, "action"))).over(Window.partitionBy(user, "chat"))
    rows = actions.withColumn("__last", last)
    live = (F.col("action") == "ask") & (F.col("__last").isNull() | (F.col(order) > F.col(f"__last.{order}")))
    out = rows.groupBy(user, "chat").agg(F.count_if(live).alias("messages"), F.min_by(F.when(live, F.col("text")), F.when(live, F.col(order))).alias("first"), F.first("__last.action").alias("ended"))
    return out.where("messages > 0 or ended = 'clear'").select(user, "chat", "messages", chat_title(F.col("first")).alias("title"))
