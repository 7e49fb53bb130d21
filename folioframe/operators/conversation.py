"""Conversation windows, summaries and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .ordering import in_order

TURNS = 3
DEFAULT_TITLE = "新对话"
TITLE_LENGTH = 20


def recent_messages(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """The last 2 * ``turns`` messages of each conversation; 0 turns means all."""
    if not turns:
        return messages
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= 2 * turns).drop("__n")


def with_citations(content: Column, role: Column, sources: Column) -> Column:
    """An assistant's text followed by the pages it cites, each once; other texts as they are."""
    cited = F.array_join(F.array_distinct(F.transform(sources, lambda s: F.concat(F.lit("《"), s["source"], F.lit("》第"), s["page"].cast("string"), F.lit("页")))), "、")
    return F.when((role == "assistant") & (F.size(sources) > 0), F.concat(content, F.lit("\n\n（本次回答依据："), cited, F.lit("）"))).otherwise(content)


def titles(messages: DataFrame) -> DataFrame:
    """(conv_id, title): the first user message on one line, cut at 20 characters."""
    first = messages.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("t"))
    line = F.replace(strip(F.col("t")), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(line) > TITLE_LENGTH, F.concat(F.substring(line, 1, TITLE_LENGTH), F.lit("..."))).otherwise(line)
    return first.select("conv_id", F.when(F.length(line) > 0, cut).otherwise(F.lit(DEFAULT_TITLE)).alias("title"))


def summary_horizon(messages: DataFrame, summaries: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, n, kept_from, summary_upto, due): where the window begins, and whether what left it needs a new summary."""
    n = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    kept = F.greatest(F.lit(0), F.col("n") - 2 * turns)
    upto = F.coalesce("summary_upto", F.lit(0))
    return n.join(summaries.select("conv_id", "summary_upto"), "conv_id", "left").select(
        "conv_id", "n", kept.alias("kept_from"), upto.alias("summary_upto"), (kept > upto).alias("due")
    )


def session_history(messages: DataFrame, summaries: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, place, role, content): the summary as a question and its answer, then the last turns."""
    own = recent_messages(messages, turns)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) + 1
    lines = own.select("conv_id", place.alias("place"), "role", F.col("text").alias("content"))
    told = summaries.where(F.length("summary") > 0).join(messages.select("conv_id").distinct(), "conv_id", "left_semi")
    pair = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("user").alias("role"), F.concat(F.lit("（以下是本次对话前面已经确立的要点，供你理解后续追问）\n"), F.col("summary")).alias("content")),
        F.struct(F.lit(1).alias("place"), F.lit("assistant").alias("role"), F.lit("已记录这些要点。").alias("content")),
    )
    return told.select("conv_id", F.inline(pair)).unionByName(lines)


def summary_transcripts(messages: DataFrame, turns: int = TURNS, most: int = 600) -> DataFrame:
    """(conv_id, transcript): what has left the window, each message cut at ``most`` characters, under its speaker."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    out = messages.withColumn("n", n).withColumn("place", place).where(F.col("place") <= F.col("n") - 2 * turns)
    line = F.concat(F.when(F.col("role") == "user", F.lit("用户")).otherwise(F.lit("助手")), F.lit("："), F.substring("text", 1, most))
    parts = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return out.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("transcript"))


def saved(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of ``new`` (conv_id, title, updated_at) that keeps the summary a conversation has."""
    old = conversations.select("conv_id", "summary", "summary_upto")
    updated = new.join(old, "conv_id", "left").select("conv_id", "title", "updated_at", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("summary_upto", F.lit(0)).alias("summary_upto"))
    return conversations.join(new, "conv_id", "left_anti").select(*updated.columns).unionByName(updated)


def summary_saved(conversations: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries (conv_id, summary, upto) put into conversations that exist; others are ignored."""
    new = summaries.select("conv_id", F.col("summary").alias("s"), F.col("upto").alias("u"))
    return conversations.join(new, "conv_id", "left").select(
        *[c for c in conversations.columns if c not in ("summary", "summary_upto")], F.coalesce("s", "summary").alias("summary"), F.coalesce("u", "summary_upto").alias("summary_upto")
    )


def messages_of(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The messages of the asked-for conversations (conv_id); none for unknown ones."""
    return messages.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")


def summaries_of(conversations: DataFrame, summaries: DataFrame) -> DataFrame:
    """(conv_id, summary, summary_upto) of the asked-for conversations; empty and 0 without a summary."""
    own = conversations.select("conv_id").distinct().join(summaries.select("conv_id", "summary", "summary_upto"), "conv_id", "left")
    return own.select("conv_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("summary_upto", F.lit(0)).alias("summary_upto"))


def deleted(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``rows`` (messages or conversations) without those of the given conversations."""
    return rows.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")


def listed(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, updated_at, ...) with ``place`` from 1: newest first, of equals the least id."""
    return in_order(conversations, [F.desc("updated_at"), F.col("conv_id")], "place").withColumn("place", F.col("place") + 1)
