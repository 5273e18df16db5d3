"""Conversation compaction over many conversations at once.

A message is a row (conv_id, turn, role, text, blocks); exactly one of text and blocks is not null. All windows
are partitioned by conversation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import ceil_quarter, trim
from quern.operators.tokens import message_chars

# Fixed values.
SNIP_ABOVE, SNIP_KEEP, SNIP_MARK = 2000, 800, "\n\n[... truncated ...]\n\n"
COLLAPSE_KEEP, SHORT_BELOW, HASH_CHARS = 5, 10, 200
TRANSCRIPT_CHARS, TOOL_INPUT_CHARS, TOOL_RESULT_CHARS = 50_000, 200, 300
NO_SUMMARY = "[Unable to generate summary]"
SUMMARY_HEAD = "[Context Summary — earlier conversation was compacted to save tokens]\n\n"
SUMMARY_ANSWER = "Understood. I have the context from our earlier conversation. Let me continue from where we left off."
SUMMARY_SYSTEM = "Summarize the following conversation concisely. Preserve key decisions, file paths mentioned, code changes made, and important context. Be thorough but compact. Output only the summary, no preamble."
SUMMARY_REQUEST = "Summarize this conversation:\n\n"


@dataclass(frozen=True)
class ContextConfig:
    max_context_tokens: int = 100_000
    reserve_tokens: int = 8192
    recent_message_count: int = 10


@dataclass(frozen=True)
class WindowConfig:
    max_tokens: int = 28_000
    compaction_threshold: float = 0.75
    corpus_tokens: int = 2000
    recent_message_count: int = 6


def snip_text(c: Column) -> Column:
    """The ends of a long text around a mark; texts of up to SNIP_ABOVE characters as they are."""
    return F.when(F.length(c) > SNIP_ABOVE, F.concat(F.left(c, F.lit(SNIP_KEEP)), F.lit(SNIP_MARK), F.right(c, F.lit(SNIP_KEEP)))).otherwise(c)


def snip(messages: DataFrame) -> DataFrame:
    """Long tool results cut; texts and other blocks untouched."""
    cut = F.transform("blocks", lambda b: F.when(b["type"] == "tool_result", b.withField("content", snip_text(b["content"]))).otherwise(b))
    return messages.withColumn("blocks", cut)


def is_short(role: Column, text: Column) -> Column:
    return F.coalesce((role == "assistant") & (F.length(trim(text)) < SHORT_BELOW), F.lit(False))


def tool_result_hash(role: Column, blocks: Column) -> Column:
    """What two results are compared by; null for messages that hold no tool result or are not the user's."""
    results = F.filter(blocks, lambda b: b["type"] == "tool_result")
    joined = F.array_join(F.transform(results, lambda b: F.left(F.coalesce(b["content"], F.lit("")), F.lit(HASH_CHARS))), "|")
    return F.when((role == "user") & (F.size(results) > 0), joined)


def split_recent(df: DataFrame, keep: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """With `_recent`: whether the row is among its conversation's last `keep`, and `_n`, the conversation's length."""
    by = W.partitionBy(conv)
    return df.withColumn("_recent", F.row_number().over(by.orderBy(F.desc(turn))) <= keep).withColumn("_n", F.count("*").over(by))


def collapse_rows(df: DataFrame, short: Column, result_hash: Column, keep: int = COLLAPSE_KEEP, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows that stay. The last `keep` always do. Of the older, runs of short answers go, each odd run takes the row behind it along,
    and a tool result goes that equals the one before it among those left (at first, the empty one).
    """
    df = split_recent(df.withColumn("_short", short).withColumn("_hash", result_hash), keep, conv, turn)
    by = W.partitionBy(conv, "_recent").orderBy(turn)
    df = df.withColumn("_island", F.sum(F.when(F.col("_short"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_run", F.count_if("_short").over(W.partitionBy(conv, "_recent", "_island")))
    eaten = F.lag("_short", 1, False).over(by) & (F.lag("_run", 1, 0).over(by) % 2 == 1)
    df = df.withColumn("_eaten", eaten).where("_recent or not (_short or _eaten)")
    seen = W.partitionBy(conv, "_recent", F.col("_hash").isNull()).orderBy(turn)
    df = df.withColumn("_before", F.lag("_hash", 1, "").over(seen)).where("_recent or _hash is null or _hash <> _before")
    return df.drop("_short", "_hash", "_recent", "_n", "_island", "_run", "_eaten", "_before")


def collapse(messages: DataFrame) -> DataFrame:
    """Short answers and repeated tool results of older messages go; conversations of up to five messages stay whole."""
    return collapse_rows(messages, is_short(F.col("role"), F.col("text")), tool_result_hash(F.col("role"), F.col("blocks")))


def needs_compaction(estimated: Column, system: Column, actual: Column | None = None, config: ContextConfig = ContextConfig()) -> Column:
    used = (F.coalesce(actual, estimated) if actual is not None else estimated) + system
    return used > config.max_context_tokens - config.reserve_tokens


def utilization(messages: DataFrame, max_tokens: int = 28_000, system_chars: int | Column = 0) -> DataFrame:
    """With used_tokens and utilization after each message."""
    so_far = F.sum(message_chars(F.col("text"), F.col("blocks"))).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    system = ceil_quarter(F.lit(system_chars) if isinstance(system_chars, int) else system_chars)
    df = messages.withColumn("used_tokens", system + ceil_quarter(so_far))
    return df.withColumn("utilization", F.col("used_tokens") / F.lit(max_tokens))


def message_line(role: Column, text: Column, blocks: Column) -> Column:
    part = lambda b: (
        F.when(b["type"] == "text", F.coalesce(b["text"], F.lit("")))
        .when(b["type"] == "tool_use", F.concat(F.lit("[Tool: "), b["name"], F.lit("("), F.left(F.coalesce(b["input_json"], F.lit("")), F.lit(TOOL_INPUT_CHARS)), F.lit(")]")))
        .when(b["type"] == "tool_result", F.concat(F.lit("[Result: "), F.left(F.coalesce(b["content"], F.lit("")), F.lit(TOOL_RESULT_CHARS)), F.lit("]")))
        .otherwise("")
    )
    return F.concat(role, F.lit(": "), F.coalesce(text, F.array_join(F.transform(blocks, part), "\n"), F.lit("")))


def transcripts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One text for each conversation, of at most TRANSCRIPT_CHARS characters.

    A line adds at least two characters, so later rows than TRANSCRIPT_CHARS / 2 cannot be in it and are left out before lines are gathered.
    """
    place = F.row_number().over(W.partitionBy(conv).orderBy(turn))
    rows = messages.withColumn("_p", place).where(F.col("_p") <= TRANSCRIPT_CHARS // 2)
    line = F.left(message_line(F.col("role"), F.col("text"), F.col("blocks")), F.lit(TRANSCRIPT_CHARS))
    rows = rows.select(conv, "_p", line.alias("_line"))
    before = F.coalesce(F.sum(F.length("_line") + 2).over(W.partitionBy(conv).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).where(F.col("_before") < TRANSCRIPT_CHARS)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_line"))), lambda x: x["_line"]), "\n\n")
    return rows.groupBy(conv).agg(F.left(lines, F.lit(TRANSCRIPT_CHARS)).alias("transcript"))


Summarizer = Callable[[str, str], str]


def extractive(system: str, prompt: str) -> str:
    """A summarizer without a model: the prompt's first and last lines."""
    lines = [x for x in prompt.split("\n") if x.strip()]
    return "\n".join([*lines[1:4], *(["..."] if len(lines) > 6 else []), *lines[max(4, len(lines) - 2) :]])


def summarize(rows: DataFrame, summarizer: Summarizer, system: str, prompt: str, name: str = "summary") -> DataFrame:
    """`rows` with what the summarizer answers to each prompt."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: summarizer(system, x) or "")

    # not to be evaluated twice, whatever the plan does with the column
    return rows.withColumn(name, run.asNondeterministic()(F.col(prompt)))


def auto_compact(messages: DataFrame, summarizer: Summarizer = extractive, recent: int = ContextConfig.recent_message_count) -> DataFrame:
    """Older messages give way to a summary and an answer; turns are numbered anew from 0. Conversations of up to `recent` messages stay as they are."""
    columns = messages.columns
    rows = split_recent(messages, recent)
    whole = rows.where(F.col("_n") <= recent).select(*columns)
    long = rows.where(F.col("_n") > recent)
    asked = transcripts(long.where("not _recent")).withColumn("_prompt", F.concat(F.lit(SUMMARY_REQUEST), F.col("transcript")))
    answered = summarize(asked, summarizer, SUMMARY_SYSTEM, "_prompt")
    said = F.when(F.col("summary") == "", NO_SUMMARY).otherwise(F.col("summary"))
    blocks = F.lit(None).cast(messages.schema["blocks"].dataType)
    two = F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit(SUMMARY_HEAD), said).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(SUMMARY_ANSWER).alias("text")),
    ))
    head = answered.select("conv_id", two).withColumn("blocks", blocks)
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) + 1
    tail = long.where("_recent").withColumn("turn", place.cast("long"))
    names = ["conv_id", "turn", "role", "text", "blocks"]
    return whole.select(*names).unionByName(head.select(*names)).unionByName(tail.select(*names))


def compact_window(messages: DataFrame, summarizer: Summarizer | None = None, config: WindowConfig = WindowConfig(), system_chars: int = 0) -> DataFrame:
    """Conversations at or over the threshold are snipped, then collapsed; those still over it are summarised if there is a summarizer.

    All windows are over conversations, so the messages are dealt out once, by the session's number of partitions: one stage sorts the texts again
    for each step, and partitions that are put together by their compressed size would be many times larger in its memory.
    """
    names = ["conv_id", "turn", "role", "text", "blocks"]
    snipped = snip(messages.select(*names)).repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")

    def used(df: DataFrame) -> DataFrame:
        total = F.sum(message_chars(F.col("text"), F.col("blocks"))).over(W.partitionBy("conv_id"))
        return df.withColumn("_over", (ceil_quarter(F.lit(system_chars)) + ceil_quarter(total)) / F.lit(config.max_tokens) >= config.compaction_threshold)

    first = used(snipped)
    small, big = first.where("not _over").select(*names), first.where("_over").select(*names)
    second = used(collapse(big))
    done = small.unionByName(second.where("not _over").select(*names))
    rest = second.where("_over").select(*names)
    return done.unionByName(auto_compact(rest, summarizer, config.recent_message_count) if summarizer else rest)


def window_stats(messages: DataFrame, config: WindowConfig = WindowConfig(), system_chars: int = 0) -> DataFrame:
    used = ceil_quarter(F.lit(system_chars)) + ceil_quarter(F.sum(message_chars(F.col("text"), F.col("blocks"))))
    return messages.groupBy("conv_id").agg(F.lit(config.max_tokens).cast("long").alias("total_tokens"), used.alias("used_tokens"), (used / F.lit(config.max_tokens)).alias("utilization"), F.count("*").alias("message_count"))
