"""Token counts of strings, blocks and message lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ceil_quarter, estimate

# An image's characters in the heuristic and tokens in the accurate count, tokens that frame a message.
IMAGE_CHARS, IMAGE_TOKENS, FRAME_TOKENS = 1000, 1000, 4


def estimate_string(c: Column) -> Column:
    return estimate(c)


def block_chars(b: Column) -> Column:
    """Characters that a content block counts for."""
    n = lambda name: F.coalesce(F.length(b[name]), F.lit(0))
    return (
        F.when(b["type"] == "text", n("text")).when(b["type"] == "thinking", n("thinking")).when(b["type"] == "tool_use", n("name") + n("input_json"))
        .when(b["type"] == "tool_result", n("content")).when(b["type"] == "image_url", F.lit(IMAGE_CHARS)).otherwise(F.lit(0)).cast("long")
    )


def message_chars(text: Column, blocks: Column) -> Column:
    """Characters of a message, whose content is either a text or blocks."""
    return F.coalesce(F.length(text).cast("long"), F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + block_chars(b)), F.lit(0).cast("long"))


def estimate_messages(messages: DataFrame, *by: str) -> DataFrame:
    """Heuristic tokens of each message list: characters are added up first and rounded once."""
    return messages.groupBy(*by).agg(ceil_quarter(F.sum(message_chars(F.col("text"), F.col("blocks")))).alias("tokens"))


def encoding_for(model: Column) -> Column:
    """Name of a model's vocabulary."""
    return F.when(F.coalesce(model, F.lit("")).startswith("claude-3-5"), "o200k_base").otherwise("cl100k_base")


class Tokenizer:
    """An accurate counter that is loaded once in each worker; a failed load is remembered.

    `load` gives a callable from string to count, for example the length of a BPE encoding.
    """

    _state: dict = {}

    def __init__(self, load=None, name: str = "cl100k_base"):
        self.load, self.name = load or self._tiktoken, name

    def _tiktoken(self):
        import tiktoken

        encoding = tiktoken.get_encoding(self.name)
        return lambda s: len(encoding.encode(s, disallowed_special=()))

    def counter(self):
        if self.name not in self._state:
            try:
                self._state[self.name] = self.load()
            except Exception:  # noqa: BLE001  whatever keeps the vocabulary away, the heuristic stands in
                self._state[self.name] = None
        return self._state[self.name]

    @classmethod
    def reset(cls) -> None:
        cls._state.clear()

    def count(self, c: Column) -> Column:
        """Tokens of each string, null where the tokenizer cannot be had."""
        own = self

        @F.pandas_udf("long")
        def run(s: pd.Series) -> pd.Series:
            f = own.counter()
            return pd.Series([None if f is None else f(x or "") for x in s], dtype="Int64")

        return run(c)


def count_strings(df: DataFrame, text: str = "text", tokenizer: Tokenizer | None = None, name: str = "tokens") -> DataFrame:
    """Accurate tokens of a string column; the heuristic where the tokenizer cannot be had."""
    return df.withColumn(name, F.coalesce((tokenizer or Tokenizer()).count(F.col(text)), estimate(F.col(text))))


def count_messages(messages: DataFrame, *by: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Accurate tokens of each message list: those of its blocks and FRAME_TOKENS a message.

    Without a tokenizer the whole list gets the heuristic count, which has no framing.
    """
    counted = (tokenizer or Tokenizer()).count
    one = F.struct(F.lit("text").alias("type"), F.col("text").alias("s"))
    parts = F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "tool_use", F.concat(F.coalesce(b["name"], F.lit("")), F.coalesce(b["input_json"], F.lit("")))).when(b["type"] == "tool_result", b["content"]).otherwise("").alias("s")))
    rows = messages.select(*by, message_chars(F.col("text"), F.col("blocks")).alias("chars"), F.posexplode_outer(F.when(F.col("text").isNotNull(), F.array(one)).otherwise(parts)).alias("at", "b"))
    rows = rows.withColumn("n", F.when(F.col("b.type") == "image_url", F.lit(IMAGE_TOKENS)).otherwise(counted(F.coalesce("b.s", F.lit("")))))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    total = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.count_if(F.col("n").isNull()).alias("failed"), F.count_if(first).alias("messages"), F.sum(F.when(first, F.col("chars")).otherwise(0)).alias("chars"))
    return total.select(*by, F.when(F.col("failed") > 0, ceil_quarter(F.col("chars"))).otherwise(F.col("n") + FRAME_TOKENS * F.col("messages")).cast("long").alias("tokens"))
