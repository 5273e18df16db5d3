"""Prompt-cache breakpoints on requests, messages as rows (conv_id, turn, role, text, blocks, cache)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What marks a boundary; blocks and tools carry it in `cache_control`.
MARK = "ephemeral"


def mark_last(items: Column) -> Column:
    """Structs with a `cache_control` field, the last one marked; null and empty arrays stay."""
    return F.transform(items, lambda x, i: F.when(i == F.size(items) - 1, x.withField("cache_control", F.lit(MARK))).otherwise(x))


def text_block(text: Column) -> Column:
    """A marked text block in place of a plain string."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(MARK).alias("cache_control")))


def system_blocks(text: Column, blocks: Column) -> Column:
    return F.when(text.isNotNull(), text_block(text)).otherwise(mark_last(blocks))


def last_flagged(messages: DataFrame, name: str = "last_static") -> DataFrame:
    """With whether a message is its conversation's last one flagged as static."""
    return messages.withColumn(name, F.coalesce(F.col("turn") == F.max(F.when(F.col("cache"), F.col("turn"))).over(W.partitionBy("conv_id")), F.lit(False)))


def breakpoints(messages: DataFrame) -> DataFrame:
    """The last flagged message gets a mark on its last block (a text becomes a block) and loses its flag; other flags stay."""
    rows = last_flagged(messages, "_l")
    marked = F.when(F.col("text").isNotNull(), text_block(F.col("text"))).otherwise(mark_last(F.col("blocks")))
    rows = rows.withColumn("blocks", F.when(F.col("_l"), marked).otherwise(F.col("blocks")))
    return rows.withColumn("text", F.when(~F.col("_l"), F.col("text"))).withColumn("cache", F.when(~F.col("_l"), F.col("cache"))).drop("_l")


def request_breakpoints(requests: DataFrame) -> DataFrame:
    """Requests (system_text, system_blocks, tools) with their system's and tools' last entries marked."""
    rows = requests.withColumn("system_blocks", system_blocks(F.col("system_text"), F.col("system_blocks"))).withColumn("system_text", F.lit(None).cast("string"))
    return rows.withColumn("tools", mark_last(F.col("tools")))
