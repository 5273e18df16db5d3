"""Strategy outcomes: leaderboard, agent profiles, suggestions and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import fixed, pad_end, percent

# Fixed values.
MIN_USES, TOP = 2, 5
NAME_WIDTH, EMPTY = 27, "No strategies with 2+ uses recorded yet."


def select(rows: DataFrame, generation: int | None = None, category: str | None = None, agent_id: str | None = None) -> DataFrame:
    for name, value in (("generation", generation), ("category", category), ("agent_id", agent_id)):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def _stats(rows: DataFrame, *by: str) -> DataFrame:
    o = F.col("outcome")
    return rows.groupBy(*by).agg(
        F.count("*").alias("uses"), F.count_if(o["success"]).alias("successes"), F.avg(o["duration"]).alias("avg_duration"),
        F.avg((o["testsPassedAfter"] - o["testsPassedBefore"]).cast("double")).alias("avg_test_improvement"), F.min("seq").alias("first_seq"),
    ).withColumn("success_rate", F.col("successes") / F.col("uses"))


def leaderboard(rows: DataFrame, min_uses: int = MIN_USES) -> DataFrame:
    """(corpus_id, category, rank, name, ...) of strategies with enough uses: by rate, then uses, then first seen."""
    by = W.partitionBy("corpus_id", "category").orderBy(F.desc("success_rate"), F.desc("uses"), "first_seq")
    return _stats(rows, "corpus_id", "category", "name").where(F.col("uses") >= min_uses).withColumn("rank", F.row_number().over(by)).drop("first_seq")


def profiles(rows: DataFrame) -> DataFrame:
    """(corpus_id, agent_id, total, successes, success_rate, category_counts) of each agent."""
    per = rows.groupBy("corpus_id", "agent_id", "category").agg(F.count("*").alias("n"), F.count_if(F.col("outcome.success")).alias("s"))
    out = per.groupBy("corpus_id", "agent_id").agg(F.sum("n").alias("total"), F.sum("s").alias("successes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    return out.withColumn("success_rate", F.coalesce(F.try_divide("successes", "total"), F.lit(0.0)))


def top_strategies(rows: DataFrame, n: int = TOP) -> DataFrame:
    """(corpus_id, agent_id, rank, name, ...): each agent's most used strategies, ties by first seen."""
    by = W.partitionBy("corpus_id", "agent_id").orderBy(F.desc("uses"), "first_seq")
    return _stats(rows, "corpus_id", "agent_id", "name").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).drop("first_seq")


def suggest(rows: DataFrame) -> DataFrame:
    """The best strategy of each category that has one with enough uses."""
    return leaderboard(rows).where("rank = 1")


def report(board: DataFrame) -> DataFrame:
    """(corpus_id, report): the leaderboard as text."""
    name = F.when(F.length("name") > NAME_WIDTH, F.concat(F.left("name", F.lit(24)), F.lit("..."))).otherwise(F.col("name"))
    delta = fixed(F.col("avg_test_improvement"), 1)
    delta = F.when(F.col("avg_test_improvement") >= 0, F.concat(F.lit("+"), delta)).otherwise(delta)
    line = F.concat(F.lit("  "), pad_end(name, 28), F.lit(" "), pad_end(percent(F.col("success_rate")), 8), F.lit(" "), pad_end(F.col("uses").cast("string"), 6), F.lit(" "), delta)
    head = F.concat(F.lit("\n  "), F.upper("category"), F.lit("\n  " + "─" * 56 + "\n  " + "Name".ljust(28) + " " + "Rate".ljust(8) + " " + "Uses".ljust(6) + " Avg Tests"))
    lines = lambda key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), "\n")
    parts = board.withColumn("_l", line).groupBy("corpus_id", "category").agg(lines("rank", "_l").alias("_b")).withColumn("_c", F.concat(head, F.lit("\n"), F.col("_b")))
    return parts.groupBy("corpus_id").agg(F.concat(F.lit("Strategy Leaderboard\n" + "═" * 60 + "\n"), lines("category", "_c")).alias("report"))
