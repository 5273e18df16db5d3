"""Embedding caches: what is stale, refreshing it, and purging what has no section."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Embedder = Callable[[str], "list[float] | None"]


def embed(rows: DataFrame, embedder: Embedder, text: str, name: str = "vector") -> DataFrame:
    """`rows` with a vector of each text; null where the embedder has none."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else embedder(x))

    # not to be evaluated twice, whatever the plan does with the column
    return rows.withColumn(name, run.asNondeterministic()(F.col(text)))


def latest(cache: DataFrame) -> DataFrame:
    """One entry for each path, the last by ord."""
    last = F.row_number().over(W.partitionBy("corpus_id", "path").orderBy(F.desc("ord")))
    return cache.withColumn("_r", last).where("_r = 1").drop("_r")


def refresh_status(sections: DataFrame, cache: DataFrame) -> DataFrame:
    """Sections (corpus_id, path, ord, content) with their hash, cached vector and status: fresh, missing (no text) or stale."""
    old = latest(cache).select("corpus_id", "path", F.col("embedding").alias("_old"), F.col("content_hash").alias("_hash"), F.col("updated_at").alias("_at"))
    rows = sections.select("corpus_id", "path", "ord", "content", F.md5(F.col("content")).alias("content_hash")).join(old, ["corpus_id", "path"], "left")
    fresh = F.coalesce((F.col("_hash") == F.col("content_hash")) & (F.size("_old") > 0), F.lit(False))
    return rows.withColumn("status", F.when(F.col("content").isNull(), "missing").when(fresh, "fresh").otherwise("stale"))


def purge(cache: DataFrame, sections: DataFrame) -> DataFrame:
    """Cache entries whose path is still a section's."""
    return cache.join(sections.select("corpus_id", "path").distinct(), ["corpus_id", "path"], "left_semi")


def refresh(sections: DataFrame, cache: DataFrame, embedder: Embedder, now: str) -> tuple[DataFrame, DataFrame]:
    """The new cache and its counters (corpus_id, updated, skipped, failed).

    Only stale texts reach the embedder. A missing text or vector fails, and its old entry stays.
    """
    rows = refresh_status(sections, cache)
    stale = embed(rows.where("status = 'stale'"), embedder, "content").withColumn("status", F.when(F.size("vector") > 0, "updated").otherwise("failed"))
    rest = rows.where("status <> 'stale'").withColumn("vector", F.lit(None).cast("array<double>")).withColumn("status", F.when(F.col("status") == "fresh", "skipped").otherwise("failed"))
    every = stale.unionByName(rest)
    done = F.col("status") == "updated"
    new = every.where(done | F.col("_hash").isNotNull()).select(
        "corpus_id", "ord", "path", F.when(done, F.col("vector")).otherwise(F.col("_old")).alias("embedding"),
        F.when(done, F.col("content_hash")).otherwise(F.col("_hash")).alias("content_hash"), F.when(done, F.lit(now)).otherwise(F.col("_at")).alias("updated_at"),
    )
    counts = every.groupBy("corpus_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("updated", "skipped", "failed")])
    return new, counts
