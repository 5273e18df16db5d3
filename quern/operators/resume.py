"""Session logs read back: recent entries, activity lines, and a summary of the last session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import or_null, short_path

# Fixed values.
NO_ACTIVITY, NO_SESSION, NO_HEADLINE = "(no recent activity)", "No prior session activity found.", "Session activity recorded"
LISTED, RESUME_ENTRIES, RESUME_TOKENS = 5, 10, 600


def select(log: DataFrame, agent: str | None = None, since: str | None = None) -> DataFrame:
    """Entries of an agent and of a time on. Times compare as strings; entries without a time stay."""
    if agent:
        log = log.where(F.col("agent") == agent)
    if since:
        log = log.where(F.coalesce(F.col("ts") >= since, F.lit(True)))
    return log


def read(log: DataFrame, limit: int | None = None, agent: str | None = None, since: str | None = None) -> DataFrame:
    """Entries last written first; the limit holds after the filters."""
    rows = select(log, agent, since).orderBy(F.desc("seq"))
    return rows.limit(limit) if limit else rows


def entry_line() -> Column:
    return F.concat_ws(" ", F.substring("ts", 12, 8), "agent", "event", or_null(F.col("tool")), short_path(or_null(F.col("path"))), F.concat(F.lit("- "), or_null(F.col("summary"))))


def activity(entries: DataFrame) -> DataFrame:
    """One row: the entries as lines, last written first."""
    lines = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("seq", entry_line().alias("x"))))), lambda x: x["x"])
    return entries.agg(F.when(F.count("*") == 0, NO_ACTIVITY).otherwise(F.array_join(lines, "\n")).alias("recent_activity"))


def summary(entries: DataFrame, cwd: str) -> DataFrame:
    """One row: a sentence on the project's entries, or on all where none is the project's. Meant for a bounded number of entries."""
    mine = F.coalesce(or_null(F.col("cwd")).startswith(cwd), F.lit(False))
    rows = entries.agg(F.collect_list(F.struct(F.col("seq"), mine.alias("mine"), "agent", short_path(or_null(F.col("path"))).alias("path"), or_null(F.col("tool")).alias("tool"), or_null(F.col("summary")).alias("summary"))).alias("all"))
    rows = rows.withColumn("all", F.reverse(F.array_sort("all"))).withColumn("own", F.filter("all", lambda x: x["mine"])).withColumn("of", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("all")))
    distinct = lambda c: F.array_distinct(F.filter(F.transform("of", lambda x: x[c]), lambda v: v.isNotNull()))
    part = lambda head, values, n=None: F.when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(F.slice(values, 1, n) if n else values, ", ")))
    headline = F.coalesce(F.get(F.filter(F.transform("of", lambda x: x["summary"]), lambda v: v.isNotNull()), F.lit(0)), F.lit(NO_HEADLINE))
    text = F.concat(headline, F.lit(". "), F.concat_ws("; ", part("Agent(s): ", distinct("agent")), part("touched ", distinct("path"), LISTED), part("used ", distinct("tool"), LISTED)), F.lit("."))
    return rows.select(F.when(F.size("all") == 0, NO_SESSION).otherwise(text).alias("last_session_summary"))


def resume_context(log: DataFrame, sections_prompt: DataFrame, cwd: str) -> DataFrame:
    """One row of three texts: recent activity, retrieved sections (a one-row frame with `prompt`, or none), last session."""
    entries = read(log, RESUME_ENTRIES)
    prompt = sections_prompt.agg(F.coalesce(F.max("prompt"), F.lit("")).alias("corpus_context"))
    return activity(entries).join(prompt).join(summary(entries, cwd))
