"""The driver's tables as the engine's records, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import estimate, iso
from quern.schemas import BLOCK, QUERIES

CORPUS = "docs"
SECTIONS_SQL = "sections as (select doc_id ord, 'doc/' || doc_id path, left(text, 60) title, substr(text, 61, 140) summary, [lang, source] tags, text content, cast(ceil(length(text) / 4.0) as bigint) tokens from documents)"
LOG_SQL = """log as (select event_id seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' ts, 'agent' || (user_id % 5) agent, event_type event, '/p' || (user_id % 3) cwd, cast(user_id as varchar) session,
  case when event_id % 4 = 0 then 'tool' || (event_id % 3) end tool, case when event_id % 5 > 0 then '/home/u/f' || (event_id % 11) || '.ts' end path, case when event_id % 6 = 0 then 'did ' || event_type end summary from events)"""
STRATEGIES_SQL = "strategies as (select event_id seq, 's' || (user_id % 7) as name, cast(user_id as varchar) agent_id, event_id % 3 generation, event_type category, value > 20 success, event_id % 5 b, event_id % 7 a, value duration from events)"
#: Documents of a source, so many ids to a file: no file is a third of all texts because a source is.
FILE_IDS = 20
FILE_SQL = f"source || '-' || (doc_id // {FILE_IDS})"
PROPOSALS_SQL = f"proposals as (select doc_id seq, 'knowledge/' || {FILE_SQL} || '-notes.md' section, case when doc_id % 15 = 0 then 'update' else 'append' end operation, case when doc_id % 11 = 0 then '' else text end content, text rationale, doc_id % 4 generation, lang agent_id from documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(CORPUS).alias("corpus_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc/"), "doc_id").alias("path"), F.left("text", F.lit(60)).alias("title"), F.substring("text", 61, 140).alias("summary"),
        F.array("lang", "source").alias("tags"), estimate(F.col("text")).alias("tokens"), F.lit(None).cast("string").alias("updated_at"), F.col("text").alias("content"),
    )


def queries_of(spark: SparkSession, rows: list[tuple[int, str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, CORPUS, t, n) for i, t, n in rows], QUERIES)


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("seq"), iso(F.col("ts").cast("timestamp")).alias("ts"), text("agent", u % 5).alias("agent"), F.col("event_type").alias("event"), text("/p", u % 3).alias("cwd"), u.cast("string").alias("session"),
        F.when(i % 4 == 0, text("tool", i % 3)).alias("tool"), F.when(i % 5 > 0, F.concat(text("/home/u/f", i % 11), F.lit(".ts"))).alias("path"), F.when(i % 6 == 0, text("did ", F.col("event_type"))).alias("summary"), F.col("props").alias("meta"),
    )


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    outcome = F.struct((F.col("value") > 20).alias("success"), (i % 5).alias("testsPassedBefore"), (i % 7).alias("testsPassedAfter"), F.lit(1).cast("long").alias("filesModified"), F.col("value").alias("duration"), F.lit(None).cast("double").alias("costUsd"))
    return e.select(F.lit(CORPUS).alias("corpus_id"), i.alias("seq"), F.concat(F.lit("s"), (u % 7).cast("string")).alias("name"), u.cast("string").alias("agent_id"), (i % 3).alias("generation"), F.col("event_type").alias("category"), outcome.alias("outcome"))


def file_of() -> Column:
    return F.concat("source", F.lit("-"), F.expr(f"doc_id div {FILE_IDS}"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        F.lit(CORPUS).alias("corpus_id"), i.alias("seq"), F.col("lang").alias("agent_id"), F.concat(F.lit("knowledge/"), file_of(), F.lit("-notes.md")).alias("section"), F.when(i % 15 == 0, "update").otherwise("append").alias("operation"),
        F.when(i % 11 == 0, "").otherwise(F.col("text")).alias("content"), F.col("text").alias("rationale"), (i % 4).alias("generation"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"))


def block(**fields) -> Column:
    """A content block with the given columns, all others null."""
    names = [x.split(":") for x in BLOCK[len("struct<") : -1].split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a conversation of tool results, with turns by time."""
    turn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    result = F.array(block(type=F.lit("tool_result"), content=F.col("event_type")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), turn.alias("turn"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("text"), result.alias("blocks"))


def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool results, those of a source a conversation."""
    result = F.array(block(type=F.lit("tool_result"), content=F.col("text")), block(type=F.lit("tool_use"), name=F.col("lang"), input_json=F.left("text", F.lit(30))), block(type=F.lit("image_url"), url=F.lit("u")))
    return table(spark, sf_dir, "documents").select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("text"), result.alias("blocks"))
