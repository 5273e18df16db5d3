"""Ending and evaluating generations as a whole: consolidation, measurement, evolution, records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import estimate
from quern.operators import corpus, fitness, proposals
from quern.operators.compaction import Summarizer, summarize

EVOLVE_SYSTEM = 'You review the strategies of a project. Answer with JSON only: {"promoted": [], "retired": [], "experiments": []}.'
#: Sections that an evolution's three lists go to.
LISTS = {"promoted": "strategies/active.md", "retired": "strategies/graveyard.md", "experiments": "strategies/experiments.md"}


def stamp(rows: DataFrame, prefix: str, now: str) -> DataFrame:
    """`rows` with an id of their own and a time, as records are queued."""
    return rows.withColumn("id", F.concat(F.lit(f"{prefix}-"), F.uuid())).withColumn("ts", F.lit(now))


@dataclass
class Evaluation:
    sections: DataFrame
    mutations: DataFrame
    scores: DataFrame
    history: DataFrame
    evolution: DataFrame | None


def evolve(sections: DataFrame, scores: DataFrame, summarizer: Summarizer, now: str) -> tuple[DataFrame, DataFrame]:
    """Lists (corpus_id, promoted, retired, experiments) that the model answers, and the sections with them appended.

    Only sections that are there are written, so each takes its corpus's answer in one join; none is numbered, and the model is asked once for them.
    """
    asked = scores.select("corpus_id", F.to_json("scores").alias("_p"))
    lists = summarize(asked, summarizer, EVOLVE_SYSTEM, "_p", "_a").select("corpus_id", fitness.parse_evolution(F.col("_a")).alias("l")).select("corpus_id", "l.*")
    own = F.coalesce(*[F.when(F.col("path") == path, F.col(name)) for name, path in LISTS.items()])
    rows = sections.join(lists, "corpus_id", "left").withColumn("_items", own)
    some = F.coalesce(F.size("_items") > 0, F.lit(False))
    text = F.concat(F.regexp_replace("content", r"\s+$", ""), F.lit("\n"), F.array_join(F.transform("_items", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))
    new = {"content": text, "tokens": estimate(text), "updated_at": F.lit(now)}
    return lists, rows.select(*[F.when(some, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in sections.columns])


def evaluate(corpora: DataFrame, sections: DataFrame, queue: DataFrame, files: DataFrame, mutations: DataFrame, history: DataFrame, now: str, summarizer: Summarizer | None = None) -> Evaluation:
    """Consolidates the queue, measures fitness on the result, adds a history entry, and evolves strategies if there is a summarizer."""
    folded, trail, _ = proposals.consolidate(queue, sections, now, summarizer)
    written = folded.select("corpus_id", F.col("section").alias("path"), "title", "summary", "tags", "content")
    new = corpus.upsert(sections, written, now)
    every = mutations.select("corpus_id", "generation").unionByName(trail.select("corpus_id", "generation"))
    scores = fitness.measure(corpora, new, files, every)
    lists = None
    if summarizer is not None:
        lists, new = evolve(new, scores, summarizer, now)
    end = history.groupBy("corpus_id").agg((F.max("ord") + 1).alias("_o"))
    entry = scores.join(end, "corpus_id", "left").select("corpus_id", F.coalesce("_o", F.lit(0)).cast("long").alias("ord"), "generation", "scores")
    return Evaluation(new, trail, scores, history.unionByName(entry), lists)


def assemble(parts: DataFrame) -> DataFrame:
    """(query_id, prompt) from prompt parts (query_id, name, content, priority): lower priorities first, then by name."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("priority", "name", "content"))), lambda x: x["content"])
    return parts.groupBy("query_id").agg(F.array_join(rows, "\n\n").alias("prompt"))
