"""Project fitness, generations and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import bar, count_words, is_json, or_null, pad_end, pad_start, percent, strict_json, trim

# Fixed values.
MARKERS, DONE = "TODO|FIXME|HACK|XXX", "complete|done|finished|shipped"
METRICS = ("testPassRate", "codeQuality", "milestoneProgress", "costEfficiency", "strategySuccessRate")


def test_pass_rate(output: Column, exit_code: Column) -> Column:
    """Share of passed tests that a runner's output tells of; without any, 1 on exit code 0, else 0.5. Null output is 0.5."""
    number = lambda word: F.coalesce(or_null(F.regexp_extract(output, rf"(?i)(\d+)\s+{word}", 1)).cast("double"), F.lit(0.0))
    passed, failed = number("pass"), number("fail")
    return F.when(output.isNull(), 0.5).when(passed + failed == 0, F.when(exit_code == 0, 1.0).otherwise(0.5)).otherwise(F.try_divide(passed, passed + failed))


def code_quality(files: DataFrame, by: str = "corpus_id", text: str = "text") -> DataFrame:
    """(by, code_quality) from the density of marker words in source files; 0.5 for no lines."""
    lines, marks = F.sum(F.regexp_count(text, F.lit("\n")) + 1), F.sum(count_words(F.col(text), MARKERS))
    density = F.try_divide(marks, lines)
    return files.groupBy(by).agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - density * 100)), F.lit(0.5)).alias("code_quality"))


def milestone_progress(text: Column) -> Column:
    """Share of ticked boxes; without boxes 0.7 if a word of completion stands there, else 0.3; 0 without text."""
    done, open_ = F.regexp_count(text, F.lit(r"(?i)\[x\]")), F.regexp_count(text, F.lit(r"\[\s\]"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(done + open_ == 0, F.when(count_words(text, DONE) > 0, 0.7).otherwise(0.3)).otherwise(F.try_divide(done, done + open_))


def cost_efficiency(count: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(count, F.lit(0)) / 10)


def list_items(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"(?m)^[-*]\s")) + F.regexp_count(t, F.lit(r"(?m)^#{2,3}\s"))


def strategy_success_rate(active: Column, graveyard: Column) -> Column:
    a, g = list_items(active), list_items(graveyard)
    return F.coalesce(F.try_divide(a, a + g), F.lit(0.5))


def measure(corpora: DataFrame, sections: DataFrame, files: DataFrame, mutations: DataFrame) -> DataFrame:
    """(corpus_id, scores): the five metrics of each corpus (corpus_id, generation, test_output, exit_code)."""
    at = lambda path, name: sections.where(F.col("path") == path).select("corpus_id", F.col("content").alias(name))
    done = mutations.groupBy("corpus_id", "generation").agg(F.count("*").alias("_n"))
    rows = corpora.join(done, ["corpus_id", "generation"], "left").join(code_quality(files), "corpus_id", "left")
    for path, name in (("milestones/current.md", "_m"), ("strategies/active.md", "_a"), ("strategies/graveyard.md", "_g")):
        rows = rows.join(at(path, name), "corpus_id", "left")
    values = [test_pass_rate(F.col("test_output"), F.col("exit_code")), F.coalesce("code_quality", F.lit(0.5)), milestone_progress(F.col("_m")), cost_efficiency(F.col("_n")), strategy_success_rate(F.col("_a"), F.col("_g"))]
    return rows.select("corpus_id", "generation", F.create_map(*[x for k, v in zip(METRICS, values, strict=True) for x in (F.lit(k), v.cast("double"))]).alias("scores"))


def compare(before: DataFrame, after: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, metric, before, after, delta) of each metric that stands before; 0 where it is missing after."""
    flat = lambda df, name: df.select(key, F.explode("scores").alias("metric", name))
    rows = flat(before, "before").join(flat(after, "after"), [key, "metric"], "left").na.fill(0.0, ["after"])
    return rows.withColumn("delta", F.col("after") - F.col("before"))


def report(rows: DataFrame, scores: str = "scores") -> DataFrame:
    """`rows` with the metrics as text lines."""
    words = lambda k: F.trim(F.concat(F.upper(F.left(k, F.lit(1))), F.regexp_replace(F.substring(k, 2, 1000), "([A-Z])", " $1")))
    line = lambda k: F.concat(F.lit("  "), pad_end(words(F.lit(k)), 25), F.lit(" "), bar(F.col(scores)[k], 20), F.lit(" "), percent(F.col(scores)[k]))
    return rows.withColumn("report", F.concat_ws("\n", F.lit("Fitness Metrics:"), *[F.when(F.col(scores)[k].isNotNull(), line(k)) for k in METRICS]))


def generation_report(rows: DataFrame) -> DataFrame:
    """(generation, milestone, scores, mutations, promoted, retired, experiments) rows with their text."""
    line = lambda k: F.concat(F.lit("  "), pad_end(F.lit(k), 20), F.lit(" "), bar(F.col("scores")[k], 10), F.lit(" "), percent(F.col("scores")[k]))
    some = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    head = F.concat(F.lit("Generation "), F.col("generation"), F.lit(": "), F.col("milestone"), F.lit("\n\nFitness:"))
    tail = [F.concat(F.lit("\nMutations: "), F.col("mutations")), some("promoted", "Promoted: "), some("retired", "Retired: "), some("experiments", "New experiments: ")]
    return rows.withColumn("report", F.concat_ws("\n", head, *[F.when(F.col("scores")[k].isNotNull(), line(k)) for k in METRICS], *tail))


def first_scores(history: DataFrame) -> DataFrame:
    """(corpus_id, generation, scores): a generation that was evaluated again keeps its first scores."""
    return history.groupBy("corpus_id", "generation").agg(F.min_by("scores", "ord").alias("scores"))


def lineage(generations: DataFrame, mutations: DataFrame, history: DataFrame, now: str) -> DataFrame:
    """Lineage entries of ended generations (corpus_id, generation, milestone, started_at, ended_at)."""
    count = mutations.groupBy("corpus_id", "generation").agg(F.count("*").alias("mutation_count"))
    rows = generations.join(count, ["corpus_id", "generation"], "left").join(first_scores(history), ["corpus_id", "generation"], "left")
    empty = F.create_map().cast("map<string,double>")
    return rows.select("corpus_id", "generation", "milestone", "started_at", F.coalesce("ended_at", F.lit(now)).alias("ended_at"), F.coalesce("mutation_count", F.lit(0)).alias("mutation_count"), F.coalesce("scores", empty).alias("fitness_scores"))


def archive_path(generation: Column) -> Column:
    n = generation.cast("string")
    return F.concat(F.lit("milestones/completed/"), pad_start(n, 3), F.lit("-gen"), n, F.lit(".md"))


def start_generation(manifests: DataFrame, sections: DataFrame, milestone: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Manifests with the next generation, and rows to write: a new current milestone where the text is missing or does not name it."""
    number = F.col("generation.number") + 1
    new = manifests.withColumn("generation", F.struct(number.alias("number"), F.lit(milestone).alias("milestone"), F.lit(now).alias("startedAt"), F.lit(None).cast("string").alias("endedAt"))).withColumn("updatedAt", F.lit(now))
    current = sections.where("path = 'milestones/current.md'").select("corpus_id", F.col("content").alias("_c"))
    stale = new.join(current, "corpus_id", "left").where(F.col("_c").isNull() | ~F.col("_c").contains(milestone))
    text = F.concat(F.lit(f"# {milestone}\n\nStatus: In Progress\nGeneration: "), F.col("generation.number"), F.lit("\n\n## Success Criteria\n\n- [ ] Define success criteria for this milestone\n"))
    rows = stale.select("corpus_id", F.lit("milestones/current.md").alias("path"), F.lit("Current Milestone").alias("title"), F.lit(milestone).alias("summary"), F.array(F.lit("milestone"), F.lit("current"), F.lit("active")).alias("tags"), text.alias("content"))
    return new, rows


def end_generation(manifests: DataFrame, sections: DataFrame, mutations: DataFrame, history: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests with the end set, the archived milestone (where it has a text) to write, and the lineage entries to append."""
    rows = manifests.select("corpus_id", F.col("generation.number").alias("generation"), F.col("generation.milestone").alias("milestone"), F.col("generation.startedAt").alias("started_at"), F.lit(None).cast("string").alias("ended_at"))
    entries = lineage(rows, mutations, history, now)
    current = sections.where("path = 'milestones/current.md' and content <> ''").select("corpus_id", "content")
    archived = rows.join(current, "corpus_id").select("corpus_id", archive_path(F.col("generation")).alias("path"), F.concat(F.lit("Generation "), F.col("generation")).alias("title"), F.col("milestone").alias("summary"), F.array(F.lit("milestone"), F.lit("completed")).alias("tags"), "content")
    ended = manifests.withColumn("generation", F.col("generation").withField("endedAt", F.lit(now))).withColumn("updatedAt", F.lit(now))
    return ended, archived, entries


def evaluated(history: Column, generation: Column) -> Column:
    return F.exists(history, lambda x: x["generation"] == generation)


#: Lists of a model's answer and the longer names that they may have.
_EVOLUTION = {"promoted": "promotedStrategies", "retired": "retiredStrategies", "experiments": "newExperiments"}
_ANSWER = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for pair in _EVOLUTION.items() for n in pair])


def parse_evolution(answer: Column) -> Column:
    """Lists (promoted, retired, experiments) from a model's JSON answer, code fences taken off; empty where it is none.

    A list that is no list is empty, or that of the longer name; its entries come as text.
    """
    text = trim(F.coalesce(answer, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"(?s)```(?!.*```).*$", "")
    said = trim(F.when(text.startswith("```"), inner).otherwise(text))
    parsed = strict_json(said, _ANSWER)
    own = lambda short, long: F.coalesce(F.when(is_json(parsed, said), F.coalesce(parsed["v"][short], parsed["v"][long])), F.array().cast("array<string>"))
    return F.struct(*[own(*pair).alias(pair[0]) for pair in _EVOLUTION.items()])


def latest_fitness(history: DataFrame) -> DataFrame:
    last = F.row_number().over(W.partitionBy("corpus_id").orderBy(F.desc("ord")))
    return history.withColumn("_r", last).where("_r = 1").drop("_r")
