"""Knowledge corpora: manifests, sections, bootstrap, migration from markdown, and path checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schemas
from quern.functions.text import PYTHON_SPACE, estimate, trim
from quern.session import cut

MAX_HOPS = 20


def total_tokens(sections: DataFrame, *by: str) -> DataFrame:
    return sections.groupBy(*by).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def normalized(path: Column) -> Column:
    """A relative path without "." and ".." segments; segments that climb above its root are kept as "..", as in a file system."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
    step = lambda acc, p: F.when((p == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def stays_inside(path: Column) -> Column:
    """Whether a section path stays below its corpus; the corpus itself and siblings do not."""
    n = normalized(path)
    return (n != "") & (n != "..") & ~n.startswith("../")


def guarded(sections: DataFrame) -> DataFrame:
    """`sections`, failing on a path that leaves its corpus."""
    bad = F.raise_error(F.concat(F.lit("path escapes corpus directory: "), F.col("path")))
    return sections.withColumn("path", F.when(stays_inside(F.col("path")), F.col("path")).otherwise(bad.cast("string")))


def find_root(starts: DataFrame, corpora: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(start, root): the nearest ancestor of an absolute path, itself included, that holds a corpus (root); null if none within `hops`."""
    parts = F.filter(F.split("start", "/"), lambda p: p != "")
    rows = starts.select("start", F.posexplode(F.sequence(F.size(parts), F.greatest(F.lit(0), F.size(parts) - hops + 1))).alias("hop", "n"), parts.alias("_p"))
    rows = rows.select("start", "hop", F.concat(F.lit("/"), F.array_join(F.slice("_p", F.lit(1), F.col("n")), "/")).alias("root"))
    found = rows.join(corpora.select("root").distinct(), "root", "left_semi").groupBy("start").agg(F.min_by("root", "hop").alias("root"))
    return starts.select("start").join(found, "start", "left")


#: A corpus's folder within its project, and files in it.
FOLDER = ".quern/corpus"
FILES = {"manifest": "manifest.json", "pending": "evolution/pending.jsonl", "mutations": "evolution/mutations.jsonl", "embeddings": "evolution/embeddings.json"}


def file_path(project: Column, name: str) -> Column:
    """Path of one of the corpus's own FILES."""
    return F.concat(project, F.lit(f"/{FOLDER}/{FILES[name]}"))


def section_path(project: Column, path: Column) -> Column:
    """Path of a section's text; an error if it would leave the corpus."""
    bad = F.raise_error(F.concat(F.lit("path escapes corpus directory: "), path)).cast("string")
    return F.when(stays_inside(path), F.concat(project, F.lit(f"/{FOLDER}/"), normalized(path))).otherwise(bad)


def _numbered(keys: DataFrame) -> DataFrame:
    """Rows (corpus_id, path) with their place `_r` within the corpus in path order, counted in ranges, so that no task has a whole corpus."""
    ranged = cut(keys.repartitionByRange("corpus_id", "path").withColumn("_b", F.spark_partition_id()))
    sizes = ranged.groupBy("corpus_id", "_b").count()  # a row for each range and corpus in it
    before = F.coalesce(F.sum("count").over(W.partitionBy("corpus_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("corpus_id", "_b").orderBy("path"))
    return ranged.withColumn("_p", place).join(sizes.select("corpus_id", "_b", before.alias("_before")), ["corpus_id", "_b"]).select("corpus_id", "path", (F.col("_before") + F.col("_p")).alias("_r"))


def upsert(sections: DataFrame, written: DataFrame, now: str, ends: DataFrame | None = None) -> DataFrame:
    """Sections after writing rows (corpus_id, path, title, summary, tags, content): known paths are replaced in place, new ones follow in path order.

    Tokens are those of the new text. Of several rows for a path the last by `seq` counts, if there is that column. `ends` gives the last
    place (corpus_id, _end) of each corpus where `sections` are a part of them: all with the paths that are written.
    """
    if "seq" in written.columns:
        last = F.row_number().over(W.partitionBy("corpus_id", "path").orderBy(F.desc("seq")))
        written = written.withColumn("_r", last).where("_r = 1").drop("_r", "seq")
    fields = ["title", "summary", "tags", "content"]
    new = written.select("corpus_id", "path", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    both = sections.join(new, ["corpus_id", "path"], "full")
    fresh = F.coalesce("_new", F.lit(False))
    end = ends if ends is not None else sections.groupBy("corpus_id").agg(F.max("ord").alias("_end"))
    added = _numbered(new.select("corpus_id", "path").join(sections.select("corpus_id", "path"), ["corpus_id", "path"], "left_anti").distinct())
    both = both.join(end, "corpus_id", "left").join(added, ["corpus_id", "path"], "left")
    both = both.withColumn("ord", F.coalesce("ord", F.coalesce("_end", F.lit(-1)) + F.col("_r")).cast("long"))
    for c in fields:
        both = both.withColumn(c, F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)))
    both = both.withColumn("tokens", F.when(fresh, estimate(F.col("content"))).otherwise(F.col("tokens"))).withColumn("updated_at", F.when(fresh, F.lit(now)).otherwise(F.col("updated_at")))
    return both.select(*sections.columns)


def empty_manifest(spark: SparkSession, project: str, now: str) -> DataFrame:
    return spark.createDataFrame([(1, project, [], (1, "", now, None), [], now, now)], schemas.MANIFEST)


@dataclass
class InitOptions:
    project: str
    vision: str
    milestone: str
    principles: list[str] = field(default_factory=list)
    anti_patterns: list[str] = field(default_factory=list)


def list_section(title: str, placeholder: str, items: Column) -> Column:
    """A text with a line for each item, or the placeholder where there are none; null items are left out."""
    lines = F.array_join(F.transform(F.array_compact(items), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit(f"# {title}\n\n"), F.when(F.size(F.array_compact(items)) > 0, lines).otherwise(placeholder), F.lit("\n"))


def bootstrap(spark: SparkSession, corpus_id: str, options: InitOptions, now: str, existing: DataFrame | None = None) -> DataFrame:
    """The sections of a new corpus; an error if `existing` holds its id."""
    o = options
    one = spark.createDataFrame([(corpus_id, o.vision, o.milestone, o.principles, o.anti_patterns)], CORPORA)
    return bootstrap_all(one, now, existing)


CORPORA = "corpus_id string, vision string, milestone string, principles array<string>, anti_patterns array<string>"


def bootstrap_all(corpora: DataFrame, now: str, existing: DataFrame | None = None) -> DataFrame:
    """The sections of each of many new corpora (corpus_id, vision, milestone, principles, anti_patterns), in one pass over their rows.

    Null texts are empty, null lists have no items. An error that names one if `existing` holds sections of any of them.
    """
    if existing is not None:
        there = corpora.join(existing.select("corpus_id").distinct(), "corpus_id", "left_semi").first()
        if there is not None:
            raise ValueError(f"corpus {there.corpus_id} exists already")
    vision, milestone = F.coalesce("vision", F.lit("")), F.coalesce("milestone", F.lit(""))
    # Path, title, summary, tags, text of the first sections, in their order.
    rows = [
        ("vision/north-star.md", "North Star Vision", "Ultimate end-state vision for the project", ["vision", "north-star", "goal", "purpose"], F.concat(F.lit("# North Star\n\n"), vision, F.lit("\n"))),
        ("vision/architecture.md", "Architecture", "System architecture decisions and design", ["vision", "architecture", "design", "system"], "# Architecture\n\nArchitectural decisions and system design will be documented here as agents discover and refine the optimal approach.\n"),
        ("vision/principles.md", "Design Principles", "Core design principles and constraints", ["vision", "principles", "constraints", "rules"], list_section("Design Principles", "Core principles will be documented here as the project evolves.", F.col("principles"))),
        ("vision/anti-patterns.md", "Anti-Patterns", "Approaches to avoid, learned from failures", ["vision", "anti-patterns", "avoid", "failures", "lessons"], list_section("Anti-Patterns", "Approaches to avoid will be documented here as agents learn from failures.", F.col("anti_patterns"))),
        ("milestones/current.md", "Current Milestone", milestone, ["milestone", "current", "active"], F.concat(F.lit("# "), milestone, F.lit("\n\nStatus: In Progress\nGeneration: 1\n\n## Success Criteria\n\n- [ ] Define success criteria for this milestone\n"))),
        ("milestones/backlog.md", "Milestone Backlog", "Future milestones ordered by priority", ["milestone", "backlog", "future", "planning"], "# Milestone Backlog\n\nFuture milestones will be added here as the project evolves.\n"),
        ("strategies/active.md", "Active Strategies", "Currently winning development approaches", ["strategies", "active", "current", "methodology"], "# Active Strategies\n\nDevelopment approaches that have proven effective.\n\n- Explore existing codebase patterns before writing new code\n- Write tests alongside implementation\n- Keep changes small and reviewable\n"),
        ("strategies/graveyard.md", "Strategy Graveyard", "Failed approaches with post-mortems", ["strategies", "graveyard", "failed", "lessons"], "# Strategy Graveyard\n\nFailed approaches and why they didn't work.\n"),
        ("strategies/experiments.md", "Experimental Strategies", "Approaches being tested this generation", ["strategies", "experiments", "testing"], "# Experimental Strategies\n\nApproaches being tested this generation.\n"),
        ("knowledge/decisions.md", "Decisions", "Architectural decision records with rationale", ["knowledge", "decisions", "adr", "rationale"], "# Architectural Decision Records\n\nKey decisions and their rationale.\n"),
        ("knowledge/discoveries.md", "Discoveries", "Agent-discovered codebase and domain knowledge", ["knowledge", "discoveries", "learned", "codebase"], "# Discoveries\n\nThings agents have learned about the codebase and domain.\n"),
        ("knowledge/dependencies.md", "Dependencies", "External deps, API contracts, integration notes", ["knowledge", "dependencies", "external", "api"], "# Dependencies\n\nExternal dependencies, API contracts, and gotchas.\n"),
    ]
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    every = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(p).alias("path"), F.lit(t).alias("title"), as_column(s).alias("summary"), F.array(*map(F.lit, g)).alias("tags"), as_column(c).alias("content")) for i, (p, t, s, g, c) in enumerate(rows)]
    made = corpora.select("corpus_id", F.inline(F.array(*every)))
    made = made.withColumn("tokens", estimate(F.col("content")).cast("long")).withColumn("updated_at", F.lit(now))
    return made.select(*[x.split()[0] for x in schemas.SECTIONS.split(", ")])


_HEAD = re.compile(r"##[\t-\r ]+")
_ENDS = re.compile(f"^{PYTHON_SPACE}+|{PYTHON_SPACE}+$")


def _sections_of(text: str) -> Iterator[tuple[int, str, str]]:
    """(place, header, body) of the sections of one text, walked once; of repeated headers the first place and the last body."""
    found: dict[str, tuple[int, int, int]] = {}
    header, start, n, at = "", 0, 0, 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if text.startswith("##", at) and (m := _HEAD.match(text, at, end)):
            if n and header:
                found[header] = (found.get(header, (n,))[0], start, at)
            n, start, header = n + 1, end + 1, _ENDS.sub("", text[m.end() : end]).lower()
        at = end + 1
    if n and header:
        found[header] = (found.get(header, (n,))[0], start, len(text))
    for header, (place, a, b) in found.items():
        yield place, header, _ENDS.sub("", text[a:b].replace("\r\n", "\n"))


def markdown_sections(files: DataFrame, key: str = "corpus_id", text: str = "text") -> DataFrame:
    """(key, ord, header, body) of each "## " section; headers are lower-cased, of repeated ones the last counts, text before the first is left out.

    A row's text is walked once, in the task that holds it; null texts have no sections.
    """

    def run(batches):
        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                rows = list(_sections_of(x.as_py())) if x.is_valid else []
                if rows:
                    own = batch.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=[key, "ord", "header", "body"])

    rows = files.select(key, text)
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("ord long, header string, body string").fields])
    return rows.mapInArrow(run, schema)


def description(text: Column) -> Column:
    """The first line that is neither blank nor a heading; null if there is none."""
    return F.get(F.filter(F.transform(F.split(text, r"\r?\n"), trim), lambda x: (x != "") & ~x.startswith("#")), F.lit(0))


def migrate(files: DataFrame, key: str = "corpus_id", text: str = "text") -> DataFrame:
    """(key, description, architecture, commands) that a project's markdown file holds; of several matching headers the last counts."""
    parts = markdown_sections(files, key, text)
    has = lambda *words: F.greatest(*[F.col("header").contains(w) for w in words])
    named = parts.groupBy(key).agg(F.max_by(F.when(has("architecture", "key director"), F.col("body")), F.when(has("architecture", "key director"), F.col("ord"))).alias("architecture"), F.max_by(F.when(has("command", "script"), F.col("body")), F.when(has("command", "script"), F.col("ord"))).alias("commands"))
    return files.select(key, description(F.col(text)).alias("description")).join(named, key, "left")
