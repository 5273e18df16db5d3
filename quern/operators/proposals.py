"""Proposal queues: ordered consolidation of sections with an audit trail of mutations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions.text import category_of, key_terms, title_of, trim
from quern.operators.compaction import Summarizer, summarize

# Fixed values.
JOIN, SUMMARY_CHARS, DIFF_CHARS = "\n\n", 200, 500
MERGE_SYSTEM = "You merge proposed updates of one section of a project's knowledge base into a single text. Keep all that is valuable, resolve contradictions, output only the merged text."


def grouped(proposals: DataFrame) -> DataFrame:
    """(corpus_id, section, n, items): each section's proposals in order of arrival."""
    items = F.array_sort(F.collect_list(F.struct("seq", "operation", "content")))
    return proposals.groupBy("corpus_id", "section").agg(F.count("*").alias("n"), items.alias("items"))


def diff_text(operation: Column, content: Column) -> Column:
    return F.concat(F.lit("["), operation, F.lit("] "), F.left(content, F.lit(DIFF_CHARS)))


#: Characters that a task gathers before it gives a piece of a section's fold.
PIECE_CHARS = 4 << 20
_PIECE = "corpus_id string, section string, seq long, n long, replaces boolean, lead long, text string, rationale string"


class _Piece:
    """The fold of proposals that follow one another in a section: whether they replace what was before, and what they make.

    `text` is what is made of an empty text; `lead` counts the empty appends before it, which show only behind a text.
    """

    def __init__(self):
        self.seq, self.n, self.replaces, self.lead, self.parts, self.chars, self.rationale = None, 0, False, 0, [], 0, None

    def add(self, seq: int, operation: str, content: str, rationale: str | None) -> None:
        if operation != "append":
            self.replaces, self.lead, self.parts, self.chars = True, 0, [], 0
        if self.parts or content:
            self.parts.append(content)
            self.chars += len(content)
        elif operation == "append" and not self.replaces:
            self.lead += 1
        self.seq, self.n, self.rationale = seq, self.n + 1, rationale

    def row(self, key: tuple) -> tuple:
        return (*key, self.seq, self.n, self.replaces, self.lead, JOIN.join(self.parts), self.rationale)


def partial_folds(proposals: DataFrame, piece_chars: int = PIECE_CHARS, ranges: int | None = None) -> DataFrame:
    """Pieces of each section's fold, over ranges of (section, seq), so that a hot section is several tasks' work; what a piece replaces is gone."""
    keys = ["corpus_id", "section", "seq"]
    rows = proposals.select(*keys, "operation", F.coalesce("content", F.lit("")).alias("content"), "rationale")
    rows = (rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def run(batches):
        key, piece, out, held = None, _Piece(), [], 0
        for batch in batches:
            for corpus, section, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (corpus, section) != key or piece.chars > piece_chars:
                    if piece.n:
                        out.append(piece.row(key))
                        held += piece.chars
                    key, piece = (corpus, section), _Piece()
                piece.add(*row)
                if held > piece_chars:
                    yield batch_of(out)
                    out, held = [], 0
        if piece.n:
            out.append(piece.row(key))
        yield batch_of(out)

    arrow = to_arrow_schema(T.StructType.fromDDL(_PIECE))

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, _PIECE)


def fold(proposals: DataFrame, sections: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(corpus_id, section, content, applied, title, summary, tags): each section after its proposals, without a summarizer.

    Appends join a text that is not empty, updates and creations replace it. Tasks fold ranges of a section's proposals; the pieces
    are put together in order from the last one that replaces, else from the section's own text, less leading empty ones.
    """
    own = sections.select("corpus_id", F.col("path").alias("section"), F.col("content").alias("_own"))
    piece = F.struct("seq", "replaces", "lead", "text")
    by = partial_folds(proposals, piece_chars).groupBy("corpus_id", "section").agg(F.sum("n").alias("applied"), F.array_sort(F.collect_list(piece)).alias("_p"), F.max_by("rationale", "seq").alias("rationale"))
    out = by.join(own, ["corpus_id", "section"], "left")
    base = F.coalesce(F.array_max(F.transform("_p", lambda x, i: F.when(x["replaces"], i + 1))), F.lit(0))
    first = F.struct(F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("replaces"), F.lit(0).cast("long").alias("lead"), F.coalesce("_own", F.lit("")).alias("text"))
    live = F.when(base > 0, F.slice("_p", F.greatest(base, F.lit(1)), F.size("_p"))).otherwise(F.concat(F.array(first), F.col("_p")))
    out = out.withColumn("_l", live)
    start = F.coalesce(F.array_position(F.transform("_l", lambda x: x["text"] != ""), True), F.lit(0)).cast("int")
    # behind a text, a piece stands with its leading empty appends; one of nothing else has one break less
    behind = F.transform(F.slice("_l", start + 1, F.size("_l")), lambda x: F.concat(F.repeat(F.lit(JOIN), (x["lead"] - F.when(x["text"] == "", 1).otherwise(0)).cast("int")), x["text"]))
    text = F.when(start > 0, F.concat(F.element_at("_l", F.greatest(start, F.lit(1)))["text"], F.when(start < F.size("_l"), F.concat(F.lit(JOIN), F.array_join(behind, JOIN))).otherwise(""))).otherwise("")
    return out.select("corpus_id", "section", text.alias("content"), "applied", *_metadata(F.col("section"), F.col("rationale")))


def _metadata(section: Column, rationale: Column) -> list[Column]:
    return [title_of(section).alias("title"), F.left(rationale, F.lit(SUMMARY_CHARS)).alias("summary"), F.concat(F.array(category_of(section)), key_terms(rationale)).alias("tags")]


def mutations(proposals: DataFrame, now: str) -> DataFrame:
    """One audit row for each applied proposal."""
    return proposals.select("corpus_id", F.concat(F.lit("mut-"), F.uuid()).alias("id"), "generation", "section", "agent_id", "operation", "rationale", F.lit(now).alias("ts"), diff_text(F.col("operation"), F.col("content")).alias("diff"))


def merge_prompt(rows: DataFrame) -> DataFrame:
    """(corpus_id, section, prompt) with numbered proposals."""
    one = F.concat(F.lit("Proposal "), F.row_number().over(W.partitionBy("corpus_id", "section").orderBy("seq")), F.lit(" ("), F.col("operation"), F.lit(", "), F.col("rationale"), F.lit("):\n"), F.col("content"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_one"))), lambda x: x["_one"])
    return rows.withColumn("_one", one).groupBy("corpus_id", "section").agg(F.array_join(lines, JOIN).alias("_proposals"))


def consolidate(proposals: DataFrame, sections: DataFrame, now: str, summarizer: Summarizer | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folded sections, mutations, and counters (corpus_id, applied, skipped).

    With a summarizer, sections of several proposals are merged by it: one applied change and one mutation, with the first
    proposal's metadata. An empty answer is one skipped merge, and the section is folded instead.
    """
    size = proposals.groupBy("corpus_id", "section").agg(F.count("*").alias("_n"))
    if summarizer is None:
        folded = fold(proposals, sections)
        return folded, mutations(proposals, now), folded.groupBy("corpus_id").agg(F.sum("applied").alias("applied"), F.lit(0).cast("long").alias("skipped"))
    many = proposals.join(size.where("_n > 1"), ["corpus_id", "section"], "left_semi")
    own = sections.select("corpus_id", F.col("path").alias("section"), F.col("content").alias("_own"))
    prompts = merge_prompt(many).join(own, ["corpus_id", "section"], "left")
    prompts = prompts.withColumn("_p", F.concat(F.lit("Current text:\n"), F.coalesce("_own", F.lit("")), F.lit("\n\nProposals:\n"), F.col("_proposals")))
    merged = summarize(prompts, summarizer, MERGE_SYSTEM, "_p", "_said").select("corpus_id", "section", trim(F.col("_said")).alias("_said"))
    first = F.row_number().over(W.partitionBy("corpus_id", "section").orderBy("seq"))
    firsts = many.withColumn("_r", first).where("_r = 1").drop("_r").join(merged.where("_said <> ''"), ["corpus_id", "section"])
    rest = proposals.join(merged.where("_said <> ''"), ["corpus_id", "section"], "left_anti")
    said = firsts.select("corpus_id", "section", F.col("_said").alias("content"), F.lit(1).cast("long").alias("applied"), *_metadata(F.col("section"), F.col("rationale")))
    folded = fold(rest, sections).unionByName(said)
    trail = mutations(rest, now).unionByName(mutations(firsts.withColumn("content", F.col("_said")), now))
    skipped = merged.groupBy("corpus_id").agg(F.count_if(F.col("_said") == "").alias("skipped"))
    counts = folded.groupBy("corpus_id").agg(F.sum("applied").alias("applied")).join(skipped, "corpus_id", "left").na.fill(0, ["skipped"])
    return folded, trail, counts


def of_generation(rows: DataFrame, generation: int) -> DataFrame:
    return rows.where(F.col("generation") == generation)


def last(rows: DataFrame, n: int | None, by: str = "corpus_id", seq: str = "seq") -> DataFrame:
    """The last n rows of each corpus in their order; all for none or 0."""
    if not n:
        return rows
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(seq)))).where(F.col("_r") <= n).drop("_r")
