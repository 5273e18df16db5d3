"""Keyword and semantic retrieval of sections under a token budget, for many queries and corpora at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import estimate, terms

# Field weights, core sections in their order with their scores, packing and search limits.
TAG, TITLE, SUMMARY = 3.0, 2.0, 1.0
CORE = {"vision/north-star.md": 3.0, "milestones/current.md": 2.0, "strategies/active.md": 1.0}
MIN_TRUNCATED, TRUNCATED_MARK, SIMILARITY_ABOVE = 200, "\n\n[... section truncated ...]", 0.3
PROMPT_HEAD, SECTION_BREAK = "## Project Genome\n\n", "\n\n---\n\n"
PRIORITIES = {"Core": 0, "PlanMode": 5, "Tools": 10, "Permissions": 20, "Genome": 25, "Knowledge": 30, "Git": 35, "Memory": 40, "Default": 50, "BuddyInfluence": 85, "ModelPatches": 90, "Undercover": 95}


def section_terms(sections: DataFrame) -> DataFrame:
    """(corpus_id, path, ord, term, weight): each distinct term of a section with the weights of the fields that hold it."""
    s = sections.select("corpus_id", "path", "ord", F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower).alias("g"), terms(F.col("title")).alias("t"), terms(F.col("summary")).alias("s"))
    s = s.withColumn("term", F.explode(F.array_union(F.array_union("g", "t"), "s")))
    held = lambda field, weight: F.when(F.array_contains(field, F.col("term")), F.lit(weight)).otherwise(F.lit(0.0))
    return s.select("corpus_id", "path", "ord", "term", (held("g", TAG) + held("t", TITLE) + held("s", SUMMARY)).alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, corpus_id, term, times); a repeated term counts each time."""
    return queries.select("query_id", "corpus_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "corpus_id", "term").agg(F.count("*").alias("times"))


def idf(found: DataFrame, sections: DataFrame) -> DataFrame:
    """(corpus_id, term, idf) from section terms: max(1, ln(N / df) + 1)."""
    n = sections.groupBy("corpus_id").agg(F.count("*").alias("n"))
    df = found.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
    return df.join(n, "corpus_id").select("corpus_id", "term", F.greatest(F.lit(1.0), F.log(F.col("n") / F.col("df")) + 1).alias("idf"))


def score(sections: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, corpus_id, path, ord, score) of sections with a positive score; only the queries' terms are shuffled. Scores are rounded to 9 digits, so the order of addition decides no tie."""
    asked = query_terms(queries)
    wanted = section_terms(sections).join(asked.select("corpus_id", "term").distinct(), ["corpus_id", "term"], "left_semi")
    return ranked(wanted, idf(wanted, sections), asked)


def ranked(wanted: DataFrame, worth: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores from the postings (corpus_id, path, ord, term, weight) of the asked terms (query_id, corpus_id, term, times) and what terms are worth."""
    hits = wanted.join(asked.join(worth, ["corpus_id", "term"]), ["corpus_id", "term"])
    total = hits.groupBy("query_id", "corpus_id", "path", "ord").agg(F.round(F.sum(F.col("times") * F.col("idf") * F.col("weight")), 9).alias("score"))
    return total.where("score > 0")


#: Parts of a query's matches that are ranked for themselves first.
SALTS = 64


def pack(scored: DataFrame, max_tokens: Column, most: int | None = None, by: str = "query_id", rank: list[Column] | None = None) -> DataFrame:
    """Rows of (by, ..., score, ord, full) that fit a budget, in rank order (score, then ord), with `tokens` and `truncated`.

    `full` is a section's own token count. Packing stops at the first section that does not fit; what is left of the budget goes to its
    beginning if that is more than MIN_TRUNCATED tokens. Each non-empty section takes a token or more, so at most as many as the
    budget has tokens are ranked: the first `most`, at least as large as any budget, or else those of each of SALTS parts, so that a
    query that all sections match is not sorted in one task.
    """
    order = rank or [F.desc("score"), F.asc("ord")]
    if most is not None:
        place, bound = F.row_number().over(W.partitionBy(by).orderBy(*order)), F.lit(most)
    else:
        place, bound = F.row_number().over(W.partitionBy(by, F.pmod(F.xxhash64("path"), F.lit(SALTS))).orderBy(*order)), max_tokens.cast("long")
    scored = scored.where("full > 0").withColumn("_p", place).where(F.col("_p") <= bound).drop("_p").unionByName(scored.where("full = 0"))
    cum = F.sum("full").over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = scored.withColumn("_max", max_tokens.cast("long")).withColumn("_cum", cum).withColumn("_used", F.col("_cum") - F.col("full"))
    rows = rows.where((F.col("_used") < F.col("_max")) & ((F.col("_cum") <= F.col("_max")) | (F.col("_max") - F.col("_used") > MIN_TRUNCATED)))
    over = F.col("_cum") > F.col("_max")
    return rows.withColumn("tokens", F.when(over, F.col("_max") - F.col("_used")).otherwise(F.col("full")).cast("long")).withColumn("truncated", over).drop("_max", "_cum", "_used", "full")


def _fill(packed: DataFrame, sections: DataFrame) -> DataFrame:
    """Packed rows with title (the path where there is none) and text."""
    text = F.when(F.col("truncated"), F.concat(F.substring(F.col("_c"), F.lit(1), F.col("tokens").cast("int") * 4), F.lit(TRUNCATED_MARK))).otherwise(F.col("_c"))
    of = sections.select("corpus_id", "path", F.col("title").alias("_title"), F.col("content").alias("_c"))
    return packed.join(of, ["corpus_id", "path"]).select("query_id", "corpus_id", "path", "ord", F.coalesce("_title", "path").alias("title"), text.alias("content"), "tokens", "score", "truncated")


def _sized(sections: DataFrame) -> DataFrame:
    """(corpus_id, path, full) of sections that have a text."""
    return sections.where("content is not null").select("corpus_id", "path", estimate(F.col("content")).alias("full"))


def retrieve_core(sections: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """The core sections, packed in the corpus's own order rather than by score."""
    points = F.create_map(*[F.lit(x) for pair in CORE.items() for x in pair])
    rows = sections.where(F.col("path").isin(*CORE)).select("corpus_id", "path", "ord").withColumn("score", points[F.col("path")])
    rows = queries.select("query_id", "corpus_id", "max_tokens").join(rows, "corpus_id").join(_sized(sections), ["corpus_id", "path"])
    return _fill(pack(rows, F.col("max_tokens"), most, rank=[F.asc("ord")]), sections)


def retrieve(sections: DataFrame, queries: DataFrame, most: int | None = None, scored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Keyword retrieval; queries without usable terms get the core sections. `scored` gives the scores of queries, those of `score` by default."""
    usable = F.size(terms(F.col("text"))) > 0
    asked = queries.where(usable)
    rows = (scored(asked) if scored else score(sections, asked)).join(asked.select("query_id", "max_tokens"), "query_id").join(_sized(sections), ["corpus_id", "path"])
    found = _fill(pack(rows, F.col("max_tokens"), most), sections)
    return found.unionByName(retrieve_core(sections, queries.where(~usable), most))


#: Bytes of query vectors that are broadcast at once; more are compared block by block.
QUERY_BYTES = 16 << 20
#: Rows that the heaps of one block's queries may hold in a task.
HEAP_ROWS = 4 << 20
#: Products that a task holds at once.
PRODUCTS = 4 << 20


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and the length of each list; 0 for null, NaN for a null value."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), sizes


def _normed(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the vectors that have a norm, and the vectors over it; others have similarity 0 to all."""
    values, sizes = _rows_of(column)
    start, out = np.cumsum(sizes) - sizes, {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        v = values[start[at][:, None] + np.arange(n)]
        norm = np.sqrt((v * v).sum(axis=1))
        usable = norm > 0
        out[n] = (at[usable], v[usable] / norm[usable][:, None])
    return out


def similar(cache: DataFrame, vectors: DataFrame, above: float = SIMILARITY_ABOVE) -> DataFrame:
    """(query_id, corpus_id, path, ord, score) of cached vectors more similar than `above` to a query's (query_id, corpus_id, vector).

    Queries are a stated set against all vectors of their corpus; each block of QUERY_BYTES is broadcast and multiplied with the cached
    vectors of a batch. Vectors that are empty, zero, null, of another length or hold a null have similarity 0; `above` is at least that.
    """
    rows = _compared(cache.withColumn("full", F.lit(1).cast("long")), vectors.withColumn("most", F.lit(None).cast("long")), above, False)
    return rows.drop("full")


def nearest(cache: DataFrame, vectors: DataFrame, above: float = SIMILARITY_ABOVE) -> DataFrame:
    """As `similar`, but of each query (query_id, corpus_id, vector, most) each task gives only the best by score, then ord: all before which
    those of the task take less than `most` tokens. `full` is a section's own token count, a column of `cache`, and stays; without it each takes one.

    The rows are still to be ranked over all tasks, where no fewer tokens stand before each: what a task leaves out has no place in a budget of
    `most`. No more than `most` non-empty ones for each query leave a task.
    """
    return _compared(cache if "full" in cache.columns else cache.withColumn("full", F.lit(1).cast("long")), vectors, above, True)


class _Heaps:
    """The best rows of each of a block's queries among those of a task: places, scores and what a row takes of the query's budget."""

    def __init__(self, most: np.ndarray):
        self.most, self.floor = most, np.full(len(most), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows: list[pa.RecordBatch] = []
        self.n = self.kept = 0

    def add(self, batch: pa.RecordBatch, place: np.ndarray, q: np.ndarray, score: np.ndarray) -> None:
        at = sum(x.num_rows for x in self.rows)
        used, back = np.unique(place, return_inverse=True)
        self.rows.append(batch.select(_HELD).take(pa.array(used)))
        self.held.append((q, score, at + back))
        self.n += len(q)
        if self.n > 2 * self.kept + PRODUCTS // 4:
            self.prune()

    def prune(self) -> None:
        if not self.held:
            return
        q, score, place = (np.concatenate(x) for x in zip(*self.held, strict=True))
        table = pa.Table.from_batches(self.rows).combine_chunks()
        order_of = table.column("ord").to_numpy()
        order = np.lexsort((order_of[place], -score, q))
        q, score, place = q[order], score[order], place[order]
        full = table.column("full").to_numpy()[place]
        upto = np.cumsum(full)
        first = np.searchsorted(q, q)
        upto = upto - (upto[first] - full[first])
        held = upto - full < self.most[q]
        last = held & (upto >= self.most[q])
        self.floor[q[last]] = score[last]
        q, score, place = q[held], score[held], place[held]
        used, back = np.unique(place, return_inverse=True)
        self.rows, self.held = table.take(pa.array(used)).combine_chunks().to_batches(), [(q, score, back)]
        self.n = self.kept = len(q)

    def take(self, ids: pa.Array, step: int = 50_000):
        self.prune()
        if not self.n:
            return
        (q, score, place), table = self.held[0], pa.Table.from_batches(self.rows)
        for lo in range(0, len(q), step):
            own = table.take(pa.array(place[lo : lo + step])).combine_chunks()
            columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (own.column(c) for c in _HELD)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[lo : lo + step])), *columns[:3], pa.array(score[lo : lo + step]), columns[3]], names=_PAIR)


#: What a heap holds of a section.
_HELD = ["corpus_id", "path", "ord", "full"]
_PAIR = ["query_id", "corpus_id", "path", "ord", "score", "full"]


def _compared(cache: DataFrame, vectors: DataFrame, above: float, heaps: bool) -> DataFrame:
    if above < 0:
        raise ValueError("above must not be negative")
    spark = cache.sparkSession
    asked = vectors.select("query_id", "corpus_id", F.col("vector").cast("array<double>").alias("vector"), F.col("most").cast("long").alias("most"))
    size, kept = asked.agg(F.sum(F.size("vector") * 8), F.sum("most")).first()
    blocks = max(1, -(-(size or 0) // QUERY_BYTES), -(-(kept or 0) // HEAP_ROWS) if heaps else 1)
    rows = cache.select("corpus_id", "path", "ord", F.col("embedding").cast("array<double>").alias("embedding"), F.col("full").cast("long").alias("full"))
    schema = T.StructType([asked.schema["query_id"], *(T.StructField(f.name, f.dataType) for f in (rows.schema[c] for c in ("corpus_id", "path", "ord"))), T.StructField("score", T.DoubleType()), T.StructField("full", T.LongType())])
    out = None
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()  # about QUERY_BYTES
        own = {}
        for corpus in pc.unique(part.column("corpus_id")).to_pylist():
            mine = part.filter(pc.equal(part.column("corpus_id"), corpus)).combine_chunks()
            ids, most = mine.column("query_id").combine_chunks(), pc.fill_null(mine.column("most"), 1 << 62).to_numpy()
            own[corpus] = {n: (ids.take(pa.array(at)), most[at], v) for n, (at, v) in _normed(mine.column("vector").combine_chunks()).items()}
        sent = spark.sparkContext.broadcast(own)

        def run(batches, sent=sent):
            held: dict = {}
            for batch in batches:
                corpora = batch.column("corpus_id")
                for corpus in pc.unique(corpora).to_pylist():
                    if corpus not in sent.value:
                        continue
                    mine = batch.filter(pc.equal(corpora, corpus))
                    for n, (at, v) in _normed(mine.column("embedding")).items():
                        if n not in sent.value[corpus]:
                            continue
                        ids, most, q = sent.value[corpus][n]
                        best = held.setdefault((corpus, n), _Heaps(most)) if heaps else None
                        step = max(1, PRODUCTS // max(1, len(ids)))
                        for lo in range(0, len(at), step):
                            # rounded before they are ranked, so that the order of addition decides no tie
                            found = np.round(v[lo : lo + step] @ q.T, 9)
                            i, j = np.nonzero((found > above) & (found >= best.floor) if heaps else found > above)
                            if heaps:
                                best.add(mine, at[lo + i], j, found[i, j])
                                continue
                            place = pa.array(at[lo + i])
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), *(mine.column(c).take(place) for c in ("corpus_id", "path", "ord")), pa.array(found[i, j]), mine.column("full").take(place)], names=_PAIR)
            for (corpus, n), best in held.items():
                yield from best.take(sent.value[corpus][n][0])

        got = rows.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def semantic_search(sections: DataFrame, cache: DataFrame, vectors: DataFrame, most: int | None = None) -> DataFrame:
    """Sections by similarity of their cached vectors to each query's (query_id, corpus_id, vector, max_tokens); ties keep the cache's order.

    Each task gives for a query no more than fills its budget of max_tokens; `pack` ranks what all tasks give.
    """
    sized = cache.join(_sized(sections), ["corpus_id", "path"])
    rows = nearest(sized, vectors.where("vector is not null").withColumn("most", F.greatest(F.col("max_tokens").cast("long"), F.lit(0))))
    return _fill(pack(rows.join(vectors.select("query_id", "max_tokens"), "query_id"), F.col("max_tokens"), most), sections)


def retrieve_v2(sections: DataFrame, queries: DataFrame, cache: DataFrame | None = None, vectors: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Semantic rows for queries that have any, keyword rows for the rest; blank queries are never searched semantically."""
    if cache is None or vectors is None:
        return retrieve(sections, queries, most)
    asked = queries.where(F.trim("text") != "").select("query_id")
    semantic = semantic_search(sections, cache, vectors.join(asked, "query_id", "left_semi"), most)
    keyword = retrieve(sections, queries, most).join(semantic.select("query_id").distinct(), "query_id", "left_anti")
    return semantic.unionByName(keyword)


def format_sections(retrieved: DataFrame) -> DataFrame:
    """(query_id, prompt): retrieved sections as one text in rank order."""
    one = F.concat(F.lit("### "), F.col("title"), F.lit(" ("), F.col("path"), F.lit(")\n"), F.col("content"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), F.col("ord").alias("b"), one.alias("c")))), lambda x: x["c"])
    return retrieved.groupBy("query_id").agg(F.concat(F.lit(PROMPT_HEAD), F.array_join(rows, SECTION_BREAK)).alias("prompt"))


def stitch(system: Column, genome: Column) -> Column:
    """Retrieved text before a system prompt; the prompt alone where nothing was retrieved."""
    return F.when(F.coalesce(genome, F.lit("")) == "", system).otherwise(F.concat(genome, F.lit(SECTION_BREAK), system))


def with_sections(prompts: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Rows (query_id, system) with retrieved text put before the system prompt."""
    return prompts.join(format_sections(retrieved), "query_id", "left").withColumn("system", stitch(F.col("system"), F.col("prompt"))).drop("prompt")


def inject(sections: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, name, content, priority, tokens) prompt parts from keyword retrieval."""
    found = retrieve(sections, queries, most)
    return format_sections(found).join(found.groupBy("query_id").agg(F.sum("tokens").alias("tokens")), "query_id").select("query_id", F.lit("genome").alias("name"), F.col("prompt").alias("content"), F.lit(PRIORITIES["Genome"]).alias("priority"), "tokens")
