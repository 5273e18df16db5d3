"""Queries over the driver's tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.functions import text as T
from quern.functions.vector import cosine
from quern.operators import budget, compaction, corpus, embeddings, fitness, generations, promptcache, proposals, registry, resume, retrieval, strategies, tokens
from quern.operators.index import Index
from quern.plans import mappings as M
from quern.session import shared_path
from quern.sources import jsonl
from quern.streaming import context_window, deltas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def _terms(x: str, least: int = 3) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda t: length(t) >= {least})"


# --- tokens and budgets


@query("select doc_id, cast(ceil(length(text) / 4.0) as bigint) tokens from documents")
def tokens_string(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", tokens.estimate_string(F.col("text")).alias("tokens"))


@query("select conv_id, cast(ceil(sum(length(text)) / 4.0) as bigint) tokens from conversations group by conv_id")
def tokens_messages(spark, sf):
    return tokens.estimate_messages(M.messages(spark, sf), "conv_id")


@query("select cast(regexp_extract(source, '(\\d+)', 1) as bigint) conv_id, cast(ceil(sum(length(text) + length(lang) + length(left(text, 30)) + 1000) / 4.0) as bigint) tokens from documents group by 1")
def tokens_blocks(spark, sf):
    return tokens.estimate_messages(M.document_results(spark, sf), "conv_id")


@query("select conv_id, cast(sum(length(text) - length(replace(text, ' ', '')) + 1) + 4 * count(*) as bigint) tokens from conversations group by conv_id")
def tokens_accurate_framing(spark, sf):
    """The accurate count with a word counter in the tokenizer's place."""
    return tokens.count_messages(M.messages(spark, sf), "conv_id", tokenizer=tokens.Tokenizer(lambda: lambda s: s.count(" ") + 1 if s else 0, "words"))


_PROVIDERS = ["xai-grok", "Anthropic", "my-OpenAI-x", "ollama", "groq", "deepseek-v3", "other"]


@query("""with p as (select c_custkey, [""" + ", ".join(f"'{p}'" for p in _PROVIDERS) + """][c_custkey % 7 + 1] provider from customer),
l as (select *, case when lower(provider) like '%xai%' then 2000000 when lower(provider) like '%anthropic%' then 200000 when lower(provider) like '%openai%' then 128000 when lower(provider) like '%ollama%' then 32000
  when lower(provider) like '%groq%' then 128000 when lower(provider) like '%deepseek%' then 128000 else 100000 end lim from p)
select c_custkey, provider, cast(lim as bigint) as context_limit, cast(least(floor(cast(lim as double) * cast(0.05 as double)), 50000) as bigint) budget from l""")  # fmt: skip
def budget_provider(spark, sf):
    names = F.array(*map(F.lit, _PROVIDERS))
    p = M.table(spark, sf, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % 7 + 1).cast("int")).alias("provider"))
    return p.select("c_custkey", "provider", budget.context_limit(F.col("provider")).alias("context_limit"), budget.system_prompt_budget(F.col("provider")).alias("budget"))


# --- compaction


@query(r"select doc_id, md5(case when length(text) > 2000 then left(text, 800) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(text, 800) else text end) content_md5 from documents")
def snip_toolresults(spark, sf):
    return compaction.snip(M.document_results(spark, sf)).select(F.col("turn").alias("doc_id"), F.md5(F.expr("blocks[0].content")).alias("content_md5"))


_EVENTS_SQL = "m as (select user_id conv_id, row_number() over (partition by user_id order by ts, event_id) turn, event_type = 'click' short, event_type h from events)"
_OLDER_SQL = "a as (select *, row_number() over (partition by conv_id order by turn desc) rd from m)"


def _flagged(spark, sf) -> DataFrame:
    return M.event_messages(spark, sf).select("conv_id", "turn", F.expr("blocks[0].content").alias("e"))


@query(f"""with {_EVENTS_SQL}, {_OLDER_SQL}, o as (select *, sum(case when short then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) g from a where rd > 5),
r as (select *, sum(short::int) over (partition by conv_id, g) n from o),
d as (select *, lag(short, 1, false) over (partition by conv_id order by turn) ps, lag(n, 1, 0) over (partition by conv_id order by turn) pn from r)
select conv_id, turn from d where not short and not (ps and pn % 2 = 1) union all select conv_id, turn from a where rd <= 5""")
def collapse_short_runs(spark, sf):
    return compaction.collapse_rows(_flagged(spark, sf), F.col("e") == "click", F.lit(None).cast("string")).select("conv_id", "turn")


@query(f"""with {_EVENTS_SQL}, {_OLDER_SQL}, t as (select *, lag(h, 1, '') over (partition by conv_id order by turn) ph from a where rd > 5)
select conv_id, turn from t where h <> ph union all select conv_id, turn from a where rd <= 5""")
def collapse_dedup(spark, sf):
    return compaction.collapse(M.event_messages(spark, sf)).select("conv_id", "turn")


@query(f"""with {_EVENTS_SQL}, {_OLDER_SQL}, o as (select *, sum(case when short then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) g from a where rd > 5),
r as (select *, sum(short::int) over (partition by conv_id, g) n from o),
d as (select *, lag(short, 1, false) over (partition by conv_id order by turn) ps, lag(n, 1, 0) over (partition by conv_id order by turn) pn from r),
k as (select * from d where not short and not (ps and pn % 2 = 1)), t as (select *, lag(h, 1, '') over (partition by conv_id order by turn) ph from k)
select conv_id, turn from t where h <> ph union all select conv_id, turn from a where rd <= 5""")
def collapse_full(spark, sf):
    return compaction.collapse_rows(_flagged(spark, sf), F.col("e") == "click", F.col("e")).select("conv_id", "turn")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 5")
def keep_recent_n(spark, sf):
    return compaction.split_recent(M.messages(spark, sf), 5).where("_recent").select("conv_id", "turn", "role")


@query("select o_orderkey, cast(o_totalprice as bigint) % 120000 + (o_orderkey % 4) * 1000 > 100000 - 8192 needs from orders")
def needs_compaction(spark, sf):
    o = M.table(spark, sf, "orders")
    actual = F.when(F.col("o_orderkey") % 2 == 0, F.col("e"))
    return o.withColumn("e", F.round("o_totalprice").cast("long") % 120000).select("o_orderkey", compaction.needs_compaction(F.col("e"), (F.col("o_orderkey") % 4) * 1000, actual).alias("needs"))


@query("select conv_id, turn, u used_tokens, round(u / 500.0, 6) utilization from (select conv_id, turn, 3 + cast(ceil(sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) / 4.0) as bigint) u from conversations)")
def window_utilization(spark, sf):
    return compaction.utilization(M.messages(spark, sf), 500, 10).select("conv_id", "turn", "used_tokens", F.round("utilization", 6).alias("utilization"))


_HEAD_SQL = "[Context Summary — earlier conversation was compacted to save tokens]' || chr(10) || chr(10) || '"
_ANSWER_SQL = "Understood. I have the context from our earlier conversation. Let me continue from where we left off."


@query(f"""with c as (select *, row_number() over (partition by conv_id order by turn desc) rd, count(*) over (partition by conv_id) n from conversations),
old as (select conv_id, left(string_agg(role || ': ' || text, chr(10) || chr(10) order by turn), 50000) t from c where n > 3 and rd > 3 group by conv_id)
select conv_id, turn, role, text from c where n <= 3
union all select conv_id, 0, 'user', '{_HEAD_SQL}' || (length(t) + 30) from old
union all select conv_id, 1, 'assistant', '{_ANSWER_SQL}' from old
union all select conv_id, 1 + row_number() over (partition by conv_id order by turn), role, text from c where n > 3 and rd <= 3""")
def autocompact_split(spark, sf):
    """A summarizer that answers with its prompt's length shows what it was given."""
    return compaction.auto_compact(M.messages(spark, sf), lambda system, prompt: str(len(prompt)), 3).select("conv_id", "turn", "role", "text")


@query("select conv_id, md5(left(string_agg(role || ': ' || text, chr(10) || chr(10) order by turn), 50000)) transcript_md5 from conversations group by conv_id")
def transcript(spark, sf):
    return compaction.transcripts(M.messages(spark, sf)).select("conv_id", F.md5("transcript").alias("transcript_md5"))


# --- retrieval

_ASKED = [(1, "the the tion src7 and heed", 3000), (2, "lich der ung src3", 1201), (3, "zzzz qqqq", 500), (4, "que ciónado los para", 900)]
_Q_SQL = "q(query_id, text, max_tokens) as (values " + ", ".join(f"({i}, '{t}', {n})" for i, t, n in _ASKED) + ")"
_SCORE_SQL = f"""{M.SECTIONS_SQL}, {_Q_SQL},
qt as (select query_id, term, count(*) times from (select query_id, unnest({_terms("text")}) term from q) group by all),
st as (select ord, path, list_transform(tags, lambda x: lower(x)) g, {_terms("title")} t, {_terms("summary")} s from sections),
ex as (select ord, path, term, 3 * list_contains(g, term)::int + 2 * list_contains(t, term)::int + list_contains(s, term)::int w from (select *, unnest(list_distinct(list_concat(g, t, s))) term from st)),
idf as (select term, greatest(1.0, ln((select count(*) from sections) / cast(count(*) as double)) + 1) idf from ex group by term),
scored as (select query_id, path, ord, round(sum(times * idf * w), 9) score from ex join qt using (term) join idf using (term) group by all having sum(times * idf * w) > 0)"""
_PACK_SQL = """packed as (select *, cum - full_ used from (select c.*, sum(full_) over (partition by query_id order by score desc, ord rows unbounded preceding) cum from cand c)),
kept as (select *, case when cum > max_tokens then max_tokens - used else full_ end tk from packed where used < max_tokens and (cum <= max_tokens or max_tokens - used > 200)),
filled as (select query_id, path, ord, round(score, 6) score, cast(tk as bigint) tokens, case when cum > max_tokens then left(content, cast(tk * 4 as bigint)) || chr(10) || chr(10) || '[... section truncated ...]' else content end content from kept join sections using (path, ord))"""


@query(f"select doc_id, term, count(*) n from (select doc_id, unnest({_terms('text')}) term from documents) group by all")
def tokenize_terms(spark, sf):
    s = M.table(spark, sf, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return s.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"select doc_id, term, count(*) n from (select doc_id, unnest({_terms('text')}) term from documents) group by all")
def tokenize_white_space(spark, sf):
    """Terms are the same where other white space than ASCII's stands between the words."""
    odd = F.translate("text", " \n\t", "\u00a0\ufeff\u2003")
    s = M.table(spark, sf, "documents").select("doc_id", F.explode(T.terms(odd)).alias("term"))
    return s.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"with {_SCORE_SQL} select term, round(idf, 6) idf from idf")
def idf(spark, sf):
    s = M.sections(spark, sf)
    return retrieval.idf(retrieval.section_terms(s), s).select("term", F.round("idf", 6).alias("idf"))


def _index(spark, sf) -> Index:
    """The stored index of the documents, built once in a session."""
    held = spark.sparkContext.__dict__.setdefault("_quern_indexes", {})
    if sf not in held or not jsonl.exists(spark, held[sf]):
        held[sf] = shared_path(spark, "index")
        Index(spark, held[sf], 8).build(M.sections(spark, sf))
    return Index(spark, held[sf], 8)


@query(f"with {_SCORE_SQL} select query_id, path, round(score, 6) score from scored")
def score_sections(spark, sf):
    return _index(spark, sf).score(M.queries_of(spark, _ASKED)).select(F.col("query_id").cast("int"), "path", F.round("score", 6).alias("score"))


def _show(df: DataFrame) -> DataFrame:
    return df.select(F.col("query_id").cast("int").alias("query_id"), "path", F.round("score", 6).alias("score"), "tokens", F.md5("content").alias("content_md5"))


_SHOW_SQL = "select query_id, path, score, tokens, md5(content) content_md5 from filled"


@query(f"with {_SCORE_SQL}, cand as (select s.*, max_tokens, tokens full_ from scored s join q using (query_id) join sections using (path, ord)), {_PACK_SQL} {_SHOW_SQL}")
def retrieve_keyword(spark, sf):
    return _show(_index(spark, sf).retrieve(M.queries_of(spark, _ASKED), most=3000))


@query(f"with {_SCORE_SQL}, cand as (select s.*, max_tokens, tokens full_ from scored s join q using (query_id) join sections using (path, ord)), {_PACK_SQL} {_SHOW_SQL}")
def index_upsert(spark, sf):
    """Retrieval from a second version, after a third of the sections were upserted in place of others."""
    s, own = M.sections(spark, sf), Index(spark, shared_path(spark, "index"), 8)
    own.build(s.withColumn("title", F.when(F.col("ord") % 3 == 1, "of another title").otherwise(F.col("title"))))
    own.upsert(s.where("ord % 3 = 1"), "now")
    return _show(own.retrieve(M.queries_of(spark, _ASKED), most=3000))


_CORE_SQL = "case ord when 11 then 'milestones/current.md' when 7 then 'strategies/active.md' when 23 then 'vision/north-star.md' else path end"


@query(f"""with base as (select doc_id ord, 'doc/' || doc_id path, text content, cast(ceil(length(text) / 4.0) as bigint) tokens from documents), sections as (select ord, {_CORE_SQL} path, content, tokens from base),
cand as (select 9 query_id, path, ord, 700 max_tokens, tokens full_, case path when 'vision/north-star.md' then 3 when 'milestones/current.md' then 2 else 1 end points, -ord score from sections where path not like 'doc/%'),
{_PACK_SQL} select query_id, path, cast(points as double) score, tokens, md5(content) content_md5 from filled join (select path, points from cand) using (path)""")
def retrieve_core(spark, sf):
    path = F.when(F.col("ord") == 11, "milestones/current.md").when(F.col("ord") == 7, "strategies/active.md").when(F.col("ord") == 23, "vision/north-star.md").otherwise(F.col("path"))
    return _show(retrieval.retrieve(M.sections(spark, sf).withColumn("path", path), M.queries_of(spark, [(9, " of ", 700)])))


@query(f"with {M.SECTIONS_SQL}, cand as (select ord % 10 query_id, path, ord, cast(tokens % 97 as double) score, 1500 max_tokens, tokens full_ from sections), {_PACK_SQL} select cast(query_id as integer) query_id, path, score, tokens, md5(content) content_md5 from filled")
def pack_budget(spark, sf):
    s = M.sections(spark, sf)
    rows = s.select((F.col("ord") % 10).alias("query_id"), "corpus_id", "path", "ord", (F.col("tokens") % 97).cast("double").alias("score"), F.col("tokens").alias("full"))
    return _show(retrieval._fill(retrieval.pack(rows, F.lit(1500), 1500), s))


@query(f"""with {_SCORE_SQL}, cand as (select s.*, max_tokens, tokens full_ from scored s join q using (query_id) join sections using (path, ord)), {_PACK_SQL}
select query_id, md5('## Project Genome' || chr(10) || chr(10) || string_agg('### ' || title || ' (' || path || ')' || chr(10) || f.content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by score desc, f.ord)) prompt_md5 from filled f join sections using (path) group by query_id""")
def format_prompt(spark, sf):
    got = retrieval.format_sections(retrieval.retrieve(M.sections(spark, sf), M.queries_of(spark, _ASKED)))
    return got.select(F.col("query_id").cast("int").alias("query_id"), F.md5("prompt").alias("prompt_md5"))


def _cache(spark, sf) -> DataFrame:
    return M.table(spark, sf, "embeddings").select(F.lit(M.CORPUS).alias("corpus_id"), F.concat(F.lit("doc/"), "vec_id").alias("path"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"))


def _vectors(spark, sf, asked=None) -> DataFrame:
    """Query vectors: every fiftieth, as a stated query set against all vectors, or those asked for."""
    return _cache(spark, sf).where("ord % 50 = 0" if asked is None else asked).select(F.col("ord").alias("query_id"), "corpus_id", F.col("embedding").alias("vector"), F.lit(2500).cast("long").alias("max_tokens"))


_COSINE_SQL = """v as (select vec_id, [cast(x as double) for x in embedding] e from embeddings),
sim as (select q.vec_id query_id, c.vec_id ord, round(list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))), 9) score from v q, v c where {asked})"""

_FIFTIETH = "q.vec_id % 50 = 0"


@query(f"with {_COSINE_SQL.format(asked=_FIFTIETH)} select query_id, ord vec_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, ord) r from sim where score > 0.3) where r <= 10")
def cosine_topk(spark, sf):
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return retrieval.nearest(_cache(spark, sf), _vectors(spark, sf).withColumn("most", F.lit(10))).withColumn("r", rank).where("r <= 10").select("query_id", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"with {M.SECTIONS_SQL}, {_COSINE_SQL.format(asked=_FIFTIETH)}, cand as (select query_id, path, ord, score, 2500 max_tokens, tokens full_ from sim join sections using (ord) where score > 0.3), {_PACK_SQL} select cast(query_id as integer) query_id, path, score, tokens, md5(content) content_md5 from filled")
def semantic_pack(spark, sf):
    return _show(retrieval.semantic_search(M.sections(spark, sf), _cache(spark, sf), _vectors(spark, sf), most=2500))


@query(f"""with {_SCORE_SQL}, {_COSINE_SQL.format(asked="q.vec_id in (1, 2)")}, cand as (select query_id, path, ord, score, 2500 max_tokens, tokens full_ from sim join sections using (ord) where score > 0.3 and query_id in (1, 2)
  union all select query_id, path, ord, score, max_tokens, tokens from scored join q using (query_id) join sections using (path, ord) where query_id in (3, 4)), {_PACK_SQL} select cast(query_id as integer) query_id, path, score, tokens, md5(content) content_md5 from filled""")
def retrieve_v2_fallback(spark, sf):
    """Queries 1 and 2 have vectors; the others fall back to keywords."""
    return _show(retrieval.retrieve_v2(M.sections(spark, sf), M.queries_of(spark, _ASKED), _cache(spark, sf), _vectors(spark, sf, F.col("ord").isin(1, 2))))


# --- embedding cache


def _old_cache(spark, sf) -> DataFrame:
    d = M.sections(spark, sf)
    own = F.md5(F.when(F.col("ord") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    old = d.where("ord % 3 <> 0").select("corpus_id", "ord", "path", F.array(F.lit(1.0)).alias("embedding"), own.alias("content_hash"), F.lit("t").alias("updated_at"))
    gone = old.limit(0).sparkSession.createDataFrame([(M.CORPUS, 10**9 + i, f"gone/{i}", [1.0], "h", "t") for i in range(5)], old.schema)
    return old.unionByName(gone)


@query("select doc_id ord, case when doc_id % 3 <> 0 and doc_id % 7 <> 0 then 'fresh' else 'stale' end status from documents")
def embedding_refresh_status(spark, sf):
    return embeddings.refresh_status(M.sections(spark, sf), _old_cache(spark, sf)).select("ord", "status")


@query("select doc_id ord, case when doc_id % 3 <> 0 and doc_id % 7 <> 0 then 't' else 'now' end updated_at, cast(case when doc_id % 3 <> 0 and doc_id % 7 <> 0 then 1 else length(text) end as double) v from documents where not (doc_id % 3 = 0 and doc_id % 5 = 0) and not (doc_id % 7 = 0 and doc_id % 3 <> 0 and doc_id % 5 = 0) union all select doc_id, 't', 1.0 from documents where doc_id % 7 = 0 and doc_id % 3 <> 0 and doc_id % 5 = 0")
def embedding_refresh(spark, sf):
    """Texts of ids divisible by five have no vector: their old entries stay."""
    s = M.sections(spark, sf).withColumn("content", F.when(F.col("ord") % 5 == 0, F.concat("content", F.lit("\u0000"))).otherwise(F.col("content")))
    old = _old_cache(spark, sf)
    fives = old.where("ord % 5 = 0").select("corpus_id", "path", F.lit(True).alias("five"))
    same = s.where("ord % 5 = 0 and ord % 7 <> 0 and ord % 3 <> 0").select("corpus_id", "path", F.md5("content").alias("new"))
    old = old.join(fives, ["corpus_id", "path"], "left").join(same, ["corpus_id", "path"], "left").withColumn("content_hash", F.coalesce("new", "content_hash")).drop("five", "new")
    new, _ = embeddings.refresh(s, old, lambda x: None if x.endswith("\u0000") else [float(len(x))], "now")
    return new.select("ord", "updated_at", F.expr("embedding[0]").alias("v"))


@query("select doc_id ord from documents where doc_id % 3 <> 0")
def embedding_purge(spark, sf):
    return embeddings.purge(_old_cache(spark, sf), M.sections(spark, sf)).select("ord")


# --- corpora


@query("select source corpus_id, cast(sum(ceil(length(text) / 4.0)) as bigint) total_tokens from documents group by source")
def total_tokens(spark, sf):
    s = M.sections(spark, sf).withColumn("corpus_id", F.col("tags")[1])
    return corpus.total_tokens(s, "corpus_id")


@query("""with s as (select doc_id ord, 'doc/' || doc_id path, left(text, 60) title, text content, cast(ceil(length(text) / 4.0) as bigint) tokens from documents where lang <> 'de'),
w as (select 'doc/' || doc_id path, 'new' title, text || '!' content, lang from documents where lang <> 'en')
select s.ord, path, coalesce(w.title, s.title) title, md5(coalesce(w.content, s.content)) content_md5, case when w.path is null then tokens else cast(ceil(length(w.content) / 4.0) as bigint) end tokens from s left join w using (path)
union all select (select max(ord) from s) + row_number() over (order by path), path, title, md5(content), cast(ceil(length(content) / 4.0) as bigint) from w where lang = 'de'""")
def upsert_sections(spark, sf):
    """Texts in German are new, those in English stay, all others are written over."""
    s = M.sections(spark, sf).withColumn("lang", F.col("tags")[0])
    written = s.where("lang <> 'en'").select("corpus_id", "path", F.lit("new").alias("title"), "summary", "tags", F.concat("content", F.lit("!")).alias("content"))
    return corpus.upsert(s.where("lang <> 'de'").drop("lang"), written, "now").select("ord", "path", "title", F.md5("content").alias("content_md5"), "tokens")


def _markdown(spark, sf, head: Column, end: str) -> DataFrame:
    """(corpus_id, b): the documents of a file as sections of one text, in order."""
    part = F.concat(head, F.lit(end), F.translate("text", "\n", " "))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "p"))), lambda x: x["p"]), end)
    return M.table(spark, sf, "documents").withColumn("p", part).groupBy(M.file_of().alias("corpus_id")).agg(body.alias("b"))


_KINDS = ["Architecture", "Commands", "Key Directories"]


@query(rf"""with r as (select {M.FILE_SQL} corpus_id, doc_id, doc_id % 4 k, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') body from documents),
f as (select corpus_id, min(doc_id) filter (k = 0) a0, min(doc_id) filter (k = 2) a2, max(doc_id) filter (k = 0) b0, max(doc_id) filter (k = 2) b2, max(doc_id) filter (k = 1) b1 from r group by corpus_id)
select corpus_id, 'about ' || corpus_id description, (select body from r where r.corpus_id = f.corpus_id and doc_id = case when a0 is null or a2 > a0 then b2 else b0 end) architecture, (select body from r where r.corpus_id = f.corpus_id and doc_id = b1) commands from f""")
def markdown_migrate(spark, sf):
    """Of two matching headers the one counts that came up later; of its repeats, the last text."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS), F.concat(F.lit("Other "), "doc_id")), (F.col("doc_id") % 4 + 1).cast("int"))
    files = _markdown(spark, sf, F.concat(F.lit("## "), kind), "\n").select("corpus_id", F.concat(F.lit("# T\n\nabout "), "corpus_id", F.lit("\n"), "b").alias("text"))
    return corpus.migrate(files)


@query(rf"select {M.FILE_SQL} corpus_id, 'other ' || doc_id header, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') body from documents")
def markdown_sections(spark, sf):
    files = _markdown(spark, sf, F.concat(F.lit("##  Other "), "doc_id"), "\r\n").select("corpus_id", F.concat(F.lit("lost\n"), "b").alias("text"))
    return corpus.markdown_sections(files).select("corpus_id", "header", "body")


@query("select doc_id, doc_id % 6 in (0, 2, 4) inside from documents")
def path_guard(spark, sf):
    forms = ["vision/{}.md", "../{}.md", "a/../b/{}.md", "a/../../genome-evil/{}.md", "./x//{}.md", "../../../etc/{}"]
    path = F.element_at(F.array(*[F.concat(F.lit(f.split("{}")[0]), "source", F.lit(f.split("{}")[1])) for f in forms]), (F.col("doc_id") % 6 + 1).cast("int"))
    return M.table(spark, sf, "documents").select("doc_id", corpus.stays_inside(path).alias("inside"))


@query("select c_custkey, case when c_custkey % 3 = 0 then '/w/n' || c_nationkey when c_custkey % 3 = 1 then '/w' end root from customer")
def ancestor_root(spark, sf):
    c = M.table(spark, sf, "customer")
    start = F.concat(F.element_at(F.array(F.lit("/w/n"), F.lit("/w/x"), F.lit("/v/n")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_nationkey"), F.lit("/src/c"), F.col("c_custkey"))
    roots = c.select(F.concat(F.lit("/w/n"), "c_nationkey").alias("root")).union(c.sparkSession.createDataFrame([("/w",)], "root string"))
    return corpus.find_root(c.select(start.alias("start")), roots).select(F.regexp_extract("start", r"(\d+)$", 1).cast("long").alias("c_custkey"), "root")


# --- strategies


@query(f"with {M.STRATEGIES_SQL} select seq, name from strategies where generation = 1 and category = 'click'")
def strategy_filter(spark, sf):
    return strategies.select(M.strategies(spark, sf), generation=1, category="click").select("seq", "name")


_BOARD_SQL = "count(*) uses, count(*) filter (success) successes, round(avg(success::int), 6) success_rate, round(avg(duration), 6) avg_duration, round(avg(a - b), 6) avg_test_improvement"


def _board(df: DataFrame) -> DataFrame:
    return df.select("category", F.col("rank").cast("long").alias("rank"), "name", "uses", "successes", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_duration", "avg_test_improvement")])


@query(f"with {M.STRATEGIES_SQL} select category, row_number() over (partition by category order by avg(success::int) desc, count(*) desc, min(seq)) as rank, name, {_BOARD_SQL} from strategies group by category, name having count(*) >= 2")
def leaderboard(spark, sf):
    return _board(strategies.leaderboard(M.strategies(spark, sf)))


@query(f"with {M.STRATEGIES_SQL}, b as (select category, row_number() over (partition by category order by avg(success::int) desc, count(*) desc, min(seq)) as rank, name, {_BOARD_SQL} from strategies group by category, name having count(*) >= 2) select * from b where rank = 1")
def suggest_strategy(spark, sf):
    return _board(strategies.suggest(M.strategies(spark, sf)))


@query(f"with {M.STRATEGIES_SQL}, c as (select agent_id, category, count(*) n from strategies group by all), g as (select agent_id, string_agg(category || '=' || n, ',' order by category) categories from c group by agent_id) select agent_id, count(*) total, count(*) filter (success) successes, round(avg(success::int), 6) success_rate, any_value(categories) categories from strategies join g using (agent_id) group by agent_id")
def agent_profile(spark, sf):
    entries = F.transform(F.array_sort(F.map_entries("category_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return strategies.profiles(M.strategies(spark, sf)).select("agent_id", "total", "successes", F.round("success_rate", 6).alias("success_rate"), F.array_join(entries, ",").alias("categories"))


@query(f"with {M.STRATEGIES_SQL.replace('cast(user_id as varchar)', 'event_type')} select * from (select agent_id, row_number() over (partition by agent_id order by count(*) desc, min(seq)) as rank, name, count(*) uses from strategies group by agent_id, name) where rank <= 5")
def top_strategies(spark, sf):
    s = M.strategies(spark, sf).withColumn("agent_id", F.col("category"))
    return strategies.top_strategies(s).select("agent_id", F.col("rank").cast("long").alias("rank"), "name", "uses")


# --- session log


@query(f"with {M.LOG_SQL} select seq, ts, agent, event from log order by seq desc limit 50")
def log_read_recent(spark, sf):
    return resume.read(M.session_log(spark, sf), 50).select("seq", "ts", "agent", "event")


@query(f"with {M.LOG_SQL}, m as (select min(ts) t from log where seq >= 500) select seq, ts, tool, path, summary from log where agent = 'agent2' and ts >= '2024-01-10'")
def log_read_agent_since(spark, sf):
    return resume.select(M.session_log(spark, sf), "agent2", "2024-01-10").select("seq", "ts", "tool", "path", "summary")


_LINE_SQL = "substr(ts, 12, 8) || ' ' || agent || ' ' || event || coalesce(' ' || tool, '') || coalesce(' ' || regexp_extract(path, '[^/]+/[^/]+$'), '') || coalesce(' - ' || summary, '')"


@query(f"with {M.LOG_SQL}, r as (select * from log order by seq desc limit 10) select string_agg({_LINE_SQL}, chr(10) order by seq desc) recent_activity from r")
def resume_activity(spark, sf):
    return resume.activity(resume.read(M.session_log(spark, sf), 10))


@query(f"""with {M.LOG_SQL}, r as (select * from log order by seq desc limit 40), o as (select * from r where cwd like '/p1%'),
a as (select string_agg(agent, ', ' order by s desc) x from (select agent, max(seq) s from o group by agent)),
p as (select string_agg(p, ', ' order by s desc) x from (select regexp_extract(path, '[^/]+/[^/]+$') p, max(seq) s from o where path is not null group by 1 order by s desc limit 5)),
t as (select string_agg(tool, ', ' order by s desc) x from (select tool, max(seq) s from o where tool is not null group by 1 order by s desc limit 5))
select coalesce((select summary from o where summary is not null order by seq desc limit 1), 'Session activity recorded') || '. Agent(s): ' || a.x || coalesce('; touched ' || p.x, '') || coalesce('; used ' || t.x, '') || '.' last_session_summary from a, p, t""")
def session_summary(spark, sf):
    return resume.summary(resume.read(M.session_log(spark, sf), 40), "/p1")


@query(f"with {M.LOG_SQL} select seq, ts, event, summary from log")
def scan_jsonl_roundtrip(spark, sf):
    """The log as JSON lines and back."""
    path = shared_path(spark, "jsonl")
    jsonl.append_jsonl(M.session_log(spark, sf), path)
    return jsonl.read_jsonl(spark, path, "seq long, ts string, event string, summary string")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def json_strict_parse(spark, sf):
    e = M.table(spark, sf, "events")
    k = StructType([StructField("k", LongType())])
    props = F.col("props")
    return e.select("event_id", props, T.strict_json(props, k).alias("p")).select("event_id", F.when(T.is_json(F.col("p"), props), F.col("p.v.k")).alias("k"))


# --- proposals


@query(f"with {M.PROPOSALS_SQL} select section, count(*) n, md5(string_agg(operation || ':' || content, '|' order by seq)) items_md5 from proposals group by section")
def proposals_grouped(spark, sf):
    items = F.array_join(F.transform("items", lambda x: F.concat(x["operation"], F.lit(":"), x["content"])), "|")
    return proposals.grouped(M.proposals(spark, sf)).select("section", "n", F.md5(items).alias("items_md5"))


def _sections_for(p: DataFrame) -> DataFrame:
    own = p.select("corpus_id", "section").distinct().where("section like '%1%'")
    return own.select("corpus_id", F.col("section").alias("path"), F.lit("old text").alias("content"))


@query(f"""with {M.PROPOSALS_SQL}, b as (select *, max(seq) filter (operation <> 'append') over (partition by section) base from proposals),
live as (select section, seq, content from b where base is null or seq >= base union all select distinct section, -1, case when section like '%1%' then 'old text' else '' end from b where base is null),
st as (select section, min(seq) filter (content <> '') s from live group by section)
select l.section, md5(coalesce(string_agg(content, chr(10) || chr(10) order by seq) filter (seq >= s), '')) content_md5, any_value(n) applied from live l join st using (section) join (select section, count(*) n from proposals group by section) using (section) group by l.section""")
def consolidate_fold(spark, sf):
    p = M.proposals(spark, sf)
    return proposals.fold(p, _sections_for(p)).select("section", F.md5("content").alias("content_md5"), "applied")


@query(f"with {M.PROPOSALS_SQL} select section, operation, '[' || operation || '] ' || left(content, 500) diff from proposals where generation = 2")
def mutations_by_generation(spark, sf):
    return proposals.of_generation(proposals.mutations(M.proposals(spark, sf), "now"), 2).select("section", "operation", "diff")


@query(f"with {M.PROPOSALS_SQL} select section, seq from (select *, row_number() over (partition by section order by seq desc) r from proposals) where r <= 3")
def mutations_last_n(spark, sf):
    return proposals.last(M.proposals(spark, sf), 3, by="section").select("section", "seq")


@query(f"with {M.PROPOSALS_SQL} select seq, array_to_string({_terms('rationale', 5)}[1:5], ',') terms from proposals")
def key_terms(spark, sf):
    return M.proposals(spark, sf).select("seq", F.array_join(T.key_terms(F.col("rationale")), ",").alias("terms"))


@query("select doc_id, 'Doc ' || upper(lang) || ' Of ' || upper(source[1:1]) || source[2:] title, 'knowledge' category from documents")
def title_category(spark, sf):
    path = F.concat(F.lit("knowledge/sub/doc-"), F.upper("lang"), F.lit("-of-"), "source", F.lit(".md"))
    return M.table(spark, sf, "documents").select("doc_id", T.title_of(path).alias("title"), T.category_of(path).alias("category"))


# --- fitness


@query("""with f as (select user_id corpus_id, string_agg(case event_type when 'error' then '// TODO: e' when 'click' then 'éfixme x' else 'line' end, chr(10) order by event_id) text from events group by user_id)
select corpus_id, round(greatest(0, least(1, 1 - 100.0 * len(regexp_extract_all(text, '(?i)\\b(TODO|FIXME|HACK|XXX)\\b')) / len(string_split(text, chr(10))))), 6) code_quality from f""")
def code_quality(spark, sf):
    line = F.when(F.col("event_type") == "error", "// TODO: e").when(F.col("event_type") == "click", "éfixme x").otherwise("line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n")
    files = M.table(spark, sf, "events").groupBy(F.col("user_id").alias("corpus_id")).agg(text.alias("text"))
    return fitness.code_quality(files).select("corpus_id", F.round("code_quality", 6).alias("code_quality"))


@query("select c_custkey, case when n is null then 0 when n = 0 then 0.3 else round(d / n, 6) end progress from customer left join (select o_custkey c_custkey, cast(count(*) as double) n, count(*) filter (o_orderstatus = 'F') d from orders group by 1) using (c_custkey)")
def milestone_progress(spark, sf):
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "- [x] order ").otherwise("- [ ] order "), "o_orderkey")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n")
    per = M.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(text.alias("m"))
    return M.table(spark, sf, "customer").join(per, "c_custkey", "left").select("c_custkey", F.round(fitness.milestone_progress(F.col("m")), 6).alias("progress"))


@query(f"with {M.PROPOSALS_SQL} select section, generation, round(least(1, count(*) / 10.0), 6) efficiency from proposals group by all")
def cost_efficiency(spark, sf):
    return M.proposals(spark, sf).groupBy("section", "generation").agg(F.round(fitness.cost_efficiency(F.count("*")), 6).alias("efficiency"))


@query("""with n as (select n_regionkey k, count(*) a, sum((n_nationkey % 3 = 0)::int) g from nation group by 1) select k region, round((a + 1) / cast(a + 1 + g as double), 6) rate from n""")
def strategy_success_rate(spark, sf):
    n = M.table(spark, sf, "nation")
    active = F.array_join(F.concat(F.array(F.lit("## Active")), F.collect_list(F.concat(F.lit("- "), "n_name"))), "\n")
    dead = F.array_join(F.concat(F.array(F.lit("# Graveyard")), F.collect_list(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("* "), "n_name")))), "\n")
    rows = n.groupBy(F.col("n_regionkey").alias("region")).agg(active.alias("a"), dead.alias("g"))
    return rows.select("region", F.round(fitness.strategy_success_rate(F.col("a"), F.col("g")), 6).alias("rate"))


@query("select o_orderkey, case when o_orderkey % 11 = 0 then 0.5 when o_orderkey % 5 + o_orderkey % 3 = 0 then case when o_orderkey % 2 = 0 then 1.0 else 0.5 end else round((o_orderkey % 5) / cast(o_orderkey % 5 + o_orderkey % 3 as double), 6) end rate from orders")
def test_output_parse(spark, sf):
    k = F.col("o_orderkey")
    out = F.when(k % 11 != 0, F.concat(F.lit("ran\n "), k % 5, F.lit(" PASS\n"), k % 3, F.lit("  fail\n99 pass")))
    return M.table(spark, sf, "orders").select("o_orderkey", F.round(fitness.test_pass_rate(out, k % 2), 6).alias("rate"))


def _scores(spark, sf, shift: int) -> DataFrame:
    k = F.col("c_custkey")
    values = [F.lit("a"), ((k + shift) % 10) / 10, F.lit("b"), ((k * 3 + shift) % 7) / 7]
    scores = F.create_map(*values)
    return M.table(spark, sf, "customer").select(k.alias("corpus_id"), (F.when(k % 4 == 0, F.map_filter(scores, lambda m, v: m == "a")).otherwise(scores) if shift else scores).alias("scores"))


@query("""with c as (select c_custkey k from customer) select k corpus_id, 'a' metric, round(((k + 3) % 10) / 10.0 - (k % 10) / 10.0, 6) delta from c
union all select k, 'b', round(case when k % 4 = 0 then 0 else ((k * 3 + 3) % 7) / 7.0 end - ((k * 3) % 7) / 7.0, 6) from c""")
def fitness_compare(spark, sf):
    got = fitness.compare(_scores(spark, sf, 0), _scores(spark, sf, 3))
    return got.select("corpus_id", "metric", F.round("delta", 6).alias("delta"))


@query("""with h as (select doc_id ord, source corpus_id, doc_id % 4 generation, n_chars s from documents), f as (select corpus_id, generation, arg_min(s, ord) s from h group by all),
m as (select source corpus_id, doc_id % 4 generation, count(*) n from documents group by all)
select corpus_id, generation, coalesce(n, 0) mutation_count, cast(s as double) score from (select distinct corpus_id, generation from h) left join f using (corpus_id, generation) left join m using (corpus_id, generation)""")
def lineage_first_fitness(spark, sf):
    d = M.table(spark, sf, "documents").select(F.col("source").alias("corpus_id"), (F.col("doc_id") % 4).alias("generation"), F.col("doc_id").alias("ord"), F.create_map(F.lit("s"), F.col("n_chars").cast("double")).alias("scores"))
    gens = d.select("corpus_id", "generation").distinct().select("*", F.lit("m").alias("milestone"), F.lit("t0").alias("started_at"), F.lit(None).cast("string").alias("ended_at"))
    got = fitness.lineage(gens, d, d, "now")
    return got.select("corpus_id", "generation", "mutation_count", F.col("fitness_scores")["s"].alias("score"))


@query("select o_orderkey, 'milestones/completed/' || case when length(o_orderkey::varchar) < 3 then lpad(o_orderkey::varchar, 3, '0') else o_orderkey::varchar end || '-gen' || o_orderkey || '.md' path from orders")
def archive_path(spark, sf):
    return M.table(spark, sf, "orders").select("o_orderkey", fitness.archive_path(F.col("o_orderkey")).alias("path"))


# --- small scalars, prompt cache, registry


@query(f"with {M.LOG_SQL} select seq, case when seq % 3 = 0 then 'bar.ts' else regexp_extract(path, '[^/]+/[^/]+$') end short from log where path is not null")
def short_path(spark, sf):
    path = F.when(F.col("seq") % 3 == 0, "bar.ts").when(F.col("seq") % 3 == 1, F.translate("path", "/", "\\")).otherwise(F.col("path"))
    return M.session_log(spark, sf).where("path is not null").select("seq", T.short_path(path).alias("short"))


@query("select conv_id, turn, role = 'user' and turn % 3 = 0 and turn = max(turn) filter (role = 'user' and turn % 3 = 0) over (partition by conv_id) marked from conversations")
def cache_last_flag(spark, sf):
    m = M.table(spark, sf, "conversations").withColumn("cache", (F.col("role") == "user") & (F.col("turn") % 3 == 0))
    return promptcache.last_flagged(m, "marked").select("conv_id", "turn", "marked")


@query("""with v as (select p_size plugin, (p_partkey % 3) || '.' || (p_partkey % 12) || '.' || (p_partkey % 5) || case when p_partkey % 6 = 0 then '-beta' else '' end as version, p_partkey % 3 a, p_partkey % 12 b, p_partkey % 5 c from part where p_partkey % 7 <> 0)
select plugin, version from (select *, row_number() over (partition by plugin order by a desc, b desc, c desc, version) r from v) where r = 1""")
def semver_latest(spark, sf):
    k = F.col("p_partkey")
    version = F.concat((k % 3).cast("string"), F.lit("."), (k % 12).cast("string"), F.lit("."), (k % 5).cast("string"), F.when(k % 6 == 0, "-beta").otherwise(""))
    rows = M.table(spark, sf, "part").select(F.col("p_size").alias("plugin"), version.alias("version"), (k % 7 != 0).alias("valid"))
    return registry.latest_versions(rows).select("plugin", "version")


@query("""with e as (select vec_id, [cast(x as double) for x in embedding] v from embeddings) select a.vec_id, round(case when a.vec_id % 5 = 0 then 0 else list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) end, 6) score from e a, e b where b.vec_id = 0""")
def cosine_pairs(spark, sf):
    """Vectors that are cut short, empty or zero have similarity 0."""
    e = M.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("q"))
    odd = F.when(F.col("vec_id") % 15 == 0, F.slice("v", 1, 3)).when(F.col("vec_id") % 5 == 0, F.transform("v", lambda x: F.lit(0.0))).otherwise(F.col("v"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("q"), odd), 6).alias("score"))


@query("select event_type, time_bucket(interval '1 hour', ts) as window_start, count(*) n, round(sum(value), 4) total from events group by all")
def events_windowed(spark, sf):
    """Batch form of the streaming window count, an extension."""
    e = M.table(spark, sf, "events")
    got = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


# --- more of the same operators, whole results


@query("select conv_id, 28000 total_tokens, u used_tokens, round(u / 28000.0, 9) utilization, n message_count from (select conv_id, 25 + cast(ceil(sum(length(text)) / 4.0) as bigint) u, count(*) n from conversations group by conv_id)")
def window_stats(spark, sf):
    got = compaction.window_stats(M.messages(spark, sf), system_chars=100)
    return got.withColumn("utilization", F.round("utilization", 9))


@query("""with m as (select conv_id, turn, case when tool then 'user' else role end as role, case when tool then null when short then 'ok' else text end as text, case when tool then result end content, not tool and short short from
  (select *, turn % 6 = 2 tool, role = 'assistant' and turn % 5 = 3 short, repeat(text || ' ', 30) result from conversations)),
s as (select * replace (case when length(content) > 2000 then left(content, 800) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(content, 800) else content end as content) from m),
z as (select *, length(coalesce(text, content)) n from s),
first as (select *, ceil(sum(n) over (partition by conv_id) / 4.0) / 600 >= 0.75 over_, row_number() over (partition by conv_id order by turn desc) rd, left(content, 200) h from z),
o as (select *, sum(case when short then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) g from first where over_ and rd > 5),
r as (select *, sum(short::int) over (partition by conv_id, g) run from o),
d as (select *, lag(short, 1, false) over (partition by conv_id order by turn) ps, lag(run, 1, 0) over (partition by conv_id order by turn) pn from r),
k as (select * from d where not short and not (ps and pn % 2 = 1)),
t as (select *, lag(h, 1, '') over (partition by conv_id, h is null order by turn) ph from k),
col as (select conv_id, turn, role, text, content, n from t where h is null or h <> ph union all select conv_id, turn, role, text, content, n from first where over_ and rd <= 5),
second as (select *, ceil(sum(n) over (partition by conv_id) / 4.0) / 600 >= 0.75 still, row_number() over (partition by conv_id order by turn desc) rd, count(*) over (partition by conv_id) left_ from col),
every as (select conv_id, turn, role, text, content from first where not over_ union all select conv_id, turn, role, text, content from second where not still or left_ <= 2
union all select conv_id, 1 + row_number() over (partition by conv_id order by turn), role, text, content from second where still and left_ > 2 and rd <= 2
union all select distinct conv_id, 0, 'user', '""" + _HEAD_SQL + """S', null from second where still and left_ > 2
union all select distinct conv_id, 1, 'assistant', '""" + _ANSWER_SQL + """', null from second where still and left_ > 2)
select conv_id, turn, role, text, md5(content) content_md5 from every""")  # fmt: skip
def compact_windows(spark, sf):
    """Some answers are short and some messages long tool results, so that windows are snipped, collapsed and then summarised."""
    c, turn = M.table(spark, sf, "conversations"), F.col("turn")
    tool, short = turn % 6 == 2, (F.col("role") == "assistant") & (turn % 5 == 3)
    result = F.array(M.block(type=F.lit("tool_result"), content=F.repeat(F.concat("text", F.lit(" ")), F.lit(30))))
    m = c.select("conv_id", "turn", F.when(tool, "user").otherwise(F.col("role")).alias("role"), F.when(tool, None).when(short, "ok").otherwise(F.col("text")).alias("text"), F.when(tool, result).alias("blocks"))
    got = compaction.compact_window(m, lambda system, prompt: "S", compaction.WindowConfig(max_tokens=600, recent_message_count=2))
    return got.select("conv_id", "turn", "role", "text", F.md5(F.expr("blocks[0].content")).alias("content_md5"))


@query(f"with {_SCORE_SQL}, cand as (select s.*, max_tokens, tokens full_ from scored s join q using (query_id) join sections using (path, ord)), {_PACK_SQL} select query_id, 25 priority, cast(sum(tokens) as bigint) tokens from filled group by query_id")
def inject_tokens(spark, sf):
    return retrieval.inject(M.sections(spark, sf), M.queries_of(spark, _ASKED)).select(F.col("query_id").cast("int").alias("query_id"), "priority", "tokens")


@query("select 'docs' corpus_id, count(*) filter (stale and doc_id % 5 > 0) updated, count(*) filter (not stale) skipped, count(*) filter (stale and doc_id % 5 = 0) failed from (select *, doc_id % 3 = 0 or doc_id % 7 = 0 stale from documents)")
def embedding_counters(spark, sf):
    """Texts whose id is divisible by five have no vector."""
    s = M.sections(spark, sf)
    none = F.when(F.col("ord") % 5 == 0, F.concat("content", F.lit("\u0000"))).otherwise(F.col("content"))
    old = _old_cache(spark, sf).join(s.select("path", F.when(F.md5("content") != F.md5(none), F.md5(none)).alias("new"), F.md5("content").alias("own")), "path", "left")
    old = old.withColumn("content_hash", F.when(F.col("new").isNotNull() & (F.col("content_hash") == F.col("own")), F.col("new")).otherwise(F.col("content_hash"))).drop("new", "own")
    return embeddings.refresh(s.withColumn("content", none), old, lambda x: None if x.endswith("\u0000") else [1.0], "now")[1]


@query("select conv_id stream_id, coalesce(string_agg(text, '' order by turn) filter (turn % 3 > 0), '') as text from conversations group by conv_id")
def stream_deltas(spark, sf):
    """Events of all streams in three batches, out of order in each and over them, some twice."""
    c = M.table(spark, sf, "conversations")
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long") - 1
    kind = F.when(F.col("turn") % 3 > 0, deltas.DELTA).otherwise("usage")
    rows = c.select(F.col("conv_id").alias("stream_id"), seq.alias("seq"), kind.alias("type"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("turn")).alias("ts"))
    source, sink, state = (shared_path(spark, n) for n in ("deltas", "parts", "delta-state"))
    context_window.use_state_store(spark)
    for batch in ("seq % 3 = 1 or seq = 0", "seq % 3 = 2 or seq % 7 = 1", "seq % 3 = 0"):
        rows.where(batch).orderBy(F.xxhash64("stream_id", "seq")).write.mode("append").parquet(source)
        parts = deltas.ordered(spark.readStream.schema(rows.schema).parquet(source))
        with _state_partitions(spark, c):
            parts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return deltas.joined(spark.read.parquet(sink)).select("stream_id", "text")


@query("""with f as (select *, max(turn) filter (role = 'user') over (partition by conv_id) l from conversations)
select conv_id, turn, case when turn = l then null else text end as text, case when turn = l then text end block_text, case when turn = l then 'ephemeral' end mark, case when turn = l then null else role = 'user' end as cache from f""")
def cache_breakpoints(spark, sf):
    kind = "array<struct<type:string,text:string,cache_control:string>>"
    m = M.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.lit(None).cast(kind).alias("blocks"), (F.col("role") == "user").alias("cache"))
    got = promptcache.breakpoints(m)
    return got.select("conv_id", "turn", "text", F.expr("blocks[0].text").alias("block_text"), F.expr("blocks[0].cache_control").alias("mark"), "cache")


@query("""with n as (select n_nationkey, n_name, n_regionkey from nation) select cast(n_regionkey as varchar) corpus_id, 'm' || n_regionkey milestone, string_agg(n_name, ',' order by n_nationkey) names from n group by n_regionkey""")
def document_roundtrip(spark, sf):
    """Manifests as JSON documents, written, read again, and their sections in their order."""
    n = M.table(spark, sf, "nation")
    out = None
    path = shared_path(spark, "manifests")
    for r in range(5):  # a region is one document
        rows = n.where(F.col("n_regionkey") == r)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("path")))
        doc = rows.agg(F.lit(1).alias("version"), F.lit(f"{r}").alias("project"), parts.alias("sections"), F.struct(F.lit(1).alias("number"), F.lit(f"m{r}").alias("milestone")).alias("generation"))
        jsonl.write_document(doc, f"{path}/{r}.json", "now")
        m = jsonl.read_document(spark, f"{path}/{r}.json")
        names = jsonl.manifest_sections(m, f"{r}").groupBy("corpus_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]), ",").alias("names"))
        got = m.select(F.col("project").alias("corpus_id"), "generation.milestone").join(names, "corpus_id")
        out = got if out is None else out.unionByName(got)
    return out


@contextlib.contextmanager
def _state_partitions(spark, rows: DataFrame):
    """A stream's state has as many partitions as a shuffle has at its first start: here by the number of rows, and no more than the session's."""
    key, n = "spark.sql.shuffle.partitions", rows.count()
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 8 + n // 50_000)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _window_sql(budget: int, recent: int, system: str, said: int) -> str:
    """State of each conversation's window after each message: (conv_id, k, chars, n, compactions, last, total). Messages are none that collapse
    drops, so a full window becomes a summary of `said` characters, its answer, and the `recent` last messages.
    """
    head = len(compaction.SUMMARY_HEAD) + said + len(compaction.SUMMARY_ANSWER)
    return f"""recursive m as (select conv_id, k, l, sum(l) over (partition by conv_id order by k) p, count(*) over (partition by conv_id) total, {system} sys from
  (select conv_id, row_number() over (partition by conv_id order by turn) k, case when role = 'assistant' and turn % 4 = 1 and length(text) > 2000 then 1623 else length(text) end l from conversations)),
w as (select conv_id, cast(0 as bigint) k, cast(0 as hugeint) chars, cast(0 as bigint) n, cast(0 as bigint) compactions from conversations group by conv_id
union all select conv_id, k, case when full_ and n > {recent} then {head} + p - coalesce(before, 0) else chars end, case when full_ and n > {recent} then {recent} + 2 else n end, compactions + case when full_ then 1 else 0 end from
  (select w.conv_id, m.k, w.chars + m.l chars, w.n + 1 n, compactions, m.p, b.p before, (ceil(m.sys / 4.0) + ceil((w.chars + m.l) / 4.0)) / {budget} >= 0.75 full_ from w join m on m.conv_id = w.conv_id and m.k = w.k + 1 left join m b on b.conv_id = m.conv_id and b.k = m.k - {recent})),
final as (select w.* from w join (select conv_id, count(*) k from conversations group by conv_id) using (conv_id, k))"""


@query(f"""with {_window_sql(400, 3, "0", 7)} select conv_id, n message_count, cast(ceil(chars / 4.0) as bigint) used_tokens, compactions, n state_messages, cast(chars as bigint) state_chars from final""")
def stream_context_windows(spark, sf):
    """Conversations as a stream into keyed state, with windows that most of them fill, some more than once. The query is stopped in the middle and
    started again; the messages are read from its state.
    """
    source, sink, state = (shared_path(spark, n) for n in ("messages", "windows", "window-state"))
    rows = M.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", ((F.col("role") == "assistant") & (F.col("turn") % 4 == 1)).alias("tool"))
    context_window.use_state_store(spark)
    config = compaction.WindowConfig(max_tokens=400, recent_message_count=3)
    for k, part in enumerate(("turn < 4", "turn >= 4")):
        rows.where(part).write.mode("append").parquet(source)
        stream = context_window.context_windows(spark.readStream.schema(rows.schema).parquet(source), config, lambda system, prompt: "so far.")
        keep = lambda df, i, k=k: df.withColumn("run", F.lit(k)).withColumn("batch", F.lit(i)).write.mode("append").parquet(sink)
        with _state_partitions(spark, rows):
            stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    got = spark.read.parquet(sink).groupBy("conv_id").agg(*[F.max_by(c, F.struct("run", "batch")).alias(c) for c in ("message_count", "used_tokens", "compactions")])
    held = context_window.window_messages(spark, state).groupBy("conv_id").agg(F.count("*").alias("state_messages"), F.sum(F.length("text")).alias("state_chars"))
    return got.join(held, "conv_id")


@query("""with s as (select c_custkey k, c_custkey % 3 d from customer) select cast(k as varchar) corpus_id, cast(case d when 0 then 0.3 when 1 then 0.5 else 1 end as double) milestone, cast(round(coalesce(least(1, n / 10.0), 0), 6) as double) cost, cast(0.5 as double) tests
from s left join (select o_custkey k, count(*) n from orders group by 1) using (k)""")
def fitness_measure(spark, sf):
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("corpus_id"))
    text = F.when(F.col("k") % 3 == 0, "no boxes").when(F.col("k") % 3 == 1, "[x] [ ]").otherwise("[X]")
    sections = c.select("corpus_id", F.lit("milestones/current.md").alias("path"), text.alias("content"))
    done = M.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("corpus_id"), F.lit(1).cast("long").alias("generation"))
    corpora = c.select("corpus_id", F.lit(1).cast("long").alias("generation"), F.lit(None).cast("string").alias("test_output"), F.lit(0).alias("exit_code"))
    got = fitness.measure(corpora, sections, spark.createDataFrame([], "corpus_id string, text string"), done)
    value = lambda k, n: F.round(F.col("scores")[k], 6).alias(n)
    return got.select("corpus_id", value("milestoneProgress", "milestone"), value("costEfficiency", "cost"), value("testPassRate", "tests"))


@query("select doc_id, '[' || case when doc_id % 15 = 0 then 'update' else 'append' end || '] ' || left(text, 500) diff from documents")
def diff_text(spark, sf):
    op = F.when(F.col("doc_id") % 15 == 0, "update").otherwise("append")
    return M.table(spark, sf, "documents").select("doc_id", proposals.diff_text(op, F.col("text")).alias("diff"))


@query("select query_id, string_agg(c, chr(10) || chr(10) order by p, n) prompt from (select o_custkey query_id, 'p' || o_orderkey n, o_orderkey % 4 * 10 p, o_orderpriority c from orders) group by query_id")
def assemble_prompts(spark, sf):
    k = F.col("o_orderkey")
    return generations.assemble(M.table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("p"), k).alias("name"), F.col("o_orderpriority").alias("content"), (k % 4 * 10).alias("priority")))
