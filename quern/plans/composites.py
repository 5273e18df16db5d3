"""Queries of composites, reports and sources over the driver's tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import compaction, corpus, fitness, generations, promptcache, proposals, resume, retrieval, strategies, tokens
from quern.plans import mappings as M
from quern.plans.queries import _ASKED, _PACK_SQL, _SCORE_SQL, _state_partitions, _window_sql, query
from quern.session import shared_path
from quern.sources import jsonl, ranges, sessionlog
from quern.streaming import context_window, tail

# --- reports


def _bar_sql(x: str, cells: int) -> str:
    return f"repeat('█', cast(floor({x} * {cells} + 0.5) as integer)) || repeat('░', {cells} - cast(floor({x} * {cells} + 0.5) as integer))"


#: Scores that are whole sixteenths, so that no rounding is near a tie that decimals and doubles see differently.
_SCORES = {"testPassRate": 5, "codeQuality": 3, "milestoneProgress": 7}
_WORDS = {"testPassRate": "Test Pass Rate", "codeQuality": "Code Quality", "milestoneProgress": "Milestone Progress"}
_ORDERED = [k for k in fitness.METRICS if k in _SCORES]


def _scores(k: Column) -> Column:
    return F.create_map(*[x for name, m in _SCORES.items() for x in (F.lit(name), ((k * m) % 17) / 16)])


def _score_sql(name: str, key: str = "c_custkey") -> str:
    return f"((({key} * {_SCORES[name]}) % 17) / 16.0)"


def _line_sql(name: str, shown: str, width: int, cells: int) -> str:
    x = _score_sql(name)
    return f"'  ' || rpad('{shown}', {width}, ' ') || ' ' || {_bar_sql(x, cells)} || ' ' || cast(cast(floor({x} * 100 + 0.5) as integer) as varchar) || '%'"


@query("select c_custkey, 'Fitness Metrics:' || chr(10) || " + " || chr(10) || ".join(_line_sql(k, _WORDS[k], 25, 20) for k in _ORDERED) + " report from customer")
def fitness_report(spark, sf):
    rows = M.table(spark, sf, "customer").select("c_custkey", _scores(F.col("c_custkey")).alias("scores"))
    return fitness.report(rows).select("c_custkey", "report")


@query("select c_custkey, 'Generation ' || c_nationkey || ': m' || c_nationkey || chr(10) || chr(10) || 'Fitness:' || chr(10) || " + " || chr(10) || ".join(_line_sql(k, k, 20, 10) for k in _ORDERED) + """ || chr(10) || chr(10) || 'Mutations: ' || c_custkey
  || case when c_custkey % 2 = 0 then chr(10) || 'Promoted: a, b' else '' end || case when c_custkey % 3 = 0 then chr(10) || 'New experiments: x' else '' end report from customer""")  # fmt: skip
def generation_report(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    none = F.array().cast("array<string>")
    rows = M.table(spark, sf, "customer").select(
        k, n.alias("generation"), F.concat(F.lit("m"), n).alias("milestone"), _scores(k).alias("scores"), k.alias("mutations"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("promoted"), none.alias("retired"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(none).alias("experiments"),
    )
    return fitness.generation_report(rows).select("c_custkey", "report")


@query(f"""with {M.STRATEGIES_SQL}, b as (select category, row_number() over (partition by category order by avg(success::int) desc, count(*) desc, min(seq)) r, name, count(*) uses, avg(success::int) rate, avg(cast(a - b as double)) delta from strategies group by category, name having count(*) >= 2),
l as (select *, '  ' || rpad(name, 28, ' ') || ' ' || rpad(cast(cast(floor(rate * 100 + 0.5) as integer) as varchar) || '%', 8, ' ') || ' ' || rpad(uses::varchar, 6, ' ') || ' ' || case when delta >= 0 then '+' else '' end
  || format('{{:.1f}}', case when (abs(delta) * 4) % 2 = 1 then delta + sign(delta) * 0.01 else delta end) line from b)
select category, r as rank, line from l""")
def leaderboard_lines(spark, sf):
    """The report's lines, each of a board of its own. In SQL an exact half is moved, as its formatting would round it to even."""
    board = strategies.leaderboard(M.strategies(spark, sf))
    lines = strategies.report(board.withColumn("corpus_id", F.concat("category", F.lit("\u0001"), "rank"))).select("corpus_id", F.element_at(F.split("report", "\n"), -1).alias("line"))
    key = F.split("corpus_id", "\u0001")
    return lines.select(key[0].alias("category"), key[1].cast("long").alias("rank"), "line")


@query("select cast(row_number() over (order by event_type) as integer) nth, '  ' || upper(event_type) head from (select distinct event_type from events)")
def leaderboard_heads(spark, sf):
    """Category heads of the report, in the order that they come in it."""
    text = strategies.report(strategies.leaderboard(M.strategies(spark, sf)))
    heads = F.filter(F.split("report", "\n"), lambda x: x.rlike("^  [A-Z_]+$"))
    return text.select(F.posexplode(heads).alias("nth", "head")).select((F.col("nth") + 1).alias("nth"), "head")


# --- generations


def _manifests(spark, sf) -> DataFrame:
    c = M.table(spark, sf, "customer")
    generation = F.struct(F.col("c_nationkey").cast("long").alias("number"), F.concat(F.lit("m"), F.col("c_nationkey")).alias("milestone"), F.lit("t0").alias("startedAt"), F.lit(None).cast("string").alias("endedAt"))
    return c.select(F.col("c_custkey").cast("string").alias("corpus_id"), generation.alias("generation"), F.lit("t0").alias("updatedAt"))


def _milestones(spark, sf) -> DataFrame:
    """Customers' current milestones: of every third none, of every third another one."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 1, F.concat(F.lit("# Ship it\n- [x] a\n- [ ] b "), k)).otherwise(F.concat(F.lit("# Other "), k))
    return M.table(spark, sf, "customer").where(k % 3 > 0).select(k.cast("string").alias("corpus_id"), F.lit("milestones/current.md").alias("path"), text.alias("content"))


@query("""select cast(c_custkey as varchar) corpus_id, cast(c_nationkey + 1 as bigint) generation, 'Ship it' milestone, case when c_custkey % 3 <> 1
  then '# Ship it' || chr(10) || chr(10) || 'Status: In Progress' || chr(10) || 'Generation: ' || (c_nationkey + 1) || chr(10) || chr(10) || '## Success Criteria' || chr(10) || chr(10) || '- [ ] Define success criteria for this milestone' || chr(10) end written from customer""")
def start_generation(spark, sf):
    new, written = fitness.start_generation(_manifests(spark, sf), _milestones(spark, sf), "Ship it", "now")
    rows = new.select("corpus_id", "generation.number", "generation.milestone").join(written.select("corpus_id", "content"), "corpus_id", "left")
    return rows.select("corpus_id", F.col("number").alias("generation"), "milestone", F.col("content").alias("written"))


@query("""with n as (select o_custkey k, count(*) n from orders group by 1) select cast(c_custkey as varchar) corpus_id, 'now' ended_at, coalesce(n, 0) mutation_count,
case when c_custkey % 3 > 0 then 'milestones/completed/' || lpad(c_nationkey::varchar, 3, '0') || '-gen' || c_nationkey || '.md' end archived,
case when c_custkey % 2 = 0 then cast((c_custkey % 8) / 8.0 as double) end score from customer left join n on k = c_custkey""")
def end_generation(spark, sf):
    m = _manifests(spark, sf)
    number = m.select("corpus_id", F.col("generation.number").alias("generation"))
    mutations = M.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("corpus_id")).join(number, "corpus_id")
    k = F.col("corpus_id").cast("long")
    first = number.where(k % 2 == 0).withColumn("scores", F.create_map(F.lit("s"), (k % 8) / 8)).withColumn("ord", F.lit(0).cast("long"))
    again = first.withColumn("scores", F.create_map(F.lit("s"), F.lit(9.0))).withColumn("ord", F.lit(1).cast("long"))
    ended, archived, entries = fitness.end_generation(m, _milestones(spark, sf), mutations, first.unionByName(again), "now")
    rows = ended.select("corpus_id", F.col("generation.endedAt").alias("ended_at")).join(entries.select("corpus_id", "mutation_count", F.col("fitness_scores")["s"].alias("score")), "corpus_id")
    return rows.join(archived.select("corpus_id", F.col("path").alias("archived")), "corpus_id", "left")


@query("select cast(c_custkey as varchar) corpus_id, 'strategies/' || p as path, 'base' || chr(10) || '- ' || p || c_custkey || chr(10) || case when p = 'active.md' then '- more' || chr(10) else '' end content from customer, (values ('active.md', 0), ('graveyard.md', 1)) t(p, i) where c_custkey % 2 = i or c_custkey % 5 = 0")
def evolve_strategies(spark, sf):
    """A model that promotes for even corpora, retires for odd ones, and does both for every fifth, its answer in a code fence."""
    import json

    k = F.col("c_custkey")
    c = M.table(spark, sf, "customer").select(k.cast("string").alias("corpus_id"), F.create_map(F.lit("k"), k.cast("double")).alias("scores"))
    each = F.explode(F.array(*[F.lit(p) for p in generations.LISTS.values()])).alias("path")
    sections = c.select("corpus_id", each).select("corpus_id", F.lit(0).cast("long").alias("ord"), "path", F.lit("t").alias("title"), F.lit("s").alias("summary"), F.array().cast("array<string>").alias("tags"), F.lit(1).cast("long").alias("tokens"), F.lit("t0").alias("updated_at"), F.lit("base\n\n").alias("content"))

    def model(system: str, prompt: str) -> str:
        n = int(json.loads(prompt)["k"])
        got = {"promoted": [f"active.md{n}", "more"] if n % 2 == 0 or n % 5 == 0 else [], "retired": [f"graveyard.md{n}"] if n % 2 == 1 or n % 5 == 0 else [], "experiments": []}
        return f"```json\n{json.dumps(got)}\n```"

    _, new = generations.evolve(sections, c, model, "now")
    return new.where("updated_at = 'now'").select("corpus_id", "path", "content")


@query(f"""with {M.PROPOSALS_SQL}, g as (select section, count(*) n, min(seq) s from proposals group by section)
select section, case when n > 1 then 1 else n end applied, case when n > 1 then 'merged ' || n end merged from g""")
def merge_proposals(spark, sf):
    """A model that counts the proposals that it is asked to merge."""
    p = M.proposals(spark, sf)
    sections = p.select("corpus_id", F.col("section").alias("path")).distinct().withColumn("content", F.lit("old"))
    folded, _, _ = proposals.consolidate(p, sections, "now", lambda system, prompt: f" merged {sum(x.startswith('Proposal ') and ' (' in x and x.split(' ')[1].isdigit() for x in prompt.split(chr(10)))}\n")
    return folded.select("section", "applied", F.when(F.col("content").startswith("merged "), F.col("content")).alias("merged"))


@query(f"""with {M.PROPOSALS_SQL}, d as (select lang corpus_id, count(*) n, sum(length(text) - length(replace(text, chr(10), '')) + 1 + case when doc_id % 50 = 0 then 1 else 0 end) lines, count(*) filter (doc_id % 50 = 0) marks from documents group by lang),
q as (select agent_id corpus_id, count(*) queued, count(*) filter (generation = 3) third, count(distinct section) written, count(distinct section) filter (section like '%1%') there from proposals group by agent_id)
select corpus_id, cast(1 as bigint) ord, cast(3 as bigint) generation, queued mutations, round(least(1, (third + n % 3) / 10.0), 9) cost, cast(0.75 as double) tests, round(cast(n % 7 as double) / (n % 7 + 3), 9) progress,
  round(greatest(0, least(1, 1 - marks / cast(lines as double) * 100)), 9) quality, round(cast(1 + n % 4 as double) / (2 + n % 4), 9) strategies, written - there + there + 3 sections, written from d join q using (corpus_id)""")
def evaluate_generation(spark, sf):
    """Of each language's corpus the queue is folded into its sections, some of them there before, and the third generation is measured by its
    tests, marked source files, boxes, strategies and mutations, after one evaluation before it.
    """
    docs = M.table(spark, sf, "documents").withColumn("corpus_id", F.col("lang"))
    p = M.proposals(spark, sf).withColumn("corpus_id", F.col("agent_id"))
    n = docs.groupBy("corpus_id").agg(F.count("*").cast("int").alias("n"))
    texts = {"milestones/current.md": F.concat(F.repeat(F.lit("[x] "), F.col("n") % 7), F.lit("[ ] [ ] [ ]")), "strategies/active.md": F.concat(F.lit("# A\n"), F.repeat(F.lit("- a\n"), F.col("n") % 4 + 1)), "strategies/graveyard.md": F.lit("## one\n")}
    there = p.where("section like '%1%'").select("corpus_id", F.col("section").alias("path")).distinct().withColumn("content", F.lit("old"))
    for path, text in texts.items():
        there = there.unionByName(n.select("corpus_id", F.lit(path).alias("path"), text.alias("content")))
    place = (F.row_number().over(W.partitionBy("corpus_id").orderBy("path")) - 1).cast("long")
    s = there.select("corpus_id", place.alias("ord"), "path", F.lit("T").alias("title"), F.lit("S").alias("summary"), F.array(F.lit("g")).alias("tags"), F.lit(1).cast("long").alias("tokens"), F.lit("then").alias("updated_at"), "content")
    files = docs.select("corpus_id", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("// TODO\n"), "text")).otherwise(F.col("text")).alias("text"))
    before = n.select("corpus_id", F.explode(F.expr("if(n % 3 = 0, array(), sequence(1, n % 3))")).alias("i")).select("corpus_id", F.concat(F.lit("m"), "i").alias("id"), F.lit(3).cast("long").alias("generation"), *[F.lit(None).cast("string").alias(c) for c in ("section", "agent_id", "operation", "rationale", "ts", "diff")])
    corpora = n.select("corpus_id", F.lit(3).cast("long").alias("generation"), F.lit("9 pass, 3 fail").alias("test_output"), F.lit(1).alias("exit_code"))
    history = n.select("corpus_id", F.lit(0).cast("long").alias("ord"), F.lit(2).cast("long").alias("generation"), F.create_map(F.lit("s"), F.lit(1.0)).alias("scores"))
    got = generations.evaluate(corpora, s, p, files, before, history, "now")
    score = lambda k, name: F.round(F.col("scores")[k], 9).alias(name)
    last = fitness.latest_fitness(got.history).select("corpus_id", "ord", "generation", score("costEfficiency", "cost"), score("testPassRate", "tests"), score("milestoneProgress", "progress"), score("codeQuality", "quality"), score("strategySuccessRate", "strategies"))
    after = got.sections.groupBy("corpus_id").agg(F.count("*").alias("sections"), F.count_if(F.col("updated_at") == "now").alias("written"))
    return last.join(got.mutations.groupBy("corpus_id").agg(F.count("*").alias("mutations")), "corpus_id").join(after, "corpus_id")


@query(f"with {M.STRATEGIES_SQL} select seq, name, 'strat-' head, 36 id_chars, 'now' as ts, count(*) over () distinct_ids from strategies")
def recorded_strategies(spark, sf):
    """Records get an id of their own and a time as they are queued, written as JSON lines and read again."""
    path = shared_path(spark, "strategies")
    jsonl.append_jsonl(generations.stamp(M.strategies(spark, sf).select("seq", "name"), "strat", "now"), path)
    got = jsonl.read_jsonl(spark, path, "seq long, name string, id string, ts string")
    n = got.agg(F.count_distinct("id").alias("distinct_ids"))
    return got.join(n).select("seq", "name", F.substring("id", 1, 6).alias("head"), F.length(F.substring("id", 7, 100)).alias("id_chars"), "ts", "distinct_ids")


# --- prompts


@query(f"""with {_SCORE_SQL}, cand as (select s.*, max_tokens, tokens full_ from scored s join q using (query_id) join sections using (path, ord)), {_PACK_SQL},
g as (select query_id, '## Project Genome' || chr(10) || chr(10) || string_agg('### ' || title || ' (' || path || ')' || chr(10) || f.content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by score desc, f.ord) p from filled f join sections using (path) group by query_id)
select query_id, md5(coalesce(p || chr(10) || chr(10) || '---' || chr(10) || chr(10), '') || 'You are ' || query_id) system_md5 from q left join g using (query_id)""")
def with_genome(spark, sf):
    """Queries that find nothing keep their own prompt."""
    asked = M.queries_of(spark, _ASKED)
    prompts = asked.select("query_id", F.concat(F.lit("You are "), "query_id").alias("system"))
    got = retrieval.with_sections(prompts, retrieval.retrieve(M.sections(spark, sf), asked))
    return got.select(F.col("query_id").cast("int").alias("query_id"), F.md5("system").alias("system_md5"))


_RECENT_SQL = f"""{M.LOG_SQL}, r as (select * from log order by seq desc limit 10), o as (select * from r where cwd like '/p1%'),
u as (select * from o union all select * from r where not exists (select 1 from o)),
a as (select string_agg(agent, ', ' order by s desc) x from (select agent, max(seq) s from u group by agent)),
p as (select string_agg(p, ', ' order by s desc) x from (select regexp_extract(path, '[^/]+/[^/]+$') p, max(seq) s from u where path is not null group by 1 order by s desc limit 5)),
t as (select string_agg(tool, ', ' order by s desc) x from (select tool, max(seq) s from u where tool is not null group by 1 order by s desc limit 5))"""


@query(f"""with {_RECENT_SQL} select (select string_agg(substr(ts, 12, 8) || ' ' || agent || ' ' || event || coalesce(' ' || tool, '') || coalesce(' ' || regexp_extract(path, '[^/]+/[^/]+$'), '') || coalesce(' - ' || summary, ''), chr(10) order by seq desc) from r) recent_activity,
'found' corpus_context, coalesce((select summary from u where summary is not null order by seq desc limit 1), 'Session activity recorded') || '. Agent(s): ' || a.x || coalesce('; touched ' || p.x, '') || coalesce('; used ' || t.x, '') || '.' last_session_summary from a, p, t""")
def resume_context(spark, sf):
    return resume.resume_context(M.session_log(spark, sf), spark.createDataFrame([("found",)], "prompt string"), "/p1")


_BLOCKS = "array<struct<type:string,text:string,cache_control:string>>"


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then ['text:' || o_orderpriority || ':ephemeral'] when o_orderkey % 3 = 1 then ['text:a:', 'text:' || o_orderstatus || ':ephemeral'] end system,
 case when o_orderkey % 2 = 0 then ['t1:', 't2:ephemeral'] when o_orderkey % 5 = 0 then [] end tools from orders""")
def cache_requests(spark, sf):
    """The last system block and the last tool of a request carry the mark; a string becomes a block."""
    k = F.col("o_orderkey")
    block = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"), F.lit(None).cast("string").alias("cache_control"))
    tool = lambda x: F.struct(F.lit(x).alias("name"), F.lit(None).cast("string").alias("cache_control"))
    empty = F.array().cast("array<struct<name:string,cache_control:string>>")
    rows = M.table(spark, sf, "orders").select(
        k, F.when(k % 3 == 0, F.col("o_orderpriority")).alias("system_text"), F.when(k % 3 == 1, F.array(block(F.lit("a")), block(F.col("o_orderstatus")))).cast(_BLOCKS).alias("system_blocks"),
        F.when(k % 2 == 0, F.array(tool("t1"), tool("t2"))).when(k % 5 == 0, empty).alias("tools"),
    )
    got = promptcache.request_breakpoints(rows)
    end = lambda x: F.coalesce(x["cache_control"], F.lit(""))
    return got.select("o_orderkey", F.transform("system_blocks", lambda b: F.concat_ws(":", b["type"], b["text"], end(b))).alias("system"), F.transform("tools", lambda t: F.concat_ws(":", t["name"], end(t))).alias("tools"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_comment when o_orderkey % 3 = 1 then '' end corpus, case when o_orderkey % 3 = 0 then o_comment || chr(10) || chr(10) || '---' || chr(10) || chr(10) || o_clerk else o_clerk end system from orders".replace("o_comment", "o_orderpriority").replace("o_clerk", "o_orderstatus"))
def stitch_prompts(spark, sf):
    k = F.col("o_orderkey")
    found = F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 3 == 1, "")
    return M.table(spark, sf, "orders").select("o_orderkey", found.alias("corpus"), retrieval.stitch(F.col("o_orderstatus"), found).alias("system"))


# --- sources


@query("select 'd' || (doc_id % 16) || '/' || doc_id || '.md' as path, md5(text) content_md5 from documents where text is not null")
def section_files(spark, sf):
    """The documents as markdown files in folders, each written by the task that holds it, and read back with their paths."""
    root = shared_path(spark, "sections")
    path = F.concat(F.lit("d"), (F.col("doc_id") % 16).cast("string"), F.lit("/./"), F.col("doc_id").cast("string"), F.lit(".md"))
    jsonl.write_sections(M.table(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content")).unionByName(spark.createDataFrame([("d0/x.txt", "no")], "path string, content string")), root)
    return jsonl.read_sections(spark, root).select("path", F.md5("content").alias("content_md5"))


@query("select vec_id ord, 'doc/' || vec_id path, cast(embedding[1] as double) first, len(embedding) dims, 'h' || vec_id content_hash, 't' updated_at from embeddings")
def embedding_cache_file(spark, sf):
    """The cache of a corpus as JSON arrays, each written and read by a task."""
    path = shared_path(spark, "cache")
    v = M.table(spark, sf, "embeddings")
    cache = v.select(F.lit(M.CORPUS).alias("corpus_id"), F.col("vec_id").alias("ord"), F.concat(F.lit("doc/"), "vec_id").alias("path"), F.col("embedding").cast("array<double>").alias("embedding"), F.concat(F.lit("h"), "vec_id").alias("content_hash"), F.lit("t").alias("updated_at"))
    jsonl.write_embedding_caches(cache, path)
    got = jsonl.read_embedding_caches(spark, path, M.CORPUS)
    return got.select("ord", "path", F.expr("embedding[0]").alias("first"), F.size("embedding").cast("long").alias("dims"), "content_hash", "updated_at")


@query("select 'p' || r_regionkey project, 'v2' milestone, 2 as number from region")
def manifest_update(spark, sf):
    """Manifests changed by a callback and written back."""
    path, out = shared_path(spark, "updates"), None
    change = lambda df: df.withColumn("generation", F.struct((F.col("generation.number") + 1).alias("number"), F.lit("v2").alias("milestone"), F.col("generation.startedAt"), F.col("generation.endedAt")))
    for n in [r.r_regionkey for r in M.table(spark, sf, "region").collect()]:  # five rows at every scale
        file = f"{path}/{n}.json"
        jsonl.write_document(corpus.empty_manifest(spark, f"p{n}", "t0"), file)
        got = jsonl.update_document(spark, file, change, "t1").select("project", "generation.milestone", F.col("generation.number").cast("int").alias("number"))
        out = got if out is None else out.unionByName(got)
    return out


@query("select c_custkey, '/w/c' || c_custkey || '/.quern/corpus/evolution/pending.jsonl' pending, '/w/c' || c_custkey || '/.quern/corpus/manifest.json' manifest, '/w/c' || c_custkey || '/.quern/corpus/vision/a.md' section from customer")
def corpus_paths(spark, sf):
    c = M.table(spark, sf, "customer")
    project = F.concat(F.lit("/w/c"), "c_custkey")
    return c.select("c_custkey", corpus.file_path(project, "pending").alias("pending"), corpus.file_path(project, "manifest").alias("manifest"), corpus.section_path(project, F.lit("vision/./x/../a.md")).alias("section"))


@query("""with s as (select *, case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then '- ' || c_name else '- ' || c_name || chr(10) || '- ' || c_mktsegment end items from customer),
t as (select c_custkey, unnest([
  (0, 'vision/north-star.md', '# North Star' || chr(10) || chr(10) || 'Serve ' || c_mktsegment || chr(10), 0), (1, 'vision/architecture.md', null, 134),
  (2, 'vision/principles.md', '# Design Principles' || chr(10) || chr(10) || case when items = '' then 'Core principles will be documented here as the project evolves.' else items end || chr(10), 0),
  (3, 'vision/anti-patterns.md', '# Anti-Patterns' || chr(10) || chr(10) || case when c_custkey % 2 = 0 then '- haste' else 'Approaches to avoid will be documented here as agents learn from failures.' end || chr(10), 0),
  (4, 'milestones/current.md', '# Ship ' || c_nationkey || chr(10) || chr(10) || 'Status: In Progress' || chr(10) || 'Generation: 1' || chr(10) || chr(10) || '## Success Criteria' || chr(10) || chr(10) || '- [ ] Define success criteria for this milestone' || chr(10), 0),
  (5, 'milestones/backlog.md', null, 82), (6, 'strategies/active.md', null, 209), (7, 'strategies/graveyard.md', null, 66), (8, 'strategies/experiments.md', null, 68),
  (9, 'knowledge/decisions.md', null, 69), (10, 'knowledge/discoveries.md', null, 73), (11, 'knowledge/dependencies.md', null, 67)]) x from s)
select cast(c_custkey as varchar) corpus_id, cast(x[1] as bigint) ord, x[2] path, x[3] own, cast(ceil(coalesce(length(x[3]), x[4]) / 4.0) as bigint) tokens from t""")
def bootstrap_corpora(spark, sf):
    """First sections of a corpus for each customer, with lists of no, one and two principles; the texts of those that hold what was given."""
    k, given = F.col("c_custkey"), ("vision/north-star.md", "vision/principles.md", "vision/anti-patterns.md", "milestones/current.md")
    no = F.array().cast("array<string>")
    corpora = M.table(spark, sf, "customer").select(
        k.cast("string").alias("corpus_id"), F.concat(F.lit("Serve "), "c_mktsegment").alias("vision"), F.concat(F.lit("Ship "), "c_nationkey").alias("milestone"),
        F.when(k % 3 == 0, no).when(k % 3 == 1, F.array("c_name")).otherwise(F.array("c_name", "c_mktsegment")).alias("principles"), F.when(k % 2 == 0, F.array(F.lit("haste"))).alias("anti_patterns"),
    )
    made = corpus.bootstrap_all(corpora, "now")
    return made.select("corpus_id", "ord", "path", F.when(F.col("path").isin(*given), F.col("content")).alias("own"), F.col("tokens").cast("long").alias("tokens"))


# --- tokens and compaction


@query("select p_partkey, case when p_partkey % 4 = 0 then 'o200k_base' else 'cl100k_base' end encoding from part")
def encoding_selector(spark, sf):
    models = F.array(F.lit("claude-3-5-sonnet"), F.lit("gpt-4"), F.lit(None).cast("string"), F.lit("x-claude-3-5"))
    return M.table(spark, sf, "part").select("p_partkey", tokens.encoding_for(F.element_at(models, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("encoding"))


@query("select doc_id, cast(length(text) - length(replace(text, 'a', '')) as bigint) tokens, cast(ceil(length(text) / 4.0) as bigint) fallback from documents")
def tokenizer_or_heuristic(spark, sf):
    """An accurate counter that is loaded in the workers, and the heuristic where it cannot be had."""

    def broken():
        raise OSError("no vocabulary")

    d = M.table(spark, sf, "documents").select("doc_id", "text")
    got = tokens.count_strings(d, tokenizer=tokens.Tokenizer(lambda: lambda s: s.count("a"), "letters"))
    return tokens.count_strings(got, tokenizer=tokens.Tokenizer(broken, "broken"), name="fallback").select("doc_id", "tokens", "fallback")


@query("""select conv_id, cast(sum(case turn % 4 when 0 then length(text) - length(replace(text, ' ', '')) + 1 when 1 then (length(text) - length(replace(text, ' ', '')) + 1) + 1 when 2 then 1 + 1000 else 1 end) + 4 * count(*) as bigint) tokens from conversations group by conv_id""")
def tokens_of_blocks(spark, sf):
    """Words of texts, tool names with their input, results and images."""
    t, turn = F.col("text"), F.col("turn")
    blocks = F.when(turn % 4 == 1, F.array(M.block(type=F.lit("text"), text=t), M.block(type=F.lit("tool_result"), content=F.lit("one")))).when(turn % 4 == 2, F.array(M.block(type=F.lit("tool_use"), name=F.lit("na"), input_json=F.lit("me")), M.block(type=F.lit("image_url"), url=F.lit("u")))).when(turn % 4 == 3, F.array(M.block(type=F.lit("thinking"), thinking=F.lit("hm"))))
    m = M.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(turn % 4 == 0, t).alias("text"), blocks.alias("blocks"))
    return tokens.count_messages(m, "conv_id", tokenizer=tokens.Tokenizer(lambda: lambda s: s.count(" ") + 1 if s else 0, "words"))


@query("select conv_id, turn, role = 'assistant' and turn % 3 < 2 short from conversations")
def short_answers(spark, sf):
    text = F.when(F.col("turn") % 3 == 0, "  ok \n").when(F.col("turn") % 3 == 1, "123456789").otherwise("1234567890")
    return M.table(spark, sf, "conversations").select("conv_id", "turn", compaction.is_short(F.col("role"), text).alias("short"))


# --- string rules


@query("select doc_id, cast(length(text) + 2 as bigint) units, 'x' stripped, least(5, length(text)) last_five, lpad('7', 3, '0') padded, round(n_chars / 2.0) half_up from (select *, length(text) l from documents)")
def string_rules(spark, sf):
    """UTF-16 lengths, white space beyond ASCII, the last entries of short arrays, padding, halves rounded up."""
    d = M.table(spark, sf, "documents")
    odd = F.concat("text", F.lit("😀"))
    return d.select("doc_id", T.length16(odd).alias("units"), T.trim(F.lit("﻿ x \n")).alias("stripped"), F.size(T.last(F.split("text", ""), 5)).cast("long").alias("last_five"), T.pad_start(F.lit("7"), 3).alias("padded"), T.half_up(F.col("n_chars") / 2).cast("double").alias("half_up"))


@query("select o_orderkey, case when o_orderkey % 8 = 0 then '0.5' when o_orderkey % 8 = 1 then '1.0' when o_orderkey % 8 = 2 then '-0.3' else '1.4' end shown from orders")
def fixed_decimals(spark, sf):
    """The binary value is rounded: 1.45 and 1.005 lie below their decimals, 0.45 above."""
    value = F.element_at(F.array(*[F.lit(x) for x in (0.45, 1.005, -0.25, 1.45, 1.45, 1.45, 1.45, 1.45)]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return M.table(spark, sf, "orders").select("o_orderkey", T.fixed(value, 1).alias("shown"))


@query("select n_nationkey, case when n_nationkey % 3 = 0 then null else n_name end kept from nation")
def falsy_strings(spark, sf):
    value = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name"))
    return M.table(spark, sf, "nation").select("n_nationkey", T.or_null(value).alias("kept"))


# --- fitness predicates


@query("select c_custkey, c_custkey % 4 in (1, 2) evaluated from customer")
def has_evaluation(spark, sf):
    k = F.col("c_custkey")
    history = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda g: F.struct(g.alias("generation")))
    return M.table(spark, sf, "customer").select("c_custkey", fitness.evaluated(history, k % 4).alias("evaluated"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'a,b' when o_orderkey % 3 = 1 then '' else 'c' end promoted, case when o_orderkey % 3 = 2 then 'd' else '' end experiments from orders")
def evolution_answers(spark, sf):
    """A model's answers: in a code fence, no JSON at all, and with the longer names."""
    answers = F.array(F.lit('```json\n{"promoted": ["a", "b"]}\n```'), F.lit("sorry"), F.lit('{"promotedStrategies": ["c"], "newExperiments": ["d"]}'))
    got = M.table(spark, sf, "orders").select("o_orderkey", fitness.parse_evolution(F.element_at(answers, (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("l"))
    return got.select("o_orderkey", F.array_join("l.promoted", ",").alias("promoted"), F.array_join("l.experiments", ",").alias("experiments"))


# --- the session log as a file


#: What a log's writers may leave between its entries.
_TORN = ['{"torn": ', "", "[1, 2]", "null", '{"a":1}}']
#: Entries that a task puts in order, and the most ranges: with more, tasks that deal out rows would hold all of theirs in memory
#: (spark.shuffle.sort.bypassMergeThreshold).
LOG_ROWS, LOG_RANGES = 50_000, 200


def _agent_logs(spark, sf, name: str, rows: Column | None = None, torn: bool = False) -> dict[str, str]:
    """The log's entries as files of JSON lines in the shared folder, one for each agent; paths by agent.

    Ranges of (agent, seq), more of them for more entries, are put in order and written side by side, and an agent's ranges then copied one after
    the other in blocks, so that no task holds a whole log. Lines are made behind the sort: it holds an entry once, whatever is written for it.
    """
    root = shared_path(spark, name)
    log = M.session_log(spark, sf).drop("meta")
    line = F.to_json(F.struct(*[c for c in log.columns if c != "seq"]))
    lines = F.when(F.col("seq") % 9 == 0, F.array(line, *map(F.lit, _TORN))).otherwise(F.array(line)) if torn else F.array(line)
    log = log.where(rows) if rows is not None else log
    n = max(min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), min(LOG_RANGES, math.ceil(log.count() / LOG_ROWS)))
    every = log.repartitionByRange(n, "agent", "seq").sortWithinPartitions("agent", "seq")
    every.select("agent", F.array_join(lines, "\n").alias("value")).write.partitionBy("agent").text(root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system, out, copies = path(root).getFileSystem(spark._jsc.hadoopConfiguration()), {}, []
    for folder in system.listStatus(path(root)):
        if folder.isDirectory():
            # a range's file has its number in its name
            parts = sorted((f.getPath() for f in system.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")), key=lambda p: int(p.getName().split("-")[1]))
            agent = folder.getPath().getName().removeprefix("agent=")
            out[agent] = f"{root}/{agent}.jsonl"
            if len(parts) == 1:
                system.rename(parts[0], path(out[agent]))
            else:
                copies.append((out[agent], [f"{folder.getPath().toString()}/{p.getName()}" for p in parts]))
    if copies:
        ranges.concatenate(spark, copies)
    for folder in system.listStatus(path(root)):
        if folder.isDirectory():
            system.delete(folder.getPath(), True)
    return out


def _renamed(spark, pairs: list[tuple[str, str]]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    for a, b in pairs:
        system = path(a).getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(path(b), False)
        system.rename(path(a), path(b))


@query(f"with {M.LOG_SQL} select ts, agent, event, cwd, session, tool, path, summary from log")
def log_file(spark, sf):
    """Logs of all agents read back, corrupt lines among their entries."""
    logs = _agent_logs(spark, sf, "log", torn=True)
    return sessionlog.read_log(spark, sorted(logs.values())).drop("seq", "meta")


@query(f"with {M.LOG_SQL} select agent, ts, event, summary, cast(k as integer) nth from (select *, row_number() over (partition by agent order by seq desc) k from log where ts >= '2024-01-03') where k <= 9")
def log_recent_file(spark, sf):
    """The last nine entries of each agent's log since a day, read from the end of its file."""
    out = None
    for agent, path in sorted(_agent_logs(spark, sf, "recent", torn=True).items()):
        own = sessionlog.read_recent(spark, path, limit=9, agent=agent, since="2024-01-03")
        out = own if out is None else out.unionByName(own)
    return out.select("agent", "ts", "event", "summary", F.row_number().over(W.partitionBy("agent").orderBy(F.desc("seq"))).alias("nth"))


@query(f"with {M.LOG_SQL} select ts, agent, event, tool from log")
def log_tail(spark, sf):
    """All agents' logs as one stream that is stopped and started: they grow, and are rotated before the stream has read them to the end."""
    n, seq = M.session_log(spark, sf).agg(F.min("seq"), F.max("seq")).first(), F.col("seq")
    half, quarter = (n[0] + n[1]) // 2, n[0] + (n[1] - n[0]) // 4
    logs = _agent_logs(spark, sf, "tail", seq <= quarter)
    sink, state = shared_path(spark, "tailed"), shared_path(spark, "tail-state")

    def run():
        stream = tail.tail(spark, sorted(logs.values()), from_start=True, part_bytes=1 << 18)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    grown, after = _agent_logs(spark, sf, "grown", seq <= half), _agent_logs(spark, sf, "after", seq > half)
    _renamed(spark, [(path, f"{logs[a]}.1") for a, path in grown.items()] + [(path, logs[a]) for a, path in after.items()])
    run()
    return spark.read.parquet(sink).select("ts", "agent", "event", "tool")


@query("select n_nationkey k from nation where n_nationkey >= 10")
def queue_truncate(spark, sf):
    """What was queued before the queue was emptied is gone; what came after stays."""
    n, path = M.table(spark, sf, "nation"), shared_path(spark, "queue")
    jsonl.append_jsonl(n.where("n_nationkey < 10").select(F.col("n_nationkey").alias("k")), path)
    jsonl.truncate(spark, path)
    jsonl.append_jsonl(n.where("n_nationkey >= 10").select(F.col("n_nationkey").alias("k")), path)
    return jsonl.read_jsonl(spark, path, "k long")


# --- limits


@query("select n_nationkey, case when n_nationkey < 19 then '/w' end root from nation")
def ancestor_hops(spark, sf):
    """A corpus is looked for in twenty folders, the start itself among them."""
    deep = F.concat(F.lit("/w"), F.repeat(F.lit("/d"), F.col("n_nationkey").cast("int") + 1))
    starts = M.table(spark, sf, "nation").select("n_nationkey", deep.alias("start"))
    found = corpus.find_root(starts.select("start"), spark.createDataFrame([("/w",)], "root string"))
    return starts.join(found, "start").select("n_nationkey", "root")


@query("select c_custkey, '{\"b\":\"' || c_name || '\",\"a\":[' || c_nationkey || ',null],\"d\":{\"z\":1,\"c\":\"é\"}}' json from customer")
def json_key_order(spark, sf):
    """Minified JSON keeps the order that keys were given in."""
    text = F.concat(F.lit('{ "b": "'), "c_name", F.lit('",\n "a" : ['), "c_nationkey", F.lit(', null], "d": {"z": 1, "c": "\\u00e9"} }'))
    return M.table(spark, sf, "customer").select("c_custkey", T.canonical_json(text).alias("json"))


@query(f"""with {_window_sql(400, 3, "length('Facts of ' || conv_id) + 7 + length('Old prompt of ' || conv_id)", 7)} select conv_id, n message_count, cast(ceil(chars / 4.0) as bigint) + cast(ceil((length('Facts of ' || conv_id) + 7 + length('You are ' || conv_id)) / 4.0) as bigint) used_tokens, compactions,
 'Facts of ' || conv_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'You are ' || conv_id system from final""")
def stream_prompts(spark, sf):
    """Prompts and retrieved texts that come with the stream and fill windows sooner: the prompt is set twice, the second counts at the end."""
    tool = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    rows = c = M.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", tool.alias("tool"))
    ids = c.select("conv_id").distinct()
    for turn, role, text in ((-2, context_window.SYSTEM, "Old prompt of "), (-1, context_window.CORPUS, "Facts of "), (10**6, context_window.SYSTEM, "You are ")):
        rows = rows.unionByName(ids.select("conv_id", F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.concat(F.lit(text), "conv_id").alias("text"), F.lit(False).alias("tool")))
    source, sink = shared_path(spark, "prompted"), shared_path(spark, "prompts")
    rows.write.parquet(source)
    context_window.use_state_store(spark)
    stream = context_window.context_windows(spark.readStream.schema(rows.schema).parquet(source), compaction.WindowConfig(max_tokens=400, recent_message_count=3), lambda system, prompt: "so far.")
    with _state_partitions(spark, c):
        stream.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "prompt-state")).trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("append").parquet(sink)).start().awaitTermination()
    return spark.read.parquet(sink).select("conv_id", "message_count", "used_tokens", "compactions", "system")
