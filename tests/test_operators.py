"""Operators on small inputs with known results."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import text as T
from quern.functions.vector import cosine
from quern.operators import budget, compaction, corpus, embeddings, fitness, promptcache, proposals, registry, resume, retrieval, strategies, tokens


def one(spark, column, **values):
    row = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def block(**f):
    names = [x.split(":")[0] for x in schemas.BLOCK[len("struct<") : -1].split(",")]
    return tuple(f.get(n) for n in names)


def chat(spark, rows, conv=1):
    return spark.createDataFrame([(conv, i, r, c if isinstance(c, str) else None, None if isinstance(c, str) else c) for i, (r, c) in enumerate(rows)], schemas.MESSAGES)


def contents(df):
    return [(r.role, r.text if r.text is not None else [b.content for b in r.blocks]) for r in df.orderBy("conv_id", "turn").collect()]


# --- tokens


@pytest.mark.parametrize("text, n", [("hello world", 3), ("", 0), ("abcd", 1), ("abcde", 2), ("こんにちは", 2)])
def test_estimate(spark, text, n):
    assert one(spark, tokens.estimate_string(F.col("s")), s=text) == n


def test_estimate_messages(spark):
    count = lambda rows: tokens.estimate_messages(chat(spark, rows), "conv_id").first().tokens
    assert count([("user", "hi"), ("assistant", "hello there")]) == 4
    assert count([("assistant", [block(type="tool_use", name="search", input_json='{"query":"test"}')])]) == 6
    assert count([("user", [block(type="image_url", url="u")])]) == 250
    assert count([("user", [block(type="text", text="12345678"), block(type="tool_result", content="123456")])]) == 4
    assert count([("user", [block(type="thinking", thinking="1234"), block(type="other", text="zzzzzzzzz")])]) == 1
    assert count([("user", [])]) == 0


def test_accurate_messages_and_fallback(spark):
    rows = chat(spark, [("user", "a b c"), ("user", [block(type="image_url"), block(type="text", text="x y")])])
    words = tokens.Tokenizer(lambda: lambda s: len(s.split()), "w1")
    assert tokens.count_messages(rows, "conv_id", tokenizer=words).first().tokens == 3 + 1000 + 2 + 8

    def broken():
        raise OSError

    none = tokens.Tokenizer(broken, "w2")
    assert tokens.count_messages(rows, "conv_id", tokenizer=none).first().tokens == tokens.estimate_messages(rows, "conv_id").first().tokens
    assert [r.tokens for r in tokens.count_strings(spark.createDataFrame([("abcde",)], "text string"), tokenizer=none).collect()] == [2]
    assert one(spark, tokens.encoding_for(F.col("m")), m="claude-3-5-x") == "o200k_base"
    assert one(spark, tokens.encoding_for(F.col("m")), m="gpt-4") == "cl100k_base"


@pytest.mark.parametrize("provider, limit, share", [("xai", 2000000, 50000), ("Anthropic", 200000, 10000), ("anthropic-claude-sonnet", 200000, 10000), ("xai-grok-4", 2000000, 50000), ("ollama", 32000, 1600), ("made-up", 100000, 5000), ("", 100000, 5000)])
def test_budget(spark, provider, limit, share):
    assert one(spark, budget.context_limit(F.col("p")), p=provider) == limit
    assert one(spark, budget.system_prompt_budget(F.col("p")), p=provider) == share


def test_budget_options(spark):
    assert one(spark, budget.system_prompt_budget(F.col("p"), 0.05, 10000), p="xai") == 10000
    assert one(spark, budget.system_prompt_budget(F.col("p"), 0.1), p="anthropic") == 20000


# --- compaction


def simulate_collapse(rows):
    """The sequential definition."""
    if len(rows) <= 5:
        return rows
    out, skip, before = [], False, ""
    for role, c in rows[:-5]:
        if skip:
            skip = False
            continue
        if role == "assistant" and isinstance(c, str) and len(c.strip()) < 10:
            skip = True
            continue
        if role == "user" and not isinstance(c, str):
            results = [b for b in c if b[0] == "tool_result"]
            if results:
                h = "|".join((b[9] or "")[:200] for b in results)
                if h == before:
                    continue
                before = h
        out.append((role, c))
    return out + rows[-5:]


def test_collapse_equals_its_sequential_definition(spark):
    rng = random.Random(4)
    texts = ["ok", "a long enough text", " yes \t", "another text here", "0123456789"]
    chats = []
    for _ in range(120):
        rows = []
        for _ in range(rng.randrange(14)):
            role = rng.choice(["user", "assistant", "assistant", "tool"])
            rows.append((role, rng.choice(texts) if rng.random() < 0.6 else [block(type="tool_result", content=rng.choice(["", "r1", "r2"])) for _ in range(rng.choice([1, 1, 2]))]))
        chats.append(rows)
    df = None
    for i, rows in enumerate(chats):
        for j, (r, c) in enumerate(rows):
            df = (df or []) + [(i, j, r, c if isinstance(c, str) else None, None if isinstance(c, str) else c)]
    got = {}
    for r in compaction.collapse(spark.createDataFrame(df, schemas.MESSAGES)).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text if r.text is not None else [tuple(b) for b in r.blocks]))
    for i, rows in enumerate(chats):
        assert got.get(i, []) == simulate_collapse(rows), rows


def test_snip(spark):
    cut = lambda n: one(spark, F.length(compaction.snip_text(F.col("s"))), s="x" * n)
    assert (cut(3000), cut(2001), cut(2000), cut(500)) == (1623, 1623, 2000, 500)
    rows = chat(spark, [("tool", [block(type="tool_result", content="y" * 3000), block(type="text", text="t" * 3000)]), ("user", "z" * 5000)])
    got = compaction.snip(rows).orderBy("turn").collect()
    assert len(got[0].blocks[0].content) == 1623 and len(got[0].blocks[1].text) == 3000 and len(got[1].text) == 5000


@pytest.mark.parametrize("estimated, system, actual, want", [(2, 0, None, False), (2, 90000, 5000, True), (2, 50000, 50000, True), (91808, 0, None, False), (91809, 0, None, True)])
def test_needs_compaction(spark, estimated, system, actual, want):
    row = spark.createDataFrame([(estimated, system, actual)], "e long, s long, a long")
    assert row.select(compaction.needs_compaction(F.col("e"), F.col("s"), F.col("a")).alias("x")).first().x is want


def test_auto_compact(spark):
    rows = [("user", f"m{i}") for i in range(15)]
    got = contents(compaction.auto_compact(chat(spark, rows), lambda s, p: "here is the summary", 5))
    assert len(got) == 7 and got[0] == ("user", compaction.SUMMARY_HEAD + "here is the summary") and got[1] == ("assistant", compaction.SUMMARY_ANSWER) and got[2:] == rows[-5:]
    assert contents(compaction.auto_compact(chat(spark, rows[:5]), lambda s, p: "x", 10)) == rows[:5]
    assert compaction.NO_SUMMARY in contents(compaction.auto_compact(chat(spark, rows), lambda s, p: "", 5))[0][1]


def test_transcript(spark):
    long = [block(type="text", text="a"), block(type="tool_use", name="t", input_json="j" * 300), block(type="tool_result", content="r" * 400), block(type="image_url")]
    rows = chat(spark, [("user", "hi"), ("assistant", long)] + [("user", "x" * 9000)] * 9)
    want = "user: hi\n\nassistant: a\n[Tool: t(" + "j" * 200 + ")]\n[Result: " + "r" * 300 + "]\n" + ("\n\nuser: " + "x" * 9000) * 9
    assert compaction.transcripts(rows).first().transcript == want[:50000]


def test_compact_window(spark):
    config = compaction.WindowConfig(max_tokens=100, recent_message_count=3)
    small = chat(spark, [("user", "short")] * 3, 1)
    big = chat(spark, [("user", f"{i} " + "w" * 60) for i in range(12)], 2)
    got = compaction.compact_window(small.unionByName(big), lambda s, p: "S", config)
    assert got.where("conv_id = 1").count() == 3 and got.where("conv_id = 2").count() == 5
    assert compaction.compact_window(big, None, config).count() == 12
    stats = compaction.window_stats(small, config).first()
    assert (stats.total_tokens, stats.used_tokens, stats.message_count) == (100, 4, 3)


# --- retrieval


def docs(spark, *rows):
    return spark.createDataFrame([("c", i, p, t, s, g, 0, None, x) for i, (p, t, s, g, x) in enumerate(rows)], schemas.SECTIONS)


def ask(spark, text, n):
    return spark.createDataFrame([(1, "c", text, n)], schemas.QUERIES)


def test_repeated_query_terms_count_again(spark):
    d = docs(spark, ("a", "north star", "", [], "x"), ("b", "other", "north", ["north"], "y"))
    s = {r.path: r.score for r in retrieval.score(d, ask(spark, "North north", 9)).collect()}
    assert s == {"a": 4.0, "b": 8.0}


@pytest.mark.parametrize("left, want", [(200, [("a", 100)]), (201, [("a", 100), ("b", 201)])])
def test_packing_truncates_once_and_stops(spark, left, want):
    d = docs(spark, ("a", "term", "", ["term"], "x" * 400), ("b", "term", "", [], "y" * 2000), ("d", "", "term", [], "z"))
    got = retrieval.retrieve(d, ask(spark, "term", 100 + left)).orderBy(F.desc("score")).collect()
    assert [(r.path, r.tokens) for r in got] == want
    if left == 201:
        assert got[1].content == "y" * 804 + retrieval.TRUNCATED_MARK


def test_exact_fill_stops_and_missing_texts_take_no_budget(spark):
    d = docs(spark, ("a", "term", "", ["term"], None), ("b", "term", "", ["term"], "x" * 40), ("e", "", "term", [], ""))
    assert [r.path for r in retrieval.retrieve(d, ask(spark, "term", 10)).collect()] == ["b"]
    assert sorted(r.path for r in retrieval.retrieve(d, ask(spark, "term", 11), most=11).collect()) == ["b", "e"]


def test_core_sections_pack_in_their_own_order(spark):
    d = docs(spark, ("strategies/active.md", "s", "", [], "x" * 40), ("vision/north-star.md", "v", "", [], "y" * 40), ("z", "", "", [], "q"))
    got = retrieval.retrieve(d, ask(spark, " a ", 10)).collect()
    assert [(r.path, r.score) for r in got] == [("strategies/active.md", 1.0)]


def test_packing_equals_its_sequential_definition(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(60):
        most = rng.choice([201, 600, 2000])
        own = [(rng.choice([0, 1, 50, 199, 200, 201, 500]), rng.randrange(4)) for _ in range(rng.randrange(9))]
        rows += [(q, "c", str(i), i, float(s), t, most) for i, (t, s) in enumerate(own)]
        used, out = 0, []
        for i, (t, _) in sorted(enumerate(own), key=lambda x: (-x[1][1], x[0])):
            if used >= most:
                break
            if used + t > most:
                if most - used > 200:
                    out.append((i, most - used))
                break
            out.append((i, t))
            used += t
        want[q] = sorted(out)
    df = spark.createDataFrame(rows, "query_id long, corpus_id string, path string, ord long, score double, full long, m long")
    for most in (None, 2000):
        got = {q: [] for q in want}
        for r in retrieval.pack(df, F.col("m"), most).collect():
            got[r.query_id].append((r.ord, r.tokens))
        assert {q: sorted(v) for q, v in got.items()} == want


def test_cosine(spark):
    c = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("x")).first().x
    assert c([1.0, 0.0], [2.0, 0.0]) == 1.0
    assert c([], []) == c([0.0], [1.0]) == c([1.0], [1.0, 2.0]) == c(None, [1.0]) == 0.0


def test_similarity_must_exceed_the_threshold(spark):
    cache = spark.createDataFrame([("c", 0, "a", [0.5, 0.0], "h", "t")], schemas.EMBEDDING_CACHE)
    v = spark.createDataFrame([(1, "c", [1.0, 0.0], 100)], "query_id long, corpus_id string, vector array<double>, max_tokens long")
    assert retrieval.similar(cache, v, 1.0).count() == 0 and retrieval.similar(cache, v, 0.99).count() == 1


def test_prompts(spark):
    d = docs(spark, ("p", "T", "", ["term"], "body"))
    found = retrieval.retrieve(d, ask(spark, "term", 50))
    assert retrieval.format_sections(found).first().prompt == "## Project Genome\n\n### T (p)\nbody"
    prompts = spark.createDataFrame([(1, "sys"), (2, "alone")], "query_id long, system string")
    got = {r.query_id: r.system for r in retrieval.with_sections(prompts, found).collect()}
    assert got == {1: "## Project Genome\n\n### T (p)\nbody\n\n---\n\nsys", 2: "alone"}
    part = retrieval.inject(d, ask(spark, "term", 50)).first()
    assert (part.priority, part.tokens) == (25, 1)


# --- embeddings


def test_refresh(spark):
    d = docs(spark, ("fresh", "", "", [], "f"), ("stale", "", "", [], "s"), ("new", "", "", [], "n"), ("missing", "", "", [], None), ("bad", "", "", [], "bad"))
    md5 = lambda s: spark.range(1).select(F.md5(F.lit(s)).alias("x")).first().x
    old = spark.createDataFrame([("c", 0, "fresh", [1.0], "x", "t"), ("c", 5, "fresh", [2.0], md5("f"), "t"), ("c", 1, "stale", [1.0], "x", "t"), ("c", 2, "gone", [1.0], "x", "t"), ("c", 3, "bad", [9.0], "x", "t"), ("c", 4, "missing", [8.0], "x", "t")], schemas.EMBEDDING_CACHE)
    seen = spark.sparkContext.accumulator(0)

    def embedder(s):
        seen.add(1)
        return None if s == "bad" else [float(len(s)), 0.5]

    new, counts = embeddings.refresh(d, old, embedder, "now")
    assert {r.path: (r.embedding, r.updated_at) for r in new.collect()} == {"fresh": ([2.0], "t"), "stale": ([1.0, 0.5], "now"), "new": ([1.0, 0.5], "now"), "bad": ([9.0], "t"), "missing": ([8.0], "t")}
    assert seen.value == 3
    c = counts.first()
    assert (c.updated, c.skipped, c.failed) == (2, 1, 2)
    assert embeddings.purge(old, d).where("path = 'gone'").count() == 0


# --- corpora


@pytest.mark.parametrize("path, want", [("vision/north-star.md", True), ("../../../etc/passwd", False), ("../genome-evil/foo.md", False), ("a/../b.md", True), ("a/../..", False), ("..", False), ("", False), ("../x/../y", False), ("a/../../a/b", False)])
def test_path_guard(spark, path, want):
    assert one(spark, corpus.stays_inside(F.col("p")), p=path) is want


def test_guard_fails(spark):
    with pytest.raises(Exception, match="escapes"):
        corpus.guarded(docs(spark, ("../x", "", "", [], ""))).collect()


@pytest.mark.parametrize("path, title, category", [("vision/north-star.md", "North Star", "vision"), ("readme.md", "Readme", "readme"), ("milestones/completed/001-gen1.md", "001 Gen1", "milestones"), ("a/XML-http.md", "XML Http", "a")])
def test_title(spark, path, title, category):
    assert one(spark, T.title_of(F.col("p")), p=path) == title
    assert one(spark, T.category_of(F.col("p")), p=path) == category


@pytest.mark.parametrize("path, want", [("/home/user/projects/foo/bar/baz.ts", "bar/baz.ts"), ("/home/user\\project/src/index.ts", "src/index.ts"), ("bar.ts", "bar.ts"), ("a/b", "a/b")])
def test_short_path(spark, path, want):
    assert one(spark, T.short_path(F.col("p")), p=path) == want


@pytest.mark.parametrize("x, want", [(2.5, 3), (-0.5, 0), (-1.5, -1), (0.49999999999999994, 0), (4503599627370497.0, 4503599627370497), (None, None)])
def test_halves_are_rounded_up(spark, x, want):
    row = spark.createDataFrame([(x,)], "x double").select(T.half_up(F.col("x")).alias("y")).first()
    assert row.y == want


def test_many_corpora_begin_at_once(spark):
    rows = [("a", "see", "go", ["x", None], []), ("b", None, None, None, None), (None, "v", "m", [], ["y"])]
    got = {(r.corpus_id, r.path): r for r in corpus.bootstrap_all(spark.createDataFrame(rows, corpus.CORPORA), "t").collect()}
    assert len(got) == 36 and got["a", "vision/principles.md"].content == "# Design Principles\n\n- x\n"
    assert got["b", "vision/north-star.md"].content == "# North Star\n\n\n" and got["b", "milestones/current.md"].summary == ""
    assert "documented here" in got["b", "vision/anti-patterns.md"].content and got[None, "vision/anti-patterns.md"].content.endswith("\n\n- y\n")
    assert corpus.bootstrap_all(spark.createDataFrame([], corpus.CORPORA), "t").count() == 0
    with pytest.raises(ValueError, match="corpus a exists"):
        corpus.bootstrap_all(spark.createDataFrame(rows[:1], corpus.CORPORA), "t", spark.createDataFrame([("a",)], "corpus_id string"))


def test_bootstrap_and_upsert(spark):
    o = corpus.InitOptions("p", "be good", "first", ["one", "two"])
    s = corpus.bootstrap(spark, "c", o, "t0")
    assert s.count() == 12 and s.where("path = 'vision/principles.md'").first().content == "# Design Principles\n\n- one\n- two\n"
    with pytest.raises(ValueError):
        corpus.bootstrap(spark, "c", o, "t0", s)
    w = spark.createDataFrame([("c", "new/b.md", "B", "", ["x"], "12345", 1), ("c", "milestones/current.md", "C", "", [], "old", 1), ("c", "milestones/current.md", "D", "", [], "newer", 2)], "corpus_id string, path string, title string, summary string, tags array<string>, content string, seq long")
    u = {r.path: r for r in corpus.upsert(s, w, "t1").collect()}
    assert len(u) == 13 and u["new/b.md"].ord == 12 and u["new/b.md"].tokens == 2
    assert (u["milestones/current.md"].ord, u["milestones/current.md"].content, u["milestones/current.md"].updated_at) == (4, "newer", "t1")
    m = corpus.empty_manifest(spark, "p", "t").first()
    assert m.generation.number == 1 and m.sections == []


def test_migrate(spark):
    text = "# Title\r\n\r\nThis is a description.\r\n## Architecture\r\nold\r\n## Scripts\r\nrun\r\n### deeper\r\nmore\r\n## architecture\r\nnew\r\n"
    got = corpus.migrate(spark.createDataFrame([("c", text), ("d", "# only")], "corpus_id string, text string"))
    r = {x.corpus_id: tuple(x)[1:] for x in got.collect()}
    assert r == {"c": ("This is a description.", "new", "run\n### deeper\nmore"), "d": (None, None, None)}


def test_find_root(spark):
    starts = spark.createDataFrame([("/a/b/c",), ("/x",), ("/a/b/long" + "/x" * 20,)], "start string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r.start[:8]: r.root for r in corpus.find_root(starts, roots).collect()} == {"/a/b/c": "/a/b", "/x": None, "/a/b/lon": None}


# --- proposals


def simulate_fold(own, items):
    text = own
    for op, c in items:
        text = f"{text}\n\n{c}" if op == "append" and text else c
    return text


def test_fold_equals_its_sequential_definition(spark):
    rng = random.Random(2)
    rows, own, want = [], [], {}
    for s in range(150):
        name = f"knowledge/s-{s}.md"
        start = rng.choice([None, "", "base"])
        if start is not None:
            own.append(("c", name, start))
        items = [(rng.choice(["append", "append", "update", "create"]), rng.choice(["", "x", "y"])) for _ in range(rng.randrange(1, 6))]
        rows += [("c", len(rows) + i, f"p{i}", "ag", name, op, c, f"reason {i} considers everything", "t", 1) for i, (op, c) in enumerate(items)]
        want[name] = (simulate_fold(start, items), len(items), f"reason {len(items) - 1} considers everything")
    p = spark.createDataFrame(rows, schemas.PROPOSALS)
    sections = spark.createDataFrame(own, "corpus_id string, path string, content string")
    got = {r.section: (r.content, r.applied, r.summary) for r in proposals.fold(p, sections).collect()}
    assert got == want
    r = proposals.fold(p, sections).where("section = 'knowledge/s-3.md'").first()
    assert r.title == "S 3" and r.tags == ["knowledge", "reason", "considers", "everything"]


def test_consolidate_with_summarizer(spark):
    rows = [("c", 1, "a", "g", "k/a.md", "append", "A1", "first", "t", 1), ("c", 2, "b", "g", "k/a.md", "append", "A2", "second", "t", 1), ("c", 3, "d", "g", "k/b.md", "append", "B1", "only", "t", 1), ("c", 4, "e", "g", "k/e.md", "update", "empty", "x", "t", 1), ("c", 5, "f", "g", "k/e.md", "append", "E2", "y", "t", 1)]
    own = spark.createDataFrame([("c", "k/b.md", "old")], "corpus_id string, path string, content string")
    merge = lambda system, prompt: " " if "empty" in prompt else " merged "
    folded, trail, counts = proposals.consolidate(spark.createDataFrame(rows, schemas.PROPOSALS), own, "now", merge)
    assert {r.section: (r.content, r.applied, r.summary) for r in folded.collect()} == {"k/a.md": ("merged", 1, "first"), "k/b.md": ("old\n\nB1", 1, "only"), "k/e.md": ("empty\n\nE2", 2, "y")}
    assert trail.count() == 4 and trail.where("section = 'k/a.md'").first().diff == "[append] merged"
    c = counts.first()
    assert (c.applied, c.skipped) == (4, 1)


def test_last(spark):
    d = spark.createDataFrame([("c", i) for i in range(5)], "corpus_id string, seq long")
    assert sorted(r.seq for r in proposals.last(d, 2).collect()) == [3, 4] and proposals.last(d, 0).count() == 5


# --- strategies


def uses(spark, *rows):
    return spark.createDataFrame([("c", i, str(i), n, "", a, 1, g, (ok, 1, 1 + d, 1, 10.0, None), "t") for i, (n, a, g, ok, d) in enumerate(rows)], schemas.STRATEGIES)


def test_strategies(spark):
    s = uses(spark, ("b", "x", "debug", True, 1), ("a", "x", "debug", True, 2), ("b", "x", "debug", False, 0), ("a", "y", "debug", False, 0), ("once", "x", "plan", True, 9))
    board = [(r.category, r["rank"], r.name, r.uses, r.success_rate) for r in strategies.leaderboard(s).orderBy("rank").collect()]
    assert board == [("debug", 1, "b", 2, 0.5), ("debug", 2, "a", 2, 0.5)]
    assert [r.name for r in strategies.suggest(s).collect()] == ["b"]
    p = strategies.profiles(s).where("agent_id = 'x'").first()
    assert (p.total, p.successes, p.category_counts) == (4, 3, {"debug": 3, "plan": 1})
    assert [r.name for r in strategies.top_strategies(s).where("agent_id = 'x'").orderBy("rank").collect()] == ["b", "a", "once"]
    text = strategies.report(strategies.leaderboard(s)).first().report.split("\n")
    assert text[:2] == ["Strategy Leaderboard", "═" * 60] and text[3] == "  DEBUG" and text[6] == "  " + "b".ljust(28) + " 50%      2      +0.5"
    assert strategies.select(s, category="plan", agent_id="x").count() == 1


# --- fitness


@pytest.mark.parametrize("output, code, want", [("3 pass\n1 fail", 1, 0.75), ("nothing", 0, 1.0), ("nothing", 1, 0.5), (None, 0, 0.5), ("2 PASS 0 fail", 1, 1.0)])
def test_pass_rate(spark, output, code, want):
    d = spark.createDataFrame([(output, code)], "o string, c int")
    assert d.select(fitness.test_pass_rate(F.col("o"), F.col("c")).alias("x")).first().x == want


@pytest.mark.parametrize("text, want", [("- [x] a\n- [X] b\n- [ ] c\n- [ ] d", 0.5), ("all done", 0.7), ("abandoned", 0.3), ("", 0.0), (None, 0.0), ("élan done", 0.7), ("édone", 0.7)])
def test_milestone(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(fitness.milestone_progress(F.col("t")).alias("x")).first().x == want


def test_fitness(spark):
    files = spark.createDataFrame([("c", "\n".join(["x"] * 199) + "\n// TODO fixme"), ("d", "\n".join(["TODO"] * 3))], "corpus_id string, text string")
    got = {r.corpus_id: r.code_quality for r in fitness.code_quality(files).collect()}
    assert got["d"] == 0.0 and abs(got["c"] - 0.0) < 1e-9
    d = spark.createDataFrame([("- a\n* b\n## h\n# t\n", "### x\n-no")], "a string, g string")
    assert d.select(fitness.strategy_success_rate(F.col("a"), F.col("g")).alias("x")).first().x == 0.75
    h = spark.createDataFrame([("c", 0, 1, {"a": 0.1}), ("c", 1, 1, {"a": 0.9})], schemas.FITNESS_HISTORY)
    assert fitness.first_scores(h).first().scores == {"a": 0.1} and fitness.latest_fitness(h).first().scores == {"a": 0.9}
    b, a = (spark.createDataFrame([("c", s)], "corpus_id string, scores map<string,double>") for s in ({"a": 0.5, "b": 1.0}, {"a": 0.75, "z": 1.0}))
    assert {r.metric: r.delta for r in fitness.compare(b, a).collect()} == {"a": 0.25, "b": -1.0}


def test_measure_and_reports(spark):
    c = spark.createDataFrame([("c", 2, "1 pass\n1 fail", 1)], "corpus_id string, generation long, test_output string, exit_code int")
    s = docs(spark, ("milestones/current.md", "", "", [], "[x] [ ]"), ("strategies/active.md", "", "", [], "- a"), ("strategies/graveyard.md", "", "", [], "- b"))
    m = spark.createDataFrame([("c", 2)] * 4, "corpus_id string, generation long")
    got = fitness.measure(c, s, spark.createDataFrame([], "corpus_id string, text string"), m)
    assert got.first().scores == {"testPassRate": 0.5, "codeQuality": 0.5, "milestoneProgress": 0.5, "costEfficiency": 0.4, "strategySuccessRate": 0.5}
    lines = fitness.report(got).first().report.split("\n")
    assert lines[1] == "  " + "Test Pass Rate".ljust(25) + " " + "█" * 10 + "░" * 10 + " 50%" and len(lines) == 6
    g = got.select("generation", F.lit("m").alias("milestone"), "scores", F.lit(3).alias("mutations"), F.array(F.lit("p")).alias("promoted"), *[F.array().cast("array<string>").alias(x) for x in ("retired", "experiments")])
    lines = fitness.generation_report(g).first().report.split("\n")
    assert lines[0] == "Generation 2: m" and lines[-2:] == ["Mutations: 3", "Promoted: p"]


def test_generations(spark):
    m = corpus.empty_manifest(spark, "p", "t0").withColumn("corpus_id", F.lit("c"))
    s = docs(spark, ("milestones/current.md", "", "", [], "# one"))
    new, write = fitness.start_generation(m, s, "two", "t1")
    assert new.first().generation.number == 2 and write.first().content.startswith("# two\n")
    assert fitness.start_generation(m, s, "one", "t1")[1].count() == 0
    ended, archived, entries = fitness.end_generation(new, s, spark.createDataFrame([("c", 2)], "corpus_id string, generation long"), spark.createDataFrame([], schemas.FITNESS_HISTORY), "t2")
    assert ended.first().generation.endedAt == "t2" and archived.first().path == "milestones/completed/002-gen2.md"
    e = entries.first()
    assert (e.generation, e.milestone, e.mutation_count, e.ended_at, e.fitness_scores) == (2, "two", 1, "t2", {})
    assert one(spark, fitness.archive_path(F.lit(1000))) == "milestones/completed/1000-gen1000.md"
    answer = '```json\n{"promoted":["a"],"retired":3}\n```'
    assert one(spark, fitness.parse_evolution(F.col("s")), s=answer) == Row(promoted=["a"], retired=[], experiments=[])


# --- session log


def log(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schemas.SESSION_LOG)


def entry(ts="2026-01-02T03:04:05.678Z", agent="claude", event="edit", cwd=None, tool=None, path=None, summary=None):
    return (ts, agent, event, cwd, None, tool, path, summary, None)


def test_log_reads(spark):
    d = log(spark, entry(ts="2020-01-01"), entry(agent="goose"), entry(ts=None), entry(ts="2027"))
    assert [r.seq for r in resume.read(d).collect()] == [3, 2, 1, 0]
    assert [r.seq for r in resume.read(d, 1, "claude", "2024").collect()] == [3]
    assert [r.seq for r in resume.read(d, since="2024").collect()] == [3, 2, 1]


def test_resume(spark):
    none = spark.createDataFrame([], schemas.SESSION_LOG)
    assert resume.activity(none).first()[0] == resume.NO_ACTIVITY and resume.summary(none, "/p").first()[0] == resume.NO_SESSION
    d = log(spark, entry(cwd="/p", tool="Edit", path="/a/b/c.ts", summary="old"), entry(cwd="/q", agent="z"), entry(cwd="/p2", path="x.ts", summary="new"))
    assert resume.activity(d).first()[0].split("\n") == ["03:04:05 claude edit x.ts - new", "03:04:05 z edit", "03:04:05 claude edit Edit b/c.ts - old"]
    assert resume.summary(d, "/p").first()[0] == "new. Agent(s): claude; touched x.ts, b/c.ts; used Edit."
    assert resume.summary(d, "/none").first()[0].startswith("new. Agent(s): claude, z;")
    prompt = spark.createDataFrame([], "prompt string")
    assert resume.resume_context(d, prompt, "/q").first().last_session_summary == "Session activity recorded. Agent(s): z."


# --- prompt cache and registry


def test_breakpoints(spark):
    schema = "conv_id long, turn long, role string, text string, blocks array<struct<type:string,text:string,cache_control:string>>, cache boolean"
    d = spark.createDataFrame([(1, 0, "user", "static", None, True), (1, 1, "user", None, [("text", "a", None), ("text", "b", None)], True), (1, 2, "user", "dynamic", None, None), (2, 0, "user", "x", None, None), (3, 0, "user", "only", None, True)], schema)
    got = {(r.conv_id, r.turn): r for r in promptcache.breakpoints(d).collect()}
    assert got[1, 0].cache and got[1, 0].text == "static"
    assert [b.cache_control for b in got[1, 1].blocks] == [None, "ephemeral"] and got[1, 1].cache is None
    assert got[2, 0].text == "x" and got[3, 0].text is None and got[3, 0].blocks[0] == Row(type="text", text="only", cache_control="ephemeral")
    tools = "struct<name:string,description:string,cache_control:string>"
    r = spark.createDataFrame([("sys", None, [("a", "", None), ("b", "", None)]), (None, [("text", "x", None)], []), (None, None, None)], f"system_text string, system_blocks array<struct<type:string,text:string,cache_control:string>>, tools array<{tools}>")
    out = promptcache.request_breakpoints(r).collect()
    assert out[0].system_blocks[0].cache_control == "ephemeral" and [t.cache_control for t in out[0].tools] == [None, "ephemeral"]
    assert out[1].system_blocks[0].cache_control == "ephemeral" and out[1].tools == [] and out[2].system_blocks is None and out[2].tools is None


def test_registry(spark, tmp_path):
    assert registry.server_config(spark, "/r", "p").count() == 10
    got = registry.server_config(spark, "/r", "p", ["sql", "bash"], "node").orderBy("ord").collect()
    assert [(r.name, r.command, r.args) for r in got] == [("p-sql", "node", ["run", "/r/servers/sql-server.ts"]), ("p-bash", "node", ["run", "/r/servers/bash-server.ts"])]
    assert registry.config_record(registry.server_config(spark, "/r", "p", ["sql"])).first().servers["p-sql"].type == "stdio"
    for v in ("1.2.0", "1.10.0", "junk", "2.0.0"):
        (tmp_path / "cache" / v / "servers").mkdir(parents=True)
        if v != "2.0.0":
            (tmp_path / "cache" / v / "servers" / "efficiency-server.ts").touch()
    assert registry.resolve_root(cache=str(tmp_path / "cache"))[0].endswith("1.10.0")
    with pytest.raises(registry.PluginNotFound) as e:
        registry.resolve_root(explicit="/nope", cache="/none")
    assert e.value.checked == ["/nope", "/none/<latest>"]


def test_strings(spark):
    assert one(spark, T.trim(F.col("s")), s=" \t x y﻿\n") == "x y"
    assert one(spark, T.length16(F.col("s")), s="😀a") == 3
    check_fixed(spark)
    assert one(spark, T.pad_end(F.col("s"), 2), s="abc") == "abc"
    assert one(spark, T.last(F.array(F.lit(1), F.lit(2)), 5)) == [1, 2]
    assert one(spark, T.count_words(F.col("s"), "TODO"), s="éTODO todo TODOs") == 2
    assert T.minified('{"a":1,"a":2}') == '{"a":2}' and T.minified("{'a':1}") is None and T.minified("NaN") is None and T.minified('{"a":1} x') is None


def test_evaluate_generation(spark):
    from quern.operators import generations

    corpora = spark.createDataFrame([("c", 1, "1 pass", 0)], "corpus_id string, generation long, test_output string, exit_code int")
    s = docs(spark, ("strategies/active.md", "A", "", [], "- one\n"), ("milestones/current.md", "M", "", [], "[ ]"))
    queue = spark.createDataFrame([("c", 1, "p", "a", "milestones/current.md", "append", "[x]", "did it", "t", 1)], schemas.PROPOSALS)
    none = spark.createDataFrame([], schemas.FITNESS_HISTORY)
    answer = lambda system, prompt: '{"promoted": ["two"], "retired": ["gone"]}'
    got = generations.evaluate(corpora, s, queue, spark.createDataFrame([], "corpus_id string, text string"), spark.createDataFrame([], "corpus_id string, generation long"), none, "now", answer)
    assert got.scores.first().scores["milestoneProgress"] == 0.5 and got.scores.first().scores["costEfficiency"] == 0.1
    assert got.sections.where("path = 'strategies/active.md'").first().content == "- one\n- two\n"
    assert got.history.first().ord == 0 and got.mutations.count() == 1 and got.evolution.first().retired == ["gone"]
    assert generations.stamp(queue, "prop", "now").first().id.startswith("prop-")
    parts = spark.createDataFrame([(1, "g", "second", 25), (1, "core", "first", 0)], "query_id long, name string, content string, priority int")
    assert generations.assemble(parts).first().prompt == "first\n\nsecond"


def test_evolution_asks_the_model_once_for_the_sections(spark, tmp_path):
    """Sections of a corpus without an answer stay; missing ones are not made; one call for each corpus."""
    from quern.operators import generations

    rows = [(c, i, p, "T", "S", ["g"], 9, "t0", f"{c} \n\n") for c in ("a", "b", "c") for i, p in enumerate(("strategies/active.md", "strategies/graveyard.md", "x.md"))]
    s = spark.createDataFrame(rows, "corpus_id string, ord long, path string, title string, summary string, tags array<string>, tokens long, updated_at string, content string")
    scores = spark.createDataFrame([("a", {"k": 1.0}), ("b", {"k": 2.0}), ("d", {"k": 1.0})], "corpus_id string, scores map<string,double>")
    calls = tmp_path / "calls"
    answers = {1.0: '{"promoted": ["p", "q"], "experiments": ["e"]}', 2.0: '{"promoted": [], "retired": ["r"]}'}

    def model(system, prompt):
        with open(calls, "a") as f:
            f.write("x")
        return answers[__import__("json").loads(prompt)["k"]]

    _, new = generations.evolve(s, scores, model, "now")
    got = {(r.corpus_id, r.path): (r.ord, r.content, r.tokens, r.updated_at, r.title) for r in new.collect()}
    want = {(c, p): (i, text, 9, "t0", "T") for c, i, p, *_, text in rows}
    want |= {("a", "strategies/active.md"): (0, "a\n- p\n- q\n", 3, "now", "T"), ("b", "strategies/graveyard.md"): (1, "b\n- r\n", 2, "now", "T")}
    assert got == want and new.schema == s.schema and len(calls.read_text()) == 3


def test_compacted_windows_are_dealt_out_by_the_sessions_partitions(spark):
    """Not put together by their compressed size, as their texts are sorted in one stage."""
    text = F.repeat(F.lit("a"), F.lit(3000))
    m = spark.range(4000).select((F.col("id") % 500).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), text.alias("text"), F.lit(None).cast(f"array<{schemas.BLOCK}>").alias("blocks"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = compaction.compact_window(m, None, compaction.WindowConfig(max_tokens=10**6)).withColumn("task", F.spark_partition_id())
    assert got.select("task").distinct().count() == n and got.count() == 4000


def test_stream_window_prompts(spark, tmp_path):
    """Rows that set the prompt are no messages; retrieved text stands before the system prompt and counts."""
    from quern.operators.compaction import WindowConfig
    from quern.streaming import context_window as w

    rows = [(1, 0, w.SYSTEM, "be kind", False), (1, 1, "user", "x" * 40, False), (1, 2, w.CORPUS, "facts", False), (1, 3, "user", "y" * 40, False), (2, 0, "system", "a message", False)]
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    w.use_state_store(spark)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool boolean").write.parquet(path)
    stream = w.context_windows(spark.readStream.schema("conv_id long, turn long, role string, text string, tool boolean").parquet(path), WindowConfig(max_tokens=1000))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).start()
    q.awaitTermination()
    got = {r.conv_id: (r.message_count, r.used_tokens, r.system) for r in spark.read.parquet(out).collect()}
    system = "facts\n\n---\n\nbe kind"
    assert got == {1: (2, 20 + -(-len(system) // 4), system), 2: (1, 3, "")}


def test_upsert_numbers_new_paths_in_order(spark):
    from quern.operators import corpus

    s = spark.createDataFrame([("a", 4, "old"), ("b", 0, "x")], "corpus_id string, ord long, path string")
    s = s.selectExpr("corpus_id", "ord", "path", "'t' title", "'s' summary", "array('g') tags", "1L tokens", "'t0' updated_at", "'c' content")
    paths = [f"p{i:03d}" for i in range(40)]
    w = spark.createDataFrame([(c, p) for c in "abc" for p in [*paths, "old"]], "corpus_id string, path string").repartition(5)
    got = corpus.upsert(s, w.selectExpr("corpus_id", "path", "'n' title", "'s' summary", "array('g') tags", "'new' content"), "now").collect()
    by = {(r.corpus_id, r.path): r.ord for r in got}
    order = sorted([*paths, "old"])
    want = {("a", "old"): 4, ("b", "x"): 0} | {("a", p): 5 + i for i, p in enumerate(paths)} | {("b", p): 1 + order.index(p) for p in order} | {("c", p): order.index(p) for p in order}
    assert by == want


def test_similar_is_the_cosine_of_each_pair(spark, monkeypatch):
    """Several corpora, lengths and blocks; odd vectors have similarity 0."""
    import random

    from quern.operators import retrieval

    rng = random.Random(4)
    vec = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0]]
    cache = [(c, f"p{i}", i, v) for c in "ab" for i, v in enumerate([vec(3 if i % 3 else 4) for i in range(30)] + odd)]
    asked = [(100 * k + i, c, v) for k, c in enumerate("abz") for i, v in enumerate([vec(3 + i % 2) for i in range(8)] + odd)]
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 100)
    monkeypatch.setattr(retrieval, "PRODUCTS", 7)

    def cos(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm > 0 else 0.0

    got = retrieval.similar(spark.createDataFrame(cache, "corpus_id string, path string, ord long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, corpus_id string, vector array<double>"))
    want = {(q, c, p, o): cos(v, e) for q, c, v in asked for c2, p, o, e in cache if c == c2 and cos(v, e) > 0.3}
    rows = {(r.query_id, r.corpus_id, r.path, r.ord): r.score for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-8 for k in want) and want
    with pytest.raises(ValueError):
        retrieval.similar(got, got, -0.1)


def test_nearest_leaves_few_rows_for_each_query_and_task(spark, monkeypatch):
    """At most `most` non-empty rows of a query leave a task, empty ones before the last of them too, and the ranking is that of all pairs."""
    rng = np.random.default_rng(4)
    rows = [("c" if i % 3 else "d", f"p{i}", i, rng.standard_normal(4).tolist() if i % 10 else [1.0, 1.0, 1.0, 1.0], int(i % 4 != 0)) for i in range(900)]
    cache = spark.createDataFrame(rows, "corpus_id string, path string, ord long, embedding array<double>, full long").repartition(3)
    asked = spark.createDataFrame([(k, "c" if k < 5 else "d", rng.standard_normal(4).tolist(), k) for k in range(8)], "query_id long, corpus_id string, vector array<double>, most long")
    want = retrieval.similar(cache, asked, 0.2).join(cache.select("path", F.col("full")), "path").collect()
    for rows_of_heaps, products in ((4 << 20, 4 << 20), (9, 64)):
        monkeypatch.setattr(retrieval, "HEAP_ROWS", rows_of_heaps)
        monkeypatch.setattr(retrieval, "PRODUCTS", products)
        got = retrieval.nearest(cache, asked, 0.2).withColumn("task", F.spark_partition_id()).collect()
        for k in range(8):
            by_task = {}
            for r in got:
                if r.query_id == k and r.full:
                    by_task[r.task] = by_task.get(r.task, 0) + 1
            assert all(n <= k for n in by_task.values())

            def upto(found, k=k):
                out, n = [], 0
                for r in sorted((r for r in found if r.query_id == k), key=lambda r: (-r.score, r.ord)):
                    if n == k:
                        break
                    n += r.full > 0
                    out.append((r.ord, round(r.score, 8)))
                return out

            assert upto(got) == upto(want)


def test_nearest_leaves_what_fills_a_budget_of_tokens(spark):
    """Sections of many tokens: a task's rows of a query end where the budget does, and packing is that of all pairs."""
    rng = np.random.default_rng(5)
    rows = [("c", f"p{i}", i, rng.standard_normal(4).tolist(), int(i * 37 % 90) + 10 if i % 9 else 0) for i in range(600)]
    cache = spark.createDataFrame(rows, "corpus_id string, path string, ord long, embedding array<double>, full long").repartition(3)
    asked = spark.createDataFrame([(k, "c", rng.standard_normal(4).tolist(), 100 * k) for k in range(5)], "query_id long, corpus_id string, vector array<double>, most long")
    got = retrieval.nearest(cache, asked, 0.2).withColumn("task", F.spark_partition_id())
    used = {}
    for r in got.orderBy(F.desc("score"), "ord").collect():
        before = used.setdefault((r.task, r.query_id), 0)
        assert before < 100 * r.query_id
        used[r.task, r.query_id] = before + r.full
    every = retrieval.similar(cache, asked, 0.2).join(cache.select("path", "full"), "path")
    packed = lambda df: sorted((r.query_id, r.path, r.tokens) for r in retrieval.pack(df.join(asked.select("query_id", "most"), "query_id"), F.col("most"), 400).collect())
    assert packed(got.drop("task")) == packed(every) and len(used) > 6


def check_fixed(spark):
    """The exact binary value rounded: halves, subnormals, whole numbers beyond 63 bits; no Python in the plan."""
    import struct
    from decimal import ROUND_HALF_UP, Context, Decimal

    rng = random.Random(1)
    values = [0.45, 1.005, 1.45, 0.5, 1.5, 2.5, 0.0, 5e-324, 2.2250738585072014e-308, 1 / 3, 2.0**53, 2.0**53 + 2, 2.0**63, 1e20, 123456789012345678901.0, 0.99999995, 1 - 2**-53, 4503599627370496.5, 1.0000000000000002]
    values += [rng.random() * 10 ** rng.randint(-8, 18) for _ in range(400)] + [rng.randint(0, 10**6) / 2 ** rng.randint(0, 30) for _ in range(400)] + [k / 1000 + 0.0005 for k in range(300)]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(52)))[0] for _ in range(10)]
    values += [-x for x in values if x]
    d = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (0, 1, 2, 4, T.MOST_DECIMALS):
        got = d.select(T.fixed(F.col("x"), k).alias("y"))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        for x, r in zip(values, got.collect(), strict=True):
            want = Decimal(abs(x)).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_UP, context=Context(prec=60))
            assert r.y == ("-" if x < 0 else "") + f"{want:f}"
    odd = spark.createDataFrame([(1e21,), (-1.5e25,), (float("nan"),), (float("inf"),), (None,)], "x double").select(T.fixed(F.col("x"), 1).alias("y"))
    assert [r.y for r in odd.collect()] == ["1e+21", "-1.5e+25", "NaN", "Infinity", None]
    with pytest.raises(ValueError):
        T.fixed(F.lit(1.0), 8)


def test_ordered_fold_of_a_hot_section(spark, monkeypatch):
    """A hundred thousand proposals of one section in several ranges and pieces, and small sections of all kinds: as one after the other."""
    rng, rows, n = random.Random(5), [], 0
    for section in ("hot", *[f"s{i}" for i in range(60)]):
        for _ in range(100_000 if section == "hot" else rng.randint(1, 9)):
            n += 1
            rows.append(("c", n, section, "update" if rng.random() < (2e-5 if section == "hot" else 0.2) else rng.choice(["append", "append", "create"] if section != "hot" else ["append"]), rng.choice(["", "", f"t{n}"]), f"why {n}"))
    p = spark.createDataFrame(rows, "corpus_id string, seq long, section string, operation string, content string, rationale string").repartition(6)
    own = {f"s{i}": "own" for i in range(0, 60, 2)} | {"hot": "start"}
    s = spark.createDataFrame([("c", k, v) for k, v in own.items()] + [("c", "s1", None), ("c", "other", "x")], "corpus_id string, path string, content string")
    want = {}
    for _, _, section, operation, content, why in rows:
        text, k, _ = want.get(section, (own.get(section, ""), 0, ""))
        want[section] = (f"{text}\n\n{content}" if operation == "append" and text else content, k + 1, why)
    for size in (proposals.PIECE_CHARS, 40):
        pieces = proposals.partial_folds(p, size, 8)
        assert pieces.where("section = 'hot'").groupBy(F.spark_partition_id()).count().count() > 3
        got = proposals.fold(p, s, size)
        assert {r.section: (r.content, r.applied, r.summary) for r in got.collect()} == want


def test_evolution_answers_without_python(spark):
    answers = {
        '```json\n{"promoted": ["a", 5, {"b": 1}], "retired": "no list"}\n``` and ```': ([], [], []), '```json\n{"promoted": ["a", 5, {"b": 1}],\n "retired": "no list", "retiredStrategies": ["r"]}\n```\n': (["a", "5", '{"b":1}'], ["r"], []),
        ' {"newExperiments": ["x```y"]} ': ([], [], ["x```y"]), '[{"promoted": ["a"]}]': ([], [], []), "sorry": ([], [], []), "```": ([], [], []), "": ([], [], []), None: ([], [], []), '{"promoted": ["a"]} and more': ([], [], []), "{'promoted': ['a']}": ([], [], []), '{"promoted": null, "promotedStrategies": []}': ([], [], []),
    }
    d = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i long, s string").select("i", fitness.parse_evolution(F.col("s")).alias("l"))
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    got = {r.i: (r.l.promoted, r.l.retired, r.l.experiments) for r in d.collect()}
    assert [got[i] for i in range(len(answers))] == list(answers.values())


def test_terms_split_at_all_white_space(spark):
    """Blanks that only JavaScript's classes take part terms like any other."""
    blanks = "\u00a0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\ufeff\v\t\n\r\f "
    d = spark.createDataFrame([(b.join(["one", "t-wo", "Three3"]) + f"{b}{b}ab{b}",) for b in blanks], "s string")
    assert all(r.t == ["one", "t-wo", "three3"] for r in d.select(T.terms(F.col("s")).alias("t")).collect())
    assert one(spark, T.terms(F.col("s")), s="\u00a0x\ufeffyz1\u00a0") == ["yz1"]


def test_a_tokenizer_that_failed_is_tried_again_after_a_reset(spark):
    calls = []

    def load():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("forced")
        return len

    own = tokens.Tokenizer(load, "forced once")
    assert own.counter() is None and own.counter() is None and len(calls) == 1
    tokens.Tokenizer.reset()
    assert own.counter()("four") == 4 and own.counter() is not None and len(calls) == 2
    tokens.Tokenizer.reset()
