"""Files, the session log and streams."""

import json
import threading
import time

from pyspark.sql import functions as F

from quern import schemas
from quern.operators import compaction, resume
from quern.sources import jsonl, sessionlog
from quern.streaming import context_window, deltas, tail


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes(b'{"a":1}\n{"a":2}\r\n\nnot json\n{"half":\n{\'a\':9}\n{"a":NaN}\n{"a":3,"z":4} x\n{"a":4,"z":{"q":1}}\n{"b":1}')
    got = jsonl.read_jsonl(spark, str(p), "a long")
    assert [r.a for r in got.collect()] == [1, 2, 4, None]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    folder = str(tmp_path / "out")
    for i in range(2):
        jsonl.append_jsonl(spark.createDataFrame([(i,)], "a long"), folder)
    assert sorted(r.a for r in jsonl.read_jsonl(spark, folder, "a long").collect()) == [0, 1]
    jsonl.truncate(spark, folder)
    assert jsonl.read_jsonl(spark, folder, "a long").count() == 0


def test_documents(spark, tmp_path):
    from quern.operators import corpus

    p = str(tmp_path / "manifest.json")
    assert jsonl.read_document(spark, p).count() == 0
    jsonl.write_document(corpus.empty_manifest(spark, "p", "t0"), p, "t1")
    m = jsonl.read_document(spark, p).first()
    assert (m.project, m.updatedAt, m.generation.number) == ("p", "t1", 1)
    assert not (tmp_path / "manifest.json.tmp").exists()
    (tmp_path / "bad.json").write_text("{")
    assert jsonl.read_document(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "project": "q", "sections": [{"path": "b", "tags": ["x"]}, {"path": "a"}]}))
    rows = jsonl.manifest_sections(jsonl.read_document(spark, str(tmp_path / "s.json")), "c").orderBy("ord").collect()
    assert [(r.ord, r.path) for r in rows] == [(0, "b"), (1, "a")]


def test_texts_and_sources(spark, tmp_path):
    for name, text in {"g/vision/a b.md": "one\ntwo", "g/x.txt": "no", "s/a.ts": "x", "s/.git/b.ts": "x", "s/node_modules/c.js": "x", "s/d/e.tsx": "y", "s/f.md": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in jsonl.read_sections(spark, str(tmp_path / "g")).collect()] == [("vision/a b.md", "one\ntwo")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in jsonl.read_sources(spark, str(tmp_path / "s")).collect()) == ["a.ts", "e.tsx"]
    (tmp_path / "e.json").write_text(json.dumps([{"sectionPath": "p", "embedding": [1.5], "contentHash": "h"}]))
    assert jsonl.read_embedding_cache(spark, str(tmp_path / "e.json"), "c").first().embedding == [1.5]
    (tmp_path / "e2.json").write_text("{}")
    assert jsonl.read_embedding_cache(spark, str(tmp_path / "e2.json"), "c").count() == 0


def test_logs_of_agents_are_written_in_ranges(spark, monkeypatch):
    """Many tasks write a log's ranges, and its file has them in order, with corrupt lines behind their entries."""
    from quern.plans import composites

    made = []
    concatenate = composites.ranges.concatenate
    monkeypatch.setattr(composites.ranges, "concatenate", lambda spark, files: (made.extend(files), concatenate(spark, files)))
    monkeypatch.setattr(composites.M, "session_log", lambda spark, sf: spark.range(6000).select(F.col("id").alias("seq"), F.concat(F.lit("agent"), F.col("id") % 2).alias("agent"), F.lit("x").alias("meta")).repartition(5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(composites.F, "to_json", lambda c: F.concat(F.lit("at "), F.col("seq")))
    try:
        logs = composites._agent_logs(spark, "", "ranges", torn=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) == 2 and all(1 < len(parts) <= 4 for _, parts in made)
    for k in (0, 1):
        with open(logs[f"agent{k}"].removeprefix("file:")) as f:
            want = [y for i in range(k, 6000, 2) for y in [f"at {i}", *(composites._TORN if i % 9 == 0 else [])]]
            assert f.read().split("\n") == [*want, ""]


def test_ranges_of_logs_follow_their_entries(spark, monkeypatch):
    """No task puts more entries in order because there are more, and none holds the lines between them as rows; the log is whole and in order."""
    from quern.plans import composites

    held = {}
    concatenate = composites.ranges.concatenate

    def seen(spark, files):
        for target, parts in files:
            held[target] = [sum(x.startswith("at ") for x in open(p.removeprefix("file:")).read().split("\n")) for p in parts]
        concatenate(spark, files)

    monkeypatch.setattr(composites.ranges, "concatenate", seen)
    monkeypatch.setattr(composites, "LOG_ROWS", 500, raising=False)
    monkeypatch.setattr(composites.F, "to_json", lambda c: F.concat(F.lit("at "), F.col("seq")))
    for rows in (3000, 12000):
        monkeypatch.setattr(composites.M, "session_log", lambda spark, sf, rows=rows: spark.range(rows).select(F.col("id").alias("seq"), F.concat(F.lit("agent"), F.col("id") % 2).alias("agent"), F.lit("x").alias("meta")).repartition(5))
        held.clear()
        logs = composites._agent_logs(spark, "", "follow", torn=True)
        assert len(held) == 2 and sum(map(sum, held.values())) == rows and max(map(max, held.values())) <= 1000
        for k in (0, 1):
            with open(logs[f"agent{k}"].removeprefix("file:")) as f:
                want = [y for i in range(k, rows, 2) for y in [f"at {i}", *(composites._TORN if i % 9 == 0 else [])]]
                assert f.read().split("\n") == [*want, ""]


def test_sections_are_listed_and_read_by_few_tasks(spark, tmp_path):
    """Empty and odd files below many folders; tasks do not grow with the files; hidden names are passed over."""
    want = {f"d{i % 3}/e{i % 2}/{i} é+%20.md": "" if i % 50 == 0 else f"text {i}\r\n" for i in range(400)} | {"top.md": "t"}
    jsonl.write_sections(spark.createDataFrame(list(want.items()), "path string, content string"), str(tmp_path / "s"))
    for name in ("_no/a.md", ".no/a.md", "d0/.a.md", "d0/_a.md", "d0/a.txt"):
        (tmp_path / "s" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "s" / name).write_text("no")
    for folder in (f"{tmp_path}/s", f"file://{tmp_path}/s/"):
        got = jsonl.read_sections(spark, folder)
        assert {r.path: r.content for r in got.collect()} == want and got.rdd.getNumPartitions() <= 4
    (tmp_path / "empty").mkdir()
    assert jsonl.read_sections(spark, str(tmp_path / "empty")).count() == 0
    assert {r.path for r in jsonl._read_sections_by_spark(spark, f"{tmp_path}/s").collect()} == {k for k, v in want.items() if v}


def test_session_log(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "log.jsonl")
    for s in ("first", "second"):
        sessionlog.append({"agent": "a", "event": "e", "summary": s}, p)
    with open(p, "a") as f:
        f.write('this-is-not-json\n{"half":\n3\n')
    sessionlog.append({"agent": "b", "event": "e", "summary": "third", "meta": {"k": 1}}, p)
    rows = resume.read(sessionlog.read_log(spark, p)).collect()
    assert [r.summary for r in rows] == ["third", "second", "first"] and rows[0].meta == '{"k":1}'
    assert len(rows[0].ts) == 24 and rows[0].ts.endswith("Z")
    monkeypatch.setenv(sessionlog.SWITCH, "0")
    sessionlog.append({"agent": "a", "event": "e"}, p)
    monkeypatch.delenv(sessionlog.SWITCH)
    assert sessionlog.read_log(spark, p).count() == 3
    assert sessionlog.read_slice(p, 0, 6) == '{"ts":'
    sessionlog.rotate(p)
    sessionlog.append({"agent": "a", "event": "post"}, p)
    assert sessionlog.read_log(spark, p).count() == 1 and sessionlog.read_log(spark, f"{p}.1").count() == 3
    sessionlog.append({"agent": "a", "event": "x"}, p, max_bytes=5)
    assert sessionlog.read_log(spark, p).count() == 1
    assert sessionlog.read_log(spark, str(tmp_path / "none")).count() == 0


def test_concurrent_appends(spark, tmp_path):
    p = str(tmp_path / "log.jsonl")
    threads = [threading.Thread(target=lambda i=i: [sessionlog.append({"agent": "a", "event": "e", "meta": {"i": 10 * i + j}}, p) for j in range(10)]) for i in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sessionlog.read_log(spark, p).select("meta").distinct().count() == 200


def test_tail(spark, tmp_path):
    p = str(tmp_path / "log.jsonl")
    sessionlog.append({"agent": "a", "event": "seed"}, p)
    q = tail.tail(spark, p, "a").writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        sessionlog.append({"agent": "a", "event": "live1"}, p)
        sessionlog.append({"agent": "z", "event": "other"}, p)
        with open(p, "a") as f:
            f.write('{"agent":"a","event":"li')
        q.processAllAvailable()
        with open(p, "a") as f:
            f.write('ve2"}\n')
        q.processAllAvailable()
        open(p, "w").close()
        q.processAllAvailable()
        sessionlog.append({"agent": "a", "event": "rotated"}, p)
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.event for r in spark.sql("select * from tailed").collect()] == ["live1", "live2", "rotated"]


def windows_of(spark, tmp_path, parts, config, summarizer=None, **options):
    """The last row of each conversation after each part was added and the query was started anew, and the checkpoint."""
    context_window.use_state_store(spark)
    source, cp, rows = str(tmp_path / "in"), str(tmp_path / "cp"), []
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = context_window.context_windows(spark.readStream.schema(part.schema).parquet(source), config, summarizer, **options)
        stream.writeStream.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(lambda df, i: rows.extend(df.collect())).start().awaitTermination()
    return {r.conv_id: r for r in rows}, cp


def test_collapse_is_the_same_in_batches_and_streams(spark):
    """The state's rule and the batch operator's, on random conversations of short answers and repeated results."""
    import random

    rng, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(rng.randint(0, 14)):
            role = rng.choice(["user", "assistant", "assistant"])
            tool = rng.random() < 0.4
            rows.append((conv, turn, role, rng.choice(["x" * 300 + "1", "x" * 300 + "2", "", "y"]) if tool else rng.choice([" \u00a0ok \ufeff", "fine then, go on", "123456789", "1234567890"]), tool))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool boolean")
    block = F.from_json(F.to_json(F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content"))), schemas.BLOCK)
    batch = compaction.collapse(d.select("conv_id", "turn", "role", F.when(~F.col("tool"), F.col("text")).alias("text"), F.when(F.col("tool"), F.array(block)).alias("blocks")))
    want = {}
    for r in batch.orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append(r.turn)
    for conv in range(60):
        own = [(t, context_window.Message(*m)) for c, t, *m in rows if c == conv]
        marked = [context_window.Message(m.role, m.text, m.tool) for _, m in own]
        kept = context_window.collapsed(marked)
        assert [next(t for (t, _), m in zip(own, marked, strict=True) if m is k) for k in kept] == want.get(conv, [])


def test_windows_follow_message_by_message(spark, tmp_path):
    """Windows that fill, in three runs of the query; the state's messages are those of a plain loop."""
    rows = [(conv, i, ("assistant", "user")[i % 2], ("ok" if i % 5 == 0 else f"{conv} {i} " + "w" * (3000 if i % 7 == 3 else 90)), i % 7 == 3) for conv in range(3) for i in range(23 + conv)]
    config = compaction.WindowConfig(max_tokens=900, recent_message_count=4)
    summarizer = lambda system, prompt: f"{len(prompt)} characters"
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool boolean")
    got, cp = windows_of(spark, tmp_path, [d.where(f"turn between {a} and {b}") for a, b in ((0, 6), (7, 13), (14, 40))], config, summarizer, system_chars=10)
    held = {}
    for r in context_window.window_messages(spark, cp).orderBy("conv_id", "place").collect():
        held.setdefault(r.conv_id, []).append(context_window.Message(r.role, r.text, r.tool))
    for conv in range(3):
        own, compactions = [], 0
        for c, _, *m in rows:
            if c == conv:
                own.append(context_window.Message(*m).snipped())
                if context_window.used(own, 10) / 900 >= 0.75:
                    own, compactions = context_window.compacted(own, summarizer, config, 10), compactions + 1
        r = got[conv]
        assert (r.message_count, r.used_tokens, r.compactions, r.closed) == (len(own), context_window.used(own, 10), compactions, False) and compactions > 1
        assert held[conv] == own


def test_idle_windows_are_let_go(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, "user", "a" * 40, False), (2, 0, "user", "b" * 8, False)], "conv_id long, turn long, role string, text string, tool boolean")
    context_window.use_state_store(spark)
    (tmp_path / "in").mkdir()
    rows = []
    stream = context_window.context_windows(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), idle_ms=3000)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").foreachBatch(lambda df, i: rows.extend(df.collect())).start()
    try:
        d.write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(150):
            time.sleep(0.2)
            if sum(r.closed for r in rows) == 2:
                break
        assert sorted((r.conv_id, r.message_count, r.used_tokens, r.closed) for r in rows) == [(1, 1, 10, False), (1, 1, 10, True), (2, 1, 2, False), (2, 1, 2, True)]
        d.where("conv_id = 1").write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(100):
            time.sleep(0.2)
            if len(rows) > 4:
                break
        assert rows[4].message_count == 1  # a new window
    finally:
        q.stop()
    assert not q.isActive


def test_deltas(spark):
    d = spark.createDataFrame([(1, 2, "text_delta", "b"), (1, 1, "text_delta", "a"), (1, 3, "stop", "z"), (2, 1, "stop", None)], "stream_id long, seq long, type string, text string")
    assert {r.stream_id: r.text for r in deltas.deltas(d).collect()} == {1: "ab", 2: ""}


def test_deltas_of_a_stream_wait_for_gaps_until_the_watermark(spark, tmp_path):
    context_window.use_state_store(spark)
    schema = "stream_id long, seq long, type string, text string, at long"
    one = [(1, 0, "text_delta", "a"), (1, 2, "text_delta", "c"), (1, 3, "usage", "no"), (1, 4, "text_delta", "e"), (2, 1, "text_delta", "y"), (2, 3, "text_delta", "z")]
    two = [(1, 1, "text_delta", "b"), (1, 2, "text_delta", "again"), (1, 0, "text_delta", "a")]
    three = [(3, 0, "text_delta", None)]
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    seen = []
    for at, batch in ((100_000, one), (100_010, two), (200_000, three)):
        d = spark.createDataFrame([(*r, at) for r in batch], schema).withColumn("ts", F.timestamp_seconds("at"))
        d.write.mode("append").parquet(source)
        deltas.ordered(spark.readStream.schema(d.schema).parquet(source), "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        seen.append({r.stream_id: (r.text, r.closed) for r in deltas.joined(spark.read.parquet(out)).collect()})
    assert seen[0] == {1: ("a", False)} and seen[1] == {1: ("abce", False)}
    assert seen[2] == {1: ("abce", True), 2: ("yz", True), 3: ("", False)}


def test_deltas_of_long_gaps_wait_in_buckets_and_close_by_the_last_event(spark, tmp_path, monkeypatch):
    """Far more events wait than are kept beside the place, some twice, and a stream's end moves with its events."""
    context_window.use_state_store(spark)
    schema = "stream_id long, seq long, type string, text string, at long"
    said = lambda s, seqs, mark="": [(s, i, "text_delta", f"{i}{mark} ") for i in seqs]
    batches = [
        (100_000, said(1, range(2, 400, 2)) + said(2, [0]) + said(3, [5, 9, 1000])), (100_040, said(1, [1, *range(3, 300, 2)]) + said(1, range(0, 50, 2), "twice") + said(2, [1])),
        (100_050, said(1, [*range(301, 400, 2), 4], "x") + said(3, range(1, 200, 3))), (100_105, said(4, [0])), (100_115, said(5, [0])), (100_300, said(6, [0])), (100_301, said(6, [1])),
    ]
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    seen = []
    for at, batch in batches:
        d = spark.createDataFrame([(*r, at) for r in batch], schema).withColumn("ts", F.timestamp_seconds("at"))
        d.write.mode("append").parquet(source)
        deltas.ordered(spark.readStream.schema(d.schema).parquet(source), "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        seen.append({r.stream_id: (r.text, r.closed) for r in deltas.joined(spark.read.parquet(out)).collect()})
    first = "0twice " + "".join(f"{i} " for i in range(1, 301))
    whole = first + "".join(f"{i}{'x' if i % 2 else ''} " for i in range(301, 399))
    assert 1 not in seen[0] and seen[1][1] == (first, False) and seen[2][1] == (whole + "399x ", False)
    assert not seen[3][2][1] and seen[-1] == {1: (whole + "399x ", True), 2: ("0 1 ", True), 3: ("".join(f"{i} " for i in sorted({*range(1, 200, 3), 5, 9, 1000})), True), 4: ("0 ", True), 5: ("0 ", True), 6: ("0 1 ", False)}


class _State:
    """A state variable in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.v, self.m = calls, None, {}

    def __getattr__(self, name):
        ops = {"get": lambda: self.v, "update": lambda v: setattr(self, "v", v), "put": lambda v: setattr(self, "v", v), "getValue": self.m.get, "containsKey": self.m.__contains__, "updateValue": self.m.__setitem__, "removeKey": self.m.pop}

        def call(*a):
            self.calls.append(name)
            return ops[name](*a)

        return call


def test_a_streams_waiting_events_take_few_state_calls():
    """One read and one write of a stream in each batch, and one timer: not calls for each event."""
    from datetime import datetime, timezone

    from pyspark.sql import Row

    calls, o = [], deltas.Ordered(0, 1000)
    o.place, o.early, o.handle = _State(calls), _State(calls), type("H", (), {"registerTimer": lambda self, x: calls.append("timer"), "deleteTimer": lambda self, x: calls.append("timer")})()
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = lambda seqs: iter([Row(seq=i, type="text_delta", text=f"{i} ", ts=at) for i in seqs])
    assert list(o.handleInputRows((1,), rows(range(1, 30, 2)), None)) == []
    (got,) = o.handleInputRows((1,), rows(range(0, 30, 2)), None)
    assert got.text == "".join(f"{i} " for i in range(30)) and calls == ["get", "timer", "update", "get", "update"]


def test_a_window_is_read_and_written_once_in_a_batch():
    """However often it is compacted; prompts are read only where there are any."""
    from pyspark.sql import Row

    calls, w = [], context_window.Windows(compaction.WindowConfig(max_tokens=100, recent_message_count=2), lambda system, prompt: "S", 0, None)
    w.numbers, w.messages, w.prompts = _State(calls), _State(calls), _State(calls)
    rows = lambda a, b: iter([Row(turn=i, role="user", text=f"{i}" + "x" * 120, tool=False) for i in range(a, b)])
    list(w.handleInputRows((1,), rows(0, 9), None))
    (got,) = w.handleInputRows((1,), rows(9, 20), None)
    assert got.compactions > 4 and calls == ["get", "put", "update", "get", "get", "put", "update"] and len(w.messages.v) == got.message_count


def test_windowed_counts_of_a_stream(spark, sf_dir, tmp_path):
    """Event-time windows with a watermark, an extension."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in")).withWatermark("ts", "1 day")
    q = s.groupBy(F.window("ts", "1 hour"), "event_type").count().writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(count) from counts").first()[0] == e.count()


def test_http_embedder():
    """A service on this machine: vectors, refusals, answers that are no JSON, and no service at all."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quern.sources.embedder import HttpEmbedder

    class Service(BaseHTTPRequestHandler):
        def _say(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):  # noqa: N802
            self._say(200 if self.path == "/api/tags" else 404, b"{}")

        def do_POST(self):  # noqa: N802
            import json

            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = asked["prompt"]
            answers = {"refuse": (500, b"{}"), "broken": (200, b"{"), "none": (200, b"{}"), "list": (200, b"[]")}
            self._say(*answers.get(prompt, (200, json.dumps({"embedding": [len(prompt), len(asked["model"])]}).encode())))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    own = HttpEmbedder(f"http://127.0.0.1:{server.server_port}", "m1")
    assert own.available() and own("four") == [4.0, 2.0]
    assert [own(x) for x in ("refuse", "broken", "none", "list")] == [None] * 4
    server.shutdown()
    server.server_close()
    assert not own.available() and own("four") is None


def test_embedder_reaches_workers(spark):
    from quern.operators.embeddings import embed
    from quern.sources.embedder import HttpEmbedder

    got = embed(spark.createDataFrame([("a",), (None,)], "t string"), HttpEmbedder("http://127.0.0.1:9", "m"), "t")
    assert [r.vector for r in got.collect()] == [None, None]


def test_project_tests_are_run(tmp_path):
    import sys

    from quern.sources.testrun import has_tests, run_tests

    say = (sys.executable, "-c", "import os, sys; print('3 pass'); print('1 fail', file=sys.stderr); sys.exit(os.environ['CI'] == 'true' and 4)")
    assert run_tests(tmp_path, say) == (None, 0)
    for text, there in (("{", False), ("[]", False), ('{"scripts": {}}', False), ('{"scripts": {"test": "x"}}', True)):
        (tmp_path / "package.json").write_text(text)
        assert has_tests(tmp_path) is there
    assert run_tests(tmp_path, say) == ("3 pass\n1 fail\n", 4)
    assert run_tests(tmp_path, ("no-such-program-here",)) == (None, 0)
    assert run_tests(tmp_path, (sys.executable, "-c", "import time; time.sleep(9)"), timeout=0.3) == (None, 0)


def test_embedding_cache_of_nothing_and_update_of_nothing(spark, tmp_path):
    import json

    import pytest

    from quern import schemas
    from quern.sources import jsonl

    path = f"file://{tmp_path}/c/embeddings.json"
    jsonl.write_embedding_cache(spark.createDataFrame([], schemas.EMBEDDING_CACHE), path)
    assert json.load(open(tmp_path / "c/embeddings.json")) == [] and jsonl.read_embedding_cache(spark, path, "c").count() == 0
    with pytest.raises(ValueError):
        jsonl.update_document(spark, f"file://{tmp_path}/none.json", lambda df: df, "now")


def test_lines_that_are_more_or_less_than_json(spark, tmp_path):
    """No Python in the plan; what follows a value, torn lines and other values than objects."""
    lines = ['{"a":1}', ' {"a":2} ', '{"a":3}\r', '{"a":4} x', '{"a":5}]', '{"a":6}{"a":7}', '{"a":8},{"a":9}', '{"a":10', "", "  ", "null", "5", '"a"', "[1]", "{'a':1}", "{a:1}", '{"a":NaN}', '{"a":1,"a":11}', '{"b":1}', '{"a":"x"}', "}", '{"a":12},"end of line":1']
    (tmp_path / "l.jsonl").write_text("\n".join(lines) + "\n")
    df = jsonl.read_jsonl(spark, f"file://{tmp_path}/l.jsonl", "a long")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r.a for r in df.collect()] == [1, 2, 3, None, None, None, None, 11, None, None]


def test_lines_of_ranges(tmp_path, monkeypatch):
    """Each line belongs to the range that it begins in, whatever the cuts and the blocks."""
    from quern.sources import ranges

    text = b"".join(b"x" * n + b"\n" for n in (3, 0, 40, 1, 0, 0, 17, 200, 5)) + b"torn"
    path = tmp_path / "l.txt"
    path.write_bytes(text)
    end = ranges.end_of_lines(str(path))
    assert end == len(text) - 4 and ranges.first_line(str(path)) == b"xxx" and ranges.end_of_lines(str(tmp_path / "none")) == 0
    want = [(i, x) for i, x in zip([0, *[i + 1 for i, b in enumerate(text) if b == 10]], text.split(b"\n")[:-1], strict=False)]
    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(ranges, "BLOCK", block)
        monkeypatch.setattr(ranges, "BACK", block)
        assert ranges.end_of_lines(f"file://{path}") == end
        for step in (1, 5, 64, 1000):
            got = [x for a, b in ranges.cuts(0, end, step) for at, lines in ranges.lines(str(path), a, b, end) for x in zip(at, lines, strict=True)]
            assert got == want
        assert list(ranges.lines_back(str(path))) == [(end, b"torn"), *[x for x in reversed(want) if x[1]]]
        assert list(ranges.lines_back(str(path), 0)) == []


def test_tail_plans_ranges_over_a_rotation(tmp_path):
    """A batch's parts cover what is new, once, in tasks of bounded bytes; also when they are planned again after the next rotation."""
    from quern.streaming.tail import SessionLogReader

    path = tmp_path / "log.jsonl"
    line = lambda g, i: '{"ts":"2024-01-0%dT00:00:00.000Z","event":"g%de%d"}\n' % (g, g, i)
    write = lambda g, n, torn="": path.write_text("".join(line(g, i) for i in range(n)) + torn)
    reader = SessionLogReader({"path": str(path), "fromstart": "true", "partbytes": "100"})
    read = lambda parts: [(s, json.loads(v)["event"]) for p in parts for b in reader.read(p) for s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    events = lambda g, a, b: [f"g{g}e{i}" for i in range(a, b)]
    zero = reader.initialOffset()
    write(1, 20, '{"event":"to')
    one = reader.latestOffset()
    first = read(reader.partitions(zero, one))
    assert [e for _, e in first] == events(1, 0, 20) and len(reader.partitions(zero, one)) > 5
    write(1, 30)
    path.rename(f"{path}.1")
    write(2, 7)
    two = reader.latestOffset()
    second = read(reader.partitions(one, two))
    assert [e for _, e in second] == events(1, 20, 30) + events(2, 0, 7)
    assert [s for s, _ in first + second] == sorted({s for s, _ in first + second})
    path.rename(f"{path}.1")
    write(3, 2)
    assert read(reader.partitions(one, two))[-7:] == second[-7:]  # read again, from the rotated file
    path.write_text("")
    assert reader.partitions(two, reader.latestOffset()) == []
    write(4, 3)
    assert [e for _, e in read(reader.partitions(two, reader.latestOffset()))][-3:] == events(4, 0, 3)
    assert SessionLogReader({"path": str(path)}).initialOffset()[str(path)]["at"] == path.stat().st_size


def test_recent_entries_are_read_from_the_end(spark, tmp_path, monkeypatch):
    from quern.sources import ranges

    path = str(tmp_path / "log.jsonl")
    with open(path, "w") as f:
        for i in range(20_000):
            f.write(json.dumps({"ts": f"2024-01-01T00:{i // 600:02d}:{i // 10 % 60:02d}.{i % 10}00Z", "agent": f"a{i % 3}", "event": f"e{i}"}) + ("\n{torn\n" if i % 50 == 0 else "\n"))
        f.write('{"event":"no time"}\n{"event":"half')
    bytes_read, whole = [], ranges.read
    monkeypatch.setattr(ranges, "read", lambda *a: bytes_read.append(len(x := whole(*a))) or x)
    reader = sessionlog.Recent({"path": path, "limit": "50", "agent": "a1"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[3] for r in rows] == [f"e{i}" for i in range(19999, 0, -1) if i % 3 == 1][:50]
    assert sum(bytes_read) <= 2 * ranges.BACK < ranges.size(path) / 5
    got = sessionlog.read_recent(spark, path, limit=4, since="2024-01-01T00:33:19.800Z").collect()
    assert [r.event for r in got] == ["no time", "e19999", "e19998"]
    every = sessionlog.read_recent(spark, path).collect()
    assert len(every) == 20_001 and every[0].event == "no time" and every[-1].event == "e0"
    assert resume.read(sessionlog.read_log(spark, path), 3, "a2").first().event == "e19997" == sessionlog.read_recent(spark, path, 3, "a2").first().event
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = sessionlog.read_recent(spark, path).where("agent = 'a2' and ts >= '2024-01-01T00:33:00.000Z' and event <> 'e19997'")
        assert pushed.count() == 65
        plan = pushed._jdf.queryExecution().executedPlan().toString()
        assert "= e19997" in plan and "= a2" not in plan and ">= 2024" not in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sessionlog.read_recent(spark, str(tmp_path / "none"), 5).count() == 0


def test_entries_are_parsed_without_python(spark, tmp_path):
    lines = ['{"ts":"t","agent":5,"meta":{"b":1,"a":[2]}}', '{"event":"x","event":"y"}', "[1]", "null", '"s"', "{torn", ""]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    df = sessionlog.read_log(spark, str(tmp_path / "l.jsonl"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.orderBy("seq").collect()
    assert [(r.ts, r.agent, r.event, r.meta) for r in rows] == [("t", "5", None, '{"b":1,"a":[2]}'), (None, None, "y", None)]
    assert [sessionlog.parse_line(x) for x in lines] == [tuple(r)[1:] for r in rows] + [None] * 5


def test_embedding_caches_are_arrays(spark, tmp_path):
    """Each file is a JSON array of its own, an empty task's too; entries keep their order and come back as they were."""
    rows = [("c", i, f"p{i}.md", [0.5, float(i)], None if i == 3 else f'h"{i}]', "t") for i in range(20)]
    d = spark.createDataFrame(rows, schemas.EMBEDDING_CACHE).repartitionByRange(3, "ord").where("ord < 12 or ord > 18")
    path = f"file://{tmp_path}/caches"
    jsonl.write_embedding_caches(d, path)
    held = [json.loads(p.read_text()) for p in (tmp_path / "caches").glob("part-*")]
    assert len(held) == 3 and sum(map(len, held)) == 13
    got = jsonl.read_embedding_caches(spark, path, "c")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in d.collect())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert jsonl.read_embedding_caches(spark, f"{path}-none", "c").count() == 0


def test_a_tail_is_cancelled_by_its_consumer(spark, tmp_path):
    """`stop` from within the query's own batches ends it; what comes later is left for the next start, once."""
    p, cp = str(tmp_path / "log.jsonl"), str(tmp_path / "cp")
    seen = []

    def start(stop):
        def consume(df, i):
            seen.extend(r.event for r in df.orderBy("seq").collect())
            if stop and "two" in seen:
                done.set()

        done = threading.Event()
        return tail.tail(spark, p, from_start=True).writeStream.foreachBatch(consume).option("checkpointLocation", cp).trigger(processingTime="100 milliseconds").start(), done

    for e in ("one", "two"):
        sessionlog.append({"agent": "a", "event": e}, p)
    q, done = start(True)
    assert done.wait(60)
    q.processAllAvailable()
    q.stop()
    assert not q.isActive and q.exception() is None
    sessionlog.append({"agent": "a", "event": "three"}, p)
    time.sleep(0.5)
    assert seen == ["one", "two"]
    q, _ = start(False)
    q.processAllAvailable()
    q.stop()
    assert seen == ["one", "two", "three"]
