"""Stored indexes and snapshots: versions, conflicts, failed writers, buckets that are read and written."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import corpus, retrieval
from quern.operators.index import Index
from quern.sources import jsonl, snapshots
from quern.sources.snapshots import Conflict, Snapshots

WORDS = [f"word{i}" for i in range(80)]


def sections_of(spark, n, seed=1):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    return spark.createDataFrame([(f"c{i % 3}", i, f"p{i}.md", text(3), text(6), [rng.choice(WORDS)], 5, "t", text(20)) for i in range(n)], schemas.SECTIONS)


def rows(df, *by):
    return sorted(map(str, df.select(*by).collect()))


def test_index_answers_as_the_sections_do(spark, tmp_path):
    s = sections_of(spark, 90)
    queries = spark.createDataFrame([(1, "c0", "word1 word2 word2", 400), (2, "c1", "word5", 60), (3, "c2", "of", 100), (4, "c9", "word1", 100), (5, "c2", "nothing-known", 100)], schemas.QUERIES)
    own = Index(spark, f"file://{tmp_path}/index", 8)
    assert own.build(s) == 1
    written = sections_of(spark, 120, 2).where("ord % 4 = 1").select("corpus_id", "path", "title", "summary", "tags", "content")
    for step in range(2):
        got = own.retrieve(queries)
        want = retrieval.retrieve(s, queries)
        assert rows(got, *sorted(want.columns)) == rows(want, *sorted(want.columns)) and got.count() > 5
        assert rows(own.score(queries), "query_id", "path", "score") == rows(retrieval.score(s, queries.where("query_id <> 3")), "query_id", "path", "score")
        if not step:
            s = spark.createDataFrame(corpus.upsert(s, written, "now").collect(), s.schema)
            assert own.upsert(written, "now") == 2
    assert rows(own.sections(), *s.columns) == rows(s, *s.columns)


def test_only_the_buckets_of_asked_terms_are_read(spark, tmp_path):
    own = Index(spark, f"file://{tmp_path}/index", 16)
    own.build(sections_of(spark, 60))
    asked = spark.createDataFrame([(1, "c0", "word7", 100)], schemas.QUERIES)
    tables = own.store.newest()[1]
    at = own._changed(retrieval.query_terms(asked), "corpus_id", "term")
    plan = own.score(asked)._jdf.queryExecution()
    files = [f for f in own.score(asked).inputFiles() if "/b=" in f]
    folders = {f"b={k}" for k in at}
    of_postings = {x.rsplit("/", 2)[-2] for x in tables["postings"].values()}
    read = {f.rsplit("/", 2)[-2] for f in files if any(x in f for x in of_postings)}
    assert len(at) == 1 and read == folders
    assert "In(term" in plan.executedPlan().toString() or "EqualTo(term" in plan.executedPlan().toString()


def test_unchanged_buckets_stay(spark, tmp_path):
    own = Index(spark, f"file://{tmp_path}/index", 16)
    own.build(sections_of(spark, 200))
    before = own.store.newest()[1]
    own.upsert(spark.createDataFrame([("c0", "p0.md", "word1", "word2", ["word3"], "x")], "corpus_id string, path string, title string, summary string, tags array<string>, content string"), "now")
    after = own.store.newest()[1]
    assert sum(before["sections"][k] != after["sections"].get(k) for k in before["sections"]) == 1
    assert sum(before["postings"][k] != after["postings"].get(k) for k in before["postings"]) < 16


def test_of_two_writers_one_is_refused(spark, tmp_path):
    d = spark.range(10).withColumn("v", F.lit("a"))
    store = Snapshots(spark, f"file://{tmp_path}/s")
    by = snapshots.bucket("id", buckets=2)
    first = store.commit(0, {"t": store.write(d, by)})
    version, tables = store.newest()
    assert version == first == 1
    one, two = (Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    assert one.commit(1, {"t": one.write(d.withColumn("v", F.lit("b")), by)}) == 2
    with pytest.raises(Conflict):
        two.commit(1, {"t": two.write(d.withColumn("v", F.lit("c")), by)})
    assert {r.v for r in store.read(store.newest()[1], "t", "id long, v string").collect()} == {"b"}
    assert {r.v for r in store.read(tables, "t", "id long, v string").collect()} == {"a"}  # who reads an older version goes on with it
    done = []

    def race():
        try:
            done.append(Snapshots(spark, f"file://{tmp_path}/s").commit(2, {}))
        except Conflict:
            done.append(None)

    threads = [threading.Thread(target=race) for _ in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(x or 0 for x in done) == [0] * 15 + [3]


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    d, by = spark.range(4), snapshots.bucket("id", buckets=2)
    store.commit(0, {"t": store.write(d, by)})
    store.write(spark.range(9), by)  # and no commit
    assert store.read(store.newest()[1], "t", "id long").count() == 4
    whole = snapshots.create_exclusively
    monkeypatch.setattr(snapshots, "create_exclusively", lambda spark, path, data: whole(spark, path, data[:20]))
    store.commit(1, {"t": store.write(spark.range(9), by)})  # ends in the middle of its file
    monkeypatch.undo()
    assert store.newest()[0] == 1 and store.read(store.newest()[1], "t", "id long").count() == 4
    assert store.commit(1, {"t": store.write(spark.range(5), by)}) == 3
    assert store.read(store.newest()[1], "t", "id long").count() == 5


def test_a_document_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/d/manifest.json"
    jsonl.write_document(corpus.empty_manifest(spark, "one", "t"), path)

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(jsonl, "replace", fail)
    with pytest.raises(OSError):
        jsonl.write_document(corpus.empty_manifest(spark, "two", "t"), path)
    assert jsonl.read_document(spark, path).first().project == "one"
    monkeypatch.undo()
    jsonl.write_document(corpus.empty_manifest(spark, "three", "t"), path)
    assert jsonl.read_document(spark, path).first().project == "three"
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["manifest.json"]
