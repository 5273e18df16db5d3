"""Exact top-k search, ranked lexical search and centroid clustering: brute force, several shards and blocks, odd rows."""

import hashlib
import math
import re

import numpy as np
import pytest

from quern.llm import balltree, centroids, lexical
from quern.llm.common import table

NAN, INF = float("nan"), float("inf")


def whole(v, by):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(by * float(np.float32(x))) for x in v]


def brute_top(rows, every, k):
    held = [(i, v) for i, v in ((i, whole(v, 256)) for i, v in rows) if i is not None and v is not None]
    asked = {}
    for i, v in held:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    return {q: sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q and len(w) == len(v))[:k] for q, v in asked.items()}


def found_top(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((-r.score, r.vec_id))
        assert r["rank"] == len(own)
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 90, "query_rows": 7, "leaf": 5}])
def test_top_k(spark, sf_dir, options):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert found_top(balltree.search(vectors, every=25, **options)) == brute_top(rows, 25, 5)


def test_top_k_odd_vectors(spark):
    odd = [(50, None), (100, [1.0, NAN]), (150, [INF, 1.0]), (200, [1.0, None]), (None, [9.0, 9.0]), (250, []), (251, []), (300, [1.0, 2.0, 3.0]), (301, [1.0, 1.0, 1.0]), (0, [0.0, 0.0])]
    same = [(i, [0.5, -0.25]) for i in range(400, 430)] + [(400, [0.5, -0.25]), (0, [1.0, -1e-20]), (0, [1.0, 1.0])]
    other = [(i, [float(i % 5) / 3, float(i % 7) / -2]) for i in range(1, 60)] + [(-50, [1.0, 0.5]), (7, [1000.0, 5000.0]), (8, [3e6, -2e6])]
    rows = odd + same + other
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, pivot string")
    for options in ({}, {"shard_rows": 7, "query_rows": 2, "leaf": 2}):
        got = found_top(balltree.search(d, **options))
        want = brute_top(rows, 50, 5)
        assert got == {q: near for q, near in want.items() if near}
    assert balltree.search(d.limit(0)).count() == 0
    huge = spark.createDataFrame([(50, [1e30]), (1, [1e-3]), (2, [2e-3])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?s)Overflow|too large|too big"):
        balltree.search(huge.union(spark.createDataFrame([(3, [1e30])], huge.schema))).collect()


def test_tree_reads_few_leaves_of_clustered_vectors():
    """Balls of clusters far apart are passed over; the k best are those of a full comparison."""
    rng = np.random.default_rng(1)
    vectors = np.concatenate([np.floor(256 * (rng.standard_normal(16) * 5 + rng.standard_normal((200, 16)) * 0.1)) for _ in range(40)])
    ids = rng.permutation(len(vectors)).astype(np.int64)
    tree = balltree.BallTree.unpacked(16, *balltree.BallTree.build(ids, vectors).packed())
    queries = vectors[:64]
    best = balltree.Best(len(queries), 5)
    read = tree.search(queries, ids[:64], best)
    leaves = int((tree.children < 0).sum())
    assert read < leaves * len(queries) / 3
    for i in range(len(queries)):
        want = sorted((-int(s), int(j)) for s, j in zip(vectors @ queries[i], ids, strict=True) if j != ids[i])[:5]
        assert [(-int(s), int(j)) for s, j in zip(best.score[best.q == i], best.ids[best.q == i], strict=True)] == want
    known = balltree.Best(len(queries), 5, best.floor)  # the k-th scores of other shards are shared
    assert tree.search(queries, ids[:64], known) <= read


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranked(docs, items, k):
    own = [(d, words(t)) for d, t in docs]
    own = [(d, w) for d, w in own if w]
    n, total = len(own), sum(len(w) for _, w in own)
    out = []
    for item, text in set(items):
        near = []
        for d, w in own:
            m = 25 + 75 * len(w) * n // total
            s = 0
            for t in words(text):
                tf = w.count(t)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in own) + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if s > 0:
                near.append((-s, d is None, d))
        near.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(near[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_ranked_search_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    bag = [f"wort{i}" for i in range(40)] + ["A", "Straße", "naïve", "a-b", "x" * 60, "中文"]
    texts = [" ".join(bag[int(j)] for j in rng.zipf(1.4, int(n)) % len(bag)) for n in rng.integers(1, 40, 90)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (500, texts[3]), (None, texts[3]), (501, None), (502, ""), (503, "--- !"), (504, " ".join(bag) * 300)]
    items = [(1, "wort1 wort2 WORT1 Straße"), (2, texts[3]), (2, texts[3]), (2, "wort7"), (None, "naïve A b"), (4, None), (5, ""), (6, "nowhere"), (7, "x" * 60 + " " + "x" * 59 + "y")]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n long, terms string").repartition(3)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, score int")
    want = brute_ranked(docs, items, 10)
    assert ranked(lexical.search(d, b)) == want
    assert ranked(lexical.search(d, b, block_bytes=12)) == want
    assert lexical.search(d.limit(0), b).count() == 0 and lexical.search(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 4])
def test_small_shards_rank_the_same(monkeypatch, step):
    rng = np.random.default_rng(5)
    n, v = 500, 30
    sizes = rng.integers(0, 12, n)
    terms = np.concatenate([np.sort(rng.choice(v, s, replace=False)) for s in sizes])
    counts, length = rng.integers(1, 9, len(terms)), rng.integers(10, 90, n)
    weight = lexical.weights(n, np.bincount(terms, minlength=v))
    shard = lexical.Shard(np.arange(n), length, sizes, terms, counts, weight, n, int(length.sum()))
    monkeypatch.setattr(lexical, "STEP", step)
    for q in range(20):
        asked = np.sort(rng.choice(v, 6, replace=False))
        times = rng.integers(1, 3, 6)
        shard.read = 0
        place, score = shard.search(asked, times, 5, 0)
        all_scores = shard.scores(np.arange(n), np.bincount(asked, weights=times, minlength=v).astype(np.int64))
        want = [i for i in np.lexsort((np.arange(n), -all_scores)) if all_scores[i] > 0][:5]
        assert place.tolist() == want and score.tolist() == all_scores[want].tolist()
        assert shard.search(asked, times, 5, int(score[-1]))[0].tolist() == want


def test_search_stops_before_the_lists_end():
    """One document holds the rare term often: the lists need not be read to their ends."""
    n = 5000
    terms, counts = np.zeros(n, np.int64), np.r_[np.full(20, 500), np.ones(n - 20, np.int64)]
    shard = lexical.Shard(np.arange(n), np.full(n, 600), np.ones(n, np.int64), terms, counts, np.array([900]), n, 600 * n)
    assert shard.search(np.array([0]), np.array([1]), 5, 0)[0].tolist() == [0, 1, 2, 3, 4]
    assert shard.read < n / 10


def brute_clusters(rows, k, rounds):
    kept = [(i, v) for i, v in ((i, whole(v, 1024)) for i, v in rows) if v is not None and len(v) == 64]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        now = [[sum(x) // len(x) for x in zip(*own, strict=True)] if (own := [v for (_, v), c in zip(kept, of, strict=True) if c == j]) else now[j] for j in range(len(now))]
    final = [(i, *near(v)) for i, v in kept]
    by = {}
    for _, d, c in final:
        by[c] = by.get(c, 0) + d
    return sorted(((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, d, c in final), key=str)


def clusters(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters_odd_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(40)]
    rows += [(100, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (101, None), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [NAN]), (105, [INF] + [1.0] * 63), (106, [0.0] * 64), (107, [4000.0] + [-0.001] * 63)]
    d = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    assert clusters(centroids.cluster(d)) == brute_clusters(rows, 8, 10)
    few = [(7, [float(i)] + [0.0] * 63) for i in range(3)] + [(8, [0.0] * 64)]
    assert clusters(centroids.cluster(spark.createDataFrame(few, "vec_id long, embedding array<float>"))) == brute_clusters(few, 8, 10)
    assert centroids.cluster(d.limit(0)).count() == 0


def test_annulus_compares_few_and_finds_all():
    """Of centroids with spread norms few lie in a vector's annulus; equal distances go to the smaller number."""
    rng = np.random.default_rng(9)
    radius = np.arange(1, 33)[:, None] * 3000
    way = rng.standard_normal((32, 8))
    c = np.floor(radius * way / np.linalg.norm(way, axis=1, keepdims=True)).astype(np.int64)
    c[20] = c[11]
    x = (c[rng.integers(0, 32, 2000)] + rng.integers(-200, 200, (2000, 8))).astype(np.int64)
    annuli = centroids.Annuli(c)
    which, far = annuli.assign(x)
    all_far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert which.tolist() == all_far.argmin(axis=1).tolist() and far.tolist() == all_far.min(axis=1).tolist()
    assert annuli.compared < 0.2 * len(x) * len(c)
    edge = centroids.Annuli(np.array([[5, 0], [-5, 0], [0, 5], [15, 0]]))
    assert edge.assign(np.array([[0, 0], [10, 0], [0, 20]]))[0].tolist() == [0, 0, 2]
