"""Nearest neighbours: recall against brute force, and odd vectors."""

import numpy as np
import pytest

from quern.llm import ann
from quern.llm.common import table


def brute(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((np.array(v, np.float64) - np.array(w, np.float64)) ** 2).sum())), i) for i, w in rows if i != q)[:k]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    vectors = table(spark, f"/root/testdata/sf{sf}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, 100, 10)
    got = {}
    for r in ann.search(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys()
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    by = dict(rows)
    for q, near in got.items():
        assert near == sorted(near)
        for s, i in near:
            assert abs(s - np.sqrt(((np.array(by[q], np.float64) - np.array(by[i], np.float64)) ** 2).sum())) < 1e-12


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (200, [0.0, 0.0]), (300, [1.0, nan]), (400, [inf, 1.0]), (500, [1.0, None]), (None, [1.0, 1.0]), (600, []), (700, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0])] + [(i, [1.0, float(i % 3)]) for i in range(1, 40)]
    d = spark.createDataFrame([(i, v, 1) for i, v in bad + good], "vec_id long, embedding array<float>, score int")
    got = ann.search(d, k=10).orderBy("rank").collect()
    want = brute(good, 100, 10)[0]
    assert [(r.query_id, r.vec_id, r.rank) for r in got] == [(0, i, n + 1) for n, (_, i) in enumerate(want)]
    assert ann.search(d.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ann.search(few).orderBy("rank").collect()] == [(1, 1.0), (1, 1.0)]


def test_blocks_and_shards_find_the_same(spark, sf_dir):
    """Shards of another size verify other vectors, but nearly all that is found is the same, and always the nearest."""
    rows = ann.valid(table(spark, sf_dir, "embeddings"))
    queries = rows.where("vec_id % 25 = 0")
    found = [{(r.query_id, r.vec_id) for r in ann.nearest(rows, queries, **sizes).collect()} for sizes in ({}, {"shard_rows": 100, "query_rows": 7})]
    true = {(q, i) for q, near in brute([(r.vec_id, r.v) for r in rows.collect()], 25, 10).items() for _, i in near}
    for own in found:
        assert len(own) == len(true) and len(own & true) >= 0.9 * len(true)


def test_share_verified_on_two_shards():
    """Vectors without clusters, as the table's: at most a fifth is verified, and nine tenths are found."""
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((2 * 12_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(len(vectors))
    shards = [ann.Shard(ids[i::2], vectors[i::2]) for i in range(2)]
    right, some = 0, range(0, len(ids), 600)
    for q in some:
        got = sorted((d, i) for s in shards for i, d in zip(*s.search(q, vectors[q], 10), strict=True))[:10]
        far = np.linalg.norm(vectors - vectors[q], axis=1)
        far[q] = np.inf
        right += len({i for _, i in got} & set(np.argsort(far)[:10].tolist()))
    assert right >= 0.9 * 10 * len(some)
    assert sum(s.verified for s in shards) <= 0.2 * len(ids) * len(some)


def test_each_dimension_is_searched(spark):
    """Rows of two dimensions, some of them with a query's id more than once: neighbours are of the query's own dimension."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(2 + 3 * (i % 2)).tolist()) for i in range(1, 60)] + [(100, [5.0, 5.0]), (100, [0.5, 0.5]), (101, [0.5, 0.5]), (200, [0.1] * 5), (300, [1.0] * 7)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"shard_rows": 9, "query_rows": 1}):
        valid = ann.valid(d)
        got = {}
        for r in ann.nearest(valid, valid.where("vec_id % 100 = 0"), 10, **sizes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got.keys() == {100, 200}
        for q, v in ((100, [0.5, 0.5]), (200, [0.1] * 5)):
            near = sorted((float(np.linalg.norm(np.array(v) - w)), i) for i, w in rows if len(w) == len(v) and i != q)[:10]
            assert len(set(got[q]) & {i for _, i in near}) >= 9


def test_cells_far_away_are_passed_over(spark):
    """Of clusters far apart a query visits its own cell alone; the neighbours are the true ones."""
    rng = np.random.default_rng(8)
    middle = rng.standard_normal((6, 16)) * 100
    rows = [(i, (middle[i % 6] + rng.standard_normal(16)).tolist()) for i in range(1800)]
    valid = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    cells = ann.Cells(valid, 300)
    of, centres, far = cells.known(16)
    got = {}
    for r in ann.nearest(valid, valid.where("vec_id % 100 = 0"), 10, shard_rows=300).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = visits = 0
    for q, near in got.items():
        v = np.array(rows[q][1])
        true = sorted((float(np.linalg.norm(v - np.array(w))), i) for i, w in rows if i != q)[:10]
        right += len(near & {i for _, i in true})
        visits += int((np.linalg.norm(centres - v, axis=1) - far <= true[-1][0]).sum())
    assert right >= 0.9 * 10 * len(got) == 0.9 * 10 * 18 and visits < len(got) * len(of) * 0.6
