"""Exact top-k search by inner product: ball-tree branch and bound in shards that share the k-th score found so far.

Vectors are dealt out to shards by the nearest pivot, a cell, of which there may be several; each shard is a ball tree, kept as one row of a written table.
A ball with centre c and radius r holds no vector whose product with q is above q.c + |q| r. In a shard a query goes down
from the root through the balls whose bound reaches its k-th score, then through the leaves that are left in the order of
their bounds, best first, until no bound reaches it. Each query is first searched in the shards of the pivot with the best
bound; the k-th score that it has then goes with it to all the other shards, and within a task from each shard to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.cells import Cells
from quern.llm.common import cut, give_back, shared_path
from quern.llm.vectors import flat, products, scaled

SCALE = 256
#: Vectors of a leaf and, about, of a shard; queries that are broadcast at once, and searched at once.
LEAF, SHARD_ROWS, QUERY_ROWS, GROUP = 64, 8192, 4096, 256
#: What bounds are raised by, for rounding in doubles.
SLACK = 1e-9
_FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes over ranges of rows; the two halves of a node are split across its widest direction."""

    def __init__(self, ids, vectors, ranges, children, centres, radii):
        self.ids, self.vectors, self.ranges, self.children, self.centres, self.radii = ids, vectors, ranges, children, centres, radii
        self.size = np.sqrt((centres * centres).sum(axis=1)) + radii

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.argsort(ids, kind="stable")
        ranges, children, centres, radii = [(0, len(ids))], [], [], []
        at = 0
        while at < len(ranges):
            lo, hi = ranges[at]
            own = vectors[order[lo:hi]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(far.max())
            if hi - lo > leaf:
                one = own[far.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (other - one), mid)]
                children.append(len(ranges))
                ranges += [(lo, lo + mid), (lo + mid, hi)]
            else:
                children.append(-1)
            at += 1
        return cls(ids[order], vectors[order], np.array(ranges, np.int64), np.array(children, np.int64), np.array(centres), np.array(radii))

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.ids, self.vectors, self.ranges, self.children, self.centres, self.radii)]

    @classmethod
    def unpacked(cls, dim: int, ids: bytes, vectors: bytes, ranges: bytes, children: bytes, centres: bytes, radii: bytes) -> BallTree:
        rows = lambda x: np.frombuffer(x, np.float64)
        ids, radii = np.frombuffer(ids, np.int64), rows(radii)
        return cls(ids, rows(vectors).reshape(len(ids), dim), np.frombuffer(ranges, np.int64).reshape(-1, 2), np.frombuffer(children, np.int64), rows(centres).reshape(len(radii), dim), radii)

    def bounds(self, queries: np.ndarray, norms: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The highest product that a vector of the node can have with the query, for pairs of both."""
        middle = np.einsum("ij,ij->i", queries[q], self.centres[node])
        return middle + norms[q] * (self.radii[node] + SLACK * self.size[node]) + SLACK

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best) -> int:
        """Improve what the queries have found; rows with a query's own id are not candidates. Returns how many leaves were read."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        leaves = []
        while len(q):
            bound = self.bounds(queries, norms, q, node)
            held = ~(bound < best.floor[q])
            q, node, bound = q[held], node[held], bound[held]
            inner = self.children[node] >= 0
            leaves.append((q[~inner], node[~inner], bound[~inner]))
            q, first = q[inner], self.children[node[inner]]
            q, node = np.r_[q, q], np.r_[first, first + 1]
        q, node, bound = (np.concatenate(x) for x in zip(*leaves, strict=True)) if leaves else (np.empty(0, np.int64),) * 3
        order = np.lexsort((-bound, q))
        q, node, bound = q[order], node[order], bound[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        at, step, read = 0, 1, 0
        while len(q):
            turn = place < at + step
            read += self._scan(queries, own, best, q[turn], node[turn])
            at, step = at + step, step * 2
            open_ = ~turn
            open_[open_] = ~(bound[open_] < best.floor[q[open_]])
            q, node, bound, place = q[open_], node[open_], bound[open_], place[open_]
        return read

    def _scan(self, queries, own, best, q, node) -> int:
        order = np.argsort(node, kind="stable")
        q, node = q[order], node[order]
        edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]) if len(node) else [0]
        found = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            lo, hi = self.ranges[node[a]]
            of, ids = q[a:b], self.ids[lo:hi]
            score = products(queries[of], self.vectors[lo:hi])
            i, j = np.nonzero((score >= best.floor[of][:, None]) & (ids[None, :] != own[of][:, None]))
            found.append((of[i], ids[j], np.array(score[i, j], np.int64)))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return len(node)


def below(score: np.ndarray) -> np.ndarray:
    """The scores as doubles, those that doubles do not hold a little less."""
    out = score.astype(float)
    return np.where(np.abs(out) < 1 << 53, out, np.nextafter(out, -np.inf))


class Best:
    """The k best (score, then smaller id) of each of n queries, and the score that a row must reach to come among them."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()
        self.q, self.ids, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = np.r_[self.q, q], np.r_[self.ids, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kth = place == self.k - 1
        self.floor[q[kth]] = np.maximum(self.floor[q[kth]], below(score[kth]))
        held = place < self.k
        self.q, self.ids, self.score = q[held], ids[held], score[held]


class Trees:
    """The written trees of all shards, and the cells that the shards are parts of."""

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF):
        self.cells = Cells(rows, shard_rows)
        self.path = shared_path(rows.sparkSession, "trees")
        grown = self.cells.grown(lambda ids, vectors: BallTree.build(ids, vectors, leaf).packed(), ["ids", "vectors", "ranges", "children", "centres", "radii"])
        grown.write.option("compression", "zstd").parquet(self.path)
        self.table = rows.sparkSession.read.schema(grown.schema).parquet(self.path)

    def homes(self, dim: int, queries: np.ndarray) -> np.ndarray:
        """The cell of each query whose vectors can have the highest products."""
        of, centres, far = self.cells.known(dim)
        return of[(queries @ centres.T + np.sqrt((queries * queries).sum(axis=1))[:, None] * far[None, :]).argmax(axis=1)] if len(of) else np.full(len(queries), -1)


def _searched(trees: DataFrame, asked: dict, k: int, at_home: bool) -> DataFrame:
    """What the queries find in the shards of their own pivot, or in all others; asked: by dimension their ids, vectors, homes and k-th scores."""
    sent = trees.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        groups = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim, pivot = row.pop("dim"), row.pop("pivot")
                if dim not in sent.value:
                    continue
                own, queries, home, floor = sent.value[dim]
                tree = BallTree.unpacked(dim, **row)
                some = np.flatnonzero((home == pivot) == at_home)
                for g in np.unique(some // GROUP).tolist():
                    lo, hi = g * GROUP, min(len(own), (g + 1) * GROUP)
                    best = groups.setdefault((dim, g), Best(hi - lo, k, floor[lo:hi]))
                    mine = some[(some >= lo) & (some < hi)]
                    if len(mine) == hi - lo:
                        tree.search(queries[lo:hi], own[lo:hi], best)
                    else:
                        part = Best(len(mine), k, best.floor[mine - lo])
                        tree.search(queries[mine], own[mine], part)
                        best.add(mine[part.q] - lo, part.ids, part.score)
        for (dim, g), best in groups.items():
            ids = sent.value[dim][0][g * GROUP :]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.ids), pa.array(best.score)], names=["query_id", "vec_id", "score"])
        give_back()

    return trees.mapInArrow(run, _FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows (vec_id, v) with the highest inner products with each query (vec_id, v).

    v are whole doubles. Queries go out in blocks of about query_rows, each block against all trees, which are built once.
    """
    spark = rows.sparkSession
    trees = Trees(rows, shard_rows, leaf)
    asked = cut(queries)
    n = asked.count()
    blocks = max(1, -(-n // query_rows))
    path = shared_path(spark, "topk")
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()  # about query_rows
        sizes = np.array([len(x) for x in got.column("v").to_pylist()], np.int64)
        block = {}
        for dim in np.unique(sizes).tolist():
            part = got.filter(pa.array(sizes == dim))
            v = flat(part.column("v").combine_chunks(), dim)
            block[dim] = (part.column("vec_id").to_numpy(), v, trees.homes(dim, v), np.full(len(v), -np.inf))
        first = f"{path}/block={b}/home=1"
        _searched(trees.table, block, k, True).write.parquet(first)
        kth = spark.read.schema(_FOUND).parquet(first).withColumn("p", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("p") == k)
        floor = {r.query_id: float(below(np.array(r.score))) for r in kth.select("query_id", "score").collect()}  # one for each query of the block
        block = {dim: (ids, v, home, np.array([floor.get(i, -np.inf) for i in ids.tolist()])) for dim, (ids, v, home, _) in block.items()}
        _searched(trees.table, block, k, False).write.parquet(f"{path}/block={b}/home=0")
    found = spark.read.schema(_FOUND).option("recursiveFileLookup", "true").parquet(path)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose id is divisible by `every`, over all rows.

    Components x count as floor(256 * x). Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; a vector meets those of its own dimension only, and one without components has product 0. Ties go to the smaller id. Repeated
    rows are each found; rows of the query's own id are not; of several rows with a query's id the least vector asks. Products are exact
    at any size of components; one that 64 bits do not hold is an error. An empty table gives an empty result; other columns are not read.
    """
    rows = scaled(vectors, SCALE, id_col, vector_col).where("vec_id is not null")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(rows, queries, k, **options)
