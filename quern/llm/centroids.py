"""Centroid clustering by annulus search, in exact integers.

A centroid c can only be as near to x as u if | |c| - |x| | <= u. So centroids are sorted by norm; each vector takes as upper
bound u its distance to the centroid whose norm is nearest to its own, finds by binary search those with norms from |x| - u to
|x| + u, and is compared exactly with these, those on the edge included. A round is one pass over the vectors that gives each
centroid's sums; nothing is kept for a vector between rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import bounded_batches, give_back, shared_path
from quern.llm.vectors import EXACT, flat, scaled, whole

DIM, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: What the annulus is widened by, in parts of its numbers, for rounding in doubles.
SLACK = 1e-9
#: Vectors that are compared at once.
STEP = 4096


class Annuli:
    """Centroids, whole numbers, in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.compared = 0

    def distances(self, x: np.ndarray, j: int) -> np.ndarray:
        """Squared distances to the centroid of place j."""
        c = self.centroids[self.order[j]]
        if x.dtype == object or np.abs(c).max(initial=0) >= EXACT:
            x, c = x.astype(object), c.astype(object)
        self.compared += len(x)
        gap = x - c
        return (gap * gap).sum(axis=1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, the smaller of two as near, and the squared distance."""
        n, k = len(x), len(self.order)
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, k - 1))
        near = np.where(np.abs(self.norms[np.minimum(right, k - 1)] - norm) < np.abs(norm - self.norms[right - 1]), np.minimum(right, k - 1), right - 1)
        best, which = np.empty(n, x.dtype), np.empty(n, np.int64)
        for j in np.unique(near).tolist():
            own = np.flatnonzero(near == j)
            d = self.distances(x[own], j)
            if d.dtype == object and best.dtype != object:
                best = best.astype(object)
            best[own], which[own] = d, self.order[j]
        bound = np.sqrt(best.astype(float))
        room = SLACK * (bound + norm + 1)
        lo, hi = np.searchsorted(self.norms, norm - bound - room, "left"), np.searchsorted(self.norms, norm + bound + room, "right")
        for j in range(k):
            own = np.flatnonzero((lo <= j) & (j < hi) & (near != j))
            if len(own):
                d = self.distances(x[own], j)
                if d.dtype == object and best.dtype != object:
                    best = best.astype(object)
                number = self.order[j]
                closer = (d < best[own]) | ((d == best[own]) & (number < which[own]))
                best[own[closer]], which[own[closer]] = d[closer], number
        return which, best


def _steps(batches, dim: int):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, whole(flat(part.column("v"), dim))


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid that has vectors: how many, the sum of their distances, and their sum by component."""
    dim = centroids.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        annuli, held = Annuli(sent.value), {}
        for _, x in _steps(batches, dim):
            which, far = annuli.assign(x)
            for c in np.unique(which).tolist():
                own = which == c
                n, total, parts = held.get(c, (0, 0, [0] * dim))
                held[c] = (n + int(own.sum()), total + int(far[own].sum()), [a + int(b) for a, b in zip(parts, x[own].sum(axis=0), strict=True)])
        # as decimals: sums of many rows may pass 64 bits
        out = [(c, "n", 0, n) for c, (n, _, _) in held.items()] + [(c, "far", 0, far) for c, (_, far, _) in held.items()] + [(c, "sum", i, s) for c, (_, _, parts) in held.items() for i, s in enumerate(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.decimal128(38, 0))], names=["c", "what", "i", "s"])
        give_back()

    parts = rows.select("v").mapInArrow(run, "c int, what string, i int, s decimal(38,0)").groupBy("c", "what", "i").agg(F.sum("s").alias("s"))
    got: dict = {}
    for r in parts.collect():  # components and two more for each centroid
        got.setdefault(r.c, {"sum": [0] * dim})
        if r.what == "sum":
            got[r.c]["sum"][r.i] = int(r.s)
        else:
            got[r.c][r.what] = int(r.s)
    return {c: (x["n"], x["far"], x["sum"]) for c, x in got.items()}


def _integers(rows: list[list[int]], dim: int) -> np.ndarray:
    small = all(abs(x) < EXACT for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), dim)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with `dim` components, none null or non-finite; components x count as floor(1024 * x). The first centroids are the
    rows with the least sha256 of "seed:id"; rows without an id come last, and equal hashes go by vector. Equal centroids may be named
    twice, ties go to the smaller number, and a centroid that gets no vectors stays. Repeated rows are each counted and returned; fewer
    rows than centroids make fewer centroids, and an empty table an empty result. Arithmetic is exact at any size of components; a distance
    or inertia that 64 bits do not hold is an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, "vectors")
    scaled(vectors, SCALE, id_col, vector_col).where(F.size("v") == dim).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema("vec_id long, v array<double>").parquet(path)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(F.asc_nulls_last(hashed), "v").limit(centroids).select("v").collect()
    now = [[int(x) for x in r.v] for r in first]
    for _ in range(rounds if now else 0):
        for c, (n, _, sums) in _sums(rows, _integers(now, dim)).items():
            now[c] = [s // n for s in sums]
    final = _integers(now, dim)
    inertia = {c: far for c, (_, far, _) in _sums(rows, final).items()} if now else {}
    about = {c: (far, hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for c, far in inertia.items()}
    total = sum(inertia.values())
    sent = spark.sparkContext.broadcast((final, about, total))

    def run(batches):
        final, about, total = sent.value
        annuli = Annuli(final)
        for part, x in _steps(batches, dim):
            which, far = annuli.assign(x)
            own = [about[c] for c in which.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(which.astype(np.int32)), pa.array([int(d) for d in far], pa.int64()), pa.array([o[0] for o in own], pa.int64()), pa.array([total] * len(own), pa.int64()), pa.array([o[1] for o in own])], names=schema.names)

    schema = T.StructType.fromDDL("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.mapInArrow(run, schema)
