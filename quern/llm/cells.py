"""Vectors in cells of nearest pivots, and in shards of a cell: each shard's rows become one row of an index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, cut, give_back
from quern.llm.vectors import flat

#: Most cells of a dimension.
PIVOTS = 256


def _assigned(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, pivot, far, vec_id, v): the nearest pivot of the vector's dimension, and the distance to it."""
    bounded_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                v, p = flat(part.column("v"), dim), sent.value[dim]
                gap = np.maximum((v * v).sum(axis=1)[:, None] - 2 * (v @ p.T) + (p * p).sum(axis=1)[None, :], 0)
                near = gap.argmin(axis=1)
                far = np.sqrt(((v - p[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(near.astype(np.int32)), pa.array(far), part.column("vec_id"), part.column("v")], names=["dim", "pivot", "far", "vec_id", "v"])

    return rows.select("vec_id", "v", F.size("v").alias("d")).mapInArrow(run, "dim int, pivot int, far double, vec_id long, v array<double>")


class Cells:
    """Rows (vec_id, v), whose cells are those of their own dimension: pivots are a bounded sample, every row is in the cell of the nearest.

    A cell with more than one and a half times shard_rows rows, such as that of many equal vectors, has several shards, dealt out row by row.
    """

    def __init__(self, rows: DataFrame, shard_rows: int):
        sizes = {r.d: r.n for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row for each dimension
        pivots = {}
        for dim, n in sizes.items():
            most = min(PIVOTS, -(-n // shard_rows))
            chosen = rows.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(most).select("v").toArrow()
            pivots[dim] = flat(chosen.column("v").combine_chunks(), dim)
        self.near = cut(_assigned(rows, pivots))
        about = self.near.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # at most PIVOTS rows for each dimension
        self.parts = {(r.dim, r.pivot): max(1, int(r.n / shard_rows + 0.5)) for r in about}
        self._known = {}
        for d in sizes:
            own = [r for r in about if r.dim == d]
            of = np.array([r.pivot for r in own], np.int64)
            self._known[d] = (of, pivots[d][of], np.array([r.far for r in own]))

    def known(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells of a dimension: numbers, pivots, and the distance of the farthest row."""
        return self._known.get(dim, (np.empty(0, np.int64), np.empty((0, dim)), np.empty(0)))

    def grown(self, make: Callable[[np.ndarray, np.ndarray], list[bytes]], names: list[str]) -> DataFrame:
        """(dim, pivot, ...): a row for each shard with what `make` makes of its ids and vectors."""
        many = [x for (d, p), n in self.parts.items() if n > 1 for x in (f"{d} {p}", n)]
        spread = F.coalesce(F.create_map(*map(F.lit, many))[F.concat_ws(" ", "dim", "pivot")], F.lit(1)) if many else F.lit(1)
        part = F.pmod(F.monotonically_increasing_id(), spread.cast("long"))
        dealt = self.near.select("dim", "pivot", part.alias("part"), "vec_id", "v")
        dealt = dealt.repartition(max(1, sum(self.parts.values())), "dim", "pivot", "part").sortWithinPartitions("dim", "pivot", "part")

        def run(batches):
            held, key = [], None

            def flush():
                ids = np.concatenate([x.column("vec_id").to_numpy() for x in held])
                vectors = np.concatenate([flat(x.column("v"), key[0]) for x in held])
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in make(ids, vectors))], names=["dim", "pivot", *names])

            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "pivot", "part")])
                edges = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True]) if batch.num_rows else [0]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    now = tuple(keys[:, a].tolist())
                    if held and now != key:
                        yield flush()
                        held.clear()
                    key = now
                    held.append(batch.slice(a, b - a))
            if held:
                yield flush()
            give_back()

        return dealt.mapInArrow(run, ", ".join(["dim int", "pivot int", *(f"{n} binary" for n in names)]))
