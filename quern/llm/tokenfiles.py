"""Token ids in ORC files: integer run-length encoding, row indexes, and a Bloom filter on doc_id in each stripe.

Documents stand in ascending doc_id order, across files (by `part`) and within them. Each file's rows carry the
place of their first id within the file, so a reader needs one sum for each file to know global places, and
stripes can be read side by side.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.bpe import encoder
from quern.llm.common import bounded_batches, chunks, give_back, list_array

#: Bytes of the tables that documents are read from, for each file; there are as many files as shuffle partitions at least.
FILE_BYTES = 128 << 20
SCHEMA = "doc_id long, part int, place long, n_tokens long, ids array<int>"
#: ORC writer settings.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def _source_bytes(docs: DataFrame) -> int:
    """Bytes of the tables under a frame; those that do not know theirs count as none."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode whole texts (null: empty), append end_id to each, and write ORC files under path.

    Null ids come first. Rows that share an id are ordered by their text's hash and then by the text, and are
    dealt to several files if they are many. Columns but id and text are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_source_bytes(docs) // FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "t")

    def run(batches):
        own, part, place = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                ids, sizes = own.encode_column(batch.column(1).slice(lo, hi - lo), end_id)
                places = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(places), pa.array(sizes), list_array(ids, sizes, pa.int32())], names=["doc_id", "part", "place", "n_tokens", "ids"])
        give_back()

    writer = ordered.select("doc_id", "t").mapInArrow(run, SCHEMA).write
    for key, value in ORC.items():
        writer = writer.option(key, value)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with doc_ids, stripes are left out by their statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files alone.

    Documents without an id come first, those that share one in the files' order; each is a row. No documents, no rows.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            view = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    # one row for each file
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before.alias("before"))
    read = rows.select("doc_id", "part", "place", "ids").mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(files), "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
