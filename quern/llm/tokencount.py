"""Token counts of documents in flat token files without an index.

A file is nothing but little-endian 16- or 32-bit ids, each document closed by an end id. Blocks of files are read
side by side; each is searched for the end id at once (one vectorised comparison). A prefix scan over the blocks
of a file gives the documents that end before a block and where the document open at its start began, so that
documents across block boundaries are stitched.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.bpe import encoder
from quern.llm.common import bounded_batches, chunks, cut, give_back, shared_path

#: Ids in a block.
BLOCK = 1 << 20


#: Spark's names of schemes that pyarrow has under another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file of the shared folder, which must be local, hdfs, s3, gs or abfs."""
    scheme, rest = uri.split(":", 1) if ":" in uri else ("file", f"//{uri}")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def write_flat(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Encode whole texts into one flat file for each task; returns (file, nth, doc_id), the documents in file order.

    Special strings in texts are ordinary text, so the end id stands at document ends alone. A task writes under a
    name of its own attempt and renames at the end; only finished tasks' files are in the returned rows.
    """
    bounded_batches(docs.sparkSession)
    kind = f"<u{width}"

    def run(batches):
        own = encoder(tokenizer_file, kind, True)
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        nth, ids = 0, []
        with system.open_output_stream(f"{name}.part") as out:
            for batch in batches:
                for lo, hi in chunks(batch.column(1)):
                    out.write(own.encode_column(batch.column(1).slice(lo, hi - lo), end_id)[0].tobytes())
                ids.append(batch.column(0))
        if not ids:
            system.delete_file(f"{name}.part")
            return
        system.move(f"{name}.part", name)
        uri = f"{folder}/{name.rsplit('/', 1)[1]}"
        for column in ids:
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(column), pa.string()), pa.array(np.arange(nth, nth + len(column))), column], names=["file", "nth", "doc_id"])
            nth += len(column)
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return cut(rows.mapInArrow(run, "file string, nth long, doc_id long"))


def _ids(system: pafs.FileSystem, path: str, start: int, n: int, width: int) -> np.ndarray:
    with system.open_input_file(path) as f:
        f.seek(start * width)
        return np.frombuffer(f.read(n * width), f"<u{width}")


def count_tokens(spark: SparkSession, files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, nth, n_tokens, closed): ids of each document without its end id. Ids after a file's last end id are a document that is not closed.

    `files` has the column file (URIs); repeated and empty files count once and not at all, null is an error. Bytes after the last
    whole id are left out. Other columns are not read; an empty table gives an empty result.
    """

    def cut_up(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = _open(uri)
                n = system.get_file_info(path).size // width
                at = np.arange(0, n, block)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(at), pa.string()), pa.array(at), pa.array(np.minimum(block, n - at)), pa.array(np.full(len(at), n))], names=["file", "at", "n", "whole"])

    def ends(batches):
        for batch in batches:
            for uri, at, n, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.flatnonzero(_ids(*_open(uri), at, n, width) == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((uri, pa.string()), (at, pa.int64()), (n, pa.int64()), (whole, pa.int64()), (len(found), pa.int64()), (at + int(found[-1]) if len(found) else None, pa.int64()))], names=["file", "at", "n", "whole", "ends", "last"])

    def documents(batches):
        for batch in batches:
            for uri, at, n, whole, nth, began in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.flatnonzero(_ids(*_open(uri), at, n, width) == end_id) + at
                sizes, closed = np.diff(np.r_[began - 1, found]) - 1, np.ones(len(found), bool)
                left = at + n - (found[-1] + 1 if len(found) else began)
                if at + n == whole and left > 0:
                    sizes, closed = np.r_[sizes, left], np.r_[closed, False]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(sizes), pa.string()), pa.array(np.arange(nth, nth + len(sizes))), pa.array(sizes.astype(np.int64)), pa.array(closed)], names=["file", "nth", "n_tokens", "closed"])

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = files.select("file").distinct()
    blocks = names.mapInArrow(cut_up, "file string, at long, n long, whole long").repartition(spread)
    found = cut(blocks.mapInArrow(ends, "file string, at long, n long, whole long, ends long, last long"))
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    scan = found.select("file", "at", "n", "whole", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("nth"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("began"))
    return scan.repartition(spread).mapInArrow(documents, "file string, nth long, n_tokens long, closed boolean")


def document_tokens(docs: DataFrame, tokenizer_file: str, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens; the texts are written to flat files and counted there.

    Null and empty texts have no tokens. Null ids and repeated rows are returned as they come; an empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    order = write_flat(docs, shared_path(spark, "flat"), tokenizer_file, end_id, id_col, text_col)
    counts = count_tokens(spark, order, end_id)
    return order.join(counts.hint("merge"), ["file", "nth"], "left").select("doc_id", "n_tokens")
