"""Shared plumbing of the training-data operators: shared folders and Arrow text chunks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import cut, remove_path, shared_path  # noqa: F401

#: Texts are worked on in pieces of about this many bytes, whole texts at least one at a time.
CHUNK_BYTES = 2 << 20


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give back their shuffle files when they end; a frame that runs twice shuffles twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Texts:
    """UTF-8 bytes of consecutive texts (null counts as empty) with their offsets."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def byte_table(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], bool)


#: A-Z to a-z; all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text; bytes of other code points are above \x7F.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Bytes of words [^\x20\x09-\x0D]+.
SOLID = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the index of each text's first word (one more entry than texts)."""
    m = inside[data]
    if not len(m):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(m), np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    after[-1], after[:-1] = False, m[1:]
    before[offsets[:-1][offsets[:-1] < len(m)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longest word, in bytes, that two lanes hold whole.
LANES = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
_LOW63 = np.uint64((1 << 63) - 1)


def word_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last eight bytes and length of each word; of words below eight bytes all bytes, and zero.

    Words of at most LANES bytes are equal if and only if all three are.
    """
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))
    size = ends - starts
    first, last = eight[starts], np.zeros(len(starts), np.uint64)
    short = size < 8
    first[short] &= _MASKS[size[short]]
    long = np.flatnonzero(~short)
    last[long] = eight[ends[long] - 8]
    return first, last, size


def lane_hashes(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of words by their lanes: even for words below eight bytes, no two the same, and odd for the others."""
    out = mix(mix(first + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (last * np.uint64(0xC2B2AE3D27D4EB4F))) | np.uint64(1)
    short = np.flatnonzero(size < 8)
    x = ((first[short] | size[short].astype(np.uint64) << np.uint64(56)) * np.uint64(0xD6E8FEB86659FD93)) & _LOW63
    x = ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) & _LOW63  # one to one on 63 bits
    out[short] = (x ^ (x >> np.uint64(29))) << np.uint64(1)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: up to LANES bytes by its lanes, beyond odd and by XXH64 of all bytes."""
    first, last, size = word_lanes(data, starts, ends)
    out = lane_hashes(first, last, size)
    long = np.flatnonzero(size > LANES)
    if len(long):
        raw, h = data.data, xxhash.xxh64_intdigest
        out[long] = np.array([h(raw[a:b], 20240229) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], np.uint64) | np.uint64(1)
    return out


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


#: Bytes of one Arrow batch; without a bound 10,000 long texts could make one.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system, so that idle workers do not hold what their last task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, text: Column, keep: dict[str, Column], result: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Rows of `keep` columns with those that a function computes from chunks of texts.

    `make` runs once a task and returns the function; `result` is the DDL of what it returns.
    Inputs are renamed on the way, so names of the frame cannot clash with those of the result.
    """
    bounded_batches(df.sparkSession)
    inner = df.select(*[c.alias(f"_k{i}") for i, c in enumerate(keep.values())], text.cast("string").alias("_t"))
    fields = [T.StructField(name, inner.schema[f"_k{i}"].dataType) for i, name in enumerate(keep)]
    schema = T.StructType(fields + T.StructType.fromDDL(result).fields)
    names = schema.names

    def run(batches):
        work = make()
        for batch in batches:
            for lo, hi in chunks(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(part.columns[-1])], names=names)
        give_back()

    return inner.mapInArrow(run, schema)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def crc_remainder(column: Column, by: int) -> Column:
    """crc32 of the value's text, modulo `by`; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(by))
