"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is matched against document windows.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z lower-cased. A window is 13 consecutive words of an
item, or all words of a shorter one. Window hashes are compared through a bitmap and a sorted array; each hit is
then verified on the words themselves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ALNUM, LOWER, Texts, map_texts, mix, shared_path, word_hashes, word_spans

WINDOW = 13
#: Bytes of benchmark text that one broadcast may index (about 250 bytes of memory for each word); more is split into
#: blocks, scanned one after the other.
BLOCK_BYTES = 4 << 20
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for t in range(1, length):
        h = h * _ROLL + words[t : t + n]
    return mix(h)


class Index:
    """Windows of benchmark items: hashes by length, the words of each window, and its items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.items: dict[bytes, frozenset[str]] = {}
        self.lengths: dict[int, set[int]] = {}
        for item, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
            if not len(starts):
                continue
            raw, length = data.tobytes(), min(window, len(starts))
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            self.lengths.setdefault(length, set()).update(_window_hashes(word_hashes(data, starts, ends), length).tolist())
            own = frozenset(["" if item is None else item])
            for i in range(len(words) - length + 1):
                key = b" ".join(words[i : i + length])
                held = self.items.setdefault(key, own)
                if not own <= held:
                    self.items[key] = held | own
        self.tables = {}
        for length, hashes in sorted(self.lengths.items()):
            table = np.array(sorted(hashes), np.uint64)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[table >> np.uint64(44)] = True
            self.tables[length] = (table, bitmap)
        del self.lengths


def _scan(index: Index, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[set[str]], np.ndarray, np.ndarray, np.ndarray]:
    texts = Texts(column)
    data = LOWER[texts.data]
    starts, ends, first = word_spans(data, texts.offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    hits: list[list[tuple[int, int]]] = [[] for _ in range(len(n))]
    found: list[set[str]] = [set() for _ in range(len(n))]
    for length, (table, bitmap) in index.tables.items():
        h = _window_hashes(words, length)
        at = np.flatnonzero(bitmap[h >> np.uint64(44)])
        if not len(at):
            continue
        at = at[doc[at] == doc[at + length - 1]]
        place = np.minimum(np.searchsorted(table, h[at]), len(table) - 1)
        at = at[table[place] == h[at]]
        for k in at.tolist():
            own = index.items.get(b" ".join(_WORD.findall(data[starts[k] : ends[k + length - 1]].tobytes())))
            if own is not None:
                d = int(doc[k])
                hits[d].append((k - int(first[d]), k - int(first[d]) + length))
                found[d] |= own
    return n, hits, found, starts, ends, first


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint spans as flat [start, end, start, end, ...]."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of about block_bytes of text, each read for itself."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for b in range(n):
        yield [(r.i, r.t) for r in (rows.where(F.col("b") == b) if n > 1 else rows).select("i", "t").collect()]


def _matched(df: DataFrame, block: list[tuple[str | None, str | None]], window: int, keep: dict[str, Column], text: Column) -> DataFrame:
    """`keep` columns with n_words, hits and items of one block of the benchmark."""
    sent = df.sparkSession.sparkContext.broadcast(Index(block, window))

    def make():
        def work(column):
            n, hits, found, *_ = _scan(sent.value, column)
            spans = [_merge(x) for x in hits]
            return [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]

        return work

    return map_texts(df, text, keep, "n_words long, hits array<long>, items array<string>", make)


def scan(docs: DataFrame, benchmark: DataFrame, keep: dict[str, Column], text: Column, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`keep` columns of each row with n_words, hits (flat word spans, merged), items (ids of occurring items).

    Null texts have no words; empty benchmarks give no hits. A benchmark larger than block_bytes is matched in
    blocks, each block against all rows: these are written to the shared folder once, numbered, each block gives the rows that it
    hits, and what all blocks gave is joined to the rows at the end.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return _matched(docs, block, window, keep, text)
    source, found = shared_path(spark, "texts"), shared_path(spark, "hits")
    kept = F.struct(*[c.alias(f"f{i}") for i, c in enumerate(keep.values())])
    docs.select(kept.alias("row"), text.cast("string").alias("t"), F.monotonically_increasing_id().alias("nth")).write.option("compression", "zstd").parquet(source)
    rows = spark.read.parquet(source)
    lengths = _matched(rows, block, window, {"nth": F.col("nth")}, F.col("t"))
    lengths.write.option("compression", "zstd").parquet(f"{found}/first")
    while after is not None:
        _matched(rows, after, window, {"nth": F.col("nth")}, F.col("t")).where("size(hits) > 0").select("nth", "hits", "items").write.mode("append").parquet(f"{found}/others")
        after = next(blocks, None)
    first = spark.read.parquet(f"{found}/first")
    every = first.select("nth", "hits", "items").where("size(hits) > 0").unionByName(spark.read.parquet(f"{found}/others"))
    hits = every.groupBy("nth").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # of one row
    whole = rows.select("nth", "row").join(first.select("nth", "n_words"), "nth").join(hits, "nth", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return whole.select(*[F.col(f"row.f{i}").alias(name) for i, name in enumerate(keep)], "n_words", none("hits", "array<bigint>"), none("items", "array<string>"))


def _hit_words(hits: str) -> Column:
    """Words in any of the flat spans; spans of several blocks may overlap."""
    pairs = f"array_sort(transform(sequence(0, size({hits}) div 2 - 1), i -> struct({hits}[2 * i] as a, {hits}[2 * i + 1] as b)))"
    fold = f"aggregate({pairs}, struct(0L as n, 0L as upto), (s, x) -> struct(s.n + greatest(0L, x.b - greatest(x.a, s.upto)) as n, greatest(s.upto, x.b) as upto), s -> s.n)"
    return F.expr(f"if(size({hits}) = 0, 0L, {fold})")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of a window; contaminated is n_hit > 0 and 20 * n_hit >= n_words.
    Items of one id count once, whatever their rows; an item without an id has the empty id. Null and empty
    texts have no words. Repeated rows are each returned; other columns are not read.
    """
    df = scan(docs, benchmark, {"doc_id": F.col(id_col)}, F.col(text_col), **options)
    return _judge(df).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _judge(df: DataFrame) -> DataFrame:
    df = df.withColumn("n_hit", _hit_words("hits")).withColumn("n_items", F.size("items").cast("long"))
    df = df.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
    return df.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not contaminated (see `contamination`), with all their columns as they were.

    Null and empty texts stay, repeated rows are each judged, ids are not read. With no benchmark all rows stay.
    """
    df = _judge(scan(docs, benchmark, {"row": F.struct("*")}, F.col(text_col), **options))
    return df.where(~F.col("contaminated")).select("row.*")


def _cut_spans(column: pa.Array, hits: pa.Array) -> list[str | None]:
    texts = Texts(column)
    starts, ends, first = word_spans(LOWER[texts.data], texts.offsets, ALNUM)
    out: list[str | None] = []
    for d, (own, old) in enumerate(zip(hits.to_pylist(), column.to_pylist(), strict=True)):
        if not own:
            out.append(old)
            continue
        lo, hi = int(texts.offsets[d]), int(texts.offsets[d + 1])
        pieces, at, f = [], lo, int(first[d])
        spans = _merge(list(zip(own[::2], own[1::2], strict=True)))
        for a, b in zip(spans[::2], spans[1::2], strict=True):
            pieces.append(texts.data[at : starts[f + a]].tobytes())
            at = int(ends[f + b - 1])
        out.append(b"".join([*pieces, texts.data[at:hi].tobytes()]).decode("utf-8", "replace"))
    return out


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` with the words of every occurring window cut out of the text (first word to last, inclusive).

    Windows that touch or overlap are cut as one. Null and empty texts stay as they are, repeated rows are each cut, other columns
    are kept whatever their names, and with no benchmark all rows stay as they are.
    """
    df = scan(docs, benchmark, {"row": F.struct("*")}, F.col(text_col), **options)
    fields = [f for f in docs.columns if f != text_col]

    def run(batches):
        for batch in batches:
            text = pa.array(_cut_spans(batch.column("t"), batch.column("hits")), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), text], names=["row", "t"])

    df = df.select("row", F.col(f"row.`{text_col}`").alias("t"), "hits")
    from pyspark.sql import types as T

    schema = T.StructType([df.schema["row"], T.StructField("t", T.StringType())])
    df = df.mapInArrow(run, schema)
    return df.select(*[F.col("t").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]) if fields else df.select(F.col("t").alias(text_col))
