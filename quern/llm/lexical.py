"""Ranked lexical search by the threshold algorithm over shards of documents.

A document's score for an item is the sum of its terms' impacts, a term's weight by how often the document holds it for its length.
One pass over the texts writes the forward index: each document's length, and the terms that items ask for with their counts.
From it come the corpus's numbers, and then the shards: in each, every term has a list of its documents, highest impact
first. The lists of an item are read in turns, a further step of each; a document that is met for the first time is scored
whole from the forward index. No document that was not met can have more than the impacts reached in the lists together,
the threshold; an item's search ends when that falls strictly below its k-th score. The k-th score goes from shard to shard within a
task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ALNUM, LOWER, Texts, bounded_batches, give_back, list_array, map_texts, shared_path, word_hashes, word_spans

#: The weight's factor, the impact's, and what document length counts, in hundredths.
WEIGHT, UNIT, COUNT, LENGTH, BY_LENGTH = 1000, 1_000_000_000, 1000, 8, 75
#: Bytes of items that one broadcast may hold; more are asked in blocks, each block against all documents.
BLOCK_BYTES = 4 << 20
#: Documents and entries of a shard, at most; places of each list that are read at first.
SHARD_DOCS, SHARD_ENTRIES, STEP = 16384, 2_000_000, 4


def words_of(text: str | None) -> list[bytes]:
    """Terms of one text: maximal runs of letters, digits and all beyond ASCII, with A-Z lower-cased."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Vocabulary:
    """The distinct terms of items, found by hash and told apart by their bytes."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.empty(0, np.int64)
        hashes = word_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.words = hashes[self.order], words
        self.same = int(np.unique(hashes, return_counts=True)[1].max()) if words else 0

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those that are not here."""
        out = np.full(len(starts), -1)
        if not len(self.hashes):
            return out
        own = word_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, own)
        some = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == own)
        # each distinct hash is compared by its bytes once in a chunk, words below eight bytes by their hash alone
        raw, known = data.data, {}
        for i, h, a, b in zip(some.tolist(), own[some].tolist(), starts[some].tolist(), ends[some].tolist(), strict=True) if self.same > 1 else ():
            out[i] = next((self.order[x] for x in range(at[i], min(at[i] + self.same, len(self.order))) if self.words[self.order[x]] == bytes(raw[a:b])), -1)
        if self.same > 1:
            return out
        out[some] = self.order[at[some]]
        for i in some[own[some] & np.uint64(1) == 1].tolist():
            word = bytes(raw[starts[i] : ends[i]])
            if known.setdefault((int(out[i]), word), self.words[out[i]] == word) is False:
                out[i] = -1
        return out


@dataclass
class Items:
    """Items of a block: their ids, and the terms of each with how often it has them."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: Vocabulary

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        numbers: dict[bytes, int] = {}
        ids, terms, times = [], [], []
        for item, text in rows:
            own = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
            t, n = np.unique(np.array(own, np.int64), return_counts=True)
            if len(t):
                ids.append(item)
                terms.append(t)
                times.append(n.astype(np.int64))
        return cls(ids, terms, times, Vocabulary(list(numbers)))


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    for b in range(n):
        yield Items.of([(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).collect()])


def forward(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (those of the vocabulary) of each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        def work(column):
            texts = Texts(column)
            data = LOWER[texts.data]
            starts, ends, first = word_spans(data, texts.offsets, ALNUM)
            number = sent.value.find(data, starts, ends)
            at = np.flatnonzero(number >= 0)
            doc, size = np.searchsorted(first, at, "right") - 1, max(1, len(sent.value.words))
            keys, counts = np.unique(doc * size + number[at], return_counts=True)
            lengths = np.bincount(keys // size, minlength=len(texts))
            return [pa.array(np.diff(first), pa.int64()), list_array((keys % size).astype(np.int32), lengths, pa.int32()), list_array(counts.astype(np.int32), lengths, pa.int32())]

        return work

    return map_texts(docs, F.col(text_col), {"doc_id": F.col(id_col).cast("long")}, "n long, terms array<int>, counts array<int>", make)


def holders(index: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for row in index.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms of a block
        out[row.term] = row.n
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Shard:
    """Documents with their forward index, and for each term the documents in the order of impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, n_docs: int, total: int):
        """ids in ascending order; sizes: how many of the terms and counts each document has."""
        self.ids, self.terms = ids, terms
        self.start = np.r_[0, np.cumsum(sizes)]
        m = 100 - BY_LENGTH + BY_LENGTH * n * n_docs // max(1, total)
        self.impact = weight[terms] * (UNIT * counts // (COUNT * counts + LENGTH * np.repeat(m, sizes)))
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((-self.impact, terms))
        self.by_impact, self.sorted = doc[order], self.impact[order]
        self.lists = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.read = self.looked_up = 0

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores of documents, looked up in the forward index; asked: how often the item has each term."""
        lo, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        upto = np.cumsum(size)
        at = np.arange(upto[-1]) + np.repeat(lo - (upto - size), size)
        held = np.r_[0, np.cumsum(self.impact[at] * asked[self.terms[at]])]
        self.looked_up += len(docs)
        return held[upto] - held[upto - size]

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents of an item with a score of `floor` or more, the best first, ties to the smaller place."""
        asked = np.zeros(len(self.lists) - 1, np.int64)
        asked[terms] = times
        lo, hi = self.lists[terms], self.lists[terms + 1]
        met = np.zeros(len(self.ids), bool)
        best, score = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, STEP
        while True:
            a, b = np.minimum(lo + depth, hi), np.minimum(lo + depth + step, hi)
            depth, step = depth + step, step * 2
            new = np.unique(np.concatenate([self.by_impact[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
            self.read += int((b - a).sum())
            new = new[~met[new]]
            met[new] = True
            if len(new):
                own = self.scores(new, asked)
                held = own >= max(1, floor)
                best, score = np.r_[best, new[held]], np.r_[score, own[held]]
                order = np.lexsort((best, -score))[:k]
                best, score = best[order], score[order]
                if len(best) == k:
                    floor = max(floor, int(score[-1]))
            # what the next place of each list could give: nothing where a list has ended
            open_ = b < hi
            threshold = int((times[open_] * self.sorted[b[open_] - 1]).sum())
            if not open_.any() or threshold < max(1, floor):
                return best, score


def _ranked(index: DataFrame, items: Items, weight: np.ndarray, n_docs: int, total: int, k: int, id_type: T.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(index.sparkSession)
    sent = index.sparkSession.sparkContext.broadcast((items.ids, items.terms, items.times, weight))
    arrow = to_arrow_type(id_type)

    def run(batches):
        ids, terms, times, weight = sent.value
        floor = np.ones(len(ids), np.int64)
        best: list = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in ids]
        held, docs, entries = [], 0, 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            doc = table.column("doc_id")
            none = doc.is_null().to_numpy()
            number = doc.fill_null(0).to_numpy()
            order = np.lexsort((number, none))
            column = table.take(pa.array(order)).combine_chunks()
            flat = lambda c: column.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
            sizes = np.diff(column.column("terms").combine_chunks().offsets.to_numpy())
            shard = Shard(number[order], column.column("n").to_numpy(), sizes, flat("terms"), flat("counts"), weight, n_docs, total)
            none = none[order]
            for i in range(len(ids)):
                place, score = shard.search(terms[i], times[i], k, int(floor[i]))
                if len(place):
                    d, s, z = (np.r_[x, y] for x, y in zip(best[i], (shard.ids[place], score, none[place]), strict=True))
                    top = np.lexsort((d, z, -s))[:k]
                    best[i] = (d[top], s[top], z[top])
                    if len(top) == k:
                        floor[i] = best[i][1][-1]

        for batch in batches:
            at = np.r_[0, np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))]
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, lo + SHARD_DOCS - docs, int(np.searchsorted(at, at[lo] + SHARD_ENTRIES - entries, "right")) - 1)
                hi = max(hi, lo + (not held))
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    docs, entries, lo = docs + hi - lo, entries + int(at[hi] - at[lo]), hi
                if lo < batch.num_rows:
                    flush()
                    held, docs, entries = [], 0, 0
        if held:
            flush()
        of = np.repeat(np.arange(len(ids)), [len(d) for d, _, _ in best])
        d, s, z = (np.concatenate(x) for x in zip(*best, strict=True)) if best else (np.empty(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in of], arrow), pa.array(of), pa.array(d, mask=z.astype(bool)), pa.array(s)], names=["item_id", "item", "doc_id", "score"])
        give_back()

    schema = T.StructType([T.StructField("item_id", id_type), *T.StructType.fromDDL("item long, doc_id long, score long").fields])
    return index.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item, equal scores by ascending id.

    Null and empty texts have no terms: such documents are in no result, such items have none. Repeated documents are each ranked, those without
    an id after others of their score. Repeated items are one; rows of one item_id with different texts are each ranked, so their ranks
    start anew, and so do those of items without an id. With no documents or no items the result is empty; other columns are not read.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "ranked")
    id_type = items.schema[item_col].dataType
    for b, block in enumerate(_blocks(items, item_col, item_text, block_bytes)):
        at = shared_path(spark, "forward")
        forward(docs, block.vocabulary, id_col, text_col).where("n > 0").write.option("compression", "zstd").parquet(at)
        index = spark.read.schema("doc_id long, n long, terms array<int>, counts array<int>").parquet(at)
        n_docs, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = weights(n_docs, holders(index, len(block.vocabulary.words)))
        _ranked(index.where(F.size("terms") > 0), block, weight, n_docs, total, k, id_type).withColumn("block", F.lit(b)).write.mode("append").parquet(path)
    found = spark.read.parquet(path)
    place = F.row_number().over(W.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
