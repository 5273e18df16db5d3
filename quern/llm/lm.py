"""Language-model scoring with a log-frequency Bloom filter.

Bigram counts of the training texts are quantised to levels of a logarithmic scale; an n-gram of level q is entered
q times, as (n-gram, 1) ... (n-gram, q). Who holds the filter finds a count by probing levels upwards until one is missing.
A bigram's probability is smoothed with that of its last token:
    P(w | h) = (c(h w) + K * P1(w)) / (c(h) + K),  P1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)).
The filter holds all bigrams, so its size follows their number. It consists of segments named by the first bits of a key. The first
ones, as many as a broadcast may hold, are on every worker; probes of the others are sent, packed, to the task that holds the
segment, which answers them from the same bits, and their sums come back. So a score does not depend on how much is broadcast. Words
have exact counts: the most frequent are on every worker, the rest at their shard, where their bigrams are sent as well. For
that the logarithm is taken apart: log P(w | h) = log K P1(w) - log(c(h) + K) + the gain log(1 + c(h w) / (K * P1(w))), which
is 0 for unseen bigrams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import LOWER, SOLID, Texts, bounded_batches, chunks, crc_remainder, freed_shuffles, give_back, list_array, mix, remove_path, shared_path, word_hashes, word_spans

FOLDS, HELD_OUT = 5, 1
#: Words with exact counts on every worker: a bound of what is broadcast.
EXACT_WORDS = 1 << 18
#: Filter: bits in a segment, most segments that are broadcast (8 MB in all), bits for each entry, probes (three in each of two words), base of the levels.
SEGMENT_BITS, SEGMENTS, ENTRY_BITS, PROBES, BASE = 20, 64, 10, 6, 1.5
SMOOTHING = 30.0
END, START = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end token after its words, and the first token of each text (one more entry)."""
    texts = Texts(column)
    data = LOWER[texts.data]
    starts, ends, first = word_spans(data, texts.offsets, SOLID)
    n = len(texts)
    out = np.empty(len(starts) + n, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = word_hashes(data, starts, ends)
    out[first[1:] + np.arange(n)] = END
    return out, first + np.arange(n + 1)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


#: High bits of a word that all bigrams share that end in it, if it is not on the workers; they name the segment and the shard.
_WORD_BITS = 24
#: Bits of a key that are sent to its segment, and that the probes come from. Two of a segment's 100,000 entries are hardly ever alike in them.
_LOW = np.uint64((1 << 32) - 1)


def first_bits(keys: np.ndarray, power: int) -> np.ndarray:
    """The first `power` bits of keys as a number."""
    return (keys >> np.uint64(64 - power) if power else np.zeros(len(keys), np.uint64)).astype(np.int64)


def _bigrams(tokens: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (token before, token), and the place of the token before; -1 for START, which a text's first token follows.

    A key's lowest bit tells whether the last word is `known`, one of those with counts on each worker; if it is not, the
    key has the word's high bits.
    """
    at = np.arange(-1, len(tokens) - 1)
    at[first[:-1]] = -1
    before = np.where(at >= 0, tokens[at], START)
    keys = mix(before * _A + tokens * _B)
    shift = np.uint64(64 - _WORD_BITS)
    keys = np.where(known, keys, (tokens >> shift << shift) | (keys & np.uint64((1 << 64 - _WORD_BITS) - 1)))
    return (keys & ~np.uint64(1)) | known.astype(np.uint64), at


class _Counter:
    """Counts of keys, added up within a task; a bounded number of keys is held."""

    MOST = 2_000_000

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        return self.take() if self.held > self.MOST else ()

    def take(self):
        if not self.held:
            return
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts, self.held = [], [], 0
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.add.reduceat(counts[order], at)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at[i : i + 50_000]].view(np.int64)), pa.array(counts[i : i + 50_000].astype(np.int64))], names=["k", "c"])


def _counts(texts: DataFrame, keys_of, near: bool = False) -> DataFrame:
    """(k, c) over all texts of the one column `t`; keys_of gives the keys of a chunk. `near`: keys with the same first bits come together."""
    bounded_batches(texts.sparkSession)

    def run(batches):
        counter = _Counter()
        for batch in batches:
            column = batch.column(0)
            for lo, hi in chunks(column):
                yield from counter.add(keys_of(column.slice(lo, hi - lo)))
        yield from counter.take()
        give_back()

    parts = texts.mapInArrow(run, "k long, c long")
    if not near:
        return parts.groupBy("k").agg(F.sum("c").alias("c"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(_WORD_BITS, n.bit_length() + 4)
    # dealt out by the first bits, which group the keys as well, so that a segment's keys are in few files
    return parts.withColumn("b", F.shiftrightunsigned("k", 64 - bits)).repartition(n, "b").groupBy("b", "k").agg(F.sum("c").alias("c")).select("k", "c")


def _written(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """As `cut`, in compressed columns below a path that is added to `paths`."""
    spark = df.sparkSession
    paths.append(shared_path(spark, name))
    df.write.option("compression", "zstd").parquet(paths[-1])
    return spark.read.parquet(paths[-1])


def _least_count(counts: DataFrame, most: int, steps: int = 4) -> int:
    """The least count such that at most `most` keys have it, from a histogram of at most 64 * steps rows."""
    bins = counts.groupBy(F.floor(F.log2("c") * steps).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, total = 1 << 62, 0
    for row in sorted(bins, key=lambda r: -r.b):
        total += row.n
        if total > most:
            break
        least = row.c
    return least


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for; level 0 is 0, level 1 is 1."""
    return np.where(q <= 0, 0.0, np.where(q == 1, 1.0, BASE ** (q - 0.5)))


class Filter:
    """Segments of bits, a row for each; the probes of one level lie in two words of 64 bits of a key's segment."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray, levels: np.ndarray | int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Two words within the segment, each with the bits of half of the probes."""
        x = mix((keys & _LOW) + np.asarray(levels, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        one, six, out = np.uint64(1), np.uint64(63), []
        for half in range(2):
            bits = one << (x >> np.uint64(18 * half) & six)
            for t in range(1, PROBES // 2):
                bits |= one << (x >> np.uint64(18 * half + 6 * t) & six)
            out.append((x >> np.uint64(36 + 14 * half) & np.uint64((1 << SEGMENT_BITS - 6) - 1), bits))
        return out

    def levels(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The level of each key, whose segment is in the row: membership is probed from 1 upwards until it fails."""
        out = np.zeros(len(keys), np.int64)
        alive, q = np.arange(len(keys)), 0
        while len(alive) and q <= 200:
            q += 1
            held = np.logical_and(*(self.words[rows, at.astype(np.int64)] & bits == bits for at, bits in self.places(keys, q)))
            alive, keys, rows = alive[held], keys[held], rows[held]
            out[alive] = q
        return out


def _segments_of(batches, power: int):
    """Bits of the segments that rows (k, c) have keys in; other tasks may have bits of the same ones."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        keys, q = batch.column(0).to_numpy().view(np.uint64), level(batch.column(1).to_numpy())
        where = first_bits(keys, power)
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0, True]) if len(order) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = order[a:b]
            k, n = keys[own], q[own]
            words = held.setdefault(int(where[own[0]]), np.zeros(1 << SEGMENT_BITS - 6, np.uint64))
            for at, bits in Filter.places(np.repeat(k, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1):
                np.bitwise_or.at(words, at, bits)
    for s, words in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([words.tobytes()], pa.binary())], names=["s", "bits"])
    give_back()


def power_of(entries: int) -> int:
    """Segments for so many entries, as a power of two."""
    power = 0
    while power < _WORD_BITS and (1 << power) << SEGMENT_BITS < entries * ENTRY_BITS:
        power += 1
    return power


@dataclass
class Model:
    """Counts of the most frequent words, the first segments of the filter of all bigrams, and how many it has, as a power of two."""

    total: int
    distinct: int
    starts: int
    words: np.ndarray
    counts: np.ndarray
    power: int
    filter: Filter


def train(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame, list[str]]:
    """The model of all texts of the one column `t`, the exact counts (k, c) of the words that it does not hold, the segments (s, bits) of the filter, and folders to remove."""
    paths: list[str] = []
    unigrams = _written(_counts(texts, lambda column: tokens_of(column)[0]), "words", paths)
    ends = F.sum(F.when(F.col("k") == int(END.view(np.int64)), F.col("c")))
    total, distinct, starts = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(ends, F.lit(0))).first()
    known = F.col("c") >= _least_count(unigrams, EXACT_WORDS)
    got = unigrams.where(known).toArrow()
    k, c = got.column("k").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(k)
    words, counts = k[order], c[order]
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def pairs(column):
        tokens, first = tokens_of(column)
        return _bigrams(tokens, first, _find(sent.value, tokens) >= 0)[0]

    bigrams = _written(_counts(texts, pairs, near=True), "bigrams", paths)
    q = F.floor(F.log("c") / math.log(BASE) + 1e-9) + 1
    power = power_of(bigrams.agg(F.coalesce(F.sum(q), F.lit(0))).first()[0])
    segments = _written(bigrams.mapInArrow(lambda batches: _segments_of(batches, power), "s long, bits binary"), "segments", paths)
    remove_path(texts.sparkSession, paths.pop(1))  # the counts are in the filter now
    bits = np.zeros((min(1 << power, SEGMENTS), 1 << SEGMENT_BITS - 6), np.uint64)
    for row in segments.where(F.col("s") < len(bits)).toLocalIterator():  # what is broadcast: SEGMENTS rows of 128 KB, in a few parts each
        bits[row.s] |= np.frombuffer(row.bits, np.uint64)
    return Model(total, distinct, starts, words, counts, power, Filter(bits)), unigrams.where(~known), segments, paths


# What a row of the shards' exchange is; the rows of a shard come in this order.
_WORDS, _SEGMENTS, _ROWS, _ASKED, _ASKED_WORDS = range(5)
_FIELDS = [("kind", pa.int32()), ("shard", pa.int32()), ("home", pa.int64()), *((name, pa.binary()) for name in ("k", "p", "c", "off", "times"))]
#: Bytes that an entry has in a binary column: words by their hashes and bigrams by the low bytes of their keys, counts, places in the
#: home, and how often an entry is asked for. A segment's row has its bits as k.
_WIDTHS = {"k": 8, "p": 4, "c": 8, "off": 2, "times": 4}
#: Rows are numbered; those with equal high bits are one home, to which sums return.
_HOME_BITS = 12
#: Homes whose sums a task holds before it sends them on.
_HOMES = 400
_EXCHANGE = "kind int, shard int, home long, k binary, p binary, c binary, off binary, times binary"


def _bytes(values: np.ndarray, name: str, edges: np.ndarray) -> pa.Array:
    """Values as one binary for each run between the edges: the first byte of all, then the second, and so on, as the higher ones are mostly zero."""
    data = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8)[:, : _WIDTHS[name]]
    return pa.array([data[a:b].T.tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())


def _values(column: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned values of all runs one after the other, and the length of each run."""
    runs = [np.frombuffer(x, np.uint8).reshape(_WIDTHS[name], -1) for x in column.to_pylist()]
    out = np.zeros((sum(x.shape[1] for x in runs), 8), np.uint8)
    if len(out):
        out[:, : _WIDTHS[name]] = np.concatenate(runs, axis=1).T
    return out.view(np.uint64).reshape(-1), np.array([x.shape[1] for x in runs], np.int64)


def _packed(kind: int, shard: np.ndarray, home: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each run of one shard and home, with lists of its entries."""
    at = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (home[1:] != home[:-1])]) if len(shard) else np.empty(0, np.int64)
    n, edges = len(at), np.r_[at, len(shard)]
    own = {"kind": pa.array(np.full(n, kind, np.int32)), "shard": pa.array(shard[at].astype(np.int32)), "home": pa.array(home[at].astype(np.int64))}
    if "off" in columns:  # as steps within a run
        step = np.diff(columns["off"], prepend=0)
        step[at] = columns["off"][at]
        columns["off"] = step
    own |= {name: _bytes(x.astype(np.int64, copy=False) if x.dtype != np.uint64 else x, name, edges) for name, x in columns.items()}
    return pa.RecordBatch.from_arrays([own.get(name, pa.nulls(n, t)) for name, t in _FIELDS], names=[name for name, _ in _FIELDS])


#: Entries that are packed at once.
_PACK = 600_000


def _pack_words(counts: DataFrame, power: int) -> DataFrame:
    """Rows (k, c) of words as rows of the exchange."""

    def flush(keys, c):
        shard = first_bits(keys, power)
        order = np.argsort(shard, kind="stable")
        return _packed(_WORDS, shard[order], np.zeros(len(order), np.int64), k=keys[order], c=c[order])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= _PACK:
                yield flush(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield flush(*map(np.concatenate, zip(*held, strict=True)))

    return counts.select("k", "c").mapInArrow(run, _EXCHANGE)


class _Asked:
    """Entries that wait to be packed: their rows, keys, and the last words or, of known ones, their counts."""

    def __init__(self, kind: int, power: int):
        self.kind, self.power, self.held, self.n = kind, power, [], 0

    def add(self, row: np.ndarray, key: np.ndarray, beside: np.ndarray):
        self.held.append((row, key, beside))
        self.n += len(row)
        if self.n >= _PACK:
            yield self.take()

    def take(self) -> pa.RecordBatch:
        row, key, beside = map(np.concatenate, zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.held, self.n = [], 0
        shard = first_bits(key, self.power)
        order = np.lexsort((key, row, shard))
        shard, row, key, beside = shard[order], row[order], key[order], beside[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (beside[1:] != beside[:-1])]) if len(key) else np.empty(0, np.int64)
        times = np.diff(np.r_[new, len(key)]).astype(np.int32)
        shard, row, key, beside = shard[new], row[new], key[new], beside[new]
        columns = {"p": key, "c": beside} if self.kind == _ASKED else {"k": beside, "p": key}
        return _packed(self.kind, shard, row >> _HOME_BITS, off=row & (1 << _HOME_BITS) - 1, times=times, **columns)


class _Shards:
    """Answers to the entries of the shards whose rows pass by: sums of each home, of known, logs and parts."""

    def __init__(self, mass: float):
        self.mass, self.now = mass, None
        self.homes: dict[int, np.ndarray] = {}

    def turn(self, shard: int) -> None:
        if shard != self.now:
            self.now, self.words, self.table, self.filter = shard, [], None, Filter(np.zeros((1, 1 << SEGMENT_BITS - 6), np.uint64))

    def learn(self, kind: int, part: pa.RecordBatch) -> None:
        if kind == _WORDS:
            self.words.append((_values(part.column("k"), "k")[0], _values(part.column("c"), "c")[0].astype(np.float64)))
            return
        for bits in part.column("k"):
            self.filter.words[0] |= np.frombuffer(bits.as_buffer(), np.uint64)

    def count(self, words: np.ndarray) -> np.ndarray:
        """Count of each word, 0 where missing."""
        if self.table is None:
            k, c = map(np.concatenate, zip(*self.words, strict=True)) if self.words else (np.empty(0, np.uint64), np.empty(0))
            order = np.argsort(k)
            self.table = (k[order], c[order])
        k, c = self.table
        at = _find(k, words)
        return np.where(at >= 0, c[at], 0.0) if len(k) else np.zeros(len(words))

    def bigrams(self, keys: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What the filter gives as counts of bigrams, at most those of their last words."""
        return np.minimum(count_of(self.filter.levels(keys, np.zeros(len(keys), np.int64))), most)

    def answer(self, kind: int, part: pa.RecordBatch) -> None:
        flat = lambda name: _values(part.column(name), name)[0]
        step, sizes = _values(part.column("off"), "off")
        times, pair = flat("times").astype(np.float64), flat("p")
        if kind == _ASKED:
            count = flat("c").astype(np.float64)
            known, logs, follows = None, None, 0.0
        else:
            key = flat("k")
            count = self.count(key)
            known = np.where(count > 0, times, 0.0)
            logs = times * (np.log10(count + 0.5) - math.log10(0.5))
            follows = np.where(key == END, 0.0, times * (np.log10(count + SMOOTHING) - math.log10(SMOOTHING)))
        parts = times * np.log10(1 + self.bigrams(pair, count) * self.mass / (SMOOTHING * (count + 0.5))) - follows
        homes, of = np.unique(part.column("home").to_numpy(), return_inverse=True)
        cell = (np.repeat(of, sizes) << _HOME_BITS) + _offsets(step, sizes)
        width = 1 << _HOME_BITS
        for i, x in enumerate((known, logs, parts)):
            if x is not None:
                for home, own in zip(homes.tolist(), np.bincount(cell, weights=x, minlength=len(homes) * width).reshape(-1, width), strict=True):
                    self.homes.setdefault(home, np.zeros((3, width)))[i] += own

    def take(self, most: int):
        """The sums so far as rows for their homes, if they are of more than `most` homes."""
        if len(self.homes) <= most:
            return
        homes, off, sums = [], [], []
        for home, own in self.homes.items():
            at = np.flatnonzero(own.any(axis=0))
            homes.append(np.full(len(at), home))
            off.append(at)
            sums.append(own[:, at])
        self.homes = {}
        home = np.concatenate(homes)
        at = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else np.empty(0, np.int64)
        yield home[at], np.diff(np.r_[at, len(home)]), np.concatenate(off), np.concatenate(sums, axis=1)


def _offsets(step: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Offsets from steps within runs of the given sizes."""
    step = step.astype(np.int64)
    upto, start = np.cumsum(step), np.cumsum(sizes) - sizes
    some = sizes > 0
    return upto - np.repeat(upto[start[some]] - step[start[some]], sizes[some])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on rows whose crc32(doc_id as text) mod 5 is not 1; rows without an id are scored but not learnt from.
    base_score uses exact counts of all words, told apart by 64-bit hashes. score uses the filter's counts of bigrams, at most those of their
    last words: about one in a hundred unseen ones is found, and a level is as far as the root of BASE from its count, so a probability may
    pass 1 a little; a text's score is then 0 at most. Null and empty texts hold the end token alone. Repeated rows are each learnt
    from and returned; columns but id and text are not read. Without training rows every probability is 1. The result is
    written to the shared folder, and what led to it is removed.
    """
    spark = docs.sparkSession
    held_out = crc_remainder(F.col(id_col), FOLDS) == HELD_OUT
    with freed_shuffles(spark):
        model, words, segments, paths = train(docs.where(~held_out).select(F.col(text_col).cast("string").alias("t")))
        rows = _asked(docs, held_out, model, words, segments, id_col, text_col)
        base = F.col("logs") - F.col("n_tokens") * math.log10(_mass(model))
        whole = F.least(F.lit(0.0), base + F.col("parts"))
        done = rows.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"))
        done = _written(done, "scores", [])
    for path in paths:
        remove_path(spark, path)
    return done


def _mass(model: Model) -> float:
    return model.total + 0.5 * (model.distinct + 1)


def _asked(docs: DataFrame, held_out: Column, model: Model, words: DataFrame, segments: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, n_tokens, known, logs (of known words' counts; half for the unknown) and parts (all else) of each row."""
    spark = docs.sparkSession
    sent, mass = spark.sparkContext.broadcast(model), _mass(model)
    power = model.power
    bounded_batches(spark)
    inner = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("t"))
    about = [T.StructField(c, inner.schema[c].dataType) for c in ("row", "doc_id", "held_out")]
    sums = T.StructType.fromDDL("n_tokens long, known long, logs double, parts double").fields
    schema = T.StructType([*T.StructType.fromDDL(_EXCHANGE).fields, *about, *sums])
    names = schema.names

    def work(column, row):
        """Sums of the texts, and entries (row, key, count) of bigrams and (row, key, word) of words to be asked for."""
        m = sent.value
        tokens, first = tokens_of(column)
        n, doc = np.diff(first), np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = _find(m.words, tokens)
        known = at >= 0
        count = np.zeros(len(tokens), np.int64)
        count[known] = m.counts[at[known]]
        total = lambda which, w=None: np.bincount(doc[which], weights=w, minlength=len(n))
        pairs, before = _bigrams(tokens, first, known)
        # an unknown word counts as unseen here; what it adds as a context is asked for with it
        context = np.where(before >= 0, count[before], m.starts)
        segment = first_bits(pairs, m.power)
        here = known & (segment < len(m.filter.words))
        local, away = np.flatnonzero(here), np.flatnonzero(known & ~here)
        distinct, one, back = np.unique(pairs[local], return_index=True, return_inverse=True)
        q = m.filter.levels(distinct, segment[local[one]])[back]
        gains = np.log10(1 + np.minimum(count_of(q), count[local]) * mass / (SMOOTHING * (count[local] + 0.5)))
        parts = total(slice(None), math.log10(SMOOTHING) - np.log10(context + SMOOTHING)) + total(local, gains)
        logs = total(slice(None), np.log10(count + 0.5))
        rest = np.flatnonzero(~known)
        return (n, total(known).astype(np.int64), logs, parts), (row[doc[away]], pairs[away], count[away]), (row[doc[rest]], pairs[rest], tokens[rest])

    def out(batch, own, sums):
        """A batch of the exchange: packed entries, or the texts' own rows."""
        n = batch.num_rows if own is None else len(sums[0])
        left = batch.columns if own is None else [pa.array(np.full(n, _ROWS, np.int32)), pa.array(first_bits(mix((np.asarray(own[0]) >> _HOME_BITS).astype(np.uint64)), power).astype(np.int32)), pa.array(np.asarray(own[0]) >> _HOME_BITS), *(pa.nulls(n, t) for _, t in _FIELDS[3:])]
        right = [pa.nulls(n, t) for t in kinds] if own is None else [*own, *(pa.array(x, t) for x, t in zip(sums, kinds[3:], strict=True))]
        return pa.RecordBatch.from_arrays([*left, *right], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in [*about, *sums]]

    def ask(batches):
        asked, asked_words = _Asked(_ASKED, power), _Asked(_ASKED_WORDS, power)
        for batch in batches:
            for lo, hi in chunks(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                sums, pairs, rest = work(part.column(3), part.column(0).to_numpy())
                yield out(None, part.columns[:3], sums)
                for packed in (*asked.add(*pairs), *asked_words.add(*rest)):
                    yield out(packed, None, None)
        for x in (asked, asked_words):
            yield out(x.take(), None, None)
        give_back()

    told = names[len(_FIELDS) :]
    returned = T.StructType([*schema.fields[len(_FIELDS) :], *T.StructType.fromDDL("home long, own int, off array<int>, more array<int>, logs2 array<double>, parts2 array<double>").fields])

    def answer(batches):
        tables = _Shards(mass)
        lists = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]

        def sent_on(most):
            for home, sizes, off, sums in tables.take(most):
                n = len(home)
                columns = [list_array(x, sizes, t.value_type) for x, t in zip((off, *sums), lists, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in kinds), pa.array(home), pa.array(np.zeros(n, np.int32)), *columns], names=returned.names)

        for batch in batches:
            kind, shard = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (shard[1:] != shard[:-1]), True]) if len(kind) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own, part = int(kind[lo]), batch.slice(lo, hi - lo)
                tables.turn(int(shard[lo]))
                if own in (_WORDS, _SEGMENTS):
                    tables.learn(own, part)
                elif own == _ROWS:
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in told), part.column("home"), pa.array(np.ones(n, np.int32)), *(pa.nulls(n, t) for t in lists)], names=returned.names)
                else:
                    tables.answer(own, part)
                    yield from sent_on(_HOMES)
        yield from sent_on(0)
        give_back()

    def add(batches):
        """The rows of each home with their sums, which come before them."""
        now, sums = None, None
        for batch in batches:
            home, own = batch.column("home").to_numpy(), batch.column("own").to_numpy()
            edges = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (own[1:] != own[:-1]), True]) if len(home) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if home[lo] != now:
                    now, sums = home[lo], np.zeros((3, 1 << _HOME_BITS))
                if own[lo]:
                    at = part.column("row").to_numpy() & (1 << _HOME_BITS) - 1
                    known, logs, parts = (part.column(x).to_numpy() + y[at] for x, y in zip(told[-3:], sums, strict=True))
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in told[1:4]), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(parts)], names=told[1:])
                else:
                    at = part.column("off").flatten().to_numpy()
                    for i, x in enumerate(("more", "logs2", "parts2")):
                        sums[i] += np.bincount(at, weights=part.column(x).flatten().to_numpy(), minlength=sums.shape[1])

    wide = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(_FIELDS) :]]
    every = inner.mapInArrow(ask, schema)
    if len(model.filter.words) < 1 << model.power or len(model.words) < model.distinct:
        own = {"kind": F.lit(_SEGMENTS), "shard": F.col("s").cast("int"), "home": F.lit(0).cast("long"), "k": F.col("bits")}
        bits = segments.select(*[own.get(name, F.lit(None).cast("binary")).alias(name) for name, _ in _FIELDS])
        every = every.unionByName(_pack_words(words, power).select("*", *wide)).unionByName(bits.select("*", *wide))
    got = every.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, returned)
    return got.repartition("home").sortWithinPartitions("home", "own").mapInArrow(add, T.StructType(schema.fields[len(_FIELDS) + 1 :]))
