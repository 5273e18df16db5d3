"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. By the pigeonhole principle two fingerprints at distance r or less
agree in some segment up to a small number of bits; the first r mod m + 1 segments are searched with
balls of radius r // m, the others with one less (none at all if that is negative). The table has each
fingerprint once for each segment, at its own value; the balls are on the side of the queries only. What
a ball meets is compared by its whole distance. Buckets return a spanning forest of their links, never
all pairs, and hot buckets are dealt to many tasks as pairs of blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, SOLID, Texts, cut, give_back, map_texts, word_spans

BITS, DISTANCE, WORDS, SEED = 64, 4, 4, 42
#: A bucket with more members is cut into blocks of this many; pairs of blocks are dealt out.
BLOCK = 8192


def _ones(hashes: np.ndarray, at: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """How often each bit is set among the hashes from each place in `at` to the next; bits are unpacked piece by piece."""
    out = np.zeros((len(at), BITS), np.int64)
    for lo in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[lo : lo + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, lo + len(bits), "left")
        out[a:b] += np.add.reduceat(bits, np.maximum(at[a:b] - lo, 0), axis=0, dtype=np.int32)
    return out


def fingerprints_of(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text; 0 for texts without words and for null."""
    texts = Texts(column)
    data = LOWER[texts.data]
    starts, ends, first = word_spans(data, texts.offsets, SOLID)
    out = np.zeros(len(texts), np.uint64)
    if not len(starts):
        return out
    keep = SOLID[data]
    lead = starts[np.setdiff1d(np.arange(len(starts)), first, assume_unique=False)] - 1
    keep[lead] = True  # one separator before each word but a text's first
    data[lead] = 0x20
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    joined, starts, ends = data[keep].tobytes(), place[starts], place[ends]
    n = np.diff(first)
    last = np.repeat(first[1:] - 1, n)
    index = np.arange(len(starts))
    is_start = (index + words - 1 <= last) | (index == np.repeat(first[:-1], n))
    index, last = index[is_start], last[is_start]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[index].tolist(), ends[np.minimum(index + words - 1, last)].tolist(), strict=True)], np.uint64)
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    full = np.flatnonzero(count)
    at = np.cumsum(count)[full] - count[full]
    bits = (2 * _ones(hashes, at) > count[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long, for each row."""
    return map_texts(docs, F.col(text_col), {"doc_id": F.col(id_col)}, "fp long", lambda: lambda c: [pa.array(fingerprints_of(c).view(np.int64))])


#: A row of the table or of a ball costs about as much as so many comparisons.
ROW_COST = 1000


def segment_plan(count: int, bits: int = BITS, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment. Their number, 2 to 4, is that with the least rows and expected comparisons; any number finds all."""

    def plan(m):
        out, shift = [], 0
        for k in range(m):
            width = bits // m + (k < bits % m)
            radius = distance // m - (k > distance % m)
            if radius >= 0:
                out.append((shift, width, radius))
            shift += width
        return out

    def cost(segments):
        balls = [(sum(math.comb(w, r) for r in range(radius + 1)), w) for _, w, radius in segments]
        return sum(n * (ROW_COST + count / 2**w) for n, w in balls)

    return min(map(plan, (4, 3, 2)), key=cost)


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _link(fps: np.ndarray, own: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of a bucket's links with the members at their `own` value, by breadth-first search over those not yet reached."""
    table, others, a, b = fps[own], fps[~own], [], []
    while len(table):
        stack, table = [(table[0], True)], table[1:]
        while stack and (len(table) or len(others)):
            u, in_table = stack.pop()
            near = np.bitwise_count(table ^ u) <= distance
            if near.any():
                stack += [(v, True) for v in table[near]]
                a += [u] * int(near.sum())
                b += list(table[near])
                table = table[~near]
            if in_table:
                near = np.bitwise_count(others ^ u) <= distance
                if near.any():
                    stack += [(v, False) for v in others[near]]
                    a += [u] * int(near.sum())
                    b += list(others[near])
                    others = others[~near]
    return a, b


#: Buckets up to this size are compared together, all members at each lag at once.
SMALL = 12


def _links_of(keys: np.ndarray, fps: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets; rows of a bucket are adjacent. `own`: at their own value, not of a ball."""
    edge = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1), True])
    size = np.diff(edge)
    a, b = [], []
    of = np.repeat(size, size)
    few = of <= SMALL
    if few.any():
        k, f, o = np.repeat(np.arange(len(size)), size)[few], fps[few], own[few]
        for lag in range(1, SMALL):
            if lag >= len(f):
                break
            hit = (k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= distance)
            hit &= (f[lag:] != f[:-lag]) & (o[lag:] | o[:-lag])
            a.append(f[:-lag][hit])
            b.append(f[lag:][hit])
    for g in np.flatnonzero(size > SMALL).tolist():
        f, at = np.unique(fps[edge[g] : edge[g + 1]], return_index=True)
        x, y = _link(f, own[edge[g] : edge[g + 1]][at], distance)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2


def _link_sorted(batches, distance: int):
    """Links of buckets from rows (k, i, j, fp, own) that arrive bucket by bucket; the last bucket of a batch waits for the next."""
    held = [np.empty((0, 3), np.int64), np.empty(0, np.uint64), np.empty(0, bool)]

    def out(*bucket):
        a, b = _links_of(*bucket, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        new = [np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)]), batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy(zero_copy_only=False)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        k = held[0]
        if not len(k):
            continue
        done = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1))
        at = done[-1] + 1 if len(done) else 0
        if at:
            yield out(*(x[:at] for x in held))
        held = [x[at:] for x in held]
    if len(held[0]):
        yield out(*held)
    give_back()


def _ball(masks: Column, value: Column, segments: int, segment: int) -> Column:
    """Keys of a ball; `own` marks the fingerprint's entry in the table, which the balls of others meet."""
    return F.transform(masks, lambda mask: F.struct((value.bitwiseXOR(mask) * F.lit(segments) + F.lit(segment)).alias("k"), (mask == 0).alias("own")))


def links(fps: DataFrame, count: int, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp`: at least a spanning forest of every group that is linked."""
    plan = segment_plan(count, BITS, distance)
    balls = []
    for s, (shift, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(x).cast("long") for x in _masks(width, radius)])
        balls.append(_ball(masks, value, len(plan), s))
    keys = fps.select("fp", F.explode(F.concat(*balls)).alias("x")).select("fp", "x.k", "x.own")
    sizes = cut(keys.groupBy("k").count().where(F.col("count") > block))
    if sizes.isEmpty():
        dealt = keys.select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "own")
    else:
        at = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        hot = keys.join(sizes.select("k", F.ceil(F.col("count") / block).cast("int").alias("n")), "k", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("at", at)
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        dealt = hot.select("k", "at", "fp", "own", other.alias("x")).select("k", F.least("at", "x").alias("i"), F.greatest("at", "x").alias("j"), "fp", "own")
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.mapInArrow(lambda batches: _link_sorted(batches, distance), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Nodes hook to their smallest neighbour, one step of pointer jumping follows, and the links are renamed
    to what is left of them, until no link joins two names. All of it stays in the cluster.
    """
    rename = None
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        step = cut(hook.join(up, "parent").select("node", "root"))
        if rename is None:
            rename = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("then"))
            rename = cut(rename.join(later, "root", "left").select("node", F.coalesce("then", "root").alias("root")))
        left, right = (step.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")) for c in "ab")
        e = e.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        e = cut(e.where("a <> b").distinct())
    return rename if rename is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint among the rows (doc_id, fp); root is the same within a component only."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    forest = connected(links(fps.select("fp"), fps.count(), distance))
    named = cut(fps.join(forest.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that a join skewed by a large component can be split
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links reach, itself included. Null and empty texts have fingerprint
    zero and are linked like any other. Null ids keep their row and never become a component's id unless all of
    its ids are null. Repeated rows are each returned. An empty table gives an empty result; other columns of
    `docs` are not read.
    """
    rows = cut(fingerprint(docs, id_col, text_col))
    of = _rooted(rows, distance)
    return rows.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of `docs` for each component, with all its columns: the one with the least id.

    Rows without an id come last. Of several rows with that id in the component, the one whose text hashes least
    stays, and of those with that text the one whose other columns come first as JSON. Components are told apart by their links, not by ids: an id used for unrelated texts stays for each.
    """
    text = F.col(text_col).cast("string")
    rows = cut(map_texts(docs, text, {"doc_id": F.col(id_col), "h": F.xxhash64(text)}, "fp long", lambda: lambda c: [pa.array(fingerprints_of(c).view(np.int64))]))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best")
    kept = rows.join(_rooted(rows, distance), "fp").groupBy("root").agg(best).select(F.col("best.doc_id").alias("_kid"), F.col("best.h").alias("_kh"))
    # a row's component follows from its text, so id and text name the component as well; whole repeats are added up to one
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]), {"ignoreNullFields": "false"})
    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), others.alias("_o"))
    own = own.join(kept, own["_id"].eqNullSafe(kept["_kid"]) & (own["_h"] == kept["_kh"]), "left_semi")
    return own.groupBy("_id", "_h").agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")
