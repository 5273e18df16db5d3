"""Secret scans in DataFrame functions only.

Three patterns give the base spans. Beside them, every run of 20 or more characters of [A-Za-z0-9+/_=-] that mixes
letters and digits is a candidate: its alphabet is its character class (hex or general), and a window of 20 characters slides over it
while the counts of its characters, and the sum of c * log2(c), are updated by the one that enters and the one
that leaves. A candidate whose largest window entropy reaches its class's threshold is a span of kind "entropy",
unless the allow-list suppresses it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, kinds in their order, thresholds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Same matches as HEX after its length filter, as runs are maximal.
HEX_LONG = r"[0-9a-f]{16,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character, of at most log2(20) = 4.32 in a window of 20.
HEX_BITS, GENERAL_BITS = 2.85, 3.65
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that match are no secrets: UUIDs, documentation examples, alphabets in order.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|dummy|sample",
    r"(?i)0123456789abcdef|abcdefghijklmnop|1234567890123456",
)


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(value: str, name: str, body: str) -> str:
    """`body` with `name` standing for the value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Matches are folded in blocks of this many, so that appending to arrays stays cheap in texts with very many.
FOLD = 1024


def _spans(text: str, pattern: str, kind: int, value: str, least: int) -> str:
    """Matches of a pattern as array<struct<s, k, e, v>>: pieces between matches and the matches themselves add up to places.

    `value` is the match's group that must have `least` characters. Texts without any match cost one search.
    """
    p, empty = _q(pattern), "cast(array() as array<struct<s:int,k:int,e:int,v:string>>)"
    step = (
        "(a, x) -> struct(a.at + length(x.`0`) + coalesce(length(x.`1`), 0) as at, "
        f"if(length(x.`2`) >= {least}, concat(a.out, array(struct(a.at + length(x.`0`) as s, {kind} as k, a.at + length(x.`0`) + length(x.`1`) as e, x.`1` as v))), a.out) as out)"
    )
    inner = f"aggregate(slice(z, {FOLD} * b + 1, {FOLD}), struct(o.at as at, {empty} as out), {step}, a -> struct(a.at as at, concat(o.out, a.out) as out))"
    fold = f"aggregate(sequence(0, (size(z) - 1) div {FOLD}), struct(0 as at, {empty} as out), (o, b) -> {inner}, o -> o.out)"
    pieces = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {value}))"
    return f"if(rlike({text}, {p}), {_bind(pieces, 'z', fold)}, {empty})"


#: c * log2(c) for the counts of a window, as integers, so that sums stay exact however far the window slides.
UNIT = 1 << 32
TERMS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]
#: Added to the place of a character that completes a window; larger than any place in ALPHABET.
FULL = 100


def _entropy(v: str) -> str:
    """The largest entropy of a window of WINDOW characters, by incremental counts; v has at least WINDOW.

    Each character is one event that enters the window, after one that leaves it once the window is full. An event is a
    place in ALPHABET: negative where it leaves, raised by FULL where it completes a window. The state holds the
    window's counts (a string with one character for each place, @ for none, A for one, ...), the sum s of their terms, and the
    least s of all full windows.
    """
    enters = f"if(i < {WINDOW - 1}, array(e), if(i = {WINDOW - 1}, array(e + {FULL}), array(-places[i - {WINDOW}], e + {FULL})))"
    events = _bind(f"transform(split({v}, ''), x -> instr('{ALPHABET}', x))", "places", f"flatten(transform(places, (e, i) -> {enters}))")
    held = f"ascii(substring(a.c, abs(d) % {FULL}, 1)) - 64"
    terms = f"array({', '.join(f'{t}L' for t in TERMS)})"
    counts = f"overlay(a.c placing char({held} + sign(d) + 64) from abs(d) % {FULL})"
    moved = f"struct({counts} as c, a.s + t[cast({held} + sign(d) as int)] - t[{held}] as s, a.least as least, d > {FULL} as whole)"
    step = _bind(moved, "m", "struct(m.c as c, m.s as s, if(m.whole, least(m.least, m.s), m.least) as least)")
    start = f"struct('{'@' * len(ALPHABET)}' as c, 0L as s, {1 << 62}L as least)"
    fold = f"aggregate({events}, {start}, (a, d) -> {step}, a -> log2({WINDOW}D) - a.least / {float(WINDOW * UNIT)}D)"
    return _bind(terms, "t", fold)


def _entropy_spans(text: str) -> str:
    every = _spans(text, CANDIDATE, KINDS.index("entropy"), "0", WINDOW)
    mixed = "rlike(x.v, '[0-9]') and rlike(x.v, '[A-Za-z]')"
    suppressed = " or ".join(f"rlike(x.v, {_q(p)})" for p in ALLOW)
    enough = f"{_entropy('x.v')} >= if(rlike(x.v, '^[0-9A-Fa-f]+$'), {HEX_BITS}D, {GENERAL_BITS}D)"
    return f"filter({every}, x -> if({mixed}, if({suppressed}, false, {enough}), false))"


def with_spans(docs: DataFrame, text: Column, name: str = "spans") -> DataFrame:
    """`docs` with an array of structs (s, k, e, v): code-point start, kind (index of KINDS), end (exclusive), match."""
    own = docs.withColumn("_qt", F.coalesce(text.cast("string"), F.lit("")))
    for k, (pattern, value, least) in enumerate(((ASSIGN, "1", 12), (ACCESS_LONG, "0", 18), (HEX_LONG, "0", 16))):
        own = own.withColumn(f"_q{k}", F.expr(_spans("_qt", pattern, k, value, least)))
    own = own.withColumn("_q3", F.expr(_entropy_spans("_qt")))
    return own.withColumn(name, F.array_sort(F.concat("_q0", "_q1", "_q2", "_q3"))).drop("_qt", "_q0", "_q1", "_q2", "_q3")


def _labels(spans: str) -> str:
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({kinds}[x.k], ':', x.s, ':', x.e)), ',')"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end, by start and then in the order of KINDS, comma-joined; base_sha256 covers the first
    three kinds. Null and empty texts have none. Repeated rows are each returned; other columns are not read.
    """
    df = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), F.col("t"), "f")
    count = lambda k: F.expr(f"cast(size(filter(f, x -> x.k = {k})) as long)")
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(_labels("filter(f, x -> x.k < 3)")).cast("binary"), 256).alias("base_sha256"), F.expr(_labels("f")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns of `docs`; every span of the text gives way to the mark, overlapping spans to one."""
    df = with_spans(docs.select(F.struct("*").alias("_row")), F.col(f"_row.`{text_col}`"), "_f").withColumn("_t", F.col(f"_row.`{text_col}`"))
    # spans are worked on in blocks, each on the piece of the text that it covers
    own, none = f"slice(_f, {FOLD} * b + 1, {FOLD})", "cast(array() as array<string>)"
    piece = f"substring(_t, o.at + 1, array_max(transform({own}, x -> x.e)) - o.at)"
    step = f"(a, x) -> struct(if(x.e <= a.at, a.out, concat(a.out, array(substring(p, a.at - o.at + 1, greatest(0, x.s - a.at)), if(x.s < a.at, '', {_q(mark)})))) as out, greatest(a.at, x.e) as at)"
    inner = _bind(piece, "p", f"aggregate({own}, struct({none} as out, o.at as at), {step}, a -> struct(concat(o.out, array(array_join(a.out, ''))) as out, a.at as at))")
    rest = "array_join(concat(o.out, array(substring(_t, o.at + 1, length(_t)))), '')"
    fold = f"aggregate(sequence(0, (size(_f) - 1) div {FOLD}), struct({none} as out, 0 as at), (o, b) -> {inner}, o -> {rest})"
    clean = F.expr(f"if(size(_f) = 0, _t, {fold})")
    return df.withColumn("_c", clean).select(*[F.col("_c").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
