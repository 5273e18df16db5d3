"""Column helpers that give JavaScript's string results where Spark's own functions differ."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that JavaScript's trim and \s take, beyond the ASCII ones of Java's \s.
SPACE = r"[\s\x0B\p{Z}\uFEFF]"
#: The same in Python's notation.
PYTHON_SPACE = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def trim(c: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def length16(c: Column) -> Column:
    """Length in UTF-16 units; `length` counts code points."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def ceil_quarter(n: Column) -> Column:
    return F.ceil(n / F.lit(4)).cast("long")


def estimate(c: Column) -> Column:
    """Heuristic token count of a string: a quarter of its length, rounded up; 0 for null."""
    return ceil_quarter(F.coalesce(F.length(c), F.lit(0)))


def pad_end(c: Column, n: int) -> Column:
    """Blanks up to n characters; longer strings stay whole."""
    return F.rpad(c, F.greatest(F.lit(n), F.length(c)), F.lit(" "))


def pad_start(c: Column, n: int, fill: str = "0") -> Column:
    return F.lpad(c, F.greatest(F.lit(n), F.length(c)), F.lit(fill))


def last(a: Column, n: int) -> Column:
    """The last n entries of an array, or all of a shorter one."""
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), n)


def or_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def terms(c: Column, least: int = 3) -> Column:
    """Lower-cased words of [a-z0-9-] with at least `least` characters; repeats stay."""
    clean = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) >= least)


def key_terms(c: Column) -> Column:
    """The first five terms of five or more characters."""
    return F.slice(terms(c, 5), 1, 5)


def without_suffix(path: Column) -> Column:
    """The path less its first ".md"."""
    return F.regexp_replace(path, r"^(.*?)\.md", "$1")


def title_of(path: Column) -> Column:
    """The last path segment with blanks for hyphens and each ASCII word's first character in upper case."""
    name = F.translate(F.element_at(F.split(without_suffix(path), "/"), -1), "-", " ")
    parts = F.split(name, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def category_of(path: Column) -> Column:
    return F.element_at(F.split(without_suffix(path), "/"), 1)


def short_path(path: Column) -> Column:
    """The last two segments of a path of more than two, else the path as it is; both slashes separate."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.when(F.size(parts) > 2, F.concat(F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))).otherwise(path)


def count_words(c: Column, words: str) -> Column:
    """Occurrences of whole ASCII words, in either case; words is an alternation."""
    return F.regexp_count(c, F.lit(rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"))


#: Most decimals of `fixed`: ten to this power has 24 bits.
MOST_DECIMALS = 7


def fixed(c: Column, digits: int) -> Column:
    """The number with so many decimals, its exact binary value rounded, halves away from zero; from 1e21 on with an exponent.

    The fraction f is cut in two halves of 26 bits, so that their products with a power of ten are exact, and the first one's distance from
    a half is compared with the second.
    """
    if not 0 <= digits <= MOST_DECIMALS:
        raise ValueError(f"0 to {MOST_DECIMALS} decimals")
    x = F.abs(c.cast("double"))
    ten = float(10**digits)
    known = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  a name for a value

    def rounded(whole: Column, f: Column) -> Column:
        t = f * float((1 << 27) + 1)
        return known(t - (t - f), lambda high: known(F.floor(high * ten), lambda n: n + F.when(high * ten - n - 0.5 >= -((f - high) * ten), 1).otherwise(0)))

    def shown(n: Column) -> Column:
        if not digits:
            return n.cast("string")
        text = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(digits + 1)), F.lit("0"))
        return known(text, lambda t: F.concat(F.left(t, F.length(t) - digits), F.lit("."), F.right(t, F.lit(digits))))

    # a whole part beyond 63 bits is taken in two
    high = F.floor(x / float(1 << 32))
    whole = F.floor(x - high.cast("double") * float(1 << 32)).cast("decimal(20,0)") + high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    small = known(F.floor(x), lambda n: rounded(n, x - n.cast("double")).cast("decimal(20,0)") + n.cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(8,0)"))
    number = F.when(x < float(1 << 53), shown(small)).otherwise(shown(whole * F.lit(10**digits).cast("decimal(8,0)")))
    large = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E", "e+")
    return F.concat(F.when(c.cast("double") < 0, "-").otherwise(""), F.when(F.isnan(x), "NaN").when(x < 1e21, number).otherwise(large))


def half_up(c: Column) -> Column:
    """The nearest whole number, halves up, also those below zero; what lies just below a half goes down."""
    return F.floor(c) + F.when(c - F.floor(c) >= 0.5, 1).otherwise(0)


def bar(value: Column, cells: int) -> Column:
    full = half_up(value * cells).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))


def percent(value: Column) -> Column:
    return F.concat(fixed(value * 100, 0), F.lit("%"))


def _refuse(name: str):
    raise ValueError(name)


def parse_strict(line: str):
    """JSON as its standard has it; ValueError for NaN, Infinity and all that is no JSON. The last of repeated keys wins."""
    return json.loads(line, parse_constant=_refuse)


def minified(line: str | None) -> str | None:
    """The line as minified JSON, null if it is none."""
    try:
        return None if line is None else json.dumps(parse_strict(line), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


def canonical_json(c: Column | str) -> Column:
    return F.udf(minified, "string")(c)


_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false"}
#: A field behind the value holds the line's hash, which tells that the value ended where the line does.
_END = "end of line"


def strict_json(line: Column, schema: T.StructType) -> Column:
    """A line's JSON as `v` of the schema, null for other values than objects; see `is_json`. The last of repeated keys wins.

    The line stands twice, once in an array: what is no single value cannot be well-formed in both places.
    """
    whole = T.StructType([T.StructField("v", schema), T.StructField("w", T.ArrayType(T.StringType())), T.StructField(_END, T.LongType())])
    some = F.trim(F.regexp_replace(line, "\r$", "")) != ""
    return F.from_json(F.when(some, F.concat(F.lit('{"v":'), line, F.lit(',"w":['), line, F.lit(f'],"{_END}":'), F.xxhash64(line).cast("string"), F.lit("}"))), whole, _STRICT)


def is_json(parsed: Column, line: Column) -> Column:
    """Whether the line that `strict_json` parsed was JSON and nothing else."""
    return F.coalesce((parsed[_END] == F.xxhash64(line)) & (F.size(parsed["w"]) == 1), F.lit(False))


def semver(c: Column) -> Column:
    """(major, minor, patch) of a name that starts with such; zeros otherwise."""
    part = lambda i: F.coalesce(F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)", i).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(ts: Column) -> Column:
    """ISO 8601 with milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts, ISO)


STRINGS = T.ArrayType(T.StringType())
