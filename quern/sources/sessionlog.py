"""The session log as a file of JSON lines: append, rotation, slices and reading."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition

from quern import schemas
from quern.functions import text
from quern.functions.text import is_json, parse_strict, strict_json
from quern.session import by_value
from quern.sources import ranges
from quern.sources.jsonl import exists

MAX_BYTES = 10 * 1024 * 1024
SWITCH, PATH = "QUERN_SESSION_LOG", "QUERN_SESSION_LOG_PATH"


def log_path() -> str:
    return os.environ.get(PATH) or os.path.join(os.path.expanduser("~"), ".quern", "session-log.jsonl")


def writes_disabled() -> bool:
    return os.environ.get(SWITCH) == "0"


def rotate(path: str) -> None:
    """The log becomes path.1, replacing an older one, and an empty log takes its place; nothing if there is none."""
    if os.path.exists(path):
        os.replace(path, f"{path}.1")
        open(path, "w").close()


def append(entry: dict, path: str | None = None, max_bytes: int = MAX_BYTES) -> None:
    """Adds one line in one write; fills in the time; rotates a log that is too large. Errors never reach the caller."""
    if writes_disabled():
        return
    try:
        path = path or log_path()
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        if os.path.exists(path) and os.path.getsize(path) > max_bytes:
            rotate(path)
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{datetime.now(timezone.utc).microsecond // 1000:03d}Z"
        line = json.dumps({"ts": now} | entry, ensure_ascii=False, separators=(",", ":")) + "\n"
        fd = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
        try:
            os.write(fd, line.encode())
        finally:
            os.close(fd)
    except Exception:  # noqa: BLE001  logging is best effort
        pass


def read_slice(path: str, start: int, end: int) -> str:
    """Bytes start to end of a file as text."""
    return ranges.read(path, start, end).decode("utf-8", "replace")


def parse_line(line: str) -> tuple | None:
    """A line's fields in the order of the schema after seq; null for blank lines and what is no JSON object. For sources that filter as they read."""
    try:
        e = parse_strict(line) if line.strip() else None
    except ValueError:
        return None
    if not isinstance(e, dict):
        return None
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return tuple(as_text(e.get(k)) for k in FIELDS)


FIELDS = [x.split()[0] for x in schemas.SESSION_LOG.split(", ")[1:]]


def entries(rows: DataFrame) -> DataFrame:
    """Entries of lines (seq, value), parsed without Python: what is no JSON object is left out, and what is no string comes as its JSON text."""
    parsed = rows.select("seq", "value", strict_json(F.col("value"), T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])).alias("r"))
    return parsed.where(is_json(F.col("r"), F.col("value")) & F.col("r.v").isNotNull() & F.ltrim("value").startswith("{")).select("seq", "r.v.*")


def read_log(spark: SparkSession, path: str | list[str] | None = None) -> DataFrame:
    """Entries with `seq`, which keeps the order that a file's lines were written in; corrupt lines are left out; none if the file is missing.

    A path may be a folder of logs, or there may be several.
    """
    paths = [path or log_path()] if not isinstance(path, list) else path
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schemas.SESSION_LOG)
    return entries(spark.read.option("lineSep", "\n").text(there).select(F.monotonically_increasing_id().alias("seq"), "value"))


class Recent(DataSourceReader):
    """Reads a log from its end, block by block, until as many entries as asked for have passed the filters.

    Filters are those of the options, as the log's own reading has them (entries without a time pass `since`), and those that a plan pushes down
    where the session has spark.sql.python.filterPushdown.enabled. Without a limit the log is read in parts, each by a task.
    """

    def __init__(self, options: dict):
        self.path, self.agent, self.since = options.get("path") or log_path(), options.get("agent"), options.get("since")
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.pushed: list[tuple[int, str, str]] = []

    def partitions(self):
        end = ranges.size(self.path)
        return [Part(self.path, 0, end, end)] if self.limit else [Part(self.path, a, b, end) for a, b in ranges.cuts(0, end, PART_BYTES)]

    def _passes(self, e: tuple) -> bool:
        if self.agent and e[FIELDS.index("agent")] != self.agent or self.since and e[FIELDS.index("ts")] is not None and e[FIELDS.index("ts")] < self.since:
            return False
        return all(e[i] is not None and (e[i] == v if how == "=" else e[i] >= v) for i, how, v in self.pushed)

    def read(self, part):
        n = 0
        rows = ranges.lines_back(part.path, part.end) if self.limit else (x for offsets, lines in ranges.lines(part.path, part.start, part.stop, part.end) for x in zip(offsets, lines, strict=True))
        for at, line in rows:
            e = parse_line(line.decode("utf-8", "replace"))
            if e is not None and self._passes(e):
                yield at, *e
                n += 1
                if n == self.limit:
                    return


class PushedRecent(Recent):
    """Takes filters of a plan as well; Spark refuses such readers where pushdown is off."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThanOrEqual)) and len(f.attribute) == 1 else None
            if self.limit is None and name in FIELDS and isinstance(f.value, str):
                self.pushed.append((FIELDS.index(name), "=" if isinstance(f, EqualTo) else ">=", f.value))
            else:
                yield f


#: Bytes of a part that one task reads.
PART_BYTES = 16 << 20


@dataclass
class Part(InputPartition):
    """Lines of a file that begin from start to stop - 1; `base` goes before the place of each."""

    path: str
    start: int
    stop: int
    end: int
    base: int = 0


class RecentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log_recent"

    def schema(self) -> str:
        return schemas.SESSION_LOG

    def reader(self, schema) -> Recent:
        return (PushedRecent if self.options.get("pushed") == "true" else Recent)(self.options)


def read_recent(spark: SparkSession, path: str | None = None, limit: int | None = None, agent: str | None = None, since: str | None = None) -> DataFrame:
    """The last `limit` entries of one log that pass the filters, last written first; only the blocks at its end are read that hold them. `seq` is the place in the file.

    Without a limit all that pass, in parts read side by side.
    """
    with by_value(sys.modules[__name__], ranges, schemas, text):
        spark.dataSource.register(RecentSource)
    given = {"path": path or log_path(), "agent": agent, "since": since, "limit": limit, "pushed": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    rows = spark.read.format("session_log_recent").options(**{k: str(v) for k, v in given.items() if v}).load()
    return rows.orderBy(F.desc("seq"))


def from_table(df: DataFrame) -> DataFrame:
    """Entries with the time filled in where there is none; the session's time zone must be UTC."""
    return df.withColumn("ts", F.coalesce("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
