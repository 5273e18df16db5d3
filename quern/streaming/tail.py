"""Tailing session logs as a stream, in byte ranges that executors read from shared storage.

Starts at the end of each log, delivers entries of complete lines exactly once (an unfinished last line waits), reads what is left of
a log that was rotated, and starts at the beginning of one that became shorter.
"""

from __future__ import annotations

import json
import sys
from datetime import datetime
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from quern import schemas
from quern.session import by_value
from quern.sources import ranges, sessionlog
from quern.sources.sessionlog import PART_BYTES, Part, entries, log_path

LINES = "seq long, value string"


def head(path: str) -> str:
    """Names a log's generation: a digest of its first line; empty before there is one."""
    line = ranges.first_line(path)
    return md5(line).hexdigest() if line else ""


def base(path: str) -> int:
    """What places in a log are counted from: the second of its first entry's time in the high half, so that the places of later generations are higher."""
    try:
        return int(datetime.fromisoformat(json.loads(ranges.first_line(path))["ts"]).timestamp()) << 32
    except (ValueError, TypeError, KeyError, OSError):
        return 0


class SessionLogReader(DataSourceStreamReader):
    """Offsets have, for each log, the generation and the end of a line in it. A rotated log is the one of the same path and ".1"."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options.get("path") or log_path()]
        self.from_start = options.get("fromstart", "false") == "true"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {p: {"head": head(p), "at": 0 if self.from_start else ranges.end_of_lines(p)} for p in self.paths}

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: {"head": head(p), "at": ranges.end_of_lines(p)} for p in self.paths}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [x for p in end for x in self._parts(p, start.get(p, {"head": "", "at": 0}), end[p])]

    def _parts(self, path: str, start: dict, end: dict) -> list[Part]:
        if start == end:
            return []
        # the newer generation may have been rotated since, as when a batch is read again
        now, old = head(path), f"{path}.1"
        of = path if now == end["head"] or head(old) != end["head"] else old
        out = []
        if start["head"] == end["head"] and start["at"] <= end["at"]:
            at = start["at"]
        else:
            at = 0
            if of == path and start["head"] and start["head"] != end["head"] and head(old) == start["head"]:
                out += self._cut(old, start["at"], ranges.end_of_lines(old))
        return out + self._cut(of, at, end["at"])

    def _cut(self, path: str, start: int, stop: int) -> list[Part]:
        first = base(path)
        return [Part(path, a, b, stop, first) for a, b in ranges.cuts(start, stop, self.part_bytes)]

    def read(self, part: Part):
        for at, lines in ranges.lines(part.path, part.start, part.stop, part.end):
            texts = [x.decode("utf-8", "replace") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array([part.base + a for a in at], pa.int64()), pa.array(texts, pa.string())], names=["seq", "value"])


class SessionLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> SessionLogReader:  # noqa: N802
        return SessionLogReader(self.options)


def tail(spark: SparkSession, path: str | list[str] | None = None, agent: str | None = None, from_start: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """A streaming frame of new entries of one log or of several; a task reads about part_bytes. `stop()` on the query that reads it ends it.

    `seq` orders a log's entries over its generations: see `base`.
    """
    with by_value(sys.modules[__name__], sessionlog, ranges):
        spark.dataSource.register(SessionLogSource)
    reader = spark.readStream.format("session_log").option("fromStart", str(from_start).lower()).option("partBytes", str(part_bytes))
    df = entries(reader.option("paths", json.dumps(path if isinstance(path, list) else [path or log_path()])).load())
    return df.where(df.agent == agent) if agent else df


def tail_folder(spark: SparkSession, folder: str, agent: str | None = None) -> DataFrame:
    """Entries of JSON-line files as they appear in a shared folder, where many writers each add files of their own."""
    df = spark.readStream.schema(schemas.SESSION_LOG).option("mode", "DROPMALFORMED").json(folder)
    return df.where(df.agent == agent) if agent else df
