"""Lines of text files by byte range, in whatever store pyarrow opens: local paths, file:, hdfs:, s3: and others."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

#: Bytes that are read at once, forwards and backwards.
BLOCK, BACK = 1 << 20, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def size(path: str) -> int:
    """Bytes of a file, 0 where there is none."""
    store, at = opened(path)
    return store.get_file_info(at).size or 0


def read(path: str, start: int, stop: int) -> bytes:
    """Bytes start to stop of a file; fewer where it ends before, none where it is missing."""
    store, at = opened(path)
    try:
        with store.open_input_file(at) as f:
            stop = min(stop, f.size())
            return f.read_at(stop - start, start) if start < stop else b""
    except FileNotFoundError:
        return b""


def end_of_lines(path: str) -> int:
    """Where the last complete line ends; 0 for none."""
    at = size(path)
    while at > 0:
        block = read(path, max(0, at - BACK), at)
        if (i := block.rfind(b"\n")) >= 0:
            return at - len(block) + i + 1
        at -= len(block) or at
    return 0


def first_line(path: str, most: int = BACK) -> bytes:
    """The first complete line, or its first bytes if it is longer; nothing while there is none."""
    block = read(path, 0, most)
    line, end, _ = block.partition(b"\n")
    return line if end or len(block) == most else b""


def lines(path: str, start: int, stop: int, end: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Offsets and lines that begin from start to stop - 1, in blocks; the last may go on, but not beyond `end`, where a line ends."""
    at, held = max(0, start - 1), b""  # a line begins at start if one ends before it
    skip = start > 0
    upto = at
    while at < stop:
        block = read(path, upto, min(end, upto + BLOCK))
        if not block:
            return
        upto += len(block)
        held += block
        last = held.rfind(b"\n")
        if last < 0:
            continue
        offsets, out = [], []
        for line in held[:last].split(b"\n"):
            if skip:
                skip = False
            elif at < stop:
                offsets.append(at)
                out.append(line)
            at += len(line) + 1
        held = held[last + 1 :]
        if out:
            yield offsets, out


def lines_back(path: str, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Offset and line, the last of the file first; what follows the last line end is a line as well."""
    at = size(path) if end is None else end
    held = b""
    while at > 0:
        block = read(path, max(0, at - BACK), at)
        if not block:
            return
        at -= len(block)
        first, *rest = (block + held).split(b"\n")
        place = at + len(block) + len(held)
        for line in reversed(rest):
            place -= len(line)
            if line:
                yield place, line
            place -= 1
        held = first
    if held:
        yield 0, held


def concatenate(spark: SparkSession, files: list[tuple[str, list[str]]]) -> None:
    """Files (target, parts) made of their parts one after the other, each by a task that holds BLOCK bytes."""

    def run(batches):
        for batch in batches:
            for target, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = opened(target)
                with store.open_output_stream(at) as out:
                    for part in parts:
                        with store.open_input_stream(opened(part)[1]) as f:
                            while block := f.read(BLOCK):
                                out.write(block)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = spark.createDataFrame(files, "target string, parts array<string>").repartition(len(files), "target")
    rows.mapInArrow(run, "n long").collect()


def cuts(start: int, stop: int, step: int) -> list[tuple[int, int]]:
    return [(a, min(stop, a + step)) for a in range(start, stop, step)]
