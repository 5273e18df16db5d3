"""Tables in buckets, changed by versions: what changed is written anew, then one small file makes the new version the newest.

    folder/v/<version>.json     for each table, the folder of each bucket's rows
    folder/data/<id>/b=<n>/     rows of a bucket, never changed once they are written

A version's file comes whole and only where none is, so of two writers that start from the same version one is refused. Readers take the newest
version that is complete; what a writer left that failed before is not named by any version.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Files that a bucket's rows are dealt out to as they are written, so that no task has a hot bucket alone.
PARTS = 4


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


def bucket(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_exclusively(spark: SparkSession, path: str, data: bytes) -> bool:
    """Puts a whole file where none is yet, in one step; false if there is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, temporary = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at.getParent())
    if system.getScheme() == "file":
        target, own = at.toUri().getPath(), temporary.toUri().getPath()
        with open(own, "wb") as f:
            f.write(data)
        try:
            os.link(own, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    out = system.create(temporary, False)
    out.write(bytearray(data))
    out.close()
    if not system.exists(at) and system.rename(temporary, at):  # a rename does not replace a file
        return True
    system.delete(temporary, False)
    return False


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v")
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))), reverse=True)

    def _read(self, version: int) -> dict | None:
        text = self.spark.read.text(f"{self.folder}/v/{version:010d}.json", wholetext=True).first()
        try:
            said = json.loads(text.value)
        except (ValueError, AttributeError):
            return None  # its writer failed
        return said["tables"] if isinstance(said, dict) and said.get("complete") else None

    def newest(self, versions: list[int] | None = None) -> tuple[int, dict]:
        """The newest complete version and its tables; 0 and none before the first."""
        for version in self._versions() if versions is None else versions:
            if (tables := self._read(version)) is not None:
                return version, tables
        return 0, {}

    def write(self, rows: DataFrame, by: Column, sort: Iterable[str] = ()) -> dict[str, str]:
        """The rows in folders of their own, by bucket; they belong to no version yet. `sort` orders the rows of a file."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)) if not sort else F.pmod(F.xxhash64(*sort), F.lit(PARTS))
        dealt = rows.withColumn("b", by).repartition("b", part).sortWithinPartitions("b", *sort)
        dealt.write.partitionBy("b").option("compression", "zstd").parquet(path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [x.getPath().getName() for x in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return {n.removeprefix("b="): f"{path}/{n}" for n in names if n.startswith("b=")}

    def commit(self, version: int, tables: dict[str, dict[str, str]]) -> int:
        """Makes the tables the version that follows `version`; `Conflict` if there is a later one."""
        versions = self._versions()
        newest, _ = self.newest(versions)
        if newest != version:
            raise Conflict(f"version {newest} was committed after {version}")
        after = max([version, *versions]) + 1  # all who saw the same versions want the same number; one that is no version is not used again
        if not create_exclusively(self.spark, f"{self.folder}/v/{after:010d}.json", json.dumps({"tables": tables, "complete": True}).encode()):
            raise Conflict(f"another writer commits version {after}")
        return after

    def read(self, tables: dict, name: str, schema: str | T.StructType, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table of a version, of all buckets or of those asked for."""
        own = tables.get(name, {})
        paths = [own[k] for k in sorted(own, key=int) if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
