"""Shared folders of the cluster, and the package on its workers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

#: The folder below the shared one that holds intermediate files.
FOLDER = "quern"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local default only for a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def session_folder(spark: SparkSession) -> str:
    """This session's own folder below the shared one."""
    context = spark.sparkContext
    if not hasattr(context, "_quern_folder"):
        context._quern_folder, context._quern_checkpoints = uuid.uuid4().hex, []
    return f"{checkpoint_root(spark).rstrip('/')}/{FOLDER}/{context._quern_folder}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's folder."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage, so lost executors cost no recomputation; `remove_shared` deletes it."""
    spark = df.sparkSession
    session_folder(spark)
    out = df.checkpoint(eager=True)
    spark.sparkContext._quern_checkpoints.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_shared(spark: SparkSession, every: bool = False) -> None:
    """Delete this session's intermediate files and checkpoints, or with `every` those that any session left in the shared folder.

    Results that were not written elsewhere go with them.
    """
    folder, context = session_folder(spark), spark.sparkContext
    for path in [*context._quern_checkpoints, folder.rsplit("/", 1)[0] if every else folder]:
        remove_path(spark, path)
    context._quern_checkpoints.clear()


@contextlib.contextmanager
def by_value(*modules: ModuleType) -> Iterator[None]:
    """What is pickled inside takes these modules' functions and classes along: the process on the driver that prepares a stateful operator
    does not get the files that were sent to the workers.
    """
    from pyspark import cloudpickle

    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, unless PYTHONPATH has it for them."""
    root = Path(__file__).resolve().parent.parent
    named = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if root in named or "site-packages" in root.parts or getattr(context, "_quern_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "quern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "quern").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    context._quern_shipped = True
