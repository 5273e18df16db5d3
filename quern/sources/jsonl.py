"""JSON lines, JSON documents, text sections and source trees as DataFrames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schemas
from quern.functions.text import canonical_json, is_json, strict_json
from quern.sources import ranges

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system Spark reads it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON lines; blank lines and those that do not parse are left out, unknown fields too, missing ones are null.

    Other JSON values than objects give nulls. A missing path has no lines.
    """
    s = _schema(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], s)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", strict_json(F.col("value"), s).alias("r")).where(is_json(F.col("r"), F.col("value"))).select("r.v.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds the rows as JSON lines; each task writes files of its own, so writers never mix lines."""
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType = schemas.MANIFEST) -> DataFrame:
    """The one record of a JSON document; no rows if it is missing or corrupt."""
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(schema))
    s = _schema(schema)
    text = spark.read.text(path, wholetext=True).select(canonical_json("value").alias("v")).where("v is not null")
    return text.select(F.from_json("v", s, _STRICT).alias("r")).where("r is not null").select("r.*")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Puts a file in the place of another in one step, so that readers find one of the two."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = b.getFileSystem(conf)
    if system.getScheme() == "file":
        os.replace(a.toUri().getPath(), b.toUri().getPath())
        for x in (a, b):  # a checksum that Hadoop keeps beside a file is no longer right
            system.getRawFileSystem().delete(jvm.org.apache.hadoop.fs.Path(x.getParent(), f".{x.getName()}.crc"), False)
        return
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), conf).rename(a, b, options)


def write_document(df: DataFrame, path: str, now: str | None = None) -> None:
    """Writes a one-row frame as a JSON document under a new name and renames it; the temporary file goes if that fails."""
    if now is not None:
        df = df.withColumn("updatedAt", F.lit(now))
    text = df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "true"}).alias("v")).first().v
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    system = target.getFileSystem(conf)
    try:
        out = system.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        replace(spark, f"{path}.tmp", path)
    finally:
        if system.exists(temporary):
            system.delete(temporary, False)


def update_document(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], now: str, schema: str | T.StructType = schemas.MANIFEST) -> DataFrame:
    """Reads a document, writes what `change` makes of its row, and returns that; an error if it is missing or corrupt."""
    old = read_document(spark, path, schema)
    if old.isEmpty():
        raise ValueError(f"no document at {path}")
    write_document(change(old), path, now)
    return read_document(spark, path, schema)


def manifest_sections(manifest: DataFrame, corpus_id: str) -> DataFrame:
    """Section rows of a manifest with their place in it."""
    rows = manifest.select(F.posexplode("sections").alias("ord", "s"))
    return rows.select(F.lit(corpus_id).alias("corpus_id"), F.col("ord").cast("long"), "s.path", "s.title", "s.summary", "s.tags", "s.tokens", F.col("s.updatedAt").alias("updated_at"))


#: Bytes of texts that a task gives at once.
TEXT_BYTES = 8 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over too."""
    return name.startswith((".", "_")) or name.endswith("._COPYING_")


def _listed(store: fs.FileSystem, folder: str, deep: bool):
    """Paths of the markdown files in a folder, and below it if `deep`, folder by folder."""
    todo = [folder]
    while todo:
        found = [x for x in store.get_file_info(fs.FileSelector(todo.pop())) if not _hidden(x.base_name)]
        if deep:
            todo += [x.path for x in found if x.type == fs.FileType.Directory]
        yield [x.path for x in found if x.type == fs.FileType.File and x.base_name.endswith(".md")]


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all markdown texts below a folder, empty ones too.

    Folders are listed by tasks, a first-level one by each, and their files are dealt out by path, so that neither the driver nor the plan has a
    list of files. A store that pyarrow does not know is read by Spark's reader, which passes over empty files.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, content string")
    try:
        store, root = ranges.opened(folder.rstrip("/"))
    except pa.ArrowInvalid:
        return _read_sections_by_spark(spark, folder)
    first = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and not _hidden(x.base_name)]

    def listed(batches):
        store, _ = ranges.opened(folder.rstrip("/"))
        for batch in batches:
            for at, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for paths in _listed(store, at, deep):
                    for a in range(0, len(paths), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(paths[a : a + 10_000], pa.string())], names=["path"])

    def run(batches):
        store, root = ranges.opened(folder.rstrip("/"))
        paths, texts, size = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as f:
                    texts.append(f.read())
                paths.append(path[len(root) :].lstrip("/"))
                size += len(texts[-1])
                if size > TEXT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "content"])
                    paths, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "content"])

    folders = spark.createDataFrame([(root, False), *((x, True) for x in first)], "path string, deep boolean").repartition(len(first) + 1, "path")
    files = folders.mapInArrow(listed, "path string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(run, "path string, content binary").select("path", F.col("content").cast("string").alias("content"))


def _read_sections_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    inside = F.regexp_replace(F.regexp_replace(F.input_file_name(), "^[a-z]+:/+", ""), f"^{root}/", "")
    return files.select(F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("content"))


def write_sections(sections: DataFrame, folder: str) -> None:
    """Writes (path, content) as files below a folder, each by the task that holds the row, under a new name that is renamed; null contents are no files.

    A path must stay inside the folder.
    """

    def run(batches):
        store, root = ranges.opened(folder.rstrip("/"))
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
                if ".." in parts or not parts:
                    raise ValueError(f"{path} is not inside the folder")
                target = "/".join([root, *parts])
                if (parent := target.rsplit("/", 1)[0]) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                temporary = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as f:
                    f.write(content.encode())
                store.move(temporary, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    sections.where("content is not null").select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of source files below a folder, less those in hidden folders and node_modules."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx,js,jsx}").text(folder, wholetext=True)
    rows = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", ""), f"^{root}/", "")
    return rows.where(~F.exists(F.slice(F.split(inside, "/"), F.lit(1), F.greatest(F.size(F.split(inside, "/")) - 1, F.lit(0))), lambda p: p.startswith(".") | (p == "node_modules")))


def read_embedding_cache(spark: SparkSession, path: str, corpus_id: str) -> DataFrame:
    """Cache entries of a JSON array; none if it is missing, corrupt or no array."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.EMBEDDING_CACHE)
    text = spark.read.text(path, wholetext=True).select(canonical_json("value").alias("v")).where("v like '[%'")
    entry = "array<struct<sectionPath:string,embedding:array<double>,contentHash:string,updatedAt:string>>"
    rows = text.select(F.posexplode(F.from_json("v", entry)).alias("ord", "e"))
    return rows.select(F.lit(corpus_id).alias("corpus_id"), F.col("ord").cast("long"), F.col("e.sectionPath").alias("path"), "e.embedding", F.col("e.contentHash").alias("content_hash"), F.col("e.updatedAt").alias("updated_at"))


def write_embedding_cache(cache: DataFrame, path: str) -> None:
    """The entries as one JSON array in order of `ord`, entry by entry through the driver, under a new name that is renamed at the end."""
    spark = cache.sparkSession
    entry = F.struct(F.col("path").alias("sectionPath"), "embedding", F.col("content_hash").alias("contentHash"), F.col("updated_at").alias("updatedAt"))
    rows = cache.orderBy("ord", "path").select(F.to_json(entry).alias("v"))
    jvm = spark.sparkContext._jvm
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(temporary, True)
    try:
        lead = b"["
        for r in rows.toLocalIterator():
            out.write(bytearray(lead + r.v.encode()))
            lead = b",\n"
        out.write(bytearray(b"]" if lead == b",\n" else b"[]"))
        out.close()
        replace(spark, f"{path}.tmp", path)
    finally:
        if system.exists(temporary):
            system.delete(temporary, False)


_ENTRY = "sectionPath string, embedding array<double>, contentHash string, updatedAt string, ord long"


def write_embedding_caches(cache: DataFrame, folder: str) -> None:
    """The entries as a folder of JSON arrays, one for each task, a line for each entry; `ord` is kept in the entry."""
    entry = F.struct(F.col("path").alias("sectionPath"), "embedding", F.col("content_hash").alias("contentHash"), F.col("updated_at").alias("updatedAt"), "ord")

    def run(batches):
        lead = "["
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                out.append(lead + x)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])

    cache.select(F.to_json(entry).alias("v")).mapInArrow(run, "value string").write.text(folder)


def read_embedding_caches(spark: SparkSession, folder: str, corpus_id: str) -> DataFrame:
    """Cache entries of a folder of arrays with a line for each entry, read line by line; lines that are no entries are left out."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schemas.EMBEDDING_CACHE)
    lines = spark.read.option("lineSep", "\n").text(folder).where("value <> ']' and value <> '[]'").select(F.regexp_replace("value", r"^[\[,]", "").alias("value"))
    rows = lines.select("value", strict_json(F.col("value"), _schema(_ENTRY)).alias("r")).where(is_json(F.col("r"), F.col("value")) & F.col("r.v").isNotNull())
    return rows.select(F.lit(corpus_id).alias("corpus_id"), "r.v.ord", F.col("r.v.sectionPath").alias("path"), "r.v.embedding", F.col("r.v.contentHash").alias("content_hash"), F.col("r.v.updatedAt").alias("updated_at"))


def truncate(spark: SparkSession, path: str) -> None:
    """Empties a folder of JSON lines if it is there."""
    if exists(spark, path):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.delete(p, True)
        system.mkdirs(p)
