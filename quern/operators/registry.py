"""Tool-server plugins: which version of a plugin folder to use and the server configuration rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import semver

# Plugins in their order.
PLUGINS = ["efficiency", "genome", "bash", "diff", "github", "http", "logs", "orient", "sql", "tree"]


class PluginNotFound(Exception):
    """No folder holds the plugins; `checked` lists where they were looked for."""

    def __init__(self, checked: list[str]):
        super().__init__("plugin root not found; checked: " + ", ".join(checked))
        self.checked = checked


def server_file(plugin: str) -> str:
    return f"servers/{plugin}-server.ts"


def looks_like_root(folder: str | Path) -> bool:
    return (Path(folder) / server_file(PLUGINS[0])).exists()


def latest_versions(versions: DataFrame, by: str = "plugin", name: str = "version") -> DataFrame:
    """The valid row of each plugin with the highest version; names without one count as 0.0.0, ties go to the smaller name."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(semver(F.col(name))), name))
    return versions.where("valid").withColumn("_r", rank).where("_r = 1").drop("_r")


def resolve_root(explicit: str | None = None, environment: str | None = None, cache: str | None = None, fallback: str | None = None) -> tuple[str, list[str]]:
    """The first folder that holds the plugins: explicit, environment, the cache's latest valid version, fallback. Driver side; folders are few."""
    import re

    checked = []
    for folder in (explicit, environment):
        if folder:
            checked.append(folder)
            if looks_like_root(folder):
                return folder, checked
    if cache:
        checked.append(f"{cache}/<latest>")
        if Path(cache).is_dir():
            version = lambda p: tuple(map(int, m.groups())) if (m := re.match(r"(\d+)\.(\d+)\.(\d+)", p.name)) else (0, 0, 0)
            for folder in sorted((p for p in Path(cache).iterdir() if p.is_dir()), key=version, reverse=True):
                if looks_like_root(folder):
                    return str(folder), checked
    if fallback:
        checked.append(fallback)
        if looks_like_root(fallback):
            return fallback, checked
    raise PluginNotFound(checked)


def server_config(spark: SparkSession, root: str, prefix: str, plugins: list[str] | None = None, runtime: str = "bun") -> DataFrame:
    """(ord, type, name, command, args) of each plugin's server, in the order asked for."""
    rows = [(i, "stdio", f"{prefix}-{p}", runtime, ["run", f"{root}/{server_file(p)}"]) for i, p in enumerate(PLUGINS if plugins is None else plugins) if p in PLUGINS]
    return spark.createDataFrame(rows, "ord int, type string, name string, command string, args array<string>")


def config_record(config: DataFrame) -> DataFrame:
    """One row: a map from server name to its configuration."""
    return config.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("type", "command", "args")))).alias("servers"))
