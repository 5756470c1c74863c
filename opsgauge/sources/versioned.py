"""Partitioned Parquet tables whose current files are named by a manifest.

Replacing partitions writes new folders first and then one new manifest; a
reader sees the old table or the new one, and a job that fails midway leaves
only folders that no manifest names.  A manifest is a Parquet table with one row
per file.  The table's schema is stored when it is created, so that partition values
keep their type and spelling.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsgauge.sources.layout import decoded, remove_folders

VERSION = "version"
_MANIFEST_SCHEMA = "directory string, partition string, path string, length bigint, rows bigint"
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def create(df: DataFrame, root: str, partition_cols: Sequence[str]) -> None:
    """Write version 1 of a table."""
    spark = df.sparkSession
    described = json.dumps({"schema": df.schema.jsonValue(), "partition_cols": list(partition_cols)})
    spark.createDataFrame([(described,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/_schema")
    staged = stage(df, root, "1", partition_cols)
    _publish(_entries(spark, root, staged), root, 1)


def description(spark: SparkSession, root: str) -> tuple[T.StructType, list[str]]:
    """The table's schema and its partition columns."""
    stored = json.loads(spark.read.text(f"{root}/_schema").first()[0])
    return T.StructType.fromJson(stored["schema"]), stored["partition_cols"]


def current_version(spark: SparkSession, root: str) -> int:
    """The newest published version; only the names of manifests are listed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # A manifest counts once it is complete.
    done = [
        status.getPath()
        for status in files.listStatus(folder)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    ]
    return max(int(path.getName().split("=")[1]) for path in done)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Folder, partition path, size and rows of every current file."""
    at = current_version(spark, root) if version is None else version
    return spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{root}/_manifest/{VERSION}={at}")


def directories(entries: DataFrame) -> list[str]:
    """Folders as a list: one per partition, as Spark's own file index keeps them."""
    return sorted(row.directory for row in entries.select("directory").distinct().collect())


def read_current(spark: SparkSession, root: str, folders: Sequence[str] | None = None) -> DataFrame:
    """The current table, or only some of its folders."""
    chosen = directories(manifest(spark, root)) if folders is None else list(folders)
    return _read(spark, root, chosen)


def _read(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    # With the stored schema a partition value like 001 is not taken for a number.
    schema, _ = description(spark, root)
    found = spark.read.schema(schema).option("basePath", root).parquet(*folders)
    return found if VERSION in schema.names else found.drop(VERSION)


def current_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per current data file, with its partition columns; read from the manifest."""
    schema, partition_cols = description(spark, root)
    values = [_value(name, schema[name].dataType).alias(name) for name in partition_cols]
    return manifest(spark, root).select("directory", "path", "length", "rows", *values)


def _value(name: str, kind: T.DataType) -> Column:
    """A partition column from the escaped path of a partition."""
    raw = F.regexp_extract("partition", f"(?:^|/){re.escape(name)}=([^/]*)", 1)
    return F.when(raw != _NULL_PARTITION, decoded(raw)).cast(kind)


def stage(df: DataFrame, root: str, version: str, partition_cols: Sequence[str]) -> str:
    """Write folders that no manifest names yet."""
    path = f"{root}/{VERSION}={version}"
    df.write.mode("errorifexists").partitionBy(*partition_cols).parquet(path)
    return path


def staging_name(version: int) -> str:
    """A name that no other run uses, so that two runs never write into one folder."""
    return f"{version}-{uuid.uuid4().hex[:12]}"


def publish_replacement(spark: SparkSession, root: str, version: int, staged: str, replaced: DataFrame) -> None:
    """Publish staged folders in the place of the ``replaced`` ones (``directory``) of the version before.

    The rows of the whole new table must be those of the old one.  Of two runs that publish the same
    version, the later one fails.
    """
    old = manifest(spark, root, version - 1)
    kept = old.join(replaced.select("directory").distinct(), "directory", "left_anti")
    entries = kept.unionByName(_entries(spark, root, staged))
    before, after = (frame.agg(F.sum("rows")).first()[0] or 0 for frame in (old, entries))
    if before != after:
        raise RuntimeError(f"the table would have {after} instead of {before} rows; version {version - 1} stays current")
    _publish(entries, root, version)


def remove_replaced(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove folders that only versions before the last ``keep`` name; returns how many."""
    last = current_version(spark, root)
    old, new = range(1, last - keep + 1), range(max(1, last - keep + 1), last + 1)
    if not old:
        return 0
    named = [
        spark.read.schema(_MANIFEST_SCHEMA).parquet(*[f"{root}/_manifest/{VERSION}={at}" for at in versions])
        for versions in (old, new)
    ]
    return remove_folders(spark, named[0].join(named[1], "directory", "left_anti"))


def _entries(spark: SparkSession, root: str, staged: str) -> DataFrame:
    """One row per staged file; the rows are counted from the files."""
    rows = _read(spark, root, [staged])
    files = rows.groupBy(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_size").alias("length"))
    path = decoded(F.col("url"))
    directory = F.regexp_replace(path, "/[^/]*$", "")
    marker = "/" + staged.rstrip("/").rsplit("/", 1)[-1] + "/"
    return files.agg(F.count(F.lit(1)).alias("rows")).select(
        directory.alias("directory"),
        F.substring_index(directory, marker, -1).alias("partition"),
        path.alias("path"),
        "length",
        "rows",
    )


def _publish(entries: DataFrame, root: str, version: int) -> None:
    columns = [part.strip().split(" ")[0] for part in _MANIFEST_SCHEMA.split(",")]
    entries.select(*columns).write.mode("errorifexists").parquet(f"{root}/_manifest/{VERSION}={version}")
