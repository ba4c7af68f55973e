"""File sources and sinks by Spark's readers, for any store that these read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder; a local master without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if base is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of its own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` after a round trip through the shared folder, for what several steps read. ``options`` are the writer's."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and an explicit schema: no pass to infer types, ids stay text."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=False, escape='"')


def read_columns(spark: SparkSession, path: str, columns: list[str], types: dict[str, str]) -> DataFrame:
    """Some columns of a CSV with a header, with given types (else text); the header's names are read from one line."""
    header = spark.read.csv(path, header=True, inferSchema=False, escape='"').columns
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return read_csv(spark, path, schema).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table if it is there, else an empty one."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first table of a list of candidates."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {paths}")


def read_binary_tree(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, group, content) of the files under a folder; group is a file's own folder.

    Contents are read only by plans that use the column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.element_at(F.split("path", "/"), -2).alias("group"), "content")


def read_embedded(spark: SparkSession, payload: str, schema: str) -> DataFrame:
    """A small table shipped in the code as base64 of gzip of CSV."""
    import base64
    import gzip

    lines = gzip.decompress(base64.b64decode(payload)).decode().splitlines()
    rows = spark.createDataFrame([(x,) for x in lines[1:]], "line string")
    return rows.select(F.from_csv("line", schema).alias("r")).select("r.*")
