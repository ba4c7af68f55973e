"""Helpers of this subpackage: shared folder, materialised intermediates, text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the master is local (tests) a
    temporary folder is made; on a cluster an unset folder is an error, as executors could not see the driver's.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="tarnmill-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tarnmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    It cuts the lineage so that a lost executor costs no recomputation of what came before, and lets two
    consumers read one result. Spark's commit protocol keeps only the rows of successful task attempts.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does the same to ASCII-only strings and is faster there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once per row although ``body`` uses it often.

    Catalyst would else copy the expression into every use inside a lambda.
    """
    return F.transform(F.array(value), body)[0]


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """The columns of ``df`` and ``outputs``; an output replaces an input column of the same name."""
    return df.withColumns(outputs)
