"""Session settings shared by the tests, the bench and local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "tarnmill", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the queries expect: UTC, AQE, Arrow.

    ``shuffle_partitions`` defaults to the number of local threads; on a cluster it is sized by the operator of
    the cluster, and AQE coalesces what turns out small.
    """
    n = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
