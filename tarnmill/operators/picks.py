"""Picks within groups, neighbours, sampling positions, exact nearest vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that go to the executors at once.
QUERY_BLOCK = 4096


def window(partition: list[str]):
    return Window.partitionBy(*partition)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("k") <= n)


def first_per_group(df: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group in a total order; the group limit runs before the shuffle as well."""
    return top_per_group(df, by, order, 1).select(*by, *keep)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def neighbours(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The value before and after each row; the ends repeat themselves."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("below", F.coalesce(F.lag(value).over(w), value)).withColumn("above", F.coalesce(F.lead(value).over(w), value))


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which every number of a name is padded with zeros."""
    return F.array_join(
        F.transform(F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)")), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, width, "0")).otherwise(F.lower(x))), ""
    )


def linspace(n: Column, k: int, low: float, high: float, short: int = 10) -> Column:
    """``k`` evenly spaced indices of n slices, an array of (i, cut, near): truncated, and rounded half to even.

    Series of at least ``short`` slices use the band from ``low`` to ``high`` of their length.
    """
    first = F.when(n >= short, F.floor(n * low)).otherwise(F.lit(0)).cast("double")
    last = F.when(n >= short, F.floor(n * high) - 1).otherwise(n - 1).cast("double")

    def at(i: Column) -> Column:
        x = F.when(n >= short, first + i * (last - first) / (k - 1)).otherwise(i * (n - 1) / (k - 1))
        return F.struct(i.cast("bigint").alias("i"), F.floor(x).cast("bigint").alias("cut"), F.bround(x, 0).cast("bigint").alias("near"))

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)


def nearest(vectors: DataFrame, queried: Column, key: str, vector: str, k: int) -> DataFrame:
    """(a, b, k, d): the ``k`` nearest rows of each queried row by Euclidean distance, ties by key.

    Queries are fetched in blocks of bounded size and sent to all rows; each batch of rows keeps its own best k per
    query, so what is shuffled is k rows per query and batch, not all pairs. Distances are rounded to 6 decimals.
    """
    ids = vectors.filter(queried).select(key, vector)
    n = ids.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = ids if blocks == 1 else ids.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block)
        rows = part.toPandas()
        sent = vectors.sparkSession.sparkContext.broadcast((rows[key].to_numpy(), np.stack(rows[vector].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))))

        def best(batches, sent=sent):
            names, queries = sent.value
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                own, x = pdf[key].to_numpy(), np.stack(pdf[vector].to_numpy()).astype(np.float64)
                found = []
                for name, q in zip(names, queries):
                    d = np.round(np.sqrt(((x - q) ** 2).sum(axis=1)), 6)
                    order = np.lexsort((own, d))
                    order = order[own[order] != name][:k]
                    found.append(pd.DataFrame({"a": name, "b": own[order], "d": d[order]}))
                yield pd.concat(found)

        part = vectors.select(key, vector).mapInPandas(best, "a bigint, b bigint, d double")
        out = part if out is None else out.unionByName(part)
    return top_per_group(out, ["a"], [F.col("d"), F.col("b")], k).select("a", "b", "k", "d")
