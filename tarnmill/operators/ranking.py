"""Rank family from counts of distinct scores: no group is ever sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores between a power of two and the next.
RANGES = 64


def same_keys_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the other columns of ``b``, joined on equal keys; nulls equal each other."""
    if not keys:
        return a.crossJoin(b)  # b has one row
    there = b.withColumnsRenamed({k: f"_tm_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_tm_{k}"))
    return a.join(there, on).drop(*(f"_tm_{k}" for k in keys))


def score_range(value: str) -> Column:
    """The number of the range that a score lies in; ranges are in the order of their scores."""
    x = F.col(value).cast("double")
    most = 2000 * RANGES  # above all exponents
    size = F.floor(F.log2(F.abs(x)) * RANGES) + most
    spot = F.when(x.isNull(), -3 * most).when(F.isnan(x) | (x == float("inf")), 3 * most).when(x == float("-inf"), -3 * most + 1)
    return spot.when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("int")


def pair_areas(df: DataFrame, by: list[str], value: str, pos: str, neg: str) -> DataFrame:
    """(by, n1, n0, s): sums of ``pos`` and ``neg``, and the pairs of one of each in which the score of ``pos`` is the
    greater, those of equal scores as halves; as from ``distinct_scores``, for scores of which few are equal.

    Rows move once, to the task of their range, where equal scores are counted and ordered; a range then is one row.
    """
    placed = df.select(*by, score_range(value).alias("_range"), value, pos, neg).repartition(*by, "_range")
    counts = placed.groupBy(*by, "_range", value).agg(F.sum(pos).alias(pos), F.sum(neg).alias(neg))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_below", F.coalesce(F.sum(neg).over(inside), F.lit(0)))
    pairs = F.sum(F.col(pos) * (F.col("_below") + F.col(neg) / F.lit(2.0)))
    ranges = within.groupBy(*by, "_range").agg(F.sum(pos).alias("n1"), F.sum(neg).alias("n0"), pairs.alias("s"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.withColumn("s", F.col("s") + F.col("n1") * F.coalesce(F.sum("n0").over(before), F.lit(0)))
    return summed.groupBy(*by).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum("s").alias("s"))


def distinct_scores(df: DataFrame, by: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """(by, value) once each, with every sum over its rows, over the rows of smaller values (``<name>_below``) and over all
    rows of the group (``<name>_total``). Nulls come first and NaN last.

    The sums are combined before the shuffle. Prefix sums run in two levels: over the ranges of a group, of which each
    power of two has ``RANGES``, and over the distinct scores of one range; so a large group is spread over many tasks.
    """
    counts = df.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    placed = counts.withColumn("_range", score_range(value))
    ranges = placed.groupBy(*by, "_range").agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *by, "_range", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums), *(F.sum(n).over(Window.partitionBy(*by)).alias(f"{n}_total") for n in sums)
    )
    both = same_keys_join(placed, ranges, [*by, "_range"])
    below = [(F.col(f"{n}_before") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below") for n in sums]
    return both.select(*by, value, *sums, *below, *(f"{n}_total" for n in sums))


def with_rank(df: DataFrame, out: str, value: str, by: list[str], kind: str = "avg") -> DataFrame:
    """``df`` with the rank of ``value`` in its group as ``out``.

    ``avg``: from 1, ties share their mean rank. ``pct``: that over the number of rows, in (0, 1]; not ``percent_rank``.
    ``01``: (average rank - 1) / (n - 1), and 0.5 for a single row.
    """
    average = F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)
    rank = {
        "avg": average,
        "pct": average / F.col("n_total"),
        "01": F.when(F.col("n_total") > 1, (average - 1) / (F.col("n_total") - 1)).otherwise(F.lit(0.5)),
    }[kind]
    ranks = distinct_scores(df, by, value, {"n": F.lit(1)}).select(*by, value, rank.alias("_tm_rank"))
    return same_keys_join(df.drop(out) if out not in (value, *by) else df, ranks, [*by, value]).withColumn(out, F.col("_tm_rank")).drop("_tm_rank")


def with_position(df: DataFrame, out: str, value: str, key: str, by: list[str]) -> DataFrame:
    """``df`` with the position from 1 by ``value``, then by the number ``key``, which is unique in a group."""
    values = distinct_scores(df, by, value, {"n": F.lit(1)}).select(*by, value, F.col("n_below").alias("_tm_smaller"))
    ties = distinct_scores(df, [*by, value], key, {"n": F.lit(1)}).select(*by, value, key, (F.col("n_below") + 1).alias("_tm_nth"))
    both = same_keys_join(same_keys_join(df, values, [*by, value]), ties, [*by, value, key])
    return both.withColumn(out, F.col("_tm_smaller") + F.col("_tm_nth")).drop("_tm_smaller", "_tm_nth")


def row_number(partition: list[Column | str], order: list[Column]) -> Column:
    """Position from 1 in an explicit total order; callers end ``order`` in a unique key. For groups of bounded size."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
