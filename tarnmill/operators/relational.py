"""Small relational operators: joins with rules, sweeps, reports. Each declares a plan and runs no action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_suffixed(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join in which columns of both sides get a suffix."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    return left.withColumnsRenamed({c: c + suffixes[0] for c in clash}).join(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), on)


def error_type(y: Column, p: Column, at: float = 0.5) -> Column:
    return F.when((y >= at) & (p >= at), "TP").when(y >= at, "FN").when(p >= at, "FP").otherwise("TN")


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(default)


def band_counts(x: Column, bands: dict[str, tuple[float | None, float | None]]) -> list[Column]:
    """A count for each half-open band [low, high)."""
    out = []
    for name, (low, high) in bands.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (x >= low)
        if high is not None:
            inside = inside & (x < high)
        out.append(F.sum(F.coalesce(inside, F.lit(False)).cast("long")).alias(name))
    return out


def threshold_sweep(df: DataFrame, value: str, key: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, n_studies): rows and distinct keys at or over each threshold, in one pass over the rows."""
    rows = df.select(key, value, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    at = F.col(value) >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.sum(at.cast("long")).alias("n"), F.countDistinct(F.when(at, F.col(key))).alias("n_studies"))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls per column, and whether there are any."""
    missing = lambda c: F.sum(F.col(c).isNull().cast("long"))
    any_null = F.sum(F.greatest(*[F.col(c).isNull().cast("int") for c in columns])) > 0
    return df.agg(*[missing(c).alias(f"null_{c}") for c in columns], any_null.alias("any_null"))


def align(required: DataFrame, have: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Every required id, with the columns of ``have`` or their defaults."""
    return required.join(have, key, "left").select(key, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in defaults.items()])


def common_to_all(df: DataFrame, key: str, member: str, n: int) -> DataFrame:
    """Keys that all ``n`` members have: one aggregate instead of n - 1 joins."""
    return df.groupBy(key).agg(F.countDistinct(member).alias("_n")).filter(F.col("_n") == n).select(key)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet; appending their results resumes a job."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of one side only, and whether the key sets are equal."""
    sides = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    left, right = F.count(F.when(F.col("_b").isNull(), 1)), F.count(F.when(F.col("_a").isNull(), 1))
    return sides.agg(left.alias("only_left"), right.alias("only_right"), ((left == 0) & (right == 0)).alias("aligned"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequencies, null included, most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def describe(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Count, mean, sample deviation, exact linear quartiles and extremes."""
    q = lambda x: F.percentile(c, F.lit(x))
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("sd"), F.min(c).alias("least"),
        q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(c).alias("most"),
    )


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows whose running ``total`` of cost within their account is at most the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(cost).over(w)).filter(F.col("total") <= budget)
