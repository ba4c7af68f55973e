"""Scores over long tables (group, y, p): AUC in its dialects, Brier, weighted BCE, confusion counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.ranking import distinct_scores, pair_areas


@dataclass(frozen=True)
class AucDialect:
    """What a caller means by AUC.

    ``drop_half``: rows with y = 0.5 do not count. ``drop_null_p``: neither do rows without a score; else those score
    0.5. ``positive``: ">=", ">" or "=" against 0.5 (or 1 for "="). ``single_class``: the value where one class is
    missing, None for null. ``macro_counts_single``: whether such values enter the macro mean.
    """

    drop_half: bool = False
    drop_null_p: bool = False
    positive: str = ">="
    single_class: float | None = None
    macro_counts_single: bool = False
    min_rows: int = 1


DIALECTS = {
    "competition": AucDialect(positive="=", single_class=0.5, macro_counts_single=True),
    "training": AucDialect(drop_half=True),
    "score_target": AucDialect(drop_half=True, min_rows=2),
    "calc": AucDialect(drop_half=True, drop_null_p=True),
    "label_validator": AucDialect(positive="=", single_class=0.5, macro_counts_single=True),
    "auditor": AucDialect(),
    "fold_gt": AucDialect(positive=">"),
    "nanmean": AucDialect(positive="="),
}


def auc(df: DataFrame, by: list[str], dialect: AucDialect, y: str = "y", p: str = "p", n: str | None = None, few_equal: bool = False) -> DataFrame:
    """(by, n_pos, n_neg, auc): area under the ROC curve from counts of distinct scores.

    A positive counts the negatives of smaller scores, and half of those of its own. Rows without truth never count.
    ``n``: a column with the number of equal rows that a row stands for. ``few_equal``: few rows have equal scores, so
    that counts before the shuffle would not be fewer; rows then move once.
    """
    rows = df.filter(F.col(y).isNotNull())
    if dialect.drop_half:
        rows = rows.filter(F.col(y) != 0.5)
    rows = rows.filter(F.col(p).isNotNull()) if dialect.drop_null_p else rows.withColumn(p, F.coalesce(p, F.lit(0.5)))
    positive = {">=": F.col(y) >= 0.5, ">": F.col(y) > 0.5, "=": F.col(y) == 1.0}[dialect.positive].cast("int")
    times = F.col(n) if n else F.lit(1)
    if few_equal:
        counted = rows.withColumn("_pos", positive * times).withColumn("_neg", (1 - positive) * times)
        sums = pair_areas(counted, by, p, "_pos", "_neg").withColumnsRenamed({"n1": "n_pos", "n0": "n_neg", "s": "_sum"})
    else:
        scores = distinct_scores(rows.withColumn("_pos", positive), by, p, {"pos": F.col("_pos") * times, "neg": (1 - F.col("_pos")) * times})
        sums = scores.groupBy(*by).agg(
            F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))).alias("_sum")
        )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") >= dialect.min_rows)
    area = F.col("_sum") / (F.col("n_pos") * F.col("n_neg"))
    return sums.select(*by, "n_pos", "n_neg", F.when(both, area).otherwise(F.lit(dialect.single_class)).alias("auc"))


def macro(df: DataFrame, by: list[str], value: str = "auc", dialect: AucDialect = AucDialect()) -> DataFrame:
    """Mean over targets of a per-target score, with or without the stand-ins for single-class targets."""
    counted = F.col(value) if dialect.macro_counts_single else F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col(value))
    aggregates = [F.round(F.avg(counted), 6).alias(f"macro_{value}"), F.count(counted).alias("n_targets")]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, although ``greatest`` and ``least`` skip nulls."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def bce(y: Column, p: Column, smoothing: float = 0.0, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    t = y * (1 - 2 * smoothing) + smoothing
    return -(t * F.log(q) + (1 - t) * F.log(1 - q))


def weighted_bce(y: str, p: str, w: str, smoothing: float) -> Column:
    """Sum of weighted losses over the sum of weights, an aggregate."""
    return F.sum(bce(F.col(y), F.col(p), smoothing) * F.col(w)) / (F.sum(w) + 1e-7)


def confusion(df: DataFrame, by: list[str], truth: Column, called: Column) -> DataFrame:
    """Counts and rates of a binary call: zero denominators give 0 for precision, recall and F1, null for the rest."""
    rows = df.select(*by, truth.alias("_t"), called.alias("_c"))
    count = lambda t, c: F.sum(((F.col("_t") == t) & (F.col("_c") == c)).cast("long"))
    n = rows.groupBy(*by).agg(count(True, True).alias("tp"), count(True, False).alias("fn"), count(False, True).alias("fp"), count(False, False).alias("tn"))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return n.select(
        *by, "tp", "fn", "fp", "tn", rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"),
        zero(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp, tp + fn).alias("sensitivity"), rate(tn, tn + fp).alias("specificity"),
        rate(tn, tn + fn).alias("npv"), rate(fn, tp + fn).alias("miss_rate"), rate(fp, fp + tn).alias("false_alarm_rate"),
    )


def efficiency(seconds: Column, score: Column, base: float, best: float) -> Column:
    """Time over the squared share of the way from a base score to the best one; null where there is no gain."""
    gain = (score - base) / (best - base)
    return F.when(gain > 0, seconds / (gain * gain))
