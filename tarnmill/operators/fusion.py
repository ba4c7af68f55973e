"""Label fusion: sources by priority, confidence weights, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.metrics import clip

#: Weights of the sources, and the confidence of an uncertain probability.
GOLD_WEIGHT, RULE_WEIGHT, UNKNOWN_WEIGHT = 1.0, 0.8, 0.2
SOURCES = ("gold", "model", "rule", "unknown")


def confidence(p: Column) -> Column:
    """From 0.3 at p = 0.5 to 1 at the ends."""
    return clip(0.3 + 1.4 * F.abs(p - 0.5), 0.3, 1.0)


def fuse(df: DataFrame, gold: str = "gold", model: str = "model", rule: str = "rule") -> DataFrame:
    """(study, target, value, weight, source): the first source that has a value wins, gold first; else 0.5."""
    g, m, r = F.col(gold), F.col(model), F.col(rule)
    return df.select(
        "study", "target", F.coalesce(g, m, r, F.lit(0.5)).alias("value"),
        F.when(g.isNotNull(), F.lit(GOLD_WEIGHT)).when(m.isNotNull(), confidence(m)).when(r.isNotNull(), F.lit(RULE_WEIGHT)).otherwise(F.lit(UNKNOWN_WEIGHT)).alias("weight"),
        F.when(g.isNotNull(), "gold").when(m.isNotNull(), "model").when(r.isNotNull(), "rule").otherwise("unknown").alias("source"),
    )


def study_source(fused: DataFrame) -> DataFrame:
    """The best source among a study's targets."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i)])
    best = fused.groupBy("study").agg(F.min(order[F.col("source")]).alias("k"))
    return best.select("study", F.array(*map(F.lit, SOURCES))[F.col("k")].alias("label_source"))


def zero_flagged(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """Weight 0 for flagged (study, target) pairs, gold rows excepted."""
    marks = flagged.select("study", "target").distinct().withColumn("_hit", F.lit(True))
    return rows.join(marks, ["study", "target"], "left").withColumn("weight", F.when(F.col("_hit") & ~F.col("is_gold"), 0.0).otherwise(F.col("weight"))).drop("_hit")


def study_weight(rows: DataFrame) -> DataFrame:
    """0.9 less 0.05 for each uncertain target, within 0.3 and 0.9; gold studies have 1."""
    unsure = F.sum(((F.col("p") > 0.3) & (F.col("p") < 0.7)).cast("int"))
    return rows.groupBy("study", "is_gold").agg(F.round(clip(0.9 - 0.05 * unsure, 0.3, 0.9), 6).alias("w")).select(
        "study", F.when(F.col("is_gold"), 1.0).otherwise(F.col("w")).alias("weight")
    )


def text_fold(text: Column, n: int = 5) -> Column:
    """A fold by the text itself, so that copies stay together."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def label_smooth(y: Column, eps: float) -> Column:
    return y * (1 - 2 * eps) + eps
