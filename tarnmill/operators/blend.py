"""Blends of model outputs on long tables (study, target, model, p, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.metrics import clip
from tarnmill.operators.ranking import with_rank
from tarnmill.sources.files import written

LOW, HIGH = 0.001, 0.999


def weight_map(weights: dict[str, float], by: str = "model") -> Column:
    """A weight for each value of ``by``, null for others. The map is a parameter of fixed size."""
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col(by)]


def with_ranks(df: DataFrame, ranks: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``df`` with a percentile rank for each name -> (value, group). A rank reads its input twice, so inputs are written."""
    for name, (value, by) in ranks.items():
        df = with_rank(written(df, "ranks"), name, value, by, "pct")
    return df


def blend_mean(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean by study and target over the models present, clipped."""
    w = weight_map(weights)
    return df.filter(w.isNotNull()).groupBy("study", "target").agg(clip(F.sum(w * F.col("p")) / F.sum(w), LOW, HIGH).alias("p"))


def blend_rank(df: DataFrame, weights: dict[str, float], rerank: bool = False) -> DataFrame:
    """Weighted mean of percentile ranks within (target, model); ``rerank`` ranks the blend once more."""
    w = weight_map(weights)
    ranked = with_rank(df.filter(w.isNotNull()), "r", "p", ["target", "model"], "pct")
    out = ranked.groupBy("study", "target").agg((F.sum(w * F.col("r")) / F.sum(w)).alias("p"))
    if rerank:
        out = with_rank(written(out.withColumn("p", F.round("p", 9)), "blend"), "r", "p", ["target"], "pct").select("study", "target", F.col("r").alias("p"))
    return out.withColumn("p", clip(F.col("p"), LOW, HIGH))


def blend_rank_members(df: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """Percentile ranks of each member, weighted by target and member (``weights[target][model]``, 0 if absent) and divided
    by the sum of the weights present. A row without any vote is an error."""
    w = F.coalesce(F.create_map(*[F.lit(x) for t, ms in weights.items() for m, v in ms.items() for x in (f"{t}:{m}", v)])[F.concat_ws(":", "target", "model")], F.lit(0.0))
    votes = with_rank(df, "r", "p", ["target", "model"], "pct").withColumn("w", w).groupBy("study", "target").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("r")).alias("s"))
    p = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.raise_error(F.concat(F.lit("no vote for "), F.col("target"))).cast("double"))
    return votes.select("study", "target", p.alias("p"))


def tta_mix(a: Column, b: Column, weight: float = 0.65) -> Column:
    """The probability of a mix of two logits. Fixed value: 0.65 of the first."""
    return sigmoid(weight * logit(a) + (1 - weight) * logit(b))


def blend_rank_by_fold(df: DataFrame) -> DataFrame:
    """Ranks within each model's fold, averaged over the models; studies that lack a model are left out."""
    n = df.select("model").distinct().count()
    ranked = with_rank(df, "r", "p", ["target", "model", "fold"], "pct")
    return ranked.groupBy("study", "target").agg(F.avg("r").alias("p"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == n).drop("k")


def blend_half_rank(df: DataFrame) -> DataFrame:
    """Sum of average ranks over (models x studies)."""
    ranked = with_rank(df, "r", "p", ["target", "model"]).groupBy("study", "target").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("k"))
    studies = ranked.groupBy(F.col("target").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(studies, F.col("target") == F.col("t")).select("study", "target", (F.col("s") / (F.col("k") * F.col("n"))).alias("p"))


def blend_rank_of_mean(df: DataFrame) -> DataFrame:
    """Rank of the mean probability over the family's members that are present."""
    mean = df.groupBy("study", "target").agg(F.round(F.avg("p"), 9).alias("m"))
    return with_rank(written(mean, "blend"), "p", "m", ["target"], "pct").select("study", "target", "p")


def blend_masked(df: DataFrame, parent: str, other: str, weight: float, eligible: Column) -> DataFrame:
    """Eligible rows mix ranks taken among eligible rows; all other rows keep the parent's rank."""
    wide = df.groupBy("study", "target").agg(
        F.max(F.when(F.col("model") == parent, F.col("p"))).alias("a"), F.max(F.when(F.col("model") == other, F.col("p"))).alias("b")
    ).withColumn("ok", eligible)
    part = ["target", "ok"]
    ranked = with_ranks(wide, {"ra": ("a", part), "rb": ("b", part), "all": ("a", ["target"])})
    mixed = (1 - weight) * F.col("ra") + weight * F.col("rb")
    return ranked.select("study", "target", F.when(F.col("ok"), mixed).otherwise(F.col("all")).alias("p"))


def logit(p: Column, eps: float = 1e-5) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(z: Column, bound: float = 11.5) -> Column:
    return 1 / (1 + F.exp(-clip(z, -bound, bound)))


def zlogit(df: DataFrame, by: list[str]) -> DataFrame:
    """Logits standardised by mean and population deviation (plus 1e-6) of their group, rounded to 5 as published.

    Group statistics are one combined aggregate, joined back; the table of groups is small and AQE broadcasts it.
    """
    z = df.withColumn("z", logit(F.col("p")))
    stats = z.groupBy(*by).agg(F.round(F.avg("z"), 5).alias("mu"), F.round(F.stddev_pop("z") + 1e-6, 5).alias("sd"))
    return z.join(stats, by).withColumn("z", (F.col("z") - F.col("mu")) / F.col("sd"))


def blend_zlogit(df: DataFrame, weights: dict[str, float], by: list[str]) -> DataFrame:
    """Weighted mean of standardised logits as a probability; members that lack a weight do not count."""
    w = weight_map(weights)
    return zlogit(df.filter(w.isNotNull()), by).groupBy("study", "target").agg(sigmoid(F.sum(w * F.col("z")) / F.sum(w)).alias("p"))


def blend_families(
    df: DataFrame, keys: DataFrame, priors: DataFrame, families: dict[str, tuple[str, ...]], weights: dict[str, float], by: list[str], special: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """(study, target, p) for every key (study, target): families of members blended in standardised logits.

    The members of a family that a row has are averaged; the families that it has are blended by weight (``special``:
    other weights for some targets), so that a single family stands for itself; a row without any member gets its
    target's prior, and 0.5 without one. Sums are combined before the shuffle.
    """
    family = F.create_map(*[F.lit(x) for f, ms in families.items() for m in ms for x in (m, f)])[F.col("model")]
    cells = {f"{t}:{f}": w for t, ws in (special or {}).items() for f, w in ws.items()}
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("family")]
    if cells:
        w = F.coalesce(F.create_map(*[F.lit(x) for pair in cells.items() for x in pair])[F.concat_ws(":", "target", "family")], w)
    means = zlogit(df.filter(family.isNotNull()), by).groupBy("study", "target", family.alias("family")).agg(F.avg("z").alias("z"))
    blended = means.withColumn("w", w).groupBy("study", "target").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))
    every = keys.select("study", "target").distinct().join(blended, ["study", "target"], "left").join(priors.select("target", F.col("p").alias("prior")), "target", "left")
    return every.select("study", "target", F.coalesce(F.when(F.col("z").isNotNull(), sigmoid(F.col("z"))), F.col("prior"), F.lit(0.5)).alias("p"))


def pool_windows(values: Column, mode: str) -> Column:
    """Pools an array of window probabilities: max, mean, logit_mean, top2, top3 or soft."""
    n = F.size(values)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    if mode == "max":
        return F.array_max(values)
    if mode == "mean":
        return mean(values)
    if mode == "logit_mean":
        return sigmoid(mean(F.transform(values, lambda x: logit(x))))
    if mode in ("top2", "top3"):
        return mean(F.slice(F.sort_array(values, asc=False), 1, F.least(F.lit(int(mode[3])), n)))
    if mode == "soft":
        weights = F.transform(values, F.exp)
        total = F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        return total / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"no such pooling: {mode}")
