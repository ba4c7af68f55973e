"""Calibration and weight search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.operators.blend import logit, sigmoid
from tarnmill.operators.metrics import AucDialect, auc, clip
from tarnmill.sources.files import written

#: Fixed values: (cause, threshold, raised target, factor), applied one after the other; caps at 0.99.
COOCCURRENCE_RULES = (
    ("acl", 0.7, "contusion", 1.15),
    ("acl", 0.7, "medial_meniscus", 1.10),
    ("medial_oa", 0.7, "medial_meniscus", 1.12),
    ("effusion", 0.75, "synovitis", 1.10),
)


def apply_rules(wide: DataFrame) -> DataFrame:
    """Raises probabilities of co-occurring findings, in order, so raises compound; causes are never raised."""
    for cause, threshold, target, factor in COOCCURRENCE_RULES:
        wide = wide.withColumn(target, F.when(F.col(cause) > threshold, clip(F.col(target) * factor, 0.0, 0.99)).otherwise(F.col(target)))
    return wide


def grid(low: float, high: float, n: int) -> Column:
    """Evenly spaced values from low to high, an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.lit(low) + i * ((high - low) / (n - 1)), 6))


def fit_temperature(df: DataFrame, by: list[str], low: float = 0.05, high: float = 5.0, n: int = 100) -> DataFrame:
    """(by, temperature): least negative log likelihood over a fixed grid; the first of equals.

    Only y of 0 or 1 counts, and five rows are needed; else the temperature is 1. Equal predictions are counted before
    the grid is exploded, and its sums are combined before the shuffle.
    """
    equal = df.filter(F.col("y").isin(0.0, 1.0)).groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    rows = equal.select(*by, "y", "n", logit(F.col("p")).alias("z"), F.explode(grid(low, high, n)).alias("t"))
    q = clip(1 / (1 + F.exp(-F.col("z") / F.col("t"))), 1e-7, 1 - 1e-7)
    each = -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))
    loss = F.round(F.sum(each * F.col("n")) / F.sum(F.when(each.isNotNull(), F.col("n"))), 9)
    fits = rows.groupBy(*by, "t").agg(loss.alias("loss"), F.sum("n").alias("rows"))
    best = fits.groupBy(*by).agg(F.min(F.struct("loss", "t")).alias("best"), F.max("rows").alias("rows"))
    return best.select(*by, F.when(F.col("rows") >= 5, clip(F.col("best.t"), 0.1, 5.0)).otherwise(F.lit(1.0)).alias("temperature"))


def apply_temperature(p: Column, temperature: Column) -> Column:
    return clip(sigmoid(logit(p) / F.greatest(F.lit(1e-3), temperature), 700.0), 0.001, 0.999)


def cooccurrence(positives: DataFrame) -> DataFrame:
    """(i, j, p): share of studies with j that also have i, from distinct (study, target); the diagonal is 1.

    The self-join pairs the at most 12 targets of one study.
    """
    a, b = positives.select("study", F.col("target").alias("i")), positives.select("study", F.col("target").alias("j"))
    n = positives.groupBy(F.col("target").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    pairs = a.join(b, "study").groupBy("i", "j").agg(F.count(F.lit(1)).alias("both"))
    return pairs.join(n, "j").select("i", "j", (F.col("both") / F.col("n")).alias("p"))


def evidence(preds: DataFrame, matrix: DataFrame) -> DataFrame:
    """(study, target, y, p, e): the evidence of the study's other targets, null without any.

    Evidence for target i: sum over j of P(i given j) * p_j over the sum of P(i given j), the diagonal left out.
    The matrix has a row for each pair of the at most 12 targets; it is collected and becomes weights in the plan, so a
    study has one row of sums for all its targets, combined before the shuffle. The study's rows meet it unsorted.
    """
    c = {(r["i"], r["j"]): r["p"] for r in matrix.filter("i <> j").collect()}
    targets, causes = (sorted({pair[k] for pair in c}) for k in (0, 1))
    if not targets:
        return preds.select("study", "target", "y", "p", F.lit(None).cast("double").alias("e"))
    chosen = lambda names, value: F.coalesce(*[F.when(F.col("target") == x, value(x)) for x in names])
    weighed = preds.select("study", "p", chosen(causes, lambda j: F.array(*[F.lit(c.get((i, j))).cast("double") for i in targets])).alias("_tm_c"))
    share = lambda k: F.sum(F.col("_tm_c")[k] * F.col("p")) / F.sum(F.col("_tm_c")[k])
    found = weighed.groupBy("study").agg(*[share(k).alias(f"_tm_e{k}") for k in range(len(targets))])
    own = chosen(targets, lambda i: F.col(f"_tm_e{targets.index(i)}"))
    return preds.join(found.hint("shuffle_hash"), "study", "left").select("study", "target", "y", "p", own.alias("e"))


def raised(beta: Column | float) -> Column:
    """The probability of logit(p) plus beta times the logit of the evidence; p itself without evidence."""
    return F.coalesce(sigmoid(logit(F.col("p")) + beta * logit(F.col("e"))), F.col("p"))


def bayes_evidence(preds: DataFrame, matrix: DataFrame, beta: float) -> DataFrame:
    """(study, target, y, p) raised by the evidence of the study's other targets."""
    return evidence(preds, matrix).select("study", "target", "y", raised(beta).alias("p"))


def search_weight(wide: DataFrame, a: str, b: str, low: float, high: float, n: int, dialect: AucDialect) -> DataFrame:
    """(target, w, auc): the weight of b in (1 - w) a + w b with the best AUC per target; the first of equals.

    Equal rows are counted and written before the weights are exploded; blends move once.
    """
    equal = written(wide.groupBy("target", "y", a, b).agg(F.count(F.lit(1)).alias("_tm_rows")), "equal-scores")
    tried = equal.withColumn("w", F.explode(grid(low, high, n))).withColumn("p", F.round((1 - F.col("w")) * F.col(a) + F.col("w") * F.col(b), 6))
    scores = auc(tried, ["target", "w"], dialect, n="_tm_rows", few_equal=True).withColumn("auc", F.round("auc", 9))
    order = Window.partitionBy("target").orderBy(F.desc_nulls_last("auc"), "w")
    return scores.withColumn("k", F.row_number().over(order)).filter("k = 1").select("target", "w", F.round("auc", 6).alias("auc"))
