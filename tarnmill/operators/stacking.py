"""Second-level models over the scores of all targets: out-of-fold neighbour regressions and stored linear models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.ranking import with_rank
from tarnmill.sources.files import written

#: Newton steps at most, and the largest change of a coefficient at which they end.
STEPS, TOLERANCE = 30, 1e-9


def standardised(df: DataFrame, by: list[str], value: str, out: str, eps: float = 1e-6) -> DataFrame:
    """``df`` with (value - mean) / (standard deviation + eps) within ``by`` as ``out``; the statistics are one combined
    aggregate, joined back."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_tm_m"), F.stddev_pop(value).alias("_tm_s"))
    return df.join(stats, by).withColumn(out, (F.col(value) - F.col("_tm_m")) / (F.col("_tm_s") + eps)).drop("_tm_m", "_tm_s")


def _design(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fold, z, y) of a batch (fold, z, y); unknown y is NaN."""
    z = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
    y = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
    return batch.column(0).to_numpy(zero_copy_only=False), np.nan_to_num(z), y


def fit_neighbours(rows: DataFrame, neighbours: list[list[int]], folds: list[int], c: float = 0.1) -> np.ndarray:
    """(targets, folds, targets + 1) coefficients, intercept last, from rows (fold, z, y) with arrays over the targets.

    The model of target j for fold f is a logistic regression of y[j] on z of the neighbours of j over the rows of all
    other folds, with the penalty |w|^2 / 2 + c * loss and a free intercept. Rows with unknown or unsure (0.5) y do not
    count. A Newton step is one job for all models: tasks add up gradients and Hessians, and only these sums, targets x
    folds x (neighbours + 1)^2 numbers, reach the driver. A model without both classes keeps zero coefficients.
    """
    n, spark = len(neighbours), rows.sparkSession
    beta = np.zeros((n, len(folds), n + 1))
    used = [np.array([*k, n]) for k in neighbours]
    sizes = [len(u) * (len(u) + 1) + 2 for u in used]
    starts = np.concatenate([[0], np.cumsum(np.repeat(sizes, len(folds)))])
    schema = pa.schema([("slot", pa.int32()), ("s", pa.float64())])
    for _ in range(STEPS):
        sent = spark.sparkContext.broadcast(beta)

        def add_up(batches):
            sums = np.zeros(starts[-1])
            for batch in batches:
                fold, z, y = _design(batch, n)
                x = np.column_stack([z, np.ones(len(z))])
                for j in range(n):
                    known = ~np.isnan(y[:, j]) & (y[:, j] != 0.5)
                    for f, held in enumerate(folds):
                        at = known & (fold != held)
                        a, t = x[at][:, used[j]], (y[at, j] >= 0.5).astype(float)
                        p = 1 / (1 + np.exp(-np.clip(a @ sent.value[j, f, used[j]], -500, 500)))
                        part = np.concatenate([(a.T @ (a * (p * (1 - p))[:, None])).ravel(), a.T @ (p - t), [t.sum(), (1 - t).sum()]])
                        sums[starts[j * len(folds) + f] :][: len(part)] += part
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], schema=schema)

        got = rows.select("fold", "z", "y").mapInArrow(add_up, "slot int, s double").groupBy("slot").agg(F.sum("s").alias("s")).toArrow()
        sums = np.zeros(starts[-1])
        sums[got["slot"].to_numpy()] = got["s"].to_numpy()
        sent.unpersist()
        moved = 0.0
        for j in range(n):
            m = len(used[j])
            for f in range(len(folds)):
                part = sums[starts[j * len(folds) + f] :][: sizes[j]]
                if not (part[-1] and part[-2]):
                    continue
                penalty = np.append(np.ones(m - 1), 0.0)
                now = beta[j, f, used[j]]
                step = np.linalg.solve(c * part[: m * m].reshape(m, m) + np.diag(penalty), c * part[m * m : -2] + penalty * now)
                beta[j, f, used[j]] = now - step
                moved = max(moved, np.abs(step).max())
        if moved < TOLERANCE:
            break
    return beta


def neighbour_prior(df: DataFrame, targets: tuple[str, ...], neighbours: dict[str, list[str]] | None = None, alpha: float = 0.1, c: float = 0.1) -> DataFrame:
    """(study, target, prior, z): z mixed with what the other targets of the study say of it.

    ``df``: (study, fold, target, y, z), one row a study and target. The logit of the out-of-fold regression on the
    neighbours (all other targets unless given), standardised within target and fold, is the prior; the result is
    (1 - alpha) z + alpha prior. No study's own fold enters its model. A missing z counts as 0 and stays null in the
    result; without a model the prior is 0.
    """
    order = {t: k for k, t in enumerate(targets)}
    links = [[order[x] for x in (neighbours[t] if neighbours else [x for x in targets if x != t])] for t in targets]
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("target")]
    cell = lambda c: F.transform(F.sequence(F.lit(0), F.lit(len(targets) - 1)), lambda k: F.element_at(c, k))
    maps = df.groupBy("study", "fold").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.struct("z", "y").alias("v")))).alias("m"))
    both = maps.select("study", "fold", cell(F.col("m")).alias("v"))
    rows = written(both.select("study", "fold", F.transform("v", lambda x: x["z"]).alias("z"), F.transform("v", lambda x: x["y"].cast("double")).alias("y")), "neighbours")
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())  # few, by definition
    sent = rows.sparkSession.sparkContext.broadcast(fit_neighbours(rows, links, folds, c))
    n = len(targets)

    def score(batches):
        for batch in batches:
            fold, z, _ = _design(batch.select([1, 2, 3]), n)
            at = np.searchsorted(folds, fold)
            x = np.column_stack([z, np.ones(len(z))])
            eta = np.einsum("rk,jrk->rj", x, sent.value[:, at, :])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(eta.tolist(), pa.list_(pa.float64()))], names=["study", "fold", "z", "eta"])

    kind = rows.schema
    scored = rows.mapInArrow(score, f"study {kind['study'].dataType.simpleString()}, fold {kind['fold'].dataType.simpleString()}, z array<double>, eta array<double>")
    names = F.array(*map(F.lit, targets))
    long = scored.select("study", "fold", F.posexplode(F.arrays_zip("z", "eta")).alias("k", "v")).select("study", "fold", names[F.col("k")].alias("target"), F.col("v.z").alias("z"), F.col("v.eta").alias("eta"))
    prior = standardised(written(long, "priors"), ["target", "fold"], "eta", "prior")
    return prior.select("study", "target", "prior", ((1 - alpha) * F.col("z") + alpha * F.col("prior")).alias("z"))


def linear_scores(features: DataFrame, model: DataFrame, intercepts: dict[str, float]) -> DataFrame:
    """(study, target, score) from features (study, feature, value) and a stored model (target, feature, mean, scale, coef).

    Sum over the features of (value - mean) / scale * coef, plus the target's intercept; a scale of at most 1e-8 in
    size counts as 1. The model is a parameter of fixed size and is broadcast; products are combined before the shuffle.
    """
    scale = F.when(F.abs("scale") <= 1e-8, 1.0).otherwise(F.col("scale"))
    each = (F.col("value") - F.col("mean")) / scale * F.col("coef")
    sums = features.join(F.broadcast(model), "feature").groupBy("study", "target").agg(F.sum(each).alias("s"))
    start = F.create_map(*[F.lit(x) for pair in intercepts.items() for x in pair])[F.col("target")]
    return sums.select("study", "target", (F.col("s") + F.coalesce(start, F.lit(0.0))).alias("score"))


def gated(base: DataFrame, scores: DataFrame, gates: dict[str, float], digits: int = 9) -> DataFrame:
    """(study, target, p): percentile ranks of base (study, target, p), with those of the scores mixed into the gated targets.

    A target with gate g becomes the rank of (1 - g) * rank(p) + g * rank(score); the others keep the rank of p.
    Values are rounded before they are ranked, so that the order of a sum makes no ties or breaks them.
    """
    gate = F.coalesce(F.create_map(*[F.lit(x) for pair in gates.items() for x in pair])[F.col("target")], F.lit(0.0))
    own = with_rank(written(base.withColumn("p", F.round("p", digits)), "gate-base"), "r", "p", ["target"], "pct").select("study", "target", "r")
    asked = scores.filter(gate > 0).withColumn("score", F.round("score", digits))
    other = with_rank(written(asked, "gate-scores"), "q", "score", ["target"], "pct").select("study", "target", "q")
    mixed = own.join(other, ["study", "target"], "left").withColumn("m", F.round(F.when(F.col("q").isNotNull(), (1 - gate) * F.col("r") + gate * F.col("q")).otherwise(F.col("r")), digits))
    again = with_rank(written(mixed, "gate-mixed"), "p", "m", ["target"], "pct")
    return again.select("study", "target", F.when(gate > 0, F.col("p")).otherwise(F.col("r")).alias("p"))
