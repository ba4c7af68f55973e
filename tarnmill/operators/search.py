"""Searches for blend weights whose trial points are evaluated together over counts of distinct scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.metrics import clip
from tarnmill.operators.ranking import pair_areas
from tarnmill.sources.files import written

Values = Callable[[list[np.ndarray]], np.ndarray]


def score_counts(df: DataFrame, members: list[str], digits: int = 6) -> DataFrame:
    """(target, members, pos, neg): equal rows of (target, y, member scores) counted once, written to the shared folder.

    Unknown and unsure (0.5) y do not count, nor do rows that lack a member.
    """
    rows = df.filter(F.col("y").isNotNull() & (F.col("y") != 0.5))
    for m in members:
        rows = rows.filter(F.col(m).isNotNull()).withColumn(m, F.round(m, digits))
    pos = (F.col("y") >= 0.5).cast("long")
    return written(rows.groupBy("target", *members).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")), "score-counts")


def _blended(counts: DataFrame, members: list[str], points: list[np.ndarray]) -> DataFrame:
    """(target, point, p, pos, neg) for each of the few points (weights, divided by their sum)."""
    rows = [(k, [float(x) for x in np.asarray(w) / max(float(np.sum(w)), 1e-12)]) for k, w in enumerate(points)]
    table = counts.sparkSession.createDataFrame(rows, "point int, w array<double>")
    p = sum((F.col("w")[k] * F.col(m) for k, m in enumerate(members)), F.lit(0.0))
    return counts.crossJoin(F.broadcast(table)).select("target", "point", F.round(p, 9).alias("p"), "pos", "neg")


def _areas(blended: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) of the groups with both classes."""
    sums = pair_areas(blended, by, "p", "pos", "neg")
    return sums.filter("n1 > 0 AND n0 > 0").select(*by, (F.col("s") / (F.col("n1") * F.col("n0"))).alias("auc"))


def macro_aucs(counts: DataFrame, members: list[str]) -> Values:
    """The macro AUC of each of several points, in one job; the result is a number a point."""

    def values(points):
        found = dict(_areas(_blended(counts, members, points), ["target", "point"]).groupBy("point").agg(F.avg("auc")).collect())
        return np.array([found.get(k, 0.0) for k in range(len(points))])

    return values


def nelder_mead(values: Values, start: np.ndarray, steps: int = 20, size: float = 0.25, low: float = 0.0, high: float = 1.0, tol: float = 1e-6) -> tuple[np.ndarray, float, int]:
    """(best point, its value, jobs): maximises ``values`` over a box by the simplex method.

    A step asks for all that it may need at once: reflection, expansion, both contractions and the shrunken simplex, so
    it is one job whatever it then does. The simplex starts at ``start`` with one corner ``size`` away along each axis.
    It ends after ``steps`` or when the values and corners lie within ``tol``.
    """
    n = len(start)
    inside = lambda x: np.clip(x, low, high)
    corners = [inside(np.array(start, float))]
    for k in range(n):
        corner = corners[0].copy()
        corner[k] += size if corner[k] + size <= high else -size
        corners.append(inside(corner))
    simplex, jobs = np.array(corners), 1
    f = values(list(simplex))
    for _ in range(steps):
        order = np.argsort(-f, kind="stable")
        simplex, f = simplex[order], f[order]
        if f[0] - f[-1] <= tol and np.abs(simplex[1:] - simplex[0]).max() <= tol:
            break
        centre, worst = simplex[:-1].mean(axis=0), simplex[-1]
        tried = [inside(centre + a * (centre - worst)) for a in (1.0, 2.0, 0.5, -0.5)]
        shrunk = [inside(simplex[0] + 0.5 * (x - simplex[0])) for x in simplex[1:]]
        got, jobs = values([*tried, *shrunk]), jobs + 1
        reflected, expanded, outer, inner = got[:4]
        if reflected > f[0]:
            simplex[-1], f[-1] = (tried[1], expanded) if expanded > reflected else (tried[0], reflected)
        elif reflected > f[-2]:
            simplex[-1], f[-1] = tried[0], reflected
        elif reflected > f[-1] and outer >= reflected:
            simplex[-1], f[-1] = tried[2], outer
        elif reflected <= f[-1] and inner > f[-1]:
            simplex[-1], f[-1] = tried[3], inner
        else:
            simplex[1:], f[1:] = shrunk, got[4:]
    k = int(np.argmax(f))
    return simplex[k], float(f[k]), jobs


def fit_simplex(df: DataFrame, members: list[str], steps: int = 20) -> tuple[dict[str, float], float, int]:
    """(weights of sum 1, macro AUC, jobs) of the best blend of the members of df (study, target, y, members)."""
    point, value, jobs = nelder_mead(macro_aucs(score_counts(df, members), members), np.full(len(members), 1 / len(members)), steps)
    return {m: float(w) for m, w in zip(members, point / max(point.sum(), 1e-12))}, value, jobs


def _losses(blended: DataFrame, by: list[str]) -> DataFrame:
    p = clip(F.col("p"), 1e-7, 1 - 1e-7)
    return blended.groupBy(*by).agg((F.sum(-(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))) / F.sum(F.col("pos") + F.col("neg"))).alias("value"))


def bounded_weights(df: DataFrame, a: str, b: str, objective: str = "log_loss", tol: float = 1e-4, bracket: int = 9) -> DataFrame:
    """(target, w, value): the weight of b in (1 - w) a + w b, in [0, 1], with the least log loss or the best AUC per target.

    All targets are searched at once. One job scores ``bracket`` even points for each; the best one's neighbours bound a
    golden section search, in which every round is one aggregate with one new point a target. The log loss of a mix is
    convex in w, so its search ends within ``tol`` of the optimum; for AUC, which has steps, it ends at the best point
    tried, the smallest of equals.
    """
    if objective not in ("log_loss", "auc"):
        raise ValueError(f"no objective {objective}")
    counts, spark = score_counts(df, [a, b]), df.sparkSession

    def values(points: list[tuple[str, float]]) -> dict[tuple[str, float], float]:
        table = spark.createDataFrame(points, "target string, point double")
        rows = counts.join(F.broadcast(table), "target").select("target", "point", F.round((1 - F.col("point")) * F.col(a) + F.col("point") * F.col(b), 9).alias("p"), "pos", "neg")
        found = _losses(rows, ["target", "point"]) if objective == "log_loss" else _areas(rows, ["target", "point"]).select("target", "point", (-F.col("auc")).alias("value"))
        return {(t, w): v for t, w, v in found.collect()}

    targets = sorted(r[0] for r in counts.select("target").distinct().collect())  # few, by definition
    even = [k / (bracket - 1) for k in range(bracket)]
    known = values([(t, w) for t in targets for w in even]) if targets else {}
    targets = [t for t in targets if (t, even[0]) in known]
    ratio, ends, inner = (5**0.5 - 1) / 2, {}, {}
    for t in targets:
        k = min(range(bracket), key=lambda i: (known[t, even[i]], i))
        low, high = even[max(0, k - 1)], even[min(bracket - 1, k + 1)]
        ends[t], inner[t] = (low, high), (high - ratio * (high - low), low + ratio * (high - low))
    if targets:
        known |= values([(t, w) for t in targets for w in inner[t]])
    while targets and max(ends[t][1] - ends[t][0] for t in targets) > tol:
        asked = []
        for t in targets:
            (low, high), (x, y) = ends[t], inner[t]
            if known[t, x] <= known[t, y]:
                ends[t], inner[t] = (low, y), (y - ratio * (y - low), x)
                asked.append((t, inner[t][0]))
            else:
                ends[t], inner[t] = (x, high), (y, x + ratio * (high - x))
                asked.append((t, inner[t][1]))
        known |= values(asked)
    best = [(t, *min(((v, w) for (u, w), v in known.items() if u == t))) for t in targets]
    sign = 1.0 if objective == "log_loss" else -1.0
    return spark.createDataFrame([(t, float(w), sign * float(v)) for t, v, w in best], "target string, w double, value double")
