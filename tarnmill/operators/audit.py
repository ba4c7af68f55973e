"""Audits of labels against predictions, confident learning, output checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.metrics import bce
from tarnmill.operators.ranking import with_position
from tarnmill.sources.files import written


def _n(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    return df.groupBy(*by).agg(
        F.round(_n(y.isin(0.0, 1.0)) / F.count(F.lit(1)) * 100, 4).alias("coverage"), _n((y == 0.5) | y.isNull()).alias("n_unsure"), (_n(y == 1) < 5).alias("few"),
        F.concat(_n((y == 1) & (p >= 0.5)).cast("string"), F.lit("/"), _n(y == 1).cast("string")).alias("found"),
    )


def agreement(df: DataFrame, by: list[str]) -> DataFrame:
    y, called = F.col("y"), F.col("p") >= 0.5
    covered = y.isin(0.0, 1.0)
    return df.groupBy(*by).agg(
        _n(covered).alias("covered"), F.round(F.try_divide(_n(covered & ((y == 1) == called)), _n(covered)), 6).alias("agreement"),
        _n((y == 0) & called).alias("spurious"), _n((y == 1) & ~called).alias("missed"), _n(y.isNull() & called).alias("unmentioned"),
    )


def silent_phantom(df: DataFrame, high: float = 0.85, low: float = 0.15) -> DataFrame:
    """Findings that the model sees and the label does not (silent), and the reverse (phantom), with their loss."""
    y, p = F.col("y"), F.col("p")
    rows = df.filter(((p >= high) & (y <= 0.2)) | ((p <= low) & (y >= 0.8)))
    return rows.select("study", "target", F.round(bce(y, p, 0.0, 1e-6), 6).alias("loss"), F.when(p >= high, "silent").otherwise("phantom").alias("kind"))


def radar(df: DataFrame) -> DataFrame:
    """Per study: Brier score, concordance, the largest difference and where it is (ties: the last target by name)."""
    d = F.abs(F.col("y") - F.col("p"))
    return df.groupBy("study").agg(
        F.round(F.avg(d * d), 6).alias("brier"), F.round(_n((F.col("y") >= 0.5) == (F.col("p") >= 0.5)) / F.count(F.lit(1)), 6).alias("concordance"),
        F.round(F.max(d), 4).alias("max_diff"), F.max_by("target", F.struct(F.round(d, 4), F.col("target"))).alias("worst"), (F.max(d) >= 0.5).alias("flagged"),
    )


def confident_learning(df: DataFrame) -> DataFrame:
    """(target, study, rank, abs_diff): likely label errors after Northcutt et al. 2021, pruned by noise rate.

    A class's threshold is the mean probability that its labelled rows get for it. The confident joint counts rows by
    label and by the class whose threshold they pass (the likelier one if both). Its off-diagonal share times the
    class's size is the number of errors, taken by the least margin. Two combined aggregates give a few numbers per
    target; positions come from counts of distinct margins.
    """
    y, p = F.col("y"), F.col("p")
    margin = F.when(y == 1, p - (1 - p)).otherwise((1 - p) - p)
    rows = written(df.filter(y.isin(0.0, 1.0)).select("study", "target", "y", "p", margin.alias("margin")), "labelled")
    limits = rows.groupBy("target").agg(
        F.avg(F.when(y == 1, p)).alias("t1"), F.avg(F.when(y == 0, 1 - p)).alias("t0"), _n(y == 1).alias("n1"), _n(y == 0).alias("n0")
    )
    one, zero = p >= F.col("t1"), (1 - p) >= F.col("t0")
    called = F.when(one & zero, F.when(p > 1 - p, 1).otherwise(0)).when(one, 1).when(zero, 0)
    joint = rows.join(limits, "target").groupBy("target", "n1", "n0").agg(
        *[_n((y == a) & (called == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    share = lambda off, on: F.coalesce(F.try_divide(F.col(off), F.col(off) + F.col(on)), F.lit(0.0))
    errors = joint.select("target", F.floor(F.col("n1") * share("c10", "c11") + 0.5).alias("k1"), F.floor(F.col("n0") * share("c01", "c00") + 0.5).alias("k0"))
    ranked = with_position(rows, "m", "margin", "study", ["target", "y"]).join(errors, "target")
    found = ranked.filter(F.col("m") <= F.when(y == 1, F.col("k1")).otherwise(F.col("k0")))
    own = F.when(y == 1, p).otherwise(1 - p)
    placed = with_position(written(found.select("target", "study", "y", "p", own.alias("own")), "issues"), "rank", "own", "study", ["target"])
    return placed.select("target", "study", "rank", F.round(F.abs(y - p), 4).alias("abs_diff"))


def validate(out: DataFrame, required: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(name, passed) for the checks of an output: rows, unique ids, the required ids, no null, values in [0, 1]."""
    cells = F.array(*[F.col(v).cast("double") for v in values])
    have = out.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids"), F.sum(F.exists(cells, lambda x: x.isNull()).cast("long")).alias("nulls"),
        F.sum(F.exists(cells, lambda x: F.coalesce((x < 0) | (x > 1), F.lit(False))).cast("long")).alias("outside"),
    )
    want = required.agg(F.count(F.lit(1)).alias("wanted"))
    sides = out.select(key, F.lit(1).alias("_a")).distinct().join(required.select(key, F.lit(1).alias("_b")).distinct(), key, "full")
    odd = sides.agg(F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("odd"))
    checks = {
        "rows": F.col("rows") == F.col("wanted"), "unique": F.col("rows") == F.col("ids"), "same_ids": F.col("odd") == 0,
        "no_null": F.coalesce("nulls", F.lit(0)) == 0, "in_range": F.coalesce("outside", F.lit(0)) == 0,
    }
    one = have.crossJoin(want).crossJoin(odd)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in checks.items()])).alias("c")).select("c.name", "c.passed")


def contract(out: DataFrame, required: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    """(name, passed) for an output's contract: its columns by name and order, numbers in the value columns, all finite, and
    then what ``validate`` checks, with the first column as the key."""
    numeric = all(dict(out.dtypes).get(v, "").split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") for v in values)
    cells = F.array(*[F.col(v).cast("double") for v in values]) if numeric else F.array().cast("array<double>")
    odd = out.agg(F.coalesce(F.sum(F.exists(cells, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))).cast("long")), F.lit(0)).alias("odd"))
    checks = {"columns": F.lit(out.columns == columns), "numeric": F.lit(numeric), "finite": F.col("odd") == 0}
    first = odd.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in checks.items()])).alias("c")).select("c.name", "c.passed")
    return first.unionByName(validate(out, required, columns[0], values)) if numeric and set(columns) <= set(out.columns) else first


def realigned(out: DataFrame, required: DataFrame, key: str, columns: list[str], defaults: dict[str, float]) -> DataFrame:
    """One row for each required id with the columns in order; an id that the output lacks gets the defaults."""
    have = out.dropDuplicates([key])
    return required.select(key).distinct().join(have, key, "left").select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in columns))
