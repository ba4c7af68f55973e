"""Algorithms that are sequential by nature, run per bounded group inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_folds(df: DataFrame, targets: list[str], n_folds: int = 5, seed: int = 0, group_rows: int = 20_000) -> DataFrame:
    """(study, fold) with each target's positives spread over the folds.

    Rows are dealt one after the other, those with most positives first and in a seeded order among equals: to the fold
    that lacks most of the row's rarest positive target, or, without positives, most rows; the first of equals. Rows are
    cut into hash groups of about ``group_rows`` and each is dealt by itself in one pass, so no task holds more than a
    group. Unknown and unsure (0.5 counts as positive) follow ``y >= 0.5``; repeated rows are dealt each.
    """
    groups = max(1, round(df.count() / group_rows))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        y = (pdf[targets].fillna(0.0).to_numpy(float) >= 0.5).astype(int)
        order = np.lexsort((pdf["study"], pdf["_tm_order"], -y.sum(axis=1)))
        counts = y.sum(axis=0)
        rarest = np.where(y > 0, counts, np.iinfo(np.int64).max).argmin(axis=1)
        lack, room = np.tile(counts / n_folds, (n_folds, 1)), np.full(n_folds, len(y) / n_folds)
        fold = np.zeros(len(y), np.int32)
        for i in order:
            k = int((lack[:, rarest[i]] if y[i].any() else room).argmax())
            fold[i] = k
            lack[k] -= y[i]
            room[k] -= 1
        return pd.DataFrame({"study": pdf["study"], "fold": fold})

    keyed = df.select("study", *targets, F.xxhash64("study", F.lit(seed)).alias("_tm_order")).withColumn("_tm_g", F.pmod(F.xxhash64("study"), F.lit(groups)))
    return keyed.groupBy("_tm_g").applyInPandas(lambda pdf: deal(pdf), "study bigint, fold int")


def quota_per_group(df: DataFrame, by: str, slot: str, total: int) -> DataFrame:
    """(by, slot, quota): each group's total dealt to its slots in proportion to their sizes, never more than a size.

    Whole shares first, then one each to the largest remainders, the first slot among equals. Shares and remainders are
    whole numbers, so ties are exact; a group has few slots, which is all that its window sorts.
    """
    sizes = df.groupBy(by, slot).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(by)
    shares = sizes.withColumn("all", F.sum("n").over(group)).withColumn("share", F.col("n") * F.least(F.lit(total), F.col("all")))
    whole = shares.withColumn("whole", F.floor(F.col("share") / F.col("all"))).withColumn("rest", F.col("share") % F.col("all"))
    place = F.row_number().over(group.orderBy(F.desc("rest"), slot))
    left = F.least(F.lit(total), F.col("all")) - F.sum("whole").over(group)
    return whole.select(by, slot, (F.col("whole") + (place <= left).cast("int")).cast("int").alias("quota"))


def pick_unused(df: DataFrame, group: str, order: list[str], slots: list[tuple[str, int]], kind: str, flag: str, key: str) -> DataFrame:
    """(group, slot, key): each slot in turn takes an unused row of its kind, one with the wanted flag if there is one.

    A group is one study's list of series, which is short: it becomes one array, from which the slots pick by SQL
    expressions, one after the other.
    """
    one = F.struct(*order, F.col(kind).alias("kind"), F.col(flag).alias("flag"), F.col(key).alias("key"))
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    rows = rows.select(group, F.transform("rows", lambda r, i: F.struct(i.alias("i"), r["kind"].alias("kind"), r["flag"].alias("flag"), r["key"].alias("key"))).alias("rows"))
    rows = rows.withColumn("used", F.array().cast("array<int>"))
    for n, (wanted, wish) in enumerate(slots):
        free = F.filter("rows", lambda r: (r["kind"] == wanted) & ~F.array_contains("used", r["i"]))
        rows = rows.withColumn("free", free)
        rows = rows.withColumn(f"pick{n}", F.coalesce(F.get(F.filter("free", lambda r: r["flag"] == wish), F.lit(0)), F.get("free", F.lit(0))))
        rows = rows.withColumn("used", F.when(F.col(f"pick{n}").isNotNull(), F.array_append("used", F.col(f"pick{n}")["i"])).otherwise(F.col("used")))
    picked = F.array(*[F.struct(F.lit(n).alias("slot"), F.col(f"pick{n}")["key"].alias(key), F.col(f"pick{n}").isNotNull().alias("ok")) for n in range(len(slots))])
    return rows.select(group, F.explode(F.filter(picked, lambda x: x["ok"])).alias("p")).select(group, "p.slot", f"p.{key}")
