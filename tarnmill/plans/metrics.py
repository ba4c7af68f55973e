"""Metric queries: eight AUC dialects, Brier, weighted BCE, confusion tables, model selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.operators import metrics
from tarnmill.plans import fixtures
from tarnmill.plans.fixtures import PREDS_SQL
from tarnmill.plans.registry import query


def _auc_sql(d: metrics.AucDialect) -> str:
    where = ["y IS NOT NULL"] + ["y <> 0.5"] * d.drop_half + ["p IS NOT NULL"] * d.drop_null_p
    positive = {">=": "y >= 0.5", ">": "y > 0.5", "=": "y = 1"}[d.positive]
    single = "NULL" if d.single_class is None else str(d.single_class)
    counted = "auc" if d.macro_counts_single else "CASE WHEN n_pos > 0 AND n_neg > 0 THEN auc END"
    return f"""{PREDS_SQL},
r AS (SELECT model, target, ({positive})::INT AS pos, rank() OVER (PARTITION BY model, target ORDER BY p) + (count(*) OVER (PARTITION BY model, target, p) - 1) / 2.0 AS r
  FROM preds WHERE {" AND ".join(where)}),
s AS (SELECT model, target, sum(pos) AS n_pos, sum(1 - pos) AS n_neg, sum(r) FILTER (pos = 1) AS rs FROM r GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN n_pos > 0 AND n_neg > 0 AND n_pos + n_neg >= {d.min_rows} THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) ELSE {single} END AS auc FROM s)
SELECT model, round(avg({counted}), 6) AS macro_auc, count({counted}) AS n_targets FROM a GROUP BY model"""


def _register_auc(name: str, d: metrics.AucDialect) -> None:
    @query(f"auc_{name}", _auc_sql(d))
    def run(spark, sf_dir):
        return metrics.macro(metrics.auc(fixtures.predictions(spark, sf_dir), ["model", "target"], d), ["model"], dialect=d)


for _name, _dialect in metrics.DIALECTS.items():
    _register_auc(_name, _dialect)


@query("metric_brier", PREDS_SQL + " SELECT model, target, round(avg((y - p) * (y - p)), 6) AS brier FROM preds WHERE y IS NOT NULL GROUP BY 1, 2")
def metric_brier(spark, sf_dir):
    return fixtures.predictions(spark, sf_dir).filter("y IS NOT NULL").groupBy("model", "target").agg(F.round(metrics.brier(), 6).alias("brier"))


_BCE = """ , l AS (SELECT target, CASE WHEN is_gold THEN 1.0 ELSE 0.8 END AS w, y * (1 - 2 * 0.05) + 0.05 AS t, greatest(1e-7, least(1 - 1e-7, p)) AS q FROM preds WHERE model = 'm1' AND y IS NOT NULL)
SELECT target, round(sum(-(t * ln(q) + (1 - t) * ln(1 - q)) * w) / (sum(w) + 1e-7), 6) AS loss FROM l GROUP BY target"""


@query("metric_weighted_bce", PREDS_SQL + _BCE)
def metric_weighted_bce(spark, sf_dir):
    rows = fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL").withColumn("w", F.when(F.col("is_gold"), 1.0).otherwise(0.8))
    return rows.groupBy("target").agg(F.round(metrics.weighted_bce("y", "p", "w", 0.05), 6).alias("loss"))


_SPLIT = """ SELECT target, CASE WHEN is_gold THEN 'gold' ELSE 'silver' END AS split, count(*) FILTER (y > 0.5) AS n_pos, count(*) FILTER (y <= 0.5) AS n_neg,
 count(*) FILTER (y > 0.5) < 5 AS few FROM preds WHERE model = 'm1' GROUP BY 1, 2"""


@query("metric_split_report", PREDS_SQL + _SPLIT)
def metric_split_report(spark, sf_dir):
    """Counts of the gold and the silver split; 0.5 counts as negative here; under five positives is flagged."""
    n_pos = F.sum(F.coalesce((F.col("y") > 0.5).cast("long"), F.lit(0)))
    n_neg = F.sum(F.coalesce((F.col("y") <= 0.5).cast("long"), F.lit(0)))
    return (
        fixtures.one_model(spark, sf_dir).groupBy("target", F.when(F.col("is_gold"), "gold").otherwise("silver").alias("split"))
        .agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"), (n_pos < 5).alias("few"))
    )


_SELECT = _auc_sql(metrics.DIALECTS["training"]).replace(
    "SELECT model, round(avg(", ", m AS (SELECT model, round(avg("
).rstrip() + """)
SELECT model, macro_auc FROM (SELECT *, row_number() OVER (ORDER BY macro_auc DESC NULLS LAST, model) AS k FROM m) WHERE k = 1"""


@query("metric_model_selection", _SELECT)
def metric_model_selection(spark, sf_dir):
    """The model with the best macro AUC; ties go to the first name. One row per model reaches the window."""
    scores = metrics.macro(metrics.auc(fixtures.predictions(spark, sf_dir), ["model", "target"], metrics.DIALECTS["training"]), ["model"])
    return scores.select("model", "macro_auc").orderBy(F.desc_nulls_last("macro_auc"), "model").limit(1)


_CONF = """ , n AS (SELECT target, count(*) FILTER (t AND c) AS tp, count(*) FILTER (t AND NOT c) AS fn, count(*) FILTER (NOT t AND c) AS fp, count(*) FILTER (NOT t AND NOT c) AS tn
 FROM (SELECT target, y >= 0.5 AS t, p >= 0.5 AS c FROM preds WHERE model = 'm1' AND y IS NOT NULL AND y <> 0.5) GROUP BY target)
SELECT *, round((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
 round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
 round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv,
 round(fn / nullif(tp + fn, 0)::DOUBLE, 6) AS miss_rate, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_alarm_rate FROM n"""


@query("audit_confusion", PREDS_SQL + _CONF)
def audit_confusion(spark, sf_dir):
    rows = fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL AND y <> 0.5")
    return metrics.confusion(rows, ["target"], F.col("y") >= 0.5, F.col("p") >= 0.5)


_CORR = """ , w AS (SELECT target, study, max(p) FILTER (model = 'm1') AS a, max(p) FILTER (model = 'm2') AS b FROM preds GROUP BY 1, 2),
c AS (SELECT target, CASE WHEN stddev_pop(a) >= 1e-12 AND stddev_pop(b) >= 1e-12 THEN corr(a, b) END AS r FROM w GROUP BY target)
SELECT round(avg(r), 6) AS mean_corr, count(r) AS n_targets FROM c"""


@query("metric_pred_corr", PREDS_SQL + _CORR)
def metric_pred_corr(spark, sf_dir):
    """Mean over targets of the Pearson correlation of two models, constant columns left out."""
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p")))
    wide = fixtures.predictions(spark, sf_dir).groupBy("target", "study").agg(one("m1").alias("a"), one("m2").alias("b"))
    varies = (F.stddev_pop("a") >= 1e-12) & (F.stddev_pop("b") >= 1e-12)
    return wide.groupBy("target").agg(F.when(varies, F.corr("a", "b")).alias("r")).agg(F.round(F.avg("r"), 6).alias("mean_corr"), F.count("r").alias("n_targets"))


_DEGEN = """ , s AS (SELECT model, target, stddev_samp(p) AS sd FROM preds GROUP BY 1, 2)
SELECT model, round(avg(sd), 6) AS mean_sd, avg(sd) < 1e-4 AS constant FROM s GROUP BY model"""


@query("validate_degenerate", PREDS_SQL + _DEGEN)
def validate_degenerate(spark, sf_dir):
    per = fixtures.predictions(spark, sf_dir).groupBy("model", "target").agg(F.stddev_samp("p").alias("sd"))
    return per.groupBy("model").agg(F.round(F.avg("sd"), 6).alias("mean_sd"), (F.avg("sd") < 1e-4).alias("constant"))


@query("metric_efficiency", PREDS_SQL + """, s AS (SELECT target, model, avg(p) AS score, count(*) / 1000.0::DOUBLE AS seconds FROM preds GROUP BY 1, 2)
SELECT target, model, round(CASE WHEN score > 0.45 THEN seconds / (((score - 0.45::DOUBLE) / (0.9::DOUBLE - 0.45)) * ((score - 0.45::DOUBLE) / (0.9::DOUBLE - 0.45))) END, 4) AS efficiency FROM s""")
def metric_efficiency(spark, sf_dir):
    """A cost over the squared gain of each model and target, with mean scores for the quality."""
    rows = fixtures.predictions(spark, sf_dir).groupBy("target", "model").agg(F.avg("p").alias("score"), (F.count(F.lit(1)) / 1000.0).alias("seconds"))
    return rows.select("target", "model", F.round(metrics.efficiency(F.col("seconds"), F.col("score"), 0.45, 0.9), 4).alias("efficiency"))
