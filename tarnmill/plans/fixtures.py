"""Bindings of the domain tables (studies, targets, predictions, series) to the driver's tables, for both engines.

Predictions and truths are derived from hashes of the ids, so that Spark and DuckDB make the same rows. The modulus
makes ties on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.sources.tables import table

#: The 12 targets in their fixed order.
TARGETS = (
    "acl", "mcl", "medial_meniscus", "lateral_meniscus", "medial_oa", "lateral_oa",
    "pf_oa", "effusion", "synovitis", "bakers", "contusion", "fracture",
)
MODELS = ("m1", "m2", "m3")


def hash_mod(n: int, *parts: Column) -> Column:
    """The first 32 bits of md5 of the parts joined by colons, modulo n."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint") % n


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, site, fold, is_gold, target, model, y, p): y is 1, 0, 0.5 (unsure) or null."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study"), F.col("source").alias("site"))
    rows = docs.withColumn("target", F.explode(F.array(*map(F.lit, TARGETS)))).withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    t = hash_mod(10, F.lit("truth"), F.col("target"), F.col("study"))
    y = F.when(t < 4, 1.0).when(t < 8, 0.0).when(t == 8, 0.5)
    raw = hash_mod(1000, F.col("model"), F.col("target"), F.col("study"))
    return rows.select(
        "study", "site", (F.col("study") % 5).alias("fold"), (F.col("study") % 7 == 0).alias("is_gold"), "target", "model", y.alias("y"),
        F.round(raw / 1000 * 0.7 + 0.3 * F.coalesce(y, F.lit(0.5)), 4).alias("p"),
    )


_TARGET_LIST = ", ".join(f"'{t}'" for t in TARGETS)
_MODEL_LIST = ", ".join(f"'{m}'" for m in MODELS)
#: CTEs ``tm`` and ``preds`` for DuckDB; continue with a comma or a SELECT.
PREDS_SQL = f"""WITH tm AS (SELECT doc_id AS study, source AS site, unnest([{_TARGET_LIST}]) AS target FROM documents),
tmm AS (SELECT *, unnest([{_MODEL_LIST}]) AS model FROM tm),
th AS (SELECT *, ('0x' || substr(md5('truth:' || target || ':' || study), 1, 8))::BIGINT % 10 AS t,
  ('0x' || substr(md5(model || ':' || target || ':' || study), 1, 8))::BIGINT % 1000 AS raw FROM tmm),
ty AS (SELECT *, CASE WHEN t < 4 THEN 1.0::DOUBLE WHEN t < 8 THEN 0.0 WHEN t = 8 THEN 0.5 END AS y FROM th),
preds AS (SELECT study, site, study % 5 AS fold, study % 7 = 0 AS is_gold, target, model, y,
  round(raw / 1000.0::DOUBLE * 0.7::DOUBLE + 0.3::DOUBLE * coalesce(y, 0.5::DOUBLE), 4) AS p FROM ty)"""


def one_model(spark: SparkSession, sf_dir: str, model: str = "m1") -> DataFrame:
    return predictions(spark, sf_dir).filter(F.col("model") == model)


#: What makes a row of lineitem unique.
SERIES_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, seq, plane, fluid, n_slices, and the columns of the key): lineitem as the table of image series."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("study"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("plane"), (F.col("l_linestatus") == "F").cast("int").alias("fluid"),
        (F.col("l_quantity") > 25).cast("int").alias("fat"), F.col("l_quantity").alias("n_slices"), "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
    )


SERIES_SQL = """WITH series AS (SELECT l_orderkey AS study, l_linenumber AS seq, l_returnflag AS plane, (l_linestatus = 'F')::INT AS fluid,
  (l_quantity > 25)::INT AS fat, l_quantity AS n_slices, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem)"""
