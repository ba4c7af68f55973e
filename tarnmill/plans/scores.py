"""Flagship query: centroid scores of the embeddings, one-vs-rest AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.operators.metrics import AucDialect, auc
from tarnmill.plans.registry import query
from tarnmill.sources.tables import table


def centroid_scores(vectors: DataFrame) -> DataFrame:
    """(vec_id, target, y, p): cosine of every vector to every class centroid, rounded to 4 decimals.

    Centroids are one small aggregate (classes x dimensions), joined back by broadcast only as AQE finds it small.
    """
    cells = vectors.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    centroids = (
        cells.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("c"))
        .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("cs"))
        .select(F.col("label").alias("target"), F.transform("cs", lambda x: x["c"]).alias("centroid"))
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    e, c = F.col("embedding"), F.col("centroid")
    return vectors.crossJoin(centroids).select(
        "vec_id", "target", (F.col("label") == F.col("target")).cast("int").alias("y"),
        F.round(dot(e, c) / (F.sqrt(dot(e, e)) * F.sqrt(dot(c, c))), 4).alias("p"),
    )


_CENTROID_SQL = """
WITH cells AS (SELECT vec_id, label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
cen AS (SELECT label AS target, pos, avg(v) AS c FROM cells GROUP BY 1, 2),
scores AS (SELECT cells.vec_id, cen.target, (cells.label = cen.target)::INT AS y,
  round(sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 4) AS p
  FROM cells JOIN cen USING (pos) GROUP BY 1, 2, 3),
ranked AS (SELECT target, y, rank() OVER (PARTITION BY target ORDER BY p)
  + (count(*) OVER (PARTITION BY target, p) - 1) / 2.0 AS r FROM scores),
auc AS (SELECT target, sum(y) AS n_pos, sum(1 - y) AS n_neg, sum(CASE WHEN y = 1 THEN r END) AS r_pos FROM ranked GROUP BY 1)
SELECT round(avg((r_pos - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)), 6) AS macro_auc, count(*) AS n_targets
FROM auc WHERE n_pos > 0 AND n_neg > 0"""


@query("auc_embeddings_macro", _CENTROID_SQL)
def auc_embeddings_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = centroid_scores(table(spark, sf_dir, "embeddings"))
    found = auc(scores, ["target"], AucDialect(positive="=")).filter("n_pos > 0 AND n_neg > 0")
    return found.agg(F.round(F.avg("auc"), 6).alias("macro_auc"), F.count(F.lit(1)).alias("n_targets"))
