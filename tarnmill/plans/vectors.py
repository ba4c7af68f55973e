"""Projection queries: components of the embeddings, fingerprints of the documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tarnmill.operators import projection
from tarnmill.plans.registry import query
from tarnmill.sources.tables import table

_COVARIANCE = """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT i, avg(v) AS m, count(*) AS n FROM x GROUP BY i), c AS (SELECT vec_id, x.i, v - m AS v, n FROM x JOIN m ON x.i = m.i)
SELECT a.i, b.i AS j, round(sum(a.v * b.v) / (any_value(a.n) - 1), 6) AS cov FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2"""


@query("embed_covariance", _COVARIANCE)
def embed_covariance(spark, sf_dir):
    """The covariances that the components are taken from."""
    vectors = table(spark, sf_dir, "embeddings")
    head = vectors.filter("embedding IS NOT NULL").select("embedding").first()[0]
    _, _, cov = projection.moments(vectors, "embedding", np.array(head, float))
    cells = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(cells, "i bigint, j bigint, cov double").withColumn("cov", F.round("cov", 6))


_EXPLAINED = """WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT count(*)::BIGINT AS n_axes, round(sum(s), 6) AS total FROM (SELECT var_samp(v) AS s FROM x GROUP BY i)"""


@query("embed_explained_variance", _EXPLAINED)
def embed_explained_variance(spark, sf_dir):
    """All axes together explain the sum of the variances of the components."""
    _, axes, values = projection.fit_pca(table(spark, sf_dir, "embeddings"), "embedding", 1 << 20)
    return table(spark, sf_dir, "embeddings").agg(F.lit(len(axes)).cast("bigint").alias("n_axes"), F.round(F.lit(float(values.sum())), 6).alias("total"))


@query("embed_sentence", None)
def embed_sentence(spark, sf_dir):
    """Every embedding in the first 16 principal axes, at unit length."""
    vectors = table(spark, sf_dir, "embeddings")
    mean, axes, _ = projection.fit_pca(vectors, "embedding", 16)
    return projection.apply_pca(vectors, "embedding", mean, axes, "reduced").select("vec_id", F.transform("reduced", lambda x: F.round(x, 6)).alias("reduced"))


_TFIDF = r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, ' ' || w || ' ' AS w FROM w),
g AS (SELECT doc_id, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) AS term FROM p),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
t AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term HAVING count(*) >= 3 ORDER BY total DESC, term LIMIT 60000),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM c JOIN t USING (term), n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x)
SELECT doc_id, count(*) AS n_terms, round(sum(w), 5) AS weight, round(max(w), 6) AS largest, round(sum(w * w), 6) AS length FROM u GROUP BY doc_id"""


@query("tfidf_char_fingerprint", _TFIDF)
def tfidf_char_fingerprint(spark, sf_dir):
    """TF-IDF of the character grams of 3 to 5 within words of every document."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, w: s + w)
    rows, _ = projection.term_rows(table(spark, sf_dir, "documents"), "doc_id", F.lower("text"))
    return rows.select(
        F.col("id").alias("doc_id"), F.size("ks").cast("bigint").alias("n_terms"), F.round(total("ws"), 5).alias("weight"), F.round(F.array_max("ws"), 6).alias("largest"),
        F.round(total(F.transform("ws", lambda w: w * w)), 6).alias("length"),
    )


@query("tfidf_svd_fingerprint", None)
def tfidf_svd_fingerprint(spark, sf_dir):
    """The documents in the first 64 singular directions of that matrix, at unit length."""
    out, _ = projection.svd_of_texts(table(spark, sf_dir, "documents"), "doc_id", F.lower("text"))
    return out.select(F.col("id").alias("doc_id"), F.transform("fingerprint", lambda x: F.round(x, 4)).alias("fingerprint"))
