"""Image and array-archive queries. Images are made of the embeddings: 16 vectors of 64 components are one of 32 x 32
pixels, dark but for the components of some size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.operators import images
from tarnmill.plans.registry import query
from tarnmill.sources import arrays
from tarnmill.sources.tables import table

SIDE, VECTORS = 32, 16


def pictures(spark, sf_dir: str) -> DataFrame:
    """(image, pixels, width) of the images with all their vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / VECTORS).alias("image"), F.struct("vec_id", "embedding").alias("v"))
    joined = rows.groupBy("image").agg(F.array_sort(F.collect_list("v")).alias("vs")).filter(F.size("vs") == VECTORS)
    bright = lambda x: F.when(F.abs(x.cast("double")) > 0.3, F.floor(F.least(F.lit(255.0), F.abs(x.cast("double")) * 500))).otherwise(0).cast("int")
    return joined.select("image", F.transform(F.flatten(F.transform("vs", lambda v: v["embedding"])), bright).alias("pixels"), F.lit(SIDE).alias("width"))


_PICTURES = f"""WITH one AS (SELECT vec_id // {VECTORS} AS image, vec_id % {VECTORS} AS part, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings),
px AS (SELECT image, part * 64 + j AS i, CASE WHEN abs(x) > 0.3::DOUBLE THEN floor(least(255.0::DOUBLE, abs(x) * 500))::INT ELSE 0 END AS v FROM one),
whole AS (SELECT image FROM px GROUP BY image HAVING count(*) = {SIDE * SIDE})"""


@query("img_window", "SELECT vec_id, list_transform(embedding, lambda x: floor((greatest(-1.0::DOUBLE, least(0.0::DOUBLE, x::DOUBLE)) + 1) * 255)::INT) AS pixels FROM embeddings")
def img_window(spark, sf_dir):
    """Embeddings stand in for pixel rows: a window around 0 of width 2, whose band is -1 to 0."""
    return table(spark, sf_dir, "embeddings").select("vec_id", images.window(F.col("embedding"), 0.0, 2.0).alias("pixels"))


_CROP = (
    _PICTURES
    + f""", hit AS (SELECT image, i // {SIDE} AS r, i % {SIDE} AS c FROM px WHERE v > 10),
box AS (SELECT image, m, coalesce(greatest(0, min(r) - m), 0) AS top, coalesce(least({SIDE}, max(r) + m + 1), {SIDE}) AS bottom, coalesce(greatest(0, min(c) - m), 0) AS lft, coalesce(least({SIDE}, max(c) + m + 1), {SIDE}) AS rgt
  FROM whole CROSS JOIN (SELECT unnest([{", ".join(map(str, images.MARGINS))}]) AS m) LEFT JOIN hit USING (image) GROUP BY image, m)
SELECT image, m AS margin, top, bottom, lft AS "left", rgt AS "right", count(*) AS n_pixels, sum((i + 1) * v)::BIGINT AS weight
FROM box JOIN px USING (image) WHERE i // {SIDE} BETWEEN top AND bottom - 1 AND i % {SIDE} BETWEEN lft AND rgt - 1 GROUP BY ALL"""
)


@query("img_crop", _CROP)
def img_crop(spark, sf_dir):
    """The box of bright pixels of every image under three margins, and a weighted sum of what is left."""
    out = None
    for margin in images.MARGINS:
        c = images.crop(pictures(spark, sf_dir), "pixels", "width", images.BRIGHT, margin)
        b = F.col("cropped_box")
        place = lambda k: (b["top"] + F.floor(k / (b["right"] - b["left"]))) * SIDE + b["left"] + k % (b["right"] - b["left"])
        weight = F.aggregate(F.transform("cropped", lambda v, k: (place(k) + 1) * v), F.lit(0).cast("bigint"), lambda s, x: s + x)
        rows = c.select("image", F.lit(margin).alias("margin"), *(b[e].alias(e) for e in ("top", "bottom", "left", "right")), F.size("cropped").cast("bigint").alias("n_pixels"), weight.alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("img_phi_scrub", None)
def img_phi_scrub(spark, sf_dir):
    """Marks outside the largest bright region of every image are removed; counts and a digest of the rest."""
    return images.scrub(pictures(spark, sf_dir), "image", "pixels", "width").drop("pixels")


@query("scan_npz", "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE vec_id IS NOT NULL")
def scan_npz(spark, sf_dir):
    """A round trip of all vectors through archives of arrays: 64 ids and a matrix of their vectors in each."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    blocks = rows.groupBy(F.floor(F.col("vec_id") / 64).alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    blocks = blocks.select("block", F.transform("v", lambda x: x["vec_id"]).alias("ids"), F.transform("v", lambda x: x["embedding"]).alias("x"))
    packed = arrays.pack_arrays(blocks, "block", {"ids": "int64", "x": "float32"})
    found = arrays.scan_manifest(arrays.write_artifacts(packed, "block", "content", ".npz")).filter("problem IS NULL")
    both = found.groupBy("path").agg(*(F.max(F.when(F.col("member") == m, F.struct("shape", "values"))).alias(m) for m in ("ids", "x")))
    width = F.col("x.shape")[1].cast("int")
    each = F.transform("ids.values", lambda i, k: F.struct(i.cast("bigint").alias("vec_id"), F.slice("x.values", k * width + 1, width).alias("v")))
    out = both.select(F.explode(each).alias("e")).select("e.*")
    return out.select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("sink_artifact", "SELECT vec_id // 64 AS block, count(*) AS n_vectors, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) AS total FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1")
def sink_artifact(spark, sf_dir):
    """One binary file for each block of vectors, listed in a manifest and read again by its paths alone."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    blocks = rows.groupBy(F.floor(F.col("vec_id") / 64).alias("block")).agg(F.collect_list("embedding").alias("x"))
    manifest = arrays.write_artifacts(arrays.pack_arrays(blocks, "block", {"x": "float32"}), "block", "content", ".npz").filter("bytes > 0")
    back = arrays.scan_manifest(manifest)
    return back.select(F.col("path").cast("bigint").alias("block"), F.col("shape")[0].alias("n_vectors"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
