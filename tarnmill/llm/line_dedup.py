"""Line dedup [native]: lines that many documents share are kept in one document only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import BLANKS, ascii_lower, let, materialise, text_or_empty


def line_keys(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, th, pos, h1, h2): one row for each line whose key has ``min_chars`` code points; th tells texts apart."""
    text = text_or_empty(F.col(text_col))
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.char_length("key") >= min_chars)
    key = ascii_lower(F.col("key"))
    return keys.select("id", "th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(17), key).alias("h2"))


def drop_shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drops lines that at least ``min_docs`` documents share, except in the largest id that holds them.

    Returns the columns of ``df`` with the kept text in ``text_col``, and ``n_lines`` (before dropping) and
    ``n_dropped``; these two replace input columns of the same name, other columns pass through.

    Plan: lines are exploded and hashed (128 bits); a map-side combined count finds hashes with enough lines, and
    only their lines go further, so the exact distinct count of documents works on few rows. The dropped positions
    are joined back to the documents, whose text moves at most once. A hot line is combined before each shuffle;
    joins on it are inner or semi joins that AQE splits.

    Defined cases: a null or empty text is one empty line; rows that share an id count as one document for the
    threshold, and each is returned; equal rows lose the same lines; a null id counts as one document, smaller than
    all others; a line repeated within the largest id stays there each time; an empty table gives an empty table.
    Joined text ends in no extra newline; if every line goes, the text is empty.
    """
    lines = line_keys(df, id_col, text_col, min_chars)
    often = lines.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    hot = materialise(lines.join(often, "h1", "left_semi"), "hot-lines")
    shared = (
        hot.groupBy("h1", "h2").agg(F.countDistinct(F.struct("id")).alias("n_docs"), F.max("id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    )
    drops = (
        hot.join(shared, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("_tm_id"), F.col("th").alias("_tm_drop_th")).agg(F.collect_set("pos").alias("_tm_drop"))
    )
    text = text_or_empty(F.col(text_col))
    joined = df.withColumn("_tm_th", F.xxhash64(text)).join(
        drops, F.col(id_col).eqNullSafe(F.col("_tm_id")) & (F.col("_tm_th") == F.col("_tm_drop_th")), "left"
    )
    kept = let(
        F.struct(F.split(text, "\n", -1).alias("lines"), F.col("_tm_drop").alias("gone")),
        lambda s: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: s["lines"][i]), "\n"
        ),
    )
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    outputs = {
        text_col: F.when(F.col("_tm_drop").isNull(), text).otherwise(kept),
        "n_lines": n_lines.cast("long"),
        "n_dropped": F.when(F.col("_tm_drop").isNull(), F.lit(0)).otherwise(F.size("_tm_drop")).cast("long"),
    }
    return joined.withColumns(outputs).drop("_tm_th", "_tm_id", "_tm_drop_th", "_tm_drop")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_shared_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT rid, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""
