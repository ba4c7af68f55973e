"""From raw documents to a mixed training corpus: five stages, each an operator of ``tarnmill.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import materialise, text_or_empty
from tarnmill.llm.line_dedup import drop_shared_lines
from tarnmill.llm.line_quality import clean_lines
from tarnmill.llm.mixing import mix_sources
from tarnmill.llm.near_dedup import near_duplicates
from tarnmill.llm.phrase_index import contamination

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do the documents that the rules reject.

    A null or empty text has no words and is rejected; rows with a null id are judged like others; equal rows are
    judged alike and all stay or go; other columns are dropped; an empty table gives an empty table.
    """
    # a row number keeps the filter above the projection, which would else be copied into it and run twice
    judged = clean_lines(docs).withColumn("_tm_row", F.monotonically_increasing_id())
    return _documents(judged.filter("kept AND _tm_row >= 0").withColumn("text", F.col("cleaned")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in one of them.

    Every row stays: a null or empty text is one empty line and comes back as the empty text; a text all of whose
    lines go is empty; rows that share an id are one document in the count; an empty table gives an empty table.
    """
    return _documents(drop_shared_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays.

    A document is an id and a text. Rows that share an id but not the text are documents of their own, so each stays
    unless it is like a smaller one (by id, then by a hash of the text); of rows equal in both the first by the other
    columns stays. Rows without an id are linked with nothing and stay, as do null and empty texts; an empty table
    gives an empty table.
    """
    keyed = docs.withColumn("_tm_th", F.xxhash64(text_or_empty(F.col("text"))))
    named = keyed.filter("doc_id IS NOT NULL")
    groups = near_duplicates(named.select(F.struct("doc_id", "_tm_th").alias("key"), "text"), id_col="key")
    kept = groups.filter("key = component_id").select("key.doc_id", "key._tm_th").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    once = named.join(kept, ["doc_id", "_tm_th"], "left_semi").groupBy("doc_id", "_tm_th").agg(F.min(F.struct(*rest)).alias("first"))
    return once.select("doc_id", *(F.col(f"first.{c}") for c in rest)).select(*COLUMNS).unionByName(keyed.filter("doc_id IS NULL").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go, and those that hold the whole of an
    item of fewer words.

    Null and empty texts hold nothing and stay; rows that share an id are judged by their own texts; equal rows stay
    or go together; an empty benchmark lets all stay; an empty table gives an empty table.
    """
    keyed = docs.withColumn("_tm_th", F.xxhash64(text_or_empty(F.col("text"))))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(keyed.select(F.struct("doc_id", "_tm_th").alias("key"), "text"), benchmark, id_col="key")
    leaked = found.filter(F.size("hits") > 0).select(F.col("key.doc_id").alias("_tm_id"), F.col("key._tm_th").alias("_tm_leak")).distinct()
    clean = keyed.join(leaked, F.col("doc_id").eqNullSafe(F.col("_tm_id")) & (F.col("_tm_th") == F.col("_tm_leak")), "left_anti")
    return clean.select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document once or more, with epoch, block and place in the block.

    Null sources are a source of their own; texts without words cost no tokens and appear once; equal rows are
    scheduled each; an empty table gives an empty table.
    """
    schedule = mix_sources(docs, target_entropy=0.998, max_repetition=2.0).select(
        F.col("id").alias("_tm_id"), F.col("source").alias("_tm_source"), F.col("th").alias("_tm_th"), F.col("epoch").cast("long").alias("epoch"), "block", "pos"
    )
    keyed = docs.withColumn("_tm_key", F.xxhash64(text_or_empty(F.col("text"))))
    same = F.col("doc_id").eqNullSafe(F.col("_tm_id")) & F.col("source").eqNullSafe(F.col("_tm_source")) & (F.col("_tm_key") == F.col("_tm_th"))
    return keyed.join(schedule, same).select(*COLUMNS, "epoch", "block", "pos")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's result is written to the shared folder, as its successor reads
    it more than once. What a stage defines for nulls, repeated rows and empty tables holds for the whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE_SQL = rf"""
WITH RECURSIVE d0 AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
-- quality rules
q_w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d0),
q_l AS (SELECT doc_id, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM q_w)),
q_j AS (SELECT *, len(lw) > 0 AND ((NOT regexp_matches({_TRIM.format("line")}, '[.!?:;…。！？]["''”’»)\]]*$'))
  OR (length(regexp_replace(line, '[^|›»•·]+', '', 'g')) >= 2 AND length(regexp_replace(line, '[^|›»•·]+', '', 'g')) * 6 >= len(lw))
  OR (len(lw) <= 20 AND regexp_matches(line, '(?i)\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|javascript|sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share on|lorem ipsum)\b'))) AS fails FROM q_l),
q_c AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT fails), '') AS cleaned,
  coalesce(sum(list_sum(list_transform(lw, lambda x: length(x)))) FILTER (fails), 0) AS lost FROM q_j GROUP BY doc_id),
q_r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM
  (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM q_w))) WHERE c > 1),
q_n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM q_r) GROUP BY doc_id),
d1 AS (SELECT doc_id, cleaned AS t FROM q_w JOIN q_c USING (doc_id) LEFT JOIN q_n USING (doc_id) WHERE len(ws) >= 50
  AND 100 * coalesce(n, 0) <= 50 * len(ws) AND 100 * lost <= 50 * list_sum(list_transform(ws, lambda x: length(x)))),
-- line dedup
l_k AS (SELECT doc_id, pos, line, {_LOW.format(_TRIM.format("line"))} AS key
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d1)),
l_s AS (SELECT key, max(doc_id) AS keeper FROM l_k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d2 AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (l_s.key IS NULL OR doc_id = keeper), '') AS t FROM l_k LEFT JOIN l_s ON l_k.key = l_s.key GROUP BY doc_id),
-- near dedup
n_w AS (SELECT doc_id, regexp_extract_all({_LOW.format("t")}, '[^\x20\x09-\x0D]+') AS ws FROM d2),
n_s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM n_w),
n_x AS (SELECT doc_id, unnest(sh) AS g FROM n_s),
n_i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM n_x a JOIN n_x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
n_e AS (SELECT a, b FROM n_i JOIN n_s p ON p.doc_id = a JOIN n_s q ON q.doc_id = b WHERE 100 * c >= 80 * (len(p.sh) + len(q.sh) - c)),
n_b AS (SELECT a, b FROM n_e UNION ALL SELECT b, a FROM n_e),
n_reach AS (SELECT a AS node, a AS seen FROM n_b UNION SELECT r.node, n_b.b FROM n_reach r JOIN n_b ON r.seen = n_b.a),
d3 AS (SELECT doc_id, t FROM d2 WHERE doc_id NOT IN (SELECT node FROM n_reach WHERE seen < node)),
-- decontamination
c_b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
c_g AS (SELECT DISTINCT w, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (SELECT ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM (SELECT ws, least(len(ws), 10) AS w FROM c_b WHERE len(ws) > 0))),
c_d AS (SELECT doc_id, regexp_extract_all({_LOW.format("t")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d3),
c_h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, w, array_to_string(ws[i:i + w - 1], ' ') AS g
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM c_d, (SELECT DISTINCT w FROM c_g) WHERE len(ws) >= w)) JOIN c_g USING (w, g)),
d4 AS (SELECT doc_id, lang, source, d3.t AS t FROM d3 JOIN d0 USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM c_h)),
-- mixing
m_d AS (SELECT doc_id AS id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM d4),
m_s AS (SELECT source, sum(n)::BIGINT AS tokens FROM m_d GROUP BY source),
m_l AS (SELECT ln(tokens / (SELECT sum(tokens)::DOUBLE FROM m_s)) AS l FROM m_s WHERE tokens > 0),
m_1 AS (SELECT -sum(exp(l) * l) >= 0.998 * ln(count(*)) AS even FROM m_l),
m_e AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL SELECT step + 1, CASE WHEN up THEN (low + high) / 2 ELSE low END, CASE WHEN up THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high, (SELECT ln(sum(exp((low + high) / 2 * l))) - sum(exp((low + high) / 2 * l) * (low + high) / 2 * l) / sum(exp((low + high) / 2 * l)) >= 0.998 * ln(count(*)) FROM m_l) AS up
    FROM m_e WHERE step < 30)),
m_r AS (SELECT ln(max(tokens) / min(tokens)::DOUBLE) AS span FROM m_s WHERE tokens > 0),
m_rep AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL SELECT step + 1, CASE WHEN (1 - (low + high) / 2) * span > ln(2) THEN (low + high) / 2 ELSE low END,
    CASE WHEN (1 - (low + high) / 2) * span > ln(2) THEN high ELSE (low + high) / 2 END FROM m_rep, m_r WHERE step < 30),
m_a AS (SELECT greatest((SELECT CASE WHEN (SELECT even FROM m_1) THEN 1.0 ELSE low END FROM m_e WHERE step = 30),
  (SELECT CASE WHEN span > ln(2) THEN high ELSE 0.0 END FROM m_rep, m_r WHERE step = 30)) AS a),
m_p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) ELSE 0 END AS w FROM m_s, m_a),
m_t AS (SELECT sum(w) * max(CASE WHEN tokens > 0 THEN tokens / w END) AS total, sum(w) AS z FROM m_p),
m_b AS (SELECT source, tokens, greatest(round(w / z * total)::BIGINT, tokens) AS budget FROM m_p, m_t),
m_n AS (SELECT greatest(1, ceil(sum(budget) / 1048576.0))::BIGINT AS n_blocks FROM m_b),
m_c AS (SELECT id, m_d.source, n, tokens, budget, unnest(range(greatest(1, ceil(budget / tokens::DOUBLE)::BIGINT))) AS epoch FROM m_d JOIN m_b ON m_d.source = m_b.source),
m_k AS (SELECT *, md5('0:' || epoch || ':' || id) AS key FROM m_c),
m_o AS (SELECT *, epoch * tokens + sum(n) OVER (PARTITION BY source, epoch ORDER BY key, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS off FROM m_k),
m_f AS (SELECT *, least(n_blocks - 1, (off::HUGEINT * n_blocks) // greatest(budget, 1))::BIGINT AS block FROM m_o, m_n WHERE off < budget OR epoch = 0),
m_x AS (SELECT id, epoch::BIGINT AS epoch, block, row_number() OVER (PARTITION BY block ORDER BY md5('0.block:' || block || ':' || key), source, id) - 1 AS pos FROM m_f)
SELECT doc_id, t AS text, lang, source, length(t)::BIGINT AS n_chars, epoch, block, pos FROM m_x JOIN d4 ON m_x.id = d4.doc_id"""
