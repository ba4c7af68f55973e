"""Fusion, audit and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.operators import audit, fusion
from tarnmill.plans import fixtures
from tarnmill.plans.fixtures import PREDS_SQL, SERIES_SQL
from tarnmill.plans.registry import query
from tarnmill.sources.tables import table

_FUSE_IN = """, f AS (SELECT study, target, max(CASE WHEN is_gold THEN y END) AS gold, max(CASE WHEN study % 2 = 0 AND model = 'm2' THEN p END) AS m, max(CASE WHEN study % 3 = 0 AND y IN (0, 1) THEN y END) AS r FROM preds GROUP BY 1, 2),
fu AS (SELECT study, target, coalesce(gold, m, r, 0.5) AS value, CASE WHEN gold IS NOT NULL THEN 1.0 WHEN m IS NOT NULL THEN greatest(0.3, least(1.0, 0.3 + 1.4 * abs(m - 0.5))) WHEN r IS NOT NULL THEN 0.8 ELSE 0.2 END AS weight,
 CASE WHEN gold IS NOT NULL THEN 'gold' WHEN m IS NOT NULL THEN 'model' WHEN r IS NOT NULL THEN 'rule' ELSE 'unknown' END AS source FROM f)"""


def _sources(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir)
    return rows.groupBy("study", "target").agg(
        F.max(F.when(F.col("is_gold"), F.col("y"))).alias("gold"), F.max(F.when((F.col("study") % 2 == 0) & (F.col("model") == "m2"), F.col("p"))).alias("model"),
        F.max(F.when((F.col("study") % 3 == 0) & F.col("y").isin(0.0, 1.0), F.col("y"))).alias("rule"),
    )


@query("fuse_priority", PREDS_SQL + _FUSE_IN + " SELECT study, target, value, round(weight, 6) AS weight, source FROM fu")
def fuse_priority(spark, sf_dir):
    return fusion.fuse(_sources(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("fuse_study_source", PREDS_SQL + _FUSE_IN + " SELECT study, CASE min(CASE source WHEN 'gold' THEN 0 WHEN 'model' THEN 1 WHEN 'rule' THEN 2 ELSE 3 END) WHEN 0 THEN 'gold' WHEN 1 THEN 'model' WHEN 2 THEN 'rule' ELSE 'unknown' END AS label_source FROM fu GROUP BY study")
def fuse_study_source(spark, sf_dir):
    return fusion.study_source(fusion.fuse(_sources(spark, sf_dir)))


@query("fuse_gold_regex", PREDS_SQL + _FUSE_IN + " SELECT study, target, coalesce(gold, r, 0.5) AS value, CASE WHEN gold IS NOT NULL THEN 1.0 WHEN r IS NOT NULL THEN 0.8 ELSE 0.2 END::DOUBLE AS weight FROM f")
def fuse_gold_regex(spark, sf_dir):
    return fusion.fuse(_sources(spark, sf_dir).withColumn("model", F.lit(None).cast("double"))).select("study", "target", "value", "weight")


@query("fuse_overlay", PREDS_SQL + ", b AS (SELECT study, target, p FROM preds WHERE model = 'm1'), o AS (SELECT study, target, p FROM preds WHERE model = 'm3' AND study % 4 = 0) SELECT study, target, coalesce(o.p, b.p) AS p, o.p IS NOT NULL AS covered FROM b LEFT JOIN o USING (study, target)")
def fuse_overlay(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir)
    over = rows.filter("model = 'm3' AND study % 4 = 0").select("study", "target", F.col("p").alias("q"))
    return rows.filter("model = 'm1'").join(over, ["study", "target"], "left").select("study", "target", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("covered"))


@query("weight_study", PREDS_SQL + " SELECT study, CASE WHEN is_gold THEN 1.0 ELSE round(greatest(0.3, least(0.9, 0.9 - 0.05 * count(*) FILTER (p > 0.3 AND p < 0.7))), 6) END::DOUBLE AS weight FROM preds WHERE model = 'm1' GROUP BY study, is_gold")
def weight_study(spark, sf_dir):
    return fusion.study_weight(fixtures.one_model(spark, sf_dir))


@query("weight_conf_affine", PREDS_SQL + " SELECT study, target, round((0.25 + 0.75 * abs(p - 0.5) * 2) * CASE WHEN is_gold THEN 3.0 ELSE 1.0 END, 6) AS weight FROM preds WHERE model = 'm1'")
def weight_conf_affine(spark, sf_dir):
    w = (0.25 + 0.75 * F.abs(F.col("p") - 0.5) * 2) * F.when(F.col("is_gold"), 3.0).otherwise(1.0)
    return fixtures.one_model(spark, sf_dir).select("study", "target", F.round(w, 6).alias("weight"))


@query("weight_source_default", PREDS_SQL + " SELECT study, target, coalesce(CASE WHEN study % 4 = 0 THEN p END, CASE WHEN is_gold THEN 1.0 ELSE 0.8 END) AS weight FROM preds WHERE model = 'm1'")
def weight_source_default(spark, sf_dir):
    given = F.when(F.col("study") % 4 == 0, F.col("p"))
    return fixtures.one_model(spark, sf_dir).select("study", "target", F.coalesce(given, F.when(F.col("is_gold"), 1.0).otherwise(0.8)).alias("weight"))


@query("weight_zero_flagged", PREDS_SQL + ", w AS (SELECT *, CASE WHEN is_gold THEN 1.0 WHEN abs(y - p) >= 0.5 THEN 0.0 ELSE 0.8 END AS weight FROM preds WHERE model = 'm1') SELECT target, round(sum(weight::DOUBLE), 4) AS total, count(*) FILTER (weight = 0) AS zeroed, count(*) FILTER (is_gold AND weight <> 1) AS broken_gold FROM w GROUP BY target")
def weight_zero_flagged(spark, sf_dir):
    rows = fixtures.one_model(spark, sf_dir).withColumn("weight", F.when(F.col("is_gold"), 1.0).otherwise(0.8))
    out = fusion.zero_flagged(rows, rows.filter(F.abs(F.col("y") - F.col("p")) >= 0.5))
    n = lambda c: F.sum(c.cast("long"))
    return out.groupBy("target").agg(F.round(F.sum("weight"), 4).alias("total"), n(F.col("weight") == 0).alias("zeroed"), n(F.col("is_gold") & (F.col("weight") != 1)).alias("broken_gold"))


@query("fold_hash", "SELECT doc_id, (('0x' || substr(md5(text), 1, 8))::BIGINT % 5)::INT AS fold FROM documents")
def fold_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fusion.text_fold(F.col("text")).alias("fold"))


@query("split_oof", PREDS_SQL + " SELECT k AS fold, split, count(*) AS n FROM (SELECT k, CASE WHEN is_gold OR fold = k THEN 'val' ELSE 'train' END AS split FROM preds CROSS JOIN (SELECT unnest(range(5)) AS k) WHERE model = 'm1') GROUP BY 1, 2")
def split_oof(spark, sf_dir):
    """Gold rows validate in every fold, the others in their own."""
    rows = fixtures.one_model(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    split = F.when(F.col("is_gold") | (F.col("fold") == F.col("k")), "val").otherwise("train")
    return rows.groupBy(F.col("k").cast("bigint").alias("fold"), split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("subsample_head", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def subsample_head(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(50)


_SWAP = {"medial_meniscus": "lateral_meniscus", "lateral_meniscus": "medial_meniscus", "medial_oa": "lateral_oa", "lateral_oa": "medial_oa"}


@query("laterality_swap", PREDS_SQL + " SELECT study, CASE target " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SWAP.items()) + " ELSE target END AS target, y FROM preds WHERE model = 'm1'")
def laterality_swap(spark, sf_dir):
    """In the long form a swap of sides is a renaming of targets."""
    swap = F.create_map(*[F.lit(x) for pair in _SWAP.items() for x in pair])
    return fixtures.one_model(spark, sf_dir).select("study", F.coalesce(F.try_element_at(swap, F.col("target")), F.col("target")).alias("target"), "y")


@query("label_smooth", PREDS_SQL + " SELECT study, target, round(y * (1 - 2 * 0.05) + 0.05, 6) AS y FROM preds WHERE model = 'm1'")
def label_smooth(spark, sf_dir):
    return fixtures.one_model(spark, sf_dir).select("study", "target", F.round(fusion.label_smooth(F.col("y"), 0.05), 6).alias("y"))


# Audits

_COV = """ SELECT target, round(count(*) FILTER (y IN (0, 1)) / count(*)::DOUBLE * 100, 4) AS coverage, count(*) FILTER (y = 0.5 OR y IS NULL) AS n_unsure, count(*) FILTER (y = 1) < 5 AS few,
 count(*) FILTER (y = 1 AND p >= 0.5) || '/' || count(*) FILTER (y = 1) AS found FROM preds WHERE model = 'm1' GROUP BY target"""


@query("audit_coverage", PREDS_SQL + _COV)
def audit_coverage(spark, sf_dir):
    return audit.coverage(fixtures.one_model(spark, sf_dir), ["target"])


_AGREE = """ SELECT target, count(*) FILTER (y IN (0, 1)) AS covered, round(count(*) FILTER (y IN (0, 1) AND (y = 1) = (p >= 0.5)) / nullif(count(*) FILTER (y IN (0, 1)), 0)::DOUBLE, 6) AS agreement,
 count(*) FILTER (y = 0 AND p >= 0.5) AS spurious, count(*) FILTER (y = 1 AND p < 0.5) AS missed, count(*) FILTER (y IS NULL AND p >= 0.5) AS unmentioned FROM preds WHERE model = 'm1' GROUP BY target"""


@query("audit_agreement", PREDS_SQL + _AGREE)
def audit_agreement(spark, sf_dir):
    return audit.agreement(fixtures.one_model(spark, sf_dir), ["target"])


_SIL = """, b AS (SELECT study, target, y, p, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM preds WHERE model = 'm1' AND y IS NOT NULL)
SELECT study, target, round(-(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS loss, CASE WHEN p >= 0.85 THEN 'silent' ELSE 'phantom' END AS kind FROM b WHERE (p >= 0.6 AND y <= 0.2) OR (p <= 0.4 AND y >= 0.8)""".replace("p >= 0.85 THEN", "p >= 0.6 THEN")


@query("audit_silent_phantom", PREDS_SQL + _SIL)
def audit_silent_phantom(spark, sf_dir):
    return audit.silent_phantom(fixtures.one_model(spark, sf_dir), 0.6, 0.4)


@query("audit_major_errors", PREDS_SQL + " SELECT target, count(*) FILTER (y < 0.5) AS fp, count(*) FILTER (y >= 0.5) AS fn, round(max(abs(y - p)), 4) AS worst FROM preds WHERE model = 'm1' AND abs(y - p) >= 0.5 GROUP BY target")
def audit_major_errors(spark, sf_dir):
    d = F.abs(F.col("y") - F.col("p"))
    n = lambda c: F.sum(c.cast("long"))
    return fixtures.one_model(spark, sf_dir).filter(d >= 0.5).groupBy("target").agg(n(F.col("y") < 0.5).alias("fp"), n(F.col("y") >= 0.5).alias("fn"), F.round(F.max(d), 4).alias("worst"))


_SER = SERIES_SQL + """, s AS (SELECT *, row_number() OVER (PARTITION BY study, plane ORDER BY seq, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k, count(*) OVER (PARTITION BY study, plane) AS n, max(fluid) OVER (PARTITION BY study, plane) AS any_fluid FROM series)
SELECT plane, count(*) FILTER (n > 1) AS multi, count(*) FILTER (fluid = 0) AS chosen_not_fluid, count(*) FILTER (fluid = 0 AND any_fluid = 1) AS fluid_available FROM s WHERE k = 1 GROUP BY plane"""


@query("audit_series_choice", _SER)
def audit_series_choice(spark, sf_dir):
    first = F.min_by("fluid", F.struct("seq", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    chosen = fixtures.series(spark, sf_dir).groupBy("study", "plane").agg(first.alias("fluid"), F.count(F.lit(1)).alias("n"), F.max("fluid").alias("any"))
    n = lambda c: F.sum(c.cast("long"))
    return chosen.groupBy("plane").agg(n(F.col("n") > 1).alias("multi"), n(F.col("fluid") == 0).alias("chosen_not_fluid"), n((F.col("fluid") == 0) & (F.col("any") == 1)).alias("fluid_available"))


_RAD = """ SELECT study, round(avg((y - p) * (y - p)), 6) AS brier, round(count(*) FILTER ((y >= 0.5) = (p >= 0.5)) / count(*)::DOUBLE, 6) AS concordance, round(max(abs(y - p)), 4) AS max_diff,
 arg_max(target, row(round(abs(y - p), 4), target)) AS worst, max(abs(y - p)) >= 0.5 AS flagged FROM preds WHERE model = 'm1' AND y IS NOT NULL GROUP BY study"""


@query("audit_radar", PREDS_SQL + _RAD)
def audit_radar(spark, sf_dir):
    return audit.radar(fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL"))


_CL = """, b AS (SELECT study, target, y, p FROM preds WHERE model = 'm1' AND y IN (0, 1)),
t AS (SELECT target, avg(CASE WHEN y = 1 THEN p END) AS t1, avg(CASE WHEN y = 0 THEN 1 - p END) AS t0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM b GROUP BY target),
j AS (SELECT b.*, t.n1, t.n0, CASE WHEN p >= t1 AND 1 - p >= t0 THEN CASE WHEN p > 1 - p THEN 1 ELSE 0 END WHEN p >= t1 THEN 1 WHEN 1 - p >= t0 THEN 0 END AS c FROM b JOIN t USING (target)),
m AS (SELECT target, any_value(n1) AS n1, any_value(n0) AS n0, count(*) FILTER (y = 1 AND c = 1) AS c11, count(*) FILTER (y = 1 AND c = 0) AS c10, count(*) FILTER (y = 0 AND c = 0) AS c00, count(*) FILTER (y = 0 AND c = 1) AS c01 FROM j GROUP BY target),
k AS (SELECT target, floor(n1 * coalesce(c10 / nullif(c10 + c11, 0)::DOUBLE, 0) + 0.5)::BIGINT AS k1, floor(n0 * coalesce(c01 / nullif(c01 + c00, 0)::DOUBLE, 0) + 0.5)::BIGINT AS k0 FROM m),
r AS (SELECT b.*, row_number() OVER (PARTITION BY target, y ORDER BY CASE WHEN y = 1 THEN p - (1 - p) ELSE (1 - p) - p END, study) AS margin_rank FROM b)
SELECT target, study, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN y = 1 THEN p ELSE 1 - p END, study) AS rank, round(abs(y - p), 4) AS abs_diff
FROM r JOIN k USING (target) WHERE margin_rank <= CASE WHEN y = 1 THEN k1 ELSE k0 END"""


@query("cl_find_issues", PREDS_SQL + _CL)
def cl_find_issues(spark, sf_dir):
    return audit.confident_learning(fixtures.one_model(spark, sf_dir))


@query("cl_issue_summary", PREDS_SQL + _CL.replace("SELECT target, study, row_number()", ", i AS (SELECT target, study, row_number()") + ") SELECT target, count(*) AS n_issues, round(count(*) / any_value(n)::DOUBLE * 100, 4) AS rate, count(*) FILTER (abs_diff >= 0.6) AS severe FROM i JOIN (SELECT target, count(*) AS n FROM b GROUP BY target) USING (target) GROUP BY target")
def cl_issue_summary(spark, sf_dir):
    rows = fixtures.one_model(spark, sf_dir)
    n = rows.filter(F.col("y").isin(0.0, 1.0)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    per = audit.confident_learning(rows).groupBy("target").agg(F.count(F.lit(1)).alias("n_issues"), F.sum((F.col("abs_diff") >= 0.6).cast("long")).alias("severe"))
    return per.join(n, "target").select("target", "n_issues", F.round(F.col("n_issues") / F.col("n") * 100, 4).alias("rate"), "severe")


_VAL = """, w AS (SELECT study, p FROM preds WHERE model = 'm1' AND target = 'acl')
SELECT 'rows' AS name, (SELECT count(*) FROM w) = (SELECT count(*) FROM documents) AS passed
UNION ALL SELECT 'unique', (SELECT count(*) FROM w) = (SELECT count(DISTINCT study) FROM w)
UNION ALL SELECT 'same_ids', (SELECT count(*) FROM documents d FULL JOIN w ON w.study = d.doc_id WHERE d.doc_id IS NULL OR w.study IS NULL) = 0
UNION ALL SELECT 'no_null', (SELECT count(*) FROM w WHERE p IS NULL) = 0
UNION ALL SELECT 'in_range', (SELECT count(*) FROM w WHERE p < 0 OR p > 1) = 0"""


@query("validate_output", PREDS_SQL + _VAL)
def validate_output(spark, sf_dir):
    out = fixtures.one_model(spark, sf_dir).filter("target = 'acl'").select("study", "p")
    return audit.validate(out, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study")), "study", ["p"])


_CONTRACT = PREDS_SQL + """, w AS (SELECT study, max(p) FILTER (target = 'acl') AS acl, max(p) FILTER (target = 'mcl') AS mcl FROM preds WHERE model = 'm1' AND is_gold GROUP BY study),
f AS (SELECT doc_id AS study, coalesce(acl, 0.5) AS acl, coalesce(mcl, 0.5) AS mcl FROM documents LEFT JOIN w ON study = doc_id),
c AS (SELECT 'before' AS stage, (SELECT count(*) FROM w) AS n, (SELECT count(*) FROM w WHERE acl NOT BETWEEN 0 AND 1 OR mcl NOT BETWEEN 0 AND 1) AS outside UNION ALL SELECT 'after', (SELECT count(*) FROM f), (SELECT count(*) FROM f WHERE acl NOT BETWEEN 0 AND 1 OR mcl NOT BETWEEN 0 AND 1))
SELECT stage, name, CASE name WHEN 'columns' THEN stage = 'after' WHEN 'rows' THEN n = (SELECT count(*) FROM documents) WHEN 'same_ids' THEN n = (SELECT count(*) FROM documents) WHEN 'in_range' THEN outside = 0 ELSE true END AS passed
FROM c, (SELECT unnest(['columns', 'numeric', 'finite', 'rows', 'unique', 'same_ids', 'no_null', 'in_range']) AS name)"""


@query("validate_contract", _CONTRACT)
def validate_contract(spark, sf_dir):
    """An output that covers some ids, with its columns in another order, before and after it is aligned to the contract."""
    columns, required = ["study", "acl", "mcl"], table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study"))
    one = lambda t: F.max(F.when(F.col("target") == t, F.col("p"))).alias(t)
    out = fixtures.one_model(spark, sf_dir).filter("is_gold").groupBy("study").agg(one("mcl"), one("acl"))
    fixed = audit.realigned(out, required, "study", columns, {"acl": 0.5, "mcl": 0.5})
    check = lambda df, stage: audit.contract(df, required, columns, columns[1:]).select(F.lit(stage).alias("stage"), "name", "passed")
    return check(out, "before").unionByName(check(fixed, "after"))


@query("sink_atomic_default", PREDS_SQL + " SELECT doc_id, coalesce(p, 0.5) AS p FROM documents LEFT JOIN (SELECT study, p FROM preds WHERE model = 'm1' AND target = 'mcl' AND NOT is_gold) ON study = doc_id")
def sink_atomic_default(spark, sf_dir):
    """A whole default table is written first; predictions replace its values as far as there are any."""
    from tarnmill.operators.relational import align
    from tarnmill.sources import files

    first = files.scratch(spark, "default")
    table(spark, sf_dir, "documents").select("doc_id", F.lit(0.5).alias("p")).write.parquet(first)
    have = fixtures.one_model(spark, sf_dir).filter("target = 'mcl' AND NOT is_gold").select(F.col("study").alias("doc_id"), "p")
    final = files.scratch(spark, "final")
    align(spark.read.parquet(first).select("doc_id"), have, "doc_id", {"p": 0.5}).write.mode("overwrite").parquet(final)
    return spark.read.parquet(final)
