"""Queries of second-level models and of weight searches."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tarnmill.operators import blend, search, stacking
from tarnmill.operators.ranking import with_rank
from tarnmill.plans import fixtures
from tarnmill.plans.fixtures import PREDS_SQL, TARGETS, hash_mod
from tarnmill.plans.registry import query
from tarnmill.sources.files import written
from tarnmill.sources.tables import table

GROUPS = {
    "ligaments": ("acl", "mcl"), "menisci": ("medial_meniscus", "lateral_meniscus"), "oa": ("medial_oa", "lateral_oa", "pf_oa"),
    "other": ("effusion", "synovitis", "bakers", "contusion", "fracture"),
}
GATES = {"acl": 0.3, "effusion": 0.5, "bakers": 0.2}
_GROUP_OF = {t: g for g, ts in GROUPS.items() for t in ts}
_PLANES = ("A", "N", "R")


def _pick(mapping: dict, key):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def feature_names() -> list[str]:
    """88: ranks (36), differences of members (24), means over groups of targets (12), counts of the protocol (16)."""
    ranks = [f"rank:{m}:{t}" for m in fixtures.MODELS for t in TARGETS]
    diffs = [f"diff:{m}:{t}" for m in fixtures.MODELS[1:] for t in TARGETS]
    means = [f"mean:{m}:{g}" for m in fixtures.MODELS for g in GROUPS]
    return ranks + diffs + means + [f"{k}:{p}{b}" for k in ("fluid", "fat") for p in _PLANES for b in (0, 1)] + ["series", "slices", "sequences", "longest"]


def features(spark, sf_dir):
    """(study, feature, value) in long form; a study without series has counts of 0."""
    ranked = written(with_rank(fixtures.predictions(spark, sf_dir), "r", "p", ["target", "model"], "pct").select("study", "target", "model", "r"), "ranks")
    ranks = ranked.select("study", F.concat_ws(":", F.lit("rank"), "model", "target").alias("feature"), F.col("r").alias("value"))
    first = ranked.filter("model = 'm1'").select("study", "target", F.col("r").alias("r1"))
    diffs = ranked.filter("model <> 'm1'").join(first, ["study", "target"]).select("study", F.concat_ws(":", F.lit("diff"), "model", "target").alias("feature"), (F.col("r1") - F.col("r")).alias("value"))
    means = ranked.groupBy("study", F.concat_ws(":", F.lit("mean"), "model", _pick(_GROUP_OF, F.col("target"))).alias("feature")).agg(F.avg("r").alias("value"))
    count = lambda c: F.sum(c.cast("long"))
    counts = {f"{k}:{p}{b}": count((F.col("plane") == p) & (F.col(k) == b)) for k in ("fluid", "fat") for p in _PLANES for b in (0, 1)}
    counts |= {"series": F.count(F.lit(1)), "slices": F.sum("n_slices"), "sequences": F.countDistinct("seq"), "longest": F.max("n_slices")}
    protocol = fixtures.series(spark, sf_dir).groupBy("study").agg(*(c.alias(f"c{k}") for k, c in enumerate(counts.values())))
    every = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study")).join(protocol, "study", "left")
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(f"c{k}").cast("double"), F.lit(0.0)).alias("value")) for k, n in enumerate(counts)])
    return ranks.unionByName(diffs).unionByName(means).unionByName(every.select("study", F.explode(cells).alias("c")).select("study", "c.*"))


def stored_model(spark):
    """(target, feature, mean, scale, coef): constants by rule, some scales 0."""
    names = spark.createDataFrame([(n,) for n in feature_names()], "feature string").withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    return names.select(
        "target", "feature", (hash_mod(1000, F.lit("mean"), F.col("feature")) / 1000).alias("mean"), (hash_mod(20, F.lit("scale"), F.col("feature")) / 10).alias("scale"),
        ((hash_mod(2001, F.lit("coef"), F.col("feature"), F.col("target")) - 1000) / 1000).alias("coef"),
    )


def _h(n: int, text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {n})"


_PCT = "((rank() OVER (PARTITION BY {part} ORDER BY {p}) + (count(*) OVER (PARTITION BY {part}, {p}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}))::DOUBLE"
_GROUP_CASE = "CASE " + " ".join(f"WHEN target IN ({', '.join(repr(t) for t in ts)}) THEN '{g}'" for g, ts in GROUPS.items()) + " END"
_COUNTS = [f"('{k}:{p}{b}', count(*) FILTER (plane = '{p}' AND {k} = {b}))" for k in ("fluid", "fat") for p in _PLANES for b in (0, 1)]
_COUNTS += ["('series', count(plane))", "('slices', coalesce(sum(n_slices), 0))", "('sequences', count(DISTINCT seq))", "('longest', coalesce(max(n_slices), 0))"]
_GATE = "CASE target " + " ".join(f"WHEN '{t}' THEN {g}::DOUBLE" for t, g in GATES.items()) + " ELSE 0 END"
_GATED = (
    PREDS_SQL
    + f""", series AS (SELECT l_orderkey AS study, l_linenumber AS seq, l_returnflag AS plane, (l_linestatus = 'F')::INT AS fluid, (l_quantity > 25)::INT AS fat, l_quantity AS n_slices FROM lineitem),
rk AS (SELECT study, target, model, {_PCT.format(part="target, model", p="p")} AS r FROM preds),
pc AS (SELECT doc_id AS study, unnest([{", ".join(f"struct_pack(feature := {c[1:].split(',')[0]}, value := ({c.split(', ', 1)[1][:-1]})::DOUBLE)" for c in _COUNTS)}]) AS c FROM documents LEFT JOIN series ON study = doc_id GROUP BY doc_id),
ft AS (SELECT study, 'rank:' || model || ':' || target AS feature, r AS value FROM rk
  UNION ALL SELECT a.study, 'diff:' || b.model || ':' || a.target, a.r - b.r FROM rk a JOIN rk b ON a.study = b.study AND a.target = b.target AND a.model = 'm1' AND b.model <> 'm1'
  UNION ALL SELECT study, 'mean:' || model || ':' || {_GROUP_CASE}, avg(r) FROM rk GROUP BY 1, 2
  UNION ALL SELECT study, c.feature, c.value FROM pc),
md AS (SELECT target, feature, {_h(1000, "'mean:' || feature")} / 1000.0::DOUBLE AS mean, {_h(20, "'scale:' || feature")} / 10.0::DOUBLE AS scale,
  ({_h(2001, "'coef:' || feature || ':' || target")} - 1000) / 1000.0::DOUBLE AS coef FROM (SELECT DISTINCT feature FROM ft), (SELECT DISTINCT target FROM rk)),
sc AS (SELECT study, target, round(sum((value - mean) / CASE WHEN abs(scale) <= 1e-8 THEN 1 ELSE scale END * coef) + {_h(1001, "'intercept:' || target")} / 1000.0::DOUBLE, 9) AS s FROM ft JOIN md USING (feature) GROUP BY study, target),
q AS (SELECT study, target, {_PCT.format(part="target", p="s")} AS q FROM sc),
b AS (SELECT study, target, {_PCT.format(part="target", p="round(p, 9)")} AS r FROM preds WHERE model = 'm1'),
mx AS (SELECT study, target, r, {_GATE} AS g, round(CASE WHEN {_GATE} > 0 THEN (1 - {_GATE}) * r + {_GATE} * q ELSE r END, 9) AS m FROM b JOIN q USING (study, target)),
o AS (SELECT study, target, r, g, {_PCT.format(part="target", p="m")} AS p FROM mx)
SELECT study, target, round(CASE WHEN g > 0 THEN p ELSE r END, 6) AS p FROM o"""
)


@query("calib_linear_gated", _GATED)
def calib_linear_gated(spark, sf_dir):
    """A stored linear model over 88 features, ranked and mixed into three targets; the others are protected."""
    intercepts = {t: int(hashlib.md5(f"intercept:{t}".encode()).hexdigest()[:8], 16) % 1001 / 1000 for t in TARGETS}
    scores = stacking.linear_scores(features(spark, sf_dir), stored_model(spark), intercepts)
    base = fixtures.one_model(spark, sf_dir).select("study", "target", "p")
    return stacking.gated(base, scores, GATES).select("study", "target", F.round("p", 6).alias("p"))


@query("calib_neighbor_lr", None)
def calib_neighbor_lr(spark, sf_dir):
    """Each target's standardised logit, mixed with what the other targets of the study say of it."""
    preds = fixtures.one_model(spark, sf_dir).withColumn("logit", blend.logit(F.col("p")))
    z = stacking.standardised(preds, ["target"], "logit", "z").select("study", "fold", "target", "y", "z")
    return stacking.neighbour_prior(z, TARGETS).select("study", "target", F.round("prior", 6).alias("prior"), F.round("z", 6).alias("z"))


def _members(spark, sf_dir):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p"))).alias(m)
    return fixtures.predictions(spark, sf_dir).groupBy("study", "target").agg(F.max("y").alias("y"), *map(one, fixtures.MODELS))


@query("opt_simplex_nm", None)
def opt_simplex_nm(spark, sf_dir):
    """The blend of three members with the best macro AUC that the simplex method finds in 12 steps, 13 jobs at most."""
    rows = _members(spark, sf_dir)
    weights, value, jobs = search.fit_simplex(rows, list(fixtures.MODELS), 12)
    given = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    names = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(round(w, 6)).alias("weight")) for m, w in weights.items()])
    return given.select("n_rows", F.explode(names).alias("m")).select("m.model", "m.weight", F.lit(round(value, 9)).alias("macro_auc"), F.lit(jobs).alias("jobs"), "n_rows")


@query("opt_bounded_scalar", None)
def opt_bounded_scalar(spark, sf_dir):
    """For each target the weight of the second member with the least log loss."""
    return search.bounded_weights(_members(spark, sf_dir), "m1", "m2")
