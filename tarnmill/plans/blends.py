"""Blend, calibration and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.operators import blend, calibrate, metrics
from tarnmill.operators.ranking import with_rank
from tarnmill.plans import fixtures
from tarnmill.plans.fixtures import PREDS_SQL
from tarnmill.plans.registry import query
from tarnmill.sources.files import written

W = {"m1": 0.5, "m2": 0.3, "m3": 0.2}
_W = "CASE model WHEN 'm1' THEN 0.5::DOUBLE WHEN 'm2' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END"


def _pct(p: str, part: str) -> str:
    return f"((rank() OVER (PARTITION BY {part} ORDER BY {p}) + (count(*) OVER (PARTITION BY {part}, {p}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}))"


def _rounded(df, digits=6):
    return df.select("study", "target", F.round("p", digits).alias("p"))


@query("blend_mean", PREDS_SQL + f" SELECT study, target, round(greatest(0.001, least(0.999, sum({_W} * p) / sum({_W}))), 6) AS p FROM preds GROUP BY 1, 2")
def blend_mean(spark, sf_dir):
    return _rounded(blend.blend_mean(fixtures.predictions(spark, sf_dir), W))


_RANKED = f""", r AS (SELECT *, {_pct("p", "target, model")} AS r FROM preds)"""


@query("blend_rank", PREDS_SQL + _RANKED + f" SELECT study, target, round(greatest(0.001, least(0.999, sum({_W} * r) / sum({_W}))), 6) AS p FROM r GROUP BY 1, 2")
def blend_rank(spark, sf_dir):
    return _rounded(blend.blend_rank(fixtures.predictions(spark, sf_dir), W))


_PAIR = (
    PREDS_SQL + _RANKED + """, b AS (SELECT study, target, round(sum(CASE model WHEN 'm1' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * r) / sum(CASE model WHEN 'm1' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 9) AS b FROM r WHERE model <> 'm3' GROUP BY 1, 2)
SELECT study, target, round(greatest(0.001, least(0.999, """ + _pct("b", "target") + ")), 6) AS p FROM b"
)


@query("blend_rank_pair", _PAIR)
def blend_rank_pair(spark, sf_dir):
    """Two members, ranked again at the end."""
    return _rounded(blend.blend_rank(fixtures.predictions(spark, sf_dir), {"m1": 0.7, "m2": 0.3}, rerank=True))


_MEMBERS = "CASE WHEN target = 'acl' THEN CASE model WHEN 'm1' THEN 0.5::DOUBLE WHEN 'm2' THEN 0.5 ELSE 0 END WHEN model = 'm1' THEN 0.2::DOUBLE WHEN model = 'm2' THEN 0.3 ELSE 0.4 END"


@query("blend_rank_members", PREDS_SQL + _RANKED + f" SELECT study, target, round(sum({_MEMBERS} * r) / sum({_MEMBERS}), 6) AS p FROM r GROUP BY 1, 2")
def blend_rank_members(spark, sf_dir):
    """One target uses two members, the others three whose weights don't sum to 1."""
    weights = {t: {"m1": 0.5, "m2": 0.5} if t == "acl" else {"m1": 0.2, "m2": 0.3, "m3": 0.4} for t in fixtures.TARGETS}
    return _rounded(blend.blend_rank_members(fixtures.predictions(spark, sf_dir), weights))


_LOGIT_SQL = "ln(greatest(1e-5, least(1 - 1e-5, {0})) / (1 - greatest(1e-5, least(1 - 1e-5, {0}))))"
_TTA = (
    ", w AS (SELECT study, target, max(p) FILTER (model = 'm1') AS a, max(p) FILTER (model = 'm2') AS b FROM preds GROUP BY 1, 2) SELECT study, target, round(1 / (1 + exp(-greatest(-11.5, least(11.5, 0.65::DOUBLE * "
    + _LOGIT_SQL.format("a") + " + (1 - 0.65::DOUBLE) * " + _LOGIT_SQL.format("b") + ")))), 6) AS p FROM w"
)


@query("tta_mix", PREDS_SQL + _TTA)
def tta_mix(spark, sf_dir):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p"))).alias(m)
    wide = fixtures.predictions(spark, sf_dir).groupBy("study", "target").agg(one("m1"), one("m2"))
    return _rounded(wide.select("study", "target", blend.tta_mix(F.col("m1"), F.col("m2")).alias("p")))


@query("blend_rank_by_fold", PREDS_SQL + f", r AS (SELECT *, {_pct('p', 'target, model, fold')} AS r FROM preds) SELECT study, target, round(avg(r), 6) AS p FROM r GROUP BY 1, 2 HAVING count(*) = 3")
def blend_rank_by_fold(spark, sf_dir):
    return _rounded(blend.blend_rank_by_fold(fixtures.predictions(spark, sf_dir)))


_HALF = """, r AS (SELECT *, rank() OVER (PARTITION BY target, model ORDER BY p) + (count(*) OVER (PARTITION BY target, model, p) - 1) / 2.0 AS r FROM preds),
s AS (SELECT study, target, sum(r) AS s, count(*) AS k FROM r GROUP BY 1, 2) SELECT study, target, round(s / (k * count(*) OVER (PARTITION BY target)), 6) AS p FROM s"""


@query("blend_half_rank", PREDS_SQL + _HALF)
def blend_half_rank(spark, sf_dir):
    return _rounded(blend.blend_half_rank(fixtures.predictions(spark, sf_dir)))


@query("blend_rank_of_prob_mean", PREDS_SQL + ", m AS (SELECT study, target, round(avg(p), 9) AS m FROM preds GROUP BY 1, 2) SELECT study, target, round(" + _pct("m", "target") + ", 6) AS p FROM m")
def blend_rank_of_prob_mean(spark, sf_dir):
    return _rounded(blend.blend_rank_of_mean(fixtures.predictions(spark, sf_dir)))


_THREE = (
    PREDS_SQL + _RANKED + """, b AS (SELECT study, target, round(sum(CASE model WHEN 'm1' THEN 0.36::DOUBLE WHEN 'm2' THEN 0.4::DOUBLE ELSE 0.24::DOUBLE END * r), 9) AS b FROM r GROUP BY 1, 2)
SELECT study, target, round(""" + _pct("b", "target") + ", 6) AS p FROM b"
)


@query("blend_rank_three_way", _THREE)
def blend_rank_three_way(spark, sf_dir):
    """Own weight 0.6 shrunk by the share 0.4 of the second member; the third takes what is left; ranked again."""
    ours, own = 0.4, 0.6
    weights = {"m1": round(own * (1 - ours), 9), "m2": ours, "m3": round(1 - ours - own * (1 - ours), 9)}
    w = blend.weight_map(weights)
    ranked = with_rank(fixtures.predictions(spark, sf_dir), "r", "p", ["target", "model"], "pct")
    raw = ranked.groupBy("study", "target").agg(F.round(F.sum(w * F.col("r")), 9).alias("b"))
    return _rounded(blend.with_ranks(raw, {"p": ("b", ["target"])}))


_MASK = f""", w AS (SELECT study, target, max(p) FILTER (model = 'm1') AS a, max(p) FILTER (model = 'm2') AS b, study % 3 = 0 AS ok FROM preds GROUP BY 1, 2)
SELECT study, target, round(CASE WHEN ok THEN (1 - 0.25) * {_pct("a", "target, ok")} + 0.25 * {_pct("b", "target, ok")} ELSE {_pct("a", "target")} END, 6) AS p FROM w"""


@query("blend_rank_masked", PREDS_SQL + _MASK)
def blend_rank_masked(spark, sf_dir):
    return _rounded(blend.blend_masked(fixtures.predictions(spark, sf_dir), "m1", "m2", 0.25, F.col("study") % 3 == 0))


_RESID = f""", w AS (SELECT study, target, max(p) FILTER (model = 'm1') AS a, max(p) FILTER (model = 'm2') AS b, max(p) FILTER (model = 'm3') AS c FROM preds GROUP BY 1, 2),
r AS (SELECT study, target, {_pct("a", "target")} AS a, {_pct("b", "target")} AS b, {_pct("c", "target")} AS c FROM w),
k AS (SELECT *, round(0.55::DOUBLE * b + 0.45::DOUBLE * c, 9) AS k FROM r), k2 AS (SELECT study, target, a, {_pct("k", "target")} AS k FROM k),
x AS (SELECT study, max(k) FILTER (target = 'synovitis') AS own, max(k) FILTER (target = 'effusion') AS aux FROM k2 GROUP BY study),
px AS (SELECT study, round(0.82::DOUBLE * own + 0.18::DOUBLE * aux, 9) AS proxy FROM x), pr AS (SELECT study, {_pct("proxy", "1")} AS proxy FROM px),
m AS (SELECT study, target, a, CASE WHEN target = 'synovitis' THEN round((1 - 0.3::DOUBLE) * a + 0.3::DOUBLE * proxy, 9) ELSE a END AS m FROM k2 JOIN pr USING (study))
SELECT study, target, round(CASE WHEN target = 'synovitis' THEN {_pct("m", "target")} ELSE a END, 6) AS p FROM m"""


@query("blend_rank_residual", PREDS_SQL + _RESID)
def blend_rank_residual(spark, sf_dir):
    """Only synovitis changes: towards a proxy of its own and effusion's consensus, ranked again at every step.

    Members are ranked in long form in one pass; the consensus is ranked for the two targets that the proxy reads, and the
    last rank is taken of the changed target alone.
    """
    preds = written(fixtures.predictions(spark, sf_dir).select("study", "target", "model", "p"), "preds")
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("r"))).alias(m)
    ranks = written(with_rank(preds, "r", "p", ["target", "model"], "pct").groupBy("study", "target").agg(*map(one, fixtures.MODELS)), "ranks")
    read = ranks.filter(F.col("target").isin("synovitis", "effusion")).withColumn("mix", F.round(0.55 * F.col("m2") + 0.45 * F.col("m3"), 9))
    consensus = with_rank(read, "k", "mix", ["target"], "pct")
    of = lambda c, t: F.max(F.when(F.col("target") == t, F.col(c)))
    proxy = consensus.groupBy("study").agg(F.round(0.82 * of("k", "synovitis") + 0.18 * of("k", "effusion"), 9).alias("own"), of("m1", "synovitis").alias("m1"))
    proxy = with_rank(written(proxy, "proxy"), "q", "own", [], "pct").select("study", F.round(0.7 * F.col("m1") + 0.3 * F.col("q"), 9).alias("m"))
    changed = with_rank(written(proxy, "mixed"), "r", "m", [], "pct").select("study", F.lit("synovitis").alias("target"), F.col("r").alias("p"))
    return _rounded(changed.unionByName(ranks.filter("target <> 'synovitis'").select("study", "target", F.col("m1").alias("p"))))


_SOFT = f""", w AS (SELECT study, target, max(p) FILTER (model = 'm1') AS a, max(p) FILTER (model = 'm2') AS b FROM preds GROUP BY 1, 2),
r AS (SELECT study, target, {_pct("a", "target")} AS a, {_pct("b", "target")} AS b, CASE target WHEN 'acl' THEN 0.4::DOUBLE WHEN 'effusion' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS w FROM w)
SELECT study, target, round((1 - w) * a + w * b, 6) AS p FROM r"""


@query("blend_soft_target", PREDS_SQL + _SOFT)
def blend_soft_target(spark, sf_dir):
    """A weight per target; 0 leaves the base."""
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p"))).alias(m)
    wide = fixtures.predictions(spark, sf_dir).groupBy("study", "target").agg(one("m1"), one("m2"))
    w = F.coalesce(blend.weight_map({"acl": 0.4, "effusion": 0.2}, "target"), F.lit(0.0))
    ranked = blend.with_ranks(wide, {"r1": ("m1", ["target"]), "r2": ("m2", ["target"])})
    return _rounded(ranked.select("study", "target", ((1 - w) * F.col("r1") + w * F.col("r2")).alias("p")))


@query("blend_prob_pair", PREDS_SQL + " SELECT study, target, round(0.65 * max(p) FILTER (model = 'm1') + 0.35 * max(p) FILTER (model = 'm2'), 6) AS p FROM preds GROUP BY 1, 2")
def blend_prob_pair(spark, sf_dir):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p")))
    return _rounded(fixtures.predictions(spark, sf_dir).groupBy("study", "target").agg((0.65 * one("m1") + 0.35 * one("m2")).alias("p")))


_Z = """, l AS (SELECT *, ln(greatest(1e-5, least(1 - 1e-5, p)) / (1 - greatest(1e-5, least(1 - 1e-5, p)))) AS z FROM preds),
st AS (SELECT model, fold, target, round(avg(z), 5) AS mu, round(stddev_pop(z) + 1e-6, 5) AS sd FROM l GROUP BY 1, 2, 3),
zz AS (SELECT l.*, (z - mu) / sd AS zs FROM l JOIN st USING (model, fold, target))"""


@query("zlogit_calibrate", PREDS_SQL + _Z + " SELECT study, target, model, round(zs, 4) AS z FROM zz")
def zlogit_calibrate(spark, sf_dir):
    return blend.zlogit(fixtures.predictions(spark, sf_dir), ["model", "fold", "target"]).select("study", "target", "model", F.round("z", 4).alias("z"))


_FAMILY_WEIGHT = "CASE WHEN target = 'acl' THEN 0.5::DOUBLE WHEN f = 'a' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END"
_FAMILIES = (
    PREDS_SQL + ", av AS (SELECT * FROM preds WHERE NOT (model = 'm3' AND study % 4 = 1) AND NOT (model <> 'm3' AND study % 6 = 1))" + _Z.replace("FROM preds)", "FROM av)")
    + f""", fm AS (SELECT study, target, CASE WHEN model = 'm3' THEN 'b' ELSE 'a' END AS f, avg(zs) AS z FROM zz GROUP BY 1, 2, 3),
bl AS (SELECT study, target, sum({_FAMILY_WEIGHT} * z) / sum({_FAMILY_WEIGHT}) AS z FROM fm GROUP BY 1, 2), pr AS (SELECT target, avg(p) AS p FROM av GROUP BY 1)
SELECT k.study, k.target, round(CASE WHEN bl.z IS NOT NULL THEN 1 / (1 + exp(-greatest(-11.5, least(11.5, bl.z)))) ELSE pr.p END, 5) AS p
FROM (SELECT DISTINCT study, target FROM preds) k LEFT JOIN bl ON bl.study = k.study AND bl.target = k.target JOIN pr ON pr.target = k.target"""
)


@query("blend_zlogit_family", _FAMILIES)
def blend_zlogit_family(spark, sf_dir):
    """Two families of members, of which some studies lack one and some both."""
    preds = fixtures.predictions(spark, sf_dir)
    have = preds.filter(~((F.col("model") == "m3") & (F.col("study") % 4 == 1)) & ~((F.col("model") != "m3") & (F.col("study") % 6 == 1)))
    priors = have.groupBy("target").agg(F.avg("p").alias("p"))
    out = blend.blend_families(have, preds, priors, {"a": ("m1", "m2"), "b": ("m3",)}, {"a": 0.6, "b": 0.4}, ["model", "fold", "target"], {"acl": {"a": 0.5, "b": 0.5}})
    return _rounded(out, 5)


@query("blend_zlogit", PREDS_SQL + _Z + f" SELECT study, target, round(1 / (1 + exp(-greatest(-11.5, least(11.5, sum({_W} * zs) / sum({_W}))))), 5) AS p FROM zz GROUP BY 1, 2")
def blend_zlogit(spark, sf_dir):
    return _rounded(blend.blend_zlogit(fixtures.predictions(spark, sf_dir), W, ["model", "fold", "target"]), 5)


_POOL = """, a AS (SELECT study, target, list(p ORDER BY p DESC) AS v FROM preds GROUP BY 1, 2)
SELECT study, target, round(list_max(v), 6) AS p_max, round(list_sum(v) / len(v), 6) AS p_mean,
 round(1 / (1 + exp(-list_sum(list_transform(v, lambda x: ln(greatest(1e-5, least(1 - 1e-5, x)) / (1 - greatest(1e-5, least(1 - 1e-5, x)))))) / len(v))), 6) AS p_logit_mean,
 round((v[1] + v[2]) / 2, 6) AS p_top2, round(list_sum(v[1:3]) / 3, 6) AS p_top3,
 round(list_sum(list_transform(v, lambda x: x * exp(x))) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS p_soft FROM a"""


@query("pool_windows", PREDS_SQL + _POOL)
def pool_windows(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir).groupBy("study", "target").agg(F.collect_list("p").alias("v"))
    return rows.select("study", "target", *[F.round(blend.pool_windows(F.col("v"), m), 6).alias(f"p_{m}") for m in ("max", "mean", "logit_mean", "top2", "top3", "soft")])


_WIDE = ", wide AS (SELECT study, " + ", ".join(f"max(p) FILTER (target = '{t}') AS {t}" for t in fixtures.TARGETS) + " FROM preds WHERE model = 'm1' GROUP BY study)"


def wide_predictions(spark, sf_dir, model: str = "m1"):
    return fixtures.one_model(spark, sf_dir, model).groupBy("study").pivot("target", list(fixtures.TARGETS)).agg(F.max("p"))


_RULES = (
    _WIDE + """ SELECT study, round(CASE WHEN acl > 0.7 THEN least(0.99, contusion * 1.15) ELSE contusion END, 6) AS contusion,
 round(CASE WHEN medial_oa > 0.7 THEN least(0.99, (CASE WHEN acl > 0.7 THEN least(0.99, medial_meniscus * 1.1) ELSE medial_meniscus END) * 1.12)
   ELSE CASE WHEN acl > 0.7 THEN least(0.99, medial_meniscus * 1.1) ELSE medial_meniscus END END, 6) AS medial_meniscus,
 round(CASE WHEN effusion > 0.75 THEN least(0.99, synovitis * 1.1) ELSE synovitis END, 6) AS synovitis FROM wide"""
)


@query("calib_rules", PREDS_SQL + _RULES)
def calib_rules(spark, sf_dir):
    out = calibrate.apply_rules(wide_predictions(spark, sf_dir))
    return out.select("study", *[F.round(c, 6).alias(c) for c in ("contusion", "medial_meniscus", "synovitis")])


_TEMP = """, g AS (SELECT target, y, ln(greatest(1e-5, least(1 - 1e-5, p)) / (1 - greatest(1e-5, least(1 - 1e-5, p)))) AS z, unnest(list_transform(range(100), lambda i: round(0.05 + i * ((5.0 - 0.05) / 99), 6))) AS t
 FROM preds WHERE model = 'm1' AND y IN (0, 1)),
q AS (SELECT *, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-z / t)))) AS q FROM g),
f AS (SELECT target, t, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) AS loss, count(*) AS n FROM q GROUP BY 1, 2)
SELECT target, CASE WHEN max(n) >= 5 THEN greatest(0.1, least(5.0, arg_min(t, row(loss, t)))) ELSE 1.0 END AS temperature FROM f GROUP BY target"""


@query("calib_temperature_fit", PREDS_SQL + _TEMP)
def calib_temperature_fit(spark, sf_dir):
    return calibrate.fit_temperature(fixtures.one_model(spark, sf_dir), ["target"])


@query("calib_temperature_apply", PREDS_SQL + " SELECT study, target, round(greatest(0.001, least(0.999, 1 / (1 + exp(-ln(greatest(1e-5, least(1 - 1e-5, p)) / (1 - greatest(1e-5, least(1 - 1e-5, p)))) / 1.7)))), 6) AS p FROM preds WHERE model = 'm1'")
def calib_temperature_apply(spark, sf_dir):
    return _rounded(fixtures.one_model(spark, sf_dir).withColumn("p", calibrate.apply_temperature(F.col("p"), F.lit(1.7))))


_COOC = """, pos AS (SELECT DISTINCT study, target FROM preds WHERE model = 'm1' AND y = 1), n AS (SELECT target, count(*) AS n FROM pos GROUP BY 1),
co AS (SELECT a.target AS i, b.target AS j, count(*) AS k FROM pos a JOIN pos b USING (study) GROUP BY 1, 2), mat AS (SELECT i, j, k / n::DOUBLE AS p FROM co JOIN n ON n.target = j)"""


def _positives(spark, sf_dir):
    return fixtures.one_model(spark, sf_dir).filter("y = 1").select("study", "target").distinct()


@query("agg_cooccurrence", PREDS_SQL + _COOC + " SELECT i, j, round(p, 6) AS p FROM mat")
def agg_cooccurrence(spark, sf_dir):
    return calibrate.cooccurrence(_positives(spark, sf_dir)).select("i", "j", F.round("p", 6).alias("p"))


_LOGIT = "ln(greatest(1e-5, least(1 - 1e-5, {0})) / (1 - greatest(1e-5, least(1 - 1e-5, {0}))))"
_BAYES = _COOC + f""", ev AS (SELECT study, i AS target, sum(mat.p * preds.p) / sum(mat.p) AS e FROM preds JOIN mat ON mat.j = preds.target AND i <> j WHERE model = 'm1' GROUP BY 1, 2),
bay AS (SELECT preds.study, preds.target, y, coalesce(1 / (1 + exp(-greatest(-11.5, least(11.5, {_LOGIT.format("preds.p")} + BETA * {_LOGIT.format("e")})))), preds.p) AS p
 FROM preds LEFT JOIN ev ON ev.study = preds.study AND ev.target = preds.target WHERE model = 'm1')"""


@query("calib_bayes", PREDS_SQL + _BAYES.replace("BETA", "0.3") + " SELECT study, target, round(p, 6) AS p FROM bay")
def calib_bayes(spark, sf_dir):
    return _rounded(calibrate.bayes_evidence(fixtures.one_model(spark, sf_dir), calibrate.cooccurrence(_positives(spark, sf_dir)), 0.3))


_GRID = """, w AS (SELECT study, target, any_value(y) AS y, max(p) FILTER (model = 'm1') AS a, max(p) FILTER (model = 'm2') AS b FROM preds GROUP BY 1, 2),
t AS (SELECT target, y, w.w, round((1 - w.w) * a + w.w * b, 6) AS p FROM w CROSS JOIN (SELECT unnest(list_transform(range(41), lambda i: round(0.1 + i * ((0.5 - 0.1) / 40), 6))) AS w) w WHERE y IS NOT NULL AND y <> 0.5),
r AS (SELECT target, w, (y >= 0.5)::INT AS pos, rank() OVER (PARTITION BY target, w ORDER BY p) + (count(*) OVER (PARTITION BY target, w, p) - 1) / 2.0 AS r FROM t),
s AS (SELECT target, w, sum(pos) AS n1, sum(1 - pos) AS n0, sum(r) FILTER (pos = 1) AS rs FROM r GROUP BY 1, 2),
g AS (SELECT target, w, round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) AS auc FROM s WHERE n1 > 0 AND n0 > 0)
SELECT target, w, round(auc, 6) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY auc DESC, w) AS k FROM g) WHERE k = 1"""


@query("opt_grid_weight", PREDS_SQL + _GRID)
def opt_grid_weight(spark, sf_dir):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p"))).alias(m)
    wide = fixtures.predictions(spark, sf_dir).groupBy("study", "target").agg(F.max("y").alias("y"), one("m1"), one("m2"))
    return calibrate.search_weight(wide, "m1", "m2", 0.1, 0.5, 41, metrics.DIALECTS["calc"])


_SWEEP_PART = """r{k} AS (SELECT target, (y >= 0.5)::INT AS pos, rank() OVER (PARTITION BY target ORDER BY p) + (count(*) OVER (PARTITION BY target, p) - 1) / 2.0 AS r FROM (SELECT target, y, round(p, 6) AS p FROM bay{k}) WHERE y IS NOT NULL AND y <> 0.5),
s{k} AS (SELECT target, sum(pos) AS n1, sum(1 - pos) AS n0, sum(r) FILTER (pos = 1) AS rs FROM r{k} GROUP BY 1),
f{k} AS (SELECT {beta}::DOUBLE AS beta, round(avg((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0)), 6) AS macro_auc FROM s{k} WHERE n1 > 0 AND n0 > 0)"""
_BETAS = (0.1, 0.2, 0.5)
_SWEEP = (
    PREDS_SQL + _BAYES.split(",\nbay AS")[0]
    + "".join(",\nbay" + str(k) + " AS" + _BAYES.split(",\nbay AS")[1].replace("BETA", str(b)) + ",\n" + _SWEEP_PART.format(k=k, beta=b) for k, b in enumerate(_BETAS))
    + " SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2"
)


@query("opt_sweep_beta", _SWEEP)
def opt_sweep_beta(spark, sf_dir):
    """Macro AUC for each strength of the evidence, which is computed once."""
    known = calibrate.evidence(fixtures.one_model(spark, sf_dir), calibrate.cooccurrence(_positives(spark, sf_dir)))
    tried = known.withColumn("beta", F.explode(F.array(*map(F.lit, _BETAS))))
    scored = tried.select("target", "beta", "y", F.round(calibrate.raised(F.col("beta")), 6).alias("p")).groupBy("target", "beta", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    found = metrics.auc(written(scored, "equal-scores"), ["target", "beta"], metrics.DIALECTS["training"], n="n")
    return metrics.macro(found, ["beta"]).select("beta", "macro_auc")


@query("check_protected", PREDS_SQL + _SOFT.replace("SELECT study, target, round((1 - w) * a + w * b, 6) AS p FROM r", "SELECT target, count(*) FILTER (round((1 - w) * a + w * b, 6) <> round(a, 6)) AS n_changed FROM r GROUP BY target"))
def check_protected(spark, sf_dir):
    """How many rows of each target a blend changed; protected targets must show 0."""
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p"))).alias(m)
    wide = fixtures.predictions(spark, sf_dir).groupBy("study", "target").agg(one("m1"))
    base = blend.with_ranks(wide, {"r": ("m1", ["target"])}).select("study", "target", F.round("r", 6).alias("before"))
    return base.join(blend_soft_target(spark, sf_dir), ["study", "target"]).groupBy("target").agg(F.sum((F.col("p") != F.col("before")).cast("long")).alias("n_changed"))
