"""Projection, filter, join, set and aggregate queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.operators import relational as rel
from tarnmill.plans import fixtures
from tarnmill.plans.fixtures import PREDS_SQL, SERIES_SQL
from tarnmill.plans.registry import query
from tarnmill.sources.tables import table


@query("proj_columns", "SELECT p_partkey, p_name, p_brand FROM part")
def proj_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")


@query("proj_rename_suffix", "SELECT d.doc_id, d.n_chars AS n_chars_gold, length(d.text)::BIGINT AS n_chars_pred FROM documents d JOIN labels USING (doc_id)")
def proj_rename_suffix(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pred = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))
    return rel.join_suffixed(docs.join(labels, "doc_id", "left_semi").select("doc_id", "n_chars"), pred, ["doc_id"], ("_gold", "_pred"))


@query("filter_notna", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def filter_notna(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").na.drop(subset=["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("filter_bool", PREDS_SQL + " SELECT study, target, p FROM preds WHERE model = 'm1' AND NOT is_gold AND abs(y - p) >= 0.5")
def filter_bool(spark, sf_dir):
    return fixtures.one_model(spark, sf_dir).filter(~F.col("is_gold") & (F.abs(F.col("y") - F.col("p")) >= 0.5)).select("study", "target", "p")


@query("filter_isin_values", PREDS_SQL + " SELECT target, count(*) AS n FROM preds WHERE y IN (0.0, 1.0) GROUP BY target")
def filter_isin_values(spark, sf_dir):
    return fixtures.predictions(spark, sf_dir).filter(F.col("y").isin(0.0, 1.0)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("case_error_type", PREDS_SQL + " SELECT study, target, CASE WHEN y >= 0.5 AND p >= 0.5 THEN 'TP' WHEN y >= 0.5 THEN 'FN' WHEN p >= 0.5 THEN 'FP' ELSE 'TN' END AS kind FROM preds WHERE model = 'm1' AND y IS NOT NULL")
def case_error_type(spark, sf_dir):
    return fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL").select("study", "target", rel.error_type(F.col("y"), F.col("p")).alias("kind"))


@query("filter_error_type", PREDS_SQL + " SELECT study, target, CASE WHEN y >= 0.5 THEN 'FN' ELSE 'FP' END AS kind FROM preds WHERE model = 'm1' AND y IS NOT NULL AND (y >= 0.5) <> (p >= 0.5)")
def filter_error_type(spark, sf_dir):
    rows = fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL")
    return rows.select("study", "target", rel.error_type(F.col("y"), F.col("p")).alias("kind")).filter(F.col("kind").isin("FN", "FP"))


_CLASS = """SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'GRE' WHEN p_retailprice < 1000 AND p_size < 15 THEN 'T1' WHEN p_size >= 35 THEN 'T2' WHEN p_retailprice >= 1000 THEN 'PD' ELSE 'UNK' END AS weighting FROM part"""


@query("case_weight_class", _CLASS)
def case_weight_class(spark, sf_dir):
    """A first-match chain over a text flag and two measures."""
    rules = [(F.col("p_type").contains("STEEL"), "GRE"), ((F.col("p_retailprice") < 1000) & (F.col("p_size") < 15), "T1"), (F.col("p_size") >= 35, "T2"), (F.col("p_retailprice") >= 1000, "PD")]
    return table(spark, sf_dir, "part").select("p_partkey", rel.first_match(rules, "UNK").alias("weighting"))


@query("bucketize", PREDS_SQL + " SELECT target, count(*) FILTER (p < 0.5) AS low, count(*) FILTER (p >= 0.5 AND p < 0.8) AS mid, count(*) FILTER (p >= 0.8) AS high FROM preds GROUP BY target")
def bucketize(spark, sf_dir):
    return fixtures.predictions(spark, sf_dir).groupBy("target").agg(*rel.band_counts(F.col("p"), {"low": (None, 0.5), "mid": (0.5, 0.8), "high": (0.8, None)}))


_SWEEP = """ SELECT t AS threshold, count(*) FILTER (d >= t) AS n, count(DISTINCT study) FILTER (d >= t) AS n_studies
FROM (SELECT study, abs(y - p) AS d FROM preds WHERE model = 'm1' AND y IS NOT NULL) CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7]) AS t) GROUP BY t"""


@query("threshold_sweep", PREDS_SQL + _SWEEP.replace("[0.5, 0.6, 0.7]", "[0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE]"))
def threshold_sweep(spark, sf_dir):
    rows = fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL").select("study", F.abs(F.col("y") - F.col("p")).alias("d"))
    return rel.threshold_sweep(rows, "d", "study", [0.5, 0.6, 0.7])


@query("fillna_typed", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0.5) AS toxic, coalesce(d.lang, 'unknown') AS lang FROM (SELECT doc_id, nullif(lang, 'fr') AS lang FROM documents) d LEFT JOIN (SELECT doc_id, quality, toxic::DOUBLE AS toxic FROM labels) l USING (doc_id)")
def fillna_typed(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("toxic").cast("double").alias("toxic"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang")).join(labels, "doc_id", "left")
    return rows.na.fill({"quality": -1, "toxic": 0.5, "lang": "unknown"}).select("doc_id", "quality", "toxic", "lang")


@query("cast_coerce", "SELECT event_id, try_cast(event_type AS DOUBLE) AS bad, try_cast(event_id::VARCHAR AS DOUBLE) AS good FROM events")
def cast_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").try_cast("double").alias("bad"), F.col("event_id").cast("string").try_cast("double").alias("good"))


@query("clip", "SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(10, least(50, value)) END AS value FROM events")
def clip(spark, sf_dir):
    from tarnmill.operators.metrics import clip as clipped

    return table(spark, sf_dir, "events").select("event_id", clipped(F.col("value"), 10.0, 50.0).alias("value"))


@query("normalize_key", "SELECT p_partkey, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS brand, lower(trim(p_type)) AS kind FROM part")
def normalize_key(spark, sf_dir):
    """Capitalises the first letter of the whole string, unlike ``initcap``."""
    return table(spark, sf_dir, "part").select("p_partkey", rel.capitalize(F.col("p_brand")).alias("brand"), F.lower(F.trim("p_type")).alias("kind"))


@query("null_any_check", "SELECT count(*) FILTER (quality IS NULL) AS null_quality, count(*) FILTER (lang IS NULL) AS null_lang, count(*) FILTER (quality IS NULL OR lang IS NULL) > 0 AS any_null FROM documents LEFT JOIN labels USING (doc_id)")
def null_any_check(spark, sf_dir):
    return rel.null_report(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "lang"])


# Joins


@query("join_inner", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")
def join_inner(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality")


@query("join_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query("join_left", SERIES_SQL + " SELECT o_orderkey, count(series.study) AS n_series FROM orders LEFT JOIN series ON study = o_orderkey GROUP BY o_orderkey")
def join_left(spark, sf_dir):
    counts = fixtures.series(spark, sf_dir).groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("study"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_series"))


@query("join_left_align", PREDS_SQL + " SELECT d.doc_id, coalesce(p.p, 0.5) AS p FROM documents d LEFT JOIN (SELECT study, p FROM preds WHERE model = 'm1' AND target = 'acl' AND study % 3 <> 0) p ON p.study = d.doc_id")
def join_left_align(spark, sf_dir):
    have = fixtures.one_model(spark, sf_dir).filter((F.col("target") == "acl") & (F.col("study") % 3 != 0)).select(F.col("study").alias("doc_id"), "p")
    return rel.align(table(spark, sf_dir, "documents").select("doc_id"), have, "doc_id", {"p": 0.5})


@query("join_index_intersection", PREDS_SQL + " SELECT study FROM preds WHERE target = 'acl' AND (study + CASE model WHEN 'm1' THEN 0 WHEN 'm2' THEN 1 ELSE 2 END) % 5 <> 0 GROUP BY study HAVING count(DISTINCT model) = 3")
def join_index_intersection(spark, sf_dir):
    shift = F.create_map(*[F.lit(x) for i, m in enumerate(fixtures.MODELS) for x in (m, i)])[F.col("model")]
    rows = fixtures.predictions(spark, sf_dir).filter((F.col("target") == "acl") & ((F.col("study") + shift) % 5 != 0))
    return rel.common_to_all(rows, "study", "model", 3)


@query("join_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("join_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(spark, sf_dir):
    return rel.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("join_pair_lookup", PREDS_SQL + " SELECT study, target, CASE WHEN is_gold THEN 1.0 WHEN abs(y - p) >= 0.6 THEN 0.0 ELSE 0.8 END::DOUBLE AS weight FROM preds WHERE model = 'm1'")
def join_pair_lookup(spark, sf_dir):
    from tarnmill.operators import fusion

    rows = fixtures.one_model(spark, sf_dir).withColumn("weight", F.when(F.col("is_gold"), 1.0).otherwise(0.8))
    flagged = rows.filter(~F.col("is_gold") & (F.abs(F.col("y") - F.col("p")) >= 0.6)).select("study", "target")
    return fusion.zero_flagged(rows, flagged).select("study", "target", "weight")


@query("join_map_lookup", "SELECT s_suppkey, coalesce(n_name, 'none') AS site FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def join_map_lookup(spark, sf_dir):
    """A bounded dimension (25 nations) as a lookup; AQE broadcasts it by its measured size."""
    nations = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("site"))


@query("join_dimension", "SELECT l_returnflag, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def join_dimension(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("l_returnflag", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("join_candidates_fallback", "SELECT o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'A' THEN 'nested' END), max(CASE WHEN l_returnflag = 'N' THEN 'flat' END), max(CASE WHEN l_returnflag = 'R' THEN 'study' END), 'none') AS found FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def join_candidates_fallback(spark, sf_dir):
    """The first candidate that exists: one join and one aggregate instead of a join for each candidate."""
    first = lambda flag, name: F.max(F.when(F.col("l_returnflag") == flag, F.lit(name)))
    have = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(first("A", "nested"), first("N", "flat"), first("R", "study")).alias("f"))
    return table(spark, sf_dir, "orders").join(have, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("f", F.lit("none")).alias("found"))


@query("assert_aligned", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right, false AS aligned")
def assert_aligned(spark, sf_dir):
    return rel.alignment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("set_ops", "SELECT doc_id, 'difference' AS kind FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'intersection' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def set_ops(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.exceptAll(b).withColumn("kind", F.lit("difference")).unionByName(a.intersect(b).withColumn("kind", F.lit("intersection")))


@query("stack_long", "UNPIVOT (SELECT doc_id, quality, toxic FROM labels) ON quality, toxic INTO NAME target VALUE y")
def stack_long(spark, sf_dir):
    return table(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "target", "y")


# Aggregates


@query("agg_group_size", SERIES_SQL + " SELECT study, count(*) AS n FROM series GROUP BY study")
def agg_group_size(spark, sf_dir):
    return fixtures.series(spark, sf_dir).groupBy("study").agg(F.count(F.lit(1)).alias("n"))


@query("agg_size_summary", SERIES_SQL + ", g AS (SELECT count(*) AS n FROM series GROUP BY study) SELECT min(n) AS least, max(n) AS most, quantile_cont(n, 0.5)::DOUBLE AS median, round(avg(n), 6) AS mean FROM g")
def agg_size_summary(spark, sf_dir):
    sizes = agg_group_size(spark, sf_dir)
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.percentile("n", F.lit(0.5)).alias("median"), F.round(F.avg("n"), 6).alias("mean"))


@query("agg_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_value_counts(spark, sf_dir):
    return rel.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("agg_value_counts_dropna_false", "SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_value_counts_dropna_false(spark, sf_dir):
    return rel.value_counts(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality")


@query("agg_nunique", SERIES_SQL + " SELECT plane, count(DISTINCT study) AS n_studies FROM series GROUP BY plane")
def agg_nunique(spark, sf_dir):
    return fixtures.series(spark, sf_dir).groupBy("plane").agg(F.countDistinct("study").alias("n_studies"))


@query("agg_named", SERIES_SQL + " SELECT study, count(*) AS series_count, string_agg(DISTINCT plane, ',' ORDER BY plane) AS planes FROM series GROUP BY study")
def agg_named(spark, sf_dir):
    return fixtures.series(spark, sf_dir).groupBy("study").agg(F.count(F.lit(1)).alias("series_count"), F.array_join(F.sort_array(F.collect_set("plane")), ",").alias("planes"))


@query("agg_conditional_counts", "SELECT o_orderkey AS study, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS n_a_f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_conditional_counts(spark, sf_dir):
    n = lambda c: F.sum(c.cast("long"))
    counts = fixtures.series(spark, sf_dir).groupBy("study").agg(n(F.col("plane") == "A").alias("n_a"), n(F.col("fluid") == 1).alias("n_f"), n((F.col("plane") == "A") & (F.col("fluid") == 1)).alias("n_a_f"))
    return rel.align(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study")), counts, "study", {"n_a": 0, "n_f": 0, "n_a_f": 0})


@query("agg_prevalence", PREDS_SQL + " SELECT target, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round(count(*) FILTER (y = 1) / nullif(count(*) FILTER (y IN (0, 1)), 0)::DOUBLE, 6) AS share FROM preds WHERE model = 'm1' GROUP BY target")
def agg_prevalence(spark, sf_dir):
    pos, neg = (F.sum(F.coalesce((F.col("y") == v).cast("long"), F.lit(0))) for v in (1.0, 0.0))
    return fixtures.one_model(spark, sf_dir).groupBy("target").agg(pos.alias("n_pos"), neg.alias("n_neg"), F.round(F.try_divide(pos, pos + neg), 6).alias("share"))


@query("agg_describe", "SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def agg_describe(spark, sf_dir):
    return rel.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("agg_row_mean", PREDS_SQL + " SELECT study, round(avg(p), 6) AS mean, count(*) FILTER (p > 0.3 AND p < 0.7) AS uncertain FROM preds WHERE model = 'm1' GROUP BY study")
def agg_row_mean(spark, sf_dir):
    """Over the 12 columns of the wide form."""
    from tarnmill.plans.blends import wide_predictions

    cells = F.array(*fixtures.TARGETS)
    total = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)
    return wide_predictions(spark, sf_dir).select("study", F.round(total / len(fixtures.TARGETS), 6).alias("mean"), F.size(F.filter(cells, lambda x: (x > 0.3) & (x < 0.7))).cast("long").alias("uncertain"))


@query("agg_macro_mean", PREDS_SQL + " SELECT model, round(avg(m), 6) AS macro_rate FROM (SELECT model, target, avg(CASE WHEN y IN (0, 1) THEN y END) AS m FROM preds GROUP BY 1, 2) GROUP BY model")
def agg_macro_mean(spark, sf_dir):
    per = fixtures.predictions(spark, sf_dir).groupBy("model", "target").agg(F.avg(F.when(F.col("y").isin(0.0, 1.0), F.col("y"))).alias("m"))
    return per.groupBy("model").agg(F.round(F.avg("m"), 6).alias("macro_rate"))


@query("agg_weighted_mean_std", PREDS_SQL + ", l AS (SELECT model, fold, target, ln(greatest(1e-5, least(1 - 1e-5, p)) / (1 - greatest(1e-5, least(1 - 1e-5, p)))) AS z FROM preds) SELECT model, fold, target, round(avg(z), 5) AS mu, round(stddev_pop(z) + 1e-6, 5) AS sd FROM l GROUP BY 1, 2, 3")
def agg_weighted_mean_std(spark, sf_dir):
    from tarnmill.operators.blend import logit

    z = fixtures.predictions(spark, sf_dir).withColumn("z", logit(F.col("p")))
    return z.groupBy("model", "fold", "target").agg(F.round(F.avg("z"), 5).alias("mu"), F.round(F.stddev_pop("z") + 1e-6, 5).alias("sd"))


@query("agg_corr_matrix", PREDS_SQL + ", o AS (SELECT study, target, y FROM preds WHERE model = 'm1' AND y IS NOT NULL) SELECT a.target AS a, b.target AS b, round(corr(a.y, b.y), 6) AS r FROM o a JOIN o b USING (study) WHERE a.target < b.target GROUP BY 1, 2")
def agg_corr_matrix(spark, sf_dir):
    """Upper triangle of the label correlations; the self-join pairs the 12 labels of one study."""
    rows = fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL")
    a, b = rows.select("study", F.col("target").alias("a"), F.col("y").alias("ya")), rows.select("study", F.col("target").alias("b"), F.col("y").alias("yb"))
    return a.join(b, "study").filter("a < b").groupBy("a", "b").agg(F.round(F.corr("ya", "yb"), 6).alias("r"))


@query("agg_median_by_group", SERIES_SQL + ", m AS (SELECT study, quantile_cont(n_slices - 25, 0.5) AS x FROM series GROUP BY study) SELECT study, x::DOUBLE AS x, CASE WHEN x > 5 THEN 'L' WHEN x < -5 THEN 'R' END AS side FROM m")
def agg_median_by_group(spark, sf_dir):
    m = fixtures.series(spark, sf_dir).groupBy("study").agg(F.percentile(F.col("n_slices") - 25, F.lit(0.5)).alias("x"))
    return m.select("study", "x", F.when(F.col("x") > 5, "L").when(F.col("x") < -5, "R").alias("side"))


@query("agg_first_nonnull_pref", SERIES_SQL + ", o AS (SELECT study, CASE WHEN fluid = 1 THEN plane END AS tag, CASE WHEN fat = 1 THEN plane END AS geo FROM series) SELECT count(*) FILTER (tag IS NOT NULL) AS from_tag, count(*) FILTER (tag IS NULL AND geo IS NOT NULL) AS from_geometry, count(*) FILTER (coalesce(tag, geo) IS NULL) AS none FROM o")
def agg_first_nonnull_pref(spark, sf_dir):
    rows = fixtures.series(spark, sf_dir).select(F.when(F.col("fluid") == 1, F.col("plane")).alias("tag"), F.when(F.col("fat") == 1, F.col("plane")).alias("geo"))
    return rows.agg(
        F.count("tag").alias("from_tag"), F.sum((F.col("tag").isNull() & F.col("geo").isNotNull()).cast("long")).alias("from_geometry"), F.sum(F.coalesce("tag", "geo").isNull().cast("long")).alias("none")
    )


@query("agg_slot_coverage", SERIES_SQL + " SELECT plane, fluid, round(count(DISTINCT study) / (SELECT count(DISTINCT study) FROM series)::DOUBLE, 6) AS share FROM series GROUP BY 1, 2")
def agg_slot_coverage(spark, sf_dir):
    rows = fixtures.series(spark, sf_dir)
    total = rows.agg(F.countDistinct("study").alias("n"))
    return rows.groupBy("plane", "fluid").agg(F.countDistinct("study").alias("k")).crossJoin(total).select("plane", "fluid", F.round(F.col("k") / F.col("n"), 6).alias("share"))


@query("agg_text_lengths", "WITH w AS (SELECT len(string_split_regex(trim(text), '[ \\n]+')) AS n FROM documents), q AS (SELECT quantile_cont(n, 0.99) AS top FROM w) SELECT (n // 25)::BIGINT AS bin, count(*) AS n_docs, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM w, q WHERE n < top GROUP BY 1")
def agg_text_lengths(spark, sf_dir):
    """The distribution of word counts below their 99th percentile, in bins of 25; the percentile is one row."""
    words = table(spark, sf_dir, "documents").select(F.size(F.split(F.trim("text"), "[ \n]+")).cast("long").alias("n"))
    top = words.agg(F.percentile("n", F.lit(0.99)).alias("top"))
    below = words.crossJoin(top).filter("n < top").groupBy(F.floor(F.col("n") / 25).alias("bin"))
    return below.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


_DIGEST = """WITH r AS (SELECT source, doc_id // 4096 AS part, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY 1, 2)
SELECT source, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest FROM r GROUP BY source"""


@query("agg_hash_digest", _DIGEST)
def agg_hash_digest(spark, sf_dir):
    """SHA-256 of the digests of a group's ranges of 4,096 ids, in order, each over its ordered ids: no task holds all
    ids of a large group."""
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["v"]), "\n")
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 4096).alias("part"), F.struct(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("v")).alias("id"))
    parts = rows.groupBy("source", "part").agg(F.sha2(ordered("id"), 256).alias("digest"))
    return parts.select("source", F.struct(F.col("part").alias("k"), F.col("digest").alias("v")).alias("d")).groupBy("source").agg(F.sha2(ordered("d"), 256).alias("digest"))


@query("sink_append_resume", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS attempt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sink_append_resume(spark, sf_dir):
    """A job that was cut after a third of its rows: started again it appends the rows whose ids the output lacks, and a
    further start appends none."""
    from tarnmill.sources import files

    path = files.scratch(spark, "appended")
    todo = rel.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    todo.filter("doc_id % 3 = 0").withColumn("attempt", F.lit(1)).write.parquet(path)
    for attempt in (2, 3):
        done = spark.read.schema("doc_id bigint, attempt int").parquet(path)
        files.written(rel.remaining(todo, done, "doc_id"), "resumed").withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(path)
    return spark.read.schema("doc_id bigint, attempt int").parquet(path)


@query("running_totals_stop", "WITH t AS (SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cost FROM events WHERE value IS NOT NULL) SELECT event_id, user_id, round(cost, 4) AS cost FROM t WHERE cost <= 100")
def running_totals_stop(spark, sf_dir):
    """Work of each account up to its budget."""
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    return rel.within_budget(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 100.0).select("event_id", "user_id", F.round("total", 4).alias("cost"))


@query("poll_latest_status", "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status, count(*) AS n_polls FROM events GROUP BY user_id")
def poll_latest_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n_polls"))
