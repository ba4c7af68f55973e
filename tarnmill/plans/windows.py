"""Rank, top-k, pick, deduplicate and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.operators import picks
from tarnmill.operators.ranking import row_number, with_position, with_rank
from tarnmill.plans import fixtures
from tarnmill.plans.fixtures import PREDS_SQL, SERIES_KEY, SERIES_SQL
from tarnmill.plans.registry import query
from tarnmill.sources.tables import table

_AVG = "(rank() OVER (PARTITION BY target, model ORDER BY p) + (count(*) OVER (PARTITION BY target, model, p) - 1) / 2.0)"
_N = "count(*) OVER (PARTITION BY target, model)"
_TIE = ["seq", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_TIE_SQL = ", ".join(_TIE)


def _tie(desc: bool = False):
    return [F.desc(c) if desc else F.asc(c) for c in _TIE]


def _rank_query(name: str, sql: str, kind: str) -> None:
    @query(name, PREDS_SQL + f" SELECT study, target, model, {sql} AS r FROM preds")
    def run(spark, sf_dir):
        ranked = with_rank(fixtures.predictions(spark, sf_dir), "r", "p", ["target", "model"], kind)
        return ranked.select("study", "target", "model", F.round("r", 9).alias("r"))


_rank_query("rank_avg", _AVG, "avg")
_rank_query("rank_pct", f"round({_AVG} / {_N}, 9)", "pct")
_rank_query("rank01", f"CASE WHEN {_N} > 1 THEN round(({_AVG} - 1) / ({_N} - 1), 9) ELSE 0.5 END", "01")


@query("rank_ordinal01", PREDS_SQL + f" SELECT study, target, model, round((row_number() OVER (PARTITION BY target, model ORDER BY p, study) - 1) / ({_N} - 1)::DOUBLE, 9) AS r FROM preds")
def rank_ordinal01(spark, sf_dir):
    preds = fixtures.predictions(spark, sf_dir)
    sizes = preds.groupBy("target", "model").agg(F.count(F.lit(1)).alias("n"))
    placed = with_position(preds, "k", "p", "study", ["target", "model"]).join(sizes, ["target", "model"])
    return placed.select("study", "target", "model", F.round((F.col("k") - 1) / (F.col("n") - 1), 9).alias("r"))


@query("rank_within_target", PREDS_SQL + " SELECT target, study, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN y = 1 THEN p ELSE 1 - p END, study) AS rank FROM preds WHERE model = 'm1' AND y IN (0, 1)")
def rank_within_target(spark, sf_dir):
    """From the least self-confidence on: the probability given to the label."""
    own = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    rows = fixtures.one_model(spark, sf_dir).filter(F.col("y").isin(0.0, 1.0)).withColumn("own", own)
    return with_position(rows, "rank", "own", "study", ["target"]).select("target", "study", "rank")


@query("topn_sort", PREDS_SQL + " SELECT study, target, round(abs(y - p), 4) AS d FROM preds WHERE model = 'm1' AND y IS NOT NULL ORDER BY abs(y - p) DESC, study, target LIMIT 25")
def topn_sort(spark, sf_dir):
    rows = fixtures.one_model(spark, sf_dir).filter("y IS NOT NULL").withColumn("d", F.abs(F.col("y") - F.col("p")))
    return rows.orderBy(F.desc("d"), "study", "target").limit(25).select("study", "target", F.round("d", 4).alias("d"))


@query("topn_per_group", PREDS_SQL + " SELECT target, study, k FROM (SELECT target, study, row_number() OVER (PARTITION BY target ORDER BY p DESC, study) AS k FROM preds WHERE model = 'm1') WHERE k <= 3")
def topn_per_group(spark, sf_dir):
    """Spark limits each partition's groups before the shuffle (WindowGroupLimit)."""
    return picks.top_per_group(fixtures.one_model(spark, sf_dir), ["target"], [F.desc("p"), F.col("study")], 3).select("target", "study", "k")


@query("pick_best_per_group", SERIES_SQL + f" SELECT study, plane, seq, n_slices FROM (SELECT *, row_number() OVER (PARTITION BY study, plane ORDER BY n_slices DESC, {_TIE_SQL}) AS k FROM series) WHERE k = 1")
def pick_best_per_group(spark, sf_dir):
    return picks.first_per_group(fixtures.series(spark, sf_dir), ["study", "plane"], [F.desc("n_slices"), *_tie()], ["seq", "n_slices"])


@query("pick_priority", SERIES_SQL + f" SELECT study, plane, seq, score FROM (SELECT *, 2 * fluid + fat AS score, row_number() OVER (PARTITION BY study, plane ORDER BY 2 * fluid + fat DESC, {_TIE_SQL}) AS k FROM series) WHERE k = 1")
def pick_priority(spark, sf_dir):
    rows = fixtures.series(spark, sf_dir).withColumn("score", 2 * F.col("fluid") + F.col("fat"))
    return picks.first_per_group(rows, ["study", "plane"], [F.desc("score"), *_tie()], ["seq", "score"])


@query("pick_last_wins", SERIES_SQL + f" SELECT study, plane, arg_max(n_slices, row({_TIE_SQL})) AS n_slices FROM series GROUP BY 1, 2")
def pick_last_wins(spark, sf_dir):
    """The last by an explicit order, one combined aggregate; rows themselves have no order."""
    return fixtures.series(spark, sf_dir).groupBy("study", "plane").agg(F.max_by("n_slices", F.struct(*_TIE)).alias("n_slices"))


@query("pick_first_wins", SERIES_SQL + f" SELECT study, plane, arg_min(n_slices, row({_TIE_SQL})) AS n_slices FROM series GROUP BY 1, 2")
def pick_first_wins(spark, sf_dir):
    return fixtures.series(spark, sf_dir).groupBy("study", "plane").agg(F.min_by("n_slices", F.struct(*_TIE)).alias("n_slices"))


@query("dedup_keep_first", PREDS_SQL + ", u AS (SELECT study, target, fold, p FROM preds WHERE model = 'm1' UNION ALL SELECT study, target, fold + 5, p FROM preds WHERE model = 'm2' AND is_gold) SELECT study, target, fold, p FROM (SELECT *, row_number() OVER (PARTITION BY study, target ORDER BY fold) AS k FROM u) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir)
    more = rows.filter("model = 'm2' AND is_gold").withColumn("fold", F.col("fold") + 5)
    both = rows.filter("model = 'm1'").unionByName(more).select("study", "target", "fold", "p")
    return picks.first_per_group(both, ["study", "target"], [F.col("fold")], ["fold", "p"])


@query("dup_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_check(spark, sf_dir):
    return picks.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dedup_ordered_list", "WITH k AS (SELECT l_orderkey, l_returnflag || l_linestatus AS item, min(row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) AS first FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(item, ',' ORDER BY first, item) AS kit FROM k GROUP BY 1")
def dedup_ordered_list(spark, sf_dir):
    """Distinct items of a study in the order of their first occurrence."""
    rows = table(spark, sf_dir, "lineitem").withColumn("item", F.concat("l_returnflag", "l_linestatus"))
    first = rows.groupBy("l_orderkey", "item").agg(F.min(F.struct(*SERIES_KEY[1:])).alias("first"))
    listed = first.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("first", "item"))).alias("items"))
    return listed.select("l_orderkey", F.array_join(F.transform("items", lambda x: x["item"]), ",").alias("kit"))


_NB = SERIES_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY " + _TIE_SQL + ") AS z FROM series) SELECT study, z, n_slices AS mid, coalesce(lag(n_slices) OVER w, n_slices) AS below, coalesce(lead(n_slices) OVER w, n_slices) AS above FROM o WINDOW w AS (PARTITION BY study ORDER BY z)"


@query("neighbor_slice", _NB)
def neighbor_slice(spark, sf_dir):
    rows = fixtures.series(spark, sf_dir).withColumn("z", row_number(["study"], _tie()))
    return picks.neighbours(rows, ["study"], "z", "n_slices").select("study", "z", F.col("n_slices").alias("mid"), "below", "above")


@query("sort_natural", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g')::BIGINT AS number, row_number() OVER (PARTITION BY c_nationkey ORDER BY regexp_replace(c_name, '[^0-9]', '', 'g')::BIGINT, c_custkey) AS k FROM customer")
def sort_natural(spark, sf_dir):
    """Names with numbers in them by the value of the numbers, ranked within each nation."""
    rows = table(spark, sf_dir, "customer").withColumn("key", picks.natural_key(F.col("c_name")))
    return rows.select("c_custkey", F.regexp_replace("c_name", "[^0-9]", "").cast("bigint").alias("number"), row_number(["c_nationkey"], [F.col("key"), F.col("c_custkey")]).alias("k"))


_CHAIN = SERIES_SQL + """, s AS (SELECT *, avg(fluid) OVER (PARTITION BY study) >= 0.8 AS geo FROM series)
SELECT study, seq, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY study ORDER BY CASE WHEN geo THEN n_slices ELSE seq END, """ + _TIE_SQL + ") AS k FROM s"


@query("sort_fallback_chain", _CHAIN)
def sort_fallback_chain(spark, sf_dir):
    """By geometry where at least 80 % of a study's rows have it, else by number."""
    rows = fixtures.series(spark, sf_dir).withColumn("geo", F.avg("fluid").over(picks.window(["study"])) >= 0.8)
    key = F.when(F.col("geo"), F.col("n_slices")).otherwise(F.col("seq").cast("double"))
    return rows.select("study", "seq", "l_partkey", "l_suppkey", "l_extendedprice", row_number(["study"], [key, *_tie()]).alias("k"))


_LIN = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, i, CASE WHEN n >= 10 THEN floor(lo + i * (hi - lo) / 7.0)::BIGINT ELSE floor(i * (n - 1) / 7.0)::BIGINT END AS cut,
 round_even(CASE WHEN n >= 10 THEN lo + i * (hi - lo) / 7.0 ELSE i * (n - 1) / 7.0 END, 0)::BIGINT AS near
FROM (SELECT *, l_quantity::BIGINT AS n, floor(l_quantity * 0.12)::DOUBLE AS lo, (floor(l_quantity * 0.88) - 1)::DOUBLE AS hi, unnest(range(8)) AS i FROM lineitem)"""


@query("sample_linspace_idx", _LIN)
def sample_linspace_idx(spark, sf_dir):
    """Eight evenly spaced slices of the middle band, truncated and rounded half to even; short series use all."""
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("bigint"))
    return rows.select(*SERIES_KEY, F.explode(picks.linspace(F.col("l_quantity"), 8, 0.12, 0.88)).alias("s")).select(*SERIES_KEY, "s.i", "s.cut", "s.near")


@query("sliding_window_starts", "SELECT o_orderkey, unnest(range(0, greatest(1, n - 2))) AS start FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def sliding_window_starts(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    have = n.join(table(spark, sf_dir, "orders"), "o_orderkey", "left_semi")
    return have.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.col("n") - 3))).alias("start"))


@query("knn_exact", "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))), 6) AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT a, b, k, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p) WHERE k <= 5")
def knn_exact(spark, sf_dir):
    """The five nearest vectors of every fiftieth vector: a stated query set, sent in blocks against all rows."""
    return picks.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5)
