"""Golden rows and invariants of the core operators."""

from __future__ import annotations

import itertools
import re
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tarnmill.functions import text as tx
from tarnmill.operators import audit, calibrate, geometry, labeling, metrics, sequential
from tarnmill.operators.ranking import pair_areas, with_position, with_rank
from tarnmill.plans import registry
from tarnmill.plans.fixtures import TARGETS
from tests import oracle


def _label(spark, text):
    rows = labeling.label_reports(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    return {r["target"]: r["label"] for r in rows}


@pytest.mark.parametrize(
    "text, want",
    [
        ("There is a large Baker cyst behind the joint. A bone contusion of the femoral condyle is seen.", {"bakers": 1.0, "contusion": 1.0}),
        ("The medial meniscus is normal. There is no fracture. No joint effusion is seen.", {"medial_meniscus": 0.0, "fracture": 0.0, "effusion": 0.0}),
        ("Se observa rotura completa del ligamento cruzado anterior y quiste de Baker.", {"acl": 1.0, "bakers": 1.0}),
        ("No hay fractura. Sin derrame articular.", {"fracture": 0.0, "effusion": 0.0}),
        ("Rupture complète du ligament croisé antérieur.", {"acl": 1.0}),
    ],
)
def test_labels(spark, text, want):
    got = _label(spark, text)
    assert len(got) == len(TARGETS)
    assert {k: got[k] for k in want} == want


def test_hedge_is_not_an_assertion(spark):
    assert _label(spark, "A small tear of the medial meniscus is possible but not certain.")["medial_meniscus"] != 1.0


def test_training_dialect_knows_fewer_negations(spark):
    from tarnmill.functions.finding_rules import NEGATIONS, training_negations

    df = spark.createDataFrame([(1, "Rupture du menisque interne, patella normale")], "id int, t string")
    label = lambda negations: {r["target"]: r["label"] for r in labeling.label_reports(df, "id", "t", negations=negations).collect()}["medial_meniscus"]
    assert set(training_negations()) < set(NEGATIONS) and label(NEGATIONS) != 1.0 and label(training_negations()) == 1.0


def test_labels_of_nothing(spark):
    assert set(_label(spark, None).values()) == {None} and set(_label(spark, "").values()) == {None}


ODD_TEXTS = (
    None, "", " ... ", "\u00a0", "\u3000.\u00a0", "-\f-", "x\vno para", "that\vis para", "no a\u2028b que", "with a\u0085b the", "by \u2029 of", "\u00a0no para", "para.\u2003no para",
    "W\u0130TH x THE", "N\u0130CHT para", "w\u0131th x the", "th\u0131s is para", "by " + "\u0130" * 20 + "of", "no " + "\u0130" * 40 + "que", "pa\u017f para", "no " + "x" * 41 + "que",
)


@pytest.mark.parametrize("name", ["label_dataframe", "label_finding", "split_sentences", "label_sentence", "split_clauses", "label_graded_score", "label_polarity"])
def test_queries_read_odd_texts_as_their_sql(spark, tmp_path, name):
    words = ("no", "with", "the", "para", "THIS IS", "que", "\u0130", "\u0131", "\u00a0", "\v", "\f", "\u2028", ". ", "; ", ", ")
    rng = np.random.default_rng(4)
    texts = [*ODD_TEXTS, *(" ".join(rng.choice(words, 12)) for _ in range(100))]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    oracle.check(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name])


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 60), rng.integers(0, 10, 60) / 10
    pairs = [(a > b) + 0.5 * (a == b) for (a, s), (b, t) in itertools.product(zip(p, y), zip(p, y)) if s == 1 and t == 0]
    df = spark.createDataFrame([("t", float(a), float(b)) for a, b in zip(y, p)], "target string, y double, p double")
    got = metrics.auc(df, ["target"], metrics.DIALECTS["training"]).first()["auc"]
    assert got == pytest.approx(np.mean(pairs))


def test_auc_dialects_of_one_class(spark):
    df = spark.createDataFrame([("t", 1.0, 0.3), ("t", 1.0, 0.4), ("t", None, 0.9)], "target string, y double, p double")
    assert metrics.auc(df, ["target"], metrics.DIALECTS["competition"]).first()["auc"] == 0.5
    assert metrics.auc(df, ["target"], metrics.DIALECTS["training"]).first()["auc"] is None


def test_rank_avg(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double").withColumn("g", F.lit(1))
    assert sorted(r["r"] for r in with_rank(df, "r", "v", ["g"]).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_ranks_match_sorting(spark):
    """Nulls first, NaN last, infinities, ties and groups of one, against a plain sort."""
    rng = random.Random(3)
    pool = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, -5.0, 0.25, *(rng.random() for _ in range(30))]
    rows = [(k, None if k % 5 == 4 else k % 5, rng.choice(pool)) for k in range(400)] + [(999, 77, 2.0)]
    order = lambda v: (0, 0) if v is None else (3, 0) if v != v else (1, v)
    df = spark.createDataFrame(rows, "id bigint, g int, v double")
    got = {r["id"]: (r["avg"], r["pct"], r["one"], r["pos"]) for r in with_position(with_rank(with_rank(with_rank(df, "avg", "v", ["g"]), "pct", "v", ["g"], "pct"), "one", "v", ["g"], "01"), "pos", "v", "id", ["g"]).collect()}
    for k, g, v in rows:
        group = [(order(x), i) for i, h, x in rows if h == g]
        below, same, n = sum(o < order(v) for o, _ in group), sum(o == order(v) for o, _ in group), len(group)
        rank = below + (same + 1) / 2
        assert got[k] == (rank, pytest.approx(rank / n), pytest.approx((rank - 1) / (n - 1) if n > 1 else 0.5), 1 + sum(x < (order(v), k) for x in group))


def test_pair_areas_match_distinct_scores_and_move_rows_once(spark):
    rng = np.random.default_rng(6)
    rows = [(str(rng.integers(3)), float(rng.choice([-0.5, 0.0, 0.25, rng.random(), 1e-9])), int(rng.integers(3)), int(rng.integers(3))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, p double, pos long, neg long")
    got = pair_areas(df, ["g"], "p", "pos", "neg")
    for r in got.collect():
        mine = [x for x in rows if x[0] == r["g"]]
        want = sum(a[2] * b[3] * (1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0) for a in mine for b in mine)
        assert (r["n1"], r["n0"], r["s"]) == (sum(x[2] for x in mine), sum(x[3] for x in mine), want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(g") == 2 and "Join" not in plan  # rows, then one row a range


def test_rules_compound(spark):
    row = {t: 0.5 for t in TARGETS} | {"acl": 0.9, "medial_oa": 0.8}
    out = calibrate.apply_rules(spark.createDataFrame([row])).first()
    assert out["medial_meniscus"] == pytest.approx(0.5 * 1.10 * 1.12) and out["contusion"] == pytest.approx(0.575)


@pytest.mark.parametrize("orientation, plane", [([0, 1, 0, 0, 0, -1], "Sagittal"), ([1, 0, 0, 0, 0, -1], "Coronal"), ([1, 0, 0, 0, 1, 0], "Axial")])
def test_planes(spark, orientation, plane):
    df = spark.createDataFrame([([float(x) for x in orientation],)], "o array<double>")
    assert df.select(geometry.plane(F.col("o"))).first()[0] == plane


def test_folds_are_balanced(spark):
    rng = np.random.default_rng(0)
    y = (rng.random((500, 4)) < 0.2).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)], "study bigint, a double, b double, c double, d double")
    folds = {r["study"]: r["fold"] for r in sequential.stratified_folds(df, list("abcd")).collect()}
    sizes = np.bincount([folds[i] for i in range(500)], minlength=5)
    assert sizes.min() >= 97 and sizes.max() <= 103
    for t in range(4):
        per = np.array([y[[i for i in range(500) if folds[i] == k], t].sum() for k in range(5)])
        assert per.max() - per.min() <= 3


def test_quota(spark):
    rows = [(g, s) for g, ns in ((1, (5, 1, 9)), (2, (1, 1, 1)), (3, (2, 2, 2, 2))) for s, n in zip("abcd", ns) for _ in range(n)]
    out = sequential.quota_per_group(spark.createDataFrame(rows, "g int, s string"), "g", "s", 6).collect()
    got = {(r["g"], r["s"]): r["quota"] for r in out}
    assert [got[1, s] for s in "abc"] == [2, 0, 4] and [got[2, s] for s in "abc"] == [1, 1, 1] and [got[3, s] for s in "abcd"] == [2, 2, 1, 1]


def test_folds_deal_dense_rows_first(spark):
    df = spark.createDataFrame([(k, 1.0, 1.0) for k in range(5)] + [(10 + k, 1.0, None) for k in range(10)] + [(100 + k, 0.0, 0.0) for k in range(10)], "study bigint, a double, b double")
    fold = {r["study"]: r["fold"] for r in sequential.stratified_folds(df, ["a", "b"]).collect()}
    assert sorted(fold[k] for k in range(5)) == [0, 1, 2, 3, 4]
    for ids in (range(10, 20), range(100, 110)):
        assert sorted(fold[k] for k in ids) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_contract_of_other_columns(spark):
    ids = spark.createDataFrame([(1,), (2,)], "k int")
    of = lambda rows, schema: {r["name"]: r["passed"] for r in audit.contract(spark.createDataFrame(rows, schema), ids, ["k", "p"], ["p"]).collect()}
    assert all(of([(1, 0.5), (2, 0.1)], "k int, p double").values())
    bad = of([(1, float("nan")), (1, None)], "k int, p double")
    assert not any(bad[n] for n in ("finite", "unique", "same_ids", "no_null")) and bad["columns"] and bad["rows"]
    assert of([(1, "x")], "k int, p string") == {"columns": True, "numeric": False, "finite": True}
    assert of([(1, 0.5)], "k int, q double") == {"columns": False, "numeric": False, "finite": True}


def test_text_functions(spark):
    df = spark.createDataFrame([("É x;\ny", "```json\n{\"status\": \"yes\"}\n```")], "t string, j string")
    row = df.select(tx.normalize_text(F.col("t")).alias("n"), tx.strip_accents("t").alias("s"), tx.fenced_json(F.col("j"), "status string").alias("j")).first()
    assert row["n"] == "é x . . y" and row["s"] == "E x;\ny" and row["j"]["status"] == "yes"


def test_texts_are_folded_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(tx, "SLICE_BYTES", 12)
    seen = []

    def fold(x):
        seen.append(x)
        return x.upper()

    slices, to_list = [], pa.Array.to_pylist
    texts = pa.array(["é" * 5, None, "a", "", "ж" * 20, "b", None, "c" * 11, "d"])

    class Counted:
        def __init__(self, held):
            self.held, self.type = held, held.type

        def __len__(self):
            return len(self.held)

        def slice(self, at, n):
            slices.append(sum(len(x.encode()) for x in to_list(self.held.slice(at, n)) if x))
            return self.held.slice(at, n)

    monkeypatch.setattr(tx.pc, "binary_length", lambda x, f=pa.compute.binary_length: f(x.held if isinstance(x, Counted) else x))
    out = tx.by_slices(Counted(texts), fold)
    assert out.to_pylist() == [x and x.upper() for x in texts.to_pylist()] and sum(slices) == sum(len(x.encode()) for x in texts.to_pylist() if x)
    assert sorted(slices)[-1] == 40 and sorted(slices)[-2] <= 12 and len(seen) == 7
    assert tx.by_slices(texts.slice(2, 0), fold).to_pylist() == [] and tx.by_slices(texts.slice(3, 2), fold).to_pylist() == ["", "Ж" * 20]



def test_stream_matches_batch(spark, sf_dir, tmp_path):
    from tarnmill.streaming import events as ev

    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    ev.run_to_memory(ev.latest_status(ev.read_events(spark, str(tmp_path / "in"), src.schema, 1)), "latest")
    got = {r["user_id"]: r["status"] for r in spark.sql("SELECT * FROM latest").collect()}
    assert got == {r["user_id"]: r["status"] for r in ev.latest_status(src).collect()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_clauses(spark):
    long = "one two three, four five, six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty a b c d e f"
    cases = {
        "Ligaments:\nNo rupture. Cartilage thin; menisci fine": ["Ligaments: No rupture.", "No rupture.", "Cartilage thin;", "menisci fine"],
        "Last header:": ["Last header:"],
        " ".join("w" for _ in range(15)) + ":\nvalue": [" ".join("w" for _ in range(15)) + ":", "value"],
        "3.5 mm wide.Next": ["3.5 mm wide.Next"],
        "A:\nB:\nc": ["A: B:", "B: c", "c"],
        long: [long, "one two three", long.split(", ")[2]],
        "": [],
        " \n ": [],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(99, None)], "k int, t string")
    got = {r["k"]: r["c"] for r in df.select("k", tx.clauses(F.col("t")).alias("c")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[99] is None


def test_span_distances_match_brute_force(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(150):
        rows.append((k, " ".join(rng.choice(["stem", "sidé", "x", "yy", "zzz", "stemside"], rng.integers(0, 60), p=[0.04, 0.04, 0.3, 0.3, 0.3, 0.02]))))
    df = spark.createDataFrame([*rows, (900, None)], "k int, t string")
    spans = df.select("k", tx.match_spans(F.col("t"), "(?i)stem").alias("a"), tx.match_spans(F.col("t"), "sid[eé]").alias("b"))
    got = {r["k"]: r for r in spans.withColumn("d", tx.span_distance(F.col("a"), F.col("b"))).collect()}
    for k, t in rows:
        a, b = ([m.span() for m in re.finditer(p, t)] for p in ("stem", "sid[eé]"))
        assert [tuple(s) for s in got[k]["a"]] == a and [tuple(s) for s in got[k]["b"]] == b
        near = [max(0, q0 - m1, m0 - q1) for m0, m1 in a for q0, q1 in b if q0 >= m0 - 55 and q1 <= m1 + 55]
        assert got[k]["d"] == min(near, default=None)
    assert got[900]["a"] is None and got[900]["d"] is None
    sides = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (None, 1), (1, None), (None, None)], "a int, b int").select(tx.nearest_side(F.col("a"), F.col("b")))
    assert [r[0] for r in sides.collect()] == ["own", "other", "own", "other", "own", None]


def test_spans_ignore_case_in_all_scripts(spark):
    df = spark.createDataFrame([("FÜR für Für x",)], "t string")
    spans = df.select(tx.match_spans(F.col("t"), "(?i)(für)").alias("a"), tx.match_spans(F.col("t"), "für").alias("b")).first()
    assert [tuple(s) for s in spans["a"]] == [(0, 3), (4, 7), (8, 11)] and [tuple(s) for s in spans["b"]] == [(4, 7)]


def test_graded_labels(spark):
    rule = labeling.GradedRule(
        "effusion", anatomy="effusion|fluid", uncertain="possible", negative="no |without", normal="normal|physiologic", severe="tear", high="large|marked", low="small|trace",
        decoy="cyst fluid", penalty="old", bonus="acute",
    )
    texts = {
        "Large effusion. Small effusion.": (2, 0, 0, 0.98, 0.85), "Trace of fluid": (1, 0, 0, 0.719, 0.7), "Acute effusion": (1, 0, 0, 0.95, 0.7), "Old effusion": (1, 0, 0, 0.67175, 0.7),
        "Possible effusion": (0, 0, 1, 0.626, 0.55), "No effusion. Without fluid.": (0, 2, 0, 0.12, 0.69), "Normal fluid": (0, 1, 0, 0.16, 0.57), "Normal fluid beside the tear": (1, 0, 0, 0.845, 0.7),
        "Cyst fluid": (0, 0, 0, 0.28, 0.05), "": (0, 0, 0, 0.28, 0.05),
    }
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "k int, t string")
    got = {r["k"]: tuple(r)[2:] for r in labeling.graded_labels(df, "k", F.lower("t"), rule).collect()}
    for k, want in enumerate(texts.values()):
        assert got[k][:3] == want[:3] and got[k][3] == pytest.approx(min(0.95, want[3]), abs=1e-4) and got[k][4] == pytest.approx(want[4], abs=1e-6), k
    assert got[99] == (0, 0, 0, 0.28, 0.05)


def test_log_blocks(spark):
    log = "start\n--- Epoch 1/9 Summary (Fold 0) ---\nTrain Loss: 0.50 | lr=-2\nGold   AUC = 0.9\n\n--- Epoch 2/9 Summary (Fold 3) ---\nnothing here\n"
    got = spark.createDataFrame([(log,), ("",), (None,)], "t string").select(tx.log_blocks(F.col("t")).alias("b")).collect()
    assert [(b["epoch"], b["fold"], [tuple(m) for m in b["metrics"]]) for b in got[0]["b"]] == [(1, 0, [("Train Loss", 0.5), ("lr", -2.0), ("Gold AUC", 0.9)]), (2, 3, [])]
    assert got[1]["b"] == [] and got[2]["b"] is None


def test_evidence_has_one_row_of_sums_a_study(spark):
    """A study's sums are one row, met by its rows unsorted; null studies and targets meet none, and null predictions count in
    the weights alone."""
    preds = spark.createDataFrame(
        [(1, "a", 1.0, 0.2), (1, "b", 0.0, 0.6), (1, "b", 0.0, 0.8), (1, "c", None, None), (2, "a", 1.0, 0.9), (None, "a", 1.0, 0.5), (None, "b", 1.0, 0.5), (3, "z", 1.0, 0.5), (3, None, 1.0, 0.5), (4, "z", 0.0, 0.1), (4, "b", 0.0, 0.4)],
        "study long, target string, y double, p double",
    )
    matrix = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25), ("b", "a", 0.75), ("c", "b", 0.125), ("a", "a", 1.0)], "i string, j string, p double")
    found = calibrate.evidence(preds, matrix)
    e = {(r["study"], r["target"], r["p"]): r["e"] for r in found.collect()}
    want = {(1, "a", 0.2): (0.5 * 0.6 + 0.5 * 0.8) / 1.25, (1, "b", 0.6): 0.2, (1, "b", 0.8): 0.2, (1, "c", None): 0.7}
    assert {k: v for k, v in e.items() if v is not None} == pytest.approx(want) and len(e) == 11
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [study#" in plan and "Sort [" not in plan and not re.search(r"Join \[study#\d+L?, target", plan)
    assert [r["e"] for r in calibrate.evidence(preds, matrix.limit(0)).distinct().select("e").distinct().collect()] == [None]


def test_gates_run_behind_their_literals(spark):
    """Sentences without any literal of a gate do not reach it, and labels are the same as without literals."""
    from dataclasses import replace

    from tarnmill.functions import finding_rules as fr

    rules = fr.rule_table()
    lists = (fr.ACL, fr.MCL, fr.MEDIAL_MENISCUS, fr.LATERAL_MENISCUS, fr.MEDIAL_COMPARTMENT, fr.LATERAL_COMPARTMENT, fr.PATELLOFEMORAL, fr.EFFUSION, fr.SYNOVITIS, fr.BAKERS, fr.CONTUSION, fr.FRACTURE)
    words = [w for x in lists for w in x.replace("[eé]", "e").replace("?", "").replace(r"\b", "").split("|")]
    words += ["meniscos ambos", "menisco los dos", "medial y lateral", "meniscos", "SIVI ARTISI", "commen", "MM", "film"]
    texts = [f"{a} {w} {b}" for w in words for a, b in (("", "tear"), ("", "ulcer"), ("no", ""), ("lesion of the", "normal"), ("é", "INTACT oa"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda rs, fold: {tuple(r) for r in labeling.label_reports(docs, "doc_id", "text", rs, fold_accents=fold).collect()}
    for fold in (True, False):
        got = found(rules, fold)
        assert got == found([replace(r, stems=()) for r in rules], fold) and len({(t, x) for _, t, x in got}) == 36
    plan = labeling.label_reports(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Contains(_tm_low" in plan
    assert fr.stems(r"collat[eé]ral m[eé]dial|meniscos? (medial|sıvı)|mm\b") == ("collat", "menisco", "medial", "sivi", "mm")
