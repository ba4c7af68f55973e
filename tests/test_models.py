"""Projections, second-level models, searches, images and array archives against numpy, brute force and round trips."""

from __future__ import annotations

import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.operators import images, projection, search, stacking
from tarnmill.sources import arrays

# projections


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 50
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    mean, axes, values = projection.fit_pca(df, "v", 4)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1][:4]
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(values, want) and np.allclose(axes @ axes.T, np.eye(4), atol=1e-9)
    assert (axes[np.arange(4), np.abs(axes).argmax(axis=1)] > 0).all()
    got = {r["id"]: r["u"] for r in projection.apply_pca(df, "v", mean, axes, "u").collect()}
    raw = (x - mean) @ axes.T
    assert np.allclose([got[k] for k in range(300)], raw / np.linalg.norm(raw, axis=1, keepdims=True), atol=1e-7)
    assert got[900] is None and got[901] is None
    assert projection.fit_pca(df.filter("false"), "v", 4)[1].shape == (0, 0)
    assert projection.apply_pca(df, "v", *projection.fit_pca(df.filter("false"), "v", 4)[:2], "u").select("u").distinct().collect() == [(None,)]


def char_wb(text):
    out = []
    for w in text.split():
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def test_word_grams(spark):
    text = "a bb  cçc\tdéjà-vu 😀x"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(projection.word_grams(F.col("t")).alias("g")).collect()
    assert sorted(got[0]["g"]) == sorted(char_wb(text)) and got[1]["g"] == [] and got[2]["g"] is None


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (98, ""), (99, None)], "id int, t string")
    weights = projection.term_weights(df, "id", F.col("t"), min_df=2).cache()
    terms = sorted({r["term"] for r in weights.collect()})
    a = np.zeros((60, len(terms)))
    for r in weights.collect():
        a[r["id"], terms.index(r["term"])] = r["w"]
    n, counts = 61, np.array([[char_wb(t).count(g) for g in terms] for t in texts])
    raw = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1)
    assert np.allclose(a, raw / np.linalg.norm(raw, axis=1, keepdims=True))
    rows, values = projection.truncated_svd(weights, dims=5)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:5], rtol=1e-6)
    z = a @ projection.with_fixed_sign(vt[:5]).T
    got = {r["id"]: r["fingerprint"] for r in rows.collect()}
    assert sorted(got) == list(range(60))
    assert np.allclose([got[k] for k in range(60)], z / np.linalg.norm(z, axis=1, keepdims=True), atol=1e-4)
    assert projection.truncated_svd(weights.filter("false"))[1].shape == (0,)


def test_vocabulary_is_cut_by_counts_then_text(spark):
    df = spark.createDataFrame([(k, "ab") for k in range(4)] + [(9, "cd cd cd cd"), (10, "cd"), (11, "cd")], "id int, t string")
    got = {r["term"] for r in projection.term_weights(df, "id", F.col("t"), max_terms=4).collect()}
    assert got == {" cd", " cd ", "cd ", " ab"}


def test_gram_counts_match_brute_force():
    texts = ["a bb  cçc\tdéjà-vu 😀x", "", " \n ", "bb bb\x00b\x0bB\u00a0x", "x" * 300, "aa aa aaa"]
    text, x, times, chars, size = projection._gram_counts(texts)
    got = {(int(t), "".join(map(chr, c[:n]))): int(k) for t, c, n, k in zip(text, chars, size, times)}
    want = {}
    for t, words in enumerate(texts):
        for w in words.encode().split():
            w = f" {w.decode()} "
            for n in (3, 4, 5):
                for i in range(len(w) - n + 1):
                    want[t, w[i : i + n]] = want.get((t, w[i : i + n]), 0) + 1
    assert got == want and len(set(x.tolist())) == len({g for _, g in want})


def test_term_rows_of_repeated_ids(spark):
    rows = [(k % 40, "ab cd " * (k % 3) + f"w{k % 5}") for k in range(60)]
    joined = {}
    for k, t in rows:
        joined[k] = f"{joined.get(k, '')} {t}"
    kinds = []
    for df in (spark.createDataFrame(rows, "id int, t string"), spark.createDataFrame([*joined.items()], "id int, t string")):
        out, terms = projection.term_rows(df, "id", F.col("t"))
        kinds.append((terms, {r["id"]: (r["ks"], [round(w, 9) for w in r["ws"]]) for r in out.collect()}))
    assert kinds[0] == kinds[1] and len(kinds[0][1]) == 40
    assert all(ks == sorted(ks) and abs(sum(w * w for w in ws) - 1) < 1e-6 for ks, ws in kinds[0][1].values())


def test_svd_of_rows_sends_packed_cells_in_parts(spark, monkeypatch):
    monkeypatch.setattr(projection, "PART_CELLS", 3)
    rng = np.random.default_rng(8)
    a = np.where(rng.random((30, 12)) < 0.4, rng.random((30, 12)), 0)
    a[:, 0] = 1
    rows = [(k, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for k, r in enumerate(a)]
    out, values = projection.svd_of_rows(spark.createDataFrame(rows, "id int, ks array<int>, ws array<double>"), 12, dims=4)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False)[:4], rtol=1e-6) and out.count() == 30


def test_svd_of_texts_reads_packed_counts_in_dense_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    texts = [*enumerate(" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)), (3, "beta"), (70, "kappa " * 300), (71, ""), (72, None), (None, "beta")]
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    rows, terms = projection.term_rows(df, "id", F.col("t"), min_df=2)
    want, singular = projection.svd_of_rows(rows, len(terms), dims=5)
    want, made = {r["id"]: r["fingerprint"] for r in want.collect()}, []
    for name, most in (("PART_CELLS", 90), ("BLOCK_CELLS", 300), ("BLOCK_TERMS", 7), ("ORDER_BYTES", 200)):
        monkeypatch.setattr(projection, name, most)
    written = projection.written
    monkeypatch.setattr(projection, "written", lambda *a, **b: made.append(written(*a, **b)) or made[-1])
    out, values = projection.svd_of_texts(df, "id", F.col("t"), min_df=2, dims=5)
    got = {r["id"]: r["fingerprint"] for r in out.collect()}
    assert np.allclose(values, singular) and sorted(got) == sorted(want) == [*range(60), 70]
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    size = {r["id"]: len(r["cells"]) for r in made[0].collect()}
    n = {r["id"]: len(r["ks"]) for r in rows.collect()}
    assert all(size[k] == (3 if k < 70 else 4) * n[k] + 1 for k in n)


# second-level models

TARGETS = ("a", "b", "c")


def _logistic(x, y, c):
    x = np.column_stack([x, np.ones(len(x))])
    penalty, w = np.append(np.ones(x.shape[1] - 1), 0), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(c * x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), c * x.T @ (p - y) + penalty * w)
    return w


def test_neighbour_prior_matches_numpy(spark):
    rng = np.random.default_rng(2)
    z, folds = rng.normal(size=(200, 3)), np.arange(200) % 3
    y = np.where(rng.random((200, 3)) < 1 / (1 + np.exp(-(z[:, [1, 2, 0]] * 2))), 1.0, 0.0)
    y[rng.random((200, 3)) < 0.1] = 0.5
    y[rng.random((200, 3)) < 0.1] = np.nan
    rows = [(k, int(folds[k]), t, None if np.isnan(y[k, j]) else float(y[k, j]), float(z[k, j])) for k in range(200) for j, t in enumerate(TARGETS)]
    df = spark.createDataFrame(rows, "study int, fold int, target string, y double, z double")
    for neighbours in (None, {"a": ["b"], "b": ["a", "c"], "c": ["a"]}):
        got = {(r["study"], r["target"]): (r["prior"], r["z"]) for r in stacking.neighbour_prior(df, TARGETS, neighbours, alpha=0.2).collect()}
        for j, t in enumerate(TARGETS):
            links = [TARGETS.index(x) for x in (neighbours[t] if neighbours else [x for x in TARGETS if x != t])]
            for f in range(3):
                train = (folds != f) & ~np.isnan(y[:, j]) & (y[:, j] != 0.5)
                w = _logistic(z[train][:, links], (y[train, j] >= 0.5).astype(float), 0.1)
                eta = z[folds == f][:, links] @ w[:-1] + w[-1]
                prior = (eta - eta.mean()) / (eta.std() + 1e-6)
                assert np.allclose([got[k, t][0] for k in np.flatnonzero(folds == f)], prior, atol=1e-6)
                assert np.allclose([got[k, t][1] for k in np.flatnonzero(folds == f)], 0.8 * z[folds == f, j] + 0.2 * prior, atol=1e-6)


def test_neighbour_prior_of_one_class(spark):
    rows = [(k, k % 2, t, 1.0, float(k)) for k in range(6) for t in TARGETS]
    out = stacking.neighbour_prior(spark.createDataFrame(rows, "study int, fold int, target string, y double, z double"), TARGETS).collect()
    assert len(out) == 18 and all(r["prior"] == 0 for r in out)


def test_gated_model_protects_and_moves(spark):
    features = spark.createDataFrame([(s, f, float(s * (1 if f == "x" else -1))) for s in range(1, 5) for f in ("x", "y")], "study int, feature string, value double")
    model = spark.createDataFrame([("a", "x", 1.0, 2.0, 0.5), ("a", "y", 0.0, 1e-9, 1.0), ("b", "x", 0.0, 0.0, 1.0)], "target string, feature string, mean double, scale double, coef double")
    scores = stacking.linear_scores(features, model, {"a": 0.25})
    got = {(r["study"], r["target"]): r["score"] for r in scores.collect()}
    assert got[3, "a"] == pytest.approx((3 - 1) / 2 * 0.5 - 3 + 0.25) and got[3, "b"] == pytest.approx(3.0)
    base = spark.createDataFrame([(s, t, s / 10) for s in range(1, 5) for t in ("a", "b")], "study int, target string, p double")
    p = {(r["study"], r["target"]): r["p"] for r in stacking.gated(base, scores, {"a": 0.75}).collect()}
    assert [p[s, "b"] for s in range(1, 5)] == [0.25, 0.5, 0.75, 1.0] and [p[s, "a"] for s in range(1, 5)] == [1.0, 0.75, 0.5, 0.25]


# searches


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(11)
    rows = []
    for t, skill in (("a", (1.5, 0.5)), ("b", (0.2, 1.2)), ("c", (1.0, 1.0))):
        y = rng.integers(0, 2, 400)
        s = [1 / (1 + np.exp(-(k * (2 * y - 1) + rng.normal(size=400)))) for k in skill]
        rows += [(i, t, float(y[i]), float(s[0][i]), float(s[1][i])) for i in range(400)]
    rows += [(1000, "a", None, 0.1, 0.2), (1001, "a", 0.5, 0.1, 0.2), (1002, "a", 1.0, None, 0.2), (1003, "d", 1.0, 0.5, 0.5)]
    return spark.createDataFrame(rows, "study int, target string, y double, m1 double, m2 double"), rows


def _auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()


def _of(rows, t):
    return np.array([r[2:] for r in rows if r[1] == t and r[2] in (0.0, 1.0) and r[3] is not None], float).T


def test_simplex_is_no_worse_than_a_grid(members):
    df, rows = members
    weights, value, jobs = search.fit_simplex(df, ["m1", "m2"], steps=15)
    macro = lambda w: np.mean([_auc(y, np.round(w * a + (1 - w) * b, 9)) for y, a, b in (_of(rows, t) for t in "abc")])
    assert sum(weights.values()) == pytest.approx(1) and jobs <= 16
    assert value == pytest.approx(macro(weights["m1"]), abs=1e-9) and value >= max(macro(w) for w in np.linspace(0, 1, 11)) - 1e-3


def test_simplex_on_a_smooth_function():
    peak = np.array([0.3, 0.8, 0.55])
    point, value, _ = search.nelder_mead(lambda xs: np.array([-((x - peak) ** 2).sum() for x in xs]), np.full(3, 1 / 3), steps=200, tol=1e-10)
    assert np.allclose(point, peak, atol=1e-3) and value == pytest.approx(0, abs=1e-6)


def test_bounded_search_meets_a_fine_grid(members):
    df, rows = members
    got = {r["target"]: (r["w"], r["value"]) for r in search.bounded_weights(df, "m1", "m2").collect()}
    areas = {r["target"]: (r["w"], r["value"]) for r in search.bounded_weights(df, "m1", "m2", objective="auc", tol=1e-2).collect()}
    assert set(got) == {"a", "b", "c", "d"} and set(areas) == {"a", "b", "c"}
    for t in "abc":
        y, a, b = _of(rows, t)
        loss = lambda w: -np.mean(np.where(y == 1, np.log(np.clip(np.round((1 - w) * a + w * b, 9), 1e-7, 1)), np.log(np.clip(1 - np.round((1 - w) * a + w * b, 9), 1e-7, 1))))
        assert got[t][1] <= min(loss(w) for w in np.linspace(0, 1, 2001)) + 1e-7 and got[t][1] == pytest.approx(loss(got[t][0]), abs=1e-6)
        assert areas[t][1] >= max(_auc(y, np.round((1 - w) * a + w * b, 9)) for w in np.linspace(0, 1, 9)) - 1e-9


# images


def test_window_by_band_and_percentiles(spark):
    df = spark.createDataFrame([([750, 1000, 1250],), (None,), ([],)], "v array<int>")
    assert [r[0] for r in df.select(images.window(F.col("v"), 1000, 500)).collect()] == [[0, 127, 255], None, []]
    v = np.random.default_rng(1).integers(0, 4000, 200)
    a, b = np.percentile(v, 1), np.percentile(v, 99)
    got = spark.createDataFrame([(v.tolist(),)], "v array<int>").select(images.window(F.col("v"))).first()[0]
    assert np.abs(np.array(got) - (np.clip(v, a, b) - a) / (b - a) * 255).max() < 1.0001
    assert spark.createDataFrame([([5, 5, 5],)], "v array<int>").select(images.window(F.col("v"))).first()[0] == [0, 0, 0]


@pytest.mark.parametrize("margin", images.MARGINS)
def test_crop_matches_slicing(spark, margin):
    rng, rows = np.random.default_rng(margin), []
    for k in range(12):
        image = np.zeros((24, 30), int)
        for _ in range(k % 4):
            image[rng.integers(0, 24), rng.integers(0, 30)] = rng.integers(5, 200)
        rows.append((k, image.ravel().tolist(), 30))
    bad = [(100, None, 30), (101, [], 30), (102, [1, 2, 3], 2), (103, [1, 2], 0), (104, [1, 2], None)]
    got = {r["k"]: r for r in images.crop(spark.createDataFrame(rows + bad, "k int, p array<int>, w int"), "p", "w", 10, margin).collect()}
    for k, p, w in rows:
        image = np.array(p).reshape(-1, w)
        y, x = np.nonzero(image > 10)
        if len(y):
            image = image[max(0, y.min() - margin) : y.max() + margin + 1, max(0, x.min() - margin) : x.max() + margin + 1]
        b = got[k]["cropped_box"]
        assert got[k]["cropped"] == image.ravel().tolist() and (b["bottom"] - b["top"], b["right"] - b["left"]) == image.shape
    assert all(got[k]["cropped"] is None and got[k]["cropped_box"] is None for k, *_ in bad)


def flood(mask):
    names, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not names[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not names[a, b]:
                    names[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return names


@pytest.mark.parametrize("share", [0.2, 0.5, 0.7])
def test_regions_match_flood_fill(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(20):
        mask = rng.random((17, 23)) < share
        assert (images.regions(mask) == flood(mask)).all()


def test_scrub_removes_marks_only(spark):
    image = np.zeros((40, 40), int)
    image[10:30, 10:30] = 100  # the body
    image[15:18, 15:18] = 0
    image[16, 16] = 90  # a region inside it
    image[2, 2:8] = 200  # a mark in a corner
    image[35, 20] = 50
    want = image.copy()
    want[2, 2:8] = want[35, 20] = 0
    df = spark.createDataFrame([(1, image.ravel().tolist(), 40), (2, [0] * 16, 4), (3, None, 4), (4, [1, 2, 3], 2)], "k int, p array<int>, w int")
    got = {r["k"]: tuple(r)[1:] for r in images.scrub(df, "k", "p", "w").collect()}
    assert got[1] == (want.ravel().tolist(), 4, 7, hashlib.sha256(want.astype(np.uint8).tobytes()).hexdigest())
    assert got[2][1:3] == (0, 0) and got[3] == (None, 0, 0, None) and got[4] == (None, 0, 0, None)


# archives of arrays


def test_arrays_survive_and_damage_is_reported(spark, tmp_path):
    rows = [(1, [1, 2, 3], [[1.5, 2.5], [3.5, 4.5]]), (2, [], None), (3, None, [[0.0]])]
    packed = arrays.pack_arrays(spark.createDataFrame(rows, "k bigint, a array<bigint>, m array<array<double>>"), "k", {"a": "int32", "m": "float32"})
    manifest = arrays.write_artifacts(packed, "k", "content", ".npz")
    got = {(r["path"], r["member"]): (r["dtype"], r["shape"], r["values"]) for r in arrays.scan_manifest(manifest).collect()}
    assert got == {("1", "a"): ("int32", [3], [1, 2, 3]), ("1", "m"): ("float32", [2, 2], [1.5, 2.5, 3.5, 4.5]), ("2", "a"): ("int32", [0], []), ("3", "m"): ("float32", [1, 1], [0.0])}
    assert manifest.filter("bytes <= 0").count() == 0

    np.savez_compressed(tmp_path / "good.npz", x=np.arange(6, dtype=np.uint8).reshape(2, 3), b=np.array([True, False]))
    (tmp_path / "none.npz").write_bytes(b"")
    data = (tmp_path / "good.npz").read_bytes()
    (tmp_path / "cut.npz").write_bytes(data[: len(data) // 2])
    np.savez(tmp_path / "pickled.npz", o=np.array([{}], object))
    with zipfile.ZipFile(tmp_path / "other.npz", "w") as z:
        z.writestr("t.txt", "no array")
        member = io.BytesIO()
        np.save(member, np.arange(1000))
        z.writestr("short.npy", member.getvalue()[:500])
    (tmp_path / "skipped.txt").write_text("x")
    rows = arrays.scan_arrays(spark, str(tmp_path)).collect()
    found = {(r["path"].rpartition("/")[2], r["member"]): r for r in rows}
    assert found["good.npz", "x"]["shape"] == [2, 3] and found["good.npz", "x"]["values"] == [0, 1, 2, 3, 4, 5] and found["good.npz", "b"]["dtype"] == "bool"
    # Spark's listing leaves out files without a byte
    assert {k for k, r in found.items() if r["problem"]} == {("cut.npz", None), ("pickled.npz", "o"), ("other.npz", "t.txt"), ("other.npz", "short")}
    assert len(rows) == 6
