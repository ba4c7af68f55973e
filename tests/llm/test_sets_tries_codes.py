"""The exact set join, the prefix trie and the vector codes against brute force, and their small cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import prefix_trie, set_relations, vector_codes
from tests.llm.test_cases import EDGES, brute_components, docs

# 11


@pytest.mark.parametrize("width, threshold, seed", [(2, 85, 1), (4, 85, 2), (4, 70, 3)])
def test_similar_sets_match_brute_force(spark, width, threshold, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for base in range(6):
        words = [rng.choice(vocab) for _ in range(120)]
        for _ in range((5, 90, 40, 3, 60, 1)[base]):
            copy = list(words)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, " ".join(copy[rng.randint(0, 5) :]), "s"))
            n += 1
    shared = [rng.choice(vocab) for _ in range(80)]
    for k in range(80):  # a common passage that is most of the text, alike and not
        rows.append((n, " ".join(shared + [rng.choice(vocab) for _ in range(k % 30)]), "s"))
        n += 1
    rows += [(n + k, t, "s") for k, t in enumerate(["", None, "w1", "w1", "W1 w2", "w1 w2", "a b c d e f g h i j", "a b c d e f g h i", "a b c d e f g h i j k"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_relations.similar_sets(docs(spark, rows), width=width, threshold=threshold).collect()}
    want = brute_components([(i, t and t.lower(), s) for i, t, s in rows], width, threshold)
    assert {i: c for i, (_, c) in got.items()} == want


def test_heads_share_what_is_asked():
    """The bounds on heads over all sizes and overlaps of small similar sets."""
    for t in (50, 80, 85, 99):
        sizes = np.arange(1, 80)
        q, least = set_relations.head_size(sizes, t)
        for n_x in sizes:
            for n_y in range(n_x, 80):
                o = -(-t * (n_x + n_y) // (100 + t))
                if o > n_x:
                    continue
                # the fewest that heads can share: all differences of one set come first in the order of hashes
                fewest = min(q[n_x - 1] - (n_x - o), q[n_y - 1] - (n_y - o), o)
                asked = max(1, o - max(n_x - q[n_x - 1], n_y - q[n_y - 1]))
                assert asked <= max(1, fewest) and fewest >= 1
                assert least[n_x - 1] <= max(1, fewest) and least[n_y - 1] <= max(1, fewest)


def test_similar_sets_edges(spark):
    d = docs(spark, EDGES)
    out = set_relations.similar_sets(d)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=repr)
    # 60,000 times "word" and one long word are two shingles
    want = [(1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (None, 0, None), (5, 0, 5), (6, 1, 6)]
    assert got == sorted(want, key=repr)
    assert set_relations.similar_sets(d.filter("false")).collect() == []


# 12

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, node binary, depth int, n bigint, words bigint"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, b"x", 9, 9, 9) for r in rows], CONVERSATIONS)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, role or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].split()) if p else 0
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    }


def _trie(df):
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in prefix_trie.prefix_trie(df).collect()}


@pytest.mark.parametrize("often", [prefix_trie.OFTEN, 1])
def test_trie_matches_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(prefix_trie, "OFTEN", often)
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    rng = random.Random(4)
    starts = [[("user", f"hello {k} " + "w " * k)] for k in range(3)]
    rows = []
    for c in [*range(-45, 130), 10**12, 2**53 + 1]:
        if c % 7 == 3:
            continue
        turns = rng.choice(starts) + [(rng.choice(["user", "assistant"]), f"say {rng.randrange(2)}") for _ in range(rng.choice([0, 1, 2, 5]))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(500, k, "user", "long one") for k in range(600)] + [(501, k, "user", "long one") for k in range(599)]
    rng.shuffle(rows)
    assert _trie(conversations(spark, rows)) == brute_trie(rows)


def test_trie_edges(spark):
    rows = [
        (40, 1, "user", "a"), (40, None, "system", None), (40, 2, None, "b c"), (41, 0, "user", ""), (41, 0, "user", ""), (-7, 0, "user", "x"), (None, 0, "user", "lost"),
        (None, None, None, None), (60, 5, "user", "word " * 50_000), (61, 5, "user", "word " * 50_000), (81, 0, "user", "only turn"), (82, 0, "user", "only turn"), (83, 0, "user", "only turn"),
    ]
    got = _trie(conversations(spark, rows))
    assert got == brute_trie(rows)
    assert any(d == 0 and g[1] == len({r[0] for r in rows} - {None}) for (_, d), g in got.items())
    assert prefix_trie.prefix_trie(conversations(spark, rows).filter("false")).collect() == []
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).collect() == []


def test_trie_of_very_many_copies(spark):
    rows = spark.range(4000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 20 == 0, "base").otherwise("same words here").alias("text"))
    local = [tuple(r) for r in rows.collect()]
    assert _trie(rows) == brute_trie(local)


# 13

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error bigint, v int, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, 2, "i") for i, v, lab in rows], VECTORS)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64).reshape(parts, -1)) for i, v, _ in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.stack([v for _, v in kept])
    books = x[: min(entries, sum(i is not None for i, _ in kept))].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
    code, d = nearest()
    return sorted(((i, bytes(c.astype(np.uint8).tolist()), int(e)) for (i, _), c, e in zip(kept, code, d.sum(axis=1))), key=repr), books


@pytest.mark.parametrize("seed, spread, n", [(1, 1.0, 700), (2, 0.004, 500), (3, 1000.0, 300), (4, 1.0, 20)])
def test_codes_match_brute_force(spark, seed, spread, n):
    """Also with few distinct values, where most distances are equal."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=32) * spread).astype(np.float32).tolist(), int(i % 3)) for i in rng.permutation(n)]
    rows += rows[:5] + [(None, rows[0][1], None)]
    coded, books = vector_codes.compress_vectors(vectors(spark, rows))
    want, want_books = brute_codes(rows)
    assert (books == want_books).all()
    assert sorted(((r["id"], bytes(r["code"]), r["error"]) for r in coded.collect()), key=repr) == want


def test_bounds_skip_and_lose_nothing():
    rng = np.random.default_rng(8)
    centres = rng.integers(-2000, 2000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))
    book = centres + rng.integers(-20, 20, (64, 4))
    group = vector_codes.entry_groups(book[None])[0]
    code, upper, lower = vector_codes.assign_all(x, book, group, int(group.max()) + 1)
    for _ in range(4):
        new = book + rng.integers(-15, 15, book.shape)
        drift = np.sqrt(((new - book) ** 2).sum(axis=1))
        code, upper, lower, scanned = vector_codes.assign_again(x, new, group, drift, code, upper, lower)
        d = vector_codes.squared(x, new)
        assert (code == d.argmin(axis=1)).all() and scanned < 0.5 * d.size
        root = np.sqrt(d)
        assert (upper.astype(float) >= root[np.arange(len(x)), code]).all()
        root[np.arange(len(x)), code] = np.inf
        assert all((lower[:, g].astype(float) <= root[:, group == g].min(axis=1)).all() for g in range(int(group.max()) + 1))
        book = new


@pytest.mark.parametrize("labels", [vector_codes.LABELS, 0])
def test_codes_edges(spark, tmp_path, monkeypatch, labels):
    monkeypatch.setattr(vector_codes, "LABELS", labels)
    good = [0.5] * 16
    rows = [
        (5, None, 1), (6, [*good[:-1], None], 1), (7, [*good[:-1], float("nan")], 1), (8, [*good[:-1], float("inf")], 1), (1, good, 1), (2, [0.25] * 16, None), (2, [0.25] * 16, None),
        (None, [0.5] * 16, 1), (3, [1.0] * 15, 1), (4, [], 2), (9, [-3e38, *good[1:]], 3),
    ]
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=repr)
    assert [g[0] for g in got] == [1, 2, 2, 3, 4, 9, None] and [g[1] for g in got[3:5]] == [None, None]
    assert got[0] == (1, "00" * 16, 0, 0) and got[1] == (2, "01" * 16, 0, 0) and got[3] == (3, None, None, 0) and got[4] == (4, None, None, None)
    assert got[5][2] == 0 and got[6][1] == "00" * 16
    for name, some in (("none", []), ("bad", rows[:4])):
        vectors(spark, some).write.parquet(str(tmp_path / name / "embeddings.parquet")) if some else vectors(spark, rows).filter("false").write.parquet(str(tmp_path / name / "embeddings.parquet"))
        assert vector_codes.op13_vector_codes(spark, str(tmp_path / name)).collect() == []
