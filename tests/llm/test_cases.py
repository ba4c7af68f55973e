"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import io
import itertools
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnmill.llm import arc_convert as arc
from tarnmill.llm import chat_format, licence_scan, line_dedup, line_quality, mixing, near_dedup, phrase_index, pii_bootstrap, secret_scan, set_relations
from tarnmill.llm import textbytes as tb
from tarnmill.llm.automaton import Automaton
from tarnmill.llm.graph import connected_components

SCHEMA = "doc_id bigint, text string, source string, n_words int, kept string, pos int, hash string, line string, key string"
LONG = "word " * 60_000 + "x" * 100_000


def docs(spark, rows):
    """Documents with extra columns whose names clash with those that operators use or make."""
    return spark.createDataFrame([(i, t, s, 1, "k", 2, "h", "l", "y") for i, t, s in rows], SCHEMA)


EDGES = [(1, None, "a"), (2, "", "a"), (3, LONG, None), (4, "one", "b"), (4, "one", "b"), (None, "no id here at all", "b"), (None, None, None), (5, "\n\n", "c"), (6, "Ünï cödé ÀÉ", "c")]

OPERATORS = {
    "mix": lambda d: mixing.mix_sources(d, target_entropy=0.9),
    "near": lambda d: near_dedup.near_duplicates(d),
    "licence": lambda d: licence_scan.scan_licences(d),
    "pii": lambda d: pii_bootstrap.extract_pii(d),
    "quality": lambda d: line_quality.clean_lines(d),
    "secrets": lambda d: secret_scan.scan_secrets(d),
    "lines": lambda d: line_dedup.drop_shared_lines(d),
    "phrases": lambda d: phrase_index.contamination(d, d.sparkSession.createDataFrame([(1, "one"), (None, None), (2, "")], "item_id int, text string")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges_and_empty(spark, name):
    d = docs(spark, EDGES)
    out = OPERATORS[name](d)
    assert out.count() >= (len(EDGES) - 1 if name == "mix" else len(EDGES))
    empty = OPERATORS[name](d.filter("false"))
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, sf_dir, name, stage):
    d = docs(spark, EDGES).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"))
    out = stage(spark, d, sf_dir)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in out.collect()), key=repr)
    every = sorted(((i, (t or "")[:20]) for i, t, _ in EDGES), key=repr)
    if name == "quality rules":  # too short, or the same word over and over
        assert got == []
    elif name == "near dedup":  # the repeated row goes
        assert got == sorted(set(every), key=repr)
    elif name == "mixing":  # each at least once
        assert set(got) == set(every) and len(got) >= len(every)
    else:
        assert got == every
    assert stage(spark, d.filter("false"), sf_dir).collect() == []


def test_decontamination_finds_short_items(spark, tmp_path):
    items = [(k, " ".join(f"item{k}x{j}" for j in range(k))) for k in range(1, 13)]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"Some words first. {t} And after.", "s") for k, t in items]
    rows += [(100 + k, f"Some words first. {t[:-1]} And after.", "s") for k, t in items if k < 11] + [(200, "nothing here", "s")]
    d = docs(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"))
    out = corpus_pipeline.decontaminate(spark, d, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(101, 111), 200]


# 1


def test_bisection_meets_its_targets(spark):
    s = spark.createDataFrame([("a", 9000, 9), ("b", 900, 9), ("c", 100, 9)], "source string, tokens bigint, n_docs bigint")
    share = np.array([9000, 900, 100]) / 10000
    a = mixing.bisect_exponent(s, 0.9, None)
    w = share**a / (share**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * np.log(3), abs=1e-6)
    b = mixing.bisect_exponent(s, None, 3.0)
    assert (share[2] / share[0]) ** (b - 1) == pytest.approx(3.0, rel=1e-6)
    assert mixing.bisect_exponent(s, 0.9, 3.0) == max(a, b)
    assert mixing.bisect_exponent(s, 0.1, None) == 1.0


def test_mix_budgets_and_blocks(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 30), "big" if i % 10 else "small") for i in range(500)]
    out = mixing.mix_sources(docs(spark, rows), max_repetition=4.0, target_entropy=None, block_tokens=500).toPandas()
    assert set(out["id"]) == set(range(500))  # each document at least once
    tokens = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("big", "small")}
    got = out.groupby("source")["n_tokens"].sum()
    assert 0 <= got["small"] - 4 * tokens["small"] <= 30 and got["big"] == tokens["big"]
    assert not out.duplicated(["id", "epoch"]).any()
    for _, block in out.groupby("block"):
        assert sorted(block["pos"]) == list(range(len(block)))
    per = out.groupby(["block", "source"])["n_tokens"].sum().unstack(fill_value=0)
    assert (abs(per["small"] - per["small"].mean()) <= 62).all()  # each block has its share


def test_mix_with_a_small_budget(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)]
    out = mixing.mix_sources(docs(spark, rows), max_repetition=1.0, budget_tokens=305).toPandas()
    assert out["n_tokens"].sum() == 310 and out["id"].is_unique


# 2


def test_arc_both_versions_and_problems():
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: 7\r\n\r\n<p>hi</p>"
    for version in (1, 2):
        data = arc.arc_version_block(version, "a.arc", "20080102030405")
        at = len(data)
        data += arc.arc_record(version, "http://x.org/", "10.0.0.1", "20080102030405", "text/html", "200", "a.arc", at, body)
        data += b"this is no header line\n" + arc.arc_record(version, "dns:x.org", "-", "20080102030405", "text/dns", "200", "a.arc", 0, b"x 1")
        data += arc.arc_record(version, "http://cut.org/", "10.0.0.1", "20080102030405", "text/html", "200", "a.arc", 0, b"y" * 50)[:-20]
        read = list(arc.read_arc(io.BytesIO(data)))
        assert [v for v, _ in read] == [version] * 5
        assert [r.problem for _, r in read] == [None, None, "not a header line", None, "shorter than its declared length"]
        assert read[1][1].content == body and read[1][1].offset == at
        warc = b"".join(arc.arc_to_warc(v, r, "a.arc") for v, r in read if r.problem is None)
        heads, blocks = zip(*arc.read_warc(io.BytesIO(warc)))
        assert [h["warc-type"] for h in heads] == ["warcinfo", "response", "resource"]
        assert heads[1]["warc-date"] == "2008-01-02T03:04:05Z" and heads[1]["warc-ip-address"] == "10.0.0.1" and "warc-ip-address" not in heads[2]
        assert heads[1]["warc-payload-digest"] == "sha1:" + arc.sha1_base32(b"<p>hi</p>") and blocks[1] == body
        assert heads[1]["warc-record-id"] == arc.record_id("a.arc", at)


def _arc(records, version=1):
    """An archive of (url, date, content type, content, declared length or None)."""
    data = arc.arc_version_block(version, "a.arc", "20080102030405")
    for url, date, kind, body, length in records:
        line = arc.arc_record(version, url, "10.0.0.1", date, kind, "200", "a.arc", len(data), body)
        data += line if length is None else line.replace(f" {len(body)}\n".encode(), f" {length}\n".encode(), 1)
    return data


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("length", [99999, 40, 30, 5])
def test_arc_wrong_lengths_lose_no_later_record(version, length):
    rows = [(f"http://x{k}.org/", "20080102030405", "text/html", f"<p>content {k}</p>\nmore".encode(), length if k == 1 else None) for k in range(4)]
    read = [r for _, r in arc.read_arc(io.BytesIO(_arc(rows, version)))][1:]
    assert [r.fields["url"] for r in read] == [f"http://x{k}.org/" for k in range(4)]
    assert [bool(r.problem) for r in read] == [False, True, False, False]
    assert read[2].content == rows[2][3] and read[1].content.startswith(rows[1][3])


@pytest.mark.parametrize("version", [1, 2])
def test_arc_types_with_blanks_and_other_dates(version):
    rows = [("http://a/", "20080102030405", "text/html; charset=utf-8", b"a", None), ("http://b/", "200801020304", "text/html", b"b", None), ("http://c/", "2008", "no-type", b"c", None), ("http://d/", "20080102030405123", "text/plain", b"d", None)]
    read = [r for _, r in arc.read_arc(io.BytesIO(_arc(rows, version)))][1:]
    assert [(r.fields["content_type"], r.content, r.problem) for r in read] == [(k, c, None) for _, _, k, c, _ in rows]
    assert [arc.warc_date(r.fields["date"]) for r in read] == ["2008-01-02T03:04:05Z", "2008-01-02T03:04:00Z", "2008-01-01T00:00:00Z", "2008-01-02T03:04:05Z"]


def test_refused_records_are_counted(spark, tmp_path):
    data = _arc([("http://a/", "20080102030405", "text/html", b"same", None), ("http://b/", "20080102030405", "text/html", b"cut", 99999), ("http://c/", "20080102030405", "text/html", b"same", None)])
    path = str(tmp_path / "a.arc.gz")
    with arc.gzip.open(path, "wb") as f:
        f.write(data)
    manifest = spark.createDataFrame([(path, 4)], "path string, records bigint")
    out = arc.convert_arcs(manifest)
    assert [(r["records"], r["refused"]) for r in out.collect()] == [(3, 1)]
    assert sorted((r["uri"], r["record_type"]) for r in arc.read_warcs(out).collect()) == [("http://a/", "resource"), ("http://c/", "revisit")]
    assert [r["url"] for r in arc.index_arcs(manifest).filter("problem IS NOT NULL").collect()] == ["http://b/"]


def test_pages_edges(spark, tmp_path):
    html = LONG * 20
    rows = [(1, "u", html, "page", "digest"), (2, "u", html, "page", "digest")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, page string, digest string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in arc.op2_arc_convert(spark, str(tmp_path)).collect()}
    digest = arc.sha1_base32(html.encode())
    assert got == {1: (len(html), digest, "response", None), 2: (len(html), digest, "revisit", 1)}
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "empty" / "pages.parquet"))
    empty = arc.op2_arc_convert(spark, str(tmp_path / "empty"))
    assert empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and empty.count() == 0


def test_pages_with_equal_payloads(spark, tmp_path):
    rows = [(5, "http://a b/", "same"), (2, None, "same"), (9, "u", "same"), (9, "u", "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (8, "u", "é\r\n\r\nWARC/1.1")]
    rows += [(20, "filedesc://b.arc", "block"), (21, "filedesc://b.arc", "block"), (22, "WARC/1.0", "x"), (23, "filedesc:", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in arc.op2_arc_convert(spark, str(tmp_path)).collect()), key=repr)
    want = [(5, 4, "revisit", 2), (2, 4, "response", None), (9, 4, "revisit", 2), (9, 4, "revisit", 2), (3, 0, "response", None), (4, 0, "revisit", 3), (None, 4, "revisit", 2), (8, 14, "response", None)]
    want += [(20, 5, "response", None), (21, 5, "revisit", 20), (22, 1, "response", None), (23, 0, "revisit", 3)]
    assert got == sorted(want, key=repr)


# 3


def brute_components(rows, width, threshold):
    sets = {}
    for i, t, _ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets[i] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= threshold * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width, seed", [(2, 1), (5, 2)])
def test_near_duplicates_match_brute_force(spark, width, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for base in range(6):
        words = [rng.choice(vocab) for _ in range(120)]
        for _ in range((5, 90, 40, 3, 60, 1)[base]):  # some families have many members and many degrees of likeness
            copy = list(words)
            for _ in range(rng.randint(0, 10)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, " ".join(copy), "s"))
            n += 1
    shared = [rng.choice(vocab) for _ in range(60)]
    for _ in range(60):  # a common passage, but not alike
        rows.append((n, " ".join(shared + [rng.choice(vocab) for _ in range(40)]), "s"))
        n += 1
    rows += [(n + k, t, "s") for k, t in enumerate(["", None, "w1", "w1", "W1 w2", "w1 w2"])]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), width=width).collect()}
    assert got == {i: c for i, c in brute_components([(i, t and t.lower(), s) for i, t, s in rows], width, 80).items()}


def test_scan_patterns_are_verified():
    from tarnmill.llm.automaton import covers

    assert all(covers(r.scan, r.head, r.body, r.min_chars) for r in secret_scan.RULES)
    assert covers("b", "a?", "b+", 1) and covers("x{2}", "x*", "x+", 2)
    assert not covers("[0-9a-f]{25}", "", "[0-9a-f]+", 24) and not covers("ab", "a?", "b+", 1) and not covers("x{3}", "x*", "x+", 2)
    with pytest.raises(ValueError, match="rule mine"):
        secret_scan.compiled((secret_scan.SecretRule("mine", "key=[0-9]{4}", "key=", "[0-9]+", 3),))


def test_match_threshold():
    assert near_dedup.match_threshold(80, 64, 1) < 64 * 0.8 and near_dedup.match_threshold(80, 32, 2) < 32 * 0.64
    assert near_dedup.match_threshold(100) == near_dedup.COORDINATES


def test_members_that_share_too_little_are_not_posted(spark):
    """Of many unlike members of a family with a common passage, only the two that may be similar reach the join by element."""
    common = list(range(10))
    rows = [("k", n, n, 20, common + [1000 * n + j for j in range(15)]) for n in range(1, 41)]
    rows += [("k", 50, 50, 20, common + list(range(900, 915))), ("k", 51, 51, 20, common + list(range(902, 917))), ("k", 52, 52, 20, common), ("other", 1, 1, 1, [5])]
    asked = spark.createDataFrame(rows, "key string, node long, own long, o int, ds array<long>")
    assert sorted(r["node"] for r in near_dedup.sharing(asked).collect()) == [50, 51]


@pytest.mark.parametrize("words", [1 << 20, 4])
def test_differences_meet_without_a_join_by_element(spark, monkeypatch, words):
    """Elements are never joined to their counts, and also with a table of counts that is far too full each similar pair of
    different components shares a posting that its bound admits."""
    monkeypatch.setattr(near_dedup, "FILTER_WORDS", words)
    rng, t = random.Random(3), 80
    pool = [rng.getrandbits(63) - (1 << 62) for _ in range(60)]
    sets = {n: rng.sample(pool[:20] if n % 2 else pool, 8) + [rng.getrandbits(62) for _ in range(rng.randint(0, 6))] for n in range(1, 81)}
    rows = [(0, True, 7, n, n, 60 + n % 9, True, 0 if n % 3 else n, ds) for n, ds in sets.items()]
    members = spark.createDataFrame(rows, "hub long, centred boolean, centre long, node long, own long, n long, related boolean, label long, ds array<long>")
    found = near_dedup.difference_postings(members, spark.createDataFrame([(0, 0)], "node long, component long"), t)
    got = found.collect()
    assert not re.search(r"Join \[key#\d+L?, d#", found._jdf.queryExecution().executedPlan().toString())
    label, size = {r[3]: r[7] for r in rows}, {r[3]: r[5] for r in rows}
    s = {n: (100 + t) * len(ds) - (100 - t) * size[n] for n, ds in sets.items()}
    lists = {}
    for r in got:
        lists.setdefault((r["key"], r["d"]), []).append((r["node"], r["left"]))
    met = {(a, b) for found in lists.values() for a, i in found for b, j in found if a < b and 2 * (100 + t) * min(i, j) >= s[a] + s[b]}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if label[a] != label[b] and 2 * (100 + t) * len({*sets[a]} & {*sets[b]}) >= s[a] + s[b]}
    assert want and want <= met


@pytest.mark.parametrize("query", [near_dedup.near_duplicates, set_relations.similar_sets])
def test_whole_sets_are_counted_once(spark, monkeypatch, query):
    """Texts with several common passages are in families of several hubs; their whole sets are counted once and not by family."""
    rng, most, count = random.Random(5), [], near_dedup.sharing
    passages = [[f"p{k}x{j}" for j in range(30)] for k in range(4)]
    rows = [(n, " ".join(sum(rng.sample(passages, 2), []) + [f"n{n}w{j}" for j in range(rng.randint(5, 20))])) for n in range(150)]
    rows += [(1000 + n, t + " more") for n, t in rows[:30]]

    def spy(asked):
        most.append([r["k"] for r in asked.filter("NOT centred").groupBy("node", "own").agg(F.count(F.lit(1)).alias("k")).collect()])
        return count(asked)

    monkeypatch.setattr(near_dedup, "sharing", spy)
    got = {r["doc_id"]: r["component_id"] for r in query(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == brute_components([(i, t, "s") for i, t in rows], 2, 80)
    assert most[0] and set(most[0]) == {1}


def test_whole_sets_meet_within_their_families(spark):
    """Each similar pair of a family, of different labels and not both like the hub, shares a posting of the family that its
    bound admits, and no other family has one."""
    rng, t = random.Random(8), 80
    pool = [rng.getrandbits(63) - (1 << 62) for _ in range(120)]
    bases = [rng.sample(pool, 40) for _ in range(12)]
    sets = {n: sorted({*rng.sample(bases[n % 12], 37), *rng.sample(pool, 2), *(rng.getrandbits(62) for _ in range(n % 3))}) for n in range(1, 121)}
    label = {n: n if n % 4 else 4 * (n // 16) for n in sets}
    apart = sorted({(rng.randint(1001, 1008), n, label[n]) for n in sets for _ in range(4)})
    apart = [(*r, rng.random() < 0.4) for r in apart]
    low = {n: min(r[3] for r in apart if r[1] == n) for n in sets}
    whole = spark.createDataFrame([(n, n, len(ds), low[n], label[n], ds) for n, ds in sets.items()], "node long, own long, n long, related boolean, label long, ds array<long>")
    none = spark.createDataFrame([], "hub long, centre long, node long, own long, n long, related boolean, label long, ds array<long>")
    families = spark.createDataFrame(apart, "hub long, node long, label long, related boolean")
    lists = {}
    for r in near_dedup.difference_postings(none, spark.createDataFrame([], "node long, component long"), t, whole, families).collect():
        lists.setdefault((r["key"], r["d"]), []).append((r["node"], r["left"], r["s"], r["related"]))
    met = {(k, a, b) for (k, _), found in lists.items() for a, i, s, x in found for b, j, z, y in found if a < b and 2 * (100 + t) * min(i, j) >= s + z and not (x and y)}
    members = {}
    for hub, n, _, related in apart:
        members.setdefault(hub, {})[n] = related
    keys = {r["hub"]: r["key"] for r in families.select("hub", F.xxhash64("hub", F.lit(False)).alias("key")).distinct().collect()}
    inside = [(hub, a, b) for hub, m in members.items() for a, b in itertools.combinations(sorted(m), 2) if label[a] != label[b] and not (m[a] and m[b])]
    want = {(keys[hub], a, b) for hub, a, b in inside if 100 * len({*sets[a]} & {*sets[b]}) >= t * len({*sets[a]} | {*sets[b]})}
    assert want and want <= met
    assert {(k, n) for (k, _), found in lists.items() for n, *_ in found} <= {(keys[hub], n) for hub, m in members.items() for n in m}


def test_common_elements_come_rare_first(spark):
    rows = spark.createDataFrame([(1, 5, [10, 20, 30, 40]), (2, 5, [10, 40]), (3, 6, [])], "node long, key long, ds array<long>")
    groups = spark.createDataFrame([(5, 10, 9), (5, 30, 2), (5, 40, 4)], "key long, d long, df long")
    assert {r["node"]: r["ds"] for r in near_dedup.rare_first(rows, groups, 6).collect()} == {1: [30, 40, 10], 2: [40, 10], 3: []}


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


# 4


def test_licences(spark):
    from tarnmill.llm.licence_texts import TEMPLATES

    mit = TEMPLATES[0][1]
    rows = [(1, mit, "s"), (2, "Some words first.\n\n" + mit.replace("\n\n", " ") + "\n\nAnd after.", "s"), (3, "text\nReleased under the MIT licence.\nReleased under the MIT License.", "s"), (4, "nothing here", "s")]
    got = {r["doc_id"]: {(m["unit"], m["licence"]) for m in r["licences"]} for r in licence_scan.scan_licences(docs(spark, rows)).collect()}
    assert got[1] == {("text", "MIT")} and ("paragraph", "MIT") in got[2] and ("line", "MIT") in got[3] and got[4] == set()


_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


def _best_window(text, template):
    """Brute force over all runs of words within the size bound: the best Dice coefficient."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda t: list(zip(words(t), words(t)[1:]))
    g, t, best = grams(text), set(grams(template)), 0.0
    for a in range(len(g)):
        run = set()
        for b in range(a, min(len(g), a + len(grams(template)) * 120 // 80)):
            run.add(g[b])
            best = max(best, 2 * len(run & t) / (len(run) + len(t)))
    return best


def test_licences_inside_documents(spark):
    from tarnmill.llm.licence_texts import TEMPLATES

    templates = (*TEMPLATES, ("LGPL-2.1-or-later", _LGPL), ("AGPL-3.0-or-later", _AGPL))
    code = "def area(w, h):\n    return w * h\n\nprint(area(3, 4), 'Some more words of a program here')\n"
    wrap = lambda t: "\n".join("# " + line for p in t.split("\n") for line in textwrap.wrap(p, 60) or [""])
    rows = [(k, f"{code}\n{t}\n\n{code * 3}", "s") for k, (_, t) in enumerate(templates)] + [(100 + k, f"{wrap(t)}\n{code}", "s") for k, (_, t) in enumerate(templates)]
    line = "Copyright (c) 2024 Jane Doe. Released under the MIT License. See LICENSE for details."
    rows += [(200, line, "s"), (201, f"{code}{line}\n{code}", "s"), (202, f"This file is released under the MIT license by Jane Doe and others {code}", "s"), (203, code, "s")]
    got = {r["doc_id"]: r["licences"] for r in licence_scan.scan_licences(docs(spark, rows), templates=templates).collect()}
    for k, (name, _) in enumerate(templates):
        assert name in {m["licence"] for m in got[k]} and name in {m["licence"] for m in got[100 + k]}, name
    assert [(m["unit"], m["place"], m["licence"], m["shared"], m["total"]) for m in got[200] if m["shared"] * 2 == m["total"]] == [("window", 5, "MIT", 4, 8)]
    assert all({m["licence"] for m in got[k]} == {"MIT"} for k in (200, 201, 202)) and got[203] == []


def test_licence_windows_match_brute_force(spark):
    rng = random.Random(7)
    templates = [("A", "a b c d e f g h"), ("B", "b c b d a"), ("C", "c d")]
    rows = [(k, " ".join(rng.choice("abcdefghxy") if rng.random() < 0.4 else "abcdefgh"[j % 8] for j in range(rng.randint(2, 40))), "s") for k in range(300)]
    rows += [(300, "a b c d " + "x " * 100 + "e f g h", "s")]
    got = {r["doc_id"]: r["licences"] for r in licence_scan.scan_licences(docs(spark, rows), templates=templates).collect()}
    for k, text, _ in rows:
        for name, t in templates:
            best, found = _best_window(text, t), [2 * m["shared"] / m["total"] for m in got[k] if m["licence"] == name]
            whole = any(m["unit"] == "text" for m in got[k])
            assert whole or max(found, default=0) == (pytest.approx(best) if best >= 0.8 else 0), (text, name)


@pytest.mark.parametrize("k", [2, 28, 60])
def test_every_copy_of_a_licence_is_told(spark, k):
    """Copies with words between, in one paragraph and in many, beside a template that repeats itself."""
    from tarnmill.llm.licence_texts import TEMPLATES

    isc = next(t for name, t in TEMPLATES if name == "ISC")
    rows = [(1, " ".join(f"made word{j} {isc}" for j in range(k)), "s"), (2, "\n\n".join(f"made word{j} {isc}" for j in range(k)), "s"), (3, "ab cd " * 200 + isc, "s")]
    got = {r["doc_id"]: r["licences"] for r in licence_scan.scan_licences(docs(spark, rows)).collect()}
    size = len(isc.split())
    for i in (1, 2):
        starts = [m["place"] for m in got[i] if m["unit"] == "window" and m["licence"] == "ISC" and 2 * m["shared"] == m["total"]]
        assert len(starts) == k and all(b - a >= size for a, b in itertools.pairwise(starts))
    assert [(m["place"], m["shared"] * 2 == m["total"]) for m in got[3] if m["unit"] == "window" and m["licence"] == "ISC"] == [(400, True)]


# 5


def test_pii_patterns_find_unseen(spark):
    rows = [(k, f"please write to mail user{k}@site{k}.org today", "s") for k in range(8)] + [(100, "please write to mail user(at)9hidden today", "s"), (101, "room 12345 is free", "s")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in pii_bootstrap.extract_pii(docs(spark, rows)).collect()}
    assert got[100] == [("found_email", 21, 36, False)] and got[101] == []
    assert got[3] == [("email", 21, 36, True)]


def test_pii_found_identifiers_are_seeds(spark):
    """Identifiers found by a seeded pattern make a pattern without base seeds good, which finds another."""
    rows = [(k, f"please write to mail user{k}@site{k}.org today", "s") for k in range(20)]
    rows += [(100 + k, f"please write to mail member-{k}x today", "s") for k in range(6)]
    rows += [(200 + k, f"our ledger shows account member-{k}x as open", "s") for k in range(6)]
    rows += [(300, "our ledger shows account other-77 as open", "s"), (301, "room 12345 is free", "s")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii_bootstrap.extract_pii(docs(spark, rows)).collect()}
    assert got[103] == [("found_email", 21, 30)] and got[203] == [("found_email", 25, 34)]
    assert got[300] == [("found_email", 25, 33)] and got[301] == []


def plain_pii(texts, rounds=3, smoothing=2.0, min_confidence=0.6, min_seeds=3):
    """The whole extraction with dictionaries: base and found spans of each text."""
    said, kinds = [], {}
    for t in texts:
        base = pii_bootstrap.base_spans(t)
        context = pii_bootstrap.Context(t)
        said.append([(k, a, b, t[a:b].lower(), context.patterns_of(a, b)) for k, a, b in [*base, *((None, a, b) for a, b in pii_bootstrap.candidates(t, base))]])
        for k, _, _, x, patterns in said[-1]:
            for p in patterns:
                known = kinds.setdefault(p, {}).get(x)
                kinds[p][x] = known if k is None else k if known is None else min(k, known)
    seeds = {(p, k): sum(v == k for v in xs.values()) for p, xs in kinds.items() for k in set(xs.values()) - {None}}
    scored = {(p, k): (n, n / (len(kinds[p]) + smoothing)) for (p, k), n in seeds.items()}
    good = lambda n, c: n >= min_seeds and c >= min_confidence
    for _ in range(rounds - 1):
        left, best = {}, {}
        for (p, k), (n, c) in scored.items():
            for x in (x for x, v in kinds[p].items() if v is None):
                left[x, k] = left.get((x, k), 1.0) * (1 - min(c, 0.999))
                if good(n, c):
                    best[x] = max(best.get(x, (0, -9)), (c, -k))
        gained = {}
        for p, xs in kinds.items():
            for x in (x for x, v in xs.items() if v is None):
                for k in range(4):
                    if (x, k) in left:
                        n, g = gained.get((p, k), (0, 0.0))
                        taken = x in best and -best[x][1] == k
                        gained[p, k] = (n + taken, g + (float(taken) if x in best else 1 - left[x, k]))
        scored = {(p, k): (seeds.get((p, k), 0) + gained.get((p, k), (0, 0))[0], (seeds.get((p, k), 0) + gained.get((p, k), (0, 0))[1]) / (len(kinds[p]) + smoothing)) for p, k in {*seeds, *gained}}
    out = []
    for mentions in said:
        base, found = [(pii_bootstrap.KINDS[k], a, b) for k, a, b, _, _ in mentions if k is not None], []
        for k, a, b, _, patterns in mentions:
            fits = [(scored[p, j][1], -j) for p in patterns for j in range(4) if (p, j) in scored and good(*scored[p, j])]
            if k is None and fits:
                found.append((-max(fits)[1], a, b))
        out.append(base + [(f"found_{pii_bootstrap.KINDS[k]}", a, b) for k, a, b in sorted(found)])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_matches_plain_python(spark, seed):
    rng = random.Random(seed)
    made = [lambda: f"u{rng.randint(0, 30)}@s.org", lambda: f"10.0.0.{rng.randint(0, 40)}", lambda: f"+49 30 {rng.randint(1000000, 1000030)}", lambda: f"id-{rng.randint(0, 25)}z", lambda: f"{rng.randint(0, 60)}"]
    frames = ["mail {} now", "host {} is up", "call {} please", "see {} there", "mail {} please", "host {} now"]
    texts = [" ".join(rng.choice(frames).format(rng.choice(made[(k := rng.randrange(6)) % 3 : k % 3 + 3])()) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii_bootstrap.extract_pii(docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), min_confidence=0.3).collect()}
    want = plain_pii(texts, min_confidence=0.3)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(x[0].startswith("found_") for w in want for x in w) > 20


def test_pii_many_mentions_in_parts(spark, monkeypatch):
    texts = [f"host 10.0.0.{k} is up, see id-{k} there" * (k % 4) for k in range(60)]
    rows = docs(spark, [(k, t, "s") for k, t in enumerate(texts)])
    whole = sorted(pii_bootstrap.mentions(rows, "doc_id", "text").drop("row").collect())
    monkeypatch.setattr(pii_bootstrap, "MENTIONS", 5)
    assert sorted(pii_bootstrap.mentions(rows, "doc_id", "text").drop("row").collect()) == whole


def test_pii_candidates_are_grouped():
    found = lambda t, taken=(): [t[a:b] for a, b in pii_bootstrap.candidates(t, list(taken))]
    assert found("iban DE89 3704 0044 0532 0130 00, paid") == ["DE89 3704 0044 0532 0130 00"]
    assert found("ssn 123 45 6789 and pin 471") == ["123 45 6789", "471"]
    assert found("call (030) 12 34 56.\n77 88") == ["030) 12 34 56", "77 88"]
    assert found("in 2019, 12345 x@ 12 5@") == ["2019", "12345", "x@", "12", "5@"]
    assert found("id 12 34 56", [(0, 6, 8)]) == ["12", "56"]


def test_pii_context_is_words():
    text = "please write" + " " * 100 + "x" * 70 + " 12345" + " " * 100 + "today"
    a = text.index("12345")
    assert pii_bootstrap.Context(text).patterns_of(a, a + 5) == ["write " + "x" * 64 + " _", "x" * 64 + " _ today"]
    assert pii_bootstrap.Context("a:12345,b c").patterns_of(2, 7) == ["^ a _", "a _ b"]


def test_pii_base_fuzz():
    from tests.llm.test_queries import base_pii

    rng = random.Random(4)
    parts = ["1", "23", ".", "@", "a", "-", " ", "+", "(", ")", "é", "com", "4539578763621486", "256", "10.0.0.1", "\n", "_", "%"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [f"{pii_bootstrap.KINDS[k]}:{a}:{b}" for k, a, b in pii_bootstrap.base_spans(t)] == base_pii(t)


def test_pii_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "@" * 100_000):
        pii_bootstrap.base_spans(t)
        pii_bootstrap.candidates(t, [])


# 6


def test_quality_rules(spark):
    good = "\n".join(" ".join(f"w{k}x{j}" for j in range(10)) + "." for k in range(8))
    nav = "\n".join(["Home | News | Sport | Contact | About | Help"] * 9)
    rows = [(1, good, "s"), (2, nav, "s"), (3, good + "\nHome | News | Login", "s"), (4, "same three words " * 30, "s"), (5, None, "s")]
    got = {r["doc_id"]: r for r in line_quality.clean_lines(docs(spark, rows)).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == good
    assert not got[2]["kept"] and got[2]["n_dup_lines"] == 8
    assert got[3]["kept"] and got[3]["cleaned"] == good
    assert got[4]["base_failed"] and got[4]["n_repeat_words"] == 90
    assert got[5]["base_failed"] and got[5]["n_words"] == 0


# 7


def test_automaton_matches_regexes():
    rng = random.Random(3)
    a = Automaton([r.scan for r in secret_scan.RULES])
    parts = ["token", "=", " ", '"', "AKIA", "a" * 20, "0f3c", "é", ":", "SECRET", "abcdef", "Z9", "ghp_", "x", "api_key", "eyJ", ".", "-----BEGIN "]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["é" * 9000 + "token=abcdef", "q" * 9000]
    data = "".join(lines).encode()
    ends = np.cumsum([len(x.encode()) for x in lines])
    got = a.scan(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert got.tolist() == [any(re.search(r.scan, x) for r in secret_scan.RULES) for x in lines]


#: The contract's patterns, spelt out: (kind, pattern, group, least characters).
_BASE_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def test_secret_spans_match_brute_force():
    rng = random.Random(9)
    spans = secret_scan.compiled(secret_scan.RULES)[1]
    parts = ["token", "Secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "a" * 9, "0f3c9", "apikey", "API_KEY", "x", "passwd", "eyJ", "eyJa.eyJb." + "Z" * 32, "ghp_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "\r"]
    others = [(r.kind, r.head + r.body, 0, r.min_chars) for r in secret_scan.RULES if not r.base]
    seen = set()
    for _ in range(4000):
        line = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        data = line.encode()
        got = [(secret_scan.RULES[n].kind, len(data[:a].decode()), len(data[:b].decode())) for n, a, h, b in spans.find(data) if b - h >= secret_scan.RULES[n].min_chars]
        want = [(k, m.start(), m.end()) for k, p, g, least in (*_BASE_SECRETS, *others) for m in re.finditer(p, line) if m.end(g) - m.start(g) >= least]
        assert got == want, line
        hit = secret_scan.compiled(secret_scan.RULES)[0].scan(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)])) if data else [False]
        assert not want or hit[0]
        seen |= {k for k, _, _ in want}
    assert {"assign", "access", "hex", "jwt", "private_key"} <= seen


def test_secret_spans_are_linear():
    spans = secret_scan.compiled(secret_scan.RULES)[1]
    for t in (b"eyJ" * 100_000, b"token" * 50_000, b"0f" * 150_000, b"-----BEGIN " + b"A " * 100_000):
        spans.find(t)


def test_secret_spans(spark):
    rows = [(1, 'é secret=token:abcdefgh\npassword: "hunter22" ' + "0f" * 15, "s"), (2, "x" * 50_000 + " API_KEY=Zz09+/_.=- ghp_" + "Qz" * 18, "s")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan_secrets(docs(spark, rows)).collect()}
    assert got[1] == [("assign", 24, 43), ("hex", 45, 75)]
    assert got[2] == [("assign", 50_001, 50_019), ("github", 50_020, 50_060)]


# 8


def test_shared_lines(spark):
    shared = "  This Line is long enough to count as shared by all.\t"
    rows = [(k, f"own {k}\n{shared if k % 2 else shared.strip().upper()}\nend", "s") for k in range(6)] + [(6, "x\n" + shared + "\n" + shared, "s"), (7, None, "s")]
    got = {r["doc_id"]: r for r in line_dedup.drop_shared_lines(docs(spark, rows)).collect()}
    assert all(got[k]["text"] == f"own {k}\nend" and got[k]["n_dropped"] == 1 and got[k]["n_lines"] == 3 for k in range(6))
    assert got[6]["n_dropped"] == 0 and got[6]["text"].count("\n") == 2
    assert got[7]["n_lines"] == 1 and got[7]["text"] == ""


def test_four_documents_share_in_peace(spark):
    line = "A line of more than forty characters that four documents share."
    out = line_dedup.drop_shared_lines(docs(spark, [(k, line, "s") for k in (1, 2, 3, 4, 4)]))
    assert {r["n_dropped"] for r in out.collect()} == {0}


# 9


def test_phrases_exact_near_and_in_blocks(spark):
    words = [f"t{k}" for k in range(30)]
    rows = [(1, " ".join(["a", *words[3:13], "b"]), "s"), (2, " ".join([*words[:5], "odd", *words[5:10]]), "s"), (3, " ".join(words[:9]), "s"), (4, "Short, ITEM!", "s"), (5, None, "s")]
    items = spark.createDataFrame([(10, " ".join(words)), (11, "short item"), (12, "")], "item_id int, text string")
    for block in (1 << 25, 40):
        got = {r["doc_id"]: r for r in phrase_index.contamination(docs(spark, rows), items, block_bytes=block).collect()}
        assert got[1]["items"] == ["10"] and sorted(got[1]["hits"]) == list(range(1, 11)) and got[1]["n_words"] == 12
        assert got[2]["items"] == [] and got[2]["near"] == ["10"]
        assert got[3]["items"] == [] and got[4]["items"] == ["11"] and got[5]["n_words"] == 0


@pytest.mark.parametrize("slack", [0, 2])
def test_match_finds_all_places(slack):
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 6, 400)
    terms, counts = np.unique(tokens, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(counts)])
    grams = np.lib.stride_tricks.sliding_window_view(rng.integers(0, 7, 60), 4)
    ranks = np.where(grams < 6, grams, -1)
    got = [(int(w), int(s), bool(e)) for ws, ss, ex in phrase_index.match(starts, np.argsort(tokens, kind="stable"), ranks, slack, most=50) for w, s, e in zip(ws, ss, ex)]
    assert len(got) == len(set(got))
    near = lambda w, s: tokens[s] == grams[w][0] and all(x in tokens[max(0, s + j - slack) : s + j + slack + 1] for j, x in enumerate(grams[w]))
    exact = lambda w, s: s <= 396 and (tokens[s : s + 4] == grams[w]).all()
    assert set(got) == {(w, s, bool(exact(w, s))) for w in range(len(grams)) for s in range(400) if near(w, s)}


def plain_phrases(text, items, width, slack):
    """(hit positions, items with exact windows, items with near ones only) by looking everywhere."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    d, hits, exact, near = words(text), set(), set(), set()
    for name, t in items:
        q = words(t)
        size = min(width, len(q))
        for a in range(len(q) - size + 1 if size else 0):
            w = q[a : a + size]
            for s in range(len(d)):
                if d[s : s + size] == w:
                    hits |= set(range(s, s + size))
                    exact.add(str(name))
                elif d[s] == w[0] and all(x in d[max(0, s + j - slack) : s + j + slack + 1] for j, x in enumerate(w)):
                    near.add(str(name))
    return sorted(hits), sorted(exact), sorted(near - exact)


@pytest.mark.parametrize("parts", [1, 7])
def test_phrases_match_brute_force(spark, parts):
    """Documents that break off inside a window and go on in the next row are no match, however rows are dealt."""
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))) for k in range(12)]
    texts = []
    for _ in range(80):
        q = rng.choice(items)[1].split()
        cut, k = rng.randint(0, len(q)), rng.randrange(len(q) + 1)
        texts += [" ".join(rng.choice("abcdefg") for _ in range(3)) + " " + " ".join(q[:cut]), " ".join(q[cut:]) + " x y", " ".join(q[:k] + ["odd"] * rng.randint(0, 3) + q[k:])]
    df = docs(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartitionByRange(parts, "doc_id")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r["doc_id"]: (sorted(r["hits"]), r["items"], r["near"]) for r in phrase_index.contamination(df, bench, width=5, slack=2).collect()}
    assert got == {k: plain_phrases(t, items, 5, 2) for k, t in enumerate(texts)}
    assert sum(bool(x[2]) for x in got.values()) > 20


# 10


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be [kind] \\e <s>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\l \\\\ > [/INST]"), (2, 1, "assistant", "first"), (2, 1, "assistant", "first"),
        (3, 0, "tool>x", None), (3, 1, None, " spaced \n"), (4, None, "user", ""), (4, 0, "assistant", LONG),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in out.withColumn("back", chat_format.read_turns(F.col("formatted"))).collect()}
    for conv in (1, 2, 3, 4):
        want = [(r or "", t or "") for _, r, t in sorted(((k if k is not None else -1, r, t) for c, k, r, t in rows if c == conv), key=lambda x: x[0])]
        assert [(x["role"], x["text"]) for x in got[conv]["back"]] == want
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
    assert [got[k]["valid"] for k in (1, 2, 3, 4)] == [True, False, False, True]
    assert [s["text"] for s in got[2]["segments"] if s["loss"]] == ["first", "first"]


def test_template_must_escape_its_marks():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(marks={"user": ("{user} ", " [/INST]")})


# helpers


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é\n\t.x9") for _ in range(rng.randint(0, 12))) if rng.random() > 0.1 else None for _ in range(2000)]
    data, offsets = tb.text_buffer(pa.array(texts))
    data = tb.ASCII_LOWER[data]
    for table, pattern in ((tb.NOT_BLANK, rb"[^\x20\x09-\x0D]+"), (tb.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        start, end, text = tb.words(data, offsets, table)
        got = [(int(k), data[a:b].tobytes()) for a, b, k in zip(start, end, text)]
        assert got == [(i, m.group()) for i, x in enumerate(texts) for m in re.finditer(pattern, (x or "").encode().lower())]
        seen = {}
        for (_, w), h in zip(got, tb.run_hashes(data, start, end)):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10] * 10 + [None, "b" * 100]})
    sizes = [sum(len(x or "") for x in p.column(0).to_pylist()) for p in tb.slices(batch, "text", 35)]
    assert max(sizes[:-1]) <= 35 and sum(sizes) == 200
