"""Every query of the subpackage against its DuckDB twin; the PII query against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest

import corpus_pipeline
from tarnmill.llm import queries as q
from tarnmill.llm.pii_bootstrap import luhn
from tests import oracle

QUERIES, ORACLES = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    oracle.check(spark, sf_dir, QUERIES[name], ORACLES[name])


def test_pipeline_matches_oracle(spark, sf_dir):
    oracle.check(spark, sf_dir, corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_pii(text: str) -> list[str]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_matches_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op5_pii_bootstrap"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, row = base_pii(d["text"]), got[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in row["spans"].split(",") if x and not x.startswith("found_")] == want
        assert row["n_card"] == sum(x.startswith("card") for x in want)
