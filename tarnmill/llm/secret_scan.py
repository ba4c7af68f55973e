"""Secret scans: all rules in one minimal automaton over the bytes, spans by automata on the lines that it flags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm import textbytes as tb
from tarnmill.llm.automaton import Automaton, Spans, covers


@dataclass(frozen=True)
class SecretRule:
    """``scan`` goes into the automaton that reads all bytes; it must occur wherever the rule has a match that counts, which
    is verified when rules are compiled.

    ``head`` and ``body`` together give the leftmost longest non-overlapping matches of a line; those whose body has
    fewer than ``min_chars`` bytes are dropped. No rule matches a newline.
    """

    kind: str
    scan: str
    head: str
    body: str
    min_chars: int = 1
    base: bool = False


_KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SETS = "[\"']?\\x20*[:=]\\x20*[\"']?"

RULES = (
    SecretRule("assign", _KEYWORDS + _SETS + "[A-Za-z0-9+/_.=-]{6}", _KEYWORDS + _SETS, "([A-Za-z0-9+/_.=-]+)", 6, True),
    SecretRule("access", "AKIA[A-Z0-9]{16}", "", "AKIA[A-Z0-9]+", 20, True),
    SecretRule("hex", "[0-9a-f]{24}", "", "[0-9a-f]+", 24, True),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]{4}", "", "gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("slack", "xox[abprs]-[0-9]", "", "xox[abprs]-[0-9]+-[A-Za-z0-9-]+", 24),
    SecretRule("google", "AIza[0-9A-Za-z_-]{4}", "", "AIza[0-9A-Za-z_-]+", 39),
    SecretRule("jwt", "eyJ[A-Za-z0-9_-]", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    SecretRule("private_key", "-----BEGIN ", "", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 1),
)


@lru_cache(maxsize=4)
def compiled(rules: tuple[SecretRule, ...]) -> tuple[Automaton, Spans]:
    """The automata of the rules; the driver builds them once and sends their arrays, some hundred KB, to the executors.

    A rule whose ``scan`` does not occur in each of its matches that count would lose matches, and is an error.
    """
    for r in rules:
        if not covers(r.scan, r.head, r.body, r.min_chars):
            raise ValueError(f"rule {r.kind}: {r.scan!r} does not occur in all of its matches")
    return Automaton([r.scan for r in rules]), Spans([(r.head, r.body) for r in rules])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(id, spans): the secrets in each text, spans being an array of (kind, start, end, base), offsets in code points
    with an exclusive end, ordered by start, then by the order of the rules.

    Each line is a lane of one array pass through the automaton of all rules; on the few lines where it ends in the hit
    state ``Spans`` gives the matches, in time linear in the line. One narrow pass over the rows, in slices of bounded bytes; no shuffle.

    Defined cases: null and empty texts have no spans; a text of one very long line is scanned whole; equal rows
    get equal results and each is returned; other columns are dropped; an empty table gives an empty table.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)

    sent = df.sparkSession.sparkContext.broadcast(compiled(rules))

    def scan(batches):
        automaton, matcher = sent.value
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                data, offsets = tb.text_buffer(piece.column(1))
                # a line begins where a text does and after each newline
                newline = np.flatnonzero(data == 10)
                start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
                start = start[start < len(data)]
                end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
                found: list[list] = [[] for _ in range(len(offsets) - 1)]
                flagged = np.flatnonzero(automaton.scan(data, start, end)) if len(start) else []
                if len(flagged):
                    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])  # code points before a byte
                    doc = np.searchsorted(offsets, start, "right") - 1
                    for k in flagged:
                        point = lambda at: int(before[start[k] + at] - before[offsets[doc[k]]])  # noqa: B023, E731
                        for n, a, head, b in matcher.find(data[start[k] : end[k]].tobytes()):
                            if b - head >= rules[n].min_chars:
                                found[doc[k]].append((point(a), n, point(b)))
                spans = [[{"kind": rules[n].kind, "start": a, "end": b, "base": rules[n].base} for a, n, b in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(arrow.field(0).type), pa.array(spans, arrow.field(1).type)], schema=arrow)

    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def spans_string(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(spans_string(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), spans_string(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """Spans from the pieces between matches: a match begins after the pieces and matches before it."""
    def lit(s: str) -> str:
        return s.replace("'", "''")

    parts = []
    for n, r in enumerate(RULES):
        parts.append(
            f"SELECT rid, {n} AS k, '{r.kind}' AS kind, {r.base} AS base, {r.min_chars} AS least, unnest(regexp_extract_all(t, '{lit(r.head + r.body)}')) AS m, "
            f"unnest(regexp_extract_all(t, '{lit(r.head + r.body)}', {2 if r.head else 0})) AS g, unnest(string_split_regex(t, '{lit(r.head + r.body)}')) AS piece, "
            f"unnest(range(len(string_split_regex(t, '{lit(r.head + r.body)}')))) AS i FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(parts)}),
s AS (SELECT *, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM p WINDOW w AS (PARTITION BY rid, k ORDER BY i)),
f AS (SELECT rid, k, kind, base, a, kind || ':' || a::BIGINT || ':' || (a + length(m))::BIGINT AS x FROM s WHERE m IS NOT NULL AND length(g) >= least),
j AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(x, ',' ORDER BY a, k) FILTER (base) AS b, string_agg(x, ',' ORDER BY a, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)"""


OP7_SQL = _sql()
