"""PII: seed entities induce lexical patterns, a pattern-instance graph is scored, patterns find unseen identifiers."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm import textbytes as tb
from tarnmill.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# No lookbehind or possessive mark here changes a match; they keep failing attempts from rereading long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"\S+")
_EDGES = "\"'`.,;:!?()[]{}<>|#*$%&="
#: Characters of a context word, those nearest to the entity.
WORD_CHARS = 64
#: Entities and candidates, beside those of one more text, that a task holds at once.
MENTIONS = 1 << 14


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each at sign outward: linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end) of the base matches, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, without outer punctuation, that touch no base span. Neighbours on a line that
    hold digits are one candidate, unless punctuation other than brackets or an at sign parts them."""
    out, free, spans, k = [], 0, sorted((a, b) for _, a, b in taken), 0
    joins, last = False, 0
    m = _MARK.search(text)
    while m:
        pos = m.start()
        start = max([free, *(text.rfind(c, free, pos) + 1 for c in " \n\t\r\x0b\x0c")])
        found = _BLANK.search(text, pos)
        stop = found.start() if found else len(text)
        token = text[start:stop]
        left = start + len(token) - len(token.lstrip(_EDGES))
        right = max(left, stop - (len(token) - len(token.rstrip(_EDGES))))
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if right > left and not (k < len(spans) and spans[k][0] < stop):
            grouped = "@" not in token
            if joins and grouped and not text[start:left].strip("([") and not text[last:start].strip(" \t"):
                out[-1] = (out[-1][0], right)
            else:
                out.append((left, right))
            joins, last = grouped and not text[right:stop].strip(")]"), stop
        else:
            joins = False
        free = stop
        m = _MARK.search(text, stop)
    return out


class Context:
    """The words of a text, from which the lexical patterns of its entities are read."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts, self.ends = [], []
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def patterns_of(self, start: int, end: int) -> list[str]:
        """The patterns that hold an entity: its two words to the left, and one word on either side. A part of a word
        that the entity leaves over is a word; of each, the ``WORD_CHARS`` nearest characters count."""
        clean = lambda w: re.sub("[0-9]+", "0", w.strip(_EDGES).lower()) or "-"
        left, k = ["^", "^"], bisect_left(self.starts, start)
        for i in range(max(0, k - 2), k):
            stop = min(self.ends[i], start)
            left.append(clean(self.text[max(self.starts[i], stop - WORD_CHARS) : stop]))
        k = bisect_right(self.ends, end)
        right = "$"
        if k < len(self.starts):
            first = max(self.starts[k], end)
            right = clean(self.text[first : min(self.ends[k], first + WORD_CHARS)])
        return [f"{left[-2]} {left[-1]} _", f"{left[-1]} _ {right}"]


def mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, spans, mentions) per document: base spans, and every entity or candidate with its patterns.

    ``row`` numbers the documents, as ids may repeat; the caller materialises the result before using it.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    mention = T.StructType([T.StructField("instance", T.LongType()), *span.fields, T.StructField("patterns", T.ArrayType(T.StringType()))])
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(span)), T.StructField("mentions", T.ArrayType(mention))]
    )
    arrow = to_arrow_schema(schema)

    def lists(kind: pa.DataType, bounds: list[int], columns: list[pa.Array]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)

    def find(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                texts, first = piece.column(1), 0
                while first < piece.num_rows:
                    base_at, all_at, instances, kinds, starts, ends, patterns, base = [0], [0], array("q"), [], array("q"), array("q"), [], []
                    row = first
                    while row < piece.num_rows and len(instances) < MENTIONS:
                        text = texts[row].as_py() or ""
                        spans = base_spans(text)
                        base += spans
                        found = [*spans, *((None, a, b) for a, b in candidates(text, spans))]
                        context = Context(text) if found else None
                        for kind, a, b in found:
                            instances.append(xxhash.xxh64_intdigest(text[a:b].lower()) - (1 << 63))
                            kinds.append(kind)
                            starts.append(a)
                            ends.append(b)
                            patterns += context.patterns_of(a, b)
                        base_at.append(len(base))
                        all_at.append(len(instances))
                        row += 1
                    spans = lists(arrow.field(2).type, base_at, [pa.array([x[0] for x in base], pa.int32()), *(pa.array([x[k] for x in base], pa.int64()) for k in (1, 2))])
                    pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(instances) + 1, dtype=np.int32) * 2), pa.array(patterns, pa.string()), type=arrow.field(3).type.value_type.field(4).type)
                    whole = lists(arrow.field(3).type, all_at, [pa.array(np.frombuffer(instances, np.int64)), pa.array(kinds, pa.int32()), pa.array(np.frombuffer(starts, np.int64)), pa.array(np.frombuffer(ends, np.int64)), pairs])
                    n = row - first
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n)), piece.column(0).slice(first, n).cast(arrow.field(1).type), spans, whole], schema=arrow)
                    number, first = number + n, row

    return rows.mapInArrow(find, schema)


def score_patterns(edges: DataFrame, rounds: int, smoothing: float, min_confidence: float, min_seeds: int) -> DataFrame:
    """(pattern, kind, confidence, n_seeds) after ``rounds`` of passing scores over the pattern-instance graph.

    ``edges``: distinct (pattern, instance, kind), kind null for candidates. A seed's score is 1 for its kind. A
    pattern's confidence for a kind is the sum of its instances' scores over their number plus ``smoothing``. A
    candidate in a pattern with at least ``min_seeds`` seeds and ``min_confidence`` is accepted: in the next round it
    is a seed of the kind of the best such pattern, and counts among ``n_seeds``, also of patterns that hold no base
    seed. The score of any other candidate is one minus the product of what its patterns leave open. Each round is
    three combined aggregates and two joins.
    """
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    graph = materialise(edges.join(totals, "pattern"), "pii-graph")
    seeds = graph.filter("kind IS NOT NULL").groupBy("pattern", "kind", "n").agg(F.count(F.lit(1)).alias("n_seeds"))
    opened = graph.filter("kind IS NULL").select("pattern", "instance", "n")
    scored = seeds.select("pattern", "kind", "n", "n_seeds", (F.col("n_seeds") / (F.col("n") + smoothing)).alias("confidence"))
    good = (F.col("confidence") >= min_confidence) & (F.col("n_seeds") >= min_seeds)
    for _ in range(rounds - 1):
        by_kind = (
            opened.select("pattern", "instance").join(scored.select("pattern", "kind", "confidence", "n_seeds"), "pattern").groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"), F.max(F.when(good, F.col("confidence"))).alias("best"))
        )
        instance = (
            by_kind.groupBy("instance")
            .agg(F.max_by("kind", F.when(F.col("best").isNotNull(), F.struct("best", -F.col("kind")))).alias("taken"), F.collect_list(F.struct("kind", "score")).alias("scores"))
            .withColumn("s", F.explode("scores"))
            .select("instance", "s.kind", F.when(F.col("taken").isNull(), F.col("s.score")).otherwise((F.col("taken") == F.col("s.kind")).cast("double")).alias("score"),
                    F.coalesce(F.col("taken") == F.col("s.kind"), F.lit(False)).cast("long").alias("accepted"))
        )
        gained = opened.join(instance, "instance").groupBy("pattern", "kind", "n").agg(F.sum("accepted").alias("n_seeds"), F.sum("score").alias("gained"))
        held = seeds.select("pattern", "kind", "n", "n_seeds", F.col("n_seeds").cast("double").alias("gained"))
        scored = materialise(
            held.unionByName(gained).groupBy("pattern", "kind", "n").agg(F.sum("n_seeds").alias("n_seeds"), F.sum("gained").alias("gained"))
            .select("pattern", "kind", "n", "n_seeds", (F.col("gained") / (F.col("n") + smoothing)).alias("confidence")),
            "pii-patterns",
        )
    return scored.select("pattern", "kind", "confidence", "n_seeds")


def extract_pii(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, smoothing: float = 2.0, min_confidence: float = 0.6, min_seeds: int = 3
) -> DataFrame:
    """(id, spans): personal data of each text as an array of (kind, start, end, base), by kind, then start.

    Base spans come from the patterns of the four kinds. They are the seeds: their contexts are lexical patterns,
    and in ``rounds`` rounds scores pass between patterns and all id-like words, or groups of them, of the corpus.
    Patterns with at least ``min_seeds`` distinct seeds and ``min_confidence`` mark the id-like words in their place as
    found entities, of kind ``found_<kind>``; these are seeds of the next round, so entities found in one context lead
    to others, a context further a round. A word that several patterns mark takes the kind of the best.

    One pass over the texts, in slices of bounded bytes; what follows handles only mentions. Patterns and instances
    that a third of the documents share are combined before each shuffle, and joins on them are left to AQE to
    split.

    Defined cases: null and empty texts have no spans; rows that share an id are separate documents; equal rows get
    equal results, and as instances are distinct strings, repeats lend a pattern no weight; ties between kinds go to
    the first kind; other columns are dropped; an empty table gives an empty table.
    """
    docs = materialise(mentions(df, id_col, text_col), "pii-mentions")
    found = docs.select("row", F.explode("mentions").alias("m")).select("row", "m.instance", "m.kind", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    edges = found.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))
    good = score_patterns(edges, rounds, smoothing, min_confidence, min_seeds).filter((F.col("confidence") >= min_confidence) & (F.col("n_seeds") >= min_seeds))
    extra = (
        found.filter("kind IS NULL").drop("kind").join(good.select("pattern", F.col("kind").alias("guess"), "confidence"), "pattern")
        .groupBy("row", "start", "end").agg(F.max_by("guess", F.struct("confidence", -F.col("guess"))).alias("kind"))
        .groupBy(F.col("row").alias("_tm_row")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    )
    out = docs.select("row", "id", "spans").join(extra, F.col("row") == F.col("_tm_row"), "left")
    names = F.array(*map(F.lit, KINDS))
    mark = lambda spans, base: F.transform(
        F.sort_array(spans),
        lambda s: F.struct(
            (names[s["kind"]] if base else F.concat(F.lit("found_"), names[s["kind"]])).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base")
        ),
    )
    spans = F.when(F.col("extra").isNull(), mark(F.col("spans"), True)).otherwise(F.concat(mark(F.col("spans"), True), mark(F.col("extra"), False)))
    return out.select(F.col("id").alias(id_col), spans.alias("spans"))


def op5_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    from tarnmill.llm.secret_scan import spans_string

    found = extract_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_found"),
        F.sha2(spans_string(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), spans_string(F.col("spans")).alias("spans"),
    )
