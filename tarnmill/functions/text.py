"""Text functions as column expressions; Unicode folding alone needs Python and runs in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the texts of a batch that are Python strings at once; a longer text is alone.
SLICE_BYTES = 1 << 20


def by_slices(texts: pa.Array, fold) -> pa.Array:
    """``fold`` of each text, null for null, over slices of at most ``SLICE_BYTES`` or one text: a batch stays in Arrow."""
    if not len(texts):
        return texts
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, cuts = np.concatenate([[0], np.cumsum(size)]), [0]
    while cuts[-1] < len(texts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, upto[cuts[-1]] + SLICE_BYTES, "right")) - 1))
    return pa.concat_arrays([pa.array([None if x is None else fold(x) for x in texts.slice(i, j - i).to_pylist()], texts.type) for i, j in pairwise(cuts)])


def _without(marks, text: str) -> str:
    """``text`` without the characters for which ``marks`` holds, none of them ASCII."""
    return re.sub(r"[^\x00-\x7F]+", lambda run: "".join(c for c in run[0] if not marks(c)), text)


def _beyond_ascii(fold):
    """``fold``, which leaves ASCII as it is, on other texts alone: only these travel to Python."""

    def folded(text: Column) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        plain = F.octet_length(text) == F.char_length(text)
        return F.when(plain, text).otherwise(fold(F.when(~plain, text)))

    folded.__name__, folded.__doc__ = fold.__name__, fold.__doc__
    return folded


@_beyond_ascii
@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Unicode compatibility composition; Spark has no builtin."""
    return by_slices(s, lambda x: unicodedata.normalize("NFKC", x))


@_beyond_ascii
@F.arrow_udf(T.StringType())
def strip_accents(s: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks, in all scripts."""
    return by_slices(s, lambda x: _without(unicodedata.combining, unicodedata.normalize("NFKD", x)))


@_beyond_ascii
@F.arrow_udf(T.StringType())
def strip_accents_mn(s: pa.Array) -> pa.Array:
    """Canonical decomposition without category Mn; ligatures and the like stay."""
    return by_slices(s, lambda x: _without(lambda c: unicodedata.category(c) == "Mn", unicodedata.normalize("NFD", x)))


def lower(text: Column) -> Column:
    """Lower case letter by letter, as in SQL: a capital I with a dot becomes i, and sigma is the same at a word's end."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def trim(text: Column) -> Column:
    """Without the spaces of all scripts at both ends, as SQL trims; other blanks stay."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.trim(text)).otherwise(F.regexp_replace(text, r"^\p{Zs}++|(?<!\p{Zs})\p{Zs}++\z", ""))


#: What a pattern of SQL takes as blank: no vertical tab.
SQL_BLANK = r"[\t\n\f\r ]"


def normalize_text(text: Column, compose: bool = True, blank: str = r"\s") -> Column:
    """Lower case; line breaks, semicolons and colons become sentence ends; blanks are squeezed; null becomes empty.

    ``compose`` applies NFKC first, which text that is composed already can do without.
    """
    t = lower(nfkc(text) if compose else text)
    for pattern, by in ((r"[\r\n\t]+", " . "), (r"[;:]+", " . "), (f"{blank}+", " ")):
        t = F.regexp_replace(t, pattern, by)
    return F.coalesce(F.transform(F.array(t), trim)[0], F.lit(""))


def normalize_text_v2(text: Column) -> Column:
    """Folds accents, drops soft hyphens, turns joiners into blanks and squeezes these."""
    t = F.regexp_replace(strip_accents(lower(text)), "­", "")
    return F.transform(F.array(F.regexp_replace(F.regexp_replace(t, r"[_\-/\\]+", " "), r"[ \t]+", " ")), trim)[0]


def sentences(text: Column) -> Column:
    """Non-empty trimmed pieces between sentence and bullet marks."""
    return F.filter(F.transform(F.split(text, r"[.\n;•\->]+"), trim), lambda s: s != "")


#: A header has at most so many words, and a clause of more than so many is also cut at commas, into parts of
#: at least so many.
HEADER_WORDS, LONG_WORDS, PART_WORDS = 14, 25, 3
_BLANKS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, _BLANKS, -1), ""))


def clauses(text: Column) -> Column:
    """The statements of a text, an array.

    Pieces end at line breaks and at a full stop, semicolon, exclamation or question mark before a blank. A piece that
    ends in a colon and is short is a header: it is read with the next piece, which also stays by itself, and not alone.
    A long clause is followed by its parts between commas, as each may say something of its own.
    """
    lines = F.split(F.regexp_replace(text, r"([.;!?])" + _BLANKS, "$1\n"), r"\n+", -1)
    pieces = F.filter(F.transform(lines, trim), lambda s: s != "")
    header = lambda s: s.endswith(":") & (n_words(s) <= HEADER_WORDS)
    merged = F.transform(F.array(pieces), lambda p: F.transform(p, lambda s, i: F.when(header(s) & (i + 1 < F.size(p)), F.concat_ws(" ", s, F.get(p, i + 1))).otherwise(s)))[0]
    parts = lambda s: F.filter(F.transform(F.split(s, ",", -1), trim), lambda x: n_words(x) >= PART_WORDS)
    return F.flatten(F.transform(merged, lambda s: F.when(n_words(s) > LONG_WORDS, F.concat(F.array(s), parts(s))).otherwise(F.array(s))))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, stop) of the matches of a pattern in order, in characters, ends exclusive; no match may be empty.

    SQL regexes give no positions: a match begins after all pieces between matches, and all matches, before it.
    A pattern that ignores case does so for letters of all scripts, as in SQL.
    """
    pattern = f"(?u){pattern}"
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda h: F.char_length(h))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(s, x):
        start = s["at"] + x["gap"]
        return F.struct((start + x["hit"]).alias("at"), F.array_append(s["spans"], F.struct(start.alias("start"), (start + x["hit"]).alias("stop"))).alias("spans"))

    return F.when(text.isNotNull(), F.aggregate(F.filter(steps, lambda x: x["hit"].isNotNull()), none, step, lambda s: s["spans"]))


def span_distance(stems: Column, qualifiers: Column, reach: int = 55) -> Column:
    """The fewest characters between a span of each array, 0 where they overlap; null if no qualifier lies within
    ``reach`` characters of a stem, its whole length counted.

    One pass over the spans of both in order of their starts: nearest to a span is the last one of the other kind.
    Spans of one kind do not overlap, and no qualifier is longer than ``reach``.
    """
    kind = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop")))
    both = F.array_sort(F.concat(kind(stems, 0), kind(qualifiers, 1)))
    far = F.lit(-(1 << 30))
    zero = F.struct(far.alias("m0"), far.alias("m1"), far.alias("q0"), far.alias("q1"), F.lit(None).cast("int").alias("best"))

    def step(s, x):
        stem = x["kind"] == 0
        fits = F.when(stem, s["q0"] >= x["start"] - reach).otherwise(x["stop"] <= s["m1"] + reach)
        gap = F.greatest(F.lit(0), x["start"] - F.when(stem, s["q1"]).otherwise(s["m1"]))
        keep = lambda mine, value, old: F.when(mine, value).otherwise(s[old]).alias(old)
        best = F.when(fits, F.least(s["best"], gap)).otherwise(s["best"]).alias("best")
        return F.struct(keep(stem, x["start"], "m0"), keep(stem, x["stop"], "m1"), keep(~stem, x["start"], "q0"), keep(~stem, x["stop"], "q1"), best)

    return F.aggregate(both, zero, step, lambda s: s["best"])


def nearest_side(own: Column, other: Column) -> Column:
    """Which of two distances is the nearer: "own", also where they are equal, "other", or null without either."""
    return F.when(own.isNotNull() & (other.isNull() | (own <= other)), "own").when(other.isNotNull(), "other")


#: One metric of a log line: a name, a colon or equals sign, a number.
METRIC = r"([A-Za-z][A-Za-z0-9_ ]*?) *[=:] *(-?[0-9]+(?:\.[0-9]+)?)"


def log_blocks(text: Column) -> Column:
    """Array of (epoch, fold, metrics) of the summaries in a log of several lines.

    A block begins with "--- Epoch n/m Summary (Fold f) ---" and ends before the next one; metrics are (name, value) in
    order. Text before the first block is skipped.
    """
    head = r"--- Epoch ([0-9]+)/[0-9]+ Summary \(Fold ([0-9]+)\) ---"
    blocks = F.filter(F.split(text, "(?=--- Epoch [0-9]+/[0-9]+ Summary)", -1), lambda b: b.rlike("^" + head))

    def parsed(b):
        body = F.regexp_replace(b, "^" + head, "")
        names, values = (F.regexp_extract_all(body, F.lit(METRIC), F.lit(k)) for k in (1, 2))
        pairs = F.zip_with(names, values, lambda n, v: F.struct(F.regexp_replace(n, " +", " ").alias("name"), v.cast("double").alias("value")))
        return F.struct(F.regexp_extract(b, head, 1).cast("int").alias("epoch"), F.regexp_extract(b, head, 2).cast("int").alias("fold"), pairs.alias("metrics"))

    return F.transform(blocks, parsed)


def metric(metrics: Column, name: str) -> Column:
    """The last value of a name in (name, value) pairs, null without one."""
    return F.try_element_at(F.filter(metrics, lambda m: m["name"] == name), F.lit(-1))["value"]


def language(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The language of the first rule whose word pattern occurs."""
    out = F
    for pattern, name in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def snippet(text: Column, n: int) -> Column:
    """The first ``n`` characters with blanks squeezed, and an ellipsis if there is more."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON object in a fenced block, or the text itself; null if neither parses."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.from_json(F.when(inner != "", inner).otherwise(text), schema)


def status_value(status: Column) -> Column:
    """YES 1, NO 0, anything else 0.5."""
    s = F.upper(F.trim(status))
    return F.when(s == "YES", 1.0).when(s == "NO", 0.0).otherwise(0.5)


def severity(score: Column, most: int = 4) -> Column:
    """A score of 0 to ``most`` as a share, rounded half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / most)), 4)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_normalize(v: Column, eps: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (norm + eps))
