"""Quality rules [native]: line-first cleaning, then rejection of documents that lose too much text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import BLANK_RUN, BLANKS, let, text_or_empty


@dataclass(frozen=True)
class LineRules:
    """What a line must satisfy, and what a document may lose.

    ``terminal``: a line must end in one of these, closing quotes and brackets set aside. ``nav_separators``: a line
    with at least ``nav_min`` of them, and one for every ``nav_words`` words, is navigation. ``boilerplate``: a line
    in which this pattern occurs and that has at most ``boilerplate_words`` words. ``max_lost``: percent of the
    word characters that a document may lose.
    """

    terminal: str = ".!?:;…。！？"
    nav_separators: str = "|›»•·"
    nav_min: int = 2
    nav_words: int = 6
    boilerplate: str = (
        r"(?i)\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|javascript|"
        r"sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share on|lorem ipsum)\b"
    )
    boilerplate_words: int = 20
    max_lost: int = 50


def words_of(text: Column) -> Column:
    """Runs of other characters than blanks, in order."""
    return F.array_remove(F.split(text, BLANK_RUN, -1), "")


def count_of(text: Column, chars_class: str) -> Column:
    """Code points of ``text`` in a regex character class."""
    return F.char_length(F.regexp_replace(text, f"[^{chars_class}]+", ""))


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the same array, the first included.

    Windows are hashed to 64 bits. Where all hashes differ, which one pass tells, nothing is sorted; else equal
    neighbours in the sorted hashes give the repeated windows.
    """

    def body(w):
        hashes = F.when(
            F.size(w) >= width,
            F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)])),
        ).otherwise(F.array().cast("array<bigint>"))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(
                                s,
                                lambda e, j: F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False))
                                | F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False)),
                            ),
                            lambda e: F.array(*[e["i"] + k for k in range(width)]),
                        )
                    )
                )
            ),
        )

    return let(words, body)


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with a word breaks one of the rules; each is one pass of a regex or a count."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    n_words = F.size(words_of(line))
    unpunctuated = ~trimmed.rlike(f"[{rules.terminal}][\"'”’»)\\]]*$")
    n_seps = count_of(line, rules.nav_separators.replace("|", r"\|"))
    navigation = (n_seps >= rules.nav_min) & (n_seps * rules.nav_words >= n_words)
    boilerplate = (n_words <= rules.boilerplate_words) & line.rlike(rules.boilerplate)
    return unpunctuated | navigation | boilerplate


def clean_lines(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Removes failing lines and judges each document by what it lost.

    Returns the columns of ``df`` with ``cleaned`` (the text without failing lines; lines without a word stay, as
    paragraph marks), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` (under ``min_words`` words, or over ``max_repeat`` percent of them in repeated 3-word windows),
    ``lost_chars`` (word characters of the failing lines) and ``kept`` (not ``base_failed`` and at most
    ``rules.max_lost`` percent lost). These replace input columns of the same name.

    One narrow pass of SQL expressions: no shuffle, no Python. Null text counts as empty: no words, base_failed,
    not kept, cleaned is the empty string. Equal rows get equal results; an empty table gives an empty table.
    """
    text = text_or_empty(F.col(text_col))
    blanks_gone = F.char_length(F.regexp_replace(text, BLANK_RUN, ""))
    staged = df.withColumns(
        {
            "_tm_words": words_of(text),
            # (line, fails) of each line; a line without a word never fails
            "_tm_lines": F.transform(
                F.split(text, "\n", -1),
                lambda l: F.struct(l.alias("line"), (F.btrim(l, F.lit(BLANKS)) != "").alias("has_word"), line_fails(l, rules).alias("fails")),
            ),
        }
    )
    measured = staged.withColumns(
        {
            "n_words": F.size("_tm_words").cast("long"),
            "word_chars": blanks_gone.cast("long"),
            "n_symbols": count_of(text, r"#*$%&|<>").cast("long"),
            "n_dup_lines": let(
                F.filter("_tm_lines", lambda s: s["has_word"]), lambda a: F.size(a) - F.size(F.array_distinct(F.transform(a, lambda s: s["line"])))
            ).cast("long"),
            "n_repeat_words": repeated_window_words(F.col("_tm_words")).cast("long"),
            "cleaned": F.array_join(
                F.transform(F.filter("_tm_lines", lambda s: ~(s["has_word"] & s["fails"])), lambda s: s["line"]), "\n"
            ),
        }
    ).drop("_tm_words", "_tm_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    lost = F.col("word_chars") - F.char_length(F.regexp_replace("cleaned", BLANK_RUN, ""))
    return measured.withColumns({"base_failed": failed, "lost_chars": lost.cast("long")}).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.max_lost * F.col("word_chars"))
    )


def op6_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
lines AS (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, unnest(ls) AS line FROM w)),
judged AS (SELECT rid, line, lw, (NOT regexp_matches(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?:;…。！？]["''”’»)\]]*$'))
  OR (length(regexp_replace(line, '[^|›»•·]+', '', 'g')) >= 2 AND length(regexp_replace(line, '[^|›»•·]+', '', 'g')) * 6 >= len(lw))
  OR (len(lw) <= 20 AND regexp_matches(line, '(?i)\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|javascript|sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share on|lorem ipsum)\b')) AS fails
  FROM lines WHERE len(lw) > 0),
per_line AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
  coalesce(sum(list_sum(list_transform(lw, lambda x: length(x)))) FILTER (fails), 0) AS lost FROM judged GROUP BY rid),
win AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN per_line USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept, lost::BIGINT AS lost_chars
FROM m"""
