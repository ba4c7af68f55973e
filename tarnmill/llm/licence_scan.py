"""Licence scans [native]: Dice coefficient of word bigrams against licence templates, pruned by size bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import let, text_or_empty
from tarnmill.llm.licence_texts import TEMPLATES


def normalised_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def ordered_bigrams(words: Column) -> Column:
    """The word bigrams in their order as 64-bit hashes; fewer than two words have none."""
    return let(
        words,
        lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1]))).otherwise(F.array().cast("array<bigint>")),
    )


def bigrams(words: Column) -> Column:
    """The distinct word bigrams."""
    return F.array_distinct(ordered_bigrams(words))


def template_array(spark: SparkSession, templates) -> tuple[Column, int]:
    """The templates as one literal, array of (licence, n, length, bigrams), and the least n; ``length`` counts repeated ones. Their number and size are fixed in
    the code."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "k int, name string, text string")
    hashed = rows.orderBy("k").select("name", bigrams(normalised_words(F.col("text"))).alias("b"), F.size(ordered_bigrams(normalised_words(F.col("text")))).alias("length")).collect()
    table = F.array(*[F.struct(F.lit(r["name"]).alias("licence"), F.lit(len(r["b"])).alias("n"), F.lit(r["length"]).alias("length"), F.array(*map(F.lit, r["b"])).alias("bigrams")) for r in hashed])
    return table, min((len(r["b"]) for r in hashed), default=0)


def windows(seq: Column, distinct: Column, table: Column, vocabulary: Column, least: int, threshold: int) -> Column:
    """Array of (start, stop, licence, n, shared, total): for each template, the best runs of bigrams ``seq[start..stop]``
    at or over ``threshold``, of those that share bigrams the best, then the first.

    A run has at most ``reach`` bigrams, the template's own number times the ratio of sizes that can match; so each start
    costs the same however often the text repeats itself, and the whole is linear in the text. A best run begins and ends
    with a bigram of the template and holds at least ``need`` distinct ones. So a template is dropped unless the whole
    text shares ``need`` with it, and a start unless ``need`` of them lie ahead within such a length. From each start
    left every end is scored: a bigram is new to a run if its previous place lies before the start.
    """
    seen = F.array_intersect(distinct, vocabulary)
    close = let(
        seen,
        lambda s: F.when(
            F.size(s) * (200 - threshold) >= least * threshold,
            F.filter(
                F.transform(table, lambda t: F.struct(t["licence"].alias("licence"), t["n"].alias("n"), t["length"].alias("length"), F.array_intersect(t["bigrams"], s).alias("b"))),
                lambda t: (F.size(t["b"]) > 0) & (F.size(t["b"]) * (200 - threshold) >= t["n"] * threshold),
            ),
        ),
    )
    by_value = F.array_sort(F.transform(seq, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    placed = let(
        by_value,
        lambda v: F.transform(v, lambda x, j: F.struct(x["i"].alias("i"), F.when(F.get(v, j - 1)["g"] == x["g"], F.get(v, j - 1)["i"]).otherwise(-1).alias("prev"))),
    )
    previous = F.transform(F.array_sort(placed), lambda x: x["prev"])

    def best_end(a, steps, n):
        """The best end of a run from ``a``, scored over the bigrams ``steps``."""
        zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "shared", "size", "best", "of", "stop")])

        def step(s, x):
            new = (x["prev"] < a).cast("int")
            shared, size = s["shared"] + new * x["hit"], s["size"] + new
            better = (x["hit"] == 1) & (shared.cast("long") * (n + s["of"]) > s["best"].cast("long") * (n + size))
            keep = lambda value, old: F.when(better, value).otherwise(s[old]).alias(old)
            return F.struct((s["at"] + 1).alias("at"), shared.alias("shared"), size.alias("size"), keep(shared, "best"), keep(size, "of"), keep(a + s["at"], "stop"))

        return F.aggregate(steps, zero, step)

    def runs(t, prev):
        need = F.ceil(t["n"] * threshold / (200 - threshold)).cast("int")
        reach = F.floor(t["length"] * (200 - threshold) / threshold).cast("int")
        steps = F.transform(seq, lambda g, i: F.struct(i.alias("i"), F.array_contains(t["b"], g).cast("int").alias("hit"), F.get(prev, i).alias("prev")))

        def from_starts(steps):
            hits = F.transform(F.filter(steps, lambda x: x["hit"] == 1), lambda x: x["i"])
            starts = let(
                hits,
                lambda h: F.transform(
                    F.filter(F.transform(h, lambda a, k: F.struct(a.alias("a"), F.get(h, k + need - 1).alias("z"))), lambda x: F.coalesce(x["z"] - x["a"] < reach, F.lit(False))), lambda x: x["a"]
                ),
            )
            ahead = F.filter(starts, lambda a: F.size(F.array_intersect(F.slice(seq, a + 1, reach), t["b"])) >= need)
            ends = F.transform(
                ahead,
                lambda a: let(
                    best_end(a, F.slice(steps, a + 1, reach), t["n"]),
                    lambda e: F.struct(
                        (-2.0 * e["best"] / (t["n"] + e["of"])).alias("dice"), a.alias("start"), e["stop"].alias("stop"), t["licence"].alias("licence"), t["n"].alias("n"),
                        e["best"].alias("shared"), (t["n"] + e["of"]).alias("total"),
                    ),
                ),
            )
            good = F.array_sort(F.filter(ends, lambda e: 200 * e["shared"] >= threshold * e["total"]))

            def apart(g):
                """The best first, each but those that overlap one taken before.

                A run holds ``need`` bigrams at least, so of runs apart at most one starts in each ``need`` places; one that
                overlaps a candidate starts in one of few such blocks.
                """
                block = lambda i: F.floor(i / need).cast("int")
                none = F.array_repeat(F.get(g, F.lit(-1)), block(F.size(steps)) + 1)

                def pick(told, e):
                    low = F.greatest(F.lit(0), block(e["start"] - reach))
                    beside = F.slice(told, low + 1, block(e["stop"]) - low + 1)
                    taken = F.exists(beside, lambda o: F.coalesce((o["start"] <= e["stop"]) & (e["start"] <= o["stop"]), F.lit(False)))
                    return F.when(taken, told).otherwise(F.transform(told, lambda o, i: F.when(i == block(e["start"]), e).otherwise(o)))

                return F.when(F.size(g) > 0, F.filter(F.aggregate(g, none, pick), lambda o: o.isNotNull())).otherwise(g)

            return let(good, apart)

        return let(steps, from_starts)

    return let(close, lambda c: F.when(F.size(c) > 0, let(previous, lambda p: F.flatten(F.transform(c, lambda t: runs(t, p))))))


def scan_licences(df: DataFrame, text_col: str = "text", threshold: int = 80, templates=TEMPLATES) -> DataFrame:
    """Compares the whole text, each paragraph, each line and every run of words with the licence templates.

    Returns the columns of ``df`` with ``n_bigrams`` (distinct, of the whole text) and ``licences``, an array of
    (unit, place, licence, shared, total): unit is "text", "paragraph", "line" or "window", place counts units from 0
    (for a window, the words before it), and the Dice coefficient 2 * shared / total is at least ``threshold`` percent; total is the sum of both set sizes. These
    replace input columns of the same name. Paragraphs are told apart by blank lines and compared only where there
    are at least two; a text of one line is not compared again as a line.

    A window is a run of words, over line and paragraph ends too, so a template is found with whatever stands around
    it; its bigrams, repeated ones counted, are within the size bound of the template's. Of windows of a template that overlap, the best is told. A
    window that overlaps a matched unit is not told again if that unit matches the same licence at least as well, nor one
    within a unit that matches another licence at least as well.

    A Dice coefficient of t needs sizes within t / (2 - t) of each other, so a template outside these bounds is
    pruned before any intersection. Windows are looked for only where the text shares enough bigrams with a template for
    one to match, which few texts do. The templates are a literal, so the whole is one narrow pass of SQL expressions.

    Defined cases: null, empty and one-word texts match nothing; all templates at or over the threshold are returned,
    in the order of the templates, so ties need no choice; equal rows get equal results; an empty table gives an
    empty table.
    """
    table, least = template_array(df.sparkSession, templates)

    def matches(sets: Column, unit: str) -> Column:
        """``sets``: array of bigram sets."""

        def of(b, place):
            near = F.filter(
                table, lambda t: (t["n"] * (200 - threshold) >= F.size(b) * threshold) & (F.size(b) * (200 - threshold) >= t["n"] * threshold)
            )
            scored = F.transform(
                near,
                lambda t: F.struct(
                    F.lit(unit).alias("unit"), place.alias("place"), t["licence"].alias("licence"), F.size(F.array_intersect(b, t["bigrams"])).alias("shared"), (t["n"] + F.size(b)).alias("total"),
                    F.size(b).alias("size"),
                ),
            )
            return F.filter(scored, lambda m: 200 * m["shared"] >= threshold * m["total"])

        return F.flatten(F.transform(sets, of))

    text = text_or_empty(F.col(text_col))
    none = F.array().cast("array<array<bigint>>")
    lines = F.split(text, "\n", -1)
    paragraphs = F.split(text, r"\n[\x20\t\r]*\n", -1)
    staged = df.withColumn("_tm_seq", ordered_bigrams(normalised_words(text))).withColumns(
        {
            "_tm_text": F.array_distinct("_tm_seq"),
            "_tm_lines": F.when(F.instr(text, "\n") > 0, F.transform(lines, lambda x: bigrams(normalised_words(x)))).otherwise(none),
            "_tm_paragraphs": let(paragraphs, lambda p: F.when(F.size(p) >= 2, F.transform(p, lambda x: bigrams(normalised_words(x)))).otherwise(none)),
        }
    )
    found = F.concat(matches(F.array("_tm_text"), "text"), matches(F.col("_tm_paragraphs"), "paragraph"), matches(F.col("_tm_lines"), "line"))
    counts = lambda parts: F.transform(parts, lambda x: F.size(normalised_words(x)))

    def told_anew(found, wins):
        """The windows that overlap no unit which matches their licence at least as well, and lie in none which matches
        another one so."""

        def ranged(line_words, paragraph_words):
            span = lambda sizes, p: F.struct(F.aggregate(F.slice(sizes, 1, p), F.lit(0), lambda s, x: s + x).alias("first"), F.get(sizes, p).alias("words"))
            whole = F.struct(F.lit(0).alias("first"), (F.size("_tm_seq") + 1).alias("words"))
            at = lambda m: F.when(m["unit"] == "text", whole).when(m["unit"] == "line", span(line_words, m["place"])).otherwise(span(paragraph_words, m["place"]))
            return F.transform(found, lambda m: F.struct(at(m).alias("at"), m["licence"].alias("licence"), m["shared"].alias("shared"), m["total"].alias("total")))

        units = let(counts(lines), lambda a: let(counts(paragraphs), lambda b: ranged(a, b)))
        as_good = lambda u, w: u["shared"].cast("long") * w["total"] >= w["shared"].cast("long") * u["total"]
        overlap = lambda u, w: (w["start"] < u["at"]["first"] + u["at"]["words"]) & (w["stop"] + 1 >= u["at"]["first"])
        inside = lambda u, w: (w["start"] >= u["at"]["first"]) & (w["stop"] + 1 < u["at"]["first"] + u["at"]["words"])
        explains = lambda u, w: as_good(u, w) & F.when(u["licence"] == w["licence"], overlap(u, w)).otherwise(inside(u, w))
        return let(units, lambda us: F.filter(wins, lambda w: ~F.exists(us, lambda u: explains(u, w))))

    told = lambda ms, unit, place: F.transform(
        ms, lambda m: F.struct(unit(m).alias("unit"), place(m).alias("place"), m["licence"].alias("licence"), m["shared"].alias("shared"), m["total"].alias("total"))
    )
    vocabulary = F.array_distinct(F.flatten(F.transform(table, lambda t: t["bigrams"])))
    staged = staged.withColumns({"_tm_found": found, "_tm_windows": windows(F.col("_tm_seq"), F.col("_tm_text"), table, vocabulary, least, threshold)})
    units = told(F.col("_tm_found"), lambda m: m["unit"], lambda m: m["place"])
    more = told(told_anew(F.col("_tm_found"), F.col("_tm_windows")), lambda m: F.lit("window"), lambda m: m["start"])
    both = F.when(F.size("_tm_windows") > 0, F.concat(units, more)).otherwise(units)
    return staged.withColumns({"n_bigrams": F.size("_tm_text").cast("long"), "licences": both}).drop("_tm_seq", "_tm_text", "_tm_lines", "_tm_paragraphs", "_tm_found", "_tm_windows")


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = F.reverse(F.array_sort(F.transform("licences", lambda m: F.struct((2 * m["shared"] / m["total"]).alias("dice"), m["licence"].alias("licence")))))
    return found.select(
        "doc_id", "n_bigrams", F.size("licences").cast("long").alias("n_matches"),
        F.try_element_at(best, F.lit(1))["licence"].alias("licence"), F.round(F.try_element_at(best, F.lit(1))["dice"], 6).alias("dice"),
        F.array_join(F.array_sort(F.transform("licences", lambda m: F.concat_ws(":", m["unit"], m["place"].cast("string"), m["licence"], m["shared"].cast("string"), m["total"].cast("string")))), ",").alias("matches"),
    )


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
    norm = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    return rf"""
WITH tpl AS (SELECT k, licence, {grams} AS b FROM (SELECT k, licence, {norm.format("t")} AS ws FROM (VALUES {values}) AS v(k, licence, t))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT rid, 'text' AS unit, 0 AS place, t AS x FROM d
  UNION ALL SELECT rid, 'line', unnest(range(len(string_split(t, chr(10))))), unnest(string_split(t, chr(10))) FROM d WHERE contains(t, chr(10))
  UNION ALL SELECT rid, 'paragraph', unnest(range(len(p))), unnest(p) FROM (SELECT rid, string_split_regex(t, '\n[\x20\t\r]*\n') AS p FROM d) WHERE len(p) >= 2),
g AS (SELECT rid, unit, place, {grams} AS b FROM (SELECT rid, unit, place, {norm.format("x")} AS ws FROM u)),
m AS (SELECT rid, unit, place, licence, len(list_intersect(g.b, tpl.b)) AS shared, len(g.b) + len(tpl.b) AS total FROM g JOIN tpl
  ON len(tpl.b) * 120 >= len(g.b) * 80 AND len(g.b) * 120 >= len(tpl.b) * 80),
k AS (SELECT rid, count(*) AS n, arg_max(licence, row(2.0::DOUBLE * shared / total, licence)) AS licence, max(2.0::DOUBLE * shared / total) AS dice,
  string_agg(x, ',' ORDER BY x) AS matches FROM (SELECT *, unit || ':' || place || ':' || licence || ':' || shared || ':' || total AS x FROM m WHERE 200 * shared >= 80 * total) GROUP BY rid),
n AS (SELECT rid, len(b) AS n_bigrams FROM g WHERE unit = 'text')
SELECT doc_id, n_bigrams::BIGINT AS n_bigrams, coalesce(n, 0)::BIGINT AS n_matches, licence, round(dice, 6) AS dice, coalesce(matches, '') AS matches
FROM d JOIN n USING (rid) LEFT JOIN k USING (rid)"""


OP4_SQL = _sql()
