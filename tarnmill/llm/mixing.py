"""Mixing sources to target weights: temperature by bisection, exact token budgets, block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import BLANK_RUN, materialise, text_or_empty

#: Bisection levels that one Spark job evaluates: the 2**LEVELS - 1 midpoints of the next LEVELS halvings.
LEVELS = 5


def token_count(text: Column) -> Column:
    """Runs of other characters than blanks."""
    return F.size(F.array_remove(F.split(text_or_empty(text), BLANK_RUN, -1), "")).cast("long")


def bisected(rises, steps: int) -> tuple[float, float]:
    """The ends of the interval of [0, 1] that ``steps`` halvings leave; ``rises`` tells for each of a list of
    exponents whether the wanted one is larger, and is asked for all midpoints of some levels at once."""
    low, high, done = 0.0, 1.0, 0
    while done < steps:
        levels = min(LEVELS, steps - done)
        at, size = 0, 1 << levels
        answers = rises([low + (high - low) * k / size for k in range(1, size)])
        cells = size
        while size > 1:  # the halvings, each by its midpoint
            size //= 2
            if answers[at + size - 1]:
                at += size
        low, high = low + (high - low) * at / cells, low + (high - low) * (at + 1) / cells
        done += levels
    return low, high


def bisect_exponent(sources: DataFrame, target_entropy: float | None, max_repetition: float | None, steps: int = 30) -> float:
    """The exponent a in [0, 1] for weights share**a / sum(share**a) over ``sources`` (tokens > 0).

    ``target_entropy``, a fraction of log(number of sources): the largest a whose weights have at least this
    entropy. ``max_repetition``: the smallest a with which the source that is repeated most is repeated at most so
    many times as the one repeated least. Both measures fall as a rises, so bisection finds the bound; if a = 1 has
    the entropy, or a = 0 keeps the limit, that end is the answer. With both, the limit holds before the entropy: the
    larger a is taken.

    For the entropy, each job is one aggregate over the source table that returns a row for each of 31 exponents;
    repetition needs only the largest and the smallest source. No table of sources reaches the driver.
    """
    total, largest, smallest, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(total)))

    def enough_entropy(points: list[float]) -> list[bool]:
        term = F.exp(F.col("a") * F.col("l"))
        rows = (
            sources.select(log_share.alias("l"), F.explode(F.array(*map(F.lit, points))).alias("a"))
            .groupBy("a").agg(F.sum(term).alias("z"), F.sum(term * F.col("a") * F.col("l")).alias("s")).collect()
        )
        entropy = {r["a"]: math.log(r["z"]) - r["s"] / r["z"] for r in rows}
        return [entropy[a] >= target_entropy * math.log(n) for a in points]

    def repeats_too_much(points: list[float]) -> list[bool]:
        return [(1 - a) * math.log(largest / smallest) > math.log(max_repetition) for a in points]

    found = []
    if target_entropy is not None:
        found.append(1.0 if enough_entropy([1.0])[0] else bisected(enough_entropy, steps)[0])
    if max_repetition is not None:
        found.append(bisected(repeats_too_much, steps)[1] if repeats_too_much([0.0])[0] else 0.0)
    return max(found)


def source_budgets(sources: DataFrame, exponent: float, budget_tokens: int | None) -> DataFrame:
    """(source, n_docs, tokens, weight, budget): budgets are whole tokens.

    ``budget_tokens`` is dealt by weight. None is the smallest total with which no source gets fewer tokens than it
    has, so that every document appears at least once. A source without tokens has weight 0 and budget 0.
    """
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(F.lit(0.0))
    z, need = sources.agg(F.sum(power), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / power))).first()
    total = F.lit(float(budget_tokens) if budget_tokens is not None else (z or 0.0) * (need or 0.0))
    weight = power / F.lit(z or 1.0)
    budget = F.round(weight * total).cast("long")
    if budget_tokens is None:
        budget = F.greatest(budget, F.col("tokens"))
    return sources.select("source", "n_docs", "tokens", weight.alias("weight"), budget.alias("budget"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, max_repetition: float | None = None,
    budget_tokens: int | None = None, block_tokens: int = 1 << 20, seed: int = 0, bucket_docs: int = 4096,
) -> DataFrame:
    """The schedule of the mixed corpus: one row for each time that a document is emitted.

    Returns (id, source, th, copies, n_tokens, epoch, block, pos); th is the hash of the text, copies the number of
    equal rows. ``target_entropy``, ``max_repetition``
    or both set the exponent (see ``bisect_exponent``). Each source has a stream: pass after pass over its documents, each
    pass a new pseudo-random permutation, cut where the source's budget is reached. A document that begins within
    the budget is emitted whole, so a source's tokens pass its budget by less than one document; every first pass is
    whole if ``budget_tokens`` is None. The streams are dealt to ceil(total budget / ``block_tokens``) blocks so that each
    block has its share of each source, and a block's documents are permuted again: ``pos`` counts from 0 in it.

    A stream's places are prefix sums of tokens, and a source may hold a third of all rows, so they are taken in
    two levels: over buckets of a source by hash (about ``bucket_docs`` documents each, from the source's count),
    then within a bucket. The only group that grows is the list of one source's bucket totals, one small row for
    each ``bucket_docs`` documents. Text is never moved.

    Rows that are equal in id, source and text are one group: they share their places. Defined cases: a null source
    is a source; null text has no tokens; documents without tokens are emitted once in each pass that reaches them,
    and those of a source without tokens once, in block 0; ties of the permutation key go by id, then by text hash;
    an empty table gives an empty table.
    """
    if target_entropy is None and max_repetition is None:
        raise ValueError("give target_entropy, max_repetition or both")
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("th"), token_count(F.col(text_col)).alias("n_tokens"))
    groups = materialise(rows.groupBy("id", "source", "th").agg(F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("copies")), "mix-docs")
    sources = materialise(groups.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    exponent = bisect_exponent(sources.filter("tokens > 0"), target_entropy, max_repetition)
    budgets = source_budgets(sources, exponent, budget_tokens)
    total_budget = budgets.agg(F.sum("budget")).first()[0] or 0
    n_blocks = max(1, math.ceil(total_budget / block_tokens))
    plan = budgets.select(
        F.col("source").alias("_tm_source"), "tokens", "budget",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_docs)).cast("long").alias("n_buckets"),
        F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.ceil(F.col("budget") / F.col("tokens")))).otherwise(F.lit(1)).cast("int").alias("passes"),
    )
    copies = (
        groups.join(plan, F.col("source").eqNullSafe(F.col("_tm_source"))).drop("_tm_source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
        .withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("n_buckets") / F.lit(1 << 32)).cast("long"))
        .withColumn("own", F.col("n_tokens") * F.col("copies"))
    )
    # the buckets' places are whole-pass offsets: one row for each bucket
    totals = copies.groupBy("source", "epoch", "bucket").agg(F.sum("own").alias("bucket_tokens"))
    ahead = totals.select(
        F.col("source").alias("b_source"), F.col("epoch").alias("b_epoch"), F.col("bucket").alias("b_bucket"),
        (F.sum("bucket_tokens").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("bucket_tokens")).alias("ahead"),
    )
    within = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "id", "th")
    placed = copies.withColumn("within", F.sum("own").over(within) - F.col("own")).join(
        ahead, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("bucket") == F.col("b_bucket"))
    )
    offset = F.col("epoch") * F.col("tokens") + F.col("ahead") + F.col("within")
    emitted = placed.withColumn("offset", offset).filter((F.col("offset") < F.col("budget")) | ((F.col("epoch") == 0) & ((F.col("tokens") == 0) | F.lit(budget_tokens is None))))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    block = F.when(
        F.col("budget") > 0, F.least(F.lit(n_blocks - 1), F.floor(whole("offset") * F.lit(n_blocks) / F.greatest(whole("budget"), F.lit(1))).cast("long"))
    ).otherwise(F.lit(0)).cast("long")
    dealt = emitted.withColumn("block", block).withColumn("order", F.md5(F.concat_ws(":", F.lit(f"{seed}.block"), F.col("block").cast("string"), "key")))
    pos = F.row_number().over(Window.partitionBy("block").orderBy("order", "source", "id", "th")) - 1
    return dealt.select("id", "source", "th", "copies", "n_tokens", "epoch", "block", pos.cast("long").alias("pos"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Weights of 0.998 of the largest entropy, as far as no source is repeated over 4 times; every document at least once; blocks of 2**20 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    schedule = mix_sources(docs, target_entropy=0.998, max_repetition=4.0)
    each = schedule.withColumn("_tm_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(F.col("id").alias("doc_id"), "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "block", "pos")


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source),
sh AS (SELECT ln(tokens / (SELECT sum(tokens)::DOUBLE FROM s)) AS l FROM s WHERE tokens > 0),
e1 AS (SELECT -sum(exp(l) * l) >= 0.998 * ln(count(*)) AS even FROM sh),
bis AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL SELECT step + 1, CASE WHEN up THEN (low + high) / 2 ELSE low END, CASE WHEN up THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high, (SELECT ln(sum(exp((low + high) / 2 * l))) - sum(exp((low + high) / 2 * l) * (low + high) / 2 * l) / sum(exp((low + high) / 2 * l)) >= 0.998 * ln(count(*)) FROM sh) AS up
    FROM bis WHERE step < 30)),
r AS (SELECT ln(max(tokens) / min(tokens)::DOUBLE) AS span FROM s WHERE tokens > 0),
rep AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL SELECT step + 1, CASE WHEN (1 - (low + high) / 2) * span > ln(4) THEN (low + high) / 2 ELSE low END,
    CASE WHEN (1 - (low + high) / 2) * span > ln(4) THEN high ELSE (low + high) / 2 END FROM rep, r WHERE step < 30),
a AS (SELECT greatest((SELECT CASE WHEN (SELECT even FROM e1) THEN 1.0 ELSE low END FROM bis WHERE step = 30),
  (SELECT CASE WHEN span > ln(4) THEN high ELSE 0.0 END FROM rep, r WHERE step = 30)) AS a),
p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) ELSE 0 END AS w FROM s, a),
t AS (SELECT sum(w) * max(CASE WHEN tokens > 0 THEN tokens / w END) AS total, sum(w) AS z FROM p),
b AS (SELECT source, tokens, greatest(round(w / z * total)::BIGINT, tokens) AS budget FROM p, t),
nb AS (SELECT greatest(1, ceil(sum(budget) / 1048576.0))::BIGINT AS n_blocks FROM b),
c AS (SELECT id, d.source, n, tokens, budget, unnest(range(greatest(1, ceil(budget / tokens::DOUBLE)::BIGINT))) AS epoch FROM d JOIN b ON d.source = b.source),
k AS (SELECT *, md5('0:' || epoch || ':' || id) AS key FROM c),
o AS (SELECT *, epoch * tokens + sum(n) OVER (PARTITION BY source, epoch ORDER BY key, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS off FROM k),
f AS (SELECT *, least(n_blocks - 1, (off::HUGEINT * n_blocks) // greatest(budget, 1))::BIGINT AS block FROM o, nb WHERE off < budget OR epoch = 0)
SELECT id AS doc_id, source, n AS n_tokens, epoch::BIGINT AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('0.block:' || block || ':' || key), source, id) - 1 AS pos FROM f"""
