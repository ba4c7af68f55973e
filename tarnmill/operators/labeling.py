"""Rule labels from report text: assertion, denial, negation and hedge per sentence, folded to one label per target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import text as tx
from tarnmill.functions.finding_rules import HEDGES, NEGATIONS, FindingRule, rule_table


def any_of(patterns: Sequence[str]) -> str:
    """Case-insensitive alternation, Unicode-aware in Java; a dot matches all but a line feed."""
    return "(?iud)(" + "|".join(patterns) + ")"


#: Java lets i match the Turkish i without a dot, SQL does not: there it is this character, in texts and patterns.
DOTLESS, APART = "\u0131", "\ufdd0"


def label_reports(
    df: DataFrame, id_col: str, text_col: str, rules: Sequence[FindingRule] | None = None, negations: Sequence[str] = NEGATIONS, hedges: Sequence[str] = HEDGES, fold_accents: bool = True,
    silent: bool = True, as_sql: bool = False,
) -> DataFrame:
    """(id, target, label): 1 if a sentence asserts the finding without hedge or negation, else 0 if one denies it,
    else null.

    Sentences are exploded, so each pattern sees a short string; the rules, of fixed number, are columns of the plan
    and not a joined table. Most sentences name no anatomy, so a rule's patterns run only behind its gate, and negations
    and hedges only behind an assertion. The gates themselves run only on sentences that hold one of their literals, if
    these are known and the sentence is ASCII, so that no folding but that of A-Z counts. Flags are combined per report before the shuffle, and become rows after it. With ``fold_accents`` the sentences,
    not the rules, lose their accents, so accented rules cannot match, as is the convention of the rule tables.

    Null and empty texts give null labels; every report has a row for each target. Without ``silent`` those in which no
    sentence is have none. ``as_sql`` reads blanks and the i without a dot as the patterns of SQL do.
    """
    rules = rule_table() if rules is None else rules
    normal = tx.normalize_text(F.col(text_col), fold_accents, tx.SQL_BLANK if as_sql else r"\s")
    if as_sql:
        normal = F.replace(normal, F.lit(DOTLESS), F.lit(APART))
    sentence = (F.explode_outer if silent else F.explode)(tx.sentences(tx.strip_accents(normal) if fold_accents else normal))
    s = F.col("s")
    has = lambda patterns: s.rlike(any_of([p.replace(DOTLESS, APART) for p in patterns] if as_sql else patterns))
    gates = [r.gate for r in rules]
    rows = df.select(F.col(id_col), sentence.alias("s"))
    named = has(gates) if all(gates) else s.isNotNull()
    if all(gates) and all(r.stems for r in rules):
        stems = {x for r in rules for x in r.stems if x.isascii()}
        least = sorted(x for x in stems if not any(y in x for y in stems - {x}))  # what holds a longer one holds these
        rows = rows.withColumn("_tm_low", F.lower(s))
        named = ((F.octet_length(s) > F.char_length(s)) | reduce(or_, (F.col("_tm_low").contains(x) for x in least), F.lit(False))) & named
    rows = rows.select(F.col(id_col), "s", named.alias("named"))
    flags = []
    for k, r in enumerate(rules):
        here = F.col("named") & has([r.gate]) if r.gate else F.col("named")
        asserted = F.when(here & has(r.asserts), ~has(hedges) & ~has(negations))
        flags += [F.max(F.coalesce(asserted, F.lit(False))).alias(f"pos{k}"), F.max(F.coalesce(here & has(r.denies), F.lit(False))).alias(f"neg{k}")]
    found = rows.groupBy(id_col).agg(*flags)
    labels = F.array(*[
        F.struct(F.lit(r.target).alias("target"), F.when(F.col(f"pos{k}"), 1.0).when(F.col(f"neg{k}"), 0.0).alias("label")) for k, r in enumerate(rules)
    ])
    return found.select(id_col, F.explode(labels).alias("f")).select(id_col, "f.target", "f.label")


def polarity(uncertain: Column, negative: Column, normal: Column, severe: Column) -> Column:
    """What a clause says of a finding: doubt comes before denial, and denial before normality, which denies too unless a
    severe sign stands beside it."""
    return F.when(uncertain, "uncertain").when(negative | (normal & ~severe), "negative").otherwise("positive")


#: Fixed values of graded scores: weights of a strong, a weak and a plain mention, factors of contexts, weight of doubt.
STRONG, WEAK, PLAIN, PENALTY, BONUS, DOUBT = 1.0, 0.45, 0.75, 0.45, 1.35, 0.30


@dataclass(frozen=True)
class GradedRule:
    """Patterns of one graded finding. A clause counts if it names the anatomy and, where one is given, the pathology, and
    no decoy. Without the pathology it denies if it says normal and nothing else does. ``penalty`` and ``bonus`` are contexts."""

    target: str
    anatomy: str
    uncertain: str
    negative: str
    normal: str
    severe: str
    high: str
    low: str
    pathology: str | None = None
    decoy: str | None = None
    penalty: str | None = None
    bonus: str | None = None


def graded_score(best: Column, n_pos: Column, n_neg: Column, n_unc: Column) -> Column:
    """Struct (score, confidence) from the strongest mention and the numbers of clauses. Slopes and caps."""
    found = F.struct(
        F.least(F.lit(0.95), 0.50 + 0.42 * best + 0.03 * F.least(n_pos, F.lit(3))).alias("score"), F.least(F.lit(1.0), 0.55 + 0.15 * n_pos).alias("confidence")
    )
    denied = F.struct(F.greatest(F.lit(0.04), 0.20 - 0.04 * n_neg).alias("score"), F.least(F.lit(0.9), 0.45 + 0.12 * n_neg).alias("confidence"))
    silent = F.struct(F.lit(0.28).alias("score"), F.lit(0.05).alias("confidence"))
    return F.when(n_pos + n_unc > 0, found).when(n_neg > 0, denied).otherwise(silent)


def graded_labels(df: DataFrame, id_col: str, text: Column, rule: GradedRule) -> DataFrame:
    """(id, target, n_pos, n_neg, n_unc, score, confidence) of one finding from the clauses of each text.

    Mentions are graded by strength and context, and the strongest counts; denials matter only where nothing is asserted
    or in doubt; silence has a score of its own. Clauses are exploded and combined per id before they move. Null and
    empty texts are silent; rows that share an id are one text.
    """
    c = F.col("_tm_c")
    has = lambda p: c.rlike(p) if p else F.lit(False)
    rows = df.select(id_col, F.explode(tx.clauses(text)).alias("_tm_c")).filter(has(rule.anatomy) & ~has(rule.decoy))
    named = has(rule.pathology) if rule.pathology else F.lit(True)
    kind = F.when(named, polarity(has(rule.uncertain), has(rule.negative), has(rule.normal), has(rule.severe))).when(has(rule.normal) & ~has(rule.negative), "negative")
    strength = F.when(has(rule.high) & ~has(rule.low), STRONG).when(has(rule.low) & ~has(rule.high), WEAK).otherwise(PLAIN)
    strength = strength * F.when(has(rule.penalty), PENALTY).otherwise(1.0)
    strength = F.when(has(rule.bonus), F.least(F.lit(1.0), strength * BONUS)).otherwise(strength)
    marked = rows.select(id_col, kind.alias("_tm_k"), F.when(kind == "positive", strength).when(kind == "uncertain", DOUBT).alias("_tm_w"))
    count = lambda k: F.sum((F.col("_tm_k") == k).cast("long"))
    found = marked.groupBy(id_col).agg(F.max("_tm_w").alias("_tm_best"), count("positive").alias("p"), count("negative").alias("n"), count("uncertain").alias("u"))
    n_pos, n_neg, n_unc = (F.coalesce(x, F.lit(0)) for x in "pnu")
    both = df.select(id_col).distinct().join(found, id_col, "left").withColumn("_tm_s", graded_score(F.coalesce("_tm_best", F.lit(0.0)), n_pos, n_neg, n_unc))
    return both.select(
        id_col, F.lit(rule.target).alias("target"), n_pos.alias("n_pos"), n_neg.alias("n_neg"), n_unc.alias("n_unc"),
        F.round("_tm_s.score", 6).alias("score"), F.round("_tm_s.confidence", 6).alias("confidence"),
    )


def cross_target_fix(wide: DataFrame) -> DataFrame:
    """A global statement fills silent compartments, and silent synovitis follows effusion. 0.28, 0.45."""
    silent = lambda c: F.abs(F.col(c) - 0.28) < 1e-9
    for c in ("medial_oa", "lateral_oa", "pf_oa"):
        wide = wide.withColumn(c, F.when(silent(c) & (F.col("global_oa") > 0.5), F.col("global_oa")).otherwise(F.col(c)))
    inherited = 0.28 + 0.45 * (F.col("effusion") - 0.28)
    return wide.withColumn("synovitis", F.when(silent("synovitis"), inherited).otherwise(F.col("synovitis")))
