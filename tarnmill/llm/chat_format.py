"""Chat formatting [native]: a declarative template, a turn-order automaton, segments with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import let


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of each role, which roles bear loss, and the automaton over roles.

    ``marks``: role -> (prefix, suffix). A role without marks gets ``other``, whose prefix holds the role's name
    between its two parts. ``transitions``: (state, role) -> state; a missing pair is an error from which the
    automaton does not recover. ``escapes``: character -> letter; each such character inside a text becomes a
    backslash and the letter. The keys must be the backslash and the first character of every mark, so no mark can
    occur inside an escaped text; that is checked.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
    )
    other: tuple[str, str, str] = ("<<ROLE:", ">>", "<</ROLE>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked", ("asked", "tool"): "asked", ("answered", "tool"): "asked",
        }
    )
    escapes: dict[str, str] = field(default_factory=lambda: {"\\": "e", "<": "l", "[": "b", ">": "g"})

    def __post_init__(self) -> None:
        for mark in [m for pair in self.marks.values() for m in pair] + [self.other[0], self.other[2]]:
            if mark.strip()[0] not in self.escapes:
                raise ValueError(f"the first character of {mark!r} is not escaped")
        if self.other[1][0] not in self.escapes or next(iter(self.escapes)) != "\\":
            raise ValueError("escapes must begin with the backslash and cover the end of the other roles' prefix")

    def escape(self, text: Column) -> Column:
        for char, letter in self.escapes.items():
            text = F.replace(text, F.lit(char), F.lit("\\" + letter))
        return text

    def unescape(self, text: Column) -> Column:
        for char, letter in reversed(self.escapes.items()):
            text = F.replace(text, F.lit("\\" + letter), F.lit(char))
        return text

    def prefix(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1]))
        for name, (before, _) in self.marks.items():
            out = F.when(role == name, F.lit(before)).otherwise(out)
        return out

    def suffix(self, role: Column) -> Column:
        out = F.lit(self.other[2])
        for name, (_, after) in self.marks.items():
            out = F.when(role == name, F.lit(after)).otherwise(out)
        return out

    def turn_pattern(self) -> str:
        """Regex of one formatted turn: group 1 the prefix, 2 another role's escaped name, 3 the escaped text."""
        free = "[^" + "".join("\\" + c for c in self.escapes if c != "\\") + "]*"
        prefixes = "|".join([*(re.escape(p) for p, _ in self.marks.values()), f"{re.escape(self.other[0])}({free}){re.escape(self.other[1])}"])
        suffixes = "|".join(re.escape(s) for s in [*(s for _, s in self.marks.values()), self.other[2]])
        return f"({prefixes})({free})(?:{suffixes})"


def format_conversations(
    df: DataFrame, template: ChatTemplate = ChatTemplate(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``segments`` and what the automaton says.

    ``segments`` is an array of (text, loss): prefix, escaped text and suffix of each turn; their concatenation is
    ``formatted``. Only the text of a turn whose role bears loss has the flag. ``valid`` tells whether the automaton
    ended in an accepting state; ``state`` is that state, or "error". Invalid conversations are returned too, so
    that the caller decides.

    One shuffle by conversation with SQL expressions only. A conversation is one output string, so its rows must
    meet; nothing else is grouped.

    Defined cases: rows are ordered by turn, then role and text (ties and repeated rows have a fixed order; repeated
    rows are separate turns); a null turn comes first; null text or role counts as empty; a null id is a
    conversation of its own; other columns are dropped; an empty table gives an empty table.
    """
    rows = df.select(
        F.col(id_col).alias(id_col),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(template.prefix(t["role"]).alias("text"), F.lit(False).alias("loss")),
                F.struct(template.escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(template.suffix(t["role"]).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    steps = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state} {role}", to)])
    state = F.aggregate(
        F.transform("turns", lambda t: t["role"]), F.lit(template.start), lambda s, role: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(" "), role)), F.lit("error"))
    )
    out = turns.select(id_col, segments.alias("segments"), state.alias("state"))
    return out.select(
        id_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*template.accepting).alias("valid")
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns, array of (role, text), read back from a formatted string."""
    pattern = F.lit(template.turn_pattern())
    parts = [F.regexp_extract_all(formatted, pattern, F.lit(k)) for k in (1, 2, 3)]

    def role(prefix: Column, other: Column) -> Column:
        out = template.unescape(other)
        for name, (before, _) in template.marks.items():
            out = F.when(prefix == before, F.lit(name)).otherwise(out)
        return out

    return F.transform(
        F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "pot")]), lambda x: F.struct(role(x["p"], x["o"]).alias("role"), template.unescape(x["t"]).alias("text"))
    )


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    template = ChatTemplate()
    out = format_conversations(rows.unionByName(extra), template)
    out = out.select(
        "conv_id", "valid", F.char_length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted"), template).alias("turns"),
        template.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss_text"),
    )
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c),
e AS (SELECT *, length(x) + length(regexp_replace(x, '[^<\[>\\]', '', 'g')) AS xe, length(r) + length(regexp_replace(r, '[^<\[>\\]', '', 'g')) AS re,
  coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY turn, r, x), '^') AS before FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(xe + CASE r WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 18 + re END)::BIGINT AS formatted_chars,
  bool_and((before || ' ' || r) IN ('^ system', '^ user', 'system user', 'user assistant', 'assistant user', 'user tool', 'tool assistant', 'tool tool', 'assistant tool'))
    AND arg_max(r, row(turn, r, x)) = 'assistant' AS valid
FROM e GROUP BY conv_id"""
