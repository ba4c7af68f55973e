"""Trie of the turn prefixes of conversations, merged family by family."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm.common import materialise, text_or_empty

#: Conversations of a family, and the turns of its base with which a member may begin.
FAMILY, HEADS = 20, 4
#: Most nodes that are broadcast as the frequent ones, and the least families that make one.
FREQUENT, OFTEN = 50_000, 64
#: Families whose ends of a node are joined to one piece of text.
SPAN = 1024

WORD = r"[^\x20\x09-\x0D]+"
ROOT = b"\0" * 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _fields(text: str) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in ((n, {"long": T.LongType(), "bytes": T.BinaryType(), "flag": T.BooleanType(), "longs": T.ArrayType(T.LongType())}[k]) for n, k in (x.split() for x in text.split(",")))])


NODES = _fields("base long,node bytes,parent bytes,depth long,conv long,n long,words long,below long,child flag,ends longs")
PARTIALS = _fields("node bytes,conv long,depth long,parent_conv long,n long,below long,children long,leaves long,inside long")


def _to_arrow(rows: list[tuple], schema: T.StructType) -> pa.Table:
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def conversation_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, family: int) -> DataFrame:
    """(base, conv, turn, role, digest, words) per row: a digest of role and text stands for both from here on."""
    c, r, t = F.col(conv).cast("long"), text_or_empty(F.col(role).cast("string")), text_or_empty(F.col(text).cast("string"))
    digest = F.unhex(F.md5(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    return df.filter(F.col(conv).isNotNull()).select(
        (c - c % family).alias("base"), c.alias("conv"), F.col(turn).alias("turn"), r.alias("role"), digest.alias("digest"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words")
    )


def family_nodes(turns: DataFrame, heads: int) -> DataFrame:
    """The nodes of each family's trie: conversations with the same base id are grouped, rebuilt and merged there.

    n: members within the family; conv: the least of them; below: words of their turns from this one on, summed
    over the members; ends: the members that end here; child: whether any goes on.
    """

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("conv", "turn", "role", "digest")], null_placement="at_start")
        own: dict[int, list] = {}
        for c, digest, words in zip(*(table.column(x).take(order).to_pylist() for x in ("conv", "digest", "words"))):
            own.setdefault(c, []).append((digest, words))
        base = key[0].as_py()
        first, nodes = own.get(base, []), {}
        for c in sorted(own):
            h = zlib.crc32(str(c).encode()) % heads
            path = first[:h] + own[c][h:]
            below, node, parent, depth, words = sum(w for _, w in path), ROOT, None, 0, 0
            for step in [*path, None]:
                at = nodes.setdefault(node, [base, node, parent, depth, c, 0, words, 0, False, []])
                at[5] += 1
                at[7] += below
                if step is None:
                    at[9].append(c)
                else:
                    at[8] = True
                    below -= words
                    parent, words = node, step[1]
                    node, depth = hashlib.md5(node + step[0]).digest(), depth + 1
        return _to_arrow([tuple(n) for n in nodes.values()], NODES)

    return turns.groupBy("base").applyInArrow(build, NODES)


def with_owner(nodes: DataFrame) -> DataFrame:
    """The family nodes with what all families together say of each: its least member (owner), members (n_all), words
    below (below_all) and whether anything goes on (goes_on).

    Facts combine before they move. The nodes that very many families have (the root, frequent first turns) are few,
    as their number is at most that of all rows divided by the least count of one; only they are broadcast, and the
    others are joined by node.
    """
    facts = materialise(
        nodes.groupBy("node").agg(
            F.min("conv").alias("owner"), F.sum("n").alias("n_all"), F.sum("below").alias("below_all"), F.bool_or("child").alias("goes_on"), F.count(F.lit(1)).alias("_families")
        ),
        "trie-facts",
    )
    total = facts.agg(F.sum("_families")).first()[0] or 0
    often = max(OFTEN, total // FREQUENT)
    hot, cold = facts.filter(F.col("_families") > often).drop("_families"), facts.filter(F.col("_families") <= often).drop("_families")
    known = nodes.join(F.broadcast(hot), "node")
    return known.unionByName(nodes.join(F.broadcast(hot.select("node")), "node", "left_anti").join(cold, "node"))


def family_sums(owned: DataFrame) -> DataFrame:
    """(node, children, leaves, inside, ...) for each family node: what the nodes that the family owns add to it.

    A node is owned by the family of its least member, so each counts once; the owner's path, and so every node above,
    is in the same family. ``inside``: words of the owned nodes of the subtree. The facts of a node come from its owner.
    """

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: -r["depth"])
        owner, out = {r["node"]: r["owner"] for r in rows}, {r["node"]: [0, 0, 0] for r in rows}
        made = []
        for r in rows:
            mine, sums = r["conv"] == r["owner"], out[r["node"]]
            if mine:
                sums[1] += not r["goes_on"]
                sums[2] += r["words"]
            if r["parent"] is not None:
                above = out[r["parent"]]
                above[0] += mine
                above[1] += sums[1]
                above[2] += sums[2]
            facts = (r["owner"], r["depth"], owner.get(r["parent"]), r["n_all"], r["below_all"]) if mine else (None,) * 5
            made.append((r["node"], *facts, *sums))
        return _to_arrow(made, PARTIALS)

    slim = owned.select("base", "node", "parent", "depth", "conv", "owner", "n_all", "below_all", "words", "goes_on")
    return slim.groupBy("base").applyInArrow(add_up, PARTIALS)


def end_digests(nodes: DataFrame, family: int) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end: of their ids in ascending order, comma-joined.

    A family's ids are ascending and lie between those of its neighbours, so they are joined to text by family, then by
    ``SPAN`` families; a task then runs over the few pieces of a node in order and keeps only the state of a digest.
    """
    named = nodes.filter(F.size("ends") > 0).select(
        "node", "base", F.floor(F.col("base") / F.lit(family * SPAN)).alias("span"), F.concat_ws(",", F.col("ends").cast("array<string>")).alias("ids")
    )
    pieces = named.groupBy("node", "span").agg(F.array_sort(F.collect_list(F.struct("base", "ids"))).alias("ids")).select("node", "span", F.array_join("ids.ids", ",").alias("ids"))
    arrow = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches):
        node = state = None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n == node:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(arrow)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=arrow)

    return pieces.repartition("node").sortWithinPartitions("node", "span").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, heads: int = HEADS
) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations.

    A conversation c is rebuilt as the first h turns of conversation c - c % family and its own turns from the
    (h + 1)-th on, with h = crc32(decimal c) % heads. A node is a sequence of d turns (role, text); those that begin with it
    are its members. Columns: conv_id (least member), depth d, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree: members but one, times the words of the last turn) and
    ends_sha256 (of the ids of members of d turns).

    1. Turns become digests and word counts in the JVM. One shuffle by base id brings a family together; it is
       rebuilt there and merged to a small trie (``family_nodes``).
    2. Only the families' combined nodes are shuffled and merged to global facts; the least member of a node makes its
       family the owner (``with_owner``).
    3. Subtree sums are taken within families over the nodes that they own, and the partial sums are added by node:
       there is no job for each level, however long the conversations are (``family_sums``).

    A group is one family: ``family`` conversations with their turns as digests; texts are not in it.

    Defined cases: rows with a null id belong to no conversation and are dropped; turns are ordered with null first, equal
    ones by role and a digest of role and text; a null role or text is empty; repeated rows are turns of their own;
    negative ids belong to the base towards zero (-7 to 0); a conversation whose rebuilt form has no turn is
    a member of the root; other columns are dropped; an empty table has no root and gives an empty table.
    """
    turns = conversation_turns(df, conv_col, turn_col, role_col, text_col, family)
    nodes = materialise(family_nodes(turns, heads), "trie-families")
    sums = family_sums(with_owner(nodes))
    merged = sums.groupBy("node").agg(
        *(F.max(c).alias(c) for c in ("conv", "depth", "parent_conv", "n", "below")), *(F.sum(c).alias(c) for c in ("children", "leaves", "inside"))
    )
    out = merged.join(end_digests(nodes, family), "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("below") - F.col("inside")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``; cases as in ``prefix_trie``."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS b, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda a, step: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM (
  SELECT ids.c, 0 AS own, i, k, w FROM ids JOIN t ON t.c = ids.b AND i < h UNION ALL SELECT ids.c, 1, i, k, w FROM ids JOIN t ON t.c = ids.c AND i >= h)),
m AS (SELECT c, d, w, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM r UNION ALL SELECT c, 0, 0, '' FROM ids),
l AS (SELECT c, max(d) AS d FROM m GROUP BY c),
n AS (SELECT node, min(c) AS c, min(d) AS d, count(*) AS n_convs, min(w) AS w FROM m GROUP BY node),
p AS (SELECT n.*, a.node AS parent FROM n LEFT JOIN m a ON a.c = n.c AND a.d = n.d - 1),
k AS (SELECT parent, count(*) AS n FROM p GROUP BY parent),
s AS (SELECT a.node, sum((u.n_convs - 1) * u.w)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM n u LEFT JOIN k ON k.parent = u.node JOIN m a ON a.c = u.c AND a.d <= u.d GROUP BY a.node),
e AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM m JOIN l USING (c, d) GROUP BY node)
SELECT p.c AS conv_id, p.d::BIGINT AS depth, q.c AS parent_conv_id, p.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM p LEFT JOIN n q ON q.node = p.parent LEFT JOIN k ON k.parent = p.node JOIN s ON s.node = p.node LEFT JOIN e ON e.node = p.node"""
