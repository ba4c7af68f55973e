"""Exact n-gram Jaccard join: block-skipping index lists, answers of a set derived from those of a similar one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm import near_dedup as nd
from tarnmill.llm import textbytes as tb
from tarnmill.llm.common import materialise
from tarnmill.llm.graph import connected_components

#: Percent of the share of a set that may differ by which its head is longer than the prefix that a pair must share.
EXTRA = 50
#: Elements of heads that are intersected at once.
HEAD_ELEMENTS = 1 << 18


def head_size(n: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(q, e) of sets of n elements: their head is the q least hashed elements, of which a partner shares at least e.

    With the prefix length n - ceil(t n) + 1 a partner shares one element of it; a head that is longer by e shares so many
    more, so a set whose head has fewer elements in common with others has no partner.
    """
    e = -(-(100 - threshold) * EXTRA * n // 10_000)
    return np.minimum(n, n + threshold * -n // 100 + 1 + e), np.maximum(1, np.minimum(n, e))


def text_heads(df: DataFrame, id_col: str, text_col: str, width: int, threshold: int) -> DataFrame:
    """(id, n, k1, k2, head, least) of each row: set size, a 128-bit key of the set, the head, its least common share."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    long = T.LongType()
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, long) for c in ("n", "k1", "k2")), T.StructField("head", T.ArrayType(long)), T.StructField("least", long)]
    )
    arrow = to_arrow_schema(schema)
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))

    def run(batches):
        for batch in batches:
            for piece in tb.slices(batch, "text", nd.SIGN_BYTES):
                values, bounds = nd.shingle_sets(piece.column(1), width)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)]) for v in (values, tb.mix(values ^ np.uint64(0x5851F42D4C957F2D)))]
                    k1, k2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                n = np.diff(bounds)
                q, least = head_size(n, threshold)
                place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
                head = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(q)]).astype(np.int32)), signed(values[place < np.repeat(q, n)]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(arrow.field(0).type), pa.array(n.astype(np.int64)), signed(k1), signed(k2), head.cast(arrow.field(4).type), pa.array(least.astype(np.int64))], schema=arrow
                )

    return rows.mapInArrow(run, schema)


def common_needed(n_x: Column, spare_x: Column, n_y: Column, spare_y: Column, threshold: int) -> Column:
    """The elements that the heads of two similar sets share at least. ``spare``: size of a set less that of its head."""
    overlap = F.ceil(threshold * (n_x + n_y) / F.lit(100 + threshold))
    return F.greatest(F.lit(1), overlap - F.greatest(spare_x, spare_y))


def index_entries(heads: DataFrame, threshold: int) -> DataFrame:
    """(token, block, node, n, spare, c, left) from (node, n, head, least): the index lists, in blocks by size.

    Elements that only one head has are dropped, and so are sets with fewer common ones than a partner would share.
    The rest of a head is ordered by frequency, and its first c - least + 1 elements are posted; ``left`` counts those
    from a posting on. Sizes in a block differ by less than the threshold admits, and an entry is in the block of
    its size and the one below, so two sets that may be similar meet in a block of their list.
    """
    elements = heads.select("node", F.explode("head").alias("v"))
    often = elements.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # the count above 48 bits of the element, one number to move and to sort by
    ranked = F.shiftleft(F.least(F.col("df"), F.lit(32767)).cast("bigint"), 48).bitwiseOR(F.col("v").bitwiseAND(F.lit((1 << 48) - 1)))
    common = elements.join(often, "v").select("node", ranked.alias("v")).groupBy("node").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    facts = heads.select("node", "n", "least", (F.col("n") - F.size("head")).alias("spare"))
    posted = common.join(facts, "node").withColumn("c", F.size("vs").cast("long")).filter("c >= least")
    entries = posted.select("node", "n", "spare", "c", F.posexplode(F.slice("vs", 1, (F.col("c") - F.col("least") + 1).cast("int"))).alias("pos", "token"))
    size_class = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / threshold)) * (1 + 1e-9)))
    return entries.select("token", F.explode(F.array(size_class, size_class - 1)).alias("block"), "node", "n", "spare", "c", (F.col("c") - F.col("pos")).alias("left"))


def skipped(entries: DataFrame, threshold: int) -> DataFrame:
    """The entries that some other set in their block may be similar to.

    The directory of a block holds the sizes in it and its best position (most elements left). Over sizes from a to b
    the elements needed are least at an end, so an entry is skipped without reading the block if either its own
    position or the best one leaves fewer than both ends ask for.
    """
    t = threshold
    directory = entries.groupBy("token", "block").agg(
        F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.max("left").alias("most"), F.min("node").alias("_one"), F.max("node").alias("_other")
    ).filter("_one <> _other").drop("_one", "_other")
    kappa = max(0.0, (t - EXTRA * (100 - t) / 100) / 100)  # a head leaves out no more than this share of its set
    low, high = F.greatest(F.col("low_n"), F.col("n") * t / 100), F.least(F.col("high_n"), F.col("n") * 100 / t)
    asked = lambda m: (F.col("n") + m) * F.lit(t / (100 + t)) - F.greatest(F.col("n"), m) * F.lit(kappa)
    enough = F.least("left", "most") >= F.least(asked(low), asked(high)) - 1e-6
    return entries.join(directory, ["token", "block"]).filter((low <= high) & enough).select(entries.columns)


def _meets(threshold: int) -> Column:
    """Whether an entry and the hub of its block (columns with ``_2``) may be similar by size and position."""
    fits = 100 * F.least("n", "n_2") >= threshold * F.greatest("n", "n_2")
    return fits & (F.least("left", "left_2") >= common_needed(F.col("n"), F.col("spare"), F.col("n_2"), F.col("spare_2"), threshold))


def heads_agree(pairs: DataFrame, heads: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the pairs (a, b) whose heads share as much as similar sets do: all similar ones and few others."""
    side = lambda c: heads.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("head").alias(f"h_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    need = common_needed(F.col("n_a"), F.col("n_a") - F.size("h_a"), F.col("n_b"), F.col("n_b") - F.size("h_b"), threshold)
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            sizes = sum(c.value_lengths().to_numpy() for c in (batch.column(2), batch.column(3)))
            upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(upto, upto[at] + HEAD_ELEMENTS, "right")) - 1)
                piece = batch.slice(at, stop - at)
                value = np.concatenate([piece.column(k).flatten().to_numpy() for k in (2, 3)])
                pair = np.concatenate([np.repeat(np.arange(stop - at), piece.column(k).value_lengths().to_numpy()) for k in (2, 3)])
                order = np.lexsort((value, pair))
                value, pair = value[order], pair[order]
                shared = np.bincount(pair[1:][(value[1:] == value[:-1]) & (pair[1:] == pair[:-1])], minlength=stop - at)
                mask = pa.array(shared >= piece.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(mask).cast(arrow.field(0).type), piece.column(1).filter(mask).cast(arrow.field(1).type)], schema=arrow)
                at = stop

    return both.select("a", "b", "h_a", "h_b", need.alias("need")).mapInArrow(run, schema)


def block_meeting(rows: DataFrame, others: DataFrame, threshold: int) -> DataFrame:
    """The pairs of ``nd.meeting``, with the lists of ``others`` in blocks by position.

    A block holds the entries whose ``left`` lies between two powers of two; its directory holds the best position,
    the least s and the labels. A row reads only the blocks that these do not exclude.
    """
    blocked = others.withColumn("block", F.floor(F.log2(F.col("left_2"))).cast("int"))
    directory = blocked.groupBy("key", "d", "block").agg(F.max("left_2").alias("_most"), F.min("s_2").alias("_s"), F.min("label_2").alias("_low"), F.max("label_2").alias("_high"))
    may = (2 * (100 + threshold) * F.least("left", "_most") >= F.col("s") + F.col("_s")) & ((F.col("label") != F.col("_low")) | (F.col("label") != F.col("_high")))
    probes = rows.join(directory, ["key", "d"]).filter(may).drop("_most", "_s", "_low", "_high")
    enough = 2 * (100 + threshold) * F.least("left", "left_2") >= F.col("s") + F.col("s_2")
    return probes.join(blocked, ["key", "d", "block"]).filter((F.col("label") != F.col("label_2")) & enough & ~(F.col("related") & F.col("related_2")))


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per row: connected components of Jaccard similarity over word shingles, exact.

    1. Equal sets become one class, named by its least id. Each class has a head, its least hashed elements, for
       which a lower bound of what similar sets share holds (``head_size``, ``common_needed``); only heads are indexed.
    2. Index lists are in blocks by size; positions in the frequency order of the heads bound what two sets can still
       share, and entries for which the directory of their block admits no partner are skipped (``skipped``).
    3. The hub of a block, the set with most common elements, has its answers computed: each member that sizes,
       positions and heads admit is compared with it in full, and links contract the blocks.
    4. The answers of the other members are derived from the hub's: a member is its difference from the hub, and two
       members are similar exactly if their differences share enough (``near_dedup.difference_postings``). The lists
       of these differences are skipped in blocks by position as well (``block_meeting``); only pairs of different
       components that the bound admits are compared in full. Members unlike the hub are posted under their whole
       sets, within their family; a whole set is counted once, in however many families it is.

    No pair of a block is formed but with its hub or under a rare element of a difference; no list or partner is
    capped, and frequent elements come last in every order. Every pair of similar sets shares a block of a list, and so is met,
    derived or joined already; up to 64-bit hashes of shingles the result is exact.

    Defined cases: null text and text without words have no shingles, n_shingles 0, and are linked with nothing;
    shorter texts than ``width`` words have one shingle; repeated rows are equal sets and so one component; rows that
    share an id count as one document, whose rows are in one component; rows with a null id are linked with nothing
    and have a null component; other columns are dropped; an empty table gives an empty table.
    """
    smallest = max(1, -(-100 // (100 - threshold)) - 1) if threshold < 100 else 1 << 62  # smaller sets link only with their equals
    base = materialise(text_heads(df, id_col, text_col, width, threshold), "heads")
    named = base.filter("n > 0 AND id IS NOT NULL")
    classes = materialise(named.groupBy("k1", "k2", "n").agg(F.min("id").alias("node")), "classes")
    chosen = named.filter(F.col("n") >= smallest).groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.min_by(F.struct("head", "least"), "id").alias("h"))
    heads = materialise(chosen.select("node", "n", "h.head", "h.least"), "class-heads")  # heads move once

    entries = materialise(skipped(materialise(index_entries(heads, threshold), "entries"), threshold), "entries")
    hubs = entries.groupBy("token", "block").agg(F.max(F.struct("c", "node", "n", "spare", "left")).alias("h"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    hubs = hubs.select("token", "block", F.col("h.node").alias("hub"), *(F.col(f"h.{c}").alias(f"{c}_2") for c in ("n", "spare", "left")))
    lists = materialise(entries.join(hubs, ["token", "block"]).filter("node <> hub").select("token", "block", "node", "hub", _meets(threshold).alias("meets")), "lists")
    met = lists.filter("meets").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    posted = heads.join(entries.select("node").distinct(), "node", "left_semi")
    hits = materialise(heads_agree(met, posted, threshold).distinct(), "collisions")

    docs = df.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    wanted = materialise(hits.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    texts = materialise(nd.texts_of(docs, wanted), "texts")
    found = materialise(connected_components(materialise(nd.confirm_pairs(hits, texts, threshold, width), "links")), "components")

    open_lists = nd.still_open(nd.labelled(lists, found), ["token", "block"])
    related = hits.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("related"))
    family = open_lists.select("hub", "node", "label").distinct().join(related, ["hub", "node"], "left").withColumn("related", F.coalesce("related", F.lit(False)))
    family = materialise(family, "families")
    apart = materialise(nd.with_unlike(family), "apart")
    more = materialise(apart.select("node").distinct().join(wanted, "node", "left_anti"), "wanted")
    texts = texts.unionByName(materialise(nd.texts_of(docs, more), "texts"))
    fine = nd.family_postings(family, apart, texts, found, threshold, width)

    columns = ("s", "node", "label", "left", "related")
    hubs = fine.groupBy("key", "d").agg(F.min(F.struct(*columns)).alias("h")).select("key", "d", *(F.col(f"h.{c}").alias(f"{c}_2") for c in columns))
    pairs = lambda rows: rows.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()
    found = nd.contracted(found, materialise(nd.confirm_pairs(pairs(nd.meeting(fine, hubs, threshold)), texts, threshold, width), "links"))

    left = materialise(nd.still_open(nd.labelled(fine.drop("label"), found), ["key", "d"]), "differences")
    centre = nd.labelled(hubs.select("key", "d", F.col("node_2").alias("node")), found, label="main").select("key", "d", "main")
    outside = left.join(centre, ["key", "d"]).filter("label <> main")
    others = left.select("key", "d", *(F.col(c).alias(f"{c}_2") for c in columns))
    last = pairs(block_meeting(outside, others, threshold).filter("label_2 = main OR node < node_2"))
    final = nd.contracted(found, materialise(nd.confirm_pairs(last, texts, threshold, width), "links"))

    placed = classes.join(final, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component"))
    out = base.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("k1")).alias("k1"), "k2").join(placed, ["k1", "k2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op11_set_join(spark, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` under four words and 0.85; cases as in ``similar_sets``."""
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4, threshold=85)


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM inter JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * c >= 85 * (len(p.sh) + len(q.sh) - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, t.b FROM reach r JOIN both_ways t ON r.seen = t.a),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN c ON s.doc_id = c.node"""
