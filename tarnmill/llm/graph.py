"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import materialise


#: Most edges whose least neighbours are broadcast; those of more edges are joined by node.
BROADCAST_EDGES = 1 << 20


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is named by its least node.

    Each round hangs a node's larger neighbours under the least node that it sees, then its smaller ones; the edges
    become stars in a number of rounds that grows with the logarithm of the largest component. An edge is kept from its
    larger end, so the least node that a node sees is a combined minimum over the edges that it begins. A round is two such minima
    and two joins on the node: broadcast for at most ``BROADCAST_EDGES`` counted edges, else shuffled, where AQE
    splits a node with many neighbours. The edges of a round are written to the shared folder; only a count and a
    checksum reach the driver.

    Loops and repeated edges do no harm; null ends are ignored; no edges give no rows.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    state = lambda: tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = state()
    while mark[0]:
        sent = F.broadcast if mark[0] <= BROADCAST_EDGES else lambda df: df
        least = lambda rows, node: sent(rows.groupBy(F.col("u").alias(node)).agg(F.min("v").alias("m")))
        large = current.join(least(current, "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        hung = large.join(least(large, "u"), "u")
        small = hung.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        current = materialise(small, "edges")
        before, mark = mark, state()
        if mark == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
