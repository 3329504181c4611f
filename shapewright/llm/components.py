"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import cut

#: Links of a node beyond which its rows are joined where they are.
HUB = 10_000


def by_node(rows: DataFrame, values: DataFrame, links: int) -> DataFrame:
    """rows (a, b) with the value of their a, from values (a, m, n), n being the rows of a.

    Rows of hubs are not brought together: nodes with more than HUB rows, and more than a thousandth of all, are 1,000 at most, and are
    broadcast."""
    most = max(HUB, links // 1_000)
    hubs = values.where(F.col("n") > most).select("a", "m")
    if hubs.isEmpty():
        return rows.join(values.select("a", "m"), "a")
    hot = F.broadcast(hubs)
    rest = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(values.where(F.col("n") <= most).select("a", "m"), "a")
    return rest.unionByName(rows.join(hot, "a"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b): component is the least node that can be reached.

    Each step links every node's neighbours to the least of them: large stars those above the node, small stars the others. The rows
    of a hub are never gathered. The work is a few rounds over the links, written at each round."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    signed, links = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = by_node(both, least, 2 * links).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = cut(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = by_node(large, down, 2 * links)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small, "links")
        # a step that changes nothing leaves stars only
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("s")).first()
        if (state.n, state.s) == signed:
            break
        signed, links = (state.n, state.s), state.n
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return cut(out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
