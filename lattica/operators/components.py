"""Connected components of links, by alternating large and small stars.

Every step is a join or an aggregate over the links, so nothing is gathered on the
driver but one checksum a round; a hub's links are spread by the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.runtime import cut, release

#: Far beyond what any graph needs (the rounds grow with the logarithm of its size); reached only by a defect.
MAX_ROUNDS = 100


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Each place hands its least neighbour (or itself) to its larger, or to its other, neighbours."""
    if larger:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, near["a"] == least["u"])
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def merged(links: DataFrame) -> DataFrame:
    """(node, component) after a single round: whole for stars about a hub; elsewhere parts of components, each named by a node of it.

    A node may come several times, with names of one component.
    """
    return _star(_star(links.select("a", "b").where("a <> b"), True), False).select(F.col("a").alias("node"), F.col("b").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node that it reaches.

    Repeated links and links of a node with itself change nothing; nodes that have
    only the latter are not returned. Nodes may be of any type with an order.
    """
    now = cut(links.select("a", "b").where("a <> b").distinct())
    sign = None
    for _ in range(MAX_ROUNDS):
        now = cut(_star(_star(now, True), False))
        last, sign = sign, now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b")), F.bit_xor(F.xxhash64("a", "b"))).first()
        release(links.sparkSession)  # the last round's shuffles
        if sign == last:
            # A fixed point is a star about each component's smallest node.
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    raise RuntimeError("components did not settle")
