"""An index of edges in both directions: bucketed tables that are joined where they lie."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.runtime import cut, shared_dir

BUCKETS = 64
#: A node is a hub if it has more than one in so many of a bucket's even share of edges.
HUB_SHARE = 8


@dataclass(frozen=True)
class Side:
    """Edges by one end: `light`, a table in buckets of that end, and `heavy`, the edges of hubs, in no order; `hubs` (node) are at most BUCKETS * HUB_SHARE."""

    light: str
    heavy: str
    hubs: str


@dataclass(frozen=True)
class Adjacency:
    """An index over (s, p, o), by subject and by object."""

    spark: SparkSession
    forward: Side
    inverse: Side


def index(triples: DataFrame, buckets: int = BUCKETS) -> Adjacency:
    """Writes the index of a graph to the shared folder, each direction once.

    A node's edges are in one bucket, sorted by node and predicate, but for hubs: a
    bucket must not hold a large part of the graph, so their edges stay in files that
    any tasks may split. Literals are ends, but no nodes to go on from. Repeated triples count once.
    """
    spark, name = triples.sparkSession, uuid.uuid4().hex
    edges = cut(triples.select("s", "p", "o").distinct())
    limit = edges.count() / (buckets * HUB_SHARE)
    sides = []
    for node, other in (("s", "o"), ("o", "s")):
        own = edges.select(F.col(node).alias("node"), "p", F.col(other).alias("next")).where(~terms.is_literal(F.col("node")))
        hubs = cut(own.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("node"))  # fewer than buckets * HUB_SHARE
        side = Side(*(f"adjacency_{name}_{node}_{kind}" for kind in ("light", "heavy", "hubs")))
        path = lambda kind: f"{shared_dir(spark)}/adjacency/{name}/{node}-{kind}"  # noqa: B023, E731
        light = own.join(F.broadcast(hubs), "node", "left_anti").repartition(buckets, "node")
        light.write.format("parquet").bucketBy(buckets, "node").sortBy("node", "p").option("path", path("light")).saveAsTable(side.light)
        own.join(F.broadcast(hubs), "node", "left_semi").write.format("parquet").option("path", path("heavy")).saveAsTable(side.heavy)
        hubs.write.format("parquet").option("path", path("hubs")).saveAsTable(side.hubs)
        sides.append(side)
    return Adjacency(spark, *sides)


def drop(found: Adjacency) -> None:
    """Forgets the index's tables; their files stay in the shared folder."""
    for side in (found.forward, found.inverse):
        for table in (side.light, side.heavy, side.hubs):
            found.spark.sql(f"DROP TABLE IF EXISTS {table}")


def neighbours(found: Adjacency, node: str, inverse: bool = False) -> DataFrame:
    """(p, next) of one node: a bucket is read, or a hub's edges."""
    side = found.inverse if inverse else found.forward
    tables = [found.spark.table(t).where(F.col("node") == node).select("p", "next") for t in (side.light, side.heavy)]
    return tables[0].unionByName(tables[1])


def hop(found: Adjacency, frontier: DataFrame, predicate: str, inverse: bool = False) -> DataFrame:
    """(entity, paths): where a predicate leads from a frontier (entity, paths), with a row for each entity.

    Edges stay in their buckets: only the frontier is moved to them. A frontier's
    hubs are few, and go to the hubs' edges as a broadcast.
    """
    side = found.inverse if inverse else found.forward
    edges = lambda table: found.spark.table(table).where(F.col("p") == predicate).select("node", "next")
    at = frontier.select(F.col("entity").alias("node"), "paths")
    few = at.join(F.broadcast(found.spark.table(side.hubs)), "node", "left_semi")  # at most a row for each hub
    steps = edges(side.light).hint("merge").join(at, "node").unionByName(edges(side.heavy).join(F.broadcast(few), "node"))
    return steps.groupBy(F.col("next").alias("entity")).agg(F.sum("paths").alias("paths"))


def walk(found: Adjacency, starts: DataFrame, steps: list[tuple[str, bool]]) -> DataFrame:
    """(entity, paths): the ends of chains of (predicate, inverse) from `starts` (entity), and how many chains end there.

    Starts that come several times count several times; null starts and literals lead nowhere.
    """
    at = starts.where(F.col("entity").isNotNull()).groupBy("entity").agg(F.count(F.lit(1)).cast("long").alias("paths"))
    for predicate, inverse in steps:
        at = hop(found, at, predicate, inverse)
    return at
