"""Traversals: predicate chains, closures of a predicate, and neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.operators.metrics import numbered
from lattica.operators.rules import SPO
from lattica.runtime import cut, deadline

MAX_HOPS, MAX_TERMINALS, MAX_EDGES = 5, 100, 200
#: Bytes of names up to which a frontier, or a list of properties, is sent to the triples, so that these stay where they are.
FEW_BYTES = 8_000_000


def _one_of(column: str, values: DataFrame, name: str) -> DataFrame:
    return values.select(F.col(name).alias(column)).distinct()


def few(frame: DataFrame, name: str = "entity") -> DataFrame:
    """A frame of names, marked for a broadcast if it is small: joins don't see its size beforehand, and would deal out all triples to find out. It should be cheap to count, as a cut frame is."""
    n, size = frame.agg(F.count(F.lit(1)), F.sum(F.octet_length(name))).first()
    return F.broadcast(frame) if (size or 0) + 32 * n <= FEW_BYTES else frame


def touching(triples: DataFrame, frontier: DataFrame, value: str) -> DataFrame:
    """The triples with a frontier's (entity, `value`) entity at an end, with its `value`: `<value>_s` for the subject, `<value>_o` for the object, null where that end is no such. One pass over the triples."""
    out = triples
    for c in ("s", "o"):
        out = out.join(frontier.select(F.col("entity").alias(f"__at_{c}"), F.col(value).alias(f"{value}_{c}")), F.col(c) == F.col(f"__at_{c}"), "left").drop(f"__at_{c}")
    return out.where(F.col(f"{value}_s").isNotNull() | F.col(f"{value}_o").isNotNull())


def hop(triples: DataFrame, frontier: DataFrame, predicate: str, inverse_only: bool = False) -> DataFrame:
    """(entity, s, p, o, direction, next): the triples of a predicate that touch the frontier (entity).

    Both ways, or only against the triple's direction; literals lead nowhere.
    """
    steps = triples.where(F.col("p") == predicate).select(SPO)
    live = frontier.select("entity").where(~terms.is_literal(F.col("entity"))).distinct()
    if inverse_only:
        return steps.join(live, steps["o"] == live["entity"]).select("entity", *SPO, F.lit("inverse").alias("direction"), F.col("s").alias("next"))
    ends = ((F.col("__of_s"), "forward", "o"), (F.col("__of_o"), "inverse", "s"))
    ways = [F.when(at.isNotNull(), F.struct(at.alias("entity"), F.lit(direction).alias("direction"), F.col(next_).alias("next"))) for at, direction, next_ in ends]
    found = touching(steps, live.withColumn("__of", F.col("entity")), "__of").withColumn("way", F.explode(F.array_compact(F.array(*ways))))
    return found.select("way.entity", *SPO, "way.direction", "way.next")


@dataclass(frozen=True)
class PathResult:
    """What a chain of predicates gives; the frames are bounded by the caps, the traversal is not.

    terminals (entity): in order of their shown form. edges (hop, s, p, o,
    direction). frontiers (hop, size, edges): uncapped counts.
    """

    terminals: DataFrame
    terminals_truncated: bool
    excluded: list[str]
    edges: DataFrame
    frontiers: DataFrame
    notes: list[str]


def chain(relations: list[str], max_hops: int = MAX_HOPS) -> list[tuple[str, bool]]:
    """(predicate, inverse only) of each hop; a leading ^ restricts a hop to the inverse direction."""
    if not relations:
        raise ValueError("a path needs at least one predicate")
    if len(relations) > max_hops:
        raise ValueError(f"{len(relations)} hops are more than {max_hops}; split the path")
    return [(terms.parse(r.strip().removeprefix("^")), r.strip().startswith("^")) for r in relations]


def walk(triples: DataFrame, start: DataFrame, hops: list[tuple[str, bool]]) -> list[DataFrame]:
    """The edges of each hop, from a frontier (entity); as many frames as hops."""
    out, frontier = [], start
    for predicate, inverse_only in hops:
        edges = hop(triples, frontier, predicate, inverse_only)
        out.append(edges)
        frontier = edges.select(F.col("next").alias("entity")).distinct()
    return out


def traverse(triples: DataFrame, start: str, relations: list[str], exclude_start: bool = True, max_terminals: int = MAX_TERMINALS, max_edges: int = MAX_EDGES, max_hops: int = MAX_HOPS, seconds: float | None = None) -> PathResult:
    """Follows a chain of predicates from one entity, each hop both ways unless it has a leading ^; DeadlineExceeded beyond `seconds`, if given."""
    with deadline(triples.sparkSession, seconds):
        return _traversed(triples, start, relations, exclude_start, max_terminals, max_edges, max_hops)


def _traversed(triples: DataFrame, start: str, relations: list[str], exclude_start: bool, max_terminals: int, max_edges: int, max_hops: int) -> PathResult:
    spark, term, hops = triples.sparkSession, terms.parse(start), chain(relations, max_hops)
    notes = []
    if triples.where((F.col("s") == term) | (F.col("o") == term)).isEmpty():
        notes.append(f"{term} does not occur; see case variants for its spelling")
    frontier, edges, sizes = spark.createDataFrame([(term,)], "entity string"), None, []
    for k, (predicate, inverse_only) in enumerate(hops, 1):
        if triples.where(F.col("p") == predicate).isEmpty():
            notes.append(f"hop {k}: {predicate} has no triples")
        found = cut(hop(triples, few(frontier), predicate, inverse_only))
        order = Window.partitionBy("hop").orderBy(F.col("entity"), F.col("s"), F.col("o"), F.col("direction"))
        # Only the first edges by that order are kept as evidence: a bounded sort, then the rank.
        first = found.orderBy("entity", "s", "o", "direction").limit(max_edges).withColumn("hop", F.lit(k)).withColumn("rank", F.row_number().over(order))
        edges = first if edges is None else edges.unionByName(first)
        frontier = cut(found.select(F.col("next").alias("entity")).distinct())
        n, size = found.count(), frontier.count()
        sizes.append((k, size, n))
        if n > max_edges:
            notes.append(f"hop {k}: evidence truncated at {max_edges} of {n} edges; the frontier is whole")
        if not size:
            notes.append(f"hop {k}: no matching edges" + ("" if k == len(hops) else f"; stopped before hop {k + 1}"))
            break
    excluded = []
    if exclude_start and not frontier.where(F.col("entity") == term).isEmpty():
        frontier = frontier.where(F.col("entity") != term)
        excluded.append(term)
        notes.append(f"{term} itself was excluded from the terminals")
    total = frontier.count()
    if total > max_terminals:
        notes.append(f"terminals truncated to {max_terminals} of {total}")
    terminals = frontier.orderBy(terms.shown(F.col("entity")), "entity").limit(max_terminals)
    return PathResult(terminals, total > max_terminals, excluded, edges.select("hop", "rank", *SPO, "direction"), spark.createDataFrame(sizes, "hop int, size long, edges long"), notes)


def functional_walk(triples: DataFrame, starts: DataFrame, predicates: list[str]) -> DataFrame:
    """(start, end): where single-valued predicates lead, one after the other; starts without a value drop out."""
    at = starts.select(F.col("entity").alias("start"), F.col("entity").alias("at"))
    for p in predicates:
        step = triples.where(F.col("p") == p).select(F.col("s").alias("at"), F.col("o").alias("to"))
        at = at.join(step, "at").select("start", F.col("to").alias("at"))
    return at.withColumnRenamed("at", "end")


def transitive_closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All (a, b) with a path of one or more edges (a, b); from `sources` (a) only, if given.

    Semi-naive: each round extends only the pairs that the last one added. Without
    sources, new pairs meet all pairs known, so the rounds grow with the logarithm
    of the longest path.
    """
    edges = cut(edges.select("a", "b").distinct())
    known = edges if sources is None else cut(edges.join(sources.select("a").distinct(), "a", "left_semi"))
    news = known
    while not news.isEmpty():
        onward = (known if sources is None else edges).select(F.col("a").alias("b"), F.col("b").alias("c"))
        further = news.join(onward, "b").select("a", F.col("c").alias("b"))
        if sources is None:
            before = known.select(F.col("a").alias("z"), F.col("b").alias("a"))
            further = further.unionByName(before.join(news, "a").select(F.col("z").alias("a"), "b"))
        news = cut(further.distinct().join(known, ["a", "b"], "left_anti"))
        known = cut(known.unionByName(news))
    return known


def neighbourhood(triples: DataFrame, start: str, radius: int, max_triples: int | None = None) -> tuple[DataFrame, bool]:
    """((s, p, o, layer, rank), truncated): triples within `radius` steps of an entity, both ways, nearest first.

    Within a layer, triples come in the order in which their entity was found, then
    by s, p, o; entities are found in the order of the triples that name them, the
    subject first. With a cap the first so many are kept; `truncated` says that more
    were within reach.
    """
    spark = triples.sparkSession
    all_ = triples.select(SPO)
    frontier = spark.createDataFrame([(start, 0)], "entity string, found long")
    seen, picked = frontier.select("entity"), spark.createDataFrame([], "s string, p string, o string, layer int, rank long")
    total = 0
    for layer in range(1, radius + 1):
        near = touching(all_, few(frontier), "found").join(picked.select(SPO), SPO, "left_anti").groupBy(*SPO).agg(F.min(F.least("found_s", "found_o")).alias("found"))
        if max_triples is None:
            place = numbered(near.withColumn("__order", F.struct("found", *SPO)), "__order").withColumn("rank", F.col("place").cast("long"))
        else:
            place = near.orderBy("found", *SPO).limit(max_triples - total + 1).withColumn("rank", F.row_number().over(Window.orderBy("found", *SPO)).cast("long") - 1)
        here = cut(place.select(*SPO, F.lit(layer).alias("layer"), (F.col("rank") + F.lit(total)).alias("rank")))
        n = here.count()
        if max_triples is not None and total + n > max_triples:
            return picked.unionByName(here.where(F.col("rank") < max_triples)), True
        picked, total = cut(picked.unionByName(here)), total + n
        names = here.select(F.col("s").alias("entity"), (F.col("rank") * 2).alias("found")).unionByName(here.select(F.col("o").alias("entity"), (F.col("rank") * 2 + 1).alias("found")))
        frontier = cut(names.groupBy("entity").agg(F.min("found").alias("found")).join(seen, "entity", "left_anti"))
        seen = cut(seen.unionByName(frontier.select("entity")))
        if not n:
            break
    return picked, False


def layers(triples: DataFrame, start: str, radius: int) -> DataFrame:
    """(s, p, o, layer): the triples of `neighbourhood` without cap or order, in joins alone."""
    all_ = triples.select(SPO)
    seen = triples.sparkSession.createDataFrame([(start, 0)], "entity string, layer int")
    for layer in range(1, radius):
        front = few(seen.where(F.col("layer") == layer - 1))
        led = F.array(F.when(F.col("layer_s").isNotNull(), F.col("o")), F.when(F.col("layer_o").isNotNull(), F.col("s")))
        steps = touching(all_, front, "layer").select(F.explode(F.array_compact(led)).alias("entity"))
        seen = cut(seen.unionByName(steps.distinct().join(seen.select("entity"), "entity", "left_anti").withColumn("layer", F.lit(layer))))
    near = touching(all_, few(seen.where(F.col("layer") < radius)), "layer")
    return near.groupBy(*SPO).agg((F.min(F.least("layer_s", "layer_o")) + 1).alias("layer"))


def touches(rows: DataFrame, entity: Column) -> Column:
    """Whether any triple of `rows` has the entity at either end, as an aggregate."""
    return F.coalesce(F.max((F.col("s") == entity) | (F.col("o") == entity)), F.lit(False))
