"""Near duplicates by bottom-k sketches of one hash function.

A document's sketch is the k smallest hashes of its shingles. Documents that are
similar enough share many retained values, so each is listed under the rarest of
its values only, as many as the least overlap leaves (a prefix of the sketch in
the order of frequency). Documents in one list are candidates; the k smallest
values of both sketches together estimate their similarity; candidates that may
reach the threshold are confirmed on their full sets.

Equal sets are one node from the start, so copies never meet in pairs. Lists of
near copies are not paired out either: in the first rounds each node meets one
leader, which joins most of a group. Then only nodes outside the leader's component
meet all of another component in the list. Where more than a few are outside, the
list's nodes (a passage that many share fills most of their sketches) are listed
anew by far larger sketches, for nearly all texts their whole sets, so that only
nodes meet that have almost everything in common. Two nodes meet where their common
values start, not again in each list that they share. So no link between components
is lost, and lists of unlike documents are not paired out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import shingles
from lattica.llm.common import batches_of, cut, integers, pieces, release
from lattica.operators.components import components, merged

#: Values in a sketch, and in the larger sketch of nodes in crowded lists.
K, LARGE_K = 64, 4096
#: At most this likely is a pair at the threshold to share fewer sketch values than asked for.
MISS = 1e-8
#: The lists by which a node finds the leader that it meets.
LEADER_LISTS = 6
#: Rounds, at most, in which the nodes of crowded lists meet a few leaders each; they end when few links are new.
LARGE_ROUNDS, LARGE_LEADERS, FEW_LINKS = 4, 4, 0.05
#: Words of 64 bits in the parity table of a set.
PARITY = 8
#: Two nodes don't meet in a list if they have one of so many values before it in common.
BEFORE = 8
#: Full sets, or pairs of them, that a worker unpacks together.
SETS_TOGETHER = 256
#: Keys with more rows than this share of all: fewer than HOT_KEYS, whatever the table's size.
HOT_KEYS = 1024
#: A list is crowded if more nodes than this are outside its leader's component.
OUTSIDE = 6


@dataclass(frozen=True)
class Measure:
    """What counts as near: `num` / `den` of the union of sets of shingles of `words` words."""

    words: int
    num: int
    den: int
    k: int = K

    @property
    def larger(self) -> Measure:
        return replace(self, k=max(self.k, LARGE_K))

    @property
    def shared(self) -> int:
        """The overlap that two full sketches have, but for a chance below MISS (Chernoff's bound)."""
        p = self.num / self.den
        for t in range(self.k, 0, -1):
            x = t / self.k
            if x < p and self.k * (x * math.log(x / p) + (1 - x) * math.log((1 - x) / (1 - p))) >= -math.log(MISS):
                return t
        return 1

    def least_overlap(self, n: int) -> int:
        """Sketch values that a node of `n` shingles shares with any node near it."""
        if n * self.den <= self.k * self.num:  # then the union of both fits in a sketch
            return -(-n * self.num // self.den)
        return min(self.shared, n)

    def prefix(self, n: int) -> int:
        """So many of its sketch values, in any one order for all, hold a value shared with each node near it."""
        return min(n, self.k) - self.least_overlap(n) + 1

    def near(self, both: int, either: int) -> bool:
        return self.den * both >= self.num * either

    def may_be_near(self, a: np.ndarray, b: np.ndarray) -> bool:
        """By the sketches' union: its k smallest values, and how many of these both have."""
        both = np.concatenate([a, b])
        both.sort()
        twice = both[:-1][both[1:] == both[:-1]]
        either = len(both) - len(twice)
        if either <= self.k:
            return self.near(len(twice), either)
        kth = np.unique(both)[self.k - 1]
        return int(np.searchsorted(twice, kth, "right")) >= self.shared


def sketches(docs: DataFrame, m: Measure, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, sketch) of each row of `docs`: set size, name of the set, its k smallest hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles.shingle_set(t, m.words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.set_key(s) for s in sets], pa.binary()), pa.array([s[: m.k] for s in sets], pa.list_(pa.int64()))],
                names=["id", "n", "key", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary")).mapInArrow(rows, "id bigint, n bigint, key binary, sketch array<bigint>")


def _least_overlap(m: Measure, n: str) -> Column:
    """`Measure.least_overlap` of a column."""
    return F.when(F.col(n) * m.den <= m.k * m.num, F.ceil(F.col(n) * m.num / m.den)).otherwise(F.least(F.lit(m.shared), F.col(n)))


def _prefix_size(m: Measure) -> Column:
    """`Measure.prefix` of the column n."""
    return (F.least(F.lit(m.k), F.col("n")) - _least_overlap(m, "n") + 1).cast("int")


def _by_rarity(nodes: DataFrame, m: Measure) -> DataFrame:
    """(node, n, own, keys): of each node's sketch the values that it is listed under, rarest first; only those that another node has.

    `own`: the sketch's values that no other node has.
    """
    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = values.join(counted, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))  # at most k values
    # Values that no other node has come first; what they leave of the prefix is listed.
    ordered = ordered.withColumn("own", F.least(F.lit(m.k), F.col("n")) - F.size("vs"))
    left = _prefix_size(m) - F.col("own")
    return cut(ordered.where(left > 0).select("node", "n", "own", F.slice(F.col("vs.v"), F.lit(1), left.cast("int")).alias("keys")))


def listed(nodes: DataFrame, m: Measure) -> DataFrame:
    """`_by_rarity` of (node, n, sketch), after leaving out nodes that have nobody near by their smallest values alone."""
    first = nodes.select("node", F.explode(F.slice("sketch", F.lit(1), _prefix_size(m))).alias("v"))
    shared = first.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    some = first.join(shared, "v", "left_semi").select("node").distinct()
    some = cut(nodes.join(some, "node", "left_semi").select("node", "n", "sketch"))
    return _by_rarity(some, m)


def parity(whole: np.ndarray) -> np.ndarray:
    """Which places of a table of 64 * PARITY bits an odd number of the set's values take."""
    odd = np.bincount(whole.view(np.uint64) >> np.uint64(64 - (64 * PARITY - 1).bit_length()), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def larger_sketches(sets: DataFrame, m: Measure) -> DataFrame:
    """(node, n, sketch, odd) with the larger sketch and the `parity`, of (node, n, whole)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SETS_TOGETHER):
            whole = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([x[: m.larger.k] for x in whole], pa.list_(pa.int64())), pa.array([parity(x) for x in whole], pa.list_(pa.int64()))], names=["node", "n", "sketch", "odd"]
            )

    return sets.select("node", "n", "whole").mapInArrow(rows, "node bigint, n bigint, sketch array<bigint>, odd array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, m: Measure, id_col: str, text_col: str) -> DataFrame:
    """(node, n, whole, sketch) of the documents named in `wanted` (node)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles.shingle_set(t, m.words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s[: m.k].tobytes() for s in sets], pa.binary())],
                names=["node", "n", "whole", "sketch"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(wanted.select("node").distinct(), "node", "left_semi").mapInArrow(rows, "node bigint, n bigint, whole binary, sketch binary")


def _tested(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose two values of `column` pass `test`."""
    left = sets.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col(column).alias("of_b"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SETS_TOGETHER):
            whole = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()], [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            yield batch.select([0, 1]).filter(pa.array([test(x, y) for x, y in zip(*whole, strict=True)], pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(rows, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, m: Measure) -> DataFrame:
    """The pairs (a, b) that are near, first by their sketches' union, then by their full sets."""

    def full(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return m.near(both, len(x) + len(y) - both)

    likely = cut(_tested(pairs, sets, "sketch", m.may_be_near))
    return _tested(likely, sets, "whole", full)


def _fits(m: Measure) -> Column:
    """Whether two nodes that meet at `pos` and `other_pos` of their values by rarity may be near.

    Read as their first common value: what comes before is not in the other set. A
    pair also meets at later ones, where this refuses too much; but it is kept where
    it is due, at the first.
    """
    n, k, at, other_at = F.col("n"), F.col("other_n"), F.col("pos") - 1, F.col("other_pos") - 1
    sizes = (n * m.den >= k * m.num) & (k * m.den >= n * m.num)
    held = F.least(F.least(n, F.lit(m.k)) - at, F.least(k, F.lit(m.k)) - other_at)
    overlap = held >= F.greatest(_least_overlap(m, "n"), _least_overlap(m, "other_n"))
    # Where the sketches are the whole sets, the union has what either lacks.
    whole = (n > m.k) | (k > m.k) | (held * m.den >= F.greatest(n + other_at, k + at) * m.num)
    return sizes & overlap & whole


def _heads(entries: DataFrame, seed: int, drawn: bool = False) -> DataFrame:
    """(v, other...): the leader of each list with several components: the node with the fewest rarer values, or one `drawn` by chance.

    Edited copies have rare values of their own, so the former is the original, or near it.
    """
    leader = F.min(F.struct((F.lit(0) if drawn else F.col("pos")).alias("first"), F.xxhash64("node", F.lit(seed), *(["v"] if drawn else [])).alias("h"), "node", "n", "pos", "label"))
    heads = entries.groupBy("v").agg(leader.alias("head"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return heads.select("v", *[F.col(f"head.{c}").alias(f"other{'' if c == 'node' else '_' + c}") for c in ("node", "n", "pos", "label")])


def _leader_pairs(entries: DataFrame, m: Measure, seed: int, drawn: bool = False, most: int = 1) -> DataFrame:
    """(node, other): each node with the leader of another component with which it shares most lists, or with so many."""
    met = entries.join(_heads(entries, seed, drawn), "v").where((F.col("label") != F.col("other_label")) & _fits(m))
    met = met.groupBy("node", "other").agg(F.count(F.lit(1)).alias("c"))
    best = Window.partitionBy("node").orderBy(F.desc("c"), F.desc("other"))  # a node meets as many leaders as it has lists, at most
    return met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("node", "other")


def _outside(entries: DataFrame, seed: int) -> DataFrame:
    """The entries outside the component of their list's leader."""
    return entries.join(_heads(entries, seed), "v").where("label <> other_label").select(*entries.columns)


def _all_pairs(mine: DataFrame, entries: DataFrame, m: Measure) -> DataFrame:
    """(node, other): every node outside with everyone of another component in the list, if the list may be the first that both are in.

    Where both have one of the values just before it, they have met already. At the
    first value that two nodes share nothing before it is common, so each pair meets.
    """
    others = entries.select("v", *[F.col(c).alias("other" if c == "node" else f"other_{c}") for c in entries.columns if c != "v"])
    met = (F.col("label") != F.col("other_label")) & _fits(m) & ~F.arrays_overlap("before", "other_before")
    if "odd" in entries.columns:
        # A place where the parities differ is taken by a value that one set alone has.
        apart = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("other_odd")[k])) for k in range(PARITY)), F.lit(0))
        met &= apart * (m.den + m.num) <= (F.col("n") + F.col("other_n")) * (m.den - m.num)
    return mine.join(others, "v").where(met).select("node", "other")


def _entries(lists: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """(v, node, n, label, before, pos, and odd where `lists` has it) of each node's lists, or of so many first or last of them.

    pos: the value's place by rarity in the node's sketch; before: the last of the node's lists before this one.
    """
    more = [c for c in lists.columns if c == "odd"]
    rows = lists.select("node", "n", "own", "label", "keys", *more, F.size("keys").alias("size"), F.posexplode("keys").alias("at", "v"))
    if first:
        rows = rows.where(F.col("at") < first)
    if last:
        rows = rows.where(F.col("at") >= F.col("size") - last)
    before = F.slice("keys", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    return rows.select("v", "node", "n", "label", *more, before.alias("before"), (F.col("own") + F.col("at") + 1).alias("pos"))


def _labelled(lists: DataFrame, found: DataFrame | None, whole: bool = False) -> DataFrame:
    """`lists` with `label`: nodes with one label are linked by the links found. Not all that are linked have one, unless asked for: that only costs comparisons."""
    plain = lists.drop("label")
    if found is None:
        return plain.withColumn("label", F.col("node"))
    joined = (components if whole else merged)(found).groupBy("node").agg(F.min("component").alias("label"))
    # The named node itself has its own name.
    return cut(plain.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")))


def links(lists: DataFrame, sets: DataFrame, m: Measure) -> DataFrame:
    """(a, b): links that give the components of all near pairs."""
    spark, found = lists.sparkSession, None

    def confirm(met: DataFrame) -> DataFrame:
        nonlocal found
        pairs = cut(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a <> b").distinct())
        with batches_of(spark, SETS_TOGETHER):
            near = cut(confirmed(pairs, sets, m))
        found = near if found is None else found.unionByName(near)
        release(spark)
        return near

    # By the rarest lists, then by the most frequent.
    now = _labelled(lists, None)
    confirm(_leader_pairs(_entries(now, first=LEADER_LISTS), m, 0))
    now = _labelled(lists, found)
    confirm(_leader_pairs(_entries(now, last=LEADER_LISTS), m, 1))
    now = _labelled(lists, found)
    outside = cut(_outside(_entries(now), 2))
    size = outside.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    confirm(_all_pairs(outside.join(size.where(F.col("c") <= OUTSIDE), "v", "left_semi"), _entries(now), m))
    crowded = cut(_entries(now).join(size.where(F.col("c") > OUTSIDE), "v", "left_semi").select("node").distinct())
    if not crowded.isEmpty():
        with batches_of(spark, SETS_TOGETHER):
            larger = cut(larger_sketches(sets.join(crowded, "node", "left_semi"), m))
        again = cut(_by_rarity(larger, m.larger).join(larger.select("node", "odd"), "node"))
        release(spark)
        few = FEW_LINKS * again.count()
        for k in range(LARGE_ROUNDS):
            now = _labelled(again, found)
            if confirm(_leader_pairs(_entries(now), m.larger, 3 + k, drawn=k > 0, most=LARGE_LEADERS)).count() <= few:
                break
        now = _labelled(again, found, whole=True)
        confirm(_all_pairs(_outside(_entries(now), 2), _entries(now), m.larger))
    return found


def _with_node(rows: DataFrame) -> DataFrame:
    """(id, node, key) of (id, key): node is the smallest id of the key. The rows of the most frequent keys stay where they are."""
    named = cut(rows.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows")))
    total = named.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") * HOT_KEYS > total  # so fewer than HOT_KEYS keys
    marked = rows.join(F.broadcast(named.where(hot).select("key", F.col("node").alias("hot_node"))), "key", "left")
    apart = marked.where("hot_node IS NULL").drop("hot_node").join(named.where(~hot).drop("rows"), "key").select("id", "node", "key")
    return apart.unionByName(marked.where("hot_node IS NOT NULL").select("id", F.col("hot_node").alias("node"), "key"))


def near_duplicates(docs: DataFrame, m: Measure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (`id_col`, n_shingles, component_id, kept), one for each row of `docs`.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a
    set holds the distinct shingles of the whole text, or the whole sequence as one
    where it has fewer words. component_id: the smallest id reachable over links;
    kept: it is the row's own. Null, empty and blank texts have empty sets and are
    linked with nothing. Rows with a null id take no part: their component_id is
    null and they are kept. Rows that repeat an id are one document, which has the
    links of each. An empty table gives no rows; other columns aren't read. Very long
    texts are taken whole. Ids are integers; another type of `id_col` raises TypeError.
    """
    spark = docs.sparkSession
    integers(docs, id_col)
    all_rows = cut(sketches(docs, m, id_col, text_col))
    rows = all_rows.where("n > 0 AND id IS NOT NULL")
    by_node = cut(_with_node(rows.select("id", "key")))
    own = by_node.where("id = node").select(F.col("id").alias("node"), "key").distinct()
    lists = listed(rows.withColumnRenamed("id", "node").join(own, ["node", "key"], "left_semi").select("node", "n", "sketch"), m)
    release(spark)
    sets = cut(full_sets(docs, lists, m, id_col, text_col))
    release(spark)
    # A copy is linked with its node; where an id has several texts, so are its nodes.
    copies = by_node.where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    label = components(cut(links(lists, sets, m)).unionByName(copies))
    out = all_rows.select("id", "n").join(label, F.col("id") == F.col("node"), "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, m: Measure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose document stays: the smallest id of each component, with the columns of `docs`.

    Rows that repeat a kept id all stay, as do rows with a null id.
    """
    gone = near_duplicates(docs, m, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
