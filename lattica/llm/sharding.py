"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into thousands of slots, whose number never changes. Bytes are added
up by slot, and a small map says which shard holds each slot. Rebalancing edits
that map and stores the result as its next version; the records' slots stay.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut

SLOTS = 4096
SEED = 20240229
#: Slots with more than this part of a shard's even share are placed before all others.
LARGE_SHARE = 4
#: Parts of a slot whose rows are numbered apart.
CELLS = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot. `edits`: (slot, from, to) that made this version of the one before."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    edits: tuple[tuple[int, int, int], ...] = ()

    @staticmethod
    def fresh(n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        if not 1 <= n_shards <= n_slots:
            raise ValueError("from 1 shard to as many as there are slots")
        return SlotMap(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def rebalanced(self, slot_bytes: dict[int, int]) -> SlotMap:
        """The next version, edited until no move of one slot brings the fullest and the emptiest shard closer."""
        held = [sorted((slot_bytes.get(s, 0), s) for s, x in enumerate(self.shards) if x == shard and slot_bytes.get(s, 0)) for shard in range(self.n_shards)]
        total = [sum(b for b, _ in h) for h in held]
        now = list(self.shards)
        large = sum(total) // (LARGE_SHARE * self.n_shards)
        self._place_largest(held, total, now, large)
        while True:
            full, empty = max(range(self.n_shards), key=lambda x: (total[x], -x)), min(range(self.n_shards), key=lambda x: (total[x], x))
            gap = total[full] - total[empty]
            # The slot nearest to half the gap; any below the whole gap helps.
            at = bisect.bisect_right(held[full], (gap // 2, len(now)))
            fit = [held[full][k] for k in (at - 1, at) if 0 <= k < len(held[full]) and held[full][k][0] < gap]
            if not fit:
                break
            size, slot = min(fit, key=lambda x: (abs(2 * x[0] - gap), x[1]))
            held[full].remove((size, slot))
            bisect.insort(held[empty], (size, slot))
            total[full] -= size
            total[empty] += size
            now[slot] = empty
        return self._edited(now, self.n_shards)

    def _place_largest(self, held: list[list[tuple[int, int]]], total: list[int], now: list[int], large: int) -> None:
        """Slots of over `large` bytes, the largest first, go where least is yet: small ones can even out the rest."""
        some = sorted((x for h in held for x in h if x[0] > large), reverse=True)
        placed = [0] * self.n_shards
        for size, slot in some:
            at = now[slot]
            # It stays where it is unless another shard has less of the large ones.
            to = min(range(self.n_shards), key=lambda x: (placed[x], x != at, x))
            placed[to] += size
            if to != at:
                held[at].remove((size, slot))
                bisect.insort(held[to], (size, slot))
                total[at] -= size
                total[to] += size
                now[slot] = to

    def grown(self, slot_bytes: dict[int, int]) -> SlotMap:
        """The next version with one more shard: slots move into it alone, each from the shard that is then fullest."""
        n, now = self.n_shards + 1, list(self.shards)
        held = [sorted((slot_bytes.get(s, 0), s) for s, x in enumerate(now) if x == shard) for shard in range(self.n_shards)]
        total, got, share = [sum(b for b, _ in h) for h in held], 0, sum(slot_bytes.values()) // n
        while True:
            full = max(range(self.n_shards), key=lambda x: (total[x], -x))
            at = bisect.bisect_right(held[full], (share - got, len(now))) - 1
            if at < 0 or held[full][at][0] <= 0:
                break
            size, slot = held[full].pop(at)
            total[full] -= size
            got += size
            now[slot] = self.n_shards
        return self._edited(now, n)

    def _edited(self, now: list[int], n: int) -> SlotMap:
        edits = tuple((s, a, b) for s, (a, b) in enumerate(zip(self.shards, now, strict=True)) if a != b)
        return replace(self, version=self.version + 1, n_shards=n, shards=tuple(now), edits=edits)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the maps stored at `path`; refuses to write a version again."""
        before = {s: a for s, a, _ in self.edits}
        rows = [(s, x, before.get(s), self.n_shards) for s, x in enumerate(self.shards)]
        spark.createDataFrame(rows, "slot int, shard int, moved_from int, n_shards int").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def latest(spark: SparkSession, path: str) -> int | None:
        """The highest version that is stored whole at `path`; None if there is none."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(where) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{path}/version={version}").collect())  # as many rows as slots
        edits = tuple((r["slot"], r["moved_from"], r["shard"]) for r in rows if r["moved_from"] is not None)
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows), edits)


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def hot_groups(sized: DataFrame, group_col: str, bytes_col: str, n_shards: int) -> DataFrame:
    """Groups of several rows with more bytes than a shard's even share, so that no shard can hold them evenly: fewer than shards, whatever the table's size."""
    total = sized.agg(F.coalesce(F.sum(bytes_col), F.lit(0)).alias("b")).first()["b"]
    sums = sized.groupBy(F.col(group_col).alias("__group")).agg(F.sum(bytes_col).alias("__b"), F.count(F.lit(1)).alias("__n"))
    return sums.where((F.col("__n") > 1) & (F.col("__b") * n_shards > total)).select("__group")


def with_slots(rows: DataFrame, hot: DataFrame, id_col: str, group_col: str, out_col: str, n_slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """`rows` with the slot of each in `out_col`: rows of one group share a slot, but those of `hot` groups spread by id.

    So a group of copies that holds a third of all bytes still gives even shards.
    The broadcast is bounded, see `hot_groups`.
    """
    spread = rows.join(F.broadcast(hot), F.col(group_col) == F.col("__group"), "left")
    key = F.when(F.col("__group").isNull(), F.xxhash64(F.lit(seed), F.col(group_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col), F.col(group_col)))
    return spread.withColumn(out_col, F.pmod(key, F.lit(n_slots)).cast("int")).drop("__group")


def slot_bytes(slotted: DataFrame, slot_col: str, bytes_col: str) -> dict[int, int]:
    """Bytes of each slot; at most as many entries as there are slots."""
    return {r[slot_col]: r["b"] for r in slotted.groupBy(slot_col).agg(F.sum(bytes_col).alias("b")).collect()}


def next_map(spark: SparkSession, sums: dict[int, int], n_shards: int, n_slots: int, path: str) -> SlotMap:
    """The latest map stored at `path` (a round-robin one, stored as version 0, if there is none), edited for these bytes and stored as the next version."""
    version = SlotMap.latest(spark, path)
    if version is None:
        now = SlotMap.fresh(n_shards, n_slots)
        now.save(spark, path)
    else:
        now = SlotMap.load(spark, path, version)
        if (now.n_shards, len(now.shards)) != (n_shards, n_slots):
            raise ValueError(f"the map at {path} has {now.n_shards} shards and {len(now.shards)} slots")
    after = now.rebalanced(sums)
    after.save(spark, path)
    return after


def shard_rows(docs: DataFrame, n_shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """Rows (`id_col`, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version), one for each of `docs`.

    Shards get nearly equal bytes (the law is `bytes`; grown_shard is null): the
    latest map stored below `map_path`, or a round-robin one, is rebalanced by the
    slots' bytes and stored as the next version. Rows of equal text are in one shard,
    unless together they have more bytes than a shard's even share: then they spread
    by id. The largest slots are placed first, each in the emptiest shard, and then
    moved one by one while that evens shards out. `slot` is the row's place in its shard, gapless from 0: shards list
    their virtual slots in order, and these their rows by a hash of the id and by id.
    Null texts have size 1 and a null checksum and count as one group, as empty texts
    do; null ids come first in their part of a slot; repeated rows are placed each;
    very long texts count whole; an empty table gives no rows. Ids may be of any type
    with an order. Other columns of `docs` aren't read. Texts are read once, whole,
    and never shuffled.
    """
    sized = cut(docs.select(F.col(id_col), record_bytes(F.col(text_col)).alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"), F.xxhash64(F.col(text_col)).alias("__text")))
    hot = cut(hot_groups(sized, "__text", "size", n_shards))
    slotted = with_slots(sized, hot, id_col, "__text", "virtual_slot", n_slots, seed).withColumn("__cell", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(CELLS)).cast("int"))
    # A row for each slot's cell that is taken: at most n_slots * CELLS, whatever the table's size.
    cells = cut(slotted.groupBy("virtual_slot", "__cell").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__b")))
    sums = {r["virtual_slot"]: r["b"] for r in cells.groupBy("virtual_slot").agg(F.sum("__b").alias("b")).collect()}
    spark = docs.sparkSession
    after = next_map(spark, sums, n_shards, n_slots, map_path)
    shards = F.broadcast(spark.createDataFrame(list(enumerate(after.shards)), "virtual_slot int, shard int"))  # a row for each slot
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot", "__cell")
    first = F.broadcast(cells.join(shards, "virtual_slot").select("virtual_slot", "__cell", "shard", (F.sum("__n").over(in_shard) - F.col("__n")).alias("__first")))
    in_cell = Window.partitionBy("virtual_slot", "__cell").orderBy(F.col(id_col).asc_nulls_first(), "__text")
    return (
        slotted.withColumn("__at", F.row_number().over(in_cell)).join(first, ["virtual_slot", "__cell"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__first") + F.col("__at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(after.version).alias("map_version"))
    )


def assign_shards(docs: DataFrame, n_shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """`docs` with its columns and `shard`, by the same law and map as `shard_rows`; texts are not shuffled.

    A column of `docs` named `shard` is replaced. Null, empty, very long and repeated rows as in `shard_rows`.
    """
    keyed = docs.drop("shard").withColumn("__size", record_bytes(F.col(text_col))).withColumn("__text", F.xxhash64(F.col(text_col)))
    light = cut(keyed.select(id_col, "__size", "__text"))
    hot = cut(hot_groups(light, "__text", "__size", n_shards))
    sums = slot_bytes(with_slots(light, hot, id_col, "__text", "__slot", n_slots, seed), "__slot", "__size")
    after = next_map(docs.sparkSession, sums, n_shards, n_slots, map_path)
    places = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(after.shards)), "__slot int, shard int"))  # a row for each slot
    slotted = with_slots(keyed, hot, id_col, "__text", "__slot", n_slots, seed)
    return slotted.join(places, "__slot").select(*[c for c in docs.columns if c != "shard"], "shard")
