"""Benchmark decontamination by SimHash over item-sized windows.

Every window of a document with as many words as a benchmark item has is compared
with the items of that size. Its five-word shingles that no item has tell nothing
and are left out; a window with too few of the others is no leak of any item. The
rest get SimHash fingerprints of 512 bits, in which a shingle counts by the root of
its weight: so the cosine of a window that holds a share s of an item's weight is
the root of s, and 0.89 at the similarity asked for, however weights are spread.

Fingerprints are cut into 64 blocks of eight bits. Of two within the radius of 143
bits at least 17 blocks differ in at most two bits; each item is listed, by block,
under the 37 values so near its own, and the lists that a window's blocks name are
counted. That finds all within the radius, and 1 in 200 of unlike pairs. What an
item's shingles weigh in each window is then summed up exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm import shingles
from lattica.llm.common import cut

WORDS = 5
SIMILARITY = 0.8
BITS, BLOCKS = 512, 64
#: Bits in which a leak's fingerprint may differ: of 512, 76 are expected at the similarity, and 105 if also the words in place of the missing ones are some other item's.
RADIUS = 143
#: Bits in which a block may differ, and how many blocks then must not differ in more.
BLOCK_RADIUS = 2
LEAST_BLOCKS = BLOCKS - RADIUS // (BLOCK_RADIUS + 1)
#: Block values by block values: whether they are that near.
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= BLOCK_RADIUS
#: Items that are indexed, and sent to the executors, together: their number and their bytes.
ITEM_BLOCK, ITEM_BLOCK_BYTES = 2000, 16_000_000
#: Shingles whose signs, and windows by items whose blocks, are unpacked together.
TOGETHER, COUNTED = 2048, 1 << 18
#: Membership is first looked up in a table of so many bits' places.
TABLE_BITS = 22


@dataclass(frozen=True)
class Leak:
    """The best window of a document for an item."""

    item: object
    start: int
    words: int
    similarity: float
    distance: int
    windows: int


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the runs of `size` shingles at `starts` (in order): rows of BITS / 8 bytes. A run's repeated shingles count once."""
    out = np.empty((len(starts), BITS // 8), np.uint8)
    lo = 0
    while lo < len(starts):  # some runs at a time, to bound memory on long texts
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + TOGETHER)))
        first, last = int(starts[lo]), int(starts[hi - 1]) + size
        at = first + np.flatnonzero(weights[first:last])
        out[lo:hi] = Signs(hashes[at], weights[at], at).prints(starts[lo:hi], size)
        lo = hi
    return out


class Signs:
    """The signs of a text's weighed shingles, added up from its beginning: fingerprints of any of its runs are differences."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, at: np.ndarray):
        n, self.at = len(hashes), at
        with np.errstate(over="ignore"):
            bits = shingles.mixed(hashes[:, None] + np.uint64(0x5851F42D4C957F2D) * np.arange(1, BITS // 64 + 1, dtype=np.uint64))
        self.signs = (np.unpackbits(bits.view(np.uint8), axis=1) * 2.0 - 1.0) * weights[:, None]
        self.sums = np.zeros((n + 1, BITS))
        np.cumsum(self.signs, axis=0, out=self.sums[1:])
        order = np.argsort(hashes, kind="stable")
        same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        self.again, self.before = order[same + 1], order[same]  # a shingle and its last place before

    def prints(self, starts: np.ndarray, size: int) -> np.ndarray:
        total = self.sums[np.searchsorted(self.at, starts + size)] - self.sums[np.searchsorted(self.at, starts)]
        if len(self.again):
            near = self.at[self.again] - self.at[self.before] < size
            again, before = self.again[near], self.before[near]
            if len(again):  # taken back from the runs that hold both
                back = np.zeros((len(starts) + 1, BITS))
                np.add.at(back, np.searchsorted(starts, self.at[again] - size + 1), self.signs[again])
                np.subtract.at(back, np.searchsorted(starts, self.at[before], "right"), self.signs[again])
                total -= np.cumsum(back, axis=0)[:-1]
        return np.packbits(total > 1e-9, axis=1)


class Runs:
    """A text's shingles, and those that some item has: their places in the text and among the items' shingles."""

    def __init__(self, items: Items, runs: np.ndarray, hit: np.ndarray):
        self.runs, self.at, self.upto = runs, np.flatnonzero(hit), np.concatenate([[0], np.cumsum(hit)])
        self.places = np.searchsorted(items.hashes, runs[self.at])
        self.roots = items.roots[self.places]
        self.signs: Signs | None = None

    def prints(self, starts: np.ndarray, span: int) -> np.ndarray:
        if len(self.at) > TOGETHER:
            weights = np.zeros(len(self.runs))
            weights[self.at] = self.roots
            return fingerprints(self.runs, weights, starts, span)
        if self.signs is None:
            self.signs = Signs(self.runs[self.at], self.roots, self.at)
        return self.signs.prints(starts, span)


class Items:
    """An index of benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]], shared: tuple[np.ndarray, np.ndarray] | None = None):
        """`shared`: the shingles that several items of the whole benchmark have, in order, and how many have them; counted over `items` if not given."""
        known = [(i, h) for i, t in items if len(h := shingles.word_hashes(t))]
        runs = [shingles.run_hashes(h, WORDS) for _, h in known]
        self.hashes, seen = np.unique(np.concatenate([np.empty(0, np.uint64), *map(np.unique, runs)]), return_counts=True)
        if shared is not None:
            seen = np.ones(len(self.hashes))
            at = np.searchsorted(shared[0], self.hashes)
            at[at == len(shared[0])] = 0
            several = np.flatnonzero(shared[0][at] == self.hashes) if len(shared[0]) else []
            seen[several] = shared[1][at[several]]
        #: A shingle of many items says little: its weight is shared among them.
        self.weights = 1.0 / seen
        self.roots = np.sqrt(self.weights)
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.by_size: dict[int, dict] = {}
        by_size = defaultdict(list)
        for (i, h), r in zip(known, runs, strict=True):
            by_size[len(h)].append((i, r))
        for size, own in by_size.items():
            alike: dict[bytes, list] = {}  # items of the same shingles are looked for once
            for i, r in own:
                places = np.searchsorted(self.hashes, np.unique(r))
                alike.setdefault(places.tobytes(), [places, []])[1].append((i, r))
            sets = [places for places, _ in alike.values()]
            weights = [self.weights[places] for places in sets]
            # So few of its heaviest shingles make up the similarity: a window must hold as many.
            need = min(int(np.searchsorted(np.cumsum(np.sort(w)[::-1]), SIMILARITY * w.sum() - 1e-9) + 1) for w in weights)
            prints = np.array([self._print(self.hashes[places], self.roots[places]) for places in sets])
            self.by_size[size] = {
                "items": [[i for i, _ in items] for _, items in alike.values()], "sets": sets, "weights": weights, "need": need, "prints": prints,
                "near": np.ascontiguousarray(NEAR[:, prints].transpose(2, 0, 1)).view(np.uint8),  # block x value x item: the inverted lists
            }

    @staticmethod
    def _print(hashes: np.ndarray, roots: np.ndarray) -> np.ndarray:
        return fingerprints(hashes, roots, np.array([0]), len(hashes))[0]

    def known(self, runs: np.ndarray) -> np.ndarray:
        """Which runs are some item's shingle."""
        hit = self.maybe[(runs >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            k = np.minimum(np.searchsorted(self.hashes, runs[at]), len(self.hashes) - 1)
            hit[at] = self.hashes[k] == runs[at]
        return hit

    def leaks(self, text: str | bytes | None) -> list[Leak]:
        """The items that a text holds, each with its best window; ties to the first."""
        words = shingles.word_hashes(text)
        if not len(words) or not len(self.hashes):
            return []
        found: list[Leak] = []
        prepared: dict[int, tuple] = {}
        for size, own in self.by_size.items():
            width = min(WORDS, size)  # an item of fewer words is one shingle
            if width not in prepared:
                runs = shingles.run_hashes(words, width)
                hit = self.known(runs)
                prepared[width] = Runs(self, runs, hit) if hit.any() else None
            if prepared[width] is not None:
                found += self._in_windows(own, size, prepared[width])
        return sorted(found, key=lambda x: (x.start, x.words, str(x.item)))

    def _in_windows(self, own: dict, size: int, text: Runs) -> Iterator[Leak]:
        span = min(len(text.runs), size - min(WORDS, size) + 1)  # shingles in a window; a shorter text is one window
        starts = np.flatnonzero(text.upto[span:] - text.upto[: len(text.upto) - span] >= own["need"])
        if not len(starts):
            return
        prints = text.prints(starts, span)
        k = np.searchsorted(starts, text.at, "right")
        inside = (k > 0) & (text.at - starts[np.maximum(k - 1, 0)] < span)  # in some window
        at, places = text.at[inside], text.places[inside]
        for n in self.candidates(own, prints):
            held = self._held(own["sets"][n], own["weights"][n], at, places, starts, span) / own["weights"][n].sum()
            enough = np.flatnonzero(held >= SIMILARITY - 1e-9)
            if not len(enough):
                continue
            best = int(np.flatnonzero(held >= held.max() - 1e-12)[0])
            start, similarity = int(starts[best]), min(1.0, float(held[best]))
            distance = int(np.bitwise_count(prints[best] ^ own["prints"][n]).sum())
            for item in own["items"][n]:
                yield Leak(item, start, span + min(WORDS, size) - 1, similarity, distance, len(enough))

    @staticmethod
    def candidates(own: dict, prints: np.ndarray) -> list[int]:
        """The items of one size with a fingerprint within RADIUS of one of `prints`, found by their blocks."""
        found: set[int] = set()
        step = max(1, COUNTED // (BLOCKS * len(own["prints"])))
        for lo in range(0, len(prints), step):
            some = prints[lo : lo + step]
            count = own["near"][np.arange(BLOCKS), some].sum(axis=1, dtype=np.uint8)
            window, item = np.nonzero(count >= LEAST_BLOCKS)
            within = np.bitwise_count(some[window] ^ own["prints"][item]).sum(axis=1) <= RADIUS
            found.update(item[within].tolist())
        return sorted(found)

    @staticmethod
    def _held(item: np.ndarray, weights: np.ndarray, at: np.ndarray, places: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
        """The weight of the item's distinct shingles in each window: one that comes again counts by its last place."""
        k = np.minimum(np.searchsorted(item, places), len(item) - 1)
        own = np.flatnonzero(item[k] == places)
        k, at = k[own], at[own]
        order = np.lexsort((at, k))
        k, at = k[order], at[order]
        # The windows that hold a shingle at this place and not at its next one.
        lo, hi = np.searchsorted(starts, at - span + 1), np.searchsorted(starts, at, "right")
        again = np.flatnonzero(k[1:] == k[:-1])
        hi[again] = np.minimum(hi[again], np.searchsorted(starts, at[again + 1] - span + 1))
        size = len(starts) + 1
        return np.cumsum(np.bincount(lo, weights[k], size) - np.bincount(hi, weights[k], size))[:-1]


def _item_shingles(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(shingle) of every item, once for each item that has it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles.shingle_set(text, WORDS))], names=["shingle"])

    return benchmark.select(text_col).mapInArrow(rows, "shingle bigint")


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple]:
    """The benchmark's items in blocks of bounded number and size, each with the counts of its shingles over all blocks (see `Items`)."""
    shared = cut(_item_shingles(benchmark, text_col).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["b"] // ITEM_BLOCK_BYTES))
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == k)
        counts = shared.join(_item_shingles(own, text_col).distinct(), "shingle", "left_semi").toArrow()  # no more than the block's shingles
        hashes, n = counts["shingle"].to_numpy().astype(np.int64).view(np.uint64), counts["n"].to_numpy()
        order = np.argsort(hashes)
        # In one order, so that ties don't depend on partitions.
        yield sorted(((r[0], r[1]) for r in own.select(item_col, text_col).collect()), key=str), (hashes[order], n[order])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (`id_col`, `item_col`, start_word, n_words, similarity, distance, n_windows): a document's best window for each item that it holds.

    Similarity: the weight of the item's distinct shingles that the window holds, as
    a share of all of them; at least 0.8. A shingle weighs one over the number of
    items of the whole benchmark that have it. distance: bits by which the
    fingerprints differ. Words are runs of characters other than ASCII white space,
    A-Z lower-cased; items of fewer than five words are one shingle; documents shorter
    than an item are one window. Null, empty and blank texts and items hold and match
    nothing. Repeated rows of `docs` give their rows each; a null id stays null; of
    items that repeat an id each gives a row. Ids may be of any type; equal names for
    `id_col` and `item_col` raise ValueError. Empty tables give no rows; other columns
    aren't read. Documents are read whole, however long, and never shuffled: once for
    each ITEM_BLOCK items, as the index of one block is what a task keeps.
    """
    if id_col == item_col:
        raise ValueError("documents and items need ids of different names")
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    name = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, start_word bigint, n_words bigint, similarity double, distance int, n_windows bigint"
    found = []
    for block in _item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most ITEM_BLOCK_BYTES or so

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                at, got = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    for x in items.leaks(text):
                        at.append(k)
                        got.append(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())), pa.array([x.item for x in got], item_type),
                        pa.array([x.start for x in got], pa.int64()), pa.array([x.words for x in got], pa.int64()), pa.array([x.similarity for x in got], pa.float64()),
                        pa.array([x.distance for x in got], pa.int32()), pa.array([x.windows for x in got], pa.int64()),
                    ],
                    names=[id_col, item_col, "start_word", "n_words", "similarity", "distance", "n_windows"],
                )

        found.append(docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(rows, name))
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item of `benchmark` (see `leaks`), with the columns of `docs`; no shuffle."""
    for block in _item_blocks(benchmark, item_col, item_text_col):
        docs = docs.where(~_leaky(docs.sparkSession.sparkContext.broadcast(block))(F.col(text_col).cast("binary")))
    return docs


def _leaky(shared):
    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(*shared.value)
        for texts in batches:
            yield pd.Series([bool(items.leaks(t)) for t in texts], dtype=bool)

    return leaky
