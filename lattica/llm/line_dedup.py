"""Line dedup by a segment-partition edit join.

Two lines within `edits` edits share, at nearly the same place, at least one of
the edits + 1 segments into which either is cut. Each distinct line is listed under
its segments, by its length, the segment's number and its text; and it looks up the
substrings of its own that may equal a segment of a line as long or a little
shorter. Pairs so found whose counts of characters are too far apart for so few
edits are refused where they meet; the others are verified by a bit-parallel edit
distance over a band of 2 * edits + 1 diagonals. Equal lines are one from the start.

A segment with many lines, as of near copies, lists none of them. Its lines meet anew
where all but `edits` of 2 * edits pieces agree, those still in a crowd where all but
as many halves of these pieces do, and so on down to single characters, where lines
that agree in all others are within the edits for certain and each needs one link only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut
from lattica.operators.components import components

EDITS = 2
#: Shorter lines aren't compared for edits, and are left alone unless `equal_chars` says otherwise.
MIN_CHARS = 12
#: A task leaves out lines that it has listed already, as long as it remembers so many.
REMEMBERED = 300_000
#: Places of the bit table by which lines without partner are left out early; a full table leaves out none.
TABLE_BITS = 22
#: Lines listed under one key that others meet one by one; if there are more, all meet under finer keys.
CROWD = 32
#: With more edits the finer keys of a line are too many; all lines of a key then meet one by one.
FINE_EDITS = 2
#: Places of at most so many characters each are followed by single characters.
LAST_CHARS = 2


@lru_cache(maxsize=10_000)
def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of `parts` pieces of a line of `n` characters; the later are the longer by one."""
    short, longer = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


@lru_cache(maxsize=10_000)
def probes(n: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, size) of the substrings of a line of `n` characters that may equal a segment.

    By how far a segment can have moved: at most k edits lie left of segment k and
    edits - k right of it, or else another segment is unchanged.
    """
    out = []
    for length in range(max(edits + 1, n - edits), n + 1):
        more = n - length
        for k, (at, size) in enumerate(segments(length, edits + 1)):
            lo = max(0, at - k, at + more - (edits - k))
            hi = min(n - size, at + k, at + more + (edits - k))
            out += [(length, k, start, size) for start in range(lo, hi + 1)]
    return out


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Edits between two strings, or None if more than `most`: bit-parallel over a band about the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    if gap > most:
        return None
    lo, hi = 0, len(b)
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    while hi > lo and a[hi + gap - 1] == b[hi - 1]:
        hi -= 1
    a, b = a[lo : hi + gap], b[lo:hi]
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    # Bit k stands for row j - most + k of column j. Rows before the first count down to it.
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    down = (1 << most) - 1
    up, last, score = full ^ down, 1 << (gap + most), gap
    for j, c in enumerate(b):
        p = places.get(c, 0)
        p = (p >> (j - most) if j >= most else p << (most - j)) & full
        x = p | down
        same = (((x & up) + up) ^ up) | x  # cells equal to the one diagonally before
        fall = up & same
        rise = down | ~(up | same)
        if not same & last:
            score += 1
            if score > most:
                return None
        y = (rise << 1 | 1) & full
        down = (y & same & full) >> 1
        up = ((fall << 1 | ~(y | same)) & full) >> 1 | top
    return score


def segment_hashes(line: str, found: list[tuple[int, int, int, int]]) -> list[int]:
    """Hashes of (length, segment, text) for each (length, segment, start, size) of a line."""
    data = line.encode("utf-32-le", "surrogatepass")
    return [xxhash.xxh3_64_intdigest(data[4 * at : 4 * (at + size)], n << 8 | k) for n, k, at, size in found]


def character_counts(line: str) -> int:
    """How often characters of each of eight kinds occur, modulo 256, as the bytes of a signed integer.

    An edit changes two counts by one at most, so lines within k edits differ by 2 * k in all.
    """
    kinds = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) & 7
    return int(np.bincount(kinds, minlength=8).astype(np.uint8).view(np.int64)[0])


def counts_apart(a: str, b: str) -> Column:
    """By how much two columns of `character_counts` differ; never more than the counts themselves do."""
    total = F.lit(0)
    for k in range(8):
        d = F.abs(F.shiftright(F.col(a), 8 * k).bitwiseAND(F.lit(255)) - F.shiftright(F.col(b), 8 * k).bitwiseAND(F.lit(255)))
        total = total + F.least(d, 256 - d)
    return total


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def line_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, line, key) of every line of at least `min_chars` characters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, key = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for n, line in enumerate(lines_of(text)):
                    if len(line) >= min_chars:
                        at.append(k)
                        no.append(n)
                        key.append(line_key(line))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(no, pa.int32()), pa.array(key, pa.binary())], names=["doc", "text_hash", "line", "key"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col))
    return rows_in.mapInArrow(rows, "doc bigint, text_hash bigint, line int, key binary")


def _listed(docs: DataFrame, min_chars: int, text_col: str, of: Callable[[int], list[tuple[int, int, int, int]]]) -> DataFrame:
    """(segment, id, counts): hashes of the places that `of` gives for a line's length, for every distinct line (one may come again from another task)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            segment, ids, counts = [], [], []
            for text in batch.column(0).to_pylist():
                for line in lines_of(text):
                    if len(line) < min_chars:
                        continue
                    own = line_id(line_key(line))
                    if own in met:
                        continue
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met.add(own)
                    got = segment_hashes(line, of(len(line)))
                    segment += got
                    ids += [own] * len(got)
                    counts += [character_counts(line)] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(segment, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["segment", "id", "counts"])

    return docs.select(text_col).mapInArrow(rows, "segment bigint, id bigint, counts bigint")


def bit_table(ids: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """Which places of a table of 2 ** bits the ids (id) take; at most 2 ** (bits - 6) rows reach the driver."""
    place = F.pmod(F.col("id"), F.lit(1 << bits))
    words = ids.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(id, {1 << bits}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in words.collect():
        table[r["w"]] = r["b"]
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _texts(docs: DataFrame, pairs: DataFrame, min_chars: int, text_col: str) -> DataFrame:
    """(id, key, line) of the lines named in `pairs` (a, b); b may be null."""
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b").where("b is not null")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(wanted)).tobytes())  # 2 ** TABLE_BITS bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, met = np.unpackbits(np.frombuffer(shared.value, np.uint8)).tolist(), set()
        mask = len(maybe) - 1
        for batch in batches:
            ids, keys, lines = [], [], []
            for text in batch.column(0).to_pylist():
                for line in lines_of(text):
                    if len(line) >= min_chars and maybe[(own := line_id(key := line_key(line))) & mask] and key not in met:
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(key)
                        ids.append(own)
                        keys.append(key)
                        lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(lines, pa.string())], names=["id", "key", "line"])

    found = docs.select(text_col).mapInArrow(rows, "id bigint, key binary, line string")
    return found.join(wanted, "id", "left_semi").dropDuplicates(["id", "key"])


Spans = tuple[tuple[int, int], ...]
#: Free places of the shorter line, and by how much what follows each is moved in the other; the last number is the difference in length.
Place = tuple[Spans, tuple[int, ...]]


@lru_cache(maxsize=10_000)
def moves(edits: int, steps: int, end: int) -> list[tuple[int, ...]]:
    """By how much what follows each of `steps` free places can be moved, if it is `end` after the last."""
    out = [((), 0, 0)]
    for k in range(steps):
        out = [((*m, to), to, n + abs(to - at)) for m, at, n in out for to in (range(-edits, edits + 1) if k < steps - 1 else [end]) if n + abs(to - at) <= edits]
    return [m for m, _, _ in out]


def fixed(n: int, free: Spans) -> list[tuple[int, int]]:
    """What a line of `n` characters has before, between and after its free places."""
    return list(zip([0, *(hi for _, hi in free)], [*(lo for lo, _ in free), n], strict=True))


def moved(n: int, free: Spans, move: tuple[int, ...], most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(start, end, move) of what is fixed, or None if it can't lie so, has another name, or may take more than `most` edits."""
    out, own, other, cost = [], 0, 0, 0
    for k, ((lo, hi), by) in enumerate(zip(fixed(n, free), (0, *move), strict=True)):
        if k:
            size = free[k - 1][1] - free[k - 1][0]
            own, other = own + size, other + size + by - out[-1][2]
            if lo < hi or k == len(move):
                if other < 0:
                    return None
                cost, own, other = cost + max(own, other), 0, 0
            elif by != out[-1][2]:  # what is empty counts as not moved
                return None
        out.append((lo, hi, by))
    return None if most is not None and cost > most else out


def places(n: int, edits: int, difference: int) -> list[Place]:
    """All places of a line of `n` characters and one longer by `difference`."""
    cuts = [(at, at + size) for at, size in segments(n, 2 * edits) if size]
    return [(free, m) for free in combinations(cuts, min(edits, len(cuts))) for m in moves(edits, min(edits, len(cuts)), difference) if moved(n, free, m)]


def is_last(free: Spans) -> bool:
    """Whether the places within these are single characters and gaps."""
    return all(hi - lo <= LAST_CHARS for lo, hi in free)


def finer(n: int, edits: int, place: Place) -> list[Place]:
    """The places within a place that may hold the edits of two lines that agree outside it."""
    free, move = place
    last = is_last(free)
    if last:
        options = [x for lo, hi in free for p in range(lo, hi) for x in ((p, p), (p, p + 1))]
    else:
        options = [x for lo, hi in free for x in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)) if x[0] < x[1]]
    sure = [x for x in moved(n, free, move) or [] if x[0] < x[1]]
    out = []
    for size in range(1 if last else min(edits, len(options)), min(edits, len(options)) + 1):
        for within in combinations(options, size):
            for m in moves(edits, size, move[-1]):
                got = moved(n, within, m, edits if last else None)
                if got and all(any(lo <= x and y <= hi and by == z for lo, hi, by in got if lo < hi) for x, y, z in sure):
                    out.append((within, m))
    return out


def place_key(line: str, n: int, place: Place) -> bytes:
    """Hash of the free places and of all that a line has outside them."""
    text = "\n".join([f"{n} {place[0]}", *(line[lo + by : hi + by] for lo, hi, by in moved(n, *place) or [] if lo < hi)])
    return xxhash.xxh3_128_digest(text.encode("utf-32-le", "surrogatepass"))


def _placed(lines: DataFrame, edits: int) -> DataFrame:
    """(key, id, counts, listed, last, place): a row for each place of each line (id, line, within); the finer ones of those that `within` lists, or all if it is null.

    `place` is its numbers in a row. Lines end in a newline here, so that what is added to one stands before a character.
    """

    def of(line: str, within: list[list[int]] | None) -> Iterator[tuple[int, Place, bool]]:
        if within is None:
            for d in range(min(edits, len(line) - 1) + 1):
                yield from ((len(line) - d, x, False) for x in places(len(line) - d, edits, d))
            return
        met = set()
        for numbers in within:
            k = len(numbers) // 3
            place = tuple(zip(numbers[:k], numbers[k : 2 * k], strict=True)), tuple(numbers[2 * k :])
            n = len(line) - place[1][-1]
            for x in finer(n, edits, place):
                if (n, x) not in met:
                    met.add((n, x))
                    yield n, x, is_last(place[0])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                key, ids, counts, listed, ends, numbers = [], [], [], [], [], []
                for own, line, within in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    count = character_counts(line)
                    line += "\n"
                    for n, (free, move), last in of(line, within):
                        key.append(place_key(line, n, (free, move)))
                        ids.append(own)
                        counts.append(count)
                        listed.append(not any(move))
                        ends.append(last)
                        numbers.append([*(x for x, _ in free), *(x for _, x in free), *move])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(listed, pa.bool_()), pa.array(ends, pa.bool_()), pa.array(numbers, pa.list_(pa.int32()))],
                    names=["key", "id", "counts", "listed", "last", "place"],
                )

    return lines.select("id", "line", "within").mapInArrow(rows, "key binary, id bigint, counts bigint, listed boolean, last boolean, place array<int>")


def crowd_pairs(texts: DataFrame, crowd: DataFrame, edits: int) -> Iterator[DataFrame]:
    """(a, b): ids of pairs among the lines (id, line) whose ids are in `crowd` (id); all that are within `edits` edits are linked by those that are.

    Each round narrows the places that the edits may be at; only lines that still are
    in a crowd come to the next, for as many rounds as a line can be halved.
    """
    lines = texts.select("id", "line").join(crowd, "id", "left_semi")
    now = lines.withColumn("within", F.lit(None).cast("array<array<int>>"))
    by_key = Window.partitionBy("key")
    while True:
        placed = _placed(now, edits).select("*", F.count("*").over(by_key).alias("rows"), F.sum(F.col("listed").cast("int")).over(by_key).alias("n"), F.min(F.when(F.col("listed"), F.col("id"))).over(by_key).alias("least"))
        placed = cut(placed.where("n > 0 and rows > 1"))
        yield placed.where("last and id <> least").select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b"))
        few = placed.where(f"not last and n <= {CROWD}")
        other = few.where("listed").select("key", F.col("id").alias("other"), F.col("counts").alias("other_counts"))
        met = few.select("key", "id", "counts").join(other, "key").where((F.col("id") != F.col("other")) & (counts_apart("counts", "other_counts") <= 2 * edits))
        yield met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        within = cut(placed.where(f"not last and n > {CROWD}").groupBy("id").agg(F.collect_set("place").alias("within")))
        if within.isEmpty():
            return
        now = lines.join(within, "id")


def candidates(docs: DataFrame, edits: int, min_chars: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(a, b): ids of pairs of lines; all lines that are within `edits` edits are linked by those of them that are. And (id, key, line) of these lines."""
    listed = _listed(docs, min_chars, text_col, lambda n: [(n, k, at, size) for k, (at, size) in enumerate(segments(n, edits + 1))])
    looked = _listed(docs, min_chars, text_col, lambda n: [x for x in probes(n, edits) if x[0] >= min_chars])
    # Dealt out once, by what its lines are made distinct, counted and joined by.
    other = listed.select("segment", F.col("id").alias("other"), F.col("counts").alias("other_counts")).repartition("segment").distinct()
    by_segment = Window.partitionBy("segment")
    crowded = F.count("*").over(by_segment) > CROWD if edits <= FINE_EDITS else F.lit(False)
    other = other.select("*", crowded.alias("crowded"), F.min("other").over(by_segment).alias("least")).where("not crowded or other = least").drop("least")
    near = (F.col("id") != F.col("other")) & (counts_apart("counts", "other_counts") <= 2 * edits)
    met = looked.join(other, "segment").where(F.col("crowded") | near)
    # Lines that look up a crowded segment, those that are listed under it among them, come without partner.
    met = cut(met.select(F.when(F.col("crowded"), F.col("id")).otherwise(F.least("id", "other")).alias("a"), F.when(~F.col("crowded"), F.greatest("id", "other")).alias("b")).distinct())
    texts = cut(_texts(docs, met, min_chars, text_col))
    pairs, crowd = met.where("b is not null"), met.where("b is null").select(F.col("a").alias("id"))
    if not crowd.isEmpty():
        for more in crowd_pairs(texts, crowd, edits):
            pairs = pairs.union(more)
        pairs = pairs.distinct()
    return pairs, texts


def near_lines(docs: DataFrame, edits: int, min_chars: int, text_col: str) -> DataFrame:
    """(a, b): keys of pairs of different lines within `edits` edits, which link all lines that are."""
    pairs, texts = candidates(docs, edits, min_chars, text_col)
    first = texts.select(F.col("id").alias("a"), F.col("key").alias("a_key"), F.col("line").alias("a_line"))
    second = texts.select(F.col("id").alias("b"), F.col("key").alias("b_key"), F.col("line").alias("b_line"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_distance(x, y, edits) is not None for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(first, "a").join(second, "b").select("a_key", "b_key", "a_line", "b_line")
    return both.mapInArrow(rows, "a_key binary, b_key binary").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", equal_chars: int | None = None) -> DataFrame:
    """Rows (`id_col`, text_hash, line, first_doc, first_line, equal): every line that repeats an earlier one, whole.

    Lines are what stands between newlines, numbered from 0. Lines of at least
    `min_chars` characters are in one class if they are equal or linked by steps of
    at most `edits` edits; the class's first line stays: the smallest id, then text
    hash, then line. `equal`: the line equals the one that stays. Shorter lines of at
    least `equal_chars` characters (`min_chars`, if not given) are in one class only
    if they are equal; still shorter ones are left alone, as are null and empty texts. Rows with a null id count as one
    document before all others. Rows that repeat an id and a text are one document;
    with other texts they come in order of their texts' hashes. An empty table gives
    no rows. Other columns aren't read.
    """
    if not 0 <= edits < 100 or min_chars < edits + 1:
        raise ValueError("lines need at least a character for each segment, and fewer than 100 edits")
    least = min_chars if equal_chars is None else min(equal_chars, min_chars)
    lines = cut(line_rows(docs, least, id_col, text_col).distinct())
    place = F.struct("doc", "text_hash", "line")
    classes = lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    label = components(near_lines(docs, edits, min_chars, text_col)) if edits else None
    if label is None:
        first = classes.where("n > 1").select("key", F.col("first").alias("stays"), F.col("first").alias("own"))
    else:
        linked = classes.join(label, F.col("key") == F.col("node"))
        heads = linked.groupBy("component").agg(F.min("first").alias("stays"))
        linked = linked.join(heads, "component").select("key", "stays", F.col("first").alias("own"))
        alone = classes.where("n > 1").join(label, F.col("key") == F.col("node"), "left_anti").select("key", F.col("first").alias("stays"), F.col("first").alias("own"))
        first = linked.unionByName(alone)
    out = lines.join(first, "key").where(~place.eqNullSafe(F.col("stays")))
    return out.select(F.col("doc").alias(id_col), "text_hash", "line", F.col("stays.doc").alias("first_doc"), F.col("stays.line").alias("first_line"), F.col("own").eqNullSafe(F.col("stays")).alias("equal"))


def without_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the lines in `repeats` (of `repeated_lines`) taken out of their texts; other columns as they were."""
    gone = repeats.groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("line").alias("__gone"))
    keyed = docs.withColumn("__text", F.xxhash64(text_col))
    joined = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda line, n: ~F.array_contains("__gone", n)), "\n")
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns])
