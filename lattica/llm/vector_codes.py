"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are fitted in whole numbers over all rows, a Spark job a round. The nearest
entry is found by screening: a float32 matrix product gives every distance with an
interval that rounding cannot leave; each entry whose interval reaches the best one's
is evaluated again in 64-bit integers, and equal distances go to the lower number.
Rows or entries whose numbers could pass 64 bits are computed in Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut
from lattica.llm.topk import whole, whole_exactly

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Numbers in a block of vectors, of distances, or of products that are in the making at a time.
BLOCK = 1 << 20
#: Labels whose sums are broadcast, the most frequent ones: no other has over a 65th of the rows.
HOT_LABELS = 64
LONG_MAX = 2**63 - 1

_UNIT = 2.0**-24  # the relative rounding of float32


class Codebook:
    """The entries of one part position. `width`: its number of components, of which entries may leave out zeros at the end."""

    def __init__(self, entries: list[list[int]], width: int):
        self.entries, self.width = entries, width
        #: Up to here sums of squared differences, and what they are made of, fit 64 bits.
        self.limit = math.isqrt(2**60 // max(1, width)) // 2
        first = {}
        for k, e in enumerate(entries):
            first.setdefault(tuple(e), k)
        #: Of equal entries only the first can win.
        self.number = np.array(list(first.values()), np.int64)
        self.exact = [list(e) for e in first]
        self.large = any(abs(x) > self.limit for e in first for x in e)
        if not self.large:
            self.ints = np.zeros((len(first), max(map(len, first), default=0)), np.int64)
            for row, e in zip(self.ints, first, strict=True):
                row[: len(e)] = e
            self.squares = (self.ints**2).sum(axis=1)
            self.norms = np.sqrt(self.squares.astype(float)) * (1 + 1e-12)
            self.floats = self.ints.astype(np.float32)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest entry; `x` holds int64 within the limit, its missing columns are zeros."""
        m = min(x.shape[1], self.ints.shape[1])
        squares = (x**2).sum(axis=1)
        if len(self.number) == 1:
            return np.full(len(x), self.number[0]), squares + self.squares[0] - 2 * (x[:, :m] @ self.ints[0, :m])
        inner = (x[:, :m].astype(np.float32) @ self.floats[:, :m].T).astype(float)
        # Two conversions, a product and m - 1 sums in any order, against |x| |c|; then what the doubles round.
        gamma = (m + 4) * _UNIT / (1 - (m + 4) * _UNIT)
        norms = np.sqrt((x[:, :m].astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        slack = (2.001 * gamma) * norms[:, None] * self.norms[None, :] + 2.0**-48 * (self.squares + 2 * np.abs(inner))
        middle = self.squares - 2 * inner
        rows, cols = np.nonzero(middle - slack <= (middle + slack).min(axis=1)[:, None])
        exact = np.empty(len(rows), np.int64)
        step = max(1, BLOCK // max(1, m))
        for lo in range(0, len(rows), step):
            r, c = rows[lo : lo + step], cols[lo : lo + step]
            exact[lo : lo + step] = self.squares[c] - 2 * (x[r, :m] * self.ints[c, :m]).sum(axis=1)
        starts = np.searchsorted(rows, np.arange(len(x)))
        best = np.minimum.reduceat(exact, starts)
        winners = np.flatnonzero(exact == best[rows])
        winners = winners[np.searchsorted(rows[winners], np.arange(len(x)))]  # the first of each row
        return self.number[cols[winners]], best + squares

    def nearest_exactly(self, x: list[int]) -> tuple[int, int]:
        """The same for one row of any whole numbers."""
        found = []
        for k, e in zip(self.number.tolist(), self.exact, strict=True):
            n = min(len(x), len(e))
            found.append((sum((a - b) ** 2 for a, b in zip(x, e, strict=False)) + sum(a * a for a in x[n:]) + sum(b * b for b in e[n:]), k))
        best = min(found)
        return best[1], best[0]


class Codebooks:
    """A codebook for each part position of vectors of `width` components in all."""

    def __init__(self, entries: list[list[list[int]]], width: int):
        self.width = width
        self.parts = [Codebook(e, width) for e in entries]
        self.limit = min(p.limit for p in self.parts)
        self.large = any(p.large for p in self.parts)

    def blocks(self, lists: pa.ListArray, scale: float) -> Iterator[tuple[np.ndarray, list[np.ndarray | list[int]]]]:
        """Some rows' places and each part's whole numbers: of many rows as a matrix, or of one row as a list where they are large."""
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        begins = np.cumsum(lengths) - lengths
        numbers = whole(flat, scale)
        big = np.full(len(lengths), self.large)
        big[np.repeat(np.arange(len(lengths)), lengths)[np.abs(numbers) > self.limit]] = True
        cuts = [k * self.width for k in range(len(self.parts) + 1)]
        for k in np.flatnonzero(big).tolist():
            row = whole_exactly(flat[begins[k] : begins[k] + lengths[k]], scale)
            yield np.array([k]), [row[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
        rest = np.flatnonzero(~big)
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        lo = 0
        while lo < len(rest):  # rows of like lengths, so that a long one widens few
            hi = lo + max(1, int(np.searchsorted(np.maximum.accumulate(np.maximum(lengths[rest[lo:]], len(self.parts[0].number))) * np.arange(1, len(rest) - lo + 1), BLOCK, "right")))
            some = rest[lo:hi]
            size = lengths[some]
            block = np.zeros((len(some), int(size.max(initial=0))), np.int64)
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            block[np.repeat(np.arange(len(some)), size), within] = numbers[np.repeat(begins[some], size) + within]
            yield some, [block[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            lo = hi

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
        out, between = hashlib.sha256(), b""
        for part in self.parts:
            for e in part.entries if self.width else ():
                out.update(between + ",".join(map(str, e + [0] * (self.width - len(e)))).encode())
                between = b","
        return out.hexdigest()


def _trimmed(row: list[int]) -> list[int]:
    n = len(row)
    while n and not row[n - 1]:
        n -= 1
    return row[:n]


def _seeds(sound: DataFrame, n: int) -> list[list[float]]:
    """Vectors of the `n` smallest ids, ascending, equal ids by vector and null ids last."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.chunked_array([], type=pa.int64())
        for batch in batches:
            held = pa.chunked_array([*held.chunks, batch.column(0)]).combine_chunks().sort()[:n]
            held = pa.chunked_array([held])
        yield pa.RecordBatch.from_arrays([held.combine_chunks()], names=["id"])

    # The ids alone at first: so few of a task's ids can be meant.
    ids = [r[0] for r in sound.where(F.col("id").isNotNull()).select("id").mapInArrow(smallest, "id bigint").orderBy("id").limit(n).collect()]
    rows = sound.where(F.col("id") <= ids[-1]) if len(ids) == n else sound
    return [r[0] for r in rows.select("v", "id").orderBy(F.asc_nulls_last("id"), "v").limit(n).select("v").collect()]


def _round(sound: DataFrame, books: Codebooks, scale: float) -> Codebooks:
    """Codebooks whose entries are the floors of the means of the parts next to them; unused ones stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def add(part: int, entry: int, count: int, total: list[int]) -> None:
            have = held.setdefault((part, entry), [0, []])
            have[0] += count
            have[1] = [a + b for a, b in zip(have[1], total, strict=False)] + have[1][len(total) :] + total[len(have[1]) :]

        for batch in batches:
            for _, parts in books.blocks(batch.column(0), scale):
                for p, (book, x) in enumerate(zip(books.parts, parts, strict=True)):
                    if isinstance(x, list):
                        add(p, book.nearest_exactly(x)[0], 1, _trimmed(x))
                        continue
                    found, _ = book.nearest(x)
                    order = np.argsort(found, kind="stable")
                    used, starts = np.unique(found[order], return_index=True)
                    totals = np.add.reduceat(x[order], starts, axis=0) if x.shape[1] else np.zeros((len(used), 0), np.int64)
                    for entry, n, total in zip(used.tolist(), np.diff([*starts, len(x)]).tolist(), totals.tolist(), strict=True):
                        add(p, entry, n, _trimmed(total))
        yield _partial(held)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, entry, count, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have, total = held.setdefault((part, entry), [0, []]), [int(x) for x in total]
                have[0] += count
                have[1] = [a + b for a, b in zip(have[1], total, strict=False)] + have[1][len(total) :] + total[len(have[1]) :]
        yield _partial({k: [n, [x // n for x in total]] for k, (n, total) in held.items()})

    # A task gives a row for each entry at most; components as text, as they have no bound.
    kind = "part int, entry int, count bigint, total array<string>"
    found = sound.select("v").mapInArrow(sums, kind).repartition("part", "entry").mapInArrow(means, kind).collect()  # parts times entries
    entries = [[list(e) for e in book.entries] for book in books.parts]
    for r in found:
        entries[r["part"]][r["entry"]] = _trimmed([int(x) for x in r["total"]])
    return Codebooks(entries, books.width)


def _partial(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
    columns = [[k[0] for k in held], [k[1] for k in held], [v[0] for v in held.values()], [list(map(str, v[1])) for v in held.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["part", "entry", "count", "total"])


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """Rows (`id_col`, code, error, label_error, codebooks_sha256), one for each row whose vector is whole.

    Components become floor(scale * x). A part position's codebook starts as that part
    of the `entries` smallest ids' vectors, ascending (equal ids by vector, null ids
    last; fewer rows give fewer entries); in each round every part goes to its nearest
    entry, equal distances to the lower number, and each entry becomes the floor of the
    mean of its parts, by component. `code`: the final numbers in part order, as hex
    digits of one width; `error`: the squared distances summed over the parts, held at
    the largest long; `label_error`: errors summed over equal labels, nulls together,
    likewise; `codebooks_sha256`: digest of the final entries.

    Rows whose vector is null or holds a null, NaN or infinity are left out; finite
    components count however large. Vectors shorter than the longest, or not divisible
    by `parts`, count as padded with zeros, but are kept and computed at their own
    length. Repeated rows are coded each. Empty tables give no rows. Other columns are
    not read. `id_col` holds integers.

    Each round reads the table once and shuffles a row for each entry and task; the
    codebooks, `entries` rows of a vector's width, are all that the driver holds.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = raw.where(F.col("v").isNotNull() & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    width = -(-(sound.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    seeds = [whole_exactly(np.array(v, float), scale) for v in _seeds(sound, entries)]
    books = Codebooks([[_trimmed(s[p * width : (p + 1) * width]) for s in seeds] for p in range(parts)], width)
    for _ in range(rounds if seeds else 0):
        books = _round(sound, books, scale)
    digits = len(f"{entries - 1:x}")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [""] * batch.num_rows, [0] * batch.num_rows
            for rows, some in books.blocks(batch.column(1), scale):
                found = [book.nearest_exactly(x) if isinstance(x, list) else book.nearest(x) for book, x in zip(books.parts, some, strict=True)]
                if isinstance(some[0], list):
                    found = [([k], [d]) for k, d in found]
                else:
                    found = [(k.tolist(), d.tolist()) for k, d in found]
                for row, numbers, distances in zip(rows.tolist(), zip(*(f[0] for f in found), strict=True), zip(*(f[1] for f in found), strict=True), strict=True):
                    codes[row], errors[row] = "".join(f"{k:0{digits}x}" for k in numbers), min(LONG_MAX, sum(distances))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    label = vectors.schema[label_col].dataType.simpleString()
    coded = cut(sound.select("id", "v", "label").mapInArrow(code, f"id bigint, label {label}, code string, error bigint"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = cut(coded.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")))
    hot = F.broadcast(cut(sums.orderBy(F.desc("n"), "label").limit(HOT_LABELS)).select(F.col("label").alias("key"), "label_error"))
    same = F.col("label").eqNullSafe(F.col("key"))
    rest = sums.join(hot, same, "left_anti").select(F.col("label").alias("key"), "label_error")
    out = coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(rest, same))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
