"""Phrase collocations by pivot partitioning.

Every phrase belongs to its rarest word, its pivot. A text is rewritten once for each
of its words: of the words about it those stay that come before any rarer one, so that
just the phrases are left that the word owns. These fragments go to the pivot's
partition, which is divided by the pivot's neighbour in the phrase (the next word, or
the one before where the pivot ends the phrase), so that each phrase is counted whole
in one place, whatever its pivot's frequency. A partition whose fragments come less
often than the least frequency is passed over; the others are mined where they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: Words of the longest phrases.
LONGEST = 4
#: Cells of the table that tells a word's frequency, a byte each; words that share one count as the more frequent.
CELLS = 1 << 24
#: A pair of words with a larger share of all pairs has its fragments dealt out by their text; fewer than this many can.
HOT = 8192
#: Bytes of text that are rewritten at a time, fragments that a task gathers, and phrases that it counts, before it hands them on.
SLICE, GATHERED, COUNTED = 1 << 21, 300_000, 500_000
#: Words that a worker keeps numbers of.
KNOWN_WORDS = 400_000
#: Parts of a language's candidates that are ranked apart before they are ranked together.
RANK_PARTS = 64

_BREAK, _JOIN = b"\xff", "."  # no byte of UTF-8; a sign that breaks
_SIGNS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _BREAK * 10)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """One number for two in order."""
    with np.errstate(over="ignore"):
        x = (a * _ODD + np.uint64(kind)) ^ (b + (a << np.uint64(17)))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words of some texts at a time; a break between pieces and between texts."""

    def words(texts: list[str]) -> list[bytes]:
        # bytes.lower changes A-Z alone; what splits here are spaces and tabs, as the other white space has become breaks.
        return f" {_JOIN} ".join(texts).encode().lower().translate(_SIGNS).replace(_BREAK, b" \xff ").split()

    for batch in batches:
        held: dict[str, list[str]] = {}
        size: Counter[str] = Counter()
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size[lang] > SLICE:
                yield lang, words(held.pop(lang))
                size[lang] = 0
        for lang, texts in held.items():
            yield lang, words(texts)


class _Words:
    """Numbers of the words met by this task: 0 is the break."""

    def __init__(self, table: bytes | None = None):
        self.table = None if table is None else np.frombuffer(table, np.uint8)
        self.by_lang: dict[str, tuple[dict[bytes, int], list[int]]] = {}
        self.n = 0

    def numbers(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int], list[int]]:
        """Each word's number, and the words and their hashes by number."""
        if self.n > KNOWN_WORDS:
            self.by_lang, self.n = {}, 0
        known, hashes = self.by_lang.setdefault(lang, ({_BREAK: 0}, [0]))
        new = set(words).difference(known)
        for w in new:
            known[w] = len(hashes)
            hashes.append(word_hash(lang, w))
        self.n += len(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), known, hashes

    def order(self, hashes: np.ndarray) -> np.ndarray:
        """The larger, the more frequent; 0 for words below the least frequency. One total order for all tasks."""
        level = self.table[hashes % np.uint64(len(self.table))].astype(np.int64)
        level[0] = 0
        return np.where(level > 0, level << 54 | (hashes >> np.uint64(10)).astype(np.int64), 0)


def _counts(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n): every word, and the pairs that hold a `hot`-th of their slice or more."""
    numbered = _Words()
    held: Counter[tuple[str, int, bytes]] = Counter()

    def out() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, list(held.values())], (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["lang", "words", "phrase", "n"])

    for lang, words in _slices(batches):
        ids, known, hashes = numbered.numbers(lang, words)
        names = list(known)
        n = np.bincount(ids, minlength=len(hashes))
        met = np.flatnonzero(n)
        for k, c in zip(met.tolist(), n[met].tolist(), strict=True):
            if k:
                held[lang, 1, names[k]] += c
        a, b = ids[:-1], ids[1:]
        pairs, times = np.unique((a << 32 | b)[(a > 0) & (b > 0)], return_counts=True)
        often = times * hot >= len(words)
        for p, c in zip(pairs[often].tolist(), times[often].tolist(), strict=True):
            held[lang, 2, names[p >> 32] + b" " + names[p & 0xFFFFFFFF]] += c
        if len(held) > GATHERED:
            yield out()
            held.clear()
    yield out()


#: A fragment's key: a hash of pivot and neighbour, whether it holds a part of their fragments only, and how often the fragment comes.
TIMES_BITS = 16
TIMES = (1 << TIMES_BITS) - 1


def _fragments(table: bytes, hot: dict[int, int]):
    """(key, fragment): by pivot and neighbour. A fragment is the pivot's place, the language, and the words."""
    hot_keys = np.array(sorted(hot), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = _Words(table)
        counts: Counter[bytes] = Counter()
        keys: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            found, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            key = np.fromiter(map(keys.__getitem__, found), np.uint64, len(found)).view(np.int64)
            many = np.flatnonzero(times > TIMES).tolist()
            more = [(k, min(TIMES, int(times[k]) - lo)) for k in many for lo in range(TIMES, int(times[k]), TIMES)]
            key = np.concatenate([key | np.minimum(times, TIMES), np.array([key[k] | n for k, n in more], np.int64)])
            counts.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(found + [found[k] for k, _ in more], pa.binary())], names=["key", "fragment"])

        for lang, words in _slices(batches):
            ids, _, hashes = numbered.numbers(lang, words)
            hashes = np.array(hashes, np.uint64)
            order = numbered.order(hashes)[ids]
            h = hashes[ids]
            reach = LONGEST - 1
            wide = np.concatenate([np.zeros(reach, np.int64), order, np.zeros(reach, np.int64)])
            left, right = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            on_left, on_right = order > 0, order > 0
            for s in range(1, reach + 1):  # the leftmost of equal words owns
                on_left = on_left & (wide[reach - s : reach - s + len(ids)] > order)
                on_right = on_right & (wide[reach + s : reach + s + len(ids)] >= order)
                left += on_left
                right += on_right
            begins = [b"%d%b\xff" % (k, lang.encode()) for k in range(LONGEST)]
            for side, at in ((1, np.flatnonzero(right)), (0, np.flatnonzero(left))):
                # With the next word: phrases that hold both. Else: those that the pivot ends.
                before = np.minimum(left[at], reach - side)
                lo, hi = at - before, at + (right[at] if side else 0) + 1
                other = at + 1 if side else at - 1
                key = _mixed(h[at], h[other], side) & ~np.uint64(2 * TIMES + 1)
                found = [begins[k] + b" ".join(words[a:b]) for k, a, b in zip(before.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                key_list = key.tolist()
                if len(hot_keys):
                    first, second = (at, other) if side else (other, at)
                    pair = _mixed(h[first], h[second], 2)
                    for k in np.flatnonzero(np.isin(pair, hot_keys)).tolist():
                        deal = xxhash.xxh32_intdigest(found[k]) % hot[int(pair[k])]
                        key_list[k] = xxhash.xxh64_intdigest(key_list[k].to_bytes(8, "little"), seed=deal) & ~(2 * TIMES + 1) | TIMES + 1
                counts.update(found)
                keys.update(zip(found, key_list, strict=True))
            if len(counts) > GATHERED:
                yield out()
        yield out()

    return run


def _phrases(at: int, words: list[bytes]) -> list[bytes]:
    """The phrases of a fragment that its pivot and neighbour own."""
    n = len(words)
    if at == n - 1:
        return [b" ".join(words[s:n]) for s in range(at)]
    return [b" ".join(words[s:e]) for s in range(at + 1) for e in range(at + 2, min(n, s + LONGEST) + 1)]


def _mine(least: int):
    """(lang, phrase, a) of fragments sorted by key; below `least` only where a key's counts are not whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, dict[bytes, int]] = {}
        ready: list[tuple[bytes, bytes, int]] = []
        key, whole, seen, waiting = None, True, 0, []

        def out() -> pa.RecordBatch:
            lang, phrase, n = zip(*ready, strict=True) if ready else ((), (), ())
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()).cast(pa.string()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64())], names=["lang", "phrase", "a"])

        def end() -> None:
            ready.extend((lang, p, n) for lang, found in counts.items() for p, n in found.items() if n >= least or not whole)
            counts.clear()

        def count(rows: list[tuple[bytes, int]]) -> int:
            for fragment, n in rows:
                head, _, body = fragment.partition(_BREAK)
                found = counts.setdefault(head[1:], {})
                for p in _phrases(head[0] - 48, body.split(b" ")):
                    found[p] = found.get(p, 0) + n
            return sum(map(len, counts.values()))

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            keys, n = keys >> TIMES_BITS, keys & TIMES
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            totals, ends = np.add.reduceat(n, starts), np.append(starts[1:], len(keys))
            often = (totals >= least) | (keys[starts] & 1 > 0)
            often[0] = often[-1] = True  # may go on in another batch
            for g in np.flatnonzero(often).tolist():
                lo, hi = int(starts[g]), int(ends[g])
                if keys[lo] != key:
                    end()
                    key, whole, seen, waiting = keys[lo], not keys[lo] & 1, 0, []
                rows = list(zip(batch.column(1).slice(lo, hi - lo).to_pylist(), n[lo:hi].tolist(), strict=True))
                seen += int(totals[g])
                if whole and seen < least:
                    waiting += rows
                    continue
                counted = count(waiting + rows)
                waiting = []
                if counted > COUNTED:
                    whole = False
                    end()
            if len(ready) > COUNTED:
                yield out()
        end()
        yield out()

    return run


def _levels(words: DataFrame, least: int, cells: int) -> bytes:
    """A byte for each cell: an eighth of the binary logarithm of the highest frequency there, 0 below `least`."""
    block = min(cells, 1 << 16)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [(word_hash(lang, w) % cells, min(255, 1 + int(8 * math.log2(n / least)))) for lang, w, n in rows]
            cell, level = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([c // block for c in cell], pa.int32()), pa.array([c % block for c in cell], pa.int32()), pa.array(level, pa.int32())], names=["block", "cell", "level"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            which, cell, level = (c.to_numpy() for c in batch.columns)
            for b in np.unique(which).tolist():
                np.maximum.at(blocks.setdefault(b, np.zeros(block, np.uint8)), cell[which == b], level[which == b].astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bytes"])

    frequent = words.where(F.col("n") >= least).select("lang", "phrase", "n")
    rows = frequent.mapInArrow(located, "block int, cell int, level int").repartition("block").mapInArrow(filled, "block int, bytes binary").collect()  # `cells` bytes at most
    table = bytearray(cells)
    for r in rows:
        table[r["block"] * block : (r["block"] + 1) * block] = r["bytes"]
    return bytes(table)


def frequent_phrases(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang", cells: int = CELLS, hot_pairs: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) for all phrases of 1 to LONGEST words that come `least` times or more; and (lang, n), all word occurrences."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counts(batches, hot_pairs)

    counts = cut(texts.mapInArrow(count, "lang string, words int, phrase binary, n bigint").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")))
    words = counts.where("words = 1")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    everything = totals.agg(F.sum("n")).first()[0] or 0
    # What a slice left out is under a `hot_pairs`-th of it, so pairs with twice that share of all are here, and no more than `hot_pairs`.
    share = max(1, everything // hot_pairs)
    hot = {}
    for r in counts.where("words = 2").where(F.col("n") >= share).collect():
        a, b = (np.array([word_hash(r["lang"], bytes(w))], np.uint64) for w in bytes(r["phrase"]).split(b" "))
        hot[int(_mixed(a, b, 2)[0])] = 2 + r["n"] // share
    table = docs.sparkSession.sparkContext.broadcast(_levels(words, least, cells))

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fragments(table.value, hot)(batches)

    dealt = texts.mapInArrow(fragments, "key bigint, fragment binary").repartition(F.shiftright("key", TIMES_BITS)).sortWithinPartitions("key")
    mined = dealt.mapInArrow(_mine(least), "lang string, phrase binary, a bigint").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    found = words.where(F.col("n") >= least).select("lang", "phrase", F.col("n").alias("a")).unionByName(mined)
    shown = found.select("lang", F.col("phrase").cast("string").alias("phrase"), "a")
    return cut(shown.withColumn("words", F.size(F.split("phrase", " ")))), totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang", cells: int = CELLS, hot_pairs: int = HOT) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's `top` collocations.

    A-Z is lower-cased; `.,;:!?` and line breaks cut texts into pieces, spaces and tabs
    those into words. All counts are by language, null being `und`: `n` of all words, f
    of a phrase's occurrences within pieces, overlaps included. Candidates are phrases
    of 2 to 4 words with a = f(phrase) >= `least`. Cut after some words, l = f(first
    part) and r = f(rest) give floor(2000000 a / (l + r)); the lowest score of all cuts
    counts, equal ones go to the earliest cut. A candidate goes if a longer one that
    holds its words in a row has 100 f(longer) >= 80 a. Order: score and a falling,
    phrase rising by UTF-8 bytes. Products are decimals, so they are exact beyond 64 bits.

    Null and empty texts and empty tables give no words; repeated rows count each; texts
    are read whole. Other columns are not read. What is broadcast has a size of its own:
    `cells` bytes and at most `hot_pairs` pairs; words that share a cell only change which of a
    phrase's words owns it.
    """
    frequent, totals = frequent_phrases(docs, least, text_col, lang_col, cells, hot_pairs)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    parts = lambda lo, n: F.concat_ws(" ", F.slice("list", lo, n))
    several = frequent.where("words > 1").withColumn("list", F.split("phrase", " "))

    cuts = several.select("lang", "phrase", "words", "a", "list", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", parts(F.lit(1), F.col("k")).alias("first"), parts(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: F.concat_ws(" ", F.slice("list", at, n)))))
    inside = several.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * 80))

    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
