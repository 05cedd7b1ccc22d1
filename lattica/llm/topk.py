"""Exact top-k inner products by MaxScore over shards of integer vectors.

A query's terms are the components where it isn't zero. Within a shard, each
term's contribution lies between two bounds that the shard's smallest and largest
component give. Terms are ordered by what they can add above their least; the
essential ones are those without which a row cannot reach the score to beat. The
essential terms are traversed for all rows of the shard; the others are probed,
in groups of falling bound, only for the rows that can still reach it. The shards'
best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import integers

#: Vectors in a packed shard; with 64 components, 1 MB.
SHARD_ROWS = 2048
#: Queries that meet a shard together.
QUERY_ROWS = 512
#: Rows of a shard that are scored whole where no score to beat is known yet.
SEED_ROWS = 256
#: Components that non-essential probing adds between two prunings.
PROBE = 8
#: Groups of vectors that every query is sent to, however few vectors there are to a query.
GROUPS = 64
#: Queries whose best rows a task holds before it hands them on.
HELD_QUERIES = 20_000
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)

#: A row met: (minus its score, its id), so that the best sorts first.
Found = list[tuple[int, int]]


def whole(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), infinite where a double can't hold it."""
    with np.errstate(over="ignore"):
        return np.floor(rows * scale)


def whole_exactly(row: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) of finite components as Python's integers."""
    return [math.floor(y) if math.isfinite(y := x * scale) else math.floor(Fraction(x) * Fraction(scale)) for x in row.tolist()]


class Shard:
    """Vectors of one shard, column by column, with the bounds of each column."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, scale: float):
        self.ids, self.raw, self.scale, self.rows = ids, raw, scale, whole(raw, scale)
        self.columns = np.ascontiguousarray(self.rows.T)  # the postings of each term
        self.low, self.high = self.rows.min(axis=0), self.rows.max(axis=0)
        self.top = float(np.abs(self.rows).max(initial=0.0))

    def best(self, query_id: int, raw: np.ndarray, k: int, known: Found) -> Found:
        """The query's k best rows here that can still enter its k best `known`."""
        query, width = whole(raw, self.scale), self.rows.shape[1]
        if max(self.top, 1.0) * max(float(np.abs(query).max(initial=0.0)), 1.0) * max(1, width) >= 2**53:
            return self._in_integers(query_id, raw, k)
        beat = -known[-1][0] if len(known) >= k else self._seed(query_id, query, k)
        least, most = np.minimum(query * self.low, query * self.high), np.maximum(query * self.low, query * self.high)
        gain = most - least
        terms = np.argsort(-gain, kind="stable")
        terms = terms[query[terms] != 0]
        at = len(terms)
        if beat is not None:
            # The most that a row gets that has its least in the terms before t.
            without = least.sum() + np.concatenate([np.cumsum(gain[terms][::-1])[::-1], [0.0]])
            at = int(np.argmax(without < beat)) if (without < beat).any() else len(terms)
        alive = np.flatnonzero(self.ids != query_id)
        score = (query[terms[:at]] @ self.columns[terms[:at]])[alive]
        while True:
            if beat is not None:
                keep = score + most[terms[at:]].sum() >= beat
                alive, score = alive[keep], score[keep]
            if at >= len(terms) or not len(alive):
                break
            probe = terms[at : at + PROBE]
            score = score + query[probe] @ self.columns[np.ix_(probe, alive)]
            at += PROBE
        if len(score) > 4 * k:  # only ties with the k-th need their ids compared
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[keep], score[keep]
        return sorted(zip((-score).astype(np.int64).tolist(), self.ids[alive].tolist(), strict=True))[:k]

    def _seed(self, query_id: int, query: np.ndarray, k: int) -> float | None:
        """A score that k rows here reach, or None."""
        some = np.unique(np.linspace(0, len(self.ids) - 1, min(len(self.ids), SEED_ROWS)).astype(np.int64))
        some = some[self.ids[some] != query_id]
        return float(np.sort(self.rows[some] @ query)[-k]) if len(some) >= k else None

    def _in_integers(self, query_id: int, raw: np.ndarray, k: int) -> Found:
        """Where floats would round: every row scored in Python's integers."""
        query = whole_exactly(raw, self.scale)
        held = lambda s: min(LONG_MAX, max(LONG_MIN, s))
        scores = (held(sum(a * b for a, b in zip(query, whole_exactly(r, self.scale), strict=True))) for r in self.raw)
        return sorted((-s, i) for s, i in zip(scores, self.ids.tolist(), strict=True) if i != query_id)[:k]


def _pack(limit: int, width: int):
    """Vectors of a partition, `limit` at a time, as one row of bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, limit):
                part = batch.slice(lo, limit)
                lists = part.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                block = np.zeros((len(lists), width))
                within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                block[np.repeat(np.arange(len(lists)), lengths), within] = flat
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([block.tobytes()], pa.binary())], names=["ids", "block"])

    return run


def group_count(n: int, asked: int, shard_rows: int) -> int:
    """Into how many groups `n` vectors are dealt: a few packed shards to each, but never so many that sending `asked` queries to all moves more than the vectors themselves, or GROUPS times the queries."""
    return max(1, min(-(-n // (4 * shard_rows)), max(GROUPS, n // max(1, asked))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's `k` best rows by inner product of floor(scale * x).

    `is_query` is a boolean column over `vectors` that states the query set; every
    row but those with the query's own id is a candidate, repeated rows each. Fewer
    than `k` candidates give as many rows; equal scores go to the smaller id. Rows
    whose id or vector is null, or whose vector holds a null, NaN or infinity, take no
    part; finite components count however large. Shorter vectors count as padded with
    zeros, so an empty one scores 0; long ones widen all. A query row that repeats an
    id and vector is asked once; an id with several vectors is asked with each, and
    their rows compete for its k places. Scores beyond a long are held at its ends.
    Empty tables give no rows; other columns aren't read. Ids are integers; another
    type of `id_col` raises TypeError.

    Rows are packed into shards and those dealt into groups, queries into blocks, and
    each block meets each shard in a join on the group's number. A task carries a query's k-th best score
    from shard to shard as the score to beat and hands on k rows of a query.
    """
    integers(vectors, id_col)
    taken = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asked"))
    sound = taken.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    size = sound.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asked").alias("asked")).first()
    n, width = size["n"], size["width"] or 1
    groups = group_count(n, size["asked"], shard_rows)
    packed = "ids binary, block binary"
    shards = sound.select("id", "v").mapInArrow(_pack(shard_rows, width), packed).select(F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("at"), F.col("ids").alias("s_ids"), F.col("block").alias("s_block"))
    asked = sound.where("asked").select("id", "v").distinct().repartition(max(1, size["asked"] // query_rows), "id").mapInArrow(_pack(query_rows, width), packed)
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("at"), F.col("ids").alias("q_ids"), F.col("block").alias("q_block"))
    # Sizes guessed from the files say little of packed and copied blocks: none may be gathered for a broadcast.
    met = shards.join(asked.hint("merge"), "at").select("s_ids", "s_block", "q_ids", "q_block")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Found] = {}
        last, shard = None, None
        for batch in batches:
            for s_ids, s_block, q_ids, q_block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != s_ids:
                    ids = np.frombuffer(s_ids, np.int64)
                    last, shard = s_ids, Shard(ids, np.frombuffer(s_block).reshape(len(ids), width), scale)
                asked_ids = np.frombuffer(q_ids, np.int64)
                for q, query in zip(asked_ids.tolist(), np.frombuffer(q_block).reshape(len(asked_ids), width), strict=True):
                    known = held.get(q, [])
                    held[q] = sorted([*known, *shard.best(q, query, k, known)])[:k]
                if len(held) > HELD_QUERIES:
                    yield _out(held)
                    held = {}
        yield _out(held)

    found = met.mapInArrow(rows, "query_id bigint, score bigint, vec_id bigint")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _out(held: dict[int, Found]) -> pa.RecordBatch:
    flat = [(q, -s, i) for q, rows in held.items() for s, i in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)], names=["query_id", "score", "vec_id"])
