"""Vector codes against brute force in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import vector_codes
from lattica.llm.vector_codes import Codebook, compress

LONG_MAX = 2**63 - 1


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v], v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(x) for _, x, _, _ in kept) // parts)
    split = lambda x: [(x + [0] * (width * parts - len(x)))[p * width : (p + 1) * width] for p in range(parts)]
    kept = [(i, split(x), v, label) for i, x, v, label in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[1][p] for r in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            by_entry = defaultdict(list)
            for r in kept:
                by_entry[near(r[1][p], books[p])[1]].append(r[1][p])
            books[p] = [[sum(c) // len(by_entry[k]) for c in zip(*by_entry[k])] if k in by_entry else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded, by_label = [], defaultdict(int)
    for i, x, _, label in kept:
        found = [near(x[p], books[p]) for p in range(parts)]
        error = min(LONG_MAX, sum(d for d, _ in found))
        by_label[label] += error
        coded.append((i, "".join(f"{k:0{len(f'{entries - 1:x}')}x}" for _, k in found), error, label))
    return sorted(((i, c, e, min(LONG_MAX, by_label[label]), digest) for i, c, e, label in coded), key=str)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumn("code", F.lit("x")).repartition(3)
    return sorted(map(tuple, compress(df, **options).collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i * 3, np.float32([rnd.gauss(0, 0.2) for _ in range(8)]).tolist(), rnd.choice([None, 1, 2, 3])) for i in range(900)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, entries=16, rounds=2) == brute(rows, entries=16, rounds=2)


def test_ties_and_repeats(spark):
    rnd = random.Random(7)
    rows = [(i % 200, [float(rnd.choice([0, 1 / 1024, 2 / 1024])) for _ in range(8)], None if i % 3 else 5) for i in range(400)]
    rows += [(7, rows[0][1], 5)] * 300
    got = run(spark, rows, entries=64)
    assert got == brute(rows, entries=64) and len(got) == 700


def test_unsound_short_and_large_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0, 0.5, 3.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan], 1), (4, [-inf], 1), (5, [0.25], None), (6, [], None), (None, [1.0, 1.0], 2), (8, [1e300, -1e300, 1.0], 2), (9, [1e18, 0.0, 1.0], 3)]
    assert run(spark, rows, kind="double", entries=3) == brute(rows, entries=3)
    assert run(spark, rows, kind="double") == brute(rows)
    assert run(spark, [(1, None, 1), (2, [nan], None)]) == [] and run(spark, [(1, [], None)]) == brute([(1, [], None)])
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert compress(empty).collect() == []


def test_one_long_vector_among_short_ones(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)], i % 5) for i in range(300)] + [(40, [0.5] * 20_001, 0)]
    got = run(spark, rows, entries=32, rounds=2)
    assert got == brute(rows, entries=32, rounds=2)


def test_labels_beyond_those_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 2)
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], None if i % 4 == 0 else i % 7) for i in range(200)]
    assert run(spark, rows, entries=8) == brute(rows, entries=8)


@pytest.mark.parametrize("size", [1, 1000, 2**23, 2**26])
def test_screening_keeps_the_nearest_where_float32_cannot_tell(size):
    rnd = np.random.default_rng(size)
    centre = rnd.integers(-size, size, 16)
    entries = (centre + rnd.integers(-2, 3, (200, 16))).tolist()
    x = centre + rnd.integers(-2, 3, (500, 16))
    book = Codebook(entries, 16)
    assert not book.large and book.limit >= 2**27
    numbers, distances = book.nearest(x)
    exact = ((x[:, None, :] - np.array(entries)[None, :, :]) ** 2).sum(axis=2)
    assert (numbers == exact.argmin(axis=1)).all() and (distances == exact.min(axis=1)).all()
    assert [book.nearest_exactly(r) for r in x[:20].tolist()] == list(zip(numbers[:20].tolist(), distances[:20].tolist()))
