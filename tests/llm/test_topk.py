"""Top-k against brute force in Python's integers."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from lattica.llm.topk import group_count, top_k


def brute(rows, k):
    sound = [(i, tuple(math.floor(1024 * Fraction(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict.fromkeys(sound):
        if q % 100 == 0:
            scores = sorted((max(-(2**63) + 1, min(2**63, -sum(x * y for x, y in zip(a, b)))), i) for i, b in sound if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("score", F.lit("x"))
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 100 == 0, **options).collect()))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.2) if rnd.random() < 0.6 else 0.0 for _ in range(12)]) for i in range(1500)]
    rows += [(5000 + i, rows[7][1]) for i in range(60)]  # many equal scores
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, rows, shard_rows=64, query_rows=3) == brute(rows, 10)


def test_unsound_short_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0, 0.5]), (1, None), (2, [1.0, None, 0.0]), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, [0.25]), (6, []), (None, [1.0, 1.0, 1.0]), (100, [0.0, 0.0, 0.0]), (7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_repeated_rows_count_each(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    best = max(rows[1:], key=lambda r: sum(a * b for a, b in zip(r[1], rows[0][1])))
    got = run(spark, rows + [best] * 60)
    assert got == brute(rows + [best] * 60, 10) and [r[2] for r in got if r[0] == 0] == [best[0]] * 10
    assert run(spark, rows + [rows[0]] * 3) == brute(rows + [rows[0]] * 3, 10)  # asked once


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 2.0**-10])] + [(i, [1e6, i * 2.0**-10]) for i in range(1, 15)]
    assert run(spark, rows, k=3) == brute(rows, 3)


def test_finite_components_beyond_a_scaled_double(spark):
    rows = [(0, [1e307, 0.0]), (1, [1.0, 2.0]), (2, [-1.0, 2.0]), (3, [0.0, 5.0]), (100, [1e307, -2e306]), (4, [1.0, 5.0]), (5, [1.0, 5.1])]
    got = run(spark, rows, kind="double")
    assert got == brute(rows, 10) and {r[0] for r in got} == {0, 100}


def test_many_components(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3000)]) for i in (0, 1, 2)] + [(3, [1.0])]
    assert run(spark, rows) == brute(rows, 10)


def test_queries_are_neither_gathered_nor_sent_to_ever_more_groups(spark, tmp_path):
    rows = [(i, [float(i), 1.0]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "v"))
    met = top_k(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 100 == 0, shard_rows=16)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, met.collect())) == brute(rows, 10)
    # Rows moved for the queries: so many times the vectors at most, at any size.
    assert all(group_count(n, n // 100, 2048) * (n // 100) <= n for n in (100, 10**6, 10**8))
    assert group_count(10**8, 10**8, 2048) == 64 and group_count(0, 0, 2048) == 1
