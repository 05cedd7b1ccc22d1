"""Resampled intervals and problems solved side by side, against plain Python."""

import hashlib
import itertools
import math
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lattica.operators import metrics
from lattica.plans import csp
from lattica.runtime import spread


def plain_bootstrap(rows, resamples, seed):
    """(mean, low, high, p) of (key, difference) rows."""
    cells = {}
    for key, d in rows:
        c = int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16) % metrics.CELLS
        s, n = cells.get(c, (0, 0))
        cells[c] = (s + d, n + 1)
    limits = [int(u, 16) for u in metrics.POISSON]
    observed, means = sum(s for s, _ in cells.values()) / sum(n for _, n in cells.values()), []
    for r in range(resamples):
        total = count = 0
        for c, (s, n) in cells.items():
            u = int(hashlib.md5(f"{seed}|{c}|{r // 8}".encode()).hexdigest()[r % 8 * 4 :][:4], 16)
            w = sum(u >= x for x in limits)
            total, count = total + w * s, count + w * n
        means.append(total / count if count else observed)
    means.sort()
    return observed, means[int(0.025 * resamples)], means[int(0.975 * resamples)], sum(abs(m - observed) >= abs(observed) - 1e-15 for m in means) / resamples


def test_bootstrap(spark):
    rows = [("x", k, float(k % 3), float(k % 2)) for k in range(200)] + [("y", k, 1.0, 1.0) for k in range(5)] + [("z", 0, 2.0, 1.0), (None, 1, 4.0, 1.0), (None, 2, 1.0, 1.0), ("y", 9, None, 1.0)]
    got = {r["g"]: tuple(r)[1:] for r in metrics.bootstrap(spark.createDataFrame(rows, "g string, k int, a double, b double"), "g", "k", 400, 3).collect()}
    for g in ("x", "y", "z", None):
        assert got[g] == pytest.approx(plain_bootstrap([(k, a - b) for h, k, a, b in rows if h == g and a is not None], 400, 3))
    assert metrics.bootstrap(spark.createDataFrame([], "g string, k int, a double, b double"), "g", "k", 8).count() == 0


def test_weights_are_poisson():
    tops = [int(u, 16) for u in metrics.POISSON] + [65536]
    shares = [(b - a) / 65536 for a, b in zip([0, *tops], tops, strict=False)]
    assert sum(k * p for k, p in enumerate(shares)) == pytest.approx(1, abs=1e-4) and sum(k * k * p for k, p in enumerate(shares)) == pytest.approx(2, abs=1e-3)


def test_interval_is_as_wide_as_of_single_rows(spark):
    rows = [("x", k, float((k * 7919) % 101), 50.0) for k in range(20_000)]
    r = metrics.bootstrap(spark.createDataFrame(rows, "g string, k int, a double, b double"), "g", "k", 2000).first()
    d = [a - b for _, _, a, b in rows]
    mean = sum(d) / len(d)
    error = (sum((x - mean) ** 2 for x in d) / len(d) / len(d)) ** 0.5
    assert r["high"] - r["low"] == pytest.approx(2 * 1.96 * error, rel=0.12)


def test_problems_side_by_side(spark):
    domains = {1: {"a": [1, 2, 3], "b": [2, 3]}, 2: {"a": [5], "b": [5]}, 3: {"a": [1]}, 4: {"a": [4, 9, 2], "b": [9, 4, 1]}}
    rows = [(k, v, x) for k, d in domains.items() for v, xs in d.items() for x in xs] * 2 + [(None, "a", 1), (1, "a", None), (1, "c", 4)]
    found = csp.solutions_of_each(spark.createDataFrame(rows, "id int, variable string, value int"), "id", ["a", "b"], ["a + 1 >= b"], all_different=[["a", "b"]])
    want = {(k, a, b) for k, d in domains.items() if len(d) == 2 for a, b in itertools.product(d["a"], d["b"]) if a + 1 >= b and a != b}
    got = [(r["id"], r["a"], r["b"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    large = spark.range(3000).selectExpr("1 AS id", "explode(array('a', 'b')) AS variable", "id AS value")
    with pytest.raises(Exception, match="search space is too large: 1"):
        csp.solutions_of_each(large, "id", ["a", "b"]).count()
    with pytest.raises(csp.ProblemError):
        csp.solutions_of_each(large, "id", ["a"], all_different=[["a", "z"]])


def test_binomial_p_of_many_trials():
    for b, c in ((480, 530), (2450, 2600), (501, 500), (1, 1020), (16, 1000), (9900, 10300)):
        n, tail, one = b + c, 0, 1
        for i in range(min(b, c) + 1):
            tail, one = tail + one, one * (n - i) // (i + 1)
        assert metrics.binomial_p(b, c) == pytest.approx(min(1.0, float(Fraction(2 * tail, 2**n))), rel=1e-11)
    began = time.time()
    # Whole numbers of a million digits took minutes; here the normal approximation is as good as any.
    assert metrics.binomial_p(2_500_000, 2_503_000) == pytest.approx(math.erfc(2999 / math.sqrt(5_003_000) / math.sqrt(2)), rel=1e-5)
    assert metrics.binomial_p(5 * 10**8, 5 * 10**8) == 1.0 and time.time() - began < 5


def test_problems_are_dealt_out_by_their_number(spark, monkeypatch):
    """However few files they come from: a task of all problems held all their domains."""
    monkeypatch.setattr(csp, "TASK_ROWS", 100)
    domains = spark.range(0, 1000, 1, 1).selectExpr("id DIV 4 AS id", "explode(array('a', 'b')) AS variable", "id % 3 AS value")
    found = csp.solutions_of_each(domains, "id", ["a", "b"], ["a < b"])
    parts = found.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("id").alias("n")).collect()
    assert len(parts) > 15 and max(r["n"] for r in parts) < 60
    assert found.count() == found.distinct().count() == sum(3 for _ in range(250))
    # A large domain of a problem that lacks another has no solution; nor does it fail the query.
    monkeypatch.setattr(csp, "MAX_SPACE", 50)
    one = spark.range(500).selectExpr("1 AS id", "'a' AS variable", "id AS value")
    assert csp.solutions_of_each(one, "id", ["a", "b"]).count() == 0


def test_spread(spark):
    rows = spread(spark.range(0, 95, 1, 1), 10)
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 95 and spread(spark.range(0), 10).count() == 0
