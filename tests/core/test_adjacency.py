"""Walks over the index of edges, against plain Python, and what their plans move."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.operators import adjacency
from lattica.runtime import setting


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(4)
    some = {(f"ns:n{rng.randrange(200)}", f"ns:p{rng.randrange(3)}", f"ns:n{rng.randrange(200)}") for _ in range(1500)}
    hub = {("ns:hub", "ns:p0", f"ns:n{k}") for k in range(200)} | {(f"ns:n{k}", "ns:p1", "ns:hub") for k in range(200)}
    return sorted(some | hub | {("ns:n1", "ns:p2", '"a word"'), ("ns:n2", "ns:p2", '"a word"')})


@pytest.fixture(scope="module")
def found(spark, edges):
    rows = spark.createDataFrame(edges + edges[:50], "s string, p string, o string").withColumn("node", F.lit(1))
    out = adjacency.index(rows, buckets=8)
    yield out
    adjacency.drop(out)


def plain(edges, starts, steps):
    at = Counter(s for s in starts if s is not None)
    for p, inverse in steps:
        new = Counter()
        for s, q, o in edges:
            a, b = (o, s) if inverse else (s, o)
            if q == p and a in at and not a.startswith('"'):
                new[b] += at[a]
        at = new
    return dict(at)


@pytest.mark.parametrize("steps", [[], [("ns:p0", False)], [("ns:p1", False), ("ns:p0", False)], [("ns:p0", True), ("ns:p1", True), ("ns:p2", False)], [("ns:p2", False), ("ns:p2", True)], [("ns:p9", False)]])
def test_walks(spark, edges, found, steps):
    starts = [f"ns:n{k}" for k in range(0, 60)] + ["ns:n3", "ns:hub", None, "ns:absent", '"a word"']
    got = adjacency.walk(found, spark.createDataFrame([(s,) for s in starts], "entity string"), steps).collect()
    assert {r["entity"]: r["paths"] for r in got} == plain(edges, starts, steps) and len({r["entity"] for r in got}) == len(got)


def test_hubs_are_apart(spark, edges, found):
    assert {r["node"] for r in spark.table(found.forward.hubs).collect()} == {"ns:hub"} == {r["node"] for r in spark.table(found.inverse.hubs).collect()}
    assert {tuple(r) for r in adjacency.neighbours(found, "ns:hub", True).collect()} == {(p, s) for s, p, o in edges if o == "ns:hub"}


def test_edges_are_not_moved(spark, found):
    frontier = spark.range(5000).selectExpr("concat('ns:n', id) AS entity", "1L AS paths")
    plan = adjacency.hop(found, frontier, "ns:p0")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    physical = adjacency.hop(found, frontier, "ns:p0")._jdf.queryExecution().executedPlan().toString()
    lines = physical.splitlines()
    scans = [k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 1
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    k, above = scans[0], []
    for line in reversed(lines[: scans[0]]):
        if depth(line) < depth(lines[k]):
            above.append(line)
            k = lines.index(line)
        if "SortMergeJoin" in line:
            break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above)


def test_one_bucket_is_read_for_one_node(spark, found):
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):  # else the plan prunes without saying so
        assert "SelectedBucketsCount: 1 out of 8" in adjacency.neighbours(found, "ns:n7")._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    found = adjacency.index(spark.createDataFrame([], "s string, p string, o string"), buckets=2)
    assert adjacency.walk(found, spark.createDataFrame([("ns:a",)], "entity string"), [("ns:p", False)]).count() == 0
    adjacency.drop(found)
