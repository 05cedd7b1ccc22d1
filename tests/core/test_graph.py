"""Paths, closures and neighbourhoods."""

import pytest

from lattica.operators import graph
from tests.core.test_reason import SHOPS, triples


def ends(r):
    return {x["entity"] for x in r.terminals.collect()}


def test_paths(spark):
    t = triples(spark, SHOPS)
    r = graph.traverse(t, "salt", ["sells", "feeds"])
    assert ends(r) == {"ns:depot_1", "ns:depot_2"}
    assert {x["direction"] for x in r.edges.collect()} == {"inverse"} and [x["size"] for x in r.frontiers.orderBy("hop").collect()] == [1, 2]
    r = graph.traverse(t, "depot_1", ["feeds", "feeds"])
    assert ends(r) == {"ns:depot_2"} and r.excluded == ["ns:depot_1"]
    assert ends(graph.traverse(t, "depot_1", ["feeds", "feeds"], exclude_start=False)) == {"ns:depot_1", "ns:depot_2"}
    assert ends(graph.traverse(t, "depot_2", ["feeds", "sells", "sells"])) == {"ns:shop_1", "ns:shop_2"}
    r = graph.traverse(t, "tea", ["taxes", "sells"])
    assert ends(r) == set() and r.frontiers.count() == 1 and any("no triples" in n for n in r.notes) and any("stopped" in n for n in r.notes)
    assert ends(graph.traverse(t, "tea", ["^sells"])) == {"ns:shop_1", "ns:shop_2"} and ends(graph.traverse(t, "shop_1", ["^sells"])) == set()
    for bad in ([], ["p"] * 6):
        with pytest.raises(ValueError):
            graph.traverse(t, "x", bad)


def test_caps_hold_for_the_payload_only(spark):
    t = triples(spark, "\n".join(f"hub p n{k:03}" for k in range(250)))
    r = graph.traverse(t, "hub", ["p"])
    assert len(ends(r)) == 100 and r.terminals_truncated and r.edges.count() == 200 and r.frontiers.first()["size"] == 250


def test_closure_with_and_without_sources(spark):
    pairs = [(k, (k * 7 + 1) % 30) for k in range(30)] + [(k, k + 1) for k in range(40, 50)]
    df = spark.createDataFrame(pairs, "a int, b int")
    reach = {}
    for a in {x for x, _ in pairs}:
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            for u, v in pairs:
                if u == x and v not in seen:
                    seen.add(v)
                    todo.append(v)
        reach[a] = seen
    assert {tuple(r) for r in graph.transitive_closure(df).collect()} == {(a, b) for a, s in reach.items() for b in s}
    some = spark.createDataFrame([(3,), (41,)], "a int")
    assert {tuple(r) for r in graph.transitive_closure(df, some).collect()} == {(a, b) for a in (3, 41) for b in reach[a]}


def test_neighbourhood(spark):
    t = triples(spark, "a p b\nb p c\nc p d\nb q h\nh q hh")
    for radius, n in ((1, 1), (2, 3), (3, 5)):
        rows, cut_off = graph.neighbourhood(t, "ns:a", radius)
        assert rows.count() == n and not cut_off and graph.layers(t, "ns:a", radius).count() == n
    rows, cut_off = graph.neighbourhood(t, "ns:a", 3, 2)
    assert cut_off and [(r["s"], r["p"], r["o"]) for r in rows.orderBy("rank").collect()] == [("ns:a", "ns:p", "ns:b"), ("ns:b", "ns:p", "ns:c")]
    rows, cut_off = graph.neighbourhood(t, "ns:a", 3, 5)
    assert not cut_off and rows.count() == 5
    assert [r["layer"] for r in rows.orderBy("rank").collect()] == [1, 2, 2, 3, 3]


def test_functional_walk(spark):
    t = triples(spark, "a p b\nb q c\nd p e")
    starts = spark.createDataFrame([("ns:a",), ("ns:d",)], "entity string")
    assert [tuple(r) for r in graph.functional_walk(t, starts, ["ns:p", "ns:q"]).collect()] == [("ns:a", "ns:c")]


def test_small_frontiers_leave_the_edges_where_they_are(spark, tmp_path):
    edges = [(f"ns:a{i}", "ns:p", f"ns:a{i // 3}") for i in range(60)] + [("ns:a1", "ns:p", "ns:a1"), ("ns:a1", "ns:p", None)]
    spark.createDataFrame(edges, "s string, p string, o string").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    found = graph.layers(g, "ns:a1", 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and plan.count("FileScan") == 1
    reach, want = {"ns:a1"}, {}
    for layer in (1, 2):
        near = [e for e in edges if e[0] in reach or e[2] in reach]
        want |= {e: layer for e in near if e not in want}
        reach |= {x for e in near for x in (e[0], e[2]) if x}
    assert {tuple(r)[:3]: r["layer"] for r in found.collect()} == want
    near, more = graph.neighbourhood(g, "ns:a1", 2)
    assert {tuple(r)[:3]: r["layer"] for r in near.collect()} == want and not more
