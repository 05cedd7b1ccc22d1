"""The graph as Spark gets it, against its SQL."""

import pytest

from lattica.plans import triplify


@pytest.mark.parametrize("sql", [triplify.GRAPH_SQL, triplify.AUDIT_SQL])
def test_rows_are_those_of_the_sql_where_keys_repeat_or_are_null(spark, tmp_path, sql):
    source = "/root/testdata/sf0.001"
    for name in triplify.TABLES:
        rows = spark.read.parquet(f"{source}/{name}.parquet").limit(60)
        if name in ("orders", "lineitem", "customer", "supplier"):
            key = rows.columns[0]
            unkeyed = rows.limit(5).selectExpr(f"CAST(NULL AS {rows.schema[key].dataType.simpleString()}) AS {key}", *rows.columns[1:])
            rows = rows.unionByName(rows.limit(20)).unionByName(unkeyed).unionByName(unkeyed)
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = triplify.triples(spark, str(tmp_path), sql)
    plan = got._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, spark.sql(sql).collect()), key=key)
    # Repeats of orders and line items are told from their keys: only the other parts, and the segments' names, cross a shuffle as text.
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("l_orderkey" in line for line in exchanges) == 2 and sum("o_orderkey" in line for line in exchanges) == 1
    assert sum("(s#" in line for line in exchanges) == 2


def test_the_gate_keeps_only_triples_that_hold_an_answer(spark, monkeypatch):
    from lattica.operators import audit

    kept = []
    monkeypatch.setattr(audit, "cut", lambda df: kept.append(sorted({r["s"] for r in df.collect()})) or df)
    graph = spark.createDataFrame([(f"ns:a{i}", "ns:p", f"ns:b{i}") for i in range(50)] + [("ns:Ax", "ns:q", '"7"')], "s string, p string, o string")
    answers = spark.createDataFrame([(1, "ns:b3", "ns:a3", "ns:p"), (2, "ns:aX", None, "ns:q"), (3, None, None, None)], "id long, answer string, start string, relation string")
    got = {r["id"]: (r["existence"], r["type"], r["start_exclusion"], r["hint"], r["relation_known"]) for r in audit.check_answers(graph, answers).collect()}
    assert got[1] == ("pass", "pass", "warn", None, True) and got[2] == ("reject", "skipped", "skipped", "ns:Ax", True)
    assert kept == [["ns:Ax", "ns:a3"]]


def test_functional_properties_go_to_the_triples(spark):
    from lattica.operators import audit

    rows = [("ns:p", "rdf:type", "owl:FunctionalProperty")] + [(f"ns:a{i % 40}", "ns:p", f"ns:b{i % 50}") for i in range(60)]
    found = audit.violations(spark.createDataFrame(rows, "s string, p string, o string").checkpoint())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r["s"], r["n"]) for r in found.collect()} == {(f"ns:a{i}", 2) for i in range(20)}
