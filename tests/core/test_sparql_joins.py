"""Joins on variables that may be unbound, against the definition of compatible solutions."""

import random

import pytest

from lattica.plans import sparql

GRAPH = [("ns:a", "ns:p", "ns:b"), ("ns:b", "ns:p", "ns:c"), ("ns:a", "ns:q", "ns:c"), ("ns:c", "ns:q", "ns:a"), ("ns:d", "ns:p", "ns:d")]


def values(names, rows):
    return f"VALUES ({' '.join('?' + n for n in names)}) {{ {' '.join('(' + ' '.join(x or 'UNDEF' for x in r) + ')' for r in rows)} }}"


def solutions(names, rows):
    return [{n: x for n, x in zip(names, r) if x is not None} for r in rows]


def compatible(a, b):
    return all(a[v] == b[v] for v in a.keys() & b.keys())


def joined(a, b, how):
    if how == "join":
        return [{**x, **y} for x in a for y in b if compatible(x, y)]
    if how == "optional":
        return [z for x in a for z in ([{**x, **y} for y in b if compatible(x, y)] or [x])]
    if how == "minus":
        return [x for x in a if not any(compatible(x, y) and x.keys() & y.keys() for y in b)]
    hit = lambda x: any(compatible(x, y) for y in b)
    return [x for x in a if hit(x) == (how == "exists")]


FORMS = {"join": "{} {}", "optional": "{} OPTIONAL {{ {} }}", "minus": "{} MINUS {{ {} }}", "exists": "{} FILTER EXISTS {{ {} }}", "not exists": "{} FILTER NOT EXISTS {{ {} }}"}


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(GRAPH, "s string, p string, o string")


def shown(rows, names):
    return sorted(str([r.get(n) for n in names]) for r in rows)


@pytest.mark.parametrize("how", list(FORMS))
@pytest.mark.parametrize("left,right", [("xy", "yz"), ("xyz", "xyz"), ("xyw", "ywz"), ("x", "x")])
def test_values_that_are_partly_unbound(graph, how, left, right):
    rnd = random.Random(f"{how}{left}{right}")
    made = [[[rnd.choice([None, "ns:a", "ns:b", "ns:c"]) for _ in names] for _ in range(12)] for names in (left, right)]
    query = "SELECT * WHERE { " + FORMS[how].format(values(left, made[0]), values(right, made[1])) + " }"
    got = sparql.select(graph, query)
    names = sorted({*left, *right} if how in ("join", "optional") else {*left})
    want = joined(solutions(left, made[0]), solutions(right, made[1]), how)
    assert shown([r.asDict() for r in got.collect()], names) == shown(want, names)


CHAINS = [
    "SELECT * WHERE { ?x ns:p ?y OPTIONAL { ?y ns:q ?z } OPTIONAL { ?z ns:p ?w } }",
    "SELECT * WHERE { { ?x ns:p ?y } UNION { ?y ns:q ?z } OPTIONAL { ?z ns:q ?x } }",
    "SELECT * WHERE { ?x ns:p ?y OPTIONAL { ?y ns:q ?z } ?z ns:q ?v }",
    "SELECT * WHERE { ?x ns:p ?y OPTIONAL { ?y ns:q ?z } MINUS { ?z ns:q ?x } }",
    "SELECT * WHERE { ?x ns:p ?y OPTIONAL { ?y ns:q ?z } FILTER NOT EXISTS { ?z ns:q ?x } }",
    "SELECT * WHERE { VALUES (?x ?y) { (ns:a UNDEF) (UNDEF ns:c) } ?x ns:p ?y }",
    "SELECT * WHERE { ?x ns:p ?y { SELECT ?x ?z WHERE { ?z ns:p ?u OPTIONAL { ?x ns:q ?z } } } }",
]


@pytest.mark.parametrize("query", CHAINS)
def test_no_plan_compares_all_pairs(spark, graph, query):
    large = graph.repartition(3)  # nothing here is worth a broadcast
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sparql.select(large, query)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan, plan


def test_a_filter_of_the_optional_part_sees_both(graph):
    got = sparql.select(graph, "SELECT ?x ?z WHERE { ?x ns:p ?y OPTIONAL { ?y ns:q ?z } OPTIONAL { ?z ns:p ?w FILTER(?w = ?y) } }")
    assert len(got.collect()) == 3


def test_exists_inside_an_expression(graph):
    got = sparql.select(graph, "SELECT ?x ?y WHERE { ?x ns:p ?y OPTIONAL { ?y ns:q ?z } FILTER(?x = ns:d || EXISTS { ?z ns:p ?u }) }")
    assert {tuple(r) for r in got.collect()} == {("ns:d", "ns:d"), ("ns:a", "ns:b"), ("ns:b", "ns:c")}


PATHS = ["SELECT * WHERE { ?x ns:p/^ns:q ?y }", "SELECT ?x WHERE { ?x ns:p/ns:p/ns:q ?y }", "SELECT * WHERE { ?x (ns:p/ns:q)/^(ns:p/ns:q) ?x }", "SELECT * WHERE { ?x ^(^ns:p/ns:q) ns:a . ?x ns:p ?z }", "SELECT * WHERE { ns:a ns:p/ns:q ns:a }"]


@pytest.mark.parametrize("query", PATHS)
def test_chains_of_links(graph, query):
    """Against the same path in pieces that are no chains of links: an alternative with a predicate that has no triples."""
    other = query.replace("ns:p", "(ns:p|ns:none)").replace("ns:q", "(ns:q|ns:none)")
    a, b = sparql.select(graph, query), sparql.select(graph, other)
    assert set(a.columns) == set(b.columns) and sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_what_a_pattern_of_one_variable_leaves_out_makes_no_product(spark):
    """4,000 things of one place, three of which are asked for: 16 million pairs before the types were joined first."""
    things = spark.range(4000).selectExpr("concat('ns:t', id) AS s", "'ns:in' AS p", "'ns:x' AS o")
    kinds = spark.range(3).selectExpr("concat('ns:t', id) AS s", "'rdf:type' AS p", "'ns:K' AS o")
    found = sparql.solutions(things.unionByName(kinds), "SELECT ?a ?b WHERE { ?a ns:in/^ns:in ?b . ?a a ns:K . ?b a ns:K }")
    assert found.count() == 9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if "Join" in line]
    # Each side's kinds are joined before the sides meet: two joins below the topmost, side by side or in line with one side whole.
    assert len(depth) == 3 and depth.count(min(depth)) == 1 and depth[1] == depth[2]


PAIRED = ["?a ns:p/^ns:p ?b", "?a ns:p ?m . ?b ns:q ?m . ?a ns:q ?x", "?a ns:p/ns:q ?b . ?b ns:p ns:n1", "?a ?p ns:n1 . ?b ?p ns:n2", "?a ns:p ?m . ?b ns:none ?m", "?a ns:p/ns:q/ns:p ?b", "?a ns:p ?m . ?m ns:q ?b . ?m ns:p ns:n3"]


@pytest.mark.parametrize("where", PAIRED)
def test_distinct_pairs_that_a_variable_links(spark, monkeypatch, where):
    """Things with one link and with several, some repeated, against all solutions made distinct."""
    monkeypatch.setattr(sparql, "LINKED", 2)
    rnd = random.Random(where)
    rows = [(f"ns:n{rnd.randrange(14)}", rnd.choice(["ns:p", "ns:q"]), f"ns:n{rnd.randrange(5)}") for _ in range(34)] + [(None, "ns:p", "ns:n1"), (None, "ns:p", "ns:n2"), ("ns:n3", "ns:p", None)]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    got = sparql.solutions(triples, f"SELECT DISTINCT ?a ?b WHERE {{ {where} }}")
    want = sparql.solutions(triples, f"SELECT ?a ?b WHERE {{ {where} }}").distinct()
    shown = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert shown(got) == shown(want)
    assert sparql.solutions(triples, f"SELECT DISTINCT ?b ?a WHERE {{ {where} }} LIMIT 2").count() == min(2, want.count())


def test_distinct_pairs_of_one_place_cross_no_shuffle(spark):
    """3,000 things of one place: nine million pairs, which were all written to a shuffle to be made distinct."""
    from pyspark.sql import functions as F

    things = spark.range(3000).selectExpr("concat('ns:t', id) AS s", "'ns:in' AS p", "concat('ns:x', id % 2) AS o")
    found = sparql.solutions(things, "SELECT DISTINCT ?a ?b WHERE { ?a ns:in/^ns:in ?b }")
    assert found.agg(F.count(F.lit(1))).first()[0] == 2 * 1500**2
    # The pairs of which one has a single link are a join below the union, with no aggregate between; the others are made distinct.
    top = [line.lstrip(" :+-").split()[0] for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()[:3]]
    assert top == ["Union", "Project", "Join"]
