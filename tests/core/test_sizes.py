"""Solutions counted before they are made, and products that are refused."""

import random
import time

import pytest

from lattica.plans import catalog, sizes, sparql, sparql_syntax


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    rows = {(f"ns:n{rng.randrange(12)}", f"ns:p{rng.randrange(3)}", f"ns:n{min(rng.randrange(12), rng.randrange(12))}") for _ in range(120)}
    return spark.createDataFrame(sorted(rows), "s string, p string, o string").cache()


def brute(rows, patterns):
    found = [{}]
    for pattern in patterns:
        found = [{**f, **own} for f in found for t in rows if (own := fits(f, pattern, t)) is not None]
    return len(found)


def fits(bound, pattern, triple):
    own = {}
    for want, is_ in zip(pattern, triple, strict=True):
        if want.startswith("?"):
            if {**bound, **own}.get(want, is_) != is_:
                return None
            own[want] = is_
        elif want != is_:
            return None
    return own


@pytest.mark.parametrize("where", [
    "?a ns:p0 ?b . ?b ns:p1 ?c . ?b ns:p2 ?d", "?a ns:p0 ?b . ?c ns:p1 ?d", "?a ?p ?b . ?b ?p ?c", "?a ns:p0 ?a . ?a ?p ?b", "ns:n1 ?p ?b . ?c ?q ?b", "?a ns:p9 ?b . ?c ns:p0 ?d", "ns:n0 ns:p0 ns:n0 . ?a ns:p1 ?b",
    "?a ns:p0 ?b . ?a ns:p1 ?b . ?b ns:p2 ?c",
])
def test_sizes(graph, where):
    patterns = sparql_syntax.parse(f"SELECT * WHERE {{ {where} }}").where.elements[0].patterns
    assert sizes.pattern_size(sparql.Planner(graph), patterns) == brute([tuple(r) for r in graph.collect()], patterns)


def test_cycles_are_not_counted(graph):
    patterns = sparql_syntax.parse("SELECT * WHERE { ?a ns:p0 ?b . ?b ns:p1 ?c . ?c ns:p2 ?a }").where.elements[0].patterns
    assert sizes.pattern_size(sparql.Planner(graph), patterns) is None


def test_under_constrained_queries_are_refused(spark, graph):
    many = spark.range(3000).selectExpr("concat('ns:x', id) AS s", "'ns:p' AS p", "concat('ns:y', id % 7) AS o").cache()
    many.count()
    began = time.time()
    with pytest.raises(sizes.ProductTooLarge, match="under-constrained"):
        sparql.select(many, "SELECT ?a ?b ?c WHERE { ?a ?p1 ?x . ?y ?p2 ?b . ?z ?p3 ?c }")
    assert time.time() - began < 20
    with pytest.raises(sizes.ProductTooLarge):
        sparql.solutions(many, "SELECT (COUNT(*) AS ?n) WHERE { ?a ns:p ?x . ?y ns:p ?b }", most_combined=1e6)
    with pytest.raises(sizes.ProductTooLarge):
        sparql.solutions(many, 'SELECT * WHERE { ?a ns:p ?x . ?y ns:p ?b FILTER(?x != ns:y1) }', most_combined=1e6)
    # What is connected, small enough, or asked for in part is answered.
    assert sparql.select(many, "SELECT ?a ?y WHERE { ?a ns:p ns:y0 . ?y ns:p ns:y1 }").count() == 429 * 429
    assert sparql.solutions(many, "SELECT ?a ?y WHERE { ?a ns:p ?x . ?y ns:p ?z FILTER(?a = ?y) }", most_combined=1e6).count() == 3000
    assert sparql.solutions(many, "SELECT ?a ?y WHERE { ?a ns:p ?x . ?y ns:p ?z } LIMIT 5", most_combined=1e6).count() == 5
    assert sparql.solutions(many, "SELECT ?a ?y WHERE { ?a ns:p ?x . ?y ns:p ?z VALUES (?a ?y) { (ns:x1 ns:x2) } }", most_combined=1e6).count() == 1
    assert sparql.ask(many, "ASK { ?a ?p1 ?x . ?y ?p2 ?b . ?z ?p3 ?c }")
    assert sparql.solutions(many, "SELECT ?a ?y WHERE { ?a ns:p ?x . ?y ns:none ?z }", most_combined=10).count() == 0


def test_sizes_are_exact_beyond_doubles_and_longs(spark):
    n = 3_000_017
    many = spark.range(n).selectExpr("concat('ns:x', id) AS s", "'ns:p' AS p", "concat('ns:y', id % 7) AS o")
    counted = lambda where: sizes.pattern_size(sparql.Planner(many), sparql_syntax.parse(f"SELECT * WHERE {{ {where} }}").where.elements[0].patterns)
    assert counted("?a ?p1 ?x . ?y ?p2 ?b . ?z ?p3 ?c") == n**3 > 2**63
    assert counted("?a ?p ?x . ?y ?p ?b . ?z ?p ?c") == n**3
    assert counted(" . ".join(f"?a{k} ?p ?x{k}" for k in range(7))) == pytest.approx(n**7, rel=1e-9)


def test_the_query_holds_sizes_beyond_a_long(spark, monkeypatch):
    many = spark.range(2_200_000).selectExpr("concat('ns:x', id) AS s", "'ns:contains' AS p", "concat('ns:y', id % 7) AS o")
    monkeypatch.setattr(catalog, "whole", lambda spark, sf_dir: many)
    found = {r["name"]: r["size"] for r in catalog.sparql_sizes(spark, "").collect()}
    assert found == {"star": 0, "chain": 0, "product": 2_200_000**3, "shared predicate": 2_200_000**2, "none": 0}


def test_the_query_keeps_counts_and_not_the_graph(spark, monkeypatch):
    """The whole graph was stored, and each pattern counted by all its variables; now a count by what is shared is kept once for all queries."""
    rows = spark.range(3000).selectExpr("concat('ns:o', id % 500) AS s", "element_at(array('ns:contains', 'ns:supplied_by', 'ns:placed_by'), CAST(id % 3 + 1 AS INT)) AS p", "concat('ns:x', id % 70) AS o").distinct()
    more = spark.range(70).selectExpr("concat('ns:x', id) AS s", "'ns:in_nation' AS p", "concat('ns:n', id % 3) AS o").unionByName(spark.range(3).selectExpr("concat('ns:n', id) AS s", "'ns:in_region' AS p", "concat('ns:r', id % 2) AS o"))
    graph, made = rows.unionByName(more), []
    triples = [tuple(r) for r in graph.collect()]
    monkeypatch.setattr(catalog, "whole", lambda spark, sf_dir: graph)
    monkeypatch.setattr(type(graph), "checkpoint", lambda *a, **k: pytest.fail("the graph is stored"))
    monkeypatch.setattr(sizes, "kept", lambda df, keep=sizes.kept: made.append(keep(df)) or made[-1])
    found = {r["name"]: r["size"] for r in catalog.sparql_sizes(spark, "").collect()}
    many = lambda p: len({t for t in triples if t[1] == p})
    star, chain = (brute(triples, [tuple(x) for x in sparql_syntax.parse(f"SELECT * WHERE {catalog.SIZED[k]}").where.elements[0].patterns]) for k in ("star", "chain"))
    preds = {t[1] for t in triples}
    assert found == {"star": star, "chain": chain, "product": len(triples) ** 3, "shared predicate": sum(many(p) ** 2 for p in preds), "none": 0}
    # contains, supplied_by and placed_by by order, in_region and in_nation by nation, all by predicate, and what does not occur.
    assert sorted(df.count() for df in made) == sorted([*(len({t[0] for t in triples if t[1] == p}) for p in ("ns:contains", "ns:supplied_by", "ns:placed_by")), 3, 3, len(preds), 1])
