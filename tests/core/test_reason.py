"""Closure, claims, audits and the answer gate."""

import pytest

from lattica.operators import audit, reason
from lattica.operators.store import Graph


def triples(spark, text):
    return Graph.of(spark, [tuple(x.split()) for x in text.strip().split("\n")]).triples


def closed(spark, text):
    return {tuple(r) for r in reason.closure(triples(spark, text)).expanded().collect()}


def verdicts(spark, kb, claims):
    t = triples(spark, kb)
    rows = triples(spark, claims)
    return {(r["s"], r["p"], r["o"]): r["verdict"] for r in reason.verify(rows, reason.closure(t)).collect()}


def test_subclasses_and_verdicts(spark):
    kb = """order_9 rdf:type Rush
Rush rdfs:subClassOf Order
Order rdfs:subClassOf Document
billed_to rdf:type owl:FunctionalProperty
order_9 billed_to acme
m owl:differentFrom n"""
    got = verdicts(spark, kb, """order_9 rdf:type Document
order_9 billed_to acme
order_9 billed_to zenith
order_9 holds bolt
n owl:sameAs m
m owl:sameAs m
order_8 billed_to zenith""")
    assert got == {
        ("ns:order_9", "rdf:type", "ns:Document"): "entailed", ("ns:order_9", "ns:billed_to", "ns:acme"): "entailed", ("ns:order_9", "ns:billed_to", "ns:zenith"): "contradicted",
        ("ns:order_9", "ns:holds", "ns:bolt"): "unknown", ("ns:n", "owl:sameAs", "ns:m"): "contradicted", ("ns:m", "owl:sameAs", "ns:m"): "entailed", ("ns:order_8", "ns:billed_to", "ns:zenith"): "unknown",
    }


RULES = {
    "a p b\np rdfs:domain C\np rdfs:range D": ["ns:a rdf:type ns:C", "ns:b rdf:type ns:D"],
    "a p b\np rdfs:subPropertyOf q\nq owl:inverseOf r": ["ns:a ns:q ns:b", "ns:b ns:r ns:a"],
    "a p b\nb p c\nc p a\np rdf:type owl:TransitiveProperty": ["ns:a ns:p ns:a", "ns:a ns:p ns:c"],
    "a p b\np rdf:type owl:SymmetricProperty": ["ns:b ns:p ns:a"],
    "a rdf:type C\nC owl:equivalentClass D": ["ns:a rdf:type ns:D", "ns:D rdfs:subClassOf ns:C"],
    "a p b\na q c\np rdf:type owl:FunctionalProperty\na p d": ["ns:b owl:sameAs ns:d", "ns:d owl:sameAs ns:b"],
    "a p x\nb p x\np rdf:type owl:InverseFunctionalProperty\na q z": ["ns:a owl:sameAs ns:b", "ns:b ns:q ns:z"],
    "a owl:sameAs b\nb owl:sameAs c\na p x\ny q c": ["ns:c ns:p ns:x", "ns:y ns:q ns:a", "ns:c owl:sameAs ns:a"],
    "u rdf:type R\nR owl:hasValue y\nR owl:onProperty p\nv p y": ["ns:u ns:p ns:y", "ns:v rdf:type ns:R"],
    "u p v\nv rdf:type Y\nR owl:someValuesFrom Y\nR owl:onProperty p": ["ns:u rdf:type ns:R"],
    "u p v\nu rdf:type R\nR owl:allValuesFrom Y\nR owl:onProperty p": ["ns:v rdf:type ns:Y"],
    "c owl:intersectionOf l1\nl1 rdf:first A\nl1 rdf:rest l2\nl2 rdf:first B\nl2 rdf:rest rdf:nil\nx rdf:type A\nx rdf:type B\ny rdf:type c": ["ns:x rdf:type ns:c", "ns:y rdf:type ns:B", "ns:c rdfs:subClassOf ns:A"],
    "c owl:unionOf l1\nl1 rdf:first A\nl1 rdf:rest rdf:nil\nx rdf:type A": ["ns:x rdf:type ns:c"],
    "c owl:oneOf l1\nl1 rdf:first A\nl1 rdf:rest rdf:nil": ["ns:A rdf:type ns:c"],
    "q owl:propertyChainAxiom l1\nl1 rdf:first p\nl1 rdf:rest l2\nl2 rdf:first r\nl2 rdf:rest rdf:nil\na p b\nb r c": ["ns:a ns:q ns:c"],
    "c owl:hasKey l1\nl1 rdf:first k\nl1 rdf:rest rdf:nil\nx rdf:type c\ny rdf:type c\nx k 5\ny k 5\nz rdf:type c\nz k 6": ["ns:x owl:sameAs ns:y"],
    "r owl:maxCardinality 1\nr owl:onProperty p\nu rdf:type r\nu p a\nu p b": ["ns:a owl:sameAs ns:b"],
}


def test_rules(spark):
    """Each graph has names of its own, so that one closure covers all."""
    own = lambda x, k: x if ":" in x and not x.startswith("ns:") or x.isdigit() else f"ns:g{k}_{x.removeprefix('ns:')}"
    graphs = list(RULES)
    text = "\n".join(" ".join(own(x, k) for x in line.split()) for k, kb in enumerate(graphs) for line in kb.split("\n"))
    got = closed(spark, text)
    for k, kb in enumerate(graphs):
        for want in RULES[kb]:
            assert tuple(own(x, k) for x in want.split()) in got, (want, kb)
    assert not any(r[1] == "owl:sameAs" and r[0].endswith("_z") for r in got)


def test_closure_is_monotone_and_idempotent(spark):
    t = triples(spark, "a p b\np rdfs:subPropertyOf q\nq rdf:type owl:TransitiveProperty\nb q c\nc owl:sameAs d")
    once = reason.closure(t).expanded()
    twice = reason.closure(once).expanded()
    asserted, one, two = ({tuple(r) for r in x.collect()} for x in (t, once, twice))
    assert asserted <= one == two and ("ns:a", "ns:q", "ns:d") in one
    assert {tuple(r) for r in reason.inferred(t, reason.closure(t)).collect()} == one - asserted


CASCADE = """in_bay rdf:type owl:FunctionalProperty
crate_1 in_bay north
crate_1 in_bay south
crate_2 in_bay north
crate_3 in_bay south
box_2 owl:sameAs crate_2
crate_1 holds m
crate_1 holds n"""


def test_violations_are_asserted_ones_only(spark):
    t = triples(spark, CASCADE)
    assert [tuple(r) for r in audit.violations(t).collect()] == [("ns:crate_1", "ns:in_bay", 2, ["ns:north", "ns:south"])]
    # The closure makes the values one, and would blame everybody.
    assert ("ns:north", "owl:sameAs", "ns:south") in {tuple(r) for r in reason.closure(t).expanded().collect()}
    log = spark.createDataFrame([("ns:crate_1", "ns:in_bay", "ns:north", "scan.csv", "2020")], "s string, p string, o string, source string, at string")
    got = {(r["o"], r["source"]) for r in audit.violations_with_sources(t, log).collect()}
    assert got == {("ns:north", "scan.csv"), ("ns:south", None)}


def test_identity_and_inconsistencies(spark):
    t = triples(spark, "a owl:sameAs b\nb owl:differentFrom a\nc owl:sameAs d\nA owl:disjointWith B\nx rdf:type A\nx rdf:type B\np rdf:type owl:IrreflexiveProperty\ny p y\nr rdf:type owl:AsymmetricProperty\nu r v\nv r u")
    assert [tuple(r) for r in audit.identity_conflicts(t).collect()] == [("ns:a", "ns:b")]
    assert {r["rule"] for r in reason.inconsistencies(reason.closure(t)).collect()} == {"cax-dw", "prp-irp", "prp-asyp", "eq-diff1"}


SHOPS = """depot_1 feeds shop_1
depot_1 feeds shop_2
depot_2 feeds shop_2
shop_1 sells tea
shop_2 sells tea
shop_2 sells salt
depot_1 run_by ann"""


def test_answer_gate(spark):
    """Each check passes, warns, rejects and is skipped at least once."""
    asked = {
        ("tea", "shop_1", "sells"): ("warn", "pass", "pass", "warn"), ("salt", "shop_1", "sells"): ("pass", "pass", "pass", "pass"), ("pepper", "shop_1", None): ("reject", "reject", "skipped", "pass"),
        ("SALT", None, None): ("reject", "reject", "skipped", "skipped"), ("ann", "shop_1", "sells"): ("warn", "pass", "warn", "pass"), ("shop_1", None, "sells"): ("pass", "pass", "pass", "skipped"),
        ("tea", None, "taxes"): ("warn", "pass", "warn", "skipped"), ("tea", "tea", None): ("warn", "pass", "skipped", "warn"), ("depot_1", "shop_1", None): ("warn", "pass", "skipped", "warn"),
    }
    rows = spark.createDataFrame([(str(k), *k) for k in asked], "id string, answer string, start string, relation string")
    got = {r["id"]: r for r in audit.check_answers(triples(spark, SHOPS), rows).collect()}
    for k, want in asked.items():
        r = got[str(k)]
        assert (r["verdict"], r["existence"], r["type"], r["start_exclusion"]) == want, k
    assert got[str(("SALT", None, None))]["hint"] == "ns:salt" and got[str(("tea", "shop_1", "sells"))]["links_by_relation"] and got[str(("tea", None, "taxes"))]["relation_known"] is False


def listed(holder, by, *items):
    cells = [f"_:{holder.strip('_:')}_{by[4:]}_{k}" for k in range(len(items))] + ["rdf:nil"]
    out = [(holder, by, cells[0])]
    for k, x in enumerate(items):
        out += [(cells[k], "rdf:first", x), (cells[k], "rdf:rest", cells[k + 1])]
    return out


def test_lists_of_any_length(spark):
    t = [*listed("ns:C", "owl:intersectionOf", "ns:k0", "ns:k1", "ns:k2", "ns:k3"), *listed("ns:q", "owl:propertyChainAxiom", "ns:p0", "ns:p1", "ns:p0", "ns:p2")]
    t += [("ns:x", "rdf:type", f"ns:k{k}") for k in range(4)] + [("ns:y", "rdf:type", f"ns:k{k}") for k in (0, 1, 3)]
    t += [("ns:a", "ns:p0", "ns:b"), ("ns:b", "ns:p1", "ns:c"), ("ns:c", "ns:p0", "ns:d"), ("ns:d", "ns:p2", "ns:e"), ("ns:c", "ns:p2", "ns:f")]
    got = {tuple(r) for r in closed_of(spark, t).triples.collect()}
    assert {r for r in got if r[1:] == ("rdf:type", "ns:C")} == {("ns:x", "rdf:type", "ns:C")} and {r for r in got if r[1] == "ns:q"} == {("ns:a", "ns:q", "ns:e")}
    assert not any("|" in x or x.startswith("_:and") for r in got for x in r)


def closed_of(spark, rows):
    return reason.closure(spark.createDataFrame(rows, "s string, p string, o string"))


def test_keys_need_one_shared_value_for_each_property(spark):
    t = [("ns:C", "rdf:type", "owl:Class"), *listed("ns:C", "owl:hasKey", "ns:p", "ns:q")]
    has = {"a": ("12", "7"), "b": ("2", "78"), "c": ("3", "7"), "d": ("4", "8"), "e": ("1", ""), "f": ("9", "9"), "g": ("9", "9")}
    for x, (p, q) in has.items():
        t += [(f"ns:{x}", "rdf:type", "ns:C")] * (x != "g") + [(f"ns:{x}", "ns:p", f'"{v}"') for v in p] + [(f"ns:{x}", "ns:q", f'"{v}"') for v in q]
    got = {(r["node"], r["component"]) for r in closed_of(spark, t).same.collect()}
    assert got == {("ns:a", "ns:a"), ("ns:b", "ns:a")}  # c and d share a value of q alone; g is of no class with a key


def test_inconsistent_lists_and_cardinalities(spark):
    t = [("_:d", "rdf:type", "owl:AllDifferent"), *listed("_:d", "owl:members", "ns:a", "ns:b", "ns:c"), ("ns:a", "owl:sameAs", "ns:b")]
    t += [("_:e", "rdf:type", "owl:AllDifferent"), *listed("_:e", "owl:distinctMembers", "ns:c", "ns:d")]
    t += [("_:f", "rdf:type", "owl:AllDisjointClasses"), *listed("_:f", "owl:members", "ns:K", "ns:L", "ns:M"), ("ns:x", "rdf:type", "ns:K"), ("ns:x", "rdf:type", "ns:M"), ("ns:y", "rdf:type", "ns:L")]
    t += [("_:g", "rdf:type", "owl:AllDisjointProperties"), *listed("_:g", "owl:members", "ns:p", "ns:q"), ("ns:x", "ns:p", "ns:y"), ("ns:x", "ns:q", "ns:y"), ("ns:x", "ns:q", "ns:c")]
    t += [("ns:R", "owl:maxQualifiedCardinality", '"0"^^xsd:nonNegativeInteger'), ("ns:R", "owl:onProperty", "ns:r"), ("ns:R", "owl:onClass", "ns:K"), ("ns:u", "rdf:type", "ns:R"), ("ns:u", "ns:r", "ns:x"), ("ns:u", "ns:r", "ns:y")]
    t += [("ns:u", "ns:age", '"old"^^xsd:integer'), ("ns:u", "ns:size", '"7"^^xsd:integer'), ("ns:u", "ns:day", '"2020-13-01"^^xsd:date')]
    got = {tuple(r) for r in reason.inconsistencies(closed_of(spark, t)).collect()}
    assert got == {
        ("eq-diff2", "ns:b", "owl:sameAs", "ns:a"), ("cax-adc", "ns:x", "rdf:type", "ns:K"), ("cax-adc", "ns:x", "rdf:type", "ns:M"), ("prp-adp", "ns:x", "ns:p", "ns:y"), ("prp-adp", "ns:x", "ns:q", "ns:y"),
        ("cls-maxqc1", "ns:u", "ns:r", "ns:x"), ("dt-not-type", "ns:u", "ns:age", '"old"^^xsd:integer'), ("dt-not-type", "ns:u", "ns:day", '"2020-13-01"^^xsd:date'),
    }