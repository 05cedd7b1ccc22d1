"""A closure that is kept up to date against one from nothing, and deadlines."""

import random
import time

import pytest

from lattica.operators import audit, graph, reason
from lattica.runtime import DeadlineExceeded, cut, deadline
from tests.core.test_reason import listed

SCHEMA = "s string, p string, o string"


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows), SCHEMA)


def names(closed):
    return {tuple(r) for r in closed.expanded().collect()}


def agrees(spark, before, gone, new):
    """The changed closure equals that of the changed graph, and its inner state does."""
    after, got = reason.changed(frame(spark, before), reason.closed(frame(spark, before)), frame(spark, gone), frame(spark, new))
    left = (set(before) - set(gone)) | (set(new) - set(before))
    assert {tuple(r) for r in after.collect()} == left
    want = reason.closed(frame(spark, left))
    assert names(got) == names(want)
    assert {tuple(r) for r in got.known.collect()} == {tuple(r) for r in want.known.collect()}
    assert {tuple(r) for r in got.same.collect()} == {tuple(r) for r in want.same.collect()}


FACTS = [
    ("ns:a", "rdf:type", "ns:C"), ("ns:b", "ns:p", "ns:c"), ("ns:c", "ns:p", "ns:d"), ("ns:d", "ns:p", "ns:b"), ("ns:a", "ns:f", "ns:x"), ("ns:a", "ns:f", "ns:y"),
    ("ns:y", "ns:q", "ns:z"), ("ns:x", "owl:sameAs", "ns:w"), ("ns:w", "ns:f", "ns:v"), ("ns:x", "ns:f", "ns:u"), ("ns:u", "rdf:type", "ns:D"),
]
RULES = [
    ("ns:C", "rdfs:subClassOf", "ns:D"), ("ns:D", "rdfs:subClassOf", "ns:E"), ("ns:C", "rdfs:subClassOf", "ns:E"), ("ns:p", "rdf:type", "owl:TransitiveProperty"),
    ("ns:f", "rdf:type", "owl:FunctionalProperty"), ("ns:p", "rdfs:subPropertyOf", "ns:q"), ("ns:q", "owl:inverseOf", "ns:r"),
]
CASES = {
    "a fact": ([("ns:c", "ns:p", "ns:d")], []),
    "one of two ways": ([("ns:D", "rdfs:subClassOf", "ns:E")], []),
    "a kind of property": ([("ns:f", "rdf:type", "owl:FunctionalProperty")], [("ns:q", "rdf:type", "owl:SymmetricProperty")]),
    "a value that made two one": ([("ns:a", "ns:f", "ns:y")], []),
    "an equality": ([("ns:x", "owl:sameAs", "ns:w")], [("ns:z", "owl:sameAs", "ns:a")]),
    "more facts": ([], [("ns:v", "ns:p", "ns:b"), ("ns:w", "ns:q", "ns:b")]),
    "what is not there": ([("ns:no", "ns:p", "ns:no")], [("ns:b", "ns:p", "ns:c")]),
    "everything": (FACTS + RULES, []),
}


def own(rows, k):
    """Rows with names of their own, so that several graphs lie in one and share a closure."""
    return [tuple(f"{x[:3]}g{k}_{x[3:]}" if x.startswith("ns:") else x for x in r) for r in rows]


def test_changes(spark):
    before, gone, new = [], [], []
    for k, (less, more) in enumerate(CASES.values()):
        before, gone, new = before + own(FACTS + RULES, k), gone + own(less, k), new + own(more, k)
    agrees(spark, before, gone, new)


def test_changes_of_lists_keys_and_cardinalities(spark):
    t = [*listed("ns:K", "owl:intersectionOf", "ns:A", "ns:B", "ns:C"), *listed("ns:q", "owl:propertyChainAxiom", "ns:p", "ns:p", "ns:p"), *listed("ns:A", "owl:hasKey", "ns:id")]
    t += [("ns:x", "rdf:type", f"ns:{k}") for k in "ABC"] + [("ns:y", "rdf:type", "ns:A"), ("ns:x", "ns:id", '"1"'), ("ns:y", "ns:id", '"1"'), ("ns:y", "ns:p", "ns:z"), ("ns:z", "ns:p", "ns:y")]
    t += [("ns:R", "owl:maxCardinality", '"1"^^xsd:nonNegativeInteger'), ("ns:R", "owl:onProperty", "ns:has"), ("ns:u", "rdf:type", "ns:R"), ("ns:u", "ns:has", "ns:m"), ("ns:u", "ns:has", "ns:n")]
    rest = next(r for r in t if r[1] == "rdf:rest" and r[0].endswith("intersectionOf_1"))
    agrees(spark, t, [rest, ("ns:y", "ns:id", '"1"'), ("ns:u", "rdf:type", "ns:R")], [(rest[0], "rdf:rest", "rdf:nil"), ("ns:y", "ns:p", "ns:u")])


def test_a_graph_from_nothing_by_a_change(spark):
    got = reason.changed(frame(spark, []), reason.nothing_known(spark), new=frame(spark, FACTS + RULES))[1]
    assert names(got) == names(reason.closed(frame(spark, FACTS + RULES)))
    unchanged = reason.changed(frame(spark, FACTS), got, frame(spark, []), frame(spark, FACTS[:2]))[1]
    assert names(unchanged) == names(got)


def made(rnd, k):
    """A random graph: half of it facts, the rest schema and equalities."""
    things, props, classes = [f"ns:i{j}" for j in range(9)], [f"ns:p{j}" for j in range(4)], [f"ns:c{j}" for j in range(5)]
    kinds = ["owl:TransitiveProperty", "owl:SymmetricProperty", "owl:FunctionalProperty", "owl:InverseFunctionalProperty"]
    forms = [
        (0.55, lambda: (rnd.choice(things), rnd.choice(props), rnd.choice(things))), (0.7, lambda: (rnd.choice(things), "rdf:type", rnd.choice(classes))),
        (0.8, lambda: (rnd.choice(classes), rnd.choice(["rdfs:subClassOf", "owl:equivalentClass"]), rnd.choice(classes))),
        (0.86, lambda: (rnd.choice(props), rnd.choice(["rdfs:subPropertyOf", "owl:inverseOf"]), rnd.choice(props))),
        (0.9, lambda: (rnd.choice(props), rnd.choice(["rdfs:domain", "rdfs:range"]), rnd.choice(classes))),
        (0.95, lambda: (rnd.choice(props), "rdf:type", rnd.choice(kinds))), (1.0, lambda: (rnd.choice(things), "owl:sameAs", rnd.choice(things))),
    ]
    out = set()
    for _ in range(30):
        pick = rnd.random()
        out.add(next(f for most, f in forms if pick < most)())
    return own(sorted(out), k)


@pytest.mark.parametrize("equating", [False, True])
def test_random_changes(spark, equating):
    """Twelve graphs at once; with and without changes to what makes properties functional, which touches all equalities."""
    rnd, before, gone, new = random.Random(equating), [], [], []
    for k in range(12):
        rows = made(rnd, k)
        free = [r for r in rows if equating or "Functional" not in r[2]]
        more = set(rnd.sample(free, 5))
        before += [r for r in rows if r not in more]
        gone += rnd.sample([r for r in free if r not in more], 5)
        new += sorted(more)
    agrees(spark, before, gone, new)


def test_a_deadline_fires_between_short_jobs(spark):
    began = time.time()
    with pytest.raises(DeadlineExceeded), deadline(spark, 1):
        while time.time() < began + 20:
            cut(spark.range(10)).count()
    assert time.time() - began < 4
    with pytest.raises(DeadlineExceeded), deadline(spark, 0.2):
        time.sleep(0.5)
    with deadline(spark, 30), deadline(spark, None):
        assert cut(spark.range(3)).count() == 3
    assert spark.range(5).count() == 5


def test_deadlines_of_closures_paths_and_violations(spark):
    t = frame(spark, [(f"ns:n{k}", "ns:p", f"ns:n{k + 1}") for k in range(400)] + [("ns:p", "rdf:type", "owl:TransitiveProperty")])
    for work in (lambda: reason.closure(t, seconds=0.3), lambda: graph.traverse(t, "n1", ["p"] * 5, seconds=0.3), lambda: audit.violations(t, seconds=0.001)):
        began = time.time()
        with pytest.raises(DeadlineExceeded):
            work()
        assert time.time() - began < 3
