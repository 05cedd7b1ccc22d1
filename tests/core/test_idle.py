"""Triples that no rule can read stay where they lie, and the closure is the same."""

from lattica.operators import reason
from tests.core.test_changes import FACTS, RULES, frame, names

IDLE = [("ns:o", "ns:has", "ns:x"), ("ns:o", "ns:has", "ns:w"), ("ns:w", "ns:has", "ns:y"), ("ns:o", "ns:has", '"1"'), ("ns:has", "ns:note", '"2"'), ("ns:o", "ns:size", '"3"')]


def test_which_predicates_are_idle(spark):
    assert reason.idle_predicates(frame(spark, FACTS + RULES + IDLE)) == {"ns:has", "ns:note", "ns:size"}
    # A triple that is read names a predicate, whose triples name the others.
    more = [("ns:note", "rdfs:comment", "ns:text"), ("ns:z", "ns:note", "ns:size")]
    assert reason.idle_predicates(frame(spark, FACTS + RULES + IDLE + more)) == frozenset()
    anything = (*reason.RULES, reason.rule("any", "?x ?p ?y", "?y ns:back ?x"))
    assert reason.idle_predicates(frame(spark, FACTS + IDLE), anything) == frozenset()


def test_idle_triples_are_renamed_changed_and_woken(spark):
    before = FACTS + RULES + IDLE
    closed = reason.closure(frame(spark, before), stored=True)
    assert {r["p"] for r in closed.known.select("p").collect()}.isdisjoint(closed.idle.predicates)
    rows = [tuple(r) for r in closed.expanded().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == names(reason.closed(frame(spark, before)))
    gone = [("ns:x", "owl:sameAs", "ns:w"), ("ns:o", "ns:size", '"3"'), ("ns:o", "ns:size", '"4"')]
    new = [("ns:has", "rdfs:subPropertyOf", "ns:q"), ("ns:e", "ns:note", '"5"'), ("ns:has", "ns:note", '"2"')]
    after, got = reason.changed(frame(spark, before), closed, frame(spark, gone), frame(spark, new))
    left = (set(before) - set(gone)) | set(new)
    assert got.idle.predicates == {"ns:note", "ns:size"}
    assert sorted(map(tuple, after.collect())) == sorted(left)
    rows = [tuple(r) for r in got.expanded().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == names(reason.closed(frame(spark, left)))
