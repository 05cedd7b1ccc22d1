"""Terms and triple tables."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.operators import store
from lattica.operators.store import Graph

TEXTS = ["alice", " alice ", "ns:alice", "rdf:type", "<http://x/y>", "<http://example.org/ns#a/b>", '"Tokyo"', "'Tokyo'", "42", "007", "-0", "-12", "3.10", "true", "FALSE", ".5", "1e5", "été", "a b", "", "  ", "bogus:thing", "+5", "http://x", "owl:sameAs", '"', "x.y-z_1"]


@pytest.mark.parametrize("as_object", [False, True])
def test_terms_as_column_and_by_hand(spark, as_object):
    def by_hand(t):
        try:
            return terms.parse(t, as_object)
        except terms.TermError:
            return None

    df = spark.createDataFrame([(t,) for t in TEXTS if t != '"'] + [(None,)], "t string").withColumn("term", terms.parsed(F.col("t"), as_object))
    for r in df.collect():
        assert r["term"] == (None if r["t"] is None else by_hand(r["t"])), r


def test_forms():
    assert terms.parse("42", True) == '"42"^^xsd:integer' and terms.parse("42") == "ns:42"
    assert terms.parse(".5", True) == "ns:.5" and terms.parse("1994") == "ns:1994" and terms.parse("'x'", True) == '"x"'
    for bad in ("", "bogus:thing", "+5", "a b"):
        with pytest.raises(terms.TermError):
            terms.parse(bad, True)


def test_parts_of_terms(spark):
    rows = [('"42"^^xsd:integer', "42", "xsd:integer", 42.0, None), ('"a"b"', 'a"b', "xsd:string", None, ""), ('"chat"@fr', "chat", "rdf:langString", None, "fr"), ("ns:x", "ns:x", None, None, None), ("_:b", "_:b", None, None, None), ('"x^^y"', "x^^y", "xsd:string", None, "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select("t", terms.shown(F.col("t")), terms.datatype(F.col("t")), terms.number(F.col("t")), F.expr("null").alias("x")).collect()
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [r[:4] for r in rows]


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "s string, p string, o string")


def test_insert_find_delete(spark):
    g, new = Graph.empty(spark).insert(texts(spark, ("alice", "knows", "bob"), ("alice", "knows", "bob")), source="census.txt")
    assert new.count() == 1
    g, new = g.insert(texts(spark, ("alice", "knows", "bob"), ("alice", "age", "42")))
    assert [tuple(r) for r in new.collect()] == [("ns:alice", "ns:age", '"42"^^xsd:integer')]
    assert g.find("alice").count() == 2 and g.find(o="42").count() == 1 and g.find("42").count() == 0 and g.find("", "", "").count() == 2
    assert [r["source"] for r in store.provenance_of(g.triples, g.provenance).orderBy("p").collect()] == [None, "census.txt"]
    gone = g.delete(texts(spark, ("alice", "knows", "bob"), ("x", "y", "z")))
    assert gone.triples.count() == 1 and gone.provenance.count() == 1
    with pytest.raises(Exception, match="no term"):
        g.insert(texts(spark, ("ok", "p", "q"), ("bogus:thing", "p", "q")))[1].collect()
    merged, new = g.merge(texts(spark, ("ns:alice", "ns:knows", "ns:bob"), ("ns:c", "ns:p", "ns:d")))
    assert new.count() == 1 and merged.triples.count() == 3
    assert tuple(store.stats(merged.triples).first()) == (3, 2, 3)
    assert store.exists(g.triples, "alice") and not store.exists(g.triples, "bob")


def test_save_and_open(spark, tmp_path):
    g = Graph.of(spark, [("a", "p", "b"), ("a", "q", '"x"')])
    g.save(str(tmp_path / "kb"))
    again = Graph.open(spark, str(tmp_path / "kb"))
    assert sorted(map(tuple, again.triples.collect())) == sorted(map(tuple, g.triples.collect())) and again.provenance.count() == 0


def test_case_index(spark):
    g = Graph.of(spark, [("Keanu", "p", "KEANU"), ("x", "p", '"Keanu"')])
    assert {r["lower"]: r["names"] for r in store.case_index(g.triples).collect()} == {"ns:keanu": ["ns:KEANU", "ns:Keanu"], "ns:x": ["ns:x"]}


def test_origin(spark):
    a, b = Graph.of(spark, [("s", "rdf:type", "Human")]).triples, Graph.of(spark, [("s", "rdf:type", "Human"), ("s", "rdf:type", "Mortal")]).triples
    assert {r["o"]: r["origin"] for r in store.with_origin(a, b).collect()} == {"ns:Human": "asserted", "ns:Mortal": "inferred"}
