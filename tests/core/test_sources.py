"""RDF formats, line sources and the stream."""

import gzip
import json

import pytest

from lattica.operators.store import Graph
from lattica.sources import rdf, records
from lattica.streaming import ingest

TURTLE = """@prefix ex: <http://ex.org/> .
@prefix : <http://example.org/ns#> .
# a comment
:alice a :Person ; :knows :bob, ex:carol ; :age 42 ; :height 1.5e0 ; :ok true .
:bob :says "hi \\"you\\"\\n", 'x'@fr, "7"^^<http://www.w3.org/2001/XMLSchema#integer> ; :has [ :p :q ] ; :list ( :a "b" ) .
<http://other.org/x#y> <http://www.w3.org/2000/01/rdf-schema#label> \"\"\"long
text\"\"\" .
"""


def rows(df):
    return sorted(map(tuple, df.collect()))


def named(found):
    """Triples with blank nodes renamed by what is said of them; enough for trees."""
    return sorted((s if not s.startswith("_:") else "_", p, o if not o.startswith("_:") else "_") for s, p, o in found)


def test_turtle():
    got = rdf.parse_turtle(TURTLE)
    assert ("ns:alice", "rdf:type", "ns:Person") in got and ("ns:alice", "ns:knows", "<http://ex.org/carol>") in got and ("ns:alice", "ns:age", '"42"^^xsd:integer') in got
    assert ("ns:bob", "ns:says", '"hi "you"\n"') in got and ("ns:bob", "ns:says", '"x"@fr') in got and ("<http://other.org/x#y>", "rdfs:label", '"long\ntext"') in got
    assert len([t for t in got if t[1] == "rdf:first"]) == 2 and len(got) == 17
    with pytest.raises(ValueError):
        rdf.parse_turtle(":a :b")


@pytest.mark.parametrize("fmt", ["nt", "turtle", "json-ld", "xml"])
def test_round_trips(spark, tmp_path, fmt):
    t = spark.createDataFrame(sorted(set(rdf.parse_turtle(TURTLE))), "s string, p string, o string")
    suffix = {"nt": "nt", "turtle": "ttl", "json-ld": "jsonld", "xml": "rdf"}[fmt]
    (tmp_path / f"g.{suffix}").write_text(rdf.text_of(t, fmt))
    got = rdf.read(spark, str(tmp_path / f"g.{suffix}"))
    assert named(rows(got)) == named(rows(t))
    rdf.write(t, str(tmp_path / f"out.{suffix}"))
    if fmt in ("nt", "turtle"):
        assert named(rows(rdf.read(spark, str(tmp_path / f"out.{suffix}"), fmt))) == named(rows(t))


def test_broken_lines_and_formats(spark, tmp_path):
    (tmp_path / "x.nt").write_text("# fine\n\n<http://a> <http://b> oops .\n")
    with pytest.raises(Exception, match="not N-Triples"):
        rdf.read(spark, str(tmp_path / "x.nt")).collect()
    with pytest.raises(ValueError):
        rdf.guess("x.unknown")


def test_turtle_as_data_source(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix n: <http://example.org/ns#> .\nn:a n:p n:b .\n")
    (tmp_path / "b.ttl").write_text("@prefix n: <http://example.org/ns#> .\nn:c n:p n:d .\n")
    spark.dataSource.register(rdf.TurtleSource)
    assert rows(spark.read.format("turtle").load(str(tmp_path))) == [("ns:a", "ns:p", "ns:b"), ("ns:c", "ns:p", "ns:d")]


def test_records(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"role": "user", "content": " hi "}\nnot json\n\n{"type": "x", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": " b "}]}}\n{"role": "tool", "content": "no"}\n{"role": "system", "content": ""}\n{"role": "user", "content": "end"}')
    got = [(r["turn"], r["role"], r["text"]) for r in records.conversations(spark, str(tmp_path / "c.jsonl")).orderBy("turn").collect()]
    assert got == [(1, "user", "hi"), (2, "assistant", "a\nb"), (3, "user", "end")]
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert rows(records.json_lines(spark, str(tmp_path / "x.json.gz"))) == [(1,), (2,)]
    g = Graph.of(spark, [("a", "p", "b")])
    from lattica.operators.store import log

    for _ in range(2):
        records.append_log(log(g.triples, "s"), str(tmp_path / "log"))
    assert records.provenance_log(spark, str(tmp_path / "log")).count() == 2
    for task, files in {"t1": {"meta.json": "{}", "buggy.py": "x"}, "t2": {"meta.json": "{1}"}}.items():
        (tmp_path / "tasks" / task).mkdir(parents=True)
        for name, text in files.items():
            (tmp_path / "tasks" / task / name).write_text(text)
    assert rows(records.task_folders(spark, str(tmp_path / "tasks"), ("meta.json", "buggy.py")).fillna("-")) == [("t1", "{}", "x"), ("t2", "{1}", "-")]


def test_stream(spark, tmp_path):
    incoming, path = tmp_path / "in", str(tmp_path / "kb")
    incoming.mkdir()
    put = lambda name, *lines: (incoming / name).write_text("\n".join(json.dumps(dict(zip(("s", "p", "o", "source"), x))) for x in lines))
    put("1.json", ("born_in", "rdf:type", "owl:FunctionalProperty", "schema"), ("alice", "born_in", "tokyo", "census"), ("alice", "born_in", "tokyo", "census"))
    ingest.ingest(spark, str(incoming), path, str(tmp_path / "cp")).awaitTermination()
    assert ingest.current(spark, path).count() == 2
    put("2.json", ("alice", "born_in", "osaka", "blog"), ("alice", "born_in", "tokyo", "blog"))
    ingest.ingest(spark, str(incoming), path, str(tmp_path / "cp")).awaitTermination()
    assert ingest.current(spark, path).count() == 3
    assert spark.read.json(f"{path}/provenance").count() == 3
    assert [r["objects"] for r in spark.read.json(f"{path}/violations").collect()] == [["ns:osaka", "ns:tokyo"]]


def test_the_round_trip_takes_little_disk(spark, monkeypatch, tmp_path):
    """A line was written as it is, some 110 bytes; it is compressed, and what is read is the same."""
    from lattica.plans import catalog

    graph = spark.range(20_000).selectExpr("concat('ns:order_', id) AS s", "'ns:contains' AS p", "concat('ns:part_', id * 7919 % 20011) AS o").repartition(2)
    monkeypatch.setattr(catalog, "whole", lambda spark, sf_dir: graph)
    monkeypatch.setattr(catalog, "shared_dir", lambda spark: str(tmp_path))
    got = catalog.rdf_roundtrip(spark, "")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 20 * 20_000
    assert got.count() == 20_000 and got.exceptAll(graph).isEmpty()


def test_lines_of_n_triples(spark, tmp_path):
    lines = [
        '<http://example.org/ns#a> <http://e.org/p> "x \\"y\\" \\u00e9\\n. # z"@en-GB . # said',
        "\t_:b0\t<http://example.org/ns#p>\t<http://e.org/q>\t.\t",
        '_:b0<http://example.org/ns#p>"5"^^<http://www.w3.org/2001/XMLSchema#integer>.',
        '<http://example.org/ns#a> <http://example.org/ns#p> "$1 \\\\ <x>" . ',
        "<http://example.org/ns#a> <http://example.org/ns#p> <http://example.org/ns#b> .\u0085",
        "<http://example.org/ns#a> <http://example.org/ns#p> <http://example.org/ns#b> .",
        "  # a comment", "",
    ]
    (tmp_path / "x.nt").write_text("\n".join(lines), encoding="utf-8", newline="")
    got = {tuple(r) for r in rdf.read(spark, str(tmp_path / "x.nt")).collect()}
    assert got == {("ns:a", "<http://e.org/p>", '"x "y" é\n. # z"@en-GB'), ("_:b0", "ns:p", "<http://e.org/q>"), ("_:b0", "ns:p", '"5"^^xsd:integer'), ("ns:a", "ns:p", '"$1 \\ <x>"'), ("ns:a", "ns:p", "ns:b")}
    for k, bad in enumerate(["<http://e.org/a> <http://e.org/p> <http://e.org/b>", "<http://e.org/a> _:p <http://e.org/b> .", '"a" <http://e.org/p> "b" .', "<http://e.org/a> <http://e.org/p> <http://e.org/b> . more"]):
        (tmp_path / f"bad{k}.nt").write_text(bad, encoding="utf-8")
        with pytest.raises(Exception, match="not N-Triples"):
            rdf.read(spark, str(tmp_path / f"bad{k}.nt")).collect()
