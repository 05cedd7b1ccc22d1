"""A streamed closure against that of the whole graph."""

import json

from lattica.operators import audit, reason
from lattica.streaming import reasoning

BATCHES = [
    [("depot", "rdf:type", "owl:Thing"), ("kept_in", "rdf:type", "owl:TransitiveProperty"), ("bolt", "kept_in", "box"), ("box", "kept_in", "hall")],
    [("hall", "kept_in", "depot"), ("made_by", "rdf:type", "owl:FunctionalProperty"), ("bolt", "made_by", "orion"), ("bolt", "made_by", "orion_ltd"), ("orion", "kept_in", "town")],
    [("box", "kept_in", "hall", "remove"), ("bolt", "kept_in", "box"), ("nut", "made_by", "lyra"), ("bolt", "made_by", "orion_ltd", "remove")],
]


def test_batches_give_the_closure_of_the_whole(spark, tmp_path):
    incoming, path = tmp_path / "in", str(tmp_path / "state")
    incoming.mkdir()
    left = set()
    for k, rows in enumerate(BATCHES):
        (incoming / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("s", "p", "o", "op"), r, strict=False))) for r in rows))
        reasoning.follow(spark, str(incoming), path, str(tmp_path / "checkpoint")).awaitTermination()
        full = lambda r: tuple(x if ":" in x else f"ns:{x}" for x in r[:3])
        left = (left - {full(r) for r in rows if len(r) > 3}) | {full(r) for r in rows if len(r) == 3}
    assert reasoning.complete(spark, path) == [0, 1, 2]
    assert [tuple(r) for r in reasoning.alerts(spark, path, 1).collect()] == [("ns:bolt", "ns:made_by", 2, ["ns:orion", "ns:orion_ltd"])]
    want = reason.closed(spark.createDataFrame(sorted(left), "s string, p string, o string"))
    expanded = {tuple(r) for r in want.expanded().collect()}
    now = reasoning.state(spark, path)
    assert {tuple(r) for r in now.asserted.collect()} == left and {tuple(r) for r in now.closure.expanded().collect()} == expanded
    assert audit.violations(now.asserted).isEmpty() and reasoning.alerts(spark, path, 2).isEmpty()
    # The last batch again, as after a failure.
    raw = spark.read.schema(reasoning.RAW).json(str(incoming / "2.json"))
    reasoning.take_up(spark, path, raw, 2)
    again = reasoning.state(spark, path)
    assert again.batch == 2 and {tuple(r) for r in again.closure.expanded().collect()} == expanded
