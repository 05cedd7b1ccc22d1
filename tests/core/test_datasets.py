"""Generated questions and copies, caches, comparisons, and the smaller sources."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import datasets, metrics
from lattica.plans import sparql
from lattica.runtime import DeadlineExceeded, deadline
from lattica.sources import records


def test_questions_lead_where_they_say(spark):
    triples = datasets.world(spark, 60, 3).cache()
    got = datasets.sample_questions(triples, (1, 2, 3), 8, 5).collect()
    facts = {(r["s"], r["p"]): r["o"] for r in triples.collect()}
    assert [sum(r["hops"] == k for r in got) for k in (1, 2, 3)] == [8, 8, 8] and len({(r["start"], *r["path"]) for r in got}) == 24
    for r in got:
        at = r["start"]
        for p in r["path"]:
            at = facts[at, p]
        assert at == r["answer"] and len(r["path"]) == r["hops"]
    assert {tuple(r) for r in map(tuple, datasets.sample_questions(triples.repartition(7), (1, 2, 3), 8, 5).select("start", "answer").collect())} == {(r["start"], r["answer"]) for r in got}


def test_audit_copy_and_other_values(spark):
    triples = datasets.world(spark, 40, 1).cache()
    before = set(map(tuple, triples.collect()))
    copy, wrong = datasets.audit_copy(triples, 12, 9)
    added = {tuple(r) for r in wrong.collect()}
    assert len(added) == 12 and not added & before and len({t[:2] for t in added}) == 12
    assert {tuple(r)[:3] for r in copy.where("source = 'kb'").collect()} == before and {tuple(r)[:3] for r in copy.where("source = 'injected'").collect()} == added
    values = {p: {t[2] for t in before if t[1] == p} for _, p, _ in added}
    assert all(o in values[p] and (s, p, o) not in before for s, p, o in added)


def test_boundary_tasks_and_cache(spark):
    tasks = spark.createDataFrame([(k, f"t{k}") for k in range(10)], "id int, source string")
    counts = spark.createDataFrame([(k, k, k // 2) for k in range(9)], "id int, mutants int, boundary int")
    assert {r["id"] for r in datasets.boundary_tasks(tasks, counts, None, 1).collect()} == set(range(1, 9))
    drawn = {r["id"] for r in datasets.boundary_tasks(tasks, counts, 2, 1).collect()}
    assert len(drawn) == 2 and drawn <= {6, 7, 8}
    cache = spark.createDataFrame([(1, 3, [True, None, False]), (2, 9, [True])], "id int, n_mutants int, killable array<boolean>")
    known, open_ = metrics.cached_verdicts(spark.createDataFrame([(1, 3), (2, 4), (3, 1)], "id int, n_mutants int"), cache)
    assert [tuple(r) for r in known.collect()] == [(1, 3, [True, None, False])] and {r["id"] for r in open_.collect()} == {2, 3}


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 0.5, 1.0), ("a", None, 0.0), ("b", 0.0, 0.0), ("c", None, 0.5)], "condition string, precision double, recall double")
    assert {r["condition"]: (r["mean_precision"], r["mean_recall"], r["f1"]) for r in metrics.audit_summary(rows).collect()} == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, 0.0), "c": (None, 0.5, None)}


def test_count_tests(spark):
    sources = spark.createDataFrame([("def test_a(): pass\nclass C:\n    async def test_b(self): pass\n    def help(self): pass\n",), ("def (",), (None,)], "source string")
    assert [r[0] for r in sources.select(text.count_tests(F.col("source"))).collect()] == [2, 0, 0]


def test_small_sources(spark, tmp_path):
    rows = [{"instance_id": f"i{k}", "repo": "r", "patch": f"p{k}"} for k in range(3)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps(rows[:2]))
    (tmp_path / "d" / "b.jsonl").write_text(json.dumps(rows[2]) + "\n")
    assert {r["patch"] for r in records.patch_instances(spark, str(tmp_path / "d" / "a.json")).collect()} == {"p0", "p1"}
    assert {r["instance_id"] for r in records.patch_instances(spark, str(tmp_path / "d")).collect()} == {"i0", "i1", "i2"}
    names = spark.createDataFrame([("ns:a", "A b"), ("ns:c", "C")], "curie string, name string")
    records.write_entity_map(names, str(tmp_path / "names"))
    assert set(map(tuple, records.entity_map(spark, str(tmp_path / "names")).collect())) == {("ns:a", "A b"), ("ns:c", "C")}
    assert records.console(names.orderBy("curie"), 1) == "curie  name\n-----  ----\nns:a   A b\n... 2 rows"


def test_deadlines_and_limits(spark):
    slow = spark.range(0, 4_000_000_000, 1, 4)
    with pytest.raises(DeadlineExceeded), deadline(spark, 1.0):
        slow.select(F.bit_xor(F.xxhash64("id", F.sin("id")))).collect()
    with deadline(spark, None):
        assert spark.range(3).count() == 3
    t = spark.createDataFrame([("ns:a", "ns:p", f"ns:b{k}") for k in range(5)], "s string, p string, o string")
    assert len(sparql.bindings(t, "SELECT ?x WHERE { ns:a ns:p ?x }")) == 5 and sparql.ask(t, "ASK { ns:a ns:p ns:b3 }")
    with pytest.raises(ValueError):
        sparql.bindings(t, "SELECT ?x WHERE { ns:a ns:p ?x }", most=4)
