"""Deep comparison of records against paths that are compared one by one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import differences


def paths(value, at="$"):
    yield at, value
    steps = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in steps:
        yield from paths(v, f"{at}[{json.dumps(k, ensure_ascii=False)}]")


def word(x):
    return "object" if isinstance(x, dict) else "array" if isinstance(x, list) else type(x).__name__


def brute(a, b):
    """{path: reason}"""
    a, b = dict(paths(a)), dict(paths(b))
    out = {p: "missing" for p in a if p not in b} | {p: "added" for p in b if p not in a}
    for p in a.keys() & b.keys():
        x, y, kinds = a[p], b[p], {word(a[p]), word(b[p])}
        if "float" in kinds and kinds <= {"float", "int"}:
            if abs(x - y) > max(1e-6 * max(abs(x), abs(y)), 1e-9):
                out[p] = "value"
        elif len(kinds) == 2:
            out[p] = "type"
        elif not isinstance(x, (dict, list)) and x != y:
            out[p] = "value"
    return out


def drawn(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind >= 6:
        size = rng.randrange(4)
        return {rng.choice(['a', 'b c', 'd"e', "f\\g", "ü", "[0]"]): drawn(rng, depth - 1) for _ in range(size)} if kind == 6 else [drawn(rng, depth - 1) for _ in range(size)]
    return [None, rng.random() < 0.5, rng.randrange(-3, 3), rng.choice([0.5, 1.0, 2.25, 1e-10, 3e20]), rng.choice(["", "x", "1", "null"]), rng.randrange(10**12)][kind]


def changed(rng, v):
    if isinstance(v, dict):
        return {k: changed(rng, x) for k, x in v.items() if rng.random() < 0.95}
    if isinstance(v, list):
        return [changed(rng, x) for x in v] + ([7] if rng.random() < 0.1 else [])
    if isinstance(v, float):
        return v * rng.choice([1, 1 + 1e-8, 1 + 1e-3])
    return drawn(rng, 1) if rng.random() < 0.1 else v


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    first = [drawn(rng, 4) for _ in range(300)]
    return [(k, a, changed(rng, a)) for k, a in enumerate(first)]


def test_made_records(spark, made):
    rows = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in made], "id int, a string, b string")
    got = {}
    for r in differences.differences(rows, ["id"], "a", "b").collect():
        got.setdefault(r["id"], {})[r["path"]] = r["reason"]
    assert got == {k: w for k, a, b in made if (w := brute(a, b))}
    counts = {r["id"]: (r["n_differences"], r["alike"]) for r in differences.alike(rows, ["id"], "a", "b").collect()}
    assert counts == {k: (len(w := brute(a, b)), not w) for k, a, b in made}


def test_numbers_nulls_and_repeats(spark):
    cases = [
        ("1.0", "1", 0, False, True), ("1.0", "true", 0, False, False), ("1.0", "true", 0, True, True), ("1", "true", 0, True, False), ("0.5", "0.6", 0.2, False, True), ("1", "2", 5.0, False, False),
        ("null", "null", 0, False, True), ("null", "0", 0, False, False), ("[]", "{}", 0, False, False), ("{", "1", 0, False, None), (None, "1", 0, False, None), ('{"a":1,"a":2}', "1", 0, False, None),
    ]
    for tolerance in (0, 0.2, 5.0):
        for strict in (False, True):
            own = [(a, b, w) for a, b, t, s, w in cases if (t, s) == (tolerance, strict)]
            if own:
                rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(own)], "id int, a string, b string")
                assert {r["id"]: r["alike"] for r in differences.alike(rows, ["id"], "a", "b", tolerance, strict).collect()} == {k: w for k, (_, _, w) in enumerate(own)}
    twice = spark.createDataFrame([(None, "[1]", "[2]"), (None, "[1]", "[2]"), (None, "[1]", "[1]")], "id int, a string, b string")
    assert sorted(r["n_differences"] for r in differences.alike(twice, ["id"], "a", "b").collect()) == [0, 1, 1]
    assert differences.alike(twice.limit(0), ["id"], "a", "b").count() == 0
    text = json.dumps({"deep": [[["x" * 2_000_000]]]})
    assert differences.alike(spark.createDataFrame([(text, text)], "a string, b string"), [], "a", "b").first()["alike"]
    assert differences.differences(twice, [], "a", "b").where(F.col("path") == "$[0]").count() == 2
