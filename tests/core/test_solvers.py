"""Constraint problems and arithmetic claims."""

import itertools
import random

import pytest

from lattica.plans import csp, exprs, smt


def test_csp(spark):
    r = csp.solve(spark, {"a": [1, 2, 3], "b": [1, 2, 3]}, ["a < b"])
    assert (r.count, r.shown[0], r.truncated) == (3, {"a": 1, "b": 2}, False)
    assert csp.solve(spark, {"x": [1, 2], "y": [1, 2]}, all_different=[["x", "y"]]).count == 2
    assert csp.solve(spark, {"x": [1], "y": [1]}, ["x != y"]).count == 0
    assert csp.solve(spark, {"x": [1, 2]}, ["1 == 2"]).count == 0
    r = csp.solve(spark, {"x": range(10), "y": range(10)}, ["abs(x - y) % 3 == 1", "max(x, y) > 4 or x in (1, 2)", "x // 2 != y"])
    want = [{"x": x, "y": y} for x, y in itertools.product(range(10), repeat=2) if abs(x - y) % 3 == 1 and (max(x, y) > 4 or x in (1, 2)) and x // 2 != y]
    assert (r.count, r.shown, r.truncated) == (len(want), want[:20], True)
    for variables, constraints in (({"x": [1]}, ["x == evil()"]), ({"x": []}, []), ({"x": [1]}, ["x.__class__"]), ({"x": [1]}, ["x =="])):
        with pytest.raises((csp.ProblemError, exprs.ExpressionError)):
            csp.solve(spark, variables, constraints)
    with pytest.raises(csp.ProblemError, match="search space"):
        csp.solve(spark, {c: range(100) for c in "abcd"})


I, R, B = "int", "real", "bool"


@pytest.mark.parametrize(
    ("types", "assumptions", "goal", "verdict"),
    [
        ({"x": I, "y": I}, ["x > 5", "y == 2*x"], "y > 10", "proved"), ({"x": I}, ["x > 0"], "x > 5", "refuted"), ({"a": B}, ["a"], None, "consistent"),
        ({"x": I}, ["x > 1", "x < 0"], None, "inconsistent"), ({"a": B, "b": B}, ["Implies(a, b)", "a"], "b", "proved"), ({"x": I}, ["z > 0"], None, "error"), ({"x": "string"}, [], None, "error"),
        ({"x": I, "y": I}, [f"x * y == {10**54 + 61}", "x > 1", "y > 1"], None, "unknown"), ({"x": I}, ["x > 0", "x < 1"], None, "inconsistent"), ({"x": R}, ["x > 0", "x < 1"], None, "consistent"),
        ({"x": I}, ["2*x == 7"], None, "inconsistent"), ({"x": R}, ["2*x == 7"], None, "consistent"), ({"x": R, "y": R}, ["x + y <= 1", "x - y >= 3"], "y <= -1", "proved"),
        ({"x": I}, [], "abs(x) >= 0", "proved"), ({"x": I, "y": I}, [], "max(x, y) >= x and min(x, y) <= y", "proved"), ({"x": I}, ["x*x == 49", "x > 0", "x < 20"], "x == 7", "proved"),
        ({"a": B, "b": B}, ["a != b"], "a or b", "proved"), ({"x": I}, ["0 < x < 3"], "x == 1 or x == 2", "proved"), ({"x": I, "y": I}, ["3*x + 6*y == 4"], None, "inconsistent"),
        ({"x": I, "p": B}, ["If(p, x == 1, x == 2)", "not p"], "x == 2", "proved"), ({"x": R, "y": R}, ["x*y > 1"], None, "unknown"),
    ],
)
def test_claims(types, assumptions, goal, verdict):
    a = smt.check(types, assumptions, goal)
    assert a.verdict == verdict, a
    if verdict in ("refuted", "consistent"):
        assert set(a.model) == set(types)


def test_claims_against_enumeration():
    rnd = random.Random(6)
    for _ in range(300):
        types = {"x": I, "y": I, "p": B}
        atom = lambda: rnd.choice([f"{rnd.randrange(-3, 4)}*x + {rnd.randrange(-3, 4)}*y {rnd.choice(['<', '<=', '==', '!=', '>'])} {rnd.randrange(-4, 5)}", "p", "not p", f"abs(x - {rnd.randrange(3)}) <= {rnd.randrange(3)}"])
        bounds = ["x >= -3", "x <= 3", "y >= -3", "y <= 3"]
        given = [f"({atom()}) {rnd.choice(['and', 'or'])} ({atom()})" for _ in range(2)]
        goal = f"({atom()}) or ({atom()})"
        models = [(x, y, p) for x in range(-3, 4) for y in range(-3, 4) for p in (True, False) if all(eval(g, {"x": x, "y": y, "p": p, "abs": abs}) for g in given)]
        holds = all(eval(goal, {"x": x, "y": y, "p": p, "abs": abs}) for x, y, p in models)
        assert smt.check(types, bounds + given, goal).verdict == ("proved" if holds else "refuted"), (given, goal)
        assert smt.check(types, bounds + given).verdict == ("consistent" if models else "inconsistent")


def test_batch(spark):
    df = spark.createDataFrame([(1, {"x": "int"}, ["x > 1"], "x > 0"), (2, {"x": "int"}, ["x > 1"], None), (3, {"x": "int"}, None, "x > 0")], "id int, variables map<string,string>, assumptions array<string>, goal string")
    assert {r["id"]: r["verdict"] for r in smt.check_all(df).collect()} == {1: "proved", 2: "consistent", 3: "refuted"}
