"""What keeps large batches of problems in time: spread over tasks, and whole numbers worked with as such."""

from fractions import Fraction

import pytest

from lattica.plans import catalog, exprs, smt


def test_one_file_of_orders_is_dealt_out(spark, tmp_path):
    spark.range(2 * catalog.SMT_ROWS + 1).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert catalog.smt_batch(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_whole_numbers_stay_ints_and_others_exact():
    solver = smt.Solver({"x": "int"})
    tree = lambda text: exprs.parse(text, {"x": "int"})
    assert {k: type(v) for k, v in solver.linear(tree("2*x + 6/3")).items()} == {"x": int, None: int}
    assert solver.linear(tree("x/3 + 0.1 + 1/2")) == {"x": Fraction(1, 3), None: Fraction(3, 5)}
    assert smt.check({"x": "real"}, ["3*x == 1"]).model == {"x": "1/3"}
    assert smt.check({"x": "int"}, ["3*x == 1"]).verdict == "inconsistent"


def test_a_remembered_form_is_of_its_own_variables():
    assert smt.check({"x": "int", "y": "int"}, ["x > 1", "y > 2"]).verdict == "consistent"
    assert smt.check({"x": "int"}, ["y > 3"]).verdict == "error"
    with pytest.raises(exprs.ExpressionError):
        exprs.parse("x > 007", {"x": "int", "y": "int"})
