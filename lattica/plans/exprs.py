"""A small expression language for constraints and claims, read without evaluating.

Python's grammar with a fixed list of what may occur; names are variables. The tree
compiles to Spark columns, to SQL, or is walked by the solver.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """An expression that isn't allowed."""


FUNCTIONS = {"abs", "min", "max", "len", "And", "Or", "Not", "Implies", "If"}
ALLOWED = (
    ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.UAdd, ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow,
    ast.Compare, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.Call, ast.Name, ast.Load, ast.Constant, ast.IfExp, ast.Tuple, ast.List,
)


#: Forms of expressions, whole numbers aside, that were found to be allowed for some variables; when there are so many, no more are remembered.
_FINE: set[tuple] = set()
REMEMBERED = 10_000
_WHOLE = re.compile(r"(?<![\w.])\d+(?![\w.])")


def parse(text: str, variables: Mapping[str, object]) -> ast.expr:
    """The expression's tree, all of whose names are variables or known functions."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
        raise ExpressionError(f"cannot read {text!r}") from e
    form = (_WHOLE.sub("0", text), *sorted(variables))  # another number changes no node but a constant
    if form in _FINE:
        return tree.body
    nodes = list(ast.walk(tree))
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    for n in nodes:
        if not isinstance(n, ALLOWED):
            raise ExpressionError(f"{type(n).__name__} is not allowed in {text!r}")
        if isinstance(n, ast.Call) and (not isinstance(n.func, ast.Name) or n.func.id not in FUNCTIONS or n.keywords):
            raise ExpressionError(f"unknown function in {text!r}")
        if isinstance(n, ast.Name) and id(n) not in called and n.id not in variables:
            raise ExpressionError(f"unknown name {n.id!r} in {text!r}")
    if len(_FINE) < REMEMBERED:
        _FINE.add(form)
    return tree.body


def names(tree: ast.expr) -> set[str]:
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


COMPARE: dict[type, Callable] = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


def column(e: ast.expr) -> Column:
    """The tree as a column over columns named like its variables; division as Python does it."""
    if isinstance(e, ast.Constant):
        return F.lit(e.value)
    if isinstance(e, ast.Name):
        return F.col(f"`{e.id}`")
    if isinstance(e, ast.UnaryOp):
        v = column(e.operand)
        return ~v if isinstance(e.op, ast.Not) else -v if isinstance(e.op, ast.USub) else v
    if isinstance(e, ast.BoolOp):
        parts = [column(v) for v in e.values]
        return reduce((lambda a, b: a & b) if isinstance(e.op, ast.And) else (lambda a, b: a | b), parts)
    if isinstance(e, ast.IfExp):
        return F.when(column(e.test), column(e.body)).otherwise(column(e.orelse))
    if isinstance(e, ast.Compare):
        out, left = [], e.left
        for op, right in zip(e.ops, e.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.Tuple, ast.List)):
                    raise ExpressionError("in needs a list")
                here = reduce(lambda a, b: a | b, [column(left) == column(x) for x in right.elts], F.lit(False))
                out.append(here if isinstance(op, ast.In) else ~here)
            else:
                out.append(COMPARE[type(op)](column(left), column(right)))
            left = right
        return reduce(lambda a, b: a & b, out)
    if isinstance(e, ast.BinOp):
        a, b = column(e.left), column(e.right)
        if isinstance(e.op, ast.Add):
            return a + b
        if isinstance(e.op, ast.Sub):
            return a - b
        if isinstance(e.op, ast.Mult):
            return a * b
        if isinstance(e.op, ast.Div):
            return F.try_divide(a, b)
        if isinstance(e.op, ast.FloorDiv):
            return F.floor(F.try_divide(a, b))
        if isinstance(e.op, ast.Mod):  # the sign of the divisor
            return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))
        return F.pow(a, b)
    if isinstance(e, ast.Call):
        name = e.func.id
        flat = e.args[0].elts if len(e.args) == 1 and isinstance(e.args[0], (ast.Tuple, ast.List)) else e.args
        v = [column(x) for x in flat]
        if name == "abs":
            return F.abs(v[0])
        if name in ("min", "max"):
            return v[0] if len(v) == 1 else (F.least if name == "min" else F.greatest)(*v)
        if name == "len":
            return F.lit(len(flat)) if flat is not e.args else F.length(v[0])
        if name == "Not":
            return ~v[0]
        if name == "Implies":
            return ~v[0] | v[1]
        if name == "If":
            return F.when(v[0], v[1]).otherwise(v[2])
        return reduce((lambda a, b: a & b) if name == "And" else (lambda a, b: a | b), v)
    raise ExpressionError(f"{type(e).__name__} stands in the wrong place")
