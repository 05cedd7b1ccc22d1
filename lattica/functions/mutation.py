"""Single-change mutants of a Python function."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

# Operators and what they are turned into, with their signs.
SWAPS: dict[type, tuple[type, str, str]] = {
    ast.Lt: (ast.LtE, "<", "<="), ast.LtE: (ast.Lt, "<=", "<"), ast.Gt: (ast.GtE, ">", ">="), ast.GtE: (ast.Gt, ">=", ">"), ast.Eq: (ast.NotEq, "==", "!="), ast.NotEq: (ast.Eq, "!=", "=="),
    ast.Add: (ast.Sub, "+", "-"), ast.Sub: (ast.Add, "-", "+"), ast.Mult: (ast.FloorDiv, "*", "//"), ast.FloorDiv: (ast.Mult, "//", "*"), ast.And: (ast.Or, "and", "or"), ast.Or: (ast.And, "or", "and"),
}
BOUNDARY = ("comparison", "constant")
#: Programs of at most so many characters are remembered with their mutants, and how many of them.
SHORT, KNOWN = 2000, 256


@dataclass(frozen=True)
class Mutant:
    source: str
    kind: str  # comparison, constant, arithmetic or boolean
    line: int
    column: int
    change: str


def named(tree: ast.AST, name: str) -> ast.AST:
    """The first function of that name anywhere in the tree."""
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name:
            return n
    raise ValueError(f"no function {name!r}")


def live(n: ast.AST) -> Iterator[ast.AST]:
    """Nodes in order of the source, without annotations and docstrings."""
    yield n
    documented = isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and ast.get_docstring(n, clean=False) is not None
    for name, value in ast.iter_fields(n):
        if name in ("annotation", "returns"):
            continue
        for k, child in enumerate(value if isinstance(value, list) else [value]):
            if isinstance(child, ast.AST) and not (documented and name == "body" and k == 0):
                yield from live(child)


def changes(n: ast.AST) -> Iterator[tuple[str, str, Callable[[], None], Callable[[], None]]]:
    """(kind, change, do, undo) of everything that can be changed at one node."""

    def swap(holder: object, key: object, kind: str):
        old = holder[key] if isinstance(holder, list) else getattr(holder, key)
        if type(old) in SWAPS:
            new, was, now = SWAPS[type(old)]
            put = (lambda v: holder.__setitem__(key, v)) if isinstance(holder, list) else (lambda v: setattr(holder, key, v))
            yield kind, f"{was} -> {now}", lambda: put(new()), lambda: put(old)

    if isinstance(n, ast.Compare):
        for k in range(len(n.ops)):
            yield from swap(n.ops, k, "comparison")
    elif isinstance(n, ast.BinOp):
        yield from swap(n, "op", "arithmetic")
    elif isinstance(n, ast.BoolOp):
        yield from swap(n, "op", "boolean")
    elif isinstance(n, ast.Constant) and type(n.value) is int:
        old = n.value
        for new in (old + 1, old - 1):
            yield "constant", f"{old} -> {new}", lambda new=new: setattr(n, "value", new), lambda: setattr(n, "value", old)


def mutants(source: str, function: str) -> Iterator[Mutant]:
    """Every mutant of a function: the whole module with one change, in order of the source."""
    tree = ast.parse(source)
    for n in list(live(named(tree, function))):
        for kind, change, do, undo in list(changes(n)):
            do()
            yield Mutant(ast.unparse(tree) + "\n", kind, n.lineno, n.col_offset, change)
            undo()


def mutants_of(programs: DataFrame) -> DataFrame:
    """(id, n, kind, boundary, line, col, change, source) of programs (id, source, function); unreadable ones give none."""
    kind = programs.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(KNOWN)(lambda source, function: tuple(mutants(source, function)))  # programs that repeat are changed once
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    found = (known if len(r.source) <= SHORT else mutants)(r.source, r.function)
                    found = list(found)
                except (SyntaxError, ValueError, TypeError):
                    continue
                out += [(r.id, k, m.kind, m.kind in BOUNDARY, m.line, m.column, m.change, m.source) for k, m in enumerate(found)]
            yield pd.DataFrame(out, columns=["id", "n", "kind", "boundary", "line", "col", "change", "source"])

    return programs.select("id", "source", "function").mapInPandas(rows, f"id {kind}, n int, kind string, boundary boolean, line int, col int, change string, source string")
