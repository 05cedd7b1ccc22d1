"""Finite-domain constraint problems as joins of their domains, filtered as soon as variables are bound."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans import exprs
from lattica.runtime import spread

#: Larger search spaces are refused.
MAX_SPACE = 5_000_000
#: Rows of domains that a task has, about.
TASK_ROWS = 1_000_000
SHOWN = 20


class ProblemError(ValueError):
    """A problem that can't be posed."""


@dataclass(frozen=True)
class Solutions:
    """The number of solutions and the first of them, by the variables' order."""

    count: int
    shown: list[dict]
    truncated: bool


def _waiting(variables: Collection[str], constraints: Sequence[str], all_different: Sequence[Sequence[str]]) -> list[tuple[set[str], Column]]:
    """The conditions, each with the variables that it needs."""
    waiting = [(set(exprs.names(t)), exprs.column(t)) for t in (exprs.parse(c, variables) for c in constraints)]
    for group in all_different:
        if unknown := set(group) - set(variables):
            raise ProblemError(f"unknown variables: {', '.join(sorted(unknown))}")
        own = list(dict.fromkeys(group))
        waiting += [({a, b}, F.col(f"`{a}`") != F.col(f"`{b}`")) for i, a in enumerate(own) for b in own[:i]]
    return waiting


def solutions_of_each(domains: DataFrame, by: str, variables: Sequence[str], constraints: Sequence[str] = (), all_different: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(by, a column for each variable): the solutions of many problems at once, one for each value of `by`.

    `domains` (by, variable, value) holds a row for each value that a problem's
    variable may take; repeated rows count once, those without a problem or a value
    not at all, and a problem that lacks a variable has no solution. Problems are
    dealt out whole, about TASK_ROWS of their rows to a task, after the rows are
    counted. A condition filters as soon as its variables are bound. A problem with
    more than MAX_SPACE assignments fails the query with its name.
    """
    if not variables:
        raise ProblemError("no variables")
    waiting = _waiting(variables, constraints, all_different)
    rows = spread(domains.select(by, "variable", "value"), TASK_ROWS, by)
    rows = rows.where(F.col(by).isNotNull() & F.col("value").isNotNull() & F.col("variable").isin(list(variables)))
    # In one order by problem, variable and value: repeated values go, and of a domain that is too large for any problem no more is gathered than shows that.
    order = Window.partitionBy(by, "variable").orderBy("value")
    rows = rows.withColumn("__rank", F.dense_rank().over(order)).withColumn("__first", ~F.lag("value").over(order).eqNullSafe(F.col("value")))
    rows = rows.where(F.col("__first") & (F.col("__rank") <= MAX_SPACE + 1))
    out = rows.groupBy(by).agg(*[F.collect_list(F.when(F.col("variable") == v, F.col("value"))).alias(f"__d_{v}") for v in variables])
    space = reduce(lambda a, b: a * b, [F.size(f"__d_{v}").cast("double") for v in variables])
    message = F.concat(F.lit("search space is too large: "), F.col(by).cast("string"))
    out = out.where(F.when(space > MAX_SPACE, F.raise_error(message).cast("boolean")).otherwise(space > 0))
    bound: set[str] = set()
    for v in variables:
        out = out.withColumn(v, F.explode(f"__d_{v}")).drop(f"__d_{v}")
        bound.add(v)
        for _, c in [w for w in waiting if w[0] <= bound]:
            out = out.where(c)
        waiting = [w for w in waiting if not w[0] <= bound]
    return out


def solutions(spark: SparkSession, variables: Mapping[str, Sequence], constraints: Sequence[str] = (), all_different: Sequence[Sequence[str]] = ()) -> DataFrame:
    """A row for each solution, a column for each variable.

    A domain joins when its turn comes, with all constraints that it completes: an
    equality with what is bound is an equi-join, the rest are filters of a bounded
    product. Constraints without variables hold for all or none.
    """
    if not variables or any(len(d) == 0 for d in variables.values()):
        raise ProblemError("every variable needs a domain")
    if (space := prod(len(set(d)) for d in variables.values())) > MAX_SPACE:
        raise ProblemError(f"search space of {space} assignments is larger than {MAX_SPACE}")
    waiting = _waiting(variables, constraints, all_different)
    out: DataFrame | None = None
    bound: set[str] = set()
    for name, domain in variables.items():
        values = spark.createDataFrame([(v,) for v in dict.fromkeys(domain)], [name])
        out = values if out is None else out.crossJoin(F.broadcast(values))  # at most MAX_SPACE rows in all
        bound.add(name)
        ready = [c for need, c in waiting if need <= bound]
        waiting = [(need, c) for need, c in waiting if not need <= bound]
        for c in ready:
            out = out.where(c)
    return out


def solve(spark: SparkSession, variables: Mapping[str, Sequence], constraints: Sequence[str] = (), all_different: Sequence[Sequence[str]] = ()) -> Solutions:
    found = solutions(spark, variables, constraints, all_different)
    first = found.orderBy(*[F.col(f"`{v}`") for v in variables]).limit(SHOWN).collect()
    n = found.count()
    return Solutions(n, [r.asDict() for r in first], n > SHOWN)
