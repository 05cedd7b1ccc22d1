"""How many solutions patterns have, counted before anything is joined out, and a guard against large products.

Each pattern is counted by the variables that it shares with others; then a pattern
whose shared variables all occur in one other is summed over them and multiplied into
that one, until none is left. Where that always finds a next pattern (no cycle of joins), the
number is exact, and no step has more rows than the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans import sparql_syntax as syntax
from lattica.plans.sparql_syntax import SparqlError
from lattica.runtime import kept, release

#: Solutions that parts of a query which share no variable may make together.
MAX_PRODUCT = 1e9
#: The type of exact counts, and the count from which doubles are taken.
WIDE, MOST_EXACT = "decimal(38,0)", 1e37


class ProductTooLarge(SparqlError):
    """Parts of a query share no variable, and have more combinations than are allowed."""


def size(counted: list[tuple[DataFrame, set[str], bool]]) -> int | None:
    """The number of solutions of joined relations (rows with `__n`, how often each comes; their variables' columns; whether these tell rows apart); None for a cycle.

    Exact, but for a connected part with 1e37 solutions or more, which is counted in doubles. Null values meet nothing.
    """
    # Beside each exact count one in doubles, which says whether the exact one may have passed its digits.
    both = ("__n", "__about")
    parts = [(df.select(*sorted(vars), F.col("__n").cast(WIDE).alias("__n"), F.col("__n").cast("double").alias("__about")), vars, told) for df, vars, told in counted]
    total = 1
    while parts:
        ear = next(((i, shared, j) for i, (_, vars, _) in enumerate(parts) if (shared := vars & set().union(*(v for k, (_, v, _) in enumerate(parts) if k != i))) is not None
                    for j in [next((k for k, (_, v, _) in enumerate(parts) if k != i and shared <= v), None)] if not shared or j is not None), None)
        if ear is None:
            return None
        i, shared, j = ear
        df, vars, told = parts[i]
        if not shared:
            exact, about = df.agg(*[F.try_sum(c).alias(c) for c in both]).first()
            total *= 0 if about is None else int(about) if about >= MOST_EXACT else int(exact)
            if not total:
                return 0
        else:
            keys = sorted(shared)
            sums = df.select(*keys, *[F.col(c).alias(f"{c}_m") for c in both]) if told and shared == vars else df.groupBy(*keys).agg(*[F.try_sum(c).alias(f"{c}_m") for c in both])
            other, theirs, apart = parts[j]
            times = [F.try_multiply(F.col(c), F.col(f"{c}_m")).cast(kind).alias(c) for c, kind in zip(both, (WIDE, "double"), strict=True)]
            parts[j] = (other.join(sums, keys).select(*sorted(theirs), *times), theirs, apart)
        parts.pop(i)
    return total


def pattern_size(planner, patterns: list, known: dict | None = None) -> int | None:
    """`size` of basic patterns; None where a path is among them, or a cycle.

    A pattern is counted by the variables that it shares with others; one that shares
    all of them is left as rows. With `known`, a dict for all calls over one graph,
    counts are kept in the shared folder, and each is made once: its shuffle is gone
    before the next one's, and the graph is never stored.
    """
    if any(isinstance(p[1], syntax.Path) for p in patterns):
        return None
    total, counted = 1, []
    for k in sorted(range(len(patterns)), key=lambda k: len(names(patterns[k]))):
        own, others = names(patterns[k]), set().union(*(names(p) for i, p in enumerate(patterns) if i != k))
        if not own & others:
            # By predicate, where that is open: a few rows that other patterns may need too.
            df, _, _ = _counts(planner, patterns[k], names(patterns[k][1]), known)
            total *= df.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
            if not total:
                return 0
        elif own <= others:
            rows = planner.pattern(*patterns[k])
            counted.append((rows.df.withColumn("__n", F.lit(1)), set(rows.df.columns), False))
        else:
            counted.append(_counts(planner, patterns[k], own & others, known))
    rest = size(counted)
    return None if rest is None else total * rest


def _counts(planner, pattern: tuple, by: set[str], known: dict | None) -> tuple[DataFrame, set[str], bool]:
    """A pattern's solutions counted (`__n`) by some of its variables."""
    rows = planner.pattern(*pattern)
    columns = dict(zip(rows.vars, rows.df.columns, strict=False))
    at = {v: f"k{[t == f'?{v}' for t in pattern].index(True)}" for v in rows.vars}
    grouped = lambda: rows.df.groupBy(*[F.col(columns[v]).alias(at[v]) for v in rows.vars if v in by]).agg(F.count(F.lit(1)).alias("__n"))
    if known is None:
        df = grouped()
    else:
        shape = tuple((at[t[1:]], t[1:] in by) if t.startswith("?") else t for t in pattern)
        if shape not in known:
            known[shape] = kept(grouped())
            release(planner.spark)
        df = known[shape]
    return df.select(*[F.col(at[v]).alias(columns[v]) for v in rows.vars if v in by], "__n"), {columns[v] for v in by}, True


def names(e) -> set[str]:
    """The variables in a part of a query."""
    if isinstance(e, str):
        return {e[1:]} if e.startswith("?") else set()
    if isinstance(e, syntax.Values):
        return set(e.names)
    if isinstance(e, syntax.Query):
        return {n for n, _ in e.select} if e.select is not None else names(e.where)
    if isinstance(e, syntax.Bind):
        return {e.var} | names(e.expr)
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "var":
        return {e[1]}
    if isinstance(e, (list, tuple)):
        return set().union(*map(names, e)) if e else set()
    return names(list(vars(e).values())) if hasattr(e, "__dict__") else set()


def components(group: syntax.Group) -> list[list]:
    """A group's elements, basic patterns one by one, by the variables that connect them; elements without variables stay out."""
    single = [x for e in group.elements for x in ([syntax.Bgp([p]) for p in e.patterns] if isinstance(e, syntax.Bgp) else [e])]
    out: list[tuple[set[str], list]] = []
    for e in single:
        own = names(e)
        if own:
            touched = [c for c in out if c[0] & own]
            out = [c for c in out if not c[0] & own] + [(own.union(*(c[0] for c in touched)), [*(x for c in touched for x in c[1]), e])]
    return [c[1] for c in out]


def guard(planner, group: syntax.Group, most: float = MAX_PRODUCT) -> None:
    """Raises ProductTooLarge if the parts of a group that share no variable have more than `most` combinations.

    Parts that filters or other elements connect are one part, whatever its size. A
    part of patterns alone is counted as `size` does; another one is planned and its
    rows are counted, up to `most`. So a group is refused only for what it would give.
    """
    parts = components(group)
    if len(parts) < 2:
        return
    total = 1
    for part in sorted(parts, key=lambda es: not all(isinstance(e, syntax.Bgp) for e in es)):
        n = pattern_size(planner, [p for e in part for p in e.patterns]) if all(isinstance(e, syntax.Bgp) for e in part) else None
        if n is None:
            n = int(planner.group(syntax.Group(part)).df.limit(int(min(most + 1, 2**31 - 1))).count())
        total *= n
        if not total:
            return
    if total > most:
        raise ProductTooLarge(f"under-constrained: parts that share no variable have {total:.3g} combinations, more than {most:.3g}; connect them, or add a limit")
