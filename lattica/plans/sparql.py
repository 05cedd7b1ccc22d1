"""SPARQL over a triple table: algebra to DataFrames.

A solution is a row with a column for each variable, holding a term or null where
it is unbound. Basic patterns become joins of filtered scans, constants first and
connected patterns next; filters, OPTIONAL, MINUS and EXISTS become filters, left,
anti and semi joins; paths with * or + become semi-naive closures. Errors in
expressions are null, as SPARQL's are neither true nor false. Joins on variables that
may be unbound are equi-joins too, see `Planner.compatible`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.operators.graph import transitive_closure
from lattica.plans import sizes
from lattica.plans import sparql_syntax as syntax
from lattica.plans.sparql_syntax import SparqlError
from lattica.runtime import cut, deadline


def column_name(var: str) -> str:
    """A column for a variable; Spark's names ignore case, SPARQL's don't."""
    return f"v_{var}" if var == var.lower() else f"v_{var.lower()}_{var.encode().hex()}"


def col(var: str) -> Column:
    return F.col(column_name(var))


@dataclass
class Rows:
    """Solutions: which variables they have, and which of these may be unbound."""

    df: DataFrame
    vars: list[str]
    maybe: set[str]


#: Parts into which rows are dealt that share no bound variable with those that they meet.
SALTS = 32
#: Rows of one side of `Planner.paired` that share a link and meet the other side in one place.
LINKED = 1024


class Pairing(NamedTuple):
    """Two sides of a join, ready: `right` has its shared variables renamed; `copied` says that a left row may come several times."""

    left: DataFrame
    right: DataFrame
    shared: list[str]
    condition: Column
    helpers: list[str]
    copied: bool


# values in expressions: ("term" | "bool" | "num" | "int" | "str", column)
Value = tuple[str, Column]


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def as_term(v: Value) -> Column:
    kind, c = v
    if kind == "term":
        return c
    if kind == "bool":
        return F.when(c.isNotNull(), F.concat(F.lit('"'), c.cast("string"), F.lit('"^^xsd:boolean')))
    if kind == "int":
        return F.when(c.isNotNull(), F.concat(F.lit('"'), c.cast("decimal(38,0)").cast("string"), F.lit('"^^xsd:integer')))
    if kind == "num":
        return F.when(c.isNotNull(), F.concat(F.lit('"'), c.cast("string"), F.lit('"^^xsd:double')))
    return F.when(c.isNotNull(), F.concat(F.lit('"'), c, F.lit('"')))


def as_num(v: Value) -> Column:
    kind, c = v
    return c.cast("double") if kind in ("num", "int") else terms.number(c) if kind == "term" else none("double")


def as_str(v: Value) -> Column:
    """A literal's or string's characters; null for IRIs."""
    kind, c = v
    if kind == "str":
        return c
    if kind == "term":
        return F.when(terms.is_literal(c), terms.lexical(c))
    return terms.lexical(as_term(v))


def as_bool(v: Value) -> Column:
    """The effective boolean value."""
    kind, c = v
    if kind == "bool":
        return c
    if kind in ("num", "int"):
        return (c != 0) & ~F.isnan(c.cast("double"))
    if kind == "str":
        return c != ""
    n, of = terms.number(c), terms.datatype(c)
    return F.when(of == "xsd:boolean", terms.lexical(c).isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(of.isin("xsd:string", "rdf:langString"), terms.lexical(c) != "")


def is_numeric(v: Value) -> bool:
    return v[0] in ("num", "int")


class Planner:
    """Plans one query over one triple table."""

    def __init__(self, triples: DataFrame):
        self.triples = triples.select("s", "p", "o")
        self.spark = triples.sparkSession
        self.fresh = 0

    # groups

    def unit(self) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("__unit")), [], set())

    def group(self, group: syntax.Group) -> Rows:
        rows, filters = None, []
        for e in group.elements:
            if isinstance(e, syntax.Filter):
                filters.append(e.expr)  # over the whole group, wherever it stands
            elif isinstance(e, syntax.Optional_):
                rows = self.optional(rows or self.unit(), e.group)
            elif isinstance(e, syntax.Minus):
                rows = self.minus(rows or self.unit(), self.group(e.group))
            elif isinstance(e, syntax.Bind):
                rows = rows or self.unit()
                if e.var in rows.vars:
                    raise SparqlError(f"?{e.var} is bound already")
                rows = Rows(rows.df.withColumn(column_name(e.var), as_term(self.value(e.expr, rows))), [*rows.vars, e.var], rows.maybe | {e.var})
            else:
                rows = self.join(rows, self.element(e)) if rows else self.element(e)
        rows = rows or self.unit()
        for expr in filters:
            rows = self.filter(rows, expr)
        return rows

    def element(self, e) -> Rows:
        if isinstance(e, syntax.Bgp):
            return self.bgp(e.patterns)
        if isinstance(e, syntax.Group):
            return self.group(e)
        if isinstance(e, syntax.Query):
            return self.query(e)
        if isinstance(e, syntax.Union):
            return reduce(self.union, [self.group(b) for b in e.branches])
        if isinstance(e, syntax.Values):
            schema = ", ".join(f"{column_name(n)} string" for n in e.names) or "__unit int"
            df = self.spark.createDataFrame([tuple(r) for r in e.rows] if e.names else [(1,)] * len(e.rows), schema)
            return Rows(df, list(e.names), {n for k, n in enumerate(e.names) if any(r[k] is None for r in e.rows)})
        raise SparqlError(f"unsupported: {type(e).__name__}")

    # joins

    def compatible(self, a: Rows, b: Rows, wild: bool = True) -> Pairing:
        """How rows of two sides go together: each shared variable is equal, or unbound on either side.

        Which variables are bound is a row's signature. A row is copied for each
        signature that the other side may have; then both signatures, and the values
        of what both bind, are an equal key. Rows that bind nothing in common meet all
        rows of their signatures, which are dealt out by a salt, or none if not `wild`.
        """
        shared = [v for v in b.vars if v in a.vars]
        other = b.df.drop("__unit")
        for v in shared:
            other = other.withColumnRenamed(column_name(v), f"r_{column_name(v)}")
        theirs = lambda v: F.col(f"r_{column_name(v)}")
        open_ = [v for v in shared if v in a.maybe or v in b.maybe]
        condition = reduce(lambda x, y: x & y, [col(v) == theirs(v) for v in shared if v not in open_], F.lit(True))
        if not open_:
            return Pairing(a.df, other, shared, condition, [], False)
        bits = {v: 1 << k for k, v in enumerate(open_)}
        signature = lambda of: reduce(lambda x, y: x + y, [F.when(of(v).isNotNull(), F.lit(bits[v])).otherwise(F.lit(0)) for v in open_])
        possible = lambda rows: [sum(c) for c in product(*[(bits[v], 0) if v in rows.maybe else (bits[v],) for v in open_])]
        copies = lambda of: F.explode(F.array(*map(F.lit, of))) if len(of) > 1 else F.lit(of[0])
        left = a.df.withColumn("__l_a", signature(col)).withColumn("__l_b", copies(possible(b)))
        right = other.withColumn("__r_b", signature(theirs)).withColumn("__r_a", copies(possible(a)))
        both_l, both_r = F.col("__l_a").bitwiseAND(F.col("__l_b")), F.col("__r_a").bitwiseAND(F.col("__r_b"))
        names = []
        for v in open_:
            k = len(names)
            left = left.withColumn(f"__l_{k}", F.when(both_l.bitwiseAND(bits[v]) != 0, col(v)).otherwise(F.lit("")))
            right = right.withColumn(f"__r_{k}", F.when(both_r.bitwiseAND(bits[v]) != 0, theirs(v)).otherwise(F.lit("")))
            names.append(str(k))
        if len(open_) == len(shared):
            spread = F.pmod(F.xxhash64(*[col(v) for v in a.vars]), F.lit(SALTS)).cast("int") if wild else F.lit(-1)
            left = left.withColumn("__l_salt", F.when(both_l == 0, spread).otherwise(F.lit(0)))
            salts = F.when(both_r == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if wild else F.array(F.lit(0))
            right = right.withColumn("__r_salt", F.explode(salts))
            names.append("salt")
        names += ["a", "b"]
        condition = reduce(lambda x, y: x & y, [F.col(f"__l_{n}") == F.col(f"__r_{n}") for n in names], condition)
        return Pairing(left, right, shared, condition, [f"__l_{n}" for n in names], any(v in b.maybe for v in open_))

    def numbered(self, rows: Rows) -> tuple[Rows, str]:
        """Rows with a number each, in the column that is named."""
        self.fresh += 1
        tag = f"__row{self.fresh}"
        return Rows(cut(rows.df.withColumn(tag, F.monotonically_increasing_id())), rows.vars, rows.maybe), tag  # numbers must not change between two reads

    def matching(self, a: Rows, b: Rows, how: str, wild: bool = True) -> DataFrame:
        """The rows of `a` that go together with a row of `b` (left_semi), or with none (left_anti)."""
        p = self.compatible(a, b, wild)
        if not p.shared:
            return a.df.join(p.right.limit(1), F.lit(True), how)
        if not p.copied:
            return p.left.join(p.right, p.condition, how).drop(*p.helpers)
        a, tag = self.numbered(a)
        p = self.compatible(a, b, wild)
        hit = p.left.join(p.right, p.condition, "left_semi").select(tag).distinct()
        return a.df.join(hit, tag, how).drop(tag)

    def settled(self, df: DataFrame, a: Rows, b: Rows, shared: list[str], left: bool) -> Rows:
        """One column for each variable of a join."""
        own = [F.coalesce(col(v), F.col(f"r_{column_name(v)}")).alias(column_name(v)) if v in shared and v in a.maybe else col(v) for v in a.vars]
        new = [v for v in b.vars if v not in a.vars]
        kept = [F.col("__unit")] if not a.vars and not new else []
        maybe = {v for v in a.maybe if v not in shared or v in b.maybe or left} | {v for v in new if left or v in b.maybe}
        return Rows(df.select(*own, *[col(v) for v in new], *kept), [*a.vars, *new], maybe)

    def join(self, a: Rows, b: Rows) -> Rows:
        if not a.vars and "__unit" in a.df.columns and not b.vars:
            return Rows(a.df.crossJoin(b.df.drop("__unit")) if b.df.columns != ["__unit"] else a.df.crossJoin(b.df.select(F.lit(1).alias("__u2"))).select("__unit"), [], set())
        p = self.compatible(a, b)
        return self.settled(p.left.join(p.right, p.condition) if p.shared else a.df.crossJoin(p.right), a, b, p.shared, False)

    def union(self, a: Rows, b: Rows) -> Rows:
        names = [*a.vars, *[v for v in b.vars if v not in a.vars]]
        fill = lambda r: r.df.select(*[col(v) if v in r.vars else none().alias(column_name(v)) for v in names], *([] if names else [F.lit(1).alias("__unit")]))
        maybe = a.maybe | b.maybe | {v for v in names if v not in a.vars or v not in b.vars}
        return Rows(fill(a).unionByName(fill(b)), names, maybe)

    def optional(self, a: Rows, group: syntax.Group) -> Rows:
        """A left join; the group's own filters see both sides and belong to its condition."""
        inner = syntax.Group([e for e in group.elements if not isinstance(e, syntax.Filter)])
        filters = [e.expr for e in group.elements if isinstance(e, syntax.Filter)]
        b = self.group(inner)
        p = self.compatible(a, b)
        if filters or p.copied:
            # The pairs that pass, then a left join on the row's number: conditions may hold EXISTS, and rows may be copied.
            numbered, tag = self.numbered(a)
            p = self.compatible(numbered, b)
            pairs = p.left.join(p.right, p.condition) if p.shared else numbered.df.crossJoin(p.right)
            new = [v for v in b.vars if v not in a.vars]
            both = Rows(pairs.select(F.col(tag), *self._columns(numbered, b, p.shared)), [*a.vars, *new], a.maybe | b.maybe)
            for expr in filters:
                both = self.filter(both, expr)
            found = both.df.select(F.col(tag), *[col(v).alias(f"n_{column_name(v)}") for v in both.vars])
            joined = numbered.df.join(found, tag, "left")
            own = [F.coalesce(F.col(f"n_{column_name(v)}"), col(v)).alias(column_name(v)) for v in a.vars]
            unit = [] if a.vars or new else [F.lit(1).alias("__unit")]
            return Rows(joined.select(*own, *[F.col(f"n_{column_name(v)}").alias(column_name(v)) for v in new], *unit), [*a.vars, *new], a.maybe | set(new))
        return self.settled(p.left.join(p.right, p.condition, "left"), a, b, p.shared, True)

    def _columns(self, a: Rows, b: Rows, shared: list[str]) -> list[Column]:
        own = [F.coalesce(col(v), F.col(f"r_{column_name(v)}")).alias(column_name(v)) if v in shared and v in a.maybe else col(v) for v in a.vars]
        return [*own, *[col(v) for v in b.vars if v not in a.vars]]

    def minus(self, a: Rows, b: Rows) -> Rows:
        if not any(v in a.vars for v in b.vars):
            return a
        # Rows that share no bound variable take nothing away.
        return Rows(self.matching(a, b, "left_anti", wild=False), a.vars, a.maybe)

    def filter(self, rows: Rows, expr: tuple) -> Rows:
        if expr[0] == "and":
            return self.filter(self.filter(rows, expr[1]), expr[2])
        negated = expr[0] == "not" and expr[1][0] == "exists"
        if negated or expr[0] == "exists":
            other = self.group(expr[1][1] if negated else expr[1])
            return Rows(self.matching(rows, other, "left_anti" if negated else "left_semi"), rows.vars, rows.maybe)
        if self.holds_exists(expr):
            # EXISTS inside a larger expression: its truth becomes a column.
            return self.with_exists(rows, expr)
        return Rows(rows.df.where(as_bool(self.value(expr, rows))), rows.vars, rows.maybe)

    def holds_exists(self, expr) -> bool:
        return isinstance(expr, tuple) and (expr[0] == "exists" or any(self.holds_exists(x) for x in expr[1:])) or isinstance(expr, list) and any(map(self.holds_exists, expr))

    def with_exists(self, rows: Rows, expr: tuple) -> Rows:
        numbered, tag = self.numbered(rows)
        df, flags = numbered.df, []

        def flagged(e):
            nonlocal df
            if isinstance(e, tuple) and e and e[0] == "exists":
                name = f"__exists{len(flags)}_{tag}"
                flags.append(name)
                hit = self.matching(numbered, self.group(e[1]), "left_semi").select(F.col(tag), F.lit(True).alias(name))
                df = df.join(hit, tag, "left")
                return ("column", name)
            if isinstance(e, (tuple, list)):
                return type(e)(flagged(x) for x in e)
            return e

        plain = flagged(expr)
        return Rows(df.where(as_bool(self.value(plain, rows))).drop(tag, *flags), rows.vars, rows.maybe)

    # patterns

    def bgp(self, patterns: list) -> Rows:
        """Joins the patterns, the most bound first, and as long as it goes one that shares a variable.

        Paths that are chains of links are patterns too, with variables of their own
        between. What a pattern of one variable allows is joined to each next pattern
        before that meets the others, so that no product of what it leaves out is made.
        """
        asked = list(dict.fromkeys(t[1:] for s, p, o in patterns for t in (s, p, o) if isinstance(t, str) and t.startswith("?")))
        todo, out = [link for p in patterns for link in self.links(*p)], None
        narrow = [p for p in todo if not isinstance(p[1], syntax.Path) and len({t for t in p if t.startswith("?")}) == 1]

        def rank(p) -> tuple:
            names = {t for t in p if isinstance(t, str) and t.startswith("?")}
            connected = out is not None and any(n[1:] in out.vars for n in names)
            recursive = isinstance(p[1], syntax.Path)
            return (out is not None and not connected, recursive, len(names), not isinstance(p[1], str) or p[1].startswith("?"))

        while todo:
            todo.sort(key=rank)
            here = self.pattern(*todo.pop(0), bound=out)
            if len(here.vars) > 1:
                for p in [p for p in narrow if p in todo and any(t[1:] in here.vars for t in p if t.startswith("?"))]:
                    todo.remove(p)
                    here = self.join(here, self.pattern(*p))
            out = here if out is None else self.join(out, here)
        if out is not None and len(asked) < len(out.vars):
            out = Rows(out.df.select(*([col(v) for v in asked] or [F.lit(1).alias("__unit")])), asked, out.maybe)
        return out or self.unit()

    def paired(self, q: syntax.Query) -> Rows | None:
        """The distinct rows of patterns that fall into two sides where one variable that is not asked for links them, else None.

        There may be far more pairs than rows of either side, so pairs are not compared
        with each other where that can be told before: what has one link only, on either
        side, meets each partner once. Only pairs of which both have several links are
        made distinct.
        """
        if not q.distinct or q.order or not q.select or any(e is not None for _, e in q.select) or len(q.where.elements) != 1 or not isinstance(q.where.elements[0], syntax.Bgp):
            return None
        patterns = [link for p in q.where.elements[0].patterns for link in self.links(*p)]
        of = lambda p: {t[1:] for t in p if isinstance(t, str) and t.startswith("?")}
        names = [n for n, _ in q.select]
        for link in sorted(set().union(*map(of, patterns)) - set(names)):
            sides: list[tuple[set[str], list]] = []
            for p in patterns:
                own = of(p) - {link}
                met = [s for s in sides if s[0] & own]
                sides = [s for s in sides if not s[0] & own] + [(own.union(*(s[0] for s in met)), [x for s in met for x in s[1]] + [p])]
            asked = [[n for n in names if n in vars] for vars, _ in sides]
            if len(sides) == 2 and all(asked) and len(asked[0]) + len(asked[1]) == len(names) and all(any(link in of(p) for p in ps) for _, ps in sides):
                break
        else:
            return None
        both = []
        for (_, ps), own in zip(sides, asked, strict=True):
            keys = [column_name(n) for n in own]
            rows = self.bgp(ps).df.select(*keys, col(link).alias("__link")).where("__link IS NOT NULL")
            each = Window.partitionBy(*keys)
            both.append(rows.repartition(*keys).distinct().withColumn("__one", F.min("__link").over(each) == F.max("__link").over(each)))
        out = [column_name(n) for n in names]
        left, right = both[0], both[1].withColumnRenamed("__one", "__other")
        once = self.linked(left, right).where("__one OR __other").select(*out)
        more = self.linked(left.where("NOT __one"), right.where("NOT __other")).select(*out).distinct()
        return Rows(once.unionByName(more), names, set())

    def linked(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The pairs of rows with the same link; a link's left rows are dealt out, and its right rows copied, so that no task makes all pairs of a common one."""
        deals = left.groupBy("__link").agg(F.ceil(F.count(F.lit(1)) / LINKED).cast("int").alias("__deals"))
        own = [c for c in left.columns if c not in ("__link", "__one")]
        dealt = left.join(deals, "__link").withColumn("__deal", F.pmod(F.xxhash64(*own), F.col("__deals")).cast("int")).drop("__deals")
        copied = right.join(deals, "__link").withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
        return dealt.join(copied, ["__link", "__deal"])

    def links(self, s: str, p, o: str) -> list[tuple]:
        """A pattern; of a path that is a chain of links, forth or back, a pattern for each link."""
        if not isinstance(p, syntax.Path):
            return [(s, p, o)]
        if p.op == "link":
            return [(s, p.parts[0], o)]
        if p.op == "inverse":
            return self.links(o, p.parts[0], s)
        if p.op != "sequence":
            return [(s, p, o)]
        self.fresh += 1
        places = [s, *[f"?__via{self.fresh}_{k}" for k in range(1, len(p.parts))], o]
        return [link for a, part, b in zip(places, p.parts, places[1:], strict=False) for link in self.links(a, part, b)]

    def pattern(self, s: str, p, o: str, bound: Rows | None = None) -> Rows:
        if isinstance(p, syntax.Path):
            pairs = self.path(p, None if s.startswith("?") else s, None if o.startswith("?") else o)
            return self.bound_columns(pairs, {"a": s, "b": o})
        return self.bound_columns(self.triples, {"s": s, "p": p, "o": o})

    def bound_columns(self, df: DataFrame, places: dict[str, str]) -> Rows:
        out: dict[str, Column] = {}
        for c, term in places.items():
            if not term.startswith("?"):
                df = df.where(F.col(c) == term)
            elif term[1:] in out:
                df = df.where(F.col(c) == out[term[1:]])
            else:
                out[term[1:]] = F.col(c)
        if not out:
            return Rows(df.select(F.lit(1).alias("__unit")), [], set())
        return Rows(df.select(*[c.alias(column_name(v)) for v, c in out.items()]), list(out), set())

    def path(self, path: syntax.Path, s: str | None, o: str | None) -> DataFrame:
        """(a, b) pairs of a path; `s` and `o` are constants at its ends, if any, that may keep closures small."""
        if path.op == "link":
            return self.triples.where(F.col("p") == path.parts[0]).select(F.col("s").alias("a"), F.col("o").alias("b"))
        if path.op == "inverse":
            return self.path(path.parts[0], o, s).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if path.op == "sequence":
            out = self.path(path.parts[0], s, None)
            for k, part in enumerate(path.parts[1:], 2):
                step = self.path(part, None, o if k == len(path.parts) else None).select(F.col("a").alias("b"), F.col("b").alias("c"))
                out = out.join(step, "b").select("a", F.col("c").alias("b"))
            return out
        if path.op == "alternative":
            return reduce(DataFrame.unionByName, [self.path(x, s, o) for x in path.parts])
        if path.op == "negated":
            forward, inverse = path.parts
            out = []
            if forward or not inverse:
                out.append(self.triples.where(~F.col("p").isin(forward)).select(F.col("s").alias("a"), F.col("o").alias("b")))
            if inverse:
                out.append(self.triples.where(~F.col("p").isin(inverse)).select(F.col("o").alias("a"), F.col("s").alias("b")))
            return reduce(DataFrame.unionByName, out)
        inner = self.path(path.parts[0], None, None)
        if path.op == "optional":
            return inner.unionByName(self.identity(s, o)).distinct()
        if s is None and o is not None:
            back = transitive_closure(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), self.spark.createDataFrame([(o,)], "a string"))
            out = back.select(F.col("b").alias("a"), F.col("a").alias("b"))
        else:
            out = transitive_closure(inner, None if s is None else self.spark.createDataFrame([(s,)], "a string"))
        return out if path.op == "plus" else out.unionByName(self.identity(s, o)).distinct()

    def identity(self, s: str | None, o: str | None) -> DataFrame:
        """Paths of length zero: every node of the graph, and constants at the ends even if they are none."""
        nodes = self.triples.select(F.col("s").alias("a")).union(self.triples.select("o"))
        for term in (s, o):
            if term is not None:
                nodes = nodes.union(self.spark.createDataFrame([(term,)], "a string"))
        return nodes.distinct().select("a", F.col("a").alias("b"))

    # queries

    def query(self, q: syntax.Query) -> Rows:
        rows = self.paired(q)
        if rows is not None:
            df = rows.df.offset(q.offset) if q.offset else rows.df
            return Rows(df if q.limit is None else df.limit(q.limit), rows.vars, rows.maybe)
        rows = self.group(q.where)
        select = q.select if q.select is not None else [(v, None) for v in rows.vars if not v.startswith("_")]
        grouped = bool(q.group or q.having) or any(self.aggregates(e) for _, e in select if e is not None)
        order = q.order
        if grouped:
            rows, select, order = self.aggregated(rows, q, select)
        else:
            for name, expr in select:
                if expr is not None:
                    rows = Rows(rows.df.withColumn(column_name(name), as_term(self.value(expr, rows))), [*rows.vars, name], rows.maybe | {name})
        names = [n for n, _ in select]
        for n in names:
            if n not in rows.vars:
                rows = Rows(rows.df.withColumn(column_name(n), none()), [*rows.vars, n], rows.maybe | {n})
        keys = []
        df = rows.df
        for k, (expr, down) in enumerate(order):
            term = as_term(self.value(expr, rows))
            # Unbound, blank nodes, IRIs, literals; numbers by value.
            rank = F.when(term.isNull(), 0).when(terms.is_blank(term), 1).when(terms.is_iri(term), 2).otherwise(3)
            parts = [rank, F.coalesce(terms.number(term), F.lit(float("-inf"))), F.coalesce(terms.lexical(term), F.lit("")), F.coalesce(term, F.lit(""))]
            for j, part in enumerate(parts):
                df = df.withColumn(f"__key{k}_{j}", part)
                keys.append(F.desc(f"__key{k}_{j}") if down else F.asc(f"__key{k}_{j}"))
        out = [col(n) for n in names] or [F.col("__unit")]
        if keys and not q.distinct:
            df = df.orderBy(*keys)
        if q.distinct:
            extra = [c for c in df.columns if c.startswith("__key")]
            df = df.select(*out, *extra).dropDuplicates([column_name(n) for n in names]) if names else df.limit(1)
            if keys:
                df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rows(df.select(*out), names, {n for n in names if n in rows.maybe})

    def aggregates(self, expr) -> bool:
        return isinstance(expr, tuple) and (expr[0] == "aggregate" or any(self.aggregates(x) for x in expr[1:])) or isinstance(expr, list) and any(map(self.aggregates, expr))

    def aggregated(self, rows: Rows, q: syntax.Query, select: list) -> tuple[Rows, list, list]:
        df, keys = rows.df, []
        for name, expr in q.group:
            if expr != ("var", name):
                df = df.withColumn(column_name(name), as_term(self.value(expr, rows)))
            elif name not in rows.vars:
                df = df.withColumn(column_name(name), none())
            keys.append(column_name(name))
        rows = Rows(df, [*rows.vars, *[n for n, _ in q.group if n not in rows.vars]], rows.maybe | {n for n, _ in q.group})
        found: list[tuple[str, Column, str]] = []

        def planned(e):
            """Expressions with each aggregate replaced by its column."""
            if isinstance(e, tuple) and e and e[0] == "aggregate":
                name = f"__agg{len(found)}"
                column, kind = self.aggregate(e, rows)
                found.append((name, column.alias(name), kind))
                return ("typed", name, kind)
            if isinstance(e, (tuple, list)):
                return type(e)(planned(x) for x in e)
            return e

        select = [(n, planned(e) if e is not None else None) for n, e in select]
        having, order = [planned(e) for e in q.having], [(planned(e), d) for e, d in q.order]
        columns = [c for _, c, _ in found] or [F.count(F.lit(1)).alias("__n")]
        df = df.groupBy(*keys).agg(*columns)
        known = [n for n, _ in q.group]
        out = Rows(df, list(known), rows.maybe & set(known))
        for e in having:
            out = Rows(out.df.where(as_bool(self.value(e, out))), out.vars, out.maybe)
        for n, e in select:
            if e is None and n not in known:
                raise SparqlError(f"?{n} is neither grouped nor aggregated")
            if e is not None:
                out = Rows(out.df.withColumn(column_name(n), as_term(self.value(e, out))), [*out.vars, n], out.maybe | {n})
        return out, [(n, None) for n, _ in select], order

    def aggregate(self, e: tuple, rows: Rows) -> tuple[Column, str]:
        _, name, distinct, expr, separator = e
        if name == "COUNT":
            if expr is None:
                whole = F.struct(*[col(v) for v in rows.vars]) if rows.vars else F.lit(1)
                return (F.count_distinct(whole) if distinct else F.count(F.lit(1))), "int"
            term = as_term(self.value(expr, rows))
            return (F.count_distinct(term) if distinct else F.count(term)), "int"
        if expr is None:
            raise SparqlError(f"{name} needs an expression")
        value = self.value(expr, rows)
        term = as_term(value)
        if name in ("SUM", "AVG"):
            n = as_num(value)
            of = F.collect_set(F.struct(term.alias("t"), n.alias("n")))
            bad = F.count_if(n.isNull() & term.isNotNull()) > 0
            total = F.aggregate(of, F.lit(0.0), lambda acc, x: acc + x["n"]) if distinct else F.coalesce(F.sum(n), F.lit(0.0))
            many = F.count_distinct(term) if distinct else F.count(term)
            if name == "AVG":
                return F.when(~bad, F.when(many == 0, F.lit(0.0)).otherwise(total / many)), "num"
            whole = F.coalesce(F.bool_and(terms.datatype(term) == "xsd:integer"), F.lit(True))
            text = F.when(whole, F.concat(F.lit('"'), total.cast("decimal(38,0)").cast("string"), F.lit('"^^xsd:integer'))).otherwise(F.concat(F.lit('"'), total.cast("string"), F.lit('"^^xsd:double')))
            return F.when(~bad, text), "term"
        if name in ("MIN", "MAX"):
            rank = F.struct(F.when(terms.is_blank(term), 1).when(terms.is_iri(term), 2).otherwise(3), F.coalesce(terms.number(term), F.lit(float("-inf"))), terms.lexical(term), term)
            pick = F.min_by if name == "MIN" else F.max_by
            return pick(term, F.when(term.isNotNull(), rank)), "term"
        if name == "SAMPLE":
            return F.min(term), "term"  # any value will do; this one is the same each time
        texts = F.collect_set(as_str(value)) if distinct else F.collect_list(as_str(value))
        return F.array_join(F.sort_array(texts), separator), "str"

    # expressions

    def value(self, e: tuple, rows: Rows) -> Value:
        op = e[0]
        if op == "var":
            return ("term", col(e[1])) if e[1] in rows.vars else ("term", none())
        if op == "term":
            return ("term", F.lit(e[1]))
        if op == "typed":
            return (e[2], F.col(e[1]))
        if op == "column":
            return ("bool", F.coalesce(F.col(e[1]), F.lit(False)))
        if op in ("and", "or"):
            a, b = as_bool(self.value(e[1], rows)), as_bool(self.value(e[2], rows))
            return ("bool", a & b if op == "and" else a | b)
        if op == "not":
            return ("bool", ~as_bool(self.value(e[1], rows)))
        if op == "minus":
            v = self.value(e[1], rows)
            return ("int", -v[1]) if v[0] == "int" else self.arithmetic("-", ("int", F.lit(0)), v)
        if op in ("+", "-", "*", "/"):
            return self.arithmetic(op, self.value(e[1], rows), self.value(e[2], rows))
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return ("bool", self.compare(op, self.value(e[1], rows), self.value(e[2], rows)))
        if op == "in":
            v = self.value(e[1], rows)
            return ("bool", reduce(lambda a, b: a | b, [self.compare("=", v, self.value(x, rows)) for x in e[2]], F.lit(False)))
        if op == "call":
            return self.call(e[1], e[2], rows)
        raise SparqlError(f"unsupported in an expression: {op}")

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        x, y = as_num(a), as_num(b)
        if op == "/":
            return ("num", F.try_divide(x, y))
        out = x + y if op == "+" else x - y if op == "-" else x * y
        if a[0] == b[0] == "int":
            return ("int", out)
        whole = lambda v: terms.datatype(v[1]) == "xsd:integer" if v[0] == "term" else F.lit(v[0] == "int")
        text = F.when(whole(a) & whole(b), as_term(("int", out))).otherwise(as_term(("num", out)))
        return ("term", F.when(out.isNotNull(), text))

    def compare(self, op: str, a: Value, b: Value) -> Column:
        x, y = as_num(a), as_num(b)
        s, t = as_term(a), as_term(b)
        ops = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
        by = ops[op]
        if op in ("=", "!="):
            return F.when(x.isNotNull() & y.isNotNull(), by(x, y)).otherwise(by(s, t))
        ordered = terms.datatype(s) == terms.datatype(t)  # strings, booleans, dates: as they read
        return F.when(x.isNotNull() & y.isNotNull(), by(x, y)).when(ordered & x.isNull() & y.isNull(), by(terms.lexical(s), terms.lexical(t)))

    def call(self, name: str, args: list, rows: Rows) -> Value:
        if name == "BOUND":
            return ("bool", as_term(self.value(args[0], rows)).isNotNull())
        if name == "COALESCE":
            return ("term", F.coalesce(*[as_term(self.value(a, rows)) for a in args]))
        if name == "IF":
            test, yes, no = (self.value(a, rows) for a in args)
            condition = as_bool(test)
            return ("term", F.when(condition, as_term(yes)).when(~condition, as_term(no)))
        v = [self.value(a, rows) for a in args]
        simple = SCALARS.get(name)
        if simple is None:
            raise SparqlError(f"unknown function {name}")
        try:
            return simple(*v)
        except TypeError as e:
            raise SparqlError(f"{name} takes other arguments") from e


def _rounded(f):
    def run(v: Value) -> Value:
        n = as_num(v)
        whole = (terms.datatype(v[1]) == "xsd:integer") if v[0] == "term" else F.lit(v[0] == "int")
        out = f(n)
        return ("term", F.when(n.isNotNull(), F.when(whole, as_term(("int", out))).otherwise(as_term(("num", out.cast("double"))))))

    return run


def _like(f):
    """String functions keep the language tag of their first argument."""

    def run(v: Value, *more: Value) -> Value:
        out = f(as_str(v), *more)
        if v[0] != "term":
            return ("str", out)
        tag = terms.language(v[1])
        return ("term", F.when(tag != "", F.concat(F.lit('"'), out, F.lit('"@'), tag)).otherwise(as_term(("str", out))))

    return run


def _flags(pattern: Value, flags: tuple) -> Column:
    """The pattern with flags, as Java's regular expressions have them."""
    if not flags:
        return as_str(pattern)
    given = as_str(flags[0])
    return F.concat(F.when(given == "", F.lit("")).otherwise(F.concat(F.lit("(?"), F.translate(given, "q", ""), F.lit(")"))), as_str(pattern))


def _time(pattern: str, kind: str = "int"):
    group = {"year": 1, "month": 2, "day": 3, "hours": 4, "minutes": 5, "seconds": 6}[pattern]

    def run(v: Value) -> Value:
        text = F.regexp_extract(as_str(v), r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?", group)
        n = F.when(text != "", text.try_cast("double"))
        return ("num", n) if kind == "num" else ("int", n)

    return run


def _zone(v: Value) -> Column:
    return F.regexp_extract(as_str(v), r"(Z|[+-]\d\d:\d\d)$", 1)


def _cast(kind: str):
    def run(v: Value) -> Value:
        text = F.trim(F.coalesce(as_str(v), terms.lexical(as_term(v))))
        if kind == "integer":
            n = F.coalesce(text.try_cast("double"), F.when(text == "true", 1.0).when(text == "false", 0.0))
            return ("int", F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)))
        if kind in ("double", "decimal", "float"):
            n = F.coalesce(text.try_cast("double"), F.when(text == "true", 1.0).when(text == "false", 0.0))
            return ("term", F.when(n.isNotNull(), F.concat(F.lit('"'), n.cast("string"), F.lit(f'"^^xsd:{kind}'))))
        if kind == "boolean":
            n = text.try_cast("double")
            return ("bool", F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true").when(n.isNotNull(), n != 0))
        if kind == "string":
            return ("str", text)
        return ("term", F.when(text.isNotNull(), F.concat(F.lit('"'), text, F.lit(f'"^^xsd:{kind}'))))

    return run


def _substr(s: Column, start: Value, *length: Value) -> Column:
    at = as_num(start).cast("int")
    size = as_num(length[0]).cast("int") if length else F.lit(2**30)
    # Places before the first take from the length.
    return F.substring(s, F.greatest(at, F.lit(1)), F.greatest(size + F.least(at, F.lit(1)) - 1, F.lit(0)))


def _split(v: Value, by: Value, after: bool) -> Value:
    s, t = as_str(v), as_str(by)
    at = F.position(t, s)
    out = F.when(at == 0, F.lit("")).otherwise(F.substring(s, at + F.length(t), F.lit(2**30)) if after else F.substring(s, F.lit(1), at - 1))
    return ("str", out)


SCALARS = {
    "STR": lambda v: ("str", F.when(terms.is_iri(as_term(v)), terms.iri(as_term(v))).otherwise(terms.lexical(as_term(v)))),
    "LANG": lambda v: ("str", terms.language(as_term(v))),
    "DATATYPE": lambda v: ("term", terms.datatype(as_term(v))),
    "IRI": lambda v: ("term", F.when(terms.is_iri(as_term(v)), as_term(v)).otherwise(terms.compacted(as_str(v)))),
    "BNODE": lambda *v: ("term", F.concat(F.lit("_:b"), as_str(v[0]) if v else F.uuid())),
    "ABS": _rounded(F.abs), "CEIL": _rounded(F.ceil), "FLOOR": _rounded(F.floor), "ROUND": _rounded(lambda n: F.floor(n + 0.5)),
    "RAND": lambda: ("num", F.rand()),
    "STRLEN": lambda v: ("int", F.length(as_str(v))),
    "SUBSTR": _like(_substr),
    "UCASE": _like(F.upper), "LCASE": _like(F.lower),
    "CONTAINS": lambda a, b: ("bool", F.contains(as_str(a), as_str(b))),
    "STRSTARTS": lambda a, b: ("bool", F.startswith(as_str(a), as_str(b))),
    "STRENDS": lambda a, b: ("bool", F.endswith(as_str(a), as_str(b))),
    "STRBEFORE": lambda a, b: _split(a, b, False),
    "STRAFTER": lambda a, b: _split(a, b, True),
    "CONCAT": lambda *v: ("str", F.concat(*[as_str(x) for x in v]) if v else F.lit("")),
    "ENCODE_FOR_URI": lambda v: ("str", F.replace(F.url_encode(as_str(v)), F.lit("+"), F.lit("%20"))),
    "REPLACE": lambda v, p, r, *f: ("str", F.regexp_replace(as_str(v), _flags(p, f), as_str(r))),
    "REGEX": lambda v, p, *f: ("bool", F.rlike(as_str(v), _flags(p, f))),
    "LANGMATCHES": lambda a, b: ("bool", F.when(as_str(b) == "*", as_str(a) != "").otherwise((F.lower(as_str(a)) == F.lower(as_str(b))) | F.startswith(F.lower(as_str(a)), F.concat(F.lower(as_str(b)), F.lit("-"))))),
    "YEAR": _time("year"), "MONTH": _time("month"), "DAY": _time("day"), "HOURS": _time("hours"), "MINUTES": _time("minutes"), "SECONDS": _time("seconds", "num"),
    "TZ": lambda v: ("str", _zone(v)),
    "TIMEZONE": lambda v: ("term", F.when(_zone(v) == "Z", F.lit('"PT0S"^^xsd:dayTimeDuration')).when(_zone(v) != "", F.concat(F.lit('"'), F.when(F.startswith(_zone(v), F.lit("-")), F.lit("-")).otherwise(F.lit("")), F.lit("PT"), F.substring(_zone(v), 2, 2).cast("int").cast("string"), F.lit("H"), F.lit('"^^xsd:dayTimeDuration')))),
    "NOW": lambda: ("term", F.concat(F.lit('"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"^^xsd:dateTime'))),
    "UUID": lambda: ("term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))), "STRUUID": lambda: ("str", F.uuid()),
    "MD5": lambda v: ("str", F.md5(as_str(v).cast("binary"))), "SHA1": lambda v: ("str", F.sha1(as_str(v).cast("binary"))),
    **{f"SHA{n}": (lambda n: lambda v: ("str", F.sha2(as_str(v).cast("binary"), n)))(n) for n in (256, 384, 512)},
    "STRLANG": lambda a, b: ("term", F.concat(F.lit('"'), as_str(a), F.lit('"@'), as_str(b))),
    "STRDT": lambda a, b: ("term", F.concat(F.lit('"'), as_str(a), F.lit('"^^'), as_term(b))),
    "SAMETERM": lambda a, b: ("bool", as_term(a) == as_term(b)),
    "ISBLANK": lambda v: ("bool", terms.is_blank(as_term(v))), "ISLITERAL": lambda v: ("bool", terms.is_literal(as_term(v))),
    "ISNUMERIC": lambda v: ("bool", F.when(as_term(v).isNotNull(), as_num(v).isNotNull())),
    **{f"xsd:{k}": _cast(k) for k in ("integer", "double", "decimal", "float", "boolean", "string", "dateTime", "date")},
}
SCALARS["URI"] = SCALARS["IRI"]
SCALARS["ISIRI"] = SCALARS["ISURI"] = lambda v: ("bool", terms.is_iri(as_term(v)))


def solutions(triples: DataFrame, text: str, most_combined: float | None = sizes.MAX_PRODUCT) -> DataFrame:
    """A SELECT's solutions, a column of terms for each selected variable; an ASK's as one boolean `ask`.

    Parts that share no variable are counted first, and refused (ProductTooLarge) if
    they have over `most_combined` combinations; not if the query asks for a few rows
    in no order, nor if `most_combined` is None.
    """
    q = syntax.parse(text)
    planner = Planner(triples)
    few = q.ask or q.limit is not None and not (q.order or q.distinct or q.group or q.having or any(e is not None for _, e in q.select or ()))
    if most_combined is not None and not few:
        sizes.guard(planner, q.where, most_combined)
    if q.ask:
        rows = planner.group(q.where).df.limit(1)
        return rows.agg((F.count(F.lit(1)) > 0).alias("ask"))
    rows = planner.query(q)
    if not rows.vars:
        return rows.df
    return rows.df.select(*[col(v).alias(v) for v in rows.vars])


def select(triples: DataFrame, text: str) -> DataFrame:
    """`solutions` with terms as they are printed."""
    out = solutions(triples, text)
    return out if out.columns == ["ask"] else out.select(*[terms.shown(F.col(c)).alias(c) for c in out.columns])


def ask(triples: DataFrame, text: str, seconds: float | None = 30.0) -> bool:
    with deadline(triples.sparkSession, seconds):
        return solutions(triples, text).first()["ask"]


def bindings(triples: DataFrame, text: str, seconds: float | None = 30.0, most: int = 100_000) -> list[dict[str, str]]:
    """A SELECT's rows as dicts without unbound variables; ValueError beyond `most` rows, DeadlineExceeded beyond `seconds`."""
    with deadline(triples.sparkSession, seconds):
        rows = select(triples, text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: add a limit, or use select()")
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]
