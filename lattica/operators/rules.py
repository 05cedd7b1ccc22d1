"""Forward chaining of triple rules by semi-naive joins.

A rule is a body of triple patterns and a head. Each round joins, for every place
of a body, the triples that are new since the last round there with all triples at
the other places; what a round adds is cut and becomes the next one's news. Rules
whose constants don't occur anywhere are skipped, and so are places whose predicate
has no news.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.runtime import kept, release

SPO = ["s", "p", "o"]
Pattern = tuple[str, str, str]
MAX_ROUNDS = 10_000
#: Additions that are read one by one before they are put together.
LOOSE = 8


@dataclass(frozen=True)
class Rule:
    """Patterns of terms and ?variables; `differ` names pairs of variables that may not be equal."""

    name: str
    body: tuple[Pattern, ...]
    head: Pattern
    differ: tuple[tuple[str, str], ...] = ()
    constants: frozenset[tuple[int, str]] = field(init=False, default=frozenset())

    def __post_init__(self):
        found = frozenset((place, term) for atom in self.body for place, term in enumerate(atom) if place and not term.startswith("?"))
        object.__setattr__(self, "constants", found)


def rule(name: str, body: str, head: str, differ: Sequence[str] = ()) -> Rule:
    """A rule from text: patterns separated by " . "."""
    split = lambda text: tuple(text.split())
    return Rule(name, tuple(split(x) for x in body.split(" . ")), split(head), tuple(tuple(x.split()) for x in differ))


def matched(triples: DataFrame, atom: Pattern) -> DataFrame:
    """One column for each variable of the pattern."""
    out, where = {}, []
    for c, term in zip(SPO, atom, strict=True):
        if not term.startswith("?"):
            where.append(F.col(c) == term)
        elif term[1:] in out:
            where.append(F.col(c) == out[term[1:]])
        else:
            out[term[1:]] = F.col(c)
    rows = reduce(DataFrame.where, where, triples)
    return rows.select(*[column.alias(name) for name, column in out.items()])


def joined(parts: list[DataFrame]) -> DataFrame:
    """Natural joins, at each step with a part that shares a variable where there is one."""
    out, rest = parts[0], list(parts[1:])
    while rest:
        k = next((k for k, x in enumerate(rest) if set(x.columns) & set(out.columns)), 0)
        part = rest.pop(k)
        on = [c for c in part.columns if c in out.columns]
        out = out.join(part, on) if on else out.crossJoin(part)
    return out


def _of_schema(atom: Pattern) -> bool:
    """Whether only statements about classes and properties match: few, however many the facts are."""
    return atom[1].startswith(("rdfs:", "owl:", "_:")) or atom[1] == "rdf:type" and atom[2].startswith(("rdfs:", "owl:"))


@dataclass(frozen=True)
class Source:
    """Triples that patterns are matched in, and the statements of the schema among them, kept by themselves."""

    triples: DataFrame
    schema: DataFrame

    @staticmethod
    def of(triples: DataFrame) -> Source:
        p, o = F.col("p"), F.col("o")
        about = lambda c, *prefixes: reduce(lambda a, b: a | b, [F.startswith(c, F.lit(x)) for x in prefixes])
        return Source(triples, kept(triples.where(about(p, "rdfs:", "owl:", "_:") | (p == "rdf:type") & about(o, "rdfs:", "owl:"))))

    def matched(self, atom: Pattern) -> DataFrame:
        """Patterns of the schema are matched in a small frame, whose size joins know: the facts that meet it need not move."""
        return matched(self.schema if _of_schema(atom) else self.triples, atom)


def consequences(r: Rule, sources: list[Source], new: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Heads of a rule, the k-th pattern of whose body is matched in the k-th of `sources`; of the heads that are `asked` for, if given.

    Statements of the schema are joined first, then the `new` source, then all facts:
    so facts are never joined with facts before the schema has picked among them.
    """
    order = sorted(range(len(r.body)), key=lambda k: (not _of_schema(r.body[k]), k != new, k))
    parts = [sources[k].matched(r.body[k]) for k in order]
    parts = [x.distinct() if len(x.columns) < 2 else x for x in parts]
    rows = joined(parts if asked is None else [asked, *parts])
    for a, b in r.differ:
        rows = rows.where(F.col(a[1:]) != F.col(b[1:]))
    head = [F.col(t[1:]) if t.startswith("?") else F.lit(t) for t in r.head]
    out = rows.select(*[c.alias(n) for c, n in zip(head, SPO, strict=True)])
    if r.head[0].startswith("?"):
        out = out.where(~F.startswith(F.col("s"), F.lit('"')))  # literals are no subjects
    return out


def _constants(triples: DataFrame, rules: Iterable[Rule]) -> set[tuple[int, str]]:
    """Which of the rules' constants occur."""
    return constants_in(triples, {c for r in rules for c in r.constants})


def constants_in(triples: DataFrame, wanted: Iterable[tuple[int, str]]) -> set[tuple[int, str]]:
    """Which of some terms occur at their places, 1 for the predicate and 2 for the object; as many rows as are asked for."""
    wanted, out = list(wanted), set()
    for place, column in ((1, "p"), (2, "o")):
        terms = sorted(t for k, t in wanted if k == place)
        if terms:
            out |= {(place, x[0]) for x in triples.where(F.col(column).isin(terms)).select(column).distinct().collect()}
    return out


def planned(rules: Iterable[Rule], present: set[tuple[int, str]], fresh: set[tuple[int, str]]) -> Iterator[tuple[Rule, int]]:
    """Rules whose constants are all `present`, and the places of their bodies whose constants are all `fresh`."""
    for r in rules:
        if r.constants <= present:
            for k, atom in enumerate(r.body):
                if {(place, t) for place, t in enumerate(atom) if place and not t.startswith("?")} <= fresh:
                    yield r, k


def together(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def saturate(known: DataFrame, news: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[DataFrame]]:
    """All that the rules give of `known` once `news`, which it holds, is new; and what each round added.

    Both are distinct. What is known grows by the rounds' additions, which are put
    together anew only now and then, so a round writes what it adds and no more.
    """
    present, fresh, added, loose = _constants(known, rules), _constants(news, rules), [], 0
    old = Source.of(known)
    new = old if news is known else Source.of(news)
    for _ in range(MAX_ROUNDS):
        found = [consequences(r, [new if j == k else old for j in range(len(r.body))], k) for r, k in planned(rules, present, fresh)]
        if not found:
            return known, added
        # What is known already is looked for among all that is known, not the other way round: a small find moves none of it.
        heads = kept(together(found).distinct())
        news = kept(heads.join(known.join(heads, SPO, "left_semi"), SPO, "left_anti"))
        if news.isEmpty():
            return known, added
        fresh = _constants(news, rules)
        present |= fresh
        added.append(news)
        known, loose = known.unionByName(news), loose + 1
        if loose == LOOSE:
            known, loose = kept(known), 0
        new = Source.of(news)
        old = Source(known, kept(old.schema.unionByName(new.schema)))
        release(known.sparkSession)
    raise RuntimeError("the rules did not settle")


def fixpoint(triples: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`triples` and all that the rules give of them, distinct."""
    known = kept(triples.select(SPO).distinct())
    return saturate(known, known, rules)[0]


def overdeleted(known: DataFrame, news: DataFrame, rules: Sequence[Rule], present: set[tuple[int, str]]) -> DataFrame:
    """What of `known` the rules give in one step of `news` with all else known."""
    old, new = Source.of(known), Source.of(news)
    found = [consequences(r, [new if j == k else old for j in range(len(r.body))], k) for r, k in planned(rules, present, _constants(news, rules))]
    return together(found).distinct().join(known, SPO, "left_semi") if found else known.limit(0)


def rederived(known: DataFrame, gone: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What of `gone` the rules give in one step of `known`: bodies meet the heads that are asked for first."""
    present, out, source = _constants(known, rules), [], Source.of(known)
    heads = _constants(gone, [Rule(r.name, (r.head,), r.head) for r in rules])
    for r in rules:
        head = {(place, t) for place, t in enumerate(r.head) if place and not t.startswith("?")}
        if r.constants <= present and head <= heads:
            asked = matched(gone, r.head).distinct()
            out.append(consequences(r, [source] * len(r.body), asked=asked))
    return together(out).distinct() if out else gone.limit(0)
