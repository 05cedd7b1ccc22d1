"""OWL 2 RL closure over triple tables, and claims checked against it.

Equality is kept apart: connected components of owl:sameAs name a representative
for each individual, triples are rewritten to representatives, and members are
expanded only where asked for. The other rules run by semi-naive joins
(`lattica.operators.rules`). Reflexive and axiomatic triples are withheld.

A closure can be kept up to date: `changed` takes facts and schema away and adds
others, with work that follows what the change touches. What may rest on something
that is gone is taken out to the last consequence; then what still stands without it
is derived again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.components import components
from lattica.operators.rules import SPO, Rule, constants_in, matched, overdeleted, rederived, rule, saturate, together
from lattica.runtime import deadline, kept, setting

TYPE, SAME, DIFFERENT, SUB = "rdf:type", "owl:sameAs", "owl:differentFrom", "rdfs:subClassOf"

#: The rules of the W3C profile that derive triples from patterns of fixed length.
RULES: tuple[Rule, ...] = (
    rule("scm-sco", "?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?c", "?a rdfs:subClassOf ?c", ["?a ?c"]),
    rule("scm-eqc1a", "?a owl:equivalentClass ?b", "?a rdfs:subClassOf ?b"),
    rule("scm-eqc1b", "?a owl:equivalentClass ?b", "?b rdfs:subClassOf ?a"),
    rule("scm-eqc2", "?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?a", "?a owl:equivalentClass ?b", ["?a ?b"]),
    rule("cax-sco", "?x rdf:type ?a . ?a rdfs:subClassOf ?b", "?x rdf:type ?b"),
    rule("scm-spo", "?a rdfs:subPropertyOf ?b . ?b rdfs:subPropertyOf ?c", "?a rdfs:subPropertyOf ?c", ["?a ?c"]),
    rule("scm-eqp1a", "?a owl:equivalentProperty ?b", "?a rdfs:subPropertyOf ?b"),
    rule("scm-eqp1b", "?a owl:equivalentProperty ?b", "?b rdfs:subPropertyOf ?a"),
    rule("scm-eqp2", "?a rdfs:subPropertyOf ?b . ?b rdfs:subPropertyOf ?a", "?a owl:equivalentProperty ?b", ["?a ?b"]),
    rule("prp-spo1", "?x ?a ?y . ?a rdfs:subPropertyOf ?b", "?x ?b ?y"),
    rule("prp-dom", "?x ?p ?y . ?p rdfs:domain ?c", "?x rdf:type ?c"),
    rule("prp-rng", "?x ?p ?y . ?p rdfs:range ?c", "?y rdf:type ?c"),
    rule("scm-dom1", "?p rdfs:domain ?a . ?a rdfs:subClassOf ?b", "?p rdfs:domain ?b"),
    rule("scm-dom2", "?q rdfs:domain ?c . ?p rdfs:subPropertyOf ?q", "?p rdfs:domain ?c"),
    rule("scm-rng1", "?p rdfs:range ?a . ?a rdfs:subClassOf ?b", "?p rdfs:range ?b"),
    rule("scm-rng2", "?q rdfs:range ?c . ?p rdfs:subPropertyOf ?q", "?p rdfs:range ?c"),
    rule("prp-symp", "?x ?p ?y . ?p rdf:type owl:SymmetricProperty", "?y ?p ?x"),
    rule("prp-trp", "?x ?p ?y . ?y ?p ?z . ?p rdf:type owl:TransitiveProperty", "?x ?p ?z"),
    rule("prp-inv1", "?x ?p ?y . ?p owl:inverseOf ?q", "?y ?q ?x"),
    rule("prp-inv2", "?x ?q ?y . ?p owl:inverseOf ?q", "?y ?p ?x"),
    rule("cls-hv1", "?u rdf:type ?x . ?x owl:hasValue ?y . ?x owl:onProperty ?p", "?u ?p ?y"),
    rule("cls-hv2", "?u ?p ?y . ?x owl:hasValue ?y . ?x owl:onProperty ?p", "?u rdf:type ?x"),
    rule("cls-svf1", "?u ?p ?v . ?v rdf:type ?y . ?x owl:someValuesFrom ?y . ?x owl:onProperty ?p", "?u rdf:type ?x"),
    rule("cls-svf2", "?u ?p ?v . ?x owl:someValuesFrom owl:Thing . ?x owl:onProperty ?p", "?u rdf:type ?x"),
    rule("cls-avf", "?u ?p ?v . ?u rdf:type ?x . ?x owl:allValuesFrom ?y . ?x owl:onProperty ?p", "?v rdf:type ?y"),
    rule("scm-hv", "?a owl:hasValue ?i . ?a owl:onProperty ?p . ?b owl:hasValue ?i . ?b owl:onProperty ?q . ?p rdfs:subPropertyOf ?q", "?a rdfs:subClassOf ?b", ["?a ?b"]),
    rule("scm-svf1", "?a owl:someValuesFrom ?c . ?a owl:onProperty ?p . ?b owl:someValuesFrom ?d . ?b owl:onProperty ?p . ?c rdfs:subClassOf ?d", "?a rdfs:subClassOf ?b", ["?a ?b"]),
    rule("scm-svf2", "?a owl:someValuesFrom ?c . ?a owl:onProperty ?p . ?b owl:someValuesFrom ?c . ?b owl:onProperty ?q . ?p rdfs:subPropertyOf ?q", "?a rdfs:subClassOf ?b", ["?a ?b"]),
    rule("scm-avf1", "?a owl:allValuesFrom ?c . ?a owl:onProperty ?p . ?b owl:allValuesFrom ?d . ?b owl:onProperty ?p . ?c rdfs:subClassOf ?d", "?a rdfs:subClassOf ?b", ["?a ?b"]),
    rule("scm-avf2", "?a owl:allValuesFrom ?c . ?a owl:onProperty ?p . ?b owl:allValuesFrom ?c . ?b owl:onProperty ?q . ?p rdfs:subPropertyOf ?q", "?b rdfs:subClassOf ?a", ["?a ?b"]),
    # Lists are flattened to (holder, _:member, item) before the rules run.
    rule("cls-int2", "?y rdf:type ?c . ?c _:intersection ?d", "?y rdf:type ?d"),
    rule("cls-uni", "?y rdf:type ?d . ?c _:union ?d", "?y rdf:type ?c"),
    rule("scm-int", "?c _:intersection ?d", "?c rdfs:subClassOf ?d", ["?c ?d"]),
    rule("scm-uni", "?c _:union ?d", "?d rdfs:subClassOf ?c", ["?c ?d"]),
    rule("cls-oo", "?c _:oneof ?y", "?y rdf:type ?c"),
    # Lists of several items count as pairs of an item and the rest, see `flattened`.
    rule("cls-int1", "?y rdf:type ?a . ?y rdf:type ?b . ?c _:and1 ?a . ?c _:and2 ?b", "?y rdf:type ?c"),
    rule("cls-int1-single", "?y rdf:type ?a . ?c _:and ?a", "?y rdf:type ?c"),
    rule("prp-spo2", "?x ?a ?y . ?y ?b ?z . ?q _:then1 ?a . ?q _:then2 ?b", "?x ?q ?z"),
    rule("prp-spo2-single", "?x ?a ?y . ?q _:then ?a", "?x ?q ?y"),
)

#: Lists that the rules read, and the predicate of their flattened form.
LISTS = {"owl:intersectionOf": "_:intersection", "owl:unionOf": "_:union", "owl:oneOf": "_:oneof", "owl:propertyChainAxiom": "_:chain", "owl:hasKey": "_:key", "owl:members": "_:members", "owl:distinctMembers": "_:members"}
#: Lists that are taken in pairs.
PAIRED = {"owl:intersectionOf": "_:and", "owl:propertyChainAxiom": "_:then"}
#: Begins the names of a list's beginnings, which stand for what its first items give.
PREFIX = "_:~"


def list_members(triples: DataFrame) -> DataFrame:
    """(holder, p, list, place, item): items of the lists that LISTS names, by walking rdf:rest one step a round; a list's first cell names it."""
    holds = triples.where(F.col("p").isin(list(LISTS))).select(F.col("s").alias("holder"), "p", F.col("o").alias("list"), F.col("o").alias("cell"))
    first = kept(triples.where(F.col("p") == "rdf:first").select(F.col("s").alias("cell"), F.col("o").alias("item")))
    rest = kept(triples.where(F.col("p") == "rdf:rest").select(F.col("s").alias("cell"), F.col("o").alias("next")))
    out, place = None, 0
    at = kept(holds.where(F.col("cell") != "rdf:nil"))
    seen = at
    while not at.isEmpty():
        here = at.join(first, "cell").select("holder", "p", "list", F.lit(place).alias("place"), "item")
        out = here if out is None else out.unionByName(here)
        step = at.join(rest, "cell").select("holder", "p", "list", F.col("next").alias("cell")).where(F.col("cell") != "rdf:nil")
        at = kept(step.join(seen, ["holder", "p", "list", "cell"], "left_anti"))  # a list that bites its tail ends
        seen = kept(seen.unionByName(at))
        place += 1
    return kept(out) if out is not None else triples.sparkSession.createDataFrame([], "holder string, p string, list string, place int, item string")


def flattened(members: DataFrame) -> DataFrame:
    """Lists as statements for the rules: (holder, LISTS[p], item); and, of lists that are taken in pairs, each beginning of a list as the beginning before and its last item."""
    named = F.coalesce(*[F.when(F.col("p") == p, F.lit(f)) for p, f in LISTS.items()])
    out = members.select(F.col("holder").alias("s"), named.alias("p"), F.col("item").alias("o"))
    rows = members.where(F.col("p").isin(list(PAIRED))).withColumn("p", F.coalesce(*[F.when(F.col("p") == p, F.lit(f)) for p, f in PAIRED.items()]))
    ends = rows.groupBy("holder", "p", "list").agg(F.max("place").alias("last"), F.min_by("item", "place").alias("first"))
    rows = rows.join(ends, ["holder", "p", "list"])
    beginning = lambda k: F.concat(F.lit(PREFIX), "list", F.lit("|"), k.cast("string"))
    whole = F.when(F.col("place") == F.col("last"), F.col("holder")).otherwise(beginning(F.col("place")))
    before = F.when(F.col("place") == 1, F.col("first")).otherwise(beginning(F.col("place") - 1))
    pairs = rows.where("place > 0").select(whole.alias("s"), F.explode(F.array(F.struct(F.concat("p", F.lit("1")).alias("p"), before.alias("o")), F.struct(F.concat("p", F.lit("2")).alias("p"), F.col("item").alias("o")))).alias("x"))
    single = rows.where("last = 0").select(F.col("holder").alias("s"), "p", F.col("item").alias("o"))
    return out.unionByName(pairs.select("s", "x.p", "x.o")).unionByName(single).distinct()


def rewritten(triples: DataFrame, same: DataFrame) -> DataFrame:
    """Triples with every term replaced by its representative in `same` (node, component)."""
    out = triples.select(SPO)
    for c in SPO:
        names = same.select(F.col("node").alias(c), F.col("component").alias("__rep"))
        out = out.join(names, c, "left").withColumn(c, F.coalesce("__rep", c)).drop("__rep")
    return out.select(SPO).distinct()


@dataclass(frozen=True)
class Idle:
    """Asserted triples, as they were asserted and without repeats, whose predicates no rule can read (`idle_predicates`); equality alone renames them."""

    triples: DataFrame
    predicates: frozenset[str]

    def part(self, triples: DataFrame, of: bool = True) -> DataFrame:
        """The triples with idle predicates, or the others."""
        mine = F.col("p").isin(sorted(self.predicates))
        return triples.where(mine if of else ~mine)


def _renamed(idle: DataFrame, same: DataFrame) -> DataFrame:
    """As `rewritten`, for idle triples: only those with a name in `same` are compared."""
    out = idle.select(SPO)
    for c in ("s", "o"):
        out = out.join(same.select(F.col("node").alias(c), F.col("component").alias(f"__{c}")), c, "left")
    plain = F.col("__s").isNull() & F.col("__o").isNull()
    return out.where(plain).select(SPO).unionByName(out.where(~plain).select(F.coalesce("__s", "s").alias("s"), "p", F.coalesce("__o", "o").alias("o")).distinct())


def _named(triples: DataFrame, same: DataFrame, columns: list[str]) -> DataFrame:
    """Triples over representatives, over all names."""
    for c in columns:
        names = same.select(F.col("component").alias(c), F.col("node").alias("__name"))
        triples = triples.join(names, c, "left").withColumn(c, F.coalesce("__name", c)).drop("__name")
    return triples.select(SPO)


@dataclass(frozen=True)
class Closure:
    """What follows from a graph: triples over representatives, and the components of equal individuals (node, component).

    `known` holds the triples with those that only the rules read; `members` are the
    asserted lists (holder, p, list, place, item). `idle`, if any, are asserted triples
    that `known` lacks.
    """

    known: DataFrame
    same: DataFrame
    members: DataFrame
    idle: Idle | None = None

    @property
    def _read(self) -> DataFrame:
        inner = [*LISTS.values(), *[f + k for f in PAIRED.values() for k in ("", "1", "2")]]
        begun = F.startswith("p", F.lit(PREFIX)) | ((F.col("p") == TYPE) & F.startswith("o", F.lit(PREFIX)))
        return self.known.where(~F.col("p").isin(inner) & ~begun)

    @property
    def triples(self) -> DataFrame:
        return self._read if self.idle is None else self._read.unionByName(_renamed(self.idle.triples, self.same))

    def expanded(self) -> DataFrame:
        """All entailed triples over all names, sameAs between different names included."""
        pair = self.same.select(F.col("node").alias("s"), "component").join(self.same.select(F.col("node").alias("o"), "component"), "component")
        out = _named(self._read, self.same, SPO).unionByName(pair.where("s <> o").select("s", F.lit(SAME).alias("p"), "o")).distinct()
        if self.idle is None:
            return out
        # Distinct triples over representatives have distinct names, and idle predicates are none of `known`.
        return out.unionByName(_named(_renamed(self.idle.triples, self.same), self.same, ["s", "o"]))


def _functional(known: DataFrame, delta: DataFrame | None, kind: str) -> DataFrame:
    """sameAs from (inverse) functional properties: every value links to the least, so a crowd costs no pairs.

    With a `delta`, of the groups alone that it adds to, or whose property it makes functional.
    """
    key, value = ("s", "o") if kind == "owl:FunctionalProperty" else ("o", "s")
    props = matched(known, ("?p", TYPE, kind)).distinct()
    rows = known.join(props, "p", "left_semi").where(~F.startswith(value, F.lit('"')))
    if delta is not None:
        touched = delta.join(props, "p", "left_semi").select("p", key).distinct()
        rows = rows.join(touched, ["p", key], "left_semi").unionByName(rows.join(matched(delta, ("?p", TYPE, kind)), "p", "left_semi"))
    least = rows.groupBy("p", key).agg(F.min(value).alias("least"))
    return rows.join(least, ["p", key]).where(F.col(value) != F.col("least")).select(F.col(value).alias("s"), F.lit(SAME).alias("p"), F.col("least").alias("o"))


def _max_one(known: DataFrame) -> DataFrame:
    """sameAs from a cardinality of at most one (cls-maxc2, cls-maxqc3 and 4)."""
    one = known.where(F.col("p").isin(list(CARDINALITIES)) & F.col("o").startswith('"1"')).select(F.col("s").alias("r"))
    on = matched(known, ("?r", "owl:onProperty", "?prop"))
    of = matched(known, ("?r", "owl:onClass", "?cls"))
    held = one.distinct().join(on, "r").join(of, "r", "left")
    users = matched(known, ("?u", TYPE, "?r")).join(held, "r")
    rows = users.join(known.select(F.col("s").alias("u"), F.col("p").alias("prop"), F.col("o").alias("y")), ["u", "prop"]).where(~F.startswith("y", F.lit('"')))
    typed = matched(known, ("?y", TYPE, "?cls")).distinct().withColumn("is_of", F.lit(True))
    rows = rows.join(typed, ["y", "cls"], "left").where(F.col("cls").isNull() | (F.col("cls") == "owl:Thing") | F.col("is_of"))
    least = rows.groupBy("u", "r").agg(F.min("y").alias("least"))
    return rows.join(least, ["u", "r"]).where("y <> least").select(F.col("y").alias("s"), F.lit(SAME).alias("p"), F.col("least").alias("o"))


def _keys(known: DataFrame, members: DataFrame) -> list[DataFrame]:
    """sameAs from keys: individuals of a class that share a value of each property of its key."""
    key = members.where(F.col("p") == "owl:hasKey").select(F.col("holder").alias("c"), "list", "place", F.col("item").alias("p"))
    longest = key.agg(F.max("place")).first()[0]
    if longest is None:
        return []
    last, out = key.groupBy("c", "list").agg(F.max("place").alias("last")), []
    users = matched(known, ("?x", TYPE, "?c")).join(key, "c").join(known.select(F.col("s").alias("x"), "p", F.col("o").alias("v")), ["x", "p"]).select("c", "list", "x", "place", "v")
    # A choice of one value for each property is a name; an individual has as many as its values combine to, one mostly.
    named = users.where("place = 0").select("c", "list", "x", F.array("v").alias("k"))
    for k in range(longest + 1):
        whole = named.join(last.where(F.col("last") == k), ["c", "list"]).select("c", "list", "x", "k")
        least = whole.groupBy("c", "list", "k").agg(F.min("x").alias("least"))
        out.append(whole.join(least, ["c", "list", "k"]).where("x <> least").select(F.col("x").alias("s"), F.lit(SAME).alias("p"), F.col("least").alias("o")))
        step = users.where(F.col("place") == k + 1).drop("place")
        named = named.join(step, ["c", "list", "x"]).select("c", "list", "x", F.array_append("k", F.col("v")).alias("k"))
    return out


CARDINALITIES = ("owl:maxCardinality", "owl:maxQualifiedCardinality")
#: Statements on which equality may rest: kinds of properties, and predicates.
EQUATES = ("owl:FunctionalProperty", "owl:InverseFunctionalProperty")
EQUATING = (*CARDINALITIES, "owl:onProperty", "owl:onClass", "_:key")


def equalities(known: DataFrame, delta: DataFrame | None, members: DataFrame) -> DataFrame:
    """(a, b): equalities that the facts force, as far as `delta` can have added some; all, if it is None."""
    here = constants_in(known, [(2, k) for k in EQUATES] + [(1, p) for p in EQUATING])
    found = [known.where(F.col("p") == SAME)]
    found += [_functional(known, delta, k) for k in EQUATES if (2, k) in here]
    if any((1, p) in here for p in CARDINALITIES):
        found.append(_max_one(known))
    if (1, "_:key") in here:
        found += _keys(known, members)
    return together(found).select(F.col("s").alias("a"), F.col("o").alias("b")).where("a <> b").distinct()


def mentioning(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples with one of `names` (node) at any place."""
    node = names.select("node").distinct()
    return together([triples.join(node.withColumnRenamed("node", c), c, "left_semi").select(SPO) for c in SPO]).distinct()


def _plainly(spark):
    """Planning without inferred filters: unions of what rounds add trip over them, and rules gain nothing from them."""
    return setting(spark, "spark.sql.constraintPropagation.enabled", "false")


def _settled(known: DataFrame, news: DataFrame, same: DataFrame, links: DataFrame, members: DataFrame, rules: tuple[Rule, ...]) -> Closure:
    """The closure of `known`, of which all but `news` and the equalities `links` (a, b) have been worked off.

    Equalities rewrite the triples that they touch, which are then all that is new.
    """
    whole = news is known
    while True:
        if not links.isEmpty():
            now = kept(components(same.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))
            before = same.select("node", F.col("component").alias("was"))
            moved = kept(now.join(before, "node", "left").where(F.col("component") != F.coalesce("was", "node")).select("node"))
            touched = kept(mentioning(known, moved))
            rest = known.join(touched, SPO, "left_anti")
            fresh = kept(rewritten(touched, now).join(rest, SPO, "left_anti"))
            known = kept(rest.unionByName(fresh))
            news = known if whole else kept(rewritten(news, now).unionByName(fresh).distinct())
            same = now
        known, added = saturate(known, news, rules)
        links = kept(equalities(known, None if whole else together([news, *added]), members))
        known, whole = known.where(F.col("p") != SAME), False
        if links.isEmpty():
            return Closure(kept(known), same, members)
        news = known.limit(0)  # the next round's news is what the links rewrite


#: With more predicates than that, none is told to be idle.
MANY_PREDICATES = 1_000
#: The predicates of the schema, which rules and equality read.
VOCABULARY = ("rdf:", "rdfs:", "owl:", "_:")


def _mentioned(triples: DataFrame, terms: set[str]) -> set[str]:
    """Which of some terms occur as subject or object."""
    wanted = sorted(terms)
    ends = triples.select("s").union(triples.select("o")) if wanted else None
    return set() if ends is None else {r[0] for r in ends.where(F.col("s").isin(wanted)).distinct().collect()}


def _wakened(triples: DataFrame, first: DataFrame, asleep: set[str]) -> set[str]:
    """Which of the predicates `asleep` the triples `first` name, or those of a predicate so named."""
    out: set[str] = set()
    found = _mentioned(first, asleep)
    while found:
        out |= found
        found = _mentioned(triples.where(F.col("p").isin(sorted(found))), asleep - out)
    return out


def idle_predicates(triples: DataFrame, rules: tuple[Rule, ...] = RULES) -> frozenset[str]:
    """Predicates that no rule can read: neither of the schema nor named, as subject or object, by a triple that a rule can read.

    A rule takes a predicate from the subject or object of another triple, or names it;
    where one takes any predicate at all, none is idle. Every term that is derived
    comes from a triple that was read, so none names an idle predicate either.
    """
    for r in rules:
        ends = {t for atom in r.body for t in (atom[0], atom[2])}
        if any(atom[1].startswith("?") and atom[1] not in ends for atom in r.body):
            return frozenset()
    own = {atom[1] for r in rules for atom in (*r.body, r.head)} | {t for r in rules for atom in (*r.body, r.head) for t in (atom[0], atom[2])}
    every = {r[0] for r in triples.select("p").distinct().limit(MANY_PREDICATES + 1).collect()}
    if len(every) > MANY_PREDICATES:
        return frozenset()
    read = {p for p in every if p.startswith(VOCABULARY) or p in own}
    asleep = every - read
    return frozenset(asleep - _wakened(triples, triples.where(F.col("p").isin(sorted(read))), asleep))


def closure(triples: DataFrame, rules: tuple[Rule, ...] = RULES, seconds: float | None = None, stored: bool = False) -> Closure:
    """`closed` within a deadline: DeadlineExceeded beyond `seconds`, if given.

    `stored`: the triples have no repeats and can be read again, as tables can. Those
    that no rule can read then stay where they are (`Closure.idle`).
    """
    with deadline(triples.sparkSession, seconds):
        idle = idle_predicates(triples, rules) if stored else frozenset()
        if not idle:
            return closed(triples, rules)
        rest = Idle(triples.select(SPO), idle)
        return replace(closed(rest.part(triples, False), rules), idle=Idle(rest.part(rest.triples), idle))


def _equal(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == SAME).select(F.col("s").alias("a"), F.col("o").alias("b")).where("a <> b")


def closed(triples: DataFrame, rules: tuple[Rule, ...] = RULES) -> Closure:
    """The OWL 2 RL closure of asserted triples.

    Contradictory graphs close too: values that a functional property shares become
    one, so audit the asserted triples (`lattica.operators.audit`), not these.
    """
    with _plainly(triples.sparkSession):
        plain = kept(triples.select(SPO).distinct())
        members = list_members(plain)
        known = kept(plain.where(F.col("p") != SAME).unionByName(flattened(members)))
        same = triples.sparkSession.createDataFrame([], "node string, component string")
        return _settled(known, known, same, kept(_equal(plain)), members, rules)


def nothing_known(spark) -> Closure:
    """The closure of an empty graph."""
    empty = spark.createDataFrame([], "s string, p string, o string")
    return Closure(empty, spark.createDataFrame([], "node string, component string"), list_members(empty))


def changed(asserted: DataFrame, closed: Closure, gone: DataFrame | None = None, new: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, Closure]:
    """The graph without `gone` and with `new` triples, and its closure, from `closed`, the closure of `asserted`.

    The same as a closure of the new graph from nothing. Rows of `gone` that aren't
    asserted and rows of `new` that are change nothing; a triple in both stays. Either
    may be None. Facts and schema alike may come and go.

    What is gone takes with it, to the last consequence, all that a rule gives of it;
    components of equal individuals that it touches come apart, and all triples that
    name them go too. From what is kept, a step of the rules brings back those of the
    lost that still follow; they, what is still asserted, and what is new, start the
    rules again.
    """
    with _plainly(asserted.sparkSession):
        if closed.idle is None:
            return _changed(asserted, closed, gone, new, rules)
        gone, new = gone.select(SPO) if gone is not None else None, kept(new.select(SPO).distinct()) if new is not None else None
        if new is not None:
            closed = _woken(closed, new)
        idle = closed.idle
        parts = [x if x is None else idle.part(x, False) for x in (gone, new)]
        after, now = _changed(idle.part(asserted, False), replace(closed, idle=None), *parts, rules)
        # Idle triples only come and go.
        rest = idle.triples if gone is None else idle.triples.join(idle.part(gone), SPO, "left_anti")
        if new is not None and not (more := idle.part(new)).isEmpty():
            rest = rest.unionByName(more.join(idle.triples.join(more, SPO, "left_semi"), SPO, "left_anti"))
        return after.unionByName(rest), replace(now, idle=Idle(rest, idle.predicates))


def _woken(closed: Closure, new: DataFrame) -> Closure:
    """The closure with those idle triples among the known that rules can read once `new` is there."""
    idle = closed.idle
    up = _wakened(idle.triples, idle.part(new, False), set(idle.predicates))
    if not up:
        return closed
    left = Idle(idle.triples, idle.predicates - up)
    more = rewritten(left.part(idle.triples, False), closed.same)
    return replace(closed, known=kept(closed.known.unionByName(more)), idle=Idle(left.part(idle.triples), left.predicates))


def _changed(asserted: DataFrame, closed: Closure, gone: DataFrame | None, new: DataFrame | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, Closure]:
    plain = asserted.select(SPO)
    empty = plain.limit(0)
    new = kept((new.select(SPO).distinct() if new is not None else empty).join(plain, SPO, "left_anti")) if new is not None else None
    lost = kept(gone.select(SPO).distinct().join(plain, SPO, "left_semi")) if gone is not None else None
    after = plain if lost is None else plain.join(lost, SPO, "left_anti")
    after = after if new is None else after.unionByName(new)
    parts = [x for x in (lost, new) if x is not None]
    if not parts:
        return asserted, closed
    lists = [*LISTS, "rdf:first", "rdf:rest"]
    members, flat, unsaid = closed.members, empty, empty
    if not together(parts).where(F.col("p").isin(lists)).isEmpty():
        members = list_members(kept(after.where(F.col("p").isin(lists))))
        old, now = flattened(closed.members), flattened(members)
        flat, unsaid = kept(now.join(old, SPO, "left_anti")), kept(old.join(now, SPO, "left_anti"))
    lost = unsaid if lost is None else lost.unionByName(unsaid)
    new = flat if new is None else new.unionByName(flat)

    left, over, apart = _without(closed, kept(lost), rules)
    same = closed.same.join(apart, "component", "left_anti")
    names = kept(closed.same.join(apart, "component", "left_semi").select("node"))
    # What is still said of the lost and of the names that came apart.
    said = after.where(F.col("p") != SAME).unionByName(flattened(members))
    again = rewritten(said, same).join(over, SPO, "left_semi").unionByName(rewritten(mentioning(said, names), same)) if not over.isEmpty() or not names.isEmpty() else empty
    back = rederived(left, over, rules) if not over.isEmpty() else empty
    fresh = together([again, back, rewritten(new.where(F.col("p") != SAME), same)]).distinct()
    news = kept(fresh.join(left, SPO, "left_anti"))
    linked = _equal(after).join(names.select(F.col("node").alias("a")), "a", "left_semi")
    links = kept(linked.unionByName(_equal(new)).distinct())
    return after, _settled(left.unionByName(news), news, kept(same), links, members, rules)


def _without(closed: Closure, lost: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What of a closure cannot rest on `lost` triples, what may, and the components that may come apart (component)."""
    known, empty = closed.known, closed.known.limit(0)
    components_ = closed.same.select("component").distinct()
    apart = kept(closed.same.join(_equal(lost).select(F.col("a").alias("node")), "node", "left_semi").select("component").distinct())
    over, news, pending = empty, kept(rewritten(lost.where(F.col("p") != SAME), closed.same).join(known, SPO, "left_semi")), apart
    if news.isEmpty() and apart.isEmpty():
        return known, empty, apart
    present = constants_in(known, sorted({c for r in rules for c in r.constants} | {(1, p) for p in CARDINALITIES}))
    counted = any((1, p) in present for p in CARDINALITIES)
    while True:
        if not pending.isEmpty():
            named = mentioning(known, pending.select(F.col("component").alias("node")))
            news = kept(news.unionByName(named).distinct().join(over, SPO, "left_anti"))
        if news.isEmpty():
            return known.join(over, SPO, "left_anti"), over, apart
        over = over.unionByName(news)
        # A component may rest on what names it, on schema that equates, or on the class of what a counted property belongs to.
        hit = together([news.select(F.col(c).alias("component")) for c in SPO])
        if counted:
            classed = news.where(F.col("p") == TYPE).select("s").distinct()
            hit = hit.unionByName(known.join(classed, "s", "left_semi").select(F.col("o").alias("component")))
        if not news.where(((F.col("p") == TYPE) & F.col("o").isin(list(EQUATES))) | F.col("p").isin(list(EQUATING))).isEmpty():
            hit = components_
        pending = kept(components_.join(hit.distinct(), "component", "left_semi").join(apart, "component", "left_anti"))
        apart = apart.unionByName(pending)
        news = kept(overdeleted(known, news, rules, present).join(over, SPO, "left_anti"))


def inferred(triples: DataFrame, closed: Closure) -> DataFrame:
    """Entailed triples that aren't asserted."""
    return closed.expanded().join(triples.select(SPO), SPO, "left_anti")


def _rep(df: DataFrame, same: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        names = same.select(F.col("node").alias(c), F.col("component").alias("__rep"))
        df = df.join(names, c, "left").withColumn(f"r_{c}", F.coalesce("__rep", c)).drop("__rep")
    return df


def verify(claims: DataFrame, closed: Closure) -> DataFrame:
    """`claims` (s, p, o, ...) with `verdict`: entailed, contradicted or unknown.

    Entailed: in the closure. Contradicted: the predicate is functional and the
    subject has another value; or equality is claimed of what is known to differ.
    """
    known = closed.triples.select(F.col("s").alias("r_s"), F.col("p").alias("r_p"), F.col("o").alias("r_o")).distinct()
    rows = _rep(claims, closed.same, SPO)
    rows = rows.join(known.withColumn("__in", F.lit(True)), ["r_s", "r_p", "r_o"], "left")
    functional = matched(closed.triples, ("?r_p", TYPE, "owl:FunctionalProperty")).distinct()
    valued = known.join(functional, "r_p", "left_semi").groupBy("r_s", "r_p").agg(F.lit(True).alias("__has"))
    rows = rows.join(valued, ["r_s", "r_p"], "left")
    differ = closed.triples.where(F.col("p") == DIFFERENT)
    differ = differ.select(F.col("s").alias("r_s"), F.col("o").alias("r_o")).unionByName(differ.select(F.col("o").alias("r_s"), F.col("s").alias("r_o"))).distinct()
    rows = rows.join(differ.withColumn("__differ", F.lit(True)), ["r_s", "r_o"], "left")
    equal = (F.col("p") == SAME) & (F.col("r_s") == F.col("r_o"))
    verdict: Column = (
        F.when(F.col("__in") | equal, "entailed")
        .when(F.col("__has"), "contradicted")  # not the claimed value, as the claim is not in the closure
        .when((F.col("p") == SAME) & F.col("__differ"), "contradicted")
        .otherwise("unknown")
    )
    return rows.select(*[F.col(c) for c in claims.columns], verdict.alias("verdict"))


def inconsistencies(closed: Closure) -> DataFrame:
    """(rule, s, p, o): what the closure holds that cannot be."""
    t = closed.triples
    disjoint = t.where(F.col("p").isin("owl:disjointWith", "owl:complementOf")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    types = matched(t, ("?x", TYPE, "?a"))
    both = types.join(disjoint, "a").join(matched(t, ("?x", TYPE, "?b")), ["x", "b"]).select(F.lit("cax-dw").alias("rule"), F.col("x").alias("s"), F.lit(TYPE).alias("p"), F.col("b").alias("o"))
    nothing = t.where((F.col("p") == TYPE) & (F.col("o") == "owl:Nothing")).select(F.lit("cls-nothing2").alias("rule"), *SPO)
    of = lambda kind: matched(t, ("?p", TYPE, kind)).distinct()
    loops = t.where("s = o").join(of("owl:IrreflexiveProperty"), "p", "left_semi").select(F.lit("prp-irp").alias("rule"), *SPO)
    back = t.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    asym = t.join(of("owl:AsymmetricProperty"), "p", "left_semi").select(SPO).join(back, SPO, "left_semi").select(F.lit("prp-asyp").alias("rule"), *SPO)
    apart = t.where(F.col("p") == "owl:propertyDisjointWith").select(F.col("s").alias("p"), F.col("o").alias("q"))
    shared = t.join(apart, "p").join(t.select("s", F.col("p").alias("q"), "o"), ["s", "q", "o"]).select(F.lit("prp-pdw").alias("rule"), *SPO)
    differ = t.where((F.col("p") == DIFFERENT) & (F.col("s") == F.col("o"))).select(F.lit("eq-diff1").alias("rule"), *SPO)
    denied = matched(t, ("?n", "owl:sourceIndividual", "?s")).join(matched(t, ("?n", "owl:assertionProperty", "?p")), "n")
    targets = matched(t, ("?n", "owl:targetIndividual", "?o")).unionByName(matched(t, ("?n", "owl:targetValue", "?o")))
    against = t.select(SPO).join(denied.join(targets, "n").select(SPO), SPO, "left_semi").select(F.lit("prp-npa").alias("rule"), *SPO)
    none = t.where(F.col("p").isin("owl:maxCardinality", "owl:maxQualifiedCardinality") & F.col("o").startswith('"0"')).select(F.col("s").alias("r"), (F.col("p") == "owl:maxCardinality").alias("any")).distinct()
    held = matched(t, ("?s", TYPE, "?r")).join(none, "r").join(matched(t, ("?r", "owl:onProperty", "?p")), "r").join(t.select(SPO), ["s", "p"])
    zero = held.where("any").select(F.lit("cls-maxc1").alias("rule"), *SPO)
    counted = held.where("NOT any").join(matched(t, ("?r", "owl:onClass", "?c")), "r")
    of_class = counted.join(t.where(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("c")), ["o", "c"], "left_semi").select(F.lit("cls-maxqc1").alias("rule"), *SPO)
    of_any = counted.where(F.col("c") == "owl:Thing").select(F.lit("cls-maxqc2").alias("rule"), *SPO)
    out = both
    for part in (nothing, loops, asym, shared, differ, against, zero, of_class, of_any, ill_typed(t), *_among_members(closed)):
        out = out.unionByName(part)
    return out.distinct()


#: Forms of literals of a datatype, as XML Schema has them.
LEXICAL = {
    "integer": r"[+-]?\d+", "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", "boolean": r"true|false|0|1",
    "double": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN", "float": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN",
    "nonNegativeInteger": r"\+?\d+|-0+", "positiveInteger": r"\+?0*[1-9]\d*", "date": r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(Z|[+-]\d\d:\d\d)?",
    "dateTime": r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d\d:\d\d)?",
}


def ill_typed(t: DataFrame) -> DataFrame:
    """(rule, s, p, o) of literals that are none of their datatype (dt-not-type)."""
    kind, text = F.regexp_extract("o", r"\^\^<?(?:xsd:|http://www\.w3\.org/2001/XMLSchema#)(\w+)>?$", 1), F.regexp_extract("o", r'(?s)^"(.*)"\^\^[^"]*$', 1)
    bad = F.lit(False)
    for name, form in LEXICAL.items():
        bad = bad | ((kind == name) & ~F.rlike(text, F.lit(f"^({form})$")))
    return t.where(F.startswith(F.col("o"), F.lit('"')) & F.contains("o", F.lit("^^")) & bad).select(F.lit("dt-not-type").alias("rule"), *SPO)


def _among_members(closed: Closure) -> list[DataFrame]:
    """What breaks lists of individuals that differ (eq-diff2, eq-diff3), of disjoint classes (cax-adc) and of disjoint properties (prp-adp).

    Counts by list and place, not pairs: a row for each fact that breaks it.
    """
    t = closed.triples
    lists = _rep(closed.members.withColumnRenamed("p", "by"), closed.same, ["holder", "item"]).select(F.col("r_holder").alias("holder"), "by", "item", F.col("r_item").alias("rep")).distinct()
    of = lambda kind: lists.join(matched(t, ("?holder", TYPE, kind)).distinct(), "holder", "left_semi")
    apart = of("owl:AllDifferent")
    merged = apart.groupBy("holder", "by", "rep").agg(F.countDistinct("item").alias("n")).where("n > 1")
    rule = F.when(F.col("by") == "owl:members", "eq-diff2").otherwise("eq-diff3").alias("rule")
    equal = apart.join(merged.select("holder", "by", "rep"), ["holder", "by", "rep"]).where("item <> rep").select(rule, F.col("item").alias("s"), F.lit(SAME).alias("p"), F.col("rep").alias("o"))
    classes = of("owl:AllDisjointClasses").select("holder", F.col("rep").alias("c")).distinct().join(matched(t, ("?x", TYPE, "?c")).distinct(), "c")
    several = classes.groupBy("holder", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = classes.join(several, ["holder", "x"]).select(F.lit("cax-adc").alias("rule"), F.col("x").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))
    props = of("owl:AllDisjointProperties").select("holder", F.col("rep").alias("p")).distinct().join(t.select(SPO).distinct(), "p")
    shared = props.groupBy("holder", "s", "o").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [equal, both, props.join(shared, ["holder", "s", "o"]).select(F.lit("prp-adp").alias("rule"), *SPO)]
