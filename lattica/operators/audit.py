"""Audits over asserted triples: conflicts of functional properties, and the answer gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.operators.graph import few
from lattica.operators.rules import SPO, matched
from lattica.operators.store import case_index
from lattica.runtime import cut, deadline

#: Differently-cased names that a rejected answer is shown.
HINTS = 5


def violations(triples: DataFrame, seconds: float | None = None) -> DataFrame:
    """(s, p, n, objects): subjects with several values of a property asserted to be functional.

    Over asserted triples on purpose: a closure makes the values equal and spreads
    one conflict over everything that they touch. With `seconds`, the result is made at
    once, or DeadlineExceeded raised.
    """
    if seconds is not None:
        with deadline(triples.sparkSession, seconds):
            return cut(violations(triples))
    functional = few(matched(triples, ("?p", "rdf:type", "owl:FunctionalProperty")).distinct(), "p")  # dealt out by property, a large one would be one task's
    found = triples.join(functional, "p", "left_semi").groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("objects"))
    return found.where(F.size("objects") > 1).select("s", "p", F.size("objects").cast("long").alias("n"), "objects")


def violations_with_sources(triples: DataFrame, provenance: DataFrame) -> DataFrame:
    """(s, p, o, source, at): every value of each violation with its records; null where there are none."""
    values = violations(triples).select("s", "p", F.explode("objects").alias("o"))
    return values.join(provenance.select(*SPO, "source", "at"), SPO, "left")


def identity_conflicts(triples: DataFrame) -> DataFrame:
    """(a, b): pairs said to be the same and to differ, in either direction; a before b."""
    pair = lambda p: triples.where(F.col("p") == p).select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    return pair("owl:sameAs").join(pair("owl:differentFrom"), ["a", "b"], "left_semi")


def check_answers(triples: DataFrame, answers: DataFrame) -> DataFrame:
    """`answers` (id, answer, start, relation) with the gate's three checks and their verdict.

    existence: the answer occurs; else reject, with names that differ in case only.
    type: it occurs with the relation, as object or subject; else warn; skipped
    without relation or existence. start_exclusion: it is neither the start nor linked
    to it by any predicate, in either direction; else warn; skipped without start.
    verdict: the worst of them. Texts are terms written by hand; start and relation
    may be null.
    """
    rows = answers.select("id", terms.parsed(F.col("answer"), True).alias("a"), terms.parsed(F.col("start")).alias("st"), terms.parsed(F.col("relation")).alias("rel"))
    literal = terms.is_literal(F.col("a"))
    # Every check but that of relations asks for triples with the answer at an end: these, in any case, are taken out of the graph first, and may come twice.
    wanted = rows.select(F.lower("a").alias("low")).distinct()
    ends = [triples.select(SPO).join(wanted, F.lower(triples[c]) == wanted["low"], "left_semi") for c in ("s", "o")]
    t = cut(ends[0].unionByName(ends[1]))
    asked = rows.select("a").distinct()
    as_object = t.join(asked, t["o"] == asked["a"], "left_semi").select(F.col("o").alias("a")).distinct()
    as_subject = t.join(asked, t["s"] == asked["a"], "left_semi").select(F.col("s").alias("a")).distinct()
    out = rows.join(as_object.unionByName(as_subject).distinct().withColumn("exists", F.lit(True)), "a", "left")
    names = case_index(t).select(F.col("lower").alias("low"), F.slice("names", 1, HINTS).alias("names"))
    out = out.join(names, F.lower("a") == F.col("low"), "left").drop("low")
    out = out.join(triples.select(F.col("p").alias("rel")).distinct().withColumn("known", F.lit(True)), "rel", "left")
    for column, name in (("o", "object_of"), ("s", "subject_of")):
        uses = t.select(F.col("p").alias("rel"), F.col(column).alias("a")).join(rows.select("rel", "a").distinct(), ["rel", "a"], "left_semi").distinct()
        out = out.join(uses.withColumn(name, F.lit(True)), ["rel", "a"], "left")
    near = t.select(F.col("s").alias("st"), F.col("o").alias("a"), "p").unionByName(t.where(terms.is_iri(F.col("s"))).select(F.col("o").alias("st"), F.col("s").alias("a"), "p"))
    near = near.join(rows.select("st", "a").distinct(), ["st", "a"], "left_semi").groupBy("st", "a").agg(F.sort_array(F.collect_set("p")).alias("links"))
    out = out.join(near, ["st", "a"], "left")
    # An answer that never occurs exists nowhere, whatever its kind.
    existence = F.when(F.col("exists"), "pass").otherwise("reject")
    kind = F.when(F.col("rel").isNull() | F.col("exists").isNull(), "skipped").when(F.col("object_of") | (F.col("subject_of") & ~literal), "pass").otherwise("warn")
    start = F.when(F.col("st").isNull(), "skipped").when((F.col("st") == F.col("a")) | F.col("links").isNotNull(), "warn").otherwise("pass")
    out = out.select(
        "id", existence.alias("existence"), kind.alias("type"), start.alias("start_exclusion"),
        F.when(F.col("exists").isNull() & ~literal, F.array_join("names", ", ")).alias("hint"),
        F.array_join("links", ", ").alias("links"), F.coalesce(F.array_contains("links", F.col("rel")), F.lit(False)).alias("links_by_relation"),
        F.when(F.col("rel").isNotNull(), F.coalesce("known", F.lit(False))).alias("relation_known"),
    )
    return out.withColumn("verdict", F.when(F.col("existence") == "reject", "reject").when((F.col("type") == "warn") | (F.col("start_exclusion") == "warn"), "warn").otherwise("pass"))
