"""Operators over triple tables (s, p, o) and their provenance (s, p, o, source, at).

A graph is a set: every operator keeps its rows distinct. Terms are strings, see
`lattica.functions.terms`. Asserted and inferred triples are kept in tables of
their own, so reasoning can never leak into what is stored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import terms

SPO = ["s", "p", "o"]


def parse_batch(raw: DataFrame) -> DataFrame:
    """Texts (s, p, o) as triples, the batch as a whole: one text that is no term fails it."""
    out = []
    for c in SPO:
        term = terms.parsed(F.col(c), as_object=c == "o")
        out.append(F.when(term.isNull(), F.raise_error(F.concat(F.lit("no term: "), F.coalesce(F.col(c), F.lit("null"))))).otherwise(term).alias(c))
    return raw.select(*out)


def add(triples: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` that are not in `triples` yet, once each: what an insert adds."""
    return new.select(SPO).dropDuplicates(SPO).join(triples.select(SPO), SPO, "left_anti")


def remove(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """`triples` without the rows of `gone`. Provenance stays: it is a log."""
    return triples.join(gone.select(SPO), SPO, "left_anti")


def find(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, limit: int | None = None) -> DataFrame:
    """Triples with the given terms, written by hand; None or an empty text is a wildcard. With a limit: the first by s, p, o."""
    out = triples
    for c, text in zip(SPO, (s, p, o), strict=True):
        if text:
            out = out.where(F.col(c) == terms.parse(text, as_object=c == "o"))
    return out if limit is None else out.orderBy(*SPO).limit(limit)


def with_origin(asserted: DataFrame, inferred: DataFrame) -> DataFrame:
    """All triples with `origin`: asserted, or inferred only."""
    only = inferred.select(SPO).join(asserted.select(SPO), SPO, "left_anti")
    return asserted.select(*SPO, F.lit("asserted").alias("origin")).unionByName(only.select(*SPO, F.lit("inferred").alias("origin")))


def stats(triples: DataFrame) -> DataFrame:
    """One row: triples, entities (distinct subjects), predicates."""
    return triples.agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("s").alias("entities"), F.countDistinct("p").alias("predicates"))


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def exists(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> bool:
    return not find(triples, s, p, o).limit(1).isEmpty()


def provenance_of(triples: DataFrame, provenance: DataFrame) -> DataFrame:
    """(s, p, o, source, at): the log's records of each triple; triples without any have nulls."""
    return triples.select(SPO).join(provenance, SPO, "left")


def provenance_index(provenance: DataFrame) -> DataFrame:
    """(s, p, o, n, sources): each triple's records, sources in order of time."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "source")))
    return provenance.groupBy(*SPO).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["source"]), "; ").alias("sources"))


def log(added: DataFrame, source: str, at: Column | None = None) -> DataFrame:
    """Provenance records for triples that were added, at UTC seconds."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if at is None else at
    return added.select(*SPO, F.lit(source).alias("source"), now.alias("at"))


def case_index(triples: DataFrame) -> DataFrame:
    """(lower, names): the IRIs that occur as subject or object, by their lower-case form."""
    names = triples.select(F.explode(F.array("s", "o")).alias("name")).where(terms.is_iri(F.col("name"))).distinct()
    return names.groupBy(F.lower("name").alias("lower")).agg(F.sort_array(F.collect_set("name")).alias("names"))


@dataclass(frozen=True)
class Graph:
    """A stored graph: immutable; `insert` and `delete` give the next state."""

    triples: DataFrame
    provenance: DataFrame
    inferred: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], "s string, p string, o string"), spark.createDataFrame([], "s string, p string, o string, source string, at string"))

    @staticmethod
    def of(spark: SparkSession, rows: list[tuple[str, str, str]]) -> Graph:
        """A graph of triples written by hand."""
        parsed = [(terms.parse(s), terms.parse(p), terms.parse(o, as_object=True)) for s, p, o in rows]
        return replace(Graph.empty(spark), triples=spark.createDataFrame(list(dict.fromkeys(parsed)), "s string, p string, o string"))

    @staticmethod
    def open(spark: SparkSession, path: str) -> Graph:
        return Graph(spark.read.parquet(f"{path}/triples"), spark.read.parquet(f"{path}/provenance"))

    def save(self, path: str, mode: str = "error") -> None:
        """Writes the asserted triples, clustered by predicate and subject for pruning, and the log."""
        self.triples.repartitionByRange("p", "s").sortWithinPartitions("p", "s", "o").write.mode(mode).parquet(f"{path}/triples")
        self.provenance.write.mode(mode).parquet(f"{path}/provenance")

    def insert(self, raw: DataFrame, source: str | None = None) -> tuple[Graph, DataFrame]:
        """The next state, and the triples that were new; these alone are logged, if a source is given."""
        new = add(self.triples, parse_batch(raw))
        log_rows = self.provenance if source is None else self.provenance.unionByName(log(new, source))
        return replace(self, triples=self.triples.unionByName(new), provenance=log_rows, inferred=None), new

    def delete(self, raw: DataFrame) -> Graph:
        return replace(self, triples=remove(self.triples, parse_batch(raw)), inferred=None)

    def merge(self, other: DataFrame) -> tuple[Graph, DataFrame]:
        """Set union with imported triples; nothing is logged."""
        new = add(self.triples, other)
        return replace(self, triples=self.triples.unionByName(new), inferred=None), new

    def find(self, s: str | None = None, p: str | None = None, o: str | None = None, limit: int | None = 50) -> DataFrame:
        if self.inferred is None:
            return find(self.triples, s, p, o, limit)
        return find(with_origin(self.triples, self.inferred), s, p, o, limit)
