"""RDF files: N-Triples read and written by columns, other formats file by file.

N-Triples is a line format, so it is split over tasks like any text. Turtle (and N3's
common part), RDF/XML and JSON-LD need a whole file; a task reads one at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.functions import terms
from lattica.functions.terms import PREFIXES, compact
from lattica.plans.sparql_syntax import Parser, Path, SparqlError

SPO = ("s", "p", "o")
FORMATS = {".nt": "nt", ".ttl": "turtle", ".n3": "turtle", ".rdf": "xml", ".xml": "xml", ".owl": "xml", ".jsonld": "json-ld", ".json": "json-ld"}
XSD = PREFIXES["xsd"]


def guess(path: str) -> str:
    suffix = re.search(r"\.[^./]+$", path.rstrip("/"))
    if not suffix or suffix[0].lower() not in FORMATS:
        raise ValueError(f"unknown format of {path!r}; known: {', '.join(sorted(set(FORMATS.values())))}")
    return FORMATS[suffix[0].lower()]


# N-Triples

_IRI, _BLANK = r"<[^<>\"{}|^`\\\s]*>", r"_:[^\s<>\"]+"
_LITERAL = r"\"(?:[^\"\\\n\r]|\\.)*\"(?:\^\^<[^<>\s]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"
#: The line ends that are none for a text file, but before which a pattern may end.
_END = r"[\u0085\u2028\u2029]?"


def _unescaped(lexical: Column) -> Column:
    """Escapes as JSON has them, and \\U and \\' besides; JSON's reader does the work."""
    as_json = F.replace(lexical, F.lit("\\'"), F.lit("'"))
    as_json = F.regexp_replace(as_json, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    read = F.try_element_at(F.from_json(F.concat(F.lit('["'), as_json, F.lit('"]')), "array<string>"), F.lit(1))
    return F.when(F.contains(lexical, F.lit("\\")), read).otherwise(lexical)


def _term(text: Column) -> Column:
    lexical = _unescaped(F.regexp_extract(text, r'^"(.*)"[^"]*$', 1))
    kind, tag = F.regexp_extract(text, r'"\^\^<([^<>]*)>$', 1), F.regexp_extract(text, r'"(@[A-Za-z0-9-]+)$', 1)
    iri = F.substring(text, F.lit(2), F.length(text) - 2)
    plain = (kind == "") | (kind == XSD + "string")
    literal = F.concat(F.lit('"'), lexical, F.lit('"'), F.when(tag != "", tag).when(plain, F.lit("")).otherwise(F.concat(F.lit("^^"), terms.compacted(kind))))
    return F.when(F.startswith(text, F.lit('"')), literal).when(F.startswith(text, F.lit("_:")), text).otherwise(terms.compacted(iri))


def read_nt(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; a line that is none, but for blanks and comments, fails the read."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#.*)?$")))
    # One match a line gives all three terms; a step of its own, so that the next one's branches do not match anew.
    found = F.split(F.regexp_replace("value", _LINE + _END, "$1\n$2\n$3"), "\n", 3)
    parted = lines.select("value", found.alias("found"))
    bad = F.when(F.size("found") < 3, F.raise_error(F.concat(F.lit("not N-Triples: "), F.substring("value", 1, 200))))
    parted = parted.select(F.coalesce(bad, F.get("found", 0)).alias("s"), F.get("found", 1).alias("p"), F.get("found", 2).alias("o"))
    return parted.select(*[_term(F.col(c)).alias(c) for c in SPO]).distinct()


def nt_term(term: Column) -> Column:
    """A term as N-Triples writes it."""
    quoted = F.regexp_extract(F.to_json(F.array(terms.lexical(term))), r"(?s)^\[(.*)\]$", 1)
    kind, tag = terms.datatype(term), terms.language(term)
    end = F.when(tag != "", F.concat(F.lit("@"), tag)).when(kind == "xsd:string", F.lit("")).otherwise(F.concat(F.lit("^^<"), terms.iri(kind), F.lit(">")))
    return F.when(terms.is_literal(term), F.concat(quoted, end)).when(terms.is_blank(term), term).otherwise(F.concat(F.lit("<"), terms.iri(term), F.lit(">")))


def nt_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat(nt_term(F.col("s")), F.lit(" "), nt_term(F.col("p")), F.lit(" "), nt_term(F.col("o")), F.lit(" .")).alias("value"))


# Turtle


class TurtleParser(Parser):
    """Turtle has the syntax of SPARQL's patterns, without variables."""

    def __init__(self, text: str, blank: str = "b"):
        super().__init__(re.sub(r"(?m)^\s*@(prefix|base)\b(.*?)\.\s*$", r"\1 \2 .", text))
        self.blank = blank

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.blank}{self.blanks}"

    def path(self) -> Path:
        return Path("link", [self.term()])

    def node(self, out: list) -> str:
        if self.kind == "var":
            raise SparqlError("a variable in a document")
        if self.kind == "blank":
            return f"_:{self.blank}_{self.next()[2:]}"
        return super().node(out)

    def document(self) -> list[tuple[str, str, str]]:
        out: list = []
        while self.kind != "end":
            if self.is_("PREFIX", "BASE"):
                which = self.next().upper()
                if which == "BASE":
                    self.base = self.next()[1:-1]
                else:
                    name = self.next()
                    self.prefixes[name[:-1]] = self.resolved(self.next()[1:-1])
                self.take(".")
                continue
            out += self.triples()
            self.need(".")
        for s, _, _ in out:
            if s.startswith('"'):
                raise SparqlError("a literal as subject")
        return out

    def properties(self, subject: str, out: list) -> None:
        if self.is_("."):
            return
        super().properties(subject, out)


def parse_turtle(text: str, blank: str = "b") -> list[tuple[str, str, str]]:
    return TurtleParser(text, blank).document()


# RDF/XML

_RDF = PREFIXES["rdf"]


def parse_xml(text: str, blank: str = "b") -> list[tuple[str, str, str]]:
    """Descriptions, typed nodes, resources, literals with type or language, nested nodes, and Collection lists."""
    out: list[tuple[str, str, str]] = []
    count = 0
    rdf = lambda name: f"{{{_RDF}}}{name}"
    iri = lambda tag: compact(re.sub(r"^\{(.*)\}", r"\1", tag))

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{blank}{count}"

    def node(e: ET.Element) -> str:
        if (about := e.get(rdf("about"))) is not None:
            s = compact(about)
        elif (own := e.get(rdf("ID"))) is not None:
            s = compact("#" + own)
        else:
            s = f"_:{blank}_{e.get(rdf('nodeID'))}" if e.get(rdf("nodeID")) else fresh()
        if e.tag != rdf("Description"):
            out.append((s, "rdf:type", iri(e.tag)))
        for name, value in e.attrib.items():
            if name.startswith("{") and not name.startswith((f"{{{_RDF}}}", "{http://www.w3.org/XML/1998/namespace}")):
                out.append((s, iri(name), f'"{value}"'))
        for p in e:
            out.append((s, iri(p.tag), value_of(p)))
        return s

    def value_of(p: ET.Element) -> str:
        if (at := p.get(rdf("resource"))) is not None:
            return compact(at)
        if p.get(rdf("nodeID")):
            return f"_:{blank}_{p.get(rdf('nodeID'))}"
        if p.get(rdf("parseType")) == "Collection":
            head = "rdf:nil"
            for item in reversed([node(c) for c in p]):
                cell = fresh()
                out.extend([(cell, "rdf:first", item), (cell, "rdf:rest", head)])
                head = cell
            return head
        if p.get(rdf("parseType")) == "Resource":
            s = fresh()
            out.extend((s, iri(c.tag), value_of(c)) for c in list(p))
            return s
        if len(p):
            return node(p[0])
        lexical, kind, tag = p.text or "", p.get(rdf("datatype")), p.get("{http://www.w3.org/XML/1998/namespace}lang")
        if tag:
            return f'"{lexical}"@{tag}'
        return f'"{lexical}"' if kind in (None, XSD + "string") else f'"{lexical}"^^{compact(kind)}'

    root = ET.fromstring(text)
    for e in root if root.tag == rdf("RDF") else [root]:
        node(e)
    return out


# JSON-LD: expanded form, and a context of prefixes and names


def parse_jsonld(text: str, blank: str = "b") -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    count = 0

    def full(name: str, context: dict) -> str:
        if name.startswith("_:"):
            return f"_:{blank}_{name[2:]}"
        known = context.get(name)
        if isinstance(known, dict):
            known = known.get("@id")
        if known:
            return full(known, {}) if known != name else compact(known)
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//"):
            base = context.get(prefix) or PREFIXES.get(prefix)
            if base:
                return compact(base + local)
        return compact(name if colon else context.get("@vocab", PREFIXES["ns"]) + name)

    def value(v, context: dict, as_iri: bool) -> Iterator[str]:
        nonlocal count
        if isinstance(v, list):
            for x in v:
                yield from value(x, context, as_iri)
        elif isinstance(v, dict):
            if "@list" in v:
                head = "rdf:nil"
                for item in reversed([x for y in v["@list"] for x in value(y, context, as_iri)]):
                    count += 1
                    cell = f"_:{blank}{count}"
                    out.extend([(cell, "rdf:first", item), (cell, "rdf:rest", head)])
                    head = cell
                yield head
            elif "@value" in v:
                x = v["@value"]
                if v.get("@language"):
                    yield f'"{x}"@{v["@language"]}'
                elif v.get("@type"):
                    yield f'"{json.dumps(x) if isinstance(x, bool) else x}"^^{full(v["@type"], context)}'
                else:
                    yield terms.lit(x)
            else:
                yield node(v, context)
        elif as_iri and isinstance(v, str):
            yield full(v, context)
        elif v is not None:
            yield terms.lit(v)

    def node(obj: dict, context: dict) -> str:
        nonlocal count
        if isinstance(obj.get("@context"), dict):
            context = context | obj["@context"]
        if "@id" in obj:
            s = full(obj["@id"], context)
        else:
            count += 1
            s = f"_:{blank}{count}"
        types = obj.get("@type", [])
        for t in types if isinstance(types, list) else [types]:
            out.append((s, "rdf:type", full(t, context)))
        for name, v in obj.items():
            if name == "@graph":
                for x in v:
                    node(x, context)
            elif not name.startswith("@"):
                known = context.get(name)
                for o in value(v, context, isinstance(known, dict) and known.get("@type") == "@id"):
                    out.append((s, full(name, context), o))
        return s

    data = json.loads(text)
    for obj in data if isinstance(data, list) else [data]:
        if set(obj) <= {"@context", "@graph"}:
            for x in obj.get("@graph", []):
                node(x, obj.get("@context") if isinstance(obj.get("@context"), dict) else {})
        else:
            node(obj, {})
    return out


PARSERS = {"turtle": parse_turtle, "xml": parse_xml, "json-ld": parse_jsonld}


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Triples of RDF files of one format, guessed from the path if not given; blank nodes are named by their file."""
    fmt = fmt or guess(path)
    if fmt == "nt":
        return read_nt(spark, path)
    if fmt not in PARSERS:
        raise ValueError(f"unknown format {fmt!r}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                yield pd.DataFrame(PARSERS[fmt](f.text, f"f{f.file}b"), columns=list(SPO))

    files = spark.read.format("binaryFile").load(path).select(F.hex(F.xxhash64("path")).alias("file"), F.col("content").cast("string").alias("text"))
    return files.mapInPandas(rows, "s string, p string, o string").distinct()


# writing


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """(value): one block for each subject; the first lines declare the prefixes."""
    short = lambda t: F.when(terms.is_iri(t) & F.rlike(t, F.lit(r"(?U)^[a-z]+:[\w][\w-]*$")), F.when(t == "rdf:type", F.lit("a")).otherwise(t)).otherwise(nt_term(t))
    name = lambda t: F.when(t == "rdf:type", F.lit("rdf:type")).otherwise(short(t))
    by_p = triples.groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list(name(F.col("o")))), ", ").alias("objects"))
    by_s = by_p.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(F.concat(short(F.col("p")), F.lit(" "), F.col("objects")))), " ;\n    ").alias("body"))
    head = "\n".join(f"@prefix {p}: <{b}> ." for p, b in PREFIXES.items())
    blocks = by_s.select(F.lit(1).alias("k"), "s", F.concat(name(F.col("s")), F.lit(" "), F.col("body"), F.lit(" .")).alias("value"))
    first = triples.sparkSession.createDataFrame([(0, "", head)], "k int, s string, value string")
    return first.unionByName(blocks).orderBy("k", "s").select("value")


def jsonld_nodes(triples: DataFrame) -> DataFrame:
    """(value): an expanded node object for each subject."""
    o = F.col("o")
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    name = lambda t: F.when(terms.is_blank(t), t).otherwise(terms.iri(t))
    literal = F.concat(F.lit('{"@value": '), quoted(terms.lexical(o)), F.when(terms.language(o) != "", F.concat(F.lit(', "@language": '), quoted(terms.language(o)))).when(terms.datatype(o) == "xsd:string", F.lit("")).otherwise(F.concat(F.lit(', "@type": '), quoted(terms.iri(terms.datatype(o))))), F.lit("}"))
    value = F.when(terms.is_literal(o), literal).otherwise(F.concat(F.lit('{"@id": '), quoted(name(o)), F.lit("}")))
    by_p = triples.groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list(value)), ", ").alias("values"))
    member = F.concat(quoted(terms.iri(F.col("p"))), F.lit(": ["), F.col("values"), F.lit("]"))
    by_s = by_p.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(member)), ", ").alias("body"))
    return by_s.select(F.concat(F.lit('{"@id": '), quoted(name(F.col("s"))), F.lit(", "), F.col("body"), F.lit("}")).alias("value"))


def xml_nodes(triples: DataFrame) -> DataFrame:
    """(value): an rdf:Description for each subject, to stand inside rdf:RDF; predicates need a local name."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    p, o = terms.iri(F.col("p")), F.col("o")
    local = F.regexp_extract(p, r"(?U)([A-Za-z_][\w.-]*)$", 1)
    space = F.substring(p, F.lit(1), F.length(p) - F.length(local))
    tag = F.concat(F.lit("p:"), F.when(local == "", F.raise_error(F.concat(F.lit("no XML name: "), p))).otherwise(local), F.lit(' xmlns:p="'), escaped(space), F.lit('"'))
    extra = F.when(terms.language(o) != "", F.concat(F.lit(' xml:lang="'), terms.language(o), F.lit('"'))).when(terms.datatype(o) == "xsd:string", F.lit("")).otherwise(F.concat(F.lit(' rdf:datatype="'), terms.iri(terms.datatype(o)), F.lit('"')))
    element = (
        F.when(terms.is_literal(o), F.concat(F.lit("<"), tag, extra, F.lit(">"), escaped(terms.lexical(o)), F.lit("</p:"), local, F.lit(">")))
        .when(terms.is_blank(o), F.concat(F.lit("<"), tag, F.lit(' rdf:nodeID="'), F.substring(o, 3, 2**30), F.lit('"/>')))
        .otherwise(F.concat(F.lit("<"), tag, F.lit(' rdf:resource="'), escaped(terms.iri(o)), F.lit('"/>')))
    )
    by_s = triples.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(element)), "").alias("body"))
    about = F.when(terms.is_blank(F.col("s")), F.concat(F.lit('rdf:nodeID="'), F.substring("s", 3, 2**30), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), escaped(terms.iri(F.col("s"))), F.lit('"')))
    return by_s.select(F.concat(F.lit("<rdf:Description "), about, F.lit(">"), F.col("body"), F.lit("</rdf:Description>")).alias("value"))


def text_of(triples: DataFrame, fmt: str) -> str:
    """A whole document, for graphs that are known to be small."""
    if fmt == "nt":
        return "".join(r["value"] + "\n" for r in nt_lines(triples).orderBy("value").collect())
    if fmt in ("turtle", "n3"):
        return "\n\n".join(r["value"] for r in turtle_blocks(triples).collect()) + "\n"
    if fmt == "json-ld":
        return "[" + ",\n ".join(r["value"] for r in jsonld_nodes(triples).orderBy("value").collect()) + "]\n"
    if fmt == "xml":
        body = "\n".join(r["value"] for r in xml_nodes(triples).orderBy("value").collect())
        return f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{_RDF}">\n{body}\n</rdf:RDF>\n'
    raise ValueError(f"unknown format {fmt!r}")


def write(triples: DataFrame, path: str, fmt: str | None = None, mode: str = "error", compression: str = "none") -> None:
    """Writes a folder of text files: N-Triples, Turtle blocks (one sorted file), or one JSON-LD or XML node a line.

    `compression` is one that Spark's text files have; a task later reads a compressed file whole.
    """
    fmt = fmt or guess(path)
    lines = {"nt": nt_lines, "turtle": turtle_blocks, "n3": turtle_blocks, "json-ld": jsonld_nodes, "xml": xml_nodes}[fmt](triples)
    (lines.coalesce(1) if fmt in ("turtle", "n3") else lines).write.mode(mode).text(path, compression=compression)


# As a data source: spark.read.format("turtle").load(path)


class _Whole(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class TurtleSource(DataSource):
    """Turtle files of a folder that every executor sees; register with spark.dataSource.register(TurtleSource)."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return "s string, p string, o string"

    def reader(self, schema):
        return _TurtleReader(self.options)


class _TurtleReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "")

    def partitions(self):
        from pathlib import Path as Files

        at = Files(re.sub(r"^file:(//)?", "", self.path))
        return [_Whole(str(f)) for f in (sorted(at.glob("**/*.ttl")) if at.is_dir() else [at])]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            yield from parse_turtle(f.read(), f"f{hashlib.blake2b(partition.path.encode(), digest_size=12).hexdigest()}b")
