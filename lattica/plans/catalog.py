"""The registered queries of the knowledge-graph operators, each with its oracle SQL where SQL can say it.

They run over whole tables of the star schema, seen as a graph (`triplify`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import code_facts, mutation, patches, terms, text
from lattica.operators import adjacency, audit, datasets, differences, graph, metrics, reason, store
from lattica.operators.components import components
from lattica.plans import csp, sizes, smt, sparql, sparql_syntax, triplify
from lattica.runtime import cut, release, shared_dir, spread
from lattica.sources import rdf
from lattica.plans.triplify import AUDIT_KB_SQL, AUDIT_SQL, EVENT_SQL, GRAPH_SQL, INJECTED_SQL, KB_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplify.triples(spark, sf_dir, KB_SQL)


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplify.triples(spark, sf_dir, GRAPH_SQL)


K, G = f"WITH kb AS ({KB_SQL})", f"WITH g AS ({GRAPH_SQL})"
GM = G.replace("g AS (", "g AS MATERIALIZED (", 1)
RK, RG = K.replace("WITH ", "WITH RECURSIVE ", 1), G.replace("WITH ", "WITH RECURSIVE ", 1)

# Claims and their verdicts; the flagship.

CLAIMS_SQL = """
    SELECT concat('ns:customer_', cast(c_custkey AS string)) AS s, 'ns:in_nation' AS p, concat('ns:nation_', cast(c_nationkey AS string)) AS o FROM customer
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'ns:in_nation', concat('ns:nation_', cast((c_nationkey + 7) % 25 AS string)) FROM customer
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'rdf:type', 'ns:Agent' FROM customer
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'ns:likes', 'ns:tea' FROM customer
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'owl:sameAs', concat('ns:customer_', cast(c_custkey + 1 AS string)) FROM customer
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string), '_alias'), 'rdf:type', 'ns:Party' FROM customer WHERE c_custkey % 17 = 0"""


@register(
    f"""{K}, claims AS ({CLAIMS_SQL}),
    canon AS (SELECT s, p, o, regexp_replace(s, '_alias$', '') AS r FROM claims)
    SELECT s, p, o, CASE
        WHEN p = 'owl:sameAs' THEN CASE WHEN EXISTS (SELECT 1 FROM kb k WHERE k.p = 'owl:differentFrom' AND k.s = r AND k.o = c.o) THEN 'contradicted' ELSE 'unknown' END
        WHEN p = 'rdf:type' THEN 'entailed'
        WHEN EXISTS (SELECT 1 FROM kb k WHERE k.s = r AND k.p = c.p AND k.o = c.o) THEN 'entailed'
        WHEN p = 'ns:in_nation' AND EXISTS (SELECT 1 FROM kb k WHERE k.s = r AND k.p = c.p) THEN 'contradicted'
        ELSE 'unknown' END AS verdict FROM canon c"""
)
def kb_verify_claims(spark, sf_dir):
    triples = kb(spark, sf_dir)
    return reason.verify(spark.sql(CLAIMS_SQL), reason.closure(triples, stored=True))


# Store.


@register(GRAPH_SQL)
def kb_triples(spark, sf_dir):
    return whole(spark, sf_dir)


@register(f"{G} SELECT count(*) AS triples, count(DISTINCT s) AS entities, count(DISTINCT p) AS predicates FROM g")
def kb_stats(spark, sf_dir):
    return store.stats(whole(spark, sf_dir))


@register(f"{G} SELECT p, count(*) AS n FROM g GROUP BY p")
def kb_predicate_counts(spark, sf_dir):
    return store.predicate_counts(whole(spark, sf_dir))


TEXTS_SQL = """
    SELECT c_name AS t FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT cast(c_acctbal AS string) FROM customer WHERE c_custkey < 0
    UNION ALL SELECT cast(o_orderkey AS string) FROM orders UNION ALL SELECT concat('ns:', c_mktsegment) FROM customer UNION ALL SELECT concat('"', n_name, '"') FROM nation
    UNION ALL SELECT concat('<http://example.org/ns#', r_name, '>') FROM region UNION ALL SELECT concat('bogus:', r_name) FROM region UNION ALL SELECT 'true' FROM region UNION ALL SELECT '007' FROM region UNION ALL SELECT ' ' FROM region"""
_PARSE = """CASE WHEN t = '' THEN NULL
    WHEN starts_with(t, '<') AND ends_with(t, '>') THEN CASE WHEN starts_with(t, '<http://example.org/ns#') THEN concat('ns:', substr(t, 24, length(t) - 24)) ELSE t END
    WHEN regexp_matches(t, '^".*"$') THEN t
    WHEN regexp_matches(t, '^-?[0-9]+$') THEN concat('"', cast(cast(t AS bigint) AS string), '"^^xsd:integer')
    WHEN lower(t) IN ('true', 'false') THEN concat('"', lower(t), '"^^xsd:boolean')
    WHEN regexp_matches(t, '^(ns|rdf|rdfs|owl|xsd):[A-Za-z0-9_.-]+$') THEN t
    WHEN regexp_matches(t, '^[A-Za-z0-9_.-]+$') THEN concat('ns:', t) END"""


@register(f"WITH texts AS ({TEXTS_SQL}) SELECT t AS text, {_PARSE} AS term FROM (SELECT trim(t) AS t FROM texts) x".replace("SELECT t AS text", "SELECT t AS text"))
def term_parse(spark, sf_dir):
    triplify.views(spark, sf_dir)
    trimmed = spark.sql(TEXTS_SQL).select(F.trim("t").alias("text"))
    return trimmed.select("text", terms.parsed(F.col("text"), as_object=True).alias("term"))


@register(f"{G} SELECT s, p, o, CASE WHEN starts_with(o, '\"') THEN regexp_replace(regexp_replace(o, '\"[^\"]*$', ''), '^\"', '') ELSE o END AS shown FROM g")
def term_format(spark, sf_dir):
    return whole(spark, sf_dir).select("s", "p", "o", terms.shown(F.col("o")).alias("shown"))


@register(
    f"""{G} SELECT 's' AS shape, s, p, o FROM g WHERE s = 'ns:customer_1' UNION ALL SELECT 'p', s, p, o FROM g WHERE p = 'ns:in_region'
    UNION ALL SELECT 'o', s, p, o FROM g WHERE o = 'ns:nation_3' UNION ALL SELECT 'po', s, p, o FROM g WHERE p = 'ns:size' AND o = '"7"^^xsd:integer'
    UNION ALL SELECT 'spo', s, p, o FROM g WHERE s = 'ns:nation_1' AND p = 'ns:in_region' AND o = 'ns:region_1'
    UNION ALL SELECT 'limit', s, p, o FROM (SELECT * FROM g WHERE p = 'ns:placed_by' ORDER BY s, p, o LIMIT 50) x"""
)
def kb_find_spo(spark, sf_dir):
    g = whole(spark, sf_dir)
    shapes = {"s": ("customer_1",), "p": (None, "in_region"), "o": (None, None, "nation_3"), "po": ("", "size", "7"), "spo": ("nation_1", "in_region", "region_1")}
    found = [store.find(g, *spo).select(F.lit(k).alias("shape"), "s", "p", "o") for k, spo in shapes.items()]
    found.append(store.find(g, p="placed_by", limit=50).select(F.lit("limit").alias("shape"), "s", "p", "o"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@register(f"{G} SELECT DISTINCT s, p, o FROM ({INJECTED_SQL} UNION ALL SELECT * FROM g) x WHERE (s, p, o) NOT IN (SELECT (s, p, o) FROM g)".replace("(s, p, o) NOT IN (SELECT (s, p, o) FROM g)", "NOT EXISTS (SELECT 1 FROM g k WHERE k.s = x.s AND k.p = x.p AND k.o = x.o)"))
def kb_add_dedupe(spark, sf_dir):
    triples = whole(spark, sf_dir)
    return store.add(triples, spark.sql(INJECTED_SQL).unionByName(triples))


@register(f"{G} SELECT s, p, o FROM g WHERE NOT (p = 'rdf:type' AND o = 'ns:Supplier') AND p <> 'owl:sameAs'")
def kb_remove(spark, sf_dir):
    triples = whole(spark, sf_dir)
    gone = triples.where((F.col("p") == "owl:sameAs") | ((F.col("p") == "rdf:type") & (F.col("o") == "ns:Supplier")))
    return store.remove(triples, gone.unionByName(spark.createDataFrame([("ns:no", "ns:such", "ns:triple")], "s string, p string, o string")))


@register(f"{G}, kb AS ({KB_SQL}) SELECT (SELECT count(*) FROM g) - (SELECT count(*) FROM kb) AS net_new, (SELECT count(*) FROM g) AS total")
def kb_merge_net_new(spark, sf_dir):
    triples, more = kb(spark, sf_dir), whole(spark, sf_dir)
    new = store.add(triples, more).agg(F.count(F.lit(1)).alias("net_new"))
    total = triples.unionByName(store.add(triples, more)).agg(F.count(F.lit(1)).alias("total"))
    return new.crossJoin(total)  # one row each


@register(f"WITH e(s, p, o, source, at_) AS ({EVENT_SQL}) SELECT s, p, o, count(*) AS n, string_agg(source, '; ' ORDER BY e.at_, source) AS sources FROM e GROUP BY s, p, o")
def kb_provenance(spark, sf_dir):
    triplify.views(spark, sf_dir)
    return store.provenance_index(spark.sql(EVENT_SQL))


@register(
    f"{G}, n AS (SELECT s AS name FROM g UNION SELECT o FROM g WHERE NOT starts_with(o, '\"')) SELECT lower(name) AS lower, string_agg(name, ',' ORDER BY name) AS names FROM n GROUP BY lower(name)"
)
def kb_case_variants(spark, sf_dir):
    return store.case_index(whole(spark, sf_dir)).select("lower", F.array_join("names", ",").alias("names"))


@register(f"{G}, u AS (SELECT s, p, o FROM g UNION SELECT s, p, o FROM ({INJECTED_SQL}) i) SELECT u.s, u.p, u.o, CASE WHEN EXISTS (SELECT 1 FROM g k WHERE k.s = u.s AND k.p = u.p AND k.o = u.o) THEN 'asserted' ELSE 'inferred' END AS origin FROM u")
def kb_origin(spark, sf_dir):
    triples = whole(spark, sf_dir)
    return store.with_origin(triples, spark.sql(INJECTED_SQL).distinct())


# SPARQL.

SPARQL: dict[str, tuple[str, str]] = {
    "sparql_bgp2": (
        "SELECT ?c ?r WHERE { ?c ns:in_nation ?n . ?n ns:in_region ?r }",
        f"{G} SELECT a.s AS c, b.o AS r FROM g a JOIN g b ON a.o = b.s WHERE a.p = 'ns:in_nation' AND b.p = 'ns:in_region'",
    ),
    "sparql_bgp4_star": (
        "SELECT ?o ?c ?s ?n WHERE { ?o ns:placed_by ?c ; ns:supplied_by ?s . ?c ns:in_nation ?n . ?s ns:in_nation ?n }",
        f"{GM}, a AS MATERIALIZED (SELECT s, o FROM g WHERE p = 'ns:placed_by'), b AS MATERIALIZED (SELECT s, o FROM g WHERE p = 'ns:supplied_by'), n AS MATERIALIZED (SELECT s, o FROM g WHERE p = 'ns:in_nation') SELECT a.s AS o, a.o AS c, b.o AS s, c.o AS n FROM a JOIN b ON a.s = b.s JOIN n c ON c.s = a.o JOIN n d ON d.s = b.o AND d.o = c.o",
    ),
    "sparql_filter": (
        "SELECT ?p ?z WHERE { ?p ns:size ?z . FILTER(?z > 28 && ?z * 2 <= 90 || ?z = 3) }",
        f"{G} SELECT s AS p, v AS z FROM (SELECT s, regexp_extract(o, '\"(.*)\"', 1) AS v FROM g WHERE p = 'ns:size') x WHERE cast(v AS int) > 28 AND cast(v AS int) * 2 <= 90 OR cast(v AS int) = 3",
    ),
    "sparql_optional": (
        "SELECT ?c ?a WHERE { ?c ns:in_nation ns:nation_3 . OPTIONAL { ?a owl:sameAs ?c } }",
        f"{G} SELECT a.s AS c, b.s AS a FROM g a LEFT JOIN g b ON b.p = 'owl:sameAs' AND b.o = a.s WHERE a.p = 'ns:in_nation' AND a.o = 'ns:nation_3'",
    ),
    "sparql_optional_filter": (
        "SELECT ?p ?z WHERE { ?p ns:brand ?b . OPTIONAL { ?p ns:size ?z FILTER(?z > 40) } }",
        f"{G} SELECT a.s AS p, regexp_extract(b.o, '\"(.*)\"', 1) AS z FROM g a LEFT JOIN g b ON b.p = 'ns:size' AND b.s = a.s AND cast(regexp_extract(b.o, '\"(.*)\"', 1) AS int) > 40 WHERE a.p = 'ns:brand'",
    ),
    "sparql_union": (
        "SELECT ?x WHERE { { ?x ns:in_nation ns:nation_1 } UNION { ?x ns:in_nation ns:nation_2 } UNION { ?x a ns:Supplier } }",
        f"{G} SELECT s AS x FROM g WHERE p = 'ns:in_nation' AND o IN ('ns:nation_1', 'ns:nation_2') UNION ALL SELECT s FROM g WHERE p = 'rdf:type' AND o = 'ns:Supplier'",
    ),
    "sparql_minus": (
        "SELECT ?c WHERE { ?c ns:in_nation ?n MINUS { ?a owl:sameAs ?c } MINUS { ?c a ns:Supplier } }",
        f"{G} SELECT s AS c FROM g WHERE p = 'ns:in_nation' AND s NOT IN (SELECT o FROM g WHERE p = 'owl:sameAs') AND s NOT IN (SELECT s FROM g WHERE o = 'ns:Supplier')",
    ),
    "sparql_not_exists": (
        "SELECT ?c WHERE { ?c a ns:Seg_BUILDING FILTER NOT EXISTS { ?o ns:placed_by ?c } }",
        f"{G} SELECT s AS c FROM g WHERE p = 'rdf:type' AND o = 'ns:Seg_BUILDING' AND s NOT IN (SELECT o FROM g WHERE p = 'ns:placed_by')",
    ),
    "sparql_exists_or": (
        "SELECT ?c WHERE { ?c ns:in_nation ?n FILTER(?n = ns:nation_4 || EXISTS { ?a owl:sameAs ?c }) }",
        f"{G} SELECT s AS c FROM g WHERE p = 'ns:in_nation' AND (o = 'ns:nation_4' OR s IN (SELECT o FROM g WHERE p = 'owl:sameAs'))",
    ),
    "sparql_values": (
        "SELECT ?c ?n WHERE { VALUES (?n ?k) { (ns:nation_5 UNDEF) (UNDEF ns:Seg_MACHINERY) } ?c ns:in_nation ?n ; a ?k . FILTER(?n != ns:nation_6) }",
        f"{G} SELECT a.s AS c, a.o AS n FROM g a JOIN g b ON a.s = b.s CROSS JOIN (VALUES ('ns:nation_5', NULL), (NULL, 'ns:Seg_MACHINERY')) v(n, k) WHERE a.p = 'ns:in_nation' AND b.p = 'rdf:type' AND (v.n IS NULL OR v.n = a.o) AND (v.k IS NULL OR v.k = b.o) AND a.o <> 'ns:nation_6'",
    ),
    "sparql_group_having": (
        "SELECT ?n (COUNT(?c) AS ?customers) (COUNT(DISTINCT ?k) AS ?kinds) (MIN(?c) AS ?first) WHERE { ?c ns:in_nation ?n ; a ?k } GROUP BY ?n HAVING(COUNT(*) > 5)",
        f"{G} SELECT a.o AS n, cast(count(*) AS string) AS customers, cast(count(DISTINCT b.o) AS string) AS kinds, min(a.s) AS first FROM g a JOIN g b ON a.s = b.s WHERE a.p = 'ns:in_nation' AND b.p = 'rdf:type' GROUP BY a.o HAVING count(*) > 5",
    ),
    "sparql_aggregates": (
        "SELECT ?b (SUM(?z) AS ?total) (MAX(?z) AS ?most) (SUM(DISTINCT ?z) AS ?different) WHERE { ?p ns:brand ?b ; ns:size ?z } GROUP BY ?b",
        f"{G}, x AS (SELECT regexp_extract(a.o, '\"(.*)\"', 1) AS b, cast(regexp_extract(z.o, '\"(.*)\"', 1) AS int) AS v FROM g a JOIN g z ON a.s = z.s WHERE a.p = 'ns:brand' AND z.p = 'ns:size') SELECT b, cast(sum(v) AS string) AS total, cast(max(v) AS string) AS most, cast(sum(DISTINCT v) AS string) AS different FROM x GROUP BY b",
    ),
    "sparql_order_limit": (
        "SELECT ?p ?z WHERE { ?p ns:size ?z } ORDER BY DESC(?z) ?p LIMIT 20 OFFSET 5",
        f"{G} SELECT s AS p, v AS z FROM (SELECT s, regexp_extract(o, '\"(.*)\"', 1) AS v FROM g WHERE p = 'ns:size') x ORDER BY cast(v AS int) DESC, s LIMIT 20 OFFSET 5",
    ),
    "sparql_distinct": ("SELECT DISTINCT ?p WHERE { ?s ?p ?o }", f"{G} SELECT DISTINCT p FROM g"),
    "sparql_subselect": (
        "SELECT ?c ?n WHERE { ?c ns:in_nation ?n . { SELECT ?n WHERE { ?s a ns:Supplier ; ns:in_nation ?n } GROUP BY ?n HAVING(COUNT(?s) > 1) } ?c a ns:Seg_BUILDING }",
        f"{G} SELECT a.s AS c, a.o AS n FROM g a JOIN g k ON k.s = a.s AND k.o = 'ns:Seg_BUILDING' WHERE a.p = 'ns:in_nation' AND a.o IN (SELECT x.o FROM g x JOIN g y ON x.s = y.s WHERE x.p = 'ns:in_nation' AND y.o = 'ns:Supplier' GROUP BY x.o HAVING count(*) > 1)",
    ),
    "sparql_ask": ("ASK { ?o ns:placed_by ?c . ?c ns:in_nation ns:nation_0 }", f"{G} SELECT count(*) > 0 AS ask FROM g a JOIN g b ON a.o = b.s WHERE a.p = 'ns:placed_by' AND b.p = 'ns:in_nation' AND b.o = 'ns:nation_0'"),
    "sparql_var_predicate": (
        "SELECT ?s ?p ?n WHERE { ?p a owl:FunctionalProperty . ?s ?p ?n . ?s a ns:Supplier }",
        f"{GM}, f AS MATERIALIZED (SELECT s FROM g WHERE p = 'rdf:type' AND o = 'owl:FunctionalProperty'), t AS MATERIALIZED (SELECT s FROM g WHERE p = 'rdf:type' AND o = 'ns:Supplier') SELECT g.s, g.p, g.o AS n FROM g JOIN f ON f.s = g.p JOIN t ON t.s = g.s",
    ),
    "sparql_functions": (
        'SELECT ?p (UCASE(?b) AS ?up) (STRLEN(?b) AS ?n) (IF(CONTAINS(?b, "1"), "one", "none") AS ?has) (STRAFTER(?b, "#") AS ?rest) WHERE { ?p ns:brand ?b . FILTER(REGEX(?b, "#[1-3]")) BIND(SUBSTR(?b, 1, 5) AS ?head) FILTER(?head = "Brand") }',
        f"{G} SELECT s AS p, upper(b) AS up, cast(length(b) AS string) AS n, CASE WHEN contains(b, '1') THEN 'one' ELSE 'none' END AS has, CASE WHEN contains(b, '#') THEN substr(b, strpos(b, '#') + 1) ELSE '' END AS rest FROM (SELECT s, regexp_extract(o, '\"(.*)\"', 1) AS b FROM g WHERE p = 'ns:brand') x WHERE regexp_matches(b, '#[1-3]') AND substr(b, 1, 5) = 'Brand'",
    ),
    "path_plus": ("SELECT ?c ?d WHERE { ?c rdfs:subClassOf+ ?d }", f"{RG}, r(c, d) AS (SELECT s, o FROM g WHERE p = 'rdfs:subClassOf' UNION SELECT r.c, g.o FROM r JOIN g ON r.d = g.s AND g.p = 'rdfs:subClassOf') SELECT c, d FROM r"),
    "path_star": ("SELECT ?x WHERE { ns:Seg_BUILDING rdfs:subClassOf* ?x }", f"{RG}, r(x) AS (SELECT 'ns:Seg_BUILDING' UNION SELECT g.o FROM r JOIN g ON r.x = g.s AND g.p = 'rdfs:subClassOf') SELECT x FROM r"),
    "path_alt": ("SELECT ?x ?y WHERE { ?x (ns:in_nation|ns:in_region) ?y }", f"{G} SELECT s AS x, o AS y FROM g WHERE p IN ('ns:in_nation', 'ns:in_region')"),
    "path_inverse_seq": (
        "SELECT DISTINCT ?a ?b WHERE { ?a ns:in_nation/^ns:in_nation ?b . ?a a ns:Supplier . ?b a ns:Supplier }",
        f"{G} SELECT DISTINCT a.s AS a, b.s AS b FROM g a JOIN g b ON a.o = b.o AND a.p = 'ns:in_nation' AND b.p = 'ns:in_nation' JOIN g x ON x.s = a.s AND x.o = 'ns:Supplier' JOIN g y ON y.s = b.s AND y.o = 'ns:Supplier'",
    ),
    "path_negated": ("SELECT ?x ?y WHERE { ?x !(ns:placed_by|ns:contains|ns:supplied_by|ns:size|ns:brand|^rdf:type) ?y }", f"{G} SELECT s AS x, o AS y FROM g WHERE p NOT IN ('ns:placed_by', 'ns:contains', 'ns:supplied_by', 'ns:size', 'ns:brand') UNION ALL SELECT o, s FROM g WHERE p <> 'rdf:type'".replace("UNION ALL SELECT o, s FROM g WHERE p <> 'rdf:type'", "UNION ALL SELECT CASE WHEN starts_with(o, '\"') THEN regexp_replace(regexp_replace(o, '\"[^\"]*$', ''), '^\"', '') ELSE o END, s FROM g WHERE p <> 'rdf:type'")),
}


def _sparql(name: str, query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sparql.select(whole(spark, sf_dir), query)

    run.__name__ = name
    return run


for _name, (_query, _sql) in SPARQL.items():
    register(_sql)(_sparql(_name, _query))

# Paths and neighbourhoods.

_HOPS = f"""{G},
    h1 AS (SELECT DISTINCT s AS e FROM g WHERE p = 'ns:in_nation' AND o = 'ns:nation_3' UNION SELECT o FROM g WHERE p = 'ns:in_nation' AND s = 'ns:nation_3'),
    h2 AS (SELECT s AS e FROM g JOIN h1 ON o = e WHERE p = 'ns:placed_by' UNION SELECT o FROM g JOIN h1 ON s = e WHERE p = 'ns:placed_by'),
    h3 AS (SELECT s AS e FROM g JOIN h2 ON o = e WHERE p = 'ns:contains' UNION SELECT o FROM g JOIN h2 ON s = e WHERE p = 'ns:contains')"""
CHAIN = ["in_nation", "placed_by", "contains"]


SIZED = {
    "star": "{ ?o ns:contains ?x . ?o ns:supplied_by ?y . ?o ns:placed_by ?c }",
    "chain": "{ ?o ns:contains ?x . ?o ns:placed_by ?c . ?c ns:in_nation ?n . ?n ns:in_region ?r . ?c2 ns:in_nation ?n }",
    "product": "{ ?a ?p1 ?x . ?y ?p2 ?b . ?z ?p3 ?c }",
    "shared predicate": "{ ?a ?p ?x . ?b ?p ?y }",
    "none": "{ ?a ns:no_such ?x . ?y ?p ?b }",
}


@register(
    f"""{GM}, c AS (SELECT s, o FROM g WHERE p = 'ns:contains'), u AS (SELECT s, o FROM g WHERE p = 'ns:supplied_by'), b AS (SELECT s, o FROM g WHERE p = 'ns:placed_by'), n AS (SELECT s, o FROM g WHERE p = 'ns:in_nation'), r AS (SELECT s, o FROM g WHERE p = 'ns:in_region')
    SELECT 'star' AS name, (SELECT count(*) FROM c JOIN u ON c.s = u.s JOIN b ON b.s = c.s) AS size
    UNION ALL SELECT 'chain', (SELECT count(*) FROM c JOIN b ON b.s = c.s JOIN n ON n.s = b.o JOIN r ON r.s = n.o JOIN n n2 ON n2.o = n.o)
    UNION ALL SELECT 'product', (SELECT count(*) FROM g) * (SELECT count(*) FROM g) * (SELECT count(*) FROM g)
    UNION ALL SELECT 'shared predicate', (SELECT cast(sum(n * n) AS BIGINT) FROM (SELECT count(*) AS n FROM g GROUP BY p) x)
    UNION ALL SELECT 'none', 0"""
)
def sparql_sizes(spark, sf_dir):
    planner, known, found = sparql.Planner(whole(spark, sf_dir)), {}, []
    for name, where in SIZED.items():
        found.append((name, sizes.pattern_size(planner, sparql_syntax.parse(f"SELECT * WHERE {where}").where.elements[0].patterns, known)))
        release(spark)
    # A row for each query asked about; wider than SQL's integers only where a size is, and where the SQL fails for that.
    if all(n < 2**63 for _, n in found):
        return spark.createDataFrame(found, "name string, size long")
    return spark.createDataFrame([(name, Decimal(n)) for name, n in found], f"name string, size {sizes.WIDE}")


@register(f"{_HOPS} SELECT e AS entity FROM h3 ORDER BY e LIMIT 100")
def kb_path_terminals(spark, sf_dir):
    return graph.traverse(whole(spark, sf_dir), "nation_3", CHAIN).terminals


@register(
    f"""{_HOPS}, e AS (
      SELECT 1 AS hop, 'ns:nation_3' AS entity, s, p, o, 'inverse' AS direction FROM g WHERE p = 'ns:in_nation' AND o = 'ns:nation_3'
      UNION ALL SELECT 2, e, s, p, o, 'forward' FROM g JOIN h1 ON s = e WHERE p = 'ns:placed_by' UNION ALL SELECT 2, e, s, p, o, 'inverse' FROM g JOIN h1 ON o = e WHERE p = 'ns:placed_by'
      UNION ALL SELECT 3, e, s, p, o, 'forward' FROM g JOIN h2 ON s = e WHERE p = 'ns:contains' UNION ALL SELECT 3, e, s, p, o, 'inverse' FROM g JOIN h2 ON o = e WHERE p = 'ns:contains'),
    r AS (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY entity, s, o, direction) AS rank FROM e)
    SELECT hop, rank, s, p, o, direction FROM r WHERE rank <= 200"""
)
def kb_path_edges(spark, sf_dir):
    return graph.traverse(whole(spark, sf_dir), "nation_3", CHAIN).edges


@register(
    f"""{_HOPS} SELECT 1 AS hop, (SELECT count(*) FROM h1) AS size, (SELECT count(*) FROM g WHERE p = 'ns:in_nation' AND o = 'ns:nation_3') AS edges
    UNION ALL SELECT 2, (SELECT count(*) FROM h2), (SELECT count(*) FROM g JOIN h1 ON s = e OR o = e WHERE p = 'ns:placed_by')
    UNION ALL SELECT 3, (SELECT count(*) FROM h3), (SELECT count(*) FROM g JOIN h2 ON s = e WHERE p = 'ns:contains')"""
)
def kb_path_frontiers(spark, sf_dir):
    return graph.traverse(whole(spark, sf_dir), "nation_3", CHAIN).frontiers


@register(f"{G}, h AS (SELECT s AS e FROM g WHERE p = 'ns:in_region' AND o = 'ns:region_2') SELECT DISTINCT s AS entity FROM g JOIN h ON o = e WHERE p = 'ns:in_nation' ORDER BY 1 LIMIT 100")
def kb_path_inverse_only(spark, sf_dir):
    return graph.traverse(whole(spark, sf_dir), "region_2", ["^in_region", "^in_nation"]).terminals


@register(f"{G} SELECT b.s AS entity, 'ns:nation_3' AS excluded FROM g a JOIN g b ON a.o = b.o AND b.p = 'ns:in_region' WHERE a.p = 'ns:in_region' AND a.s = 'ns:nation_3' AND b.s <> 'ns:nation_3'")
def kb_path_excluded(spark, sf_dir):
    r = graph.traverse(whole(spark, sf_dir), "nation_3", ["in_region", "in_region"])
    return r.terminals.select("entity", F.lit(",".join(r.excluded)).alias("excluded"))


@register(
    f"""{GM}, a AS (SELECT c.o AS part, c.s AS ord FROM g c WHERE c.p = 'ns:contains')
    SELECT n.o AS entity, count(*) AS paths FROM a JOIN g b ON b.s = a.ord AND b.p = 'ns:placed_by' JOIN g n ON n.s = b.o AND n.p = 'ns:in_nation' WHERE a.part IN (SELECT s FROM g WHERE p = 'ns:brand') GROUP BY n.o"""
)
def adjacency_walk(spark, sf_dir):
    g = whole(spark, sf_dir)
    found = adjacency.index(g)
    return adjacency.walk(found, g.where(F.col("p") == "ns:brand").select(F.col("s").alias("entity")), [("ns:contains", True), ("ns:placed_by", False), ("ns:in_nation", False)])


_LAYERS = f"""WITH kb AS MATERIALIZED ({GRAPH_SQL}),
    e0 AS (SELECT 'ns:region_1' AS e, 0 AS d),
    e1 AS (SELECT e, min(d) AS d FROM (SELECT * FROM e0 UNION ALL SELECT o, 1 FROM kb JOIN e0 ON s = e UNION ALL SELECT s, 1 FROM kb JOIN e0 ON o = e) x GROUP BY e),
    near AS (SELECT s, p, o, min(d) + 1 AS layer FROM (SELECT s, p, o, d FROM kb JOIN e1 ON s = e UNION ALL SELECT s, p, o, d FROM kb JOIN e1 ON o = e) x GROUP BY s, p, o)"""


@register(f"{_LAYERS} SELECT s, p, o, layer FROM near")
def bfs_neighborhood(spark, sf_dir):
    return graph.layers(whole(spark, sf_dir), "ns:region_1", 2)


@register(f"{_LAYERS} SELECT s, p, o FROM near WHERE layer = 1 ORDER BY s, p, o LIMIT 4")
def bfs_neighborhood_capped(spark, sf_dir):
    rows, _ = graph.neighbourhood(whole(spark, sf_dir), "ns:region_1", 2, 4)
    return rows.select("s", "p", "o")


# Reasoning.

_TYPES = f"{RK}, sub(c, d) AS (SELECT s, o FROM kb WHERE p = 'rdfs:subClassOf' UNION SELECT sub.c, kb.o FROM sub JOIN kb ON sub.d = kb.s AND kb.p = 'rdfs:subClassOf')"


def _entailed(spark: SparkSession, sf_dir: str, extra: list[tuple[str, str, str]], keep) -> DataFrame:
    triples = kb(spark, sf_dir).where(~F.col("p").isin("owl:sameAs", "owl:differentFrom"))
    more = spark.createDataFrame(extra, "s string, p string, o string") if extra else triples.limit(0)
    return reason.closure(triples.unionByName(more), stored=True).triples.where(keep)


@register(f"{_TYPES} SELECT c AS s, d AS o FROM sub")
def rdfs_subclass_closure(spark, sf_dir):
    return _entailed(spark, sf_dir, [], F.col("p") == "rdfs:subClassOf").select("s", "o")


@register(f"{_TYPES} SELECT DISTINCT s, o FROM (SELECT s, o FROM kb WHERE p = 'rdf:type' UNION SELECT kb.s, sub.d FROM kb JOIN sub ON kb.o = sub.c WHERE kb.p = 'rdf:type') x")
def rdfs_type_closure(spark, sf_dir):
    return _entailed(spark, sf_dir, [], F.col("p") == "rdf:type").select("s", "o")


@register(f"{K} SELECT DISTINCT s, 'ns:Located' AS o FROM kb WHERE p = 'ns:in_nation' UNION SELECT DISTINCT o, 'ns:Nation' FROM kb WHERE p = 'ns:in_nation'")
def domain_range(spark, sf_dir):
    extra = [("ns:in_nation", "rdfs:domain", "ns:Located"), ("ns:in_nation", "rdfs:range", "ns:Nation")]
    return _entailed(spark, sf_dir, extra, (F.col("p") == "rdf:type") & F.col("o").isin("ns:Located", "ns:Nation")).select("s", "o")


@register(f"{K} SELECT o AS s, s AS o FROM kb WHERE p = 'ns:in_nation'")
def inverse(spark, sf_dir):
    return _entailed(spark, sf_dir, [("ns:in_nation", "owl:inverseOf", "ns:nation_of")], F.col("p") == "ns:nation_of").select("s", "o")


@register(f"{K} SELECT s, o FROM kb WHERE p = 'ns:in_region' UNION SELECT o, s FROM kb WHERE p = 'ns:in_region'")
def symmetric(spark, sf_dir):
    extra = [("ns:in_region", "rdfs:subPropertyOf", "ns:touches"), ("ns:touches", "rdf:type", "owl:SymmetricProperty")]
    return _entailed(spark, sf_dir, extra, F.col("p") == "ns:touches").select("s", "o")


@register(f"{K} SELECT s, o FROM kb WHERE p IN ('ns:in_nation', 'ns:in_region') UNION SELECT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = 'ns:in_nation' AND b.p = 'ns:in_region'")
def transitive_subproperty(spark, sf_dir):
    return _entailed(spark, sf_dir, [], F.col("p") == "ns:located_in").select("s", "o")


_SAME = f"""{RK}, e(a, b) AS (SELECT s, o FROM kb WHERE p = 'owl:sameAs' UNION SELECT o, s FROM kb WHERE p = 'owl:sameAs'),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


@register(f"{_SAME} SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a")
def sameas_components(spark, sf_dir):
    same = kb(spark, sf_dir).where(F.col("p") == "owl:sameAs")
    return components(same.select(F.col("s").alias("a"), F.col("o").alias("b")))


@register(
    f"""{K}, alias AS (SELECT s AS a, o AS b FROM kb WHERE p = 'owl:sameAs'), plain AS (SELECT * FROM kb WHERE p <> 'owl:sameAs'),
    names(n, m) AS (SELECT a, b FROM alias UNION SELECT b, a FROM alias)
    SELECT s, p, o FROM plain UNION SELECT n, p, o FROM plain JOIN names ON s = m UNION SELECT s, p, n FROM plain JOIN names ON o = m
    UNION SELECT x.n, p, y.n FROM plain JOIN names x ON s = x.m JOIN names y ON o = y.m UNION SELECT n, 'owl:sameAs', m FROM names"""
)
def sameas_expand(spark, sf_dir):
    return reason.closure(kb(spark, sf_dir), rules=(), stored=True).expanded().select("s", "p", "o")


@register(
    f"""{_TYPES}, alias AS (SELECT s AS a, o AS b FROM kb WHERE p = 'owl:sameAs'), names(n, m) AS (SELECT a, b FROM alias UNION SELECT b, a FROM alias),
    loc AS (SELECT s, o FROM kb WHERE p IN ('ns:in_nation', 'ns:in_region') UNION SELECT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = 'ns:in_nation' AND b.p = 'ns:in_region'),
    base AS (SELECT s, p, o FROM kb WHERE p <> 'owl:sameAs' UNION SELECT kb.s, 'rdf:type', sub.d FROM kb JOIN sub ON kb.o = sub.c WHERE kb.p = 'rdf:type' UNION SELECT c, 'rdfs:subClassOf', d FROM sub UNION SELECT s, 'ns:located_in', o FROM loc),
    full_ AS (SELECT s, p, o FROM base UNION SELECT n, p, o FROM base JOIN names ON s = m UNION SELECT s, p, n FROM base JOIN names ON o = m UNION SELECT x.n, p, y.n FROM base JOIN names x ON s = x.m JOIN names y ON o = y.m UNION SELECT n, 'owl:sameAs', m FROM names)
    SELECT p, count(*) AS n FROM full_ f WHERE NOT EXISTS (SELECT 1 FROM kb WHERE kb.s = f.s AND kb.p = f.p AND kb.o = f.o) GROUP BY p"""
)
def owl_infer_counts(spark, sf_dir):
    triples = kb(spark, sf_dir)
    return store.predicate_counts(reason.inferred(triples, reason.closure(triples, stored=True)))


# A tenth of the facts, an edge of the schema and half of the aliases go, an edge of the schema comes.
_GONE = """
    SELECT concat('ns:customer_', cast(c_custkey AS string)) AS s, 'ns:in_nation' AS p, concat('ns:nation_', cast(c_nationkey AS string)) AS o FROM customer WHERE c_custkey % 10 = 3
    UNION ALL SELECT concat('ns:order_', cast(o_orderkey AS string)), 'ns:placed_by', concat('ns:customer_', cast(o_custkey AS string)) FROM orders WHERE o_orderkey % 10 = 3
    UNION ALL SELECT concat('ns:order_', cast(l_orderkey AS string)), 'ns:contains', concat('ns:part_', cast(l_partkey AS string)) FROM lineitem WHERE l_orderkey % 10 = 3
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string), '_alias'), 'owl:sameAs', concat('ns:customer_', cast(c_custkey AS string)) FROM customer WHERE c_custkey % 34 = 0
    UNION ALL SELECT 'ns:Customer', 'rdfs:subClassOf', 'ns:Party'"""
_CHANGED = f"""WITH RECURSIVE g AS MATERIALIZED ({GRAPH_SQL}), gone AS MATERIALIZED ({_GONE}),
    kb AS MATERIALIZED (SELECT s, p, o FROM g WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.s = g.s AND x.p = g.p AND x.o = g.o) UNION SELECT 'ns:Supplier', 'rdfs:subClassOf', 'ns:Vendor'),
    sub(c, d) AS (SELECT s, o FROM kb WHERE p = 'rdfs:subClassOf' UNION SELECT sub.c, kb.o FROM sub JOIN kb ON sub.d = kb.s AND kb.p = 'rdfs:subClassOf')"""


@register(
    f"""{_CHANGED}, alias AS (SELECT s AS a, o AS b FROM kb WHERE p = 'owl:sameAs'), names(n, m) AS (SELECT a, b FROM alias UNION SELECT b, a FROM alias),
    loc AS (SELECT s, o FROM kb WHERE p IN ('ns:in_nation', 'ns:in_region') UNION SELECT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = 'ns:in_nation' AND b.p = 'ns:in_region'),
    base AS (SELECT s, p, o FROM kb WHERE p <> 'owl:sameAs' UNION SELECT kb.s, 'rdf:type', sub.d FROM kb JOIN sub ON kb.o = sub.c WHERE kb.p = 'rdf:type' UNION SELECT c, 'rdfs:subClassOf', d FROM sub UNION SELECT s, 'ns:located_in', o FROM loc)
    SELECT s, p, o FROM base UNION SELECT n, p, o FROM base JOIN names ON s = m UNION SELECT s, p, n FROM base JOIN names ON o = m
    UNION SELECT x.n, p, y.n FROM base JOIN names x ON s = x.m JOIN names y ON o = y.m UNION SELECT n, 'owl:sameAs', m FROM names"""
)
def closure_after_changes(spark, sf_dir):
    triples = whole(spark, sf_dir)
    more = spark.createDataFrame([("ns:Supplier", "rdfs:subClassOf", "ns:Vendor")], "s string, p string, o string")
    _, after = reason.changed(triples, reason.closure(triples, stored=True), spark.sql(_GONE), more)
    return after.expanded()


# Audits and the answer gate.

_AUDIT = f"WITH a AS ({AUDIT_SQL}), f AS (SELECT s AS p FROM a WHERE p = 'rdf:type' AND o = 'owl:FunctionalProperty'), v AS (SELECT s, a.p, count(*) AS n, string_agg(o, ',' ORDER BY o) AS objects FROM a JOIN f ON a.p = f.p GROUP BY s, a.p HAVING count(DISTINCT o) > 1)"


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplify.triples(spark, sf_dir, AUDIT_SQL)


@register(f"{_AUDIT} SELECT s, p, n, objects FROM v")
def functional_violations(spark, sf_dir):
    return audit.violations(_audited(spark, sf_dir)).select("s", "p", "n", F.array_join("objects", ",").alias("objects"))


@register(f"{_AUDIT}, i AS ({INJECTED_SQL}) SELECT a.s, a.p, a.o, CASE WHEN i.s IS NOT NULL THEN 'injected' END AS source FROM v JOIN a ON a.s = v.s AND a.p = v.p LEFT JOIN i ON i.s = a.s AND i.p = a.p AND i.o = a.o")
def functional_violations_with_provenance(spark, sf_dir):
    triples = _audited(spark, sf_dir)
    log = spark.sql(INJECTED_SQL).select("s", "p", "o", F.lit("injected").alias("source"), F.lit("2024-01-01").alias("at"))
    return audit.violations_with_sources(triples, log).select("s", "p", "o", "source")


@register(f"{_AUDIT.replace(AUDIT_SQL, AUDIT_KB_SQL)} SELECT s, p, n, objects FROM v")
def functional_violations_after_infer(spark, sf_dir):
    state = store.Graph(triplify.triples(spark, sf_dir, AUDIT_KB_SQL), store.Graph.empty(spark).provenance)
    closed = reason.closure(state.triples, stored=True)
    state = store.Graph(state.triples, state.provenance, reason.inferred(state.triples, closed))
    return audit.violations(state.triples).select("s", "p", "n", F.array_join("objects", ",").alias("objects"))


@register(
    f"{G}, same AS (SELECT concat('ns:customer_', cast(c_custkey AS string)) AS s, concat('ns:customer_', cast(c_custkey + 1 AS string)) AS o FROM customer WHERE c_custkey % 38 = 0) SELECT least(s, o) AS a, greatest(s, o) AS b FROM same WHERE EXISTS (SELECT 1 FROM g WHERE g.p = 'owl:differentFrom' AND g.s = same.s AND g.o = same.o)"
)
def identity_conflicts(spark, sf_dir):
    triples = whole(spark, sf_dir)
    same = spark.sql("SELECT concat('ns:customer_', cast(c_custkey + 1 AS string)) AS s, 'owl:sameAs' AS p, concat('ns:customer_', cast(c_custkey AS string)) AS o FROM customer WHERE c_custkey % 38 = 0")
    return audit.identity_conflicts(triples.unionByName(same))


ANSWERS_SQL = """
    SELECT cast(c_custkey AS bigint) AS id, concat('ns:nation_', cast(c_nationkey AS string)) AS answer, concat('ns:customer_', cast(c_custkey AS string)) AS start, 'ns:in_nation' AS relation FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, concat('ns:region_', cast(c_nationkey % 5 AS string)), concat('ns:customer_', cast(c_custkey AS string)), 'ns:in_region' FROM customer WHERE c_custkey % 4 = 1
    UNION ALL SELECT c_custkey, concat('ns:NATION_', cast(c_nationkey AS string)), NULL, 'ns:in_nation' FROM customer WHERE c_custkey % 4 = 2
    UNION ALL SELECT c_custkey, concat('ns:customer_', cast(c_custkey AS string)), concat('ns:customer_', cast(c_custkey AS string)), 'ns:in_region' FROM customer WHERE c_custkey % 4 = 3"""


@register(
    f"""WITH kb AS MATERIALIZED ({GRAPH_SQL}), q AS ({ANSWERS_SQL}),
    c AS (SELECT id, CASE WHEN EXISTS (SELECT 1 FROM kb WHERE kb.s = answer OR kb.o = answer) THEN 'pass' ELSE 'reject' END AS existence,
        EXISTS (SELECT 1 FROM kb WHERE kb.p = relation AND (kb.o = answer OR kb.s = answer)) AS typed,
        CASE WHEN start IS NULL THEN 'skipped' WHEN start = answer OR EXISTS (SELECT 1 FROM kb WHERE kb.s = start AND kb.o = answer OR kb.s = answer AND kb.o = start) THEN 'warn' ELSE 'pass' END AS start_exclusion,
        (SELECT min(n) FROM (SELECT s AS n FROM kb UNION SELECT o FROM kb WHERE NOT starts_with(o, '"')) x WHERE lower(n) = lower(answer)) AS variant FROM q)
    SELECT id, existence, CASE WHEN existence = 'reject' THEN 'skipped' WHEN typed THEN 'pass' ELSE 'warn' END AS type, start_exclusion,
        CASE WHEN existence = 'reject' THEN variant END AS hint,
        CASE WHEN existence = 'reject' THEN 'reject' WHEN NOT typed OR start_exclusion = 'warn' THEN 'warn' ELSE 'pass' END AS verdict FROM c"""
)
def check_answer(spark, sf_dir):
    return audit.check_answers(whole(spark, sf_dir), spark.sql(ANSWERS_SQL)).select("id", "existence", "type", "start_exclusion", "hint", "verdict")


# Solvers.


_PLACES_SQL = "SELECT DISTINCT l_orderkey AS id, cast(l_quantity AS bigint) AS q FROM lineitem"


def _places(spark: SparkSession, sf_dir: str, variables: str) -> DataFrame:
    """An order's quantities as the domain of each variable; a quantity that comes again counts once there."""
    places = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("bigint").alias("q"))
    return places.select("id", F.explode(F.array(*map(F.lit, variables))).alias("variable"), F.col("q").alias("value"))


@register(f"WITH d AS ({_PLACES_SQL}) SELECT x.id, x.q AS a, y.q AS b, z.q AS c FROM d x JOIN d y USING (id) JOIN d z USING (id) WHERE x.q + 2 <= y.q AND y.q < z.q AND (z.q - x.q) % 3 = 0 AND abs(y.q - z.q) <> 2")
def csp_schedule(spark, sf_dir):
    return csp.solutions_of_each(_places(spark, sf_dir, "abc"), "id", "abc", ["a + 2 <= b", "b < c", "(c - a) % 3 == 0", "abs(b - c) != 2"])


@register(f"WITH d AS ({_PLACES_SQL}) SELECT w.id, w.q AS w, x.q AS x, y.q AS y, z.q AS z FROM d w JOIN d x USING (id) JOIN d y USING (id) JOIN d z USING (id) WHERE w.q <> x.q AND w.q <> y.q AND w.q <> z.q AND x.q <> y.q AND x.q <> z.q AND y.q <> z.q AND greatest(w.q, x.q) < least(y.q, z.q)")
def csp_all_different(spark, sf_dir):
    return csp.solutions_of_each(_places(spark, sf_dir, "wxyz"), "id", "wxyz", ["max(w, x) < min(y, z)"], all_different=["wxyz"])


@register(f"WITH d AS ({_PLACES_SQL}) SELECT DISTINCT id FROM d WHERE id NOT IN (SELECT x.id FROM d x JOIN d y USING (id) WHERE x.q >= 2 * y.q)")
def csp_unsat(spark, sf_dir):
    places = _places(spark, sf_dir, "xy")
    return places.select("id").distinct().join(csp.solutions_of_each(places, "id", "xy", ["x >= 2 * y"]), "id", "left_anti")


@register(f"WITH d AS ({_PLACES_SQL}) SELECT x.id, count(*) AS count FROM d x JOIN d y USING (id) JOIN d z USING (id) WHERE x.q + y.q >= z.q AND x.q < y.q GROUP BY x.id")
def csp_count(spark, sf_dir):
    found = csp.solutions_of_each(_places(spark, sf_dir, "xyz"), "id", "xyz", ["x + y >= z", "x < y"])
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("count"))


#: Problems of a task: some seconds of work; a file of few row groups would keep few tasks busy.
SMT_ROWS = 20_000


@register(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'proved' WHEN o_orderkey % 3 = 1 THEN 'refuted' ELSE 'inconsistent' END AS verdict FROM orders"
)
def smt_batch(spark, sf_dir):
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), SMT_ROWS)
    key = F.col("o_orderkey")
    k = key.cast("string")
    given = F.when(key % 3 == 2, F.array(F.concat(F.lit("x > "), k), F.concat(F.lit("x < "), k))).otherwise(F.array(F.concat(F.lit("x > "), k), F.lit("y == 2*x")))
    goal = F.when(key % 3 == 0, F.concat(F.lit("y > 2*"), k)).when(key % 3 == 1, F.concat(F.lit("x > 1 + "), k))
    problems = orders.select(key.alias("id"), F.create_map(F.lit("x"), F.lit("int"), F.lit("y"), F.lit("int")).alias("variables"), given.alias("assumptions"), goal.alias("goal"))
    return smt.check_all(problems).select("id", "verdict")


# Datasets.


@register(f"{G} SELECT a.s AS start, c.o AS \"end\" FROM g a JOIN g b ON a.o = b.s JOIN g c ON b.o = c.s WHERE a.p = 'ns:placed_by' AND b.p = 'ns:in_nation' AND c.p = 'ns:in_region'")
def qa_gold_walk(spark, sf_dir):
    g = whole(spark, sf_dir)
    starts = g.where(F.col("p") == "ns:placed_by").select(F.col("s").alias("entity"))
    return graph.functional_walk(g, starts, ["ns:placed_by", "ns:in_nation", "ns:in_region"])


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("id"))


@register("SELECT concat('ns:person_', cast(c_custkey AS string)) AS s, concat('ns:person_', cast(c_custkey - 1 AS string)) AS o FROM customer WHERE c_custkey % 5 <> 0")
def kbgen_chain(spark, sf_dir):
    return datasets.world(spark, _people(spark, sf_dir), seed=7).where(F.col("p") == "ns:reports_to").select("s", "o")


@register("SELECT label, kind_known AS fine, n FROM (VALUES ('entailed', true, 40), ('contradicted', true, 40), ('unknown', true, 40)) t(label, kind_known, n)")
def kbgen_claims(spark, sf_dir):
    w = datasets.world(spark, _people(spark, sf_dir), seed=3)
    closed = reason.closure(w)
    claims = datasets.sample_claims(w, closed, 40, seed=3)
    again = reason.verify(claims, closed)
    return again.groupBy("label").agg(F.bool_and(F.col("label") == F.col("verdict")).alias("fine"), F.count(F.lit(1)).cast("int").alias("n"))


@register(f"{G}, v AS (SELECT s, p, min(o) AS o FROM g WHERE p IN ('ns:in_nation', 'ns:in_region') GROUP BY s, p) SELECT 25 AS injected, 25 AS conflicts, true AS other_values FROM v LIMIT 1")
def inject_contradictions(spark, sf_dir):
    triples = cut(whole(spark, sf_dir))
    new = datasets.injected(triples, 25, seed=1)
    found = audit.violations(triples.unionByName(new))
    return new.agg(F.count(F.lit(1)).cast("int").alias("injected")).crossJoin(found.agg(F.count(F.lit(1)).cast("int").alias("conflicts"))).crossJoin(new.join(triples, ["s", "p", "o"], "left_semi").agg((F.count(F.lit(1)) == 0).alias("other_values")))


NAMES_SQL = "SELECT p_name AS name, cast(p_partkey AS bigint) AS first_seen FROM part UNION ALL SELECT c_name, c_custkey FROM customer UNION ALL SELECT concat(n_name, '!'), n_nationkey FROM nation UNION ALL SELECT '!!!', 0 FROM region"
_SANITIZE = "CASE WHEN trim(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') = '' THEN 'x' ELSE trim(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '_') END"


@register(f"SELECT name, {_SANITIZE} AS local FROM ({NAMES_SQL}) t")
def sanitize_local(spark, sf_dir):
    triplify.views(spark, sf_dir)
    return spark.sql(NAMES_SQL).select("name", text.sanitized(F.col("name")).alias("local"))


@register(f"WITH t AS (SELECT name, min(first_seen) AS seen FROM ({NAMES_SQL}) x GROUP BY name), b AS (SELECT name, {_SANITIZE} AS base, seen FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seen, name) AS k FROM b) SELECT name, concat('ns:', base, CASE WHEN k > 1 THEN concat('_', cast(k AS string)) ELSE '' END) AS curie FROM r")
def curie_mapping(spark, sf_dir):
    triplify.views(spark, sf_dir)
    return text.curie_mapping(spark.sql(NAMES_SQL))


@register(
    f"""{G}, names AS (SELECT s AS n FROM g UNION SELECT o FROM g), e AS (SELECT n FROM names WHERE starts_with(n, 'ns:') AND n NOT IN (SELECT p FROM g))
    SELECT (SELECT count(*) FROM e) AS renamed, (SELECT count(*) FROM e) AS opaque, count(*) AS triples, count(DISTINCT p) AS predicates FROM g"""
)
def perturb_graph(spark, sf_dir):
    triples = whole(spark, sf_dir)
    names = datasets.opaque_names(triples, seed=5)
    new = datasets.renamed(triples, names).distinct()
    counts = names.agg(F.count(F.lit(1)).alias("renamed"), F.countDistinct("new").alias("opaque"))
    return counts.crossJoin(new.agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("p").alias("predicates")))  # one row each


QUESTIONS_SQL = """
    SELECT o_orderkey % 3 + 1 AS hops, concat('who placed [order ', cast(o_orderkey AS string), ']', CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(chr(9), 'customer ', cast(o_custkey AS string), CASE WHEN o_orderkey % 7 = 0 THEN '|another' ELSE '' END) END) AS value FROM orders"""


#: Names that are part of others, too: a kind's beside its individuals'.
SURFACES_SQL = """
    SELECT concat('order ', cast(o_orderkey AS string)) AS surface FROM orders UNION SELECT concat('customer ', cast(c_custkey AS string)) FROM customer
    UNION SELECT 'order' UNION SELECT 'customer' UNION SELECT 'another'"""


@register(
    """WITH q AS (SELECT o_orderkey AS id, concat('ent_', md5(concat('order ', o_orderkey))) AS o, concat('ent_', md5(concat('customer ', o_custkey))) AS c, o_custkey IN (SELECT c_custkey FROM customer) AS known, o_custkey FROM orders)
    SELECT id, concat('who placed [', o, ']', CASE WHEN id % 11 = 0 THEN '' ELSE concat(chr(9), CASE WHEN known THEN c ELSE concat('ent_', md5('customer'), ' ', o_custkey) END, CASE WHEN id % 7 = 0 THEN concat('|ent_', md5('another')) ELSE '' END) END) AS value FROM q"""
)
def perturb_texts(spark, sf_dir):
    triplify.views(spark, sf_dir)
    names = spark.sql(SURFACES_SQL).select("surface", F.concat(F.lit("ent_"), F.md5(F.col("surface").cast("binary"))).alias("new"))
    questions = spark.sql(f"SELECT q.value, cast(regexp_extract(q.value, 'order ([0-9]+)', 1) AS bigint) AS id FROM ({QUESTIONS_SQL}) q")
    return datasets.rewritten_texts(questions, names, "value").select("id", "value")


@register(f"SELECT hops, CASE WHEN NOT contains(value, chr(9)) THEN 'malformed' WHEN contains(value, '|') THEN 'multi_answer' ELSE 'kept' END AS reason, count(*) AS n FROM ({QUESTIONS_SQL}) q GROUP BY 1, 2")
def metaqa_filter(spark, sf_dir):
    triplify.views(spark, sf_dir)
    kept = _questions(spark.sql(QUESTIONS_SQL.replace("chr(9)", "'\\t'")))
    return kept.groupBy("hops", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _questions(lines: DataFrame) -> DataFrame:
    """Question rows of every hop count."""
    out = None
    for h in (1, 2, 3):
        here = datasets.question_rows(lines.where(F.col("hops") == h).select("value")).withColumn("hops", F.lit(h).cast("bigint"))
        out = here if out is None else out.unionByName(here)
    return out


@register(f"SELECT hops, concat('order ', regexp_extract(value, 'order ([0-9]+)', 1)) AS entity, regexp_extract(value, '(customer [0-9]+)$', 1) AS answer FROM ({QUESTIONS_SQL}) q WHERE contains(value, chr(9)) AND NOT contains(value, '|') AND cast(regexp_extract(value, 'order ([0-9]+)', 1) AS int) % 2 = 1")
def heldout_exclusion(spark, sf_dir):
    triplify.views(spark, sf_dir)
    questions = _questions(spark.sql(QUESTIONS_SQL.replace("chr(9)", "'\\t'")))
    seen = questions.where(F.regexp_extract("entity", r"(\d+)", 1).cast("int") % 2 == 0)
    return datasets.single_answer_questions(questions, None, 0, exclude=seen).select("hops", "entity", "answer")


THEORY_SQL = """SELECT concat('item', cast(n_nationkey AS string)) AS id, array(concat('("', n_name, '" "is" "', CASE WHEN n_nationkey % 2 = 0 THEN 'kind' ELSE 'calm' END, '" "', CASE WHEN n_nationkey % 5 = 4 THEN '-' ELSE '+' END, '")')) AS facts,
    array(CASE n_nationkey % 4 WHEN 0 THEN '((("someone" "is" "kind" "+")) -> ("someone" "is" "nice" "+"))' WHEN 1 THEN '((("someone" "is" "calm" "+") ("someone" "is" "kind" "+")) -> ("someone" "is" "nice" "+"))'
      WHEN 2 THEN '((("Bob" "is" "kind" "+")) -> ("Bob" "is" "nice" "+"))' ELSE '((("someone" "likes" "tea" "+")) -> ("someone" "is" "nice" "+"))' END) AS rules FROM nation"""


@register("SELECT concat('item', cast(n_nationkey AS string)) AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'negated_fact' WHEN n_nationkey % 4 = 1 THEN 'multi_antecedent' WHEN n_nationkey % 4 = 2 THEN 'grounded_rule' WHEN n_nationkey % 4 = 3 THEN 'relational_rule' END AS reason FROM nation")
def proofwriter_reasons(spark, sf_dir):
    triplify.views(spark, sf_dir)
    return datasets.theories(spark.sql(THEORY_SQL)).select("id", "reason")


@register("SELECT concat('item', cast(n_nationkey AS string)) AS id, 'q' AS qid, CASE WHEN n_nationkey % 8 = 0 THEN 'entailed' ELSE 'entailed' END AS label, CAST(NULL AS VARCHAR) AS reason FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey % 5 <> 4")
def proofwriter_claims(spark, sf_dir):
    triplify.views(spark, sf_dir)
    mapped = datasets.theories(spark.sql(THEORY_SQL))
    questions = spark.sql("""SELECT concat('item', cast(n_nationkey AS string)) AS id, 'q' AS qid, concat('("', n_name, '" "is" "nice" "', CASE WHEN n_nationkey % 8 = 0 THEN '+' ELSE '-' END, '")') AS representation, CASE WHEN n_nationkey % 8 = 0 THEN 'True' ELSE 'false' END AS answer FROM nation""")
    return datasets.theory_claims(questions, mapped).select("id", "qid", "label", "reason")


# Metrics over result records, made from orders.

RECORDS_SQL = """
    SELECT cast(o_orderkey AS bigint) AS task_id, cast(o_custkey % 3 AS int) AS run, concat('c', cast(o_custkey % 4 AS string)) AS condition,
        CASE o_orderkey % 3 WHEN 0 THEN 'entailed' WHEN 1 THEN 'contradicted' ELSE 'unknown' END AS gold,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN (o_orderkey + o_custkey) % 3 = 0 THEN 'entailed' WHEN (o_orderkey + o_custkey) % 3 = 1 THEN 'contradicted' ELSE 'unknown' END AS pred,
        o_totalprice AS cost_usd, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_custkey % 100 AS double) END AS seconds FROM orders"""
RECORDS = f"WITH r AS (SELECT *, coalesce(gold = pred, false) AS correct FROM ({RECORDS_SQL}) x)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    triplify.views(spark, sf_dir)
    return spark.sql(f"SELECT *, coalesce(gold = pred, false) AS correct FROM ({RECORDS_SQL}) x")


@register(f"{RECORDS} SELECT condition, count(*) AS n, avg(correct::INT) AS accuracy FROM r GROUP BY condition")
def accuracy_by_group(spark, sf_dir):
    return metrics.accuracy(_records(spark, sf_dir), ["condition"])


@register(
    f"""{RECORDS}, l AS (SELECT unnest(['entailed', 'contradicted', 'unknown']) AS label),
    c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS p, count(*) FILTER (gold = label) AS g FROM l, r GROUP BY label),
    m AS (SELECT label, tp / p AS precision, tp / g AS recall FROM c)
    SELECT label, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM m"""
)
def three_way_metrics(spark, sf_dir):
    return metrics.three_way(_records(spark, sf_dir))


@register(f"{RECORDS} SELECT count(*) AS n, count(*) FILTER (gold <> 'entailed' AND pred = 'entailed') / count(*) FILTER (gold <> 'entailed') AS false_verification_rate FROM r")
def false_verification(spark, sf_dir):
    return metrics.three_way_summary(_records(spark, sf_dir)).select("n", "false_verification_rate")


@register(f"{RECORDS} SELECT count(*) FILTER (a.correct AND NOT b.correct) AS b, count(*) FILTER (NOT a.correct AND b.correct) AS c FROM r a JOIN r b ON a.task_id = b.task_id - 1 AND a.run = b.run")
def mcnemar_counts(spark, sf_dir):
    r = _records(spark, sf_dir)
    return metrics.mcnemar(r, r.withColumn("task_id", F.col("task_id") - 1)).select("b", "c")


@register(f"{RECORDS} SELECT condition, count(*) AS n, avg(correct::INT) AS accuracy, round(avg(cost_usd), 4) AS mean_cost_usd, avg(seconds) AS mean_seconds, count(*) FILTER (pred IS NULL) AS unparsed FROM r GROUP BY condition")
def result_summary(spark, sf_dir):
    return metrics.summary(_records(spark, sf_dir)).withColumn("mean_cost_usd", F.round("mean_cost_usd", 4))


@register("SELECT event_type AS tool, concat('c', cast(user_id % 3 AS string)) AS condition, cast(sum(user_id % 5 + 1) AS bigint) AS calls FROM events GROUP BY 1, 2")
def tool_totals(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    records = events.select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("condition"), F.create_map("event_type", F.col("user_id") % 5 + 1).alias("tool_calls"))
    return metrics.tool_totals(records)


@register(
    """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 5 AS a, o_custkey % 4 AS b FROM orders), s AS (SELECT id, list_distinct(CASE WHEN a = 0 THEN [] ELSE ['k1', 'k' || a] END) AS gold, list_distinct(CASE WHEN b = 0 THEN [] ELSE ['k2', 'k' || b] END) AS pred FROM x),
    t AS (SELECT id, len(list_intersect(gold, pred)) AS common, len(gold) AS g, len(pred) AS p, list_sort(gold) = list_sort(pred) AS exact FROM s)
    SELECT id, CASE WHEN p = 0 THEN 0 ELSE common / p END AS precision, CASE WHEN g = 0 THEN 0 ELSE common / g END AS recall, exact FROM t"""
)
def audit_prf(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = F.col("o_orderkey") % 5, F.col("o_custkey") % 4
    empty = F.array().cast("array<string>")
    records = orders.select(
        F.col("o_orderkey").alias("id"), F.when(a == 0, empty).otherwise(F.array(F.lit("k1"), F.concat(F.lit("k"), a.cast("string")))).alias("gold"),
        F.when(b == 0, empty).otherwise(F.array(F.lit("k2"), F.concat(F.lit("k"), b.cast("string")))).alias("pred"),
    )
    return metrics.audit_scores(records).select("id", "precision", "recall", "exact")


@register("SELECT o_orderkey AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) x WHERE r % 7 = 2")
def shard_partition(spark, sf_dir):
    return metrics.shard(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id")), 2, 7)


@register("WITH x AS (SELECT c_custkey % 10 AS task, c_nationkey AS args, c_mktsegment AS expected FROM customer) SELECT task, args, count(DISTINCT expected) AS n_expected FROM x GROUP BY task, args HAVING count(DISTINCT expected) > 1")
def infeasible_specs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return metrics.infeasible(c.select((F.col("c_custkey") % 10).alias("task"), F.col("c_nationkey").alias("args"), F.col("c_mktsegment").alias("expected")))


_WEIGHT = " + ".join(f"cast(substr(h, 4 * k + 1, 4) >= '{u}' AS int)" for u in metrics.POISSON)


@register(
    f"""{RECORDS}, d AS (SELECT condition, cast(correct AS int) - cast(gold = 'entailed' AS int) AS diff, ('0x' || substr(md5(cast(task_id AS varchar)), 1, 8))::BIGINT % {metrics.CELLS} AS cell FROM r),
    c AS (SELECT condition, cell, sum(diff) AS s, count(*) AS n FROM d GROUP BY ALL), o AS (SELECT condition, sum(s) / sum(n) AS mean_diff FROM c GROUP BY condition),
    w AS (SELECT cell, 8 * chunk + k AS resample, {_WEIGHT} AS w FROM (SELECT cell, chunk, md5('0|' || cell || '|' || chunk) AS h FROM (SELECT DISTINCT cell FROM c) x, range(0, 1250) t(chunk)) y, range(0, 8) z(k)),
    m AS (SELECT condition, sum(w * s) / sum(w * n) AS mean FROM c JOIN w USING (cell) GROUP BY condition, resample),
    k AS (SELECT condition, mean, mean_diff, row_number() OVER (PARTITION BY condition ORDER BY mean) AS rank FROM m JOIN o USING (condition))
    SELECT condition, max(mean_diff) AS mean_diff, max(mean) FILTER (rank = 251) AS low, max(mean) FILTER (rank = 9751) AS high, avg(cast(abs(mean - mean_diff) >= abs(mean_diff) - 1e-15 AS int)) AS p_value FROM k GROUP BY condition"""
)
def bootstrap_ci(spark, sf_dir):
    r = _records(spark, sf_dir)
    return metrics.bootstrap(r.select("condition", "task_id", F.col("correct").cast("double").alias("a"), (F.col("gold") == "entailed").cast("double").alias("b")), "condition", "task_id")


@register(
    """WITH x AS (SELECT o_orderkey AS id, [cast(o_orderkey % 2 AS int), cast(o_custkey % 2 AS int), 1] AS kills, [true, o_custkey % 3 = 0, false] AS boundary, o_orderkey % 4 <> 0 AS passes FROM orders)
    SELECT id, CASE WHEN passes THEN list_sum(kills) / 3 ELSE 0 END AS mutation_score,
        CASE WHEN passes THEN (kills[1] + CASE WHEN boundary[2] THEN kills[2] ELSE 0 END) / CASE WHEN boundary[2] THEN 2 ELSE 1 END ELSE 0 END AS boundary_score FROM x"""
)
def kill_scores(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    suites = spark.read.parquet(f"{sf_dir}/orders.parquet").select(o.alias("id"), F.array((o % 2).cast("int"), (c % 2).cast("int"), F.lit(1)).alias("kills"), F.array(F.lit(True), c % 3 == 0, F.lit(False)).alias("boundary"), (o % 4 != 0).alias("passes"))
    return metrics.kill_scores(suites).select("id", "mutation_score", "boundary_score")


# Texts.

def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@register("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS answer FROM conversations")
def parse_final(spark, sf_dir):
    marked = F.concat(F.lit("FINAL: first\nso FINAL: "), F.col("role"), F.element_at(F.array(*[F.lit(x) for x in (".", ";,", "", ".:")]), (F.col("turn") % 4 + 1).cast("int")))
    return _conversations(spark, sf_dir).select("conv_id", "turn", text.final_answer(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(F.col("turn") % 4 == 3, F.lit("no answer")).otherwise(marked))).alias("answer"))


@register(
    """WITH w AS (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), ' ')) AS word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS at FROM conversations),
    p AS (SELECT a.conv_id, a.turn, cast(a.role IS DISTINCT FROM b.role AS int) AS role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    d AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.turn, y.turn - 1) AS turn, count(*) AS n FROM w x FULL JOIN w y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 AND x.at = y.at WHERE x.word IS DISTINCT FROM y.word GROUP BY ALL)
    SELECT p.conv_id, p.turn, p.role + coalesce(d.n, 0) AS n_differences, p.role + coalesce(d.n, 0) = 0 AS alike FROM p LEFT JOIN d USING (conv_id, turn)"""
)
def record_differences(spark, sf_dir):
    turns = _conversations(spark, sf_dir)
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.split(F.coalesce("text", F.lit("")), " ").alias("words")))
    told = turns.select("conv_id", "turn", record.alias("record"))
    following = told.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("record").alias("after"))
    return differences.alike(told.join(following, ["conv_id", "turn"]), ["conv_id", "turn"], "record", "after")


@register("SELECT conv_id, turn, CASE WHEN role < 'b|2' THEN concat(role, ',b|2') ELSE concat('b|2,', role) END AS pairs FROM conversations")
def parse_final_pairs(spark, sf_dir):
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\nFINAL: x|y\nFINAL: `b | 2`; "), F.col("role"), F.lit(". ;b|2; ;"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.array_join(text.final_pairs(line), ",").alias("pairs"))


_HISTORY = "WITH h AS (SELECT conv_id, turn, role, trim(text, ' \n\t\r') AS t FROM conversations WHERE turn % 5 <> 4 AND trim(text, ' \n\t\r') <> '')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines of several shapes, with junk between."""
    c = _conversations(spark, sf_dir)
    flat = F.to_json(F.struct("role", F.col("text").alias("content")))
    wrapped = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text"))).alias("content")).alias("message")))
    value = F.when(F.col("turn") % 5 == 4, F.lit("{not json")).when(F.col("turn") % 2 == 0, flat).otherwise(wrapped)
    return c.select("conv_id", F.col("turn").alias("line_no"), value.alias("value"))


@register(f"{_HISTORY} SELECT conv_id AS conversation, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role, t AS text FROM h")
def history_turns(spark, sf_dir):
    return text.message_turns(_lines(spark, sf_dir), conversation="conv_id")


@register(f"{_HISTORY}, n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role, t FROM h) SELECT conv_id AS conversation, string_agg('[turn ' || turn || ' - ' || role || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY turn) AS rendered FROM n GROUP BY conv_id")
def history_render(spark, sf_dir):
    return text.rendered(text.message_turns(_lines(spark, sf_dir), conversation="conv_id"))


# Sources of code, their mutants and patches.

#: Programs or patches that a task reads.
CODE_ROWS = 10_000

PATCH_SQL = """
    SELECT cast(p_partkey AS bigint) AS instance_id, cast(p_size AS string) AS size, cast(p_size + 1 AS string) AS one_more, cast(p_size + 9 AS string) AS more, p_partkey % 8 AS kind FROM part"""


@register(
    """SELECT CAST(p_partkey AS BIGINT) AS instance_id, p_partkey % 8 IN (0, 1, 3, 4) AS qualifies,
        CASE p_partkey % 8 WHEN 2 THEN 'unclassified_change' WHEN 5 THEN 'test_or_doc_only' WHEN 6 THEN 'non_py_code_change' WHEN 7 THEN 'no_boundary_change' END AS reason,
        CASE p_partkey % 8 WHEN 0 THEN 'comparison_operator' WHEN 1 THEN 'constant_delta' WHEN 3 THEN 'index_date_arith' WHEN 4 THEN 'minmax_guard' ELSE '' END AS classes FROM part"""
)
def patch_classes(spark, sf_dir):
    triplify.views(spark, sf_dir)
    kind, size, one_more, more = F.col("kind"), F.col("size"), F.col("one_more"), F.col("more")
    text_of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    changes = [
        (text_of("if rows < ", size, ":"), text_of("if rows <= ", size, ":")), (text_of("size = ", size), text_of("size = ", one_more)), (text_of("size = ", size), text_of("size = ", more)),
        (text_of("row = rows[", size, "]"), text_of("row = rows[", more, "]")), (text_of("size = width"), text_of("size = min(width, ", size, ")")), (text_of("assert size < ", size), text_of("assert size <= ", size)),
        (text_of("return size < ", size, ";"), text_of("return size <= ", size, ";")), (text_of("# was ", size), text_of("# now ", more)),
    ]
    pick = lambda side: F.coalesce(*[F.when(kind == k, c[side]) for k, c in enumerate(changes)])
    path = F.when(kind == 5, "tests/test_size.py").when(kind == 6, "src/size.c").otherwise("src/size.py")
    patch = text_of("--- a/", path, "\n+++ b/", path, "\n@@ -1,2 +1,2 @@\n context\n-", pick(0), "\n+", pick(1), "\n")
    judged = patches.judged(spread(spark.sql(PATCH_SQL), CODE_ROWS).select("instance_id", patch.alias("patch")))
    return judged.select("instance_id", "qualifies", "reason", F.array_join("filter_classes", ",").alias("classes"))


CODE_SQL = """
    SELECT concat('shop/client_', cast(c_custkey AS string), '.py') AS path, concat('shop.client_', cast(c_custkey AS string)) AS module,
        concat('import json\nfrom shop.base import Base\n\nclass C', cast(c_custkey AS string), '(Base):\n    def save(self):\n        return self.text()\n\n    def text(self):\n        raise KeyError(', cast(c_nationkey AS string), ')\n') AS source FROM customer"""


@register(
    """WITH m AS (SELECT concat('shop.client_', c_custkey) AS m, concat('shop.client_', c_custkey, '.C', c_custkey) AS c FROM customer)
    SELECT m AS s, 'rdf:type' AS p, 'Module' AS o FROM m UNION ALL SELECT m, 'imports', 'json' FROM m UNION ALL SELECT m, 'imports', 'shop.base' FROM m
    UNION ALL SELECT c, 'rdf:type', 'Class' FROM m UNION ALL SELECT c, 'defined_in', m FROM m UNION ALL SELECT c, 'rdfs:subClassOf', 'shop.base.Base' FROM m
    UNION ALL SELECT concat(c, f), 'rdf:type', 'Function' FROM m, (VALUES ('.save'), ('.text')) t(f) UNION ALL SELECT concat(c, f), 'defined_in', m FROM m, (VALUES ('.save'), ('.text')) t(f)
    UNION ALL SELECT concat(c, '.save'), 'calls', concat(c, '.text') FROM m UNION ALL SELECT concat(c, '.text'), 'raises', 'KeyError' FROM m UNION ALL SELECT concat(c, '.text'), 'calls', 'KeyError' FROM m"""
)
def code_facts_python(spark, sf_dir):
    triplify.views(spark, sf_dir)
    return code_facts.facts(spread(spark.sql(CODE_SQL), CODE_ROWS)).select("s", "p", "o").distinct()


@register(
    """SELECT CAST(p_partkey AS BIGINT) AS id, kind, boundary, change FROM part, LATERAL (VALUES ('comparison', true, '< -> <='), ('constant', true, concat(p_size, ' -> ', p_size + 1)), ('constant', true, concat(p_size, ' -> ', p_size - 1)), ('arithmetic', false, '+ -> -')) t(kind, boundary, change)"""
)
def mutants(spark, sf_dir):
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), CODE_ROWS)
    source = F.concat(F.lit("def fits(a, b):\n    return a + b < "), F.col("p_size").cast("string"), F.lit("\n"))
    return mutation.mutants_of(part.select(F.col("p_partkey").cast("long").alias("id"), source.alias("source"), F.lit("fits").alias("function"))).select("id", "kind", "boundary", "change")


# RDF files, written and read again.


@register(f"{G} SELECT s, p, o FROM g")
def rdf_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/rdf/{uuid.uuid4().hex}"
    rdf.write(whole(spark, sf_dir), path, "nt", compression="gzip")  # a line takes 8 bytes where it took 110
    release(spark)
    return rdf.read(spark, path, "nt")


# What cannot be: facts made from the tables that break lists and cardinalities.

BROKEN_SQL = """
    SELECT concat('ns:customer_', cast(c_custkey AS string)) AS s, 'rdf:type' AS p, 'ns:Debtor' AS o FROM customer WHERE c_acctbal < 1000
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'rdf:type', 'ns:Saver' FROM customer WHERE c_acctbal > 500
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'ns:likes', concat('ns:Seg_', c_mktsegment) FROM customer
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'ns:hates', concat('ns:Seg_', c_mktsegment) FROM customer WHERE c_custkey % 10 = 0
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'rdf:type', 'ns:Clean' FROM customer WHERE c_custkey % 7 = 0
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'ns:owes', concat('ns:nation_', cast(c_nationkey AS string)) FROM customer
    UNION ALL SELECT concat('ns:nation_', cast(n_nationkey AS string)), 'rdf:type', 'ns:Rich' FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT * FROM (VALUES ('ns:Clean', 'owl:maxQualifiedCardinality', '"0"^^xsd:nonNegativeInteger'), ('ns:Clean', 'owl:onProperty', 'ns:owes'), ('ns:Clean', 'owl:onClass', 'ns:Rich'),
        ('_:c', 'rdf:type', 'owl:AllDisjointClasses'), ('_:c', 'owl:members', '_:c0'), ('_:c0', 'rdf:first', 'ns:Debtor'), ('_:c0', 'rdf:rest', '_:c1'), ('_:c1', 'rdf:first', 'ns:Saver'), ('_:c1', 'rdf:rest', 'rdf:nil'),
        ('_:p', 'rdf:type', 'owl:AllDisjointProperties'), ('_:p', 'owl:members', '_:p0'), ('_:p0', 'rdf:first', 'ns:likes'), ('_:p0', 'rdf:rest', '_:p1'), ('_:p1', 'rdf:first', 'ns:hates'), ('_:p1', 'rdf:rest', 'rdf:nil')) x"""


@register(
    f"""WITH t(s, p, o) AS ({BROKEN_SQL})
    SELECT 'cax-adc' AS rule, s, p, o FROM t WHERE p = 'rdf:type' AND o IN ('ns:Debtor', 'ns:Saver') AND s IN (SELECT s FROM t WHERE o = 'ns:Debtor') AND s IN (SELECT s FROM t WHERE o = 'ns:Saver' AND p = 'rdf:type')
    UNION ALL SELECT 'prp-adp', a.s, a.p, a.o FROM t a WHERE a.p IN ('ns:likes', 'ns:hates') AND a.s IN (SELECT s FROM t WHERE p = 'ns:hates')
    UNION ALL SELECT 'cls-maxqc1', s, p, o FROM t WHERE p = 'ns:owes' AND s IN (SELECT s FROM t WHERE o = 'ns:Clean') AND o IN (SELECT s FROM t WHERE o = 'ns:Rich' AND p = 'rdf:type')"""
)
def owl_inconsistencies(spark, sf_dir):
    triplify.views(spark, sf_dir)
    return reason.inconsistencies(reason.closure(spark.sql(BROKEN_SQL)))
