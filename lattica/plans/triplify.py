"""A knowledge graph over the star schema, as one SQL text for Spark and DuckDB.

`GRAPH_SQL` gives the distinct triples; `AUDIT_SQL` adds injected conflicts. Terms
are as in `lattica.functions.terms`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

ENTITY_SQL = """
    SELECT concat('ns:nation_', cast(n_nationkey AS string)) AS s, 'ns:in_region' AS p, concat('ns:region_', cast(n_regionkey AS string)) AS o FROM nation
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'ns:in_nation', concat('ns:nation_', cast(c_nationkey AS string)) FROM customer
    UNION ALL SELECT concat('ns:supplier_', cast(s_suppkey AS string)), 'ns:in_nation', concat('ns:nation_', cast(s_nationkey AS string)) FROM supplier
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'rdf:type', concat('ns:Seg_', c_mktsegment) FROM customer
    UNION ALL SELECT concat('ns:supplier_', cast(s_suppkey AS string)), 'rdf:type', 'ns:Supplier' FROM supplier
    UNION ALL SELECT concat('ns:part_', cast(p_partkey AS string)), 'ns:brand', concat('"', p_brand, '"') FROM part
    UNION ALL SELECT concat('ns:part_', cast(p_partkey AS string)), 'ns:size', concat('"', cast(p_size AS string), '"^^xsd:integer') FROM part"""

ORDER_SQL = """
    SELECT concat('ns:order_', cast(o_orderkey AS string)) AS s, 'ns:placed_by' AS p, concat('ns:customer_', cast(o_custkey AS string)) AS o FROM orders
    UNION ALL SELECT DISTINCT concat('ns:order_', cast(l_orderkey AS string)), 'ns:contains', concat('ns:part_', cast(l_partkey AS string)) FROM lineitem
    UNION ALL SELECT DISTINCT concat('ns:order_', cast(l_orderkey AS string)), 'ns:supplied_by', concat('ns:supplier_', cast(l_suppkey AS string)) FROM lineitem"""

SCHEMA_SQL = """
    SELECT DISTINCT concat('ns:Seg_', c_mktsegment) AS s, 'rdfs:subClassOf' AS p, 'ns:Customer' AS o FROM customer
    UNION ALL SELECT 'ns:Customer', 'rdfs:subClassOf', 'ns:Party'
    UNION ALL SELECT 'ns:Supplier', 'rdfs:subClassOf', 'ns:Party'
    UNION ALL SELECT 'ns:Party', 'rdfs:subClassOf', 'ns:Agent'
    UNION ALL SELECT 'ns:in_nation', 'rdf:type', 'owl:FunctionalProperty'
    UNION ALL SELECT 'ns:in_region', 'rdf:type', 'owl:FunctionalProperty'
    UNION ALL SELECT 'ns:placed_by', 'rdf:type', 'owl:FunctionalProperty'
    UNION ALL SELECT 'ns:in_nation', 'rdfs:subPropertyOf', 'ns:located_in'
    UNION ALL SELECT 'ns:in_region', 'rdfs:subPropertyOf', 'ns:located_in'
    UNION ALL SELECT 'ns:located_in', 'rdf:type', 'owl:TransitiveProperty'"""

ALIAS_SQL = """
    SELECT concat('ns:customer_', cast(c_custkey AS string), '_alias') AS s, 'owl:sameAs' AS p, concat('ns:customer_', cast(c_custkey AS string)) AS o FROM customer WHERE c_custkey % 17 = 0
    UNION ALL SELECT concat('ns:customer_', cast(c_custkey AS string)), 'owl:differentFrom', concat('ns:customer_', cast(c_custkey + 1 AS string)) FROM customer WHERE c_custkey % 19 = 0"""

INJECTED_SQL = """
    SELECT concat('ns:customer_', cast(c_custkey AS string)) AS s, 'ns:in_nation' AS p, concat('ns:nation_', cast((c_nationkey + 7) % 25 AS string)) AS o FROM customer WHERE c_custkey % 10 = 0"""

EVENT_SQL = """
    SELECT concat('ns:user_', cast(user_id AS string)) AS s, concat('ns:did_', event_type) AS p, concat('ns:day_', cast(cast(ts AS date) AS string)) AS o,
           concat('event_', cast(event_id AS string)) AS source, cast(cast(ts AS date) AS string) AS at FROM events"""

#: Everything but orders; the graph that closures and claims run over.
KB_SQL = f"SELECT DISTINCT s, p, o FROM ({ENTITY_SQL} UNION ALL {SCHEMA_SQL} UNION ALL {ALIAS_SQL}) kb_rows"
GRAPH_SQL = f"SELECT DISTINCT s, p, o FROM ({ENTITY_SQL} UNION ALL {ORDER_SQL} UNION ALL {SCHEMA_SQL} UNION ALL {ALIAS_SQL}) graph_rows"
AUDIT_SQL = f"SELECT DISTINCT s, p, o FROM ({ENTITY_SQL} UNION ALL {ORDER_SQL} UNION ALL {SCHEMA_SQL} UNION ALL {INJECTED_SQL}) audit_rows"
#: The same without orders, for the audit of what a closure was made of.
AUDIT_KB_SQL = f"SELECT DISTINCT s, p, o FROM ({ENTITY_SQL} UNION ALL {SCHEMA_SQL} UNION ALL {INJECTED_SQL}) audit_rows"


#: ORDER_SQL without repeats, told from the keys: a key takes a sixth of the bytes of the triple that it names.
_ORDERS = """
    SELECT concat('ns:order_', cast(o_orderkey AS string)) AS s, 'ns:placed_by' AS p, concat('ns:customer_', cast(o_custkey AS string)) AS o FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) a
    UNION ALL SELECT concat('ns:order_', cast(l_orderkey AS string)), 'ns:contains', concat('ns:part_', cast(l_partkey AS string)) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b
    UNION ALL SELECT concat('ns:order_', cast(l_orderkey AS string)), 'ns:supplied_by', concat('ns:supplier_', cast(l_suppkey AS string)) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) c"""
#: How Spark gets the same rows: no other part has the predicates of orders, so only the small parts are compared as triples.
PLANNED = {
    GRAPH_SQL: f"SELECT DISTINCT s, p, o FROM ({ENTITY_SQL} UNION ALL {SCHEMA_SQL} UNION ALL {ALIAS_SQL}) rest UNION ALL {_ORDERS}",
    AUDIT_SQL: f"SELECT DISTINCT s, p, o FROM ({ENTITY_SQL} UNION ALL {SCHEMA_SQL} UNION ALL {INJECTED_SQL}) rest UNION ALL {_ORDERS}",
}


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def triples(spark: SparkSession, sf_dir: str, sql: str = GRAPH_SQL) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(PLANNED.get(sql, sql))
