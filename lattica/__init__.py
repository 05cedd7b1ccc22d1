"""lattica: a Spark-native engine for knowledge graphs kept as triple tables.

The subpackages hold relational operators over triples (`operators`), readers
and writers (`sources`), scalar and column functions (`functions`), query plans
such as the SPARQL planner (`plans`) and continuous ingestion (`streaming`).
"""
