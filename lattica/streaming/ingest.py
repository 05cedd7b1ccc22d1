"""Continuous ingestion of triples: an extension for growing graphs.

Batches of texts (s, p, o, source) arrive as files; each is parsed, de-duplicated
against the graph and added, its provenance logged, and its conflicts with
functional properties reported. Everything that a batch writes goes to folders of
its own, which a repeated batch overwrites, so a restarted stream adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.functions import terms
from lattica.operators import audit, store
from lattica.runtime import cut

RAW = "s string, p string, o string, source string"
TERMS = "s string, p string, o string"


def current(spark: SparkSession, path: str) -> DataFrame:
    """All triples that the stream has written below `path`, with the batch that brought them."""
    return spark.read.schema(TERMS + ", batch long").parquet(f"{path}/triples")


def _batch(spark: SparkSession, path: str):
    def run(raw: DataFrame, batch: int) -> None:
        known = current(spark, path).where(F.col("batch") != batch).select("s", "p", "o")
        fresh = cut(store.add(known, store.parse_batch(raw)))
        sources = raw.select(*[terms.parsed(F.col(c), as_object=c == "o").alias(c) for c in ("s", "p", "o")], "source").where(F.col("source").isNotNull())
        logged = fresh.join(sources.groupBy("s", "p", "o").agg(F.min("source").alias("source")), ["s", "p", "o"])
        logged = logged.withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        # Only subjects that the batch touched can have new conflicts.
        after = known.unionByName(fresh)
        touched = after.join(fresh.select("s", "p").distinct(), ["s", "p"], "left_semi").select("s", "p", "o")
        found = audit.violations(touched.unionByName(after.where(F.col("o") == "owl:FunctionalProperty")))
        for name, rows in (("provenance", logged), ("violations", found)):
            rows.write.mode("overwrite").json(f"{path}/{name}/batch={batch}")
        fresh.write.mode("overwrite").parquet(f"{path}/triples/batch={batch}")

    return run


def ingest(spark: SparkSession, incoming: str, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that takes up all files of JSON records below `incoming` and then stops."""
    spark.createDataFrame([], TERMS).write.mode("overwrite").parquet(f"{path}/triples/batch=-1")
    batches = spark.readStream.schema(RAW).json(incoming)
    return batches.writeStream.foreachBatch(_batch(spark, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
