"""A closure that a stream of triples keeps up to date, with alerts.

Batches of texts (s, p, o, op) arrive as files; `op` is "add" (also if null) or
"remove". Each batch takes the state that the batches before it left, changes its
closure by what it brings (`reason.changed`), and writes the next state and its alerts
to a folder of its own, which counts once its last part is there. So a batch that is
repeated after a failure starts from the same state and overwrites what it wrote, and
a reader never sees half a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import audit, reason, store
from lattica.operators.reason import Closure
from lattica.operators.rules import SPO
from lattica.runtime import cut

RAW = "s string, p string, o string, op string"


@dataclass(frozen=True)
class State:
    """The asserted triples after a batch, and their closure."""

    batch: int
    asserted: DataFrame
    closure: Closure


def complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose state is whole, ascending."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")]
    done = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "alerts/_SUCCESS"))]  # written last
    return sorted(int(p.getName().removeprefix("batch=")) for p in done)


def state(spark: SparkSession, path: str, before: int | None = None) -> State:
    """The latest state, or the latest of a batch before `before`; that of an empty graph if there is none."""
    known = [b for b in complete(spark, path) if before is None or b < before]
    if not known:
        empty = reason.nothing_known(spark)
        return State(-1, empty.known, empty)
    read = lambda part: spark.read.parquet(f"{path}/batch={known[-1]}/{part}")
    return State(known[-1], read("asserted"), Closure(read("known"), read("same"), read("members")))


def alerts(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """(s, p, n, objects): the conflicts of functional properties among the subjects that a batch touched."""
    return spark.read.parquet(f"{path}/batch={batch}/alerts")


def take_up(spark: SparkSession, path: str, raw: DataFrame, batch: int) -> None:
    """One batch of texts (s, p, o, op). A triple both removed and added in it stays."""
    now = state(spark, path, batch)
    adds = F.coalesce(F.col("op"), F.lit("add")) == "add"
    new, gone = cut(store.parse_batch(raw.where(adds))), cut(store.parse_batch(raw.where(F.col("op") == "remove")))
    asserted, closure = reason.changed(now.asserted, now.closure, gone, new)
    asserted = cut(asserted.select(SPO))
    # Only subjects that the batch touched can have new conflicts, unless it makes a property functional.
    kinds = asserted.where(F.col("o") == "owl:FunctionalProperty")
    made = new.where(F.col("o") == "owl:FunctionalProperty").select(F.col("s").alias("p"))
    touched = asserted.join(new.select("s", "p").distinct(), ["s", "p"], "left_semi").select(SPO).unionByName(asserted.join(made, "p", "left_semi").select(SPO)).distinct()
    found = audit.violations(touched.unionByName(kinds).distinct())
    # A repeated batch counts again only once it is whole.
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}/alerts")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(mark, True)
    for part, rows in (("asserted", asserted), ("known", closure.known), ("same", closure.same), ("members", closure.members), ("alerts", found)):
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}/{part}")


def follow(spark: SparkSession, incoming: str, path: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Starts a stream that takes up all files of JSON records below `incoming`, so many at a time, and then stops."""
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).json(incoming)
    return raw.writeStream.foreachBatch(lambda df, batch: take_up(spark, path, df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
