"""Line-oriented sources: numbered lines, JSON lines, provenance logs, question sets, task folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import message_turns


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, lines numbered from 0 within their file; a task reads a file at a time."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "value"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line, blank lines skipped; .gz files are read as they are."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def provenance_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "s string, p string, o string, source string, at string")


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(path, turn, role, text) of conversation files, a line a record; lines that are no messages are skipped."""
    return message_turns(numbered_lines(spark, path), conversation="path").withColumnRenamed("conversation", "path")


def patch_instances(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, repo, patch) of a .json file (an array), a .jsonl file, or a folder of such files."""
    schema = "instance_id string, repo string, patch string"
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if path.endswith((".jsonl", ".jsonl.gz")):
        return spark.read.schema(schema).json(path)
    lines = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl*").json(path)
    return lines.unionByName(spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path))


def write_entity_map(names: DataFrame, path: str, mode: str = "error") -> None:
    """Identifiers and the texts they stand for (curie, name), an object a line."""
    names.select("curie", "name").write.mode(mode).json(path)


def entity_map(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "curie string, name string")


def console(rows: DataFrame, most: int = 50) -> str:
    """The first rows as lines of aligned columns, and how many there are, if more."""
    some = rows.limit(most + 1).collect()  # bounded
    table = [rows.columns, *[["" if v is None else str(v) for v in r] for r in some[:most]]]
    width = [max(len(line[k]) for line in table) for k in range(len(rows.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(line, width, strict=True)).rstrip() for line in table]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:], *([f"... {rows.count()} rows"] if len(some) > most else [])])


def task_folders(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """(task, a column for each file name) of folders `root/task/name`; missing files are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("task"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").cast("string").alias("text"))
    return parts.groupBy("task").pivot("name", list(names)).agg(F.first("text"))
