"""What the operators share: cut lineage in the shared folder, and the input tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from lattica.runtime import cut, release, shared_dir

__all__ = ["batches_of", "claim", "cut", "integers", "pieces", "release", "shared_dir", "table"]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what is made of a batch's texts is made of a few at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Says that `owner` keeps tables in this process until another owner claims it; theirs are dropped first, as workers live on from stage to stage."""
    if owner not in _HELD:
        for other in _HELD.values():
            other()
        _HELD.clear()
        _HELD[owner] = drop


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hands Python workers so many rows at a time in what is computed inside; for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integers(df: DataFrame, column: str) -> None:
    """Raises TypeError unless `column` has an integer type of at most 64 bits."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"column {column} must hold integers, not {kind.simpleString()}")
