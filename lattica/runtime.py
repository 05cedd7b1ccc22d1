"""The shared folder, cut lineage, and a deadline for Spark work."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Seconds between two cancellations of late jobs.
POLL_S = 0.25


class DeadlineExceeded(RuntimeError):
    """Work was interrupted because it took longer than its deadline."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, one is made and set, but only if the session runs
    on one machine, as in tests; on a cluster that raises ValueError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: The deadlines that the work of this thread is under; each is set once it has passed.
_LATE: ContextVar[tuple[threading.Event, ...]] = ContextVar("late", default=())


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder: no lineage, safe from lost executors."""
    if any(late.is_set() for late in _LATE.get()):
        raise DeadlineExceeded("the deadline has passed")
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As `cut`, but as Parquet: a few bytes a row where a checkpoint takes a hundred, and joins know its size beforehand."""
    if any(late.is_set() for late in _LATE.get()):
        raise DeadlineExceeded("the deadline has passed")
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt out so that a task has about so many `rows`, however few or large its files are; by `keys`, if given.

    Its rows are counted first, so it should be cheap to count, as a table is.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of steps whose results are cut and whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is planned inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Raises DeadlineExceeded once the work inside has taken `seconds` (never, if None); works on any thread.

    From then on the Spark jobs started inside are cancelled again and again, so that
    work that plans between short jobs ends too; at the latest the block's end raises.
    """
    if seconds is None:
        yield
        return
    tag, late, over = f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if over.wait(seconds):
            return
        late.set()
        while not over.wait(POLL_S):
            spark.sparkContext.cancelJobsWithTag(tag)

    before = _LATE.set((*_LATE.get(), late))
    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    message = f"exceeded {seconds:g} s; bind more terms, or add a limit"
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise DeadlineExceeded(message) from e
        raise
    finally:
        over.set()
        spark.sparkContext.removeJobTag(tag)
        _LATE.reset(before)
    if late.is_set():
        raise DeadlineExceeded(message)
