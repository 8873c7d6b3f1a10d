"""What the operators share: the shared folder, lineage cuts and table reading."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and
    all runs in one process, as in tests, a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='planweft-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_dir(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; nothing is created there yet."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from what was written."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as its bytes need, to be written: each file of a checkpoint costs processes of its own on a local file system."""
    return df.hint("rebalance")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Partitions to deal a shuffle to: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def place_of(df: DataFrame, name: str) -> int:
    """Where a column is: the one of exactly this name, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    near = [i for i, c in enumerate(df.columns) if c.casefold() == name.casefold()]
    if len(near) != 1:
        raise ValueError(f"no column {name!r} among {df.columns}" if not near else f"{name!r} may be any of {[df.columns[i] for i in near]}")
    return near[0]


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no name of a caller can then clash with another or with an operator's own."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def only(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns (new name = name in ``df``) alone, whatever the names of the others."""
    rows = positional(df)
    return rows.select(*(F.col(f"c{place_of(df, name)}").alias(new) for new, name in wanted.items()))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def give_back() -> None:
    """Return freed memory to the system: worker processes are used again and again, beside each other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, giving memory back at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
