"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.session import scratch_path

# A word, by the contract of every operator here: a run of characters other
# than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


TEXTS = 1_000       # rows of an Arrow batch that holds whole texts
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Inside, Python workers get so many rows at a time (both they and the JVM
    hold such a batch); None: as the session has it."""
    before = spark.conf.get(_BATCH)
    if rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to a new folder under the shared scratch folder and read it
    back: cuts the lineage, and survives lost executors.  ``batch``: rows that
    Python workers get at a time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with batches_of(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: list[dict] = []


def claim(memory: dict) -> dict:
    """``memory``, and what other operators' tasks have left in this worker is
    dropped: a worker outlives the stages that it serves.  What Arrow and the C
    library keep of freed memory goes back to the system."""
    for other in _HELD:
        if other is not memory:
            other.clear()
    _HELD[:] = [memory]
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)
    return memory
