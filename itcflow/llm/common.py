"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package
from ..sources.tables import load

#: Bytes of the white space class [\x20\x09-\x0D]; ``bytes.split()`` cuts at exactly these.
SPACE = b" \t\n\x0b\x0c\r"

#: Rows of one Arrow batch: bounds a Python worker's memory for long texts.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship this package to the Python workers and bound the Arrow batches."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return load(spark, sf_dir, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder and read it back:
    cuts the lineage, pins the rows, and survives a lost executor."""
    spark = df.sparkSession
    return _written(df, shared_dir(spark, f"itcflow-llm/{uuid.uuid4().hex}/{name}"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str):
    """``materialize`` for a large table that nothing needs after the block."""
    spark = df.sparkSession
    path = shared_dir(spark, f"itcflow-llm/{uuid.uuid4().hex}/{name}")
    yield _written(df, path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def give_back() -> None:
    """Returns what this Python worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, that gives its memory back after the
    last batch. Workers wait for other tasks after that, more of them than an
    executor has cores, and what they hold comes on top of the next stage."""
    def and_tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return and_tidy


def spare(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def utf8(col: str):
    """A text column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]+``."""
    return text.split()
