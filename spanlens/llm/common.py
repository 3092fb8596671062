"""What the operators share: the shared work folder, tables written once, text clean-up."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401  the operators take it from here


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spanlens-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder, which may go when its results have been read."""
    return f"{shared_dir(spark)}/spanlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: Column | str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Give a worker's freed memory back: workers are used again, and what one operator left would add to the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(task):
    """A task's function, with its memory given back at the end."""

    def rows(table):
        try:
            return task(table)
        finally:
            release()

    return rows


def tidy_batches(task):
    """The same for a function over batches."""

    def batches(given):
        try:
            yield from task(given)
        finally:
            release()

    return batches
