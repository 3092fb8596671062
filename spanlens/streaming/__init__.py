"""Incremental counts over streams of judged records, and resumable batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def contingency_counts(stream: DataFrame, keys: list[str], z: str, y: str) -> DataFrame:
    """Running 2 x 2 counts by key, for output mode `complete`. An AUC cannot be kept up without binning its scores, so none is offered."""
    a, b = F.col(z).cast("int"), F.col(y).cast("int")
    return stream.groupBy(*keys).agg(*(F.count_if((a == i) & (b == j)).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)))


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Rows by window and key; rows later than `late` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def judge_once(stream: DataFrame, key: str, out: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], label: str = "label") -> StreamingQuery:
    """Judge each key once, into the table at `out`, one folder for each run (checkpoint) and batch.

    Within a run the stream's state knows the keys it has met, so no batch reads
    what others wrote. A batch replaces its own folder: run again after a failure
    between its write and its checkpoint, it leaves the same rows. Keys with a
    label from earlier runs are left out; those whose label is null are judged again.
    """
    spark = stream.sparkSession
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    before = judged(spark, out, key, label, other_than=run)
    fresh = stream.dropDuplicates([key])
    if before is not None:
        # Both sides are shuffled: the keys of earlier runs grow with the table and go to no driver.
        fresh = fresh.join(before.filter(F.col(label).isNotNull()).select(key).hint("merge"), key, "left_anti")
    writer = fresh.writeStream.foreachBatch(lambda batch, number: write_batch(judge(batch), out, run, number))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(rows: DataFrame, out: str, run: str, number: int) -> None:
    """A batch's rows in its own folder, in place of any that it wrote before."""
    rows.write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")


def judged(spark: SparkSession, out: str, key: str, label: str = "label", other_than: str | None = None) -> DataFrame | None:
    """The table that runs have written, a row for each key: with a label if any run gave one, else the last try. None where there is none."""
    try:
        rows = spark.read.option("basePath", out).parquet(out)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    rows = rows.filter(F.col("run") != other_than) if other_than else rows
    own = [c for c in rows.columns if c not in ("run", "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(F.col(label).isNotNull(), "run", "batch")).alias("r")).select("r.*")
