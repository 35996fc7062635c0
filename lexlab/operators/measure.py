"""Measured runs: seconds on the driver's clock, rows counted inside the job.

The count is an ``Observation`` on the rows that the action produces, so measuring
reads nothing twice.  Log rows are appended to a table beside the results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "step string, run int, rows bigint, sec double, rows_per_sec double"


def noop(df: DataFrame) -> None:
    """Produce every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def measured(df: DataFrame, step: str, run: int = 0, action: Callable[[DataFrame], object] = noop) -> tuple:
    """Run ``action`` on ``df`` once; its log row."""
    seen = Observation(f"{step}-{run}")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    began = time.perf_counter()
    action(watched)
    sec = time.perf_counter() - began
    rows = int(seen.get["rows"])
    return step, run, rows, sec, rows / sec if sec > 0 else None


def append_log(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    """Append log rows to the table at ``path``; the whole log."""
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(LOG_SCHEMA).parquet(path)
