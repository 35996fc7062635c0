"""Sinks: results CSV, summary CSV, run-config JSON, split tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single_file: bool = False) -> str:
    """Header CSV directory, one file per partition.  ``single_file`` is for
    tables of bounded size (experiment results): it writes through one task."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_run_config(spark: SparkSession, meta: Mapping[str, object], path: str) -> str:
    """One-row JSON (compact) with the run configuration."""
    spark.createDataFrame([(json.dumps(dict(meta), sort_keys=True),)], "j string") \
        .select(F.col("j").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> str:
    """Persist a split table partitioned by split, so a test-only read is
    partition-pruned."""
    df.write.mode("overwrite").partitionBy(split_col).format(fmt).save(path)
    return path


# --- fixed format: run folder of an experiment and seed ---------------------
def output_dir_name(experiment_id: str, seed: int) -> str:
    return f"{experiment_id}_seed{seed}"
