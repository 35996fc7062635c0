"""Experiment results: multi-seed summary, ranking, best epoch, marginal value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT_SCHEMA = ("experiment_id string, backbone string, method string, seed int, "
                 "test_f1_macro double, val_f1_macro double, trainable_params bigint, "
                 "total_params bigint, trainable_pct double, output_dir string")


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


def seed_summary(results: DataFrame, metric: str = "test_f1_macro", key: str = "experiment_id",
                 digits: int = 6) -> DataFrame:
    """mean / sample std / min / max / count per experiment (std NULL for one run)."""
    return results.groupBy(key).agg(
        F.count(F.col(metric)).cast("bigint").alias("n_runs"),
        F.round(F.avg(metric), digits).alias("mean"),
        F.round(F.stddev_samp(metric), digits).alias("std"),
        F.round(F.min(metric), digits).alias("min"),
        F.round(F.max(metric), digits).alias("max"))


def order_summary(summary: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Best mean first, NULL last, ties by id."""
    return summary.orderBy(F.desc_nulls_last("mean"), F.col(key))


def order_runs(results: DataFrame, metric: str = "test_f1_macro") -> DataFrame:
    return results.orderBy(F.desc_nulls_last(metric), "experiment_id", "seed")


def rank_methods(summary: DataFrame, key: str = "experiment_id") -> DataFrame:
    """rank() by mean, descending, over the (small) summary table."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("mean"))
    return summary.select(key, "mean", F.rank().over(w).cast("int").alias("rank"))


def best_epoch(epoch_log: DataFrame, run_col: str = "run", epoch_col: str = "epoch",
               metric: str = "f1_macro") -> DataFrame:
    """Best epoch per run: highest metric, earliest epoch on ties."""
    w = Window.partitionBy(run_col).orderBy(F.desc(metric), F.col(epoch_col))
    return (epoch_log.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select(run_col, F.col(epoch_col).alias("best_epoch"), F.col(metric).alias("best_f1")))


def marginal_value(summary_by_method: DataFrame, base_method: str = "eval_only",
                   adapted_method: str = "head_only", digits: int = 6) -> DataFrame:
    """Off-the-shelf vs adapted within each backbone (pivot on method)."""
    w = summary_by_method.groupBy("backbone").agg(
        F.max(F.when(F.col("method") == base_method, F.col("mean"))).alias("base_mean"),
        F.max(F.when(F.col("method") == adapted_method, F.col("mean"))).alias("adapted_mean"))
    return w.withColumn("marginal", F.round(F.col("adapted_mean") - F.col("base_mean"), digits))


def fill_std(summary: DataFrame) -> DataFrame:
    """Chart form: a one-run std is shown as 0."""
    return summary.withColumn("std", F.coalesce(F.col("std"), F.lit(0.0)))


def check_ids(requested: Sequence[str], known: Sequence[str]) -> list[str]:
    """De-duplicated requested ids in catalogue order; unknown ids raise."""
    unknown = sorted(set(requested) - set(known))
    if unknown:
        raise ValueError(f"unknown experiment ids: {unknown}")
    want = set(requested)
    return [k for k in known if k in want] if requested else list(known)
