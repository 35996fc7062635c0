"""Metrics of a stream of labelled rows, by event-time window.

Rows are scored by the batch projection; confusion cells are counted per window in
Spark's state store, which a watermark keeps bounded: windows that end at or before it are
closed, and rows that come later than that are dropped.

The sink writes what a micro-batch changed to a folder named by the batch's number and
overwrites it, so a batch that is run again after a failure leaves the same files.
Counts only grow, so a cell's value is the one of its last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.operators import heads as H
from lexlab.operators import metrics as M

ROW_SCHEMA = "doc_id bigint, sentence string, label int, event_time timestamp"
CELL_SCHEMA = "window_start timestamp, label int, pred int, n bigint, batch bigint"
WIDTH, DELAY = "60 minutes", "30 minutes"


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the parquet files of ``folder`` and of its sub-folders."""
    return (spark.readStream.format("parquet").schema(ROW_SCHEMA).option("recursiveFileLookup", True).load(folder))


def score_rows(rows: DataFrame, seed: int = 42, n_classes: int = 3) -> DataFrame:
    """``event_time, label, pred`` by the fixed text head."""
    scored = H.with_prediction(H.text_features(rows, "sentence"), H.fixed_text_logits("idx", seed, n_classes))
    return scored.select("event_time", "label", "pred")


def windowed_cells(preds: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """``window_start, label, pred, n`` of a stream (or of a batch, where nothing is late)."""
    return (preds.withWatermark("event_time", delay).groupBy(F.window("event_time", width).alias("w"), "label", "pred")
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "label", "pred", "n"))


def write_batch(cells: DataFrame, batch_id: int, out: str) -> None:
    cells.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/cells-{batch_id:010d}")


def run_available(cells: DataFrame, out: str, checkpoint: str) -> None:
    """Work through every file that is there, then stop; goes on from the checkpoint."""
    q = (cells.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, out)).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def current_cells(spark: SparkSession, out: str) -> DataFrame:
    """``window_start, label, pred, n`` as of the last batch that touched each cell."""
    rows = spark.read.schema(CELL_SCHEMA).option("recursiveFileLookup", True).parquet(out)
    return rows.groupBy("window_start", "label", "pred").agg(F.max_by("n", "batch").alias("n"))


def window_metrics(cells: DataFrame) -> DataFrame:
    """``window_start, macro_f1, accuracy, n``."""
    return M.macro_f1(cells, ["window_start"])
