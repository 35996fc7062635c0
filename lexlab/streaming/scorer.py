"""Streaming scorer: the batch scoring projection on a file stream.

Stateless (one projection per micro-batch), so no watermark or state is
needed.  The sink is a parquet directory with its own checkpoint, both under
the shared checkpoint folder; ``availableNow`` processes every file present
at start and stops, which makes a run repeatable and restartable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexlab.operators import heads as H

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_documents_stream(spark: SparkSession, folder: str, file_glob: str = "documents.parquet",
                          max_files_per_trigger: int = 1) -> DataFrame:
    """The tables of ``folder`` that ``file_glob`` names: files, or folders of files.  (The braces make
    the path a pattern; as a plain path, a table of one file would be refused as no folder.)"""
    return (spark.readStream.format("parquet").schema(DOC_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .load(f"{folder.rstrip('/')}/{{{file_glob}}}"))


def score_projection(df: DataFrame, seed: int = 42, text_col: str = "text") -> DataFrame:
    """Fixed text head: doc_id, pred, confidence (same expression as batch)."""
    feats = H.text_features(df, text_col)
    out = H.with_prediction(feats, H.fixed_text_logits("idx", seed, 3))
    return out.select("doc_id", "pred", "confidence")


def run_to_completion(scored: DataFrame, out_path: str, checkpoint: str) -> None:
    q = (scored.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def score_stream(spark: SparkSession, folder: str, out_path: str, checkpoint: str,
                 seed: int = 42) -> DataFrame:
    run_to_completion(score_projection(read_documents_stream(spark, folder), seed), out_path, checkpoint)
    return spark.read.parquet(out_path)
