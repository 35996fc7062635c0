"""Tokenize / truncate, vocabulary counts, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlab.constants import EVAL_BATCH_SIZE, MAX_LENGTH
from lexlab.functions.exprs import hex8_to_long, seeded_md5
from lexlab.functions.text import token_indices, truncate, word_tokens
from lexlab.session import stage_table

PAD_VOCAB = 32768          # ids 1..PAD_VOCAB; 0 is padding
BATCH_BUCKETS = 256        # fixed, so a row's batch never depends on the table's size


def tokenize(df: DataFrame, text_col: str = "text", out_col: str = "tokens",
             max_length: int | None = MAX_LENGTH) -> DataFrame:
    """Word tokens of the whole text plus the truncated model input.

    ``n_tokens`` counts the whole text; ``out_col`` keeps the first
    ``max_length`` tokens (the model-input limit).
    """
    return (df.withColumn("_all", word_tokens(text_col))
              .withColumn("n_tokens", F.size("_all").cast("bigint"))
              .withColumn(out_col, truncate("_all", max_length))
              .drop("_all"))


def vocab_counts(df: DataFrame, tokens_col: str = "tokens", key_col: str = "doc_id") -> DataFrame:
    """(token, n_occurrences, n_docs) over whole texts, with one shuffle.

    Each row emits (token, 1, 0) per occurrence and (token, 0, 1) per
    distinct token of the document (``array_distinct`` inside the row), and
    a single ``groupBy(token)`` sums both.  Map-side partial aggregation
    collapses a partition to one row per token before the shuffle, so even a
    token present in a third of all documents moves as one row per partition.
    """
    t = F.col(tokens_col)
    pieces = F.concat(
        F.transform(t, lambda x: F.struct(x.alias("token"), F.lit(1).alias("occ"), F.lit(0).alias("doc"))),
        F.transform(F.array_distinct(t),
                    lambda x: F.struct(x.alias("token"), F.lit(0).alias("occ"), F.lit(1).alias("doc"))))
    return (df.select(F.explode(pieces).alias("p"))
              .groupBy(F.col("p.token").alias("token"))
              .agg(F.sum("p.occ").cast("bigint").alias("n_occurrences"),
                   F.sum("p.doc").cast("bigint").alias("n_docs")))


def token_ids(tokens: str, vocab: int = PAD_VOCAB):
    """Stable ids in 1..vocab (0 stays free for padding)."""
    return F.transform(token_indices(tokens, vocab), lambda i: i + 1)


def batch_starts(keys: DataFrame, bucket: Column, key_col: str) -> DataFrame:
    """``key, bucket, start``: how many rows of its bucket come before each key.

    Two levels: keys are dealt out by ranges of (bucket, key); within a range they are
    numbered by a window over one bucket's share of it, and running sums over the
    counts of (bucket, range), a row per range, carry the numbers on.  The result does not
    depend on the number of ranges, and no window holds more than a range."""
    counted = keys.groupBy(key_col).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)
    ranged = stage_table(counted.repartitionByRange("bucket", key_col).withColumn("part", F.spark_partition_id()), "batch-keys")
    inside = Window.partitionBy("part", "bucket").orderBy(key_col).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_b", F.coalesce("bucket", F.lit(-1)))
    parts = (ranged.groupBy("part", "_b").agg(F.sum("n").alias("n"))
             .select("part", "_b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    return (ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["part", "_b"])
            .select(key_col, "bucket", (F.col("before") + F.col("inside")).alias("start")))


def pad_batches(df: DataFrame, ids_col: str = "ids", key_col: str = "doc_id",
                batch_size: int = EVAL_BATCH_SIZE, n_buckets: int = BATCH_BUCKETS) -> DataFrame:
    """Sequential batches of ``batch_size`` rows, each padded to its longest row.

    Rows are dealt into ``n_buckets`` hash buckets; within a bucket they are
    numbered by key (:func:`batch_starts`, which sees keys only) and cut into
    batches.  Rows with equal keys follow each other; a NULL key has a bucket of its own.
    """
    bucket = (hex8_to_long(seeded_md5("batch", key_col)) % F.lit(n_buckets)).cast("int")
    starts = batch_starts(df.select(key_col), bucket, key_col).withColumnRenamed(key_col, "_key")
    same = Window.partitionBy("_key").orderBy(F.lit(0))
    out = (df.join(starts, F.col(key_col).eqNullSafe(F.col("_key")))
             .withColumn("batch_no", F.floor((F.col("start") + F.row_number().over(same) - 1) / batch_size).cast("bigint"))
             .withColumn("seq_len", F.size(ids_col).cast("bigint")).drop("_key", "start"))
    out = out.withColumn("padded_len",
                         F.max("seq_len").over(Window.partitionBy("bucket", "batch_no")))
    pad = F.array_repeat(F.lit(0), (F.col("padded_len") - F.col("seq_len")).cast("int"))
    return (out.withColumn("input_ids", F.concat(F.col(ids_col), pad))
               .withColumn("attention_mask", F.concat(
                   F.array_repeat(F.lit(1), F.col("seq_len").cast("int")), pad)))
