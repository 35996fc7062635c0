"""Readers for the parquet tables and the labelled relation built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.functions.exprs import one_line
from lexlab.operators.labels import decode_label, label_from_flags


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition by ``key`` into ``spark.lexlab.text.partitions``
    partitions, if the session sets that parameter; else the scan's own splits
    (``spark.sql.files.maxPartitionBytes``) are kept.

    Text work is heavy per row, and a file of one large row group is one task;
    the parameter is for such inputs.  Results do not depend on it."""
    n = df.sparkSession.conf.get("spark.lexlab.text.partitions", None)
    return df if not n else df.repartition(int(n), key)


def read_documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Document columns for text work."""
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", *cols), "doc_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled relation L: ``documents JOIN labels USING (doc_id)``.

    label = negative if toxic, else positive if quality, else neutral
    (ids in the general family order).  Only the needed document columns
    are selected; Catalyst prunes the scan further to what each query uses.  The join is left
    to Catalyst/AQE: broadcast when the label table's measured size is
    below the threshold, sort-merge otherwise.
    """
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("sentence"), "lang", "source")
    labs = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = (docs.join(labs, "doc_id")
              .select("doc_id", "sentence", "lang", "source",
                      label_from_flags(F.col("quality"), F.col("toxic")).alias("label"))
              .withColumn("label_name", decode_label("label")))
    return spread(joined, "doc_id")


def corpus_lines(labelled_df: DataFrame) -> DataFrame:
    """Render L in the corpus line format ``sentence@label_name``."""
    return labelled_df.select(
        "doc_id", F.concat(one_line("sentence"), F.lit("@"), F.col("label_name")).alias("line"))


def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New text to score: documents without a label (left anti join)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labs = read_table(spark, sf_dir, "labels").select("doc_id")
    return spread(docs.join(labs, "doc_id", "left_anti"), "doc_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
