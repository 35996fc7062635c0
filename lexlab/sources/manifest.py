"""Artifact manifest: files and sizes under a model store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the regular files under ``root``.

    ``content`` is never selected, so the scan reads file metadata only.
    Non-recursive listing matches a plain directory listing.
    """
    return (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
            .load(root).select("path", "length", "modificationTime"))


def manifest(files: DataFrame, root: str) -> DataFrame:
    """Per parent directory (relative to ``root``): file count, bytes, MB."""
    # the root's own files and folders come back with a qualified path: cut by its length
    spark = files.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    full = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri().getPath()
    # "file:/a" and "file:///a" name the same path: compare without scheme and authority
    path = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rel = F.substring(path, len(full) + 2, 1 << 30)
    parent = F.regexp_replace(rel, r"/?[^/]*$", "")
    return (files.withColumn("parent", parent)
            .groupBy("parent").agg(F.count(F.lit(1)).cast("bigint").alias("n_files"),
                                   F.sum("length").cast("bigint").alias("total_bytes"))
            .withColumn("size_mb", F.round(F.col("total_bytes") / F.lit(1e6), 3)))
