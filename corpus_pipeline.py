"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are applied in order; each takes ``(spark, docs, sf_dir)`` and returns
the documents that it keeps, with the columns of ``documents`` (the last one
returns the pieces of the packed sequences).  :func:`run` writes each stage's
result to the shared folder and reads it back for the next.

All stages define their results for null, empty and very long texts, repeated
rows and empty tables as the operators that they call do; other columns than
those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.llm import decontaminate, jaccard, linededup, packing, quality
from lexlab.llm.queries import table, tokenizer_path
from lexlab.session import drop_staged, stage_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on this
    stage's documents and the labels outside the held-out fold."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document are deleted; a document that
    has nothing left of it but blanks goes, ``n_chars`` follows the text."""
    cut = linededup.dedup_lines(docs, keep=("lang", "source"))
    left = ~((F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == ""))
    return (cut.filter(F.coalesce(left, F.lit(True)))
            .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class of near copies: the one with the least id."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    row = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    hits = (decontaminate.decontaminate(docs.select("text", row.alias("row_key")), table(spark, sf_dir, "benchmark"), key="row_key")
            .filter("n_hit > 0").select(F.col("row_key.doc_id").alias("hit_id"), F.col("row_key.hash").alias("hit_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash"))
    return docs.join(hits, same, "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", accept_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: no stage but the fourth can be said in SQL; the tests hold each against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's table is deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop_staged(last)
        last = docs
    return docs
