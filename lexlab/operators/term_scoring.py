"""Scoring by a stored parameter table, for models of any number of terms.

Documents are rows ``(key, term, n)``, a model is a table ``(term, weights)`` and a few
biases.  Scoring is a join on the term and a sum per document, so no part of the model
passes through the driver or a plan's literals.

A term that is in every document would send all its rows to one task.  Terms with more
than a thousandth of all rows are less than a thousand; their weights are broadcast,
and only the other terms' rows are shuffled by term.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.functions.exprs import argmax, softmax
from lexlab.operators.counting import word_counts
from lexlab.session import stage_table


def term_counts(df: DataFrame, text_col: str = "sentence", key_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``key, keep..., term, n`` of whole texts: one shuffle, of the texts."""
    return word_counts(df, text_col, [key_col, *keep])


@dataclass
class TermModel:
    """``params``: (term string, weights array<double>), one row per term; ``bias``: one number per class."""
    params: DataFrame
    bias: list[float]

    def save(self, path: str) -> None:
        spark = self.params.sparkSession
        self.params.write.parquet(f"{path}/params")
        spark.createDataFrame(list(enumerate(self.bias)), "class int, bias double").coalesce(1).write.parquet(f"{path}/bias")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TermModel":
        bias = spark.read.parquet(f"{path}/bias").orderBy("class").collect()  # a row per class
        return TermModel(spark.read.parquet(f"{path}/params"), [r["bias"] for r in bias])


def fit_term_bayes(counts: DataFrame, labels: DataFrame, n_classes: int, smoothing: float = 1.0) -> TermModel:
    """Multinomial naive Bayes over the whole vocabulary.

    ``counts`` are rows ``label, term, n`` of the train documents, ``labels`` a
    row with ``label`` per train document (documents without terms count for the
    prior).  Only totals reach the driver.  Rows whose label is NULL or outside the
    classes are left out; a class without documents has a bias of -1e300."""
    inside = F.col("label").between(0, n_classes - 1)
    per_term = (counts.filter(inside).groupBy("term")
                .agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(n_classes)]))
    per_term = stage_table(per_term, "term-counts")
    total = per_term.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"n{c}") for c in range(n_classes)]).first()
    docs = {r["label"]: r["count"] for r in labels.filter(inside).groupBy("label").count().collect()}
    n_docs = sum(docs.values())
    weights = [F.log((F.col(f"n{c}") + F.lit(smoothing)) / F.lit(total[f"n{c}"] + smoothing * total["v"])) for c in range(n_classes)]
    bias = [math.log(docs[c] / n_docs) if docs.get(c) else -1e300 for c in range(n_classes)]
    return TermModel(per_term.select("term", F.array(*weights).alias("weights")), bias)


def score_terms(docs: DataFrame, counts: DataFrame, model: TermModel, key_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``probs``, ``pred`` and ``confidence``.

    ``counts`` are rows ``key, term, n`` of the documents.  Terms that the
    model does not have add nothing; documents without any term of it get the
    biases' prediction.  Keys must be unique in ``docs`` and not NULL."""
    counts = stage_table(counts.select(key_col, "term", "n"), "doc-terms")
    classes = range(len(model.bias))
    total = counts.count()
    hot = counts.groupBy("term").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") * 1000 > total).select("term")  # less than 1000
    hot = stage_table(hot.join(model.params, "term", "left"), "hot-terms")
    near = counts.join(F.broadcast(hot), "term")
    far = counts.join(F.broadcast(hot.select("term")), "term", "left_anti").join(model.params, "term")
    parts = [rows.select(key_col, *[(F.col("n") * F.col("weights")[c]).alias(f"s{c}") for c in classes]) for rows in (near, far)]
    sums = parts[0].unionByName(parts[1]).groupBy(key_col).agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in classes])
    logits = F.array(*[F.coalesce(F.col(f"s{c}"), F.lit(0.0)) + F.lit(float(model.bias[c])) for c in classes])
    out = docs.join(sums, key_col, "left").withColumn("_z", logits)
    return (out.withColumn("probs", softmax("_z")).withColumn("pred", argmax("_z"))
            .withColumn("confidence", F.element_at("probs", F.col("pred") + 1)).drop("_z", *[f"s{c}" for c in classes]))
