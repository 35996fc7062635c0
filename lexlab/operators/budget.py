"""Parameter catalogue and trainable-parameter budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlab.constants import HEAD_KEYS
from lexlab.functions.exprs import half_up_pct2


def is_head_param(name: str | Column, keys: Sequence[str] = HEAD_KEYS) -> Column:
    """True when any head key occurs in the parameter name (substring test)."""
    n = F.col(name) if isinstance(name, str) else name
    out = F.lit(False)
    for k in keys:
        out = out | n.contains(k)
    return out


def mark_trainable(params: DataFrame, name_col: str = "name", keys: Sequence[str] = HEAD_KEYS) -> DataFrame:
    """Freeze everything except head parameters."""
    return params.withColumn("trainable", is_head_param(name_col, keys))


def param_budget(params: DataFrame, model_col: str = "model_id") -> DataFrame:
    """Per model: trainable, total, frozen parameters and the trainable share
    in percent (2 decimals, half-up on the exact ratio; 0.0 for an empty model)."""
    agg = params.groupBy(model_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_tensors"),
        F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0)).cast("bigint")
        .alias("trainable_params"),
        F.coalesce(F.sum("numel"), F.lit(0)).cast("bigint").alias("total_params"))
    return (agg.withColumn("frozen_params", F.col("total_params") - F.col("trainable_params"))
               .withColumn("trainable_pct", half_up_pct2(F.col("trainable_params"), F.col("total_params"))))


def vocab_param_catalogue(docs: DataFrame, tokens_col: str = "tokens", domain_col: str = "lang",
                          dim: int = 64, n_classes: int = 3) -> DataFrame:
    """Catalogue of one bag-of-words classifier per domain: a frozen word vector
    per distinct token of that domain's documents, plus a two-layer head.

    (model_id, name, numel, trainable) -- grows with the vocabulary.  A word's
    tensor is named by a digest, so no token can look like a head's name.
    """
    words = (docs.select(domain_col, F.explode(F.array_distinct(tokens_col)).alias("token"))
             .distinct()   # partial aggregation map-side; one row per (domain, token) per partition
             .select(F.concat(F.lit("word_"), F.col(domain_col)).alias("model_id"),
                     F.concat(F.lit("embeddings.word."), F.md5("token")).alias("name"),
                     F.lit(dim).cast("bigint").alias("numel")))
    head = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).cast("bigint").alias("numel"))
                     for n, k in (("pre_classifier.weight", dim * dim), ("pre_classifier.bias", dim),
                                  ("classifier.weight", dim * n_classes), ("classifier.bias", n_classes))])
    heads = (docs.select(domain_col).distinct()
             .select(F.concat(F.lit("word_"), F.col(domain_col)).alias("model_id"),
                     F.explode(head).alias("h"))
             .select("model_id", "h.name", "h.numel"))
    return mark_trainable(words.unionByName(heads))
