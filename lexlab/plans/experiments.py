"""Experiment results that are pure functions of (data, seed).

Rungs (feature set = "backbone", method):
* word  / eval_only : fixed head on hashed word counts, weights from the seed
* word  / head_only : multinomial naive Bayes fitted on the seed's resample of the train split
* emb   / eval_only : fixed head on the frozen 64-d embeddings
* emb   / head_only : nearest-centroid head fitted on the seed's resample

All models of one feature set are scored in a single projection, stacked,
and reduced to macro-F1 per (model, split) with one aggregation; the
results table then has one row per (experiment, seed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.constants import LADDER_SEEDS
from lexlab.functions.exprs import half_up_pct2
from lexlab.operators import heads as H
from lexlab.operators import metrics as M
from lexlab.plans import scoring as S

G_MS = ["model_id", "split"]


def _results_from_f1(f1: DataFrame, backbone: str, head_method: str, head_model: str,
                     eval_params: int, head_params: int) -> DataFrame:
    """(model_id, split, macro_f1) -> D11 rows; model ids end in ``_s<seed>``,
    and each is a run of its own."""
    w = f1.groupBy("model_id").agg(
        F.max(F.when(F.col("split") == "test", F.col("macro_f1"))).alias("test_f1_macro"),
        F.max(F.when(F.col("split") == "validation", F.col("macro_f1"))).alias("val_f1_macro"))
    is_head = F.col("model_id").startswith(head_model + "_s")
    method = F.when(is_head, F.lit(head_method)).otherwise(F.lit("eval_only"))
    exp_id = F.concat(F.lit(backbone + "_"), method)
    trainable = F.when(is_head, F.lit(head_params)).otherwise(F.lit(0)).cast("bigint")
    total = F.when(is_head, F.lit(head_params)).otherwise(F.lit(eval_params)).cast("bigint")
    out = w.select(exp_id.alias("experiment_id"), F.lit(backbone).alias("backbone"),
                   method.alias("method"), F.regexp_extract("model_id", r"_s(\d+)$", 1).cast("int").alias("seed"),
                   "test_f1_macro",
                   F.when(is_head, F.col("val_f1_macro")).cast("double").alias("val_f1_macro"),
                   trainable.alias("trainable_params"), total.alias("total_params"))
    out = out.withColumn("trainable_pct", F.when(F.col("method") == "eval_only", F.lit(0.0))
                         .otherwise(half_up_pct2(F.col("trainable_params"), F.col("total_params"))))
    return out.withColumn("output_dir", F.when(
        F.col("method") != "eval_only", F.format_string("%s_seed%d", F.col("experiment_id"), F.col("seed"))))


def word_results(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = LADDER_SEEDS) -> DataFrame:
    P = S.text_predictions(spark, sf_dir, seeds, nb=False, keep=("doc_id", "split", "label"), nb_seeds=seeds,
                           splits=("validation", "test"))
    f1 = M.macro_f1(M.confusion_long(P, S.TEXT_CLASSES, G_MS), G_MS)
    c, d = S.TEXT_CLASSES, H.NUM_FEATURES
    return _results_from_f1(f1, "word", "head_only", "nb", c * d, c * d + c)


def emb_predictions(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = LADDER_SEEDS,
                    n_classes: int | None = None) -> DataFrame:
    wide = S.emb_scored(spark, sf_dir, seeds, centroid=True, n_classes=n_classes)
    names = [f"fixed_s{s}" for s in seeds] + [f"centroid_s{s}" for s in seeds]
    return S.stack_models(wide.withColumnRenamed("vec_id", "doc_id"), names, ["doc_id", "split", "label"])


def emb_results(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = LADDER_SEEDS) -> DataFrame:
    c = S.emb_classes(spark, sf_dir)
    P = emb_predictions(spark, sf_dir, seeds, c)
    f1 = M.macro_f1(M.confusion_long(P, c, G_MS), G_MS)
    d = S.EMB_DIM
    return _results_from_f1(f1, "emb", "head_only", "centroid", c * d, c * d + c)


def fixed_results(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = LADDER_SEEDS) -> DataFrame:
    return word_results(spark, sf_dir, seeds).unionByName(emb_results(spark, sf_dir, seeds))


# ---------------------------------------------------------------------------
# learning curve: NB on a growing, seed-ordered share of the train split
# ---------------------------------------------------------------------------
def nb_epoch_log(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = LADDER_SEEDS,
                 epochs: int = 3) -> DataFrame:
    """(run, epoch, f1_macro): a learning curve.  Step e trains on the train rows
    whose seeded hash fraction is below e/epochs; F1 on the validation split.

    The subsets of all seeds and steps are flags of one pass over the words
    (:func:`heads.fit_naive_bayes_many`); the validation rows are scored by
    every (seed, step) model in one projection.
    """
    from lexlab.functions.exprs import seeded_md5, unit_interval
    feats = S.text_features_table(spark, sf_dir)
    c = S.TEXT_CLASSES
    train = feats.filter(F.col("split") == "train").select("doc_id", "label", "idx")
    steps = [(s, e) for s in seeds for e in range(1, epochs + 1)]
    members = [unit_interval(seeded_md5(s, "doc_id")) < F.lit(float(e)) / F.lit(float(epochs)) for s, e in steps]
    tables = H.fit_naive_bayes_many(train, members, "idx", "label", c)
    val = feats.filter(F.col("split") == "validation").select("doc_id", "label", "idx")
    names = []
    for (s, e), table in zip(steps, tables):
        name = f"r{s}_e{e}"
        val = H.with_prediction(val, table.logits("idx"), prefix=name + "_")
        names.append(name)
    P = S.stack_models(val, names, ["doc_id", "label"])
    f1 = M.macro_f1(M.confusion_long(P, c, ["model_id"]), ["model_id"])
    return f1.select(
        F.concat(F.lit("word_head_only_seed"), F.regexp_extract("model_id", r"^r(\d+)_", 1)).alias("run"),
        F.regexp_extract("model_id", r"_e(\d+)$", 1).cast("int").alias("epoch"),
        F.col("macro_f1").alias("f1_macro"))
